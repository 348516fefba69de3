"""Filter audit, ranked search and SimHash: brute force on small tables, edge rows, SQL twins."""

import itertools
import math
import random
import re

import numpy as np
import pytest
import xxhash

from conftest import SF001
from oracle_harness import compare
from salescope.llm import filter_audit, lexical_search, simhash

LONG = " ".join(f"w{i % 7000}" for i in range(60000))
EDGES = [(1, None, None), (2, "", ""), (3, " \n\t", "en"), (4, "one", "en"), (5, "One two", "de"), (5, "One two", "de"), (None, "One two", None), (7, LONG, "en"), (8, "ONE # é", "fr")]


def docs_of(spark, rows):
    """``rows`` of (doc_id, text, lang); the other columns clash with names used inside."""
    schema = "doc_id long, text string, lang string, n string, failed string, fp string, terms string, rank string"
    return spark.createDataFrame([(*r, "x", "y", "z", "u", "v") for r in rows], schema).repartition(3)


@pytest.mark.parametrize("key", ["op11_filter_audit", "op12_lexical_search"])
def test_twins(spark, key):
    assert compare(spark, SF001, [key], verbose=False)[key][0] == "ok"


# ---------------------------------------------------------------- filter audit


def audited(rows, labels):
    """All orders walked document by document."""
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1} for k in (0, 1))
    docs = []
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        twin = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                 "D": bool(re.search(r"[#$%&*|]", text)), "E": twin}
        docs.append((lang or "", fails, i in good and i is not None, i in toxic and i is not None))
    out, shapley = {}, {}
    for part in {d[0] for d in docs}:
        for order in itertools.permutations("ABCDE"):
            live = {k for k, d in enumerate(docs) if d[0] == part}
            gone = set()
            for step, f in enumerate(order, 1):
                hit = {k for k in live if docs[k][1][f]}
                shapley[part, f] = shapley.get((part, f), 0) + len(hit)
                out[part, "".join(order), step] = [len(live - hit), len(hit), sum(docs[k][1][f] for k in gone),
                    sum(d[0] == part and d[1][f] and sum(d[1].values()) == 1 for d in docs), sum(docs[k][2] for k in hit), sum(docs[k][3] for k in hit)]
                live -= hit
                gone |= hit
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_matches_a_walk_over_all_orders(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["Aa", "bb", "#c", f"d{r.randrange(200)}"]) for _ in range(r.randrange(0, 220))), r.choice(["en", "de", None])) for i in range(40)]
    rows += [(100 + i, rows[i % 5][1], "en") for i in range(20)] + EDGES
    labels = [(i, r.randrange(2), r.randrange(2)) for i in range(0, 120, 2)] + [(5, 0, 1), (5, 1, 0), (None, 1, 1), (999, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.filter_audit(docs_of(spark, rows), frame).collect()
    assert len(found) == 600 * len({lang or "" for _, _, lang in rows}) and {tuple(f) for f in found} == audited(rows, labels)


def test_audit_of_no_documents_and_no_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs_of(spark, EDGES).limit(0), labels).count() == 0
    assert filter_audit.filter_audit(docs_of(spark, EDGES), labels).agg({"good_lost": "sum"}).first()[0] == 0


def test_path_counts():
    forward, backward = filter_audit.path_counts(5)
    assert all(forward[s] == math.factorial(s.bit_count()) and backward[s] == math.factorial(5 - s.bit_count()) for s in range(32))


# ---------------------------------------------------------------- ranked search


def searched(rows, items, k):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    docs = [(i, cut(t)) for i, t, _ in rows]
    docs = [d for d in docs if d[1]]
    n, total = len(docs), sum(len(t) for _, t in docs)
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(cut(t))
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in set(d) for _, d in docs) + 1))) for q in queries.values() for t in q}
    out = []
    for item, q in queries.items():
        scores = []
        for i, d in docs:
            m = 50 + 50 * len(d) * n // total
            scores.append((-sum(weight[t] * (10**9 * d.count(t) // (1000 * d.count(t) + 20 * m)) for t in q), i is not None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(s for s in scores if s[0])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("group,block", [(50_000, 40_000), (20, 60)])
def test_search_matches_brute_force(spark, monkeypatch, group, block):
    # by value, the workers see these settings
    monkeypatch.setattr(lexical_search, "QUERY_TERMS", group)
    monkeypatch.setattr(lexical_search, "BLOCK_POSTINGS", block)
    r = random.Random(7)
    word = lambda: f"t{int(r.paretovariate(0.7)) % 90}"
    rows = [(i, " ".join(word() for _ in range(r.randrange(1, 60))), None) for i in range(150)]
    rows += [(1000 - i, rows[3][1], None) for i in range(9)] + EDGES  # ties
    items = [(i, " ".join(word() for _ in range(r.randrange(1, 12)))) for i in range(12)] + [(3, "T1, t2!"), (None, "one"), (50, ""), (51, None), (52, "absent"), (53, "É é")]
    frame = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, score string")
    found = lexical_search.lexical_search(docs_of(spark, rows), frame, k=7).collect()
    assert sorted((tuple(f) for f in found), key=str) == searched(rows, items, 7)


def test_blocks_come_to_python_a_few_at_a_time(spark, monkeypatch):
    seen, keep, conf = [], lexical_search.stored, "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setattr(lexical_search, "stored", lambda df, name: seen.append((name, spark.conf.get(conf))) or keep(df, name))
    before, items = spark.conf.get(conf), spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert lexical_search.lexical_search(docs_of(spark, [(1, "one", "en"), (2, "two two", "en")]), items).count() == 2
    assert ("search-hits", str(lexical_search.BLOCK_BATCH)) in seen and spark.conf.get(conf) == before


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert lexical_search.lexical_search(docs_of(spark, EDGES).limit(0), items).count() == 0
    assert lexical_search.lexical_search(docs_of(spark, EDGES), items.limit(0)).count() == 0


def test_pair_bounds_skip_more_than_single_maxima():
    r = np.random.default_rng(3)
    n = 4000
    ids = np.arange(n)
    # terms 0 and 1 never meet where both are strong, 2 is rare and strong
    docs = [np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32), np.sort(r.choice(n, 60, replace=False)).astype(np.int32)]
    first = r.integers(0, 600, n)
    impacts = [first, 600 - first, r.integers(800, 900, 60)]
    terms = np.repeat([0, 1, 2], [n, n, 60])
    flat = np.concatenate(docs), terms, np.concatenate(impacts).astype(np.int64)
    # the first two terms alone could reach 1100, as a pair they reach 600
    assert lexical_search.prefix_bounds([599, 600, 899], [-1, -1, -1], [0, 0, 0])[2] == 1199
    block = lexical_search.build_block(ids, *flat, [(0, 1)])
    assert block["pair_maxima"].tolist() == [600]
    best = [lexical_search.Best(50)]
    best[0].add(np.arange(-50, 0), np.full(50, 1100))
    assert lexical_search.search_block(block, ids, [np.array([0, 1, 2])], best, np.full(3, -1)) == 60
    total = np.zeros(n, np.int64)
    np.add.at(total, flat[0], flat[2])
    want = sorted(list(zip(-total, ids)) + [(-1100, i) for i in range(-50, 0)])[:50]
    assert [(-s, i) for s, i in zip(best[0].scores, best[0].ids)] == want


# ---------------------------------------------------------------- SimHash


def printed(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius=4):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= radius:
            root[find(a)] = find(b)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("tile", [32768, 16])
def test_simhash_matches_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    r = random.Random(2)
    rows = list(EDGES)
    for base in range(15):
        text = [f"w{r.randrange(500)}" for _ in range(r.choice([3, 5, 60, 400]))]
        for k in range(7):
            copy = list(text)
            copy[r.randrange(len(copy))] = f"x{k % 4}"
            rows.append((100 + 10 * base + k, " ".join(copy), None))
    found = simhash.simhash_components(docs_of(spark, rows)).collect()
    fps = {t: printed(t) for _, t, _ in rows}
    root = components(sorted(set(fps.values())))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[root[fps[t]]] = min(i, least.get(root[fps[t]], i))
    want = sorted(((i, fps[t], least.get(root[fps[t]])) for i, t, _ in rows), key=str)
    assert sorted(((f.doc_id, f.fp % 2**64, f.component_id) for f in found), key=str) == want
    assert len(set(root.values())) < len(root)
    assert simhash.simhash_components(docs_of(spark, rows).limit(0)).count() == 0


def test_tiles_connect_what_all_pairs_connect():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 1500, dtype=np.uint64)
    flips = np.uint64(1) << r.integers(0, 63, (2, 900)).astype(np.uint64)
    dense = base[0] ^ (np.uint64(1) << np.arange(60, dtype=np.uint64))
    fps = np.unique(np.concatenate([base, base[:900] ^ flips[0] ^ flips[1], dense]))
    r.shuffle(fps)
    one, two = fps[:1000], fps[1000:]
    links = simhash.tile_links(one, None, 4) + simhash.tile_links(two, None, 4) + simhash.tile_links(one, two, 4)
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    graph = {int(f): {int(f)} for f in fps}
    for a, b in links:
        graph[a].add(b), graph[b].add(a)
    want = components([int(f) for f in fps])

    def reach(start):
        seen, todo = {start}, [start]
        while todo:
            for other in graph[todo.pop()] - seen:
                seen.add(other)
                todo.append(other)
        return seen

    for start in {want[f] for f in want}:
        assert reach(start) == {f for f in want if want[f] == start}
