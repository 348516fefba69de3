"""Training-data operators: edge rows, brute force and round trips on small tables."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from salescope.llm import decontamination, exact_dedup, jaccard_join, lm_score, mixing, substring_dedup, toxicity, warc

DOCS = "doc_id long, text string, source string, node string, key string, words string"


def docs_of(spark, rows):
    """``rows`` of (doc_id, text); the other columns clash with names used inside."""
    return spark.createDataFrame([(i, t, "s", "x", "y", "z") for i, t in rows], DOCS).repartition(3)


EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two"), (5, "one two"), (None, "a b c d"), (7, "long word " * 30000)]


def words(seed, n, kinds=300):
    r = random.Random(seed)
    return [f"w{r.randrange(kinds)}" for _ in range(n)]


def test_jaccard_components_match_brute_force(spark):
    r, rows = random.Random(5), []
    for base in range(12):
        text = words(base, r.choice([6, 12, 40, 90, 200]))
        for _ in range(8):
            copy = list(text)
            for _ in range(r.randrange(3)):
                copy[r.randrange(len(copy))] = "changed" + str(r.randrange(50))
            rows.append((len(rows), " ".join(copy)))
    for width, percent in ((3, 90), (5, 80)):
        sets = {i: {tuple(t.split()[k : k + width]) for k in range(max(1, len(t.split()) - width + 1))} for i, t in rows}
        root = {i: i for i in sets}
        for a, b in itertools.combinations(sets, 2):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {i: x if c == y else c for i, c in root.items()}
        found = jaccard_join.similar_components(docs_of(spark, rows), width, percent).collect()
        assert {(f.doc_id, f.n_shingles, f.component_id) for f in found} == {(i, len(sets[i]), root[i]) for i in sets}


def counted(monkeypatch, module):
    """(name, rows) of each table that ``module`` stores from now on."""
    kept, plain = [], module.stored

    def stored(df, name):
        out = plain(df, name)
        kept.append((name, out.count()))
        return out

    monkeypatch.setattr(module, "stored", stored)
    return kept


def test_jaccard_moves_keys_and_sets_in_parts(spark, monkeypatch):
    r, rows = random.Random(9), []
    for base in range(10):
        text = words(base, 60)
        for _ in range(5):
            copy = list(text)
            copy[r.randrange(len(copy))] = "changed" + str(r.randrange(50))
            rows.append((len(rows), " ".join(copy)))
    docs = docs_of(spark, rows)
    whole = sorted(jaccard_join.similar_components(docs, 3, 80).collect())
    assert len({f.component_id for f in whole}) < len(rows)
    monkeypatch.setattr(jaccard_join, "KEYS_AT_ONCE", 200, raising=False)
    monkeypatch.setattr(jaccard_join, "VERIFY_BYTES", 4000, raising=False)
    kept = counted(monkeypatch, jaccard_join)
    assert sorted(jaccard_join.similar_components(docs, 3, 80).collect()) == whole
    parts = [n for name, n in kept if name == "jaccard-nodes-of-keys"]
    assert max(parts[: jaccard_join.SLICES]) < sum(parts[: jaccard_join.SLICES]) / 2
    assert [name for name, _ in kept].count("jaccard-links") > 3


def test_jaccard_large_sets_that_only_share_a_passage_do_not_travel(spark, monkeypatch):
    passage = words(1, 600, 10**9)
    rows = [(i, " ".join(passage + words(100 + i, 2400, 10**9))) for i in range(8)]
    kept = counted(monkeypatch, jaccard_join)
    found = jaccard_join.similar_components(docs_of(spark, rows), 5, 80).collect()
    assert all(f.component_id == f.doc_id for f in found)
    by = [(name, n) for name, n in kept if name in ("jaccard-nodes-of-keys", "jaccard-sets")]
    assert by[0][1] > 0 and sum(n for name, n in by if name == "jaccard-sets") == 0


def test_jaccard_wide_sketch_is_a_lower_bound():
    r = np.random.default_rng(3)
    for n, extra in ((3, 0), (700, 90), (1000, 60), (5000, 3000)):
        both = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        one, two = (np.unique(np.concatenate([both, r.integers(0, 2**63, k).astype(np.uint64)])) for k in (extra, extra // 2))
        least = jaccard_join.apart_at_least(jaccard_join.wide_sketch(one), jaccard_join.wide_sketch(two))
        assert 0.4 * len(np.setxor1d(one, two)) <= least <= len(np.setxor1d(one, two))


def test_jaccard_edges(spark):
    found = jaccard_join.similar_components(docs_of(spark, EDGES), 3, 90).collect()
    by = {f.doc_id: (f.n_shingles, f.component_id) for f in found}
    assert len(found) == len(EDGES) and by[1] == (0, 1) and by[3] == (0, 3) and by[5] == (1, 5) and by[None] == (2, None)
    assert by[7][0] == 2
    assert jaccard_join.keep_one_similar(docs_of(spark, EDGES), 3, 90).count() == len(EDGES)
    assert jaccard_join.similar_components(docs_of(spark, EDGES).limit(0), 3, 90).count() == 0


def test_leaks_tolerate_substitutions_and_spare_clean_texts(spark):
    item = words(1, 30)
    changed = list(item)
    changed[9] = changed[21] = "other"
    rows = [(101, " ".join(words(2, 20) + item)), (102, " ".join(changed + words(3, 9))), (103, " ".join(words(4, 400))), (104, "tiny item here"), (105, "tiny item"), *EDGES]
    items = spark.createDataFrame([(10, " ".join(item).upper(), "x"), (11, "tiny item here", "x"), (12, None, "x"), (13, "", "x")], "item_id long, text string, h string")
    found = decontamination.leaks(docs_of(spark, rows), items).collect()
    assert {(f.doc_id, f.item_id) for f in found} == {(101, 10), (102, 10), (104, 11)}
    assert decontamination.drop_leaks(docs_of(spark, rows), items).count() == len(rows) - 3
    assert decontamination.leaks(docs_of(spark, rows), items.limit(0)).count() == 0
    assert decontamination.leaks(docs_of(spark, rows).limit(0), items).count() == 0


def test_leaks_find_every_pair_of_substitutions(spark):
    item = [f"item{i}" for i in range(12)]
    swap = lambda at: " ".join("other" if i in at else w for i, w in enumerate(item))
    pairs = list(itertools.combinations(range(12), 2))
    rows = [(i, swap(at)) for i, at in enumerate(pairs)] + [(100 + i, swap(at)) for i, at in enumerate(itertools.combinations(range(12), 3))]
    fifth = [f"long{i}" for i in range(60)]
    rows.append((1000, " ".join("other" if i % 5 == 2 else w for i, w in enumerate(fifth))))
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(fifth))], "item_id long, text string")
    found = decontamination.leaks(docs_of(spark, rows), items).collect()
    assert {(f.doc_id, f.item_id, f.most_equal) for f in found} == {(i, 1, 10) for i in range(66)} | {(1000, 2, 10)}
    with pytest.raises(ValueError):
        decontamination.leaks(docs_of(spark, rows), items, equal=9)


def test_repeated_lines_go_and_offsets_fit(spark):
    line = "This very line with more than eight words stands in several texts."
    rows = [(3, f"first one\n{line}\nend"), (1, f"intro words. {line}"), (2, line.upper().replace(" ", "  ")), *EDGES]
    found = substring_dedup.repeated_units(docs_of(spark, rows)).collect()
    texts = dict(rows[:3])
    assert {f.doc_id for f in found} >= {2, 3} and 1 not in {f.doc_id for f in found}
    assert all(" ".join(texts[f.doc_id][f.start : f.end].split()).lower() == line.lower() for f in found if f.doc_id in (2, 3))
    out = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs_of(spark, rows[:3])).collect()}
    assert out[3] == "first one\n\nend" and out[1] == rows[1][1] and out[2] == ""
    assert substring_dedup.repeated_units(docs_of(spark, rows).limit(0)).count() == 0


def test_repeated_passages_of_short_sentences_go_whole(spark):
    passage = " ".join(" ".join(words(50 + k, 6)).capitalize() + f" n{k}." for k in range(10))
    rows = [(1, "Own begin of one here. " + passage + " Own end."), (2, "Other begin. " + passage + " Last words of two."), (3, "Own end. Yes.")]
    found = substring_dedup.repeated_units(docs_of(spark, rows)).collect()
    assert {f.doc_id for f in found} == {2}
    assert {f.first_doc_id for f in found} == {1} and {f.occurrences for f in found} == {2}
    out = {r.doc_id: (r.text, r.removed) for r in substring_dedup.remove_repeats(docs_of(spark, rows)).collect()}
    start = rows[1][1].index(passage)
    assert out[1] == (rows[0][1], []) and out[3] == (rows[2][1], [])
    assert out[2] == ("Other begin.  Last words of two.", [(start, start + len(passage))])


def test_repeated_runs_match_brute_force(spark):
    r, rows = random.Random(3), []
    for i in range(90):
        rows.append((i, "".join(" ".join(words(r.randrange(3), r.choice([2, 3, 5, 9]))) + r.choice([". ", "\n", "! "]) for _ in range(r.randrange(9)))))
    runs, least, most = {}, 6, 9
    for i, text in rows:
        pieces = [(m.start(), m.end(), m.group().split()) for m in re.finditer(r"\S[^.!\n]*[.!]?", text)]
        size = lambda a, b: sum(len(p[2]) for p in pieces[a:b])
        for a, b in itertools.combinations(range(len(pieces) + 1), 2):
            from_first = size(a, a + 1) < least and size(a, b) >= most > size(a, b - 1)
            to_last = size(b - 1, b) < least and size(a, b) >= most > size(a + 1, b)
            if (b == a + 1 and size(a, b) >= least) or from_first or to_last:
                content = tuple(w for p in pieces[a:b] for w in p[2])
                runs.setdefault(content, []).append((i, pieces[a][0], pieces[b - 1][1], size(a, b)))
    want = {(*at, *min(places)[:2], len(places)) for places in runs.values() for at in places if at != min(places)}
    got = list(map(tuple, substring_dedup.repeated_units(docs_of(spark, rows), least, most).collect()))
    assert len(got) == len(want) > 50 and set(got) == want
    left = {" ".join(p.split()) for row in substring_dedup.remove_repeats(docs_of(spark, rows), least, most).collect() for p in re.findall(r"\S[^.!\n]*[.!]?", row.text)}
    assert left >= {" ".join(p.split()) for _, text in rows for p in re.findall(r"\S[^.!\n]*[.!]?", text)}


def test_warc_round_trip(spark, scratch):
    big = "<p>" + "x" * 200 + "é</p>"
    rows = [(1, "http://a/ b\r\nc", big, "d"), (5000, "http://b", big, "d"), (2, None, None, "d"), (3, "u", "short", "d"), (4, "u", "short", "d"), (6, "u", "y" * 300000, "d"), (-9, "v", big, "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    marks = []
    for k in range(2):
        manifest = warc.write_warc(pages.repartition(1 + k * 3), f"file://{scratch}/{k}", roll_bytes=200)
        marks.append(sorted(map(tuple, manifest.collect())))
    assert marks[0] == marks[1] and len(marks[0]) > 2
    got = {r.page_id: r for r in warc.read_warc(spark, f"file://{scratch}/0").collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {
        -9: ("response", None), 1: ("revisit", -9), 5000: ("revisit", -9), 2: ("response", None), 3: ("response", None), 4: ("response", None), 6: ("response", None)}
    assert bytes(got[6].payload) == b"y" * 300000 and got[1].payload_bytes == len(big.encode()) and got[2].payload_bytes == 0
    assert warc.read_warc(spark, f"file://{scratch}/0").count() == len(rows)
    warc.write_warc(pages.limit(0), f"file://{scratch}/empty")
    assert warc.read_warc(spark, f"file://{scratch}/empty").count() == 0


def test_lm_probabilities_sum_to_one_and_prefer_learnt_text(spark):
    learnt = docs_of(spark, [(i, " ".join(words(i, 60, 20))) for i in range(40)] + EDGES)
    tree = lm_score.ContextTree(lm_score.context_table(learnt.select(F.coalesce("text", F.lit("")).alias("text")), 64))
    assert (abs((2.0 ** tree.bits.astype(float)).sum(axis=1) - 1) < 1e-4).all()
    like, unlike = tree.score([" ".join(words(99, 60, 20)).encode(), bytes(range(33, 120)) * 3])
    assert like / 200 > unlike / 261 and math.isfinite(unlike)
    scored = lm_score.ctw_scores(learnt, F.lit(True), ["doc_id"]).collect()
    assert len(scored) == 40 + len(EDGES) and all(math.isfinite(s.score) and s.score <= 0 for s in scored)
    assert lm_score.ctw_scores(learnt.limit(0), F.lit(True), ["doc_id"]).count() == 0


def test_lm_scores_use_every_context_by_either_way(spark):
    learnt = docs_of(spark, [(100 + i, " ".join(words(i, 60, 20)) + " é") for i in range(40)] + EDGES)
    texts = learnt.select(F.coalesce("text", F.lit("")).alias("text"))
    tree = lm_score.ContextTree(lm_score.context_table(texts, 1 << 40))
    want = {r.doc_id: tree.score([(r.text or "").encode()])[0] for r in learnt.collect()}
    for limit in (0, 10**6):
        found = lm_score.ctw_scores(learnt, F.lit(True), ["doc_id"], split=1, broadcast_grams=limit).collect()
        assert len(found) == 40 + len(EDGES)
        assert all(f.score == pytest.approx(want[f.doc_id], rel=1e-4, abs=1e-3) for f in found)


def test_lm_broadcasts_many_grams_in_parts(spark, monkeypatch):
    learnt = docs_of(spark, [(100 + i, " ".join(words(i, 60, 20)) + " é") for i in range(20)] + EDGES[:-1])
    want = sorted((r.doc_id or -1, r.n_bytes, r.score) for r in lm_score.ctw_scores(learnt, F.lit(True), ["doc_id"]).collect())
    monkeypatch.setattr(lm_score, "joined_scores", None)  # no gram of a text is shuffled
    kept = counted(monkeypatch, lm_score)
    found = sorted((r.doc_id or -1, r.n_bytes, r.score) for r in lm_score.ctw_scores(learnt, F.lit(True), ["doc_id"], broadcast_grams=200).collect())
    n = next(n for name, n in kept if name == "lm-bits")
    assert 200 < n <= 200 * lm_score.PASSES and [name for name, _ in kept].count("lm-part") == -(-n // 200)
    assert [f[:2] for f in found] == [w[:2] for w in want] and [f[2] for f in found] == pytest.approx([w[2] for w in want], rel=1e-9)


def test_lm_keeps_what_it_learnt_in_a_larger_corpus(spark):
    rare = "Quokkas juggle vexing zephyrs."
    few = [(i, rare) for i in range(6)] + [(10, rare)]
    much = few + [(100 + i, " ".join(words(i, 40000, 20))) for i in range(4)]
    got = {}
    for rows in (few, much):
        scored = docs_of(spark, rows)
        found = lm_score.ctw_scores(scored, scored["doc_id"] != 10, ["doc_id"]).collect()
        got[len(rows)] = next(f.score for f in found if f.doc_id == 10)
    # about 31 bytes; without contexts of its own they cost a digit each
    assert got[len(much)] > got[len(few)] - 8


@pytest.mark.parametrize("hot", [1, 30, 100_000])
def test_unigram_scores_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(lm_score, "HOT_TOKENS", hot)
    rows = [(100 + i, " ".join(words(i, 80, 40)) + " Zebra\x0bÉa") for i in range(30)] + [r for r in EDGES if r[0] not in (5, None)]
    docs = docs_of(spark, rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 3 != 0).alias("train"))
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    counts = {}
    for i, t in rows:
        for w in cut(t) if i % 3 else []:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    found = {r.doc_id: r for r in lm_score.unigram_scores(docs, "doc_id").collect()}
    assert len(found) == len(rows)
    for i, t in rows:
        c = [counts.get(w, 0) for w in cut(t)]
        base = sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in c)
        assert (found[i].n_tokens, found[i].n_known, found[i].train_tokens) == (len(c), sum(x > 0 for x in c), n)
        assert found[i].base_score == pytest.approx(base, rel=1e-9)


def test_swapped_identities_do_not_move_the_score():
    rows = [[toxicity.bucket(w) for w in t.split()] for t in ["awful women here", "awful women there", "nice men here", "nice men there"] * 5]
    labels = np.array([1, 1, 0, 0] * 5)
    rows = [np.array(sorted(r), np.int32) for r in rows]
    gap = lambda w: abs(w[toxicity.bucket("women")] - w[toxicity.bucket("men")])
    women, men = toxicity.bucket("women"), toxicity.bucket("men")
    swaps = [([women], [men]) if women in r else ([men], [women]) for r in rows]
    free, held = (toxicity.fit(rows, labels, swaps, penalty=p)[0] for p in (0.0, 20.0))
    assert gap(held) < 0.2 * gap(free) and held[toxicity.bucket("awful")] > 0


def test_training_rows_stay_in_the_arrays_they_come_in(spark, monkeypatch):
    rows = [[1, 5, 9], [5], [], [1, 9]] * 6
    swaps = [([1], [7]), ([], []), ([5, 9], [1])] * 8
    labels = np.array([1, 0, 0, 1] * 6)
    lists = [toxicity.Rows.of_lists(pa.array(x, pa.list_(pa.int32()))) for x in (rows, [a for a, _ in swaps], [b for _, b in swaps])]
    for got, want in zip(toxicity.fit(lists[0], labels, tuple(lists[1:])), toxicity.fit(rows, labels, swaps)):
        assert np.array_equal(got, want)
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toPandas", lambda self: pytest.fail("rows come as Python objects"))
    docs = docs_of(spark, [(i, "nice kind words" if i % 2 else "awful bad words") for i in range(20)])
    model = toxicity.train(docs, docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic"), F.lit(True))
    assert model.n_counterfactuals == 0 and model.weights


def test_swapped_sentences_score_alike(spark):
    # labels skewed against the first name of each pair
    r, rows = random.Random(1), []
    for i in range(400):
        name = ("muslims", "christians", "women", "girls")[2 * (i // 2 % 2) + ((i % 2 == 0) == (r.random() < 0.9))]
        rows.append((i, f"some words of {name} number{i % 7}"))
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs_of(spark, rows), labels, F.lit(True))
    names = ["muslims", "christians", "jews", "hindus", "women", "men", "girls", "boys"]
    tests = docs_of(spark, [(k, f"some words of {n}") for k, n in enumerate(names)])
    by = {names[x.doc_id]: x.score for x in tests.select("doc_id", toxicity.toxicity(tests, model).alias("score")).collect()}
    logit = lambda p: math.log(p / (1 - p))
    for group in (names[:4], names[4:]):
        at = [logit(by[n]) for n in group]
        assert max(at) - min(at) < 1, by


def test_found_groups_are_swapped_and_held_level(spark):
    # names of an invented language, one of them more often in toxic rows; insults are no names
    r, rows = random.Random(5), []
    names = [f"nam{c}ka" for c in "abcd"]
    for i in range(600):
        name = names[0] if r.random() < (0.5 if i % 2 else 0.2) else r.choice(names[1:])
        rows.append((i, f"{'grobix' if i % 2 and r.random() < 0.7 else 'milo'} w{r.randrange(40)}. su {name} lo"))
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    texts = docs_of(spark, rows).withColumn("toxic", (F.col("doc_id") % 2).cast("int"))
    common, toxicity.COMMON = toxicity.COMMON, 0.5
    try:
        assert [set(g) for g in toxicity.identity_groups(texts, 600, 300) if set(g) & set(names)] == [set(names)]
        model = toxicity.train(docs_of(spark, rows), labels, F.lit(True))
    finally:
        toxicity.COMMON = common
    assert model.n_counterfactuals >= 3 * 600
    weight = lambda n: sum(model.weights.get(f, 0.0) for f in toxicity.parts(n))
    held = [weight(n) for n in names]
    others = toxicity.turns(toxicity.IDENTITY + model.groups)
    changed = [toxicity.changes(t, others) for _, t in rows]
    # the same rows without the penalty
    free = toxicity.fit([toxicity.features(t) for _, t in rows], np.array([i % 2 for i, _ in rows]),
                        [(c[k], c[k + 1]) for c in changed for k in range(0, len(c), 2)], penalty=0.0)[0]
    loose = [sum(free[f] for f in toxicity.parts(n)) for n in names]
    assert max(held) - min(held) < 0.3 * (max(loose) - min(loose)) and weight("grobix") > 1


def test_counterfactuals_match_the_swapped_text():
    r = random.Random(2)
    groups = (("alba", "albor", "cora"), ("dim", "dimmer"))
    pool = ["alba", "albor", "cora", "dim", "dimmer", "alb", "albino", "other", "words"]
    others = toxicity.turns(groups)
    for _ in range(200):
        text = " ".join(r.choice(pool) for _ in range(r.randrange(6)))
        want = []
        for by in (1, 2):
            other = {a: g[(i + by) % len(g)] for g in groups for i, a in enumerate(g)}
            turned = " ".join(other.get(w, w) for w in text.split())
            if set(turned.split()) != set(text.split()):
                a, b = set(toxicity.features(text)), set(toxicity.features(turned))
                want += [sorted(a - b), sorted(b - a)]
        assert toxicity.changes(text, others) == want


def test_counterfactuals_occur_in_the_given_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, toxicity.trainable(F.col("doc_id")))
    assert model.n_counterfactuals > 0 and model.groups


def test_toxicity_edges(spark):
    docs = docs_of(spark, EDGES + [(i, "bad stuff" if i % 2 else "good stuff") for i in range(100, 160)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 160)] + [(None, 1), (4, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    scored = docs.select("doc_id", toxicity.toxicity(docs, model).alias("score")).collect()
    assert len(scored) == len(EDGES) + 60 and all(0 <= s.score <= 1 for s in scored)
    by = {s.doc_id: s.score for s in scored}
    assert min(by[i] for i in range(101, 160, 2)) > max(by[i] for i in range(100, 160, 2))
    assert toxicity.train(docs, labels.limit(0), F.lit(True)) is None


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.lit(b"same")])
def test_exact_dedup_keeps_largest_id(spark, digest):
    found = exact_dedup.copy_classes(docs_of(spark, EDGES), digest).collect()
    assert len(found) == len(EDGES) and sum(f.kept for f in found) == 6
    assert {(f.doc_id, f.keep_id, f.group_size) for f in found if f.doc_id in (1, 2, 5)} == {(1, 2, 2), (2, 2, 2), (5, 5, 2)}


def test_mixing_meets_targets(spark):
    r = random.Random(3)
    rows = [(i, " ".join(words(i, r.randrange(60))), f"s{i % 4}", "", "", "") for i in range(200)]
    found = mixing.mix_counts(spark.createDataFrame(rows, DOCS), block_words=16).toPandas()
    assert len(found) == 200 and (found.taken <= 2 * found["size"]).all()
    size = sum(len(re.findall(r"\S+", t[1])) for t in rows)
    assert abs(found.taken.sum() - 1.5 * size) <= 4
