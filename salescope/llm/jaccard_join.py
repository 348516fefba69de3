"""Operator 5: n-gram Jaccard join with parity sketches, and the components of its links.

1. A text becomes the set of its word shingles, as 64-bit hashes. Equal sets form one node.
2. Sizes lie in bands; with sizes a <= b and similarity of at least ``percent`` the two sets lie in
   one band or in neighbouring ones, and differ in at most d = (100 - percent)(a + b) / (100 + percent) shingles. In the scheme of
   a band (its sets and the next band's) the hash space is cut into d + 1 parts; a part's
   key is the XOR of the set's hashes in it. At most d parts can differ, so at least one key is
   equal (pigeonhole). Keys of empty parts would say little: there are some more parts, so that
   the equal ones outnumber the empty ones; a set with more empty parts than that is cut anew by
   another hash (its partner finds it by a filled part, or is cut anew as well).
3. Candidates are filtered by 512-bit parity sketches: a bit is the parity of the shingles
   that fall on it, so the Hamming distance never exceeds the symmetric difference. Those of large sets are full, so
   the distinct pairs that are left are filtered by sketches with as many bits as a set has shingles.
4. The rest is verified on the whole sets.

Keys are stored in SLICES by their leading bits and shuffled KEYS_AT_ONCE at a time or an eighth of them, and the whole sets travel to
the pairs VERIFY_BYTES at a time, so that disk holds a part of either at once.

A group of K near copies must not give K * K pairs. So links are first sought between each member of
a key and that key's centre (the member with the most shared keys), and merged to components.
This is repeated while it links anything. Then every pair of members of one key that is
still in two components, and passes the sketch filter, is verified: no link is lost.

Defined cases: a null text is empty; texts without words have an empty set, link with
nothing and are their own component; texts with fewer words than a shingle have one shingle, the whole sequence;
repeated rows, also of one doc_id, are each a row of the result; a null doc_id is never the smallest
unless all are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.llm.common import attach, broadcast_if_small, discard, ship, stored, table, text_of

ship(__name__)

LEVELS = 4
#: Share of sets that may have more empty parts than their scheme allows for.
RARE = 1e-5
SKETCH_LONGS = 8
#: Nodes that a task remembers so as not to write their keys again; a key written twice changes nothing.
SEEN = 500_000
#: Rows of one Arrow batch that leave a Python task.
OUT_ROWS = 256
#: Ranges of the keys, each in a column of its own.
SLICE_BITS = 3
SLICES = 1 << SLICE_BITS
#: Keys that are shuffled together, as far as SLICES allows.
KEYS_AT_ONCE = 16_000_000
#: Bytes of whole sets that travel to their pairs together.
VERIFY_BYTES = 1 << 30


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser with public multipliers."""
    x = x ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``width`` words."""
    found = text.encode().lower().split()  # of bytes: A-Z alone, and the six ASCII blanks
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = max(1, len(h) - width + 1)
    out = np.full(n, len(h) if len(h) < width else width, np.uint64)
    for k in range(min(width, len(h))):
        out = mixed(out * np.uint64(31) + h[k : k + n], k + 1)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def node_of(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "big", signed=True)


def band_ends(percent: int, size: int) -> list[int]:
    """Largest size of each band, up to the band that holds ``size``."""
    ends, low = [], 1
    while not ends or ends[-1] < size:
        ends.append(low * 100 // percent)
        low = ends[-1] + 1
    return ends


def most_apart(percent: int, end: int) -> int:
    """Largest symmetric difference of a link whose smaller set has ``end`` elements at most."""
    return (100 - percent) * (end + end * 100 // percent) // (100 + percent)


#: Schemes computed so far. A dictionary travels to executors by value; a function wrapped by a cache would not.
_SCHEMES: dict[tuple[int, int, int], tuple[int, int]] = {}


def parts_of(percent: int, low: int, end: int) -> tuple[int, int]:
    """Number of parts, and of them the empty ones that a set with ``low`` elements may have.

    With apart + 1 + spare parts at least spare + 1 are equal in a link, so with ``spare`` empty
    parts at most one filled part is equal.
    """
    if (percent, low, end) in _SCHEMES:
        return _SCHEMES[percent, low, end]
    apart = most_apart(percent, end)
    best = (2.0, 0)
    for spare in range(apart + 4):
        m = apart + 1 + spare
        mean = m * math.exp(-low / m)
        # Poisson tail: more than ``spare`` empty parts
        term = total = math.exp(-mean)
        for k in range(1, spare + 1):
            term *= mean / k
            total += term
        best = min(best, (1 - total, spare))
        if 1 - total < RARE:
            break
    _SCHEMES[percent, low, end] = apart + 1 + best[1], best[1]
    return _SCHEMES[percent, low, end]


def part_keys(hashes: np.ndarray, scheme: int, parts: int, spare: int, level: int = 0) -> list[np.ndarray]:
    """XOR key of each filled part; a set with too many empty parts is cut anew, and after LEVELS cuts has one key with its like."""
    at = ((mixed(hashes, 101 + level) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    xor = np.bitwise_xor.reduceat(hashes[order], first)
    place = mixed(at[first].astype(np.uint64) + np.uint64(scheme << 32), 7 + level)
    keys = [mixed(xor + place, 3)]
    if parts - len(first) > spare:
        last = level + 1 == LEVELS
        keys += [mixed(np.array([scheme], np.uint64), 50)] if last else part_keys(hashes, scheme, parts, spare, level + 1)
    return keys


def all_keys(hashes: np.ndarray, percent: int) -> np.ndarray:
    ends = band_ends(percent, len(hashes))
    band = len(ends) - 1
    keys = []
    for scheme in {band, max(0, band - 1)}:
        if most_apart(percent, ends[scheme]):
            low = ends[scheme - 1] + 1 if scheme else 1
            keys += part_keys(hashes, scheme, *parts_of(percent, low, ends[scheme]))
    return np.unique(np.concatenate(keys)) if keys else np.empty(0, np.uint64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    bits = np.bincount((hashes >> np.uint64(55)).astype(np.int64), minlength=64 * SKETCH_LONGS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def wide_sketch(hashes: np.ndarray) -> bytes:
    """Parity sketch with a bit or two for each shingle."""
    bits = max(64 * SKETCH_LONGS, 1 << max(0, len(hashes) - 1).bit_length())
    return np.packbits((np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def apart_at_least(x: bytes, y: bytes) -> int:
    """Lower bound of the symmetric difference from two wide sketches; the longer one is folded."""
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(np.frombuffer(s, np.uint8).reshape(-1, n)) for s in (x, y))
    return int.from_bytes((x ^ y).tobytes(), "big").bit_count()


def _sliced(keys: list[np.ndarray]) -> list[pa.ListArray]:
    """The keys of some rows as one array of lists for each slice."""
    flat = np.concatenate(keys)
    slices = (flat >> np.uint64(64 - SLICE_BITS)).astype(np.int64)
    n = np.bincount(slices * len(keys) + np.repeat(np.arange(len(keys)), [len(k) for k in keys]), minlength=SLICES * len(keys)).reshape(SLICES, -1)
    parts = np.split(flat[np.argsort(slices, kind="stable")].view(np.int64), np.cumsum(n.sum(axis=1))[:-1])
    return [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(m)]).astype(np.int32), part) for m, part in zip(n, parts)]


def _described(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row: doc_id, n_shingles, node, sketch, wide, keys0, keys1, ...; equal sets of one task have their keys once, mostly."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = [f"keys{k}" for k in range(SLICES)]

    def describe(batches):
        seen: set[int] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(lo, OUT_ROWS)
                sets = [shingles(t, width) for t in part.column(1).to_pylist()]
                nodes = [node_of(s) for s in sets]
                keys = []
                for s, node in zip(sets, nodes):
                    keys.append(all_keys(s, percent) if len(s) and node not in seen else np.empty(0, np.uint64))
                    seen.add(node)
                if len(seen) > SEEN:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.array([sketch(s) for s in sets], pa.list_(pa.int64())),
                    pa.array([wide_sketch(s) for s in sets], pa.binary()),
                    *_sliced(keys),
                ], ["doc_id", "n_shingles", "node", "sketch", "wide", *columns])

    rows = docs.select("doc_id", text_of(docs).alias("text"))
    lists = ", ".join(f"{c} array<long>" for c in columns)
    return rows.mapInArrow(describe, f"doc_id {kind}, n_shingles long, node long, sketch array<long>, wide binary, {lists}")


def _nodes_of_keys(rows: DataFrame) -> DataFrame:
    """(key, node) of the keys that more than one row has; stored, some slices at a time."""
    columns = [c for c in rows.columns if c.startswith("keys")]
    n = rows.agg(F.sum(reduce(lambda a, b: a + b, [F.size(c) for c in columns]).cast("long"))).first()[0] or 0
    step = max(1, SLICES // max(1, -(-n // KEYS_AT_ONCE)))
    found = []
    for lo in range(0, SLICES, step):
        # only keys that occur twice are shuffled with their nodes; equal sets then count once
        keys = rows.select(F.explode(F.concat(*columns[lo : lo + step])).alias("key"), "node")
        shared = stored(keys.groupBy("key").count().filter("count > 1").select("key"), "jaccard-shared")
        found.append(stored(keys.join(shared.hint("merge"), "key", "left_semi").distinct(), "jaccard-nodes-of-keys"))
        discard(shared)
    if len(found) == 1:
        return found[0]
    out = stored(reduce(DataFrame.unionByName, found), "jaccard-nodes-of-keys")
    discard(*found)
    return out


def _sets(docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """One row per node of ``reps`` (node, rep): node, set; stored."""

    def build(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, OUT_ROWS):
                sets = [shingles(t, width) for t in batch.column(0).slice(lo, OUT_ROWS).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "set"]
                )

    named = stored(reps.select("rep").distinct(), "jaccard-reps")
    ids = broadcast_if_small(named)
    texts = docs.select("doc_id", text_of(docs).alias("text")).join(ids, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    sets = texts.select("text").mapInArrow(build, "node long, set binary").join(reps.select("node"), "node", "left_semi")
    sets = stored(sets.dropDuplicates(["node"]), "jaccard-sets")
    discard(named)
    return sets


def _close(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b, bytes of their sets) of the pairs whose wide sketches allow a link."""

    def close(batches):
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            apart = [apart_at_least(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            near = np.array(apart, np.int64) * (100 + percent) <= n * (100 - percent)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(8 * n)], ["a", "b", "bytes"])
            yield out.filter(pa.array(near, pa.bool_()))

    facts = nodes.select("node", "n", "wide")
    pairs = pairs.join(facts.toDF("a", "n_a", "x"), "a").join(facts.toDF("b", "n_b", "y"), "b")
    return pairs.select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(close, "a long, b long, bytes long")


def _links(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int, exact_sketch: bool) -> DataFrame:
    """The pairs (a, b) of different nodes that link."""
    if not exact_sketch:
        pairs = _beside(pairs, nodes)
        pairs = pairs.filter(_near(percent))
    pairs = stored(_close(pairs.select("a", "b").distinct(), nodes, percent), "jaccard-pairs")
    used = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    reps = nodes.join(used, "node", "left_semi").select("node", "rep")
    sets = _sets(docs, reps, width)

    def verify(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    parts = max(1, -(-(pairs.agg(F.sum("bytes")).first()[0] or 0) // VERIFY_BYTES))
    links = []
    for part in range(parts):
        # a centre, which many pairs share, is b: its set is in one part only
        of_part = lambda node: F.pmod(F.xxhash64(node), F.lit(parts)) == part  # noqa: E731, B023
        some, one, two = pairs.select("a", "b"), sets, sets
        if parts > 1:
            some, two = some.filter(of_part("b")), sets.filter(of_part("node"))
            one = sets.join(broadcast_if_small(some.select(F.col("a").alias("node")).distinct()), "node", "left_semi")
        full = some.join(one.withColumnsRenamed({"node": "a", "set": "x"}), "a")
        full = full.join(two.withColumnsRenamed({"node": "b", "set": "y"}), "b").select("a", "b", "x", "y")
        links.append(stored(full.mapInArrow(verify, "a long, b long"), "jaccard-links"))
    discard(pairs, sets)
    return reduce(DataFrame.unionByName, links)


def _beside(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    facts = nodes.select("node", "n", "sketch")
    pairs = pairs.join(facts.toDF("a", "n_a", "sketch_a"), "a")
    return pairs.join(facts.toDF("b", "n_b", "sketch_b"), "b")


def _near(percent: int) -> Column:
    """Sizes and sketches of a and b allow a link."""
    bits = [F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(SKETCH_LONGS)]
    apart = reduce(lambda x, y: x + y, bits)
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return (small * 100 >= large * percent) & (apart * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))


def component_roots(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each linked node's component, by alternating stars."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter("u <> v").distinct(), "stars")
        discard(edges)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = stored(small, "stars")
        discard(large)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def similar_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    rows = stored(_described(docs, width, percent), "jaccard-rows")
    facts = rows.groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"), F.first("n_shingles").alias("n"),
        F.first("sketch").alias("sketch"), F.first("wide").alias("wide"))
    nodes = stored(facts, "jaccard-nodes")
    of_keys = _nodes_of_keys(rows)
    plain = stored(rows.select("doc_id", "n_shingles", "node"), "jaccard-described")  # the keys are not read again
    discard(rows)
    rows = plain
    sizes = of_keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    sized = stored(of_keys.join(sizes, "key"), "jaccard-members")
    discard(of_keys)
    popular = sized.groupBy("node").agg(F.sum("members").alias("popular"))
    members = stored(sized.join(popular, "node").select("key", "node", "popular"), "jaccard-popular")
    discard(sized)

    links = None
    roots = None
    labelled = None
    while True:
        if labelled is not None:
            discard(labelled)
        labelled = members if roots is None else members.join(roots, "node", "left")
        root = F.col("node") if roots is None else F.coalesce("root", "node")
        labelled = labelled.select("key", "node", "popular", root.alias("root"))
        centre = F.max(F.struct("popular", "node", "root")).alias("c")
        per_key = labelled.groupBy("key").agg(centre, F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
        labelled = stored(labelled.join(per_key.select("key", "c"), "key"), "jaccard-open")
        pairs = labelled.filter("root <> c.root").select(F.col("node").alias("a"), F.col("c.node").alias("b"))
        new = _links(pairs, docs, nodes, width, percent, False)
        if new.isEmpty():
            break
        links = new if links is None else links.unionByName(new)
        roots = component_roots(links)
    # what is still apart: every pair of a key across components
    beside = labelled.join(nodes.select("node", "n", "sketch"), "node").select("key", "node", "root", "n", "sketch")
    one = beside.toDF("key", "a", "root_a", "n_a", "sketch_a")
    two = beside.toDF("key", "b", "root_b", "n_b", "sketch_b")
    apart = (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b"))
    left = one.join(two, (one["key"] == two["key"]) & apart & _near(percent)).select("a", "b")
    new = _links(left, docs, nodes, width, percent, True)
    if not new.isEmpty():
        links = new if links is None else links.unionByName(new)
        roots = component_roots(links)
    discard(members, labelled)
    if roots is None:
        roots = nodes.select("node", F.col("node").alias("root")).limit(0)
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    named = stored(named.join(least, "root").select("node", "rows", "component"), "jaccard-components")
    out = attach(rows.select("doc_id", "n_shingles", "node"), named, "node", "rows", F.lit(rows.count()))
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def keep_one_similar(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` that stay: of each component those with the smallest doc_id; empty sets stay."""
    found = similar_components(docs, width, percent)
    stays = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = found.groupBy("doc_id").agg(stays.alias("stays")).filter("not stays").select(F.col("doc_id").alias("_gone"))
    gone = broadcast_if_small(stored(gone, "jaccard-gone"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_gone")), "left_anti")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"), width=3, percent=90)
