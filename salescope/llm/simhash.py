"""Operator 13: SimHash near-duplicates by a tiled exact comparison of fingerprints.

1. A text's shingles (``width`` words, repeats included) are hashed by XXH64; a bit of the
   fingerprint is 1 if it is set in over half the hashes. Equal fingerprints form one class.
2. The distinct fingerprints, sorted by the population counts of the whole, its halves, quarters
   and eighths, are cut into tiles of TILE. Two fingerprints differ in at least as many
   bits as the counts of disjoint parts differ in sum. So a pair of tiles is skipped if its ranges of
   counts, at any of these levels, are further apart than the radius; inside a pair of
   tiles the same holds for pairs of blocks of BLOCK.
3. The other pairs are compared exactly: exclusive-or and bit counts of numpy, a block against all blocks it may link with.
   A task keeps the links that connect something new in its pair of tiles, a spanning forest, not
   all pairs of a cluster. Components are then merged over all tasks.

Work grows with the square of the distinct fingerprints, less what the ranges skip (the more there
are, the narrower the ranges); a pair of tiles moves 2 * TILE * 8 bytes to its task.

Defined cases: a null text is empty; a text without words has the fingerprint 0 and is linked
like any other; a text with fewer words than a shingle has one shingle, the whole sequence;
repeated rows, also of one doc_id, are each a row of the result; a null doc_id is never the smallest unless all of its component
are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.llm.common import attach, ship, stored, table, text_of
from salescope.llm.jaccard_join import component_roots
from salescope.operators.numbering import dense_numbers

ship(__name__)

SEED = 42
TILE, BLOCK = 32768, 64
#: Shingles whose bits are counted at once.
RUN = 65536
#: Bits of the parts at each level: the whole, halves, quarters, eighths.
LEVELS = (64, 32, 16, 8)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    found = text.lower().split()  # of bytes: A-Z alone, and the six ASCII blanks
    if not found:
        return np.empty(0, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    span = min(width, len(found))
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    bounds = zip(starts[: len(found) - span + 1].tolist(), (ends[span - 1 :] - 1).tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in bounds), np.uint64, len(found) - span + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit value; bit i is 1 if more than half of the hashes have it."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), RUN):
        run = np.ascontiguousarray(hashes[lo : lo + RUN]).astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(run, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (BIGINT with the 64 bits)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def describe(batches):
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), width)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = docs.select("doc_id", text_of(docs).cast("binary").alias("text"))
    return rows.mapInArrow(describe, f"doc_id {kind}, fp long")


def _counts(level: int) -> list:
    """Population counts of the parts of ``level`` bits, as columns of fp."""
    mask = F.lit((1 << level) - 1 if level < 64 else -1).cast("long")
    return [F.bit_count(F.shiftrightunsigned("fp", low).bitwiseAND(mask)) for low in range(0, 64, level)]


def part_counts(fps: np.ndarray) -> np.ndarray:
    """Population counts of all parts of all levels, a row for each fingerprint."""
    columns = []
    for level in LEVELS:
        mask = np.uint64((1 << level) - 1)
        columns += [np.bitwise_count((fps >> np.uint64(low)) & mask) for low in range(0, 64, level)]
    return np.stack(columns, axis=1).astype(np.int16)


def _gaps(lo_a, hi_a, lo_b, hi_b) -> np.ndarray:
    """Fewest bits in which members of ranges a and b can differ (parts in the last axis)."""
    gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    ends = np.cumsum([64 // level for level in LEVELS])
    return np.max([gap[..., end - 64 // level : end].sum(axis=-1) for end, level in zip(ends, LEVELS)], axis=0)


class _Blocks:
    """A tile cut into blocks of fingerprints with like population counts, and their ranges."""

    def __init__(self, fps: np.ndarray):
        counts = part_counts(fps)
        order = np.lexsort(counts.T[::-1])
        self.fps, counts = fps[order], counts[order]
        at = np.arange(0, len(fps), BLOCK)
        self.bounds = [(lo, min(lo + BLOCK, len(fps))) for lo in at.tolist()]
        self.block = np.arange(len(fps)) // BLOCK
        self.lo, self.hi = np.minimum.reduceat(counts, at, axis=0), np.maximum.reduceat(counts, at, axis=0)


def tile_links(one: np.ndarray, two: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links that connect all fingerprints of two tiles (of ``one`` alone if ``two`` is None) that are connected in them."""
    a = _Blocks(one)
    b = a if two is None else _Blocks(two)
    base = 0 if two is None else len(one)
    label = np.arange(len(a.fps) if two is None else len(one) + len(two))
    links = []
    for i, (lo, hi) in enumerate(a.bounds):
        near = _gaps(a.lo[i], a.hi[i], b.lo, b.hi) <= radius
        if two is None:
            near[:i] = False
        others = np.flatnonzero(near[b.block])
        x, y = np.nonzero(np.bitwise_count(a.fps[lo:hi, None] ^ b.fps[others]) <= radius)
        x, y = x + lo, others[y]
        of_x, of_y = label[x], label[y + base]
        apart = of_x != of_y
        if not apart.any():
            continue
        pairs, at = np.unique(np.stack((of_x[apart], of_y[apart])), axis=1, return_index=True)
        root = {int(k): int(k) for k in np.unique(pairs)}

        def find(k):
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        for p, q, k in zip(*pairs.tolist(), np.flatnonzero(apart)[at].tolist()):
            p, q = find(p), find(q)
            if p != q:
                root[max(p, q)] = min(p, q)
                links.append((int(a.fps[x[k]]), int(b.fps[y[k]])))
        new = np.arange(len(label))
        for k in root:
            new[k] = find(k)
        label = new[label]
    return links


def _tiles(classes: DataFrame) -> DataFrame:
    """One row per tile: tile, fps (array), and lo and hi of the population counts of each part."""
    keys = [F.col(f"_k{i}") for i in range(sum(64 // level for level in LEVELS))]
    counts = [c for level in LEVELS for c in _counts(level)]
    marked = classes.select("fp", *[c.alias(f"_k{i}") for i, c in enumerate(counts)])
    placed = dense_numbers(marked, keys, "no", start=0)
    bounds = lambda f: F.array(*[f(k) for k in keys])
    per = placed.groupBy(F.expr(f"no div {TILE}").alias("tile"))
    return per.agg(F.collect_list("fp").alias("fps"), bounds(F.min).alias("lo"), bounds(F.max).alias("hi"))


def _tile_pairs(tiles: DataFrame, radius: int) -> DataFrame:
    """Pairs of tiles (a <= b) whose population counts allow a link: those of neighbouring totals, then all levels."""
    ranges = tiles.select("tile", "lo", "hi")
    one = ranges.select(F.col("tile").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), F.explode(F.sequence(F.col("lo")[0], F.col("hi")[0])).alias("total"))
    two = ranges.select(F.col("tile").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"),
                        F.explode(F.sequence(F.col("lo")[0] - radius, F.col("hi")[0] + radius)).alias("total"))
    pairs = one.join(two, "total").filter("a <= b")
    start = 0
    for level in LEVELS:
        parts = range(start, start + 64 // level)
        start += 64 // level
        gap = sum((F.greatest(F.lit(0), F.col("lo_a")[i] - F.col("hi_b")[i], F.col("lo_b")[i] - F.col("hi_a")[i]) for i in parts), F.lit(0))
        pairs = pairs.filter(gap <= radius)
    return pairs.select("a", "b").distinct()


def fingerprint_links(classes: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` of ``classes`` that connect all that is connected within ``radius`` bits."""
    tiles = stored(_tiles(classes), "simhash-tiles")
    pairs = _tile_pairs(tiles, radius)
    held = tiles.select("tile", "fps").hint("merge")
    held_b = tiles.select(F.col("tile").alias("b"), F.col("fps").alias("fps_b")).hint("merge")
    # a tile meets itself without a second copy of its fingerprints
    full = pairs.join(held.withColumnsRenamed({"tile": "a", "fps": "fps_a"}), "a")
    full = full.join(held_b, (full["b"] == held_b["b"]) & (full["a"] != held_b["b"]), "left").select("fps_a", "fps_b")

    def compare(batches):
        for batch in batches:
            found = []
            for x, y in zip(batch.column(0), batch.column(1)):
                x, y = (None if s.values is None else s.values.to_numpy().view(np.uint64) for s in (x, y))
                found += tile_links(x, y, radius)
            ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    return stored(full.mapInArrow(compare, "a long, b long"), "simhash-links")


def simhash_components(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id."""
    rows = stored(fingerprints(docs, width), "simhash-rows")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")), "simhash-classes")
    roots = component_roots(fingerprint_links(classes, radius))
    named = classes.join(roots, classes["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = stored(named.join(least, "root").select("fp", "rows", "component_id"), "simhash-components")
    return attach(rows, named, "fp", "rows", F.lit(rows.count())).select("doc_id", "fp", "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
