"""Operator 6: benchmark decontamination by spaced seeds, in DataFrame functions only.

Texts are lower-cased word sequences. A window is SPAN words of a benchmark item, in four groups of
three words; each of six fixed masks selects two groups and ignores the others. Two
substituted words lie in at most two groups, so the mask of the other two is untouched: every window
with EQUAL or more equal words is found by a mask. A smaller ``equal`` is refused.

1. A group is itself a spaced seed (three words, four apart). Each position of a document gives one hash, which is
   semi-joined with the group hashes of the benchmark. A window that a mask hits has two such groups.
2. Windows with two hit groups are cut out, each mask gives its hash, and these are joined with the masks' hashes of the benchmark.
3. The two windows are compared word by word; at least ``equal`` of the SPAN words must be the same.

The benchmark's hashes and the ids of hit documents are broadcast only if there are at most BROADCAST_ROWS; a larger
table is joined by shuffle.

Defined cases: an item with fewer than SPAN words is one window of its own length, without
tolerance; null and empty texts match nothing; repeated rows count once; a null id is an id of its
own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.llm.common import ascii_lower, broadcast_if_small, stored, table, text_of, words

SPAN, EQUAL = 12, 10
#: Every fourth word is a group; each mask selects two of the four.
GROUPS = 4
MASKS = tuple(combinations(range(GROUPS), 2))
BROADCAST_ROWS = 1_000_000


def _group(words: Column, at: Column) -> Column:
    """Hash of the group of words that starts at position ``at``."""
    return F.xxhash64(*[F.get(words, at + k) for k in range(0, SPAN, GROUPS)])


def _whole(words: Column, at: Column, length: int) -> Column:
    """Hash of ``length`` consecutive words, for items that have no more."""
    return F.xxhash64(F.lit(length), *[F.get(words, at + k) for k in range(length)])


def _masked(window: Column, length: Column) -> Column:
    """Hashes of a window's words: one by each mask, or one of all words if it is shorter than SPAN."""
    one = lambda k, mask: F.xxhash64(F.lit(k), *[F.get(window, F.lit(g + i)) for g in mask for i in range(0, SPAN, GROUPS)])
    masks = F.array(*[one(k, mask) for k, mask in enumerate(MASKS)])
    return F.when(length == SPAN, masks).otherwise(F.array(F.xxhash64(F.lit(len(MASKS)), length, F.array_join(window, " "))))


def _candidates(texts: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """Windows of the documents that may hit one of the benchmark: _doc, pos, length.

    ``texts`` has doc_id and words. Positions are exploded beside their words, so hashing runs in compiled code."""
    placed = texts.select("doc_id", "words", F.posexplode("words").alias("pos", "word"))
    parts = []
    for n in lengths:
        own = windows.filter(F.col("length") == n)
        if n == SPAN:
            wanted = own.select(F.explode(F.array(*[_group(F.col("theirs"), F.lit(g)) for g in range(GROUPS)])).alias("h"))
            reach, h = SPAN - GROUPS + 1, _group(F.col("words"), F.col("pos"))
        else:
            wanted = own.select(_whole(F.col("theirs"), F.lit(0), n).alias("h"))
            reach, h = n, _whole(F.col("words"), F.col("pos"), n)
        wanted = broadcast_if_small(stored(wanted.distinct(), "leak-hashes"), BROADCAST_ROWS)
        inside = placed.filter(F.col("pos") + reach <= F.size("words")).select("doc_id", "pos", h.alias("h"))
        hits = inside.join(wanted, "h", "left_semi")
        if n == SPAN:
            # a group may be any of the four of a window
            hits = hits.select("doc_id", "pos", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))).alias("group"))
            per = hits.groupBy("doc_id", (F.col("pos") - F.col("group")).alias("pos")).agg(F.bit_or(F.expr("shiftleft(1, group)")).alias("groups"))
            hits = per.filter((F.bit_count("groups") >= 2) & (F.col("pos") >= 0))
        parts.append(hits.select(F.col("doc_id").alias("_doc"), "pos", F.lit(n).alias("length")))
    return reduce(DataFrame.unionByName, parts)


def leaks(docs: DataFrame, items: DataFrame, equal: int = EQUAL) -> DataFrame:
    """One row per document and item that overlap: doc_id, item_id, n_windows, most_equal, first_word."""
    if equal < EQUAL:
        raise ValueError(f"the masks find windows with at least {EQUAL} equal words, not {equal}")
    tests = items.select("item_id", words(ascii_lower(text_of(items))).alias("words")).distinct().filter(F.size("words") > 0)
    tests = tests.withColumn("length", F.least(F.size("words"), F.lit(SPAN)))
    starts = F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)).alias("at")
    windows = tests.select("item_id", "length", "words", starts).select("item_id", "length", F.slice("words", F.col("at"), F.col("length")).alias("theirs"))
    windows = stored(windows, "leak-windows")
    # at most SPAN different numbers
    lengths = [r[0] for r in windows.select("length").distinct().collect()] or [SPAN]
    texts = docs.select("doc_id", words(ascii_lower(text_of(docs))).alias("words"))
    # a document's hits are at most its own windows
    hits = _candidates(texts, windows, lengths).groupBy("_doc").agg(F.collect_set(F.struct("pos", "length")).alias("hits"))
    hits = stored(hits, "leak-hits")
    ids = broadcast_if_small(hits.select("_doc"), BROADCAST_ROWS)
    texts = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
    around = texts.join(hits, F.col("doc_id").eqNullSafe(F.col("_doc"))).select("doc_id", "words", F.explode("hits").alias("x"))
    around = around.select("doc_id", F.col("x.pos").alias("pos"), F.col("x.length").alias("length"),
                           F.slice("words", F.col("x.pos") + 1, F.col("x.length")).alias("ours")).filter(F.size("ours") == F.col("length"))
    ours = around.select("*", F.explode(_masked(F.col("ours"), F.col("length"))).alias("h"))
    theirs = windows.select("*", F.explode(_masked(F.col("theirs"), F.col("length"))).alias("h"))
    pairs = ours.join(theirs, ["h", "length"])
    same = F.size(F.filter(F.zip_with("ours", "theirs", lambda a, b: a.eqNullSafe(b)), lambda x: x))
    needed = F.when(F.col("length") == SPAN, F.lit(equal)).otherwise(F.col("length"))
    pairs = pairs.withColumn("same", same).filter(F.col("same") >= needed)
    return pairs.groupBy("doc_id", "item_id").agg(
        F.count_distinct("pos").alias("n_windows"), F.max("same").alias("most_equal"), F.min("pos").alias("first_word")
    )


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` that share no window with an item."""
    found = stored(leaks(docs, items).select(F.col("doc_id").alias("_leak")).distinct(), "leak-ids")
    found = broadcast_if_small(found, BROADCAST_ROWS)
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_leak"]), "left_anti")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
