"""Operator 2: mixing sources to target weights on a low-discrepancy schedule.

1. Each source's documents are shuffled by a hash of doc_id and laid end to end; the stream
   is cut into blocks of ``block_words`` words.
2. A source's target is ``min(2 * size, level * weight)``, with one level at which all targets together
   are ``share`` of all words: what a capped source leaves goes to the others by weight.
3. Points j / 2^m of the van der Corput sequence (j is slot i with its bits reversed) are mapped through the
   cumulative block needs of the sources. Each point gives its slot to a source. The
   slots of a source are ranked; rank r takes block r mod (blocks of the source), the last
   one only as far as the target goes, ranks beyond the need are left out. An interval of
   the 2^m points holds at least as many points as its source needs blocks, so each source
   takes its target's whole words exactly.
4. The slots are joined with the blocks on (source, block).

Ranks and stream positions are prefix sums in two levels (range of the order, then
ranges), so a source with a third of all rows is spread over RANGES groups. Only tables
with one row per (source, range) are ordered per source, and the one with a row per source as a whole.

Defined cases: null texts and texts without words have size 0 and are taken 0 times; a
null source is a source, ordered last; repeated rows are documents of their own; without
any word all targets are 0; an empty table gives an empty result; other columns of the
input do not matter. Reruns agree because order and ties depend on contents only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salescope.llm.common import stored, table, text_of, word_count

RANGES = 4096
BLOCK_WORDS = 256
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: source, source_no, source_size, weight, target.

    ``sizes`` has source and size. Sources are ordered by code point, null last; the weights repeat in that order.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("source_no", F.row_number().over(every).cast("long"))
    cycle = F.array(*map(F.lit, WEIGHTS))
    per = per.withColumn("weight", F.get(cycle, F.pmod(F.col("source_no") - 1, F.lit(len(WEIGHTS))).cast("int")))
    per = per.withColumn("most", F.col("source_size") * F.lit(most))
    before = Window.orderBy(F.col("most") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / open_weight)
    # the level of the first source that is not capped
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    per = per.withColumn("level", F.min_by(fits, F.when(fits.isNotNull(), F.struct(F.col("most") / F.col("weight"), F.col("source_no")))).over(whole))
    target = F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return per.select("source", "source_no", "source_size", "weight", F.greatest(target, F.lit(0.0)).alias("target"))


def _schedule(sources: DataFrame, block_words: int) -> DataFrame:
    """Slots that are used: source_no, slot, rank, block, upto (words taken from the block's start)."""
    size, goal = F.col("source_size"), F.col("goal")
    s = sources.filter("source_size > 0 AND target >= 1").withColumn("goal", F.floor("target").cast("long"))
    s = s.withColumns({
        "blocks": F.ceil(size / block_words).cast("long"),
        "rest": goal % size,
    })
    s = s.withColumn("need", F.expr("goal div source_size") * F.col("blocks") + F.ceil(F.col("rest") / block_words).cast("long"))
    cumulative = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumns({"upper": F.sum("need").over(cumulative), "all": F.sum("need").over(Window.partitionBy())})
    s = s.withColumn("m", F.ceil(F.log2(F.col("all") * 2)).cast("int"))
    s = s.withColumn("wide", F.expr("shiftleft(1L, m) div all"))  # points for each block needed
    low = (F.col("upper") - F.col("need")) * F.col("wide")
    chunk = 1 << 16
    s = s.withColumns({"low": low, "high": F.col("upper") * F.col("wide")})
    s = s.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("high") - F.col("low") - 1) / chunk))))
    # a number of its own: a few rows would be folded into one task, which then wrote all slots
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = s.repartition(tasks, "source_no", "c")
    first = F.col("low") + F.col("c") * chunk
    s = s.withColumn("j", F.explode(F.sequence(first, F.least(first + chunk, F.col("high")) - 1)))
    s = s.withColumn("slot", F.conv(F.reverse(F.lpad(F.bin("j"), F.col("m"), F.lit("0"))), 2, 10).cast("long"))
    s = s.withColumn("range", F.expr("shiftright(slot, greatest(m - 12, 0))"))
    # rank of a slot among its source's: within its range of slots, then over the ranges
    inner = Window.partitionBy("source_no", "range").orderBy("slot")
    ranges = s.groupBy("source_no", "range").agg(F.count(F.lit(1)).alias("n"))
    outer = Window.partitionBy("source_no").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("source_no", "range", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("before"))
    s = s.withColumn("own", F.row_number().over(inner) - 1).join(ranges, ["source_no", "range"])
    s = s.withColumn("rank", F.col("before") + F.col("own")).filter("rank < need")
    s = s.withColumn("block", F.col("rank") % F.col("blocks"))
    length = F.least(F.lit(block_words).cast("long"), size - F.col("block") * block_words)
    partial = (F.col("rank") == F.col("need") - 1) & (F.col("rest") > 0)
    upto = F.when(partial, F.col("rest") - F.col("block") * block_words).otherwise(length)
    return s.select("source_no", "slot", "rank", "block", upto.alias("upto"))


def _streams(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their place in their source's shuffled stream; the sources."""
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["source"].cast("string").alias("source"), word_count(text_of(docs)).alias("size"))
    rows = stored(rows, "mix-sizes")
    rows = rows.withColumn("order", F.xxhash64("doc_id", F.lit(seed)))
    rows = rows.withColumn("range", F.pmod("order", F.lit(RANGES)))
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), "source"))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("size"))
    sources = stored(source_targets(ranges), "mix-sources")
    before = Window.partitionBy("source_no").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    keyed = sources.withColumn("key", key).drop("source")
    ranges = ranges.withColumn("key", key).drop("source").join(keyed, "key")
    ranges = ranges.select("key", "range", "source_no", "source_size", "target", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    inner = Window.partitionBy("key", "range").orderBy("order", "doc_id", "size")
    rows = rows.withColumn("key", key).withColumns({
        "no": F.row_number().over(inner),
        "end": F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)),
    })
    rows = rows.join(ranges, ["key", "range"])
    begin = F.col("before") + F.col("end") - F.col("size")
    return rows.select("doc_id", "size", "source_no", "source_size", "target", "range", "no", begin.alias("begin")), sources


def mix_slots(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 17) -> DataFrame:
    """The mix in pieces: which words of which document each slot takes.

    Returns every document at least once: doc_id, size, source_no, source_size, target, range and
    no (they name the document's row), slot, first_word, n_words (null for what no slot takes).
    """
    rows, sources = _streams(docs, seed)
    blocks = F.sequence(F.expr(f"begin div {block_words}"), F.expr(f"(begin + size - 1) div {block_words}"))
    pieces = rows.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, blocks)))
    base = F.col("block") * block_words
    pieces = pieces.withColumns({
        "lo": F.greatest(F.col("begin") - base, F.lit(0)),
        "hi": F.least(F.col("begin") + F.col("size") - base, F.lit(block_words)),
    })
    found = pieces.join(_schedule(sources, block_words).hint("merge"), ["source_no", "block"], "left")
    taken = F.when(F.col("slot").isNotNull(), F.greatest(F.least("hi", "upto") - F.col("lo"), F.lit(0)))
    return found.select(
        "doc_id", "size", "source_no", "source_size", "target", "range", "no", "slot",
        (base + F.col("lo") - F.col("begin")).alias("first_word"), taken.alias("n_words"),
    )


def mix_counts(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    slots = mix_slots(docs, block_words, seed)
    per = slots.groupBy("source_no", "range", "no", "doc_id", "size", "source_size", "target")
    per = per.agg(F.coalesce(F.sum("n_words"), F.lit(0)).cast("long").alias("taken"))
    return per.select("doc_id", "size", "source_size", "target", "taken")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents"))
