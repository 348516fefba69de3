"""Operator 3: exact dedup by skew-safe combining, in DataFrame functions only.

1. Rows that share a text are combined inside each task and then under (digest, salt,
   text): a group of copies, however large, is spread over SALTS keys.
2. The salt winners are combined globally under (digest, text).
3. The classes, one row per (digest, salt), carry keep_id and group_size back to the documents. The documents meet them without their texts.

Both combining steps group by the whole text, not just its digest. Step 3 needs it only
where a digest stands for several texts; those digests, if any, are joined by the text as well.

Defined cases: a null text is empty; the empty text is a text like others; a null doc_id
is the smallest; of repeated rows with one doc_id and text exactly one is kept; an empty
table gives an empty result; other columns of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.llm.common import stored, table, text_of

SALTS = 16
#: Repeated identical rows are written out in runs of this many.
RUN = 100_000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _salted(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    text = text_of(docs)
    return docs.select(
        docs["doc_id"].alias("doc_id"), text.alias("text"), digest(text).alias("digest"),
        F.pmod(F.xxhash64(docs["doc_id"]), F.lit(SALTS)).cast("int").alias("salt"),
    )


def _classes(rows: DataFrame) -> DataFrame:
    """One row per (digest, text, salt): keep_id, group_size."""
    local = rows.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
    whole = local.groupBy("digest", "text").agg(
        F.max("top").alias("keep_id"), F.sum("n").alias("group_size"),
        F.bit_or(F.expr("shiftleft(1, salt)")).alias("salts"),
    )
    used = F.expr(f"filter(sequence(0, {SALTS - 1}), s -> shiftright(salts, s) & 1 = 1)")
    return whole.select("digest", "text", "keep_id", "group_size", F.explode(used).alias("salt"))


def copy_classes(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: doc_id, digest, keep_id, group_size, kept."""
    rows = _salted(docs, digest)
    classes = stored(_classes(rows).drop("text"), "copy-classes")
    shared = classes.groupBy("digest", "salt").count().filter("count > 1").select("digest").distinct()
    ids = rows.groupBy("doc_id", "digest", "salt").agg(F.count(F.lit(1)).alias("n"))
    if shared.isEmpty():
        found = ids.join(classes, ["digest", "salt"])
    else:  # a digest of several texts
        shared = stored(shared, "shared-digests")
        clear = ids.join(shared, "digest", "left_anti").join(classes, ["digest", "salt"])
        texts = rows.join(shared, "digest", "left_semi")
        by_text = texts.groupBy("doc_id", "digest", "salt", "text").agg(F.count(F.lit(1)).alias("n"))
        found = clear.unionByName(by_text.join(_classes(texts), ["digest", "salt", "text"]).drop("text"))
    # rows that agree in doc_id and text are one row with their number n so far
    runs = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))
    found = found.withColumn("_run", F.explode(runs))
    found = found.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(RUN).cast("long"), F.col("n") - F.col("_run") * RUN))))
    first = (F.col("_run") == 0) & (F.col("_i") == 1)
    return found.select("doc_id", "digest", "keep_id", "group_size", (first & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"))


def keep_one_copy(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    winners = stored(_classes(_salted(docs, digest)).select("digest", "keep_id").distinct(), "copy-winners")
    columns = docs.columns
    rows = docs.withColumns({"_digest": digest(text_of(docs)), "_text": text_of(docs)})
    kept = rows.join(
        winners.hint("merge"), (rows["_digest"] == winners["digest"]) & rows["doc_id"].eqNullSafe(winners["keep_id"]), "left_semi"
    )
    return kept.dropDuplicates(["_digest", "doc_id", "_text"]).select(*columns)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = copy_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP3_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  coalesce(doc_id = max(doc_id) OVER g, true) AND row_number() OVER (PARTITION BY text, doc_id) = 1 AS kept,
  sha256(text) AS text_sha256
FROM d WINDOW g AS (PARTITION BY text)
"""
