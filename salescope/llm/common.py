"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import uuid
import weakref

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.session import scratch_path

#: The separators of the word pattern ``[^\x20\x09-\x0D]+``.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A key that holds more than this share of all rows is "hot". By counting,
#: there are at most HOT_SHARE of them, so a table of hot keys is bounded.
HOT_SHARE = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Drops a query's shuffle files when it ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back (cuts the lineage).

    The shuffle files of the write go with its end: what comes later reads the table.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "llm", f"{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` returned and that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(df))
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` narrow rows; a larger one is shuffled."""
    return F.broadcast(df) if df.count() <= rows else df.hint("merge")


def ship(module: str) -> None:
    """Send the Python functions of ``module`` to executors by value, which may not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def text_of(docs: DataFrame, column: str = "text") -> Column:
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a non-null text, as an array."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def word_count(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "[\\x20\\x09-\\x0D]+"))).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def attach(rows: DataFrame, facts: DataFrame, key: str, n: str, total: Column) -> DataFrame:
    """Left join of ``rows`` with one row per key of ``facts``, safe for hot keys.

    ``facts`` has ``key``, its row count ``n`` and other columns; ``total`` is an expression of it
    that holds the number of all rows. Keys with more than 1/HOT_SHARE of the
    rows (HOT_SHARE at most) are broadcast; the others are shuffled, and rows of hot keys
    take part in that shuffle under a scattered key that matches nothing.
    """
    facts = facts.withColumn("_hot", F.col(n) * HOT_SHARE > total)
    others = [c for c in facts.columns if c not in (key, "_hot")]
    hot = facts.filter("_hot").select(F.col(key), F.struct(*others).alias("_a"))
    rest = facts.filter(~F.col("_hot")).select(F.col(key).alias("_key"), F.struct(*others).alias("_b"))
    spread = F.when(F.col("_a").isNull(), F.col(key))
    scatter = F.when(F.col("_a").isNotNull(), F.monotonically_increasing_id())
    found = rows.join(F.broadcast(hot), key, "left").withColumns({"_k": spread, "_s": F.coalesce(scatter, F.lit(-1))})
    rest = rest.withColumn("_t", F.lit(-1).cast("long"))
    found = found.join(rest.hint("merge"), (F.col("_k") == F.col("_key")) & (F.col("_s") == F.col("_t")), "left")
    out = found.withColumn("_f", F.coalesce("_a", "_b"))
    return out.select(*rows.columns, *[F.col("_f")[c].alias(c) for c in others])
