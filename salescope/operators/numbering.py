"""Gap-free numbers for the rows of a DataFrame, without a window over all rows.

Rows are range-partitioned and sorted; a row's number is the number of rows in the partitions before its
own, plus its place in its partition. Only one count per partition comes to the driver.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescope.session import ensure_checkpoint_dir, kept

#: ``monotonically_increasing_id`` holds the partition above these bits and the row's place in it below.
_PLACE_BITS = 33


def _before(sizes: DataFrame, start: int) -> Column:
    """First number of each partition, from (part, n)."""
    found = {r["part"]: r["n"] for r in sizes.collect()}
    counts = [found.get(i, 0) for i in range(max(found, default=0) + 1)]
    return F.lit([start, *accumulate(counts, initial=start)][1:-1] or [start]).cast("array<bigint>")


def dense_numbers(df: DataFrame, order: list[str | Column], name: str, start: int = 1) -> DataFrame:
    """``df`` with a BIGINT column ``name``: start, start + 1, ... in the order of ``order``, no number left out.

    Rows equal in ``order`` are numbered in any order. The partitioned rows are checkpointed (shared folder) before
    they are counted: range bounds come from a sample, and another run of the plan might cut elsewhere.
    """
    ensure_checkpoint_dir(df.sparkSession)
    placed = (df.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("_id", F.monotonically_increasing_id()).checkpoint(eager=True))
    part = F.shiftright("_id", _PLACE_BITS).cast("int")
    before = _before(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")), start)
    place = F.col("_id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return placed.withColumn(name, F.get(before, part) + place).drop("_id")


def dense_numbers_by_group(df: DataFrame, group: str, order: list[str | Column], name: str, start: int = 1) -> DataFrame:
    """Numbers as ``dense_numbers`` gives them in the order (``group``, *``order``), for rows that lie together by ``group`` already.

    Only a count per group is range-partitioned; the rows stay where they are. ``group`` is an integer and not null, and
    ``df`` must give the same rows whenever it is computed."""
    placed = kept(df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).repartitionByRange(group).withColumn("_part", F.spark_partition_id()))
    before = _before(placed.groupBy(F.col("_part").alias("part")).agg(F.sum("_n").alias("n")), start)
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy("_part").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = placed.select(group, (F.get(before, F.col("_part")) + earlier).alias("_first"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return df.withColumn("_place", place).join(firsts.hint("merge"), group).withColumn(name, F.col("_first") + F.col("_place")).drop("_first", "_place")
