"""How many rows each cleaning step leaves, per file.

One aggregation over the flagged, de-duplicated rows gives all eight counts
(``n_original`` sums the raw rows each survivor stands for), instead of
counting after every step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.operators.clean import flagged
from salescope.session import ensure_checkpoint_dir

COUNT_COLUMNS = ("n_original", "n_dedupe", "n_credits", "n_dates", "n_codes", "n_quantity",
                 "n_country", "n_total")


def counts_from_flags(flags: DataFrame) -> DataFrame:
    """F1 on an already flagged frame."""
    return flags.groupBy("file_name").agg(
        F.sum("dup_count").cast("bigint").alias("n_original"),
        F.count(F.lit(1)).alias("n_dedupe"),
        F.count_if("k_credits").alias("n_credits"),
        F.count_if("k_dates").alias("n_dates"),
        F.count_if("k_codes").alias("n_codes"),
        F.count_if("k_quantity").alias("n_quantity"),
        F.count_if("k_country").alias("n_country"),
        F.count_if("k_country").alias("n_total"),
    )


def feedback_counts(raw: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """per file, rows left after each step.

    ``files`` (a ``file_name`` column, e.g. from ``sources.csv_files.list_files``)
    makes files without any data row appear too, with zero counts."""
    counts = counts_from_flags(flagged(raw))
    if files is None:
        return counts
    return (files.select("file_name").distinct().join(counts, "file_name", "left")
            .select("file_name", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in COUNT_COLUMNS]))


def with_removed(counts: DataFrame) -> DataFrame:
    """rows removed = original - total."""
    return counts.withColumn("n_removed", F.col("n_original") - F.col("n_total"))


def with_percent(counts: DataFrame) -> DataFrame:
    """percent removed, two digits, half-to-even; NULL for an empty file."""
    c = with_removed(counts)
    pct = F.try_divide(F.col("n_removed").cast("double"), F.col("n_original").cast("double")) * F.lit(100.0)
    return c.withColumn("pct_removed", F.bround(pct, 2))


# Report rows in display order: (row label, column of the per-file frame).
MATRIX_ROWS = (
    ("original", "n_original"),
    ("dedupe", "n_dedupe"),
    ("credits", "n_credits"),
    ("dates", "n_dates"),
    ("codes", "n_codes"),
    ("quantity", "n_quantity"),
    ("country", "n_country"),
    ("total", "n_total"),
    ("removed", "n_removed"),
    ("percent", "pct_removed"),
)


def feedback_long(counts: DataFrame) -> DataFrame:
    """F4 in long form, for any number of files: file_name, step_order, step, value (DOUBLE, as the percent row needs)."""
    stack = ", ".join(f"{i}, '{label}', CAST({col} AS DOUBLE)" for i, (label, col) in enumerate(MATRIX_ROWS, 1))
    return with_percent(counts).selectExpr("file_name", f"stack({len(MATRIX_ROWS)}, {stack}) AS (step_order, step, value)")


def feedback_matrix(counts: DataFrame, file_names: list[str] | None = None) -> DataFrame:
    """steps as rows, files as columns (values as DOUBLE).

    ``file_names`` fixes the pivot columns; without it all distinct file names are taken
    (a small extra job over one row per file; the names come to the driver, as columns must). They are
    given to the pivot, whose own search stops at ``spark.sql.pivotMaxValues`` files.
    """
    if file_names is None:
        # One row per file: checkpointed (shared folder) so that finding the
        # pivot values and the pivot itself do not both recompute the cleaning.
        ensure_checkpoint_dir(counts.sparkSession)
        counts = counts.checkpoint(eager=True)
        file_names = [r["file_name"] for r in counts.select("file_name").distinct().orderBy("file_name").collect()]
    return feedback_long(counts).groupBy("step_order", "step").pivot("file_name", file_names).agg(F.first("value"))
