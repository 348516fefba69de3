"""Q1-Q5: the integrity rules a relational store would enforce, as reports.

Each check is one or a few aggregations / anti-joins and returns a small
report DataFrame (one row per table/column/relation), never the offending
rows themselves, so the result size is independent of the data size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.star_schema import (
    INVOICE_NO_MAX,
    INVOICE_NO_MIN,
    MAX_LEN_COUNTRY,
    MAX_LEN_PRODUCT_CODE,
    MAX_LEN_PRODUCT_NAME,
    Star,
)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _key_report(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_rows"),
        F.coalesce(F.sum(F.when(any_null, F.col("n"))), F.lit(0)).cast("bigint").alias("n_null_keys"),
        F.count_if(~any_null & (F.col("n") > 1)).alias("n_duplicate_keys"),
    ).select(F.lit(table).alias("table_name"), F.lit(",".join(keys)).alias("key_columns"),
             "n_rows", "n_null_keys", "n_duplicate_keys")


def check_primary_keys(star: Star) -> DataFrame:
    """Q1: primary keys unique and not null."""
    return _union([
        _key_report(star.countries, "countries", ["country"]),
        _key_report(star.products, "products", ["product_code"]),
        _key_report(star.invoices, "invoices", ["invoice_no"]),
    ])


def check_unique_lines(star: Star) -> DataFrame:
    """Q2: UNIQUE(invoice_no, product_code) on the lines."""
    return _key_report(star.lines, "invoice_lines", ["invoice_no", "product_code"])


def check_foreign_keys(star: Star) -> DataFrame:
    """Q3: orphans per foreign key (left anti-joins, then a count)."""
    def orphans(child, parent, key, name):
        # Child rows are counted per key first (map-side partial aggregation), so
        # the anti-join sees one row per key even when one key is very frequent.
        per_key = child.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        return (per_key.join(parent.select(key).distinct(), key, "left_anti")
                .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_orphans"))
                .select(F.lit(name).alias("relation"), "n_orphans"))
    return _union([
        orphans(star.invoices, star.countries, "country", "invoices.country -> countries"),
        orphans(star.lines, star.invoices, "invoice_no", "invoice_lines.invoice_no -> invoices"),
        orphans(star.lines, star.products, "product_code", "invoice_lines.product_code -> products"),
    ])


def _null_counts(df: DataFrame, table: str, cols: list[str]) -> DataFrame:
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return agg.selectExpr(f"'{table}' AS table_name", f"stack({len(cols)}, {stack}) AS (column_name, n_nulls)")


def check_not_null(star: Star) -> DataFrame:
    """Q4: NOT NULL columns."""
    return _union([
        _null_counts(star.countries, "countries", ["country"]),
        _null_counts(star.products, "products", ["product_code", "product_name"]),
        _null_counts(star.invoices, "invoices", ["invoice_no", "invoice_date", "country"]),
        _null_counts(star.lines, "invoice_lines", ["invoice_no", "product_code"]),
    ])


def check_lengths(star: Star) -> DataFrame:
    """Q5: declared text widths and the 32-bit invoice number range."""
    def too_long(df, table, col, width):
        return df.agg(F.count_if(F.length(col) > width).alias("n_violations")).select(
            F.lit(table).alias("table_name"), F.lit(col).alias("column_name"),
            F.lit(width).cast("bigint").alias("max_allowed"), "n_violations")
    out_of_range = star.invoices.agg(
        F.count_if(~F.col("invoice_no").between(INVOICE_NO_MIN, INVOICE_NO_MAX)).alias("n_violations")).select(
        F.lit("invoices").alias("table_name"), F.lit("invoice_no").alias("column_name"),
        F.lit(INVOICE_NO_MAX).cast("bigint").alias("max_allowed"), "n_violations")
    return _union([
        too_long(star.countries, "countries", "country", MAX_LEN_COUNTRY),
        too_long(star.products, "products", "product_code", MAX_LEN_PRODUCT_CODE),
        too_long(star.products, "products", "product_name", MAX_LEN_PRODUCT_NAME),
        too_long(star.invoices, "invoices", "country", MAX_LEN_COUNTRY),
        out_of_range,
    ])
