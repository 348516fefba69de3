"""Rows that break a declared width or range are set apart at load, with the reasons.

The relational store refuses a whole file for one such value. Here the clean rows get the list of the rules they break
in one pass without a shuffle; rows with an empty list are loaded, the others go to a reject table. Both are written by
one job (partitioned by the verdict), so the rows are computed once and either part is read without the other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.functions.names import normalise_product_name
from salescope.operators.star import whole_invoice_no
from salescope.star_schema import (
    INVOICE_NO_MAX,
    INVOICE_NO_MIN,
    MAX_LEN_COUNTRY,
    MAX_LEN_PRODUCT_CODE,
    MAX_LEN_PRODUCT_NAME,
)


@dataclass(frozen=True)
class Limits:
    """Declared widths in characters, and the range of invoice numbers."""

    country: int = MAX_LEN_COUNTRY
    product_code: int = MAX_LEN_PRODUCT_CODE
    product_name: int = MAX_LEN_PRODUCT_NAME
    invoice_no: tuple[int, int] = (INVOICE_NO_MIN, INVOICE_NO_MAX)


def broken_rules(limits: Limits = Limits()) -> Column:
    """Names of the rules that a clean row breaks, in a fixed order. The name's width is that of the stored, normalised name."""
    number = whole_invoice_no(F.col("invoice_no"))
    rules = {
        "country_too_long": F.length("country") > limits.country,
        "invoice_no_fractional": number.isNull(),
        "invoice_no_out_of_range": ~number.between(*limits.invoice_no),
        "product_code_too_long": F.length("product_code") > limits.product_code,
        "product_name_too_long": F.length(normalise_product_name(F.col("product_name"))) > limits.product_name,
    }
    return F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]), lambda x: x.isNotNull())


def flagged(clean_rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``clean_rows`` with ``reasons``; a row to load has none."""
    return clean_rows.withColumn("reasons", broken_rules(limits))


def quarantine(clean_rows: DataFrame, path: str, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(rows to load, reject table with ``reasons``), both from one write below ``path``."""
    rows = flagged(clean_rows, limits).withColumn("rejected", F.size("reasons") > 0)
    rows.write.partitionBy("rejected").parquet(path)
    # the schema is stated: a part may be empty, and a partition value is not guessed
    both = clean_rows.sparkSession.read.schema(rows.schema).parquet(path)
    kept = both.filter(~F.col("rejected")).drop("rejected", "reasons")
    return kept, both.filter("rejected").drop("rejected")


def reject_report(clean_rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Rows by file and reason, ``none`` for those to load; a row that breaks two rules counts under both."""
    reasons = F.explode(F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("none"))))
    rows = flagged(clean_rows, limits).select("file_name", reasons.alias("reason"))
    return rows.groupBy("file_name", "reason").agg(F.count(F.lit(1)).alias("n_rows"))
