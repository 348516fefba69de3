"""Sales rankings over the star (country and product families, with drill-downs).

The measure is the number of invoice lines (one line = one product on one
invoice). Plans are written aggregate-before-join: lines are counted per
join key first (map-side partial aggregation, then one row per key), so no
join ever sees more than one row per invoice or per product, whatever the
skew of the fact table. The year filter is a half-open date range, which
reaches the Parquet scan as a pushed filter (``year(d) = y`` does not).
Every ordering has the label as a second key, so ties at the limit are
resolved the same way on every run.
"""

from __future__ import annotations

import datetime as _dt
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.star_schema import (
    COUNTRY,
    INVOICE_DATE,
    INVOICE_NO,
    INVOICE_YEAR,
    PRODUCT_CODE,
    PRODUCT_NAME,
    SALES,
    Star,
)

Mode = Literal["top", "all", "flop"]

# List lengths of the rankings and drill-downs.
RANK_LIMIT = 10
DRILL_LIMIT = 5


def year_range(year: int) -> Column:
    """Half-open [Jan 1 of year, Jan 1 of year+1) on invoice_date."""
    lo = F.lit(_dt.date(int(year), 1, 1))
    hi = F.lit(_dt.date(int(year) + 1, 1, 1))
    d = F.col(INVOICE_DATE)
    return (d >= lo) & (d < hi)


def _invoices(star: Star, year: int | None, country: str | None = None) -> DataFrame:
    inv = star.invoices
    if year is not None:
        inv = inv.filter(year_range(year))
        if INVOICE_YEAR in inv.columns:
            # stored invoices partitioned by year: prune to the one partition
            inv = inv.filter(F.col(INVOICE_YEAR) == F.lit(int(year)))
    if country is not None:
        inv = inv.filter(F.col(COUNTRY) == F.lit(country))
    return inv


def _lines(star: Star, year: int | None) -> DataFrame:
    """The lines; those of one year if they are stored with it (the others' files are then not read)."""
    if year is None or INVOICE_YEAR not in star.lines.columns:
        return star.lines
    return star.lines.filter(F.col(INVOICE_YEAR) == F.lit(int(year)))


def _order(df: DataFrame, mode: Mode, label_cols: list[str], limit: int | None) -> DataFrame:
    sales = F.col(SALES).asc() if mode == "flop" else F.col(SALES).desc()
    ordered = df.orderBy(sales, *[F.col(c).asc() for c in label_cols])
    if limit is not None:
        ordered = ordered.limit(limit)
    return ordered


def _limit_for(mode: Mode) -> int | None:
    if mode not in ("top", "all", "flop"):
        raise ValueError(f"unknown rank mode {mode!r}")
    return None if mode == "all" else RANK_LIMIT


def rank_countries(star: Star, mode: Mode = "top", year: int | None = None) -> DataFrame:
    """(country, sales) by number of lines, top 10 / all / flop 10, optionally one year."""
    per_invoice = _lines(star, year).groupBy(INVOICE_NO).agg(F.count(F.lit(1)).alias("n_lines"))
    inv = _invoices(star, year).select(INVOICE_NO, COUNTRY)
    counted = (per_invoice.join(inv, INVOICE_NO)
               .groupBy(COUNTRY).agg(F.sum("n_lines").cast("bigint").alias(SALES)))
    return _order(counted, mode, [COUNTRY], _limit_for(mode))


def country_top_products(star: Star, country: str, year: int | None = None,
                         k: int = DRILL_LIMIT) -> DataFrame:
    """The k product *names* with most lines in one country (codes sharing a name merge)."""
    inv = _invoices(star, year, country).select(INVOICE_NO)
    per_code = (_lines(star, year).join(inv, INVOICE_NO)
                .groupBy(PRODUCT_CODE).agg(F.count(F.lit(1)).alias("n_lines")))
    per_name = (per_code.join(star.products.select(PRODUCT_CODE, PRODUCT_NAME), PRODUCT_CODE)
                .groupBy(PRODUCT_NAME).agg(F.sum("n_lines").cast("bigint").alias(SALES)))
    return _order(per_name, "top", [PRODUCT_NAME], k)


def product_counts(star: Star, year: int | None = None) -> DataFrame:
    """(product_code, product_name, sales) for every product with at least one line."""
    lines = _lines(star, year)
    if year is not None:
        lines = lines.join(_invoices(star, year).select(INVOICE_NO), INVOICE_NO)
    per_code = lines.groupBy(PRODUCT_CODE).agg(F.count(F.lit(1)).alias(SALES))
    return per_code.join(star.products.select(PRODUCT_CODE, PRODUCT_NAME), PRODUCT_CODE).select(
        PRODUCT_CODE, PRODUCT_NAME, SALES)


def rank_products(star: Star, mode: Mode = "top", year: int | None = None) -> DataFrame:
    """(product_code, product_name, sales), top 10 / all / flop 10, optionally one year."""
    return _order(product_counts(star, year), mode, [PRODUCT_CODE], _limit_for(mode))


def rank_products_by_name(star: Star, year: int) -> DataFrame:
    """All products of one year ordered by name, descending (then code)."""
    return product_counts(star, year).orderBy(F.col(PRODUCT_NAME).desc(), F.col(PRODUCT_CODE).asc())


def product_top_countries(star: Star, product_code: str, year: int | None = None,
                          k: int = DRILL_LIMIT) -> DataFrame:
    """The k countries with most lines of one product.

    The inner join with products (a line counts only if its product exists)
    is kept as a join with the distinct codes of products filtered to this one
    code: that side has at most one row by construction, so broadcasting it is
    safe, and the lines (all with the same code) are never shuffled on the code.
    Lines are then counted per invoice before meeting the invoices.
    """
    code = F.lit(product_code)
    lines = _lines(star, year).filter(F.col(PRODUCT_CODE) == code)
    known = star.products.filter(F.col(PRODUCT_CODE) == code).select(PRODUCT_CODE).distinct()
    per_invoice = (lines.join(F.broadcast(known), PRODUCT_CODE)
                   .groupBy(INVOICE_NO).agg(F.count(F.lit(1)).alias("n_lines")))
    counted = (per_invoice.join(_invoices(star, year).select(INVOICE_NO, COUNTRY), INVOICE_NO)
               .groupBy(COUNTRY).agg(F.sum("n_lines").cast("bigint").alias(SALES)))
    return _order(counted, "top", [COUNTRY], k)
