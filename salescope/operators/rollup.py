"""A1-A17 from a rollup of the lines kept at load.

The cube counts lines by invoice year, country and product code at all eight levels. Counts add up, so a batch
contributes the cube of its new lines, and a level's current counts are the sums over the batches. Every ranking reads one
level: its rows number years x countries x products at most, whatever the number of lines. Names are joined
when a ranking is asked for, so renamed products need no new counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.operators.rank import DRILL_LIMIT, Mode, _limit_for, _order
from salescope.star_schema import COUNTRY, INVOICE_YEAR, PRODUCT_CODE, PRODUCT_NAME, SALES

DIMENSIONS = (INVOICE_YEAR, COUNTRY, PRODUCT_CODE)
LEVEL = "level"
#: A product with a larger share of the lines is counted before its rows are dealt to one task.
HOT_SHARE = 0.001


def level_of(*kept: str) -> int:
    """``grouping_id`` of the level that keeps these dimensions: a bit is set for each one summed over."""
    return sum(1 << len(DIMENSIONS) - 1 - i for i, d in enumerate(DIMENSIONS) if d not in kept)


def line_cube(lines: DataFrame, share: float = 1.0) -> DataFrame:
    """invoice_year, country, product_code, level, sales from lines with the three dimensions.

    The lines are counted at the finest level first (map-side) if a product may have more than HOT_SHARE of them (``share``). The cells, or
    the lines, are then dealt out by product: the levels that keep the product are summed where they lie, without another shuffle; the others
    have few rows (years x countries)."""
    if share > HOT_SHARE:
        cells = lines.groupBy(*DIMENSIONS).agg(F.count(F.lit(1)).alias("n")).repartition(PRODUCT_CODE)
    else:
        cells = lines.select(*DIMENSIONS).repartition(PRODUCT_CODE).groupBy(*DIMENSIONS).agg(F.count(F.lit(1)).alias("n"))
    year, country = (cells.schema[d].dataType.simpleString() for d in (INVOICE_YEAR, COUNTRY))
    levels = [F.struct((F.col(INVOICE_YEAR) if y else F.lit(None).cast(year)).alias(INVOICE_YEAR), (F.col(COUNTRY) if c else F.lit(None).cast(country)).alias(COUNTRY),
                       F.lit(level_of(*[INVOICE_YEAR] * y, *[COUNTRY] * c, PRODUCT_CODE)).alias(LEVEL)) for y in (1, 0) for c in (1, 0)]
    fine = (cells.select(PRODUCT_CODE, "n", F.explode(F.array(*levels)).alias("_k")).select("_k.*", PRODUCT_CODE, "n")
            .groupBy(PRODUCT_CODE, INVOICE_YEAR, COUNTRY, LEVEL).agg(F.sum("n").cast("bigint").alias(SALES)))
    coarse = cells.cube(INVOICE_YEAR, COUNTRY).agg(F.sum("n").cast("bigint").alias(SALES), (F.grouping_id() * 2 + 1).cast("int").alias(LEVEL))
    coarse = coarse.withColumn(PRODUCT_CODE, F.lit(None).cast(cells.schema[PRODUCT_CODE].dataType))
    return fine.select(*DIMENSIONS, LEVEL, SALES).unionByName(coarse.select(*DIMENSIONS, LEVEL, SALES))


def merged(cubes: DataFrame) -> DataFrame:
    """The cubes of several batches as one."""
    return cubes.groupBy(*DIMENSIONS, LEVEL).agg(F.sum(SALES).cast("bigint").alias(SALES)).select(*DIMENSIONS, LEVEL, SALES)


def _at(cubes: DataFrame, labels: list[str], year: int | None = None, where: Column | None = None, fixed: tuple[str, ...] = ()) -> DataFrame:
    """Sales by ``labels``, from the level of the labels, the fixed dimensions and the year if one is asked for."""
    kept = [*labels, *fixed] + ([] if year is None else [INVOICE_YEAR])
    rows = cubes.filter(F.col(LEVEL) == F.lit(level_of(*kept)))
    if year is not None:
        rows = rows.filter(F.col(INVOICE_YEAR) == F.lit(int(year)))
    if where is not None:
        rows = rows.filter(where)
    return rows.groupBy(*labels).agg(F.sum(SALES).cast("bigint").alias(SALES))


def rank_countries(cubes: DataFrame, mode: Mode = "top", year: int | None = None) -> DataFrame:
    """A1-A6."""
    return _order(_at(cubes, [COUNTRY], year), mode, [COUNTRY], _limit_for(mode))


def country_top_products(cubes: DataFrame, products: DataFrame, country: str, year: int | None = None, k: int = DRILL_LIMIT) -> DataFrame:
    """A7-A8."""
    per_code = _at(cubes, [PRODUCT_CODE], year, F.col(COUNTRY) == F.lit(country), (COUNTRY,))
    per_name = (per_code.join(products.select(PRODUCT_CODE, PRODUCT_NAME), PRODUCT_CODE)
                .groupBy(PRODUCT_NAME).agg(F.sum(SALES).cast("bigint").alias(SALES)))
    return _order(per_name, "top", [PRODUCT_NAME], k)


def product_counts(cubes: DataFrame, products: DataFrame, year: int | None = None) -> DataFrame:
    named = _at(cubes, [PRODUCT_CODE], year).join(products.select(PRODUCT_CODE, PRODUCT_NAME), PRODUCT_CODE)
    return named.select(PRODUCT_CODE, PRODUCT_NAME, SALES)


def rank_products(cubes: DataFrame, products: DataFrame, mode: Mode = "top", year: int | None = None) -> DataFrame:
    """A9-A14."""
    return _order(product_counts(cubes, products, year), mode, [PRODUCT_CODE], _limit_for(mode))


def rank_products_by_name(cubes: DataFrame, products: DataFrame, year: int) -> DataFrame:
    """A15."""
    return product_counts(cubes, products, year).orderBy(F.col(PRODUCT_NAME).desc(), F.col(PRODUCT_CODE).asc())


def product_top_countries(cubes: DataFrame, product_code: str, year: int | None = None, k: int = DRILL_LIMIT) -> DataFrame:
    """A16-A17."""
    counted = _at(cubes, [COUNTRY], year, F.col(PRODUCT_CODE) == F.lit(product_code), (PRODUCT_CODE,))
    return _order(counted, "top", [COUNTRY], k)
