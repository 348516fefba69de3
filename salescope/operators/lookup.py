"""Small lookups on the star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.operators import rank
from salescope.star_schema import Star


def list_countries(star: Star) -> DataFrame:
    """S6."""
    return star.countries.select("country")


def list_products(star: Star) -> DataFrame:
    """The product keys."""
    return star.products.select("product_code")


def name_by_code(star: Star, code: str) -> DataFrame:
    """The product row of one code (at most one row, the code is the key)."""
    return star.products.filter(F.col("product_code") == F.lit(code)).select("product_code", "product_name")


def code_by_name(star: Star, name: str) -> DataFrame:
    """Every product with this exact name and how many there are.

    The drill-down from a bar gives a name; several codes may carry it, so
    all matches are returned with ``n_matches`` instead of failing. The count
    is an equi-join on the name with its one-row aggregate (no global window).
    """
    matches = star.products.filter(F.col("product_name") == F.lit(name)).select("product_code", "product_name")
    n = matches.groupBy("product_name").agg(F.count(F.lit(1)).alias("n_matches"))
    return matches.join(n, "product_name").select("product_code", "product_name", "n_matches")


def ranked_product_options(star: Star, mode: rank.Mode = "top", year: int | None = None) -> DataFrame:
    """(code, name) of the products in the current ranking, for the selector."""
    return rank.rank_products(star, mode, year).select("product_code", "product_name")
