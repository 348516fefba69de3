"""The two dashboards as single DataFrames.

A dashboard shows a ranking and a drill-down. Both are returned in one
DataFrame with a ``panel`` column ('ranking' or 'drilldown'); within a panel
the order is given by (sales, label) as in the underlying ranking. No
window numbering is added: the 'all' ranking is unbounded and a global
row_number would funnel it through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.operators import rank
from salescope.plans.params import DashboardParams
from salescope.star_schema import COUNTRY, PRODUCT_CODE, PRODUCT_NAME, SALES, Star


def _panel(df: DataFrame, panel: str, label: str) -> DataFrame:
    return df.select(F.lit(panel).alias("panel"), F.col(label).alias("label"), F.col(SALES))


def dashboard_country(star: Star, params: DashboardParams = DashboardParams()) -> DataFrame:
    ranking = rank.rank_countries(star, params.mode, params.year)
    drill = rank.country_top_products(star, params.country, params.year)
    return _panel(ranking, "ranking", COUNTRY).unionByName(_panel(drill, "drilldown", PRODUCT_NAME))


def dashboard_product(star: Star, params: DashboardParams = DashboardParams()) -> DataFrame:
    ranking = rank.rank_products(star, params.mode, params.year)
    drill = rank.product_top_countries(star, params.product_code, params.year)
    return _panel(ranking, "ranking", PRODUCT_CODE).unionByName(_panel(drill, "drilldown", COUNTRY))
