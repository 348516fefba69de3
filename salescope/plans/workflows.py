"""The three user flows of the source application, as functions.

* ``upload_report``  -- send files, get the per-file cleaning report (counts,
  rows removed, percent) and the report matrix;
* ``save_batch``     -- load the files into the stored star (insert-new or the
  per-file all-or-nothing ``strict`` mode), returning the per-file verdict;
* ``country_view`` / ``product_view`` -- the two dashboards for a selection;
  ``select_product_by_name`` is the drill-down from a product bar (a name) to
  its code(s).

All return lazy DataFrames except ``save_batch``, which writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.operators import feedback, lookup
from salescope.plans import dashboard, store
from salescope.plans.params import DashboardParams
from salescope.sources.csv_files import file_label, list_files, read_invoice_csv
from salescope.star_schema import Star


def upload_report(spark: SparkSession, paths: list[str], **csv_options) -> tuple[DataFrame, DataFrame]:
    """(per-file counts with n_removed, pct_removed and file_label, the base name; report matrix). Every input
    file is listed by its path, also one with no data row (its percent is NULL)."""
    files = list_files(spark, paths, csv_options.get("recursive", False))
    counts = feedback.with_percent(feedback.feedback_counts(read_invoice_csv(spark, paths, **csv_options), files))
    matrix = feedback.feedback_matrix(counts.drop("n_removed", "pct_removed"))
    return counts.withColumn("file_label", file_label(F.col("file_name"))), matrix


def save_batch(spark: SparkSession, paths: list[str], tables_path: str, prefix: str, *,
               n_buckets: int = 64, mode: str = "insert_new", **csv_options) -> DataFrame:
    """Load the files into the star stored under ``tables_path`` (tables ``<prefix>_*``), as one
    batch that readers see whole or not at all; returns the per-file verdict."""
    raw = read_invoice_csv(spark, paths, **csv_options)
    return store.load_batch(raw, tables_path, prefix, n_buckets, mode=mode).verdict


def stored_star(spark: SparkSession, tables_path: str, prefix: str) -> Star:
    """The star saved under ``tables_path``, also by another application."""
    star = store.open_star(spark, tables_path, prefix)
    if star is None:
        raise ValueError(f"no star is stored under {tables_path}")
    return star


def country_view(star: Star, params: DashboardParams = DashboardParams()) -> DataFrame:
    return dashboard.dashboard_country(star, params)


def product_view(star: Star, params: DashboardParams = DashboardParams()) -> DataFrame:
    return dashboard.dashboard_product(star, params)


def select_product_by_name(star: Star, name: str) -> DataFrame:
    return lookup.code_by_name(star, name)
