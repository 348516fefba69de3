"""Invariants that hold whatever the data (run on sf0.01)."""

from pyspark.sql import functions as F

from conftest import SF01
from salescope.operators import feedback, quality, rank
from salescope.plans import etl
from salescope.sources.testdata import raw_feed_from_testdata, star_from_testdata


def test_feedback_counts_fall(spark):
    rows = feedback.feedback_counts(raw_feed_from_testdata(spark, SF01)).collect()
    assert len(rows) == 5
    for r in rows:
        seq = [r[c] for c in feedback.COUNT_COLUMNS]
        assert all(a >= b for a, b in zip(seq, seq[1:])), seq
        assert r["n_total"] == r["n_country"]


def test_country_sums(spark):
    star = star_from_testdata(spark, SF01)
    n_lines = star.lines.count()
    all_years = {r["country"]: r["sales"] for r in rank.rank_countries(star, "all").collect()}
    assert sum(all_years.values()) == n_lines
    years = [r[0] for r in star.invoices.select(F.year("invoice_date")).distinct().collect()]
    per_year = {}
    for y in years:
        for r in rank.rank_countries(star, "all", y).collect():
            per_year[r["country"]] = per_year.get(r["country"], 0) + r["sales"]
    assert per_year == all_years


def test_load_twice_equals_once(spark):
    raw = raw_feed_from_testdata(spark, SF01)
    once = etl.run_etl(raw).star
    twice = etl.run_etl(raw, old=once).star
    for name in ("countries", "products", "invoices", "invoice_lines"):
        a, b = once.tables()[name], twice.tables()[name]
        assert a.count() == b.count() and a.exceptAll(b).isEmpty(), name


def test_strict_equals_insert_new_without_clashes(spark):
    raw = raw_feed_from_testdata(spark, SF01)
    a = etl.run_etl(raw, mode="insert_new").star
    b = etl.run_etl(raw, mode="strict").star
    for name in ("invoices", "invoice_lines"):
        assert a.tables()[name].exceptAll(b.tables()[name]).isEmpty(), name
        assert b.tables()[name].exceptAll(a.tables()[name]).isEmpty(), name


def test_adapter_star_is_clean(spark):
    star = star_from_testdata(spark, SF01)
    assert all(r["n_null_keys"] == 0 and r["n_duplicate_keys"] == 0
               for r in quality.check_primary_keys(star).collect())
    assert all(r["n_orphans"] == 0 for r in quality.check_foreign_keys(star).collect())
    assert all(r["n_nulls"] == 0 for r in quality.check_not_null(star).collect())
    assert all(r["n_violations"] == 0 for r in quality.check_lengths(star).collect())


def test_loaded_feed_star_passes_checks(spark):
    star = etl.run_etl(raw_feed_from_testdata(spark, SF01)).star
    assert all(r["n_orphans"] == 0 for r in quality.check_foreign_keys(star).collect())
    assert all(r["n_duplicate_keys"] == 0 for r in quality.check_unique_lines(star).collect())


def test_clean_rows_equal_last_count(spark):
    from salescope.operators import clean

    raw = raw_feed_from_testdata(spark, SF01)
    per_file = {r["file_name"]: r["count"] for r in clean.clean(raw).groupBy("file_name").count().collect()}
    totals = {r["file_name"]: r["n_total"] for r in feedback.feedback_counts(raw).collect()}
    assert per_file == {k: v for k, v in totals.items() if v}
