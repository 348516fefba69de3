"""Loading batches into stored, bucketed star tables."""

import uuid

import pytest

from conftest import SF001
from salescope.operators import quality
from salescope.plans import etl, workflows
from salescope.sources.testdata import raw_feed_from_testdata


def _same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_load_into_tables_appends_only_new_rows(spark, scratch):
    raw = raw_feed_from_testdata(spark, SF001)
    prefix = "sink" + uuid.uuid4().hex[:8]
    files = sorted(r[0] for r in raw.select("file_name").distinct().collect())
    first, rest = files[:2], files[2:]
    etl.load_into_tables(raw.filter(raw.file_name.isin(first)), prefix, scratch, n_buckets=4)
    etl.load_into_tables(raw.filter(raw.file_name.isin(rest)), prefix, scratch, n_buckets=4)
    stored = etl.table_star(spark, prefix)
    once = etl.run_etl(raw).star
    for name in ("countries", "products", "invoices", "invoice_lines"):
        assert _same(stored.tables()[name], once.tables()[name]), name
    # loading the whole batch again changes nothing
    etl.load_into_tables(raw, prefix, scratch, n_buckets=4)
    stored = etl.table_star(spark, prefix)
    for name in ("countries", "products", "invoices", "invoice_lines"):
        assert _same(stored.tables()[name], once.tables()[name]), name
    assert all(r["n_duplicate_keys"] == 0 for r in quality.check_primary_keys(stored).collect())
    assert all(r["n_orphans"] == 0 for r in quality.check_foreign_keys(stored).collect())


def _forget(spark, prefix):
    # the tables are external: another process, with an empty catalog, sees the folder alone
    for t in etl.STORED:
        spark.sql(f"DROP TABLE IF EXISTS {prefix}_{t}")


def test_store_outlives_its_catalog(spark, scratch):
    raw = raw_feed_from_testdata(spark, SF001)
    prefix = "again" + uuid.uuid4().hex[:8]
    files = sorted(r[0] for r in raw.select("file_name").distinct().collect())
    for part in (files[:2], files[2:4], files[4:]):
        etl.load_into_tables(raw.filter(raw.file_name.isin(part)), prefix, scratch, n_buckets=4)
        _forget(spark, prefix)
    assert etl.open_store(spark, scratch, prefix)
    stored = etl.table_star(spark, prefix, scratch)
    once = etl.run_etl(raw).star
    for name in etl.STORED:
        assert _same(stored.tables()[name], once.tables()[name]), name
    assert "Bucketed: true" in stored.lines.groupBy("invoice_no").count()._jdf.queryExecution().toString()


def test_incomplete_store_is_refused(spark, scratch):
    raw = raw_feed_from_testdata(spark, SF001)
    prefix = "part" + uuid.uuid4().hex[:8]
    with pytest.raises(ValueError, match="no star"):
        workflows.stored_star(spark, scratch, prefix)
    raw.select("Country").write.parquet(f"{scratch}/countries")
    with pytest.raises(ValueError, match="incomplete"):
        etl.load_into_tables(raw, prefix, scratch, n_buckets=4)
    assert spark.read.parquet(f"{scratch}/countries").count() == raw.count()


def test_hot_bucket_falls_back_to_plain_reads(spark, scratch):
    from pyspark.sql import functions as F

    from salescope.star_schema import Star

    # one invoice holds most of the lines
    lines = spark.range(20000).select(F.when(F.col("id") < 15000, F.lit(7)).otherwise(F.col("id")).alias("invoice_no"),
                                      F.col("id").cast("string").alias("product_code"))
    invoices = lines.select("invoice_no").distinct().select("invoice_no", F.current_date().alias("invoice_date"),
                                                            F.lit("X").alias("country"))
    products = lines.select("product_code", F.lit("n").alias("product_name"))
    countries = spark.range(1).select(F.lit("X").alias("country"))
    prefix = "hot" + uuid.uuid4().hex[:8]
    etl.save_star_tables(Star(countries, products, invoices, lines), scratch, prefix, n_buckets=8)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        assert etl.bucket_skewed(spark, f"{scratch}/invoice_lines")
        star = etl.table_star(spark, prefix, scratch)
        plan = star.lines._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert "Bucketed: true" not in plan
    assert not etl.bucket_skewed(spark, f"{scratch}/invoices")


def test_plain_parquet_star_round_trip(spark, scratch):
    from salescope.sources.testdata import star_from_testdata

    star = star_from_testdata(spark, SF001)
    etl.write_star(star, scratch)
    back = etl.read_star(spark, scratch)
    for name in ("countries", "products", "invoices", "invoice_lines"):
        cols = star.tables()[name].columns
        assert _same(back.tables()[name].select(*cols), star.tables()[name]), name
    # a year ranking on the stored star reads one invoice partition and gives the same answer
    from salescope.operators import rank
    df = rank.rank_countries(back, "all", 1998)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(invoice_year" in plan and "invoice_year" in plan
    assert _same(df, rank.rank_countries(star, "all", 1998))
