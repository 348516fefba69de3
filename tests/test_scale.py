"""What a task holds does not grow with the tables: rows per task, buckets, the cube's levels."""

import uuid

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from salescope import session
from salescope.operators import clean, load, rollup, star
from salescope.operators.numbering import dense_numbers, dense_numbers_by_group
from salescope.plans import catalog, etl, store
from salescope.sources import testdata


def most_rows_in_a_task(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("build", [testdata.lines_from_testdata, testdata.raw_feed_from_testdata])
def test_line_items_are_dealt_out_by_their_count(spark, monkeypatch, build):
    want = build(spark, SF001).drop("row_pos").collect()
    monkeypatch.setattr(testdata, "LINES_PER_TASK", 200)
    got = build(spark, SF001).drop("row_pos")
    assert sorted(map(str, got.collect())) == sorted(map(str, want))
    assert most_rows_in_a_task(got) < 600 < len(want) / 6


def test_codes_are_padded_as_printf_does(spark):
    n = F.col("n")
    numbers = spark.createDataFrame([(x,) for x in (0, 7, 99999, 100000, 7200000, -1, -9999, -10000, 2**63 - 1, -2**63)], "n long")
    padded = numbers.select(testdata._pad5(n).alias("a"), F.format_string("%05d", n).alias("b"))
    assert padded.filter("a <> b").isEmpty() and padded.count() == 10
    assert "format_string" not in testdata.raw_feed_from_testdata(spark, SF001)._jdf.queryExecution().optimizedPlan().toString()


def test_a_large_first_batch_gets_more_buckets(spark, scratch, monkeypatch):
    monkeypatch.setattr(store, "BUCKET_ROWS", 200)
    prefix = "bk" + uuid.uuid4().hex[:8]
    raw = testdata.raw_feed_from_testdata(spark, SF001)
    store.load_batch(raw.filter("file_name <= 'feed_1.csv'"), scratch, prefix, n_buckets=2)
    store.load_batch(raw.filter("file_name >= 'feed_1.csv'"), scratch, prefix, n_buckets=2)
    first, second = store.commits(spark, scratch)
    assert first.n_buckets == second.n_buckets > max(2, first.n_lines // 200 - 1)


def test_cells_of_the_cube_are_not_shuffled_at_every_level(spark):
    lines = spark.range(20000).selectExpr("CAST(2000 + id % 3 AS INT) AS invoice_year", "concat('c', id % 5) AS country", "concat('p', id % 4001) AS product_code").checkpoint()
    cube = rollup.line_cube(lines)
    plan = cube._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan.split("Expand")[-1]
    want = lines.cube(*rollup.DIMENSIONS).agg(F.count(F.lit(1)).alias("sales"), F.grouping_id().cast("int").alias("level"))
    assert cube.exceptAll(want.select(cube.columns)).isEmpty() and cube.count() == want.count()


def test_the_feed_is_cleaned_once_for_the_appended_lines(spark):
    plan = catalog.QUERIES["load_append_lines"](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_returnflag") == 2  # the lines of the star, kept and met; those of the feed are not read again


def test_late_steps_parse_texts_before_the_deduplication(spark):
    raw = testdata.raw_feed_from_testdata(spark, SF001)
    for step in ("clean_positive_qty", "clean_drop_unspecified", "clean_drop_mailout"):
        got = clean.upto_step(raw, step)
        above = got._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [")[0]
        assert "RLIKE" not in above and "try_make_timestamp" not in above.lower(), step
        want = clean.run_steps(raw, step)
        assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_strict_load_groups_the_rows_of_the_files_once(spark, monkeypatch):
    calls = []
    keep = load._checkpoint
    monkeypatch.setattr(load, "_checkpoint", lambda df: calls.append(df.columns) or keep(df))
    raw = testdata.raw_feed_from_testdata(spark, SF001)
    result = etl.run_etl(raw, testdata.star_from_testdata(spark, SF001), mode="strict")
    assert ["file_name", "invoice_no", "product_code", "n"] in calls and ["file_name", "invoice_no", "invoice_date", "country"] in calls
    assert result.verdict.count() == 5


def same_rows(a, b):
    a = a.select(b.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_kept_rows_come_back_as_they_were_in_files_of_few_rows(spark, monkeypatch):
    rows = spark.range(1000).selectExpr("id AS `a b`", "CASE WHEN id % 3 = 0 THEN NULL ELSE struct(id, 'x' AS y) END AS `c.d`", "NULL AS e", "timestamp_ntz'2011-01-02 03:04:05' AS f")
    monkeypatch.setattr(session, "KEPT_FILE_ROWS", 100)
    got = session.kept(rows)
    assert got.columns == rows.columns and got.withColumn("e", F.lit(None)).exceptAll(rows).isEmpty() and got.count() == 1000
    assert len(got.inputFiles()) >= 10
    session.drop_kept(got)
    with pytest.raises(Exception):
        got.collect()


@pytest.mark.parametrize("most", [0, 10_000])
@pytest.mark.parametrize("stored", [False, True])
def test_only_repeated_keys_are_grouped_for_the_flags(spark, monkeypatch, most, stored):
    raw = testdata.raw_feed_from_testdata(spark, SF001)
    nulls = raw.limit(30).withColumns({"StockCode": F.lit(None).cast("string"), "InvoiceNo": F.lit(None).cast("string")})
    raw = raw.unionByName(raw.filter("StockCode LIKE '%a'")).unionByName(nulls).unionByName(nulls).checkpoint()
    monkeypatch.setattr(clean, "REPEATED_KEYS", most)
    grouped = []
    keep = clean.dedupe_first
    monkeypatch.setattr(clean, "dedupe_first", lambda df: grouped.append(df.count()) or keep(df))
    got = clean.kept_flags(raw, stored)
    assert got.columns == clean.flagged(raw).columns and same_rows(got, clean.flagged(raw))
    assert (grouped[0] < 0.8 * raw.count()) == (most > 0)


def test_the_store_state_builds_the_feed_once(spark, monkeypatch):
    calls = []
    keep = catalog.raw_feed_from_testdata
    for module in (catalog, testdata):
        monkeypatch.setattr(module, "raw_feed_from_testdata", lambda *a: calls.append(a) or keep(*a))
    assert catalog.QUERIES["load_store_state"](spark, SF001).count() == 4
    assert len(calls) == 1


def test_offered_rows_are_dealt_once(spark, scratch):
    rows = clean.clean(testdata.raw_feed_from_testdata(spark, SF001))
    prefix = "of" + uuid.uuid4().hex[:8]
    name, at = store._offered(rows, prefix, 4)
    offer = spark.table(name)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for got, want in ((star.star_invoices(offer), star.star_invoices(rows)), (star.star_invoices(offer, True), star.star_invoices(rows, True)),
                          (star.star_invoice_lines(offer), star.star_invoice_lines(rows)), (star.star_invoice_lines(offer, True), star.star_invoice_lines(rows, True))):
            assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
            assert same_rows(got, want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    store._forget(spark, name, at)
    assert not spark.catalog.tableExists(name)


def test_a_product_of_many_lines_is_counted_before_it_is_dealt(spark):
    lines = spark.range(3000).selectExpr("CAST(2000 + id % 3 AS INT) AS invoice_year", "concat('c', id % 5) AS country", "CASE WHEN id % 7 > 0 THEN concat('p', id % 401) END AS product_code").checkpoint()
    assert store._share(lines.withColumn("product_code", F.lit("p")), 3000) == 1.0 > 10 * store._share(lines.filter("product_code IS NOT NULL"), 3000)
    for share in (0.0, 1.0):
        cube = rollup.line_cube(lines, share)
        want = lines.cube(*rollup.DIMENSIONS).agg(F.count(F.lit(1)).alias("sales"), F.grouping_id().cast("int").alias("level"))
        assert same_rows(cube, want) and cube.schema.simpleString() == want.select(cube.columns).schema.simpleString()
    before_dealing = [rollup.line_cube(lines, s)._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[-1] for s in (0.0, 1.0)]
    assert ["Aggregate" in p for p in before_dealing] == [False, True]
    assert rollup.line_cube(lines.limit(0)).count() == 0


def test_numbers_by_group_are_those_of_the_whole_order(spark):
    rows = spark.range(2000).selectExpr("id * 7919 % 97 AS g", "concat('p', id) AS k").checkpoint()
    got = dense_numbers_by_group(rows, "g", ["k"], "no", start=5)
    assert got.columns == ["g", "k", "no"] and same_rows(got, dense_numbers(rows, ["g", "k"], "no", start=5))
    assert dense_numbers_by_group(rows.limit(0), "g", ["k"], "no").count() == 0


@pytest.mark.parametrize("most", [0, 1000])
def test_first_names_need_positions_only_where_names_differ(spark, monkeypatch, most):
    rows = spark.range(600).selectExpr("concat('f', id % 3) AS file_name", "id * 7919 % 600 AS row_pos", "CASE WHEN id % 50 > 0 THEN concat('p', id % 50) END AS product_code",
                                       "CASE WHEN id % 50 = 9 AND id % 4 = 1 THEN NULL WHEN id % 50 < 5 THEN concat('n', id % 11) ELSE concat('m', id % 50) END AS product_name")
    monkeypatch.setattr(star, "SEVERAL_NAMES", most)
    assert same_rows(star.star_products_by_name(rows), star.star_products(rows))
    one = rows.filter("product_code > 'p90'")
    assert same_rows(star.star_products_by_name(one), star.star_products(one))
