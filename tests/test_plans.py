"""Physical-plan properties the design relies on."""

import contextlib
import io

import pytest

from conftest import SF001
from salescope.plans import catalog


def formatted(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


# rows that read a store load it twice first; what is left to plan then is a scan (tests/test_store.py has its plans)
LOADED_FIRST = {"load_surrogate_ids", "load_store_products", "load_store_state", "load_rollup"}


@pytest.mark.parametrize("key", sorted(set(catalog.QUERIES) - LOADED_FIRST))
def test_no_python_in_plans(spark, key):
    df = catalog.QUERIES[key](spark, SF001)
    p = formatted(df)
    for bad in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas"):
        assert bad not in p, (key, bad)


def test_year_filter_reaches_scan(spark):
    p = formatted(catalog.QUERIES["country_top10_year"](spark, SF001))
    assert "GreaterThanOrEqual(o_orderdate" in p and "LessThan(o_orderdate" in p


def test_topk_is_take_ordered(spark):
    for key in ("country_top10", "product_flop10", "country_top5_products", "product_top5_countries_year"):
        assert "TakeOrderedAndProject" in formatted(catalog.QUERIES[key](spark, SF001)), key


def test_dedupe_is_aggregate_not_window(spark):
    p = formatted(catalog.QUERIES["clean_dedupe_first"](spark, SF001))
    assert "HashAggregate" in p or "ObjectHashAggregate" in p or "SortAggregate" in p
    assert "Window" not in p


def test_rankings_have_no_window_or_cartesian(spark):
    for key in catalog.QUERIES:
        if key.startswith(("country_", "product_", "dashboard_")):
            p = formatted(catalog.QUERIES[key](spark, SF001))
            assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, key
            assert "Window " not in p, key


def test_column_pruning(spark):
    p = formatted(catalog.QUERIES["product_top10"](spark, SF001))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in p


def test_bucketed_star_joins_without_shuffle(spark, scratch):
    import uuid

    from salescope.operators import rank
    from salescope.plans import etl
    from salescope.sources.testdata import star_from_testdata

    prefix = "t" + uuid.uuid4().hex[:8]
    etl.save_star_tables(star_from_testdata(spark, SF001), scratch, prefix, n_buckets=4)
    star = etl.table_star(spark, prefix)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = rank.rank_countries(star, "top")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in p
    # the only exchange left is the small one on country
    exchanges = [line for line in p.splitlines() if "Exchange" in line and "hashpartitioning" in line]
    assert exchanges and all("country" in line for line in exchanges), exchanges


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _partial_before_exchange(plan: str, func: str) -> bool:
    """True if a partial aggregate of ``func`` appears below (after, in the text) an Exchange."""
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            if any(f"partial_{func}" in below for below in lines[i + 1:i + 4]):
                return True
    return False


@pytest.mark.parametrize("key,func", [("clean_dedupe_first", "min"), ("feedback_counts", "min"),
                                      ("star_products", "min"), ("star_invoices", "min"),
                                      ("country_top10", "count"), ("product_top10", "count"),
                                      ("country_top5_products_year", "count"),
                                      ("product_top5_countries", "count")])
def test_hot_keys_are_pre_aggregated_map_side(spark, key, func):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # the large-table shape
    try:
        plan = _physical(catalog.QUERIES[key](spark, SF001))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert _partial_before_exchange(plan, func), (key, plan[:3000])
    assert "Window" not in plan, key
