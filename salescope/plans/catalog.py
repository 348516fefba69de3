"""Registered queries (one per operator of the inventory) and their SQL twins.

Each Spark query takes ``(spark, sf_dir)`` and returns a lazy DataFrame over
the driver's tables. The SQL twin computes the same result in plain SQL over
the same tables (the DuckDB oracle); column names and types agree.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as _F

from salescope.functions import names as _names
from salescope.operators import clean, feedback, paging, quarantine, rank, rollup
from salescope.operators import load as _load
from salescope.operators import lookup as _lookup
from salescope.operators import quality as _quality
from salescope.operators import star as _starops
from salescope.plans import dashboard
from salescope.plans import etl as _etl
from salescope.plans import store as _store
from salescope.plans.params import DashboardParams
from salescope.plans.sql_twins import (
    BATCH_CTES,
    CLEAN_STEP_KEYS,
    FEED_STAR_CTES,
    FEEDBACK_CTES,
    RAW_CTE,
    ROLLUP_SQL,
    STAR_CTES,
    STORE_STATE_SQL,
    STRICT_VERDICT_SQL,
    SURROGATE_SQL,
    clean_step_sql,
)
from salescope.session import drop_kept, kept, scratch_path
from salescope.sources.testdata import (
    raw_batches_from_testdata,
    raw_feed_from_testdata,
    raw_feed_via_csv,
    star_from_testdata,
)

# Parameters used by the registered queries on the test tables
# (the country and the product with most lines, a year with many invoices).
P_COUNTRY = "NATION_7"
P_PRODUCT = "558"
P_YEAR = 1998

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


# --------------------------------------------------------------------------- star adapter

STAR_SQL = "WITH " + STAR_CTES


def _star(spark, sf_dir):
    return star_from_testdata(spark, sf_dir)


# --------------------------------------------------------------------------- rankings A1-A17

_COUNTRY_RANK_SQL = STAR_SQL + """
SELECT country, COUNT(*) AS sales
FROM invoices INNER JOIN lines ON invoices.invoice_no = lines.invoice_no
{where}
GROUP BY country ORDER BY sales {dir}, country {limit}
"""
_YEAR_WHERE = "WHERE EXTRACT(YEAR FROM invoices.invoice_date) = {y}"

for _mode, _dir, _limit in (("top10", "DESC", "LIMIT 10"), ("all", "DESC", ""), ("flop10", "ASC", "LIMIT 10")):
    _m = {"top10": "top", "all": "all", "flop10": "flop"}[_mode]
    register(f"country_{_mode}", _COUNTRY_RANK_SQL.format(where="", dir=_dir, limit=_limit))(
        lambda spark, sf, _m=_m: rank.rank_countries(_star(spark, sf), _m))
    register(f"country_{_mode}_year", _COUNTRY_RANK_SQL.format(
        where=_YEAR_WHERE.format(y=P_YEAR), dir=_dir, limit=_limit))(
        lambda spark, sf, _m=_m: rank.rank_countries(_star(spark, sf), _m, P_YEAR))

_COUNTRY_DRILL_SQL = STAR_SQL + """
SELECT product_name, COUNT(*) AS sales
FROM products INNER JOIN lines ON products.product_code = lines.product_code
INNER JOIN invoices ON lines.invoice_no = invoices.invoice_no
WHERE country = '{c}' {year}
GROUP BY product_name ORDER BY sales DESC, product_name LIMIT 5
"""
register("country_top5_products", _COUNTRY_DRILL_SQL.format(c=P_COUNTRY, year=""))(
    lambda spark, sf: rank.country_top_products(_star(spark, sf), P_COUNTRY))
register("country_top5_products_year", _COUNTRY_DRILL_SQL.format(
    c=P_COUNTRY, year=f"AND EXTRACT(YEAR FROM invoice_date) = {P_YEAR}"))(
    lambda spark, sf: rank.country_top_products(_star(spark, sf), P_COUNTRY, P_YEAR))

_PRODUCT_RANK_SQL = STAR_SQL + """
SELECT products.product_code, product_name, COUNT(*) AS sales
FROM products INNER JOIN lines ON products.product_code = lines.product_code
GROUP BY products.product_code, product_name ORDER BY sales {dir}, product_code {limit}
"""
_PRODUCT_RANK_YEAR_SQL = STAR_SQL + """
SELECT products.product_code, product_name, COUNT(*) AS sales
FROM products INNER JOIN lines ON products.product_code = lines.product_code
INNER JOIN invoices ON lines.invoice_no = invoices.invoice_no
WHERE EXTRACT(YEAR FROM invoices.invoice_date) = {y}
GROUP BY products.product_code, product_name ORDER BY {order} {limit}
"""
for _mode, _dir, _limit in (("top10", "DESC", "LIMIT 10"), ("all", "DESC", ""), ("flop10", "ASC", "LIMIT 10")):
    _m = {"top10": "top", "all": "all", "flop10": "flop"}[_mode]
    register(f"product_{_mode}", _PRODUCT_RANK_SQL.format(dir=_dir, limit=_limit))(
        lambda spark, sf, _m=_m: rank.rank_products(_star(spark, sf), _m))
    register(f"product_{_mode}_year", _PRODUCT_RANK_YEAR_SQL.format(
        y=P_YEAR, order=f"sales {_dir}, product_code", limit=_limit))(
        lambda spark, sf, _m=_m: rank.rank_products(_star(spark, sf), _m, P_YEAR))

register("product_all_year_by_name", _PRODUCT_RANK_YEAR_SQL.format(
    y=P_YEAR, order="product_name DESC, product_code", limit=""))(
    lambda spark, sf: rank.rank_products_by_name(_star(spark, sf), P_YEAR))

_PRODUCT_DRILL_SQL = STAR_SQL + """
SELECT country, COUNT(*) AS sales
FROM invoices INNER JOIN lines ON invoices.invoice_no = lines.invoice_no
INNER JOIN products ON lines.product_code = products.product_code
WHERE products.product_code = '{p}' {year}
GROUP BY country ORDER BY sales DESC, country LIMIT 5
"""
register("product_top5_countries", _PRODUCT_DRILL_SQL.format(p=P_PRODUCT, year=""))(
    lambda spark, sf: rank.product_top_countries(_star(spark, sf), P_PRODUCT))
register("product_top5_countries_year", _PRODUCT_DRILL_SQL.format(
    p=P_PRODUCT, year=f"AND EXTRACT(YEAR FROM invoices.invoice_date) = {P_YEAR}"))(
    lambda spark, sf: rank.product_top_countries(_star(spark, sf), P_PRODUCT, P_YEAR))


# --------------------------------------------------------------------------- cleaning C1-C14


def _raw(spark, sf_dir):
    return raw_feed_from_testdata(spark, sf_dir)


def _visible(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in ("row_pos", "dup_count") if c in df.columns])


for _step in CLEAN_STEP_KEYS:
    register(_step, clean_step_sql(_step))(
        lambda spark, sf, _step=_step: _visible(clean.upto_step(_raw(spark, sf), _step)))

register("clean_full", clean_step_sql("clean_drop_mailout"))(
    lambda spark, sf: _visible(clean.clean(_raw(spark, sf))))


# --------------------------------------------------------------------------- feedback F1-F4

_FEEDBACK_SQL = "WITH " + FEEDBACK_CTES

register("feedback_counts", _FEEDBACK_SQL + "SELECT * FROM feedback")(
    lambda spark, sf: feedback.feedback_counts(_raw(spark, sf)))
register("feedback_removed", _FEEDBACK_SQL + "SELECT file_name, n_original, n_total, n_removed FROM feedback_pct")(
    lambda spark, sf: feedback.with_removed(feedback.feedback_counts(_raw(spark, sf))).select(
        "file_name", "n_original", "n_total", "n_removed"))
register("feedback_percent", _FEEDBACK_SQL + "SELECT file_name, n_removed, pct_removed FROM feedback_pct")(
    lambda spark, sf: feedback.with_percent(feedback.feedback_counts(_raw(spark, sf))).select(
        "file_name", "n_removed", "pct_removed"))

_MATRIX_FILES = [f"feed_{i}.csv" for i in range(5)]
_MATRIX_SQL = _FEEDBACK_SQL + ", long AS (" + " UNION ALL ".join(
    f"SELECT file_name, {i} AS step_order, '{label}' AS step, CAST({col} AS DOUBLE) AS value FROM feedback_pct"
    for i, (label, col) in enumerate(feedback.MATRIX_ROWS, 1)) + ")\nSELECT step_order, step, " + ", ".join(
    f"max(CASE WHEN file_name = '{f}' THEN value END) AS \"{f}\"" for f in _MATRIX_FILES) + \
    " FROM long GROUP BY step_order, step"
register("feedback_matrix", _MATRIX_SQL)(
    lambda spark, sf: feedback.feedback_matrix(feedback.feedback_counts(_raw(spark, sf))))


# --------------------------------------------------------------------------- star derivation and load L1-L11


_FS = "WITH " + FEED_STAR_CTES


def _clean_rows(spark, sf):
    return clean.clean(_raw(spark, sf))


register("star_countries", _FS + "SELECT country FROM feed_countries")(
    lambda spark, sf: _starops.star_countries(_clean_rows(spark, sf)))
register("star_invoices", _FS + "SELECT * FROM feed_invoices")(
    lambda spark, sf: _starops.star_invoices(_clean_rows(spark, sf)))
register("star_products", _FS + "SELECT * FROM feed_products")(
    lambda spark, sf: _starops.star_products(_clean_rows(spark, sf)))
register("star_invoice_lines", _FS + "SELECT * FROM feed_lines")(
    lambda spark, sf: _starops.star_invoice_lines(_clean_rows(spark, sf)))


def _names_after(spark, sf, fn):
    raw_names = _starops.star_products(_clean_rows(spark, sf), normalise=False)
    return raw_names.select("product_code", fn(_F.col("product_name")).alias("product_name"))


register("norm_name_rtrim", _FS + "SELECT product_code, name_rtrim AS product_name FROM feed_names")(
    lambda spark, sf: _names_after(spark, sf, _names.rtrim_unicode))
register("norm_name_quotes", _FS + "SELECT product_code, name_quotes AS product_name FROM feed_names")(
    lambda spark, sf: _names_after(spark, sf, lambda c: _names.remove_quotes(_names.rtrim_unicode(c))))
register("norm_name_slashes", _FS + "SELECT product_code, name_all AS product_name FROM feed_names")(
    lambda spark, sf: _names_after(spark, sf, _names.normalise_product_name))

register("load_upsert_countries", _FS + "SELECT country FROM countries UNION SELECT country FROM feed_countries")(
    lambda spark, sf: _load.upsert_countries(_star(spark, sf).countries,
                                             _starops.star_countries(_clean_rows(spark, sf))))
register("load_upsert_products", _FS + "SELECT * FROM loaded_products")(
    lambda spark, sf: _load.upsert_products(_star(spark, sf).products,
                                            _starops.star_products(_clean_rows(spark, sf))))
register("load_append_invoices", _FS + "SELECT * FROM loaded_invoices")(
    lambda spark, sf: _load.append_invoices(_star(spark, sf).invoices,
                                            _starops.star_invoices(_clean_rows(spark, sf))))


def _loaded_lines(spark, sf):
    old = _star(spark, sf)
    # the clean rows feed the products, the invoices and the lines: kept, so that the feed is cleaned once
    rows = kept(_clean_rows(spark, sf))
    products = _load.upsert_products(old.products, _starops.star_products(rows))
    invoices = _load.append_invoices(old.invoices, _starops.star_invoices(rows))
    return _load.append_lines(old.lines, _starops.star_invoice_lines(rows), invoices, products)


register("load_append_lines", _FS + "SELECT * FROM loaded_lines")(_loaded_lines)

register("load_verdict", _FS + """
SELECT coalesce(i.file_name, l.file_name) AS file_name, i.invoices_offered, i.invoices_clashing,
       l.lines_offered, l.lines_clashing
FROM (SELECT f.file_name, count(*) AS invoices_offered, count(o.invoice_no) AS invoices_clashing
      FROM feed_invoices_per_file f LEFT JOIN invoices o ON f.invoice_no = o.invoice_no GROUP BY f.file_name) i
FULL JOIN (
      SELECT f.file_name, count(*) AS lines_offered, count(o.invoice_no) AS lines_clashing
      FROM feed_lines_per_file f LEFT JOIN lines o
        ON f.invoice_no = o.invoice_no AND f.product_code = o.product_code GROUP BY f.file_name) l
  ON i.file_name = l.file_name""")(
    lambda spark, sf: _load.insert_new_verdict(_star(spark, sf).invoices, _star(spark, sf).lines,
                                               _clean_rows(spark, sf)).select(
        _F.col("file_name"), "invoices_offered", "invoices_clashing", "lines_offered", "lines_clashing"))

# Strict, per-file all-or-nothing load into the existing tables: sequential by
# definition; its SQL twin walks the files with a recursive CTE (and the tests
# also check it against a file-by-file loop).

register("load_strict_verdict", STRICT_VERDICT_SQL)(
    lambda spark, sf: _etl.run_etl(_raw(spark, sf), _star(spark, sf), mode="strict").verdict)

register("etl_star", _FS + """
SELECT 'countries' AS table_name, count(*) AS n_rows FROM feed_countries
UNION ALL SELECT 'products', count(*) FROM feed_products
UNION ALL SELECT 'invoices', count(*) FROM feed_invoices
UNION ALL SELECT 'invoice_lines', count(*) FROM feed_lines""")(
    lambda spark, sf: _etl.table_counts(_etl.run_etl(_raw(spark, sf)).star))


# The stored star after two batches that share a file: inserts, skips and renamed products.


def _two_batches(spark, sf, feed=None):
    """(path, prefix) of a new store that the feed was loaded into in two batches; the feed is written once for both."""
    name = "store_" + uuid.uuid4().hex[:12]
    path = scratch_path(spark, name)
    own = kept(_raw(spark, sf)) if feed is None else feed
    for raw in raw_batches_from_testdata(spark, sf, own):
        _store.load_batch(raw, path, name, n_buckets=16, stored=True)
    if feed is None:
        drop_kept(own)
    return path, name


register("load_surrogate_ids", SURROGATE_SQL)(
    lambda spark, sf: _store.open_star(spark, *_two_batches(spark, sf)).lines.select("line_id", "invoice_no", "product_code"))
register("load_store_products", BATCH_CTES + "SELECT * FROM loaded_names")(
    lambda spark, sf: _store.open_star(spark, *_two_batches(spark, sf)).products.select("product_code", "product_name"))


def _store_state(spark, sf):
    """Rows of each table by the ledger's two batches, and as read beside a third batch that was written but not committed."""
    feed = kept(_raw(spark, sf))
    path, name = _two_batches(spark, sf, feed)
    other = feed.withColumns({"InvoiceNo": _F.concat("InvoiceNo", _F.lit("77")), "Description": _F.concat("Description", _F.lit(" III"))})
    _store.load_batch(other, path, name, commit=False, stored=True)
    drop_kept(feed)
    read = _etl.table_counts(_store.open_star(spark, path, name))
    one, two = (_F.max(_F.when(_F.col("seq") == k, _F.col("n"))).alias(c) for k, c in ((1, "n_first"), (2, "n_second")))
    by_batch = _store.ledger(spark, path).selectExpr(
        "seq", "stack(4, 'countries', n_countries, 'products', n_products, 'invoices', n_invoices, 'invoice_lines', n_lines) AS (table_name, n)")
    return by_batch.groupBy("table_name").agg(one, two).join(read, "table_name")


register("load_store_state", STORE_STATE_SQL)(_store_state)
register("load_rollup", ROLLUP_SQL)(
    lambda spark, sf: rollup.merged(_store.open_rollup(spark, *_two_batches(spark, sf))))


# --------------------------------------------------------------------------- integrity checks Q1-Q5


register("check_primary_keys", "WITH " + STAR_CTES + """
SELECT 'countries' AS table_name, 'country' AS key_columns, CAST(sum(n) AS BIGINT) AS n_rows,
       CAST(coalesce(sum(CASE WHEN country IS NULL THEN n END), 0) AS BIGINT) AS n_null_keys,
       count(*) FILTER (WHERE country IS NOT NULL AND n > 1) AS n_duplicate_keys
FROM (SELECT country, count(*) AS n FROM countries GROUP BY country)
UNION ALL
SELECT 'products', 'product_code', CAST(sum(n) AS BIGINT), CAST(coalesce(sum(CASE WHEN product_code IS NULL THEN n END), 0) AS BIGINT),
       count(*) FILTER (WHERE product_code IS NOT NULL AND n > 1)
FROM (SELECT product_code, count(*) AS n FROM products GROUP BY product_code)
UNION ALL
SELECT 'invoices', 'invoice_no', CAST(sum(n) AS BIGINT), CAST(coalesce(sum(CASE WHEN invoice_no IS NULL THEN n END), 0) AS BIGINT),
       count(*) FILTER (WHERE invoice_no IS NOT NULL AND n > 1)
FROM (SELECT invoice_no, count(*) AS n FROM invoices GROUP BY invoice_no)""")(
    lambda spark, sf: _quality.check_primary_keys(_star(spark, sf)))

register("check_unique_lines", "WITH " + STAR_CTES + """
SELECT 'invoice_lines' AS table_name, 'invoice_no,product_code' AS key_columns, CAST(sum(n) AS BIGINT) AS n_rows,
       CAST(coalesce(sum(CASE WHEN invoice_no IS NULL OR product_code IS NULL THEN n END), 0) AS BIGINT) AS n_null_keys,
       count(*) FILTER (WHERE invoice_no IS NOT NULL AND product_code IS NOT NULL AND n > 1) AS n_duplicate_keys
FROM (SELECT invoice_no, product_code, count(*) AS n FROM lines GROUP BY invoice_no, product_code)""")(
    lambda spark, sf: _quality.check_unique_lines(_star(spark, sf)))

register("check_foreign_keys", "WITH " + STAR_CTES + """
SELECT 'invoices.country -> countries' AS relation, count(*) AS n_orphans
FROM invoices i WHERE NOT EXISTS (SELECT 1 FROM countries c WHERE c.country = i.country)
UNION ALL SELECT 'invoice_lines.invoice_no -> invoices', count(*)
FROM lines l WHERE NOT EXISTS (SELECT 1 FROM invoices i WHERE i.invoice_no = l.invoice_no)
UNION ALL SELECT 'invoice_lines.product_code -> products', count(*)
FROM lines l WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.product_code = l.product_code)""")(
    lambda spark, sf: _quality.check_foreign_keys(_star(spark, sf)))

_NN = [("countries", "countries", "country"), ("products", "products", "product_code"),
       ("products", "products", "product_name"), ("invoices", "invoices", "invoice_no"),
       ("invoices", "invoices", "invoice_date"), ("invoices", "invoices", "country"),
       ("invoice_lines", "lines", "invoice_no"), ("invoice_lines", "lines", "product_code")]
register("check_not_null", "WITH " + STAR_CTES + "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_nulls FROM {v}\n"
    for t, v, c in _NN))(
    lambda spark, sf: _quality.check_not_null(_star(spark, sf)))

register("check_lengths", "WITH " + STAR_CTES + """
SELECT 'countries' AS table_name, 'country' AS column_name, CAST(30 AS BIGINT) AS max_allowed,
       count(*) FILTER (WHERE length(country) > 30) AS n_violations FROM countries
UNION ALL SELECT 'products', 'product_code', 20, count(*) FILTER (WHERE length(product_code) > 20) FROM products
UNION ALL SELECT 'products', 'product_name', 50, count(*) FILTER (WHERE length(product_name) > 50) FROM products
UNION ALL SELECT 'invoices', 'country', 30, count(*) FILTER (WHERE length(country) > 30) FROM invoices
UNION ALL SELECT 'invoices', 'invoice_no', 2147483647,
       count(*) FILTER (WHERE NOT (invoice_no BETWEEN -2147483648 AND 2147483647)) FROM invoices""")(
    lambda spark, sf: _quality.check_lengths(_star(spark, sf)))


# --------------------------------------------------------------------------- scans S1-S7


_RAW_COLS = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID",
             "Country"]

register("scan_raw", "WITH " + RAW_CTE + "SELECT * EXCLUDE (k1, k2, k3, k4) FROM raw")(
    lambda spark, sf: raw_feed_via_csv(spark, sf).drop("row_pos"))


def _null_report(spark, sf):
    df = raw_feed_via_csv(spark, sf)
    agg = df.groupBy("file_name").agg(*[_F.count_if(_F.col(c).isNull()).alias(c) for c in _RAW_COLS])
    stack = ", ".join(f"'{c}', `{c}`" for c in _RAW_COLS)
    return agg.selectExpr("file_name", f"stack({len(_RAW_COLS)}, {stack}) AS (column_name, n_nulls)")


register("scan_null_tokens", "WITH " + RAW_CTE + "\nUNION ALL ".join(
    f"SELECT file_name, '{c}' AS column_name, count(*) FILTER (WHERE \"{c}\" IS NULL) AS n_nulls "
    f"FROM raw GROUP BY file_name\n" for c in _RAW_COLS))(_null_report)


def _multi_file(spark, sf):
    df = raw_feed_via_csv(spark, sf)
    return df.groupBy("file_name").agg(
        _F.count(_F.lit(1)).alias("n_rows"),
        _F.min_by("InvoiceNo", "row_pos").alias("first_invoice"),
        _F.min_by("StockCode", "row_pos").alias("first_code"),
        _F.max_by("InvoiceNo", "row_pos").alias("last_invoice"),
        _F.max_by("StockCode", "row_pos").alias("last_code"))


register("scan_multi_file", "WITH " + RAW_CTE + """,
ordered AS (SELECT file_name, "InvoiceNo", "StockCode",
  row_number() OVER (PARTITION BY file_name ORDER BY k1, k2, k3, k4) AS rf,
  row_number() OVER (PARTITION BY file_name ORDER BY k1 DESC, k2 DESC, k3 DESC, k4 DESC) AS rl FROM raw)
SELECT file_name, count(*) AS n_rows,
       max(CASE WHEN rf = 1 THEN "InvoiceNo" END) AS first_invoice,
       max(CASE WHEN rf = 1 THEN "StockCode" END) AS first_code,
       max(CASE WHEN rl = 1 THEN "InvoiceNo" END) AS last_invoice,
       max(CASE WHEN rl = 1 THEN "StockCode" END) AS last_code
FROM ordered GROUP BY file_name""")(_multi_file)

register("scan_star", "WITH " + STAR_CTES + """
SELECT 'countries' AS table_name, count(*) AS n_rows FROM countries
UNION ALL SELECT 'products', count(*) FROM products
UNION ALL SELECT 'invoices', count(*) FROM invoices
UNION ALL SELECT 'invoice_lines', count(*) FROM lines""")(
    lambda spark, sf: _etl.table_counts(_star(spark, sf)))

register("list_countries", "WITH " + STAR_CTES + "SELECT country FROM countries")(
    lambda spark, sf: _lookup.list_countries(_star(spark, sf)))
register("list_products", "WITH " + STAR_CTES + "SELECT product_code FROM products")(
    lambda spark, sf: _lookup.list_products(_star(spark, sf)))


# --------------------------------------------------------------------------- lookups and dashboards P1-P6

P_NAME = "large gizmo"

register("lookup_name_by_code", "WITH " + STAR_CTES +
         f"SELECT product_code, product_name FROM products WHERE product_code = '{P_PRODUCT}'")(
    lambda spark, sf: _lookup.name_by_code(_star(spark, sf), P_PRODUCT))
register("lookup_code_by_name", "WITH " + STAR_CTES + f"""
SELECT product_code, product_name, count(*) OVER () AS n_matches FROM products
WHERE product_name = '{P_NAME}'""")(
    lambda spark, sf: _lookup.code_by_name(_star(spark, sf), P_NAME))
register("ranked_product_options", _PRODUCT_RANK_SQL.replace(
    "SELECT products.product_code, product_name, COUNT(*) AS sales",
    "SELECT products.product_code, product_name").replace("ORDER BY sales", "ORDER BY COUNT(*)").format(
    dir="DESC", limit="LIMIT 10"))(
    lambda spark, sf: _lookup.ranked_product_options(_star(spark, sf)))

_DASH_C = "WITH " + STAR_CTES + f"""
(SELECT 'ranking' AS panel, country AS label, COUNT(*) AS sales
 FROM invoices JOIN lines ON invoices.invoice_no = lines.invoice_no
 GROUP BY country ORDER BY sales DESC, country LIMIT 10)
UNION ALL
(SELECT 'drilldown', product_name, COUNT(*) AS sales
 FROM products JOIN lines ON products.product_code = lines.product_code
 JOIN invoices ON lines.invoice_no = invoices.invoice_no
 WHERE country = '{P_COUNTRY}' GROUP BY product_name ORDER BY sales DESC, product_name LIMIT 5)"""
register("dashboard_country", _DASH_C)(
    lambda spark, sf: dashboard.dashboard_country(_star(spark, sf), DashboardParams(country=P_COUNTRY)))

_DASH_P = "WITH " + STAR_CTES + f"""
(SELECT 'ranking' AS panel, products.product_code AS label, COUNT(*) AS sales
 FROM products JOIN lines ON products.product_code = lines.product_code
 GROUP BY products.product_code ORDER BY sales DESC, label LIMIT 10)
UNION ALL
(SELECT 'drilldown', country, COUNT(*) AS sales
 FROM invoices JOIN lines ON invoices.invoice_no = lines.invoice_no
 JOIN products ON lines.product_code = products.product_code
 WHERE products.product_code = '{P_PRODUCT}' GROUP BY country ORDER BY sales DESC, country LIMIT 5)"""
register("dashboard_product", _DASH_P)(
    lambda spark, sf: dashboard.dashboard_product(_star(spark, sf), DashboardParams(product_code=P_PRODUCT)))


# --------------------------------------------------------------------------- paged fetch S10, quarantine Q5/L10

P_PAGE = 300


def _second_page(spark, sf):
    counted = rank.product_counts(_star(spark, sf))
    first = paging.page(counted, P_PAGE, ["product_code"])
    return paging.page(counted, P_PAGE, ["product_code"], after=paging.cursor_of(first, ["product_code"]))


register("page_products", _PRODUCT_RANK_SQL.format(dir="DESC", limit=f"LIMIT {P_PAGE} OFFSET {P_PAGE}"))(_second_page)

# Limits narrow enough for the feed to break each of them.
P_LIMITS = quarantine.Limits(country=8, product_code=5, product_name=11, invoice_no=(0, 10_000))

_QUARANTINE_CTES = _FS.rstrip() + f""",
judged AS (
  SELECT * FROM (
    SELECT *, list_filter([
      CASE WHEN length(country) > {P_LIMITS.country} THEN 'country_too_long' END,
      CASE WHEN invoice_no <> floor(invoice_no) THEN 'invoice_no_fractional' END,
      CASE WHEN invoice_no = floor(invoice_no)
        AND invoice_no NOT BETWEEN {P_LIMITS.invoice_no[0]} AND {P_LIMITS.invoice_no[1]} THEN 'invoice_no_out_of_range' END,
      CASE WHEN length(product_code) > {P_LIMITS.product_code} THEN 'product_code_too_long' END,
      CASE WHEN length(replace(replace(regexp_replace(product_name, '\\s+$', ''), '"', ''), '/', '')) > {P_LIMITS.product_name}
        THEN 'product_name_too_long' END], lambda x: x IS NOT NULL) AS reasons
    FROM clean_drop_mailout))
"""
register("quarantine_report", _QUARANTINE_CTES + """
SELECT file_name, reason, count(*) AS n_rows FROM (
  SELECT file_name, unnest(CASE WHEN len(reasons) = 0 THEN ['none'] ELSE reasons END) AS reason FROM judged)
GROUP BY file_name, reason""")(
    lambda spark, sf: quarantine.reject_report(_clean_rows(spark, sf), P_LIMITS))


def _rejects(spark, sf):
    path = scratch_path(spark, f"quarantine-{uuid.uuid4().hex}")
    _, rejects = quarantine.quarantine(_clean_rows(spark, sf), path, P_LIMITS)
    return rejects.select("file_name", "invoice_no", "product_code", "product_name", "country", _F.concat_ws(",", "reasons").alias("reasons"))


register("load_quarantine", _QUARANTINE_CTES + """
SELECT file_name, CAST(invoice_no AS DOUBLE) AS invoice_no, product_code, product_name, country, array_to_string(reasons, ',') AS reasons
FROM judged WHERE len(reasons) > 0""")(
    _rejects)
