"""SQL texts (DuckDB dialect) that recompute the registered queries from the
driver's tables: the star adapter, the raw feed adapter and the cleaning
steps as a chain of CTEs. Used only as the correctness oracle."""

from __future__ import annotations

STAR_CTES = """
countries AS (SELECT DISTINCT n_name AS country FROM nation),
products AS (SELECT CAST(p_partkey AS VARCHAR) AS product_code, p_name AS product_name FROM part),
invoices AS (
  SELECT o_orderkey AS invoice_no, CAST(o_orderdate AS DATE) AS invoice_date, n_name AS country
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
lines AS (SELECT DISTINCT l_orderkey AS invoice_no, CAST(l_partkey AS VARCHAR) AS product_code FROM lineitem)
"""

RAW_CTE = r"""
raw AS (
  SELECT 'feed_' || CAST(n_regionkey AS VARCHAR) || '.csv' AS file_name,
    l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_quantity AS k4,
    CASE WHEN l_orderkey % 11 = 0 THEN 'C' || CAST(l_orderkey AS VARCHAR)
         WHEN l_orderkey % 997 = 0 THEN 'A' || CAST(l_orderkey AS VARCHAR)
         ELSE CAST(l_orderkey AS VARCHAR) END AS "InvoiceNo",
    CASE l_partkey % 50 WHEN 0 THEN 'm' WHEN 1 THEN 'post' WHEN 2 THEN 'bank charges'
         WHEN 3 THEN NULL WHEN 4 THEN 'dcgs0003'
         ELSE printf('%05d', l_partkey) || CASE l_partkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'B' ELSE '' END
    END AS "StockCode",
    CASE WHEN l_partkey % 37 = 0 THEN NULL WHEN l_partkey % 41 = 0 THEN 'mailout'
         WHEN l_partkey % 7 = 0 THEN p_name || ' 1/2" ' ELSE p_name END AS "Description",
    CAST(CAST(CASE WHEN l_linenumber = 3 AND l_quantity > 40 THEN -l_quantity
                   WHEN l_quantity = 1 THEN 0.0 ELSE l_quantity END AS BIGINT) AS VARCHAR) AS "Quantity",
    CASE WHEN l_orderkey % 101 = 0 THEN '2010-12-01 08:26'
         WHEN l_orderkey % 103 = 0 THEN '13/31/2010 8:26'
         ELSE CAST(month(o_orderdate) AS VARCHAR) || '/' || CAST(day(o_orderdate) AS VARCHAR) || '/'
              || CAST(year(o_orderdate) AS VARCHAR) || ' 8:26' END AS "InvoiceDate",
    CAST(CAST(round(l_extendedprice * 100) AS BIGINT) // 100 AS VARCHAR) || '.'
      || lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS "UnitPrice",
    CAST(o_custkey AS VARCHAR) AS "CustomerID",
    CASE WHEN n_name = 'NATION_4' THEN 'Unspecified' ELSE n_name END AS "Country"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)
"""

NUM_RE = r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*"
DATA_COLS = ("invoice_no", "product_code", "product_name", "quantity", "invoice_date", "country")


def _null_out(cond: str) -> str:
    cols = ", ".join(f"CASE WHEN coalesce({cond}, false) THEN NULL ELSE {c} END AS {c}" for c in DATA_COLS)
    return cols


CLEAN_CTES = RAW_CTE + f""",
clean_project AS (
  SELECT file_name, k1, k2, k3, k4, "InvoiceNo" AS invoice_no, "StockCode" AS product_code,
         "Description" AS product_name, "Quantity" AS quantity, "InvoiceDate" AS invoice_date,
         "Country" AS country FROM raw),
clean_upper_code AS (SELECT * REPLACE (upper(product_code) AS product_code) FROM clean_project),
clean_dedupe_first AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY file_name, invoice_no, product_code
                                 ORDER BY k1, k2, k3, k4) AS rn
    FROM clean_upper_code) WHERE rn = 1),
clean_coerce_invoice AS (
  SELECT * REPLACE (CASE WHEN regexp_full_match(invoice_no, '{NUM_RE}')
                         THEN TRY_CAST(trim(invoice_no) AS DOUBLE) END AS invoice_no)
  FROM clean_dedupe_first),
clean_drop_credits AS (SELECT * FROM clean_coerce_invoice WHERE invoice_no IS NOT NULL),
clean_parse_date AS (
  SELECT * REPLACE (CASE WHEN try_strptime(invoice_date, '%m/%d/%Y %H:%M')
                              BETWEEN TIMESTAMP '1677-09-21 00:13:00' AND TIMESTAMP '2262-04-11 23:47:00'
                         THEN try_strptime(invoice_date, '%m/%d/%Y %H:%M') END AS invoice_date)
  FROM clean_drop_credits),
clean_drop_bad_dates AS (SELECT * FROM clean_parse_date WHERE invoice_date IS NOT NULL),
clean_code_len_mid AS (
  SELECT file_name, k1, k2, k3, k4, {_null_out("length(product_code) BETWEEN 3 AND 4")}
  FROM clean_drop_bad_dates),
clean_code_len_long AS (
  SELECT file_name, k1, k2, k3, k4, {_null_out("length(product_code) > 8")}
  FROM clean_code_len_mid),
clean_drop_any_null AS (
  SELECT * FROM clean_code_len_long
  WHERE {" AND ".join(f"{c} IS NOT NULL" for c in DATA_COLS)}),
clean_positive_qty AS (
  SELECT * EXCLUDE (quantity) FROM clean_drop_any_null
  WHERE CASE WHEN regexp_full_match(quantity, '{NUM_RE}') THEN TRY_CAST(trim(quantity) AS DOUBLE) END > 0),
clean_drop_unspecified AS (SELECT * FROM clean_positive_qty WHERE country <> 'Unspecified'),
clean_drop_mailout AS (SELECT * FROM clean_drop_unspecified WHERE product_name <> 'mailout')
"""

CLEAN_STEP_KEYS = ("clean_project", "clean_upper_code", "clean_dedupe_first", "clean_coerce_invoice",
                   "clean_drop_credits", "clean_parse_date", "clean_drop_bad_dates", "clean_code_len_mid",
                   "clean_code_len_long", "clean_drop_any_null", "clean_positive_qty",
                   "clean_drop_unspecified", "clean_drop_mailout")


def clean_step_sql(step: str) -> str:
    return "WITH " + CLEAN_CTES + f"SELECT * EXCLUDE (k1, k2, k3, k4) FROM {step}"


_COUNT_STEPS = (("n_original", "clean_upper_code"), ("n_dedupe", "clean_dedupe_first"),
                ("n_credits", "clean_drop_credits"), ("n_dates", "clean_drop_bad_dates"),
                ("n_codes", "clean_drop_any_null"), ("n_quantity", "clean_positive_qty"),
                ("n_country", "clean_drop_mailout"), ("n_total", "clean_drop_mailout"))

FEEDBACK_CTES = CLEAN_CTES + ",\n" + ",\n".join(
    f"{name}_c AS (SELECT file_name, count(*) AS n FROM {step} GROUP BY file_name)" for name, step in _COUNT_STEPS
) + """,
feedback AS (
  SELECT f.file_name, """ + ", ".join(f"coalesce({n}_c.n, 0) AS {n}" for n, _ in _COUNT_STEPS) + """
  FROM (SELECT DISTINCT file_name FROM raw) f """ + " ".join(
    f"LEFT JOIN {n}_c ON {n}_c.file_name = f.file_name" for n, _ in _COUNT_STEPS) + """),
feedback_pct AS (
  SELECT *, n_original - n_total AS n_removed,
         round_even(CAST(n_original - n_total AS DOUBLE) / CAST(n_original AS DOUBLE) * 100.0, 2) AS pct_removed
  FROM feedback)
"""

FEED_STAR_CTES = CLEAN_CTES + r""",
feed_countries AS (SELECT DISTINCT country FROM clean_drop_mailout),
feed_invoices AS (
  SELECT CAST(invoice_no AS BIGINT) AS invoice_no, CAST(invoice_date AS DATE) AS invoice_date, country FROM (
    SELECT *, row_number() OVER (PARTITION BY invoice_no ORDER BY file_name, k1, k2, k3, k4) AS rn
    FROM clean_drop_mailout WHERE invoice_no = floor(invoice_no)) WHERE rn = 1),
feed_invoices_per_file AS (
  SELECT file_name, CAST(invoice_no AS BIGINT) AS invoice_no FROM clean_drop_mailout
  WHERE invoice_no = floor(invoice_no) GROUP BY file_name, invoice_no),
feed_first_names AS (
  SELECT product_code, product_name AS raw_name FROM (
    SELECT product_code, product_name,
           row_number() OVER (PARTITION BY product_code ORDER BY file_name DESC, k1, k2, k3, k4) AS rn
    FROM clean_drop_mailout) WHERE rn = 1),
feed_names AS (
  SELECT product_code, raw_name,
         regexp_replace(raw_name, '\s+$', '') AS name_rtrim,
         replace(regexp_replace(raw_name, '\s+$', ''), '"', '') AS name_quotes,
         replace(replace(regexp_replace(raw_name, '\s+$', ''), '"', ''), '/', '') AS name_all
  FROM feed_first_names),
feed_products AS (SELECT product_code, name_all AS product_name FROM feed_names),
feed_lines AS (
  SELECT DISTINCT CAST(invoice_no AS BIGINT) AS invoice_no, product_code FROM clean_drop_mailout
  WHERE invoice_no = floor(invoice_no)),
feed_lines_per_file AS (
  SELECT DISTINCT file_name, CAST(invoice_no AS BIGINT) AS invoice_no, product_code FROM clean_drop_mailout
  WHERE invoice_no = floor(invoice_no)),
""" + STAR_CTES + """,
loaded_products AS (
  SELECT product_code, product_name FROM products
  WHERE product_code NOT IN (SELECT product_code FROM feed_products)
  UNION ALL SELECT product_code, product_name FROM feed_products),
loaded_invoices AS (
  SELECT * FROM invoices UNION ALL
  SELECT * FROM feed_invoices WHERE invoice_no NOT IN (SELECT invoice_no FROM invoices)
    AND invoice_no BETWEEN -2147483648 AND 2147483647),
loaded_lines AS (
  SELECT invoice_no, product_code FROM lines UNION ALL
  SELECT f.invoice_no, f.product_code FROM feed_lines f
  WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.invoice_no = f.invoice_no AND l.product_code = f.product_code)
    AND f.invoice_no IN (SELECT invoice_no FROM loaded_invoices)
    AND f.product_code IN (SELECT product_code FROM loaded_products))
"""

# Strict load: files in name order, each step accepting or rejecting one file's
# invoice batch and line batch against everything accepted before it. The
# accepted keys travel through the recursion as lists.
STRICT_VERDICT_SQL = "WITH RECURSIVE " + FEED_STAR_CTES + """,
sf AS (SELECT file_name, row_number() OVER (ORDER BY file_name) AS i
       FROM (SELECT DISTINCT file_name FROM clean_drop_mailout)),
fi AS (SELECT sf.i, list(p.invoice_no) AS invs, count(*) AS n_inv,
              bool_and(p.invoice_no BETWEEN -2147483648 AND 2147483647) AS in_range
       FROM feed_invoices_per_file p JOIN sf ON p.file_name = sf.file_name GROUP BY sf.i),
fl AS (SELECT sf.i, list(DISTINCT l.invoice_no) AS line_invs, list(DISTINCT l.product_code) AS codes,
              list(DISTINCT l.pair) AS pairs, count(DISTINCT l.pair) AS n_lines,
              count(*) = count(DISTINCT l.pair) AS no_dup
       FROM (SELECT file_name, CAST(invoice_no AS BIGINT) AS invoice_no, product_code,
                    CAST(CAST(invoice_no AS BIGINT) AS VARCHAR) || '|' || product_code AS pair
             FROM clean_drop_mailout WHERE invoice_no = floor(invoice_no)) l
       JOIN sf ON l.file_name = sf.file_name GROUP BY sf.i),
steps(i, acc_inv, acc_pairs, inv_ok, lines_ok) AS (
  SELECT 0, (SELECT list(invoice_no) FROM invoices),
         (SELECT list(CAST(invoice_no AS VARCHAR) || '|' || product_code) FROM lines),
         CAST(NULL AS BOOLEAN), CAST(NULL AS BOOLEAN)
  UNION ALL
  SELECT y.i, y.acc_inv2,
         CASE WHEN y.lines_ok THEN list_concat(y.acc_pairs, y.pairs) ELSE y.acc_pairs END,
         y.inv_ok, y.lines_ok
  FROM (
    SELECT x.*, x.no_dup AND (NOT list_has_any(x.acc_pairs, x.pairs)) AND list_has_all(x.acc_inv2, x.line_invs)
                AND list_has_all((SELECT list(product_code) FROM loaded_products), x.codes) AS lines_ok
    FROM (
      SELECT s.i + 1 AS i, s.acc_pairs,
             coalesce(fl.pairs, []) AS pairs, coalesce(fl.line_invs, []) AS line_invs,
             coalesce(fl.codes, []) AS codes, coalesce(fl.no_dup, true) AS no_dup,
             (NOT list_has_any(s.acc_inv, coalesce(fi.invs, []))) AND coalesce(fi.in_range, true) AS inv_ok,
             CASE WHEN (NOT list_has_any(s.acc_inv, coalesce(fi.invs, []))) AND coalesce(fi.in_range, true)
                  THEN list_concat(s.acc_inv, coalesce(fi.invs, [])) ELSE s.acc_inv END AS acc_inv2
      FROM steps s JOIN sf ON sf.i = s.i + 1
      LEFT JOIN fi ON fi.i = s.i + 1 LEFT JOIN fl ON fl.i = s.i + 1) x) y)
SELECT sf.file_name, coalesce(fi.n_inv, 0) AS invoices_offered, s.inv_ok AS invoices_accepted,
       coalesce(fl.n_lines, 0) AS lines_offered, s.lines_ok AS lines_accepted
FROM steps s JOIN sf ON sf.i = s.i LEFT JOIN fi ON fi.i = s.i LEFT JOIN fl ON fl.i = s.i
WHERE s.i > 0
"""

# The feed loaded as two batches that share a file (sources.testdata.raw_batches_from_testdata).
_BATCH = """
{b}_names AS (
  SELECT product_code, replace(replace(regexp_replace(product_name, '\\s+$', ''), '"', ''), '/', '') AS product_name FROM (
    SELECT *, row_number() OVER (PARTITION BY product_code ORDER BY file_name DESC, k1, k2, k3, k4) AS rn FROM {b}) WHERE rn = 1),
{b}_invoices AS (SELECT DISTINCT CAST(invoice_no AS BIGINT) AS invoice_no FROM {b} WHERE invoice_no = floor(invoice_no)
  AND invoice_no BETWEEN -2147483648 AND 2147483647),
{b}_lines AS (SELECT DISTINCT CAST(invoice_no AS BIGINT) AS invoice_no, product_code FROM {b} WHERE invoice_no = floor(invoice_no)
  AND invoice_no BETWEEN -2147483648 AND 2147483647)"""
BATCH_CTES = "WITH " + CLEAN_CTES + """,
b1 AS (SELECT * FROM clean_drop_mailout WHERE file_name <= 'feed_2.csv'),
b2 AS (SELECT * REPLACE (CASE WHEN product_code LIKE '%A' THEN product_name || ' II' ELSE product_name END AS product_name)
       FROM clean_drop_mailout WHERE file_name >= 'feed_2.csv'),""" + _BATCH.format(b="b1") + "," + _BATCH.format(b="b2") + """,
added_lines AS (SELECT * FROM b2_lines EXCEPT SELECT * FROM b1_lines),
added_invoices AS (SELECT * FROM b2_invoices EXCEPT SELECT * FROM b1_invoices),
added_countries AS (SELECT country FROM b2 EXCEPT SELECT country FROM b1),
changed_names AS (SELECT n.* FROM b2_names n LEFT JOIN b1_names o USING (product_code)
                  WHERE o.product_code IS NULL OR n.product_name <> o.product_name),
loaded_names AS (SELECT * FROM changed_names UNION ALL
                 SELECT * FROM b1_names WHERE product_code NOT IN (SELECT product_code FROM changed_names))
"""
SURROGATE_SQL = BATCH_CTES + """
SELECT row_number() OVER (ORDER BY invoice_no, product_code) AS line_id, invoice_no, product_code FROM b1_lines
UNION ALL
SELECT (SELECT count(*) FROM b1_lines) + row_number() OVER (ORDER BY invoice_no, product_code), invoice_no, product_code FROM added_lines"""
STORE_STATE_SQL = BATCH_CTES + """
SELECT 'countries' AS table_name, (SELECT count(DISTINCT country) FROM b1) AS n_first, (SELECT count(*) FROM added_countries) AS n_second,
       (SELECT count(DISTINCT country) FROM b1) + (SELECT count(*) FROM added_countries) AS n_rows
UNION ALL SELECT 'products', (SELECT count(*) FROM b1_names), (SELECT count(*) FROM changed_names), (SELECT count(*) FROM loaded_names)
UNION ALL SELECT 'invoices', (SELECT count(*) FROM b1_invoices), (SELECT count(*) FROM added_invoices),
       (SELECT count(*) FROM b1_invoices) + (SELECT count(*) FROM added_invoices)
UNION ALL SELECT 'invoice_lines', (SELECT count(*) FROM b1_lines), (SELECT count(*) FROM added_lines),
       (SELECT count(*) FROM b1_lines) + (SELECT count(*) FROM added_lines)"""
ROLLUP_SQL = BATCH_CTES + """
, headers AS (SELECT CAST(invoice_no AS BIGINT) AS invoice_no, CAST(year(invoice_date) AS INTEGER) AS invoice_year, country FROM (
    SELECT *, row_number() OVER (PARTITION BY invoice_no ORDER BY file_name, k1, k2, k3, k4) AS rn
    FROM clean_drop_mailout WHERE invoice_no = floor(invoice_no)) WHERE rn = 1)
SELECT invoice_year, country, product_code, CAST(GROUPING_ID(invoice_year, country, product_code) AS INTEGER) AS level, count(*) AS sales
FROM (SELECT * FROM b1_lines UNION ALL SELECT * FROM added_lines) JOIN headers USING (invoice_no)
GROUP BY CUBE (invoice_year, country, product_code)"""
