"""Adapters from the driver's TPC-H-like tables to the shapes salescope works on.

``star_from_testdata`` maps the tables onto the four-table star;
``raw_feed_from_testdata`` turns line items into raw invoice rows (as they
would come out of the CSV reader) spread over five "files", with the defects
the cleaning rules exist for. Both are lazy DataFrame plans over the parquet
files, so Catalyst prunes columns and pushes filters into the scans.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.session import scratch_path
from salescope.sources.csv_files import read_invoice_csv, write_invoice_csv
from salescope.star_schema import Star

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


_SCHEMAS: dict[tuple, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table. The schema inferred from a local file's footer is remembered
    per (path, mtime, size), so later reads skip the small inference job."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    try:
        st = os.stat(path)
        key = (path, st.st_mtime_ns, st.st_size)
    except OSError:
        return spark.read.parquet(path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


# Rows of the line items that one task takes from a shuffle: the adapters deal them out by a count of the rows, because
# partitions that are sized by their compressed bytes grow with the table, and so does what a task sorts or hashes.
LINES_PER_TASK = 250_000


def line_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Into how many tasks the line items are dealt (the count reads file footers only).

    An odd number: with a divisor in common with a store's buckets, a task would hold rows of a few buckets only."""
    rows = table(spark, sf_dir, "lineitem").count()
    return max(spark.sparkContext.defaultParallelism, -(-rows // LINES_PER_TASK)) | 1


def invoices_from_testdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """invoice_no, invoice_date, country: orders -> customer -> nation.

    ``nation`` is a fixed 25-row dimension; the planner broadcasts it from its
    file size. orders-customer joins two large tables: it carries a sort-merge
    hint, because Spark's static size estimate of a join (the product of its
    inputs) would otherwise make the planner broadcast the orders and stream
    the small customer file -- one task for the whole join.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    cust_country = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        "c_custkey", F.col("n_name").alias("country"))
    return orders.join(cust_country.hint("merge"), orders.o_custkey == cust_country.c_custkey).select(
        F.col("o_orderkey").alias("invoice_no"),
        F.to_date("o_orderdate").alias("invoice_date"),
        "country",
    )


def lines_from_testdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (invoice_no, product_code) pairs of lineitem.

    The rows are dealt out on both columns, so even an invoice with a huge number of lines is spread over
    tasks by product (by invoice alone would save a later shuffle but send such an invoice's raw lines to a single task). Nearly all
    pairs differ, so they are not combined before the shuffle: a map task would hold all its pairs for nothing.
    """
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("invoice_no"),
        F.col("l_partkey").cast("string").alias("product_code"),
    )
    return li.repartition(line_tasks(spark, sf_dir), "invoice_no", "product_code").dropDuplicates(["invoice_no", "product_code"])


def star_from_testdata(spark: SparkSession, sf_dir: str) -> Star:
    nation = table(spark, sf_dir, "nation")
    part = table(spark, sf_dir, "part")
    countries = nation.select(F.col("n_name").alias("country")).distinct()
    products = part.select(
        F.col("p_partkey").cast("string").alias("product_code"),
        F.col("p_name").alias("product_name"),
    )
    return Star(
        countries=countries,
        products=products,
        invoices=invoices_from_testdata(spark, sf_dir),
        lines=lines_from_testdata(spark, sf_dir),
    )


# Fixed values of the synthetic raw feed (FIXTURES.md section 6): which keys
# receive which defect.
CREDIT_NOTE_EVERY = 11          # InvoiceNo 'C<key>'
ADJUSTMENT_EVERY = 997          # InvoiceNo 'A<key>'
ISO_DATE_EVERY = 101            # InvoiceDate '2010-12-01 08:26'
BAD_MONTH_EVERY = 103           # InvoiceDate '13/31/2010 8:26'
NULL_NAME_EVERY = 37
MAILOUT_EVERY = 41
QUOTED_NAME_EVERY = 7
SPECIAL_CODES = {0: "m", 1: "post", 2: "bank charges", 3: None, 4: "dcgs0003"}  # by p_partkey % 50
CODE_SUFFIX = {0: "a", 1: "B", 2: ""}                                           # by p_partkey % 3
UNSPECIFIED_NATION = "NATION_4"


def _stock_code(partkey):
    m50 = partkey % 50
    suffix = (F.when(partkey % 3 == 0, F.lit(CODE_SUFFIX[0]))
              .when(partkey % 3 == 1, F.lit(CODE_SUFFIX[1]))
              .otherwise(F.lit(CODE_SUFFIX[2])))
    return (F.when(m50 == 0, F.lit(SPECIAL_CODES[0]))
            .when(m50 == 1, F.lit(SPECIAL_CODES[1]))
            .when(m50 == 2, F.lit(SPECIAL_CODES[2]))
            .when(m50 == 3, F.lit(None).cast("string"))
            .when(m50 == 4, F.lit(SPECIAL_CODES[4]))
            .otherwise(F.concat(_pad5(partkey), suffix)))


def _pad5(n):
    """printf('%05d', n); padded with plain string functions, format_string runs a java.util.Formatter per row."""
    def padded(digits, width):
        return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))
    text = n.cast("string")
    return F.when(n >= 0, padded(text, 5)).otherwise(F.concat(F.lit("-"), padded(F.substr(text, F.lit(2)), 4)))


def raw_feed_from_testdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw invoice rows: file_name, row_pos, then the eight text columns of an invoice file.

    ``row_pos`` orders rows inside a file (the CSV reader provides the same
    column from the file offset). One file per region.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")

    # Names join the narrow line items first (the planner or AQE broadcasts the parts while they are few), orders get their
    # customer and nation, and the two meet dealt out by order key, so a task sorts a fixed number of rows. The joins of the
    # orders carry sort-merge hints: the static estimate of a join's size (product of its inputs) would otherwise
    # make the planner broadcast them.
    n = line_tasks(spark, sf_dir)
    cust = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    order_ctx = orders.join(cust.hint("merge"), orders.o_custkey == cust.c_custkey).select(
        "o_orderkey", "o_custkey", "o_orderdate", "n_name", "n_regionkey")
    named = li.join(part, li.l_partkey == part.p_partkey).drop("p_partkey")
    rows = named.repartition(n, "l_orderkey").join(
        order_ctx.repartition(n, "o_orderkey").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))

    key = F.col("l_orderkey")
    pk = F.col("l_partkey")
    qty = F.col("l_quantity")
    odate = F.col("o_orderdate")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")

    invoice_no = (F.when(key % CREDIT_NOTE_EVERY == 0, F.concat(F.lit("C"), key.cast("string")))
                  .when(key % ADJUSTMENT_EVERY == 0, F.concat(F.lit("A"), key.cast("string")))
                  .otherwise(key.cast("string")))
    description = (F.when(pk % NULL_NAME_EVERY == 0, F.lit(None).cast("string"))
                   .when(pk % MAILOUT_EVERY == 0, F.lit("mailout"))
                   .when(pk % QUOTED_NAME_EVERY == 0, F.concat(F.col("p_name"), F.lit(' 1/2" ')))
                   .otherwise(F.col("p_name")))
    quantity = (F.when((F.col("l_linenumber") == 3) & (qty > 40), -qty)
                .when(qty == 1, F.lit(0.0))
                .otherwise(qty)).cast("bigint").cast("string")
    invoice_date = (F.when(key % ISO_DATE_EVERY == 0, F.lit("2010-12-01 08:26"))
                    .when(key % BAD_MONTH_EVERY == 0, F.lit("13/31/2010 8:26"))
                    .otherwise(F.concat(F.month(odate).cast("string"), F.lit("/"),
                                        F.dayofmonth(odate).cast("string"), F.lit("/"),
                                        F.year(odate).cast("string"), F.lit(" 8:26"))))
    unit_price = F.concat((cents / 100).cast("bigint").cast("string"), F.lit("."),
                          F.lpad((cents % 100).cast("string"), 2, "0"))
    country = F.when(F.col("n_name") == UNSPECIFIED_NATION, F.lit("Unspecified")).otherwise(F.col("n_name"))

    return rows.select(
        F.concat(F.lit("feed_"), F.col("n_regionkey").cast("string"), F.lit(".csv")).alias("file_name"),
        F.struct(key.alias("k1"), F.col("l_linenumber").alias("k2"), pk.alias("k3"), qty.alias("k4")).alias("row_pos"),
        invoice_no.alias("InvoiceNo"),
        _stock_code(pk).alias("StockCode"),
        description.alias("Description"),
        quantity.alias("Quantity"),
        invoice_date.alias("InvoiceDate"),
        unit_price.alias("UnitPrice"),
        F.col("o_custkey").cast("string").alias("CustomerID"),
        country.alias("Country"),
    )


def raw_feed_via_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw feed written as ISO-8859-1 CSV files into the shared checkpoint
    folder, then read back with the CSV source (S1-S4 on real files).

    The writer lays each feed file out as ``file_name=<name>/part-*.csv`` with
    part files in row order; the feed file name and row position are rebuilt
    from the path: (part file, split start, row id).
    """
    import uuid

    path = scratch_path(spark, "feed_csv", uuid.uuid4().hex)
    write_invoice_csv(raw_feed_from_testdata(spark, sf_dir), path)
    df = read_invoice_csv(spark, [path], recursive=True)
    # plain text functions: a regular expression over the path would cost more than the rest of a row
    folder = F.substring_index(F.substring_index("file_name", "file_name=", -1), "/", 1)
    return df.select(
        folder.alias("file_name"),
        F.struct(F.col("file_name").alias("part"), F.col("row_pos.block_start").alias("block_start"),
                 F.col("row_pos.row_id").alias("row_id")).alias("row_pos"),
        *[c for c in df.columns if c not in ("file_name", "row_pos")],
    )


# Fixed values of the two batches that the feed is loaded in: files up to, and from, this one (it is in both).
SHARED_FILE = "feed_2.csv"
RENAMED_SUFFIX = " II"


def raw_batches_from_testdata(spark: SparkSession, sf_dir: str, raw: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The raw feed (``raw``, if it is there already) as two batches that share a file. In the second one, products with a code ending in 'a' have new names."""
    raw = raw_feed_from_testdata(spark, sf_dir) if raw is None else raw
    renamed = F.col("StockCode").endswith("a") & (F.col("Description") != "mailout")
    again = raw.filter(F.col("file_name") >= SHARED_FILE).withColumn(
        "Description", F.when(renamed, F.concat("Description", F.lit(RENAMED_SUFFIX))).otherwise(F.col("Description")))
    return raw.filter(F.col("file_name") <= SHARED_FILE), again
