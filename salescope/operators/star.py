"""Deriving the star rows from clean invoice rows.

Input: clean rows with file_name, row_pos, invoice_no (DOUBLE),
product_code, product_name, invoice_date (TIMESTAMP_NTZ), country.

"First" always means first in (file name, row position) order: files are
taken in ascending name order, rows top to bottom. All picks are grouped
``min``/``max`` over structs, which aggregate map-side before the shuffle, so
a key holding a large share of the rows (a hot product code) costs one
partial row per map task, not one reducer holding all its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.functions.names import normalise_product_name
from salescope.session import kept
from salescope.star_schema import INVOICE_NO_MAX, INVOICE_NO_MIN


def whole_invoice_no(c: Column) -> Column:
    """DOUBLE -> BIGINT when the number is whole (and finite); NULL otherwise.

    A fractional invoice number is rejected rather than rounded."""
    return F.when(c == F.floor(c), c.try_cast("bigint"))


def _invoice_no(rows: DataFrame) -> Column:
    """The whole invoice number of ``rows``, as it is if it is one by type (its partitioning then stays known)."""
    return F.col("invoice_no") if rows.schema["invoice_no"].dataType.typeName() == "long" else whole_invoice_no(F.col("invoice_no"))


def star_countries(clean_rows: DataFrame) -> DataFrame:
    """L1: distinct countries."""
    return clean_rows.select("country").distinct()


def star_invoices(clean_rows: DataFrame, per_file: bool = False) -> DataFrame:
    """L2 (+L2b, L2c): one header per invoice number from its first row.

    ``per_file=True`` keeps one header per (file, invoice) -- what each file
    offers to the load; the default keeps the first over all files.
    """
    rows = clean_rows.select(
        "file_name", "row_pos",
        _invoice_no(clean_rows).alias("invoice_no"),
        F.to_date("invoice_date").alias("invoice_date"), "country",
    ).filter(F.col("invoice_no").isNotNull())
    keys = ["file_name", "invoice_no"] if per_file else ["invoice_no"]
    order = ["row_pos"] if per_file else ["file_name", "row_pos"]
    first = F.min(F.struct(*order, "invoice_date", "country")).alias("_f")
    return rows.groupBy(*keys).agg(first).select(*keys, "_f.invoice_date", "_f.country")


def first_name_per_file(clean_rows: DataFrame) -> DataFrame:
    """(product_code, file_name, product_name): the first raw name of each code in each file."""
    return (clean_rows.groupBy("product_code", "file_name")
            .agg(F.min(F.struct("row_pos", "product_name")).alias("_f"))
            .select("product_code", "file_name", F.col("_f.product_name").alias("product_name")))


def star_products(clean_rows: DataFrame, normalise: bool = True) -> DataFrame:
    """L8 (+L8a-c): per code, the first name in the *last* file that has the code
    (a later file overwrites the name), normalised."""
    return _last_names(first_name_per_file(clean_rows), normalise)


#: Most pairs of code and file with several names that are sent to every task.
SEVERAL_NAMES = 1_000_000


def star_products_by_name(clean_rows: DataFrame) -> DataFrame:
    """``star_products`` of stored rows: a code with one name in a file needs no row positions, which are most of what would be shuffled.

    Only the pairs of code and file with several names (or none) are picked from by position. The pairs stay below the shared folder."""
    pairs = kept(clean_rows.groupBy("product_code", "file_name").agg(
        F.min("product_name").alias("product_name"), (F.min("product_name").eqNullSafe(F.max("product_name")) & (F.count("product_name") == F.count(F.lit(1)))).alias("_one")))
    several = pairs.filter("NOT _one").select(F.col("product_code").alias("_code"), F.col("file_name").alias("_file"))
    n = several.count()
    if not n:
        return _last_names(pairs)
    if n > SEVERAL_NAMES:
        return star_products(clean_rows)
    same = F.col("product_code").eqNullSafe(F.col("_code")) & F.col("file_name").eqNullSafe(F.col("_file"))
    picked = first_name_per_file(clean_rows.join(F.broadcast(several), same, "left_semi"))
    return _last_names(pairs.filter("_one").select(*picked.columns).unionByName(picked))


def _last_names(per_file: DataFrame, normalise: bool = True) -> DataFrame:
    last = (per_file.groupBy("product_code")
            .agg(F.max(F.struct("file_name", "product_name")).alias("_l"))
            .select("product_code", F.col("_l.product_name").alias("product_name")))
    if normalise:
        last = last.withColumn("product_name", normalise_product_name(F.col("product_name")))
    return last


def star_invoice_lines(clean_rows: DataFrame, per_file: bool = False) -> DataFrame:
    """(invoice_no, product_code) facts; ``per_file`` keeps the file column."""
    cols = ["file_name"] if per_file else []
    return (clean_rows.select(*cols, _invoice_no(clean_rows).alias("invoice_no"), "product_code")
            .filter(F.col("invoice_no").isNotNull())
            .distinct())


def in_int32(c: Column) -> Column:
    return c.between(INVOICE_NO_MIN, INVOICE_NO_MAX)
