"""The cleaning rules, in their original order.

Input is a raw invoice frame: ``file_name``, ``row_pos`` (orders rows inside
a file), the eight text columns of an invoice file and possibly extra
columns. Every step is a built-in expression or a single aggregation, so the
whole chain compiles into whole-stage code with one shuffle (the de-duplication).

Two forms are offered:
* step functions (``project`` ... ``drop_mailout``) that follow the source
  literally, step by step, for inspection and the per-step queries;
* ``stage_flags`` which evaluates all later rules at once as cumulative
  booleans on the de-duplicated rows, used for the feedback counts and the
  load (one pass instead of eight).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.functions.codes import code_length_long, code_length_mid, code_length_rejected
from salescope.functions.coercion import parse_invoice_timestamp, to_number
from salescope.session import drop_kept, kept

# Raw header names and the names they take here.
RAW_COLUMNS = ("InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice",
               "CustomerID", "Country")
RENAMES = {
    "InvoiceNo": "invoice_no",
    "StockCode": "product_code",
    "Description": "product_name",
    "Quantity": "quantity",
    "InvoiceDate": "invoice_date",
    "Country": "country",
}
DROPPED = ("CustomerID", "UnitPrice")
UNSPECIFIED_COUNTRY = "Unspecified"
MAILOUT_NAME = "mailout"

BOOKKEEPING = ("file_name", "row_pos", "dup_count", "absent")
DEDUPE_KEYS = ("file_name", "invoice_no", "product_code")


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in BOOKKEEPING]


def project(raw: DataFrame) -> DataFrame:
    """Rename five columns, drop CustomerID and UnitPrice (both must exist)."""
    missing = [c for c in RAW_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"raw invoice data lacks columns {missing}")
    return raw.withColumnsRenamed(RENAMES).drop(*DROPPED)


def upper_code(df: DataFrame) -> DataFrame:
    """Product codes are compared upper-cased."""
    return df.withColumn("product_code", F.upper("product_code"))


def dedupe_first(df: DataFrame) -> DataFrame:
    """One row per (file, raw invoice text, upper code): the first in file order.

    A grouped ``min`` over ``struct(row_pos, rest...)`` picks the first row's
    values. Unlike a window, this aggregates map-side before the shuffle, so a
    key holding a large share of the rows still reaches the reducer as one
    partial row per map task. Null keys group together, as in the source.
    ``dup_count`` records how many raw rows each survivor stands for.

    The struct buffer makes this a sort-based aggregate. The invoice text leads the
    grouping columns: the sorter compares the first eight bytes of the leading column
    before anything else, and the file name is shared by every row of a file.
    """
    rest = ["row_pos"] + [c for c in df.columns if c not in DEDUPE_KEYS and c != "row_pos"]
    first = F.min(F.struct(*[F.col(c) for c in rest])).alias("_first")
    grouped = df.groupBy("invoice_no", "product_code", "file_name").agg(first, F.count(F.lit(1)).alias("dup_count"))
    return grouped.select(*DEDUPE_KEYS, *[F.col(f"_first.{c}").alias(c) for c in rest], "dup_count")


def coerce_invoice(df: DataFrame) -> DataFrame:
    """C4: invoice number as a number; credit notes ('C...') and other text become NULL."""
    return df.withColumn("invoice_no", to_number(F.col("invoice_no")))


def drop_credits(df: DataFrame) -> DataFrame:
    """C5."""
    return df.filter(F.col("invoice_no").isNotNull())


def parse_date(df: DataFrame) -> DataFrame:
    """C6."""
    return df.withColumn("invoice_date", parse_invoice_timestamp(F.col("invoice_date")))


def drop_bad_dates(df: DataFrame) -> DataFrame:
    """C7."""
    return df.filter(F.col("invoice_date").isNotNull())


def _null_out(df: DataFrame, cond: Column) -> DataFrame:
    # The condition is computed once as a column; the optimizer keeps the two
    # projections apart rather than copying a non-trivial expression into
    # every output column.
    marked = df.withColumn("_hit", F.coalesce(cond, F.lit(False)))
    return marked.select(*[F.when(~F.col("_hit"), F.col(c)).alias(c) if c not in BOOKKEEPING else F.col(c)
                           for c in df.columns])


def null_code_len_mid(df: DataFrame) -> DataFrame:
    """Rows whose code has 3 or 4 characters lose all their values."""
    return _null_out(df, code_length_mid(F.col("product_code")))


def null_code_len_long(df: DataFrame) -> DataFrame:
    """Rows whose code has more than 8 characters lose all their values."""
    return _null_out(df, code_length_long(F.col("product_code")))


def _all_present(cols: list[str], df: DataFrame) -> Column:
    """No value is missing; an extra column that the row's file does not have (``absent``) is not one."""
    def present(c):
        own = c in RENAMES.values() or "absent" not in df.columns
        return F.col(c).isNotNull() if own else F.col(c).isNotNull() | F.array_contains("absent", c)
    return reduce(lambda a, b: a & b, [present(c) for c in cols], F.lit(True))


def drop_any_null(df: DataFrame) -> DataFrame:
    """Drop rows with a missing value in any data column."""
    return df.filter(_all_present(data_columns(df), df))


def positive_quantity(df: DataFrame) -> DataFrame:
    """C11: keep quantity > 0, then drop the column."""
    return df.filter(F.coalesce(to_number(F.col("quantity")) > 0, F.lit(False))).drop("quantity")


def drop_unspecified(df: DataFrame) -> DataFrame:
    """C12 (exact, case-sensitive)."""
    return df.filter(F.col("country") != F.lit(UNSPECIFIED_COUNTRY))


def drop_mailout(df: DataFrame) -> DataFrame:
    """C13 (exact, case-sensitive, before any trimming)."""
    return df.filter(F.col("product_name") != F.lit(MAILOUT_NAME))


STEPS = (
    ("clean_project", project),
    ("clean_upper_code", upper_code),
    ("clean_dedupe_first", dedupe_first),
    ("clean_coerce_invoice", coerce_invoice),
    ("clean_drop_credits", drop_credits),
    ("clean_parse_date", parse_date),
    ("clean_drop_bad_dates", drop_bad_dates),
    ("clean_code_len_mid", null_code_len_mid),
    ("clean_code_len_long", null_code_len_long),
    ("clean_drop_any_null", drop_any_null),
    ("clean_positive_qty", positive_quantity),
    ("clean_drop_unspecified", drop_unspecified),
    ("clean_drop_mailout", drop_mailout),
)


def run_steps(raw: DataFrame, upto: str | None = None) -> DataFrame:
    """Apply the steps in order, up to and including ``upto`` (all by default)."""
    df = raw
    for name, fn in STEPS:
        df = fn(df)
        if name == upto:
            break
    return df


# ----------------------------------------------------------------------------- one-pass form

FLAGS = ("k_credits", "k_dates", "k_codes", "k_quantity", "k_country")


def stage_flags(deduped: DataFrame) -> DataFrame:
    """Cumulative survival flags for the steps after de-duplication.

    ``k_credits`` is true when the row survives C5, ``k_dates`` C7,
    ``k_codes`` C10, ``k_quantity`` C11 and ``k_country`` C13. Coerced
    ``invoice_no`` (DOUBLE) and ``invoice_date`` (TIMESTAMP_NTZ) replace the text.

    This form keeps the raw texts through de-duplication (``upto_step`` shows
    them for the early steps); ``flagged`` is the production form. The
    coercions are evaluated once per row in a first projection; the flags are
    cheap boolean combinations of the resulting columns.
    """
    others = [c for c in data_columns(deduped) if c not in ("invoice_no", "invoice_date")]
    f = lambda e: F.coalesce(e, F.lit(False))
    base = deduped.withColumns({
        "_raw_date": F.col("invoice_date"),
        "invoice_no": to_number(F.col("invoice_no")),
        "invoice_date": parse_invoice_timestamp(F.col("invoice_date")),
        "_code_ok": f(~code_length_rejected(F.col("product_code"))) & _all_present(others, deduped),
        "_qty_ok": f(to_number(F.col("quantity")) > 0),
        "_place_ok": (f(F.col("country") != F.lit(UNSPECIFIED_COUNTRY))
                      & f(F.col("product_name") != F.lit(MAILOUT_NAME))),
    })
    inv_ok = F.col("invoice_no").isNotNull()
    date_ok = inv_ok & F.col("invoice_date").isNotNull()
    codes_ok = date_ok & F.col("_code_ok")
    qty_ok = codes_ok & F.col("_qty_ok")
    return base.withColumns({
        "k_credits": inv_ok,
        "k_dates": date_ok,
        "k_codes": codes_ok,
        "k_quantity": qty_ok,
        "k_country": qty_ok & F.col("_place_ok"),
    }).drop("_code_ok", "_qty_ok", "_place_ok")


def flagged(raw: DataFrame) -> DataFrame:
    """C1-C3 then the survival flags: one row per de-duplicated raw row.

    Coercions are per-row and deterministic, so they are evaluated map-side
    before the de-duplication shuffle, on every raw row, and the survivor
    keeps the values of its own (first) row -- the same result as coercing
    after de-duplication. The parsed timestamp (8 bytes) travels through the
    shuffle instead of the date text, quantity travels as a number plus a
    presence bit, and after the aggregate the flags are cheap boolean
    combinations of plain columns (nothing expensive for filter pushdown to
    copy).
    """
    return _with_flags(dedupe_first(_coerced(upper_code(project(raw)))))


def _coerced(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "_inv_num": to_number(F.col("invoice_no")),
        "invoice_date": parse_invoice_timestamp(F.col("invoice_date")),
        "_qty_num": to_number(F.col("quantity")),
        "quantity": F.col("quantity").isNotNull(),
    })


def _with_flags(d: DataFrame) -> DataFrame:
    extras = [c for c in data_columns(d) if c not in (*RENAMES.values(), "_inv_num", "_qty_num")]
    f = lambda e: F.coalesce(e, F.lit(False))
    present = _all_present(["product_code", "product_name", "country", *extras], d) & F.col("quantity")
    k_credits = F.col("_inv_num").isNotNull()
    k_dates = k_credits & F.col("invoice_date").isNotNull()
    k_codes = k_dates & f(~code_length_rejected(F.col("product_code"))) & present
    k_quantity = k_codes & f(F.col("_qty_num") > 0)
    k_country = (k_quantity & f(F.col("country") != F.lit(UNSPECIFIED_COUNTRY))
                 & f(F.col("product_name") != F.lit(MAILOUT_NAME)))
    return d.select(
        "file_name", "row_pos", F.col("_inv_num").alias("invoice_no"), "product_code", "product_name",
        F.col("_qty_num").alias("quantity"), "invoice_date", "country", *extras, "dup_count",
        k_credits.alias("k_credits"), k_dates.alias("k_dates"), k_codes.alias("k_codes"),
        k_quantity.alias("k_quantity"), k_country.alias("k_country"))


#: Most repeated keys (their 64-bit hashes) that go to every task; with more, all rows are grouped.
REPEATED_KEYS = 2_000_000


def kept_flags(raw: DataFrame, stored: bool = False) -> DataFrame:
    """The rows of ``flagged``, written once (``session.kept``) for several consumers.

    A row whose key occurs once meets no other row: counted hashes of the keys (a few bytes a row are shuffled) tell the
    keys that may be repeated, and only their rows are grouped. The raw rows are read again for that: unless they lie in
    a table already (``stored``) they are written first."""
    source = raw if stored else kept(raw)
    df = upper_code(project(source))
    key = F.xxhash64(*DEDUPE_KEYS)
    repeated = kept(df.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_key"))
    if repeated.count() > REPEATED_KEYS:
        out = kept(flagged(source))
    else:
        marked, marks = df.withColumn("_key", key), F.broadcast(repeated)
        once = _coerced(marked.join(marks, "_key", "left_anti").drop("_key")).withColumn("dup_count", F.lit(1).cast("bigint"))
        several = dedupe_first(_coerced(marked.join(marks, "_key", "left_semi").drop("_key")))
        out = kept(_with_flags(once.unionByName(several)))
    drop_kept(repeated, *([] if stored else [source]))
    return out


def clean(raw: DataFrame) -> DataFrame:
    """C14: clean rows (file_name, row_pos, invoice_no, product_code, product_name,
    invoice_date, country, extra columns)."""
    return flagged(raw).filter("k_country").drop(*FLAGS, "quantity", "dup_count")


def upto_step(raw: DataFrame, step: str) -> DataFrame:
    """The rows as they are after ``step``, computed from the one-pass flags.

    Same result as ``run_steps(raw, step)`` (the tests check this), but the
    coercions are evaluated once and every later step is a filter on a boolean
    column, instead of a chain of projections that the optimizer would inline
    into one large filter expression.
    """
    names = [n for n, _ in STEPS]
    if step not in names:
        raise ValueError(f"unknown step {step!r}")
    i = names.index(step)
    if i <= names.index("clean_dedupe_first"):
        return run_steps(raw, step)
    if i >= names.index("clean_positive_qty") and "absent" not in raw.columns:
        # no text of number or date is shown any more: they are parsed once, before the de-duplication
        kept = F.col("k_country" if step == "clean_drop_mailout" else "k_quantity")
        if step == "clean_drop_unspecified":
            kept = kept & (F.col("country") != F.lit(UNSPECIFIED_COUNTRY))
        rest = [c for c in project(raw).columns if c not in (*DEDUPE_KEYS, "row_pos", "quantity")]
        return flagged(raw).filter(kept).select(*DEDUPE_KEYS, "row_pos", *rest, "dup_count")
    deduped = dedupe_first(upper_code(project(raw)))
    flags = stage_flags(deduped)
    hidden = [*FLAGS]
    if step == "clean_coerce_invoice":
        return flags.withColumn("invoice_date", F.col("_raw_date")).drop(*hidden, "_raw_date")
    if step == "clean_drop_credits":
        return flags.filter("k_credits").withColumn("invoice_date", F.col("_raw_date")).drop(*hidden, "_raw_date")
    if step == "clean_parse_date":
        out = flags.filter("k_credits")
    elif step == "clean_drop_bad_dates":
        out = flags.filter("k_dates")
    elif step in ("clean_code_len_mid", "clean_code_len_long"):
        code = F.col("product_code")
        hit = code_length_mid(code) if step == "clean_code_len_mid" else code_length_rejected(code)
        out = _null_out(flags.filter("k_dates"), hit)
    elif step == "clean_drop_any_null":
        out = flags.filter("k_codes")
    elif step == "clean_positive_qty":
        out = flags.filter("k_quantity").drop("quantity")
    elif step == "clean_drop_unspecified":
        out = flags.filter(F.col("k_quantity") & (F.col("country") != F.lit(UNSPECIFIED_COUNTRY))).drop("quantity")
    else:  # clean_drop_mailout
        out = flags.filter("k_country").drop("quantity")
    return out.drop(*hidden, "_raw_date")
