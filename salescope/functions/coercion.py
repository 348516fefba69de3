"""Text-to-value coercions that behave like the pandas reader the source used.

All are built-in expressions (no Python UDF), so they stay inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default null markers of the pandas 1.5 CSV reader. The
# reader turns a field equal to one of these (exactly, case-sensitive) into a
# missing value. 'None' is not in the 1.5 list and stays text.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "n/a",
    "nan",
    "null",
)

# Fixed value: plain decimal or scientific notation, optional sign and blanks.
# It rejects what pandas' to_numeric rejects but Spark's cast accepts
# (type suffixes such as '5d', 'NaN', 'Infinity').
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# The invoice date format (month/day/year hour:minute, each part
# with or without a leading zero) and the range of a nanosecond timestamp,
# cut to whole minutes.
INVOICE_TS_FORMAT = "M/d/yyyy H:m"
INVOICE_TS_TEXT = r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}$"
TS_MIN = "1677-09-21 00:13:00"
TS_MAX = "2262-04-11 23:47:00"


def null_tokens_to_null(c: Column, tokens=NA_TOKENS) -> Column:
    return F.when(c.isin(list(tokens)), F.lit(None)).otherwise(c)


def to_number(c: Column) -> Column:
    """Text -> DOUBLE, invalid -> NULL (never raises under ANSI mode)."""
    return F.when(c.rlike(NUMERIC_TEXT), F.trim(c).try_cast("double"))


def parse_invoice_timestamp(c: Column) -> Column:
    """Text -> TIMESTAMP_NTZ with format ``M/d/yyyy H:m``; invalid or out of range -> NULL.

    The text must match the format exactly (month, day, hour and minute with one
    or two digits, a four-digit year); the parts are then assembled with
    ``try_make_timestamp_ntz``, which gives NULL for impossible values (month 13,
    30 February, hour 24). No time zone takes part, so the result does not
    depend on the session time zone.
    """
    parts = F.split(c, "[/ :]")
    part = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    ts = F.try_make_timestamp_ntz(part(2), part(0), part(1), part(3), part(4), F.lit(0))
    in_range = ts.between(F.lit(TS_MIN).cast("timestamp_ntz"), F.lit(TS_MAX).cast("timestamp_ntz"))
    return F.when(c.rlike(INVOICE_TS_TEXT) & in_range, ts)
