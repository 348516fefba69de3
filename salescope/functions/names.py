"""Product name normalisation applied when products are loaded.

Order matters and is kept: right-trim first, then drop double quotes, then
drop slashes (so ``e "`` ends as ``e `` with a trailing blank).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: trailing characters Python's str.rstrip() removes. (?U)\s is the
# Unicode White_Space set (NBSP, U+0085, U+2000..U+200A, ...); Python also
# counts the separators U+001C..U+001F as blanks.
TRAILING_BLANKS = r"(?U)[\s\x{1c}-\x{1f}]+$"


def rtrim_unicode(c: Column) -> Column:
    return F.regexp_replace(c, TRAILING_BLANKS, "")


def remove_quotes_and_slashes(c: Column) -> Column:
    return F.translate(c, '"/', "")


def remove_quotes(c: Column) -> Column:
    return F.translate(c, '"', "")


def remove_slashes(c: Column) -> Column:
    return F.translate(c, "/", "")


def normalise_product_name(c: Column) -> Column:
    return remove_slashes(remove_quotes(rtrim_unicode(c)))
