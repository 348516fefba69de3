"""Product code rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of length 3 to 4 (postage, fees) and longer than 8
# (free-text codes such as bank charges) are not products.
MID_LEN_MIN = 3
MID_LEN_MAX = 4
LONG_LEN_OVER = 8


def code_length_mid(c: Column) -> Column:
    return F.length(c).between(MID_LEN_MIN, MID_LEN_MAX)


def code_length_long(c: Column) -> Column:
    return F.length(c) > LONG_LEN_OVER


def code_length_rejected(c: Column) -> Column:
    """True for codes the cleaning removes; NULL for a NULL code (removed too)."""
    return code_length_mid(c) | code_length_long(c)
