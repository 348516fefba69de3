
import datetime as dt

import pytest
from pyspark.sql import functions as F

from salescope.functions import (
    code_length_rejected,
    normalise_product_name,
    null_tokens_to_null,
    parse_invoice_timestamp,
    to_number,
)


def _apply(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return [r[0] for r in df.select(fn(F.col("s"))).collect()]


def test_to_number(spark):
    vals = ["536365", " 5 ", "1e3", "12.5", ".5", "-3", "C1", "A563185", "0x10", "1_000", "5d", "5f", "NaN",
            "inf", "12abc", "", None]
    got = dict(zip(vals, _apply(spark, vals, to_number)))
    assert got["536365"] == 536365.0 and got[" 5 "] == 5.0 and got["1e3"] == 1000.0
    assert got["12.5"] == 12.5 and got[".5"] == 0.5 and got["-3"] == -3.0
    for bad in ("C1", "A563185", "0x10", "1_000", "5d", "5f", "NaN", "inf", "12abc", "", None):
        assert got[bad] is None, bad


def test_parse_invoice_timestamp(spark):
    ok = {"12/1/2010 8:26": dt.datetime(2010, 12, 1, 8, 26), "1/2/2011 8:5": dt.datetime(2011, 1, 2, 8, 5),
          "12/01/2010 08:26": dt.datetime(2010, 12, 1, 8, 26)}
    bad = ["13/1/2010 8:26", "2010-12-01 08:26", "12/1/2010 8:26:00", "12/1/10 8:26", "2/30/2011 1:00",
           " 12/1/2010 8:26", "12/1/2010 24:00", "1/1/1500 0:00", None,
           "garbage", "1/2", "12/1/2010", "x y", "//:", ""]
    got = dict(zip(list(ok) + bad, _apply(spark, list(ok) + bad, parse_invoice_timestamp)))
    for k, v in ok.items():
        assert got[k] == v, k
    for k in bad:
        assert got[k] is None, k


@pytest.mark.parametrize("token", ["", "NA", "n/a", "null", "#N/A", "<NA>", "N/A", "NULL", "NaN", "nan",
                                   "-NaN", "1.#QNAN"])
def test_null_tokens(spark, token):
    assert _apply(spark, [token], null_tokens_to_null) == [None]


def test_text_that_stays(spark):
    assert _apply(spark, ["None", "na", "Null ", "x"], null_tokens_to_null) == ["None", "na", "Null ", "x"]


def test_code_lengths(spark):
    vals = ["M", "C2", "ABCDE", "DCGS0003", "DOT", "POST", "AMAZONFEE", None]
    got = _apply(spark, vals, code_length_rejected)
    assert got == [False, False, False, False, True, True, True, None]


def test_name_normalisation(spark):
    vals = ['e "', "NAME\xa0", "NAME\x85", "NAME\x1c", "NAME \t", '1/2" BOLT', "A/B", " LEAD"]
    assert _apply(spark, vals, normalise_product_name) == ["e ", "NAME", "NAME", "NAME", "NAME", "12 BOLT",
                                                           "AB", " LEAD"]


def test_dates_do_not_depend_on_session_time_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = _apply(spark, ["3/13/2011 2:30", "11/6/2011 1:30"], parse_invoice_timestamp)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [dt.datetime(2011, 3, 13, 2, 30), dt.datetime(2011, 11, 6, 1, 30)]
