"""Paged fetch against the whole ranking; quarantine against the rules row by row."""

import random

import pytest
from pyspark.sql import functions as F

from salescope.operators import paging, quarantine, star
from salescope.operators.quality import check_lengths
from salescope.star_schema import Star
from test_plans import formatted


@pytest.mark.parametrize("mode", ["top", "flop"])
def test_pages_joined_are_the_whole_ranking(spark, mode):
    r = random.Random(1)
    rows = [(f"p{i:03d}" if i % 40 else None, f"é{i}", r.randrange(4)) for i in range(41)]  # many ties, a null label twice
    counted = spark.createDataFrame(rows, "product_code string, product_name string, sales long").repartition(3)
    labels = ["product_code", "product_name"]
    whole = sorted(rows, key=lambda x: (x[2] if mode == "flop" else -x[2], x[0] is not None, x[0] or "", x[1]))
    got, cursor, fetched = [], None, 0
    while True:
        rows_of_page = paging.page(counted, 7, labels, mode, cursor)
        cursor = paging.cursor_of(rows_of_page, labels, mode)
        if cursor is None:
            break
        got += map(tuple, rows_of_page.collect())
        fetched += 1
    assert got == whole and fetched == 6
    assert "TakeOrderedAndProject" in formatted(paging.page(counted, 7, labels, mode, (2, "p003", "é3")))


def test_page_refuses_wrong_cursors_and_sizes(spark):
    counted = spark.createDataFrame([("a", 1)], "country string, sales long")
    with pytest.raises(ValueError):
        paging.page(counted, 0, ["country"])
    with pytest.raises(ValueError):
        paging.page(counted, 5, ["country"], after=(1,))
    assert paging.page(counted, 5, ["country"], after=(1, "a")).isEmpty()
    assert paging.cursor_of(counted.limit(0), ["country"]) is None


CLEAN = "file_name string, row_pos long, invoice_no double, product_code string, product_name string, invoice_date timestamp_ntz, country string"


def test_quarantine_parts_every_row_with_all_its_reasons(spark, tmp_path):
    def row(k, no=5.0, code="abcde", name="name", country="France"):
        return ("f.csv", k, no, code, name, None, country)

    rows = [
        row(0), row(1, country="C" * 30), row(2, country="C" * 31), row(3, code="x" * 20), row(4, code="x" * 21),
        row(5, name="n" * 50), row(6, name="n" * 51), row(7, name="n" * 50 + '"/ '), row(8, no=2.0**31), row(9, no=-(2.0**31)),
        row(10, no=1.5, code="x" * 30, country="é" * 40), row(11, country=None), row(0),
    ]
    clean = spark.createDataFrame(rows, CLEAN)
    kept, rejects = quarantine.quarantine(clean, str(tmp_path / "q"))
    assert kept.columns == clean.columns
    assert sorted(r.row_pos for r in kept.collect()) == [0, 0, 1, 3, 5, 7, 9, 11]
    assert {r.row_pos: r.reasons for r in rejects.collect()} == {
        2: ["country_too_long"], 4: ["product_code_too_long"], 6: ["product_name_too_long"], 8: ["invoice_no_out_of_range"],
        10: ["country_too_long", "invoice_no_fractional", "product_code_too_long"]}
    assert "PartitionFilters: [isnotnull(rejected" in formatted(rejects)
    report = {r.reason: r.n_rows for r in quarantine.reject_report(clean).collect()}
    assert report == {"none": 8, "country_too_long": 2, "product_code_too_long": 2, "product_name_too_long": 1,
                      "invoice_no_out_of_range": 1, "invoice_no_fractional": 1}
    loaded = Star(star.star_countries(kept), star.star_products(kept), star.star_invoices(kept), star.star_invoice_lines(kept))
    assert check_lengths(loaded).agg(F.sum("n_violations")).first()[0] == 0


def test_quarantine_is_one_pass_and_takes_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], CLEAN)
    kept, rejects = quarantine.quarantine(empty, str(tmp_path / "q"))
    assert kept.isEmpty() and rejects.isEmpty() and kept.columns == empty.columns
    assert "Exchange" not in formatted(quarantine.flagged(empty))
