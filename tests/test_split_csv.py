"""Large CSV files with newlines in quotes read by many tasks; headers from the first block of each file."""

import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF001  # noqa: F401  (path set-up)
from salescope.operators import clean, feedback, star
from salescope.sources import headers, quoted_csv, testdata
from salescope.sources.csv_files import file_label, list_files, read_invoice_csv
from test_edge_rows import BASE, HEADER, write_csv


def read_at(spark, split, paths, **options):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        return read_invoice_csv(spark, paths, **options).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def rows_in_order(rows):
    ordered = sorted(rows, key=lambda r: (r["file_name"], r["row_pos"]["block_start"], r["row_pos"]["row_id"]))
    return [tuple(v for k, v in r.asDict().items() if k != "row_pos") for r in ordered]


@pytest.mark.parametrize("line,outside,inside", [
    (b"a,b", False, True), (b'a,"b', True, False), (b'"a""', True, False), (b'"a"', False, False), (b'5" pipe,x', False, False),
    (b'a,"b"junk"x,c', False, False), (b'",', True, False), (b'""', False, True), (b"", False, True), (b'x""y,"', True, False), (b'"a","b\r', True, True)])
def test_state_at_the_end_of_a_line(line, outside, inside):
    assert quoted_csv.ends_inside(line, False) is outside and quoted_csv.ends_inside(line, True) is inside


@pytest.mark.parametrize("seed,ending,split", [(s, e, w) for s in range(3) for e, w in (("\n", "64"), ("\r\n", "300"), ("\n", "2k"))])
def test_any_split_gives_the_rows_of_multi_line_mode(spark, scratch, seed, ending, split):
    r = random.Random(seed)

    def field():
        kind = r.randrange(9)
        text = "".join(r.choice("abé 7") for _ in range(r.randrange(1, 12)))
        if kind < 4:
            return text
        if kind == 4:
            return f'{text}" pipe'  # a quote inside an unquoted field is text
        if kind == 5:
            return ""
        inner = text + r.choice(["", ",", '""', ending, ending + ending, f'{ending},"",{ending}', "x" * r.randrange(400)]) + text
        return f'"{inner}"'

    lines = [",".join(HEADER), ""] + [",".join(field() for _ in HEADER) for _ in range(150)] + ["", "short", ""]
    p = os.path.join(scratch, "odd né.csv")
    with open(p, "w", encoding="ISO-8859-1", newline="") as f:
        f.write(ending.join(lines) + r.choice(["", ending, f'{ending}1,"never closed{ending}x']))
    want = rows_in_order(read_invoice_csv(spark, [p], multi_line=True).collect())
    got = read_at(spark, split, [p])
    assert rows_in_order(got) == want and len(want) > 150
    assert len({x["row_pos"]["block_start"] for x in got}) > 3  # many splits took part


def test_one_big_file_is_read_by_many_tasks(spark, scratch):
    p = os.path.join(scratch, "big.csv")
    write_csv(p, HEADER, [dict(BASE, InvoiceNo=str(700000 + i), Description=f'TWO\nLINES "{i}"', CaseId=str(i)) for i in range(3000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        raw = read_invoice_csv(spark, [p])
        assert raw.select(F.spark_partition_id()).distinct().count() >= os.path.getsize(p) // 32768
        assert clean.clean(raw).count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_uniform_header_is_checked_for_cut_files_too(spark, scratch):
    a, b = (os.path.join(scratch, f) for f in ("a.csv", "b.csv"))
    write_csv(a, HEADER, [dict(BASE, Description="x\ny", CaseId=str(i)) for i in range(50)])
    write_csv(b, HEADER[::-1], [dict(BASE, Description="x\ny", CaseId=str(i)) for i in range(50)])
    with pytest.raises(ValueError, match="header"):
        read_at(spark, "1k", [a, b], uniform_header=True)


# ---------------------------------------------------------------- headers


def test_headers_come_from_the_first_block(spark, scratch):
    paths = [os.path.join(scratch, f) for f in ("long.csv", "blank +1%.csv", "cr.csv", "none.csv")]
    texts = [",".join(HEADER) + "\n" + "x" * 500_000, "\n \r\n" + "k" * 3000 + "\r\nmore", "a,b\r1,2\r", "\n\n"]
    for p, text in zip(paths, texts):
        with open(p, "w", newline="") as f:
            f.write(text)
    listing = headers.listing_of(spark, [scratch])
    found = {os.path.basename(r["path"]): r for r in headers.file_headers(listing, "ISO-8859-1", block=1024).collect()}
    assert found["long.csv"]["header"] == ",".join(HEADER) and found["long.csv"]["bytes_read"] == 1024
    assert found["blank%20+1%25.csv"]["header"] == "k" * 3000 and found["cr.csv"]["header"] == "a,b" and found["none.csv"]["header"] is None


@pytest.mark.parametrize("block", [1, 2, 3, 7])
def test_first_line_at_any_block_size(scratch, block):
    p = os.path.join(scratch, "x.csv")
    for text, want in ((b"\r\n\r\nab,c\r\nd", b"ab,c"), (b"ab", b"ab"), (b"\r\rab\rc", b"ab"), (b"", None), (b"ab\r", b"ab"), (b" \nab\n", b"ab")):
        with open(p, "wb") as f:
            f.write(text)
        assert headers.first_line("file://" + p, block)[0] == want


def test_stores_that_tasks_cannot_open_are_probed_by_the_reader(spark, scratch, monkeypatch):
    from salescope.sources import csv_files

    write_csv(os.path.join(scratch, "a.csv"), HEADER, [dict(BASE, CaseId="1")])
    want = csv_files.header_groups(spark, [scratch])
    monkeypatch.setattr(csv_files, "can_open", lambda path: False)
    assert csv_files.header_groups(spark, [scratch]) == want and len(want) == 1


# ---------------------------------------------------------------- files of one batch


def test_a_column_of_one_file_leaves_the_others_whole(spark, scratch):
    one, two = os.path.join(scratch, "one.csv"), os.path.join(scratch, "two.csv")
    plain = [c for c in HEADER if c != "CaseId"]
    write_csv(one, plain, [dict(BASE, InvoiceNo="1001")])
    write_csv(two, plain + ["Note"], [dict(BASE, InvoiceNo="1002", Note="seen"), dict(BASE, InvoiceNo="1003", Note=None)])
    raw = read_invoice_csv(spark, [one, two])
    kept = {r["invoice_no"]: r["Note"] for r in clean.clean(raw).collect()}
    assert kept == {1001.0: None, 1002.0: "seen"}  # a note missing in its own file is missing
    literal = {r["invoice_no"] for r in clean.run_steps(raw).collect()}
    flags = {r["invoice_no"] for r in clean.upto_step(raw, "clean_drop_mailout").collect()}
    assert literal == flags == set(kept)
    alone = feedback.feedback_counts(read_invoice_csv(spark, [one])).collect()
    both = {r["file_name"]: r for r in feedback.feedback_counts(raw, list_files(spark, [one, two])).collect()}
    assert both[f"file:{one}"] == alone[0] and both[f"file:{two}"]["n_codes"] == 1


def test_names_do_not_depend_on_the_batch(spark, scratch):
    paths = [os.path.join(scratch, d, "x.csv") for d in "ab"]
    for p in paths:
        os.makedirs(os.path.dirname(p))
    write_csv(paths[0], HEADER, [dict(BASE, CaseId="1", Description="FIRST"), dict(BASE, InvoiceNo="1001", CaseId="2")])
    with open(paths[1], "w") as f:
        f.write("\n\n")
    counts = {r["file_name"]: r["n_total"] for r in feedback.feedback_counts(read_invoice_csv(spark, paths), list_files(spark, paths)).collect()}
    assert counts == {f"file:{paths[0]}": 2, f"file:{paths[1]}": 0}
    # the last file by path wins, alone or beside a file of the same base name
    write_csv(paths[1], HEADER, [dict(BASE, CaseId="1", Description="LAST")])
    names = star.star_products(clean.clean(read_invoice_csv(spark, paths))).collect()
    assert [r["product_name"] for r in names] == ["LAST"]


@pytest.mark.parametrize("multi_line", [None, False])
def test_paths_without_escapes_are_not_decoded_for_every_row(spark, scratch, multi_line):
    def read(*names):
        paths = [os.path.join(scratch, n) for n in names]
        for p in paths:
            with open(p, "w") as f:
                f.write('InvoiceNo,StockCode\n1,"a\nb"\n' if multi_line is None else "InvoiceNo,StockCode\n1,a\n")
        df = read_invoice_csv(spark, paths, multi_line=multi_line)
        labels = {r[0] for r in df.select(file_label(F.col("file_name"))).collect()}
        return labels, df._jdf.queryExecution().optimizedPlan().toString().lower()

    plain, odd = read("a+b.csv", "c.csv"), read("d e.csv", "f%20+g.csv", "h.csv")
    assert plain[0] == {"a+b.csv", "c.csv"} and odd[0] == {"d e.csv", "f%20+g.csv", "h.csv"}
    assert "urlcodec" in odd[1] and "urlcodec" not in plain[1]


def test_the_feed_file_is_not_matched_in_every_path(spark):
    df = testdata.raw_feed_via_csv(spark, SF001)
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp" not in plan and "urlcodec" not in plan
    assert {r["file_name"] for r in df.select("file_name").distinct().collect()} == {f"feed_{i}.csv" for i in range(5)}
