"""Hand-made invoice rows, one per cleaning rule, written as real ISO-8859-1 CSV
files and read back with the CSV source. Each row carries a CaseId column
(an extra column, which survives like any other) so the step that removes it
can be read off the flags."""

import csv
import os

import pytest
from pyspark.sql import functions as F

from salescope.operators import clean, star
from salescope.sources.csv_files import read_invoice_csv

HEADER = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID",
          "Country", "CaseId"]
BASE = dict(InvoiceNo="536365", StockCode="85123A", Description="WHITE HOLDER", Quantity="6",
            InvoiceDate="12/1/2010 8:26", UnitPrice="2.55", CustomerID="17850", Country="France")

# (case id, changed fields, expected: 'kept' or the stage number removing it)
_inv = iter(range(600000, 700000))


def case(cid, expect, **changes):
    row = dict(BASE)
    row["InvoiceNo"] = str(next(_inv))
    row.update(changes)
    row["CaseId"] = cid
    return cid, row, expect


CASES = [
    ("base", dict(BASE, CaseId="base"), "kept"),
    ("dup_lower", dict(BASE, StockCode="85123a", CaseId="dup_lower"), 1),
    ("pair_first", dict(BASE, InvoiceNo="536400", Quantity="-1", CaseId="pair_first"), 5),
    ("pair_second", dict(BASE, InvoiceNo="536400", CaseId="pair_second"), 1),
    ("nullinv_first", dict(BASE, InvoiceNo=None, StockCode="22222", CaseId="nullinv_first"), 2),
    ("nullinv_second", dict(BASE, InvoiceNo=None, StockCode="22222", CaseId="nullinv_second"), 1),
    case("credit_c", 2, InvoiceNo="C536379"),
    case("credit_a", 2, InvoiceNo="A563185"),
    case("inv_underscore", 2, InvoiceNo="1_000"),
    case("inv_hex", 2, InvoiceNo="0x10"),
    case("inv_suffix", 2, InvoiceNo="5d"),
    case("inv_inf", 2, InvoiceNo="inf"),
    case("inv_blanks", "kept", InvoiceNo=" 536366 "),
    case("inv_sci", "kept", InvoiceNo="1e3"),
    case("inv_fraction", "kept", InvoiceNo="12.5"),
    case("date_month13", 3, InvoiceDate="13/1/2010 8:26"),
    case("date_iso", 3, InvoiceDate="2010-12-01 08:26"),
    case("date_seconds", 3, InvoiceDate="12/1/2010 8:26:00"),
    case("date_2digit_year", 3, InvoiceDate="12/1/10 8:26"),
    case("date_feb30", 3, InvoiceDate="2/30/2011 1:00"),
    case("date_unpadded", "kept", InvoiceDate="1/2/2011 8:5"),
    case("date_padded", "kept", InvoiceDate="12/01/2010 08:26"),
    case("code_M", "kept", StockCode="M"),
    case("code_m", "kept", StockCode="m"),
    case("code_C2", "kept", StockCode="C2"),
    case("code_5", "kept", StockCode="ABCDE"),
    case("code_8", "kept", StockCode="DCGS0003"),
    case("code_DOT", 4, StockCode="DOT"),
    case("code_POST", 4, StockCode="POST"),
    case("code_9", 4, StockCode="AMAZONFEE"),
    case("code_null", 4, StockCode=None),
    case("desc_null", 4, Description=None),
    case("desc_NA", 4, Description="NA"),
    case("desc_n/a", 4, Description="n/a"),
    case("desc_nulltext", 4, Description="null"),
    case("desc_quoted_empty", 4, Description=""),
    case("country_null", 4, Country=None),
    case("qty_null", 4, Quantity=None),
    case("customer_null", "kept", CustomerID=None),
    case("qty_zero", 5, Quantity="0"),
    case("qty_negative", 5, Quantity="-1"),
    case("country_unspecified", 6, Country="Unspecified"),
    case("desc_mailout", 6, Description="mailout"),
    case("country_lower_unspecified", "kept", Country="unspecified"),
    case("desc_Mailout", "kept", Description="Mailout"),
    case("desc_mailout_blank", "kept", Description="mailout ", StockCode="77777"),
    case("desc_nbsp", "kept", Description="NBSP NAME\xa0", StockCode="11111"),
    case("desc_quote_slash", "kept", Description='1/2" BOLT', StockCode="22223"),
    case("desc_e_quote", "kept", Description='e "', StockCode="33333"),
    case("desc_newline", "kept", Description="TWO\nLINES", StockCode="44444"),
    case("desc_accent", "kept", Description="CAFÉ CRÈME", StockCode="55555"),
    case("desc_None", "kept", Description="None", StockCode="66666"),
    case("name_M_first", "kept", StockCode="M", Description="MANUAL"),
    case("name_M_second", "kept", StockCode="M", Description="MANUAL TWO"),
]


def write_csv(path, header, rows):
    with open(path, "w", newline="", encoding="ISO-8859-1") as fh:
        w = csv.writer(fh, quoting=csv.QUOTE_MINIMAL, lineterminator="\n")
        w.writerow(header)
        for r in rows:
            vals = []
            for h in header:
                v = r.get(h)
                vals.append("" if v is None else v)
            w.writerow(vals)
        if rows:
            fh.write("\n")  # a blank line at the end is skipped


def _stage(row):
    for i, flag in enumerate(clean.FLAGS, start=2):
        if not row[flag]:
            return i
    return "kept"


@pytest.fixture()
def edge_raw(spark, scratch):
    rows = [r for _, r, _ in CASES]
    write_csv(os.path.join(scratch, "a_edge.csv"), HEADER, rows)
    # The quoted empty Description must be written as "" explicitly.
    p = os.path.join(scratch, "a_edge.csv")
    text = open(p, encoding="ISO-8859-1").read()
    text = text.replace(",,6,12/1/2010 8:26,2.55,17850,France,desc_quoted_empty",
                        ',"",6,12/1/2010 8:26,2.55,17850,France,desc_quoted_empty')
    open(p, "w", encoding="ISO-8859-1").write(text)
    return read_invoice_csv(spark, [p])


def test_each_rule_removes_its_rows(edge_raw):
    raw_n = edge_raw.count()
    assert raw_n == len(CASES)
    flagged = {r["CaseId"]: r for r in clean.flagged(edge_raw).collect()}
    for cid, _, expect in CASES:
        got = _stage(flagged[cid]) if cid in flagged else 1
        assert got == expect, (cid, got, expect)


def test_step_functions_agree_with_flags(edge_raw):
    stepwise = {r["CaseId"] for r in clean.run_steps(edge_raw).collect()}
    oneshot = {r["CaseId"] for r in clean.clean(edge_raw).collect()}
    assert stepwise == oneshot
    assert stepwise == {cid for cid, _, e in CASES if e == "kept"}


def test_csv_reader_keeps_text(edge_raw):
    got = {r["CaseId"]: r for r in edge_raw.collect()}
    assert got["inv_blanks"]["InvoiceNo"] == " 536366 "
    assert got["desc_newline"]["Description"] == "TWO\nLINES"
    assert got["desc_accent"]["Description"] == "CAFÉ CRÈME"
    assert got["desc_quote_slash"]["Description"] == '1/2" BOLT'
    assert got["desc_None"]["Description"] == "None"
    assert got["desc_NA"]["Description"] is None
    assert got["desc_quoted_empty"]["Description"] is None
    assert got["desc_nbsp"]["Description"] == "NBSP NAME\xa0"


def test_product_names_normalised(edge_raw):
    rows = clean.clean(edge_raw)
    names = {r["product_code"]: r["product_name"] for r in star.star_products(rows).collect()}
    assert names["11111"] == "NBSP NAME"
    assert names["22223"] == "12 BOLT"
    assert names["33333"] == "e "
    assert names["77777"] == "mailout"
    # code M appears first (case code_M) with the base name; later names for M lose
    assert names["M"] == "WHITE HOLDER"


def test_fractional_invoice_rejected_at_load(edge_raw):
    rows = clean.clean(edge_raw)
    inv = {r["invoice_no"] for r in star.star_invoices(rows).collect()}
    assert 536366 in inv and 1000 in inv
    assert all(isinstance(i, int) for i in inv)
    kept = {r["invoice_no"] for r in rows.collect()}
    assert 12.5 in kept and 12 not in inv


def test_columns_bound_by_name_across_files(spark, scratch):
    a = dict(BASE, CaseId="a")
    b = dict(BASE, InvoiceNo="777777", CaseId="b")
    write_csv(os.path.join(scratch, "f1.csv"), HEADER, [a])
    shuffled = ["Country", "CaseId", "InvoiceDate", "StockCode", "UnitPrice", "Description", "CustomerID",
                "Quantity", "InvoiceNo"]
    write_csv(os.path.join(scratch, "f2.csv"), shuffled, [b])
    raw = read_invoice_csv(spark, [os.path.join(scratch, "f1.csv"), os.path.join(scratch, "f2.csv")])
    got = {r["CaseId"]: r for r in raw.collect()}
    assert got["b"]["InvoiceNo"] == "777777" and got["b"]["Country"] == "France"
    assert got["a"]["file_name"] == f"file:{scratch}/f1.csv" and got["b"]["file_name"] == f"file:{scratch}/f2.csv"


def test_row_order_within_split_files(spark, scratch):
    # Many rows, small splits: "first" must still mean first in the file.
    rows = [dict(BASE, InvoiceNo="900000", Description=f"NAME {i:05d}", CaseId=str(i)) for i in range(3000)]
    p = os.path.join(scratch, "big.csv")
    write_csv(p, HEADER, rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        raw = read_invoice_csv(spark, [p], multi_line=False)
        assert raw.rdd.getNumPartitions() > 1
        first = clean.dedupe_first(clean.upper_code(clean.project(raw))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(first) == 1 and first[0]["product_name"] == "NAME 00000" and first[0]["dup_count"] == 3000


@pytest.mark.parametrize("step", [n for n, _ in clean.STEPS])
def test_flag_based_steps_equal_literal_steps(edge_raw, step):
    drop = [c for c in ("row_pos", "dup_count") if True]
    a = clean.run_steps(edge_raw, step)
    b = clean.upto_step(edge_raw, step)
    a = a.drop(*[c for c in drop if c in a.columns])
    b = b.drop(*[c for c in drop if c in b.columns]).select(*a.columns)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), step


def test_auto_mode_splits_large_files_only(spark, scratch):
    big = [dict(BASE, InvoiceNo=str(800000 + i), Description=f"ITEM {i:05d}", CaseId=str(i)) for i in range(4000)]
    small = [dict(BASE, InvoiceNo="1", Description="TWO\nLINES", CaseId="nl")]
    pb, ps = os.path.join(scratch, "big.csv"), os.path.join(scratch, "small.csv")
    write_csv(pb, HEADER, big)
    write_csv(ps, HEADER, small)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        auto = read_invoice_csv(spark, [pb, ps])
        n_parts = auto.rdd.getNumPartitions()
        rows = {r["CaseId"]: r for r in auto.collect()}
        uni = read_invoice_csv(spark, [pb, ps], uniform_header=True)
        uni_n = uni.count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert n_parts > 2                              # the big file is split
    assert rows["nl"]["Description"] == "TWO\nLINES"  # the small one keeps its quoted newline
    assert len(rows) == 4001 and uni_n == 4001
    assert rows["3999"]["Description"] == "ITEM 03999"


def test_split_file_keeps_row_order_for_first_pick(spark, scratch):
    rows = [dict(BASE, InvoiceNo="424242", Description=f"N {i:05d}", CaseId=str(i)) for i in range(5000)]
    p = os.path.join(scratch, "order.csv")
    write_csv(p, HEADER, rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        raw = read_invoice_csv(spark, [p])
        assert raw.rdd.getNumPartitions() > 3
        names = star.star_products(clean.clean(raw)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["product_name"] for r in names] == ["N 00000"]


def test_non_ascii_header_names_bind(spark, scratch):
    header = HEADER + ["Catégorie"]
    p = os.path.join(scratch, "latin.csv")
    write_csv(p, header, [dict(BASE, CaseId="x", **{"Catégorie": "Décor"})])
    raw = read_invoice_csv(spark, [p])
    row = raw.collect()[0]
    assert "Catégorie" in raw.columns and row["Catégorie"] == "Décor" and row["Country"] == "France"


def test_duplicate_and_empty_header_names(spark, scratch):
    from salescope.sources.headers import parse_header

    assert parse_header("A,B,A,,A,A.1") == ["A", "B", "A.1", "Unnamed: 3", "A.2", "A.1.1"]
    p = os.path.join(scratch, "dups.csv")
    header = HEADER + ["Note", "Note", ""]
    with open(p, "w", encoding="ISO-8859-1", newline="") as fh:
        fh.write(",".join(header) + "\n")
        vals = [BASE[h] if h in BASE else "" for h in HEADER]
        vals[HEADER.index("CaseId")] = "d"
        fh.write(",".join(vals + ["n1", "n2", "x"]) + "\n")
    raw = read_invoice_csv(spark, [p])
    row = raw.collect()[0]
    assert row["Note"] == "n1" and row["Note.1"] == "n2" and row["Unnamed: 11"] == "x"
    assert row["InvoiceNo"] == "536365"


def test_uniform_header_still_checks_each_header(spark, scratch):
    a = os.path.join(scratch, "u1.csv")
    b = os.path.join(scratch, "u2.csv")
    write_csv(a, HEADER, [dict(BASE, CaseId="a")])
    shuffled = ["Country", "CaseId", "InvoiceDate", "StockCode", "UnitPrice", "Description", "CustomerID",
                "Quantity", "InvoiceNo"]
    write_csv(b, shuffled, [dict(BASE, CaseId="b")])
    with pytest.raises(Exception) as err:
        read_invoice_csv(spark, [a, b], uniform_header=True).collect()
    assert "header" in str(err.value).lower() or "schema" in str(err.value).lower()
    # the default (header binding by name) reads both correctly
    got = {r["CaseId"]: r["InvoiceNo"] for r in read_invoice_csv(spark, [a, b]).collect()}
    assert got == {"a": "536365", "b": "536365"}


@pytest.mark.parametrize("uniform", [False, True])
def test_large_file_with_newlines_in_quotes_reads_as_a_small_one(spark, scratch, uniform):
    rows = [dict(BASE, InvoiceNo=str(700000 + i), Description=f"TWO\nLINES {i}", CaseId=str(i)) for i in range(400)]
    p = os.path.join(scratch, "big é.csv")
    write_csv(p, HEADER, rows)
    small = read_invoice_csv(spark, [p], uniform_header=uniform).drop("row_pos").collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        large = read_invoice_csv(spark, [p], uniform_header=uniform).drop("row_pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(large) == 400 and sorted(large) == sorted(small) and {r["Country"] for r in large} == {BASE["Country"]}


def test_files_of_one_base_name_stay_apart(spark, scratch):
    from salescope.operators import feedback
    from salescope.sources.csv_files import list_files

    paths = [os.path.join(scratch, d, "same.csv") for d in ("a", "b")] + [os.path.join(scratch, "other.csv")]
    for p in paths:
        os.makedirs(os.path.dirname(p), exist_ok=True)
        write_csv(p, HEADER, [dict(BASE, CaseId="1")])
    counts = feedback.feedback_counts(read_invoice_csv(spark, paths), list_files(spark, paths)).collect()
    assert len(counts) == 3 and all(r["n_original"] == r["n_dedupe"] == 1 for r in counts)
    assert {r["file_name"] for r in counts} == {f"file:{p}" for p in paths}
