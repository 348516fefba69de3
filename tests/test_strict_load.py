"""Strict (per-file, all-or-nothing) load against a plain file-by-file loop."""

import datetime as dt
import random

import pytest
from pyspark.sql import types as T

from salescope.operators import load

ROWS_SCHEMA = T.StructType([
    T.StructField("file_name", T.StringType()),
    T.StructField("row_pos", T.LongType()),
    T.StructField("invoice_no", T.DoubleType()),
    T.StructField("product_code", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("invoice_date", T.TimestampNTZType()),
    T.StructField("country", T.StringType()),
])
INV_SCHEMA = T.StructType([T.StructField("invoice_no", T.LongType()), T.StructField("invoice_date", T.DateType()),
                           T.StructField("country", T.StringType())])
LINE_SCHEMA = T.StructType([T.StructField("invoice_no", T.LongType()), T.StructField("product_code", T.StringType())])
PROD_SCHEMA = T.StructType([T.StructField("product_code", T.StringType()),
                            T.StructField("product_name", T.StringType())])


def brute_force(old_inv, old_lines, rows):
    inv, lines, verdict = set(old_inv), set(old_lines), {}
    files = sorted({r[0] for r in rows})
    for f in files:
        fr = [r for r in rows if r[0] == f]
        inv_f = {int(r[2]) for r in fr}
        lines_f = {(int(r[2]), r[3]) for r in fr}
        ok_inv = not (inv_f & inv)
        if ok_inv:
            inv |= inv_f
        ok_lines = not (lines_f & lines) and all(i in inv for i, _ in lines_f)
        if ok_lines:
            lines |= lines_f
        verdict[f] = (ok_inv, ok_lines)
    return inv, lines, verdict


def fixture(seed):
    rnd = random.Random(seed)
    rows = []
    ts = dt.datetime(2011, 1, 1, 8, 0)
    for f in range(rnd.randint(3, 7)):
        for i in range(rnd.randint(1, 6)):
            inv = rnd.randint(1, 25)
            code = rnd.choice("ABCDE")
            rows.append((f"f{f}.csv", f * 100 + i, float(inv), code, "name " + code, ts, "FR"))
    # one row per (file, invoice, code), as the cleaning leaves it
    seen, uniq = set(), []
    for r in rows:
        if (r[0], r[2], r[3]) not in seen:
            seen.add((r[0], r[2], r[3]))
            uniq.append(r)
    old_inv = set(rnd.sample(range(1, 30), 3))
    old_lines = {(i, rnd.choice("ABCDE")) for i in old_inv}
    return uniq, old_inv, old_lines


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_strict_matches_file_by_file(spark, seed):
    rows, old_inv, old_lines = fixture(seed)
    exp_inv, exp_lines, exp_verdict = brute_force(old_inv, old_lines, rows)
    df = spark.createDataFrame(rows, ROWS_SCHEMA)
    old_i = spark.createDataFrame([(i, dt.date(2010, 1, 1), "FR") for i in sorted(old_inv)], INV_SCHEMA)
    old_l = spark.createDataFrame(sorted(old_lines), LINE_SCHEMA)
    prods = spark.createDataFrame([(c, "name " + c) for c in "ABCDE"], PROD_SCHEMA)
    out = load.strict_load(old_i, old_l, prods, df)
    got_verdict = {r["file_name"]: (r["invoices_accepted"], r["lines_accepted"]) for r in out["verdict"].collect()}
    assert got_verdict == exp_verdict
    assert {r["invoice_no"] for r in out["invoices"].collect()} == exp_inv
    got_lines = [(r["invoice_no"], r["product_code"]) for r in out["lines"].collect()]
    assert sorted(got_lines) == sorted(exp_lines) and len(got_lines) == len(set(got_lines))


def test_greedy_chain(spark):
    # f0-f1 share key 1, f1-f2 share key 2, f2-f3 share key 3: f0 and f2 accepted.
    pairs = spark.createDataFrame([("f0", 1), ("f1", 1), ("f1", 2), ("f2", 2), ("f2", 3), ("f3", 3), ("f3", 9)],
                                  "file_name string, key int")
    files = pairs.select("file_name").distinct()
    res = load.greedy_accept(pairs, files, spark.createDataFrame([], "file_name string"))
    got = {r["file_name"]: r["accepted"] for r in res.collect()}
    assert got == {"f0": True, "f1": False, "f2": True, "f3": False}


def test_same_line_twice_after_coercion_rejects_lines(spark):
    ts = dt.datetime(2011, 1, 1, 8, 0)
    # f0 offers invoice 5 twice with code A (two raw texts, one number); f1 is clean
    rows = [("f0.csv", 1, 5.0, "A", "a", ts, "FR"), ("f0.csv", 2, 5.0, "A", "a", ts, "FR"),
            ("f0.csv", 3, 6.0, "B", "b", ts, "FR"), ("f1.csv", 1, 7.0, "A", "a", ts, "FR")]
    df = spark.createDataFrame(rows, ROWS_SCHEMA)
    empty_i = spark.createDataFrame([], INV_SCHEMA)
    empty_l = spark.createDataFrame([], LINE_SCHEMA)
    prods = spark.createDataFrame([("A", "a"), ("B", "b")], PROD_SCHEMA)
    out = load.strict_load(empty_i, empty_l, prods, df)
    got = {r["file_name"]: (r["invoices_accepted"], r["lines_accepted"]) for r in out["verdict"].collect()}
    assert got == {"f0.csv": (True, False), "f1.csv": (True, True)}
    assert sorted((r["invoice_no"], r["product_code"]) for r in out["lines"].collect()) == [(7, "A")]


@pytest.mark.parametrize("bound", [load.FOLD_PAIRS, 0])
def test_both_ways_decide_alike(spark, monkeypatch, bound):
    monkeypatch.setattr(load, "FOLD_PAIRS", bound)
    r = random.Random(11)
    pairs = [(f"f{i:03d}", r.randrange(40)) for i in range(60) for _ in range(r.randrange(1, 5))]
    refused = {f"f{i:03d}" for i in range(0, 60, 9)}
    taken, want = set(), {}
    for name in sorted({f for f, _ in pairs} | refused):
        keys = {k for f, k in pairs if f == name}
        want[name] = name not in refused and not keys & taken
        taken |= keys if want[name] else set()
    frame = spark.createDataFrame(pairs, "file_name string, key int")
    got = load.greedy_accept(frame.selectExpr("file_name", "struct(key AS a, 'x' AS b) AS key"), spark.createDataFrame([(f,) for f in want], "file_name string"),
                             spark.createDataFrame([(f,) for f in refused], "file_name string"))
    assert {r["file_name"]: r["accepted"] for r in got.collect()} == want


def test_a_chain_needs_no_round_per_link(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(load, "_checkpoint", lambda df: calls.append(1) or df.checkpoint(eager=True))
    for n in (10, 1000):
        calls.clear()
        pairs = spark.createDataFrame([(f"f{i:04d}", k) for i in range(n) for k in (i, i + 1)], "file_name string, key int")
        got = load.greedy_accept(pairs, pairs.select("file_name").distinct(), spark.createDataFrame([], "file_name string"))
        assert {r["file_name"]: r["accepted"] for r in got.collect()} == {f"f{i:04d}": i % 2 == 0 for i in range(n)}
        assert len(calls) == 3
