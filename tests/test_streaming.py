"""The streaming ingest gives the same per-file feedback and clean rows as the
batch path, also when files arrive over several micro-batches."""

import os

from pyspark.sql import functions as F

from salescope.operators import clean, feedback
from salescope.sources.csv_files import read_invoice_csv
from salescope.streaming.file_ingest import start_ingest
from test_edge_rows import BASE, CASES, HEADER, write_csv


def test_stream_matches_batch(spark, scratch):
    landing = os.path.join(scratch, "landing")
    os.makedirs(landing)
    rows = [r for _, r, _ in CASES if "\n" not in (r.get("Description") or "")]
    # three files; the third repeats rows of the first under another file name
    write_csv(os.path.join(landing, "u1.csv"), HEADER, rows[:30])
    write_csv(os.path.join(landing, "u2.csv"), HEADER, rows[30:])
    write_csv(os.path.join(landing, "u3.csv"), HEADER, rows[:10] + [dict(BASE, CaseId="x")])
    sink = os.path.join(scratch, "sink")
    q = start_ingest(spark, landing, sink, os.path.join(scratch, "ckpt"), max_files_per_trigger=1,
                    columns=HEADER)
    q.awaitTermination(300)
    assert q.exception() is None

    batch_raw = read_invoice_csv(spark, [os.path.join(landing, f) for f in ("u1.csv", "u2.csv", "u3.csv")])
    want = {r["file_name"]: tuple(r[c] for c in feedback.COUNT_COLUMNS)
            for r in feedback.feedback_counts(batch_raw).collect()}
    fb = spark.read.parquet(os.path.join(sink, "feedback"))
    got = {r["file_name"]: tuple(r[c] for c in feedback.COUNT_COLUMNS) for r in fb.collect()}
    assert got == want
    assert fb.select("batch_id").distinct().count() == 3

    cols = ["file_name", "invoice_no", "product_code", "product_name", "invoice_date", "country", "CaseId"]
    a = spark.read.parquet(os.path.join(sink, "clean")).select(*cols)
    b = clean.clean(batch_raw).select(*cols)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
