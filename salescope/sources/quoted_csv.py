"""One large CSV file with newlines inside quoted fields, read by many tasks.

Spark's multi-line mode reads such a file in one task, because a split cannot tell whether it starts inside
quotes. Here the file is read as physical lines, which split anywhere, and the question is answered from summaries:

1. A line starts outside or inside quotes. What it does to either state is a function of two
   values; a split's lines compose to such a function (for files where every quote delimits, the XOR of the quote counts' parities).
   Each task gives its splits' functions, one small row per split.
2. The driver, which plans the splits anyway, composes them in file order: the state at each split's start.
3. Each task then cuts its splits into records at true record ends. A record that crosses split borders leaves
   a fragment in each; the fragments, two per split at most, are brought together and joined.
4. Records are parsed by Spark's own CSV expression, as a file's records are by its reader.

A quote opens a quoted field only at the start of a field; elsewhere it is text (``5" pipe``). Within quotes a
doubled quote is a quote; after the closing quote the field runs to the next comma. Records end with LF or CRLF
(a file of CRLF records has CRLF within quotes read as LF, as Spark does); an encoding must be a superset of ASCII.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# executors may not have this package: its functions travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The rest of a quoted field up to its closing quote.
_CLOSING = re.compile(rb'(?:[^"]|"")*+"')


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether the end of a physical line lies in quotes, given the state at its start."""
    at = 0
    while True:
        if inside:
            closing = _CLOSING.match(line, at)
            if closing is None:
                return True
            at, inside = closing.end(), False
            comma = line.find(b",", at)
        elif line.startswith(b'"', at):
            inside, at = True, at + 1
            continue
        else:
            comma = line.find(b",", at)
        if comma < 0 or line.find(b'"', comma) < 0:
            return False
        at = comma + 1


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Physical lines of the files: path, start (of the split), line_id (ascending within a split), value (bytes without LF)."""
    return (spark.read.option("lineSep", "\n").text(paths)
            .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
                    F.monotonically_increasing_id().alias("line_id"), F.col("value").cast("binary").alias("value")))


def split_states(spark: SparkSession, paths: list[str]) -> dict[str, dict[int, bool]]:
    """{path: {split start: whether the split starts inside quotes}} for the files in which some line ends inside quotes,
    with the state at the file's end under -1. All other files hold a record per line. A split without any quote changes nothing and is left out."""
    def compose(batches):
        now = None
        for batch in batches:
            for path, start, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if now is None or now[:2] != [path, start]:
                    if now is not None:
                        yield summary(now)
                    now = [path, start, False, True, False]
                line = value.as_py()
                now[2], now[3] = ends_inside(line, now[2]), ends_inside(line, now[3])
                now[4] = now[4] or now[2]
        if now is not None:
            yield summary(now)

    def summary(row):
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], ["path", "start", "from_outside", "from_inside", "crosses"])

    quoted = _lines(spark, paths).filter(F.contains(F.col("value"), F.lit(b'"'))).select("path", "start", "value")
    rows = quoted.mapInArrow(compose, "path string, start long, from_outside boolean, from_inside boolean, crosses boolean").collect()
    files: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        files.setdefault(r["path"], []).append(r)
    states = {}
    for path, splits in files.items():
        if any(r["crosses"] for r in splits):
            state, states[path] = False, {}
            for r in splits:
                states[path][r["start"]] = state
                state = r["from_inside"] if state else r["from_outside"]
            states[path][-1] = state  # at the end of the file
    return states


def _records(spark: SparkSession, states: dict[str, dict[int, bool]], paths: list[str]) -> DataFrame:
    """Records of the files: path, start, line_id (both of its first line), value; the header and empty lines are left out."""
    known = {path: sorted(start for start in at if start >= 0) for path, at in states.items()}

    def state_at(path, start):
        # splits without quotes keep the state that the next split with quotes starts in
        i = bisect_left(known[path], start)
        return states[path][known[path][i] if i < len(known[path]) else -1]

    def cut(batches):
        at, inside, held, first, header, crlf = None, False, [], None, False, False
        rows: list[tuple] = []

        def close(kind):
            nonlocal held, header, crlf
            value = b"\n".join(held)
            held = []
            if kind == "whole":
                crlf = value.endswith(b"\r") or crlf
                if crlf:
                    value = value.removesuffix(b"\r").replace(b"\r\n", b"\n")
                if header and value:
                    header = False
                    return
                if not value:
                    return
            rows.append((*at, first, kind, value, crlf))

        for batch in batches:
            for path, start, line_id, value in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if at != (path, start):
                    if held:
                        close("middle" if continued else "open")
                    at = (path, start)
                    inside = state_at(path, start)
                    continued, header, crlf = inside, start == 0, False
                if not held:
                    first = line_id
                held.append(value)
                if inside or b'"' in value:
                    inside = ends_inside(value, inside)
                if not inside:
                    close("last" if continued else "whole")
                    continued = False
            if rows:
                yield table(rows)
                rows = []
        if held:
            close("middle" if continued else "open")
        if rows:
            yield table(rows)

    def table(rows):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["path", "start", "line_id", "kind", "value", "crlf"])

    return _lines(spark, paths).mapInArrow(cut, "path string, start long, line_id long, kind string, value binary, crlf boolean")


def _joined(fragments: DataFrame) -> DataFrame:
    """Records from the fragments that splits left of them."""
    order = Window.partitionBy("path").orderBy("start", "line_id")
    numbered = fragments.withColumn("record", F.sum((F.col("kind") == "open").cast("long")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("start", "line_id", "value", "crlf")))
    per = numbered.groupBy("path", "record").agg(parts.alias("parts"))
    text = F.aggregate(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), F.col("parts")[0]["value"],
                       lambda done, part: F.concat(done, F.lit(b"\n"), part["value"]))
    records = per.select("path", F.col("parts")[0]["start"].alias("start"), F.col("parts")[0]["line_id"].alias("line_id"),
                         text.alias("value"), F.col("parts")[0]["crlf"].alias("crlf"))
    ends = F.substring("value", -1, 1) == F.lit(b"\r")
    bare = F.when(ends, F.substring(F.col("value"), F.lit(1), F.length("value") - 1)).otherwise(F.col("value"))
    # bytes of one byte each, so that text functions apply to them
    plain = F.encode(F.replace(F.decode(bare, "ISO-8859-1"), F.lit("\r\n"), F.lit("\n")), "ISO-8859-1")
    return records.select("path", "start", "line_id", F.when(ends | F.col("crlf"), plain).otherwise(F.col("value")).alias("value"))


def read_split(spark: SparkSession, states: dict[str, dict[int, bool]], paths: list[str], columns: list[str], encoding: str,
               options: dict[str, str]) -> tuple[DataFrame, Column, Column]:
    """Rows of the files: a frame with a struct ``row`` of the text ``columns``, and its path and position expressions."""
    records = _records(spark, states, paths)
    whole = records.filter("kind = 'whole'").drop("kind", "crlf")
    crossing = _joined(records.filter("kind <> 'whole'"))
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    rows = whole.unionByName(crossing).select("path", "start", "line_id", F.from_csv(F.decode("value", encoding), schema.simpleString(), options).alias("row"))
    return rows, F.col("path"), F.struct(F.col("start").alias("block_start"), F.col("line_id").alias("row_id"))
