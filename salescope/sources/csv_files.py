"""Reading a batch of raw invoice CSV files.

* S1: header line, comma, ISO-8859-1, doubled quotes inside quoted fields,
  newlines inside quoted fields, blank lines skipped. Every column is read as
  text; typing happens in the cleaning rules.
* S2: the pandas null markers become NULL after reading.
* S3: a batch is many files read as one DataFrame; ``file_name``, the file's
  path, keys everything per file, whatever else is in the batch
  (``file_label`` is its base name, for display).
* S4: ``row_pos`` = (start offset of the split, row id inside the task)
  orders rows as they appear in each file, so "first row" means the same as
  in a file read top to bottom, also when a large file is split.

Spark's CSV reader binds columns by position. The header of each file is read
first (its first block alone, ``sources.headers``); files of one header are read
with their own schema, and the groups are combined by name. A column that a file
does not have is NULL there and listed in ``absent``, so that the cleaning does not
take it for a missing value. ``uniform_header=True`` skips the header pass when
all files are known to share one header (the reader then still checks each file's header against it).
"""

from __future__ import annotations

import csv
import io
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salescope.functions.coercion import NA_TOKENS, null_tokens_to_null
from salescope.sources.headers import can_open, file_headers, listing_of, parse_header
from salescope.sources.quoted_csv import read_split, split_states

SOURCE_ENCODING = "ISO-8859-1"

# The columns of an invoice file.
INVOICE_COLUMNS = ("InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice",
                   "CustomerID", "Country")
EMPTY_RAW_SCHEMA = T.StructType(
    [T.StructField("file_name", T.StringType()),
     T.StructField("row_pos", T.StructType([T.StructField("block_start", T.LongType()),
                                            T.StructField("row_id", T.LongType())]))]
    + [T.StructField(c, T.StringType()) for c in INVOICE_COLUMNS])


def _reader(spark: SparkSession, encoding: str, multi_line: bool, recursive: bool = False):
    return (spark.read
            .option("recursiveFileLookup", recursive)
            .option("header", True)
            .option("encoding", encoding)
            .option("multiLine", multi_line)
            .option("quote", '"')
            .option("escape", '"')
            .option("enforceSchema", False)
            .option("mode", "PERMISSIVE"))


def _as_read_path(uri: str) -> str:
    """File paths in ``_metadata`` / binaryFile listings are URI strings (a space is
    ``%20``); readers take plain paths."""
    return unquote(uri)


def decoded(c: Column) -> Column:
    """Plain path or name from a URI-encoded ``_metadata`` one ('a%20b.csv' -> 'a b.csv').
    A literal '+' is protected first: form decoding would turn it into a blank."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def _row_path(uris: list[str], uri: Column) -> Column:
    """Path of the file of each row of ``uris``. URIs without an escape are paths already, so no row has to be decoded
    (a ``*`` is not escaped, and a reader may take it for a pattern of files with other names)."""
    return decoded(uri) if any(c in u for u in uris for c in "%*") else uri


def file_label(c: Column) -> Column:
    """Base name of a file's path, for display; several files may have it."""
    return F.element_at(F.split(c, "/"), -1)


def _headers_by_reader(spark: SparkSession, paths: list[str], recursive: bool, encoding: str) -> DataFrame:
    """(path, size, header) through Spark's reader, for stores that tasks cannot open themselves: every file is read once."""
    lines = (spark.read
             .option("recursiveFileLookup", recursive)
             .option("encoding", encoding)
             .option("header", False)
             .option("multiLine", False)
             .option("sep", "\u0001")
             .option("quote", "\u0000")
             .schema("value STRING")
             .csv(paths)
             .select(F.col("_metadata.file_path").alias("path"),
                     F.col("_metadata.file_size").alias("size"),
                     F.col("_metadata.file_block_start").alias("start"),
                     F.monotonically_increasing_id().alias("pos"),
                     "value")
             .filter((F.col("start") == 0) & (F.trim("value") != "")))
    return lines.groupBy("path", "size").agg(F.min_by("value", "pos").alias("header"))


def header_groups(spark: SparkSession, paths: list[str], recursive: bool = False,
                  encoding: str = SOURCE_ENCODING) -> dict[str, list[tuple[str, int]]]:
    """{header line: [(file URI, file size)]} from the first non-blank line of each file; files without one are left out.

    Distributed: each task opens its files and reads their first blocks. One row per file (URI,
    size, header line) comes back to the driver, as a file listing would.
    """
    listing = listing_of(spark, paths, recursive)
    one = listing.limit(1).collect()
    if one and can_open(one[0]["path"]):
        found = file_headers(listing, encoding).filter("header IS NOT NULL")
    else:
        found = _headers_by_reader(spark, paths, recursive, encoding)
    groups: dict[str, list[tuple[str, int]]] = {}
    for r in found.collect():
        groups.setdefault(r["header"], []).append((r["path"], r["size"]))
    return {h: sorted(files) for h, files in groups.items()}


def list_files(spark: SparkSession, paths: list[str] | str, recursive: bool = False) -> DataFrame:
    """(file_name, file_label, file_size) of every input file, contents not read.

    Lets per-file reports include files that hold no data row (a header only, or blank lines).
    Zero-byte files are skipped by Spark's file scans and are not listed."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    name = decoded(F.col("path"))
    return listing_of(spark, paths, recursive).select(name.alias("file_name"), file_label(name).alias("file_label"), F.col("size").alias("file_size"))


_UNITS = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}


def split_bytes(spark: SparkSession) -> int:
    """spark.sql.files.maxPartitionBytes in bytes."""
    raw = str(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m")).strip().lower()
    num = raw.rstrip("bkmg")
    unit = raw[len(num):] or "b"
    return int(float(num) * _UNITS[unit])


#: How a CSV file is parsed, by the reader or record by record.
CSV_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def _read_group(spark, uris, columns, encoding, mode, recursive=False, check_header=True, states=None) -> DataFrame:
    if mode == "records":
        df, path, pos = read_split(spark, {u: states[u] for u in uris}, [_as_read_path(u) for u in uris], columns, encoding, CSV_OPTIONS)
        return df.select(_row_path(uris, path).alias("file_name"), pos.alias("row_pos"), *[F.col("row")[c].alias(c) for c in columns])
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    reader = _reader(spark, encoding, mode == "multi-line", recursive)
    if not check_header:
        # names were made unique, so they differ from the file's header text; the
        # probe already established the column order of every file in the group
        reader = reader.option("enforceSchema", True)
    df = reader.schema(schema).csv([_as_read_path(u) for u in uris])
    return df.select(
        _row_path(uris, F.col("_metadata.file_path")).alias("file_name"),
        F.struct(F.col("_metadata.file_block_start").alias("block_start"),
                 F.monotonically_increasing_id().alias("row_id")).alias("row_pos"),
        *[F.col(f"`{c}`") for c in columns],
    )


def _by_mode(files: list[tuple[str, int]], multi_line: bool | None, limit: int, states: dict) -> dict[str, list[str]]:
    """Files per reading mode. Auto (None): a file up to one split is read in
    multi-line mode (it is one task either way); a larger one line by line, or as cut records if some span lines."""
    out: dict[str, list[str]] = {}
    for uri, size in files:
        if multi_line is None:
            mode = "multi-line" if size <= limit else "records" if uri in states else "lines"
        else:
            mode = "multi-line" if multi_line else "lines"
        out.setdefault(mode, []).append(uri)
    return out


def read_invoice_csv(spark: SparkSession, paths: list[str] | str, *, encoding: str = SOURCE_ENCODING,
                     multi_line: bool | None = None, uniform_header: bool = False,
                     null_tokens=NA_TOKENS, recursive: bool = False) -> DataFrame:
    """Raw invoice rows: file_name (path), row_pos, then one text column per header name; ``absent`` (the
    columns a row's file does not have) if the files' columns differ.

    ``multi_line``: newlines inside quoted fields need Spark's multi-line
    mode, in which a file cannot be split and is read by one task. The
    default (None) gives the same rows for a file of any size: files up to
    ``spark.sql.files.maxPartitionBytes`` are read that way -- they would be a
    single split anyway. Larger files are split; a first pass over their lines with quotes finds
    those with records that span lines, which are cut at true record ends (``sources.quoted_csv``). Pass
    True to spare that pass (one task per file), False to split all at line ends: the caller
    then vouches that no field holds a newline. For an encoding that is no superset of ASCII
    (UTF-16, say) large files are read by one task each.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    limit = split_bytes(spark)
    if multi_line is None and encoding.upper().startswith(("UTF-16", "UTF-32")):
        multi_line = True
    # Both branches end with a list of individual files (no directory recursion needed below).
    if uniform_header:
        listing = [(r["path"], r["size"]) for r in listing_of(spark, paths, recursive).collect()]
        groups = []
        if listing:
            probe = _reader(spark, encoding, True).csv(_as_read_path(listing[0][0]))
            groups = [(probe.columns, listing, True)]
    else:
        groups = [(parse_header(h), files, parse_header(h) == next(csv.reader(io.StringIO(h))))
                  for h, files in header_groups(spark, paths, recursive, encoding).items()]
    large = [uri for _, files, _ in groups for uri, size in files if size > limit] if multi_line is None else []
    states = split_states(spark, [_as_read_path(u) for u in large]) if large else {}
    if uniform_header and states:  # records that are cut here meet no reader that checks their file's header
        for header, files in header_groups(spark, [_as_read_path(u) for u in states], False, encoding).items():
            if next(csv.reader(io.StringIO(header))) != groups[0][0]:
                raise ValueError(f"the header of {files[0][0]} is not {groups[0][0]}")
    every = list(dict.fromkeys(c for cols, _, _ in groups for c in cols))
    parts = []
    for cols, files, plain in groups:
        missing = F.lit([c for c in every if c not in cols]).cast("array<string>")
        for mode, uris in _by_mode(files, multi_line, limit, states).items():
            part = _read_group(spark, uris, cols, encoding, mode, check_header=plain, states=states)
            parts.append(part if all(set(c) == set(every) for c, _, _ in groups) else part.withColumn("absent", missing))
    if not parts:
        # no file with a header line (e.g. only empty files): an empty raw frame
        return spark.createDataFrame([], EMPTY_RAW_SCHEMA)
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p, allowMissingColumns=True)
    keep = [c for c in ("file_name", "row_pos", "absent") if c in df.columns]
    return df.select(*keep, *[null_tokens_to_null(F.col(f"`{c}`"), null_tokens).alias(c) for c in every])


def write_invoice_csv(raw: DataFrame, path: str, encoding: str = SOURCE_ENCODING) -> None:
    """Write a raw frame as CSV below ``path/file_name=<name>/``, text kept as is
    (no trimming, doubled quotes).

    Rows are range-partitioned on (file_name, row_pos), so each task writes a
    contiguous run of one file's rows and part-file order follows row order;
    no file, however large, is funnelled through a single task.
    """
    data = [c for c in raw.columns if c not in ("file_name", "row_pos", "absent")]
    (raw.repartitionByRange("file_name", "row_pos")
        .sortWithinPartitions("file_name", "row_pos")
        .select("file_name", *data)
        .write.mode("overwrite")
        .partitionBy("file_name")
        .option("header", True)
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path))
