"""The header line of every file of a batch, reading the first block of each file alone."""

from __future__ import annotations

import csv
import io
import sys
from itertools import count

import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes read at once; further blocks only while no header line has ended.
BLOCK = 1 << 16


def first_line(path: str, block: int = BLOCK) -> tuple[bytes | None, int]:
    """First non-blank line of a file (None if there is none) and the number of bytes read for it."""
    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    rest, read = b"", 0
    with fs.open_input_stream(inner, compression=None) as stream:
        while True:
            chunk = stream.read(block)
            read += len(chunk)
            rest = (rest + chunk).replace(b"\r\n", b"\n")
            held = rest.endswith(b"\r") and chunk  # its LF may be in the next block
            lines = rest.replace(b"\r", b"\n").split(b"\n")
            whole = lines if not chunk else lines[: -2 if held else -1]
            found = next((line for line in whole if line.strip()), None)
            if found is not None or not chunk:
                return found, read
            rest = b"\n".join(lines[len(whole):]) if not held else lines[-2] + b"\r"


def can_open(path: str) -> bool:
    """Whether the tasks can open ``path`` by themselves (some stores only Spark's readers reach)."""
    try:
        fs, inner = pyarrow.fs.FileSystem.from_uri(path)
        return fs.get_file_info(inner).type != pyarrow.fs.FileType.NotFound
    except (OSError, ValueError, NotImplementedError):
        return False


def file_headers(listing: DataFrame, encoding: str, block: int = BLOCK) -> DataFrame:
    """``listing`` (path, size) with header and bytes_read; the files are opened by the tasks, a slice of the listing each."""
    def probe(batches):
        for batch in batches:
            found = [first_line(p, block) for p in batch.column(0).to_pylist()]
            lines = [None if line is None else line.decode(encoding) for line, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lines, pa.string()), pa.array([n for _, n in found], pa.int64())],
                ["path", "size", "header", "bytes_read"])

    return listing.select("path", "size").mapInArrow(probe, "path string, size long, header string, bytes_read long")


def parse_header(line: str) -> list[str]:
    """Column names of a header line, all different: an empty name is ``Unnamed: <position>``; of a name that
    is taken further left, the first of ``<name>.1``, ``<name>.2``, ... that is free."""
    names: dict[str, None] = {}
    for place, cell in enumerate(next(csv.reader(io.StringIO(line)))):
        name = cell or f"Unnamed: {place}"
        free = name if name not in names else next(n for k in count(1) if (n := f"{name}.{k}") not in names)
        names[free] = None
    return list(names)


def listing_of(spark, paths: list[str], recursive: bool = False) -> DataFrame:
    """(path, size) of every file, contents not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(paths)
            .select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("size")))
