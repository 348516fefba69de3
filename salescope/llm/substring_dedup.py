"""Operator 10: substring dedup by hashing lines and runs of lines.

A unit is a line, cut further after sentence ends, because repeated passages often stand inside
a line. Units are normalised (A-Z lower-cased, runs of blanks made one space). A unit of ``min_words`` words or more
is hashed (to 128 bits) by itself. A shorter one repeats by chance, also beside another short one; it is hashed in the shortest
run of consecutive units with ``run_words`` words or more that begins with it, and in the shortest that ends with it. So a
repeated passage of sentences of any length is found whole if it has 2 * ``run_words`` words. Digests are grouped over all documents; of each
repeated run the occurrence with the smallest (doc_id, start) stays and the others are removed. The first
occurrence of a unit's text always stays: a run that removes it has an earlier occurrence, which holds that text.
Offsets are code points of the original text; runs may overlap.

A run that a third of all rows hold is combined before the shuffle, and its row comes back to the units by broadcast.

Defined cases: null and empty texts have no units; a text with fewer than ``min_words`` words has nothing to compare; a null doc_id ranks last; repeated rows
of one doc_id are one document, so they keep or lose the same units; an empty table gives an empty
result; other columns of the input do not matter.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salescope.llm.common import LOWER, UPPER, attach, ship, stored, table, text_of

ship(__name__)

MIN_WORDS = 8
#: Half of the shortest passage that is found whatever the length of its sentences.
RUN_WORDS = 25
UNIT = re.compile(r"[^\n.!?]*(?:[.!?]+(?![ \n]|$)[^\n.!?]*)*[.!?]*")
TO_LOWER = str.maketrans(UPPER, LOWER)
#: Units of one Arrow batch that leaves a Python task.
OUT_UNITS = 20_000


def runs(text: str, min_words: int, run_words: int) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of what is hashed of ``text``, in order, each once."""
    plain, at, words = [], [], [0]
    for m in UNIT.finditer(text):
        piece = m.group()
        if found := piece.split():
            at.append((m.start() + len(piece) - len(piece.lstrip()), m.end() - (len(piece) - len(piece.rstrip()))))
            plain.append(" ".join(found).translate(TO_LOWER))
            words.append(words[-1] + len(found))
    n = len(plain)
    spans = set()
    first, last = 0, 0
    for i in range(n):
        # [i, last) is the shortest run from unit i; [first, i] the shortest up to it
        while last < n and words[last] - words[i] < run_words:
            last += 1
        while words[i + 1] - words[first + 1] >= run_words:
            first += 1
        if words[i + 1] - words[i] >= min_words:
            spans.add((i, i + 1))
            continue
        if words[last] - words[i] >= run_words:
            spans.add((i, last))
        if words[i + 1] - words[first] >= run_words:
            spans.add((first, i + 1))
    out = []
    for i, j in sorted(spans):
        digest = hashlib.blake2b(" ".join(plain[i:j]).encode(), digest_size=16).digest()
        out.append((at[i][0], at[j - 1][1], words[j] - words[i], digest))
    return out


def _units(docs: DataFrame, min_words: int, run_words: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            ids, rows, at = batch.column(0), [], []

            def flush():
                start, end, n, digest = zip(*rows)
                return pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary())],
                    ["doc_id", "start", "end", "n_words", "digest"],
                )

            for i in range(batch.num_rows):
                found = runs(batch.column(1)[i].as_py(), min_words, run_words)
                rows += found
                at += [i] * len(found)
                if len(rows) >= OUT_UNITS:
                    yield flush()
                    rows, at = [], []
            if rows:
                yield flush()

    rows = docs.select("doc_id", text_of(docs).alias("text"))
    return rows.mapInArrow(cut, f"doc_id {kind}, start long, end long, n_words long, digest binary")


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """The runs to remove: doc_id, start, end, n_words, first_doc_id, first_start, occurrences."""
    found = stored(_units(docs, max(1, min_words), max(1, run_words)), "line-units")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "start")
    groups = found.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("occurrences"))
    groups = stored(groups.filter("occurrences > 1"), "line-groups")
    rows = attach(found, groups, "digest", "occurrences", F.lit(found.count())).filter("occurrences is not null")
    other = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("start") == F.col("first.start")))
    return rows.filter(other).select(
        "doc_id", "start", "end", "n_words",
        F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"), "occurrences",
    )


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """``docs`` with the repeated runs cut from the texts and ``removed``, their [start, end) in the original text, overlaps merged."""
    earlier = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = repeated_units(docs, min_words, run_words).select("doc_id", "start", "end").distinct()
    spans = spans.withColumn("opens", (F.col("start") > F.coalesce(F.max("end").over(earlier), F.lit(-1))).cast("long"))
    spans = spans.withColumn("island", F.sum("opens").over(earlier.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy(F.col("doc_id").alias("_doc")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_cut"))
    spans = stored(spans, "line-cuts")
    rows = docs.join(spans, docs["doc_id"].eqNullSafe(spans["_doc"]), "left")
    cut = F.coalesce("_cut", F.array().cast("array<struct<start:long,end:long>>"))
    begin = lambda i: F.when(i > 0, F.get(cut, i - 1)["end"]).otherwise(F.lit(0))
    stop = lambda i: F.coalesce(F.get(cut, i)["start"], F.length("text").cast("long"))
    pieces = F.transform(F.sequence(F.lit(0), F.size(cut)), lambda i: F.substring(docs["text"], (begin(i) + 1).cast("int"), (stop(i) - begin(i)).cast("int")))
    text = F.when(F.size(cut) == 0, docs["text"]).otherwise(F.array_join(pieces, ""))
    return rows.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns], cut.alias("removed"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_units(table(spark, sf_dir, "documents"))
