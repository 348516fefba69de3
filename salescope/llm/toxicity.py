"""Operator 4: a counterfactual-regularised toxicity classifier.

A sparse logistic model over the distinct words of a text and their beginnings (3 to 5
letters, for compounds and inflected forms), hashed to 2^BITS features. It is
fitted on a bounded sample of labelled rows (``sample``: half of it of either label at most, the rows with the smallest
hash of doc_id). For each training text that names a group, a copy with the identity terms swapped
for another group's is made for each other term, with the features that the swapped text would have (words and their beginnings), and the
squared change of the score's argument is penalised: the model cannot lean on which group is named. An L1 term keeps only the words that matter, so
long texts do not gather noise. Scoring reads every whole text.

Terms that may stand for each other are those of IDENTITY (English) and, for texts in any language, groups found in the training
texts (``identity_groups``): names that fill the same place between the same neighbours, about as often under either label.

Defined cases: a null or empty text has the model's base rate as its score; a document with several
labels, a null label or a null doc_id does not train more than once or not at all; of several texts of a doc_id the
greatest trains; without usable labels of both
classes every score is 0; repeated rows are scored each; an empty table gives an empty
result; texts without terms of a group have no counterfactual; other columns of the input do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.llm.common import crc_mod, ship, stored, table, text_of

ship(__name__)

BITS = 18
SAMPLE = 8000
THRESHOLD = 0.7
STEMS = (3, 4, 5)
TOKEN = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[.!?\n]+")
#: Found terms: at most TERMS, each in at most COMMON of the training rows, and at most LIKE times as often under one label as under the other.
TERMS, COMMON, LIKE = 512, 0.25, 3
#: A found term fills its place in SLOT_ROWS rows at least; at most RING terms are swapped for each other.
SLOT_ROWS, RING = 3, 4
#: Rows whose features are worked on together in a fit.
BLOCK = 512
#: Identity terms that may stand for each other.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("black", "white", "asian", "latino"),
    ("muslim", "christian", "jewish", "hindu"),
    ("muslims", "christians", "jews", "hindus"),
    ("gay", "straight", "lesbian", "transgender"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
)


def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) & ((1 << BITS) - 1)


def tokens(text: str) -> set:
    return set(TOKEN.findall(text.lower()))


class Model(NamedTuple):
    weights: dict
    bias: float
    n_counterfactuals: int
    groups: tuple


def parts(word: str) -> list[int]:
    return [bucket(word)] + [bucket("^" + word[:k]) for k in STEMS if len(word) > k]


def numbered(found: set) -> list[int]:
    """Features of a text with the words ``found``."""
    return sorted({f for w in found for f in parts(w)})


def features(text: str) -> list[int]:
    return numbered(tokens(text))


def turns(identity=IDENTITY) -> list[dict]:
    """Term -> other term, one dictionary for each distance within the groups."""
    return [{a: g[(i + by) % len(g)] for g in identity for i, a in enumerate(g)} for by in range(1, max(map(len, identity)))]


def changes(text: str, others: list[dict]) -> list:
    """(features lost, features gained) of the counterfactuals of a text that names a group, one after the other."""
    found = tokens(text)
    out, own = [], None
    for other in others:
        swapped = {other.get(w, w) for w in found}
        if swapped == found:
            continue
        if own is None:
            own = Counter(f for w in found for f in parts(w))
        moved = Counter(f for w in swapped - found for f in parts(w))
        moved.subtract(f for w in found - swapped for f in parts(w))
        out.append(sorted(f for f, n in moved.items() if n < 0 and own[f] + n == 0))
        out.append(sorted(f for f, n in moved.items() if n > 0 and own[f] == 0))
    return out


def identity_groups(texts: DataFrame, rows: int, toxic_rows: int, seen: int = 5) -> tuple:
    """Groups of terms found in the training ``texts`` (text, toxic), of which ``rows`` there are.

    A term occurs in ``seen`` rows of either label at least. Terms whose most frequent place, between the same two
    neighbours of a sentence, is the same form a group, cut into rings of RING terms by their frequency. Only the counts of at most TERMS
    terms reach the driver.
    """

    def count(batches):
        for batch in batches:
            n = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in tokens(text):
                    n.setdefault(w, [0, 0])[toxic] += 1
            words, by = list(n), np.array(list(n.values()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(by[:, 0]), pa.array(by[:, 1])], ["term", "clean", "toxic"])

    counts = texts.select("text", "toxic").mapInArrow(count, "term string, clean long, toxic long")
    counts = counts.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    per_toxic, per_clean = F.col("toxic") * (rows - toxic_rows), F.col("clean") * toxic_rows
    fixed = sorted({w for g in IDENTITY for w in g})
    usable = (
        (F.least("clean", "toxic") >= seen) & (F.col("clean") + F.col("toxic") <= COMMON * rows)
        & (per_toxic <= LIKE * per_clean) & (per_clean <= LIKE * per_toxic) & ~F.col("term").isin(fixed)
    )
    often = counts.filter(usable).select("term", (F.col("clean") + F.col("toxic")).alias("n")).orderBy(F.desc("n"), "term").limit(TERMS)
    order = {r.term: k for k, r in enumerate(often.collect())}
    if not order:
        return ()
    terms = frozenset(order)

    def places(batches):
        for batch in batches:
            n = Counter()
            for text in batch.column(0).to_pylist():
                found = set()
                for sentence in SENTENCE.split(text.lower()):
                    line = ["", *TOKEN.findall(sentence), ""]
                    if len(line) == 3:
                        continue  # a word alone has no neighbours
                    found.update((w, line[i - 1] + " " + line[i + 1]) for i, w in enumerate(line) if w in terms)
                n.update(found)
            columns = [pa.array([t for t, _ in n], pa.string()), pa.array([p for _, p in n], pa.string()), pa.array(list(n.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["term", "place", "n"])

    met = texts.select("text").mapInArrow(places, "term string, place string, n long").groupBy("term", "place").agg(F.sum("n").alias("n"))
    best = met.groupBy("term").agg(F.max(F.struct("n", "place")).alias("b")).filter(F.col("b.n") >= SLOT_ROWS)
    at: dict = {}
    for r in sorted(best.select("term", "b.place").collect(), key=lambda r: order[r.term]):
        at.setdefault(r.place, []).append(r.term)
    rings = [g[k : k + RING] for _, g in sorted(at.items()) for k in range(0, len(g), RING)]
    return tuple(tuple(g) for g in rings if len(g) > 1)


class Rows:
    """Binary rows in compressed form, worked on in blocks."""

    def __init__(self, at: np.ndarray, size: np.ndarray):
        self.n, self.at, self.size = len(size), at, size
        self.start = np.concatenate([[0], np.cumsum(size)])

    @classmethod
    def of(cls, rows: list) -> Rows:
        return cls(np.concatenate([*(np.asarray(r, np.int32) for r in rows), np.empty(0, np.int32)]), np.fromiter(map(len, rows), np.int64, len(rows)))

    @classmethod
    def of_lists(cls, lists: pa.ListArray) -> Rows:
        """The rows of an Arrow column of lists, whose values are taken over as they are."""
        return cls(lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64))

    def some(self, rows: np.ndarray) -> Rows:
        """The rows marked in ``rows``."""
        return Rows(self.at[np.repeat(rows, self.size)], self.size[rows])

    def numbered(self, used: np.ndarray, number: np.ndarray) -> Rows:
        """The features marked in ``used``, under the numbers given by ``number``."""
        kept = used[self.at]
        ends = np.concatenate([[0], np.cumsum(kept)])[self.start]
        return Rows(number[self.at[kept]], np.diff(ends))

    def blocks(self):
        for lo in range(0, self.n, BLOCK):
            hi = min(lo + BLOCK, self.n)
            yield slice(lo, hi), self.at[self.start[lo] : self.start[hi]], self.size[lo:hi]

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for rows, at, size in self.blocks():
            out[rows] = np.bincount(np.repeat(np.arange(len(size)), size), w[at], len(size))
        return out

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        for rows, at, n in self.blocks():
            out += np.bincount(at, np.repeat(g[rows], n), size)
        return out


def fit(
    rows: list | Rows, labels: np.ndarray, swaps: list | tuple[Rows, Rows], penalty: float = 1.0, l1: float = 1e-3, steps: int = 300, seen: int = 5
) -> tuple[np.ndarray, float]:
    """Weights and bias, by accelerated proximal gradient, over features that ``seen`` rows have at least.

    ``swaps`` has (features lost, features gained) of all counterfactuals, as a list of pairs or as two ``Rows``. A row has a feature once.
    """
    x = rows if isinstance(rows, Rows) else Rows.of(rows)
    one, two = swaps if isinstance(swaps, tuple) else (Rows.of([s[k] for s in swaps]) for k in (0, 1))
    # a penalised swap changes a score only through the features that differ
    differ = one.size + two.size > 0
    one, two = one.some(differ), two.some(differ)
    n_turned = one.n
    often = np.bincount(x.at, minlength=1 << BITS) >= seen
    often[one.at] = often[two.at] = True
    used, size = np.flatnonzero(often), int(often.sum())
    number = (np.cumsum(often) - 1).astype(np.int32)
    x, one, two = (r.numbered(often, number) for r in (x, one, two))
    y = labels.astype(float)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, b = np.zeros(size), 0.0
    v, c, t = w, b, 1.0
    # bound of the curvature by power iteration, from a start that no swap leaves unchanged
    p = np.random.default_rng(0).normal(size=size)
    p /= np.linalg.norm(p)
    for _ in range(30):
        q = x.back(weight * x.dot(p), size) * 0.25
        if n_turned:
            q += penalty / n_turned * (one.back(d := one.dot(p) - two.dot(p), size) - two.back(d, size))
        top = np.linalg.norm(q)
        p = q / max(top, 1e-12)
    rate = 1.0 / (1.3 * top + 0.5)
    for _ in range(steps):
        error = weight * (1 / (1 + np.exp(-np.clip(x.dot(v) + c, -40, 40))) - y)
        g = x.back(error, size)
        if n_turned:
            d = one.dot(v) - two.dot(v)
            g += penalty / n_turned * (one.back(d, size) - two.back(d, size))
        new = v - rate * g
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        new_b = c - rate * error.sum()
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / later * (new - w), new_b + (t - 1) / later * (new_b - b)
        w, b, t = new, new_b, later
    whole = np.zeros(1 << BITS)
    whole[used] = w
    return whole, float(b)


def train(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> Model | None:
    """The fitted model, with the number of counterfactuals and the groups found; ``usable`` is a condition on doc_id."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).filter(usable)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = docs.select("doc_id").join(known, "doc_id").dropDuplicates(["doc_id"])
    half = lambda y: ids.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2)
    picked = stored(half(0).unionByName(half(1)), "toxic-sample")
    texts = docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(picked), "doc_id")
    texts = stored(texts.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")), "toxic-texts")
    n, n_toxic = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < n_toxic < n:
        return None
    groups = identity_groups(texts, n, n_toxic)
    others = turns(IDENTITY + groups)
    found = F.pandas_udf(lambda s: s.map(features), "array<int>")
    turned = F.pandas_udf(lambda s: s.map(lambda t: changes(t, others)), "array<array<int>>")
    # ``sample`` rows at most; they stay in the few arrays that they come in
    rows = texts.select("toxic", found("text").alias("f"), turned("text").alias("t")).toArrow().combine_chunks()
    labels = rows["toxic"].to_numpy()
    x, pairs = Rows.of_lists(rows["f"].chunk(0)), Rows.of_lists(rows["t"].chunk(0).flatten())
    del rows
    lost = np.arange(pairs.n) % 2 == 0
    swaps = pairs.some(lost), pairs.some(~lost)
    del pairs
    w, b = fit(x, labels, swaps)
    return Model({int(i): float(w[i]) for i in np.flatnonzero(w)}, b, swaps[0].n, groups)


def toxicity(docs: DataFrame, model: Model | None) -> Column:
    """Score column (0 to 1) of the text of ``docs``."""
    if model is None:
        return F.lit(0.0)
    weights, bias = model.weights, model.bias

    def score(texts: pd.Series) -> pd.Series:
        get = weights.get
        total = [bias + sum(get(i, 0.0) for i in features(t)) for t in texts]
        return pd.Series(1 / (1 + np.exp(-np.clip(total, -40, 40))))

    return F.pandas_udf(score, "double")(text_of(docs))


def trainable(doc_id: Column) -> Column:
    return crc_mod(doc_id, 3) != 1


def drop_toxic(docs: DataFrame, labels: DataFrame, usable: Column, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose score stays below ``threshold``."""
    model = train(docs, labels, usable)
    return docs.withColumn("_score", toxicity(docs, model)).filter(F.col("_score") < threshold).select(*docs.columns)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, trainable(F.col("doc_id")))
    rows = docs.select("doc_id", (crc_mod(docs["doc_id"], 3) == 1).alias("held_out"), toxicity(docs, model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
