"""Operator 12: ranked lexical search, MaxScore with bounds of term pairs.

The index is a table of blocks of documents. A block holds, for each term of the queries, its posting list with
impacts (a term's share of a document's score) and the largest impact, and for chosen pairs of
terms the intersection list with joint impacts and the largest joint impact. Pairs are neighbours by
weight within a query, so each term of a query is in one pair at most.

A search runs over the blocks with the best ``k`` documents of each query so far:

* A threshold is the k-th best score so far, or the k-th best joint impact of one of the query's pairs in
  the block, whichever is larger: that many documents reach it.
* Terms are ordered by their largest impacts. The bound of the first terms adds up the
  pairs' joint maxima (or a single maximum, if that is larger) where both terms of a pair are among them, else single maxima.
  While it stays below the threshold, these terms alone lift no document: only the postings of the others give candidates.
* Candidates are completed term by term, and dropped as soon as their score and the bound of what is left stay below the threshold.

Skipping never drops a document that reaches the threshold, so the result is exact. Each task gives its
best ``k`` of each query; these are merged by salted, then by global ranks.

Queries come to the driver and to the tasks in groups of about QUERY_TERMS (query, term) pairs, one pass for each group;
a group's vocabulary, weights and best lists are bounded by that.

Defined cases: a null or empty text has no term; rows of ``items`` with one item_id (also null) are one query with the terms of
all, once each; a query without terms, or whose terms no document holds, has no result; repeated documents are results of their own;
doc_id is cast to BIGINT, a null one is smaller than all others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from contextlib import contextmanager
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salescope.llm.common import discard, ship, stored, table, text_of

ship(__name__)

#: (query, term) pairs of one pass over the documents.
QUERY_TERMS = 50_000
#: Postings of an index block.
BLOCK_POSTINGS = 40_000
SALTS = 64
#: Blocks that a task reads and hands to Python at a time: a row holds a whole block's lists, and the defaults are thousands of rows.
BLOCK_BATCH = 4

#: Byte by byte: A-Z lower-cased, other bytes of terms kept, the rest blank.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def _query_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term)."""
    kind = items.schema["item_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1)):
                found = sorted(set(terms_of(text.as_py())))
                if found:
                    ids = pa.array([item.as_py()] * len(found), batch.column(0).type)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.binary())], ["item_id", "term"])

    rows = items.select("item_id", text_of(items).cast("binary").alias("text"))
    return rows.mapInArrow(cut, f"item_id {kind}, term binary").distinct()


def _postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """One row per document with a term: doc_id, n (its terms with repeats), terms and counts of those in the vocabulary."""

    def describe(batches):
        for batch in batches:
            keep, sizes, terms, counts = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                found = terms_of(text.as_py())
                if found:
                    ids = np.fromiter(map(vocabulary.get, found, repeat(-1)), np.int32, len(found))
                    one, n = np.unique(ids[ids >= 0], return_counts=True)
                    keep.append(i)
                    sizes.append(len(found))
                    terms.append(one)
                    counts.append(n)
            if keep:
                ends = np.cumsum([0, *map(len, terms)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(keep)), pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(ends, np.concatenate(terms)),
                    pa.ListArray.from_arrays(ends, np.concatenate(counts).astype(np.int64)),
                ], ["doc_id", "n", "terms", "counts"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).cast("binary").alias("text"))
    return rows.mapInArrow(describe, "doc_id long, n long, terms array<int>, counts array<long>")


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts_of(weights: np.ndarray, counts: np.ndarray, sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 50 + (50 * sizes * n_docs) // n_terms
    return weights * ((1_000_000_000 * counts) // (1000 * counts + 20 * m))


def build_block(ids: np.ndarray, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray, pairs: list[tuple[int, int]]) -> dict:
    """Posting lists (documents by place, ascending) of each term, and the intersection lists of ``pairs``."""
    order = np.argsort(terms, kind="stable")
    terms, docs, impacts = terms[order], docs[order], impacts[order]
    starts = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else np.empty(0, np.int64)
    present = terms[starts]
    ends = np.append(starts[1:], len(terms))
    at = {int(t): slice(a, b) for t, a, b in zip(present, starts, ends)}
    place = np.full(len(ids), -1, np.int64)
    kept, joint_docs, joints = [], [], []
    last = None
    for a, b in pairs:
        if a in at and b in at:
            if a != last:
                if last is not None:
                    place[docs[at[last]]] = -1
                place[docs[at[a]]] = np.arange(at[a].start, at[a].stop)
                last = a
            both = docs[at[b]]
            where = place[both]
            hit = where >= 0
            if hit.any():
                kept.append((a, b))
                joint_docs.append(both[hit])
                joints.append(impacts[where[hit]] + impacts[at[b]][hit])
    sizes = [len(j) for j in joints]
    return {
        "terms": present, "starts": np.append(starts, len(terms)), "docs": docs, "impacts": impacts,
        "maxima": np.maximum.reduceat(impacts, starts) if len(starts) else np.empty(0, np.int64),
        "pair_first": np.array([p[0] for p in kept], np.int32), "pair_second": np.array([p[1] for p in kept], np.int32),
        "pair_starts": np.cumsum([0, *sizes]), "pair_docs": np.concatenate(joint_docs) if kept else np.empty(0, np.int32),
        "pair_impacts": np.concatenate(joints) if kept else np.empty(0, np.int64),
        "pair_maxima": np.array([j.max() for j in joints], np.int64),
    }


_LISTS = {"terms": "int", "starts": "long", "docs": "int", "impacts": "long", "maxima": "long", "pair_first": "int", "pair_second": "int",
          "pair_starts": "long", "pair_docs": "int", "pair_impacts": "long", "pair_maxima": "long"}


def _index(postings: DataFrame, weights: np.ndarray, pairs: list[tuple[int, int]], n_docs: int, n_terms: int) -> DataFrame:
    """One row per block: ids (doc_id by place) and the lists of ``build_block``."""

    def block(ids, sizes, lengths, terms, counts):
        docs = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
        found = build_block(ids, docs, terms, impacts_of(weights[terms], counts, sizes[docs], n_docs, n_terms), pairs)
        lists = [pa.array([found[k]], pa.list_(pa.int32() if t == "int" else pa.int64())) for k, t in _LISTS.items()]
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), *lists], ["ids", *_LISTS])

    def build(batches):
        held, n = [], 0
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy()
            # a batch may hold several blocks: cut it where the postings reach the bound
            cuts = np.cumsum(lengths) // BLOCK_POSTINGS
            for piece in np.unique(cuts):
                at = np.flatnonzero(cuts == piece)
                part = batch.slice(at[0], len(at))
                # a place may lack its doc_id: it travels as the smallest 64-bit number
                ids = part.column(0).fill_null(NO_ID).to_numpy()
                held.append((ids, part.column(1).to_numpy(), lengths[at], part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()))
                n += int(lengths[at].sum())
                if n >= BLOCK_POSTINGS:
                    yield block(*map(np.concatenate, zip(*held)))
                    held, n = [], 0
        if held:
            yield block(*map(np.concatenate, zip(*held)))

    schema = ", ".join(["ids array<long>", *[f"{k} array<{t}>" for k, t in _LISTS.items()]])
    return postings.filter(F.size("terms") > 0).mapInArrow(build, schema)


NO_ID = -(2**63)


class Best:
    """The best ``k`` documents of a query: highest scores, then smallest doc_id."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def threshold(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate((self.ids, ids)), np.concatenate((self.scores, scores))
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]


def prefix_bounds(maxima: list[int], partner: list[int], joint: list[int]) -> list[int]:
    """Entry i: most that the first i terms can add to a score. ``joint`` is the bound of a term and its partner together."""
    bounds, total = [0], 0
    for i, (most, other) in enumerate(zip(maxima, partner)):
        total += joint[i] - maxima[other] if 0 <= other < i else most
        bounds.append(total)
    return bounds


def search_block(block: dict, ids: np.ndarray, queries: list[np.ndarray], best: list[Best], slots: np.ndarray) -> int:
    """Add a block's documents to the best ones of each query; gives the number of postings read for candidates.

    The first and second, third and fourth, ... term of a query must be pairs the block was built for: one without a list has no document.

    ``slots`` is room for the place of each term of the vocabulary, all -1 between calls."""
    terms, starts, docs, impacts, maxima = (block[k] for k in ("terms", "starts", "docs", "impacts", "maxima"))
    slots[terms] = np.arange(len(terms))
    joint, reached = {}, {}
    k = best[0].k if best else 0
    ends = block["pair_starts"]
    for i, (a, b, top) in enumerate(zip(block["pair_first"].tolist(), block["pair_second"].tolist(), block["pair_maxima"].tolist())):
        joint[a, b] = top
        values = block["pair_impacts"][ends[i] : ends[i + 1]]
        if len(values) >= k:
            reached[a, b] = int(np.partition(values, len(values) - k)[len(values) - k])
    scores = np.zeros(len(ids), np.int64)
    read = 0
    for query, top in zip(queries, best):
        at = slots[query]
        here = np.flatnonzero(at >= 0)
        if not len(here):
            continue
        most = maxima[at[here]]
        order = np.argsort(most, kind="stable")
        spot = {int(here[o]): i for i, o in enumerate(order)}  # place in the query -> place in the order
        most, at = most[order].tolist(), at[here][order]
        partner, together = [-1] * len(most), [0] * len(most)
        threshold = top.threshold()
        for p in range(0, len(query) - 1, 2):
            i, j = spot.get(p), spot.get(p + 1)
            if i is not None and j is not None:
                pair = int(query[p]), int(query[p + 1])
                partner[i], partner[j] = j, i
                together[i] = together[j] = max(joint.get(pair, 0), most[i], most[j])
                threshold = max(threshold, reached.get(pair, 0))
        bounds = prefix_bounds(most, partner, together)
        first = len(most)
        while first and bounds[first] >= threshold:
            first -= 1
        # terms before ``first`` alone stay below the threshold
        if first == len(most):
            continue
        for t in at[first:]:
            span = slice(starts[t], starts[t + 1])
            scores[docs[span]] += impacts[span]
            read += span.stop - span.start
        found = np.flatnonzero(scores)
        total = scores[found]
        scores[found] = 0
        for i in range(first - 1, -1, -1):
            stays = total + bounds[i + 1] >= threshold
            found, total = found[stays], total[stays]
            if not len(found):
                break
            span = slice(starts[at[i]], starts[at[i] + 1])
            place = np.minimum(np.searchsorted(docs[span], found), span.stop - span.start - 1)
            total = total + np.where(docs[span][place] == found, impacts[span][place], 0)
        stays = (total >= threshold) & (total > 0)
        if stays.any():
            top.add(ids[found[stays]], total[stays])
    slots[terms] = -1
    return read


@contextmanager
def _few_rows_at_a_time(spark: SparkSession):
    keys = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, str(BLOCK_BATCH))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _search(index: DataFrame, queries: list[np.ndarray], size: int, k: int) -> DataFrame:
    """Best ``k`` documents of each query by each task: query (its number), doc_id, score."""

    def run(batches):
        best, slots = [Best(k) for _ in queries], np.full(size, -1, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                block = {name: batch.column(name)[i].values.to_numpy() for name in _LISTS}
                search_block(block, batch.column("ids")[i].values.to_numpy(), queries, best, slots)
        numbers = np.repeat(np.arange(len(best)), [len(b.ids) for b in best])
        ids = np.concatenate([b.ids for b in best])
        yield pa.RecordBatch.from_arrays([
            pa.array(numbers, pa.int32()), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(np.concatenate([b.scores for b in best]), pa.int64()),
        ], ["query", "doc_id", "score"])

    return index.mapInArrow(run, "query int, doc_id long, score long")


def _search_group(docs: DataFrame, group: DataFrame, k: int) -> DataFrame | None:
    """Results of a bounded group of queries (item_id, term)."""
    spark = docs.sparkSession
    found = group.groupBy("item_id").agg(F.collect_set("term").alias("terms")).collect()
    if not found:
        return None
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for row in found for t in row["terms"]}))}
    postings = stored(_postings(docs, vocabulary), "search-postings")
    n_docs, n_terms = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    weights = np.zeros(len(vocabulary), np.int64)
    for row in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[row["term"]] = term_weight(n_docs, row["count"])
    # neighbours in this order are a query's pairs
    queries = [np.array(sorted((vocabulary[bytes(t)] for t in row["terms"]), key=lambda t: (weights[t], t)), np.int64) for row in found]
    pairs = sorted({(int(q[p]), int(q[p + 1])) for q in queries for p in range(0, len(q) - 1, 2)})
    index = stored(_index(postings, weights, pairs, n_docs, n_terms), "search-index")
    with _few_rows_at_a_time(spark):
        hits = stored(_search(index, queries, len(vocabulary), k), "search-hits")
    discard(postings, index)
    ranked = hits
    for salt in (F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)), F.lit(0)):
        order = Window.partitionBy("query", salt).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        ranked = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, row["item_id"]) for i, row in enumerate(found)], f"query int, item_id {group.schema['item_id'].dataType.simpleString()}")
    return ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")  # names: at most QUERY_TERMS rows or so


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank, doc_id, score."""
    queries = stored(_query_terms(items), "search-queries")
    groups = max(1, -(-queries.count() // QUERY_TERMS))
    parts = [_search_group(docs, queries.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g), k) for g in range(groups)]
    out = docs.sparkSession.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    for part in parts:
        out = out if part is None else out.unionByName(part)
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, {_TERMS_SQL} AS terms FROM documents),
c AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d WHERE len(terms) > 0),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark)),
p AS (SELECT row_no, doc_id, n, term, count(*) AS tf FROM (SELECT row_no, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY row_no, doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
s AS (SELECT item_id, row_no, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM p JOIN w USING (term) JOIN q USING (term), c GROUP BY item_id, row_no, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""
