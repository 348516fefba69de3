"""Operator 7: language-model scores by context-tree weighting over bytes.

A text is its UTF-8 bytes and an end byte FF (which no text holds). A byte is coded as eight binary
decisions, most significant bit first. Each (context, bits so far) node holds a Krichevsky-Trofimov
estimate from its counts, and weighting mixes a node's own estimate with
the product of its children's, over all context depths up to DEPTH bytes.

Counts cover all training texts: Spark counts the (DEPTH + 1)-grams of all of them. The model is a table of (context, bits so far)
nodes that grows with the corpus: a node is split off where it was met SPLIT times, whatever the size of the input. What was met less often
stays with the parent in one "rest" child, a leaf of the tree; nothing is left out of the counts. Weights go up the
tree by one grouping per depth and mixtures down by one join per depth, for the nodes of every distinct gram of the texts. The
probabilities of grams are broadcast to the texts, BROADCAST_GRAMS of them at a time: with more of them the texts are stored once and read once
for each part, up to PASSES parts; beyond, each gram of each text is joined by shuffle, which takes many times the input of disk. Scores are equal.
Scoring takes every byte of every text. ``ContextTree`` is the same model in memory, for small tables of whole contexts.

The base score is a smoothed unigram over words. Counts of frequent words (a bounded number by their share) are broadcast;
the other words are shuffled to theirs.

Defined cases: a null text is empty; the empty text is scored as its end alone; a document is
its row, repeated rows are scored each; without training rows all bytes are equally
likely; an empty table gives an empty result; other columns of the input do not matter.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.llm.common import attach, crc_mod, discard, ship, stored, table, text_of

ship(__name__)

DEPTH = 5
CONTEXTS = 32768
#: Times a node is met before it is split off its parent.
SPLIT = 2
BROADCAST_GRAMS = 4_000_000
#: Most parts of the grams that are broadcast one after another.
PASSES = 16
#: A gram's part is its remainder by this prime, which mixes its bytes, by the number of parts.
PART_PRIME = 1_000_003
END = 255
#: Bytes that are counted or scored together in a task.
CHUNK = 1 << 20
#: A gram has 48 bits, so it is sorted together with the number of its text in a run.
RUN_BITS = 15
RUN_TEXTS = 1 << RUN_BITS
#: Tokens with more than this share of all training tokens are met where they are; by counting, there are HOT_TOKENS at most.
HOT_TOKENS = 100_000
#: Distinct tokens that a task holds before it passes their counts on.
HELD_TOKENS = 1 << 18


def framed(texts: list) -> np.ndarray:
    """Bytes of the texts, each with DEPTH pads before it and the end behind it."""
    pad, end = bytes([END]) * DEPTH, bytes([END])
    return np.frombuffer(b"".join(x for t in texts for x in (pad, t, end)), np.uint8)


def places(texts: list) -> np.ndarray:
    """Positions in ``framed(texts)`` that are coded (texts and ends, not pads)."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return np.arange(sizes.sum()) + np.repeat(DEPTH * np.arange(1, len(texts) + 1), sizes)


def grouped(batch: pa.RecordBatch, column: int):
    """Rows of a batch in runs (first, texts) of about CHUNK bytes and at most RUN_TEXTS texts; a longer text is a run of its own."""
    first, texts, size = 0, [], 0
    for i in range(batch.num_rows):
        text = batch.column(column)[i].as_py().encode()
        if texts and (size + len(text) > CHUNK or len(texts) == RUN_TEXTS):
            yield first, texts
            first, texts, size = i, [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield first, texts


def grams_of(texts: list) -> np.ndarray:
    """Gram of each coded byte; a gram is DEPTH context bytes, oldest first, and the byte itself."""
    data = framed(texts)
    gram = np.zeros(len(data) - DEPTH, np.int64)
    for k in range(DEPTH, -1, -1):
        gram <<= 8
        gram |= data[DEPTH - k : len(data) - k]
    return gram[places(texts) - DEPTH]


def gram_counts(texts: DataFrame) -> DataFrame:
    """(gram, n) of all texts."""

    def count(batches):
        for batch in batches:
            for _, run in grouped(batch, 0):
                found, n = np.unique(grams_of(run), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["gram", "n"])

    return texts.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def context_table(texts: DataFrame, contexts: int = CONTEXTS) -> pd.DataFrame:
    """Counts (depth, context, byte, n) of the contexts that are split off, and of depth 0.

    At most (1 + DEPTH * ``contexts``) * 256 rows reach the driver, whatever the input's size.
    """
    grams = stored(gram_counts(texts), "lm-grams")
    every = [
        grams.groupBy(
            F.lit(d).alias("depth"), F.expr(f"shiftright(gram, 8) & {(1 << 8 * d) - 1}L").alias("context"), F.expr("gram & 255L").alias("byte")
        ).agg(F.sum("n").alias("n"))
        for d in range(DEPTH + 1)
    ]
    counts = stored(reduce(DataFrame.unionByName, every), "lm-contexts")
    total = counts.filter("depth = 0").agg(F.sum("n")).first()[0] or 0
    large = counts.groupBy("depth", "context").agg(F.sum("n").alias("all")).filter(F.col("all") * contexts > total)
    return counts.join(F.broadcast(large), ["depth", "context"]).select("depth", "context", "byte", "n").toPandas()


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def bit_counts(byte_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of the 255 bit nodes (heap order) from 256 byte counts per row."""
    zero, one = np.zeros((len(byte_counts), 255)), np.zeros((len(byte_counts), 255))
    for level in range(8):
        sums = byte_counts.reshape(len(byte_counts), 2 << level, 128 >> level).sum(axis=2)
        zero[:, (1 << level) - 1 : (2 << level) - 1] = sums[:, 0::2]
        one[:, (1 << level) - 1 : (2 << level) - 1] = sums[:, 1::2]
    return zero, one


def kt(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of the counts."""
    return log_gamma(zero + 0.5) + log_gamma(one + 0.5) - log_gamma(zero + one + 1) - math.log(math.pi)


class ContextTree:
    """``child[row, older byte]``: row of the longer context or -1; ``bits[row, byte]``: log2 probability."""

    def __init__(self, counts: pd.DataFrame):
        index, n = {(0, 0): 0}, 1
        for d, c in sorted(set(zip(counts["depth"].tolist(), counts["context"].tolist()))):
            if (d, c) not in index:
                index[d, c] = n
                n += 1
        own = np.zeros((n, 256), np.float64)
        rows = [index[k] for k in zip(counts["depth"].tolist(), counts["context"].tolist())]
        own[rows, counts["byte"].to_numpy(int)] = counts["n"].to_numpy(float)
        self.child = np.full((n, 256), -1, np.int32)
        parent = np.full(n, -1)
        for (d, c), r in index.items():
            if d:
                up = index[d - 1, c & ((1 << 8 * (d - 1)) - 1)]
                self.child[up, c >> 8 * (d - 1)] = r
                parent[r] = up
        depth = np.zeros(n, int)
        for (d, _), r in index.items():
            depth[r] = d
        weighted, stop, pred, rest_pred = (np.zeros((n, 255)) for _ in range(4))
        for d in range(DEPTH, -1, -1):
            at = np.flatnonzero(depth == d)
            kids = np.flatnonzero(depth == d + 1)
            rest, below = own.copy() if len(kids) else own, np.zeros((n, 255))
            if len(kids):
                np.subtract.at(rest, parent[kids], own[kids])
                np.add.at(below, parent[kids], weighted[kids])
            has = np.isin(at, parent[kids]) if len(kids) else np.zeros(len(at), bool)
            z, o = bit_counts(own[at])
            e = kt(z, o)
            pred[at] = (o + 0.5) / (z + o + 1)
            rz, ro = bit_counts(rest[at])
            split = np.where(has[:, None], below[at] + kt(rz, ro), -np.inf)
            rest_pred[at] = (ro + 0.5) / (rz + ro + 1)
            both = np.logaddexp(e, split) - math.log(2)
            weighted[at] = np.where(has[:, None], both, e)
            stop[at] = np.where(has[:, None], np.exp(e - math.log(2) - both), 1.0)
        # mixture from the root down: what the path has left goes to the child, or to the rest leaf
        left, mix = np.ones((n, 255)), np.zeros((n, 255))
        for r in sorted(range(n), key=lambda r: depth[r]):
            if parent[r] >= 0:
                left[r], mix[r] = left[parent[r]] * (1 - stop[parent[r]]), mix[parent[r]]
            mix[r] = mix[r] + left[r] * stop[r] * pred[r]
        final = mix + left * (1 - stop) * rest_pred
        self.bits = np.zeros((n, 256), np.float32)
        for byte in range(256):
            node = 0
            for level in range(7, -1, -1):
                bit = byte >> level & 1
                self.bits[:, byte] += np.log2(final[:, node] if bit else 1 - final[:, node])
                node = 2 * node + 1 + bit

    def score(self, texts: list) -> np.ndarray:
        """log10 probability of each text with its end."""
        out = np.zeros(len(texts))
        for k, text in enumerate(texts):
            # a long text is scored in overlapping chunks
            data = framed([text])
            for lo in range(DEPTH, len(data), CHUNK):
                part = data[lo - DEPTH : lo + CHUNK]
                at = np.arange(DEPTH, len(part))
                row = np.zeros(len(at), np.int32)
                on = np.ones(len(at), bool)
                for d in range(1, DEPTH + 1):
                    longer = self.child[row, part[at - d]]
                    on &= longer >= 0
                    row = np.where(on, longer, row)
                out[k] += float(self.bits[row, part[at]].sum(dtype=np.float64))
        return out * math.log10(2)


def met_grams(texts: DataFrame) -> DataFrame:
    """(gram, met, n) of ``texts`` (text, train): times met in all texts and in those under train."""

    def count(batches):
        for batch in batches:
            learnt = batch.column(1)
            for first, run in grouped(batch, 0):
                sizes = [len(t) + 1 for t in run]
                flags = np.array([bool(learnt[first + i].as_py()) for i in range(len(run))])
                found, n = np.unique(grams_of(run) << 1 | np.repeat(flags, sizes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found >> 1), pa.array(n.astype(np.int64)), pa.array(n * (found & 1))], ["gram", "met", "n"])

    counts = texts.mapInArrow(count, "gram long, met long, n long")
    return counts.groupBy("gram").agg(F.sum("met").alias("met"), F.sum("n").alias("n"))


def log_gamma_of(x: Column) -> Column:
    """``log_gamma`` as an expression."""
    y, shift = x + 8, reduce(lambda a, b: a * b, [x + k for k in range(8)])
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - F.log(shift)


def kt_of(zero: Column, one: Column) -> Column:
    return log_gamma_of(zero + 0.5) + log_gamma_of(one + 0.5) - log_gamma_of(zero + one + 1.0) - math.log(math.pi)


def gram_scores(grams: DataFrame, split: int = SPLIT) -> DataFrame:
    """(gram, met, bits): log10 probability of the last byte of each gram after the others.

    A node is context << 8 | heap number of the bits so far (1 for none); in depth d it has 8 * (d + 1) bits, so
    the node of the next shorter context is its lower 8 * d bits.
    """
    way = F.explode(F.expr("""transform(sequence(0, 7), k -> struct(
        (shiftleft(shiftright(gram, 8), 8) | shiftleft(1, k) | shiftright(gram & 255L, 8 - k)) as node,
        shiftright(gram & 255L, 7 - k) & 1L as bit))""")).alias("s")
    steps = grams.select("gram", "met", "n", way).select("gram", "met", "n", "s.*")
    own = steps.groupBy("node").agg(F.sum(F.col("n") * (1 - F.col("bit"))).alias("z"), F.sum(F.col("n") * F.col("bit")).alias("o"))
    nothing = F.lit(0).cast("long")
    levels = {DEPTH: stored(own.select("node", "z", "o", nothing.alias("kids"), F.col("z").alias("rz"), F.col("o").alias("ro"), F.lit(0.0).alias("below")), "lm-nodes")}
    z, o = F.col("z"), F.col("o")
    here = kt_of(z, o)
    under = F.col("below") + kt_of(F.col("rz"), F.col("ro"))
    # log(exp(a) + exp(b)) by the larger one
    both = F.greatest("_here", "_under") + F.log1p(F.exp(-F.abs(F.col("_here") - F.col("_under")))) - math.log(2)
    for d in range(DEPTH, 0, -1):
        kids = levels[d].withColumns({"_here": here, "_under": under, "_off": z + o >= split})
        kids = kids.withColumn("_w", F.when(F.col("kids") > 0, both).otherwise(F.col("_here")))
        off = lambda c: F.sum(F.when(F.col("_off"), F.col(c)))
        up = kids.groupBy(F.expr(f"node & {(1 << 8 * d) - 1}L").alias("node")).agg(
            F.sum("z").alias("z"), F.sum("o").alias("o"), F.count_if("_off").alias("kids"),
            (F.sum("z") - F.coalesce(off("z"), nothing)).alias("rz"), (F.sum("o") - F.coalesce(off("o"), nothing)).alias("ro"),
            F.coalesce(off("_w"), F.lit(0.0)).alias("below"),
        )
        levels[d - 1] = stored(up, "lm-nodes")
    # from the root down: what the path has left goes to the child, or to the rest leaf
    down = None
    for d in range(DEPTH + 1):
        rows = levels[d].withColumns({
            "_stop": F.when(F.col("kids") > 0, 1 / (1 + F.exp(under - here))).otherwise(1.0),
            "_pred": (o + 0.5) / (z + o + 1), "_rest": (F.col("ro") + 0.5) / (F.col("rz") + F.col("ro") + 1),
        })
        if down is None:
            rows = rows.withColumns({"_mix": F.lit(0.0), "_left": F.lit(1.0), "_p": F.lit(0.5), "_off": F.lit(True)})
        else:
            rows = rows.withColumns({"_up": F.expr(f"node & {(1 << 8 * d) - 1}L"), "_off": z + o >= split}).join(down.hint("shuffle_hash"), "_up")
        mix, left = F.col("_mix") + F.col("_left") * F.col("_stop") * F.col("_pred"), F.col("_left") * (1 - F.col("_stop"))
        one = F.when(F.col("_off"), mix + left * F.col("_rest")).otherwise(F.col("_p"))
        down = rows.select(F.col("node").alias("_up"), mix.alias("_mix"), left.alias("_left"), one.alias("_p"))
    # a context has 255 nodes at most
    nodes = F.collect_list(F.struct(F.expr("node & 255L").alias("m"), "_p"))
    ways = down.select(F.col("_up").alias("node"), "_p").groupBy(F.expr("shiftright(node, 8)").alias("_c")).agg(F.map_from_entries(nodes).alias("_ways"))
    found = grams.withColumn("_c", F.expr("shiftright(gram, 8)")).join(ways.hint("shuffle_hash"), "_c")
    scores = found.select("gram", "met", F.expr("""aggregate(sequence(0, 7), 0D, (sum, k) -> sum + log10(
        if(shiftright(gram & 255L, 7 - k) & 1L = 1L, _ways[shiftleft(1L, k) | shiftright(gram & 255L, 8 - k)],
           1D - _ways[shiftleft(1L, k) | shiftright(gram & 255L, 8 - k)])))""").alias("bits"))
    scores = stored(scores, "lm-bits")
    discard(*levels.values())
    return scores


def ctw_scores(docs: DataFrame, train: Column, keep: list, split: int = SPLIT, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """``keep`` columns of ``docs`` with score and n_bytes; texts under ``train`` are learnt."""
    text = text_of(docs)
    grams = stored(met_grams(docs.select(text.alias("text"), F.coalesce(train, F.lit(False)).alias("train"))), "lm-grams")
    table = gram_scores(grams, split)
    discard(grams)
    n_bytes = F.octet_length(text).cast("long").alias("n_bytes")
    n = table.count()
    if n <= broadcast_grams:
        return docs.select(*keep, n_bytes, broadcast_scores(text, table)[0])
    if n > PASSES * broadcast_grams:
        return joined_scores(docs.select(*keep, n_bytes, text.alias("_text")), table)
    return scores_in_parts(docs.select(*keep, n_bytes, text.alias("_text")), table, -(-n // broadcast_grams))


def broadcast_scores(text: Column, table: DataFrame, part: int = 0, parts: int = 1) -> tuple[Column, Broadcast]:
    """The score of ``text`` by the grams of ``table`` (gram, bits), and their broadcast; of its grams in one of ``parts``, if there are more."""
    found = table.select("gram", "bits").toArrow()  # about BROADCAST_GRAMS rows at most
    gram, bits = found["gram"].to_numpy(), found["bits"].to_numpy()
    order = np.argsort(gram)
    shared = table.sparkSession.sparkContext.broadcast((gram[order], bits[order]))

    def score(texts: pd.Series) -> pd.Series:
        gram, bits = shared.value
        out = []
        for _, run in grouped(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]), 0):
            number = np.repeat(np.arange(len(run)), [len(t) + 1 for t in run])
            own = grams_of(run)
            if parts > 1:
                mine = own % PART_PRIME % parts == part
                own, number = own[mine], number[mine]
            if not len(own):
                out.append(np.zeros(len(run)))
                continue
            met = np.sort(own << RUN_BITS | number)
            found = met >> RUN_BITS
            first = np.concatenate([[0], np.flatnonzero(found[1:] != found[:-1]) + 1])
            # each gram of the run is looked up once, in ascending order
            once = bits[np.searchsorted(gram, found[first])]
            each = np.repeat(once, np.diff(first, append=len(found)))
            out.append(np.bincount(met & (RUN_TEXTS - 1), each, len(run)))
        return pd.Series(np.concatenate(out) if out else np.empty(0))

    return F.pandas_udf(score, "double")(text).alias("score"), shared


def scores_in_parts(docs: DataFrame, table: DataFrame, parts: int) -> DataFrame:
    """``docs`` without _text and with the score; ``parts`` parts of ``table`` (gram, bits) are broadcast one after another."""
    names = [c for c in docs.columns if c != "_text"]
    rows = stored(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*names).alias("_doc"), "_text"), "lm-texts")
    found = []
    for part in range(parts):
        score, shared = broadcast_scores(F.col("_text"), table.filter(F.col("gram") % PART_PRIME % parts == part), part, parts)
        found.append(stored(rows.select("_row", score), "lm-part"))
        shared.unpersist()
    sums = reduce(DataFrame.unionByName, found).groupBy("_row").agg(F.sum("score").alias("score"))
    out = stored(rows.select("_row", "_doc").join(sums.hint("merge"), "_row").select("_doc.*", "score"), "lm-sums")
    discard(rows, *found)
    return out


def joined_scores(docs: DataFrame, table: DataFrame) -> DataFrame:
    """``docs`` without _text and with the score by a join of their grams with ``table`` (gram, met, bits)."""
    names = [c for c in docs.columns if c != "_text"]
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "_text", F.struct(*names).alias("_doc"))
    kind = rows.schema["_doc"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            for first, run in grouped(batch, 1):
                for i, text in enumerate(run, first):
                    found, n = np.unique(grams_of([text]), return_counts=True)
                    row = np.full(len(found), batch.column(0)[i].as_py(), np.int64)
                    # the columns of the document stand at its first gram
                    doc = batch.column(2).take(pa.array([i] + [None] * (len(found) - 1), pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(found), pa.array(n.astype(np.int64)), doc], ["_row", "gram", "c", "_doc"])

    cuts = rows.mapInArrow(cut, f"_row long, gram long, c long, _doc {kind}")
    found = attach(cuts, table, "gram", "met", F.lit(table.agg(F.coalesce(F.sum("met"), F.lit(0))).first()[0]))
    sums = found.groupBy("_row").agg(F.first("_doc", True).alias("_doc"), F.sum(F.col("c") * F.col("bits")).alias("score"))
    return sums.select("_doc.*", "score")


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, c) of ``texts`` (text): words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and an end each, which is no word.

    On bytes, ``lower`` and ``split`` of Python know ASCII alone and just these blanks.
    """

    def table(n):
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["token", "c"])

    def count(batches):
        for batch in batches:
            n = Counter()
            for _, run in grouped(batch, 0):
                for text in run:
                    n.update(text.lower().split())
                n[b"\n"] += len(run)
                if len(n) > HELD_TOKENS:
                    yield table(n)
                    n = Counter()
            yield table(n)

    return texts.mapInArrow(count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def unigram_scores(rows: DataFrame, key: str) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score); ``rows`` has ``key``, text and train."""
    vocabulary = stored(token_counts(rows.filter("train").select("text")), "lm-words")
    n, v = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    often = vocabulary.filter(F.col("c") * HOT_TOKENS > n).toArrow()  # HOT_TOKENS rows at most
    logs = zip(often["token"].to_pylist(), np.log10(often["c"].to_numpy() + 0.1).tolist())
    hot = rows.sparkSession.sparkContext.broadcast(dict(logs))

    def cut(batches):
        # a row with the sum over a text's frequent tokens, and one for each other token
        known = hot.value
        for batch in batches:
            for first, run in grouped(batch, 1):
                at, token, times, hot_n, hot_sum = [], [], [], [], []
                for i, text in enumerate(run, first):
                    found = Counter(text.lower().split())
                    found[b"\n"] += 1
                    rare = [w for w in found if w not in known]
                    met = [(k, known[w]) for w, k in found.items() if w in known]
                    # no word begins like this, so the sum meets no count, and sums are spread over the shuffle
                    token += [b"\n%d:%d" % (i, len(text)), *rare]
                    at += [i] * (1 + len(rare))
                    times += [0, *(found[w] for w in rare)]
                    hot_n += [sum(k for k, _ in met), *[0] * len(rare)]
                    hot_sum += [math.fsum(k * x for k, x in met), *[0.0] * len(rare)]
                columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(token, pa.binary()), pa.array(times, pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(hot_n, pa.int64()), pa.array(hot_sum, pa.float64())], [key, "token", "k", "hot_n", "hot_sum"]
                )

    kind = rows.schema[key].dataType.simpleString()
    parts = rows.select(key, "text").mapInArrow(cut, f"{key} {kind}, token binary, k long, hot_n long, hot_sum double")
    found = parts.join(vocabulary.hint("shuffle_hash"), "token", "left")
    n_tokens, below = F.sum(F.col("hot_n") + F.col("k")), math.log10(n + 0.1 * (v + 1))
    sums = F.sum(F.col("hot_sum") + F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.1))
    return found.groupBy(key).agg(
        n_tokens.alias("n_tokens"),
        F.sum(F.col("hot_n") + F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (sums - n_tokens * below).alias("base_score"),
    )


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    train = crc_mod(docs["doc_id"], 10) != 0
    scored = docs.withColumns({"train": train, "row": F.monotonically_increasing_id()})
    scores = stored(ctw_scores(scored, F.col("train"), ["row", "doc_id", "train"]), "lm-scores")
    base = unigram_scores(scored.select("row", text_of(scored).alias("text"), "train"), "row")
    return scores.join(base, "row").select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"
    )
