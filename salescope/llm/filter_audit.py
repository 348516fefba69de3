"""Operator 11: filter interaction audit over the lattice of filter subsets.

A state is the set of filters already applied; an edge adds one filter. A document is removed
on an edge if it fails the added filter and none of the state's. So the documents matter only by the set of
filters they fail: they are counted once per (part, failed set), 2^n cells a part, and the
edges get their figures from the cells.

* Forward counts: the orders that reach a state; backward counts: the orders that lead from it to
  the full set. Their product over an edge is the number of orders that take the edge.
* Shapley weights: the removals of a filter's edges, each times the orders that take it.
* The steps of every order are read from the same edges.

Whether a text is identical to one of a smaller doc_id is decided table-wide by groups of
SHA-256 digests, combined inside each task before the shuffle, so a text held by a third of
all rows is one row per task and part there.

Defined cases: a null text is empty, a null lang is the part "" (as an empty one); a null doc_id is
neither smaller nor larger than another, so it neither fails E nor makes others fail; rows that agree in doc_id and text are
documents of their own, none smaller than the other; several labels of a doc_id count as 1 if one is; rows of
``labels`` without a document are ignored; an empty table has no parts and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salescope.llm.common import UPPER, table, text_of, words

#: Letters of the filters; the bit of a filter in a state is its place here.
FILTERS = "ABCDE"
COPIES = FILTERS.index("E")


def text_failures(text: Column, found: Column) -> list[Column]:
    """Failure conditions A to D of a non-null text and its words."""
    count, distinct = F.size(found), F.size(F.array_distinct(found))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return [
        count < 100,
        distinct.cast("long") * 100 < count.cast("long") * 80,
        capitals.cast("long") * 100 > F.length(text).cast("long") * 10,
        text.rlike("[#$%&*|]"),
    ]


def _mask(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)])


def failure_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part and set of failed filters: part, failed, n, good, toxic."""
    text = text_of(docs)
    rows = docs.select(
        docs["doc_id"].alias("doc_id"), F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("part"),
        text.alias("text"), words(text).alias("words"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = rows.select("doc_id", "part", "digest", _mask(text_failures(F.col("text"), F.col("words"))).alias("failed"))
    marks = labels.groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).cast("int").alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int").alias("toxic"))
    # rows without a doc_id match no label: a salt spreads them
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.crc32("digest"), F.lit(4096))).otherwise(F.lit(0)).cast("int"))
    rows = rows.join(marks.withColumn("salt", F.lit(0)), ["doc_id", "salt"], "left").fillna(0, ["good", "toxic"])
    keys = ["salt", "digest", "part", "failed", "good", "toxic"]
    # repeated doc_ids come together first: then the rows with a group's smallest doc_id are one row
    same = rows.groupBy("doc_id", *keys).agg(F.count(F.lit(1)).alias("n"))
    named = F.col("doc_id").isNotNull()
    local = same.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0)).alias("unnamed"),
        F.min(F.when(named, F.struct("doc_id", "n"))).alias("first"))
    first = F.min("first.doc_id").over(Window.partitionBy("digest"))
    copies = local.withColumn("least", first)
    stay = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = F.explode(F.array(
        F.struct(F.col("failed").alias("failed"), stay.alias("n")),
        F.struct((F.col("failed") + F.lit(1 << COPIES)).alias("failed"), (F.col("n") - stay).alias("n"))))
    cells = copies.select("part", "good", "toxic", split.alias("c")).select("part", "good", "toxic", "c.*")
    return cells.groupBy("part", "failed").agg(
        F.sum("n").alias("n"), F.sum(F.col("good") * F.col("n")).alias("good"), F.sum(F.col("toxic") * F.col("n")).alias("toxic"))


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """Per state of n filters: the orders that reach it from the empty set, and that lead from it to the full set."""
    states, bits = 1 << n, [1 << i for i in range(n)]
    forward, backward = [0] * states, [0] * states
    forward[0] = backward[-1] = 1
    for s in range(1, states):
        forward[s] = sum(forward[s ^ b] for b in bits if s & b)
    for s in range(states - 2, -1, -1):
        backward[s] = sum(backward[s | b] for b in bits if not s & b)
    return forward, backward


def edge_figures(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part and lattice edge (state, filter), with the orders that take it and its figures."""
    n = len(filters)
    forward, backward = path_counts(n)
    edges = [(s, f, forward[s] * backward[s | 1 << f]) for s in range(1 << n) for f in range(n) if not s >> f & 1]
    lattice = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(o).alias("orders")) for s, f, o in edges]))
    rows = cells.select("*", lattice.alias("e")).select("part", "failed", "n", "good", "toxic", "e.*")
    bit = F.expr("shiftleft(1, filter)")
    fails, gone = F.col("failed").bitwiseAND(bit) != 0, F.col("failed").bitwiseAND(F.col("state")) != 0
    total = lambda condition, of="n": F.coalesce(F.sum(F.when(condition, F.col(of))), F.lit(0)).cast("long")
    return rows.groupBy("part", "state", "filter", "orders").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"),
        total(F.col("failed") == bit).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"))


def order_steps(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """Every order's steps as edges: filter_order, step, state, filter; len(filters)! * len(filters) rows."""
    rows = []
    for order in permutations(range(len(filters))):
        state = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(filters[i] for i in order), step, state, f))
            state |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, state int, filter int")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, with the step's figures and its filter's Shapley sum."""
    edges = edge_figures(failure_cells(docs, labels))
    of_filter = Window.partitionBy("part", "filter")
    edges = edges.withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(of_filter))
    steps = F.broadcast(order_steps(docs.sparkSession))  # 600 rows, whatever the input
    return edges.join(steps, ["state", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
m AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
     100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'),
     coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM d LEFT JOIN m ON d.doc_id = m.doc_id),
l AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, e.i, g.i] AS places FROM l a, l b, l c, l e, l g WHERE len(list_distinct([a.i, b.i, c.i, e.i, g.i])) = 5),
s AS (SELECT array_to_string(list_transform(places, lambda p: substr('ABCDE', p, 1)), '') AS filter_order, i AS step, places[i] AS place, places[1:i-1] AS earlier FROM o, l),
x AS (SELECT s.*, f.*, f.fails[place] AS failing, list_bool_or(list_concat([false], list_transform(earlier, lambda p: f.fails[p]))) AS gone,
    len(list_filter(f.fails, lambda v: v)) = 1 AS alone FROM s, f),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, place, count(*) FILTER (NOT gone AND NOT failing) AS kept,
    count(*) FILTER (NOT gone AND failing) AS removed, count(*) FILTER (gone AND failing) AS redundant,
    count(*) FILTER (failing AND alone) AS unique_fails,
    count(*) FILTER (NOT gone AND failing AND good = 1) AS good_lost, count(*) FILTER (NOT gone AND failing AND toxic = 1) AS toxic_lost
  FROM x GROUP BY part, filter_order, step, place)
SELECT * EXCLUDE (place), CAST(sum(removed) OVER (PARTITION BY part, place) AS BIGINT) AS shapley FROM r
"""
