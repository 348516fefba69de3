"""Loading derived star rows into existing star tables.

Two modes:

* ``insert_new`` (default): keys already present are skipped row by row;
  everything else is appended. Set-based, no ordering between files beyond
  "first file wins" for a key offered by several files.
* ``strict``: what a per-file transactional append does. Files are taken in
  name order; if any invoice of a file already exists (in the table or in an
  earlier *accepted* file) the whole invoice batch of that file is rejected;
  the file's lines are rejected as a whole if one of them already exists or
  refers to an invoice that is not present at that point. Countries and
  products are upserted regardless.

Strict acceptance is sequential by definition (a file's fate depends on the
fate of earlier files). It is computed as a fixpoint over only the keys that
several files share: each round, per key, the smallest file still in the
running and the smallest accepted file are found (grouped min, skew-safe);
a file whose keys all name it first is accepted, a file with a key already
taken by an earlier accepted file is rejected. The smallest undecided file is
always decided, and in practice all files are decided in one or two rounds.
State is checkpointed to the shared checkpoint folder between rounds.
Chains (each file shares a key with the next) need a round per link, so up to FOLD_PAIRS
(file, shared key) pairs, a counted bound, are instead decided by one ordered pass in one task.
"""

from __future__ import annotations

import sys
from itertools import groupby

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.session import ensure_checkpoint_dir
from salescope.operators.star import in_int32, star_invoice_lines, star_invoices, whole_invoice_no


# executors may not have this package: its functions travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Most (file, shared key) pairs that one task decides in order.
FOLD_PAIRS = 1_000_000


def fresh_countries(old: DataFrame, new: DataFrame) -> DataFrame:
    """Countries not in the table yet (the rows an append writes)."""
    return new.select("country").join(old.select("country"), "country", "left_anti")


def upsert_countries(old: DataFrame, new: DataFrame) -> DataFrame:
    """L3: countries are a key-only table; add the new ones."""
    return fresh_countries(old, new).unionByName(old.select("country"))


def upsert_products(old: DataFrame, new: DataFrame) -> DataFrame:
    """L4: new names overwrite old ones for the same code."""
    kept = old.join(new.select("product_code"), "product_code", "left_anti")
    return kept.select("product_code", "product_name").unionByName(new.select("product_code", "product_name"))


def fresh_invoices(old: DataFrame, offered: DataFrame) -> DataFrame:
    """Offered invoices whose number is new and fits the 32-bit column."""
    return (offered.filter(in_int32(F.col("invoice_no")))
            .join(old.select("invoice_no"), "invoice_no", "left_anti")
            .select("invoice_no", "invoice_date", "country"))


def append_invoices(old: DataFrame, offered: DataFrame) -> DataFrame:
    """L5 (insert_new): old invoices plus offered ones whose number is new."""
    return old.select("invoice_no", "invoice_date", "country").unionByName(fresh_invoices(old, offered))


def fresh_lines(old: DataFrame, offered: DataFrame, invoices: DataFrame, products: DataFrame) -> DataFrame:
    """New (invoice, product) pairs whose invoice and product exist after the load."""
    return (offered.select("invoice_no", "product_code").distinct()
            .join(old.select("invoice_no", "product_code"), ["invoice_no", "product_code"], "left_anti")
            .join(invoices.select("invoice_no"), "invoice_no", "left_semi")
            .join(products.select("product_code"), "product_code", "left_semi")
            .select("invoice_no", "product_code"))


def append_lines(old: DataFrame, offered: DataFrame, invoices: DataFrame, products: DataFrame) -> DataFrame:
    """L6 (insert_new): old lines plus new (invoice, product) pairs whose invoice and
    product exist in the loaded tables."""
    return old.select("invoice_no", "product_code").unionByName(fresh_lines(old, offered, invoices, products))


# ----------------------------------------------------------------------------- strict mode


def _checkpoint(df: DataFrame) -> DataFrame:
    # Reliable checkpoint into spark.checkpoint.dir (shared storage on a cluster):
    # cuts the lineage that grows each round and survives executor loss.
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _fold(contested: DataFrame, state: DataFrame) -> DataFrame:
    """(file_name, accepted) of the files in ``contested``, taken in name order by one task: FOLD_PAIRS rows at most."""
    def walk(batches):
        taken: set[str] = set()
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        names, verdicts = [], []
        for name, offered in groupby(rows, key=lambda r: r[0]):
            offered = list(offered)
            keys = {key for _, key, _ in offered}
            good = offered[0][2] == "U" and taken.isdisjoint(keys)
            if good:
                taken |= keys
            names.append(name)
            verdicts.append(good)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(verdicts, pa.bool_())], ["file_name", "accepted"])

    pairs = contested.join(state, "file_name").select("file_name", F.to_json(F.struct("key")).alias("key"), "status")
    return pairs.repartition(1).sortWithinPartitions("file_name").mapInArrow(walk, "file_name string, accepted boolean")


def greedy_accept(pairs: DataFrame, files: DataFrame, pre_rejected: DataFrame) -> DataFrame:
    """Files accepted by a left-to-right scan where a file is refused if it shares
    a key with an earlier accepted file, or is in ``pre_rejected``.

    pairs: distinct (file_name, key); files: (file_name) of every candidate.
    Returns (file_name, accepted BOOLEAN) for every file.
    """
    pairs = pairs.select("file_name", "key")
    shared = (pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n_files"))
              .filter("n_files > 1").select("key"))
    contested = _checkpoint(pairs.join(shared, "key", "left_semi"))
    state = (files.select("file_name").distinct()
             .join(pre_rejected.select("file_name").distinct().withColumn("_r", F.lit(True)), "file_name", "left")
             .select("file_name", F.when(F.col("_r"), F.lit("R")).otherwise(F.lit("U")).alias("status")))
    if contested.isEmpty():
        # No key is offered by two files: nothing is decided by file order.
        return state.select("file_name", (F.col("status") == "U").alias("accepted"))
    state = _checkpoint(state)
    if contested.count() <= FOLD_PAIRS:
        decided = _checkpoint(_fold(contested, state))
        return state.join(decided, "file_name", "left").select(
            "file_name", F.coalesce("accepted", F.col("status") == "U").alias("accepted"))
    # Every round decides at least the first open file, so the rounds end by themselves.
    before = None
    while (open_files := state.filter("status = 'U'").count()):
        if before is not None and open_files >= before:
            raise RuntimeError(f"strict load: no progress, {open_files} files undecided")
        before = open_files
        tagged = contested.join(state, "file_name")
        per_key = tagged.groupBy("key").agg(
            F.min(F.when(F.col("status") != "R", F.col("file_name"))).alias("first_live"),
            F.min(F.when(F.col("status") == "A", F.col("file_name"))).alias("first_acc"))
        votes = (tagged.filter("status = 'U'").join(per_key, "key")
                 .groupBy("file_name").agg(
                     F.max(F.coalesce(F.col("first_acc") < F.col("file_name"), F.lit(False))).alias("blocked"),
                     F.min(F.col("first_live") == F.col("file_name")).alias("clear")))
        state = _checkpoint(
            state.join(votes, "file_name", "left").select(
                "file_name",
                F.when(F.col("status") != "U", F.col("status"))
                 .when(F.col("blocked"), F.lit("R"))
                 .when(F.coalesce(F.col("clear"), F.lit(True)), F.lit("A"))
                 .otherwise(F.lit("U")).alias("status")))
    return state.select("file_name", (F.col("status") == "A").alias("accepted"))


def strict_load(old_invoices: DataFrame, old_lines: DataFrame, products_after: DataFrame,
                clean_rows: DataFrame, materialised: bool = False) -> dict[str, DataFrame]:
    """Per-file all-or-nothing load. Returns invoices, lines (loaded tables) and
    verdict (one row per file).

    The clean rows feed several branches and the fixpoint's rounds, so unless
    the caller already ``materialised`` them they are checkpointed once
    (reliably, to the shared folder) before anything else.
    """
    clean_rows = clean_rows.select("file_name", "row_pos", "invoice_no", "invoice_date", "country",
                                   "product_code")
    if not materialised:
        clean_rows = _checkpoint(clean_rows)
    # What the files offer is asked for up to seven times below: it is kept, so the wide rows are read and grouped once.
    inv = _checkpoint(star_invoices(clean_rows, per_file=True))
    offers = _checkpoint(clean_rows.select("file_name", whole_invoice_no(F.col("invoice_no")).alias("invoice_no"), "product_code")
                         .filter(F.col("invoice_no").isNotNull())
                         .groupBy("file_name", "invoice_no", "product_code").agg(F.count(F.lit(1)).alias("n")))
    lines = offers.drop("n")
    files = clean_rows.select("file_name").distinct()

    # Invoices: a file is rejected up front if one of its invoices exists already or
    # does not fit the 32-bit column.
    inv_pairs = inv.select("file_name", F.col("invoice_no").alias("key"))
    clash_old = inv.join(old_invoices.select("invoice_no"), "invoice_no", "left_semi").select("file_name")
    out_of_range = inv.filter(~in_int32(F.col("invoice_no"))).select("file_name")
    inv_ok = greedy_accept(inv_pairs, files, clash_old.unionByName(out_of_range))
    accepted_inv = inv.join(inv_ok.filter("accepted"), "file_name", "left_semi")

    # Lines: an invoice is available to file f if it was there before or belongs to an
    # accepted file g <= f.
    first_acc = accepted_inv.groupBy("invoice_no").agg(F.min("file_name").alias("acc_file"))
    line_inv = (lines.select("file_name", "invoice_no").distinct()
                .join(old_invoices.select("invoice_no").withColumn("_old", F.lit(True)), "invoice_no", "left")
                .join(first_acc, "invoice_no", "left"))
    fk_missing = line_inv.filter(~F.coalesce(F.col("_old"), F.lit(False))
                                 & ~F.coalesce(F.col("acc_file") <= F.col("file_name"), F.lit(False)))
    # distinct (file, code) first: a frequent code meets the anti-join once per file
    prod_missing = (lines.select("file_name", "product_code").distinct()
                    .join(products_after.select("product_code"), "product_code", "left_anti"))
    line_clash_old = lines.join(old_lines.select("invoice_no", "product_code"),
                                ["invoice_no", "product_code"], "left_semi")
    # Two raw invoice texts ('536365', '536365.0') survive de-duplication but
    # coerce to one number: the file then offers the same line twice, which a
    # unique constraint rejects for the whole batch.
    dup_in_file = offers.filter("n > 1")
    pre = (fk_missing.select("file_name").unionByName(prod_missing.select("file_name"))
           .unionByName(line_clash_old.select("file_name")).unionByName(dup_in_file.select("file_name")))
    line_pairs = lines.select("file_name", F.struct("invoice_no", "product_code").alias("key"))
    lines_ok = greedy_accept(line_pairs, files, pre)
    accepted_lines = lines.join(lines_ok.filter("accepted"), "file_name", "left_semi")

    invoices_after = old_invoices.select("invoice_no", "invoice_date", "country").unionByName(
        accepted_inv.select("invoice_no", "invoice_date", "country"))
    lines_after = old_lines.select("invoice_no", "product_code").unionByName(
        accepted_lines.select("invoice_no", "product_code"))

    inv_counts = inv.groupBy("file_name").agg(F.count(F.lit(1)).alias("invoices_offered"))
    line_counts = lines.groupBy("file_name").agg(F.count(F.lit(1)).alias("lines_offered"))
    verdict = (files.join(inv_counts, "file_name", "left").join(line_counts, "file_name", "left")
               .join(inv_ok.withColumnRenamed("accepted", "invoices_accepted"), "file_name", "left")
               .join(lines_ok.withColumnRenamed("accepted", "lines_accepted"), "file_name", "left")
               .select("file_name",
                       F.coalesce("invoices_offered", F.lit(0)).cast("bigint").alias("invoices_offered"),
                       F.coalesce("invoices_accepted", F.lit(False)).alias("invoices_accepted"),
                       F.coalesce("lines_offered", F.lit(0)).cast("bigint").alias("lines_offered"),
                       F.coalesce("lines_accepted", F.lit(False)).alias("lines_accepted")))
    return {"invoices": invoices_after, "lines": lines_after, "verdict": verdict,
            "new_invoices": accepted_inv.select("invoice_no", "invoice_date", "country"),
            "new_lines": accepted_lines.select("invoice_no", "product_code")}


def insert_new_verdict(old_invoices: DataFrame, old_lines: DataFrame, clean_rows: DataFrame) -> DataFrame:
    """L10 for insert_new mode: per file, rows offered and how many clash with the
    existing tables (those rows are skipped, the rest is loaded)."""
    inv = star_invoices(clean_rows, per_file=True)
    lines = star_invoice_lines(clean_rows, per_file=True)
    old_inv = old_invoices.select("invoice_no").withColumn("_hit", F.lit(1))
    old_ln = old_lines.select("invoice_no", "product_code").withColumn("_hit", F.lit(1))
    inv_v = (inv.join(old_inv, "invoice_no", "left").groupBy("file_name")
             .agg(F.count(F.lit(1)).alias("invoices_offered"),
                  F.count("_hit").alias("invoices_clashing")))
    line_v = (lines.join(old_ln, ["invoice_no", "product_code"], "left").groupBy("file_name")
              .agg(F.count(F.lit(1)).alias("lines_offered"),
                   F.count("_hit").alias("lines_clashing")))
    return inv_v.join(line_v, "file_name", "full")
