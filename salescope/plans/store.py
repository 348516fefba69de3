"""The stored star, loaded batch by batch with one commit over all its tables.

Layout below a folder (catalog tables ``<prefix>_*`` point at it)::

    countries/batch=B/...                        new countries of each batch
    products/batch=B/bucket=K/...                hash buckets of products, rewritten only where a batch changes them
    invoices/batch=B/invoice_year=Y/...          new invoices, bucketed by invoice_no
    invoice_lines/batch=B/invoice_year=Y/...     new lines with line_id, bucketed by invoice_no
    rollup/batch=B/level=L/...                   cube of the batch's new lines by year, country and product
    ledger/000001.json, ...                      one small file per committed batch, written last

* One commit. A batch writes its rows under a number of its own and then one ledger file, renamed into place. Readers
  take the batches of the ledger only, so a load that ends between two writes leaves the old state, and all of it, readable.
  Ledger files are numbered; of two loads that started from one state the second finds its number taken and raises.
* Keyed upsert. Codes whose name is new or changed decide which buckets are written anew; the newest committed
  batch that holds a bucket is its current version. Other buckets keep their files and are not even read.
* Key checks without a shuffle of the stored rows. Offered rows are dealt into the stored buckets once, written there (``_offered``), and meet
  only the range of invoice numbers they span (the files are sorted by it); the stored side is read bucket by bucket where it lies.
  Batches with an outsized bucket and strict loads deal each offer of theirs by itself.
* Lines are numbered without gaps (``operators.numbering``); a batch continues where the ledger says the last one ended.
* The cube of a batch's new lines is added beside them (``operators.rollup``), so rankings need not read the lines.
* Lines carry the year of their invoice as a partition, so a year's ranking reads one year.

One writer at a time is assumed to move the store forward (another is refused, not merged); the folder must be on a file
system with an atomic rename.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.operators import clean, feedback, load, star
from salescope.operators.numbering import dense_numbers, dense_numbers_by_group
from salescope.operators.rollup import line_cube
from salescope.operators.star import in_int32, whole_invoice_no
from salescope.plans.etl import LAYOUT, EtlResult, bucket_skewed, empty_star
from salescope.session import drop_kept, ensure_checkpoint_dir, kept, scratch_path
from salescope.star_schema import INVOICE_YEAR, Star

PRODUCT_BUCKETS = 16
#: Most clean rows per bucket in the batch that founds a store: a task joins, sorts and writes whole buckets.
BUCKET_ROWS = 500_000
#: Most offered codes without a product that are sent to every task.
ABSENT_CODES = 1_000_000

# columns, partition columns, and whether the table is bucketed by invoice_no
_TABLES = {
    "countries": ("country STRING", ("batch BIGINT",), False),
    "products": ("product_code STRING, product_name STRING", ("batch BIGINT", "bucket INT"), False),
    "invoices": ("invoice_no BIGINT, invoice_date DATE, country STRING", ("batch BIGINT", f"{INVOICE_YEAR} INT"), True),
    "invoice_lines": ("line_id BIGINT, invoice_no BIGINT, product_code STRING", ("batch BIGINT", f"{INVOICE_YEAR} INT"), True),
    "rollup": (f"{INVOICE_YEAR} INT, country STRING, product_code STRING, sales BIGINT", ("batch BIGINT", "level INT"), False),
}


@dataclass(frozen=True)
class Commit:
    """A ledger entry: what a committed batch holds."""

    seq: int
    batch: int
    n_buckets: int
    product_buckets: list[int]
    n_countries: int
    n_products: int
    n_invoices: int
    n_lines: int
    last_line_id: int


class ConcurrentLoad(RuntimeError):
    """Another load was committed since this one read the store."""


# ----------------------------------------------------------------------------- the ledger


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def commits(spark: SparkSession, path: str) -> list[Commit]:
    """The committed batches in order (one small row each comes to the driver)."""
    jvm, folder, fs = _hadoop(spark, f"{path}/ledger")
    if fs.exists(jvm.org.apache.hadoop.fs.Path(path, LAYOUT)):
        raise ValueError(f"{path} holds a store of the former layout (plans.etl); load into another folder")
    if not fs.exists(folder) or not any(f.getPath().getName().endswith(".json") for f in fs.listStatus(folder)):
        return []
    rows = spark.read.text(f"{path}/ledger/*.json", wholetext=True).collect()
    return sorted((Commit(**json.loads(r["value"])) for r in rows), key=lambda c: c.seq)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger as a DataFrame, one row per committed batch."""
    columns = ("seq BIGINT, batch BIGINT, n_buckets BIGINT, product_buckets ARRAY<BIGINT>, n_countries BIGINT, n_products BIGINT, "
               "n_invoices BIGINT, n_lines BIGINT, last_line_id BIGINT")
    return spark.createDataFrame([tuple(asdict(c).values()) for c in commits(spark, path)], columns)


def _begin(spark: SparkSession, path: str) -> int:
    """A batch number that no other load has or had, failed ones included."""
    jvm, folder, fs = _hadoop(spark, f"{path}/begun")
    fs.mkdirs(folder)
    batch = max((int(f.getPath().getName()) for f in fs.listStatus(folder)), default=0) + 1
    while not fs.createNewFile(jvm.org.apache.hadoop.fs.Path(folder, str(batch))):
        batch += 1
    return batch


def _commit(spark: SparkSession, path: str, entry: Commit) -> None:
    jvm, final, fs = _hadoop(spark, f"{path}/ledger/{entry.seq:06d}.json")
    fs.mkdirs(final.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(final.getParent(), f"_{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(asdict(entry)).encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration())
    no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        files.rename(draft, final, no_overwrite)
    except Exception as e:
        if fs.exists(final):
            raise ConcurrentLoad(f"batch {entry.seq} of {path} was committed by another load") from e
        raise


# ----------------------------------------------------------------------------- reading


def _open_tables(spark: SparkSession, path: str, prefix: str, n_buckets: int) -> None:
    """Make the tables known to this session's catalog, with all partitions that lie below ``path``."""
    for name, (columns, parts, bucketed) in _TABLES.items():
        table = f"{prefix}_{name}"
        _, folder, fs = _hadoop(spark, f"{path}/{name}")
        fs.mkdirs(folder)
        if spark.catalog.tableExists(table):
            at = spark.sql(f"DESCRIBE FORMATTED {table}").filter("col_name = 'Location'").first()["data_type"]
            if _hadoop(spark, at)[1].toUri().getPath().rstrip("/") != _hadoop(spark, f"{path}/{name}")[1].toUri().getPath().rstrip("/"):
                raise ValueError(f"table {table} lies at {at}, not below {path}: choose another prefix")
        else:
            buckets = f"CLUSTERED BY (invoice_no) SORTED BY (invoice_no) INTO {n_buckets} BUCKETS" if bucketed else ""
            spark.sql(f"CREATE TABLE {table} ({columns}, {', '.join(parts)}) USING parquet OPTIONS (compression 'zstd') "
                      f"PARTITIONED BY ({', '.join(p.split()[0] for p in parts)}) {buckets} LOCATION '{path}/{name}'")
        spark.sql(f"MSCK REPAIR TABLE {table}")


def _current_products(done: list[Commit]) -> Column:
    """Which (batch, bucket) partitions hold the current products."""
    newest = {bucket: c.batch for c in done for bucket in c.product_buckets}
    of_batch: dict[int, list[int]] = {}
    for bucket, batch in newest.items():
        of_batch.setdefault(batch, []).append(bucket)
    held = [(F.col("batch") == batch) & F.col("bucket").isin(buckets) for batch, buckets in sorted(of_batch.items())]
    return reduce(lambda a, b: a | b, held, F.lit(False))


def open_star(spark: SparkSession, path: str, prefix: str, upto: int | None = None) -> Star | None:
    """The star as of the last committed batch (or of ledger entry ``upto``); None if nothing was committed."""
    done = [c for c in commits(spark, path) if upto is None or c.seq <= upto]
    if not done:
        return None
    _open_tables(spark, path, prefix, done[0].n_buckets)
    batches = [c.batch for c in done]
    rows = {name: spark.table(f"{prefix}_{name}") for name in ("countries", "invoices", "invoice_lines")}
    if bucket_skewed(spark, f"{path}/invoice_lines"):
        # a bucketed scan reads a bucket in one task: with an outsized one the files are read as they come
        rows |= {name: spark.read.schema(rows[name].schema).parquet(f"{path}/{name}") for name in ("invoices", "invoice_lines")}
    rows = {name: df.filter(F.col("batch").isin(batches)) for name, df in rows.items()}
    products = spark.table(f"{prefix}_products").filter(_current_products(done))
    return Star(countries=rows["countries"].select("country"), products=products.select("product_code", "product_name", "bucket"),
                invoices=rows["invoices"].drop("batch"), lines=rows["invoice_lines"].drop("batch"))


def open_rollup(spark: SparkSession, path: str, prefix: str, upto: int | None = None) -> DataFrame | None:
    """The cubes of the committed batches (``operators.rollup`` answers the rankings from them); None if nothing was committed."""
    done = [c for c in commits(spark, path) if upto is None or c.seq <= upto]
    if not done:
        return None
    _open_tables(spark, path, prefix, done[0].n_buckets)
    return spark.table(f"{prefix}_rollup").filter(F.col("batch").isin([c.batch for c in done])).drop("batch")


# ----------------------------------------------------------------------------- loading


def product_bucket(code: Column, n: int = PRODUCT_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(code), F.lit(n)).cast("int")


def _within(stored: DataFrame, offered: DataFrame) -> DataFrame:
    """Stored rows in the range of the offered invoice numbers: a filter that reaches the files' statistics."""
    lo, hi = offered.agg(F.min("invoice_no"), F.max("invoice_no")).first()
    return stored.filter(F.col("invoice_no").between(lo, hi)) if lo is not None else stored.filter(F.lit(False))


def _dealt(df: DataFrame, n_buckets: int | None) -> DataFrame:
    return df.repartition(n_buckets, "invoice_no") if n_buckets else df


def new_invoices(stored: DataFrame, offered: DataFrame, n_buckets: int | None) -> DataFrame:
    """Offered invoices (32-bit numbers) that are not stored; the stored ones stay in their buckets.

    Without ``n_buckets`` both sides are shuffled on the whole key (for a store with an outsized bucket)."""
    dealt = _dealt(offered.filter(in_int32(F.col("invoice_no"))), n_buckets)
    known = _within(stored, offered).select("invoice_no", F.lit(True).alias("_known")).hint("merge")
    # not an anti-join: the optimizer would push that below the repartitioning, and then shuffle the stored rows
    return dealt.join(known, "invoice_no", "left").filter("_known IS NULL").select("invoice_no", "invoice_date", "country")


def new_lines(stored: Star, offered: DataFrame, added: DataFrame, products: DataFrame, n_buckets: int | None, codes: DataFrame | None = None) -> DataFrame:
    """Offered lines that are not stored and whose invoice and product are, with the invoice's year and country.

    ``added`` are the batch's new invoices, ``products`` the codes after it, ``codes`` the distinct offered codes, if they are known. The stored lines and invoices stay in their buckets."""
    dealt = _dealt(offered.select("invoice_no", "product_code").distinct(), n_buckets)
    lines = _within(stored.lines, offered).select("invoice_no", "product_code", F.lit(True).alias("_known")).hint("merge")
    header = F.struct(F.year("invoice_date").alias("year"), "country")
    known = _within(stored.invoices, offered).select("invoice_no", header.alias("_stored")).hint("merge")
    own = _dealt(added.select("invoice_no", header.alias("_added")), n_buckets).hint("merge")
    fresh = (dealt.join(lines, ["invoice_no", "product_code"], "left").filter("_known IS NULL")
             .join(known, "invoice_no", "left").join(own, "invoice_no", "left")
             .withColumn("_header", F.coalesce("_stored", "_added")).filter(F.col("_header").isNotNull() & F.col("product_code").isNotNull()))
    # the codes are checked, not each line: the lines stay in their buckets
    codes = offered.select("product_code").distinct() if codes is None else codes
    absent = kept(codes.select("product_code").join(products.select("product_code"), "product_code", "left_anti"))
    if n := absent.count():
        fresh = fresh.join(F.broadcast(absent) if n <= ABSENT_CODES else absent, "product_code", "left_anti")
    return fresh.select(
        "invoice_no", "product_code", F.col("_header.year").alias(INVOICE_YEAR), F.col("_header.country").alias("country"))


def changed_products(stored: DataFrame, offered: DataFrame) -> DataFrame:
    """Offered codes that are new or have another name."""
    old = stored.select("product_code", F.col("product_name").alias("_old"), F.lit(True).alias("_known"))
    both = offered.select("product_code", "product_name").join(old, "product_code", "left")
    return both.filter(F.col("_known").isNull() | ~F.col("product_name").eqNullSafe(F.col("_old"))).select("product_code", "product_name")


@contextmanager
def _aligned(spark: SparkSession):
    """Joins on (invoice_no, more) may use rows that are partitioned by invoice_no alone; buckets count as partitions."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _append(rows: DataFrame, table: str) -> None:
    rows.select(*rows.sparkSession.table(table).columns).write.insertInto(table)


def _offered(rows: DataFrame, prefix: str, n_buckets: int) -> tuple[str, str]:
    """Clean rows with a whole invoice number, written in the store's buckets: name of the table, and its folder.

    What the files offer (headers and lines, by file and over all) is then grouped, and met with the stored rows, without a shuffle."""
    name = f"{prefix}_offered_{uuid.uuid4().hex}"
    at = scratch_path(rows.sparkSession, "offered", name)
    offer = rows.select("file_name", "row_pos", whole_invoice_no(F.col("invoice_no")).alias("invoice_no"), "product_code",
                        F.to_date("invoice_date").alias("invoice_date"), "country").filter("invoice_no IS NOT NULL")
    (offer.repartition(n_buckets, "invoice_no").write.option("compression", "zstd").option("path", at)
     .bucketBy(n_buckets, "invoice_no").sortBy("invoice_no").saveAsTable(name))
    return name, at


def _share(lines: DataFrame, n: int) -> float:
    """The share of the lines that the most frequent product has, from a sample (it decides how rows are dealt, no result)."""
    counts = lines.sample(min(1.0, 100_000 / max(n, 1)), seed=0).groupBy("product_code").count()
    most, all_ = counts.agg(F.max("count"), F.sum("count")).first()
    return most / all_ if all_ else 0.0


def _forget(spark: SparkSession, name: str, at: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    _, folder, fs = _hadoop(spark, at)
    fs.delete(folder, True)


def load_batch(raw: DataFrame, path: str, prefix: str, n_buckets: int = 64, mode: str = "insert_new", commit: bool = True, stored: bool = False) -> EtlResult:
    """Load a raw batch into the store below ``path`` (created by the first batch) and commit it (``commit=False``:
    its rows are written, and its result can be looked at, but no reader takes them).

    ``mode``: insert_new skips keys that are stored; strict accepts or refuses the invoices and lines of each
    file as a whole (``operators.load``). The result's feedback and verdict are checkpointed, its new rows are read
    from the batch's files; its star reads the committed state. ``n_buckets`` counts for the first batch, which takes more if its buckets would
    hold over BUCKET_ROWS rows; later ones keep it. ``stored``: raw is a stored table, cheap to read again."""
    spark = raw.sparkSession
    ensure_checkpoint_dir(spark)
    done = commits(spark, path)
    flags = clean.kept_flags(raw, stored)
    report = feedback.counts_from_flags(flags).checkpoint(eager=True)
    rows = flags.filter("k_country").drop(*clean.FLAGS, "quantity", "dup_count")
    n_buckets = done[0].n_buckets if done else max(n_buckets, -(-rows.count() // BUCKET_ROWS))
    _open_tables(spark, path, prefix, n_buckets)
    old = open_star(spark, path, prefix) if done else None
    old = old or empty_star(spark)

    countries = load.fresh_countries(old.countries, star.star_countries(rows)).checkpoint(eager=True)
    names = kept(star.star_products_by_name(rows))
    changed = kept(changed_products(old.products, names).withColumn("bucket", product_bucket(F.col("product_code"))))
    touched = sorted(r["bucket"] for r in changed.select("bucket").distinct().collect())
    codes = old.products.select("product_code").unionByName(changed.select("product_code")).distinct()
    aligned = None if done and bucket_skewed(spark, f"{path}/invoice_lines") else n_buckets
    last = done[-1].last_line_id if done else 0
    offered = _offered(rows, prefix, n_buckets) if aligned and mode == "insert_new" else None
    if offered and bucket_skewed(spark, offered[1]):
        _forget(spark, *offered)
        offered = None
    with _aligned(spark):
        if offered:
            offer = spark.table(offered[0])
            verdict = load.insert_new_verdict(old.invoices, old.lines, offer)
            invoices = new_invoices(old.invoices, star.star_invoices(offer), None)
            lines = new_lines(old, star.star_invoice_lines(offer), invoices, codes, None, names)
        elif mode == "insert_new":
            verdict = load.insert_new_verdict(old.invoices, old.lines, rows)
            invoices = kept(new_invoices(old.invoices, star.star_invoices(rows), aligned))
            lines = new_lines(old, star.star_invoice_lines(rows), invoices, codes, aligned)
        elif mode == "strict":
            out = load.strict_load(old.invoices, old.lines, codes, rows, materialised=True)
            verdict, invoices = out["verdict"], kept(out["new_invoices"])
            lines = new_lines(old, out["new_lines"], invoices, codes, aligned)
        else:
            raise ValueError(f"mode must be insert_new or strict, not {mode!r}")
        verdict = verdict.checkpoint(eager=True)
        number = dense_numbers_by_group if offered else dense_numbers
        keys = ("invoice_no", ["product_code"]) if offered else (["invoice_no", "product_code"],)
        lines = number(lines, *keys, "line_id", start=last + 1)

        batch = _begin(spark, path)
        mark = F.lit(batch).cast("bigint").alias("batch")
        _append(countries.select("country", mark), f"{prefix}_countries")
        if touched:
            unchanged = old.products.filter(F.col("bucket").isin(touched)) if done else changed.limit(0)
            unchanged = unchanged.join(changed.select("product_code"), "product_code", "left_anti")
            version = unchanged.select("product_code", "product_name", "bucket").unionByName(changed)
            _append(version.select("*", mark).repartition("bucket"), f"{prefix}_products")

        def by_bucket(df):
            # a task holds whole buckets, so a bucket has a file for each year: offered rows lie that way; others are dealt, and
            # an outsized bucket (a hot invoice) is split up
            return df.select("*", mark) if offered else df.select("*", mark).hint("rebalance", n_buckets, F.col("invoice_no"))

        _append(by_bucket(invoices.withColumn(INVOICE_YEAR, F.year("invoice_date"))), f"{prefix}_invoices")
        _append(by_bucket(lines), f"{prefix}_invoice_lines")
        of_batch = lambda name: spark.table(f"{prefix}_{name}").filter(F.col("batch") == batch).drop("batch")
        if offered:
            # from here on the batch's files are read; a line's invoice is stored by now
            invoices, lines = of_batch("invoices").select("invoice_no", "invoice_date", "country"), of_batch("invoice_lines")
            headers = old.invoices.select("invoice_no", "country").unionByName(invoices.select("invoice_no", "country"))
            lines = lines.join(_within(headers, lines).hint("merge"), "invoice_no")
            _forget(spark, *offered)
        n_countries, n_products, n_invoices = (df.count() for df in (countries, changed, invoices))
        n_lines = of_batch("invoice_lines").count()
        _append(line_cube(lines, _share(of_batch("invoice_lines"), n_lines)).select("*", mark), f"{prefix}_rollup")
    seq = done[-1].seq + 1 if done else 1
    if commit:
        _commit(spark, path, Commit(seq, batch, n_buckets, touched, n_countries, n_products, n_invoices, n_lines, last + n_lines))
    drop_kept(flags, names, changed)
    return EtlResult(feedback=report, star=open_star(spark, path, prefix) or old, verdict=verdict, new_countries=countries,
                     new_invoices=invoices, new_lines=lines)
