"""Raw invoice rows -> feedback report + loaded star, as one lazy plan.

The flagged rows (de-duplicated, with survival flags) feed both the
feedback counts and the clean rows; ``materialise=True`` writes them once
into the shared checkpoint folder so the two consumers do not repeat the
de-duplication (``clean.kept_flags``).
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salescope.operators import clean, feedback, load, star
from salescope.session import ensure_checkpoint_dir
from salescope.star_schema import INVOICE_YEAR, Star

STAR_SCHEMAS = {
    "countries": T.StructType([T.StructField("country", T.StringType())]),
    "products": T.StructType([T.StructField("product_code", T.StringType()),
                              T.StructField("product_name", T.StringType())]),
    "invoices": T.StructType([T.StructField("invoice_no", T.LongType()),
                              T.StructField("invoice_date", T.DateType()),
                              T.StructField("country", T.StringType())]),
    "lines": T.StructType([T.StructField("invoice_no", T.LongType()),
                           T.StructField("product_code", T.StringType())]),
}


def empty_star(spark: SparkSession) -> Star:
    e = {k: spark.createDataFrame([], v) for k, v in STAR_SCHEMAS.items()}
    return Star(countries=e["countries"], products=e["products"], invoices=e["invoices"], lines=e["lines"])


@dataclass(frozen=True)
class EtlResult:
    feedback: DataFrame
    star: Star
    verdict: DataFrame
    new_countries: DataFrame
    new_invoices: DataFrame
    new_lines: DataFrame


def run_etl(raw: DataFrame, old: Star | None = None, mode: str = "insert_new",
            materialise: bool = True) -> EtlResult:
    """Clean ``raw``, report on it, and load it into ``old`` (an empty star by default).

    ``mode`` is ``insert_new`` or ``strict`` (see ``operators.load``). The
    result holds the feedback counts, the loaded star, the per-file verdict,
    and the new rows of the append-only tables (what a sink appends)."""
    spark = raw.sparkSession
    old = old or empty_star(spark)
    flags = clean.kept_flags(raw) if materialise else clean.flagged(raw)
    rows = flags.filter("k_country").drop(*clean.FLAGS, "quantity", "dup_count")

    new_countries = load.fresh_countries(old.countries, star.star_countries(rows))
    countries = new_countries.unionByName(old.countries.select("country"))
    products = load.upsert_products(old.products, star.star_products(rows))
    if mode == "insert_new":
        new_invoices = load.fresh_invoices(old.invoices, star.star_invoices(rows))
        invoices = old.invoices.select("invoice_no", "invoice_date", "country").unionByName(new_invoices)
        new_lines = load.fresh_lines(old.lines, star.star_invoice_lines(rows), invoices, products)
        lines = old.lines.select("invoice_no", "product_code").unionByName(new_lines)
        verdict = load.insert_new_verdict(old.invoices, old.lines, rows)
    elif mode == "strict":
        out = load.strict_load(old.invoices, old.lines, products, rows, materialised=materialise)
        invoices, lines, verdict = out["invoices"], out["lines"], out["verdict"]
        new_invoices, new_lines = out["new_invoices"], out["new_lines"]
    else:
        raise ValueError(f"mode must be insert_new or strict, not {mode!r}")
    return EtlResult(feedback=feedback.counts_from_flags(flags),
                     star=Star(countries=countries, products=products, invoices=invoices, lines=lines),
                     verdict=verdict, new_countries=new_countries, new_invoices=new_invoices,
                     new_lines=new_lines)


def table_counts(s: Star) -> DataFrame:
    """(table_name, n_rows) for the four star tables."""
    parts = [df.groupBy().agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table_name"), "n_rows") for name, df in s.tables().items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_star(s: Star, path: str, mode: str = "overwrite") -> None:
    """Store the star as plain Parquet, invoices and lines clustered by invoice number
    (file min/max statistics then prune by invoice range); invoices are also
    partitioned by year (column ``invoice_year``). Lines are range-partitioned
    on (invoice, product), so an invoice with a huge number of lines is spread over
    several write tasks instead of one."""
    s.countries.write.mode(mode).parquet(f"{path}/countries")
    s.products.write.mode(mode).parquet(f"{path}/products")
    # Invoices are partitioned by year: a year filter then skips the other years' files.
    (s.invoices.withColumn(INVOICE_YEAR, F.year("invoice_date"))
     .repartitionByRange(INVOICE_YEAR, "invoice_no").sortWithinPartitions("invoice_no")
     .write.mode(mode).partitionBy(INVOICE_YEAR).parquet(f"{path}/invoices"))
    (s.lines.repartitionByRange("invoice_no", "product_code").sortWithinPartitions("invoice_no", "product_code")
     .write.mode(mode).parquet(f"{path}/lines"))


def read_star(spark: SparkSession, path: str) -> Star:
    return Star(countries=spark.read.parquet(f"{path}/countries"),
                products=spark.read.parquet(f"{path}/products"),
                invoices=spark.read.parquet(f"{path}/invoices"),
                lines=spark.read.parquet(f"{path}/lines"))


def save_star_tables(s: Star, path: str, prefix: str, n_buckets: int, mode: str = "overwrite") -> None:
    """Store the star as catalog tables under ``path``; invoices and lines are
    bucketed (and sorted) by invoice number with the same bucket count, so the
    per-invoice count and the lines-invoices join run without any shuffle.
    Choose ``n_buckets`` so one bucket of lines is a few hundred MB."""
    for name, df in s.tables().items():
        w = df.write.mode(mode).option("path", f"{path}/{name}")
        if name in ("invoices", "invoice_lines"):
            w = w.bucketBy(n_buckets, "invoice_no").sortBy("invoice_no")
        w.saveAsTable(f"{prefix}_{name}")
    layout = s.lines.sparkSession.range(1).select(F.lit(n_buckets).alias("n_buckets"))
    layout.write.mode(mode).parquet(f"{path}/{LAYOUT}")


STORED = ("countries", "products", "invoices", "invoice_lines")
#: Folder written last when a store is created: it holds the bucket count and marks the store complete.
LAYOUT = "layout"


def _list_folder(spark: SparkSession, path: str) -> dict[str, int]:
    """{folder name: modification time} directly below ``path``; empty if it does not exist."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return {}
    return {f.getPath().getName(): f.getModificationTime() for f in fs.listStatus(root) if f.isDirectory()}


def _newest_products(spark: SparkSession, path: str, folders: dict[str, int]) -> str | None:
    """The last product folder that was written to its end. All appends of a batch precede it,
    so a complete folder belongs to the stored state even if its table was not re-pointed any more."""
    done = []
    for name in folders:
        if name == "products" or name.startswith("products_"):
            mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")
            fs = mark.getFileSystem(spark._jsc.hadoopConfiguration())
            if fs.exists(mark):
                done.append((fs.getFileStatus(mark).getModificationTime(), name))
    return max(done)[1] if done else None


def open_store(spark: SparkSession, path: str, prefix: str) -> bool:
    """Make the star tables stored under ``path`` known to this session's catalog.

    True: the four tables are there. False: neither tables nor data exist, a store can be
    created. Anything between (a table or folder missing, a first save that did not end) raises,
    so stored data is never written over."""
    known = [t for t in STORED if spark.catalog.tableExists(f"{prefix}_{t}")]
    if len(known) == len(STORED):
        return True
    folders = _list_folder(spark, path)
    here = {t: t for t in STORED if t in folders}
    products = _newest_products(spark, path, folders)
    here = {**here, "products": products} if products else {t: f for t, f in here.items() if t != "products"}
    if not known and not here and LAYOUT not in folders:
        return False
    if len(here) < len(STORED) or LAYOUT not in folders:
        missing = [t for t in (*STORED, LAYOUT) if t not in here and t not in folders]
        raise ValueError(f"the store under {path} is incomplete (missing: {missing}; in the catalog: {known}); "
                         "nothing was written")
    n_buckets = spark.read.parquet(f"{path}/{LAYOUT}").first()["n_buckets"]
    for table, folder in here.items():
        if table in known:
            continue
        schema = spark.read.parquet(f"{path}/{folder}").schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        buckets = (f"CLUSTERED BY (invoice_no) SORTED BY (invoice_no) INTO {n_buckets} BUCKETS"
                   if table in ("invoices", "invoice_lines") else "")
        spark.sql(f"CREATE TABLE {prefix}_{table} ({columns}) USING parquet {buckets} LOCATION '{path}/{folder}'")
    return True


_BUCKET_ID = re.compile(r"_(\d{5})(?:\.c\d{3})?(?:\.[A-Za-z0-9]+)*$")


def bucket_sizes(spark: SparkSession, location: str) -> dict[int, int]:
    """Bytes per bucket of a bucketed table, from a file listing (contents are not read)."""
    listing = spark.read.format("binaryFile").load(location).select("path", "length")
    sizes: dict[int, int] = {}
    for r in listing.collect():
        m = _BUCKET_ID.search(r["path"].rsplit("/", 1)[-1])
        if m:
            b = int(m.group(1))
            sizes[b] = sizes.get(b, 0) + r["length"]
    return sizes


def bucket_skewed(spark: SparkSession, location: str, factor: float = 4.0) -> bool:
    """True when the largest bucket is over ``factor`` times the mean and larger than one split.

    A bucketed scan reads each bucket in one task and has no shuffle that AQE
    could split, so a bucket holding a large share of the rows (one hot
    invoice) would become one huge task."""
    from salescope.sources.csv_files import split_bytes

    sizes = bucket_sizes(spark, location)
    if not sizes:
        return False
    mean = sum(sizes.values()) / len(sizes)
    biggest = max(sizes.values())
    return biggest > factor * mean and biggest > split_bytes(spark)


def table_star(spark: SparkSession, prefix: str, path: str | None = None) -> Star:
    """The stored star. With ``path`` (the tables' location) the bucket sizes are
    checked first: if a bucket is outsized, invoices and lines are read as plain
    Parquet instead, so scans split by size and joins shuffle with map-side
    pre-aggregation (skew-safe) rather than read one bucket per task."""
    invoices, lines = spark.table(f"{prefix}_invoices"), spark.table(f"{prefix}_invoice_lines")
    if path is not None and bucket_skewed(spark, f"{path}/invoice_lines"):
        invoices, lines = spark.read.parquet(f"{path}/invoices"), spark.read.parquet(f"{path}/invoice_lines")
    return Star(countries=spark.table(f"{prefix}_countries"), products=spark.table(f"{prefix}_products"),
                invoices=invoices, lines=lines)


def load_into_tables(raw: DataFrame, prefix: str, path: str, n_buckets: int,
                     mode: str = "insert_new") -> EtlResult:
    """Load a raw batch into stored star tables (created on first use, else opened
    from the folder by ``open_store``; an incomplete store is refused, never written over).

    Countries, invoices and lines are append-only: only the new rows are
    written (``mode("append")``, same bucketing), never the whole table.
    Products are an upsert (a later file renames a code), which Parquet
    cannot do in place: the new product table is checkpointed (shared
    folder), written to a fresh directory, and the table is re-pointed to it.
    Every append is one write job (atomic through the commit protocol), and a
    rerun after a failure only adds what is still missing (insert-new). Products are a dimension, small
    next to the lines. Returns the result with feedback, verdict and deltas
    materialised (checkpointed) and ``star`` reading the updated tables.
    """
    spark = raw.sparkSession
    exists = open_store(spark, path, prefix)
    old = table_star(spark, prefix, path) if exists else None
    result = run_etl(raw, old, mode=mode)
    ensure_checkpoint_dir(spark)
    # Everything derived from the old tables is materialised before any table is
    # written: the products table is rewritten below, and lazy frames still
    # pointing at its old files could not be evaluated afterwards.
    keep = {"feedback": result.feedback, "verdict": result.verdict, "new_countries": result.new_countries,
            "new_invoices": result.new_invoices, "new_lines": result.new_lines}
    if exists:
        keep["products"] = result.star.products
    done = {k: v.checkpoint(eager=True) for k, v in keep.items()}
    if not exists:
        save_star_tables(result.star, path, prefix, n_buckets)
    else:
        for name, key in (("countries", "new_countries"), ("invoices", "new_invoices"),
                          ("invoice_lines", "new_lines")):
            w = done[key].write.mode("append").option("path", f"{path}/{name}")
            if name in ("invoices", "invoice_lines"):
                w = w.bucketBy(n_buckets, "invoice_no").sortBy("invoice_no")
            w.saveAsTable(f"{prefix}_{name}")
        # The new product table goes to a fresh directory and the table is then
        # re-pointed in one catalog operation: a failure while writing leaves the
        # old table untouched (an in-place overwrite would delete it first).
        fresh = f"{path}/products_{uuid.uuid4().hex}"
        done["products"].write.mode("errorifexists").parquet(fresh)
        spark.sql(f"ALTER TABLE {prefix}_products SET LOCATION '{fresh}'")
        spark.sql(f"REFRESH TABLE {prefix}_products")
    return EtlResult(feedback=done["feedback"], star=table_star(spark, prefix, path), verdict=done["verdict"],
                     new_countries=done["new_countries"], new_invoices=done["new_invoices"],
                     new_lines=done["new_lines"])
