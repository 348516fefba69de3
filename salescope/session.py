"""Session construction and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every salescope job relies on. AQE re-plans joins (broadcast only
# when the runtime size is below the threshold), coalesces small shuffle
# partitions and splits skewed ones.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Checkpoint files (strict-load rounds, materialised ETL rows) are removed
    # once nothing references them, instead of piling up in the shared folder.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "salescope", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used
    as is. Only when it is unset (local tests) a folder of our own is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not current:
        current = spark.conf.get("spark.checkpoint.dir", None)
    if not current and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder: executors cannot see a local one")
    if not current:
        current = tempfile.mkdtemp(prefix="salescope-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared checkpoint folder, for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "salescope", *parts)


# Rows of a kept file. A scan packs files up to a number of bytes and counts each as openCostInBytes at least (4 MB of
# 128 MB by default), so a task reads about 32 files: rows that compress well do not come to it in ever larger numbers.
KEPT_FILE_ROWS = 40_000

_KEPT: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once below the shared checkpoint folder and read back (cuts the lineage).

    For wide or many rows: a reliable checkpoint computes them twice (to count and to write them) and stores them
    uncompressed. The files stay until ``drop_kept``. Columns are stored under numbers, as their names may differ in case only."""
    spark = df.sparkSession
    path = scratch_path(spark, "kept", uuid.uuid4().hex)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    plain = plain.select(*[F.col(f.name).cast("string") if f.dataType.typeName() == "void" else F.col(f.name) for f in plain.schema])
    plain.write.option("compression", "zstd").option("maxRecordsPerFile", KEPT_FILE_ROWS).parquet(path)
    out = spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)
    _KEPT[out] = path
    return out


def drop_kept(*tables: DataFrame) -> None:
    """Delete the files of tables that ``kept`` returned and that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_KEPT.pop(df))
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
