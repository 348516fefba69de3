"""Upload folder as a stream: each micro-batch of new CSV files is cleaned and
reported on, as an upload would be.

The file source tracks which files were processed (in the query checkpoint),
never splits one file across micro-batches and replays a batch after a
failure. Per batch, ``foreachBatch`` runs the batch operators on the new
files only -- the cleaning is per file, so per-batch results are exactly the
per-file results -- and appends:

* ``<sink>/feedback``: one row per file with the eight stage counts and the batch id;
* ``<sink>/clean``: the clean rows, partitioned by batch id.

Loading into the star stays a batch job over the clean table (``plans.etl``).
Output is partitioned by batch id and written with dynamic partition
overwrite, so a replayed batch rewrites its own partition instead of
duplicating it. The flagged rows are checkpointed once per batch (shared
checkpoint folder) because two outputs read them.

``multi_line=True`` (newlines inside quoted fields) makes each file one task;
pass False when single uploads can be large.

The stream binds columns by position to the canonical header; the reader is
told to check every file's header against it (``enforceSchema=false``), so a
file with reordered columns fails the batch rather than loading scrambled
values. Batch reads (``sources.csv_files``) handle mixed headers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from salescope.functions.coercion import NA_TOKENS, null_tokens_to_null
from salescope.operators import clean, feedback
from salescope.operators.clean import RAW_COLUMNS
from salescope.session import ensure_checkpoint_dir
from salescope.sources.csv_files import SOURCE_ENCODING, decoded

def raw_stream(spark: SparkSession, landing_dir: str, multi_line: bool = True,
               max_files_per_trigger: int | None = None, columns=RAW_COLUMNS) -> DataFrame:
    missing = [c for c in RAW_COLUMNS if c not in columns]
    if missing:
        raise ValueError(f"expected header lacks {missing}")
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    reader = (spark.readStream.schema(schema)
              .option("header", True)
              .option("encoding", SOURCE_ENCODING)
              .option("multiLine", multi_line)
              .option("quote", '"')
              .option("escape", '"')
              .option("enforceSchema", False))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    df = reader.csv(landing_dir)
    return df.select(decoded(F.col("_metadata.file_path")).alias("file_name"),
                     F.col("_metadata.file_block_start").alias("_block_start"), *columns)


def _batch_raw(batch: DataFrame) -> DataFrame:
    """Give a micro-batch the raw-frame shape: row_pos and null tokens."""
    cols = [c for c in batch.columns if c not in ("file_name", "_block_start")]
    return batch.select(
        "file_name",
        F.struct(F.col("_block_start").alias("block_start"),
                 F.monotonically_increasing_id().alias("row_id")).alias("row_pos"),
        *[null_tokens_to_null(F.col(c), NA_TOKENS).alias(c) for c in cols])


def process_batch(batch: DataFrame, batch_id: int, sink_dir: str) -> None:
    ensure_checkpoint_dir(batch.sparkSession)
    flags = clean.flagged(_batch_raw(batch)).checkpoint(eager=True)
    counts = feedback.counts_from_flags(flags).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    rows = (flags.filter("k_country").drop(*clean.FLAGS, "quantity", "dup_count", "row_pos")
            .withColumn("batch_id", F.lit(batch_id).cast("bigint")))
    # Dynamic overwrite replaces only this batch's partition: a replayed batch
    # rewrites its own output instead of appending it twice.
    for df, name in ((counts, "feedback"), (rows, "clean")):
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy("batch_id").parquet(f"{sink_dir}/{name}"))


def start_ingest(spark: SparkSession, landing_dir: str, sink_dir: str, checkpoint_location: str,
                 available_now: bool = True, max_files_per_trigger: int | None = None,
                 multi_line: bool = True, columns=RAW_COLUMNS) -> StreamingQuery:
    """Start the ingest; with ``available_now`` it processes what is there and stops.
    ``columns`` is the expected header (the eight invoice columns plus any extras)."""
    writer = (raw_stream(spark, landing_dir, multi_line, max_files_per_trigger, columns).writeStream
              .foreachBatch(lambda df, bid: process_batch(df, bid, sink_dir))
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
