"""Structured Streaming forms of the pipeline's file-driven stages.

* S4 ``file_arrival_ingest``: new files in a landing folder are loaded exactly once
  (file source + checkpoint), with source-file columns added (X1); one run at a time
  by running ``availableNow`` triggers from the scheduler. With ``archive_dir`` the
  source archives read files (S3, stream form). Spark archives the files of batch
  *n* while planning a later batch, so the last batch's files stay until the next run.
* ``file_arrival_load``: the same arrivals with their paths as the stream: each micro-batch of
  files is one run of the incremental load (columns by header name, quarantine and rejects
  by file), committed to the bronze table's ledger under the stream's id and its batch.
* ``cdc_stream``: a change feed committed per micro-batch as the table's next delta
  (merge-on-read, periodic compaction), so a batch costs the size of its changes. The
  commit names the stream and its batch, so a retried batch is not applied twice and a
  batch of another stream, or of a new checkpoint, is never taken for a retry.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.names import DEFAULT_ROUTES
from ..operators.cdc import read_cdc_table
from ..operators.layers import bronze_columns
from ..plans.incremental import archive_runs, committed_run, load_listing
from ..sources.files import base_name
from ..sources.tables import commit_delta, commit_snapshot, committed_batch


def landing_stream(
    spark: SparkSession,
    landing: str,
    schema: StructType,
    glob: str = "*.csv",
    archive_dir: str | None = None,
    max_files_per_trigger: int | None = None,
    header: bool = True,
) -> DataFrame:
    """A streaming DataFrame over CSV files arriving in ``landing``. A stream reads columns by
    position, so a header that does not name the schema's columns in their order fails
    the query, as does a cell that is not of its type; nothing is read as something else."""
    reader = (
        spark.readStream.schema(schema)
        .option("header", header)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("pathGlobFilter", glob)
    )
    if archive_dir:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive_dir)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.csv(landing)


def file_arrival_ingest(
    spark: SparkSession,
    landing: str,
    schema: StructType,
    sink: str,
    checkpoint: str,
    routes: Sequence[tuple] = DEFAULT_ROUTES,
    archive_dir: str | None = None,
    glob: str = "*.csv",
    partition_by: Sequence[str] = ("as_of_date",),
    fmt: str = "parquet",
    available_now: bool = True,
    ingestion_ts: Column | None = None,
) -> StreamingQuery:
    """Start the ingest of newly arrived files into ``sink`` (partitioned by the
    as-of date); returns the running query (``awaitTermination()`` for a run)."""
    stream = bronze_columns(landing_stream(spark, landing, schema, glob, archive_dir), routes, ingestion_ts=ingestion_ts)
    writer = (
        stream.writeStream.format(fmt)
        .option("checkpointLocation", checkpoint)
        .partitionBy(*partition_by)
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start(sink)


LISTING = "path string, modificationTime timestamp, length long, content binary"


def file_arrival_load(
    spark: SparkSession,
    landing: str,
    schema: StructType,
    bronze_path: str,
    checkpoint: str,
    routes: Sequence[tuple] = DEFAULT_ROUTES,
    glob: str = "*.csv",
    archive: bool = True,
    max_files_per_trigger: int | None = None,
    available_now: bool = True,
    stream_id: str | None = None,
    now: Callable[[], dt.datetime] | None = None,
) -> StreamingQuery:
    """S4 with changing layouts: the stream is the files' paths (``binaryFile`` without the
    content), and each micro-batch loads its files as ``plans.incremental`` does: grouped by
    header, with undated files and files without a needed column quarantined, files of a loaded
    customer, series and date skipped, records that do not fit set apart.

    A batch is a run of the bronze table's commit log under ``<stream>/<batch>``, so a batch
    that is retried after its commit is not loaded again, and it takes turns with other runs
    on the table. ``archive`` moves the files to the folders of their decisions. A stream sees
    a path once: re-sent data comes under another name. ``finish_runs`` writes the run log and
    the watermark of runs that are not archived.
    """

    def load_batch(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        stream = stream_id or own.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not stream:
            raise RuntimeError("the stream has no id; give one")
        source = f"{stream}/{batch_id}"
        if committed_run(own, bronze_path, source) is None:
            listing = batch.select("path", base_name("path").alias("file_name"), "length", "modificationTime")
            stamp = now() if now else dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
            load_listing(own, lambda: listing, schema, bronze_path, routes, stamp, source)
        if archive:
            archive_runs(own, bronze_path)

    reader = spark.readStream.format("binaryFile").schema(LISTING).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    paths = reader.load(landing).select("path", "length", "modificationTime")
    writer = paths.writeStream.foreachBatch(load_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def cdc_stream(
    changes: DataFrame,
    base_path: str,
    keys: Sequence[str],
    checkpoint: str,
    seq_col: str = "seq",
    op_col: str = "op",
    fmt: str = "parquet",
    compact_every: int = 20,
    available_now: bool = True,
    stream_id: str | None = None,
) -> StreamingQuery:
    """X5, stream form (merge-on-read): each micro-batch of changes is committed as the
    table's next delta version -- its cost is the size of the batch, not of the table.
    Every ``compact_every`` versions the table is compacted: the full snapshot plus the
    deltas are merged (``cdc_apply``) and committed as a new full version.
    ``operators.cdc.read_cdc_table`` reads the current state.

    A batch is known by ``stream_id`` (default: the query's own id, which lives in its
    checkpoint) and its batch id; one that is committed is skipped when it is retried. Table
    versions belong to the table alone.
    """

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream = stream_id or spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not stream:
            raise RuntimeError("the stream has no id; give one")
        if committed_batch(spark, base_path, stream, batch_id) is not None:
            return  # committed by an earlier attempt
        version = commit_delta(batch, base_path, None, fmt, stream, batch_id)
        if compact_every and version % compact_every == 0:
            merged = read_cdc_table(spark, base_path, keys, seq_col, op_col, fmt)
            commit_snapshot(merged, base_path, version, fmt)

    writer = changes.writeStream.foreachBatch(apply_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
