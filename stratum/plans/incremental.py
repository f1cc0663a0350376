"""Entry point C: one incremental load run over a landing folder.

    list input files (S1) -> decide for each file: load, skip, quarantine, unread
      -> read the files to load by header name, set records that do not fit apart, add file
         name, customer, as-of date, clean names (X1: P14, P6, P2, P1)
      -> write the good records as one load of the bronze table, the others to its rejects
      -> ledger commit -> run-log rows (S10) -> watermark upsert (A2, U1) -> moves (S3)

The file list is made once and carried through: only rows of listed files are read, and
only files that the ledger names are moved. What was loaded before is read from the
ledger, one row a file, not from the table.

*One bad file stops no other.* A file whose name gives no date, or whose header lacks a column,
is quarantined by itself; a record with a cell of another type, or with too few or too many
fields, goes to the rejects with its file, its text and the reason, and its file is logged
``Partial``. Both leave the landing folder, so the next run does not meet them again.

*Runs that overlap load each file once.* A load is written to ``load_id=<run>`` and exists when
the commit log (``sources.commits``) names its run; a run commits by creating the record after
the last one that it planned on. If another run was first, and took one of the same files or
the same customer, series and date, the load is planned anew and its written rows are never
read; else the run takes the next number. Log, watermark and moves are made under a lease, by
one run at a time, and can be repeated: :func:`finish_runs` does it for every committed run
that is not yet marked finished, so a run that was cut off is completed by the next one.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.names import DEFAULT_ROUTES, as_of_date, as_of_to_date, route_by_name
from ..operators.layers import bronze_columns
from ..operators.watermark import max_timestamp, upsert_watermark
from ..schemas import ETL_LOG
from ..sources import commits, files
from ..sources.tables import append_run_log, commit_snapshot, latest_version, read_snapshot

BRONZE_PARTITIONS = ("customer", "as_of_date")
LOAD_ID = "load_id"
LEDGER = (
    "run_id string, n int, path string, file_name string, length long, customer string, series string, "
    "as_of_date string, decision string, reason string, rows long, rejected long, stamp timestamp_ntz"
)
REJECTS = "source_file string, line string, reason string, customer string, as_of_date string, ingestion_timestamp timestamp_ntz"
#: File name endings that have a reader.
READABLE = ".csv"
#: Where a file goes after its run, by decision; an unread file stays where it is.
PLACES = {"load": "backup", "skip": "skipped", "quarantine": "quarantine"}


@dataclass
class LoadRun:
    run_id: str
    loaded_rows: int
    files: DataFrame
    moves: dict[str, int]
    watermark_version: int


def file_series(file_name: Column | str, layout: Column) -> Column:
    """What a file is about apart from its date: the text before the first ``-`` (layout
    ``after_dash``) or after the first ``_`` (``before_underscore``), lower case. Files of one
    customer and date are different tables when their series differ."""
    f = F.col(file_name) if isinstance(file_name, str) else file_name
    before_dash = F.split_part(f, F.lit("-"), F.lit(1))
    after_line = F.split_part(F.substr(f, F.instr(f, "_") + 1), F.lit("."), F.lit(1))
    return F.lower(F.trim(F.when(layout == "after_dash", before_dash).otherwise(after_line)))


def _commit_folder(bronze_path: str) -> str:
    return f"{bronze_path}/_commits"


def _rows_of(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all runs in a folder of folders ``<name>=<run>``; none if there is no folder."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return spark.createDataFrame([], schema)
        raise


def read_ledger(spark: SparkSession, bronze_path: str) -> DataFrame:
    """One row a file and run: ``LEDGER``, the ``version`` that committed the run, the time
    ``log_from`` that its log rows begin at, and whether the run is ``finished``."""
    log = commits.records(spark, _commit_folder(bronze_path))
    runs = log.where("state IN ('committed', 'finished')").groupBy("run_id").agg(
        F.min(F.when(F.col("state") == "committed", F.col("n"))).alias("version"),
        F.min("stamp").cast("timestamp_ntz").alias("log_from"),
        F.max(F.col("state") == "finished").alias("finished"),
    )
    return _rows_of(spark, f"{bronze_path}/_ledger", LEDGER).join(runs.where("version IS NOT NULL"), "run_id")


def _all_of(columns: Sequence[str], other: str) -> Column:
    """NULL-safe equality of columns with those of the same name behind a prefix."""
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"{other}{c}"))
    return same


KEY = ["customer", "series", "as_of_date"]


def plan_files(
    listing: DataFrame, ledger: DataFrame, routes: Sequence[tuple] = DEFAULT_ROUTES, schema: StructType | None = None
) -> DataFrame:
    """Each listed file with its decision, the reason and, with a ``schema``, its header:

    * ``unread``: accepted (S1) but not CSV;
    * ``quarantine``: the name gives no as-of date, or the header lacks a column of ``schema``;
    * ``skip``: customer, series and date are loaded already, or an earlier name of this
      listing has the same ones and can be loaded;
    * ``load``: all others.

    Files of a committed run that is not finished are left to it.
    """
    layout = route_by_name("file_name", routes, 2)
    waiting = ledger.where(~F.col("finished") & F.col("decision").isin(*PLACES)).select("path").distinct()
    named = listing.join(waiting, "path", "left_anti").select(
        "path",
        "file_name",
        "length",
        route_by_name("file_name", routes, 1).alias("customer"),
        file_series("file_name", layout).alias("series"),
        as_of_date("file_name", layout).alias("as_of_date"),
    )
    done = ledger.where("decision = 'load'").select(*[F.col(k).alias(f"_{k}") for k in KEY]).distinct()
    first = (
        F.when(~F.col("file_name").endswith(READABLE), "unread")
        .when(as_of_to_date("as_of_date").isNull(), "quarantine")
        .when(F.col("_done"), "skip")
    )
    decided = named.join(done.withColumn("_done", F.lit(True)), _all_of(KEY, "_"), "left").select(*named.columns, first.alias("_first"))
    if schema is None:
        decided = decided.withColumns({"header": F.lit(None).cast("array<string>"), "_problem": F.lit(None).cast("string")})
    else:
        headers = files.csv_headers(decided.where(F.col("_first").isNull()))
        decided = decided.join(headers, "path", "left").withColumn(
            "_problem", F.when(F.col("_first").isNull(), files.header_problem("header", schema))
        )
    open_ = F.col("_first").isNull() & F.col("_problem").isNull()
    nth = F.row_number().over(Window.partitionBy(*KEY, "_open").orderBy("file_name"))
    # the files of one listing get numbers, which make their log times differ
    number = F.row_number().over(Window.orderBy("file_name", "path"))
    decision = (
        F.when(F.col("_first").isNotNull(), F.col("_first"))
        .when(F.col("_problem").isNotNull(), "quarantine")
        .when(F.col("_nth") > 1, "skip")
        .otherwise("load")
    )
    reason = (
        F.when(F.col("_problem").isNotNull(), F.col("_problem"))
        .when(F.col("decision") == "quarantine", "no as-of date in the name")
        .when(F.col("decision") == "skip", "already loaded for its customer, series and date")
        .when(F.col("decision") == "unread", "no reader for this kind of file, left in the landing folder")
    )
    return (
        decided.withColumn("_open", open_)
        .withColumn("_nth", nth)
        .withColumn("decision", decision)
        .select(number.alias("n"), "path", "file_name", "length", *KEY, "decision", reason.alias("reason"), "header")
    )


def _exact_partitions(schema: StructType) -> StructType:
    """The schema of read bronze rows with the partition columns as text (Spark would otherwise
    infer e.g. ``20230630`` as an int)."""
    text = (*BRONZE_PARTITIONS, LOAD_ID)
    return StructType([StructField(f.name, StringType()) if f.name in text else f for f in schema.fields])


def read_bronze(spark: SparkSession, bronze_path: str) -> DataFrame:
    """The committed loads of a bronze table, its partition columns as their exact text."""
    fixed = _exact_partitions(spark.read.parquet(bronze_path).schema)
    return _of_runs(spark, bronze_path, spark.read.schema(fixed).parquet(bronze_path), LOAD_ID).drop(LOAD_ID)


def data_runs(spark: SparkSession, bronze_path: str) -> list[str]:
    """The committed runs that have loaded a row, in the order of their commits."""
    runs = read_ledger(spark, bronze_path).groupBy("run_id", "version").agg(F.sum("rows").alias("rows")).where("rows > 0")
    return [r["run_id"] for r in runs.orderBy("version").collect()]


def read_loads(spark: SparkSession, bronze_path: str, run_ids: Sequence[str]) -> DataFrame:
    """The rows of some committed runs, and no others' files."""
    paths = [f"{bronze_path}/{LOAD_ID}={r}" for r in run_ids]
    return spark.read.schema(_exact_partitions(spark.read.parquet(*paths).schema)).parquet(*paths)


def _of_runs(spark: SparkSession, bronze_path: str, rows: DataFrame, run: str) -> DataFrame:
    """The rows of committed runs."""
    committed = commits.records(spark, _commit_folder(bronze_path)).where("state = 'committed'")
    return rows.join(committed.select(F.col("run_id").alias(run)).distinct(), run, "left_semi")


def read_rejects(spark: SparkSession, bronze_path: str) -> DataFrame:
    """The records that committed loads have set apart, with their ``run_id``."""
    return _of_runs(spark, bronze_path, _rows_of(spark, f"{bronze_path}/_rejects", REJECTS + ", run_id string"), "run_id")


def _write_records(
    spark: SparkSession, headers: DataFrame, schema: StructType, bronze_path: str, routes: Sequence[tuple], run_id: str, at: Column
) -> tuple[DataFrame, DataFrame]:
    """Writes the records of the files of ``headers(path, header)``: rows and rejects by file."""
    counts = Observation()
    records = files.read_csv_checked(spark, headers, schema).drop("source_path")
    observed = records.observe(counts, F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"))
    good = observed.where("reject_reason IS NULL").drop(*files.REJECT_COLUMNS)
    target, aside = f"{bronze_path}/{LOAD_ID}={run_id}", f"{bronze_path}/_rejects/run_id={run_id}"
    rows = bronze_columns(good, routes, file_name=F.col("source_file"), ingestion_ts=at)
    rows.write.mode("overwrite").partitionBy(*BRONZE_PARTITIONS).parquet(target)
    written = spark.read.schema("source_file string").parquet(target).groupBy(F.col("source_file").alias("file_name")).agg(F.count(F.lit(1)).alias("rows"))
    if not counts.get["rejected"]:
        return written, spark.createDataFrame([], "file_name string, rejected long")
    bad = records.where("reject_reason IS NOT NULL").select(
        "source_file",
        F.col("reject_line").alias("line"),
        F.col("reject_reason").alias("reason"),
        route_by_name("source_file", routes, 1).alias("customer"),
        as_of_date("source_file", route_by_name("source_file", routes, 2)).alias("as_of_date"),
        at.alias("ingestion_timestamp"),
    )
    bad.write.mode("overwrite").parquet(aside)
    rejected = spark.read.schema(REJECTS).parquet(aside).groupBy(F.col("source_file").alias("file_name"))
    return written, rejected.agg(F.count(F.lit(1)).alias("rejected"))


def _write_load(
    spark: SparkSession, plan: DataFrame, schema: StructType, bronze_path: str, routes: Sequence[tuple], run_id: str, stamp: dt.datetime
) -> DataFrame:
    """Writes the records of the planned files and returns the ledger rows. The files are read
    again for the rejects only if the first pass has counted any."""
    at = F.lit(stamp).cast("timestamp_ntz")
    wanted = plan.where((F.col("decision") == "load") & (F.size("header") > 0)).select("path", "header")
    if wanted.isEmpty():
        none = spark.createDataFrame([], "file_name string, rows long, rejected long")
        written, rejected = none.drop("rejected"), none.drop("rows")
    else:
        written, rejected = _write_records(spark, wanted, schema, bronze_path, routes, run_id, at)
    load = F.col("decision") == "load"
    return plan.drop("header").join(written, "file_name", "left").join(rejected, "file_name", "left").withColumns(
        {c: F.when(load, F.coalesce(c, F.lit(0))).otherwise(0).cast("long") for c in ("rows", "rejected")}
        | {"run_id": F.lit(run_id), "stamp": at}
    )


def _conflicts(spark: SparkSession, bronze_path: str, own: DataFrame, version: int) -> bool:
    """Whether a run that was committed after ``version`` took a file of ``own``, or loaded its
    customer, series and date."""
    later = read_ledger(spark, bronze_path).where((F.col("version") > version) & F.col("decision").isin(*PLACES))
    later = later.select("path", *KEY, "decision")
    mine = own.where(F.col("decision").isin(*PLACES)).select(*[F.col(c).alias(f"_{c}") for c in later.columns])
    if not later.join(mine, F.col("path") == F.col("_path"), "left_semi").isEmpty():
        return True
    loads = later.where("decision = 'load'").join(mine.where("_decision = 'load'"), _all_of(KEY, "_"), "left_semi")
    return not loads.isEmpty()


def _commit(
    spark: SparkSession, bronze_path: str, own: DataFrame, run_id: str, planned_on: int, stamp: dt.datetime, source: str | None = None
) -> bool:
    """Makes the run the next record of the commit log; False if it has to be planned anew."""
    folder, seen = _commit_folder(bronze_path), planned_on
    while True:
        last = commits.last_number(spark, folder)
        if last > seen and _conflicts(spark, bronze_path, own, seen):
            return False
        seen = last
        # log times are a key: a run's begin after those of the runs before it
        taken = read_ledger(spark, bronze_path).agg(F.max(F.expr("log_from + make_dt_interval(0, 0, 0, n * 0.000001BD)")).alias("t")).first()["t"]
        log_from = stamp if taken is None or taken < stamp else taken
        if commits.append(spark, folder, last + 1, state="committed", run_id=run_id, owner=source, stamp=log_from.isoformat(sep=" ")):
            return True


def load_listing(
    spark: SparkSession,
    listing: Callable[[], DataFrame],
    schema: StructType,
    bronze_path: str,
    routes: Sequence[tuple],
    stamp: dt.datetime,
    source: str | None = None,
) -> str:
    """Plans the files of a listing (made anew when another run was first), writes the records of
    those to load and commits the run, under the name of its ``source`` if it has one; returns
    its id. Nothing is moved or logged."""
    while True:
        run_id = uuid.uuid4().hex
        planned_on = commits.last_number(spark, _commit_folder(bronze_path))
        plan = plan_files(listing(), read_ledger(spark, bronze_path), routes, schema)
        plan.write.parquet(f"{bronze_path}/_runs/{run_id}")  # the one listing that all else goes by
        plan = spark.read.schema(plan.schema).parquet(f"{bronze_path}/_runs/{run_id}")
        rows = _write_load(spark, plan, schema, bronze_path, routes, run_id, stamp)
        names = [f.name for f in _ledger_schema().fields if f.name != "run_id"]
        rows.select(*names).coalesce(1).write.mode("overwrite").parquet(f"{bronze_path}/_ledger/run_id={run_id}")
        own = spark.read.schema(LEDGER).parquet(f"{bronze_path}/_ledger/run_id={run_id}")
        if _commit(spark, bronze_path, own, run_id, planned_on, stamp, source):
            return run_id


def committed_run(spark: SparkSession, bronze_path: str, source: str) -> str | None:
    """The run that was committed under the name of a source."""
    log = commits.records(spark, _commit_folder(bronze_path))
    row = log.where((F.col("state") == "committed") & (F.col("owner") == source)).first()
    return None if row is None else row["run_id"]


def load_files(
    spark: SparkSession, landing: str, schema: StructType, bronze_path: str, routes: Sequence[tuple], stamp: dt.datetime
) -> str:
    """:func:`load_listing` of the files in ``landing``."""
    return load_listing(spark, lambda: files.list_input_files(spark, landing), schema, bronze_path, routes, stamp)


def _ledger_schema() -> StructType:
    return StructType.fromDDL(LEDGER)


def run_files(spark: SparkSession, bronze_path: str, run_id: str) -> DataFrame:
    """The files of a committed run with their decisions and row counts."""
    return read_ledger(spark, bronze_path).where(F.col("run_id") == run_id)


def loaded_rows(spark: SparkSession, bronze_path: str, run_id: str) -> int:
    return run_files(spark, bronze_path, run_id).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def last_ingestion(spark: SparkSession, bronze_path: str) -> DataFrame:
    """A2 over a bronze table, ``max_timestamp``, from the ledger's row counts and times: no data
    file is read. A table without a ledger is scanned."""
    if commits.last_number(spark, _commit_folder(bronze_path)):
        return read_ledger(spark, bronze_path).where("rows > 0").agg(F.max("stamp").alias("max_timestamp"))
    return max_timestamp(spark.read.parquet(bronze_path))


def log_rows(ledger: DataFrame, table_name: str, workflow_id: int, job_run_id: int) -> DataFrame:
    """Run-log rows of committed runs, one a file; the times of one run differ by a microsecond."""
    rows, rejected = F.col("rows").cast("string"), F.col("rejected").cast("string")
    load, partial = F.col("decision") == "load", F.col("rejected") > 0
    message = (
        F.when(load & partial, F.concat(F.lit("loaded "), rows, F.lit(" and rejected "), rejected, F.lit(" rows from "), F.col("file_name")))
        .when(load, F.concat(F.lit("loaded "), rows, F.lit(" rows from "), F.col("file_name")))
        .otherwise(F.concat_ws(": ", "reason", "file_name"))
    )
    status = (
        F.when(load & partial, "Partial").when(load, "Success").when(F.col("decision") == "quarantine", "Quarantined").otherwise("Skipped")
    )
    return ledger.select(
        F.lit(workflow_id).cast("long").alias("workflowId"),
        F.lit(job_run_id).cast("long").alias("JobRunId"),
        F.lit(table_name).alias("workflowName"),
        F.lit("bronze_ingest").alias("notebookName"),
        message.alias("logMessage"),
        (F.col("log_from") + F.make_dt_interval(secs=(F.col("n") * F.lit(1e-6).cast("decimal(18,6)")).cast("decimal(18,6)"))).alias("logTime"),
        status.alias("status"),
        F.col("as_of_date").alias("asOfDate"),
    )


def unfinished(spark: SparkSession, bronze_path: str) -> DataFrame:
    """Ledger rows of the committed runs that are not marked finished."""
    return read_ledger(spark, bronze_path).where(~F.col("finished"))


def archive_runs(spark: SparkSession, bronze_path: str) -> dict[str, int]:
    """Moves the files of the unfinished runs to the folders of their decisions and marks the
    runs finished; returns the number of files per status of the move."""
    place = F.create_map(*[F.lit(x) for pair in PLACES.items() for x in pair])
    moved: dict[str, int] = {}
    folder = _commit_folder(bronze_path)
    with commits.exclusively(spark, folder):
        log = commits.records(spark, folder)
        done = log.where("state = 'finished'").select("run_id")
        runs = log.where("state = 'committed'").join(done, "run_id", "left_anti").orderBy("n").collect()  # one, or a few after a crash
        for run in runs:
            own = run_files(spark, bronze_path, run["run_id"])
            stamp = F.lit(run["stamp"]).cast("timestamp_ntz")
            plan = files.archive_plan(own.where(F.col("decision").isin(*PLACES)), stamp, place[F.col("decision")])
            for status, n in files.run_moves(plan).items():
                moved[status] = moved.get(status, 0) + n
            commits.append_next(spark, folder, state="finished", run_id=run["run_id"])
    return moved


def finish_runs(
    spark: SparkSession,
    bronze_path: str,
    table_name: str,
    etl_log_base: str,
    run_log_table: str,
    workflow_id: int = 0,
    job_run_id: int = 0,
    archive: bool = True,
) -> tuple[int, dict[str, int]]:
    """Log, watermark and moves of every committed run that is not finished; each step may
    have been done before. Returns the watermark's version and the counts of the moves."""
    with commits.exclusively(spark, _commit_folder(bronze_path)):
        open_rows = unfinished(spark, bronze_path)
        append_run_log(log_rows(open_rows, table_name, workflow_id, job_run_id), run_log_table)
        change = open_rows.agg(F.max(F.when(F.col("rows") > 0, F.col("stamp"))).alias("lastExtractDateTime")).select(
            F.lit(table_name).alias("tableName"), "lastExtractDateTime"
        )
        old = (
            read_snapshot(spark, etl_log_base)
            if latest_version(spark, etl_log_base) is not None
            else spark.createDataFrame([], ETL_LOG)
        )
        version = commit_snapshot(upsert_watermark(old, change), etl_log_base)
    return version, archive_runs(spark, bronze_path) if archive else {}


def run_incremental_load(
    spark: SparkSession,
    landing: str,
    schema: StructType,
    bronze_path: str,
    table_name: str,
    etl_log_base: str,
    run_log_table: str,
    workflow_id: int = 0,
    job_run_id: int = 0,
    routes: Sequence[tuple] = DEFAULT_ROUTES,
    archive: bool = True,
    now: dt.datetime | None = None,
) -> LoadRun:
    """Load the files waiting in ``landing`` into ``bronze_path``, each customer, series and
    as-of date once. ``archive=False`` leaves the files, for :func:`archive_runs`."""
    stamp = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    names = (table_name, etl_log_base, run_log_table, workflow_id, job_run_id, archive)
    if not unfinished(spark, bronze_path).isEmpty():
        finish_runs(spark, bronze_path, *names)  # what a run that was cut off has left
    run_id = load_files(spark, landing, schema, bronze_path, routes, stamp)
    version, moves = finish_runs(spark, bronze_path, *names)
    return LoadRun(run_id, loaded_rows(spark, bronze_path, run_id), run_files(spark, bronze_path, run_id), moves, version)
