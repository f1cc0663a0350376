"""Control-table operators: split (J6/J7), dry-run check (J5) and the sync plan.

The control table has one row per table to migrate. The whole plan is one lazy
DataFrame: control -> managed work list -> job name, parameters, schedule ->
left join with the known jobs -> action/status -> sync-log rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cron import NOT_SUPPORTED, is_missing, schedule_mode, schedule_to_cron
from ..functions.names import null_if_nan, schema_part, table_part
from ..schemas import SYNC_LOG

# Fixed values used in plan rows and log rows.
SYNC_JOB_PREFIX = "CDC_UC"
SOURCE_CATALOG = "hive_metastore"
NOT_AVAILABLE = "N/A"
MSG_NOT_WANTED = "sync_required parameter is NO"
MSG_KNOWN = "job already scheduled"
MSG_NO_LISTING = "the job listing could not be read"
MSG_NO_SCHEMA = "table name has no schema part"
MSG_NO_FREQUENCY = "created without schedule: no frequency given"
MSG_NO_TIME = "created without schedule: no time given"
MSG_NO_SCHEDULE = "created without schedule: no frequency or time given"
MSG_BAD_TIME = "created without schedule: time does not parse"
MSG_UNSUPPORTED = "created without schedule: frequency not supported"

MANAGED_FIELDS = [
    "Hive_table_type",
    "Hive_table_format",
    "Sync_required",
    "Frequency_of_sync",
    "Date_n_time_for_1st_schedule",
    "Uc_catalog_name",
    "Uc_schema_name",
    "Uc_table_name",
    "Failure_notifications",
    "Primary_key_for_cdc",
    "Uc_table_type",
    "Uc_table_format",
    "Uc_external_table_location",
]


def destination_type() -> Column:
    """P7 on the destination type: missing or ``nan`` falls back to the source type."""
    return null_if_nan("Uc_table_type", "Hive_table_type")


def is_external() -> Column:
    """Both the source and (defaulted) destination types are EXTERNAL, any case."""
    return (F.upper("Hive_table_type") == "EXTERNAL") & (F.upper(destination_type()) == "EXTERNAL")


def split_control(control: DataFrame) -> DataFrame:
    """Tables to sync as external tables -> name, location, catalog, schema."""
    return control.where(is_external()).select(
        "Hive_table_name",
        F.col("Hive_table_location").alias("location"),
        F.col("Uc_catalog_name").alias("catalog_name"),
        F.col("Uc_schema_name").alias("schema_name"),
    )


def managed_worklist(control: DataFrame) -> DataFrame:
    """The exact complement of J6, with 13 fields (destination type defaulted)."""
    return (
        control.where(~F.coalesce(is_external(), F.lit(False)))
        .withColumn("Uc_table_type", destination_type())
        .select("Hive_table_name", *MANAGED_FIELDS)
    )


# --- J5 -------------------------------------------------------------------------------

DRY_RUN_STATUSES = ("SOURCE_MISSING", "DEST_SCHEMA_MISSING", "DEST_EXISTS", "NOT_EXTERNAL", "OK")


def destination_table() -> Column:
    """Destination table name: the UC name unless missing or ``nan``, else the source table."""
    return F.coalesce(null_if_nan("Uc_table_name"), table_part("Hive_table_name"))


def dry_run_check(control: DataFrame, inventory: DataFrame, source_catalog: str = SOURCE_CATALOG) -> DataFrame:
    """Adds ``dry_run_status`` from joins with a catalog inventory.

    ``inventory`` has ``catalog, schema, table`` (one row per existing table). The
    source is ``<source_catalog>.<schema part>.<table part>`` of the Hive name; the
    destination is ``Uc_catalog_name.Uc_schema_name.<destination table>``.
    """
    inv = inventory.select(
        F.lower("catalog").alias("_c"), F.lower("schema").alias("_s"), F.lower("table").alias("_t")
    ).distinct()
    src = inv.withColumn("_src", F.lit(True))
    dst = inv.withColumn("_dst", F.lit(True))
    schemas = inv.select("_c", "_s").distinct().withColumn("_sch", F.lit(True))
    base = control.withColumn("_row_dest_table", destination_table())
    joined = (
        base.join(
            src.withColumnsRenamed({"_c": "_sc", "_s": "_ss", "_t": "_st"}),
            (F.lit(source_catalog.lower()) == F.col("_sc"))
            & (F.lower(schema_part("Hive_table_name")) == F.col("_ss"))
            & (F.lower(table_part("Hive_table_name")) == F.col("_st")),
            "left",
        )
        .join(
            dst.withColumnsRenamed({"_c": "_dc", "_s": "_ds", "_t": "_dt"}),
            (F.lower("Uc_catalog_name") == F.col("_dc"))
            & (F.lower("Uc_schema_name") == F.col("_ds"))
            & (F.lower("_row_dest_table") == F.col("_dt")),
            "left",
        )
        .join(
            schemas.withColumnsRenamed({"_c": "_hc", "_s": "_hs"}),
            (F.lower("Uc_catalog_name") == F.col("_hc")) & (F.lower("Uc_schema_name") == F.col("_hs")),
            "left",
        )
    )
    status = (
        F.when(F.col("_src").isNull(), F.lit("SOURCE_MISSING"))
        .when(F.col("_sch").isNull(), F.lit("DEST_SCHEMA_MISSING"))
        .when(F.col("_dst").isNotNull(), F.lit("DEST_EXISTS"))
        .when(~F.coalesce(is_external(), F.lit(False)), F.lit("NOT_EXTERNAL"))
        .otherwise(F.lit("OK"))
    )
    return joined.withColumn("dry_run_status", status).select(*control.columns)


# --- R1 - R4 --------------------------------------------------------------------------


def sync_job_name(prefix: str = SYNC_JOB_PREFIX) -> Column:
    """``CDC_UC_<table>`` plus ``_<Uc_table_name>`` when that is present and not ``nan``;
    NULL when the table name has no schema part (no dot), which would give all such
    tables one job."""
    name = F.concat_ws("_", F.lit(prefix), table_part("Hive_table_name"), null_if_nan("Uc_table_name"))
    return F.when(F.instr("Hive_table_name", ".") > 0, name)


def sync_parameters(source_catalog: str = SOURCE_CATALOG) -> Column:
    """R2: the 10 notebook parameters of a sync job as a struct."""
    return F.struct(
        F.lit(source_catalog).alias("sourceCatalog"),
        schema_part("Hive_table_name").alias("sourceSchema"),
        F.col("Primary_key_for_cdc").alias("primaryKey"),
        destination_table().alias("destTable"),
        F.col("Uc_catalog_name").alias("destCatalog"),
        F.col("Uc_schema_name").alias("destSchema"),
        table_part("Hive_table_name").alias("sourceTable"),
        F.col("Uc_table_type").alias("ucTableType"),
        F.col("Uc_table_format").alias("ucTableFormat"),
        F.col("Uc_external_table_location").alias("ucExternalTableLocation"),
    )


def notifications(user: Column | str) -> Column:
    """``on_success = [user]``, ``on_failure = [user, extra]`` when extra is present."""
    u = F.lit(user) if isinstance(user, str) else user
    return F.struct(
        F.array(u).alias("on_success"),
        F.array_compact(F.array(u, null_if_nan("Failure_notifications"))).alias("on_failure"),
    )


def schedule_columns(df: DataFrame) -> DataFrame:
    """Adds ``mode`` (schedule/create), ``cron`` (NULL when unscheduled) and the reason
    why a job is created without a schedule: what is missing, or what does not parse."""
    # The raw cron is its own column: later expressions reference it by name, so the
    # parse is evaluated once per row and generated code stays small.
    staged = df.withColumn("_cron_raw", schedule_to_cron("Date_n_time_for_1st_schedule", "Frequency_of_sync"))
    mode = schedule_mode("Frequency_of_sync", "Date_n_time_for_1st_schedule")
    cron = F.col("_cron_raw")
    no_frequency, no_time = is_missing("Frequency_of_sync"), is_missing("Date_n_time_for_1st_schedule")
    return staged.withColumn("mode", mode).withColumn(
        "cron", F.when((F.col("mode") == "schedule") & (cron != NOT_SUPPORTED), cron)
    ).withColumn(
        "_unscheduled_reason",
        F.when(no_frequency & no_time, F.lit(MSG_NO_SCHEDULE))
        .when(no_frequency, F.lit(MSG_NO_FREQUENCY))
        .when(no_time, F.lit(MSG_NO_TIME))
        .when((F.col("mode") == "schedule") & cron.isNull(), F.lit(MSG_BAD_TIME))
        .when((F.col("mode") == "schedule") & (cron == NOT_SUPPORTED), F.lit(MSG_UNSUPPORTED)),
    )


# --- R5, R6 ---------------------------------------------------------------------------


#: What tells the rows of a sheet apart: the source and its destination.
ROW_KEY = ("Hive_table_name", "Uc_catalog_name", "Uc_schema_name", "Uc_table_name")


def sync_plan(
    managed: DataFrame, known_jobs: DataFrame, user: str = "pipeline-owner", listing_broken: Column | None = None
) -> DataFrame:
    """One plan row per managed table.

    ``managed`` is the J7 work list; ``known_jobs`` has ``job_name, job_id`` with one
    row per name (see ``lookup.first_by_name``). Actions: ``skip`` (sync not wanted,
    or job already known), ``fail`` (the table name has no schema part), ``schedule``
    (valid cron) or ``create`` (unscheduled, with the reason).
    ``Sync_required`` must equal ``yes`` exactly.

    A job is made once: of the rows that want one job name, the first (in the order of
    ``ROW_KEY``, as a table has no order of its own) gets it, and for the others it is
    already scheduled. Where ``listing_broken`` (``lookup.listing_broken``) is true, a job
    that is not in the listing may exist all the same: its row fails instead of being planned.
    """
    jobs = known_jobs.select(F.col("job_name").alias("_known_name"), F.col("job_id").alias("_known_id"))
    wanted = F.coalesce(F.col("Sync_required") == "yes", F.lit(False))
    planned = schedule_columns(managed.withColumn("job_name", sync_job_name())).withColumn("_wanted", wanted)
    joined = planned.join(jobs, planned["job_name"] == jobs["_known_name"], "left")
    # rows without a name, or that want no job, are groups of their own
    rival = F.when(F.col("_wanted") & F.col("job_name").isNotNull(), F.col("job_name")).otherwise(
        F.concat_ws("\u0000", F.lit(""), *[F.coalesce(F.col(c), F.lit("")) for c in ROW_KEY])
    )
    nth = F.row_number().over(Window.partitionBy("_rival").orderBy(*[F.col(c).asc_nulls_first() for c in ROW_KEY]))
    known = F.col("_known_name").isNotNull()
    blind = F.lit(False) if listing_broken is None else listing_broken
    kind = (
        F.when(~F.col("_wanted"), F.lit("unwanted"))
        .when(F.col("job_name").isNull(), F.lit("unnamed"))
        .when(known, F.lit("known"))
        .when(F.col("_blind"), F.lit("blind"))
        .when(F.col("_nth") > 1, F.lit("second"))
        .otherwise(F.lit("new"))
    )
    joined = joined.withColumns({"_rival": rival, "_blind": blind}).withColumn("_nth", nth).withColumn("_kind", kind)
    is_kind = lambda *names: F.col("_kind").isin(*names)
    action = (
        F.when(is_kind("unwanted", "known", "second"), F.lit("skip"))
        .when(is_kind("unnamed", "blind"), F.lit("fail"))
        .when(F.col("cron").isNotNull(), F.lit("schedule"))
        .otherwise(F.lit("create"))
    )
    status = (
        F.when(is_kind("unwanted", "known", "second"), F.lit("Skipped"))
        .when(is_kind("unnamed", "blind"), F.lit("Failed"))
        .otherwise(F.lit("Planned"))
    )
    message = (
        F.when(is_kind("unwanted"), F.lit(MSG_NOT_WANTED))
        .when(is_kind("unnamed"), F.lit(MSG_NO_SCHEMA))
        .when(is_kind("known", "second"), F.lit(MSG_KNOWN))
        .when(is_kind("blind"), F.lit(MSG_NO_LISTING))
        .when(F.col("cron").isNotNull(), F.concat(F.lit("scheduled: "), F.col("cron")))
        .otherwise(F.col("_unscheduled_reason"))
    )
    return joined.select(
        F.col("Hive_table_name").alias("table_name"),
        "job_name",
        action.alias("action"),
        status.alias("status"),
        F.when(is_kind("new"), F.col("cron")).alias("cron"),
        message.alias("log_message"),
        F.when(is_kind("known"), F.col("_known_id")).alias("job_id"),
        F.col("Uc_catalog_name").alias("destination_catalog_name"),
        F.col("Uc_schema_name").alias("destination_schema_name"),
        F.col("Uc_table_name").alias("destination_table_name"),
        sync_parameters().alias("parameters"),
        notifications(user).alias("notifications"),
    )


def plan_statuses(plan: DataFrame) -> DataFrame:
    """``ROW_KEY`` and ``Table_Status`` of the rows of a plan, for U2: one row a source and
    destination, of a repeated one the status that says most."""
    order = F.array_position(F.array(F.lit("Skipped"), F.lit("Failed"), F.lit("Planned")), F.col("status"))
    names = ("table_name", "destination_catalog_name", "destination_schema_name", "destination_table_name")
    keys = [F.col(c).alias(k) for c, k in zip(names, ROW_KEY, strict=True)]
    return plan.groupBy(*keys).agg(F.max_by("status", order).alias("Table_Status"))


def sync_log_rows(plan: DataFrame, log_time: Column | None = None) -> DataFrame:
    """The sync-log records (schema ``schemas.SYNC_LOG``); the log time is filled."""
    named = F.col("action").isin("schedule", "create") | (F.col("log_message") == MSG_KNOWN)
    return plan.select(
        F.coalesce(F.col("job_id").cast("string"), F.lit(NOT_AVAILABLE)).alias("jobId"),
        F.when(named, F.col("job_name")).otherwise(F.lit(NOT_AVAILABLE)).alias("jobName"),
        "table_name",
        "destination_catalog_name",
        "destination_schema_name",
        "status",
        "log_message",
        (log_time if log_time is not None else F.current_timestamp()).cast("timestamp").alias("log_time"),
    )


def append_sync_log(rows: DataFrame, table: str, at: dt.datetime | None = None) -> None:
    """Append sync-log rows (``sync_log_rows`` output) to a catalog table, creating
    it on first use. With the time ``at`` that all rows have, rows that the table has already
    with this time are not appended again: a run that was cut off can repeat the call."""
    spark = rows.sparkSession
    shaped = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SYNC_LOG.fields])
    if at is not None and spark.catalog.tableExists(table):
        if not spark.table(table).where(F.col("log_time") == F.lit(at)).isEmpty():
            return  # one insert holds all rows of a run
    if spark.catalog.tableExists(table):
        shaped.write.insertInto(table)
    else:
        shaped.write.mode("append").saveAsTable(table)
