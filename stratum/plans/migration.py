"""Entry point B: the table-migration plan as one lazy plan plus its writes.

    control sheet (S6) -> dry-run check (J5) -> save control (S8)
      -> external list (J6) | managed work list (J7)
      -> job name, parameters, schedule (R1-R4) -> join with known jobs (J4) -> plan (R5)
      -> sync log (R6, S9) -> table status back into the control table (U2)

No per-table round trips: every step is a join or a projection over all rows.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import control as ctl
from ..operators import lookup
from ..operators.watermark import update_status
from ..sources.control import read_control
from ..sources.tables import commit_snapshot, committed_batch, last_stream


def reported_jobs(listings: DataFrame, json_col: str = "listing", page_col: str = "page_id") -> DataFrame:
    """The jobs of JSON listings, with a row for each listing that is broken."""
    return lookup.explode_jobs(listings, json_col, keep=(page_col,), on_error="report")


def known_jobs(reported: DataFrame, page_col: str = "page_id") -> DataFrame:
    """``job_name, job_id`` (first by listing position)."""
    return lookup.first_by_name(reported, order_cols=(page_col, "pos"))


def migration_plan(
    control: DataFrame, reported: DataFrame, inventory: DataFrame | None = None, user: str = "pipeline-owner"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(checked control, external sync list, per-table plan) -- all lazy. Where a listing is
    broken, rows whose job the others do not name fail."""
    checked = ctl.dry_run_check(control, inventory) if inventory is not None else control
    external = ctl.split_control(checked)
    plan = ctl.sync_plan(ctl.managed_worklist(checked), known_jobs(reported), user, lookup.listing_broken(reported))
    return checked, external, plan


@dataclass
class MigrationRun:
    control_version: int
    plan: DataFrame
    external: DataFrame


def run_migration(
    spark: SparkSession,
    control_path: str,
    jobs_listings: DataFrame,
    inventory: DataFrame | None,
    sync_log_table: str,
    control_base: str,
    user: str = "pipeline-owner",
    run_key: str | None = None,
    now: dt.datetime | None = None,
) -> MigrationRun:
    """Read the sheet, plan every table, commit the control table (with dry-run and table
    statuses) as a new snapshot version and append the sync log.

    The plan is written first, under the run's key and time, then the version is committed,
    then the log is appended. A run that is repeated under its ``run_key`` (a scheduler's
    retry) takes up where the first attempt stopped: a committed version is not made again, rows
    that are logged are not logged again. Before that, the log of the last committed run is
    completed, if it was cut off.
    """
    key = run_key or uuid.uuid4().hex
    control = read_control(spark, control_path)
    last = last_stream(spark, control_base)
    if last is not None and last != key:
        _log(spark, control_base, last, sync_log_table)
    version = committed_batch(spark, control_base, key, 0)
    if version is None:
        stamp = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        checked, _, plan = migration_plan(control, reported_jobs(jobs_listings), inventory, user)
        plan.withColumn("planned_at", F.lit(stamp).cast("timestamp_ntz")).write.mode("overwrite").parquet(_plan_path(control_base, key))
        statuses = ctl.plan_statuses(_read_plan(spark, control_base, key))
        version = commit_snapshot(update_status(checked, statuses, ctl.ROW_KEY), control_base, stream=key, batch=0)
    _log(spark, control_base, key, sync_log_table)
    return MigrationRun(version, _read_plan(spark, control_base, key).drop("planned_at"), ctl.split_control(control))


def _plan_path(control_base: str, key: str) -> str:
    return f"{control_base}/_plans/{key}"


def _read_plan(spark: SparkSession, control_base: str, key: str) -> DataFrame:
    return spark.read.parquet(_plan_path(control_base, key))


def _log(spark: SparkSession, control_base: str, key: str, table: str) -> None:
    plan = _read_plan(spark, control_base, key)
    at = plan.agg(F.max("planned_at").cast("timestamp").alias("at")).first()["at"]
    if at is not None:
        ctl.append_sync_log(ctl.sync_log_rows(plan, F.col("planned_at")), table, at)
