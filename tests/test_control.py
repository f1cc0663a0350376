"""Control table: J6/J7 partition, J5 statuses, R1-R6 plan rows."""

from pyspark.sql import functions as F

from stratum.operators import control, lookup
from stratum.plans import derived
from stratum.schemas import CONTROL_COLUMNS

SF = "/root/testdata/sf0.01"


def ctl(spark, rows):
    base = {c: None for c in CONTROL_COLUMNS}
    full = [tuple({**base, **r}[c] for c in CONTROL_COLUMNS) for r in rows]
    return spark.createDataFrame(full, ", ".join(f"{c} string" for c in CONTROL_COLUMNS))


def test_split_is_a_partition(spark):
    c = derived.control(spark, SF)
    ext = control.split_control(c).select("Hive_table_name")
    man = control.managed_worklist(c).select("Hive_table_name")
    assert ext.intersect(man).count() == 0
    assert ext.union(man).distinct().count() == c.count() == ext.count() + man.count()


def test_external_needs_both_types(spark):
    c = ctl(
        spark,
        [
            {"Hive_table_name": "s.a", "Hive_table_type": "external", "Uc_table_type": None},
            {"Hive_table_name": "s.b", "Hive_table_type": "EXTERNAL", "Uc_table_type": "nan"},
            {"Hive_table_name": "s.c", "Hive_table_type": "EXTERNAL", "Uc_table_type": "MANAGED"},
            {"Hive_table_name": "s.d", "Hive_table_type": None, "Uc_table_type": "EXTERNAL"},
            {"Hive_table_name": "s.e", "Hive_table_type": "managed", "Uc_table_type": ""},
        ],
    )
    ext = sorted(r[0] for r in control.split_control(c).select("Hive_table_name").collect())
    man = {r[0]: r[1] for r in control.managed_worklist(c).select("Hive_table_name", "Uc_table_type").collect()}
    assert ext == ["s.a", "s.b"]
    assert man == {"s.c": "MANAGED", "s.d": "EXTERNAL", "s.e": ""}


def test_job_name_and_parameters(spark):
    c = ctl(
        spark,
        [
            {"Hive_table_name": "bronze.cust", "Uc_table_name": "cust_v2", "Failure_notifications": "a@x"},
            {"Hive_table_name": "bronze.ord", "Uc_table_name": "NaN", "Failure_notifications": "nan"},
            {"Hive_table_name": "bronze.li", "Uc_table_name": None},
        ],
    )
    rows = c.select(
        "Hive_table_name",
        control.sync_job_name().alias("j"),
        control.sync_parameters().alias("p"),
        control.notifications("me").alias("n"),
    ).collect()
    got = {r.Hive_table_name: r for r in rows}
    assert got["bronze.cust"].j == "CDC_UC_cust_cust_v2"
    assert got["bronze.ord"].j == "CDC_UC_ord"
    assert got["bronze.ord"].p.destTable == "ord"
    assert got["bronze.cust"].p.sourceSchema == "bronze" and got["bronze.cust"].p.sourceCatalog == "hive_metastore"
    assert got["bronze.cust"].n.on_failure == ["me", "a@x"]
    assert got["bronze.ord"].n.on_failure == ["me"]
    assert got["bronze.li"].n.on_success == ["me"]


def test_plan_rows(spark):
    c = ctl(
        spark,
        [
            {"Hive_table_name": "b.no", "Hive_table_type": "MANAGED", "Sync_required": "no"},
            {"Hive_table_name": "b.cap", "Hive_table_type": "MANAGED", "Sync_required": "YES"},
            {"Hive_table_name": "b.sched", "Hive_table_type": "MANAGED", "Sync_required": "yes",
             "Frequency_of_sync": "Daily", "Date_n_time_for_1st_schedule": "16:00:00"},
            {"Hive_table_name": "b.known", "Hive_table_type": "MANAGED", "Sync_required": "yes",
             "Frequency_of_sync": "Daily", "Date_n_time_for_1st_schedule": "16:00:00"},
            {"Hive_table_name": "b.nofreq", "Hive_table_type": "MANAGED", "Sync_required": "yes",
             "Date_n_time_for_1st_schedule": "16:00:00"},
            {"Hive_table_name": "b.notime", "Hive_table_type": "MANAGED", "Sync_required": "yes",
             "Frequency_of_sync": "Daily", "Date_n_time_for_1st_schedule": "nan"},
            {"Hive_table_name": "nodot", "Hive_table_type": "MANAGED", "Sync_required": "yes"},
            {"Hive_table_name": "nodot2", "Hive_table_type": "MANAGED", "Sync_required": "no"},
            {"Hive_table_name": "b.nosched", "Hive_table_type": "MANAGED", "Sync_required": "yes"},
            {"Hive_table_name": "b.badtime", "Hive_table_type": "MANAGED", "Sync_required": "yes",
             "Frequency_of_sync": "weekly", "Date_n_time_for_1st_schedule": "99:00:00"},
            {"Hive_table_name": "b.yearly", "Hive_table_type": "MANAGED", "Sync_required": "yes",
             "Frequency_of_sync": "yearly", "Date_n_time_for_1st_schedule": "1:00:00"},
        ],
    )
    jobs = spark.createDataFrame([("CDC_UC_known", 7), ("CDC_UC_known", 8), ("other", 9)], "job_name string, job_id long")
    known = lookup.first_by_name(jobs.withColumn("pos", F.col("job_id")))
    plan = control.sync_plan(control.managed_worklist(c), known)
    got = {r.table_name: r for r in plan.collect()}
    assert (got["b.no"].action, got["b.no"].status) == ("skip", "Skipped")
    assert got["b.cap"].action == "skip"  # "YES" is not "yes"
    assert (got["b.sched"].action, got["b.sched"].cron, got["b.sched"].status) == ("schedule", "0 0 16 * * ? ", "Planned")
    assert (got["b.known"].action, got["b.known"].job_id, got["b.known"].log_message) == ("skip", 7, "job already scheduled")
    assert (got["b.nofreq"].action, got["b.nofreq"].log_message) == ("create", control.MSG_NO_FREQUENCY)
    assert (got["b.notime"].action, got["b.notime"].log_message) == ("create", control.MSG_NO_TIME)
    assert (got["nodot"].action, got["nodot"].status, got["nodot"].log_message) == ("fail", "Failed", control.MSG_NO_SCHEMA)
    assert got["nodot"].job_name is None and got["nodot2"].status == "Skipped"
    assert (got["b.nosched"].action, got["b.nosched"].cron) == ("create", None)
    assert got["b.badtime"].log_message == control.MSG_BAD_TIME
    assert got["b.yearly"].log_message == control.MSG_UNSUPPORTED
    log = {r.table_name: r for r in control.sync_log_rows(plan).collect()}
    assert (log["b.no"].jobId, log["b.no"].jobName) == ("N/A", "N/A")
    assert (log["b.known"].jobId, log["b.known"].jobName) == ("7", "CDC_UC_known")
    assert (log["b.sched"].jobId, log["b.sched"].jobName) == ("N/A", "CDC_UC_sched")
    assert all(r.log_time is not None for r in log.values())


def test_a_job_name_is_planned_once_and_a_broken_listing_plans_nothing_new(spark):
    rows = [
        {"Hive_table_name": f"{schema}.t1", "Hive_table_type": "MANAGED", "Sync_required": wanted, "Uc_table_name": dest}
        for schema, wanted, dest in [("b", "yes", None), ("a", "yes", "nan"), ("c", "no", None), ("a", "yes", "other"), ("a", "yes", "known")]
    ]
    pages = spark.createDataFrame(
        [(1, '{"jobs": [{"job_id": 7, "settings": {"name": "CDC_UC_t1_known"}}]}'), (2, '{"jobs": [{"job_id": 8, "sett')],
        "page_id long, listing string",
    )
    for broken in (False, True):
        reported = lookup.explode_jobs(pages if broken else pages.where("page_id = 1"), keep=("page_id",), on_error="report")
        plan = control.sync_plan(
            control.managed_worklist(ctl(spark, rows)), lookup.first_by_name(reported), listing_broken=lookup.listing_broken(reported)
        ).cache()
        got = {(r.table_name, r.destination_table_name): (r.action, r.log_message, r.job_id) for r in plan.collect()}
        new = ("fail", control.MSG_NO_LISTING, None) if broken else ("create", control.MSG_NO_SCHEDULE, None)
        assert got == {
            ("a.t1", "nan"): new,
            ("b.t1", None): new if broken else ("skip", control.MSG_KNOWN, None),
            ("c.t1", None): ("skip", control.MSG_NOT_WANTED, None),
            ("a.t1", "other"): new,
            ("a.t1", "known"): ("skip", control.MSG_KNOWN, 7),
        }
        names = {(r.table_name, r.jobName) for r in control.sync_log_rows(plan).collect() if r.status == "Skipped"}
        assert names == {("c.t1", "N/A"), ("a.t1", "CDC_UC_t1_known"), *([] if broken else [("b.t1", "CDC_UC_t1")])}
        statuses = {tuple(r)[:4]: r.Table_Status for r in control.plan_statuses(plan.unionAll(plan.withColumn("status", F.lit("Skipped")))).collect()}
        assert statuses[("a.t1", None, None, "other")] == ("Failed" if broken else "Planned")


def test_dry_run_statuses(spark):
    c = ctl(
        spark,
        [
            {"Hive_table_name": "bronze.a", "Hive_table_type": "EXTERNAL", "Uc_catalog_name": "main", "Uc_schema_name": "s"},
            {"Hive_table_name": "bronze.b", "Hive_table_type": "EXTERNAL", "Uc_catalog_name": "main", "Uc_schema_name": "s"},
            {"Hive_table_name": "bronze.c", "Hive_table_type": "MANAGED", "Uc_catalog_name": "main", "Uc_schema_name": "s"},
            {"Hive_table_name": "bronze.d", "Hive_table_type": "EXTERNAL", "Uc_catalog_name": "main", "Uc_schema_name": "zz"},
            {"Hive_table_name": "bronze.gone", "Hive_table_type": "EXTERNAL", "Uc_catalog_name": "main", "Uc_schema_name": "s"},
        ],
    )
    inv = spark.createDataFrame(
        [("hive_metastore", "bronze", t) for t in "abcd"] + [("main", "s", "B"), ("main", "s", "other")],
        "catalog string, schema string, table string",
    )
    got = {r[0]: r[1] for r in control.dry_run_check(c, inv).select("Hive_table_name", "dry_run_status").collect()}
    assert got == {
        "bronze.a": "OK",
        "bronze.b": "DEST_EXISTS",
        "bronze.c": "NOT_EXTERNAL",
        "bronze.d": "DEST_SCHEMA_MISSING",
        "bronze.gone": "SOURCE_MISSING",
    }


def test_control_from_pandas_and_sync_log_append(spark, tmpdir_path):
    import uuid

    import numpy as np
    import pandas as pd

    from stratum.sources.control import control_from_frames, control_from_pandas

    pdf = pd.DataFrame(
        {"Hive_table_name": ["bronze.a", "bronze.b"], "Uc_table_type": [np.nan, "EXTERNAL"], "Sync_required": ["", "yes"]}
    )
    c = control_from_pandas(spark, pdf)
    got = {r.Hive_table_name: r for r in c.collect()}
    assert got["bronze.a"].Uc_table_type is None and got["bronze.a"].Sync_required is None
    assert got["bronze.b"].Uc_table_type == "EXTERNAL" and c.columns == CONTROL_COLUMNS
    table = spark.createDataFrame([("bronze.a", None, "", 1), ("bronze.b", "EXTERNAL", "yes", 2)], "Hive_table_name string, Uc_table_type string, Sync_required string, more int")
    frames = control_from_frames(table)
    assert frames.schema.simpleString() == c.schema.simpleString() and sorted(map(tuple, frames.collect()), key=repr) == sorted(map(tuple, c.collect()), key=repr)
    plan = control.sync_plan(control.managed_worklist(c), spark.createDataFrame([], "job_name string, job_id long"))
    table = "sync_log_" + uuid.uuid4().hex[:8]
    control.append_sync_log(control.sync_log_rows(plan), table)
    control.append_sync_log(control.sync_log_rows(plan), table)
    assert spark.table(table).count() == 2 * plan.count()
    assert spark.table(table).where("log_time IS NULL").count() == 0
