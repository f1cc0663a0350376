"""End-to-end runs: the migration plan (entry point B) and an incremental load (C)."""

import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.plans import derived
from stratum.plans import incremental, migration
from stratum.plans.incremental import archive_runs, read_bronze, read_rejects, run_incremental_load, unfinished
from stratum.plans.migration import run_migration
from stratum.sources import commits, files, tables

SF = "/root/testdata/sf0.001"


def touch(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)


def test_run_migration(spark, tmpdir_path):
    control_path = f"{tmpdir_path}/control_csv"
    (
        derived.control(spark, SF)
        .write.option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(control_path)
    )
    log_table = "sync_log_" + uuid.uuid4().hex[:8]
    run = run_migration(
        spark, control_path, derived.job_listings(spark, SF), derived.inventory(spark, SF), log_table,
        f"{tmpdir_path}/control_table",
    )
    n_control = derived.control(spark, SF).count()
    assert run.external.count() + run.plan.count() == n_control
    assert spark.table(log_table).count() == run.plan.count()
    saved = tables.read_snapshot(spark, f"{tmpdir_path}/control_table")
    assert saved.count() == n_control
    assert saved.where("dry_run_status IS NULL").count() == 0
    planned = {r.table_name: r.status for r in run.plan.select("table_name", "status").collect()}
    got = {r.Hive_table_name: r.Table_Status for r in saved.select("Hive_table_name", "Table_Status").collect()}
    assert all(got[t] == s for t, s in planned.items())


def test_a_repeated_migration_logs_once(spark, tmpdir_path, monkeypatch):
    """Cut off at each step and repeated under its key; two destinations of one source."""
    sheet = f"{tmpdir_path}/sheet"
    touch(f"{sheet}/a.csv", "Hive_table_name,Hive_table_type,Uc_table_name,Uc_schema_name,Sync_required\n"
          "bronze.t,MANAGED,one,s,yes\nbronze.t,MANAGED,two,s,no\nbronze.t,MANAGED,two,s,no\nsilver.t,MANAGED,one,s,yes\n")  # fmt: skip
    jobs = spark.createDataFrame([(1, "{}")], "page_id long, listing string")
    table, base = "sync_log_" + uuid.uuid4().hex[:8], f"{tmpdir_path}/control"

    def run(key, when):
        return run_migration(spark, sheet, jobs, None, table, base, run_key=key, now=when)

    for step in ("update_status", "commit_snapshot", "_log"):
        with monkeypatch.context() as m:
            m.setattr(migration, step, lambda *a, **b: (_ for _ in ()).throw(RuntimeError("cut off")))
            with pytest.raises(RuntimeError, match="cut off"):
                run("first", T1)
        assert not spark.catalog.tableExists(table)
    again = run("first", T2)  # the version is there: it is logged at its own time
    assert again.control_version == 0 and run("first", T3).control_version == 0
    log = spark.table(table)
    assert log.count() == 4 and [r.t for r in log.selectExpr("cast(log_time as timestamp_ntz) t").distinct().collect()] == [T1]
    saved = sorted((r.Hive_table_name, r.Uc_table_name, r.Table_Status) for r in tables.read_snapshot(spark, base).collect())
    assert saved == [("bronze.t", "one", "Planned"), ("bronze.t", "two", "Skipped"), ("bronze.t", "two", "Skipped"), ("silver.t", "one", "Skipped")]
    # a run that was cut off before its log is completed by the next one
    with monkeypatch.context() as m:
        m.setattr(migration, "_log", lambda spark, base, key, table: (_ for _ in ()).throw(RuntimeError("cut off")) if key == "second" else None)
        with pytest.raises(RuntimeError):
            run("second", T2)
    assert run("third", T3).control_version == 2
    assert {r["t"]: r["count"] for r in spark.table(table).groupBy(F.col("log_time").cast("timestamp_ntz").alias("t")).count().collect()} == {T1: 4, T2: 4, T3: 4}


SHEET = T.StructType([T.StructField("Order Key", T.LongType()), T.StructField("Total Price", T.DoubleType())])


def load_env(spark, tmpdir_path):
    landing, bronze, etl = (f"{tmpdir_path}/{x}" for x in ("landing", "bronze", "etl"))
    table = "run_log_" + uuid.uuid4().hex[:8]
    tables.create_run_log(spark, table, location=f"{tmpdir_path}/run_log")

    def run(when, **options):
        return run_incremental_load(spark, landing, SHEET, bronze, "orders", etl, table, now=when, **options)

    return landing, bronze, etl, table, run


T1, T2, T3 = dt.datetime(2024, 1, 1, 10, 0, 0), dt.datetime(2024, 1, 2, 15, 30, 0), dt.datetime(2024, 1, 3, 8, 0, 0)


def outcome(run):
    return {r.file_name: (r.decision, r.rows) for r in run.files.collect()}


def test_run_incremental_load_is_once_per_as_of_date(spark, tmpdir_path):
    landing, bronze, etl, table, run = load_env(spark, tmpdir_path)
    touch(f"{landing}/LPT - 2023 06 30.csv", "Order Key,Total Price\n1,10.5\n2,20.0\n")
    touch(f"{landing}/2023-07_bcg.csv", "Total Price,extra,Order Key\n30.0,x,3\n")  # another order, one column more
    first = run(T1)
    assert first.loaded_rows == 3 and first.moves == {"moved": 2}
    assert sorted(os.listdir(f"{landing}/backup")) == ["2023-07_bcg_2024_01_01-10_00_00_AM.csv",
                                                       "LPT - 2023 06 30_2024_01_01-10_00_00_AM.csv"]
    # the same as-of date arrives again (a re-sent file) plus a new one
    touch(f"{landing}/LPT - 2023 06 30.csv", "Order Key,Total Price\n1,10.5\n")
    touch(f"{landing}/LPT - 2023 09 30.csv", "Order Key,Total Price\n4,40.0\n")
    second = run(T2)
    assert outcome(second) == {"LPT - 2023 06 30.csv": ("skip", 0), "LPT - 2023 09 30.csv": ("load", 1)}
    assert os.listdir(f"{landing}/skipped") == ["LPT - 2023 06 30_2024_01_02-03_30_00_PM.csv"]  # not in backup
    b = read_bronze(spark, bronze)
    assert sorted((r.OrderKey, r.TotalPrice) for r in b.collect()) == [(1, 10.5), (2, 20.0), (3, 30.0), (4, 40.0)]
    assert dict(b.dtypes)["as_of_date"] == "string"
    assert sorted({r.as_of_date for r in b.collect()}) == ["2023-07", "20230630", "20230930"]
    log = spark.table(table)
    assert sorted(r.status for r in log.collect()) == ["Skipped", "Success", "Success", "Success"]
    assert tables.check_unique_key(log, ["logTime"]).count() == 0
    wm = tables.read_snapshot(spark, etl).collect()
    assert [(r.tableName, r.lastExtractDateTime) for r in wm] == [("orders", T2)]


def test_undated_unreadable_and_sibling_files(spark, tmpdir_path):
    landing, bronze, etl, table, run = load_env(spark, tmpdir_path)
    row = "Order Key,Total Price\n{},1.0\n"
    touch(f"{landing}/LPT 20230630.csv", row.format(1))  # no dash: no date
    touch(f"{landing}/other-0001.csv", row.format(2))  # no routing token
    touch(f"{landing}/LPT - final.csv", row.format(3))  # not a date
    touch(f"{landing}/LPT - 2023 06 30.xlsx", "binary")
    touch(f"{landing}/LPT detail - 2023 06 30.csv", row.format(4))
    first = run(T1)
    assert first.loaded_rows == 1 and first.moves == {"moved": 4}
    assert len(os.listdir(f"{landing}/quarantine")) == 3 and os.path.exists(f"{landing}/LPT - 2023 06 30.xlsx")
    # a different undated file is quarantined too; a sibling of the same date is another table
    touch(f"{landing}/LPT 20230731.csv", row.format(5))
    touch(f"{landing}/LPT gross - 2023 06 30.csv", row.format(6))
    second = run(T2)
    assert outcome(second) == {
        "LPT 20230731.csv": ("quarantine", 0), "LPT gross - 2023 06 30.csv": ("load", 1), "LPT - 2023 06 30.xlsx": ("unread", 0),
    }
    assert len(os.listdir(f"{landing}/quarantine")) == 4 and len(os.listdir(f"{landing}/backup")) == 2
    assert sorted(r.OrderKey for r in read_bronze(spark, bronze).collect()) == [4, 6]
    said = {(r.status, r.logMessage.rsplit(": ", 1)[-1].rsplit(" from ", 1)[-1]) for r in spark.table(table).collect()}
    assert ("Quarantined", "LPT 20230731.csv") in said and ("Skipped", "LPT - 2023 06 30.xlsx") in said
    empty = run(T3)  # only the unreadable file is left
    assert empty.loaded_rows == 0 and outcome(empty) == {"LPT - 2023 06 30.xlsx": ("unread", 0)}


def test_only_planned_files_are_archived(spark, tmpdir_path):
    landing, bronze, etl, table, run = load_env(spark, tmpdir_path)
    touch(f"{landing}/LPT - 2023 06 30.csv", "Order Key,Total Price\n1,1.0\n")
    run(T1, archive=False)
    touch(f"{landing}/LPT - 2023 07 31.csv", "Order Key,Total Price\n2,1.0\n")  # arrives after the load
    assert archive_runs(spark, bronze) == {"moved": 1}
    assert sorted(f for f in os.listdir(landing) if f.endswith(".csv")) == ["LPT - 2023 07 31.csv"]


def test_a_bad_file_or_record_stops_nothing_else(spark, tmpdir_path, monkeypatch):
    landing, bronze, etl, table, run = load_env(spark, tmpdir_path)
    touch(f"{landing}/LPT - 2023 06 30.csv", 'Order Key,Total Price\n1,1.0\noops,2.0\n3,"x, y"\n4\n5,5.0,6\n,7.0\n')
    touch(f"{landing}/LPT - 2023 07 31.csv", "Total Price,Order Key\n8.0,8\n")
    touch(f"{landing}/LPT - 2023 08 31.csv", "Order Key\n9\n")  # a column is missing
    touch(f"{landing}/LPT - 2023 09 30.csv", "Order Key,Total Price\nall,bad\n")
    touch(f"{landing}/LPT - 2023 10 31.csv", "\n")
    touch(f"{landing}/LPT - 2023 11 30.csv", "x" * 50)  # no line end where the header is looked for
    monkeypatch.setattr(files, "HEADER_BYTES", 40)
    first = run(T1)
    assert outcome(first) == {
        "LPT - 2023 06 30.csv": ("load", 2), "LPT - 2023 07 31.csv": ("load", 1), "LPT - 2023 08 31.csv": ("quarantine", 0),
        "LPT - 2023 09 30.csv": ("load", 0), "LPT - 2023 10 31.csv": ("load", 0), "LPT - 2023 11 30.csv": ("quarantine", 0),
    }
    assert sorted(((r.OrderKey, r.TotalPrice) for r in read_bronze(spark, bronze).collect()), key=repr) == [(1, 1.0), (8, 8.0), (None, 7.0)]
    rejects = {(r.source_file[6:16], r.line): r.reason for r in read_rejects(spark, bronze).collect()}
    other = "another number of fields than the header has"
    assert rejects == {
        ("2023 06 30", "oops,2.0"): "Order Key: oops is no bigint",
        ("2023 06 30", '3,"x, y"'): "Total Price: x, y is no double",
        ("2023 06 30", "4"): other,
        ("2023 06 30", "5,5.0,6"): other,
        ("2023 09 30", "all,bad"): "Order Key: all is no bigint; Total Price: bad is no double",
    }
    said = {r.logMessage: r.status for r in spark.table(table).collect()}
    assert said["loaded 2 and rejected 4 rows from LPT - 2023 06 30.csv"] == "Partial"
    assert said["loaded 1 rows from LPT - 2023 07 31.csv"] == "Success"
    assert said["no column Total Price: LPT - 2023 08 31.csv"] == "Quarantined"
    assert len(os.listdir(f"{landing}/quarantine")) == 2 and not [f for f in os.listdir(landing) if f.endswith(".csv")]
    # a file that cannot be read takes nothing from a later name of its customer, series and date
    touch(f"{landing}/LPT - 2023.csv", "no,columns\n")
    touch(f"{landing}/LPT -2023 08 31.csv", "Order Key\n9\n")
    touch(f"{landing}/LPT-2023 08 31.csv", "Order Key,Total Price\n9,9.0\n")
    second = run(T2)
    assert outcome(second) == {"LPT - 2023.csv": ("quarantine", 0), "LPT -2023 08 31.csv": ("quarantine", 0), "LPT-2023 08 31.csv": ("load", 1)}


def test_overlapping_runs_load_each_file_once(spark, tmpdir_path, monkeypatch):
    landing, bronze, etl, table, run = load_env(spark, tmpdir_path)
    head = "Order Key,Total Price\n"
    touch(f"{landing}/LPT - 2023 06 30.csv", head + "1,1.0\n")
    touch(f"{landing}/LPT 20230731.csv", head + "2,1.0\n")
    real, others = incremental._commit, []

    def overtaken(*args):  # a whole second run comes between the first one's writes and its commit
        if not others:
            others.append(None)
            touch(f"{landing}/LPT - 2023 08 31.csv", head + "3,1.0\n")
            others[0] = run(T2)
        return real(*args)

    monkeypatch.setattr(incremental, "_commit", overtaken)
    first = run(T1)
    assert outcome(others[0]) == {"LPT - 2023 06 30.csv": ("load", 1), "LPT 20230731.csv": ("quarantine", 0), "LPT - 2023 08 31.csv": ("load", 1)}
    assert outcome(first) == {} and first.loaded_rows == 0
    assert sorted(r.OrderKey for r in read_bronze(spark, bronze).collect()) == [1, 3]
    assert spark.table(table).count() == 3 and len(os.listdir(f"{landing}/backup")) == 2
    # runs that took other files are both committed as they are; their log times differ
    others.clear()
    monkeypatch.setattr(files, "list_input_files", lambda *a, f=files.list_input_files: f(*a).where(f"file_name LIKE '%{9 + len(others)} %'"))
    touch(f"{landing}/LPT - 2023 09 30.csv", head + "4,1.0\n")
    touch(f"{landing}/LPT - 2023 10 31.csv", head + "5,1.0\n")
    before = len(os.listdir(f"{bronze}/_runs"))
    run(T3)
    assert len(os.listdir(f"{bronze}/_runs")) == before + 2  # no run was planned twice
    assert sorted(r.OrderKey for r in read_bronze(spark, bronze).collect()) == [1, 3, 4, 5]
    assert tables.check_unique_key(spark.table(table), ["logTime"]).isEmpty()


def test_simultaneous_runs(spark, tmpdir_path):
    from concurrent.futures import ThreadPoolExecutor

    landing, bronze, etl, table, run = load_env(spark, tmpdir_path)
    for i in range(1, 7):
        touch(f"{landing}/LPT - 2023 0{i} 28.csv", f"Order Key,Total Price\n{i},1.0\n")
    with ThreadPoolExecutor(3) as pool:
        done = list(pool.map(lambda n: run(T1 + dt.timedelta(seconds=n)), range(3)))
    assert sum(r.loaded_rows for r in done) == 6
    assert sorted(r.OrderKey for r in read_bronze(spark, bronze).collect()) == [1, 2, 3, 4, 5, 6]
    assert spark.table(table).count() == 6 and len(os.listdir(f"{landing}/backup")) == 6
    assert unfinished(spark, bronze).isEmpty()
    assert [r.tableName for r in tables.read_snapshot(spark, etl).collect()] == ["orders"]


def test_commit_log(spark, tmpdir_path):
    folder = f"{tmpdir_path}/log"
    assert commits.last_number(spark, folder) == 0 and commits.records(spark, folder).isEmpty()
    assert commits.append(spark, folder, 1, state="committed", run_id="a")
    assert not commits.append(spark, folder, 1, state="committed", run_id="b")
    assert commits.append_next(spark, f"file://{folder}", state="committed", run_id="c") == 2
    assert [(r.n, r.run_id) for r in commits.records(spark, folder).orderBy("n").collect()] == [(1, "a"), (2, "c")]
    assert sorted(os.listdir(folder)) == [f"{1:020d}.json", f"{2:020d}.json"]
    # a lease is given back, waited for, and over with its time if its holder is gone
    assert commits._take(spark, folder, "gone", 3.0) and not commits._take(spark, folder, "other", 9.0)
    with commits.exclusively(spark, folder, pause=0.1):
        assert not commits._take(spark, folder, "other", 9.0)
    assert commits._take(spark, folder, "other", 9.0)


def test_a_run_that_was_cut_off_is_completed(spark, tmpdir_path, monkeypatch):
    landing, bronze, etl, table, run = load_env(spark, tmpdir_path)
    touch(f"{landing}/LPT - 2023 06 30.csv", "Order Key,Total Price\n1,1.0\n")
    for where in ("append_run_log", "commit_snapshot", "archive_runs"):
        with monkeypatch.context() as m:
            m.setattr(incremental, where, lambda *a, **b: (_ for _ in ()).throw(RuntimeError("cut off")))
            with pytest.raises(RuntimeError, match="cut off"):
                run(T1)
    assert spark.table(table).count() == 1 and os.path.exists(f"{landing}/LPT - 2023 06 30.csv")
    touch(f"{landing}/LPT - 2023 07 31.csv", "Order Key,Total Price\n2,1.0\n")
    run(T2)
    assert sorted(r.OrderKey for r in read_bronze(spark, bronze).collect()) == [1, 2]
    assert len(os.listdir(f"{landing}/backup")) == 2
    log = spark.table(table)
    assert log.count() == 2 and log.where("status = 'Success'").count() == 2
    assert tables.read_snapshot(spark, etl).first().lastExtractDateTime == T2
    # a write without a commit is no load
    with monkeypatch.context() as m:
        m.setattr(incremental, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("cut off")))
        touch(f"{landing}/LPT - 2023 08 31.csv", "Order Key,Total Price\n3,1.0\n")
        with pytest.raises(RuntimeError):
            run(T3)
    assert sorted(r.OrderKey for r in read_bronze(spark, bronze).collect()) == [1, 2]
    assert run(T3).loaded_rows == 1
    assert sorted(r.OrderKey for r in read_bronze(spark, bronze).collect()) == [1, 2, 3]


def test_stream_of_arrivals_loads_each_file_once(spark, tmpdir_path, monkeypatch):
    from stratum.streaming import ingest

    landing, bronze, etl, table, run = load_env(spark, tmpdir_path)

    def arrive(when):
        query = ingest.file_arrival_load(
            spark, landing, SHEET, bronze, f"{tmpdir_path}/ckpt", max_files_per_trigger=2, stream_id="arrivals", now=lambda: when
        )
        query.awaitTermination()

    def loaded():
        return sorted(r.OrderKey for r in read_bronze(spark, bronze).collect())

    touch(f"{landing}/LPT - 2023 06 30.csv", "Order Key,Total Price\n1,1.0\nbad,1.0\n")
    touch(f"{landing}/2023-07_bcg.csv", "Total Price,extra,Order Key\n30.0,x,3\n")
    touch(f"{landing}/LPT 20230731.csv", "Order Key,Total Price\n4,1.0\n")  # undated
    arrive(T1)
    assert loaded() == [1, 3] and read_rejects(spark, bronze).count() == 1 and os.listdir(f"{landing}/quarantine")
    # a batch that fails after its commit is retried without loading anything again
    touch(f"{landing}/LPT -2023 06 30.csv", "Order Key,Total Price\n1,1.0\n")  # re-sent
    touch(f"{landing}/LPT - 2023 09 30.csv", "Order Key,Total Price\n5,1.0\n")
    with monkeypatch.context() as m:
        m.setattr(ingest, "archive_runs", lambda *a: (_ for _ in ()).throw(RuntimeError("cut off")))
        with pytest.raises(Exception, match="cut off"):
            arrive(T2)
    assert loaded() == [1, 3, 5] and not unfinished(spark, bronze).isEmpty()
    arrive(T3)
    assert loaded() == [1, 3, 5] and unfinished(spark, bronze).isEmpty()
    assert sorted(os.listdir(landing)) == ["backup", "quarantine", "skipped"] and len(os.listdir(f"{landing}/skipped")) == 1
    # a scheduled run on the same table goes on from there
    touch(f"{landing}/LPT -  2023 09 30.csv", "Order Key,Total Price\n5,1.0\n")
    assert outcome(run(T3)) == {"LPT -  2023 09 30.csv": ("skip", 0)} and loaded() == [1, 3, 5]


def test_run_layer_stages_in_order(spark, tmpdir_path):
    from stratum.plans.stages import BronzeSource, LayerSpec, run_layer_stages
    from stratum.sources import files

    land_a, land_b = f"{tmpdir_path}/land_a", f"{tmpdir_path}/land_b"
    rows = derived.sheet_rows(spark, SF)
    files.write_named_files(rows.where("file_name LIKE '%bcg%'"), "file_name", land_a, "csv", {"header": "true"})
    files.write_named_files(rows.where("file_name LIKE 'LPT%'"), "file_name", land_b, "csv", {"header": "true"})
    log_table = "run_log_" + uuid.uuid4().hex[:8]
    tables.create_run_log(spark, log_table, location=f"{tmpdir_path}/run_log")
    spec = LayerSpec(
        key="OrderPriority", ts_col="OrderDate", measure="TotalPrice", business_keys=["OrderKey"],
        group_cols=["customer", "OrderStatus"], measures={"total": "TotalPrice"},
    )
    res = run_layer_stages(
        spark,
        [BronzeSource("a", land_a, derived.SHEET_SCHEMA), BronzeSource("b", land_b, derived.SHEET_SCHEMA)],
        spec, f"{tmpdir_path}/out", log_table, now=dt.datetime(2024, 2, 1, 8, 0, 0),
    )
    dated = "file_name LIKE '%.csv' AND o_orderkey % 10 NOT IN (7, 9)"  # the others go to quarantine
    want = derived.file_names(spark, SF).where(dated).count()
    assert res.loaded_rows["a"] + res.loaded_rows["b"] == want
    assert res.archived == derived.file_names(spark, SF).where(
        "file_name LIKE '%.csv'").select("file_name").distinct().count()
    silver = tables.read_snapshot(spark, f"{tmpdir_path}/out/silver")
    assert silver.agg({"n_rows": "sum"}).first()[0] == want
    detail = tables.read_snapshot(spark, f"{tmpdir_path}/out/detail")
    assert detail.where("level_id = 3").first().n_rows == want


def test_stages_count_replaced_rows_once_and_gold_shape(spark, tmpdir_path):
    from stratum.operators.layers import group_totals
    from stratum.plans.stages import BronzeSource, LayerSpec, run_gold_stages, run_layer_stages

    schema = T.StructType([T.StructField("Order Key", T.LongType()), T.StructField("Order Date", T.TimestampNTZType()),
                           T.StructField("Order Status", T.StringType()), T.StructField("Total Price", T.DoubleType())])
    spec = LayerSpec(key="OrderStatus", ts_col="OrderDate", measure="TotalPrice", business_keys=["OrderKey"], group_cols=["OrderStatus"])
    for name in ("layers", "gold"):
        landing, root, log_table = f"{tmpdir_path}/{name}_in", f"{tmpdir_path}/{name}", "run_log_" + uuid.uuid4().hex[:8]
        tables.create_run_log(spark, log_table, location=f"{tmpdir_path}/{name}_log")
        head = "Order Key,Order Date,Order Status,Total Price\n"
        touch(f"{landing}/LPT - 2023 06 30.csv", head + "1,2023-06-01 00:00:00,O,10.0\n2,2023-06-01 00:00:00,O,5.0\n")
        touch(f"{landing}/LPT - 2023 07 31.csv", head + "1,2023-07-01 00:00:00,F,11.0\n")
        source = BronzeSource("orders", landing, schema)
        if name == "layers":
            run_layer_stages(spark, [source], spec, root, log_table, now=T1)
            detail = tables.read_snapshot(spark, f"{root}/detail").where("level_id = 1").first()
            assert (detail.n_rows, float(detail.total)) == (2, 16.0)  # order 1 counts once, as it is now
        else:
            res = run_gold_stages(spark, source, lambda b: group_totals(b, ["OrderStatus"], {"total": "TotalPrice"}), root, log_table, now=T1)
            assert res.archived == 2 and res.loaded_rows == {"orders": 3}
            got = {r.OrderStatus: float(r.total) for r in tables.read_snapshot(spark, f"{root}/gold").collect()}
            assert got == {"O": 15.0, "F": 11.0}
