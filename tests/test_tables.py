"""C1, C2, C5-C7, S10 and versioned snapshots."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from stratum.sources import tables


def test_run_log_roundtrip_with_quotes(spark, tmpdir_path):
    name = "run_log_" + uuid.uuid4().hex[:8]
    tables.create_run_log(spark, name, owner="acme", location=f"{tmpdir_path}/rl")
    tables.create_run_log(spark, name, owner="acme", location=f"{tmpdir_path}/rl")  # idempotent
    rows = spark.createDataFrame(
        [(1, 2, "wf", "nb1", "it's 'quoted'", dt.datetime(2024, 1, 1)), (1, 3, "wf", "nb2", "x", dt.datetime(2024, 1, 2))],
        "workflowId long, JobRunId long, workflowName string, notebookName string, logMessage string, "
        "logTime timestamp_ntz",
    )
    tables.append_run_log(rows, name)
    back = {r.JobRunId: r for r in spark.table(name).collect()}
    assert back[2].logMessage == "it's 'quoted'" and back[2].logTime == dt.datetime(2024, 1, 1)
    assert spark.table(name).columns[-1] == "notebookName"
    tables.append_run_log(rows, name)  # the same rows again, as after a run that was cut off
    assert spark.table(name).count() == 2
    null = rows.where("JobRunId = 3").selectExpr("* EXCEPT (logTime)", "CAST(NULL AS TIMESTAMP_NTZ) AS logTime")
    with pytest.raises(Exception, match="logTime must not be NULL"):
        tables.append_run_log(null, name)
    with pytest.raises(ValueError, match="key logTime broken"):
        tables.append_run_log(rows.where("JobRunId = 3").withColumn("logMessage", F.lit("other")), name)
    with pytest.raises(ValueError, match="key logTime broken"):
        two = rows.withColumn("logTime", F.lit("2024-03-01 00:00:00").cast("timestamp_ntz"))
        tables.append_run_log(two, name)
    tables.append_run_log(rows.drop("logTime").withColumn("logMessage", F.lit("now")), name)  # times are filled, and differ
    assert spark.table(name).count() == 4 and tables.check_unique_key(spark.table(name), ["logTime"]).count() == 0


def test_merge_rows_needs_row_level_operations(spark, tmpdir_path):
    name = "merge_" + uuid.uuid4().hex[:8]
    spark.range(3).withColumn("v", F.lit("a")).write.option("path", f"{tmpdir_path}/m").saveAsTable(name)
    updates = spark.createDataFrame([(1, "b")], "id long, v string")
    assert tables.merge_rows(updates, name, ["id"], ["v"]) is False
    assert spark.table(name).where("v = 'a'").count() == 3


def test_find_layer_tables(spark):
    listing = spark.createDataFrame([("detail20230630",), ("detail2_20230731",), ("Acme_all20230831x",), ("gross",)], "tableName string")
    req = spark.createDataFrame(
        [("lay", "Detail", "detail", "20230630"), ("lay", "gross", "detail", "20230630"), ("lay", "summary", "detail2", "20230731"),
         ("lay", "detail", "gross", "2023"), ("acme", "any", "x", "20230831"), ("acme", None, None, "20230630")],
        "customer string, table_type string, bronze_table_type string, as_of string",
    )
    got = [r.found for r in tables.find_layer_tables(req, listing, ["lay"], ["acme"]).orderBy("customer", "as_of", "bronze_table_type").collect()]
    assert got == [False, True, False, True, True, False]  # detail2_: no digit right after the type
    bad = spark.createDataFrame([("lay", "other", "detail", "2")], req.schema)
    with pytest.raises(Exception, match="no rule for customer"):
        tables.find_layer_tables(bad, listing, ["lay"], ["acme"]).collect()


def test_check_unique_key(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (None, 3), (2, 2)], "a long, b long")
    got = {(r.a, r.b, r.n, r.reason) for r in tables.check_unique_key(df, ["a", "b"]).collect()}
    assert got == {(1, 1, 2, "duplicate"), (None, 3, 1, "null key")}


def test_tables_exist(spark):
    inv = spark.createDataFrame([("Main", "S", "T")], "catalog string, schema string, table string")
    req = spark.createDataFrame([("main", "s", "t"), ("main", "s", "u")], "catalog string, schema string, table string")
    assert [r.exists for r in tables.tables_exist(req, inv).orderBy("table").collect()] == [True, False]


def test_like_patterns():
    assert tables.like_to_regex("detail[0-9]*") == "(?i)^(?:detail[0-9].*)$"


def test_find_dated_tables(spark):
    listing = spark.createDataFrame(
        [("detail20230630",), ("detail",), ("detail_x20230630",), ("GROSS20230531",), ("claimsfull_20230630",),
         ("updatevalues20230101",)],
        "tableName string",
    )
    req = spark.createDataFrame(
        [("detail", "20230630"), ("detail", "20230531"), ("gross", "20230531"), ("summary", "2023")],
        "kind string, as_of string",
    )
    got = {(r.kind, r.as_of): r.found for r in tables.find_dated_tables(req, listing, tables.layer_kind_patterns()).collect()}
    assert got == {("detail", "20230630"): True, ("detail", "20230531"): False, ("gross", "20230531"): True,
                   ("summary", "2023"): False}
    req6 = spark.createDataFrame([("CLAIMSFULL", "0630"), (" ", "2023"), ("lossevents", "2023")], "kind string, as_of string")
    got6 = {(r.kind, r.as_of): r.found for r in tables.find_dated_tables(req6, listing).collect()}
    assert got6 == {("CLAIMSFULL", "0630"): True, (" ", "2023"): True, ("lossevents", "2023"): False}
    bad = spark.createDataFrame([("nope", "1")], "kind string, as_of string")
    with pytest.raises(Exception, match="unknown table kind"):
        tables.find_dated_tables(bad, listing).collect()


def test_commit_snapshot_versions(spark, tmpdir_path):
    base = f"{tmpdir_path}/snap"
    assert tables.latest_version(spark, base) is None
    v0 = tables.commit_snapshot(spark.range(3), base)
    v1 = tables.commit_snapshot(spark.range(5), base)
    assert (v0, v1) == (0, 1)
    assert tables.read_snapshot(spark, base).count() == 5
    tables.commit_snapshot(spark.range(7), base, version=1)  # a retried write of version 1
    assert tables.read_snapshot(spark, base).count() == 7
    assert tables.read_snapshot(spark, base, version=0).count() == 3


def test_run_log_key_check_reads_the_touched_months(spark, tmpdir_path):
    name = "run_log_" + uuid.uuid4().hex[:8]
    tables.create_run_log(spark, name, location=f"{tmpdir_path}/rl")
    rows = spark.createDataFrame([(1, "nb", f"2024-0{m}-01 00:00:00", "x") for m in (1, 2, 3)], "JobRunId long, notebookName string, t string, logMessage string")
    rows = rows.select("JobRunId", "notebookName", F.col("t").cast("timestamp_ntz").alias("logTime"), "logMessage")
    tables.append_run_log(rows, name)
    near = tables.logged_near(rows.where("logTime >= '2024-03-01'").withColumn(tables.LOG_MONTH, F.lit("2024-03")), name)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(logMonth" in plan and len(near.inputFiles()) >= 1 and near.count() == 1
    assert all("logMonth=2024-03" in f for f in near.inputFiles())
    tables.append_run_log(rows, name)  # the same rows again
    assert spark.table(name).count() == 3


def test_catalog_query_lists_a_table_per_ten_suppliers(spark, tmpdir_path):
    from checks.oracle_sql import ORACLE
    from stratum.plans.registry import REGISTRY

    keys = [(k,) for k in (0, 9, 10, 10, 57, 57, 123, None)]
    spark.createDataFrame(keys, "s_suppkey long").write.parquet(f"{tmpdir_path}/supplier.parquet")
    got = REGISTRY["C3_catalog_inventory"](spark, tmpdir_path)
    assert got.columns == ["catalog", "schema", "table"]
    rows = sorted(map(tuple, got.collect()), key=repr)
    want = [("spark_catalog", s, t) for s, t in (("0", "t0"), ("0", "t5"), ("1", "t1"), ("2", "t12"), (None, None))]
    assert rows == sorted(want, key=repr)
    assert "FROM supplier" in ORACLE["C3_catalog_inventory"]


def test_catalog_inventory_and_schemas(spark):
    inv = tables.catalog_inventory(spark, ["spark_catalog"])
    assert set(inv.columns) == {"catalog", "schema", "table"}
    demo = spark.createDataFrame(
        [("c1", "b", "t1"), ("c1", "a", "t2"), ("c1", "a", "t3"), ("c2", "x", "t")], "catalog string, schema string, table string"
    )
    got = {r.catalog: r.schemas for r in tables.catalog_schemas(demo).collect()}
    assert got == {"c1": ["a", "b"], "c2": ["x"]}


def test_a_delta_of_one_task_is_read_by_many(spark, tmpdir_path):
    base, n = f"{tmpdir_path}/delta", 2 * tables.DELTA_FILE_ROWS + 1
    tables.commit_snapshot(spark.range(1), base)
    tables.commit_delta(spark.range(n).coalesce(1), base)
    _, deltas = tables.read_with_deltas(spark, base)
    per_file = deltas.groupBy(F.input_file_name()).count().collect()
    assert len(per_file) >= 3 and sum(r["count"] for r in per_file) == n
    assert max(r["count"] for r in per_file) <= tables.DELTA_FILE_ROWS


def test_cdc_query_streams_the_files_of_its_feed_side_by_side(spark, tmpdir_path):
    import os

    from stratum.plans.registry import REGISTRY
    from stratum.session import shared_dir

    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    orders.repartition(4).write.parquet(f"{tmpdir_path}/orders.parquet")
    root = shared_dir(spark).removeprefix("file:") + "/stratum"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    rows = REGISTRY["X5_cdc_stream"](spark, tmpdir_path)
    want = REGISTRY["X5_cdc_apply"](spark, tmpdir_path)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, want.collect()))
    [base] = [f for f in set(os.listdir(root)) - before if f.startswith("cdc-base")]
    deltas = sorted(os.listdir(f"{root}/{base}/_deltas"))
    assert deltas == ["delta_version=3", "delta_version=4"]  # a batch an arrival
    for d in deltas:
        assert sum(f.endswith(".parquet") for f in os.listdir(f"{root}/{base}/_deltas/{d}")) > 1
