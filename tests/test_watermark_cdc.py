"""A1-A4, U1, U2 and X5."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stratum.operators import cdc, watermark
from stratum.plans import derived

SF = "/root/testdata/sf0.01"
T = dt.datetime


def test_last_run_empty_and_null(spark):
    empty = spark.createDataFrame([], "tableName string, lastExtractDateTime timestamp_ntz")
    assert watermark.last_run(empty).first()[0] == T(1970, 1, 1)
    nulls = spark.createDataFrame([("a", None)], "tableName string, lastExtractDateTime timestamp_ntz")
    assert watermark.last_run(nulls).first()[0] == T(1970, 1, 1)
    assert watermark.last_run(nulls, per_table=True).first()["last_run"] == T(1970, 1, 1)
    assert watermark.max_timestamp(empty.withColumnRenamed("lastExtractDateTime", "ingestion_timestamp")).first()[0] is None


def test_incremental_slice_literal_is_pushed_to_scan(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    wm = watermark.watermark_value(derived.etl_log(spark, SF))
    sliced = watermark.incremental_slice(events, wm, "ts")
    plan = sliced._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts," in plan
    assert sliced.count() == events.where(F.col("ts") > F.lit(wm)).count()
    assert watermark.incremental_slice(events, wm, "ts", inclusive=True).count() >= sliced.count()


def test_upsert_watermark(spark):
    log = spark.createDataFrame([("a", T(2024, 1, 5)), ("b", T(2024, 1, 9))], "tableName string, lastExtractDateTime timestamp_ntz")
    ch = spark.createDataFrame(
        [("a", T(2024, 1, 7)), ("a", T(2024, 1, 6)), ("b", T(2024, 1, 1)), ("c", T(2024, 1, 2)), ("b", None)],
        "tableName string, lastExtractDateTime timestamp_ntz",
    )
    once = watermark.upsert_watermark(log, ch)
    got = {r[0]: r[1] for r in once.collect()}
    assert got == {"a": T(2024, 1, 7), "b": T(2024, 1, 9), "c": T(2024, 1, 2)}
    twice = watermark.upsert_watermark(once, ch)
    assert sorted(twice.collect()) == sorted(once.collect())


def test_update_status(spark):
    c = spark.createDataFrame([("t1", "OLD"), ("t2", "OLD"), ("t3", None)], "Hive_table_name string, Table_Status string")
    u = spark.createDataFrame([("t1", "DONE"), ("t3", None), ("t9", "X")], "Hive_table_name string, Table_Status string")
    got = {r[0]: r[1] for r in watermark.update_status(c, u).collect()}
    assert got == {"t1": "DONE", "t2": "OLD", "t3": None}
    dup = spark.createDataFrame([("t1", "A"), ("t1", "B")], "Hive_table_name string, Table_Status string")
    with pytest.raises(Exception, match="duplicate update key"):
        watermark.update_status(c, dup).collect()


def test_cdc_apply_and_replay(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    ch = spark.createDataFrame(
        [(1, 1, "U", "a1"), (1, 2, "U", "a2"), (2, 5, "D", None), (4, 1, "I", "d"), (5, 1, "I", "e"), (5, 2, "D", None)],
        "k long, seq long, op string, v string",
    )
    out = cdc.cdc_apply(base, ch, ["k"])
    assert sorted(map(tuple, out.collect())) == [(1, "a2"), (3, "c"), (4, "d")]
    again = cdc.cdc_apply(out, ch, ["k"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))
    bad = spark.createDataFrame([(1, 1, "X", "z")], "k long, seq long, op string, v string")
    with pytest.raises(Exception, match="unknown change op"):
        cdc.cdc_apply(base, bad, ["k"]).collect()


def test_cdc_rejects_unknown_ops_on_older_changes_and_null_keys(spark):
    base = spark.createDataFrame([(1, "a")], "k long, v string")
    schema = "k long, seq long, op string, v string"
    for rows, why in (([(1, 1, "X", "z"), (1, 2, "U", "ok")], "unknown change op"), ([(None, 1, "I", "z")], "change without a key")):
        for in_place in (False, True):
            with pytest.raises(Exception, match=why):
                cdc.cdc_apply(base, spark.createDataFrame(rows, schema), ["k"], keep_base_in_place=in_place).collect()


def test_cdc_plans_agree_and_small_feed_does_not_shuffle_base(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    feed = derived.change_feed(spark, SF)
    small = cdc.cdc_apply(orders, feed, ["o_orderkey"], keep_base_in_place=True)
    shuffled = cdc.cdc_apply(orders, feed, ["o_orderkey"])
    assert small.exceptAll(shuffled).count() == 0 and shuffled.exceptAll(small).count() == 0
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    text = shuffled._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and text.count("FileScan") == 2  # the base once, the feed once


def test_incremental_slice_pushes_the_lowest_watermark(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "event_type", "ts")
    wm = watermark.last_run(derived.etl_log(spark, SF), per_table=True)
    known = watermark.watermark_rows(wm)
    out = watermark.incremental_slice(ev, wm, "ts", table_col="event_type", known=known)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts," in plan.split("PushedFilters:")[1].split("\n")[0]
    joined = watermark.incremental_slice(ev, wm, "ts", table_col="event_type")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, joined.collect()))
    # a table without a watermark keeps all its rows
    some = wm.where("tableName <> 'click'") if ev.where("event_type = 'click'").count() else wm.limit(1)
    out = watermark.incremental_slice(ev, some, "ts", table_col="event_type", known=watermark.watermark_rows(some))
    joined = watermark.incremental_slice(ev, some, "ts", table_col="event_type")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, joined.collect()))
