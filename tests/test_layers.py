"""X2, X3, X4, X6 semantics on small hand-checked inputs."""

import datetime as dt
from decimal import Decimal as D

import pytest

from stratum.operators import layers

T = dt.datetime


def test_period_differential(spark):
    rows = [
        ("a", T(2024, 1, 5), 10.0), ("a", T(2024, 1, 20), 5.0), ("a", T(2024, 2, 1), 30.0),
        ("a", T(2024, 4, 1), 0.0), ("a", T(2024, 5, 1), 7.0), ("b", T(2024, 2, 3), 1.25),
    ]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    got = {(r.k, r.period): r for r in layers.period_differential(df, "k", "ts", "v").collect()}
    jan, feb, apr, may = (dt.date(2024, m, 1) for m in (1, 2, 4, 5))
    assert got[("a", jan)].total == D("15.00") and got[("a", jan)].prev_total is None
    assert got[("a", feb)].diff == D("15.00") and got[("a", feb)].pct_change == 100.0
    assert got[("a", apr)].prev_total == D("30.00")  # the previous period present for the key
    assert got[("a", may)].pct_change is None  # previous total is zero
    assert got[("b", feb)].total == D("1.25") and got[("b", feb)].diff is None


def test_snapshot_differential(spark):
    cur = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "k string, v double")
    prev = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("d", 4.0)], "k string, v double")
    got = {r.k: (r.status, r.diff) for r in layers.snapshot_differential(cur, prev, "k", "v").collect()}
    assert got == {
        "a": ("same", D("0.00")), "b": ("changed", D("-3.00")), "c": ("new", D("3.00")), "d": ("gone", D("-4.00")),
    }


def test_silver_and_rollup(spark):
    rows = [
        (1, T(2024, 1, 1), "x", 1.10), (1, T(2024, 1, 2), "y", 2.20),  # key 1: newest is y
        (2, T(2024, 1, 1), "x", 3.30),
    ]
    df = spark.createDataFrame(rows, "k long, ts timestamp_ntz, g string, v double")
    newest = {r.k: r.g for r in layers.newest_per_key(df, ["k"], ["ts"]).collect()}
    assert newest == {1: "y", 2: "x"}
    silver = {r.g: (r.n_rows, r.total) for r in layers.silver_aggregation(df, ["k"], ["ts"], ["g"], {"total": "v"}).collect()}
    assert silver == {"y": (1, D("2.20")), "x": (1, D("3.30"))}
    roll = {(r.g, r.level_id): (r.n_rows, r.total) for r in layers.detail_rollup(df, ["g"], {"total": "v"}).collect()}
    assert roll == {("x", 0): (2, D("4.40")), ("y", 0): (1, D("2.20")), (None, 1): (3, D("6.60"))}


def test_sums_are_exact(spark):
    rows = [("a", 0.0004, D("123456789012345678.25"), 7), ("a", 0.0004, D("0.01"), 8), ("a", 0.0004, None, None)]
    df = spark.createDataFrame(rows, "g string, v double, d decimal(20,2), n long")
    fine = layers.detail_rollup(df, ["g"], {"v": "v", "d": "d", "n": "n"}, scale=4).where("level_id = 0").first()
    assert (fine.v, fine.d, fine.n) == (D("0.0012"), D("123456789012345678.2600"), D("15.0000"))
    with pytest.raises(Exception, match="more than 2 decimals"):
        layers.group_totals(df, ["g"], {"v": "v"}).collect()
    assert layers.group_totals(df, ["g"], {"d": "d"}).first().d == D("123456789012345678.26")
    wide = spark.createDataFrame([("a", D("1.2345")), ("a", D("1.0001"))], "g string, d decimal(30,4)")
    assert layers.group_totals(wide, ["g"], {"d": "d"}).first().d == D("2.2346")  # its own scale


def test_gold_lines_read_and_shuffle_little(spark):
    sf = "/root/testdata/sf0.001"
    t = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("lineitem", "orders", "customer", "nation", "region")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = layers.gold_report(layers.newest_lines(t["lineitem"]), *[t[n] for n in ("orders", "customer", "nation", "region")])
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = next(x for x in plan.splitlines() if "FileScan" in x and "l_orderkey" in x)
    assert scan.split("ReadSchema: struct<")[1].rstrip(">").count(":") == 5
    assert plan.count("hashpartitioning(l_orderkey") == 1  # the window and the join share it


def test_gold_report(spark):
    lines = spark.createDataFrame(
        [(1, 100.0, 0.10), (1, 50.0, 0.0), (2, 10.0, 0.5)], "l_orderkey long, l_extendedprice double, l_discount double"
    )
    orders = spark.createDataFrame(
        [(1, 7, T(2020, 3, 1)), (2, 8, T(2021, 3, 1))], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"
    )
    customer = spark.createDataFrame([(7, 0), (8, 1)], "c_custkey long, c_nationkey int")
    nation = spark.createDataFrame([(0, 0), (1, 1)], "n_nationkey int, n_regionkey int")
    region = spark.createDataFrame([(0, "EAST"), (1, "WEST")], "r_regionkey int, r_name string")
    got = [(r.r_name, r.order_year, r.n_lines, r.net_revenue) for r in layers.gold_report(lines, orders, customer, nation, region).collect()]
    assert got == [("EAST", 2020, 2, D("140.0000")), ("WEST", 2021, 1, D("5.0000"))]


def test_month_over_month_new_gone(spark):
    rows = [("a", T(2024, 1, 5), 10.0), ("a", T(2024, 2, 5), 10.0), ("a", T(2024, 4, 1), 3.0), ("b", T(2024, 2, 9), 2.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    got = {(r.k, r.period.month): (r.status, r.diff) for r in layers.month_over_month(df, "k", "ts", "v").collect()}
    assert got == {
        ("a", 1): ("new", D("10.00")), ("a", 2): ("same", D("0.00")), ("a", 3): ("gone", D("-10.00")),
        ("a", 4): ("new", D("3.00")), ("a", 5): ("gone", D("-3.00")),
        ("b", 2): ("new", D("2.00")), ("b", 3): ("gone", D("-2.00")),
    }
