"""One key holding a third of all rows: results stay right and hot keys are reduced
map-side (a partial aggregate runs before the shuffle)."""

from pyspark.sql import functions as F

from stratum.operators import cdc, lookup
from stratum.operators.joins import contains_any
from stratum.operators.layers import newest_per_key
from stratum.sources.tables import check_unique_key

SF = "/root/testdata/sf0.01"


def skewed_lines(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    hot = F.when(F.col("l_orderkey") % 3 == 0, F.lit(0)).otherwise(F.col("l_orderkey"))
    return li.withColumn("l_orderkey", hot.cast("long")).withColumn("l_linenumber", F.lit(1))


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def partial_before_exchange(plan: str, fn: str) -> bool:
    lines = plan.splitlines()
    partial = [i for i, ln in enumerate(lines) if f"partial_{fn}" in ln]
    exchange = [i for i, ln in enumerate(lines) if "Exchange hashpartitioning" in ln]
    # in the plan text children are printed below parents
    return bool(partial) and bool(exchange) and max(partial) > min(exchange)


def test_newest_per_key_under_skew(spark):
    li = skewed_lines(spark)
    out = newest_per_key(li, ["l_orderkey", "l_linenumber"], ["l_shipdate"])
    lines = plan_of(out).splitlines()
    limits = [i for i, ln in enumerate(lines) if "WindowGroupLimit" in ln and "Partial" in ln]
    exchange = [i for i, ln in enumerate(lines) if "Exchange hashpartitioning" in ln]
    assert limits and exchange and max(limits) > min(exchange)  # one row a key and task is shuffled
    pdf = li.toPandas()
    got = out.toPandas()
    assert len(got) == pdf.groupby(["l_orderkey", "l_linenumber"]).ngroups
    newest = pdf.groupby(["l_orderkey", "l_linenumber"]).l_shipdate.max()
    merged = got.set_index(["l_orderkey", "l_linenumber"]).l_shipdate
    assert (merged.sort_index() == newest.sort_index()).all()
    assert (pdf.l_orderkey == 0).sum() > len(pdf) / 4  # the hot key really holds about a third


def test_unique_key_check_under_skew(spark):
    li = skewed_lines(spark)
    out = check_unique_key(li, ["l_orderkey", "l_linenumber"])
    assert partial_before_exchange(plan_of(out), "count")
    hot = out.where("l_orderkey = 0").first()
    assert hot.n == li.where("l_orderkey = 0").count() and hot.n > li.count() / 4


def test_cdc_hot_key_in_change_feed(spark):
    base = spark.createDataFrame([(0, "base"), (1, "one")], "k long, v string")
    n = 30000
    hot = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") + 10).alias("k"),
        F.col("id").alias("seq"),
        F.lit("U").alias("op"),
        F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"),
    )
    out = {r.k: r.v for r in cdc.cdc_apply(base, hot, ["k"]).collect()}
    assert out[0] == f"v{max(i for i in range(n) if i % 3 == 0)}"
    assert out[1] == "one" and len(out) == 2 + sum(1 for i in range(n) if i % 3)
    assert partial_before_exchange(plan_of(cdc.latest_changes(hot, ["k"])), "max")


def test_hot_needle_does_not_emit_pairs(spark):
    texts = spark.range(5000).select(F.concat(F.lit("s3://bucket/"), F.col("id").cast("string")).alias("url"))
    needles = spark.createDataFrame([("bucket",), ("nothere",), ("s3://",)], "n string")
    out = contains_any(needles, "n", texts, "url")
    rows = {r.n: r.matched for r in out.collect()}
    assert rows == {"bucket": True, "nothere": False, "s3://": True}
    assert out.count() == 3  # one row per needle, however many texts contain it


def test_lookup_hot_name(spark):
    listing = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("n"), F.col("id").cast("string"))).alias("job_name"),
        F.col("id").alias("job_id"),
        F.col("id").cast("int").alias("pos"),
    )
    wanted = spark.createDataFrame([("hot",)], "job_name string")
    out = lookup.lookup_by_name(wanted, listing)
    r = out.first()
    assert (r.job_id, r.job_id_last, r.status) == (0, 8997, "found")
    assert partial_before_exchange(plan_of(lookup.first_by_name(listing)), "min_by")
