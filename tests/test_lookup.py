"""J1-J4 and the exact substring join."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratum.operators import lookup
from stratum.operators.joins import contains_any


def test_resolve_catalog(spark):
    cat = spark.createDataFrame(
        [("Acme", "DEV", "cat_b"), ("acme", "dev", "cat_a"), ("acme", "prod", "cat_p"), ("other", "dev", "cat_o")],
        "customer string, environment string, catalogName string",
    )
    req = spark.createDataFrame(
        [("acme", "job-qa-1"), ("acme", "job-prod-2"), ("Acme", "job-dev-3"), ("zed", "job-dev-4"), ("acme", "x")],
        "client string, cluster_name string",
    )
    out = lookup.resolve_catalog(lookup.environment_from_cluster(req), cat)
    got = {(r.client, r.cluster_name): r.catalogName for r in out.collect()}
    assert got == {
        ("acme", "job-qa-1"): "cat_a",  # qa shares dev; tie broken by the smallest name
        ("acme", "job-prod-2"): "cat_p",
        ("Acme", "job-dev-3"): None,  # the client is not lowered
        ("zed", "job-dev-4"): None,
        ("acme", "x"): None,
    }


def test_building_a_plan_runs_no_job(spark):
    """Lookups, checks and plans are lazy, and gather no side into one task."""
    from stratum.operators import cdc, control
    from stratum.plans import derived

    sf = "/root/testdata/sf0.001"
    # reading the inputs' schemas runs jobs; what follows must not
    ctl, inv = derived.control(spark, sf), derived.inventory(spark, sf)
    listing = lookup.explode_jobs(derived.job_listings(spark, sf), keep=("page_id",))
    requests = lookup.environment_from_cluster(derived.catalog_requests(spark, sf))
    names = derived.catalog_names(spark, sf)
    orders, feed = spark.read.parquet(f"{sf}/orders.parquet"), derived.change_feed(spark, sf)
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    plans = [
        lookup.resolve_catalog(requests, names),
        lookup.lookup_by_name(ctl.select(control.sync_job_name().alias("job_name")), listing, order_cols=("page_id", "pos")),
        control.dry_run_check(ctl, inv),
        control.sync_plan(control.managed_worklist(ctl), lookup.first_by_name(listing, order_cols=("page_id", "pos"))),
        cdc.cdc_apply(orders, feed, ["o_orderkey"]),
    ]
    texts = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    assert set(tracker.getJobIdsForGroup(None)) == before
    assert all("GlobalLimit" not in t and "CollectLimit" not in t for t in texts)
    # the only single partition is the subquery that counts the listing of J4
    assert [t.count("SinglePartition") for t in texts] == [0, texts[1].count("SinglePartition"), 0, 0, 0]
    assert texts[1].count("SinglePartition") <= 1


def test_validate_storage(spark):
    req = spark.createDataFrame(
        [("s3://bucket-a/x",), ("s3://bucket-z/x",), ("",), (None,), ("noslash",), ("abfss://c@acct/dir",)],
        "storage_name string",
    )
    loc = spark.createDataFrame(
        [("l1", "s3://bucket-a/landing/"), ("l2", "abfss://c@acct.dfs.core.windows.net/")], "name string, url string"
    )
    got = {r[0]: r[1] for r in lookup.validate_storage(req, loc).select("storage_name", "valid").collect()}
    assert got == {
        "s3://bucket-a/x": True,
        "s3://bucket-z/x": False,
        "": False,
        None: False,
        "noslash": False,
        "abfss://c@acct/dir": True,  # substring of the location URL
    }
    exact = {r[0]: r[1] for r in lookup.validate_storage(req, loc, exact=True).select("storage_name", "valid").collect()}
    assert exact["abfss://c@acct/dir"] is False and exact["s3://bucket-a/x"] is True
    raw = lookup.validate_storage(req, loc, use_root=False).where("valid").count()
    assert raw == 0  # the raw names are not substrings of the URLs


@settings(max_examples=15, deadline=None)
@given(
    needles=st.lists(st.text(alphabet="ab/c", max_size=4), max_size=6),
    hay=st.lists(st.text(alphabet="ab/c", max_size=7), max_size=5),
)
def test_contains_any_equals_brute_force(spark, needles, hay):
    n = spark.createDataFrame([(x,) for x in needles], "needle string")
    h = spark.createDataFrame([(x,) for x in hay], "text string")
    want = {x: any(x in t for t in hay) for x in needles}
    got = {r.needle: r.matched for r in contains_any(n, "needle", h, "text").collect()}
    assert got == want


def test_contains_any_with_hundreds_of_needle_lengths(spark):
    """600 lengths, short and long, with grams that many texts share."""
    import random

    rng = random.Random(5)
    texts = ["https://host.example.com/" + "".join(rng.choice("abcde/") for _ in range(rng.randrange(900))) for _ in range(12)]
    needles = []
    for k in range(1, 601):
        t = rng.choice(texts)
        at = rng.randrange(max(1, len(t) - k + 1))
        needles.append(t[at : at + k] if k % 3 else t[at : at + k - 1] + "#")
    needles += ["https://", "https://host.example.com/", "example.com", "", "zzz"]
    want = {x: any(x in t for t in texts) for x in needles}
    n = spark.createDataFrame([(x,) for x in needles], "needle string")
    h = spark.createDataFrame([(x,) for x in texts], "text string")
    assert {r.needle: r.matched for r in contains_any(n, "needle", h, "text").collect()} == want


def test_no_text_is_shuffled_by_its_substrings(spark):
    """A join shuffles numbers by substring, and texts by their number alone; a substring that
    all texts have is one counted row."""
    import re

    from stratum.operators.joins import GRAM, matching_needles

    texts = [(i % 2, f"https://host{i}.example.com/{i * 7919}") for i in range(300)]
    needles = [(0, "https://"), (0, "https://host4.ex"), (1, "https://host4.ex"), (1, "ample.com/7919"), (0, "")]
    h = spark.createDataFrame(texts, "k int, text string").repartition(4)
    n = spark.createDataFrame(needles, "k int, needle string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = matching_needles(n, "needle", h, "text", ["k"])
        plan = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
        assert sorted(map(tuple, out.collect())) == [(0, ""), (0, "https://"), (0, "https://host4.ex"), (1, "ample.com/7919")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffles = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: hashpartitioning\((.*?), \d+\)", plan)
    by_gram = [columns for columns, keys in shuffles if "_gram" in keys]
    assert len(by_gram) >= 3 and not any("_hay" in columns for columns in by_gram)
    hot = spark.createDataFrame([("x" * GRAM + str(i),) for i in range(500)], "text string")
    assert matching_needles(spark.createDataFrame([("x" * GRAM,)], "needle string"), "needle", hot, "text").count() == 1


def test_explode_listing_and_lookup(spark):
    docs = [
        (1, json.dumps({"jobs": [{"job_id": 10, "settings": {"name": "a"}}, {"job_id": 11, "settings": {"name": "b"}}]})),
        (2, json.dumps({"jobs": [{"job_id": 12, "settings": {"name": "a"}}]})),
        (3, json.dumps({})),
        (4, json.dumps({"jobs": []})),
    ]
    listing = lookup.explode_jobs(spark.createDataFrame(docs, "page long, listing string"), keep=("page",))
    assert listing.count() == 3
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "job_name string")
    out = {r.job_name: r for r in lookup.lookup_by_name(wanted, listing, order_cols=("page", "pos")).collect()}
    assert (out["a"].job_id, out["a"].job_id_last, out["a"].status) == (10, 12, "found")
    assert (out["c"].job_id, out["c"].status) == (None, "not found")
    empty = lookup.lookup_by_name(wanted, listing.limit(0), order_cols=("page", "pos"))
    assert {r.status for r in empty.collect()} == {"empty"}


def test_a_broken_listing_is_no_empty_one(spark):
    docs = [
        (1, '{"jobs": [{"job_id": 1, "settings": {"name": "a"}}, {"settings": {}}]}'), (2, '{"jobs": [{"job_id": 2, "sett'), (3, None), (4, ""),
        (5, "{}"), (6, '{"jobs": []}'), (7, '{"jobs": null}'), (8, "[1]"), (9, '{"jobs": 5}'), (10, '{"error_code": "X", "message": "m"}'),
    ]
    pages = spark.createDataFrame(docs, "page long, listing string")
    listing = lookup.explode_jobs(pages, keep=("page",), on_error="report")
    got = {(r.page, r.pos, r.job_id, r.job_name, r.error) for r in listing.collect()}
    assert got == {
        (1, 0, 1, "a", None), (1, 1, None, None, None), (2, None, None, None, lookup.ERROR_NOT_JSON), (3, None, None, None, lookup.ERROR_NO_LISTING),
        (4, None, None, None, lookup.ERROR_NOT_JSON), (8, None, None, None, lookup.ERROR_NO_OBJECT), (9, None, None, None, "jobs is not an array"),
        (10, None, None, None, "listing is an error: X m"),
    }
    wanted = spark.createDataFrame([("a",), ("c",)], "job_name string")
    out = {r.job_name: r.status for r in lookup.lookup_by_name(wanted, listing, order_cols=("page", "pos")).collect()}
    assert out == {"a": "found", "c": "unknown"}
    fine = lookup.explode_jobs(pages.where("page IN (5, 6, 7)"), keep=("page",))
    assert {r.status for r in lookup.lookup_by_name(wanted, fine, order_cols=("page", "pos")).collect()} == {"empty"}
    for page, error in ((2, "not valid JSON"), (3, "no listing"), (10, "X m")):
        with pytest.raises(Exception, match=error):
            lookup.explode_jobs(pages.where(f"page = {page}")).collect()
        with pytest.raises(Exception, match=error):
            lookup.explode_clusters(pages.where(f"page = {page}")).count()


def test_explode_clusters(spark):
    doc = json.dumps({"clusters": [{"cluster_name": "x", "cluster_id": "1", "state": "RUNNING"}]})
    out = lookup.explode_clusters(spark.createDataFrame([(doc,)], "listing string")).collect()
    assert [(r.cluster_name, r.cluster_id, r.state, r.pos) for r in out] == [("x", "1", "RUNNING", 0)]
