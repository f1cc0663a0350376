"""The layer aggregates brought up to date from new loads equal those made from all rows."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from stratum.operators.layers import detail_rollup, group_totals, period_differential, silver_rows
from stratum.plans import incremental, refresh
from stratum.plans.refresh import PARTS, part_of, refresh_layers
from stratum.plans.stages import LayerSpec
from stratum.sources import commits, tables

SPEC = LayerSpec(
    key="kind", ts_col="at", measure="amount", business_keys=["id", "line"], group_cols=["kind", "place"],
    measures={"total": "amount", "pieces": "n"},
)
ROW = "id long, line int, kind string, place string, amount double, n long, at timestamp_ntz, customer string, as_of_date string"


def add_load(spark, bronze, run_id, rows):
    """A committed load as ``load_files`` writes it."""
    df = spark.createDataFrame(rows, ROW)
    df.coalesce(1).write.partitionBy("customer", "as_of_date").parquet(f"{bronze}/load_id={run_id}")
    names = [f.name for f in incremental._ledger_schema().fields if f.name != "run_id"]
    ledger = spark.createDataFrame([(len(rows), "load")], "rows long, decision string")
    ledger = ledger.select(*[F.col(c) if c in ledger.columns else F.lit(None).alias(c) for c in names])
    ledger.select(*[F.col(c).cast(f.dataType) for c in names for f in incremental._ledger_schema().fields if f.name == c]).write.parquet(f"{bronze}/_ledger/run_id={run_id}")
    commits.append_next(spark, f"{bronze}/_commits", state="committed", run_id=run_id, stamp="2024-01-01 00:00:00")


def some_rows(rng, n, ids, as_of):
    day = dt.datetime(2024, 1, 1)
    return [
        (rng.choice([None, *ids]), rng.randrange(2), rng.choice(["a", "b", None]), rng.choice(["x", "y", "z"]),
         rng.choice([None, rng.randrange(9999) / 100]), rng.choice([None, 1, 5]), day + dt.timedelta(days=rng.randrange(150)), "c", as_of)
        for _ in range(n)
    ]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def check(spark, sources, root, versions):
    bronze = None
    for path in sources.values():
        part = incremental.read_bronze(spark, path)
        bronze = part if bronze is None else bronze.unionByName(part)
    silver = silver_rows(bronze, SPEC.business_keys, [SPEC.ts_col, "as_of_date"], SPEC.group_cols, SPEC.measures)
    want = {
        "differential": period_differential(bronze, SPEC.key, SPEC.ts_col, SPEC.measure),
        "silver": group_totals(silver, SPEC.group_cols, SPEC.measures),
        "detail": detail_rollup(silver, SPEC.group_cols, SPEC.measures),
    }
    for name, df in want.items():
        got = tables.read_snapshot(spark, f"{root}/{name}", version=versions[name])
        assert got.schema.simpleString() == df.schema.simpleString(), name
        assert rows_of(got) == rows_of(df), name


def test_refreshes_equal_full_recomputation(spark, tmpdir_path, monkeypatch):
    rng, sources, root = random.Random(1), {"one": f"{tmpdir_path}/one", "two": f"{tmpdir_path}/two"}, f"{tmpdir_path}/out"
    add_load(spark, sources["one"], "1e10", some_rows(rng, 200, range(90), "20240131"))
    with pytest.raises(FileNotFoundError):
        refresh_layers(spark, {"none": f"{tmpdir_path}/none"}, SPEC, f"{tmpdir_path}/empty")
    first = refresh_layers(spark, sources, SPEC, root)
    check(spark, {"one": sources["one"]}, root, first)
    assert refresh_layers(spark, sources, SPEC, root) == first  # nothing new
    # replaced, new and moved rows from both sources, and two loads at once
    add_load(spark, sources["two"], "b", some_rows(rng, 60, range(60, 120), "20240229"))
    add_load(spark, sources["one"], "c", some_rows(rng, 30, range(20), "2024-03"))
    for step in ("silver_totals", "rolled_up"):  # cut off between the writes, and made again
        with monkeypatch.context() as m:
            m.setattr(refresh, step, lambda *a: (_ for _ in ()).throw(RuntimeError("cut off")))
            with pytest.raises(RuntimeError, match="cut off"):
                refresh_layers(spark, sources, SPEC, root)
    second = refresh_layers(spark, sources, SPEC, root)
    check(spark, sources, root, second)
    # one row that takes the last row of a group away
    add_load(spark, sources["two"], "d", [(7, 0, "only", "here", 1.0, 1, dt.datetime(2025, 1, 1), "c", "20250131")])
    check(spark, sources, root, refresh_layers(spark, sources, SPEC, root))
    add_load(spark, sources["two"], "e", [(7, 0, "a", "x", 1.0, 1, dt.datetime(2025, 2, 1), "c", "20250228")])
    last = refresh_layers(spark, sources, SPEC, root)
    check(spark, sources, root, last)
    assert tables.read_snapshot(spark, f"{root}/silver", version=last["silver"]).where("place = 'here'").isEmpty()


def spoil(folder):
    """Makes every data file in a folder unreadable."""
    n = 0
    for base, _, names in os.walk(folder):
        for name in names:
            if name.endswith(".parquet"):
                with open(f"{base}/{name}", "wb") as out:
                    out.write(b"no parquet")
                n += 1
    return n


def test_a_refresh_reads_only_its_load_and_the_touched_parts(spark, tmpdir_path):
    rng, bronze, root = random.Random(2), f"{tmpdir_path}/bronze", f"{tmpdir_path}/out"
    add_load(spark, bronze, "a", some_rows(rng, 400, range(200), "20240131"))
    first = refresh_layers(spark, {"s": bronze}, SPEC, root)
    held = incremental.read_bronze(spark, bronze).cache()
    held.count()
    new = [(3, 0, "a", "y", 2.5, 1, dt.datetime(2025, 1, 1), "c", "20250131"), (4, 1, "b", "x", None, 2, dt.datetime(2025, 1, 2), "c", "20250131")]
    assert spoil(f"{bronze}/load_id=a") == 1
    assert not any("load_id=" in f for f in incremental.last_ingestion(spark, bronze).inputFiles())
    add_load(spark, bronze, "b", new)
    touched = {r.part for r in spark.createDataFrame(new, ROW).select(part_of(SPEC.business_keys)).collect()}
    parts = {r["name"]: r["value"] for r in tables.read_snapshot(spark, f"{root}/_state/record").where("kind = 'part'").collect()}
    assert 20 < len(parts) <= PARTS
    for name, path in parts.items():
        if int(name) not in touched:
            assert spoil(path) == 1
    second = refresh_layers(spark, {"s": bronze}, SPEC, root)
    assert second != first
    now = {r["name"]: r["value"] for r in tables.read_snapshot(spark, f"{root}/_state/record").where("kind = 'part'").collect()}
    assert {int(n) for n in now if now[n] != parts.get(n)} == touched
    rows = held.unionByName(spark.createDataFrame(new, ROW))
    silver = silver_rows(rows, SPEC.business_keys, [SPEC.ts_col, "as_of_date"], SPEC.group_cols, SPEC.measures)
    assert rows_of(tables.read_snapshot(spark, f"{root}/silver")) == rows_of(group_totals(silver, SPEC.group_cols, SPEC.measures))
    assert rows_of(tables.read_snapshot(spark, f"{root}/differential")) == rows_of(period_differential(rows, SPEC.key, SPEC.ts_col, SPEC.measure))
