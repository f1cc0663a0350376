"""Incremental refresh of the layer aggregates (X2, X3, X4) from the loads that are new.

What is kept between runs, under ``<root>/_state`` and as snapshot versions:

* the totals by key and period (X2): a load's totals are added, and the previous-period
  columns are made anew for the keys that it has;
* the current row of every business key (X3), in ``PARTS`` parts by the hash of the key: the
  parts that a load's keys fall into are merged with the load (newest row wins) and written
  again; other parts are neither read nor written;
* the totals by group (X3): what the touched parts held before is taken off, what they hold now
  is added. Sums are exact decimals, so nothing drifts; the rollup (X4) is made from the groups.

A refresh reads the new loads' rows, the touched parts and the aggregates, never the bronze
table. Its last write is a state record that names the loads it has applied, the part
files and the versions of the aggregates; the next refresh starts from exactly these, so one
that was cut off is simply made again. Refreshes of one root run one at a time, under a lease.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layers import exact_sum, newest_per_key, period_totals, with_previous_period
from ..sources import commits
from ..sources.tables import commit_snapshot, latest_version, read_snapshot
from .incremental import data_runs, read_loads

#: Parts of the current rows; a load of few keys touches as many parts at most.
PARTS = 64
STATE = "kind string, name string, value string"


def part_of(keys: Sequence[str], parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int").alias("part")


def group_sums(rows: DataFrame, group_cols: Sequence[str], measures: dict[str, str], sign: int = 1) -> DataFrame:
    """Signed totals of ``rows`` by group: ``n_rows``, each measure's sum and the number ``_n_*``
    of its values, as a sum of no values is NULL."""
    aggs = [(F.count(F.lit(1)) * sign).alias("n_rows")]
    for alias, c in measures.items():
        aggs += [exact_sum(rows, c, alias), (F.count(c) * sign).alias(f"_n_{alias}")]
    out = rows.groupBy(*group_cols).agg(*aggs)
    return out.withColumns({alias: F.col(alias) * sign for alias in measures}) if sign < 0 else out


def add_sums(parts: Sequence[DataFrame], group_cols: Sequence[str], measures: dict[str, str]) -> DataFrame:
    """The sum of several :func:`group_sums`; groups without a row left are gone."""
    kinds = dict(parts[0].dtypes)
    both = reduce(DataFrame.unionByName, parts).groupBy(*group_cols)
    names = ["n_rows", *[n for alias in measures for n in (alias, f"_n_{alias}")]]
    out = both.agg(*[F.sum(n).cast(kinds[n]).alias(n) for n in names]).where("n_rows > 0")
    return out.withColumns({alias: F.when(F.col(f"_n_{alias}") > 0, F.col(alias)) for alias in measures})


def silver_totals(sums: DataFrame, group_cols: Sequence[str], measures: dict[str, str]) -> DataFrame:
    """X3 from the kept sums."""
    return sums.select(*group_cols, "n_rows", *measures)


def rolled_up(sums: DataFrame, levels: Sequence[str], measures: dict[str, str]) -> DataFrame:
    """X4 from the kept sums: totals at every prefix of ``levels``."""
    kinds = dict(sums.dtypes)
    aggs = [F.sum(n).cast(kinds[n]).alias(n) for n in ("n_rows", *measures)]
    return sums.rollup(*levels).agg(*aggs, F.grouping_id().cast("int").alias("level_id"))


def add_periods(old: DataFrame, load: DataFrame, key: str) -> DataFrame:
    """X2 with the totals by key and period of a load added: rows of other keys as they are."""
    kind = dict(load.dtypes)["total"]
    touched = load.select(F.col(key).alias("_touched")).distinct()
    mine = F.col(key).eqNullSafe(F.col("_touched"))
    changed = old.join(touched, mine, "left_semi").select(key, "period", "total").unionByName(load)
    totals = changed.groupBy(key, "period").agg(F.sum("total").cast(kind).alias("total"))
    return old.join(touched, mine, "left_anti").unionByName(with_previous_period(totals, key))


def _read_state(spark: SparkSession, root: str) -> DataFrame | None:
    base = f"{root}/_state/record"
    return read_snapshot(spark, base) if latest_version(spark, base) is not None else None


def refresh_layers(spark: SparkSession, bronze: dict[str, str], spec, root: str, parts: int = PARTS) -> dict[str, int]:
    """Brings the outputs of a ``LayerSpec`` under ``root`` up to the committed loads of the
    ``bronze`` tables (paths by source); returns the versions of ``differential``, ``silver``
    and ``detail``. Without a new load nothing is written."""
    with commits.exclusively(spark, f"{root}/_state/log"):
        return _refresh(spark, bronze, spec, root, parts)


def _refresh(spark: SparkSession, bronze: dict[str, str], spec, root: str, parts: int) -> dict[str, int]:
    state = _read_state(spark, root)
    kept = [] if state is None else state.collect()  # a row a load, part and output
    applied = {(r["name"], r["value"]) for r in kept if r["kind"] == "run"}
    files = {int(r["name"]): r["value"] for r in kept if r["kind"] == "part"}
    versions = {r["name"]: int(r["value"]) for r in kept if r["kind"] == "version"}
    new = {src: [r for r in data_runs(spark, path) if (src, r) not in applied] for src, path in bronze.items()}
    if state is not None and not any(new.values()):
        return {n: versions[n] for n in ("differential", "silver", "detail")}
    loads = [read_loads(spark, bronze[src], runs) for src, runs in new.items() if runs]
    if not loads:
        raise FileNotFoundError(f"no load with a row under {sorted(bronze.values())}")
    load = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), loads)

    measures = spec.measures or {"total": spec.measure}
    order = [spec.ts_col, "as_of_date"]
    columns = list(dict.fromkeys([*spec.business_keys, *order, *spec.group_cols, *measures.values()]))
    slim = load.select(*columns)
    touched = sorted(r["part"] for r in slim.select(part_of(spec.business_keys, parts)).distinct().collect())  # ``parts`` at most
    before = [files[p] for p in touched if p in files]
    old = spark.read.schema(slim.schema).parquet(*before) if before else spark.createDataFrame([], slim.schema)
    merged = newest_per_key(old.unionByName(slim), spec.business_keys, order, columns)
    tag = uuid.uuid4().hex
    path = f"{root}/_state/rows/{tag}"
    by_part = merged.withColumn("part", part_of(spec.business_keys, parts))
    by_part.repartition("part").write.partitionBy("part").parquet(path)
    now = spark.read.schema(slim.schema).parquet(*[f"{path}/part={p}" for p in touched])

    sums = [group_sums(now, spec.group_cols, measures)]
    added = period_totals(load, spec.key, spec.ts_col, spec.measure)
    if state is None:
        periods = with_previous_period(added, spec.key)
    else:
        sums += [read_snapshot(spark, f"{root}/_state/sums", version=versions["sums"]), group_sums(old, spec.group_cols, measures, -1)]
        periods = add_periods(read_snapshot(spark, f"{root}/differential", version=versions["differential"]), added, spec.key)
    versions["sums"] = commit_snapshot(add_sums(sums, spec.group_cols, measures), f"{root}/_state/sums")
    kept_sums = read_snapshot(spark, f"{root}/_state/sums", version=versions["sums"])
    versions |= {
        "differential": commit_snapshot(periods, f"{root}/differential"),
        "silver": commit_snapshot(silver_totals(kept_sums, spec.group_cols, measures), f"{root}/silver"),
        "detail": commit_snapshot(rolled_up(kept_sums, spec.group_cols, measures), f"{root}/detail"),
    }
    files |= {p: f"{path}/part={p}" for p in touched}
    record = [("run", src, r) for src, runs in new.items() for r in runs] + [("run", *a) for a in sorted(applied)]
    record += [("part", str(p), f) for p, f in sorted(files.items())] + [("version", n, str(v)) for n, v in sorted(versions.items())]
    commit_snapshot(spark.createDataFrame(record, STATE).coalesce(1), f"{root}/_state/record")
    return {n: versions[n] for n in ("differential", "silver", "detail")}
