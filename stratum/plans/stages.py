"""Entry point A: the layered stages in their order, in both workflow shapes.

    layers: bronze loads (one per landing folder, in parallel) -> backup
      -> period differential (X2) -> silver aggregation (X3) -> detail rollup (X4)
    gold:   bronze load -> backup -> gold report (X6)

The backup runs only when every load succeeded, and moves exactly the files that the
loads' ledgers name. Each stage is a DataFrame plan written to its own location; the
functions only fix the order and the gate. Stage outputs are written as new snapshot
versions, so a failed run leaves the previous versions readable.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..functions.names import DEFAULT_ROUTES
from ..sources.tables import commit_snapshot
from .incremental import archive_runs, finish_runs, load_files, loaded_rows, read_bronze
from .refresh import refresh_layers

#: Loads that run at the same time; Spark schedules their tasks together.
PARALLEL_LOADS = 4


@dataclass
class BronzeSource:
    name: str
    landing: str
    schema: StructType


@dataclass
class LayerSpec:
    """Column roles in the bronze rows used by the downstream stages."""

    key: str
    ts_col: str
    measure: str
    business_keys: Sequence[str]
    group_cols: Sequence[str]
    measures: dict[str, str] = field(default_factory=dict)


@dataclass
class StageResult:
    loaded_rows: dict[str, int]
    archived: int
    versions: dict[str, int]


def load_and_back_up(
    spark: SparkSession, sources: Sequence[BronzeSource], root: str, run_log_table: str, now: dt.datetime
) -> tuple[dict[str, int], int]:
    """The bronze loads, then the backup: rows loaded per source, and files moved. A load
    that raises stops the run before any file is moved."""

    def load(item: tuple[int, BronzeSource]) -> str:
        n, src = item
        stamp = now + dt.timedelta(seconds=n)  # the times of two sources' log rows must differ
        return load_files(spark, src.landing, src.schema, f"{root}/bronze/{src.name}", DEFAULT_ROUTES, stamp)

    with ThreadPoolExecutor(max(1, min(PARALLEL_LOADS, len(sources)))) as pool:
        runs = list(pool.map(load, enumerate(sources)))  # each writes to folders of its own
    loaded = {}
    for src, run_id in zip(sources, runs, strict=True):
        bronze = f"{root}/bronze/{src.name}"
        finish_runs(spark, bronze, src.name, f"{root}/etl_log/{src.name}", run_log_table, archive=False)
        loaded[src.name] = loaded_rows(spark, bronze, run_id)
    archived = sum(archive_runs(spark, f"{root}/bronze/{src.name}").get("moved", 0) for src in sources)
    return loaded, archived


def _bronze(spark: SparkSession, sources: Sequence[BronzeSource], root: str) -> DataFrame:
    out = None
    for src in sources:
        part = read_bronze(spark, f"{root}/bronze/{src.name}")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def run_layer_stages(
    spark: SparkSession,
    sources: Sequence[BronzeSource],
    spec: LayerSpec,
    root: str,
    run_log_table: str,
    now: dt.datetime | None = None,
) -> StageResult:
    """Bronze loads, backup, then X2 over the bronze rows, X3 over the newest row per
    business key, and X4 over the same silver rows, so that a row that a newer as-of date
    replaced counts in neither.

    X2 to X4 are refreshed from the loads that they do not have yet (``plans.refresh``): a
    second arrival costs its own rows and the keys and groups that it touches. Outputs:
    ``<root>/bronze/<name>``, ``<root>/differential``, ``<root>/silver``, ``<root>/detail`` (the
    last three as snapshot versions).
    """
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    loaded, archived = load_and_back_up(spark, sources, root, run_log_table, now)
    versions = refresh_layers(spark, {src.name: f"{root}/bronze/{src.name}" for src in sources}, spec, root)
    return StageResult(loaded, archived, versions)


def run_gold_stages(
    spark: SparkSession,
    source: BronzeSource,
    report: Callable[[DataFrame], DataFrame],
    root: str,
    run_log_table: str,
    now: dt.datetime | None = None,
) -> StageResult:
    """Bronze load, backup, then the gold report (X6) over the bronze rows, committed as a
    version of ``<root>/gold``."""
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    loaded, archived = load_and_back_up(spark, [source], root, run_log_table, now)
    version = commit_snapshot(report(_bronze(spark, [source], root)), f"{root}/gold")
    return StageResult(loaded, archived, {"gold": version})
