"""Incremental-load bookkeeping: last run (A1), max ingestion time (A2),
incremental slice (A4), watermark upsert (U1) and status update (U2).

All are pure DataFrame functions (``base, changes -> new snapshot``); writing the
result back is ``sources.tables.commit_snapshot``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import default_timestamp

#: Watermark rows that are put into the scan as literal bounds; more are joined.
MAX_LITERAL_TABLES = 1_000


def last_run(etl_log: DataFrame, per_table: bool = False, ts_col: str = "lastExtractDateTime") -> DataFrame:
    """A1: latest extract time over the whole log (or per ``tableName``);
    an empty log or a NULL maximum gives the 1970 default.

    The global form is a single partial aggregate: each task reduces its rows to
    one value before one tiny exchange.
    """
    value = F.coalesce(F.max(ts_col), default_timestamp()).alias("last_run")
    if per_table:
        return etl_log.groupBy("tableName").agg(value)
    return etl_log.agg(value)


def max_timestamp(silver: DataFrame, ts_col: str = "ingestion_timestamp") -> DataFrame:
    """A2: ``max(ingestion_timestamp)``; NULL on an empty table."""
    return silver.agg(F.max(ts_col).alias("max_timestamp"))


def watermark_value(etl_log: DataFrame, ts_col: str = "lastExtractDateTime") -> dt.datetime:
    """A1 as one driver value (one row), for a literal filter that reaches the scan."""
    return last_run(etl_log, ts_col=ts_col).first()["last_run"]


def watermark_rows(watermark: DataFrame, table_col: str = "tableName", col: str = "last_run") -> list[tuple[str, dt.datetime]]:
    """The rows of a per-table watermark, for literal bounds that reach the scan; none if
    there are more than ``MAX_LITERAL_TABLES`` (the join alone then decides)."""
    rows = watermark.where(F.col(table_col).isNotNull()).select(table_col, F.coalesce(col, default_timestamp())).limit(MAX_LITERAL_TABLES + 1).collect()
    return [] if len(rows) > MAX_LITERAL_TABLES else [(r[0], r[1]) for r in rows]


def incremental_slice(
    df: DataFrame,
    watermark: DataFrame | dt.datetime | Column,
    ts_col: str,
    inclusive: bool = False,
    table_col: str | None = None,
    watermark_table_col: str = "tableName",
    watermark_col: str = "last_run",
    known: list[tuple[str, dt.datetime]] | None = None,
) -> DataFrame:
    """A4: rows newer than the watermark (strict ``>``; ``inclusive=True`` for ``>=``).

    * a ``datetime``/Column watermark becomes a plain predicate, which Parquet
      scans receive as a pushed filter;
    * a per-table watermark DataFrame (``tableName, last_run``) is joined on
      ``table_col``. Tables without a watermark use the 1970 default. Give its rows from
      :func:`watermark_rows` to have the scan skip what no table needs: rows up to the
      lowest watermark, unless they belong to a table without one.
    """
    if isinstance(watermark, DataFrame):
        if table_col is None:
            raise ValueError("a watermark table needs table_col")
        wm = watermark.select(F.col(watermark_table_col).alias("_wm_table"), F.col(watermark_col).alias("_wm"))
        if known:
            lowest = F.lit(min(t for _, t in known)).cast("timestamp_ntz")
            newer = F.col(ts_col) >= lowest if inclusive else F.col(ts_col) > lowest
            df = df.where(newer | ~F.col(table_col).isin([name for name, _ in known]) | F.col(table_col).isNull())
        joined = df.join(wm, F.col(table_col) == F.col("_wm_table"), "left")
        bound = F.coalesce(F.col("_wm"), default_timestamp())
        cond = F.col(ts_col) >= bound if inclusive else F.col(ts_col) > bound
        return joined.where(cond).drop("_wm_table", "_wm")
    bound = watermark if isinstance(watermark, Column) else F.lit(watermark).cast("timestamp_ntz")
    return df.where(F.col(ts_col) >= bound if inclusive else F.col(ts_col) > bound)


def upsert_watermark(
    etl_log: DataFrame, changes: DataFrame, ts_col: str = "lastExtractDateTime"
) -> DataFrame:
    """Per-table upsert of the watermark log.

    ``changes`` has ``tableName`` and a new ``ts_col`` value. New tables are inserted,
    existing ones take the newer of both values (a NULL new value keeps the old one;
    the watermark never moves backwards). Several change rows for one table reduce
    to their maximum. Applying the same changes twice gives the same log.
    """
    new = changes.groupBy("tableName").agg(F.max(ts_col).alias("_new"))
    old = etl_log.select("tableName", F.col(ts_col).alias("_old"))
    return old.join(new, "tableName", "full_outer").select(
        "tableName", F.greatest("_old", "_new").alias(ts_col)
    )


def update_status(
    control: DataFrame,
    updates: DataFrame,
    key: str | Sequence[str] = "Hive_table_name",
    value: str = "Table_Status",
) -> DataFrame:
    """Set ``value`` for the keys in ``updates``; other rows, and updates with a
    NULL value, keep the current one. Of several ``key`` columns, those after the first may be
    NULL and then match NULL.

    Two updates for one key fail the job (checked lazily inside the same plan, on the
    already-aggregated update side).
    """
    keys = [key] if isinstance(key, str) else list(key)
    upd = updates.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n"), F.max(value).alias("_v"))
    upd = upd.withColumn(
        "_new",
        F.when(F.col("_n") > 1, F.raise_error(F.concat_ws(" ", F.lit("duplicate update key:"), *[f"_{k}" for k in keys])))
        .otherwise(F.col("_v")),
    )
    same = F.col(keys[0]) == F.col(f"_{keys[0]}")
    for k in keys[1:]:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = control.join(upd, same, "left")
    return out.withColumn(value, F.coalesce(F.col("_new"), F.col(value))).select(*control.columns)
