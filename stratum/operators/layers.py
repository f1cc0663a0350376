"""Layer stages named by the pipeline (bronze -> differential -> silver -> detail -> gold).

The reference names these stages but does not contain their bodies; the semantics
here are ours (see README). All are plain DataFrame plans:

* X1 ``bronze_columns``: source-file columns (name, customer, as-of date) + clean names
* X2 ``period_differential``: per key and period, total vs previous period present;
  ``month_over_month``: against the calendar-previous month, with new / gone keys;
  ``snapshot_differential``: two as-of snapshots compared per key
* X3 ``newest_per_key`` + ``group_totals``: latest row per business key, then totals
* X4 ``detail_rollup``: totals with sub-totals (``rollup`` + ``grouping_id``)
* X6 ``gold_report``: reporting view over the silver rows joined to the dimensions
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import clean_columns
from ..functions.names import DEFAULT_ROUTES, as_of_date, route_by_name, source_file_name
MONEY = "decimal(18,2)"


def exact_sum(df: DataFrame, col: str, alias: str, scale: int = 2) -> Column:
    """Exact sum of a measure of ``df`` as a decimal.

    Decimals and integers are summed as they are; the result has their own scale or
    ``scale``, whichever is larger. A double is taken as a decimal of ``scale`` places and summed in
    whole units of the last one, in a ``long``: this keeps the aggregate on the fixed-width
    hash-aggregate path. A double that is not within rounding error of such a decimal is
    finer than ``scale`` and fails the job, as does an overflow (ANSI mode).
    """
    kind = df.schema[col].dataType
    c = F.col(col)
    if isinstance(kind, T.DecimalType):
        return F.sum(c).cast(T.DecimalType(38, max(scale, kind.scale))).alias(alias)
    if isinstance(kind, T.IntegralType):
        return F.sum(c.cast("decimal(38,0)")).cast(T.DecimalType(38, scale)).alias(alias)
    scaled = c.cast("double") * F.lit(10.0**scale)
    units = F.rint(scaled)
    near = F.abs(scaled - units) <= F.greatest(F.lit(1e-6), F.abs(scaled) * 4e-16)
    checked = F.when(c.isNull() | near, units.cast("long")).otherwise(
        F.raise_error(F.concat(F.lit(f"{col} has more than {scale} decimals: "), c.cast("string"))).cast("long")
    )
    return (F.sum(checked).cast("decimal(38,0)") / F.lit(10**scale)).cast(T.DecimalType(38, scale)).alias(alias)


def _difference(now: str, before: str) -> Column:
    """``now - before`` with a missing side as zero, at their own scale."""
    return F.coalesce(now, F.lit(0)) - F.coalesce(before, F.lit(0))


# --- X1 -------------------------------------------------------------------------------


def bronze_columns(
    df: DataFrame,
    routes: Sequence[tuple] = DEFAULT_ROUTES,
    file_name: Column | None = None,
    ingestion_ts: Column | None = None,
    clean: bool = True,
) -> DataFrame:
    """Adds ``source_file``, ``customer``, ``as_of_date`` and ``ingestion_timestamp``
    to rows read from landing files, then cleans the column names (P1).

    ``file_name`` defaults to the decoded ``_metadata.file_name`` of each row (P14).
    """
    name = file_name if file_name is not None else source_file_name()
    out = (
        df.withColumn("source_file", name)
        .withColumn("customer", route_by_name("source_file", routes, 1))
        .withColumn("as_of_date", as_of_date("source_file", route_by_name("source_file", routes, 2)))
        .withColumn(
            "ingestion_timestamp",
            ingestion_ts if ingestion_ts is not None else F.current_timestamp().cast("timestamp_ntz"),
        )
    )
    return clean_columns(out) if clean else out


# --- X2 -------------------------------------------------------------------------------


def period_totals(df: DataFrame, key: str, ts_col: str, measure: str, period: str = "month", scale: int = 2) -> DataFrame:
    """X2 step 1: ``total`` per key and period."""
    per = F.trunc(F.col(ts_col).cast("date"), period).alias("period")
    return df.groupBy(key, per).agg(exact_sum(df, measure, "total", scale))


def with_previous_period(totals: DataFrame, key: str) -> DataFrame:
    """X2 step 2: each total against the one of the previous period present for the key."""
    kind = totals.schema["total"].dataType
    prev = F.lag("total").over(Window.partitionBy(key).orderBy("period"))
    out = totals.withColumn("prev_total", prev).withColumn("diff", F.col("total") - F.col("prev_total"))
    pct = F.col("diff").cast("double") * F.lit(100.0) / F.nullif(F.col("prev_total").cast("double"), F.lit(0.0))
    return out.withColumn("diff", F.col("diff").cast(kind)).withColumn("pct_change", pct)


def period_differential(
    df: DataFrame, key: str, ts_col: str, measure: str, period: str = "month", scale: int = 2
) -> DataFrame:
    """Per key and period: ``total``, ``prev_total`` (previous period present for
    the key), ``diff`` and ``pct_change`` (NULL when there is no previous total or it
    is zero).

    One partial aggregate on (key, period); the window then runs over the
    aggregated rows only (one row per key and period).
    """
    return with_previous_period(period_totals(df, key, ts_col, measure, period, scale), key)


def month_over_month(df: DataFrame, key: str, ts_col: str, measure: str, scale: int = 2) -> DataFrame:
    """X2, calendar form: each key and month against the key's calendar-previous month.

    ``status``: ``new`` (no row the month before), ``gone`` (a row the month before, none
    now -- emitted for the month after the key's last month), ``changed`` or ``same``;
    ``diff`` treats a missing side as zero. No window: the month totals are joined with
    themselves shifted by one month (a full outer join on key and month).
    """
    month = F.trunc(F.col(ts_col).cast("date"), "month")
    cur = df.groupBy(F.col(key).alias(key), month.alias("period")).agg(exact_sum(df, measure, "total", scale))
    prev = cur.select(key, F.add_months("period", 1).alias("period"), F.col("total").alias("prev_total"))
    j = cur.join(prev, [key, "period"], "full_outer")
    status = (
        F.when(F.col("prev_total").isNull(), F.lit("new"))
        .when(F.col("total").isNull(), F.lit("gone"))
        .when(F.col("total") != F.col("prev_total"), F.lit("changed"))
        .otherwise(F.lit("same"))
    )
    diff = _difference("total", "prev_total").cast(cur.schema["total"].dataType)
    return j.select(key, "period", "total", "prev_total", diff.alias("diff"), status.alias("status"))


def snapshot_differential(
    current: DataFrame, previous: DataFrame, key: str, measure: str, scale: int = 2
) -> DataFrame:
    """X2, snapshot form: compare two as-of snapshots per key (full outer join):
    ``status`` = new / gone / changed / same, with both totals and the difference."""
    cur = current.groupBy(key).agg(exact_sum(current, measure, "cur_total", scale))
    prv = previous.groupBy(key).agg(exact_sum(previous, measure, "prev_total", scale))
    j = cur.join(prv, key, "full_outer")
    status = (
        F.when(F.col("prev_total").isNull(), F.lit("new"))
        .when(F.col("cur_total").isNull(), F.lit("gone"))
        .when(F.col("cur_total") != F.col("prev_total"), F.lit("changed"))
        .otherwise(F.lit("same"))
    )
    return j.withColumn("status", status).withColumn(
        "diff", _difference("cur_total", "prev_total").cast(cur.schema["cur_total"].dataType)
    )


# --- X3 -------------------------------------------------------------------------------


def newest_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order_cols: Sequence[str],
    columns: Sequence[str] | None = None,
    partition_by: Sequence[str] | None = None,
) -> DataFrame:
    """X3 step 1: the newest row per business key, with only the ``columns`` that are needed
    (default: all), so the scan reads no others.

    Newest by ``order_cols``, ties by ``columns`` in their order, so rows that tie are equal
    in everything that is returned. ``row_number() = 1`` keeps one row per key and task
    before the shuffle (a window group limit), so a hot key is reduced where it is read.
    ``partition_by`` (some of the keys) shuffles by these alone, for a join on them that
    follows without a second shuffle.
    """
    keys, order_cols = list(keys), list(order_cols)
    wanted = list(columns) if columns is not None else list(df.columns)
    rest = [c for c in wanted if c not in keys and c not in order_cols]
    slim = df.select(*dict.fromkeys([*keys, *order_cols, *rest]))
    if partition_by:
        slim = slim.repartition(*partition_by)
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order_cols + rest])
    return slim.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(*wanted)


def group_totals(df: DataFrame, group_cols: Sequence[str], measures: dict[str, str], scale: int = 2) -> DataFrame:
    """X3 step 2: row count and exact sums per group."""
    aggs = [F.count(F.lit(1)).alias("n_rows")] + [exact_sum(df, c, alias, scale) for alias, c in measures.items()]
    return df.groupBy(*group_cols).agg(*aggs)


def silver_rows(
    df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], group_cols: Sequence[str], measures: dict[str, str]
) -> DataFrame:
    """The newest row per key across as-of dates, with the columns that X3 and X4 total."""
    return newest_per_key(df, keys, order_cols, list(dict.fromkeys([*group_cols, *measures.values()])))


def silver_aggregation(
    df: DataFrame,
    keys: Sequence[str],
    order_cols: Sequence[str],
    group_cols: Sequence[str],
    measures: dict[str, str],
    scale: int = 2,
) -> DataFrame:
    """Newest row per key across as-of dates, then group totals."""
    return group_totals(silver_rows(df, keys, order_cols, group_cols, measures), group_cols, measures, scale)


# --- X4 -------------------------------------------------------------------------------


def detail_rollup(df: DataFrame, levels: Sequence[str], measures: dict[str, str], scale: int = 2) -> DataFrame:
    """Totals at every prefix of ``levels`` (``rollup``), with ``level_id`` =
    ``grouping_id()`` (0 = most detailed, all bits set = grand total)."""
    aggs = [F.count(F.lit(1)).alias("n_rows")] + [exact_sum(df, c, alias, scale) for alias, c in measures.items()]
    return df.rollup(*levels).agg(*aggs, F.grouping_id().cast("int").alias("level_id"))


# --- X6 -------------------------------------------------------------------------------


def newest_lines(lineitem: DataFrame) -> DataFrame:
    """The silver lines that X6 reports on, shuffled once, by order."""
    return newest_per_key(
        lineitem,
        ["l_orderkey", "l_linenumber"],
        ["l_shipdate"],
        ["l_orderkey", "l_extendedprice", "l_discount"],
        partition_by=["l_orderkey"],
    )


def gold_report(
    silver_lines: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame
) -> DataFrame:
    """Net revenue and line count per region and order year over the silver lines.

    Fact-to-fact joins (lines, orders, customers) shuffle on their keys; the lines keep
    the partitioning by ``l_orderkey`` that :func:`newest_lines` gives them.
    """
    lines = silver_lines.select(
        "l_orderkey",
        (F.col("l_extendedprice").cast(MONEY) * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).alias("_net"),
    )
    o = orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("order_year"))
    c = customer.select("c_custkey", "c_nationkey")
    n = nation.select("n_nationkey", "n_regionkey")
    r = region.select("r_regionkey", "r_name")
    joined = (
        lines.join(o, lines["l_orderkey"] == o["o_orderkey"])
        .join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return (
        joined.groupBy("r_name", "order_year")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.sum("_net").cast("decimal(38,4)").alias("net_revenue"),
        )
        .orderBy("r_name", "order_year")
    )
