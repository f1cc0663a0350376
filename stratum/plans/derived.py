"""Pipeline inputs derived from the driver tables, so every query's work grows with them.

Expressions in the ``*_EXPRS`` lists are portable SQL (Spark SQL and DuckDB read
them the same way); the oracle SQL builds the same inputs from the same text.
Date formatting differs between the dialects and is written once per dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import clean_name
from ..session import load


def _k(col: str) -> str:
    return f"CAST({col} AS STRING)"


# --- control table (from part) --------------------------------------------------------

#: A few names have no schema part.
HIVE_NAME_EXPR = f"CASE WHEN p_partkey % 97 = 5 THEN 'nodot' ELSE 'bronze.t' END || {_k('p_partkey')}"

CONTROL_EXPRS = [
    ("Hive_table_name", HIVE_NAME_EXPR),
    (
        "Hive_table_type",
        "CASE p_partkey % 4 WHEN 0 THEN 'MANAGED' WHEN 1 THEN 'EXTERNAL' WHEN 2 THEN 'managed' "
        "ELSE 'External' END",
    ),
    ("Hive_table_format", "'delta'"),
    ("Hive_table_location", f"'s3://lake' || {_k('p_partkey % 7')} || '/bronze/t' || {_k('p_partkey')} || '/'"),
    (
        "Uc_table_type",
        "CASE p_partkey % 5 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'nan' WHEN 2 THEN 'EXTERNAL' "
        "WHEN 3 THEN 'MANAGED' ELSE 'NaN' END",
    ),
    ("Uc_table_format", "'delta'"),
    (
        "Uc_table_name",
        f"CASE p_partkey % 3 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'nan' ELSE 'u' || {_k('p_partkey')} END",
    ),
    ("Uc_catalog_name", "'main'"),
    ("Uc_schema_name", "lower(p_type)"),
    (
        "Uc_external_table_location",
        f"CASE WHEN p_partkey % 4 IN (1, 3) THEN 's3://ext/t' || {_k('p_partkey')} || '/' "
        "ELSE CAST(NULL AS STRING) END",
    ),
    ("Sync_required", "CASE p_size % 5 WHEN 0 THEN 'no' WHEN 1 THEN 'YES' ELSE 'yes' END"),
    (
        "Frequency_of_sync",
        "CASE p_partkey % 9 WHEN 0 THEN 'Daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'MONTHLY' "
        "WHEN 3 THEN 'hourly' WHEN 4 THEN 'yearly' WHEN 5 THEN CAST(NULL AS STRING) WHEN 6 THEN 'nan' "
        "WHEN 7 THEN '' ELSE 'daily' END",
    ),
    (
        "Date_n_time_for_1st_schedule",
        "CASE p_size % 12 "
        f"WHEN 0 THEN {_k('p_partkey % 24')} || ':' || {_k('p_partkey % 60')} || ':00' "
        f"WHEN 1 THEN {_k('p_size % 28 + 1')} || ', ' || {_k('p_partkey % 24')} || ':52:38' "
        "WHEN 2 THEN 'Tuesday 11:52:38' WHEN 3 THEN '0:30:0' WHEN 4 THEN 'bad time' "
        "WHEN 5 THEN CAST(NULL AS STRING) WHEN 6 THEN '25:00:00' WHEN 7 THEN 'Friday   9:05:07' "
        "WHEN 8 THEN 'nan' WHEN 9 THEN '' WHEN 10 THEN '07:08:60' ELSE ' 23:59:59' END",
    ),
    ("Primary_key_for_cdc", "'id'"),
    (
        "Failure_notifications",
        f"CASE p_partkey % 6 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'nan' "
        f"ELSE 'ops' || {_k('p_partkey % 3')} || '@example.com' END",
    ),
    ("Table_Status", "CASE WHEN p_partkey % 2 = 0 THEN 'PENDING' ELSE CAST(NULL AS STRING) END"),
    ("dry_run_status", "CAST(NULL AS STRING)"),
]

#: Rows that the migration's sheet has besides: tables of another schema with the same name
#: (one job for both), and second destinations of a table.
SAME_NAME = ("p_partkey % 23 = 7", {"Hive_table_name": f"'silver.t' || {_k('p_partkey')}"})
SECOND_DESTINATION = ("p_partkey % 29 = 11", {"Uc_table_name": f"'second' || {_k('p_partkey')}"})

# Known jobs: one per part, pages of 100 jobs per listing document.
JOB_EXPRS = [
    ("page_id", "CAST(floor(p_partkey / 100) AS BIGINT)"),
    ("job_id", "1000000 + p_partkey"),
    (
        "job_name",
        f"CASE WHEN p_size % 3 = 0 THEN 'CDC_UC_t' || {_k('p_partkey')} || "
        f"CASE WHEN p_partkey % 3 = 2 THEN '_u' || {_k('p_partkey')} ELSE '' END "
        "ELSE 'other_' || p_name END",
    ),
]

#: Pages of the broken listing that are cut off, that are an error's text, and without jobs.
BROKEN_PAGES = {"cut": "page_id % 7 = 3", "error": "page_id % 7 = 5", "none": "page_id % 11 = 6"}
ERROR_PAGE = '{"error_code": "TEMPORARILY_UNAVAILABLE", "message": "try again"}'

# Catalog inventory: source tables (some renamed away) and destination tables.
INVENTORY_SOURCE_EXPRS = [
    ("catalog", "'hive_metastore'"),
    ("schema", "'bronze'"),
    ("table", f"CASE WHEN p_size > 45 THEN 't' || {_k('p_partkey')} || '_old' ELSE 't' || {_k('p_partkey')} END"),
]
INVENTORY_DEST_EXPRS = [
    ("catalog", "'main'"),
    ("schema", "CASE WHEN p_type = 'SMALL' THEN 'small_v2' ELSE lower(p_type) END"),
    (
        "table",
        f"CASE WHEN p_size % 4 = 0 THEN (CASE WHEN p_partkey % 3 = 2 THEN 'u' ELSE 't' END) || {_k('p_partkey')} "
        f"ELSE 'other_' || {_k('p_partkey')} END",
    ),
]

STATUS_UPDATE_EXPRS = [
    ("Hive_table_name", HIVE_NAME_EXPR),
    (
        "Table_Status",
        "CASE p_size % 3 WHEN 0 THEN 'MIGRATED' WHEN 1 THEN 'FAILED' ELSE CAST(NULL AS STRING) END",
    ),
]

# Clusters: one per supplier, pages of 50 per listing document; names repeat.
CLUSTER_EXPRS = [
    ("page_id", "CAST(floor(s_suppkey / 50) AS BIGINT)"),
    ("s_suppkey", "s_suppkey"),
    ("cluster_name", f"'cluster-' || {_k('s_suppkey % 17')}"),
    ("cluster_id", f"'c' || {_k('s_suppkey')}"),
    ("state", "CASE s_nationkey % 3 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'TERMINATED' ELSE 'PENDING' END"),
]
WANTED_CLUSTER_EXPR = f"'cluster-' || {_k('n_nationkey')}"

# --- customer-derived ------------------------------------------------------------------

USER_ID_EXPR = (
    "CASE c_custkey % 4 WHEN 0 THEN lower(replace(c_name, '#', '')) || '@x.com' "
    "WHEN 1 THEN lower(c_name) WHEN 2 THEN CAST(NULL AS STRING) "
    "ELSE lower(replace(c_name, '#', '.')) || '@x.com' END"
)

CATALOG_NAME_EXPRS = [
    ("customer", "CASE c_custkey % 3 WHEN 0 THEN upper(n_name) WHEN 1 THEN lower(n_name) ELSE n_name END"),
    ("environment", "CASE c_custkey % 4 WHEN 0 THEN 'DEV' WHEN 1 THEN 'qa' WHEN 2 THEN 'Prod' ELSE 'uat' END"),
    ("catalogName", f"'cat_' || lower(n_name) || '_' || {_k('c_custkey')}"),
]
CLUSTER_NAMES = ("job-dev-01", "job-QA-02", "job-prod-03", "standalone")
CLIENT_EXPR = "CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END"

# --- events-derived --------------------------------------------------------------------

# The ETL log lags the data by 15 days; changes carry the data's own times.
ETL_LOG_EXPRS = [
    ("tableName", "CASE WHEN user_id % 7 = 0 THEN event_type || '_old' ELSE event_type END"),
    ("lastExtractDateTime", "ts - INTERVAL 15 DAY"),
]
ETL_CHANGE_EXPRS = [
    ("tableName", "CASE WHEN user_id % 5 = 0 THEN event_type || '_v2' ELSE event_type END"),
    ("lastExtractDateTime", "ts"),
]
RUN_LOG_EXPRS = [
    ("workflowId", "user_id"),
    ("JobRunId", "event_id"),
    ("workflowName", "'wf_' || event_type"),
    ("notebookName", "event_type"),
    ("jobTriggerTime", "CAST(CAST(ts AS DATE) AS STRING)"),
    ("logMessage", "props"),
    ("logTime", "ts"),
    ("errorMessage", "CASE WHEN event_type = 'error' THEN 'it''s broken: ' || props ELSE CAST(NULL AS STRING) END"),
    ("status", "CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Success' END"),
    ("jobEndTime", "CAST(CAST(ts AS DATE) AS STRING)"),
    ("asOfDate", "CAST(CAST(ts AS DATE) AS STRING)"),
]

# --- pages-derived ---------------------------------------------------------------------

# Locations: one per page; the pages that are not https are elsewhere, so some requests fail.
LOCATION_EXPRS = [
    ("name", f"'loc' || {_k('page_id')}"),
    ("url", f"CASE WHEN url LIKE 'https:%' THEN url ELSE 's3://elsewhere' || {_k('page_id % 11')} || '/x' END"),
]

# --- orders-derived (dialect-specific date text) ---------------------------------------

# Landing sheet column names: header text as it arrives, cleaned by P1 on ingest.
SHEET_COLUMNS = [
    ("o_orderkey", "Order Key"),
    ("o_custkey", "Customer#Key"),
    ("o_orderstatus", "Order Status"),
    ("o_totalprice", "Total Price ($)"),
    ("o_orderdate", "Order Date"),
    ("o_orderpriority", "Order-Priority"),
]

# The landing sheet as read: header names as they arrive, with declared types.
SHEET_SCHEMA = T.StructType(
    [
        T.StructField("Order Key", T.LongType()),
        T.StructField("Customer#Key", T.LongType()),
        T.StructField("Order Status", T.StringType()),
        T.StructField("Total Price ($)", T.DoubleType()),
        T.StructField("Order Date", T.TimestampNTZType()),
        T.StructField("Order-Priority", T.StringType()),
    ]
)
# Bronze rows: cleaned sheet names plus the source-file columns added on ingest.
BRONZE_SCHEMA = T.StructType(
    [T.StructField(clean_name(f.name), f.dataType) for f in SHEET_SCHEMA.fields]
    + [
        T.StructField("source_file", T.StringType()),
        T.StructField("customer", T.StringType()),
        T.StructField("ingestion_timestamp", T.TimestampNTZType()),
        T.StructField("as_of_date", T.StringType()),
    ]
)

EXT_EXPR = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN '.csv' WHEN '2-HIGH' THEN '.csv' WHEN '3-MEDIUM' THEN '.xlsx' "
    "WHEN '4-NOT SPECIFIED' THEN '.XLS' ELSE '.txt' END"
)

#: Two arrivals in one landing folder: the orders before this day, then the others together with
#: some of the first ones again (re-sent files of dates that are loaded).
SECOND_ARRIVAL = "1998-07-01"
ARRIVAL_EXPRS = {
    1: f"o_orderdate < TIMESTAMP '{SECOND_ARRIVAL} 00:00:00'",
    2: f"(o_orderdate >= TIMESTAMP '{SECOND_ARRIVAL} 00:00:00' OR o_orderkey % 50 IN (2, 11))",
}

#: Rows of the arrivals whose price or date is not of its type, and files of the second
#: arrival whose header has no date column.
BAD_PRICE_EXPR, BAD_DATE_EXPR = "o_orderkey % 41 = 3", "o_orderkey % 43 = 5"
HEADERLESS_EXPR = "file_name LIKE 'LPT - 1999 %'"

#: The second arrival's re-sent files come under other names of the same series and date.
RESENT_EXPR = "o_orderdate < TIMESTAMP '1998-07-01 00:00:00'"
RESENT_NAME_EXPR = "replace(replace(file_name, 'LPT - ', 'LPT -'), '_bcg', '_ bcg')"

# C7 with all inputs: layer customers have tables by type, the others by customer name.
LAYER_CUSTOMERS, WHOLE_CUSTOMERS = ("client_b",), ("client_a",)
LAYER_REQUEST_EXPRS = [
    ("customer", "CASE WHEN o_custkey % 4 = 3 THEN 'client_a' ELSE 'client_b' END"),
    ("table_type", "CASE o_custkey % 3 WHEN 0 THEN 'Detail' WHEN 1 THEN 'gross' ELSE 'SUMMARY' END"),
    ("bronze_table_type", "CASE o_custkey % 5 WHEN 0 THEN 'detail' WHEN 1 THEN 'gross' WHEN 2 THEN 'summary' WHEN 3 THEN 'claims2' ELSE 'detail_' END"),
]

DATED_KINDS = (
    "claimreviews", "claimsfull", "lossevents", "updatevalues", "detail", "gross", "summary", "detail_x",
)
C6_REQUEST_KINDS = ("claimreviews", "CLAIMSFULL", "lossevents", " ")
C7_REQUEST_KINDS = ("detail", "gross", "summary")


def _select(df: DataFrame, exprs: list[tuple[str, str]]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in exprs])


def _case(col: str, values: tuple) -> F.Column:
    n = len(values)
    expr = F.when(F.col(col) % n == 0, F.lit(values[0]))
    for i, v in enumerate(values[1:], start=1):
        expr = expr.when(F.col(col) % n == i, F.lit(v))
    return expr


def control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(load(spark, sf_dir, "part"), CONTROL_EXPRS)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(load(spark, sf_dir, "part"), JOB_EXPRS)


def job_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs as REST listing documents: ``page_id, listing`` (JSON ``{"jobs": [...]}``),
    100 jobs per page in job-id order."""
    j = jobs(spark, sf_dir)
    item = F.struct(
        F.col("job_id").alias("job_id"), F.struct(F.col("job_name").alias("name")).alias("settings")
    )
    pages = j.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("jobs"))
    return pages.select("page_id", F.to_json(F.struct("jobs")).alias("listing"))


def broken_job_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings with pages that are cut off, pages of an error and pages without jobs."""
    half = F.substring(F.col("listing"), F.lit(1), (F.length("listing") / 2).cast("int"))
    return job_listings(spark, sf_dir).withColumn(
        "listing",
        F.when(F.expr(BROKEN_PAGES["cut"]), half)
        .when(F.expr(BROKEN_PAGES["error"]), F.lit(ERROR_PAGE))
        .when(F.expr(BROKEN_PAGES["none"]), F.lit("{}"))
        .otherwise(F.col("listing")),
    )


def migration_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The control table with rows that share a job name or a source."""
    part, out = load(spark, sf_dir, "part"), control(spark, sf_dir)
    for which, changed in (SAME_NAME, SECOND_DESTINATION):
        out = out.unionByName(_select(part.where(which), [(n, changed.get(n, e)) for n, e in CONTROL_EXPRS]))
    return out


def cluster_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters as REST listing documents: ``page_id, listing`` (JSON
    ``{"clusters": [...]}``) in supplier-key order."""
    c = _select(load(spark, sf_dir, "supplier"), CLUSTER_EXPRS)
    item = F.struct("s_suppkey", "cluster_name", "cluster_id", "state")
    ordered = F.transform(
        F.array_sort(F.collect_list(item)),
        lambda x: F.struct(x["cluster_name"].alias("cluster_name"), x["cluster_id"].alias("cluster_id"), x["state"].alias("state")),
    )
    pages = c.groupBy("page_id").agg(ordered.alias("clusters"))
    return pages.select("page_id", F.to_json(F.struct("clusters")).alias("listing"))


def wanted_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").select(F.expr(WANTED_CLUSTER_EXPR).alias("cluster_name"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    return _select(part, INVENTORY_SOURCE_EXPRS).unionByName(_select(part, INVENTORY_DEST_EXPRS))


def status_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(load(spark, sf_dir, "part"), STATUS_UPDATE_EXPRS)


def user_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").selectExpr("c_custkey", f"{USER_ID_EXPR} AS user_id")


def catalog_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    n = load(spark, sf_dir, "nation")
    return _select(c.join(n, c["c_nationkey"] == n["n_nationkey"]), CATALOG_NAME_EXPRS)


def catalog_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation")
    return n.select(
        F.expr(CLIENT_EXPR).alias("client"),
        F.explode(F.array(*[F.lit(c) for c in CLUSTER_NAMES])).alias("cluster_name"),
    )


def etl_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(load(spark, sf_dir, "events"), ETL_LOG_EXPRS)


def etl_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(load(spark, sf_dir, "events"), ETL_CHANGE_EXPRS)


def run_log_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(load(spark, sf_dir, "events"), RUN_LOG_EXPRS)


def storage_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", F.col("url").alias("storage_name"))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(load(spark, sf_dir, "pages"), LOCATION_EXPRS)


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One input-file name per order: layout A (``yyyy-MM_bcg``) for even keys, layout B
    (``LPT - yyyy MM dd``, quarter end) for odd keys, layout B without a dash
    (``LPT yyyyMMdd``) for keys ending in 9 and with dots (``LPT - yyyy.MM.dd``) for keys
    ending in 7; extension by order priority."""
    o = load(spark, sf_dir, "orders")
    quarter = F.trunc(F.col("o_orderdate").cast("date"), "quarter")
    quarter_end = F.last_day(F.add_months(quarter, 2))
    name = (
        F.when(F.col("o_orderkey") % 10 == 9, F.concat(F.lit("LPT "), F.date_format(quarter_end, "yyyyMMdd")))
        .when(F.col("o_orderkey") % 10 == 7, F.concat(F.lit("LPT - "), F.date_format(quarter_end, "yyyy.MM.dd")))
        .when(F.col("o_orderkey") % 2 == 0, F.concat(F.date_format(quarter, "yyyy-MM"), F.lit("_bcg")))
        .otherwise(F.concat(F.lit("LPT - "), F.date_format(quarter_end, "yyyy MM dd")))
    )
    return o.withColumn("file_name", F.concat(name, F.expr(EXT_EXPR)))


def backup_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names with a reproducible stamp time spread over the clock."""
    return file_names(spark, sf_dir).withColumn(
        "stamp_ts", F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("o_orderkey") * 7919) % 86400)
    )


def sheet_rows(spark: SparkSession, sf_dir: str, which: str = "true") -> DataFrame:
    """Orders (those of ``which``) with the landing-sheet header names plus their file name."""
    o = file_names(spark, sf_dir).where(which)
    return o.select(*[F.col(src).alias(dst) for src, dst in SHEET_COLUMNS], "file_name")


def resent_sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second arrival, its re-sent files under other names."""
    o = file_names(spark, sf_dir).where(ARRIVAL_EXPRS[2])
    o = o.withColumn("file_name", F.when(F.expr(RESENT_EXPR), F.expr(RESENT_NAME_EXPR)).otherwise(F.col("file_name")))
    return o.select(*[F.col(src).alias(dst) for src, dst in SHEET_COLUMNS], "file_name")


def faulty_sheet_rows(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """``sheet_rows`` as text, with cells that are not of their column's type."""
    o = file_names(spark, sf_dir).where(which)
    bad = {"o_totalprice": (BAD_PRICE_EXPR, "n/a"), "o_orderdate": (BAD_DATE_EXPR, "31.12., late")}

    def cell(src: str) -> F.Column:
        text = F.col(src).cast("string")
        return F.when(F.expr(bad[src][0]), F.lit(bad[src][1])).otherwise(text) if src in bad else text

    return o.select(*[cell(src).alias(dst) for src, dst in SHEET_COLUMNS], "file_name")


def dated_table_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return o.select(
        F.concat(_case("o_orderkey", DATED_KINDS), F.date_format("o_orderdate", "yyyyMMdd")).alias("tableName")
    )


def dated_requests(spark: SparkSession, sf_dir: str, kinds: tuple) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return o.select(
        _case("o_custkey", kinds).alias("kind"), F.date_format("o_orderdate", "yyyyMMdd").alias("as_of")
    ).distinct()


def layer_table_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dated tables, and for every seventh order one of the customers' own tables."""
    o = load(spark, sf_dir, "orders")
    own = o.where(F.col("o_orderkey") % 7 == 0).select(
        F.concat(F.lit("Client_A_x"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_v2")).alias("tableName")
    )
    return dated_table_listing(spark, sf_dir).unionByName(own)


def layer_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    named = o.selectExpr(*[f"{e} AS {n}" for n, e in LAYER_REQUEST_EXPRS], "o_orderdate")
    return named.select(*[n for n, _ in LAYER_REQUEST_EXPRS], F.date_format("o_orderdate", "yyyyMMdd").alias("as_of")).distinct()


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two changes per order key (``k`` = 1, 2): key%10 = 1 deleted, 2 inserted under a
    shifted key, 3 deleted by a newer second change, the rest updated."""
    o = load(spark, sf_dir, "orders").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    return o.selectExpr(*[f"{e} AS {n}" for n, e in CHANGE_EXPRS])


CHANGE_EXPRS = [
    ("o_orderkey", "CASE WHEN o_orderkey % 10 = 2 THEN o_orderkey + 1000000000 ELSE o_orderkey END"),
    ("o_custkey", "o_custkey"),
    ("o_orderstatus", "CASE WHEN k = 1 THEN 'U' ELSE 'V' END"),
    ("o_totalprice", "o_totalprice + k"),
    ("o_orderdate", "o_orderdate"),
    ("o_orderpriority", "o_orderpriority"),
    (
        "op",
        "CASE WHEN k = 1 THEN (CASE o_orderkey % 10 WHEN 1 THEN 'D' WHEN 2 THEN 'I' ELSE 'U' END) "
        "ELSE (CASE WHEN o_orderkey % 10 = 3 THEN 'D' ELSE 'U' END) END",
    ),
    (
        "seq",
        "o_orderkey * 4 + CASE WHEN k = 1 THEN 2 WHEN o_orderkey % 10 = 3 THEN 3 ELSE 1 END",
    ),
]
