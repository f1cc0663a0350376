"""DuckDB oracle SQL, one statement per registered query.

Derived inputs come from the same portable expression lists as the Spark side
(``stratum.plans.derived``); the operator logic itself is written here a second
time, in plain SQL, so the two implementations check each other.
"""

from __future__ import annotations

from stratum.plans import derived as d


def _sel(exprs) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in exprs)


CONTROL = f"(SELECT {_sel(d.CONTROL_EXPRS)} FROM part)"


def _norm(c: str) -> str:
    return f"CASE WHEN trim({c}) <> '' AND lower({c}) <> 'nan' THEN {c} END AS {c}"


# as S6 reads it
SHEET = "(SELECT " + ", ".join(_norm(c) for c, _ in d.CONTROL_EXPRS) + f" FROM {CONTROL})"
# the migration's sheet, with rows that share a job name or a source
MIGRATION_CONTROL = f"({CONTROL[1:-1]}" + "".join(
    f" UNION ALL SELECT {_sel([(n, changed.get(n, e)) for n, e in d.CONTROL_EXPRS])} FROM part WHERE {which}"
    for which, changed in (d.SAME_NAME, d.SECOND_DESTINATION)
) + ")"
MIGRATION_SHEET = "(SELECT " + ", ".join(_norm(c) for c, _ in d.CONTROL_EXPRS) + f" FROM {MIGRATION_CONTROL})"
JOBS = f"(SELECT {_sel(d.JOB_EXPRS)} FROM part)"
INVENTORY = (
    f"(SELECT {_sel(d.INVENTORY_SOURCE_EXPRS)} FROM part UNION ALL "
    f"SELECT {_sel(d.INVENTORY_DEST_EXPRS)} FROM part)"
)

_Q = "CAST(date_trunc('quarter', o_orderdate) AS DATE)"
_QE = f"last_day({_Q} + INTERVAL 2 MONTH)"
FILE_NAME = (
    f"(CASE WHEN o_orderkey % 10 = 9 THEN 'LPT ' || strftime({_QE}, '%Y%m%d') "
    f"WHEN o_orderkey % 10 = 7 THEN 'LPT - ' || strftime({_QE}, '%Y.%m.%d') "
    f"WHEN o_orderkey % 2 = 0 THEN strftime({_Q}, '%Y-%m') || '_bcg' "
    f"ELSE 'LPT - ' || strftime({_QE}, '%Y %m %d') END || {d.EXT_EXPR})"
)
FILES = f"(SELECT *, {FILE_NAME} AS file_name FROM orders)"


def nan_null(c: str) -> str:
    return f"(CASE WHEN lower({c}) <> 'nan' THEN {c} END)"


DEST_TYPE = f"coalesce({nan_null('Uc_table_type')}, Hive_table_type)"
IS_EXT = f"(upper(Hive_table_type) = 'EXTERNAL' AND upper({DEST_TYPE}) = 'EXTERNAL')"
TABLE_PART = "split_part(Hive_table_name, '.', 2)"
JOB_NAME = (
    f"(CASE WHEN contains(Hive_table_name, '.') THEN 'CDC_UC_' || {TABLE_PART} || "
    f"coalesce('_' || {nan_null('Uc_table_name')}, '') END)"
)
ROUTE_CUSTOMER = (
    "(CASE WHEN contains(lower(file_name), 'lpt') THEN 'client_b' "
    "WHEN contains(lower(file_name), 'bcg') THEN 'client_a' END)"
)
ROUTE_LAYOUT = (
    "(CASE WHEN contains(lower(file_name), 'lpt') THEN 'after_dash' "
    "WHEN contains(lower(file_name), 'bcg') THEN 'before_underscore' END)"
)
AS_OF = (
    "replace(split_part(trim(CASE " + ROUTE_LAYOUT + " WHEN 'before_underscore' THEN split_part(file_name, '_', 1) "
    "WHEN 'after_dash' THEN CASE WHEN strpos(file_name, '-') > 0 THEN substr(file_name, strpos(file_name, '-') + 1) END "
    "END), '.', 1), ' ', '')"
)
INPUT_EXT = "(suffix(file_name, '.csv') OR suffix(file_name, '.xls') OR suffix(file_name, '.xlsx'))"
MANAGED_OF = (
    "(SELECT Hive_table_name, Hive_table_type, Hive_table_format, Sync_required, Frequency_of_sync, "
    f"Date_n_time_for_1st_schedule, Uc_catalog_name, Uc_schema_name, Uc_table_name, Failure_notifications, "
    f"Primary_key_for_cdc, {DEST_TYPE} AS Uc_table_type, Uc_table_format, Uc_external_table_location "
    f"FROM %s WHERE NOT coalesce({IS_EXT}, false))"
)
MANAGED = MANAGED_OF % CONTROL


def cron_sql(src: str, key: str = "Hive_table_name") -> str:
    """P9 over a relation with columns ``key, Date_n_time_for_1st_schedule, Frequency_of_sync``."""
    return f"""
(WITH c AS (SELECT {key} AS k, Date_n_time_for_1st_schedule AS t, lower(Frequency_of_sync) AS f FROM {src}),
k AS (SELECT *, CASE WHEN strpos(t, ',') > 0 THEN 'comma' WHEN strpos(t, ' ') > 0 THEN 'space' ELSE 'nothing' END AS kind,
             regexp_replace(t, '\\s{{2,}}', ' ', 'g') AS sq FROM c),
p AS (SELECT *, CASE kind WHEN 'comma' THEN trim(split_part(t, ',', 1)) WHEN 'space' THEN trim(split_part(sq, ' ', 1)) END AS prefix,
             CASE kind WHEN 'comma' THEN trim(split_part(t, ',', 2)) WHEN 'space' THEN trim(split_part(sq, ' ', 2)) ELSE t END AS clock
      FROM k),
h AS (SELECT *, coalesce(regexp_full_match(clock, '([01]?[0-9]|2[0-3]):([0-5]?[0-9]):([0-5]?[0-9])'), false) AS ok FROM p),
v AS (SELECT *, CAST(CASE WHEN ok THEN split_part(clock, ':', 1) END AS INTEGER) AS hh,
             CAST(CASE WHEN ok THEN split_part(clock, ':', 2) END AS INTEGER) AS mm,
             CAST(CASE WHEN ok THEN split_part(clock, ':', 3) END AS INTEGER) AS ss FROM h)
SELECT k, CASE WHEN ok THEN CASE
    WHEN f = 'daily' THEN CAST(ss AS STRING) || ' ' || CAST(mm AS STRING) || ' ' || CAST(hh AS STRING) || ' * * ? '
    WHEN f = 'monthly' THEN CAST(ss AS STRING) || ' ' || CAST(mm AS STRING) || ' ' || CAST(hh AS STRING) || ' ' || prefix || ' * ? '
    WHEN f = 'weekly' THEN CAST(ss AS STRING) || ' ' || CAST(mm AS STRING) || ' ' || CAST(hh AS STRING) || '  ? * ' || substr(prefix, 1, 3)
    WHEN f = 'hourly' THEN CAST(ss AS STRING) || ' ' || CAST(mm AS STRING) || ' * * *  ? '
    ELSE 'not yet supported' END END AS cron
FROM v)"""


LISTING = f"""(SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY job_id) - 1 AS INTEGER) AS pos,
  job_id, job_name FROM {JOBS})"""

_BROKEN = f"({d.BROKEN_PAGES['cut']} OR {d.BROKEN_PAGES['error']} OR {d.BROKEN_PAGES['none']})"
BROKEN_LISTING = f"(SELECT * FROM {LISTING} WHERE NOT {_BROKEN})"
LISTING_ERRORS = f"""(SELECT DISTINCT page_id, CASE WHEN {d.BROKEN_PAGES['cut']} THEN 'listing is not valid JSON'
  ELSE 'listing is an error: TEMPORARILY_UNAVAILABLE try again' END AS error
  FROM {LISTING} WHERE {d.BROKEN_PAGES['cut']} OR {d.BROKEN_PAGES['error']})"""


# R4, R5 by the contract: a schedule needs a frequency and a time; the sheet is read by S6,
# so what is missing is NULL; a table name without a schema part fails; a job name is planned
# once; a job that a broken listing does not name fails.
def plan_sql(listing: str, broken: str) -> str:
    return f"""(WITH m AS (SELECT *, {JOB_NAME} AS job_name,
    row_number() OVER (ORDER BY Hive_table_name, Uc_catalog_name NULLS FIRST, Uc_schema_name NULLS FIRST, Uc_table_name NULLS FIRST) AS rid
  FROM {MANAGED_OF % MIGRATION_SHEET}),
cr AS {cron_sql('m', 'rid')},
kn AS (SELECT job_name AS known_name, arg_min(job_id, page_id * 1000000 + pos) AS known_id FROM {listing} GROUP BY job_name),
y AS (SELECT m.*, cr.cron AS raw_cron,
        CASE WHEN Frequency_of_sync IS NOT NULL AND Date_n_time_for_1st_schedule IS NOT NULL
             AND cr.cron <> 'not yet supported' THEN cr.cron END AS cron_ok,
        CASE WHEN coalesce(m.Sync_required <> 'yes', true) THEN 'unwanted'
             WHEN m.job_name IS NULL THEN 'unnamed' WHEN kn.known_name IS NOT NULL THEN 'known'
             WHEN {broken} THEN 'blind' ELSE 'new' END AS kind0, kn.known_id
      FROM m JOIN cr ON m.rid = cr.k LEFT JOIN kn ON m.job_name = kn.known_name),
x AS (SELECT *, CASE WHEN kind0 = 'new' AND row_number() OVER (PARTITION BY kind0, job_name ORDER BY rid) > 1 THEN 'second' ELSE kind0 END AS kind FROM y)
SELECT Hive_table_name AS table_name, Uc_table_name AS destination_table_name, job_name,
  CASE WHEN kind IN ('unnamed', 'blind') THEN 'fail' WHEN kind = 'new' THEN CASE WHEN cron_ok IS NULL THEN 'create' ELSE 'schedule' END ELSE 'skip' END AS action,
  CASE WHEN kind IN ('unnamed', 'blind') THEN 'Failed' WHEN kind = 'new' THEN 'Planned' ELSE 'Skipped' END AS status,
  CASE WHEN kind = 'new' THEN cron_ok END AS cron,
  CASE kind WHEN 'unwanted' THEN 'sync_required parameter is NO' WHEN 'unnamed' THEN 'table name has no schema part'
    WHEN 'known' THEN 'job already scheduled' WHEN 'second' THEN 'job already scheduled' WHEN 'blind' THEN 'the job listing could not be read'
    ELSE CASE WHEN cron_ok IS NOT NULL THEN 'scheduled: ' || cron_ok
      WHEN Frequency_of_sync IS NULL AND Date_n_time_for_1st_schedule IS NULL THEN 'created without schedule: no frequency or time given'
      WHEN Frequency_of_sync IS NULL THEN 'created without schedule: no frequency given'
      WHEN Date_n_time_for_1st_schedule IS NULL THEN 'created without schedule: no time given'
      WHEN raw_cron IS NULL THEN 'created without schedule: time does not parse'
      ELSE 'created without schedule: frequency not supported' END END AS log_message,
  CASE WHEN kind = 'known' THEN known_id END AS job_id,
  Uc_catalog_name AS destination_catalog_name, Uc_schema_name AS destination_schema_name
FROM x)"""


PLAN = plan_sql(LISTING, "false")


def lookup_sql(name: str, listing: str, otherwise: str) -> str:
    return f"""SELECT '{name}' AS listing, w.job_name, b.job_id, b.job_id_last,
        CASE WHEN b.job_id IS NOT NULL THEN 'found' ELSE {otherwise} END AS status
        FROM (SELECT DISTINCT {JOB_NAME} AS job_name FROM {CONTROL}) w
        LEFT JOIN (SELECT job_name, arg_min(job_id, page_id * 1000000 + pos) AS job_id,
            arg_max(job_id, page_id * 1000000 + pos) AS job_id_last FROM {listing} GROUP BY job_name) b ON w.job_name = b.job_name"""


NEWEST_LINES = """(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate DESC, %s) AS rn FROM lineitem) WHERE rn = 1)"""

ETL_LOG = f"(SELECT {_sel(d.ETL_LOG_EXPRS)} FROM events)"
WM_BY_TABLE = (
    f"(SELECT tableName, coalesce(max(lastExtractDateTime), TIMESTAMP '1970-01-01 00:00:00') AS last_run "
    f"FROM {ETL_LOG} GROUP BY tableName)"
)

DATED_LISTING = (
    "(SELECT DISTINCT (CASE o_orderkey % 8 "
    + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(d.DATED_KINDS))
    + " END) || strftime(o_orderdate, '%Y%m%d') AS tableName FROM orders)"
)


def dated_requests(kinds: tuple) -> str:
    n = len(kinds)
    case = "CASE o_custkey % " + str(n) + " " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(kinds)) + " END"
    return f"(SELECT DISTINCT {case} AS kind, strftime(o_orderdate, '%Y%m%d') AS as_of FROM orders)"


def dated_sql(kinds: tuple, patterns: dict) -> str:
    pat = "CASE lower(kind) " + " ".join(f"WHEN '{k}' THEN '{p}'" for k, p in patterns.items()) + " END"
    kind_of = " UNION ALL ".join(
        f"SELECT '{k}' AS kind, tableName FROM {DATED_LISTING} WHERE regexp_full_match(tableName, '{p}', 'i')"
        for k, p in patterns.items()
    )
    return f"""WITH r AS (SELECT kind, as_of, {pat} AS pattern FROM {dated_requests(kinds)}),
lk AS ({kind_of}),
hit AS (SELECT DISTINCT r.kind, r.as_of FROM r JOIN lk ON lower(r.kind) = lk.kind AND contains(lk.tableName, r.as_of))
SELECT r.kind, r.as_of, hit.kind IS NOT NULL AS found FROM r LEFT JOIN hit ON r.kind = hit.kind AND r.as_of = hit.as_of"""


SHEET_CSV = f"""(SELECT o_orderkey AS OrderKey, o_custkey AS CustomerKey, o_orderstatus AS OrderStatus,
  o_totalprice AS TotalPrice, o_orderdate AS OrderDate, o_orderpriority AS OrderPriority, file_name AS source_file,
  {ROUTE_CUSTOMER} AS customer, {AS_OF} AS as_of_date FROM {FILES} WHERE suffix(file_name, '.csv'))"""

BACKUP_STEM = "split_part(file_name, '.', 1) || '_' || strftime(TIMESTAMP '2024-01-31 15:04:05', '%Y_%m_%d-%I_%M_%S_%p')"


X5_SQL = f"""WITH ch AS (SELECT {_sel(d.CHANGE_EXPRS)} FROM (SELECT *, unnest([1, 2]) AS k FROM orders)),
        l AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC, op DESC,
               o_custkey DESC, o_orderstatus DESC, o_totalprice DESC, o_orderdate DESC, o_orderpriority DESC) AS rn FROM ch)
              WHERE rn = 1)
        SELECT coalesce(b.o_orderkey, l.o_orderkey) AS o_orderkey,
          CASE WHEN l.op IN ('I', 'U') THEN l.o_custkey ELSE b.o_custkey END AS o_custkey,
          CASE WHEN l.op IN ('I', 'U') THEN l.o_orderstatus ELSE b.o_orderstatus END AS o_orderstatus,
          CASE WHEN l.op IN ('I', 'U') THEN l.o_totalprice ELSE b.o_totalprice END AS o_totalprice,
          CASE WHEN l.op IN ('I', 'U') THEN l.o_orderdate ELSE b.o_orderdate END AS o_orderdate,
          CASE WHEN l.op IN ('I', 'U') THEN l.o_orderpriority ELSE b.o_orderpriority END AS o_orderpriority
        FROM orders b FULL OUTER JOIN l ON b.o_orderkey = l.o_orderkey
        WHERE coalesce(l.op, '') <> 'D' AND (b.o_orderkey IS NOT NULL OR l.op IN ('I', 'U'))"""

# Two arrivals: what each file's run says of it, and what bronze holds of it.
_SERIES = (
    "lower(trim(CASE WHEN contains(lower(file_name), 'lpt') THEN split_part(file_name, '-', 1) "
    "ELSE split_part(substr(file_name, strpos(file_name, '_') + 1), '.', 1) END))"
)
_DATED = f"coalesce(regexp_full_match({AS_OF}, '[0-9]{{8}}|[0-9]{{4}}-[0-9]{{2}}'), false)"
DATED_SHEET = (
    "(SELECT o_orderkey AS OrderKey, o_orderstatus AS OrderStatus, o_totalprice AS TotalPrice, o_orderdate AS OrderDate, "
    "o_orderpriority AS OrderPriority, "
    f"{ROUTE_CUSTOMER} AS customer FROM {FILES} WHERE suffix(file_name, '.csv') AND {_DATED})"
)
X1_RUN = f"""WITH arrived AS (
    SELECT 1 AS run, * FROM {FILES} WHERE {d.ARRIVAL_EXPRS[1]} UNION ALL SELECT 2, * FROM {FILES} WHERE {d.ARRIVAL_EXPRS[2]}),
  f AS (SELECT run, file_name, {ROUTE_CUSTOMER} AS customer, {_SERIES} AS series, {AS_OF} AS as_of,
      count(*) FILTER (NOT ({d.BAD_PRICE_EXPR} OR {d.BAD_DATE_EXPR})) AS n, sum(o_orderkey) FILTER (NOT ({d.BAD_PRICE_EXPR} OR {d.BAD_DATE_EXPR})) AS keys,
      count(*) FILTER ({d.BAD_PRICE_EXPR} OR {d.BAD_DATE_EXPR}) AS bad, count(*) FILTER ({d.BAD_PRICE_EXPR}) AS bad_price
    FROM arrived WHERE {INPUT_EXT} GROUP BY 1, 2, 3, 4, 5),
  -- a file that is not CSV stays, so the second run sees those of the first too
  seen AS (SELECT * FROM f
    UNION ALL SELECT 2 AS run, * EXCLUDE (run) FROM f a WHERE run = 1 AND NOT suffix(file_name, '.csv')
      AND NOT EXISTS (SELECT 1 FROM f b WHERE b.run = 2 AND b.file_name = a.file_name)),
  decided AS (SELECT *, CASE WHEN NOT suffix(file_name, '.csv') THEN 'unread'
      WHEN NOT coalesce(regexp_full_match(as_of, '[0-9]{{8}}|[0-9]{{4}}-[0-9]{{2}}'), false) THEN 'quarantine'
      WHEN run = 2 AND EXISTS (SELECT 1 FROM f b WHERE b.run = 1 AND suffix(b.file_name, '.csv') AND b.customer = seen.customer
          AND b.series = seen.series AND b.as_of = seen.as_of) THEN 'skip'
      WHEN run = 2 AND {d.HEADERLESS_EXPR} THEN 'quarantine' ELSE 'load' END AS decision FROM seen)
SELECT run, file_name,
  CASE decision WHEN 'load' THEN CASE WHEN bad > 0 THEN 'Partial' ELSE 'Success' END WHEN 'quarantine' THEN 'Quarantined' ELSE 'Skipped' END AS status,
  as_of AS "asOfDate", CASE WHEN decision = 'load' AND n > 0 THEN n END AS n_rows,
  CAST(CASE WHEN decision = 'load' AND n > 0 THEN keys END AS BIGINT) AS sum_keys,
  CASE WHEN decision = 'load' AND bad > 0 THEN bad END AS n_rejected, CASE WHEN decision = 'load' AND bad > 0 THEN bad_price END AS n_bad_price
FROM decided"""

CLUSTERS = f"(SELECT {_sel(d.CLUSTER_EXPRS)} FROM supplier)"

ORACLE: dict[str, str] = {
    "P1_clean_columns": """SELECT o_orderkey AS OrderKey, o_custkey AS CustomerKey, o_orderstatus AS OrderStatus,
        o_totalprice AS TotalPrice, o_orderdate AS OrderDate, o_orderpriority AS OrderPriority FROM orders""",
    "P2_as_of_date": f"""SELECT o_orderkey, file_name, {ROUTE_LAYOUT} AS layout, {AS_OF} AS as_of_date,
        CAST(coalesce(try_strptime({AS_OF}, '%Y%m%d'), try_strptime({AS_OF}, '%Y-%m-%d'), try_strptime({AS_OF}, '%Y-%m'),
                      try_strptime({AS_OF}, '%Y_%m'), try_strptime({AS_OF}, '%Y%m')) AS DATE) AS as_of
        FROM {FILES}""",
    "P3_storage_root": "SELECT page_id, url, nullif(regexp_extract(url, '//(.+?)/', 1), '') AS storage_root FROM pages",
    "P4_backup_name": f"""SELECT o_orderkey, CASE WHEN coalesce(file_name, '') = '' THEN '' ELSE
        split_part(file_name, '.', 1) || '_' ||
        strftime(o_orderdate + to_seconds((o_orderkey * 7919) % 86400), '%Y_%m_%d-%I_%M_%S_%p') || '.' ||
        CASE WHEN strpos(file_name, '.') > 0 THEN regexp_extract(file_name, '\\.([^.]*)$', 1) ELSE '' END END AS backup_name
        FROM {FILES}""",
    "P5_initials": f"""SELECT c_custkey, user_id,
        substr(split_part(user_id, '.', 1), 1, 1) || split_part(split_part(user_id, '.', 2), '@', 1) AS initials
        FROM (SELECT c_custkey, {d.USER_ID_EXPR} AS user_id FROM customer)""",
    "P6_route_by_name": f"SELECT o_orderkey, {ROUTE_CUSTOMER} AS customer, {INPUT_EXT} AS is_input_file FROM {FILES}",
    "P7_null_if_nan": f"""SELECT Hive_table_name, {DEST_TYPE} AS destination_type, {nan_null('Uc_table_name')} AS uc_table_name
        FROM {CONTROL}""",
    "P8_delimiter_kind": f"""SELECT Hive_table_name, CASE WHEN strpos(Date_n_time_for_1st_schedule, ',') > 0 THEN 'comma'
        WHEN strpos(Date_n_time_for_1st_schedule, ' ') > 0 THEN 'space' ELSE 'nothing' END AS delimiter FROM {CONTROL}""",
    "P9_schedule_to_cron": f"""SELECT k AS Hive_table_name, cron,
        CASE WHEN cron = 'not yet supported' THEN cron ELSE trim(regexp_replace(cron, ' +', ' ', 'g')) END AS cron_canonical
        FROM {cron_sql(CONTROL)}""",
    "J1_resolve_catalog": f"""WITH cat AS (SELECT lower(customer) AS cust, lower(environment) AS env, min(catalogName) AS catalogName
          FROM (SELECT {_sel(d.CATALOG_NAME_EXPRS)} FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1, 2),
        req AS (SELECT {d.CLIENT_EXPR} AS client, unnest({list(d.CLUSTER_NAMES)}) AS cluster_name FROM nation),
        r2 AS (SELECT client, cluster_name, CASE WHEN lower(split_part(cluster_name, '-', 2)) IN ('dev', 'qa') THEN 'dev'
                 ELSE nullif(lower(split_part(cluster_name, '-', 2)), '') END AS environment FROM req)
        SELECT r2.client, r2.cluster_name, r2.environment, cat.catalogName FROM r2
        LEFT JOIN cat ON r2.client = cat.cust AND r2.environment = cat.env""",
    "J2_validate_storage": f"""WITH r AS (SELECT page_id, url AS storage_name,
          CASE WHEN length(coalesce(url, '')) > 0 THEN nullif(regexp_extract(url, '//(.+?)/', 1), '') END AS root FROM pages),
        loc AS (SELECT {_sel(d.LOCATION_EXPRS)} FROM pages),
        roots AS (SELECT DISTINCT root FROM r WHERE root IS NOT NULL),
        hit AS (SELECT root FROM roots WHERE EXISTS (SELECT 1 FROM loc WHERE contains(loc.url, roots.root)))
        SELECT page_id, storage_name, hit.root IS NOT NULL AS valid FROM r LEFT JOIN hit ON r.root = hit.root""",
    "J3_explode_listing": f"""SELECT page_id, pos, job_id, job_name, CAST(NULL AS STRING) AS error FROM {BROKEN_LISTING}
        UNION ALL SELECT page_id, NULL, NULL, NULL, error FROM {LISTING_ERRORS}""",
    "J4_lookup_by_name": " UNION ALL ".join([
        lookup_sql("whole", LISTING, "'not found'"),
        lookup_sql("broken", BROKEN_LISTING, f"CASE WHEN (SELECT count(*) FROM {LISTING_ERRORS}) > 0 THEN 'unknown' ELSE 'not found' END"),
        lookup_sql("empty", f"(SELECT * FROM {LISTING} WHERE false)", "'empty'"),
    ]),
    "J4_cluster_lookup": f"""WITH l AS (SELECT cluster_name, cluster_id,
          page_id * 1000000 + row_number() OVER (PARTITION BY page_id ORDER BY s_suppkey) AS ord FROM {CLUSTERS}),
        b AS (SELECT cluster_name, arg_max(cluster_id, ord) AS cluster_id FROM l GROUP BY cluster_name),
        w AS (SELECT {d.WANTED_CLUSTER_EXPR} AS cluster_name FROM nation)
        SELECT w.cluster_name, b.cluster_id, CASE WHEN b.cluster_id IS NOT NULL THEN 'found' ELSE 'not found' END AS status
        FROM w LEFT JOIN b ON w.cluster_name = b.cluster_name""",
    "J5_dry_run_check": f"""WITH inv AS (SELECT DISTINCT lower(catalog) AS c, lower(schema) AS s, lower("table") AS t FROM {INVENTORY}),
        c AS (SELECT *, coalesce({nan_null('Uc_table_name')}, {TABLE_PART}) AS dest_table FROM {CONTROL})
        SELECT Hive_table_name, CASE
          WHEN NOT EXISTS (SELECT 1 FROM inv WHERE c = 'hive_metastore' AND s = lower(split_part(Hive_table_name, '.', 1))
                           AND t = lower({TABLE_PART})) THEN 'SOURCE_MISSING'
          WHEN NOT EXISTS (SELECT 1 FROM inv WHERE c = lower(Uc_catalog_name) AND s = lower(Uc_schema_name)) THEN 'DEST_SCHEMA_MISSING'
          WHEN EXISTS (SELECT 1 FROM inv WHERE c = lower(Uc_catalog_name) AND s = lower(Uc_schema_name) AND t = lower(dest_table))
               THEN 'DEST_EXISTS'
          WHEN NOT coalesce({IS_EXT}, false) THEN 'NOT_EXTERNAL' ELSE 'OK' END AS dry_run_status FROM c""",
    "J6_split_control": f"""SELECT Hive_table_name, Hive_table_location AS location, Uc_catalog_name AS catalog_name,
        Uc_schema_name AS schema_name FROM {CONTROL} WHERE {IS_EXT}""",
    "J7_managed_worklist": f"SELECT * FROM {MANAGED_OF % MIGRATION_CONTROL}",
    "C2_check_unique_key": """SELECT l_orderkey, l_linenumber, count(*) AS n,
        CASE WHEN l_orderkey IS NULL OR l_linenumber IS NULL THEN 'null key' ELSE 'duplicate' END AS reason
        FROM lineitem GROUP BY l_orderkey, l_linenumber
        HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL""",
    "C5_table_exists": f"""WITH inv AS (SELECT DISTINCT lower(catalog) AS c, lower(schema) AS s, lower("table") AS t FROM {INVENTORY})
        SELECT Hive_table_name, EXISTS (SELECT 1 FROM inv WHERE c = lower(Uc_catalog_name) AND s = lower(Uc_schema_name)
          AND t = lower({TABLE_PART})) AS "exists" FROM {CONTROL}""",
    "C6_find_dated_table": dated_sql(
        d.C6_REQUEST_KINDS,
        {"claimreviews": "claimreviews.*", "claimsfull": "claimsfull.*", "lossevents": "lossevents.*", " ": "updatevalues.*"},
    ),
    "C7_find_dated_layer_table": dated_sql(
        d.C7_REQUEST_KINDS, {"detail": "detail[0-9].*", "gross": "gross[0-9].*", "summary": "summary[0-9].*"}
    ),
    "A1_last_run": f"SELECT coalesce(max(lastExtractDateTime), TIMESTAMP '1970-01-01 00:00:00') AS last_run FROM {ETL_LOG}",
    "A1_last_run_by_table": f"SELECT * FROM {WM_BY_TABLE}",
    "A2_max_timestamp": "SELECT max(ts) AS max_timestamp FROM events",
    "A4_incremental_slice": f"""SELECT e.event_id, e.event_type, e.ts FROM events e LEFT JOIN {WM_BY_TABLE} w ON e.event_type = w.tableName
        WHERE e.ts > coalesce(w.last_run, TIMESTAMP '1970-01-01 00:00:00')""",
    "U1_upsert_watermark": f"""WITH o AS (SELECT tableName, last_run AS old FROM {WM_BY_TABLE}),
        n AS (SELECT tableName, max(lastExtractDateTime) AS new FROM (SELECT {_sel(d.ETL_CHANGE_EXPRS)} FROM events) GROUP BY tableName)
        SELECT coalesce(o.tableName, n.tableName) AS tableName,
          CASE WHEN o.old IS NULL THEN n.new WHEN n.new IS NULL THEN o.old WHEN n.new > o.old THEN n.new ELSE o.old END
            AS lastExtractDateTime
        FROM o FULL OUTER JOIN n ON o.tableName = n.tableName""",
    "U2_update_status": f"""WITH u AS (SELECT Hive_table_name, max(Table_Status) AS s FROM (SELECT {_sel(d.STATUS_UPDATE_EXPRS)} FROM part)
          GROUP BY Hive_table_name)
        SELECT c.Hive_table_name, coalesce(u.s, c.Table_Status) AS Table_Status FROM {CONTROL} c
        LEFT JOIN u ON c.Hive_table_name = u.Hive_table_name""",
    "R1_sync_job_name": f"SELECT Hive_table_name, {JOB_NAME} AS job_name FROM {CONTROL}",
    "R2_sync_parameters": f"""SELECT Hive_table_name, 'hive_metastore' AS sourceCatalog, split_part(Hive_table_name, '.', 1) AS sourceSchema,
        Primary_key_for_cdc AS primaryKey, coalesce({nan_null('Uc_table_name')}, {TABLE_PART}) AS destTable,
        Uc_catalog_name AS destCatalog, Uc_schema_name AS destSchema, {TABLE_PART} AS sourceTable,
        Uc_table_type AS ucTableType, Uc_table_format AS ucTableFormat, Uc_external_table_location AS ucExternalTableLocation,
        'owner' AS on_success, 'owner' || coalesce(';' || {nan_null('Failure_notifications')}, '') AS on_failure
        FROM {MANAGED}""",
    "R5_sync_plan": " UNION ALL ".join(
        f"SELECT '{name}' AS listing, table_name, destination_table_name, job_name, action, status, cron, log_message, job_id FROM {plan}"
        for name, plan in (("whole", PLAN), ("broken", plan_sql(BROKEN_LISTING, f"(SELECT count(*) FROM {LISTING_ERRORS}) > 0")))
    ),
    "R6_sync_log_rows": f"""SELECT coalesce(CAST(job_id AS STRING), 'N/A') AS jobId,
        CASE WHEN action IN ('schedule', 'create') OR log_message = 'job already scheduled' THEN job_name ELSE 'N/A' END AS jobName,
        table_name, destination_catalog_name, destination_schema_name, status, log_message,
        TIMESTAMP '2024-01-31 15:04:05' AS log_time FROM {PLAN}""",
    "migration_status_counts": f"SELECT action, status, count(*) AS n_tables FROM {PLAN} GROUP BY action, status",
    "S1_list_input_files": f"SELECT DISTINCT file_name FROM {FILES} WHERE {INPUT_EXT}",
    "S2_file_exists": f"SELECT DISTINCT file_name, {INPUT_EXT} AS present FROM {FILES}",
    "S1_first_input_file": f"SELECT min(file_name) AS file_name FROM {FILES} WHERE {INPUT_EXT}",
    "S3_archive_processed": f"""SELECT stem || CASE WHEN count(*) OVER (PARTITION BY stem, ext) > 1
          THEN '_' || substr(md5(file_name), 1, 12) ELSE '' END || ext AS file_name, 'backup' AS place
        FROM (SELECT file_name, {BACKUP_STEM} AS stem, '.' || regexp_extract(file_name, '\\.([^.]*)$', 1) AS ext
          FROM {FILES} WHERE {INPUT_EXT} GROUP BY file_name)""",
    "S4_file_arrival_ingest": f"SELECT *, TIMESTAMP '2024-01-31 15:04:05' AS ingestion_timestamp FROM {SHEET_CSV}",
    "S4_file_arrival_load": f"""WITH arrived AS (SELECT 1 AS run, * FROM {FILES} WHERE {d.ARRIVAL_EXPRS[1]}
          UNION ALL SELECT 2, * REPLACE (CASE WHEN {d.RESENT_EXPR} THEN {d.RESENT_NAME_EXPR} ELSE file_name END AS file_name)
          FROM {FILES} WHERE {d.ARRIVAL_EXPRS[2]}),
        f AS (SELECT run, file_name, {AS_OF} AS as_of_date, {ROUTE_CUSTOMER} AS customer, count(*) AS n, sum(o_orderkey) AS keys,
            bool_or({d.RESENT_EXPR}) AND run = 2 AS resent
          FROM arrived WHERE suffix(file_name, '.csv') GROUP BY 1, 2, 3, 4),
        g AS (SELECT *, CASE WHEN NOT coalesce(regexp_full_match(as_of_date, '[0-9]{{8}}|[0-9]{{4}}-[0-9]{{2}}'), false) THEN 'quarantine'
            WHEN run = 2 AND EXISTS (SELECT 1 FROM f b WHERE b.run = 1 AND b.customer = f.customer AND b.as_of_date = f.as_of_date) THEN 'skip'
            ELSE 'load' END AS decision FROM f)
        SELECT run, file_name, decision, CASE WHEN decision = 'load' THEN n ELSE 0 END AS "rows", as_of_date, true AS finished,
          CASE WHEN decision = 'load' THEN n END AS n_rows, CAST(CASE WHEN decision = 'load' THEN keys END AS BIGINT) AS sum_keys,
          CASE WHEN decision = 'load' THEN n END AS n_keys FROM g""",
    "S6_read_control": f"SELECT * FROM {SHEET}",
    "S7_pandas_to_df": f"SELECT * FROM {SHEET}",
    "X1_incremental_run": X1_RUN,
    "X5_cdc_stream": X5_SQL,
    "X7_layer_stages": f"""WITH p AS (SELECT OrderPriority, CAST(date_trunc('month', OrderDate) AS DATE) AS period,
          CAST(sum(CAST(TotalPrice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total FROM {DATED_SHEET} GROUP BY 1, 2),
        x2 AS (SELECT *, lag(total) OVER (PARTITION BY OrderPriority ORDER BY period) AS prev_total FROM p)
        SELECT 'differential' AS output, NULL AS customer, NULL AS "OrderStatus", NULL AS n_rows, total, NULL AS level_id,
          OrderPriority, period, prev_total, CAST(total - prev_total AS DECIMAL(38,2)) AS diff FROM x2
        UNION ALL SELECT 'silver', customer, OrderStatus, count(*), CAST(sum(CAST(TotalPrice AS DECIMAL(18,2))) AS DECIMAL(38,2)), NULL,
          NULL, NULL, NULL, NULL FROM {DATED_SHEET} GROUP BY customer, OrderStatus
        UNION ALL SELECT 'detail', customer, OrderStatus, count(*),
        CAST(sum(CAST(TotalPrice AS DECIMAL(18,2))) AS DECIMAL(38,2)),
        CAST(grouping(customer, OrderStatus) AS INTEGER), NULL, NULL, NULL, NULL
        FROM {DATED_SHEET} GROUP BY ROLLUP (customer, OrderStatus)""",
    "X7_gold_stages": f"""SELECT customer, CAST(year(OrderDate) AS INTEGER) AS year, count(*) AS n_rows,
        CAST(sum(CAST(TotalPrice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total FROM {DATED_SHEET} GROUP BY 1, 2""",
    "C3_catalog_inventory": """SELECT DISTINCT 'spark_catalog' AS catalog, CAST(k % 5 AS STRING) AS schema, 't' || CAST(k AS STRING) AS "table"
        FROM (SELECT CAST(floor(s_suppkey / 10) AS BIGINT) AS k FROM supplier)""",
    "C3_catalog_schemas": f"""SELECT catalog, CAST(count(DISTINCT schema) AS INTEGER) AS n_schemas,
        string_agg(DISTINCT schema, ',' ORDER BY schema) AS schemas FROM {INVENTORY} GROUP BY catalog""",
    "C7_find_layer_table": f"""WITH r AS (SELECT DISTINCT {_sel(d.LAYER_REQUEST_EXPRS)}, strftime(o_orderdate, '%Y%m%d') AS as_of FROM orders),
        names AS (SELECT tableName FROM {DATED_LISTING}
          UNION SELECT 'Client_A_x' || strftime(o_orderdate, '%Y%m%d') || '_v2' FROM orders WHERE o_orderkey % 7 = 0),
        hit AS (SELECT DISTINCT r.* FROM r JOIN names n ON contains(n.tableName, r.as_of)
          AND CASE WHEN r.customer = 'client_a' THEN starts_with(lower(n.tableName), 'client_a')
              ELSE regexp_full_match(lower(n.tableName), lower(r.bronze_table_type) || '[0-9].*') END)
        SELECT r.*, hit.customer IS NOT NULL AS found FROM r LEFT JOIN hit USING (customer, table_type, bronze_table_type, as_of)""",
    "S10_append_run_log": f"""SELECT workflowId, JobRunId, workflowName, jobTriggerTime, errorMessage, logMessage, logTime, status,
        jobEndTime, asOfDate, notebookName FROM (SELECT {_sel(d.RUN_LOG_EXPRS)} FROM events)""",
    "X1_bronze_ingest": f"SELECT * FROM {SHEET_CSV}",
    "X2_period_differential": """WITH a AS (SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
          CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total FROM orders GROUP BY 1, 2),
        b AS (SELECT *, lag(total) OVER (PARTITION BY o_orderpriority ORDER BY period) AS prev_total FROM a)
        SELECT o_orderpriority, period, total, prev_total, CAST(total - prev_total AS DECIMAL(38,2)) AS diff,
          CAST(CAST(total - prev_total AS DECIMAL(38,2)) AS DOUBLE) * CAST(100.0 AS DOUBLE)
            / nullif(CAST(prev_total AS DOUBLE), CAST(0.0 AS DOUBLE)) AS pct_change FROM b""",
    "X2_month_over_month": """WITH cur AS (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
          CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total FROM orders GROUP BY 1, 2),
        prv AS (SELECT o_custkey, CAST(period + INTERVAL 1 MONTH AS DATE) AS period, total AS prev_total FROM cur)
        SELECT coalesce(cur.o_custkey, prv.o_custkey) AS o_custkey, coalesce(cur.period, prv.period) AS period,
          total, prev_total, CAST(coalesce(total, 0) - coalesce(prev_total, 0) AS DECIMAL(38,2)) AS diff,
          CASE WHEN prev_total IS NULL THEN 'new' WHEN total IS NULL THEN 'gone'
               WHEN total <> prev_total THEN 'changed' ELSE 'same' END AS status
        FROM cur FULL OUTER JOIN prv ON cur.o_custkey = prv.o_custkey AND cur.period = prv.period""",
    "X2_snapshot_differential": f"""WITH cur AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS cur_total
          FROM ({X5_SQL}) GROUP BY o_custkey),
        prv AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS prev_total
          FROM orders GROUP BY o_custkey)
        SELECT coalesce(cur.o_custkey, prv.o_custkey) AS o_custkey, cur_total, prev_total,
          CASE WHEN prev_total IS NULL THEN 'new' WHEN cur_total IS NULL THEN 'gone'
               WHEN cur_total <> prev_total THEN 'changed' ELSE 'same' END AS status,
          CAST(coalesce(cur_total, 0) - coalesce(prev_total, 0) AS DECIMAL(38,2)) AS diff
        FROM cur FULL OUTER JOIN prv ON cur.o_custkey = prv.o_custkey""",
    "X3_silver_aggregation": f"""SELECT l_returnflag, l_linestatus, count(*) AS n_rows,
        CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum_qty,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum_price
        FROM {NEWEST_LINES % "l_returnflag DESC, l_linestatus DESC, l_quantity DESC, l_extendedprice DESC"} GROUP BY l_returnflag, l_linestatus""",
    "X4_detail_aggregation": """SELECT l_returnflag, l_linestatus, count(*) AS n_rows,
        CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum_qty,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum_price,
        CAST(grouping(l_returnflag, l_linestatus) AS INTEGER) AS level_id
        FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "X5_cdc_apply": X5_SQL,
    "X6_gold_report": f"""SELECT r_name, CAST(year(o_orderdate) AS INTEGER) AS order_year, count(*) AS n_lines,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DECIMAL(38,4)) AS net_revenue
        FROM {NEWEST_LINES % "l_extendedprice DESC, l_discount DESC"} li JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        GROUP BY r_name, CAST(year(o_orderdate) AS INTEGER)""",
}

ORACLE["S8_overwrite_table"] = f"""SELECT c.* REPLACE (j.dry_run_status AS dry_run_status)
    FROM {CONTROL} c JOIN ({ORACLE["J5_dry_run_check"]}) j USING (Hive_table_name)"""
ORACLE["S9_append_sync_log"] = f"SELECT * FROM ({ORACLE['R6_sync_log_rows']}) UNION ALL SELECT * FROM ({ORACLE['R6_sync_log_rows']})"
