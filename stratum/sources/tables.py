"""Catalog tables: run log (C1, S10), key checks (C2), table existence (C5),
dated-table search (C6, C7), catalog inventory (C3) and versioned snapshots.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import matching_needles
from ..schemas import RUN_LOG, RUN_LOG_DDL

# --- C1, S10 --------------------------------------------------------------------------

LOG_MONTH = "logMonth"


def _month(time: Column | str) -> Column:
    return F.date_format(time, "yyyy-MM")


def create_run_log(
    spark: SparkSession, table: str, owner: str = "pipeline", location: str | None = None, fmt: str = "parquet"
) -> None:
    """Create the run-log table if missing (partitioned by ``notebookName`` and by the month of
    ``logTime``, so that the key check of an append reads the months it touches).

    ``NOT NULL`` is not enforced by file-based tables; ``append_run_log`` checks it.
    """
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({RUN_LOG_DDL}, {LOG_MONTH} STRING COMMENT 'month of the log time') USING {fmt} "
        f"PARTITIONED BY ({LOG_MONTH}, notebookName){loc} COMMENT '{owner} workflow log table'"
    )


def run_log_rows(rows: DataFrame) -> DataFrame:
    """Shape rows to the run-log schema. Without a ``logTime`` column the rows get now
    (zoneless), each a microsecond after the one before, as ``logTime`` is the key; a NULL in a
    given column stays, and fails the append."""
    cols = []
    for field in RUN_LOG.fields:
        if field.name == "logTime":
            if "logTime" in rows.columns:
                ts = F.col("logTime").cast("timestamp_ntz")
            else:
                nth = F.row_number().over(Window.orderBy(*[F.col(c) for c in rows.columns]))  # log rows, a few a run
                ts = F.current_timestamp().cast("timestamp_ntz") + F.make_dt_interval(secs=nth * F.lit(0.000001).cast("decimal(18,6)"))
            cols.append(ts.alias("logTime"))
        elif field.name in rows.columns:
            cols.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
    return rows.select(*cols)


def append_run_log(rows: DataFrame, table: str, check_key: bool = True) -> None:
    """Append many run-log rows in one write (values are data, never SQL text).

    A NULL ``logTime`` fails the write. ``check_key``: so does a ``logTime`` that the new
    rows have twice or the table has already (C2; the table's times are read, not its
    texts), unless the row is there already, as after a run that was cut off: then it is
    not appended again. Only the months of the new rows are read for it. Off for a feed whose
    times are not unique.
    """
    shaped = run_log_rows(rows)
    shaped = shaped.withColumn(
        "logTime", F.coalesce(F.col("logTime"), F.raise_error(F.lit("logTime must not be NULL")).cast("timestamp_ntz"))
    )
    shaped = shaped.withColumn(LOG_MONTH, _month("logTime"))
    shaped = shaped.select(*[c for c in shaped.columns if c != "notebookName"], "notebookName")  # as the table has them
    if not check_key:
        shaped.write.insertInto(table)
        return
    old = logged_near(shaped, table)
    same = F.col("notebookName").eqNullSafe(F.col("_b")) & F.col("logMessage").eqNullSafe(F.col("_m"))
    new = shaped.join(old, (F.col("logTime") == F.col("_t")) & same, "left_anti")
    times = new.select("logTime", F.lit(1).alias("n")).unionAll(old.join(new, F.col("_t") == F.col("logTime"), "left_semi").select("_t", F.lit(1)))
    broken = check_unique_key(times, ["logTime"]).select("logTime", "reason").limit(5).collect()
    if broken:
        raise ValueError(f"run log key logTime broken: {[(str(r['logTime']), r['reason']) for r in broken]}")
    new.write.insertInto(table)


def logged_near(rows: DataFrame, table: str) -> DataFrame:
    """Key, notebook and message (``_t, _b, _m``) of the logged rows in the months from the first
    to the last of ``rows``: other months' partitions are not read."""
    span = rows.agg(F.min(LOG_MONTH).alias("first"), F.max(LOG_MONTH).alias("last")).first()
    old = rows.sparkSession.table(table).where(F.col(LOG_MONTH).between(F.lit(span["first"]), F.lit(span["last"])))
    return old.select(F.col("logTime").alias("_t"), F.col("notebookName").alias("_b"), F.col("logMessage").alias("_m"))


# --- C2 -------------------------------------------------------------------------------


def check_unique_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that break a primary key: duplicates (``n > 1``) and NULL keys.

    Empty result = the key is valid. One partial aggregate on the key columns.
    """
    keys = list(keys)
    any_null = None
    for k in keys:
        any_null = F.col(k).isNull() if any_null is None else (any_null | F.col(k).isNull())
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.col("n") > 1) | any_null).withColumn(
        "reason", F.when(any_null, F.lit("null key")).otherwise(F.lit("duplicate"))
    )


# --- C3, C5 ---------------------------------------------------------------------------


def catalog_inventory(spark: SparkSession, catalogs: Sequence[str] | None = None) -> DataFrame:
    """Existing tables as ``catalog, schema, table`` rows (metadata commands only, one a
    schema, as open-source catalogs have no listing across schemas; the session's current
    catalog is left alone). Their results stay DataFrames; the driver keeps schema names."""
    out = spark.createDataFrame([], "catalog string, schema string, table string")
    names = list(catalogs) if catalogs is not None else [c.name for c in spark.catalog.listCatalogs()]
    for cat in names:
        for db in spark.sql(f"SHOW NAMESPACES IN {_quoted(cat)}").collect():
            path = ".".join([_quoted(cat), *[_quoted(part) for part in _parts(db[0])]])
            found = spark.sql(f"SHOW TABLES IN {path}").where(~F.col("isTemporary"))
            out = out.unionByName(found.select(F.lit(cat).alias("catalog"), F.lit(db[0]).alias("schema"), F.col("tableName").alias("table")))
    return out


def create_tables(wanted: DataFrame, location: str, threads: int = 8) -> None:
    """Register an empty table for every row of ``wanted(schema, table)``, with its schema under
    ``location``. A catalog takes tables one by one, from the driver, which holds the names
    of one partition at a time; ``threads`` commands run side by side."""
    spark = wanted.sparkSession
    for row in wanted.select("schema").distinct().toLocalIterator():
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {_quoted(row['schema'])} LOCATION '{location}/{row['schema']}'")

    def create(row) -> None:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {_quoted(row['schema'])}.{_quoted(row['table'])} (x INT) USING parquet")

    with ThreadPool(threads) as pool:
        for _ in pool.imap_unordered(create, wanted.toLocalIterator(), chunksize=16):
            pass


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _parts(namespace: str) -> list[str]:
    """Parts of a namespace as ``SHOW NAMESPACES`` prints it: quoted where needed."""
    import re

    return [p[1:-1].replace("``", "`") if p.startswith("`") else p for p in re.findall(r"`(?:[^`]|``)*`|[^.`]+", namespace)]


def catalog_schemas(inventory: DataFrame) -> DataFrame:
    """C3, map form: ``catalog, schemas`` (sorted distinct schema names per catalog)."""
    return inventory.groupBy("catalog").agg(F.sort_array(F.collect_set("schema")).alias("schemas"))


def tables_exist(
    requests: DataFrame, inventory: DataFrame, catalog: str = "catalog", schema: str = "schema", table: str = "table"
) -> DataFrame:
    """C5, many-row form: adds ``exists`` to (catalog, schema, table) requests
    (case-insensitive names)."""
    inv = inventory.select(
        F.lower("catalog").alias("_c"), F.lower("schema").alias("_s"), F.lower("table").alias("_t")
    ).distinct().withColumn("_hit", F.lit(True))
    cond = (
        (F.lower(F.col(catalog)) == F.col("_c"))
        & (F.lower(F.col(schema)) == F.col("_s"))
        & (F.lower(F.col(table)) == F.col("_t"))
    )
    return requests.join(inv, cond, "left").withColumn("exists", F.coalesce("_hit", F.lit(False))).drop(
        "_c", "_s", "_t", "_hit"
    )


# --- C6, C7 ---------------------------------------------------------------------------

# Table-kind -> SHOW TABLES LIKE pattern ('*' = any text, '|' separates
# alternatives, case-insensitive, whole-name match).
DATED_KIND_PATTERNS = (
    ("claimreviews", "claimreviews*"),
    ("claimsfull", "claimsfull*"),
    ("lossevents", "lossevents*"),
    (" ", "updatevalues*"),
)


def layer_kind_patterns(kinds: Sequence[str] = ("detail", "gross", "summary")) -> tuple:
    """C7 rules: ``<kind>[0-9]*`` for each layer table kind."""
    return tuple((k, f"{k}[0-9]*") for k in kinds)


LAYER_TABLE_TYPES = ("detail", "gross", "summary")


def find_layer_tables(
    requests: DataFrame,
    listing: DataFrame,
    layer_customers: Sequence[str],
    whole_customers: Sequence[str],
    name_col: str = "tableName",
) -> DataFrame:
    """C7 with all its inputs: ``requests(customer, table_type, bronze_table_type, as_of)``
    plus ``found``.

    For a customer of ``layer_customers`` the table type must be one of
    ``LAYER_TABLE_TYPES`` (any case) and the pattern is ``<bronze_table_type>[0-9]*``; for one of
    ``whole_customers`` it is ``<customer>*``, whatever the types. Other customers and types
    fail the job. The pattern's text comes from the data, so it is matched by the longest
    prefix of letters that a table name and a request share, then by the rest.
    """
    kind = (
        F.when(
            F.col("customer").isin(*layer_customers) & F.lower("table_type").isin(*LAYER_TABLE_TYPES),
            F.concat(F.lit("0"), F.lower("bronze_table_type")),
        )
        .when(F.col("customer").isin(*whole_customers), F.concat(F.lit("*"), F.lower("customer")))
        .otherwise(
            F.raise_error(F.concat_ws(" ", F.lit("no rule for customer and table type:"), F.coalesce("customer", F.lit("NULL")), F.coalesce("table_type", F.lit("NULL"))))
        )
    )
    req = requests.withColumn("_kind", kind)
    names = listing.select(F.col(name_col).alias("_name")).where(F.col("_name").isNotNull()).distinct()
    # a layer table is named by its type and a digit: the type is what stands before a digit
    low = F.lower("_name")
    digits = F.filter(F.sequence(F.lit(1), F.length("_name")), lambda i: F.substring(low, i, 1).rlike("[0-9]"))
    layer = names.select("_name", F.explode(digits).alias("_at")).select(
        "_name", F.concat(F.lit("0"), F.substring(low, F.lit(1), F.col("_at") - 1)).alias("_kind")
    )
    whole = names.select(
        "_name",
        F.explode(F.array(*[F.when(low.startswith(c.lower()), F.lit("*" + c.lower())) for c in whole_customers])).alias("_kind"),
    ) if whole_customers else names.select("_name", F.lit("").alias("_kind")).limit(0)
    kinds = layer.unionByName(whole.where(F.col("_kind").isNotNull()))
    needles = req.select("_kind", F.col("as_of").alias("_as_of"))
    hits = matching_needles(needles, "_as_of", kinds.join(needles.select("_kind").distinct(), "_kind", "left_semi"), "_name", keys=["_kind"])
    hits = hits.withColumn("_hit", F.lit(True))
    return (
        req.join(hits, (req["_kind"] == hits["_kind"]) & (req["as_of"] == hits["_as_of"]), "left")
        .withColumn("found", F.coalesce(F.col("_hit"), F.lit(False)))
        .select(*requests.columns, "found")
    )


def like_to_regex(pattern: str) -> str:
    """A SHOW TABLES LIKE pattern as a Java regex (whole-name, case-insensitive)."""
    alts = [p.strip().replace("*", ".*") for p in pattern.split("|")]
    return "(?i)^(?:" + "|".join(alts) + ")$"


def table_kinds(names: DataFrame, name_col: str, rules: Sequence[tuple]) -> DataFrame:
    """Each table name with every kind whose pattern it matches (no join needed)."""
    matches = F.array_compact(
        F.array(*[F.when(F.col(name_col).rlike(like_to_regex(p)), F.lit(k)) for k, p in rules])
    )
    return names.select(F.col(name_col).alias("_name"), F.explode(matches).alias("kind"))


def find_dated_tables(
    requests: DataFrame,
    listing: DataFrame,
    rules: Sequence[tuple] = DATED_KIND_PATTERNS,
    kind_col: str = "kind",
    as_of_col: str = "as_of",
    name_col: str = "tableName",
    case_insensitive_kind: bool = True,
) -> DataFrame:
    """For each (kind, as-of) request, ``found`` = some listed table matches the
    kind's pattern and contains the as-of text. Unknown kinds fail the job.

    The "contains" test is the exact substring join of ``joins.matching_needles``, so no
    request is paired with every table of its kind. The batch answer to
    "what is still to load" is ``where(~found)``.
    """
    known = [k for k, _ in rules]
    kind = F.lower(F.col(kind_col)) if case_insensitive_kind else F.col(kind_col)
    req = requests.withColumn("_kind", kind)
    req = req.withColumn(
        "_kind",
        F.when(F.col("_kind").isin(known), F.col("_kind")).otherwise(
            F.raise_error(F.concat(F.lit("unknown table kind: "), F.coalesce(F.col(kind_col), F.lit("NULL"))))
        ),
    )
    kinds = table_kinds(listing.select(name_col).distinct(), name_col, rules).withColumnRenamed("kind", "_kind")
    hits = matching_needles(
        req.select("_kind", F.col(as_of_col).alias("_as_of")), "_as_of", kinds, "_name", keys=["_kind"]
    ).withColumn("_hit", F.lit(True))
    return (
        req.join(hits, (req["_kind"] == hits["_kind"]) & (req[as_of_col] == hits["_as_of"]), "left")
        .withColumn("found", F.coalesce(F.col("_hit"), F.lit(False)))
        .select(*requests.columns, "found")
    )


# --- versioned snapshots --------------------------------------------------------------


COMMITS_SCHEMA = "version long, kind string, commit_id string, stream string, batch long"
DELTA_PARTITION = "delta_version"
#: Rows of a file of a delta. Readers sort the changes of a scan task by key; Spark puts at most
#: 32 files in a scan task (``maxPartitionBytes`` over ``openCostInBytes``), however small they are.
DELTA_FILE_ROWS = 100_000


def _commit(spark: SparkSession, base: str, version: int, kind: str, stream: str | None = None, batch: int | None = None) -> None:
    spark.createDataFrame([(version, kind, uuid.uuid4().hex, stream, batch)], COMMITS_SCHEMA).write.mode("append").parquet(
        f"{base}/_commits"
    )


def _commits(spark: SparkSession, base: str) -> DataFrame | None:
    try:
        return spark.read.schema(COMMITS_SCHEMA).parquet(f"{base}/_commits")
    except Exception as exc:  # no commit yet
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
            return None
        raise


def commit_snapshot(
    df: DataFrame, base: str, version: int | None = None, fmt: str = "parquet", stream: str | None = None, batch: int | None = None
) -> int:
    """Write ``df`` as a full version under ``base`` and record it as committed.

    Data goes to ``<base>/v=<n>`` (overwrite, so a retried write of the same version
    replaces partial output); then ``n`` is appended to ``<base>/_commits``. Readers
    take the highest committed version. ``version`` defaults to one above the last;
    ``stream`` and ``batch`` name what it came from, for :func:`committed_batch`.
    """
    spark = df.sparkSession
    if version is None:
        last = latest_version(spark, base)
        version = 0 if last is None else last + 1
    df.write.mode("overwrite").format(fmt).save(f"{base}/v={version}")
    _commit(spark, base, version, "full", stream, batch)
    return version


def commit_delta(
    df: DataFrame, base: str, version: int | None = None, fmt: str = "parquet", stream: str | None = None, batch: int | None = None
) -> int:
    """Record ``df`` (rows of changes) as the next delta version: written to
    ``<base>/_deltas/delta_version=<n>`` (overwrite: a retry replaces partial output), then committed,
    with the stream and batch it came from. The cost is the size of the changes, whatever
    the size of the table. Files have at most ``DELTA_FILE_ROWS`` rows, so that a delta of one
    task is read by many."""
    spark = df.sparkSession
    if version is None:
        last = latest_version(spark, base)
        version = 0 if last is None else last + 1
    df.write.mode("overwrite").option("maxRecordsPerFile", DELTA_FILE_ROWS).format(fmt).save(f"{base}/_deltas/{DELTA_PARTITION}={version}")
    _commit(spark, base, version, "delta", stream, batch)
    return version


def committed_batch(spark: SparkSession, base: str, stream: str, batch: int) -> int | None:
    """The version that holds a batch of a stream; None if it was not committed."""
    commits = _commits(spark, base)
    if commits is None:
        return None
    row = commits.where((F.col("stream") == stream) & (F.col("batch") == batch)).agg(F.max("version").alias("v")).first()
    return row["v"]


def last_stream(spark: SparkSession, base: str) -> str | None:
    """The stream of the newest version that has one."""
    commits = _commits(spark, base)
    if commits is None:
        return None
    return commits.where(F.col("stream").isNotNull()).agg(F.max_by("stream", "version").alias("s")).first()["s"]


def latest_version(spark: SparkSession, base: str, kind: str | None = None) -> int | None:
    """Highest committed version (of any kind, or of the given ``kind``)."""
    commits = _commits(spark, base)
    if commits is None:
        return None
    if kind is not None:
        commits = commits.where(F.col("kind") == kind)
    row = commits.agg(F.max("version").alias("v")).first()
    return None if row is None else row["v"]


def read_snapshot(spark: SparkSession, base: str, fmt: str = "parquet", version: int | None = None) -> DataFrame:
    """The latest committed full version (or the given one)."""
    v = latest_version(spark, base, "full") if version is None else version
    if v is None:
        raise FileNotFoundError(f"no committed snapshot under {base}")
    return spark.read.format(fmt).load(f"{base}/v={v}")


def read_with_deltas(spark: SparkSession, base: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame | None]:
    """(latest full version, committed deltas after it or ``None``) -- the two inputs a
    merge-on-read reader combines. Deltas are pruned by their version partition."""
    full_v = latest_version(spark, base, "full")
    if full_v is None:
        raise FileNotFoundError(f"no committed snapshot under {base}")
    last = latest_version(spark, base)
    full = spark.read.format(fmt).load(f"{base}/v={full_v}")
    if last == full_v:
        return full, None
    deltas = (
        spark.read.format(fmt)
        .load(f"{base}/_deltas")
        .where((F.col(DELTA_PARTITION) > full_v) & (F.col(DELTA_PARTITION) <= last))
        .drop(DELTA_PARTITION)
    )
    return full, deltas


def stamp_now() -> Column:
    """Current time as a zoneless timestamp."""
    return F.current_timestamp().cast("timestamp_ntz")


def merge_rows(updates: DataFrame, table: str, keys: Sequence[str], columns: Sequence[str]) -> bool:
    """Row-level write-back: set ``columns`` of the rows of ``table`` that ``updates`` names by
    ``keys``, and insert the others, with ``MERGE``. False where the table's catalog has no
    row-level operations (nothing is written then: write a snapshot instead)."""
    keys, columns = list(keys), list(columns)
    source = updates.select(*keys, *columns).alias("source")
    match = None
    for k in keys:
        one = F.col(f"{table}.{k}").eqNullSafe(F.col(f"source.{k}"))
        match = one if match is None else match & one
    try:
        source.mergeInto(table, match).whenMatched().update(
            {c: F.col(f"source.{c}") for c in columns}
        ).whenNotMatched().insert({c: F.col(f"source.{c}") for c in [*keys, *columns]}).merge()
    except Exception as exc:
        if "MERGE" in str(exc).upper() and ("UNSUPPORTED" in str(exc).upper() or "SUPPORT" in str(exc).upper()):
            return False
        raise
    return True
