"""Lookups: catalog resolution (J1), storage validation (J2), REST listings.

The reference loops over collected rows in Python; here each lookup is a join.
"First" always has a stated order, and ties are picked with a partial aggregate
(``min_by``/``max_by``) rather than a window, so a hot key is reduced map-side
before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import environment_bucket, storage_root
from .joins import matching_needles


# --- J1 -------------------------------------------------------------------------------


def resolve_catalog(
    requests: DataFrame,
    catalog_names: DataFrame,
    client_col: str = "client",
    env_col: str = "environment",
) -> DataFrame:
    """Adds ``catalogName`` for each (client, environment) request.

    Matching is ``lower(customer) == client`` (the client itself is not lowered, as in
    the reference) and ``lower(environment) == env``. Several catalog rows for one key:
    the smallest ``catalogName`` wins. No row: NULL.

    The catalog side is one row per (customer, environment).
    """
    cat = (
        catalog_names.select(
            F.lower("customer").alias("_cust"), F.lower("environment").alias("_env"), "catalogName"
        )
        .groupBy("_cust", "_env")
        .agg(F.min("catalogName").alias("catalogName"))
    )
    out = requests.join(
        cat, (F.col(client_col) == F.col("_cust")) & (F.col(env_col) == F.col("_env")), "left"
    )
    return out.drop("_cust", "_env")


def environment_from_cluster(requests: DataFrame, cluster_col: str = "cluster_name") -> DataFrame:
    """P12 applied to a request table: adds ``environment`` from the cluster name."""
    return requests.withColumn("environment", environment_bucket(cluster_col))


# --- J2 -------------------------------------------------------------------------------


def validate_storage(
    requests: DataFrame,
    locations: DataFrame,
    name_col: str = "storage_name",
    url_col: str = "url",
    use_root: bool = True,
    exact: bool = False,
) -> DataFrame:
    """Adds boolean ``valid`` to each storage request.

    ``use_root=True``: the storage root (P3) of the name must occur as a substring of
    at least one location URL; ``use_root=False`` looks for the raw name (the other
    edition). An empty or NULL name, or a name without a root, is not valid.
    ``exact=True`` compares the root with the root of each location URL by equality.

    A root that is the root of a location is found by that equality; only the others
    go through the substring search.
    """
    probe = storage_root(name_col) if use_root else F.col(name_col)
    req = requests.withColumn("_probe", F.when(F.coalesce(F.length(name_col), F.lit(0)) > 0, probe))
    same = locations.select(storage_root(url_col).alias("_probe")).where(F.col("_probe").isNotNull()).distinct()
    if exact:
        roots = same
    elif use_root:
        rest = req.select("_probe").distinct().join(same, "_probe", "left_anti")
        roots = same.unionByName(matching_needles(rest, "_probe", locations, url_col))
    else:
        roots = matching_needles(req, "_probe", locations, url_col)
    roots = roots.withColumn("_hit", F.lit(True))
    return (
        req.join(roots, "_probe", "left")
        .withColumn("valid", F.coalesce("_hit", F.lit(False)))
        .drop("_probe", "_hit")
    )


# --- J3 -------------------------------------------------------------------------------

ERROR_NO_LISTING = "no listing"
ERROR_NOT_JSON = "listing is not valid JSON"
ERROR_NO_OBJECT = "listing is not a JSON object"


def _items(listings: DataFrame, json_col: str, items: str, keep: tuple, on_error: str) -> DataFrame:
    """One row per element of the array ``items`` of each JSON listing: ``pos`` and the element
    as a VARIANT ``_item``. A listing without the array is an empty one. What is no listing
    (NULL, broken JSON, no object, an ``error_code`` document, ``items`` that is no array) gives
    one row with the ``error`` (``on_error="report"``), or fails the job (``"raise"``)."""
    if on_error not in ("raise", "report"):
        raise ValueError(f"on_error is raise or report, not {on_error}")
    doc = listings.select(*keep, F.col(json_col).alias("_text"), F.try_parse_json(json_col).alias("_doc"))
    found = F.try_variant_get("_doc", f"$.{items}", "variant")
    doc = doc.withColumns({
        "_found": found,
        "_list": F.try_variant_get("_doc", f"$.{items}", "array<variant>"),
        "_code": F.try_variant_get("_doc", "$.error_code", "string"),
        "_said": F.try_variant_get("_doc", "$.message", "string"),
    })
    given = F.col("_found").isNotNull() & ~F.coalesce(F.is_variant_null("_found"), F.lit(False))
    error = (
        F.when(F.col("_text").isNull(), F.lit(ERROR_NO_LISTING))
        .when(F.col("_doc").isNull(), F.lit(ERROR_NOT_JSON))
        .when(F.col("_code").isNotNull(), F.concat_ws(" ", F.lit("listing is an error:"), "_code", "_said"))
        .when(~F.schema_of_variant("_doc").startswith("OBJECT"), F.lit(ERROR_NO_OBJECT))
        .when(given & F.col("_list").isNull(), F.lit(f"{items} is not an array"))
    )
    if on_error == "raise":
        error = F.when(error.isNotNull(), F.raise_error(error).cast("string"))
    # an element of its own carries the error; NULL elements are no items
    place = F.struct(F.lit(None).cast("int").alias("pos"), F.lit(None).cast("variant").alias("item"), F.col("error").alias("error"))
    each = F.transform("_list", lambda x, i: F.struct(i.cast("int").alias("pos"), x.alias("item"), F.lit(None).cast("string").alias("error")))
    return (
        doc.withColumn("error", error)
        .select(*keep, F.explode(F.when(F.col("error").isNotNull(), F.array(place)).otherwise(each)).alias("_row"))
        .select(*keep, "_row.pos", F.col("_row.item").alias("_item"), "_row.error")
    )


def _fields(rows: DataFrame, keep: tuple, fields: dict[str, tuple[str, str]], on_error: str) -> DataFrame:
    columns = [F.try_variant_get("_item", path, kind).alias(name) for name, (path, kind) in fields.items()]
    return rows.select(*keep, "pos", *columns, *(["error"] if on_error == "report" else []))


def explode_jobs(listings: DataFrame, json_col: str = "listing", keep: tuple = (), on_error: str = "raise") -> DataFrame:
    """JSON jobs listings -> one row per job: ``pos, job_id, job_name``.

    A missing or empty ``jobs`` array yields no rows. ``pos`` is the 0-based place
    in its listing, which together with ``keep`` columns orders "first" and "last". A broken
    listing fails the job, or with ``on_error="report"`` is a row with an ``error`` (NULL for
    jobs), so that it is not taken for an empty one.
    """
    rows = _items(listings, json_col, "jobs", keep, on_error)
    return _fields(rows, keep, {"job_id": ("$.job_id", "bigint"), "job_name": ("$.settings.name", "string")}, on_error)


def explode_clusters(listings: DataFrame, json_col: str = "listing", keep: tuple = (), on_error: str = "raise") -> DataFrame:
    """J3, cluster form: one row per cluster: ``pos, cluster_name, cluster_id, state``."""
    rows = _items(listings, json_col, "clusters", keep, on_error)
    names = ("cluster_name", "cluster_id", "state")
    return _fields(rows, keep, {n: (f"$.{n}", "string") for n in names}, on_error)


def listing_broken(listing: DataFrame) -> Column:
    """Whether a reported listing has an error: a subquery for plans that must not take a job
    that it does not name for one that does not exist."""
    return listing.where(F.col("error").isNotNull()).select(F.count(F.lit(1)) > 0).scalar()


# --- J4 -------------------------------------------------------------------------------


def first_by_name(
    listing: DataFrame,
    name_col: str = "job_name",
    value_col: str = "job_id",
    order_cols: tuple = ("pos",),
    keep: str = "first",
) -> DataFrame:
    """One row per name: the value at the first (or last) listing position."""
    order = F.struct(*order_cols) if len(order_cols) > 1 else F.col(order_cols[0])
    pick = F.min_by if keep == "first" else F.max_by
    if "error" in listing.columns:
        listing = listing.where(F.col("error").isNull())
    return listing.groupBy(name_col).agg(pick(value_col, order).alias(value_col))


def lookup_by_name(
    wanted: DataFrame,
    listing: DataFrame,
    name_col: str = "job_name",
    value_col: str = "job_id",
    order_cols: tuple = ("pos",),
) -> DataFrame:
    """For each wanted name: first and last id, and ``status``.

    ``found`` / ``not found``; ``empty`` when the listing has no rows at all. Where a reported
    listing has an ``error``, a name that is not in the rest is ``unknown``.
    """
    order = F.struct(*order_cols) if len(order_cols) > 1 else F.col(order_cols[0])
    reported = "error" in listing.columns
    rows_only = listing.where(F.col("error").isNull()) if reported else listing
    both = rows_only.groupBy(name_col).agg(
        F.min_by(value_col, order).alias(value_col), F.max_by(value_col, order).alias(f"{value_col}_last")
    )
    rows = listing.select(F.count(F.lit(1))).scalar()  # a subquery of the same plan
    out = wanted.join(both, name_col, "left")
    status = F.when(F.col(value_col).isNotNull(), F.lit("found"))
    if reported:
        status = status.when(listing_broken(listing), F.lit("unknown"))
    status = status.when(rows == 0, F.lit("empty")).otherwise(F.lit("not found"))
    return out.withColumn("status", status)
