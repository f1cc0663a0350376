"""Column expressions over file names, storage URLs, user ids and table names.

Every function takes Columns (or column names) and returns a Column, so it runs
inside whole-stage codegen on the executors; nothing here is a UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's for the same results):
# accepted input-file extensions, in the order the reference tests them.
INPUT_EXTENSIONS = (".csv", ".xls", ".xlsx")
# Backup time stamp: Python strftime "%Y_%m_%d-%I_%M_%S_%p", written as a Spark pattern.
BACKUP_STAMP_PATTERN = "yyyy_MM_dd-hh_mm_ss_a"
# Default watermark when nothing was loaded yet: 1970-01-01 00:00:00.000.
DEFAULT_TIMESTAMP_TEXT = "1970-01-01 00:00:00"
# File-name routing rules: (token searched in the lower-cased name, customer, as-of layout).
# The tokens are fixed values; customer names are neutral placeholders.
DEFAULT_ROUTES = (
    ("lpt", "client_b", "after_dash"),
    ("bcg", "client_a", "before_underscore"),
)

# Python's str.strip() whitespace: Unicode white space plus the four separators \x1c-\x1f.
_PY_SPACE = r"[\s\x{1c}-\x{1f}]"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _v(value: Column | str) -> Column:
    """A literal unless it is already a Column."""
    return value if isinstance(value, Column) else F.lit(value)


def py_strip(col: Column | str) -> Column:
    """Strip leading and trailing whitespace the way Python's ``str.strip()`` does."""
    return F.regexp_replace(_c(col), rf"(?U)^{_PY_SPACE}+|{_PY_SPACE}+$", "")


def after_first(col: Column | str, sep: str) -> Column:
    """Text after the first ``sep``; NULL when ``sep`` does not occur."""
    c = _c(col)
    pos = F.instr(c, sep)
    return F.when(pos > 0, F.substr(c, pos + F.lit(len(sep))))


# --- P2 -------------------------------------------------------------------------------


def as_of_date(file_name: Column | str, layout: Column | str) -> Column:
    """As-of date text taken from a file name.

    layout ``before_underscore``: text before the first ``_``;
    layout ``after_dash``: text after the first ``-`` (NULL when there is none).
    Then: stripped, cut at the first ``.``, blanks removed. Stays a string.
    Unknown layouts give NULL.
    """
    f = _c(file_name)
    lay = _v(layout)
    raw = F.when(lay == "before_underscore", F.split_part(f, F.lit("_"), F.lit(1))).when(
        lay == "after_dash", after_first(f, "-")
    )
    return F.replace(F.split_part(py_strip(raw), F.lit("."), F.lit(1)), F.lit(" "), F.lit(""))


AS_OF_FORMATS = ("yyyyMMdd", "yyyy-MM-dd", "yyyy-MM", "yyyy_MM", "yyyyMM")


def _shape(fmt: str) -> str:
    """A regex every text that ``fmt`` can parse matches: each run of pattern letters
    becomes a run of digits (optionally signed), other characters stay literal."""
    import re

    body = re.sub(r"[A-Za-z]+", "[0-9]+", re.escape(fmt).replace("\\-", "-"))
    return f"^[+-]?{body}$"


def as_of_to_date(text: Column | str, formats: Sequence[str] = AS_OF_FORMATS) -> Column:
    """The as-of text parsed to a DATE with the first format that fits, else NULL.

    Each format is only tried on text of its shape: a failed parse is costly (the
    parser fails by exception), and a text of another shape cannot parse anyway.
    """
    t = _c(text)
    return F.coalesce(*[F.when(t.rlike(_shape(fmt)), F.try_to_date(t, fmt)) for fmt in formats])


# --- P3 -------------------------------------------------------------------------------


def storage_root(url: Column | str) -> Column:
    """First ``//(.+?)/`` match (bucket or ``container@account``); NULL when absent."""
    return F.nullif(F.regexp_extract(_c(url), r"//(.+?)/", 1), F.lit(""))


# --- P4 -------------------------------------------------------------------------------


def backup_stamp(ts: Column | str) -> Column:
    """The backup time stamp text (12-hour clock with AM/PM, US form)."""
    return F.date_format(_c(ts), BACKUP_STAMP_PATTERN)


def backup_name(file_name: Column | str, extension: Column | str, stamp_ts: Column | str) -> Column:
    """``<text before the first dot>_<stamp>.<extension>``; empty text for an empty name."""
    f = _c(file_name)
    named = F.concat(
        F.split_part(f, F.lit("."), F.lit(1)), F.lit("_"), backup_stamp(stamp_ts), F.lit("."), _v(extension)
    )
    return F.when(F.coalesce(f, F.lit("")) == "", F.lit("")).otherwise(named)


def file_extension(file_name: Column | str) -> Column:
    """Text after the last dot (empty when there is no dot)."""
    f = _c(file_name)
    return F.when(F.instr(f, ".") > 0, F.substring_index(f, ".", -1)).otherwise(F.lit(""))


# --- P5 -------------------------------------------------------------------------------


def initials(user_id: Column | str) -> Column:
    """P5: first letter of the first dot-part + second dot-part up to ``@``.

    ``john.smith@x.com`` -> ``jsmith``; ``jane@x.com`` -> ``jcom``; NULL stays NULL.
    """
    u = _c(user_id)
    first = F.substring(F.split_part(u, F.lit("."), F.lit(1)), 1, 1)
    second = F.split_part(F.split_part(u, F.lit("."), F.lit(2)), F.lit("@"), F.lit(1))
    return F.concat(first, second)


# --- P6 -------------------------------------------------------------------------------


def route_by_name(file_name: Column | str, routes: Sequence[tuple] = DEFAULT_ROUTES, field: int = 1) -> Column:
    """The first rule whose token occurs in the lower-cased name wins; NULL if none.

    ``field`` picks what is returned from the rule (1 = customer, 2 = layout).
    """
    low = F.lower(_c(file_name))
    out = None
    for rule in routes:
        cond = low.contains(rule[0])
        out = F.when(cond, F.lit(rule[field])) if out is None else out.when(cond, F.lit(rule[field]))
    return out if out is not None else F.lit(None).cast("string")


# --- P7, P8 ---------------------------------------------------------------------------


def null_if_nan(value: Column | str, fallback: Column | str | None = None) -> Column:
    """NULL or the text ``nan`` (any case) counts as missing; then take ``fallback``.

    Blank text is *not* missing, as in the reference.
    """
    v = _c(value)
    kept = F.when(F.lower(v) != "nan", v)
    return kept if fallback is None else F.coalesce(kept, _c(fallback))


def delimiter_kind(text: Column | str) -> Column:
    """``comma`` if the text has a comma, else ``space`` if it has a blank, else ``nothing``."""
    t = _c(text)
    return (
        F.when(F.instr(t, ",") > 0, F.lit("comma"))
        .when(F.instr(t, " ") > 0, F.lit("space"))
        .otherwise(F.lit("nothing"))
    )


# --- P10 - P14 ------------------------------------------------------------------------


def default_timestamp() -> Column:
    """P10: the zoneless epoch used when no load happened yet."""
    return F.lit(DEFAULT_TIMESTAMP_TEXT).cast("timestamp_ntz")


def schema_part(name: Column | str) -> Column:
    """Text before the first dot of ``schema.table``."""
    return F.split_part(_c(name), F.lit("."), F.lit(1))


def table_part(name: Column | str) -> Column:
    """Text between the first and second dot (empty when there is no dot)."""
    return F.split_part(_c(name), F.lit("."), F.lit(2))


def environment_bucket(cluster_name: Column | str) -> Column:
    """Second ``-`` part of a cluster name, lower case; ``dev`` and ``qa`` share ``dev``."""
    env = F.nullif(F.lower(F.split_part(_c(cluster_name), F.lit("-"), F.lit(2))), F.lit(""))
    return F.when(env.isin("dev", "qa"), F.lit("dev")).otherwise(env)


def has_extension(file_name: Column | str, extensions: Sequence[str] = INPUT_EXTENSIONS) -> Column:
    """The name ends with one of the extensions (case-sensitive)."""
    f = _c(file_name)
    cond = None
    for ext in extensions:
        e = f.endswith(ext)
        cond = e if cond is None else (cond | e)
    return cond


def decode_file_name(encoded: Column | str) -> Column:
    """URL-decode a name from ``_metadata.file_name``; a literal ``+`` stays a ``+``."""
    return F.try_url_decode(F.replace(_c(encoded), F.lit("+"), F.lit("%2B")))


def source_file_name() -> Column:
    """The decoded name of the file each row was read from."""
    return decode_file_name(F.col("_metadata.file_name"))
