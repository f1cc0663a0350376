"""File sources and file moves: list input files (S1), check presence (S2),
archive read files (S3), and land rows as named files (used to stage inputs).

Listings use the ``binaryFile`` source restricted to ``path, length,
modificationTime``, so file contents are never read. File moves run on the
executors through pyarrow filesystems, one small task per batch of files, and are
idempotent: a retried task finds the file already at its destination. A move never
lands on an existing file.
"""

from __future__ import annotations

import csv
import io
import sys
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import INPUT_EXTENSIONS, backup_name, decode_file_name, file_extension

# The move functions run in Python workers; ship them by value so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LISTING_SCHEMA = "path string, file_name string, length long, modificationTime timestamp"
MOVE_SCHEMA = "src string, dst string, status string"
#: Bytes of a file that are looked at for its header line.
HEADER_BYTES = 1 << 20


def _glob(extensions: Sequence[str]) -> str:
    exts = [e.lstrip(".") for e in extensions]
    return "*." + exts[0] if len(exts) == 1 else "*.{" + ",".join(exts) + "}"


def list_input_files(
    spark: SparkSession, directory: str, extensions: Sequence[str] = INPUT_EXTENSIONS
) -> DataFrame:
    """Files directly in ``directory`` whose names end with one of the extensions
    (case-sensitive): ``path, file_name, length, modificationTime``.

    Sub-directories (such as ``backup/``) are not entered. No match gives no rows.
    """
    pattern = f"{directory.rstrip('/')}/{_glob(extensions)}"
    try:
        listing = spark.read.format("binaryFile").load(pattern)
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return spark.createDataFrame([], LISTING_SCHEMA)
        raise
    return listing.select("path", base_name("path").alias("file_name"), "length", "modificationTime")


def base_name(path: Column | str) -> Column:
    """Last segment of a listed path (``binaryFile`` paths are not URL-encoded,
    unlike ``_metadata.file_name``)."""
    return F.element_at(F.split(path, "/"), -1)


def first_input_file(listing: DataFrame) -> DataFrame:
    """S1 "first file": the oldest by modification time, then by path (deterministic)."""
    return listing.orderBy("modificationTime", "path").limit(1)


def files_present(requests: DataFrame, listing: DataFrame, name_col: str = "file_name") -> DataFrame:
    """Adds boolean ``present`` = the exact name is in the filtered listing."""
    names = listing.select(F.col("file_name").alias("_present_name")).distinct().withColumn("_hit", F.lit(True))
    return (
        requests.join(names, F.col(name_col) == F.col("_present_name"), "left")
        .withColumn("present", F.coalesce("_hit", F.lit(False)))
        .drop("_present_name", "_hit")
    )


# --- moves ----------------------------------------------------------------------------


def archive_plan(
    listing: DataFrame, stamp_ts: Column | None = None, subdir: Column | str = "backup"
) -> DataFrame:
    """S3, batch form: ``src, dst, length`` per listed file, for any scheme that the
    executors' file system library knows (``dbfs`` paths are reached through their mount).

    ``dst = <dir of src>/<subdir>/<name before first dot>_<stamp>.<extension>``; the
    stamp comes from ``stamp_ts`` (default: now) so a plan can be reproduced. The name is cut at the
    first dot, so ``x - 2023.06.30.csv`` and ``x - 2023.07.31.csv`` would share a
    destination: where files of a plan do, each gets a suffix made from its own name.
    ``subdir`` may be a column that names the folder for each file.
    """
    ts = stamp_ts if stamp_ts is not None else F.current_timestamp()
    parent = F.regexp_replace("path", "/[^/]*$", "")
    folder = F.lit(subdir) if isinstance(subdir, str) else subdir
    name = backup_name("file_name", file_extension("file_name"), ts)
    planned = listing.select(
        F.col("path").alias("src"), "file_name", "length", F.concat(parent, F.lit("/"), folder, F.lit("/"), name).alias("dst")
    )
    shared = F.count(F.lit(1)).over(Window.partitionBy("dst"))
    suffix = F.concat(F.lit("_"), F.substring(F.md5(F.col("file_name").cast("binary")), 1, 12))
    stem = F.regexp_extract("dst", r"^(.*?)(\.[^./]*)?$", 1)
    end = F.regexp_extract("dst", r"^(.*?)(\.[^./]*)?$", 2)
    return planned.withColumn("_shared", shared).select(
        "src", F.when(F.col("_shared") > 1, F.concat(stem, suffix, end)).otherwise(F.col("dst")).alias("dst"), "length"
    )


def _fs_path(uri: str):
    """A pyarrow filesystem and path for a Hadoop-style path as Spark lists it (raw,
    not URL-encoded)."""
    from pyarrow import fs as pafs

    if uri.startswith("dbfs:"):
        uri = "/dbfs/" + uri[len("dbfs:"):].lstrip("/")  # the mount that executors have
    if uri.startswith("file:") or uri.startswith("/"):
        path = uri[len("file:"):] if uri.startswith("file:") else uri
        while path.startswith("//"):
            path = path[1:]
        return pafs.LocalFileSystem(), path
    if uri.startswith("s3a://") or uri.startswith("s3n://"):
        uri = "s3://" + uri.split("://", 1)[1]
    return pafs.FileSystem.from_uri(uri)


def _move_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs as pafs

    for pdf in batches:
        out = []
        for src, dst, length in zip(pdf["src"], pdf["dst"], pdf["length"]):
            sfs, spath = _fs_path(src)
            dfs, dpath = _fs_path(dst)
            there, target = sfs.get_file_info(spath), dfs.get_file_info(dpath)
            if there.type == pafs.FileType.File and not pd.isna(length) and there.size != length:
                status = "changed"  # another file under the planned one's name, for a later run
            elif there.type == pafs.FileType.File and target.type != pafs.FileType.NotFound:
                status = "clash"  # another file has the name: this one stays where it is
            elif there.type == pafs.FileType.File:
                dfs.create_dir(dpath.rsplit("/", 1)[0], recursive=True)
                sfs.move(spath, dpath)
                status = "moved"
            elif target.type == pafs.FileType.File and (pd.isna(length) or target.size == length):
                status = "already moved"
            else:
                status = "missing"
            out.append((src, dst, status))
        yield pd.DataFrame(out, columns=["src", "dst", "status"])


def apply_moves(plan: DataFrame) -> DataFrame:
    """Run a ``src, dst[, length]`` move plan on the executors; returns ``src, dst, status``:
    ``moved``; ``already moved`` (the source is gone and a file of its length is at the
    destination); ``clash`` (both exist, nothing is moved); ``changed`` (the source has another
    length than planned, nothing is moved); ``missing``. Lazy: act on the result to move."""
    if "length" not in plan.columns:
        plan = plan.withColumn("length", F.lit(None).cast("long"))
    return plan.select("src", "dst", "length").mapInPandas(_move_batches, MOVE_SCHEMA)


def run_moves(plan: DataFrame, files_per_task: int = 64) -> dict[str, int]:
    """Execute a move plan once, spread over the tasks, and return the count per status (at
    most four rows reach the driver)."""
    spread = plan.repartition(int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src")
    return {r["status"]: r["n"] for r in apply_moves(spread).groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}


# --- CSV by header name -----------------------------------------------------------------


def _header_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path in pdf["path"]:
            fs, name = _fs_path(path)
            with fs.open_input_file(name) as source:
                head = source.read(HEADER_BYTES)
            if len(head) == HEADER_BYTES and b"\n" not in head and b"\r" not in head:
                out.append((path, None))
                continue
            text = head.decode("utf-8-sig", "replace")
            out.append((path, [n.strip() for n in next(csv.reader(io.StringIO(text, newline="")), [])]))
        yield pd.DataFrame(out, columns=["path", "header"])


def csv_headers(listing: DataFrame) -> DataFrame:
    """``path, header array<string>`` of each listed CSV file: one small range read a file. The
    header is NULL where no line ends within ``HEADER_BYTES``."""
    return listing.select("path").mapInPandas(_header_batches, "path string, header array<string>")


def header_problem(header: str, schema: T.StructType) -> Column:
    """Why a file whose names are in the column ``header`` cannot be read as ``schema``; NULL if
    it can. An empty file has no header and no problem."""
    lacking = F.array_except(F.array(*[F.lit(f.name) for f in schema.fields]), F.col(header))
    return (
        F.when(F.col(header).isNull(), F.lit(f"no header line within {HEADER_BYTES} bytes"))
        .when(F.size(header) == 0, F.lit(None))
        .when(F.size(lacking) > 0, F.concat(F.lit("no column "), F.array_join(lacking, ", ")))
    )


def _by_layout(
    spark: SparkSession, headers: DataFrame, schema: T.StructType, options: dict, cells: Callable[[T.StructField, Column | None], list[Column]],
    whole: Callable[[list[str]], list[Column]],
) -> DataFrame:
    """The records of the CSV files of ``headers(path, header)``, those of one header read
    together under its names: ``cells`` makes the output columns of a schema column from its text
    (None: the header lacks it), ``whole`` further ones from the names of all text columns."""
    layouts = headers.where(F.size("header") > 0).groupBy("header").agg(F.collect_list("path").alias("paths")).collect()
    out: DataFrame | None = None
    for layout in sorted(layouts, key=lambda x: x["header"]):  # a few, however many the files
        names = layout["header"]
        positions = {n: i for i, n in reversed(list(enumerate(names)))}
        columns = [f"c{i}" for i in range(len(names))]
        text = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, *([MALFORMED] if "columnNameOfCorruptRecord" in options else [])]])
        raw = spark.read.schema(text).options(header=True, **options).csv([_quoted(p) for p in layout["paths"]])
        rows = raw.select(
            *[c for f in schema.fields for c in cells(f, F.col(columns[positions[f.name]]) if f.name in positions else None)],
            *whole(columns),
            F.col("_metadata.file_path").alias("source_path"),
            F.col("_metadata.file_name").alias("_file_name"),
        )
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.range(0).select(
            *[c for f in schema.fields for c in cells(f, F.lit(None).cast("string"))], *whole([]),
            F.lit("").alias("source_path"), F.lit("").alias("source_file"),
        )
    return out.withColumn("source_file", decode_file_name("_file_name")).drop("_file_name")


def read_csv_by_header(spark: SparkSession, listing: DataFrame, schema: T.StructType, optional: bool = False) -> DataFrame:
    """The rows of the listed CSV files, columns taken by the name in each file's header,
    in the order and with the types of ``schema``, plus ``source_path`` and ``source_file``.

    Spark reads CSV columns by position when a schema is declared, so files are grouped by
    header and each group is read under its own names. Extra columns are ignored; a
    schema column that a header lacks raises (``optional``: becomes NULL). A cell that is
    not of the declared type fails the job instead of becoming NULL.
    """
    headers = csv_headers(listing).withColumn("problem", header_problem("header", schema))
    unread = F.col("problem").isNotNull() & (F.col("header").isNull() | F.lit(not optional))
    headers = headers.withColumn(
        "header", F.when(unread, F.raise_error(F.concat_ws(": ", "path", "problem")).cast("array<string>")).otherwise(F.col("header"))
    )

    def cells(field: T.StructField, text: Column | None) -> list[Column]:
        return [(F.lit(None) if text is None else text).cast(field.dataType).alias(field.name)]

    try:
        return _by_layout(spark, headers, schema, {"mode": "FAILFAST"}, cells, lambda _: [])
    except Exception as exc:
        if "USER_RAISED_EXCEPTION" in str(exc):
            raise ValueError(f"CSV files that cannot be read, one among them: {str(exc).splitlines()[0]}") from exc
        raise


#: Column of a record that has another number of fields than its header, and of a reject.
MALFORMED = "_malformed"
REJECT_COLUMNS = ("reject_reason", "reject_line")


def read_csv_checked(spark: SparkSession, headers: DataFrame, schema: T.StructType, escape: str = '"') -> DataFrame:
    """Like :func:`read_csv_by_header`, for ``headers(path, header)`` without a
    :func:`header_problem`, but a record that does not fit fails nothing: it has a
    ``reject_reason`` (each cell that is not of its column's type, or a wrong number of
    fields) and its ``reject_line``, both NULL for good records. A quote inside a quoted cell is
    doubled, as spreadsheets write it; give another ``escape`` for other files."""

    def cells(field: T.StructField, text: Column | None) -> list[Column]:
        typed = text.try_cast(field.dataType)
        wrong = F.concat(F.lit(f"{field.name}: "), text, F.lit(f" is no {field.dataType.simpleString()}"))
        return [typed.alias(field.name), F.when(text.isNotNull() & typed.isNull(), wrong).alias(f"_wrong {field.name}")]

    def whole(columns: list[str]) -> list[Column]:
        if not columns:
            return [F.lit("").alias(MALFORMED), F.lit("").alias("_line")]
        return [F.col(MALFORMED), F.to_csv(F.struct(*columns)).alias("_line")]

    # without column pruning a record's fields are counted whatever is selected of it
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED, "columnPruning": False, "escape": escape}
    rows = _by_layout(spark, headers, schema, options, cells, whole)
    wrong = [f"`_wrong {f.name}`" for f in schema.fields]
    reason = F.when(F.col(MALFORMED).isNotNull(), F.lit("another number of fields than the header has")).otherwise(
        F.nullif(F.concat_ws("; ", *wrong), F.lit(""))
    )
    return rows.withColumn("reject_reason", reason).select(
        *[F.col(f"`{f.name}`") for f in schema.fields],
        "source_path",
        "source_file",
        "reject_reason",
        F.when(F.col("reject_reason").isNotNull(), F.coalesce(MALFORMED, "_line")).alias("reject_line"),
    )


def _quoted(path: str) -> str:
    """A listed path as a literal glob: the characters with a meaning are escaped."""
    return "".join("\\" + c if c in "{}[]*?\\" else c for c in path)


# --- named files ------------------------------------------------------------------------


def write_named_files(
    df: DataFrame, name_col: str, directory: str, fmt: str = "csv", options: dict | None = None, parts: int = 1
) -> dict[str, int]:
    """Write the rows of ``df`` as one file per value of ``name_col``, named by it,
    directly in ``directory`` (like files arriving in a landing folder).

    Spark writes the data (partitioned output in a staging folder whose name starts with
    ``_`` so readers skip it); the part files are then renamed on the executors. With
    ``parts`` above one, a name's rows are dealt out to that many tasks and files, the
    further ones named ``<stem>_<n>.<extension>``, so that a hot name is not one task's
    work. Returns the count of files per move status.
    """
    spark = df.sparkSession
    base = directory.rstrip("/")
    staging = f"{base}/_staging-{uuid.uuid4().hex[:12]}"
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(parts)).cast("int")
    salted = df.withColumn("_part", salt) if parts > 1 else df.withColumn("_part", F.lit(0))
    writer = salted.repartition(name_col, "_part").write.partitionBy(name_col, "_part").format(fmt)
    for k, v in (options or {}).items():
        writer = writer.option(k, v)
    writer.save(staging)
    written = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(staging).select("path", "length")
    # partition directory values carry Spark's %XX escapes; decoding them gives the name
    name = decode_file_name(F.regexp_extract("path", f"/{name_col}=([^/]*)/_part=[^/]*/[^/]*$", 1))
    number = F.regexp_extract("path", "/_part=([^/]*)/[^/]*$", 1)
    stem = F.regexp_extract(name, r"^(.*?)(\.[^./]*)?$", 1)
    end = F.regexp_extract(name, r"^(.*?)(\.[^./]*)?$", 2)
    final = F.when(number == "0", name).otherwise(F.concat(stem, F.lit("_"), number, end))
    plan = written.where(name != "").select(F.col("path").alias("src"), F.concat(F.lit(base + "/"), final).alias("dst"), "length")
    return run_moves(plan)
