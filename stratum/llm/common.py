"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import stratum
from stratum.session import load, scratch_path

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    """The wanted columns of one table; extra columns are pruned from the scan."""
    return load(spark, sf_dir, name).select(*columns)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    Cuts the lineage: what follows is replayed from files that every executor sees.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once a Spark context, through Spark's own file
    distribution; they need not have it installed. Module state (vocabularies, caches) then
    lives as long as a Python worker."""
    sc = spark.sparkContext
    if getattr(sc, "_stratum_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(stratum.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="stratum-ship-"), "stratum.zip")  # read by the driver alone
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._stratum_shipped = True


#: Rows of a batch between the JVM and Python: the rows here are whole texts, so Spark's
#: default of 10,000 would be tens of MB a task on both sides.
ARROW_ROWS = 2_000


def release_memory() -> None:
    """Gives freed memory back to the system; Python workers outlive their tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return


def arrow_map(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the executors and small batches."""
    spark = df.sparkSession
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)

    def task(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return df.mapInArrow(task, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_join(big: DataFrame, small: DataFrame, on: list[str], by: str, salts: int = 16) -> DataFrame:
    """Inner join on ``on`` that deals the rows of a hot key out to ``salts`` tasks, by the hash
    of ``by``; each row of ``small`` is sent to all of them. For a ``small`` with few rows a key."""
    dealt = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(dealt, [*on, "_salt"]).drop("_salt")


#: Upper bound on the ranges of :func:`range_buckets`; two lookups of 256 cover it.
MAX_BUCKETS = 65_536
_FAN = 256


def _long_array(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def range_buckets(df: DataFrame, key: str, rows_per_bucket: int = 2048) -> Column:
    """A deterministic range number (int) for a bigint column: quantile splits of the
    column are measured once (at most ``MAX_BUCKETS``) and put into the plan as
    literals, so that a replayed task deals its rows as before. NULL is in range 0."""
    n = df.count()
    parts = max(1, min(MAX_BUCKETS, math.ceil(n / rows_per_bucket)))
    if parts == 1:
        return F.lit(0)
    shares = [i / parts for i in range(1, parts)]
    splits = df.agg(F.percentile_approx(key, shares, max(10_000, 4 * parts)).alias("s")).first()["s"]
    splits = sorted({s for s in splits or [] if s is not None})
    if not splits:
        return F.lit(0)
    col = F.col(key)

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda s: s <= col))

    if len(splits) <= _FAN:
        return below(_long_array(splits))
    groups = [splits[i : i + _FAN] for i in range(0, len(splits), _FAN)]
    first = below(_long_array([g[0] for g in groups]))
    rows = F.transform(F.split(F.lit(";".join(",".join(map(str, g)) for g in groups)), ";"),
                       lambda s: F.split(s, ",").cast("array<bigint>"))
    return F.when(first == 0, 0).otherwise((first - 1) * _FAN + below(F.element_at(rows, F.greatest(first, F.lit(1)))))
