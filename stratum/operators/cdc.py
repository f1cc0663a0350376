"""Apply a change feed (insert / update / delete) to a base table by key.

Batch: newest change per key (an aggregate, so hot keys reduce map-side), then
merged into the base by one full outer join: the base is read once and shuffled on the
key. ``keep_base_in_place=True`` is the plan for a change feed that is small beside the
base: a left join, which Spark turns into a broadcast of the changes by their statistics
or at run time, so the base is not shuffled; its key columns are read a second time to
tell inserts from updates. The result is the same.

Replaying the same changes gives the same result. The streaming form
(``streaming.ingest.cdc_stream``) runs this per micro-batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = ("I", "U", "D")


def latest_changes(changes: DataFrame, keys: Sequence[str], seq_col: str = "seq", op_col: str = "op") -> DataFrame:
    """Newest change per key by ``seq`` (ties broken by the rest of the row). Every change,
    not only the newest, must have a known op and a key: others fail the job."""
    keys = list(keys)
    changes = changes.withColumns({op_col: _checked_op(op_col), **{k: _checked_key(k, changes) for k in keys}})
    rest = [c for c in changes.columns if c not in keys and c not in (seq_col, op_col)]
    packed = F.struct(F.col(seq_col), F.col(op_col), *[F.col(c) for c in rest])
    return changes.groupBy(*keys).agg(F.max(packed).alias("_c")).select(
        *keys, F.col(f"_c.{seq_col}").alias(seq_col), F.col(f"_c.{op_col}").alias(op_col),
        *[F.col(f"_c.{c}").alias(c) for c in rest],
    )


def _checked_op(op_col: str) -> Column:
    return F.when(F.col(op_col).isin(*OPS), F.col(op_col)).otherwise(
        F.raise_error(F.concat(F.lit("unknown change op: "), F.coalesce(F.col(op_col), F.lit("NULL"))))
    )


def _checked_key(key: str, changes: DataFrame) -> Column:
    missing = F.raise_error(F.lit(f"change without a key: {key} is NULL")).cast(changes.schema[key].dataType)
    return F.when(F.col(key).isNotNull(), F.col(key)).otherwise(missing)


def cdc_apply(
    base: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    seq_col: str = "seq",
    op_col: str = "op",
    keep_base_in_place: bool = False,
) -> DataFrame:
    """Base rows after the newest change per key: ``D`` removes the key, ``I``/``U``
    replace (or add) the row with the change's values, keys without a change stay.
    Unknown ops and NULL keys in the changes fail the job. Output columns are the base
    columns. ``keep_base_in_place``: see the module text.
    """
    keys = list(keys)
    cols = [c for c in base.columns if c not in keys]
    latest = latest_changes(changes.select(*keys, seq_col, op_col, *cols), keys, seq_col, op_col)
    ch = latest.select(*keys, F.col(op_col).alias("_op"), *[F.col(c).alias(f"_new_{c}") for c in cols])
    take_new = F.col("_op").isin("I", "U")
    merged = [F.when(take_new, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in cols]

    if keep_base_in_place:
        kept = (
            base.join(ch, keys, "left")
            .where(F.coalesce(F.col("_op"), F.lit("")) != "D")
            .select(*keys, *merged)
        )
        present = base.select(*keys).join(ch.select(*keys), keys, "left_semi").distinct()
        inserted = (
            ch.where(take_new)
            .join(present, keys, "left_anti")
            .select(*keys, *[F.col(f"_new_{c}").alias(c) for c in cols])
        )
        return kept.unionByName(inserted)

    b = base.withColumn("_in_base", F.lit(True))
    j = b.join(ch, keys, "full_outer")
    out = j.where(F.coalesce(F.col("_op"), F.lit("")) != "D").where(F.col("_in_base") | take_new)
    return out.select(*keys, *merged)


def read_cdc_table(
    spark, base_path: str, keys: Sequence[str], seq_col: str = "seq", op_col: str = "op", fmt: str = "parquet"
) -> DataFrame:
    """Merge-on-read: the latest full snapshot under ``base_path`` with every committed
    change delta after it applied (newest change per key wins)."""
    from ..sources.tables import read_with_deltas

    full, deltas = read_with_deltas(spark, base_path, fmt)
    return full if deltas is None else cdc_apply(full, deltas, keys, seq_col, op_col)
