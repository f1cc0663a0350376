"""The corpus pipeline: from ``documents`` to token ids, in five stages.

1. ``quality``: documents that the ordinal quality classifier rejects go.
2. ``language``: documents that language ID rejects go.
3. ``near_duplicates``: one document of each near-duplicate group stays, the smallest ``doc_id``
   (where none has a ``doc_id``, one of the smallest text hash).
4. ``mixture``: each leaf of the domain - language - source tree keeps the token prefix that its
   budget allows, in one epoch, so that no document comes twice.
5. ``tokens``: byte-level BPE ids of every document that is left, and a decoding check.

A stage takes (spark, docs, sf_dir) and sees all that the one before it kept; all but the
last return the columns of their input, extra ones included, whatever they are called.
``run`` writes each stage's result to the shared folder as Parquet and reads it again, so a
lost executor costs no more than one stage.

Defined cases: a document with a NULL or empty text has no letter, so stage 2 drops it if
stage 1 has not; documents with a NULL ``doc_id`` are compared in stage 3 like others, and
stage 4 takes or leaves them together; documents without a word are near duplicates of none; of rows
that repeat a ``doc_id`` in one group stage 3 keeps one, and those of unlike texts stay; an
empty table stays empty; without labels stage 1 keeps everything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import bpe, lang_id, mixture, ngram_join, ordinal_quality
from stratum.llm.common import arrow_map, materialize, ship_package, table
from stratum.llm.textnp import blocks
from stratum.session import load

#: Nearly all tokens: what the target weights leave over is little.
MIX = mixture.Mix(budget_percent=90, max_epochs=1)


def _filter_rows(docs: DataFrame, stays: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """The rows whose ``text`` passes, with their columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", 256 << 10):
                yield part.filter(stays(part.column("text")))

    return arrow_map(docs, run, docs.schema)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    ship_package(spark)
    model = spark.sparkContext.broadcast(ordinal_quality.fit(docs.select("doc_id", "text"), labels))

    def stays(text: pa.Array) -> pa.Array:
        own = model.value
        tail = own.predict(*ordinal_quality.feature_sets(text, own.weights != 0))[1]
        return pa.array(tail >= own.keep_from)

    return _filter_rows(docs, stays)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    model = spark.sparkContext.broadcast(lang_id.fit(docs.select("doc_id", "text", "lang")))

    def stays(text: pa.Array) -> pa.Array:
        return pa.array(~model.value.predict(pc.fill_null(text, "").to_pylist())[3])

    return _filter_rows(docs, stays)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = ngram_join.row_groups(docs.select("doc_id", "text"))
    wordless = F.when(F.col("group_key").isNull(), F.col("text_hash")).alias("wordless")
    first = groups.filter("doc_id <=> class_id").groupBy("doc_id", "group_key", wordless)
    first = first.agg(F.count("*").alias("rows"), F.min("text_hash").alias("text_hash"))
    first = first.select(F.col("doc_id").alias("taken_id"), F.col("text_hash").alias("taken_hash"), "rows", "wordless")
    first = materialize(first, "first")
    same = (F.col("doc_id") == F.col("taken_id")) & (F.col("text_hash") == F.col("taken_hash"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", F.xxhash64("text").alias("text_hash"))
    once = rows.join(first.filter("rows = 1"), same, "left_semi").select("row.*")
    repeated = rows.join(first.filter("rows > 1"), same, "left_semi").dropDuplicates(["doc_id", "text_hash"]).select("row.*")
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(ngram_join.HAS_WORD)
    unnamed = rows.filter("doc_id IS NULL")
    taken = first.filter("taken_id IS NULL AND wordless IS NULL").select(F.col("taken_hash").alias("text_hash"))
    least = unnamed.filter(worded).select("row", "text_hash").dropDuplicates(["text_hash"]).join(taken, "text_hash", "left_semi").select("row.*")
    alone = unnamed.filter(~worded).select("row.*")
    return once.unionByName(repeated).unionByName(least).unionByName(alone)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sized = materialize(mixture.sized_documents(docs), "sized")
    taken = mixture.select_mixture(sized, MIX).select(F.col("doc_id").alias("taken_id")).distinct()
    return docs.join(taken, docs["doc_id"].eqNullSafe(taken["taken_id"]), "left_semi")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids``."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(docs, path, public_tokenizers.PATTERN, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("mixture", mix_sources),
    ("tokens", tokens),
]

#: SQL expresses neither the fitted models nor the tokenizer; the stages are tested against
#: brute-force versions instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
