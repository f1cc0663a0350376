"""Importance resampling towards a target distribution.

Features are the runs of one to ``RUN`` neighbouring words of a text (A-Z lower-cased, words
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``), repeats counted; a feature's bucket is its CRC-32
modulo ``BUCKETS``. The raw and the target texts' features are counted by bucket, each task
in one array, and a bucket's gain is its log ratio target against raw, in thousandths. A
text's weight is the sum of its features' gains, its score the weight plus Gumbel noise from
the SHA-256 of its ``doc_id``: the highest scores are a sample without replacement in
proportion to the weights.

The draw does not sort the scores. A quantile sketch of the scores gives a bracket about the
cutoff's rank; an exact count of the scores above the bracket and in it shows whether the
cutoff is inside, else the bracket is widened. Only the bracket is put in order, to find the
last drawn row; all that come before it are drawn. The ranks of the drawn rows are their
place in a range of scores plus the number of rows in the ranges before.

Texts are read twice (counts, weights) and never shuffled; the driver sees the ``BUCKETS``
counts, the sketch's quantiles and the cutoff row. Scores are written to the shared folder, some
integers a row.

Defined cases: a NULL text has no words; a text with fewer than ``min_words`` words is weighed
and never drawn; a NULL ``doc_id`` is hashed as the empty name and comes last among equal
scores; rows that repeat a ``doc_id`` are weighed and drawn one by one, rows alike in score and
``doc_id`` in the order of weight and number of features; an empty target gives every
bucket a count of one over ``BUCKETS``, an empty table no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratum.llm.common import arrow_map, materialize, range_buckets, table
from stratum.llm.textnp import blocks, word_lists

RUN = 3
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 5
SEED = 42
#: The sketch's rank error is one in so many rows; the first bracket reaches two errors to each side.
ACCURACY = 10_000
#: Rows of a range of scores when rows are numbered.
RANGE_ROWS = 1024

_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def text_buckets(text: bytes, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Number of new words and buckets of the features that end in them, piece by piece."""
    for words, old in word_lists(text.lower(), _WORDS, RUN - 1):
        tails = [b" " + w for w in words]
        sums = list(map(crc32, words))
        found = [sums[old:]]
        for k in range(1, RUN):  # a longer run's CRC goes on from that of the run without its last word
            sums = list(map(crc32, tails[k:], sums))
            found.append(sums[max(0, old - k) :])
        total = sum(map(len, found))
        yield len(words) - old, np.fromiter(chain.from_iterable(found), np.int64, total) % buckets


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for part in blocks(batch, "text"):
            yield part, pc.fill_null(part.column("text"), "").cast(pa.large_binary()).to_pylist()


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features by bucket over all rows of ``texts(text)``: one array a task, then one sum a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for _, own in _texts(batches):
            for text in own:
                for _, found in text_buckets(text, buckets):
                    counts += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["bucket", "n"])

    found = arrow_map(texts.select("text"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for row in found.collect():  # at most ``buckets``
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares, rounded down."""
    size, s_all, t_all = len(raw), float(raw.sum() + len(raw)), float(target.sum() + len(raw))
    return np.array(
        [math.floor(1000 * math.log(float(target[i] + 1) * s_all / (float(raw[i] + 1) * t_all))) for i in range(size)], np.int64
    )


def gumbel(doc_id: int | None, seed: int) -> int:
    """Thousandths of standard Gumbel noise from the document's name, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(docs: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """``SCORED`` of every row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches):
            ids = part.column("doc_id").to_pylist()
            out = np.zeros((4, len(ids)), np.int64)
            for i, text in enumerate(texts):
                for words, found in text_buckets(text, len(gains)):
                    out[:3, i] += (words, len(found), gains[found].sum())
                out[3, i] = out[2, i] + gumbel(ids[i], seed)
            names = [c.split()[0] for c in SCORED.split(", ")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, out)], names)

    return arrow_map(docs.select("doc_id", "text"), run, SCORED)


def _order() -> list[Column]:
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()]


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with their place (1, 2, ...) in the order of the draw. Each range of scores is
    numbered by itself; the ranges' sizes (at most 65,536) give where it begins."""
    ranged = rows.withColumn("falling", -F.col("score"))
    ranged = ranged.withColumn("range", range_buckets(ranged, "falling", RANGE_ROWS)).drop("falling")
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begin = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*_order()))
    return ranged.withColumn("within", place).join(F.broadcast(begin), "range").withColumn(name, F.col("begin") + F.col("within")).drop("range", "begin", "within")


def bracket(rows: DataFrame, total: int, wanted: int, accuracy: int = ACCURACY, reach: float = 2.0) -> tuple[int | None, int | None, int]:
    """Lowest and highest score (NULL: no limit) between which the ``wanted``-th of ``total``
    rows in falling order lies, and the number of rows above the highest."""
    share = reach / accuracy
    while True:
        middle = 1 - wanted / total
        limits = [middle - share, middle + share]
        inside = [q for q in limits if 0 < q < 1]
        found = rows.agg(F.percentile_approx("score", inside, accuracy).alias("q")).first()["q"] if inside else []
        found = dict(zip(inside, found, strict=True))
        low, high = (found.get(q) for q in limits)
        over = F.lit(False) if high is None else F.col("score") > F.lit(high)
        under = F.lit(False) if low is None else F.col("score") < F.lit(low)
        counts = rows.agg(F.count_if(over).alias("above"), F.count_if(under).alias("below")).first()
        if counts["above"] < wanted <= total - counts["below"]:
            return low, high, counts["above"]
        share *= 4


def draw(scored: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``scored`` with the ``rank`` of those that are drawn."""
    able = scored.filter(F.col("n_words") >= min_words)
    total = able.count()
    wanted = total * percent // 100
    undrawn = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return scored.select("*", undrawn)
    low, high, above = bracket(able, total, wanted)
    between = able
    if low is not None:
        between = between.filter(F.col("score") >= F.lit(low))
    if high is not None:
        between = between.filter(F.col("score") <= F.lit(high))
    last = numbered(between, "place").filter(F.col("place") == wanted - above).first()
    before = (F.col("score") > last["score"]) | (
        (F.col("score") == last["score"]) & (F.lit(True) if last["doc_id"] is None else F.coalesce(F.col("doc_id") <= last["doc_id"], F.lit(False)))
    )
    taken = (F.col("n_words") >= min_words) & before
    ranks = numbered(scored.filter(taken), "place")
    ranks = ranks.withColumn("rank", F.when(F.col("place") <= wanted, F.col("place")).cast("long")).drop("place")
    return ranks.unionByName(scored.filter(~taken).select("*", undrawn))


def resample(docs: DataFrame, target: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of ``docs(doc_id,
    text)``, drawn towards the texts of ``target(text)``."""
    gains = bucket_gains(bucket_counts(docs), bucket_counts(target))
    return draw(materialize(score_documents(docs, gains, seed), "scored"), min_words, percent)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    drawn = resample(docs, table(spark, sf_dir, "benchmark", ["text"]))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank", "n_words")
