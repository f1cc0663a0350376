"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades: 0 toxic (``toxic`` 1), 1 poor (``quality`` 0), 2 good. Toxic is the lowest, as a few words
tell it and the more of them the worse, while a grade between two others bounds what its words
may weigh together. All grades share one weight per hashed feature; ordered thresholds cut the score into grades:
``P(grade <= j) = sigmoid(threshold_j - score)``. Selection uses the expected grade and the
tail probability of the best grade.

Features of a whole text, each once (present or not), hashed to ``2^BITS`` weights: its
lower-cased words, the first 3, 4 and 5 characters of longer words, its runs of
punctuation, and coarse steps of a few ratios (distinct
words, upper case, symbols, word length).

Fitting: at most about ``SAMPLE`` labelled texts, by the hash of ``doc_id``, with one text of each
set of near copies. Features in fewer than ``LEAST`` texts, or that tell the grades apart too little
(chi-square below ``CHI_SQUARE``), get no weight. The sample's feature numbers are written
once to the shared folder and counted there by Spark; the driver gathers a few minima of each
text for the near copies, and of the features only those that get a weight in one of the fits,
which it makes by full gradients. The selection threshold is the tail
probability that ``CLEAN_RECALL`` of the good texts reach when each is scored by a model that was
fitted without its fold, one of ``FOLDS``, or by the model if that is lower (0.5 without good texts). Scoring needs no shuffle.

Defined cases: a NULL or empty text has only its ratio features; equal texts get equal
scores; labels with NULL ``quality`` are not used and NULL ``toxic`` counts as 0; a document
with several labels is used with each; grades that no label has are skipped; without at
least two grades the model keeps everything (every probability 1); other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratum.llm.common import arrow_map, materialize, release_memory, ship_package, table
from stratum.llm.textnp import BLANK_SEPARATED, WORD_BYTES, blocks, mix, prefix_sums, span_hashes, text_bytes, word_spans

BITS = 18
BLOCK_BYTES = 512 << 10  # texts that are scored at a time
SAMPLE = 12_000
LEAST = 5
CHI_SQUARE = 60.0
ROUNDS = 250
FOLDS = 5
RATE = 0.1
DECAY = 2e-4
CLEAN_RECALL = 0.98
TOP_GRADE = 2
PREFIXES = (3, 4, 5)
MINIMA = 48  # of the hashes of a text's features
BAND = 6
STEP = 1 << 16  # entries that the fit sums at a time
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_PUNCT = BLANK_SEPARATED & ~WORD_BYTES


def token_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature number of every occurrence, in order of the texts per kind."""
    n = len(column)
    raw, offsets = text_bytes(column)
    lower, low_offsets = text_bytes(column, lower=True)
    start, end, doc = word_spans(lower, low_offsets, WORD_BYTES)
    sums = prefix_sums(lower)
    words = span_hashes(lower, start, end, sums)
    docs, found = [doc], [words]
    heads = np.flatnonzero((lower & 0xC0) != 0x80)  # where each character begins
    number = np.searchsorted(heads, start)
    heads = np.concatenate([heads, np.full(max(PREFIXES), len(lower))])
    for k in PREFIXES:
        stop = heads[number + k]
        longer = np.flatnonzero(stop < end)
        docs.append(doc[longer])
        found.append(mix(span_hashes(lower, start[longer], stop[longer], sums) + np.uint64(k)))
    p_start, p_end, p_doc = word_spans(lower, low_offsets, _PUNCT)
    docs.append(p_doc)
    found.append(mix(span_hashes(lower, p_start, p_end, sums) ^ np.uint64(0x70)))
    n_words = np.bincount(doc, minlength=n)
    size = np.maximum(np.diff(offsets), 1)
    upper = np.concatenate([[0], np.cumsum(_UPPER[raw])])
    n_upper = upper[offsets[1:]] - upper[offsets[:-1]]
    chars = np.bincount(doc, end - start, n)
    punct = np.bincount(p_doc, p_end - p_start, n)
    at = np.searchsorted(doc, np.arange(n + 1))
    distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(at, at[1:], strict=False)], np.int64)
    some = np.maximum(n_words, 1)
    steps = [
        np.minimum(np.log2(n_words + 1), 10).astype(np.int64),
        # repeated words, beyond what a text of this length repeats anyway
        (10 * distinct / some).astype(np.int64) * 16 + np.minimum(np.log2(n_words + 1), 12).astype(np.int64),
        np.minimum(20 * n_upper / size, 12).astype(np.int64),
        np.minimum(10 * punct / some, 20).astype(np.int64),
        np.minimum(chars / some, 16).astype(np.int64),
    ]
    for k, step in enumerate(steps):
        docs.append(np.arange(n))
        found.append(mix(step.astype(np.uint64) + np.uint64(1000 * (k + 1))))
    return np.concatenate(docs), (np.concatenate(found) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def feature_sets(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct feature numbers of each text, one after the other, and the n + 1
    offsets; only the ``wanted`` features (a flag for each number) if given."""
    doc, index = token_features(column)
    if wanted is not None:
        use = wanted[index]
        doc, index = doc[use], index[use]
    both = np.unique((doc << BITS) | index)
    at = np.searchsorted(both, np.arange(len(column) + 1, dtype=np.int64) << BITS)
    return (both & ((1 << BITS) - 1)).astype(np.int32), at.astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _sums(into: np.ndarray, value: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """``np.bincount(into, value[of], n)`` without arrays of that length between."""
    out = np.zeros(n)
    for i in range(0, len(into), STEP):
        np.add.at(out, into[i : i + STEP].astype(np.intp), value[of[i : i + STEP]])
    return out


@dataclass
class OrdinalModel:
    """``grades`` in order, one threshold between each two, one weight a feature."""

    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray
    keep_from: float = 0.0

    def scores(self, index: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[index], dtype=np.float64)])
        return sums[at[1:]] - sums[at[:-1]]

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade) for each grade of ``grades``."""
        below = _sigmoid(self.thresholds[None, :] - score[:, None])
        edges = np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], axis=1)
        return np.diff(edges, axis=1)

    def predict(self, index: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and the probability of ``TOP_GRADE`` or more."""
        n = len(at) - 1
        if len(self.grades) < 2:
            return np.full(n, float(self.grades[0] if self.grades else TOP_GRADE)), np.ones(n)
        p = self.probabilities(self.scores(index, at))
        grades = np.array(self.grades, float)
        return p @ grades, p[:, grades >= TOP_GRADE].sum(axis=1)


def telling(by_grade: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The features (columns) in enough texts that tell the grades (rows) apart; ``counts``: the
    texts of each grade."""
    often = by_grade.sum(axis=0)
    expected = often * (counts / counts.sum())[:, None]
    chi = ((by_grade - expected) ** 2 / np.maximum(expected, 1e-9)).sum(axis=0) / np.maximum(1 - often / counts.sum(), 1e-9)
    return (often >= LEAST) & (chi >= CHI_SQUARE)


def fit_ordinal(index: np.ndarray, at: np.ndarray, grade: np.ndarray) -> OrdinalModel:
    """Penalised maximum likelihood by Adam on full gradients; rare grades are weighted up
    to half the weight of the most frequent one."""
    grades = sorted(set(grade.tolist()))
    size = 1 << BITS
    if len(grades) < 2:
        return OrdinalModel(grades, np.zeros(size, np.float32), np.zeros(0))
    level = np.searchsorted(grades, grade)
    counts = np.bincount(level)
    row_weight = np.maximum(1.0, 0.5 * counts.max() / counts)[level]
    row_weight /= row_weight.sum()
    doc = np.repeat(np.arange(len(grade), dtype=np.int32), np.diff(at))
    by_grade = np.zeros((len(grades), size), np.int64)
    for i in range(0, len(doc), STEP):
        np.add.at(by_grade.ravel(), level[doc[i : i + STEP]] * size + index[i : i + STEP], 1)
    # features that are rare, or that tell the grades apart too little, have no weight
    known = telling(by_grade, counts)
    kept, number = np.flatnonzero(known), (np.cumsum(known) - 1).astype(np.int32)
    use = known[index]
    doc, column = doc[use], number[index[use]]
    share = np.cumsum(counts)[:-1] / counts.sum()
    first = np.log(share / (1 - share))
    # thresholds: the first one free, the others by positive steps
    theta = np.concatenate([np.zeros(len(kept)), [first[0]], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    k = len(kept)
    rows = np.arange(len(grade))
    for t in range(1, ROUNDS + 1):
        cuts = np.concatenate([[theta[k]], theta[k] + np.cumsum(np.exp(theta[k + 1 :]))])
        score = _sums(doc, theta, column, len(grade))
        below = _sigmoid(cuts[None, :] - score[:, None])
        edges = np.concatenate([np.zeros((len(grade), 1)), below, np.ones((len(grade), 1))], axis=1)
        slope = edges * (1 - edges)
        p = np.maximum(edges[rows, level + 1] - edges[rows, level], 1e-9)
        d_score = row_weight * (slope[rows, level + 1] - slope[rows, level]) / p
        d_cuts = np.zeros(len(cuts))
        for j in range(len(cuts)):
            upper, lower_ = level == j, level == j + 1
            d_cuts[j] = -(row_weight[upper] * slope[upper, j + 1] / p[upper]).sum() + (row_weight[lower_] * slope[lower_, j + 1] / p[lower_]).sum()
        grad = np.empty_like(theta)
        grad[:k] = _sums(column, d_score, doc, k) + DECAY * theta[:k]
        grad[k] = d_cuts.sum()
        tails = np.cumsum(d_cuts[::-1])[::-1]
        grad[k + 1 :] = tails[1:] * np.exp(theta[k + 1 :])
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        theta -= RATE * (1 - t / (ROUNDS + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(size, np.float32)
    weights[kept] = theta[:k]
    return OrdinalModel(grades, weights, np.concatenate([[theta[k]], theta[k] + np.cumsum(np.exp(theta[k + 1 :]))]))


def minima(index: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``MINIMA`` minima of hashes of each set, a row for each; all -1 for an empty set."""
    least = np.full((len(at) - 1, MINIMA), -1, np.int64)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        every = index.astype(np.uint64)
        for k in range(MINIMA):
            least[some, k] = np.minimum.reduceat(mix(every ^ np.uint64(0xC0FFEE * (k + 1))), at[some]).view(np.int64)
    return least


def first_of_near_copies(least: np.ndarray) -> np.ndarray:
    """False for a row of ``minima`` of which ``BAND`` in a row are those of an earlier one."""
    out = np.ones(len(least), bool)
    seen: set[tuple[int, bytes]] = set()
    for i, own in enumerate(least):
        names = {(k, own[k : k + BAND].tobytes()) for k in range(0, MINIMA, BAND)}
        out[i] = not (names & seen)
        seen |= names
    return out


def one_of_near_copies(sets: list[np.ndarray]) -> np.ndarray:
    """False for a set that shares six minima of hashes in a row with an earlier one."""
    at = np.cumsum([0, *[len(own) for own in sets]])
    return first_of_near_copies(minima(np.concatenate([np.zeros(0, np.int32), *sets]), at))


def graded_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, text, grade`` of about ``sample`` labelled rows at most, by the hash of
    ``doc_id``."""
    grades = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select(
        "doc_id",
        F.when(F.coalesce("toxic", F.lit(0)) > 0, 0).when(F.col("quality") <= 0, 1).otherwise(TOP_GRADE).alias("grade"),
    )
    n = grades.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(n, 1)))
    return docs.select("doc_id", "text").filter(draw).join(grades.filter(draw), "doc_id")


def sample_features(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, grade, place, fold, f, least`` of the graded sample: the feature numbers of each
    text and their ``minima``; ``place`` numbers the rows of a document with one grade."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", BLOCK_BYTES):
                index, at = feature_sets(part.column("text"))
                fold = mix(part.column("doc_id").to_numpy().astype(np.uint64) + np.uint64(77)) % np.uint64(FOLDS)
                every = np.arange(part.num_rows + 1, dtype=np.int32)
                columns = [
                    part.column("doc_id"),
                    part.column("grade"),
                    pa.array(fold.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(index)),
                    pa.ListArray.from_arrays(pa.array(every * MINIMA), pa.array(minima(index, at).ravel())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "grade", "fold", "f", "least"])

    rows = graded_sample(docs, labels, sample).select("doc_id", "text", "grade")
    rows = arrow_map(rows, run, "doc_id long, grade int, fold int, f array<int>, least array<long>")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "grade").orderBy("f")))


def telling_features(rows: DataFrame, counts: np.ndarray) -> np.ndarray:
    """The features of ``rows`` that :func:`telling` finds in all of them or in those of all folds
    but one; ``counts``: the texts of each fold (row) and grade (column)."""
    cell = F.col("fold") * counts.shape[1] + F.col("grade")
    cells = F.array(*[F.count_if(F.col("cell") == k) for k in range(counts.size)])
    seen = rows.select(F.explode("f").alias("feature"), cell.alias("cell")).groupBy("feature").agg(cells.alias("seen"))
    subsets = [np.ones(len(counts), bool), *(np.arange(len(counts)) != k for k in range(len(counts)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_fold = batch.column("seen").flatten().to_numpy().reshape(-1, *counts.shape)
            use = np.zeros(len(by_fold), bool)
            for own in subsets:
                if counts[own].any():
                    use |= telling(np.ascontiguousarray(by_fold[:, own].sum(axis=1).T), counts[own].sum(axis=0))
            yield pa.RecordBatch.from_arrays([batch.column("feature").filter(pa.array(use))], ["feature"])

    return arrow_map(seen, run, "feature int").toArrow().column("feature").to_numpy()


def only_features(rows: DataFrame, wanted: np.ndarray) -> DataFrame:
    """``rows`` with the ``wanted`` ones of their feature numbers ``f``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(1 << BITS, bool)
        known[wanted] = True
        for batch in batches:
            f = batch.column("f")
            index, size = f.flatten().to_numpy(), f.value_lengths().to_numpy()
            use = known[index]
            at = np.concatenate([[0], use.cumsum()])[np.concatenate([[0], size.cumsum()])]
            own = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(index[use]))
            yield batch.set_column(batch.schema.get_field_index("f"), "f", own)

    return arrow_map(rows, run, rows.schema)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    rows = materialize(sample_features(docs, labels, sample), "features")
    key = ["doc_id", "grade", "place"]

    def gathered(df: DataFrame) -> pa.Table:
        return df.toArrow().sort_by([(c, "ascending") for c in key]).combine_chunks()

    texts = gathered(rows.select(*key, "fold", "least"))
    grade, fold = (texts.column(c).to_numpy().astype(np.int64) for c in ("grade", "fold"))
    alone = first_of_near_copies(pc.list_flatten(texts.column("least")).to_numpy().reshape(-1, MINIMA))
    counts = np.zeros((FOLDS, TOP_GRADE + 1), np.int64)
    np.add.at(counts, (fold[alone], grade[alone]), 1)
    copies = docs.sparkSession.createDataFrame(texts.select(key).filter(pa.array(~alone)))
    wanted = telling_features(rows.join(F.broadcast(copies), key, "left_anti"), counts)
    sets = gathered(only_features(rows.select(*key, "f"), wanted)).column("f")
    index, size = pc.list_flatten(sets).to_numpy(), pc.list_value_length(sets).to_numpy()

    def pick(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return index[np.repeat(which, size)], np.concatenate([[0], np.cumsum(size[which])]).astype(np.int64)

    model, good = fit_ordinal(*pick(alone), grade[alone]), grade >= TOP_GRADE
    if len(model.grades) >= 2:
        tails = [0.5] if not good.any() else []
        for k in range(FOLDS):
            asked, rest = good & (fold == k), alone & (fold != k)
            if asked.any():
                without = fit_ordinal(*pick(rest), grade[rest])
                own = without if without.grades == model.grades else model  # a fold may hold all of a grade
                tails.extend(own.predict(*pick(asked))[1].tolist())
        ends = [tails, model.predict(*pick(good))[1]] if good.any() else [tails]  # few labels: the folds' scale may be another
        model.keep_from = float(min(np.quantile(x, 1 - CLEAN_RECALL) for x in ends)) - 1e-9
    del texts, sets, index
    release_memory()
    return model


SCORES = "expected_grade double, tail_probability double, kept boolean"


def grade_documents(docs: DataFrame, model: OrdinalModel, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of ``docs`` (default: ``doc_id``) with ``SCORES``, from ``text``."""
    keep = ["doc_id"] if keep is None else keep
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in blocks(batch, "text", BLOCK_BYTES):
                expected, tail = own.predict(*feature_sets(part.column("text"), own.weights != 0))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], pa.array(expected), pa.array(tail), pa.array(tail >= own.keep_from)],
                    [*keep, *[x.split()[0] for x in SCORES.split(", ")]],
                )

    columns = list(dict.fromkeys([*keep, "text"]))
    return arrow_map(docs.select(*columns), run, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [SCORES]))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return grade_documents(docs, fit(docs, table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])))
