"""Language ID by interpolated Kneser-Ney character models in sorted hash arrays.

Text is reduced to lower-case letters and single gaps (all else), each text padded with
gaps. For each language a character model of order ``ORDER`` is counted on a bounded sample
of labelled rows: raw counts at the top order, continuation counts below, one absolute
discount per order. What is stored per order is the union of the languages' n-grams: a
sorted array of 64-bit hashes and a matrix of log probabilities (row: n-gram, column:
language, each already interpolated down to that language's unigrams), and the same for
contexts with their backoff weights. So one lookup serves all languages, and an n-gram that
no language has seen falls back to the next lower order by the backoff weights.

A text's score for a language is its mean cross-entropy per character; the lowest wins.
Calibration on a held part of the sample: a temperature turns the cross-entropies into
``score`` (0 to 1), and each language gets the mean and spread of its own texts'
cross-entropy, per text and per character; a text is rejected if it has no letter or its
lowest cross-entropy is more than ``REJECT_Z`` spreads, and more than a floor, above the mean of
that language. The floor is calibrated by leaving out each held text's own language
(:meth:`Model._calibrate_floor`): texts of a language that was not learned are beyond it, texts
that quote another language are not.

The sample has about ``SAMPLE`` different texts a language, chosen by the hash of the text, and
at most ``SAMPLE_BYTES`` (see :func:`sample_rows`); they are gathered and counted on the driver.
The model (some MB) goes with the tasks. Scoring needs no shuffle and reads whole texts.

Defined cases: a NULL text, or one without a letter, is ``und`` with score 0; equal texts
get equal results; rows with NULL text or label are not learned; with no labelled row at
all every text is ``und``; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratum.llm.common import arrow_map, release_memory, ship_package, table
from stratum.llm.textnp import blocks, mix

ORDER = 5
BLOCK_BYTES = 256 << 10  # texts that are scored at a time
SAMPLE = 600
SAMPLE_BYTES = 24 << 20
HELD_SHARE = 5  # one in so many sample texts calibrates
REJECT_Z = 8.0
REJECT_NATS = 1.5  # where there are too few texts or languages to calibrate it
FLOOR_TEXTS = 40
UNKNOWN = "und"
_STEP = [np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) % 2**64) for j in range(ORDER)]

_LETTER: np.ndarray | None = None
_LOWER: np.ndarray | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter, and its lower case if that is one code point."""
    global _LETTER, _LOWER
    if _LETTER is None:
        letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                letter[c] = True
                low = ch.lower()
                if len(low) == 1:
                    lower[c] = ord(low)
        _LETTER, _LOWER = letter, lower
    return _LETTER, _LOWER


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each reduced to letters and single gaps (0) with
    ``ORDER - 1`` gaps before it; and the n + 1 offsets (pads included)."""
    letter, lower = _tables()
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = sizes.cumsum()
    doc = np.repeat(np.arange(len(texts)), sizes)
    is_letter = letter[raw]
    before = np.zeros(len(raw), bool)
    before[1:] = is_letter[:-1]
    starts = (ends - sizes)[sizes > 0]
    before[starts] = False
    keep = is_letter | before  # a gap only after a letter
    code = np.where(is_letter, lower[raw], 0)[keep].astype(np.uint32)
    doc = doc[keep]
    own = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    offsets = np.concatenate([[0], (own + ORDER - 1).cumsum()])
    out = np.zeros(offsets[-1], np.uint32)
    out[np.arange(len(doc)) + (doc + 1) * (ORDER - 1)] = code
    return out, offsets


@dataclass
class HashTable:
    """Rows of a matrix by sorted 64-bit hashes; the top bits give where to begin."""

    keys: np.ndarray
    rows: np.ndarray

    def __post_init__(self) -> None:
        bits = max(1, min(20, int(np.ceil(np.log2(max(2, len(self.keys)))))))
        self.shift = np.uint64(64 - bits)
        self.begin = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.padded = np.concatenate([self.keys, [np.iinfo(np.uint64).max]])

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Row numbers; -1 where there is none."""
        at = self.begin[(wanted >> self.shift).astype(np.int64)]
        less = self.padded[at] < wanted
        while less.any():
            more = np.flatnonzero(less)
            while len(more):
                at[more] += 1
                more = more[self.padded[at[more]] < wanted[more]]
            break
        return np.where(self.padded[at] == wanted, at, -1)


@dataclass
class Counts:
    """One language: per order sorted hashes, log probabilities, contexts and weights."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: float


def train(texts: list[str]) -> Counts:
    """Interpolated Kneser-Ney probabilities of every n-gram of the texts."""
    code, offsets = letters(texts)
    scored = np.ones(len(code), bool)
    for j in range(ORDER - 1):
        scored[offsets[:-1] + j] = False
    where = np.flatnonzero(scored)
    grams, contexts = [], []
    alphabet = len(np.unique(code[scored])) + 1
    lower_p: dict[str, np.ndarray] = {}
    floor = 0.0
    for n in range(1, ORDER + 1):
        if n == ORDER:
            gram, at, counts = np.unique(gram_hashes_at(code, where, n, True), return_index=True, return_counts=True)
            at = where[at]
        else:  # continuation counts: distinct characters before it, from the distinct n+1-grams
            above = where[np.unique(gram_hashes_at(code, where, n + 1, True), return_index=True)[1]]
            gram, at, counts = np.unique(gram_hashes_at(code, above, n, True), return_index=True, return_counts=True)
            at = above[at]
        context = gram_hashes_at(code, at, n - 1)
        once, twice = int((counts == 1).sum()), int((counts == 2).sum())
        discount = once / (once + 2 * twice) if once else 0.5
        names, inverse, kinds = np.unique(context, return_inverse=True, return_counts=True)
        total = np.bincount(inverse, counts)
        weight = np.maximum(discount * kinds / total, 1e-9)
        if n == 1:
            below = np.full(len(at), 1.0 / alphabet)
            floor = float(np.log(weight[0] / alphabet))
        else:
            lower_hash = gram_hashes_at(code, at, n - 1, from_end=True)
            keys, p = lower_p["keys"], lower_p["p"]
            below = p[np.searchsorted(keys, lower_hash)]
        p = np.maximum(counts - discount, 0) / total[inverse] + weight[inverse] * below
        lower_p = {"keys": gram, "p": p}
        grams.append((gram, np.log(p).astype(np.float32)))
        contexts.append((names, np.log(weight).astype(np.float32)))
    return Counts(grams, contexts, floor)


def gram_hashes_at(code: np.ndarray, at: np.ndarray, n: int, from_end: bool = False) -> np.ndarray:
    """Hashes of ``n`` characters: those before position ``at``, or those that end there."""
    begin = at if from_end else at - 1
    out = np.zeros(len(at), np.uint64)
    for j in range(n):
        out += mix(code[begin - j].astype(np.uint64) + np.uint64(0x51ED270B)) * _STEP[j]
    return mix(out + np.uint64(n))


@dataclass
class Model:
    languages: list[str]
    grams: list[HashTable]
    contexts: list[HashTable]
    floor: np.ndarray
    temperature: float = 1.0
    mean: np.ndarray | None = None
    by_text: np.ndarray | None = None
    by_char: np.ndarray | None = None
    reject_nats: float = REJECT_NATS

    def log_p(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log probability of the character at each position, a column for each language."""
        return self._falling(lambda n, k: gram_hashes_at(code, at[k], n, True), lambda n, k: gram_hashes_at(code, at[k], n - 1), len(at))

    def _falling(self, gram, context, size: int, top: int = ORDER) -> np.ndarray:
        out = np.zeros((size, len(self.languages)), np.float32)
        open_ = np.arange(size)
        for n in range(top, 0, -1):
            row = self.grams[n - 1].find(gram(n, open_))
            hit = row >= 0
            out[open_[hit]] += self.grams[n - 1].rows[row[hit]]
            open_ = open_[~hit]
            if not len(open_):
                return out
            row = self.contexts[n - 1].find(context(n, open_))
            hit = row >= 0
            out[open_[hit]] += self.contexts[n - 1].rows[row[hit]]
        # the context of a unigram is empty and always known; its weight is in the floor
        out[open_] += self.floor - self.contexts[0].rows[0]
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the mean negative log probability under each language, and how many
        characters it has; NaN where it has none."""
        code, offsets = letters(texts)
        size = np.diff(offsets) - (ORDER - 1)
        scored = np.ones(len(code), bool)
        for j in range(ORDER - 1):
            scored[offsets[:-1] + j] = False
        at = np.flatnonzero(scored)
        sums = np.full((len(texts), len(self.languages)), np.nan)
        if len(at):
            base = mix(code.astype(np.uint64) + np.uint64(0x51ED270B))
            # full arrays at the top order, few positions below it
            full = np.zeros(len(code), np.uint64)
            for j in range(ORDER):
                full[j:] += base[: len(code) - j] * _STEP[j]
            full = mix(full + np.uint64(ORDER))
            p = self._falling(
                lambda n, k: full[at] if n == ORDER else gram_hashes_at(code, at[k], n, True),
                lambda n, k: gram_hashes_at(code, at[k], n - 1),
                len(at),
            )
            some = np.flatnonzero(size > 0)
            begin = (offsets[:-1] - np.arange(len(texts)) * (ORDER - 1))[some]
            sums[some] = -np.add.reduceat(p, begin, axis=0, dtype=np.float64) / size[some, None]
        return sums, size

    def calibrate(self, texts: list[str], truth: list[str]) -> None:
        """Temperature, and each language's usual cross-entropy of its own texts."""
        k = len(self.languages)
        self.mean, self.by_text, self.by_char = np.full(k, np.inf), np.zeros(k), np.zeros(k)
        parts = [self.cross_entropies(texts[i : i + 100]) for i in range(0, len(texts), 100)]
        h = np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, k))
        size = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        own = np.array([self.languages.index(x) for x in truth], np.int64)
        use = np.flatnonzero(size > 0)
        if not len(use):
            return
        best = (np.inf, 1.0)
        for t in 2.0 ** np.arange(-2, 8.5, 0.5):
            z = -h[use] * t
            z -= z.max(axis=1, keepdims=True)
            loss = float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(use)), own[use]]).mean())
            best = min(best, (loss, float(t)))
        self.temperature = best[1]
        for j in range(k):
            mine = use[own[use] == j]
            if len(mine) >= 2:
                x, n = h[mine, j], size[mine]
                weight = np.sqrt(n)
                self.mean[j] = float((x * weight).sum() / weight.sum())
                gap = (x - self.mean[j]) ** 2
                # one part of the spread is the text's own, the other shrinks with its length
                self.by_text[j] = float(np.sqrt(np.median(gap[n >= np.median(n)]) * 2.2))
                self.by_char[j] = float(np.sqrt(np.median((gap * n)[n <= np.median(n)]) * 2.2))
        self._calibrate_floor(h[use], own[use])

    def _calibrate_floor(self, h: np.ndarray, own: np.ndarray) -> None:
        """How far above a language's mean a text is foreign, by leaving its own language out:
        half way from what 98 in 100 texts do not exceed under their own language to what nine in
        ten exceed under the nearest other one, and at least a quarter more than the former."""
        rows = np.arange(len(h))
        known = np.isfinite(self.mean)
        if known.sum() < 2 or known[own].sum() < FLOOR_TEXTS:
            return
        rows = rows[known[own]]
        above = np.where(known, h - np.where(known, self.mean, 0.0), np.inf)
        at_home = above[rows, own[rows]]
        abroad = np.where(known, h, np.inf)
        abroad[rows, own[rows]] = np.inf
        away = above[rows, abroad[rows].argmin(axis=1)]
        inside, outside = np.quantile(at_home, 0.98), np.quantile(away, 0.1)
        self.reject_nats = float(max((inside + outside) / 2, 1.25 * inside))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, lowest cross-entropy and rejection of each text."""
        if not self.languages:
            n = len(texts)
            return [UNKNOWN] * n, np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
        h, size = self.cross_entropies(texts)
        some = size > 0
        filled = np.where(some[:, None], h, 0.0)
        best = filled.argmin(axis=1)
        z = -filled * self.temperature
        z -= z.max(axis=1, keepdims=True)
        score = np.where(some, 1 / np.exp(z).sum(axis=1), 0.0)
        lowest = filled[np.arange(len(texts)), best]
        spread = np.sqrt(self.by_text[best] ** 2 + self.by_char[best] ** 2 / np.maximum(size, 1))
        rejected = ~some | (lowest > self.mean[best] + np.maximum(REJECT_Z * spread, self.reject_nats))
        names = [self.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)]
        return names, score, np.where(some, lowest, np.nan), rejected


def merge(counts: dict[str, Counts]) -> Model:
    """One model of all languages: the union of their n-grams, each scored under every one."""
    languages = sorted(counts)
    k = len(languages)
    floor = np.array([counts[x].floor for x in languages], np.float32)

    def union(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(np.concatenate([p[0] for p in parts]))
        rows = np.full((len(keys), k), np.nan, np.float32)
        for j, (own, value) in enumerate(parts):
            rows[np.searchsorted(keys, own), j] = value
        return keys, rows

    grams = [HashTable(*union([counts[x].grams[n] for x in languages])) for n in range(ORDER)]
    contexts = []
    for n in range(ORDER):
        keys, rows = union([counts[x].contexts[n] for x in languages])
        contexts.append(HashTable(keys, np.nan_to_num(rows, nan=0.0)))
    return Model(languages, grams, contexts, floor)


def fill(model: Model, texts: list[str], step: int = 200) -> None:
    """Scores each n-gram under the languages that lack it, lowest order first; the texts
    are those the counts came from, so every n-gram of the union occurs in them."""
    for n in range(1, ORDER + 1):
        for k in range(0, len(texts), step):
            _fill(model, n, *letters(texts[k : k + step]))


def _fill(model: Model, n: int, code: np.ndarray, offsets: np.ndarray) -> None:
    scored = np.ones(len(code), bool)
    for j in range(ORDER - 1):
        scored[offsets[:-1] + j] = False
    where = np.flatnonzero(scored)
    t = model.grams[n - 1]
    found, first = np.unique(gram_hashes_at(code, where, n, True), return_index=True)
    at = where[first]
    row = t.find(found)
    at, row = at[row >= 0], row[row >= 0]
    weight = np.zeros((len(at), len(model.languages)), np.float32)
    hit = model.contexts[n - 1].find(gram_hashes_at(code, at, n - 1))
    weight[hit >= 0] = model.contexts[n - 1].rows[hit[hit >= 0]]
    if n == 1:
        lower = np.broadcast_to(model.floor - weight, weight.shape)
    else:
        lower = model.grams[n - 2].rows[model.grams[n - 2].find(gram_hashes_at(code, at, n - 1, True))]
    own = t.rows[row]
    t.rows[row] = np.where(np.isnan(own), weight + lower, own)


def sample_rows(docs: DataFrame, per_language: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Labelled texts: of each language about ``per_language`` different ones, drawn by the hash of
    the text, so that copies are drawn once and the ids have no say. No more than twice as many
    texts and ``most_bytes`` a language come out, whatever the table holds; a text of over a
    quarter of that is not learned from."""
    size = F.octet_length("text")
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("text").alias("h"), size.alias("bytes"))
    rows = rows.filter(F.col("bytes") <= most_bytes // 4)
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.01).alias("n")).collect()  # a row a language
    if not sizes:
        return rows.select("lang", "text")
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_language / max(1, r["n"])))])
    draw = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) / float(1 << 30)
    once = rows.filter(draw < share[F.col("lang")]).dropDuplicates(["lang", "h"])
    order = Window.partitionBy("lang").orderBy("h")
    bounded = once.withColumns({"place": F.row_number().over(order), "total": F.sum("bytes").over(order)})
    return bounded.filter((F.col("place") <= 2 * per_language) & (F.col("total") <= most_bytes)).select("lang", "text")


def fit(docs: DataFrame, per_language: int = SAMPLE) -> Model:
    """Trains and calibrates on a sample of ``docs(text, lang)``."""
    ship_package(docs.sparkSession)
    rows = sample_rows(docs, per_language).withColumn("held", F.pmod(F.xxhash64("text"), F.lit(HELD_SHARE)) == 0)
    rows = rows.orderBy("lang", "text").toArrow()  # the bounded sample
    lang, text, held = (rows.column(c).to_pylist() for c in ("lang", "text", "held"))
    by: dict[str, list[str]] = {}
    for x, t, h in zip(lang, text, held, strict=True):
        by.setdefault(x, [])
        if not h:
            by[x].append(t)
    for x, t in zip(lang, text, strict=True):
        if not by[x]:
            by[x].append(t)  # nothing but held texts: learn from them
    counts = {x: train(t) for x, t in by.items() if letters(t)[1][-1] > (ORDER - 1) * len(t)}
    if not counts:
        return Model([], [], [], np.zeros(0, np.float32))
    model = merge(counts)
    fill(model, [t for x in counts for t in by[x]])
    pairs = [(x, t) for x, t, h in zip(lang, text, held, strict=True) if h and x in counts]
    pairs = pairs or [(x, t) for x in counts for t in by[x]]
    model.calibrate([t for _, t in pairs], [x for x, _ in pairs])
    del rows, text, by
    release_memory()
    return model


PREDICTION = "lang_pred string, score double, cross_entropy double, rejected boolean"


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of ``docs`` (default: ``doc_id``) with ``PREDICTION``, from ``text``."""
    keep = ["doc_id"] if keep is None else keep
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some MB, bounded by the sample
    columns = list(dict.fromkeys([*keep, "text"]))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", BLOCK_BYTES):
                names, score, lowest, rejected = shared.value.predict(pc.fill_null(part.column("text"), "").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in keep],
                        pa.array(names, pa.string()),
                        pa.array(score, pa.float64()),
                        pa.array(lowest, pa.float64(), from_pandas=True),
                        pa.array(rejected),
                    ],
                    [*keep, *[x.split()[0] for x in PREDICTION.split(", ")]],
                )

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [PREDICTION])
    return arrow_map(docs.select(*columns), run, schema)


def held_out():
    """One document in four, by the CRC-32 of its id's decimal text, is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    model = fit(docs.filter(~held_out()))
    return identify(docs, model).withColumn("held_out", held_out())
