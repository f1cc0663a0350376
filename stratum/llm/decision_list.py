"""Quality rules: learned decision lists over word statistics.

Statistics of every whole text (words: ``[^\\x20\\x09-\\x0D]+``) are joined with the labels;
on a bounded sample of labelled rows sequential covering learns rules for the bad class.
A rule is grown on two thirds of the sample, one threshold at a time, by FOIL's information
gain; it is pruned on the last third by dropping final conditions while (p - n) / (p + n)
does not fall; it enters the list if it is at least ``PRECISION`` right there, and the rows
it covers are taken out. The list becomes one ordered Spark conditional expression, which
is applied to all rows; the rules can be read as text.

Statistics need no shuffle; the labels are joined to numbers, never to texts. The sample is
taken by the hash of ``doc_id``, about ``SAMPLE`` labels at most, seven numbers each, and is
fitted on the driver.

Repeated five-word windows are found by 64-bit hashes of the words within a text.

Defined cases: a NULL text has no word (all statistics 0, ``base_failed``); rows that repeat
a ``doc_id`` are judged one by one, and each label counts once per such row; labels that are
NULL are not used; without labels, or with labels of one class only, the list is empty and
every row that passes the base is kept; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.common import arrow_map, materialize, table
from stratum.llm.textnp import BLANK_SEPARATED, blocks, span_hashes, text_bytes, windows, word_spans

SAMPLE = 20_000
PRECISION = 0.9
MAX_RULES, MAX_CONDITIONS, CUTS = 16, 4, 64
WINDOW = 5
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_BLANKS = " \t\n\x0b\x0c\r"
STATISTICS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"

#: What conditions are about, as Spark expressions over the statistics.
FEATURES = {
    "n_words": "double(n_words)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "n_dup_lines": "double(n_dup_lines)",
    "dup_lines_per_word": "n_dup_lines / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}


def _dup_lines(text: str | None) -> int:
    if not text or "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.strip(_BLANKS)]
    return len(lines) - len(set(lines))


def text_statistics(docs: DataFrame) -> DataFrame:
    """``STATISTICS`` of each row ``doc_id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                raw, offsets = text_bytes(part.column("text"))
                start, end, doc = word_spans(raw, offsets, BLANK_SEPARATED)
                n = part.num_rows
                n_words = np.bincount(doc, minlength=n)
                points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                word_chars = np.bincount(doc, points[end] - points[start], n).astype(np.int64)
                symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[raw])])
                words = span_hashes(raw, start, end)
                runs = windows(words, WINDOW)
                first = np.concatenate([[0], n_words.cumsum()])
                repeats = np.zeros(n, np.int64)
                for i in np.flatnonzero(n_words > WINDOW):
                    own = runs[first[i] : first[i + 1] - WINDOW + 1]
                    order = np.argsort(own)
                    ranked = own[order]
                    same = ranked[1:] == ranked[:-1]
                    if same.any():
                        twice = np.zeros(len(own), bool)
                        twice[order[1:][same]] = True
                        twice[order[:-1][same]] = True
                        edge = np.zeros(n_words[i] + 1, np.int64)
                        at = np.flatnonzero(twice)
                        edge[at] += 1
                        edge[at + WINDOW] -= 1
                        repeats[i] = (edge.cumsum() > 0).sum()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(n_words.astype(np.int64)),
                        pa.array(word_chars),
                        pa.array((symbols[offsets[1:]] - symbols[offsets[:-1]]).astype(np.int64)),
                        pa.array([_dup_lines(x) for x in part.column("text").to_pylist()], pa.int64()),
                        pa.array(repeats),
                    ],
                    [x.split()[0] for x in STATISTICS.split(", ")],
                )

    return arrow_map(docs.select("doc_id", "text"), run, STATISTICS)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.feature] >= self.cut if self.above else values[self.feature] < self.cut

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value >= F.lit(self.cut) if self.above else value < F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, values: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(values.values()))), bool)
    for c in rule:
        out &= c.holds(values)
    return out


def _grow(values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Adds the condition of the highest information gain until no good row is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS:
        p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
        if not n0 or not p0:
            break
        best, gain = None, 0.0
        base = np.log2(p0 / (p0 + n0))
        for feature, column in values.items():
            own, wrong = column[inside], bad[inside]
            levels = np.unique(own)
            if len(levels) < 2:
                continue
            cuts = np.unique((levels[1:] + levels[:-1]) / 2)
            if len(cuts) > CUTS:  # quantiles of the bad rows and of all rows
                share = np.linspace(0, 1, CUTS // 2)
                cuts = np.unique(np.concatenate([np.quantile(own[wrong], share), np.quantile(own, share)]))
            for cut in cuts.tolist():
                over = own >= cut
                for above in (True, False):
                    in_ = over if above else ~over
                    p, n = int((wrong & in_).sum()), int((~wrong & in_).sum())
                    if p and (value := p * (np.log2(p / (p + n)) - base)) > gain + 1e-9:
                        best, gain = Condition(feature, above, float(cut)), value
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(values)
    return tuple(rule)


def _prune(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        inside = covers(r, values)
        p, n = int((bad & inside).sum()), int((~bad & inside).sum())
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for size in range(len(rule) - 1, 0, -1):
        if worth(rule[:size]) >= worth(best):
            best = rule[:size]
    return best


def learn_rules(values: dict[str, np.ndarray], bad: np.ndarray, for_pruning: np.ndarray) -> list[Rule]:
    """An ordered list of rules for the bad rows."""
    rules: list[Rule] = []
    values = dict(values)
    while len(rules) < MAX_RULES and bad.any() and not bad.all():
        grow, prune = ~for_pruning, for_pruning
        if not bad[grow].any():
            break
        rule = _grow({k: v[grow] for k, v in values.items()}, bad[grow])
        if not rule:
            break
        rule = _prune(rule, {k: v[prune] for k, v in values.items()}, bad[prune])
        inside = covers(rule, values)
        p, n = int((bad & inside & prune).sum()), int((~bad & inside & prune).sum())
        if p < 1 or p < PRECISION * (p + n) or (bad & inside).sum() < PRECISION * inside.sum():
            break
        rules.append(rule)
        values = {k: v[~inside] for k, v in values.items()}
        bad, for_pruning = bad[~inside], for_pruning[~inside]
    return rules


def rule_number(rules: list[Rule]) -> Column:
    """The first rule, from 1, that covers a row; 0 if none does: an ordered conditional."""
    out: Column | None = None
    for k, rule in enumerate(rules, 1):
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        out = F.when(holds, k) if out is None else out.when(holds, k)
    return F.lit(0) if out is None else out.otherwise(0)


def base_failed() -> Column:
    """Under ten words, or more than a fifth of the words in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def fit_rules(statistics: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from labelled rows that pass the base (the others are rejected without them)."""
    labels = labels.filter("quality IS NOT NULL").select("doc_id", "quality")
    share = min(1.0, sample / max(labels.count(), 1))
    labels = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * share))
    rows = (
        statistics.filter(~base_failed())
        .join(labels, "doc_id")
        .select(F.xxhash64("doc_id").alias("h"), "quality", *[F.expr(e).alias(k) for k, e in FEATURES.items()])
        .orderBy("h", "quality", *FEATURES)
        .toPandas()
    )
    if rows.empty:
        return []
    values = {k: rows[k].to_numpy(float) for k in FEATURES}
    return learn_rules(values, rows["quality"].to_numpy() <= 0, rows["h"].to_numpy() % 3 == 0)


def judge(statistics: DataFrame, rules: list[Rule]) -> DataFrame:
    """The statistics with ``base_failed``, ``rule`` and ``kept``."""
    return (
        statistics.withColumn("base_failed", base_failed())
        .withColumn("rule", rule_number(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # read twice, for the sample and for the verdicts; the texts only once
    statistics = materialize(text_statistics(table(spark, sf_dir, "documents", ["doc_id", "text"])), "statistics")
    rules = fit_rules(statistics, table(spark, sf_dir, "labels", ["doc_id", "quality"]))
    return judge(statistics, rules)
