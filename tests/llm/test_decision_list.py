import collections
import re

import numpy as np
from pyspark.sql import functions as F

from stratum.llm import decision_list as dl
from stratum.session import load
from tests.conftest import SF_ORACLE
from tests.llm.helpers import DOCUMENTS, awkward_rows, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    runs = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = set()
    for i in range(len(words) - 4):
        if runs[tuple(words[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(covered)


def test_statistics_match_brute_force(spark):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    rows += [(20, "a b c d e f a b c d e"), (21, "x x x x x x x"), (22, "a|b <c> \x0b\x0c # ## \n \n\n a|b"), (23, " \n\t\r "), (24, "u v w")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    got = sorted((tuple(r) for r in dl.text_statistics(df).collect()), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=repr)


def test_rules_learn_a_conjunction_and_are_ordered():
    rng = np.random.default_rng(5)
    values = {k: rng.uniform(0, 1, 3000) for k in ("n_words", "symbols_per_word", "repeat_share")}
    bad = (values["symbols_per_word"] > 0.8) | ((values["n_words"] < 0.3) & (values["repeat_share"] > 0.7))
    rules = dl.learn_rules(values, bad, np.arange(3000) % 3 == 0)
    caught = np.zeros(3000, bool)
    for rule in rules:
        caught |= dl.covers(rule, values)
    assert (caught == bad).mean() > 0.98 and max(map(len, rules)) <= dl.MAX_CONDITIONS
    assert dl.learn_rules(values, np.zeros(3000, bool), np.arange(3000) % 3 == 0) == []


def test_conditional_takes_the_first_rule(spark):
    rules = [(dl.Condition("n_words", True, 100.0),), (dl.Condition("n_words", True, 50.0), dl.Condition("n_dup_lines", False, 2.0))]
    df = spark.createDataFrame([(120, 0), (60, 0), (60, 5), (10, 0)], "n_words long, n_dup_lines long")
    assert [r.x for r in df.select(dl.rule_number(rules).alias("x")).collect()] == [1, 2, 0, 0]
    assert " AND ".join(map(str, rules[1])) == "n_words >= 50 AND n_dup_lines < 2"


def test_verdicts_on_labelled_documents(spark):
    statistics = dl.text_statistics(load(spark, SF_ORACLE, "documents"))
    labels = load(spark, SF_ORACLE, "labels")
    judged = dl.judge(statistics, dl.fit_rules(statistics, labels))
    rows = judged.join(labels, "doc_id").filter("NOT base_failed").select("quality", "kept").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.95
    assert judged.filter("base_failed AND kept").count() == 0 and judged.count() == 1000


def test_without_labels_all_that_pass_the_base_stay(spark):
    statistics = dl.text_statistics(documents(spark))
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    rules = dl.fit_rules(statistics, none)
    assert rules == [] and dl.judge(statistics, rules).filter("kept = base_failed").count() == 0
    empty = dl.text_statistics(spark.createDataFrame([], DOCUMENTS))
    assert dl.judge(empty, dl.fit_rules(empty, none)).collect() == []
