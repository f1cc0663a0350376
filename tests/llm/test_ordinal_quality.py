import numpy as np
import pyarrow as pa

from stratum.llm import ordinal_quality as oq
from stratum.session import load
from tests.conftest import SF_ORACLE
from tests.llm.helpers import DOCUMENTS, awkward_rows, documents

SF_LABELS = "/root/testdata/sf0.1"  # the smaller tables have few toxic documents


def synthetic(n=600, seed=2):
    rng = np.random.default_rng(seed)
    common = [f"word{i}" for i in range(200)]
    texts, grades = [], []
    for i in range(n):
        grade = i % 3
        words = list(rng.choice(common, 40))
        if grade < 2:
            words += list(rng.choice([f"bad{k}" for k in range(6)], 2))
        if grade == 0:
            words += list(rng.choice([f"junk{k}" for k in range(6)], 3))
        texts.append(" ".join(rng.permutation(words)))
        grades.append(grade)
    return texts, np.array(grades)


def test_ordered_thresholds_and_held_out_grades():
    texts, grades = synthetic()
    model = oq.fit_ordinal(*oq.feature_sets(pa.array(texts)), grades)
    assert (np.diff(model.thresholds) > 0).all()
    texts, grades = synthetic(seed=9)
    expected, tail = model.predict(*oq.feature_sets(pa.array(texts), model.weights != 0))
    assert np.abs(expected - grades).mean() < 0.25 and ((tail >= 0.5) == (grades == 2)).mean() > 0.95
    p = model.probabilities(np.linspace(-5, 5, 7))
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()


def test_gradient_is_the_slope_of_the_likelihood():
    # one feature, two grades: the fit is plain logistic regression on it
    texts = ["seen other"] * 240 + ["other words"] * 240
    grades = np.array([0] * 200 + [2] * 40 + [0] * 40 + [2] * 200)
    model = oq.fit_ordinal(*oq.feature_sets(pa.array(texts)), grades)
    _, tail = model.predict(*oq.feature_sets(pa.array(["seen other", "other words"])))
    assert abs(tail[0] - 1 / 6) < 0.05 and abs(tail[1] - 5 / 6) < 0.05


def test_labelled_documents(spark):
    docs, labels = load(spark, SF_ORACLE, "documents"), load(spark, SF_ORACLE, "labels")
    rows = oq.grade_documents(docs, oq.fit(docs, labels)).join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    poor = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.9 and np.mean(poor) < 0.3
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in rows)


def test_toxic_documents_that_were_not_learned_go(spark):
    docs, labels = load(spark, SF_LABELS, "documents"), load(spark, SF_LABELS, "labels")
    asked = "doc_id % 5 = 0"
    model = oq.fit(docs, labels.filter(f"NOT {asked}"))
    rows = oq.grade_documents(docs.filter(asked), model).join(labels, "doc_id").collect()
    toxic = [r.kept for r in rows if r.toxic == 1]
    assert len(toxic) > 50 and np.mean(toxic) < 0.12
    assert np.mean([r.kept for r in rows if r.quality == 1 and r.toxic == 0]) > 0.96
    assert np.mean([r.kept for r in rows if r.quality == 0 and r.toxic == 0]) < 0.3


def test_repeated_labels_of_repeated_documents(spark):
    rows = [(i % 40, f"{'vile' if i % 2 else 'fine'} text number {i % 40} of a few") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i % 40, 1, i % 2) for i in range(80)], "doc_id long, quality int, toxic int")
    assert oq.graded_sample(docs, labels).count() == 240  # each of 120 rows with each of its two labels
    got = oq.grade_documents(docs, oq.fit(docs, labels)).collect()
    assert len(got) == 120 and len({(r.doc_id, r.tail_probability) for r in got}) == 40


def test_awkward_rows_and_missing_grades(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1, None), (2, 1, 1), (4, 0, 0), (None, 1, 0), (6, None, 1)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.filter("doc_id = 1"), labels.limit(0)):
        rows = oq.grade_documents(docs, oq.fit(docs, given)).collect()
        assert len(rows) == len(awkward_rows())
        first = {r.doc_id: r for r in rows}
        assert first[1].tail_probability == first[2].tail_probability
    assert all(r.kept for r in rows)
    assert oq.grade_documents(spark.createDataFrame([], DOCUMENTS), oq.fit(docs, labels)).collect() == []


def test_copies_count_once():
    sets = [np.arange(200, dtype=np.int32), np.arange(200, dtype=np.int32), np.arange(1000, 1200, dtype=np.int32)]
    assert oq.one_of_near_copies(sets).tolist() == [True, False, True]


def test_driver_gets_only_the_features_that_tell_grades_apart(spark, monkeypatch):
    texts, grades = synthetic()
    ids = [i // 2 * 7 for i in range(len(texts))] + list(range(10_000, 10_060))  # two texts an id, then copies
    texts, grades = texts + texts[:60], [*grades.tolist(), *grades[:60].tolist()]
    docs = spark.createDataFrame([(i + 100_000 * g, t) for i, g, t in zip(ids, grades, texts, strict=True)], "doc_id long, text string")
    labels = sorted({(i + 100_000 * g, int(g > 1), int(g < 1)) for i, g in zip(ids, grades, strict=True)})
    whole, given = oq.fit_ordinal, []
    monkeypatch.setattr(oq, "fit_ordinal", lambda index, at, grade: given.append(index) or whole(index, at, grade))
    model = oq.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))

    index, at = oq.feature_sets(pa.array(texts))
    sets = [index[a:b] for a, b in zip(at, at[1:], strict=False)]
    order = sorted(range(len(texts)), key=lambda k: (ids[k] + 100_000 * grades[k], sets[k].tolist()))
    alone = oq.one_of_near_copies([sets[k] for k in order])
    kept = [k for k, own in zip(order, alone, strict=True) if own]
    assert len(kept) <= len(texts) - 60
    want = whole(np.concatenate([sets[k] for k in kept]), np.cumsum([0, *[len(sets[k]) for k in kept]]), np.array(grades)[kept])
    assert np.array_equal(model.weights, want.weights) and np.array_equal(model.thresholds, want.thresholds)
    assert len(given) == 1 + oq.FOLDS and (want.weights != 0).any()
    assert max(map(len, given)) < len(index) / 10
