import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from stratum.llm import importance
from stratum.llm.importance import bracket, draw, numbered, op13_importance_resampling, resample
from tests.llm.helpers import DOCUMENTS, awkward_rows, documents


def features(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain(rows, target, min_words=20, percent=5, seed=42):
    """Every row's features, weight, score and rank by one sort."""
    own = [features(t) for _, t in rows]
    s, t = [0] * 10000, [0] * 10000
    for _, f in own:
        for b in f:
            s[b] += 1
    for text in target:
        for b in features(text)[1]:
            t[b] += 1
    s_all, t_all = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    out = []
    for (i, _), (n, f) in zip(rows, own, strict=True):
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[3], -r[2]))
    for place, r in enumerate(able[: len(able) * percent // 100], 1):
        r[5] = place
    return sorted(map(tuple, out), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("percent", [5, 50, 100])
def test_awkward_rows(spark, percent):
    rng = random.Random(percent)
    more = [(100 + i, " ".join(rng.choice(["Quick", "brown", "fox", "river", "été", "42", "x-y"]) for _ in range(rng.randrange(60)))) for i in range(150)]
    rows = [*[(r[0], r[1]) for r in awkward_rows()], *more, more[3], more[3], (None, more[5][1]), (None, more[5][1])]
    target = ["The quick brown fox", None, "", "river river bank été"]
    frame = documents(spark, [(i, t, "en", "s", 0) for i, t in rows])
    towards = spark.createDataFrame([(t, "x") for t in target], "text string, doc_id string")
    assert got(resample(frame, towards, percent=percent)) == plain(rows, target, percent=percent)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCUMENTS)
    some = documents(spark)
    assert resample(none, some).collect() == [] and resample(none, none).collect() == []
    assert got(resample(some, none, min_words=0, percent=30)) == plain([(r[0], r[1]) for r in awkward_rows()], [], 0, 30)


def test_sample_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert got(op13_importance_resampling(spark, folder)) == plain(rows, target)


def test_long_text_in_pieces():
    text = " ".join(f"w{i % 91}" for i in range(120_000)).encode()
    pieces = list(importance.text_buckets(text, 10000))
    assert len(pieces) > 1
    n, want = features(text.decode())
    assert sum(p[0] for p in pieces) == n
    assert sorted(x for p in pieces for x in p[1].tolist()) == sorted(want)


def scored(spark, scores):
    return spark.createDataFrame([(i, 30, 3, s, s) for i, s in enumerate(scores)], importance.SCORED)


@pytest.mark.parametrize("reach", [2.0, 1e-4, 0.0001])
@pytest.mark.parametrize("accuracy", [10_000, 3])
def test_bracket_holds_the_cutoff(spark, reach, accuracy):
    """A coarse sketch or a bracket that is too narrow is found out by the counts and widened."""
    rng = random.Random(4)
    scores = [rng.randrange(500) for _ in range(3000)] + [7] * 1000
    rows = scored(spark, scores).cache()
    falling = sorted(scores, reverse=True)
    for wanted in (1, 2, 200, 3500, 3999, 4000):
        low, high, above = bracket(rows, len(scores), wanted, accuracy, reach)
        assert above == (0 if high is None else sum(s > high for s in scores))
        assert above < wanted
        assert low is None or low <= falling[wanted - 1]
        assert high is None or falling[wanted - 1] <= high


def test_ranges_are_numbered_as_one_order(spark, monkeypatch):
    monkeypatch.setattr(importance, "RANGE_ROWS", 16)
    rng = random.Random(8)
    rows = scored(spark, [rng.randrange(200) for _ in range(900)] + [50] * 300)
    places = [(r.place, -r.score, r.doc_id) for r in numbered(rows, "place").collect()]
    places.sort()
    assert [p[0] for p in places] == list(range(1, 1201))
    assert [p[1:] for p in places] == sorted(p[1:] for p in places)
    drawn = draw(rows, percent=50).filter(F.col("rank").isNotNull()).collect()
    assert sorted((r.rank, r.doc_id) for r in drawn) == [(p[0], p[2]) for p in places[:600]]
