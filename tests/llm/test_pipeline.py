import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from stratum.llm import bpe, lang_id, ordinal_quality
from stratum.session import load
from tests.conftest import SF_ORACLE, SF_SMOKE
from tests.llm.helpers import DOCUMENTS, awkward_rows, brute_groups, documents
from tests.llm.test_ngram_join import repeated_rows


def test_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["quality", "language", "near_duplicates", "mixture", "tokens"]


@pytest.fixture(scope="module")
def outputs(spark):
    from stratum.llm.common import materialize

    docs, out = load(spark, SF_ORACLE, "documents"), {}
    for name, stage in cp.STAGES:
        out[name] = (docs, materialize(stage(spark, docs, SF_ORACLE), name))
        docs = out[name][1]
    return out


def test_filters_keep_what_their_models_keep(spark, outputs):
    docs, kept = outputs["quality"]
    assert kept.columns == docs.columns
    model = ordinal_quality.fit(docs, load(spark, SF_ORACLE, "labels"))
    want = {r.doc_id for r in ordinal_quality.grade_documents(docs, model).filter("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want and 700 < len(want) < 1000
    labels = load(spark, SF_ORACLE, "labels").collect()
    good = [r.doc_id in want for r in labels if r.quality == 1 and r.toxic == 0]
    poor = [r.doc_id in want for r in labels if r.quality == 0]
    assert sum(good) / len(good) > 0.9 and sum(poor) / len(poor) < 0.3
    docs, kept = outputs["language"]
    model = lang_id.fit(docs)
    want = {r.doc_id for r in lang_id.identify(docs, model).filter("NOT rejected").collect()}
    assert {r.doc_id for r in kept.collect()} == want and len(want) > 0.98 * docs.count()


def test_one_document_of_each_group_stays(outputs):
    docs, kept = outputs["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {i for i, _ in rows} & {label for label, _ in brute_groups(rows).values()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want) and kept.columns == docs.columns


def test_mixture_and_tokens(outputs):
    docs, kept = outputs["mixture"]
    before, after = {r.doc_id: r for r in docs.collect()}, kept.collect()
    assert all(before[r.doc_id] == r for r in after) and len({r.doc_id for r in after}) == len(after)
    words = sum(len(r.text.split()) for r in after) / sum(len(r.text.split()) for r in before.values())
    assert 0.8 < words < 0.97
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs, encoded = outputs["tokens"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = encoded.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert list(r.ids) == plain.encode_ordinary(texts[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_awkward_rows_and_clashing_columns(spark):
    docs = documents(spark)
    for name, stage in cp.STAGES:
        got = stage(spark, docs, SF_SMOKE)
        rows = got.collect()
        if name == "tokens":
            assert len(rows) == len(awkward_rows())
        else:
            assert got.columns == docs.columns and 0 < len(rows) <= len(awkward_rows())
            assert all(r["kept"] == "not kept" for r in rows)
        if name == "near_duplicates":
            assert sorted((r.doc_id for r in rows), key=repr) == [1, 10, 11, 4, 5, 6, 7, 8, 9]
        empty = spark.createDataFrame([], DOCUMENTS).withColumn("key", F.lit(1))
        assert stage(spark, empty, SF_SMOKE).collect() == []


def test_unlike_texts_of_one_doc_id_stay(spark):
    rows = repeated_rows()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCUMENTS)
    got = sorted((r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, SF_SMOKE).collect())
    assert got == sorted([rows[0], rows[3], rows[5], rows[7]])


def test_near_duplicates_without_ids_go(spark):
    one, two, three = (" ".join(f"{name}{k}" for k in range(80)) for name in ("x", "y", "z"))
    rows = [(None, one), (7, one + " tail"), (None, two), (None, two), (None, two + " tail"), (None, three), (None, None), (None, None), (None, ". !")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCUMENTS)
    got = [(r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, SF_SMOKE).collect()]
    kept = [x for x in got if x[1] not in (two, two + " tail")]
    assert len(got) == len(kept) + 1
    assert sorted(kept, key=repr) == sorted([(7, one + " tail"), (None, three), (None, None), (None, None), (None, ". !")], key=repr)


def test_run(spark):
    rows = cp.run(spark, SF_SMOKE).collect()
    assert 100 < len(rows) <= 200 and len({r.doc_id for r in rows}) == len(rows)
