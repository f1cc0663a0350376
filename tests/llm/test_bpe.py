import hashlib

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from stratum.llm import bpe
from tests.llm.helpers import DOCUMENTS, awkward_rows, documents

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.BytePairCodec(RANKS, public_tokenizers.PATTERN)


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aeinstr the'ün<|endoftext|>\n 0", max_size=200)))
def test_same_ids_as_the_library_and_back(text):
    ids = CODEC.encode(text)
    assert ids.tolist() == REFERENCE.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_matches_of_every_width():
    for text in ("a" * 255, "a" * 256, "ab" * 200, "é" * 500, " " * 999, "ing" * 700, "x", "", "<|endoftext|>"):
        ids = CODEC.encode(text)
        assert ids.tolist() == REFERENCE.encode_ordinary(text) and CODEC.decode(ids) == text.encode()


def test_every_code_point_is_split_as_the_library_does():
    points = [x for x in range(0x110000) if not 0xD800 <= x < 0xE000]
    for k in range(0, len(points), 4096):
        text = "".join(f"a{chr(x)} {chr(x)}1{chr(x)}." for x in points[k : k + 4096])
        assert CODEC.encode(text).tolist() == REFERENCE.encode_ordinary(text), hex(points[k])
        CODEC.young, CODEC.old = {}, {}


def test_the_cache_turns_over(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 8)
    codec = bpe.BytePairCodec(RANKS, public_tokenizers.PATTERN)
    for text in ["one two three four five six", "seven eight nine ten", "one two eleven twelve"] * 2:
        assert codec.encode(text).tolist() == REFERENCE.encode_ordinary(text)


def test_tables(spark):
    def want(text):
        ids = REFERENCE.encode_ordinary(text or "")
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    encoded = bpe.encode_documents(documents(spark), PATH, public_tokenizers.PATTERN, with_ids=True)
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encoded.collect()), key=repr)
    assert got == sorted(((r[0], *want(r[1])) for r in awkward_rows()), key=repr)
    back = bpe.decode_documents(encoded, PATH, public_tokenizers.PATTERN).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=repr) == sorted(((r[0], r[1] or "") for r in awkward_rows()), key=repr)
    assert bpe.encode_documents(spark.createDataFrame([], DOCUMENTS), PATH, public_tokenizers.PATTERN).collect() == []
