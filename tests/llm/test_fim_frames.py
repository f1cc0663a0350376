import hashlib

import pandas as pd
import pytest

from stratum.llm.fim_frames import (
    OP12_SQL, Codec, Frames, Rates, draw, fim_digests, op12_fim_frames, output_texts, rebuilt, restored_texts, store_frames, transform_frames,
)
from tests.llm.helpers import DOCUMENTS, awkward_rows, documents, duck_rows, spark_rows

EXTRA = [(30 + i, t, "en", "s", 0) for i, t in enumerate(["has <S> inside", "<P>", "<M", "a<", "<P", "é" * 9000 + "<", "<<" * 3000, "x" * 4096, "y" * 8192, "\U0001f600z" * 5000])]


def plain(doc_id, text, rates=Rates()):
    """form, cuts and output by slicing."""
    text = text or ""
    h = hashlib.sha256(f"{rates.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rates.fim:
        return "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < rates.spm:
        return "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_awkward_rows(spark):
    rows = [*awkward_rows(), *EXTRA, *[(100 + i, f"short text number {i} <", "en", "s", 0) for i in range(60)]]
    want = []
    for r in rows:
        form, a, m, output = plain(r[0], r[1])
        want.append((r[0], len(r[1] or ""), form, a, m, sha(output), sha(r[1])))
    got = [tuple(r) for r in fim_digests(documents(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    frame = pd.DataFrame([r[:2] for r in rows], columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    assert duck_rows(OP12_SQL, documents=frame) == spark_rows(fim_digests(documents(spark, rows)))


def test_texts_and_way_back(spark):
    rows = [*awkward_rows(), *EXTRA]
    for rates in (Rates(), Rates(fim=100, spm=100, seed=9)):
        stored = store_frames(documents(spark, rows))
        done = transform_frames(stored, rates)
        assert sorted(((r.doc_id, r.text) for r in output_texts(done).collect()), key=repr) == sorted(((r[0], plain(r[0], r[1], rates)[3]) for r in rows), key=repr)
        assert sorted(((r.doc_id, r.text) for r in restored_texts(done).collect()), key=repr) == sorted(((r[0], r[1] or "") for r in rows), key=repr)


def test_empty_table_and_sample_table(spark):
    assert fim_digests(spark.createDataFrame([], DOCUMENTS)).collect() == []
    got = op12_fim_frames(spark, "/root/testdata/sf0.001").collect()
    rows = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(rows)
    for r in got:
        form, a, m, output = plain(r.doc_id, rows[r.doc_id])
        assert (r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (form, a, m, sha(output), sha(rows[r.doc_id]))


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 30, 95])
def test_only_cut_frames_are_read(n):
    class Counting(Codec):
        read = 0

        def unpack(self, frame):
            self.read += 1
            return super().unpack(frame)

    codec, text = Counting(), "".join(chr(0x3041 + i % 80) for i in range(n))
    stored = Frames.store(codec, text, 10)
    for a in range(0, n + 1, 3):
        for b in range(a, n + 1, 4):
            codec.read = 0
            part = stored.section(a, b)
            assert codec.read <= (a % 10 != 0) + (b % 10 != 0 and b != n) + 0
            assert "".join(part.stream()) == text[a:b] and len(part) == b - a
            codec.read = 0
            assert "".join(stored.stream(a, b)) == text[a:b]
            assert codec.read == (-(-b // 10) - a // 10 if b > a else 0)


def test_markers_over_frame_borders():
    codec = Codec()
    text = "0123456<P>abc<S>def<M>"
    for units in range(1, 9):
        output = Frames.store(codec, text, units)
        assert output.find(("<P>", "<S>", "<M>", "<X>")) == [7, 13, 19, -1]
        assert "".join(rebuilt(Frames.store(codec, "<S>suf<P>pre<M>mid", units), "spm")) == "premidsuf"


def test_shares():
    forms = [draw(i, 50, False, Rates())[0] for i in range(4000)]
    assert 0.08 < forms.count("plain") / 4000 < 0.12 and 0.15 < forms.count("spm") / 4000 < 0.21
