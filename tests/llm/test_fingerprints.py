import contextlib
import hashlib
import io
import re

from pyspark.sql import functions as F

from stratum.llm import common
from stratum.llm.fingerprints import combine, digest, fingerprint_documents, likeness, paragraph_sums
from tests.llm.helpers import DOCUMENTS, documents


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [r[1] or "" for r in order]
    out = []
    for k, text in enumerate(texts):
        after, half = texts[(k + 1) % len(texts)], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out.append((order[k][0], len(text), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_awkward_rows_match_brute_force(spark, monkeypatch):
    from tests.llm.helpers import awkward_rows

    for rows_per_bucket in (2048, 2):  # one range, and many of a few rows
        monkeypatch.setattr("stratum.llm.fingerprints.range_buckets", lambda df, key, n=rows_per_bucket: common.range_buckets(df, key, n))
        got = fingerprint_documents(documents(spark)).collect()
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == brute([(r[0], r[1]) for r in awkward_rows()])
        by_text = {}
        texts = {r[0]: r[1] or "" for r in awkward_rows()}
        for r in got:
            by_text.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert all(len(v) == 1 for v in by_text.values())
        assert len({next(iter(v)) for v in by_text.values()}) == len(by_text)


def test_empty_table_and_single_row(spark):
    assert fingerprint_documents(spark.createDataFrame([], DOCUMENTS)).collect() == []
    (one,) = fingerprint_documents(spark.createDataFrame([(1, "abcdef", "en", "s", 6)], DOCUMENTS)).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1.0


def test_order_insertion_and_deletion(spark):
    texts = {1: "alpha beta.\ngamma delta!\nepsilon", 2: "epsilon\nalpha beta.\ngamma delta!", 3: "alpha beta.\nepsilon", 4: "gamma delta!"}
    df = spark.createDataFrame(list(texts.items()), "id long, body string")
    sums = paragraph_sums(df, ["id"]).select("id", F.struct("exact", "like", "pieces").alias("v"))
    v = {i: sums.filter(F.col("id") == i).select(F.col("v").alias(f"v{i}")) for i in texts}
    row = (
        v[1].crossJoin(v[2]).crossJoin(v[3]).crossJoin(v[4])
        .select(
            digest(F.col("v1")).alias("a"), digest(F.col("v2")).alias("b"),
            digest(combine(F.col("v3"), F.col("v4"))).alias("inserted"),
            digest(combine(F.col("v1"), F.col("v4"), -1)).alias("deleted"), digest(F.col("v3")).alias("c"),
            likeness(F.col("v1"), F.col("v2")).alias("same"),
        ).first()
    )
    assert row.a == row.b == row.inserted and row.deleted == row.c and row.same == 1.0


def test_likeness_follows_the_common_share(spark):
    lines = [f"sentence number {i} says {i * i} things about {i % 7} topics" for i in range(80)]
    rows = [(i, "\n".join(lines[:40] + [x[::-1] for x in lines[40 : 80 - keep]] + lines[80 - keep :])) for i, keep in ((1, 40), (2, 20), (3, 0))]
    df = spark.createDataFrame(rows, "id long, body string")
    sums = paragraph_sums(df, ["id"]).select("id", F.struct("exact", "like", "pieces").alias("v"))
    first = sums.filter("id = 1").select(F.col("v").alias("a"))
    got = {r.id: r.s for r in sums.crossJoin(first).select("id", likeness(F.col("v"), F.col("a")).alias("s")).collect()}
    assert got[1] == 1.0 and abs(got[2] - 0.75) < 0.2 and abs(got[3] - 0.5) < 0.25


def test_sums_make_no_method_near_the_compilers_limit(spark):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        spark.conf.set("spark.sql.adaptive.enabled", False)  # else the plan has no code before it runs
        try:
            fingerprint_documents(documents(spark)).explain("codegen")
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", True)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())]
    assert sizes and max(sizes) < 4000


def test_long_bodies_and_repeated_keys_are_summed(spark):
    """More pieces than a byte counts, some in all lanes alike."""
    bodies = [(1, "same words. " * 1000 + "\n"), (1, "other!\n\nlines"), (2, None), (3, "")]
    df = spark.createDataFrame(bodies, "id long, body string")
    got = {r.id: r for r in paragraph_sums(df, ["id"]).collect()}
    assert set(got) == {1, 3} and got[3].pieces == 0 and set(got[3].like) == {0}
    pieces = ["same words"] + [" same words"] * 999 + [" ", "other", "lines"]
    hashes = spark.createDataFrame([(p,) for p in pieces], "p string").select(F.xxhash64("p", F.lit(0)), F.xxhash64("p", F.lit(1))).collect()
    pair = 1 | 1 << 31
    assert got[1].like == [sum(((r[seed] & (1 << 64) - 1) >> i) & pair for r in hashes) for seed in (0, 1) for i in range(31)]
    pars = ["same words. " * 1000, "", "other!", "", "lines"]
    digests = [hashlib.sha512(p.encode()).hexdigest() for p in pars]
    assert got[1].exact == [sum(int(d[8 * i : 8 * i + 8], 16) for d in digests) % (1 << 32) for i in range(16)] and got[1].pieces == len(pieces)
