import random

import numpy as np

from stratum.llm import ngram_join
from stratum.llm.components import connected_components
from stratum.llm.ngram_join import jaccard_groups, least_matches, linked, star_labels, surviving_pairs
from tests.llm.helpers import DOCUMENTS, awkward_rows, brute_groups, documents


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCUMENTS)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_groups(df).collect()}
    assert got == {rows[i][0]: x for i, x in brute_groups(rows).items()}


def corpus(seed, families, copies, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
                text[rng.randrange(words)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    return rows


def test_links_and_groups_match_all_pairs(spark):
    check(spark, corpus(1, 25, 6))


def test_large_groups_are_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    check(spark, corpus(2, 2, 40))


def test_awkward_rows(spark):
    got = jaccard_groups(documents(spark)).collect()
    assert len(got) == len(awkward_rows())
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert [by_id[i][0].class_id for i in (1, 2, 3)] == [1, 1, 1] and by_id[1][0].copy_id == by_id[2][0].copy_id == 1
    assert by_id[3][0].copy_id == 3 and by_id[3][0].n_links == 2 and by_id[3][0].n_text_links == 1
    assert (by_id[4][0].class_id, by_id[4][0].n_links) == (4, 0) and (by_id[5][0].class_id, by_id[5][0].n_links) == (5, 0)
    assert len(by_id[9]) == 2 and {(r.class_id, r.n_links) for r in by_id[9]} == {(9, 1)}
    assert [(r.class_id, r.copy_id, r.n_links) for r in by_id[None]] == [(10, 10, 1)] == [(r.class_id, r.copy_id, r.n_links) for r in by_id[10]]


def test_blocks_are_cut_by_size(spark, monkeypatch):
    # beginnings of one text, each four words longer: all are connected, few pairs can be linked
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(360)]
    rows = [(k, " ".join(words[: 40 + 4 * k])) for k in range(80)]
    seen = []
    deal = ngram_join.deal_by_size
    monkeypatch.setattr(ngram_join, "BLOCK", 6)
    monkeypatch.setattr(ngram_join, "deal_by_size", lambda members, threshold: seen.append((members.count(), deal(members, threshold))) or seen[-1][1])
    check(spark, rows)
    n, dealt = seen[0]
    assert n == 80 and dealt.select("rep", "p", "q").distinct().count() == dealt.count() < 80 * (80 / 6) * 0.6


def test_rows_without_ids_are_compared(spark):
    one, two, three = (" ".join(f"{name}{k}" for k in range(80)) for name in ("x", "y", "z"))
    rows = [(None, one), (7, one + " tail"), (None, one), (None, two), (None, two + " tail"), (None, two + " tail"), (None, three), (None, None), (3, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCUMENTS)
    got = sorted(((r.doc_id, r.class_id, r.copy_id, r.n_links, r.n_text_links) for r in jaccard_groups(df).collect()), key=repr)
    want = [(7, 7, 7, 2, 1), (None, 7, None, 2, 1), (None, 7, None, 2, 1), (None, None, None, 2, 1), (None, None, None, 2, 1), (None, None, None, 2, 1)]
    want += [(None, None, None, 0, 0), (None, None, None, 0, 0), (3, 3, 3, 0, 0)]
    assert got == sorted(want, key=repr)


def repeated_rows():
    one, two = (" ".join(f"{name}{k}" for k in range(80)) for name in ("x", "y"))
    return [(9, one), (9, one), (12, one + " tail"), (9, two), (15, two + " tail"), (12, "alone"), (20, "first " + one), (20, "lone")]


def test_rows_that_repeat_a_doc_id(spark):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in repeated_rows()], DOCUMENTS)
    got = sorted((r.doc_id, r.class_id, r.copy_id, r.n_links, r.n_text_links) for r in jaccard_groups(df).collect())
    # two groups of smallest doc_id 9: rows 9, 9, 12 and 20 of one text, 9 and 15 of the other
    want = [(9, 9, 9, 3, 2)] * 2 + [(9, 9, 9, 1, 1), (12, 9, 12, 3, 2), (12, 12, 12, 0, 0), (15, 9, 15, 1, 1), (20, 9, 20, 3, 2), (20, 20, 20, 0, 0)]
    assert got == sorted(want)


def test_empty_table(spark):
    assert jaccard_groups(spark.createDataFrame([], DOCUMENTS)).collect() == []


def test_pairs_whose_members_hash_to_the_same_40_bits(spark):
    from pyspark.sql import functions as F

    hashed = spark.range(4000).select(F.xxhash64("id").bitwiseAND(F.lit(2**40 - 1)).alias("h")).toPandas()["h"].to_numpy()
    i, j = np.triu_indices(len(hashed), 1)
    sums = hashed[i] + hashed[j]
    order = np.argsort(sums)
    same = np.flatnonzero(np.diff(sums[order]) == 0)[0]
    (a, b), (c, d) = ((int(i[k]), int(j[k])) for k in order[same : same + 2])
    assert len({a, b, c, d}) == 4
    one, two = ([f"{name}{k}" for k in range(80)] for name in ("x", "y"))
    check(spark, [(a, " ".join(one)), (b, " ".join([*one, "tail"])), (c, " ".join(two)), (d, " ".join([*two, "tail"]))])


def test_pruning_drops_unlike_pairs_and_keeps_like_ones():
    least = least_matches()
    assert list(least) == sorted(least) and all(least[n] <= n for n in least)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**16, ngram_join.VALUES, dtype=np.uint16)
    like, unlike = base.copy(), base.copy()
    like[rng.permutation(ngram_join.VALUES)[:22]] += 1  # about 0.8
    unlike[rng.permutation(ngram_join.VALUES)[:80]] += 1  # about 0.3
    i, j = surviving_pairs(np.stack([base, like, unlike]), np.array([0, 0, 1]), np.array([1, 2, 2]), least)
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 1)]


def test_exact_links_and_labels():
    sets = [np.arange(0, 10, dtype=np.uint64), np.arange(1, 11, dtype=np.uint64), np.arange(2, 12, dtype=np.uint64)]
    i, j = np.triu_indices(3, 1)
    assert linked(sets, i, j, 0.8).tolist() == [True, False, True]  # 9/11, 8/12, 9/11
    assert star_labels(5, np.array([3, 1]), np.array([4, 3])).tolist() == [0, 1, 2, 1, 1]


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7), (101, 100)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
