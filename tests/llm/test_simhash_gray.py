import random
import re

import numpy as np
import pytest
import xxhash

from stratum.llm import simhash_gray
from stratum.llm.simhash_gray import GrayTree, fingerprint_links, simhash_components, text_fingerprint
from stratum.llm.textnp import word_lists
from tests.llm.helpers import DOCUMENTS, awkward_rows, documents


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """(doc_id, fingerprint, smallest reachable doc_id) of every row by comparing all pairs."""
    prints = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for k, (i, _) in zip(label, rows, strict=True):
        if i is not None:
            least[k] = min(least.get(k, i), i)
    return sorted([(i, f"{p:016x}", least.get(k)) for (i, _), p, k in zip(rows, prints, label, strict=True)], key=repr)


def got(df):
    return sorted([(r.doc_id, r.fingerprint, r.component_id) for r in df.collect()], key=repr)


def test_awkward_rows(spark):
    rows = [*[(r[0], r[1]) for r in awkward_rows()], (20, " \t\n"), (21, "Two words"), (22, "two WORDS"), (23, "ÄÖ Ab"), (None, None), (None, "lonely words of nobody")]
    frame = documents(spark, [(i, t, "en", "s", 0) for i, t in rows])
    assert got(simhash_components(frame)) == plain_components(rows)


def test_empty_table(spark):
    assert simhash_components(spark.createDataFrame([], DOCUMENTS)).collect() == []


def test_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = []
    for i in range(160):
        words = list(base) if i % 4 else [f"v{rng.randrange(900)}" for _ in range(60)]
        for _ in range(i % 5):
            words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
        rows.append((1000 - i, " ".join(words)))
    want = plain_components(rows)
    assert len({c for _, _, c in want}) < 120  # some are linked
    assert got(simhash_components(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_sample_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    assert got(simhash_components(frame)) == plain_components(rows)


@pytest.mark.parametrize("limit", [1024, 256, 8])
def test_links_of_dense_fingerprints(spark, monkeypatch, limit):
    """Many fingerprints about few centres: nodes are opened down to the last level."""
    monkeypatch.setattr(simhash_gray, "LIMIT", limit)
    rng = random.Random(limit)
    fps = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        free = rng.sample(range(64), 12)
        fps |= {centre ^ sum(1 << b for b in rng.sample(free, rng.randrange(8))) for _ in range(300)}
    fps |= {rng.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    words = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(words[:i] ^ words[i]) <= 2):
            label[root(i)] = root(int(j))
    want = {}
    for i, f in enumerate(fps):
        want.setdefault(root(i), set()).add(f)
    frame = spark.createDataFrame([(int(x),) for x in words.view(np.int64)], "fp long")
    edges = [(r.a % 2**64, r.b % 2**64) for r in fingerprint_links(frame).collect()]
    assert all((a ^ b) != 0 for a, b in edges)
    place = {f: i for i, f in enumerate(fps)}
    label[:] = range(len(fps))
    for a, b in edges:
        label[root(place[a])] = root(place[b])
    found = {}
    for i, f in enumerate(fps):
        found.setdefault(root(i), set()).add(f)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_tree_finds_all_pairs_of_each_node():
    rng = np.random.default_rng(3)
    sizes = [2, 3, 70, 9, 600]
    rest, starts = [], np.concatenate([[0], np.cumsum(sizes)])[:-1]
    for n in sizes:
        centre = rng.integers(0, 2**32)
        near = centre ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 32, (n, 2)).astype(np.uint64), axis=1).astype(np.int64)
        rest.append(near.astype(np.uint64))
    rest = np.concatenate(rest)
    tree = GrayTree(rest, starts)
    a, b = tree.links(rest, np.arange(len(rest)))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    i, j = np.triu_indices(len(rest), 1)
    near = (owner[i] == owner[j]) & (np.bitwise_count(rest[i] ^ rest[j]) <= 2)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == list(zip(i[near].tolist(), j[near].tolist(), strict=True))


def test_pieces_of_a_long_text():
    words = re.compile(rb"[^\x20\x09-\x0D]+")
    text = "  ".join(f"w{i % 37}" for i in range(4000)) + " " + "z" * 900 + "\n"
    for most in (1, 7, 100, 1 << 18):
        lists = list(word_lists(text.encode(), words, 2, most))
        assert [w for found, old in lists for w in found[old:]] == text.encode().split()
        assert all(found[:old] == before[0][-2:] for before, (found, old) in zip(lists, lists[1:], strict=False))
    assert text_fingerprint((text * 60).encode()) == plain_fingerprint(text * 60)
