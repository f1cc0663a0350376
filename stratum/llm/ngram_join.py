"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification.

Two texts are linked when the Jaccard similarity of their sets of five-word shingles is at
least ``threshold`` (words: lower-cased runs of letters, digits, ``_`` and non-ASCII).

1. Each text gets its shingle set's fingerprint and ``VALUES`` 16-bit MinHash values. Texts
   of equal sets (exact copies among them) are one class under a key of its own; one text of
   its smallest ``doc_id`` goes on.
2. Classes that agree in all ``ROWS`` values of a band meet in a bucket. A pair of
   similarity 0.8 shares none of the 28 bands with probability 4e-7. Buckets of one member
   are dropped by counting, buckets of the same members (two 64-bit hashes) are kept once.
3. A bucket is dealt out by pairs of blocks of ``BLOCK`` members, so that no task gets more
   than two blocks of a hot bucket. For each pair the MinHash values are compared ``STEP``
   at a time, and the pair is dropped as soon as the posterior probability that its
   similarity reaches the threshold (uniform prior) is below ``TOLERANCE``. Survivors are
   summed up as a star to the smallest member of each connected part, one row a member.
4. The connected parts are gathered; each is again dealt out by pairs of blocks. A part of
   more than one block is cut by size first: sets of similarity 0.8 differ in size by a
   factor of 1.25 at most, so only blocks of the same or the next size bin meet. The pairs
   are pruned as before, on the MinHash values alone, and only classes that have a pair left
   get their texts, for those pairs of blocks: there the rest is verified exactly on the
   shingle sets. A class gets its number of links; verified links are again summed up as
   stars, whose connected components are the groups.

No pairs leave a task, nothing is collected, no key's rows meet in one task, and each
intermediate table is written to the shared folder. Classes of more than a thousandth of the
rows (fewer than 1,000) are broadcast to their rows.

Defined cases: a text without words (NULL, empty) has no shingle and no link and is a
class and a group of its own; one to four words are one shingle; rows with a NULL ``doc_id``
are compared and counted like others but name no class: the ids of a class or group are
NULL if all of its rows have none; rows that repeat a ``doc_id`` with the same words are
copies of one another, those with other words are classes of their own, which may have the
same smallest ``doc_id``; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.common import arrow_map, materialize, salted_join, shuffle_partitions, table
from stratum.llm.components import connected_components
from stratum.llm.textnp import blocks, mix, shingle_sets

K = 5
THRESHOLD = 0.8
BANDS, ROWS = 28, 4
VALUES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
BLOCK = 256
_A = np.random.default_rng(7).integers(0, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(8).integers(0, 2**63, VALUES, dtype=np.uint64)

#: A text has a word, and so a shingle, if this matches.
HAS_WORD = r"[0-9A-Za-z_]|[^\x00-\x7F]"

SKETCH = "doc_id long, text_hash long, n_shingles int, f1 long, f2 long, bands array<long>"


def sketches(docs: DataFrame) -> DataFrame:
    """``SKETCH`` of every row: the set's fingerprint and its MinHash values, four in a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                sets, at = shingle_sets(part.column("text"), K)
                size = np.diff(at)
                some = np.flatnonzero(size)
                sums = np.zeros((2, part.num_rows), np.uint64)
                values = np.zeros((len(some), VALUES), np.uint16)
                if len(some):
                    begin = at[:-1][some]
                    sums[0, some] = np.add.reduceat(sets, begin)
                    sums[1, some] = np.add.reduceat(mix(sets ^ np.uint64(0xA5A5A5A5DEADBEEF)), begin)
                    for k in range(VALUES):
                        values[:, k] = mix(np.minimum.reduceat(sets * _A[k] + _B[k], begin)) >> np.uint64(48)
                bands = values.view(np.int64).ravel()
                ends = np.zeros(part.num_rows + 1, np.int32)
                ends[1:] = np.cumsum(np.where(size > 0, BANDS, 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text_hash"),
                        pa.array(size.astype(np.int32)),
                        pa.array(sums[0].view(np.int64)),
                        pa.array(sums[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(bands)),
                    ],
                    ["doc_id", "text_hash", "n_shingles", "f1", "f2", "bands"],
                )

    return arrow_map(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), run, SKETCH)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After n compared values: how many must match for the posterior probability of a
    similarity of at least ``threshold`` to be ``tolerance`` or more. With a uniform prior
    it is P(Binomial(n + 1, threshold) <= matches)."""
    out = {}
    for n in [*range(STEP, VALUES, STEP), VALUES]:
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def surviving_pairs(values: np.ndarray, left: np.ndarray, right: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of ``values`` that incremental comparison does not drop."""
    matches, begin = np.zeros(len(left), np.int32), 0
    for n, need in least.items():
        step = values[:, begin:n]
        matches += (step[left] == step[right]).sum(axis=1, dtype=np.int32)
        stay = matches >= need
        if not stay.all():
            left, right, matches = left[stay], right[stay], matches[stay]
        begin = n
    return left, right


def star_labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index that each of n rows is connected to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that end where a group of the sorted ``keys`` ends."""
    waiting: list[pa.RecordBatch] = []

    def codes(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys], axis=1)

    for batch in batches:
        if not batch.num_rows:
            continue
        own = codes(batch)
        changes = np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1
        if waiting and (own[0] != codes(waiting[-1].slice(waiting[-1].num_rows - 1))[0]).any():
            yield pa.Table.from_batches(waiting).combine_chunks()
            waiting = []
        if len(changes):
            last = int(changes[-1])
            yield pa.Table.from_batches([*waiting, batch.slice(0, last)]).combine_chunks()
            waiting = [batch.slice(last)]
        else:
            waiting.append(batch)
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def group_limits(t: pa.Table, keys: list[str]) -> list[int]:
    own = np.stack([t.column(k).to_numpy() for k in keys], axis=1)
    return [0, *(np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1).tolist(), t.num_rows]


def block_pairs(own: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one pair of blocks: all pairs within a block, or across two."""
    if p == q:
        return np.triu_indices(len(own), 1)
    a, b = np.flatnonzero(own == p), np.flatnonzero(own == q)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def minhash_matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat).view(np.uint16).reshape(-1, VALUES)


def deal_blocks(members: DataFrame, key: str, n: str) -> DataFrame:
    """Each member once for every pair of blocks that its block is in; ``p <= q`` name the
    pair and ``own`` the member's block. Sorted by group within a partition."""
    count = F.ceil(F.col(n) / BLOCK).cast("int")
    dealt = (
        members.withColumn("own", F.pmod(F.xxhash64("rep", F.lit(key)), count).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
        .withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")})
        .drop("other", n)
    )
    return _by_pair_of_blocks(dealt, key)


def _by_pair_of_blocks(dealt: DataFrame, key: str) -> DataFrame:
    return dealt.repartition(shuffle_partitions(dealt.sparkSession), key, "p", "q").sortWithinPartitions(key, "p", "q", "rep")


def _candidates(t: pa.Table, keys: list[str], least: dict[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs that are left in the pairs of blocks of ``t``; small ones are
    compared together."""
    own, p, q = (t.column(c).to_numpy() for c in ("own", "p", "q"))
    values = minhash_matrix(t.column("bands"))
    limits = group_limits(t, keys)
    lefts, rights, size = [], [], 0
    for k, (a, b) in enumerate(zip(limits, limits[1:], strict=False)):
        i, j = block_pairs(own[a:b], p[a], q[a])
        lefts.append(i + a), rights.append(j + a)
        size += len(i)
        if size >= 100_000 or k == len(limits) - 2:
            i, j = surviving_pairs(values, np.concatenate(lefts), np.concatenate(rights), least)
            lefts, rights, size = [], [], 0
            if len(i):
                yield i, j


def _prune(least: dict[int, int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["key", "p", "q"]):
            rep = t.column("rep").to_numpy()
            for i, j in _candidates(t, ["key", "p", "q"], least):
                label = star_labels(len(rep), i, j)
                use = np.flatnonzero(label != np.arange(len(rep)))
                yield pa.RecordBatch.from_arrays([pa.array(rep[use]), pa.array(rep[label[use]])], ["a", "b"])

    return run


def _with_pairs(least: dict[int, int]) -> Callable:
    """The rows that have a pair left in their pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["comp", "p", "q"]):
            left = np.zeros(t.num_rows, bool)
            for i, j in _candidates(t, ["comp", "p", "q"], least):
                left[i] = left[j] = True
            yield from t.filter(pa.array(left)).to_batches()

    return run


def deal_by_size(members: DataFrame, threshold: float) -> DataFrame:
    """``comp, p, q, own`` and the columns of ``members`` (``comp, rep, n_shingles``, others):
    a member once for every pair of blocks it is to be compared in. Sorted like
    :func:`deal_blocks`; no two sets that may reach the threshold miss each other."""
    width = max(-math.log(threshold) * (1 + 1e-6), 0.05)  # a little wider: bins differ by one at most
    size_bin = F.floor(F.log("n_shingles") / width).cast("int")
    sizes = members.groupBy("comp", size_bin.alias("bin")).agg(F.count("*").alias("size"))
    sizes = sizes.groupBy("comp").agg(F.sum("size").alias("total"), F.collect_list(F.struct("bin", "size")).alias("bins"))  # a row a bin
    one = F.array(F.struct(F.lit(0).alias("bin"), F.col("total").alias("size")))
    sizes = sizes.select("comp", "total", F.map_from_entries(F.when(F.col("total") > BLOCK, F.col("bins")).otherwise(one)).alias("sizes"))

    def count(of_bin: Column) -> Column:
        return F.ceil(F.coalesce(F.try_element_at("sizes", of_bin), F.lit(0)) / BLOCK)

    def name(of_bin: Column, block: Column) -> Column:
        return F.shiftleft(of_bin.cast("long"), 40) + block

    def names(of_bin: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0).cast("long"), count(of_bin) - 1), lambda block: name(of_bin, block))
        return F.when(count(of_bin) > 0, every).otherwise(F.array().cast("array<long>"))

    at = F.col("bin")
    dealt = (
        salted_join(members, sizes, ["comp"], "rep")
        .withColumn("bin", F.when(F.col("total") > BLOCK, size_bin).otherwise(0))
        .withColumn("own", name(at, F.pmod(F.xxhash64("rep", F.lit("comp")), count(at))))
        .withColumn("other", F.explode(F.concat(names(at - 1), names(at), names(at + 1))))
        .withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")})
        .drop("other", "total", "sizes", "bin")
    )
    return _by_pair_of_blocks(dealt, "comp")


def linked(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs reach the threshold: exact intersections, by products of 0/1
    matrices over the shingles that more than one set has, a slice of them at a time."""
    size = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    use = shared[column]
    row, column = row[use], number[column[use]]
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 8192
    for begin in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [begin, begin + width])
        cells = np.zeros((len(sets), width), np.float32)
        cells[row[a:b], column[a:b] - begin] = 1
        common += cells @ cells.T
    both = common[i, j].astype(np.int64)
    return both >= threshold * (size[i] + size[j] - both) - 1e-9


def _verify(least: dict[int, int], threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["comp", "p", "q"]):
            rep, own, p, q, n = (t.column(c).to_numpy() for c in ("rep", "own", "p", "q", "n"))
            values, texts = minhash_matrix(t.column("bands")), t.column("shingles").combine_chunks()
            limits = group_limits(t, ["comp", "p", "q"])
            out = []
            for a, b in zip(limits, limits[1:], strict=False):
                i, j = block_pairs(own[a:b], p[a], q[a])
                i, j = surviving_pairs(values[a:b], i, j, least)
                if not len(i):
                    continue
                sets = [np.frombuffer(texts[x].as_buffer(), np.uint64) for x in range(a, b)]
                yes = linked(sets, i, j, threshold)
                i, j = i[yes], j[yes]
                if not len(i):
                    continue
                label = star_labels(b - a, i, j)
                links = np.bincount(i, minlength=b - a) + np.bincount(j, minlength=b - a)
                copies = np.bincount(i, n[a:b][j], b - a) + np.bincount(j, n[a:b][i], b - a)
                use = np.flatnonzero(links)
                out.append((rep[a:b][use], rep[a:b][label[use]], links[use], copies[use].astype(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], ["a", "b", "links", "copies"]
                )

    return run


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["rep", "n", "bands", "cells"]
    for batch in batches:
        for part in blocks(batch, "text"):
            sets, at = shingle_sets(part.column("text"), K)
            shingles = pa.array([sets[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], shingles], [*names, "shingles"])


def jaccard_groups(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``; ``class_id``, the smallest ``doc_id`` of its
    group (the documents that links connect); ``copy_id``, the smallest of equal shingle
    sets; ``n_links``, the other documents it is linked to; ``n_text_links``, those of other
    shingle sets counted once a set."""
    return row_groups(docs, threshold, tolerance).drop("text_hash", "group_key")


def row_groups(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """:func:`jaccard_groups` with each row's ``text_hash`` and the ``group_key`` of its group,
    which differs between groups even where they have the same smallest ``doc_id``; NULL
    without words."""
    least = least_matches(threshold, tolerance)
    sketch = materialize(sketches(docs), "sketches")
    classes = materialize(
        sketch.filter("n_shingles > 0")
        .groupBy("f1", "f2")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("least"),
            F.count("*").alias("n"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
        )
        .select(F.monotonically_increasing_id().alias("rep"), "f1", "f2", "least.doc_id", "least.text_hash", "n", "n_shingles", "bands"),
        "classes",
    )
    members = classes.select("rep", F.posexplode("bands").alias("band", "key")).select("rep", F.xxhash64("band", "key").alias("key"))
    other = F.xxhash64(F.lit(1), "rep")  # summed in halves, which no count of members overflows
    buckets = (
        members.groupBy("key")
        .agg(
            F.count("*").alias("n"),
            F.bit_xor(F.xxhash64("rep")).alias("who"),
            F.sum(F.shiftright(other, 32)).alias("high"),
            F.sum(other.bitwiseAND(F.lit(2**32 - 1))).alias("low"),
        )
        .filter("n > 1")
        .groupBy("n", "who", "high", "low")
        .agg(F.min("key").alias("key"))
        .select("key", "n")
    )
    candidates = salted_join(members, buckets, ["key"], "rep").join(classes.select("rep", "bands"), "rep")
    stars = arrow_map(deal_blocks(candidates, "key", "n"), _prune(least), "a long, b long")
    parts = connected_components(stars).select(F.col("node").alias("rep"), F.col("label").alias("comp"))
    parts = materialize(parts.join(classes.drop("f1", "f2"), "rep"), "parts")
    dealt = deal_by_size(parts, threshold).select("comp", "p", "q", "own", "rep", "n", "doc_id", "text_hash", "bands")
    left = materialize(
        arrow_map(
            dealt,
            _with_pairs(least),
            "comp long, p long, q long, own long, rep long, n long, doc_id long, text_hash long, bands array<long>",
        ),
        "left",
    )
    wanted = left.groupBy("rep", F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_hash"), "n").agg(
        F.first("bands").alias("bands"), F.collect_list(F.struct("comp", "p", "q", "own")).alias("cells")
    )
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    texts = texts.filter("doc_id IS NOT NULL").unionAll(texts.filter("doc_id IS NULL").dropDuplicates(["text_hash"]))
    same = F.col("of_doc").eqNullSafe(F.col("doc_id")) & (F.col("of_hash") == F.col("text_hash"))
    once = wanted.join(texts, same).dropDuplicates(["of_doc", "of_hash", "rep"])
    cells = "array<struct<comp:long,p:long,q:long,own:long>>"
    shingled = arrow_map(
        once.select("rep", "n", "bands", "cells", "text"), _shingled, f"rep long, n long, bands array<long>, cells {cells}, shingles binary"
    )
    shingled = shingled.select("rep", "n", "bands", "shingles", F.explode("cells").alias("cell")).select("cell.*", "rep", "n", "bands", "shingles")
    found = materialize(
        arrow_map(_by_pair_of_blocks(shingled, "comp"), _verify(least, threshold), "a long, b long, links long, copies long"), "links"
    )
    groups = connected_components(found.select("a", "b")).withColumnsRenamed({"node": "rep", "label": "group"})
    groups = materialize(groups.join(classes.select("rep", "doc_id"), "rep"), "groups")
    groups = salted_join(groups.drop("doc_id"), groups.groupBy("group").agg(F.min("doc_id").alias("group_doc")), ["group"], "rep")
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"), F.sum("copies").alias("copies"))
    known = classes.select("f1", "f2", "rep", F.col("doc_id").alias("copy"), "n").join(links.join(groups, "rep"), "rep", "left")
    known = materialize(
        known.select(
            "f1",
            "f2",
            (F.col("n") * 1000 > sketch.count()).alias("often"),  # fewer than 1,000 classes
            F.coalesce("group_doc", "copy").alias("class_id"),
            F.col("copy").alias("copy_id"),
            (F.col("n") - 1 + F.coalesce("copies", F.lit(0))).cast("bigint").alias("n_links"),
            F.coalesce("links", F.lit(0)).cast("bigint").alias("n_text_links"),
            F.coalesce("group", "rep").alias("group_key"),
        ),
        "known",
    )
    rows = sketch.select("doc_id", "text_hash", "f1", "f2", "n_shingles")
    worded = rows.filter("n_shingles > 0")
    often = F.broadcast(known.filter("often"))
    rest = worded.join(often.select("f1", "f2"), ["f1", "f2"], "left_anti").join(known.filter("NOT often"), ["f1", "f2"])
    names = ["doc_id", "class_id", "copy_id", "n_links", "n_text_links", "text_hash", "group_key"]
    alone = rows.filter("n_shingles = 0").withColumns({"class_id": F.col("doc_id"), "copy_id": F.col("doc_id")})
    alone = alone.withColumns({"n_links": F.lit(0).cast("bigint"), "n_text_links": F.lit(0).cast("bigint"), "group_key": F.lit(None).cast("bigint")})
    return worded.join(often, ["f1", "f2"]).select(*names).unionAll(rest.select(*names)).unionAll(alone.select(*names))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents", ["doc_id", "text"]))
