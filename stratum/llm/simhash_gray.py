"""SimHash near-duplicates by a hierarchical index in Gray order.

A text (A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``) has the shingles of three
neighbouring words, repeats included; a text of one or two words has one shingle of all. A bit of
its fingerprint is 1 if more than half of the XXH64 (seed 42) of its shingles have it. Two
fingerprints are linked if they differ in ``DISTANCE`` bits or fewer; components of linked
fingerprints are named by their smallest ``doc_id``.

The index is a forest over the distinct fingerprints:

* *Upper nodes* hold a shared masked bit pattern. The 64 bits are four blocks; two
  fingerprints that differ in two bits agree in two of the blocks at least, so each hangs
  under its patterns of the six pairs of blocks, and a pair meets without a difference
  under one of them. A node with more than ``LIMIT`` members is opened: the bits that are
  still free are four blocks again, and its members hang under the six patterns that
  lengthen its own. After three levels 56 of the 64 bits are fixed and 256 members are the
  most there can be, so a fingerprint has 6 places, and 216 at most, however many others
  are like it; no node's members are dealt out in pairs of blocks.
* *Lower nodes*: the members of an upper node are sorted by the Gray rank of their free
  bits, in which neighbours differ in few bits. Each run of ``FAN`` neighbours is a node
  whose mask holds the bits that all of them share and whose ancestors' masks lack; runs of
  ``FAN`` nodes are nodes in turn, up to the upper node.
* *Search* goes down for all members of a partition at once. A node adds the differences
  under its own mask to those of its ancestors; where the sum exceeds ``DISTANCE``, the
  node and all below it are left. What arrives at a member is a link.

A partition's links are summed up as stars (one row a fingerprint at most); the stars'
connected components give the result. Nothing is collected; every intermediate table is
written to the shared folder and has at most some integers a row.

Defined cases: a text without words (NULL, empty, blank) has fingerprint zero and is linked
like any other; rows that repeat a ``doc_id`` are fingerprinted one by one; a NULL ``doc_id``
names no component: such rows get their fingerprint and the smallest ``doc_id`` that they
reach, NULL if there is none; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.common import arrow_map, materialize, salted_join, shuffle_partitions, table
from stratum.llm.components import connected_components
from stratum.llm.ngram_join import star_labels, whole_groups
from stratum.llm.textnp import blocks, word_lists

K = 3
SEED = 42
DISTANCE = 2
#: Bits of a block, level by level: two of four blocks are fixed at each.
WIDTHS = (16, 8, 4)
#: Members of an upper node that is not opened; 256 at least, so that the last level needs no opening.
LIMIT = 1024
FAN = 8
#: A fingerprint of more than one in so many rows is joined by broadcast: so many at most.
HOT_SHARE = 1000

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_PAIRS = [(0, 1, 2, 3), (0, 2, 1, 3), (0, 3, 1, 2), (1, 2, 0, 3), (1, 3, 0, 2), (2, 3, 0, 1)]


def text_fingerprint(text: bytes) -> int:
    """The fingerprint of one UTF-8 text, as an unsigned integer."""
    from xxhash import xxh64_intdigest

    ones, total, words = np.zeros(64, np.int64), 0, []
    for words, _ in word_lists(text.lower(), _WORDS, K - 1):
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        runs = zip(starts, ends[K - 1 :].tolist(), strict=False)
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in runs], np.uint64)
        total += len(hashes)
        for i in range(0, len(hashes), 1 << 15):
            bits = np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
    if not total:
        return xxh64_intdigest(b" ".join(words), SEED) if words else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def simhash_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp``: the fingerprint of every row, its 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                texts = pc.fill_null(part.column("text"), "").cast(pa.large_binary())
                found = np.array([text_fingerprint(t.as_py()) for t in texts], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def _hang(rows: DataFrame, width: int) -> DataFrame:
    """Each of ``fp, path, pattern, rest`` under the six nodes that fix two of the four blocks
    of ``width`` bits of ``rest``."""
    block = [F.shiftrightunsigned("rest", width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(4)]

    def two(high: Column, low: Column) -> Column:
        return F.shiftleft(high, width).bitwiseOR(low)

    places = [
        F.struct(
            (F.col("path") * len(_PAIRS) + F.lit(k)).alias("path"),
            F.shiftleft("pattern", 2 * width).bitwiseOR(two(block[a], block[b])).alias("pattern"),
            two(block[c], block[d]).alias("rest"),
        )
        for k, (a, b, c, d) in enumerate(_PAIRS)
    ]
    return rows.select("fp", F.inline(F.array(*places)))


def gray_rank(bits: Column) -> Column:
    """The place of a pattern of up to 32 bits in the reflected Gray code."""
    for shift in (1, 2, 4, 8, 16):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, shift))
    return bits


class GrayTree:
    """The lower nodes of all upper nodes of a sorted table of ``rest``; ``starts`` are the
    rows at which upper nodes begin. ``levels`` go from the roots to the members."""

    def __init__(self, rest: np.ndarray, starts: np.ndarray):
        size = np.diff(np.append(starts, len(rest)))
        value, mask, last = rest, np.full(len(rest), 2**32 - 1, np.uint64), np.arange(1, len(rest) + 1)
        self.levels = [(value, mask, last)]
        self.child_starts: list[np.ndarray] = []
        begin, count = starts, size
        while (count > 1).any():
            runs = -(-count // FAN)
            offset = np.concatenate([[0], np.cumsum(runs)])
            number = np.arange(offset[-1]) - np.repeat(offset[:-1], runs)
            heads = np.repeat(begin, runs) + number * FAN
            ends = np.append(heads[1:], len(value))
            ones = np.bitwise_and.reduceat(value, heads)
            shared = np.bitwise_and.reduceat(mask, heads) & ~(ones ^ np.bitwise_or.reduceat(value, heads))
            self.levels[0] = (value, mask & ~np.repeat(shared, ends - heads), last)  # the bits that the parent lacks
            self.child_starts.insert(0, heads)
            value, mask, last = ones & shared, shared, last[ends - 1]
            self.levels.insert(0, (value, mask, last))
            begin, count = offset[:-1], runs
        self.root = np.repeat(np.arange(len(starts)), size)

    def links(self, rest: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, later member of its upper node) within ``DISTANCE``."""
        node, acc = self.root[queries], np.zeros(len(queries), np.uint8)
        for level, heads in enumerate(self.child_starts, 1):
            value, mask, last = self.levels[level]
            ends = np.append(heads[1:], len(value))
            fan = ends[node] - heads[node]
            inner = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
            child = np.repeat(heads[node], fan) + inner
            queries, acc = np.repeat(queries, fan), np.repeat(acc, fan)
            later = last[child] > queries + 1  # each pair once: some member below comes after the query
            queries, acc, child = queries[later], acc[later], child[later]
            acc = acc + np.bitwise_count((rest[queries] ^ value[child]) & mask[child])
            near = acc <= DISTANCE
            queries, acc, node = queries[near], acc[near], child[near]
        return queries, node


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[pa.Table] = []

    def found() -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(waiting)
        waiting.clear()
        fp, path, pattern, rest = (t.column(c).to_numpy() for c in ("fp", "path", "pattern", "rest"))
        new = np.concatenate([[True], (path[1:] != path[:-1]) | (pattern[1:] != pattern[:-1])])
        alone = new & np.concatenate([new[1:], [True]])
        fp, rest, new = fp[~alone], rest[~alone].astype(np.uint64), new[~alone]
        if not len(fp):
            return
        tree = GrayTree(rest, np.flatnonzero(new))
        pairs = [tree.links(rest, np.arange(a, min(a + 1024, len(fp)))) for a in range(0, len(fp), 1024)]
        label = star_labels(len(fp), *(np.concatenate(x) for x in zip(*pairs, strict=True)))
        use = np.flatnonzero(label != np.arange(len(fp)))
        if len(use):
            yield pa.RecordBatch.from_arrays([pa.array(fp[use]), pa.array(fp[label[use]])], ["a", "b"])

    rows = 0
    for groups in whole_groups(batches, ["path", "pattern"]):
        waiting.append(groups)
        rows += groups.num_rows
        if rows >= 1 << 16:
            yield from found()
            rows = 0
    if waiting:
        yield from found()


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """``a, b``: stars that connect the distinct fingerprints ``fp`` as all links within
    ``DISTANCE`` do."""
    stars, rows = None, fps.select("fp", F.lit(0).alias("path"), F.lit(0).cast("long").alias("pattern"), F.col("fp").alias("rest"))
    for width in WIDTHS:
        rows = _hang(rows, width)
        whole = rows
        if width != WIDTHS[-1]:
            node = ["path", "pattern"]
            large = materialize(rows.groupBy(*node).count().filter(F.col("count") > LIMIT).select(*node), "large")
            dealt = rows.withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(8)).cast("int"))
            parts = large.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(7))))
            whole = dealt.join(parts, [*node, "part"], "left_anti").select(*rows.columns)
            rows = dealt.join(parts, [*node, "part"], "left_semi").select(*rows.columns)
        ordered = whole.repartition(shuffle_partitions(fps.sparkSession), "path", "pattern").withColumn("rank", gray_rank(F.col("rest")))
        ordered = ordered.sortWithinPartitions("path", "pattern", "rank").drop("rank")
        found = arrow_map(ordered, _search, "a long, b long")
        stars = found if stars is None else stars.unionAll(found)
        if width != WIDTHS[-1] and large.isEmpty():
            break
    return stars


def named_by_class(rows: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """``rows`` with the columns that ``classes(fp, n, ...)`` has for their ``fp``. Classes of
    more than one in ``HOT_SHARE`` of all ``total`` rows, of which there are fewer than that, are
    broadcast; the others' rows meet theirs by a shuffle."""
    hot = F.col("n") * HOT_SHARE > total
    many, few = classes.filter(hot), classes.filter(~hot)
    often = rows.join(F.broadcast(many), "fp")
    seldom = rows.join(F.broadcast(many.select("fp")), "fp", "left_anti").join(few, "fp")
    return often.unionByName(seldom)


def simhash_components(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id, n_copies, n_fingerprints`` of every row: its
    fingerprint in hex, the smallest ``doc_id`` that links reach from it, the rows of its
    fingerprint and the different fingerprints of its component."""
    prints = materialize(simhash_fingerprints(docs), "fingerprints")
    classes = prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    classes = materialize(classes, "classes")
    labels = connected_components(fingerprint_links(classes)).withColumnsRenamed({"node": "fp"})
    linked = materialize(classes.join(labels, "fp", "left"), "linked")
    whole = linked.filter("label IS NOT NULL").groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("n_fingerprints"))
    alone = linked.filter("label IS NULL").select("fp", "n", F.col("least").alias("component_id"), F.lit(1).cast("long").alias("n_fingerprints"))
    named = salted_join(linked.filter("label IS NOT NULL").select("fp", "n", "label"), whole, ["label"], "fp").drop("label")
    named = materialize(alone.unionByName(named), "named")
    return named_by_class(prints, named, prints.count()).select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        F.col("n").alias("n_copies"),
        "n_fingerprints",
    )


def op11_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents", ["doc_id", "text"]))
