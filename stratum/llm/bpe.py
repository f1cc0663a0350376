"""Byte-level BPE encoding and decoding with a published rank file.

Each text is split by the tokenizer's pattern; every match is encoded by itself. The
distinct matches of a batch that were not seen before are grouped by byte length into
padded numpy matrices. In each round every row merges its leftmost pair of minimum rank:
ranks of adjacent pairs are looked up in an open-addressing hash table, the pair's left
cell takes the merged token's rank and the row is compacted by one cell. Rows without a
pair of known rank leave the matrix. Matches longer than ``WIDE`` bytes (base64 blobs,
runs of one letter) would make a matrix quadratic; they take the same merges, in the
same order, from a heap over a linked list.

Letters and numbers are those of the Unicode version that the published encoders go by; younger
ones (``YOUNGER``), which the ``regex`` package counts too, are neither.

The ids of a document are turned back to bytes by one gather over the vocabulary's byte
table.

Memory of a task: the rank table (a few MB), one Arrow batch, and about ``CACHE``
encoded matches. Documents are independent: no shuffle.

Defined cases: NULL is the empty text (no ids, the digest of the empty string); equal
rows give equal results; ``<|endoftext|>`` and the like are ordinary text; other columns
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

from stratum.llm.common import arrow_map, table

WIDE = 256
CACHE = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
NO_RANK = np.int32(2**31 - 1)
# Letters and numbers of ``regex`` that the published encoders' Unicode version has not assigned.
YOUNGER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
UNASSIGNED = "\uffff"  # stands for them while a text is split: neither letter, number nor white space


def read_ranks(path: str) -> dict[bytes, int]:
    """``base64-token rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PairTable:
    """(left id, right id) -> id of the merged token, in an open-addressing hash table."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        merged = np.array(merged, np.int32)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.full(1 << bits, NO_RANK, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):  # all keys that find their slot free and come first take it; the others step on
            at = slot[todo]
            free = self.keys[at] == np.iinfo(np.uint64).max
            _, first = np.unique(at[free], return_index=True)
            winners = todo[free][first]
            self.keys[slot[winners]], self.values[slot[winners]] = keys[winners], merged[winners]
            todo = np.setdiff1d(todo, winners, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask
        self.plain: dict[int, int] | None = None

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the merged pairs; ``NO_RANK`` where there is none (a negative id is padding)."""
        keys = (left.astype(np.int64).astype(np.uint64) << np.uint64(32)) | (right.astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], NO_RANK)
        open_ = np.flatnonzero((out == NO_RANK) & (self.keys[slot] != np.iinfo(np.uint64).max))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != np.iinfo(np.uint64).max)]
        out[(left < 0) | (right < 0)] = NO_RANK
        return out

    def one(self, left: int, right: int) -> int:
        if self.plain is None:
            used = self.keys != np.iinfo(np.uint64).max
            self.plain = dict(zip(self.keys[used].tolist(), self.values[used].tolist(), strict=True))
        return self.plain.get(left << 32 | right, int(NO_RANK))


def merge_matrix(cells: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Fully merged rows of a matrix of ids, -1 pads at the end of a row; and their lengths."""
    n, width = cells.shape
    merged, length = np.full((n, width), -1, np.int32), np.zeros(n, np.int64)
    rows = np.arange(n)
    rank = pairs.look_up(cells[:, :-1].ravel(), cells[:, 1:].ravel()).reshape(n, width - 1) if width > 1 else np.zeros((n, 0), np.int32)
    while True:
        if cells.shape[1] < 2:
            at, best = np.zeros(len(rows), np.int64), np.full(len(rows), NO_RANK)
        else:
            at = rank.argmin(axis=1)  # the first of equal ranks: the leftmost
            best = rank[np.arange(len(rows)), at]
        over = best == NO_RANK
        if over.any():
            ended = cells[over]
            merged[rows[over], : ended.shape[1]] = ended
            length[rows[over]] = (ended >= 0).sum(axis=1)
            go = ~over
            rows, cells, rank, at, best = rows[go], cells[go], rank[go], at[go], best[go]
        if not len(rows):
            return merged, length
        k = np.arange(len(rows))
        # compaction: cells right of the merged pair move one to the left
        column = np.arange(cells.shape[1] - 1)
        source = column + (column > at[:, None])
        cells = np.take_along_axis(cells, source, axis=1)
        cells[k, at] = best
        if cells.shape[1] < 2:
            rank = np.zeros((len(rows), 0), np.int32)
            continue
        column = column[:-1]
        rank = np.take_along_axis(rank, column + (column >= at[:, None]), axis=1)
        # the two pairs that hold the merged token are new
        has_left = at > 0
        rank[k[has_left], at[has_left] - 1] = pairs.look_up(cells[k[has_left], at[has_left] - 1], best[has_left])
        has_right = at < cells.shape[1] - 1
        rank[k[has_right], at[has_right]] = pairs.look_up(best[has_right], cells[k[has_right], at[has_right] + 1])


def merge_long(ids: list[int], pairs: PairTable) -> np.ndarray:
    """The same merges for one long row: a heap of (rank, position) over a linked list."""
    n = len(ids)
    ids, following, before = list(ids), [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(r, i) for i in range(n - 1) if (r := pairs.one(ids[i], ids[i + 1])) != NO_RANK]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = following[i]
        if ids[i] < 0 or j < 0 or pairs.one(ids[i], ids[j]) != r:
            continue  # one of the two has been merged since
        ids[i], ids[j], following[i] = r, -1, following[j]
        if following[j] >= 0:
            before[following[j]] = i
        for a, b in ((before[i], i), (i, following[i])):
            if a >= 0 and b >= 0 and (x := pairs.one(ids[a], ids[b])) != NO_RANK:
                heapq.heappush(heap, (x, a))
    return np.array([x for x in ids if x >= 0], np.int32)


class BytePairCodec:
    """Encodes and decodes texts by one rank file and one split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.pattern = regex.compile(pattern)
        self.younger = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in YOUNGER) + "]")
        self.pairs = PairTable(ranks)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        tokens = sorted(ranks.items(), key=lambda x: x[1])
        size = tokens[-1][1] + 1
        self.length = np.zeros(size, np.int64)
        self.start = np.zeros(size, np.int64)
        at = 0
        for token, rank in tokens:
            self.start[rank], self.length[rank] = at, len(token)
            at += len(token)
        self.bytes = np.frombuffer(b"".join(t for t, _ in tokens), np.uint8)
        self.name = list(map(str, range(size)))
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}

    def matches(self, text: str) -> list[str]:
        if text.isascii() or not self.younger.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(self.younger.sub(UNASSIGNED, text))]

    def _encode_new(self, matches: list[str]) -> None:
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for m in matches:
            raw = m.encode()
            by_width.setdefault(len(raw) if len(raw) <= 8 else -(-len(raw) // 8) * 8, []).append((m, raw))
        for width, group in by_width.items():
            if width > WIDE:
                for m, raw in group:
                    ids = merge_long(self.byte_id[np.frombuffer(raw, np.uint8)].tolist(), self.pairs)
                    self.young[m] = (ids.tobytes(), ",".join(map(str, ids.tolist())))
                continue
            for k in range(0, len(group), 8192):
                part = group[k : k + 8192]
                raw = np.frombuffer(b"".join(r.ljust(width, b"\0") for _, r in part), np.uint8).reshape(len(part), width)
                cells = self.byte_id[raw]
                cells[np.arange(width) >= np.array([len(r) for _, r in part])[:, None]] = -1
                merged, length = merge_matrix(cells, self.pairs)
                for (m, _), row, n, raw in zip(part, merged.tolist(), length.tolist(), merged, strict=True):
                    self.young[m] = (raw[:n].tobytes(), ",".join([self.name[x] for x in row[:n]]))

    def encode_many(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """For each text the ids, and the same ids as decimal text joined by commas."""
        matches = [self.matches(text) for text in texts]
        distinct: set[str] = set().union(*matches)
        if len(self.young) > CACHE // 2:  # what was used since the last turn stays for another
            self.old, self.young = self.young, {}
        missing = [m for m in distinct if m not in self.young]
        self.young.update({m: self.old[m] for m in missing if m in self.old})
        self._encode_new([m for m in missing if m not in self.young])
        seen, out = self.young, []
        for found in matches:
            parts = [seen[m] for m in found]
            out.append((np.frombuffer(b"".join([x[0] for x in parts]), np.int32), ",".join([x[1] for x in parts])))
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0][0]

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        length = self.length[ids]
        ends = length.cumsum()
        shift = np.repeat(self.start[ids] - (ends - length), length)
        return self.bytes[np.arange(ends[-1]) + shift].tobytes()


_CODECS: dict[tuple[str, str], BytePairCodec] = {}


def codec(path: str, pattern: str) -> BytePairCodec:
    """One codec for each Python worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = BytePairCodec(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def blocks(batch: pa.RecordBatch, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with texts of about ``most_bytes``, one row at least."""
    sizes = np.array([0 if x is None else x for x in pa.compute.binary_length(batch.column("text")).to_pylist()], np.int64)
    number = sizes.cumsum() // most_bytes
    starts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
    for a, b in zip(starts, starts[1:], strict=False):
        yield batch.slice(a, b - a)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row, and ``ids array<int>``
    if wanted. ``rank_file`` is read on each executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file, pattern)
        for batch in batches:
            for part in blocks(batch):
                texts = [x or "" for x in part.column("text").to_pylist()]
                out = [
                    (len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest(), ids)
                    for ids, said in own.encode_many(texts)
                ]
                columns = [part.column("doc_id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out]), pa.array([x[2] for x in out])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    ends = np.cumsum([0, *(x[0] for x in out)], dtype=np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x[3] for x in out]))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return arrow_map(docs.select("doc_id", "text"), run, SCHEMA + (", ids array<int>" if with_ids else ""))


def decode_documents(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, ids array<int>`` (NULL: empty). Bytes that are no
    UTF-8, which only ids that no text gives can yield, become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file, pattern)
        for batch in batches:
            texts = [own.decode(np.array(x.as_py() or [], np.int64)).decode("utf-8", "replace") for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def op3_byte_bpe(spark: SparkSession, sf_dir: str, rank_file: str | None = None) -> DataFrame:
    import public_tokenizers

    path = rank_file or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(table(spark, sf_dir, "documents", ["doc_id", "text"]), path, public_tokenizers.PATTERN)
