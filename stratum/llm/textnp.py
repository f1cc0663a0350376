"""Whole-text word hashing over Arrow string columns in numpy.

All work is over the bytes of a block of texts at once: word limits come from a byte
table, and the hash of every word from prefix sums of ``code[byte] * BASE^position``
modulo 2^64, taken back to position 0 by the inverse power.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2^64
_CODE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}

#: Words of the reports and contracts: everything but blanks and the five control characters.
BLANK_SEPARATED = np.ones(256, bool)
BLANK_SEPARATED[[0x20, *range(0x09, 0x0E)]] = False
#: Words of the near-duplicate operators: letters, digits, ``_`` and all that is not ASCII.
WORD_BYTES = np.array([chr(b).isalnum() or b == 0x5F if b < 0x80 else True for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 21:
            _POWERS[base] = have
    return have[:n]


def blocks(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with texts of about ``most_bytes``, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    number = sizes.cumsum() // most_bytes
    starts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:], strict=False):
        yield batch.slice(a, b - a)


def text_bytes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and the n + 1 offsets. NULL: empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document number of each word; no word crosses two documents."""
    inside = kind[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(raw) else np.zeros(0, bool)
    start = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(raw) else np.zeros(0, bool)
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_CODE[raw] * _powers(_BASE, len(raw)), out=sums[1:])
    return sums


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span of bytes; ``sums``: its :func:`prefix_sums`, if at hand."""
    sums = prefix_sums(raw) if sums is None else sums
    inverse = _powers(pow(_BASE, -1, 1 << 64), len(raw) + 1)
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of ``k`` words, whatever document they belong to."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += words[j : j + n] * np.uint64((0x9E3779B97F4A7C15 * (2 * j + 3)) % 2**64 | 1)
    return mix(out)


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text's ``k``-word shingles, all texts one after
    the other, and the n + 1 offsets. A text of 1 to k - 1 words has one shingle of all."""
    raw, offsets = text_bytes(column, lower=True)
    start, end, doc = word_spans(raw, offsets, WORD_BYTES)
    words = span_hashes(raw, start, end)
    runs = windows(words, k)
    limits = np.searchsorted(doc, np.arange(len(column) + 1))
    sets = []
    for i in range(len(column)):
        a, b = limits[i], limits[i + 1]
        if b - a >= k:
            sets.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            sets.append(windows(words[a:b], int(b - a)) + np.uint64(b - a))
        else:
            sets.append(np.zeros(0, np.uint64))
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], sizes.cumsum()]).astype(np.int64)


def word_lists(text: bytes, words: re.Pattern, carry: int, most_bytes: int = 1 << 18) -> Iterator[tuple[list[bytes], int]]:
    """The matches of ``words`` in a text of any length, a list for each piece of about
    ``most_bytes``. A list begins with the last ``carry`` words of the one before (all of
    them, if it had fewer); the number says how many of its words were in it."""
    begin, tail = 0, []
    while begin < len(text):
        end = begin + most_bytes
        if end < len(text):  # a piece ends with the word that reaches over its end
            last = words.match(text, end)
            end = last.end() if last else end
        found = [*tail, *words.findall(text, begin, end)]
        if len(found) > len(tail):
            yield found, len(tail)
        begin, tail = end, found[-carry:] if carry else []
