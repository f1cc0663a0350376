"""Fill-in-the-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of ``FRAME`` units (code points) with the
cumulative unit count of each frame, so that any range of units is read by decompressing
only the frames that it touches (:class:`Frames`). The transformation cuts the stored text
at two units: only the frames that hold a cut are decompressed, and their pieces become
frames again; all other frames are taken over as they are. The output, the sections in another
order behind their markers, is an order of frames itself. Digests stream the ordered frames;
the text is rebuilt by streaming the output once to find its markers and then reading the
sections' ranges in the text's order.

The cuts and the form of a document come from the SHA-256 of ``<seed>:<doc_id>``, so a
replayed task gives the same output. There is no shuffle; a task holds one text and its frames
at a time.

Defined cases: a NULL text is the empty text; the empty text and a text that holds a
marker stay plain; an empty text has no frame; a NULL ``doc_id`` is hashed as the empty
name; rows that repeat a ``doc_id`` are transformed one by one; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stratum.llm.common import arrow_map, table
from stratum.llm.textnp import blocks

FRAME = 4096
PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")
#: Sections of each form in the output's order.
ORDERS = {"plain": (), "psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}

STORED = "doc_id long, n long, marked boolean, frames array<binary>, ends array<long>"
TRANSFORMED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, frames array<binary>, ends array<long>"
DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


@dataclass(frozen=True)
class Rates:
    """Of 100 documents ``fim`` are transformed, and of 100 of those ``spm`` suffix first."""

    fim: int = 90
    spm: int = 20
    seed: int = 1


class Codec:
    """One compressor and decompressor a task."""

    def __init__(self):
        import zstandard

        self._pack, self._unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

    def pack(self, text: str) -> bytes:
        return self._pack.compress(text.encode())

    def unpack(self, frame: bytes) -> str:
        return self._unpack.decompress(frame).decode()


class Frames:
    """A text as frames with their cumulative unit counts."""

    def __init__(self, codec: Codec, frames: list[bytes], ends: list[int]):
        self.codec, self.frames, self.ends = codec, frames, ends

    @classmethod
    def store(cls, codec: Codec, text: str, units: int = FRAME) -> Frames:
        starts = range(0, len(text), units)
        return cls(codec, [codec.pack(text[a : a + units]) for a in starts], [min(a + units, len(text)) for a in starts])

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def stream(self, a: int = 0, b: int | None = None) -> Iterator[str]:
        """The units from ``a`` to ``b``, one frame at a time; other frames stay compressed."""
        from bisect import bisect_right

        b = len(self) if b is None else b
        at = bisect_right(self.ends, a)
        while a < b:
            begin = self.ends[at - 1] if at else 0
            text = self.codec.unpack(self.frames[at])
            yield text[a - begin : b - begin]
            a, at = self.ends[at], at + 1

    def section(self, a: int, b: int) -> Frames:
        """The units from ``a`` to ``b`` as frames: whole ones as they are, cut ones anew."""
        from bisect import bisect_right

        frames, ends, at, start = [], [], bisect_right(self.ends, a), a
        while a < b:
            begin, end = self.ends[at - 1] if at else 0, self.ends[at]
            if a == begin and end <= b:
                frames.append(self.frames[at])
            else:
                frames.append(self.codec.pack(self.codec.unpack(self.frames[at])[a - begin : b - begin]))
            a, at = min(end, b), at + 1
            ends.append(a - start)
        return Frames(self.codec, frames, ends)

    def find(self, marks: tuple[str, ...]) -> list[int]:
        """The first unit at which each mark begins, in one pass over the ordered frames; -1: none."""
        most, places, tail, begin = max(map(len, marks), default=1) - 1, [-1] * len(marks), "", 0
        for text in self.stream():
            joined = tail + text
            for i, mark in enumerate(marks):
                if places[i] < 0 and (at := joined.find(mark)) >= 0:
                    places[i] = begin - len(tail) + at
            begin += len(text)
            tail = joined[-most:] if most else ""
        return places


def joined(codec: Codec, parts: list[Frames]) -> Frames:
    frames, ends, total = [], [], 0
    for part in parts:
        frames += part.frames
        ends += [total + e for e in part.ends]
        total += len(part)
    return Frames(codec, frames, ends)


def draw(doc_id: int | None, n: int, marked: bool, rates: Rates) -> tuple[str, int, int]:
    """The form and the two cuts, in order, of a document of ``n`` units."""
    digest = hashlib.sha256(f"{rates.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    form = "plain" if not n or marked or h3 % 100 >= rates.fim else "spm" if h4 % 100 < rates.spm else "psm"
    return form, *sorted((h1 % (n + 1), h2 % (n + 1)))


def arranged(stored: Frames, form: str, low: int, high: int, marks: dict[str, Frames]) -> Frames:
    """The output of one text: its sections behind their markers, in the form's order."""
    if form == "plain":
        return stored
    section = {PREFIX: (0, low), MIDDLE: (low, high), SUFFIX: (high, len(stored))}
    return joined(stored.codec, [part for m in ORDERS[form] for part in (marks[m], stored.section(*section[m]))])


def rebuilt(output: Frames, form: str) -> Iterator[str]:
    """The text of an output, streamed, from nothing but the output and its form."""
    order = ORDERS[form]
    if not order:
        yield from output.stream()
        return
    at = output.find(order)
    ends = [*at[1:], len(output)]
    ranges = {m: (a + len(m), b) for m, a, b in zip(order, at, ends, strict=True)}
    for m in (PREFIX, MIDDLE, SUFFIX):
        yield from output.stream(*ranges[m])


def sha256(parts: Iterator[str]) -> str:
    digest = hashlib.sha256()
    for part in parts:
        digest.update(part.encode())
    return digest.hexdigest()


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64())}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = Codec()
    for batch in batches:
        for part in blocks(batch, "text"):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                text = text.as_py() or ""
                stored = Frames.store(codec, text)
                rows.append((doc_id, len(text), any(m in text for m in MARKERS), stored.frames, stored.ends))
            yield _batch(rows, STORED)


def _transform(rates: Rates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec()
        marks = {m: Frames.store(codec, m) for m in MARKERS}
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                form, low, high = draw(row["doc_id"], row["n"], row["marked"], rates)
                output = arranged(Frames(codec, row["frames"], row["ends"]), form, low, high, marks)
                cuts = (None, None) if form == "plain" else (low, high - low)
                rows.append((row["doc_id"], row["n"], form, *cuts, output.frames, output.ends))
            yield _batch(rows, TRANSFORMED)

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = Codec()
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            output = Frames(codec, row.pop("frames"), row.pop("ends"))
            rows.append((*row.values(), sha256(output.stream()), sha256(rebuilt(output, row["form"]))))
        yield _batch(rows, DIGESTS)


def _text(form_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec()
        for batch in batches:
            for row in batch.to_pylist():  # a whole text at a time
                output = Frames(codec, row["frames"], row["ends"])
                parts = rebuilt(output, row["form"]) if form_too else output.stream()
                yield _batch([(row["doc_id"], "".join(parts))], "doc_id long, text string")

    return run


def store_frames(docs: DataFrame) -> DataFrame:
    """``STORED``: every text as frames; ``marked``: it holds one of the markers."""
    return arrow_map(docs.select("doc_id", "text"), _store, STORED)


def transform_frames(stored: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """``TRANSFORMED``: the outputs as frames. ``prefix_chars`` and ``middle_chars`` are NULL
    where the form is plain."""
    return arrow_map(stored.select("doc_id", "n", "marked", "frames", "ends"), _transform(rates), TRANSFORMED)


def output_texts(transformed: DataFrame) -> DataFrame:
    """``doc_id, text``: the outputs as texts."""
    return arrow_map(transformed.select("doc_id", "form", "frames", "ends"), _text(False), "doc_id long, text string")


def restored_texts(transformed: DataFrame) -> DataFrame:
    """``doc_id, text``: the texts before the transformation, from output and form alone."""
    return arrow_map(transformed.select("doc_id", "form", "frames", "ends"), _text(True), "doc_id long, text string")


def fim_digests(docs: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """``DIGESTS`` of storing, transforming and restoring, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _digest(_transform(rates)(_store(batches)))

    return arrow_map(docs.select("doc_id", "text"), run, DIGESTS)


def op12_fim_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_digests(table(spark, sf_dir, "documents", ["doc_id", "text"]))


OP12_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), g AS (
  SELECT *, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) AS h1, CAST(('0x' || substr(h, 9, 8)) AS BIGINT) AS h2,
         CAST(('0x' || substr(h, 17, 8)) AS BIGINT) AS h3, CAST(('0x' || substr(h, 25, 8)) AS BIGINT) AS h4
  FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM g
), s AS (
  SELECT *, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1, n - b) AS s FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM s
"""
