"""WARC archives packed in ZIP files: written, then read back by ranges.

Writing: each task fills archives of its own, ``<name>-<uuid>.zip``, with stored (not
compressed) members: ``archive/data-<n>.warc.gz``, WARC files whose records are gzip members
of their own, and ``indexes/index.cdxj``, a line of place and length for each record. A
new archive begins at ``archive_bytes``, a new member at ``member_bytes``. The files an
attempt finished are named by the rows it returns, and these are written as a table before
anything is read, so files of lost attempts are never seen.

Reading: :class:`ZipDirectory` finds the end-of-directory record (and, where a field
overflows, the ZIP64 record by its locator), parses the central directory with its ZIP64
extra fields, and locates stored members through their local headers. The index members
give the records, which are dealt out in slices of about ``SLICE_BYTES`` and each read by
one range read; nothing is extracted and no member is read whole but the indexes, in pieces.

A payload of at least ``least_bytes`` that equals that of a smaller ``page_id`` is written
as a ``revisit`` record that names the first; the digests are compared after one
aggregation by digest, and joined back in parts by ``page_id``, so a large group of copies
meets in no task.

Files are reached through ``pyarrow.fs`` by the URI of the shared folder (``file``, ``hdfs``
and the stores pyarrow knows).

Each page becomes a compressed response record before the one shuffle that its bytes take,
so the shuffle moves what the archive will hold.

Defined cases: NULL html is an empty payload; an empty table gives no archive and no rows;
rows that repeat the smallest ``page_id`` of a payload are responses, each of them, and a
NULL ``page_id`` is larger than any other; a NULL url is written as an empty target; other
columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.common import arrow_map, materialize, salted_join, shuffle_partitions, table
from stratum.llm.textnp import blocks
from stratum.session import scratch_path

LEAST_BYTES = 100
GZIP_LEVEL = 4
ARCHIVE_BYTES = 256 << 20
MEMBER_BYTES = 64 << 20
SLICE_BYTES = 8 << 20
INDEX_PIECE = 4 << 20

_EOCD, _EOCD64, _LOCATOR, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_FULL32, _FULL16 = 0xFFFFFFFF, 0xFFFF


def filesystem(uri: str):
    """The pyarrow file system of a URI or plain path, and the path in it."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


# ---------------------------------------------------------------- ZIP writing


class StoredZipWriter:
    """A ZIP of stored members, written front to back. Sizes and checksums are not known
    before a member ends, so they follow it in a data descriptor; ``zip64`` gives every
    entry ZIP64 fields (else only those that need them have them)."""

    def __init__(self, sink, zip64: bool = False) -> None:
        self.sink, self.at, self.zip64 = sink, 0, zip64
        self.entries: list[tuple[bytes, int, int, int]] = []
        self.name: bytes | None = None

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.offset, self.crc, self.size = name.encode(), self.at, 0, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0) if self.zip64 else b""
        size = _FULL32 if self.zip64 else 0
        self._put(_LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x0808, 0, 0, 0x21, 0, size, size, len(self.name), len(extra)) + self.name + extra)

    def write(self, data: bytes) -> int:
        """Appends to the open member; where the data begin in it."""
        begin = self.size
        self._put(data)
        self.crc, self.size = zlib.crc32(data, self.crc), self.size + len(data)
        return begin

    def end(self) -> None:
        form = "<IQQ" if self.zip64 or self.size >= _FULL32 else "<III"
        self._put(b"PK\x07\x08" + struct.pack(form, self.crc, self.size, self.size))
        self.entries.append((self.name, self.offset, self.size, self.crc))

    def close(self) -> None:
        begin = self.at
        for name, offset, size, crc in self.entries:
            big = [x for x in (size, size, offset) if self.zip64 or x >= _FULL32]
            extra = struct.pack(f"<HH{len(big)}Q", 1, 8 * len(big), *big) if big else b""
            size32, offset32 = (_FULL32 if self.zip64 or x >= _FULL32 else x for x in (size, offset))
            self._put(
                _CENTRAL
                + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x0808, 0, 0, 0x21, crc, size32, size32, len(name), len(extra), 0, 0, 0, 0, offset32)
                + name
                + extra
            )
        length, n = self.at - begin, len(self.entries)
        if self.zip64 or n >= _FULL16 or begin >= _FULL32 or length >= _FULL32:
            record = self.at
            self._put(_EOCD64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, length, begin))
            self._put(_LOCATOR + struct.pack("<IQI", 0, record, 1))
            n, length, begin = (_FULL16, _FULL32, _FULL32) if self.zip64 else (min(n, _FULL16), min(length, _FULL32), min(begin, _FULL32))
        self._put(_EOCD + struct.pack("<HHHHIIH", 0, 0, n, n, length, begin, 0))
        self.sink.close()


# ---------------------------------------------------------------- ZIP reading


class ZipDirectory:
    """Members of a ZIP file by range reads: name -> (offset of the local header, stored
    size, compression method)."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        tail_at = max(0, size - (22 + _FULL16))
        tail = self.read(tail_at, size - tail_at)
        at = tail.rfind(_EOCD)
        # the mark can also stand in the comment; the record's comment ends with the file
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(_EOCD, 0, at)
        if at < 0:
            raise ValueError("not a ZIP file: no end of central directory")
        _, _, _, n, length, begin, _ = struct.unpack_from("<HHHHIIH", tail, at + 4)
        if n == _FULL16 or length == _FULL32 or begin == _FULL32:
            where = tail_at + at - 20
            locator = self.read(where, 20) if where >= 0 else b""
            if locator[:4] == _LOCATOR:
                record = self.read(struct.unpack_from("<Q", locator, 8)[0], 56)
                if record[:4] != _EOCD64:
                    raise ValueError("ZIP64 locator points to no ZIP64 record")
                n, length, begin = struct.unpack_from("<QQQ", record, 32)
        self.members: dict[str, tuple[int, int, int]] = {}
        directory = self.read(begin, length)
        at = 0
        for _ in range(n):
            if directory[at : at + 4] != _CENTRAL:
                raise ValueError("damaged central directory")
            flags, method = struct.unpack_from("<HH", directory, at + 8)
            packed, plain, names, extras, comment = struct.unpack_from("<IIHHH", directory, at + 20)
            offset = struct.unpack_from("<I", directory, at + 42)[0]
            name = directory[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
            extra = directory[at + 46 + names : at + 46 + names + extras]
            packed, offset = self._wide(extra, plain, packed, offset)
            self.members[name] = (offset, packed, method)
            at += 46 + names + extras + comment

    @staticmethod
    def _wide(extra: bytes, plain: int, packed: int, offset: int) -> tuple[int, int]:
        """Size and offset, taken from the ZIP64 extra field where the plain fields are full."""
        at = 0
        while at + 4 <= len(extra):
            kind, size = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                values = list(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
                if plain == _FULL32:
                    values.pop(0)
                if packed == _FULL32:
                    packed = values.pop(0)
                if offset == _FULL32:
                    offset = values.pop(0)
                break
            at += 4 + size
        return packed, offset

    def read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def stored(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin in the file, and how many they are."""
        offset, size, method = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
        head = self.read(offset, 30)
        if head[:4] != _LOCAL:
            raise ValueError(f"{name}: no local header")
        names, extras = struct.unpack_from("<HH", head, 26)
        return offset + 30 + names + extras, size


# ---------------------------------------------------------------- WARC records


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return lines.encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    warc = dict(x.split(": ", 1) for x in lines[1:])
    http, _, payload = rest[: int(warc["Content-Length"])].partition(b"\r\n\r\n")
    return warc, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _one_line(text: str | None) -> str:
    return (text or "").replace("\r", "%0D").replace("\n", "%0A")


def _page_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record if there is no payload."""
    # the date is fixed: equal inputs give equal records
    headers = [
        ("WARC-Type", "revisit" if payload is None else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", _one_line(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if payload is None:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:page:{refers_to}>"),
        ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return warc_record(headers, http + (payload or b""))


def _packed(record: bytes) -> bytes:
    return gzip.compress(record, GZIP_LEVEL, mtime=0)


MANIFEST = "archive string, bytes long, records long"


class _ArchiveWriter:
    def __init__(self, folder: str, archive_bytes: int, member_bytes: int, zip64: bool) -> None:
        self.folder, self.archive_bytes, self.member_bytes, self.zip64 = folder, archive_bytes, member_bytes, zip64
        self.zip: StoredZipWriter | None = None
        self.done: list[tuple[str, int, int]] = []

    def add(self, packed: bytes) -> None:
        if self.zip is None:
            fs, path = filesystem(self.folder)
            fs.create_dir(path, recursive=True)
            self.path = f"{self.folder}/pages-{uuid.uuid4().hex}.zip"
            self.zip = StoredZipWriter(fs.open_output_stream(filesystem(self.path)[1]), self.zip64)
            self.index, self.number = [], 0
            self.zip.begin(self._member())
        elif self.zip.size >= self.member_bytes:
            self.zip.end()
            self.number += 1
            self.zip.begin(self._member())
        begin = self.zip.write(packed)
        self.index.append(json.dumps({"member": self._member(), "offset": begin, "length": len(packed)}))
        if self.zip.at >= self.archive_bytes:
            self.finish()

    def _member(self) -> str:
        return f"archive/data-{self.number:05d}.warc.gz"

    def finish(self) -> None:
        if self.zip is None:
            return
        self.zip.end()
        self.zip.begin("indexes/index.cdxj")
        for k in range(0, len(self.index), 10_000):
            self.zip.write(("\n".join(self.index[k : k + 10_000]) + "\n").encode())
        self.zip.end()
        self.zip.close()
        self.done.append((self.path, self.zip.at, len(self.index)))
        self.zip = None


def find_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``page_id, digest, refers_to`` of the pages whose payload a smaller ``page_id`` has."""
    slim = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    slim = slim.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("size")).filter(F.col("size") >= least_bytes)
    first = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 AND refers_to IS NOT NULL")
    copies = salted_join(slim.select("page_id", "digest"), first.drop("n"), ["digest"], "page_id")
    return copies.filter("page_id IS NULL OR page_id <> refers_to").distinct()


def packed_responses(pages: DataFrame) -> DataFrame:
    """``page_id, url, size, digest, packed``: each page as a compressed response record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "html"):
                out = []
                for page_id, url, html in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                    payload = (html or "").encode()
                    digest = hashlib.sha256(payload).hexdigest()
                    out.append((len(payload), digest, _packed(_page_record(page_id, url, payload, len(payload), digest, None))))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("page_id"),
                        part.column("url"),
                        pa.array([x[0] for x in out], pa.int64()),
                        pa.array([x[1] for x in out], pa.string()),
                        pa.array([x[2] for x in out], pa.binary()),
                    ],
                    ["page_id", "url", "size", "digest", "packed"],
                )

    return arrow_map(pages.select("page_id", "url", "html"), run, "page_id long, url string, size long, digest string, packed binary")


def write_archives(
    pages: DataFrame,
    folder: str,
    least_bytes: int = LEAST_BYTES,
    archive_bytes: int = ARCHIVE_BYTES,
    member_bytes: int = MEMBER_BYTES,
    zip64: bool = False,
) -> DataFrame:
    """Writes a record for each row ``page_id, url, html`` and returns the ``MANIFEST`` of the
    archives as a table in the shared folder."""
    revisits = find_revisits(pages, least_bytes).alias("v")
    marked = packed_responses(pages).alias("r").join(
        revisits, F.col("r.page_id").eqNullSafe(F.col("v.page_id")) & (F.col("r.digest") == F.col("v.digest")), "left"
    )
    # a revisit record is made of the other columns
    body = F.when(F.col("refers_to").isNull(), F.col("packed")).alias("packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _ArchiveWriter(folder, archive_bytes, member_bytes, zip64)
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "size", "digest", "refers_to", "packed")]
            for k in range(batch.num_rows):
                page_id, url, size, digest, refers_to, packed = (c[k].as_py() for c in columns)
                out.add(_packed(_page_record(page_id, url, None, size, digest, refers_to)) if packed is None else packed)
        out.finish()
        yield pa.RecordBatch.from_pylist(
            [{"archive": a, "bytes": b, "records": n} for a, b, n in out.done],
            pa.schema([("archive", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]),
        )

    rows = marked.select("r.page_id", "r.url", "size", "r.digest", "refers_to", body)
    return materialize(arrow_map(rows, run, MANIFEST), "manifest")


def record_ranges(manifest: DataFrame) -> DataFrame:
    """``archive, at, lengths``: slices of neighbouring records, from the archives' own
    directories and indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("at", pa.int64()), ("lengths", pa.list_(pa.int32()))])
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                fs, path = filesystem(archive)
                with fs.open_input_file(path) as source:
                    directory = ZipDirectory(source)
                    begins: dict[str, int] = {}
                    at, size = directory.stored("indexes/index.cdxj")
                    rest, slices, now = b"", [], None
                    for piece in range(at, at + size, INDEX_PIECE):
                        lines = (rest + directory.read(piece, min(INDEX_PIECE, at + size - piece))).split(b"\n")
                        rest = lines.pop()
                        for line in lines:
                            x = json.loads(line)
                            if x["member"] not in begins:
                                begins[x["member"]] = directory.stored(x["member"])[0]
                            where = begins[x["member"]] + x["offset"]
                            if now is None or where != now["at"] + now["bytes"] or now["bytes"] >= SLICE_BYTES:
                                now = {"archive": archive, "at": where, "bytes": 0, "lengths": []}
                                slices.append(now)
                            now["bytes"] += x["length"]
                            now["lengths"].append(x["length"])
                        if len(slices) > 1:
                            yield pa.RecordBatch.from_pylist([{k: s[k] for k in ("archive", "at", "lengths")} for s in slices[:-1]], schema)
                            slices = slices[-1:]
                    yield pa.RecordBatch.from_pylist([{k: s[k] for k in ("archive", "at", "lengths")} for s in slices], schema)

    return arrow_map(manifest.select("archive"), run, "archive string, at long, lengths array<int>")


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _page_of(urn: str) -> int | None:
    said = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(said) if said else None


def read_records(manifest: DataFrame, keep: Callable[[dict, dict, bytes], bool] | None = None) -> DataFrame:
    """``RECORD`` of every record of the archives. The digest of a response is computed from
    its payload and must be the one in its header; a revisit has that of the page it names."""
    spark = manifest.sparkSession
    ranges = record_ranges(manifest.repartition(shuffle_partitions(spark)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        schema = pa.schema([(n, pa.string() if n in ("payload_digest", "record_type", "url") else pa.int64()) for n in names])
        for batch in batches:
            for x in batch.to_pylist():
                fs, path = filesystem(x["archive"])
                with fs.open_input_file(path) as source:
                    source.seek(x["at"])
                    raw = io.BytesIO(source.read(sum(x["lengths"])))
                rows = []
                for length in x["lengths"]:
                    warc, http, payload = parse_record(gzip.decompress(raw.read(length)))
                    if keep is not None and not keep(warc, http, payload):
                        continue
                    revisit = warc["WARC-Type"] == "revisit"
                    digest = warc["WARC-Payload-Digest"].removeprefix("sha256:")
                    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {warc['WARC-Record-ID']} differs from its digest")
                    rows.append((
                        _page_of(warc["WARC-Record-ID"]), int(http["Content-Length"]), digest, warc["WARC-Type"],
                        _page_of(warc["WARC-Refers-To"]) if revisit else None, warc["WARC-Target-URI"],
                    ))
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    return arrow_map(ranges.repartition(shuffle_partitions(spark)), run, RECORD)


def op10_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", ["page_id", "url", "html"])
    return read_records(write_archives(pages, scratch_path(spark, "warc")))


OP10_SQL = """
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
    CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to,
  url
FROM f
"""
