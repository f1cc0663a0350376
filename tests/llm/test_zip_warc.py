import gzip
import hashlib
import io
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

from stratum.llm.zip_warc import OP10_SQL, StoredZipWriter, ZipDirectory, find_revisits, op10_zip_warc, parse_record, read_records, write_archives
from tests.conftest import SF_SMOKE
from tests.llm.helpers import duck_rows, spark_rows


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


class Sink(io.BytesIO):
    def close(self):
        self.done = self.getvalue()


def packed(members, zip64):
    sink = Sink()
    z = StoredZipWriter(sink, zip64)
    for name, parts in members.items():
        z.begin(name)
        for part in parts:
            z.write(part)
        z.end()
    z.close()
    return sink.done


MEMBERS = {"a.txt": [b"one", b"", b"two"], "dir/ü.bin": [bytes(range(256)) * 50], "empty": []}


@pytest.mark.parametrize("zip64", [False, True])
def test_our_archives_are_zip_files(zip64):
    raw = packed(MEMBERS, zip64)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == {k: b"".join(v) for k, v in MEMBERS.items()}
    own = ZipDirectory(Source(raw))
    for name, parts in MEMBERS.items():
        at, size = own.stored(name)
        assert raw[at : at + size] == b"".join(parts)
    assert (b"PK\x06\x06" in raw) == zip64


def test_archives_of_another_writer():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.comment = b"a comment with PK\x05\x06 in it"
        z.writestr("plain", b"stored bytes")
        with z.open("forced", "w", force_zip64=True) as f:
            f.write(b"zip64 local header")
        z.writestr("packed", b"x" * 1000, zipfile.ZIP_DEFLATED)
    raw = buffer.getvalue()
    own = ZipDirectory(Source(raw))
    for name, want in (("plain", b"stored bytes"), ("forced", b"zip64 local header")):
        at, size = own.stored(name)
        assert raw[at : at + size] == want
    with pytest.raises(ValueError, match="compressed"):
        own.stored("packed")
    with pytest.raises(ValueError, match="not a ZIP"):
        ZipDirectory(Source(b"nothing"))


PAGES = "page_id long, url string, html string"


def test_records_come_back(spark):
    long = "<p>" + "é" * 60 + "</p>"  # 127 bytes
    rows = [
        (5, "u5", long), (3, "u3", long), (9, None, long), (1, "u1", "short"), (2, "u2", "short"), (4, "a\r\nb", None), (6, "u6", ""),
        (7, "u7", "x" * 99), (8, "u8", "x" * 99), (10, "u", "y" * 100), (11, "u", "y" * 100), (None, "n", long), (12, "big", "\r\n\r\nz" * 50_000),
    ]
    df = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("clash"))
    for options in ({}, {"archive_bytes": 400, "member_bytes": 300, "zip64": True}):
        manifest = write_archives(df, tempfile.mkdtemp(), **options)
        got = {r.page_id: r for r in read_records(manifest).collect()}
        assert len(got) == len(rows)
        for i, url, text in rows:
            payload = (text or "").encode()
            r = got[i]
            assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
            want = {5: 3, 9: 3, None: 3, 11: 10}.get(i)
            assert (r.record_type, r.refers_to) == (("revisit", want) if want else ("response", None))
        assert got[4].url == "a%0D%0Ab"
    assert manifest.count() > 1


def test_records_are_warc(spark):
    folder = tempfile.mkdtemp()
    (row,) = write_archives(spark.createDataFrame([(7, "http://x/", "<p>hi")], PAGES), folder).collect()
    with zipfile.ZipFile(row.archive) as z:
        raw = gzip.decompress(z.read("archive/data-00000.warc.gz"))
    warc, http, payload = parse_record(raw)
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n") and payload == b"<p>hi"
    assert warc["WARC-Target-URI"] == "http://x/" and http["Content-Length"] == "5"


def test_empty_table(spark):
    assert read_records(write_archives(spark.createDataFrame([], PAGES), tempfile.mkdtemp())).collect() == []


def test_query_matches_sql(spark):
    frame = spark.read.parquet(f"{SF_SMOKE}/pages.parquet").toPandas()
    assert spark_rows(op10_zip_warc(spark, SF_SMOKE)) == duck_rows(OP10_SQL, pages=frame)


def test_copies_of_one_payload_are_dealt_out(spark):
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = {x: spark.conf.get(x) for x in names}
    try:
        for name, value in zip(names, ("false", "-1"), strict=True):
            spark.conf.set(name, value)
        pages = spark.range(1, 301).select(F.col("id").alias("page_id"), F.lit("same payload " * 20).alias("html"))
        found = find_revisits(pages)
        joins = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
        assert joins and all("_salt" in x for x in joins)  # the digest alone would send all rows to one task
        digest = hashlib.sha256(b"same payload " * 20).hexdigest()
        assert sorted((r.page_id, r.digest, r.refers_to) for r in found.collect()) == [(i, digest, 1) for i in range(2, 301)]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
