"""Document fingerprints: a homomorphic multiset hash of a document's paragraphs.

A paragraph is a ``\\n``-separated line. Each paragraph is hashed to one wide vector:

* ``EXACT_LANES`` lanes of 32 bits, the SHA-512 of the paragraph, for equality;
* ``LIKE_LANES`` lanes that count, over the paragraph's pieces (up to ``PIECE`` characters
  between sentence marks), the one-bits of two 64-bit hashes of the piece, for likeness;
* the number of pieces.

A document's fingerprint is the sum of its paragraphs' vectors modulo powers of two
(2^32 for the exact lanes, 2^31 for the others), so it does not depend on the order of
the paragraphs, and a paragraph is inserted or deleted by adding or subtracting its
vector (:func:`combine`). With ``c`` ones in a lane and ``n`` pieces, ``2c - n`` is a sum
of random signs per piece; the inner product of two such vectors estimates the number of
common pieces, hence the likeness ``2 a.b / (a.a + b.b)`` (Dice), clipped to 0..1, with a
standard error of about 0.09.

Everything is DataFrame functions; no Python runs on the executors.

Defined cases: a NULL text is the empty text (one empty paragraph, no piece); texts
without a piece have likeness 1 to an equal text and 0 to any other; rows that share a
``doc_id`` are ordered by text, equal rows are interchangeable, so each gets its own
result row; a NULL ``doc_id`` comes last; a table of one row is its own next document; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratum.llm.common import range_buckets, table

EXACT_LANES = 16
_WORDS = 31  # each 64-bit hash fills so many sums, two lanes in each
_HASHES = 2
LIKE_LANES = 2 * _WORDS * _HASHES
PIECE = 48
_LOW = (1 << 31) - 1
_CHUNK = 127  # hashes whose ones fit a byte each, the highest without its sign
_BYTES = 0x0101010101010101


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _shift(x: Column, bits: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, bits)


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def _packed_lanes(hashes: Column) -> Column:
    """Packed pairs of lanes of an array of hashes: word ``i`` counts bit ``i`` and bit ``i + 31``.
    Up to ``_CHUNK`` hashes are counted in eight sums of eight one-byte counts, then spread."""

    def of_chunk(chunk: Column) -> Column:
        sums = F.transform(_numbers(8), lambda i: F.aggregate(
            chunk, F.lit(0).cast("bigint"), lambda s, h: s + _shift(h, i).bitwiseAND(F.lit(_BYTES))
        ))

        def ones(by: Column, bit: Column) -> Column:
            return _shift(F.get(by, bit.bitwiseAND(F.lit(7))), bit.bitwiseAND(F.lit(-8))).bitwiseAND(F.lit(255).cast("bigint"))

        return _let(sums, lambda by: F.transform(_numbers(_WORDS), lambda i: ones(by, i).bitwiseOR(F.shiftleft(ones(by, i + _WORDS), _WORDS))))

    chunks = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(hashes) / _CHUNK).cast("int")), lambda c: F.slice(hashes, c * _CHUNK + 1, _CHUNK)
    )
    none = F.array_repeat(F.lit(0).cast("bigint"), _WORDS)
    return F.aggregate(chunks, none, lambda total, chunk: F.zip_with(total, of_chunk(chunk), lambda x, y: x + y))


def paragraph_vector(body: Column) -> Column:
    """Struct of ``exact array<bigint>``, ``like array<bigint>`` (packed pairs of lanes) and
    ``pieces bigint``, summed over the paragraphs of one body.

    Arrays inside the row: an aggregate of 79 sums is one generated method of nearly the size
    limit of the JVM's compiler, in whose memory it shows. The row's pieces are held at once."""
    exact = F.aggregate(
        F.split(body, "\n"),
        F.array_repeat(F.lit(0).cast("bigint"), EXACT_LANES),
        lambda total, par: _let(F.sha2(par, 512), lambda d: F.zip_with(
            total, _numbers(EXACT_LANES),
            lambda x, i: (x + F.conv(F.substring(d, i * 8 + 1, F.lit(8)), 16, 10).cast("bigint")).bitwiseAND(F.lit((1 << 32) - 1)),
        )),
    )
    # a piece ends with its paragraph
    pieces = F.regexp_extract_all(body, F.lit(f"[^.!?\n]{{1,{PIECE}}}"), F.lit(0))

    def hashed(found: Column, seed: int) -> Column:
        return F.transform(found, lambda x: F.xxhash64(x, F.lit(seed)))

    def vector(found: Column) -> Column:
        like = [_let(hashed(found, seed), _packed_lanes) for seed in range(_HASHES)]
        return F.struct(exact.alias("exact"), F.concat(*like).alias("like"), F.size(found).cast("bigint").alias("pieces"))

    return F.when(body.isNotNull(), _let(pieces, vector))


def paragraph_sums(bodies: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Per ``keys``: ``exact array<bigint>``, ``like array<bigint>`` (packed pairs of lanes)
    and ``pieces bigint``, summed over the paragraphs of every body."""
    vectors = bodies.where(F.col(body).isNotNull()).select(*keys, paragraph_vector(F.col(body)).alias("_v"))
    lanes = vectors.select(*keys, F.posexplode(F.concat("_v.exact", "_v.like", F.array("_v.pieces"))).alias("_at", "_n"))
    totals = lanes.groupBy(*keys, "_at").agg(F.sum("_n").alias("_n")).groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_at", "_n"))), lambda x: x["_n"]).alias("_all")  # 79 each
    )
    return totals.select(
        *keys,
        F.transform(F.slice("_all", 1, EXACT_LANES), lambda x: x.bitwiseAND(F.lit((1 << 32) - 1))).alias("exact"),
        F.slice("_all", EXACT_LANES + 1, _WORDS * _HASHES).alias("like"),
        F.element_at("_all", -1).alias("pieces"),
    )


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the multiset union (``sign`` 1) or difference (-1) of two documents'
    paragraphs; ``a`` and ``b`` are structs of ``exact, like, pieces``."""
    low, high = F.lit(_LOW), F.lit(_LOW << 31)

    def lanes(x: Column, y: Column) -> Column:
        lower = (x.bitwiseAND(low) + sign * y.bitwiseAND(low)).bitwiseAND(low)
        upper = (F.shiftrightunsigned(x, 31) + sign * F.shiftrightunsigned(y, 31)).bitwiseAND(low)
        return F.shiftleft(upper, 31).bitwiseAND(high).bitwiseOR(lower)

    return F.struct(
        F.zip_with(a["exact"], b["exact"], lambda x, y: (x + sign * y).bitwiseAND(F.lit((1 << 32) - 1))).alias("exact"),
        F.zip_with(a["like"], b["like"], lanes).alias("like"),
        (a["pieces"] + sign * b["pieces"]).alias("pieces"),
    )


def digest(v: Column) -> Column:
    """The fingerprint as hex text: exact lanes, packed like lanes, pieces."""
    return F.lower(F.concat(
        F.array_join(F.transform(v["exact"], lambda x: F.lpad(F.hex(x), 8, "0")), ""),
        F.array_join(F.transform(v["like"], lambda x: F.lpad(F.hex(x), 16, "0")), ""),
        F.lpad(F.hex(v["pieces"]), 8, "0"),
    ))


def _dot(a: Column, b: Column) -> Column:
    def lane(x: Column, n: Column, shift: int) -> Column:
        return (2 * F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(_LOW)) - n).cast("double")

    terms = F.zip_with(
        a["like"], b["like"],
        lambda x, y: lane(x, a["pieces"], 0) * lane(y, b["pieces"], 0) + lane(x, a["pieces"], 31) * lane(y, b["pieces"], 31),
    )
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common pieces of two fingerprints, 0 to 1; 1 if they are equal."""
    norms = _dot(a, a) + _dot(b, b)
    share = F.when(norms > 0, 2 * _dot(a, b) / norms).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, own, next_text, next``: each row with the text of the next document in
    descending ``doc_id`` (after the last: the first), and the :func:`paragraph_vector` of both,
    each text's computed once. One shuffle of the texts, by ranges of
    ``doc_id``; the first text of each range is copied to the end of the range before it."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("bucket", range_buckets(docs.select("doc_id"), "doc_id"))
    first = rows.groupBy("bucket").agg(F.max("doc_id").alias("doc_id"))  # at most MAX_BUCKETS rows
    by_order = Window.orderBy("bucket")  # of at most MAX_BUCKETS rows
    target = first.select(
        "bucket", "doc_id", F.coalesce(F.lead("bucket").over(by_order), F.min("bucket").over(Window.partitionBy())).alias("to")
    ).alias("f")
    heads = (
        rows.alias("r")
        .join(F.broadcast(target), (F.col("r.bucket") == F.col("f.bucket")) & F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")))
        .groupBy(F.col("f.to").alias("bucket"))
        .agg(F.min("text").alias("text"))
        .select(F.lit(None).cast("bigint").alias("doc_id"), "text", "bucket", F.lit(True).alias("copied"))
    )
    w = Window.partitionBy("bucket").orderBy("copied", F.col("doc_id").desc_nulls_last(), "text")
    return (
        rows.withColumn("copied", F.lit(False))
        .unionByName(heads)
        .repartition("bucket")
        .withColumn("own", paragraph_vector(F.col("text")))  # after the shuffle, before the window
        .withColumns({"next_text": F.lead("text").over(w), "next": F.lead("own").over(w)})
        .filter(~F.col("copied"))
        .select("doc_id", "text", "own", "next_text", "next")
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, n_pieces`` (see the module docstring)."""
    linked = with_next(docs)
    n = F.length("text").cast("bigint")
    half = F.floor(n / 2).cast("int")
    prepared = linked.select(
        "doc_id",
        n.alias("n_chars"),
        F.concat(F.substring(F.col("text"), F.lit(1), n.cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"),
        "own",
        "next",
    )
    return (
        prepared.select(
            "doc_id",
            "n_chars",
            F.sha2("edited", 256).alias("edited_sha256"),
            "own",
            paragraph_vector(F.col("edited")).alias("edited"),
            "next",
        )
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            digest(F.col("own")).alias("fingerprint"),
            digest(F.col("edited")).alias("edited_fingerprint"),
            likeness(F.col("own"), F.col("edited")).alias("near_edited"),
            likeness(F.col("own"), F.col("next")).alias("near_next"),
            F.col("own")["pieces"].alias("n_pieces"),
        )
    )


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents", ["doc_id", "text"]))
