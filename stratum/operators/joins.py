"""Join helpers shared by the operators.

Join strategies are left to Spark: file statistics at planning time and AQE at run
time decide what is broadcast. Nothing here runs a job while a plan is built.

``matching_needles``: "does this needle occur as a substring of any haystack text?" as an
equi-join on short substrings, instead of a nested-loop join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Needles of at least this length meet the texts on one substring of this length.
GRAM = 8


def _substrings(text: Column, length: Column) -> Column:
    """All substrings of one length, in order; none where the text is shorter."""
    last = F.length(text) - length + 1
    return F.when(
        last >= 1, F.transform(F.sequence(F.lit(1), last), lambda p: F.substring(text, p, length))
    ).otherwise(F.array().cast("array<string>"))


def matching_needles(
    needles: DataFrame, needle_col: str, haystack: DataFrame, hay_col: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Distinct ``(keys..., needle)`` rows whose needle occurs as a substring of some
    haystack text with the same ``keys`` (NULL needles never match; an empty needle
    matches when any text exists for its keys).

    A text has postings: its number with each of its distinct substrings of ``GRAM``
    characters, and of those shorter lengths that some needle has (a subquery of the same plan;
    at most ``GRAM`` lengths). Postings are counted by substring before anything is joined, so
    that one that is in all texts is one row. A needle of up to ``GRAM`` characters is found if
    it is counted. A longer one is represented by one of its substrings, the one that fewest
    texts have, and meets the numbers of the texts that have it; a text itself is fetched once,
    by its number, to be compared. There is no limit on the number or length of needles.
    """
    keys = list(keys)
    n = needles.select(*keys, F.col(needle_col).alias("_needle")).where(F.col("_needle").isNotNull()).distinct()
    hay = haystack.select(*keys, F.col(hay_col).alias("_hay")).where(F.col("_hay").isNotNull()).distinct()
    # texts that share a number are both compared
    hay = hay.withColumn("_text", F.xxhash64(*keys, "_hay"))
    short, long = n.where(F.length("_needle") <= GRAM), n.where(F.length("_needle") > GRAM)
    lengths = short.where(F.length("_needle") < GRAM).select(F.array_sort(F.collect_set(F.length("_needle")))).scalar()
    grams = F.array_distinct(
        F.flatten(
            F.transform(
                F.array_append("_lengths", F.lit(GRAM)),
                # a substring of no characters is in every text
                lambda k: F.when(k == 0, F.array(F.lit(""))).otherwise(_substrings(F.col("_hay"), k)),
            )
        )
    )
    postings = hay.withColumn("_lengths", lengths).select(*keys, "_text", F.explode(grams).alias("_gram"))
    on = [*keys, "_gram"]
    counts = postings.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    found = short.withColumn("_gram", F.col("_needle")).join(counts, on, "left_semi").select(*keys, "_needle")
    # a substring that no text has rules its needle out
    rarest = (
        long.select(*keys, "_needle", F.explode(F.array_distinct(_substrings(F.col("_needle"), F.lit(GRAM)))).alias("_gram"))
        .join(counts, on, "left")
        .groupBy(*keys, "_needle")
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_r"))
        .where("_r.n > 0")
        .select(*keys, "_needle", F.col("_r.gram").alias("_gram"))
    )
    pairs = postings.join(rarest, on).select(*keys, "_needle", "_text")
    compared = pairs.join(hay, [*keys, "_text"]).where(F.contains("_hay", "_needle")).select(*keys, "_needle").distinct()
    return found.unionByName(compared).withColumnRenamed("_needle", needle_col)


def contains_any(
    needles: DataFrame,
    needle_col: str,
    haystack: DataFrame,
    hay_col: str,
    keys: Sequence[str] = (),
    out_col: str = "matched",
) -> DataFrame:
    """Every distinct ``(keys..., needle)`` with ``out_col`` = it occurs in some haystack
    text with the same keys (see ``matching_needles``)."""
    keys = list(keys)
    n = needles.select(*keys, needle_col).where(F.col(needle_col).isNotNull()).distinct()
    hits = matching_needles(n, needle_col, haystack, hay_col, keys)
    return n.join(hits.withColumn("_hit", F.lit(True)), keys + [needle_col], "left").select(
        *keys, needle_col, F.coalesce("_hit", F.lit(False)).alias(out_col)
    )
