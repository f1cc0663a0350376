"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import materialize, salted_join

#: Parts that a hub's edges are dealt into when they meet its minimum.
SALTS = 8


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``node, label`` for every node of ``edges(a long, b long)``; the label is the smallest
    node of the component. Each round hangs the neighbours of a node on the smallest one
    (first the larger neighbours, then the smaller) and is written to the shared folder;
    minima are pre-aggregated and a hub's edges are dealt into parts. The driver sees one
    count and one checksum a round."""
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, seen = materialize(now, "edges"), None
    for _ in range(max_rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if (state["n"], state["h"]) == seen or state["n"] == 0:
            break
        seen = (state["n"], state["h"])
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both, least, ["u"], "v", SALTS).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, least, ["u"], "v", SALTS).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
