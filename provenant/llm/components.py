"""Connected components of a graph that no single task could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import cut

#: Links to a partition of what is written, so that few links aren't many files.
LINKS = 100_000
#: More rounds than any graph of fewer than 2**60 nodes takes.
MOST_ROUNDS = 200


def components(links: DataFrame) -> DataFrame:
    """Columns node and root of links' nodes: root is the smallest node of node's component.

    links: columns a and b of one orderable type; direction, repeated links and loops don't matter, rows with a null are
    ignored. Alternates large-star and small-star steps, each a minimum per node and a join; nodes with many neighbours
    cost a partial aggregation and a join whose skewed side can be split. Nodes without a link to another are absent.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    parts, seen = max(2, -(-edges.count() // LINKS)), None  # rounds don't add links
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large.filter("u <> v").coalesce(parts), "large")
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = cut(small.unionByName(lower.select("u", F.col("m").alias("v"))).filter("u <> v").distinct().coalesce(parts), "small")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components haven't settled after {MOST_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
