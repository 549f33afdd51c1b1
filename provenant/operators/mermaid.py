"""The claim graph as lines of a Mermaid diagram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _id(name):
    return F.concat(F.lit("n_"), F.regexp_replace(name, r"[^\p{L}\p{N}]", "_"))


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """part (0 head, 1 nodes, 2 edges), line. The diagram is the lines in the order of part, then line.

    nodes: node, superseded (rounded where true). edges: source, target, type; rebuttals are dotted, and those without a source left out.
    """
    spark = nodes.sparkSession
    box = F.when(F.col("superseded"), F.concat(F.lit('(["'), "node", F.lit('"])'))).otherwise(F.concat(F.lit('["'), "node", F.lit('"]')))
    shown = nodes.select(F.lit(1).alias("part"), F.concat(F.lit("  "), _id(F.col("node")), box).alias("line"))
    arrow = F.concat(F.when(F.col("type") == "rebuts", "-.->").otherwise("-->"), F.lit("|"), "type", F.lit("|"))
    drawn = edges.filter("source <> ''").select(F.lit(2).alias("part"), F.concat(F.lit("  "), _id(F.col("source")), F.lit(" "), arrow, F.lit(" "), _id(F.col("target"))).alias("line"))
    return spark.range(1).select(F.lit(0).alias("part"), F.lit("graph TD").alias("line")).unionByName(shown).unionByName(drawn)
