"""The claim graph: what underpins a claim, what a conclusion rests on, shared premises."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.sources.scratch import stored

#: More steps than any chain of claims has.
MOST_STEPS = 1000


def underpins(edges: DataFrame) -> DataFrame:
    """lower, upper: supports goes from source to target, depends-on the other way; others and nulls are left out."""
    ends = F.when(F.col("type") == "supports", F.struct(F.col("source").alias("lower"), F.col("target").alias("upper"))).when(F.col("type") == "depends-on", F.struct(F.col("target").alias("lower"), F.col("source").alias("upper")))
    return edges.select(ends.alias("e")).select("e.*").dropna().distinct()


def closure(under: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """node, ancestor (and blocked): all that a node rests on; a node on a cycle rests on itself.

    Semi-naive: each step joins only what the last one found, and adds only that. With blocked (column blocked), paths
    through each blocked node are cut, for all of them at once. Steps are cut by checkpoint(), so none depends on lost
    executors. On a cluster, spark.checkpoint.dir must name a shared folder.
    """
    spark = under.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp())
    keys = ["node", "ancestor"]
    known = under.select(F.col("upper").alias("node"), F.col("lower").alias("ancestor"))
    step = under.select(F.col("upper").alias("via"), F.col("lower").alias("next"))
    if blocked is not None:
        keys.append("blocked")
        known = known.join(blocked, "node")
    known = fresh = known.distinct().checkpoint()
    for _ in range(MOST_STEPS):
        onward = fresh.filter("ancestor <> blocked") if blocked is not None else fresh
        found = onward.join(step, F.col("ancestor") == F.col("via")).drop("ancestor", "via").withColumnRenamed("next", "ancestor").select(*keys).distinct()
        fresh = found.join(known, keys, "left_anti").checkpoint()
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)  # of checkpoints: what was found before isn't written again
    raise ValueError("a chain of claims is too long")


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """node of all that edges (node, next) lead to from start (node), start included.

    Each step follows only the edges of what the last one found, so every edge is followed once; steps are written to the
    shared folder.
    """
    step = stored(edges.select("node", "next").distinct(), "edges")
    known = fresh = stored(start.select("node").distinct(), "reached")
    while not fresh.isEmpty():
        found = fresh.join(step, "node").select(F.col("next").alias("node")).distinct()
        fresh = stored(found.join(known, "node", "left_anti"), "reached")
        known = known.unionByName(fresh)
    return known


def cuts(under: DataFrame) -> DataFrame:
    """node, cut: ancestors without which some other ancestor no longer reaches the node.

    A cut always parts the node from one of the nodes right below the cut: were each of these reached some other way, so
    would be all below them. So only ancestors with something below are tried, and only what is right below is compared.
    """
    all_ = closure(under)
    below = under.select(F.col("upper").alias("blocked"), F.col("lower").alias("ancestor")).filter("blocked <> ancestor")
    candidates = all_.select("node", F.col("ancestor").alias("blocked")).filter("node <> blocked").join(below, "blocked", "left_semi")
    without = closure(under, candidates)
    return candidates.join(below, "blocked").join(without, ["node", "ancestor", "blocked"], "left_anti").select("node", F.col("blocked").alias("cut")).distinct()


def load_bearing(edges: DataFrame) -> DataFrame:
    """node, in_degree, grounding_degree, total: edges into a node and edges it grounds."""
    into = edges.filter("target is not null").select(F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("g"))
    ground = edges.filter("grounding is not null").select(F.col("grounding").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("g"))
    return into.unionByName(ground).groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("g").alias("grounding_degree"), F.count(F.lit(1)).alias("total"))


def structure_problems(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """source, target, code: targets that no claim is, and pairs both supported and rebutted."""
    dangling = edges.join(claims.select(F.col("claim").alias("target")), "target", "left_anti").select("source", "target", F.lit("dangling").alias("code"))
    both = edges.groupBy("source", "target").agg(F.bool_or(F.col("type") == "supports").alias("s"), F.bool_or(F.col("type") == "rebuts").alias("r")).filter("s and r")
    return dangling.unionByName(both.select("source", "target", F.lit("contradiction").alias("code")))


def double_count(supports: DataFrame, correlated: DataFrame) -> DataFrame:
    """target, lo, hi, kind: two supporters of one target whose pair is declared correlated. correlated: lo, hi, kind."""
    side = lambda n: supports.select("target", F.col("source").alias(n)).distinct()
    # From the declared pairs, so supporters of one claim are never paired among themselves.
    return correlated.filter("lo < hi").join(side("lo"), "lo").join(side("hi"), ["hi", "target"]).select("lo", "hi", "target", "kind")


def coverage(edges: DataFrame, records: DataFrame) -> DataFrame:
    """Adds covering: the record an edge names if it covers it, else the least that does, else null."""
    ids = records.groupBy("target", "grounding").agg(F.collect_set("id").alias("ids"))
    joined = edges.join(ids, ["target", "grounding"], "left")
    return joined.withColumn("covering", F.when(F.col("rec").isNotNull(), F.when(F.array_contains("ids", F.col("rec")), F.col("rec"))).otherwise(F.array_min("ids"))).drop("ids")
