"""Whether quotes lie within the units that their claims name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.functions import text as X


def problems(claims: DataFrame, manifests: DataFrame, units: DataFrame) -> DataFrame:
    """key, locus, problem, hard: what is wrong with claims' loci; soft where the manifest isn't fully enumerable.

    claims: key, locus, quote, stamp; those without a locus are left out. manifests: key, source_sha256, fully_enumerable
    (null: true), one a key. units: key, locus, text, one a key and locus. Loci are equal whatever their case. Problems of
    a whole file have no locus: no manifest, or one of other bytes than the stamp's, where both are there.
    """
    named = claims.filter("locus <> ''").select("key", F.lower("locus").alias("locus"), "quote", "stamp")
    files = named.select("key", "stamp").distinct()
    whole = manifests.select("key", F.col("source_sha256").alias("source"), F.coalesce("fully_enumerable", F.lit(True)).alias("hard"))
    none = F.lit(None).cast("string").alias("locus")
    absent = files.select("key").distinct().join(whole, "key", "left_anti").select("key", none, F.lit("no manifest").alias("problem"), F.lit(True).alias("hard"))
    other = files.filter("stamp <> ''").join(whole.filter("source <> ''"), "key").filter("stamp <> source").select("key", none, F.lit("other bytes").alias("problem"), "hard").distinct()
    parts = units.select("key", F.lower("locus").alias("locus"), F.coalesce("text", F.lit("")).alias("unit"))
    each = named.join(whole, "key").join(parts, ["key", "locus"], "left")
    problem = F.when(F.col("unit").isNull(), "unknown locus").when(F.col("quote").isNull(), "no quote").when(~F.contains(X.norm(F.col("unit")), X.norm(F.col("quote"))), "outside")
    wrong = each.select("key", "locus", problem.alias("problem"), "hard").filter("problem IS NOT NULL")
    return absent.unionByName(other).unionByName(wrong)
