"""Agreement and detection metrics; ratios aren't rounded and are null without a denominator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions import text as X
from provenant.sources import markdown


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def confusion(scored: DataFrame, *by: str) -> DataFrame:
    """From gold and verdict (boolean, verdict null if unscored): counts, recall, specificity, precision, accuracy."""
    on = F.col("verdict").isNotNull()
    count = lambda g, v: F.count_if(on & (F.col("gold") == g) & (F.col("verdict") == v))
    made = scored.groupBy(*by).agg(count(True, True).alias("tp"), count(False, True).alias("fp"), count(False, False).alias("tn"), count(True, False).alias("fn"), F.count_if(~on).alias("unscored"))
    c = F.col
    return made.withColumns({"recall": _ratio(c("tp"), c("tp") + c("fn")), "specificity": _ratio(c("tn"), c("tn") + c("fp")), "precision": _ratio(c("tp"), c("tp") + c("fp")), "accuracy": _ratio(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn"))})


def agreement(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """n_both, n_either and jaccard of two runs' distinct keys; of two empty runs 1."""
    both = a.select(*keys, F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(b.select(*keys, F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    each = both.groupBy(*keys).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    total = each.agg(F.count_if((F.col("in_a") == 1) & (F.col("in_b") == 1)).alias("n_both"), F.count(F.lit(1)).alias("n_either"))
    return total.withColumn("jaccard", F.coalesce(_ratio(F.col("n_both"), F.col("n_either")), F.lit(1.0)))


def residual(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, once, and which."""
    return a.subtract(b).withColumn("side", F.lit("a")).unionByName(b.subtract(a).withColumn("side", F.lit("b")))


def jaccard(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """shared, total and jaccard of two sets of keys (one row)."""
    return agreement(a, b, *keys).select(F.col("n_both").alias("shared"), F.col("n_either").alias("total"), "jaccard")


def quote_runs(files: DataFrame) -> DataFrame:
    """key, span: normal forms of files' quoted stretches, whose consecutive lines are one; empty ones are left out. files: key, text."""
    each = files.select("key", F.split(F.coalesce("text", F.lit("")), r"\R").alias("lines"))
    marked = F.expr("transform(lines, x -> if(x rlike '^\\\\s*>', regexp_replace(x, '^\\\\s*>\\\\s*|\\\\s+$', ''), null))")
    # Null lines part stretches: consecutive others are joined in one fold.
    fold = F.aggregate(marked, F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open")), lambda s, x: F.when(x.isNull(), F.struct(F.when(s["open"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["open"])).alias("done"), F.lit(None).cast("string").alias("open"))).otherwise(F.struct(s["done"].alias("done"), F.when(s["open"].isNull(), x).otherwise(F.concat(s["open"], F.lit(" "), x)).alias("open"))), lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["open"])))
    return each.select("key", F.explode(fold).alias("quote")).select("key", X.norm("quote").alias("span")).filter("span <> ''").distinct()


def run_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """measure, shared, total, value of two runs' claim files (key, text): locus, selection, claim, coverage and attribution.

    Loci are null where neither run has any; attribution is the part of shared slugs that both runs give to the same files,
    1 without shared ones.
    """
    sides = [(markdown.claims(x), x) for x in (a, b)]
    slugs = [markdown.field(p, "id").select("key", F.lower("value").alias("slug")).distinct() for p, _ in sides]
    loci = [markdown.field(p, "locus").select("key", F.lower(F.regexp_extract("value", r"(?U)^(\S+)", 1)).alias("locus")).distinct() for p, _ in sides]
    asked = [markdown.field(p, "addresses", "crux-of").select(F.lower(F.regexp_extract("value", r"(?U)^([\w-]+)", 1)).alias("qid")).filter("qid <> ''").distinct() for p, _ in sides]
    told = lambda name, df, value=F.col("jaccard"): df.select(F.lit(name).alias("measure"), "shared", "total", value.alias("value"))
    owners = [s.groupBy("slug").agg(F.array_sort(F.collect_set("key")).alias(f"keys_{i}")) for i, s in enumerate(slugs)]
    same = owners[0].join(owners[1], "slug").agg(F.count_if(F.col("keys_0") == F.col("keys_1")).alias("shared"), F.count(F.lit(1)).alias("total"))
    rows = [told("locus", jaccard(*loci, "key", "locus"), F.when(F.col("total") > 0, F.col("jaccard"))), told("selection", jaccard(quote_runs(a), quote_runs(b), "key", "span")), told("claim", jaccard(*slugs, "key", "slug")), told("coverage", jaccard(*asked, "qid"))]
    rows.append(told("attribution", same, F.coalesce(_ratio(F.col("shared"), F.col("total")), F.lit(1.0))))
    return reduce(DataFrame.unionByName, rows)
