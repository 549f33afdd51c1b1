"""Whether aliases of citation keys lead one way only, and to something real."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.sources.scratch import stored


def pairs(setting: Column) -> Column:
    """(alias, target) of a setting `alias -> target, ...`, in lower case and in its order; incomplete ones are left out, and a placeholder has none."""
    parts = F.transform(F.split(F.lower(setting), ","), lambda p: F.struct(F.trim(F.substring_index(p, "->", 1)).alias("alias"), F.trim(F.when(F.instr(p, "->") > 0, F.regexp_replace(p, "^.*?->", "")).otherwise("")).alias("target")))
    whole = F.filter(parts, lambda p: (p["alias"] != "") & (p["target"] != ""))
    return F.when(setting.isNull() | setting.startswith("<"), F.array().cast("array<struct<alias:string,target:string>>")).otherwise(whole)


def ends(links: DataFrame) -> DataFrame:
    """project, alias, end, steps (long) of links (project, alias, target; one for each alias): where following targets leads.

    A target that is no alias is an end, steps links away. Aliases that lead into a loop have no end and null steps, and
    loops tells if the alias is on the loop itself. Pointers are doubled: after k rounds each alias knows the place 2^k
    links on, so a chain of n takes about log2 n rounds. A round in which no chain ends leaves only those that lead into a
    loop, and when their places no longer become fewer, these places are just what is on loops. Stored columns of like names
    take little room, so Spark would take them to be small and send them whole through the driver; hints keep it from that.
    """
    c = F.col
    now = stored(links.select("project", "alias", c("target").alias("at"), F.lit(1).cast("long").alias("steps"), F.lit(False).alias("done")), "aliases")
    before = (-1, -1)
    while True:
        size = now.agg(F.count_if(~c("done")).alias("open"), F.countDistinct(F.when(~c("done"), F.struct("project", "at"))).alias("places")).first()
        if size["open"] == 0 or (size["open"], size["places"]) == before:
            break
        before = (size["open"], size["places"])
        onward = now.select("project", c("alias").alias("at"), c("at").alias("next"), c("steps").alias("more"), c("done").alias("over"))
        # Of places that are no alias, nothing is joined: they are ends.
        now = stored(now.filter("not done").join(onward.hint("merge"), ["project", "at"], "left").select("project", "alias", F.coalesce("next", "at").alias("at"), (c("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("over", F.lit(True)).alias("done")).unionByName(now.filter("done")), "aliases")
    ring = now.filter("not done").select("project", c("at").alias("alias")).distinct().withColumn("loops", F.lit(True))
    found = now.join(ring.hint("merge"), ["project", "alias"], "left")
    return found.select("project", "alias", F.when(c("done"), c("at")).alias("end"), F.when(c("done"), c("steps")).alias("steps"), F.coalesce("loops", F.lit(False)).alias("loops"))


def problems(aliases: DataFrame, real: DataFrame) -> DataFrame:
    """project, code, alias, detail of aliases (project, alias, target, in lower case) against the keys of claim files (real: project, key).

    duplicate: aliased more than once, detail how often; the least target counts. shadow: itself a key. missing: the target is
    no key, told only of projects that have keys, as nothing is known of others. chain: the target is an alias, which isn't
    followed; detail is where it would end. loop: on a circle of aliases; detail is its target. into loop: leads to one.
    Null or empty aliases and targets are none.
    """
    c = F.col
    each = aliases.select("project", "alias", "target").filter("alias <> '' and target <> ''")
    one = stored(each.groupBy("project", "alias").agg(F.min("target").alias("target"), F.count(F.lit(1)).alias("n")), "alias")
    keys = real.select("project", "key").distinct()
    told = lambda df, code, detail: df.select("project", F.lit(code).alias("code"), "alias", detail.cast("string").alias("detail"))
    twice = told(one.filter("n > 1"), "duplicate", c("n"))
    shadow = told(one.join(keys.withColumnRenamed("key", "alias").hint("merge"), ["project", "alias"], "left_semi"), "shadow", F.lit(None))
    lost = told(one.join(keys.select("project").distinct(), "project", "left_semi").join(keys.withColumnRenamed("key", "target").hint("merge"), ["project", "target"], "left_anti"), "missing", c("target"))
    led = ends(one).join(one.select("project", "alias", "target").hint("merge"), ["project", "alias"])
    code = F.when(c("loops"), "loop").when(c("end").isNull(), "into loop").when(c("steps") > 1, "chain")
    further = led.select("project", code.alias("code"), "alias", F.when(c("loops"), c("target")).otherwise(c("end")).alias("detail")).filter("code is not null")
    return twice.unionByName(shadow).unionByName(lost).unionByName(further)
