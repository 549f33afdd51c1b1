"""Whether the pages of a bundle hold together: links that lead nowhere, assets from elsewhere, pages that no link leads to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.operators.graph import reachable

# Links in attributes, places that anchors name, schemes, and what loads an asset from another host.
ATTRIBUTE_URL = r"""(?i)(?:href|src)\s*=\s*["']([^"']+)["']"""
ANCHOR = r"""(?i)\s(?:id|name)\s*=\s*["']([^"']+)["']"""
SCHEME = "(?i)^[a-z][a-z0-9+.-]*:"
REMOTE = r"""(?i)<script\b[^>]*\bsrc\s*=\s*["']\s*(?:https?:)?//|<link\b[^>]*\bhref\s*=\s*["']\s*(?:https?:)?//|\burl\(\s*["']?\s*(?:https?:)?//|@import\s+["']\s*(?:https?:)?//|\bfetch\(\s*["']\s*(?:https?:)?//"""


def _plain(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def external(url: Column) -> Column:
    """Whether a link names another place altogether, or only a part of its own page."""
    plain = _plain(url)
    return (plain == "") | plain.startswith("//") | plain.rlike(SCHEME)


def resolved(base: Column, url: Column) -> Column:
    """path of what a relative link on the page base (a path without a leading slash) leads to, fragment and outside, as a struct.

    Queries are dropped. A link that starts with a slash counts from the bundle's root. Dot segments are taken away one
    after the other; outside tells that they lead above the root, and path is then what is left.
    """
    plain = _plain(url)
    whole = F.when(plain.startswith("/"), F.substring(plain, F.lit(2), F.length(plain))).otherwise(F.concat(F.regexp_replace(base, "[^/]*$", ""), plain))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("outside"))

    def step(at: Column, part: Column) -> Column:
        up = part == ".."
        above = up & (F.size(at["kept"]) == 0)
        kept = F.when(above | (part == ".") | (part == ""), at["kept"]).when(up, F.slice(at["kept"], F.lit(1), F.greatest(F.size(at["kept"]) - 1, F.lit(0)))).otherwise(F.concat(at["kept"], F.array(part)))
        return F.struct(kept.alias("kept"), (at["outside"] | above).alias("outside"))

    done = F.aggregate(F.split(whole, "/"), start, step)
    return F.struct(F.array_join(done["kept"], "/").alias("path"), F.nullif(F.regexp_extract(url, "#(.*)$", 1), F.lit("")).alias("fragment"), done["outside"].alias("outside"))


def links(files: DataFrame) -> DataFrame:
    """bundle, path, url, to, fragment, outside of every different relative link of files (bundle, path, html)."""
    each = files.select("bundle", "path", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(ATTRIBUTE_URL), F.lit(1)))).alias("url")).filter(~external(F.col("url")))
    return each.withColumn("r", resolved(F.col("path"), F.col("url"))).select("bundle", "path", "url", F.col("r.path").alias("to"), "r.fragment", "r.outside").distinct()


def places(files: DataFrame) -> DataFrame:
    """bundle, place of files (bundle, path) and the folders above them, of which the root is empty."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return files.select("bundle", F.explode(above).alias("place")).distinct()


def problems(files: DataFrame, index: DataFrame) -> DataFrame:
    """bundle, path, code, detail of what is wrong with bundles: files (bundle, path, html), index (bundle, path of its first pages).

    dead: a link to no file or folder of the bundle. outside: one that leads above its root. no anchor: one to a part that its
    page hasn't. remote: a page that loads an asset from another host. unreachable: a page that no chain of links from the
    index leads to. Links to other places aren't followed. Null pages have no links; files of one path count as one.
    """
    c = F.col
    each = links(files)
    inside = each.filter("not outside")
    there = places(files).withColumnRenamed("place", "to")
    dead = inside.join(there, ["bundle", "to"], "left_anti")
    anchors = files.select("bundle", c("path").alias("to"), F.explode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1))).alias("fragment")).distinct()
    own = files.select("bundle", c("path").alias("to")).distinct()
    loose = inside.filter("fragment is not null").join(own, ["bundle", "to"], "left_semi").join(anchors, ["bundle", "to", "fragment"], "left_anti")
    far = files.filter(c("html").rlike(REMOTE)).select("bundle", "path").distinct()
    node = lambda name: F.struct("bundle", c(name).alias("path"))
    led = reachable(inside.select(node("path").alias("node"), node("to").alias("next")), index.select(F.struct("bundle", "path").alias("node")))
    lost = own.select("bundle", c("to").alias("path")).withColumn("node", F.struct("bundle", "path")).join(led, "node", "left_anti")
    told = lambda df, code, detail: df.select("bundle", "path", F.lit(code).alias("code"), detail.cast("string").alias("detail"))
    none = F.lit(None)
    return reduce(DataFrame.unionByName, [told(dead, "dead", c("url")), told(each.filter("outside"), "outside", c("url")), told(loose, "no anchor", c("url")), told(far, "remote", none), told(lost, "unreachable", none)])


def ceiling_problems(levels: DataFrame) -> DataFrame:
    """name of packs (name, level) that claim to be reproducible, though no source ships with a bundle."""
    return levels.filter("level = 'reproducible'").select("name")
