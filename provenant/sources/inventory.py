"""Files as rows with their digests, what was taken from them, and manifests whose root says whether anything changed.

A manifest's root is that of a tree of hashes over the digests of paths, so it depends on names and contents alone, not on
partitions or the order of rows; and two trees are compared from their nodes down, so only files below nodes that differ
are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.sources.html_units import page_text

# The kinds of source files, and the ending of a digest's own file.
GLOB, SIDECAR = "*.{pdf,html,xml}", ".source.sha256"
#: Levels below the root, sixteen children a node: up to 65 536 lowest nodes.
DEPTH = 4


def scan(spark: SparkSession, root: str, glob: str = GLOB, recursive: bool = False) -> DataFrame:
    """path (below root), extension, size, sha256 and content of the files in a folder; hidden ones are left out.

    Content is a column like others: where it isn't used, it is digested within the JVM and goes no further. A file has to
    fit in a task.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/"
    path = F.expr(f"substring(path, locate('{base.replace(chr(39), chr(92) + chr(39))}', path) + {len(base)})")
    named = found.withColumn("path", path).filter(~F.substring_index("path", "/", -1).startswith("."))
    return named.select("path", F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("extension"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")


def extracts(files: DataFrame) -> DataFrame:
    """path, text, source_sha256 of the HTML and XML files among scan()ned ones; a text and its source's digest stay together."""

    @F.pandas_udf("string")
    def text(content):
        return content.map(lambda b: page_text(b.decode("utf-8", "ignore")), na_action="ignore")

    return files.filter(F.col("extension").isin("html", "xml")).select("path", text("content").alias("text"), F.col("sha256").alias("source_sha256"))


def sidecar(text: Column) -> Column:
    """The digest that a sidecar file's text begins with, in lower case; null if its first word is none."""
    return F.lower(F.nullif(F.regexp_extract(text, r"^\s*([0-9A-Fa-f]{64})(?:\s|$)", 1), F.lit("")))


def stale(extracted: DataFrame, files: DataFrame) -> DataFrame:
    """path, code of extracts (path, source_sha256) whose source is gone, has changed or isn't recorded. files: path, sha256."""
    now = files.select("path", F.col("sha256").alias("__now"))
    code = F.when(F.col("__now").isNull(), "gone").when(F.col("source_sha256").isNull(), "unrecorded").when(F.col("source_sha256") != F.col("__now"), "changed")
    return extracted.select("path", "source_sha256").join(now, "path", "left").select("path", code.alias("code")).filter("code is not null")


def tree(files: DataFrame, depth: int = DEPTH) -> DataFrame:
    """level, prefix, digest, files (long) of the nodes of a manifest (files: path, sha256; a path once), the root at level 0.

    A leaf is SHA-256 of path, a zero character and digest; it lies below the node that its path's own digest begins with. A
    node is SHA-256 of its children's digests in their order. Without files the root is that of an empty text.
    """
    leaf = files.select(F.left(F.sha2("path", 256), F.lit(depth)).alias("prefix"), F.sha2(F.concat("path", F.lit("\0"), "sha256"), 256).alias("digest"), F.lit(1).cast("long").alias("files"), F.sha2("path", 256).alias("place"))
    level = leaf.groupBy("prefix").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"]), ""), 256).alias("digest"), F.sum("files").alias("files"))
    whole = level.select(F.lit(depth).alias("level"), "prefix", "digest", "files")
    for n in range(depth - 1, 0, -1):
        level = level.groupBy(F.left("prefix", F.lit(n)).alias("up")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "digest"))), lambda x: x["digest"]), ""), 256).alias("digest"), F.sum("files").alias("files")).withColumnRenamed("up", "prefix")
        whole = whole.unionByName(level.select(F.lit(n).alias("level"), "prefix", "digest", "files"))
    root = level.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "digest"))), lambda x: x["digest"]), ""), 256).alias("digest"), F.coalesce(F.sum("files"), F.lit(0)).cast("long").alias("files"))
    return whole.unionByName(root.select(F.lit(0).alias("level"), F.lit("").alias("prefix"), "digest", "files"))


def changes(before: DataFrame, after: DataFrame, depth: int = DEPTH) -> DataFrame:
    """path, code of files that were added, removed or changed between two manifests (path, sha256).

    Only files below lowest nodes whose digests differ are joined; there are at most 16 to the power of depth such nodes.
    """
    lowest = lambda df, name: tree(df, depth).filter(F.col("level") == depth).select("prefix", F.col("digest").alias(name))
    moved = lowest(before, "a").join(lowest(after, "b"), "prefix", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("prefix")
    near = lambda df, name: df.select("path", F.col("sha256").alias(name), F.left(F.sha2("path", 256), F.lit(depth)).alias("prefix")).join(moved, "prefix", "left_semi").drop("prefix")
    each = near(before, "a").join(near(after, "b"), "path", "full")
    code = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return each.select("path", code.alias("code")).filter("code is not null")


def checksum_lines(files: DataFrame) -> DataFrame:
    """line of each file, digest, two spaces and path, as checksum tools read them, in the order of paths."""
    return files.orderBy("path").select(F.concat_ws("  ", "sha256", "path").alias("line"))


def checksum_problems(lines: DataFrame, files: DataFrame) -> DataFrame:
    """path, code of checksum lines (line) against files (path, sha256): mismatch, absent or, of files without a line, unlisted."""
    told = lines.filter(F.contains("line", F.lit("  "))).select(F.regexp_replace("line", r"(?s)^.*?  ", "").alias("path"), F.substring_index("line", "  ", 1).alias("told"))
    each = told.join(files.select("path", "sha256"), "path", "full")
    code = F.when(F.col("sha256").isNull(), "absent").when(F.col("told").isNull(), "unlisted").when(F.col("told") != F.col("sha256"), "mismatch")
    return each.select("path", code.alias("code")).filter("code is not null")
