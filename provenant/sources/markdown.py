"""Claim files: Markdown with flat frontmatter, parsed once into rows.

A file is one row (path, text); parsing runs per file in Arrow batches and everything after it is relational.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.functions import text as X

_CLAIM = re.compile(r"^##\s+claim\b", re.IGNORECASE)
_FIELD = re.compile(r"^\s*\*\*([A-Za-z-]+):\*\*\s*(.*)$")
_FENCE = ("```", "~~~")
CLAIMS = "key string, frontmatter map<string,string>, ordinal int, header string, text string, quotes array<string>, fields array<struct<name:string,value:string,line:int>>"


def frontmatter(lines: list[str]) -> tuple[dict[str, str], int]:
    """Fields of the block that a first line of three dashes opens, the last of equal names; and where the body starts."""
    if not lines or lines[0].strip() != "---":
        return {}, 0
    found = {}
    for i, line in enumerate(lines[1:], 1):
        if line.strip() == "---":
            return found, i + 1
        name, colon, value = line.partition(":")
        if colon and re.fullmatch(r"[A-Za-z_][\w-]*", name.strip()):
            found[name.strip()] = value.strip()
    return found, len(lines)


def blocks(lines: list[str], first: int) -> Iterator[dict]:
    """Claim blocks: header to next header. Fenced lines are neither headers nor fields; quoted ones aren't fields."""
    now, fenced = None, False
    for i in range(first, len(lines)):
        line = lines[i]
        fence = line.lstrip().startswith(_FENCE)
        if not fenced and not fence and re.match(r"^##\s+\S", line):
            if now:
                yield now
            now = {"header": line, "claim": bool(_CLAIM.match(line)), "lines": [line], "fields": [], "quotes": []}
        elif now:
            now["lines"].append(line)
            if line.startswith(">"):
                now["quotes"].append(line)
            elif not fenced and not fence and (m := _FIELD.match(line)):
                now["fields"].append({"name": m[1], "value": m[2].strip(), "line": i + 1})
        fenced ^= fence
    if now:
        yield now


def read_files(spark: SparkSession, glob: str) -> DataFrame:
    """key (file stem in lower case) and text of files, templates left out; a file without a byte has no row, as Spark passes it over."""
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1)
    return spark.read.text(glob, wholetext=True).select(stem.alias("stem"), F.col("value").alias("text")).filter("stem <> 'TEMPLATE'").select(F.lower("stem").alias("key"), "text")


def claims(files: DataFrame) -> DataFrame:
    """A row for each claim of files (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = (text or "").splitlines()
                front, start = frontmatter(lines)
                n = 0
                for b in blocks(lines, start):
                    if b["claim"]:
                        n += 1
                        out.append({"key": key, "frontmatter": list(front.items()), "ordinal": n, "header": b["header"], "text": "\n".join(b["lines"]).rstrip() + "\n", "quotes": b["quotes"], "fields": b["fields"]})
            schema = pa.schema([("key", pa.string()), ("frontmatter", pa.map_(pa.string(), pa.string())), ("ordinal", pa.int32()), ("header", pa.string()), ("text", pa.string()), ("quotes", pa.list_(pa.string())), ("fields", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string()), ("line", pa.int32())])))])
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return files.select("key", "text").mapInArrow(run, CLAIMS)


def aliases(parsed: DataFrame) -> DataFrame:
    """Names that resolve to a claim: its ordinal cN and each of its ids, in lower case."""
    ids = F.transform(F.filter("fields", lambda f: F.lower(f["name"]) == "id"), lambda f: F.lower(f["value"]))
    both = parsed.select("key", "ordinal", ids.alias("ids")).select("key", "ordinal", "ids", F.explode(F.array_union(F.array(F.concat(F.lit("c"), F.col("ordinal").cast("string"))), "ids")).alias("alias"))
    return both.select("key", "alias", F.array_contains("ids", F.col("alias")).alias("is_slug"), "ordinal")


def bodies(files: DataFrame) -> DataFrame:
    """key, frontmatter and body of each file: its lines below the frontmatter, each with a line feed; nothing if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            split = [(t or "").splitlines() for t in texts]
            parts = [frontmatter(lines) for lines in split]
            below = ["\n".join(lines[start:]) for lines, (_, start) in zip(split, parts, strict=True)]
            columns = [pa.array(keys, pa.string()), pa.array([list(f.items()) for f, _ in parts], pa.map_(pa.string(), pa.string())), pa.array([b.rstrip("\n") + "\n" if b.strip("\n") else "" for b in below], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "frontmatter", "body"])

    return files.select("key", "text").mapInArrow(run, "key string, frontmatter map<string,string>, body string")


def lines(files: DataFrame) -> DataFrame:
    """key, line (from 1) and text of every line, fenced and quoted ones too."""
    each = files.select("key", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\R")).alias("at", "text"))
    return each.select("key", (F.col("at") + 1).alias("line"), "text")


def edges(files: DataFrame) -> DataFrame:
    """Edges of claim files: from_key, line, type, source, target, grounding, rec; addresses are qualified by the file's key.

    Every line counts, within fences as well. source is the grounding claim, null if the edge names none.
    """
    each = lines(files).filter(F.ltrim("text").startswith("**")).select("key", "line", X.edge(F.col("text")).alias("e")).filter("e.type is not null")
    own = lambda a: F.when(F.instr(a, ":") > 0, a).otherwise(F.concat_ws(":", "key", a))
    source = F.when(F.col("e.grounding").isNotNull(), F.concat_ws(":", "key", "e.grounding"))
    return each.select(F.col("key").alias("from_key"), "line", "e.type", source.alias("source"), own(F.col("e.target")).alias("target"), "e.grounding", "e.rec")


def field(parsed: DataFrame, *names: str) -> DataFrame:
    """key, ordinal, ids, name, value, line of claims' fields of these names, in lower case; ids are those of the claim."""
    ids = F.transform(F.filter("fields", lambda f: F.lower(f["name"]) == "id"), lambda f: F.lower(f["value"]))
    each = parsed.select("key", "ordinal", ids.alias("ids"), F.explode("fields").alias("f"))
    return each.select("key", "ordinal", "ids", F.lower("f.name").alias("name"), "f.value", "f.line").filter(F.col("name").isin(*names))
