"""Texts under ids, such as records and claim files, that change only where a writer has seen what it changes.

A change names the digest of the text that it was made from. Where the stored text has another one by now, the change is
refused, so no writer undoes what another has written. New partitions are staged in full before they take the place of
old ones, and only partitions in which something changes are written.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.operators.records import RECORD_SEAL, digest
from provenant.sources.scratch import stored

#: Partitions of a store; each holds the ids of one hash.
PARTS = 64


def _placed(rows: DataFrame, parts: int) -> DataFrame:
    return rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))


def create(texts: DataFrame, path: str, parts: int = PARTS) -> None:
    """Writes a new store of texts (id, text; an id once)."""
    rows = _placed(texts.select("id", "text"), parts).withColumn("digest", F.sha2("text", 256))
    rows.repartition("part").write.partitionBy("part").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """id, text, digest, part of a store."""
    return spark.read.schema("id string, text string, digest string, part int").parquet(path)


def outcomes(now: DataFrame, changes: DataFrame) -> DataFrame:
    """id, text, outcome of changes (id, text, expected: the digest of the text they were made from, null for a new one) against now (id, digest).

    same: the text is there already. stale: another one is there, or none, than was expected. conflict: several changes of
    one id, none of which is made unless they agree. Else new or changed. Null ids and texts are invalid.
    """
    c = F.col
    each = changes.select("id", "text", "expected").distinct()
    many = each.groupBy("id").agg((F.count(F.lit(1)) > 1).alias("many"))
    found = each.join(many, "id").join(now.select("id", c("digest").alias("now")), "id", "left").unionByName(each.filter("id is null").select("*", F.lit(False).alias("many"), F.lit(None).cast("string").alias("now")))
    outcome = (
        F.when(c("id").isNull() | c("text").isNull(), "invalid").when(c("many"), "conflict").when(c("now") == F.sha2("text", 256), "same")
        .when(~c("now").eqNullSafe(c("expected")), "stale").when(c("now").isNull(), "new").otherwise("changed")
    )
    return found.select("id", "text", outcome.alias("outcome"))


def apply(spark: SparkSession, path: str, changes: DataFrame, parts: int = PARTS) -> DataFrame:
    """Makes those changes that outcomes() lets through, and returns id and outcome of each.

    A store has one writer at a time. Partitions are read where changes fall, staged in full in the shared folder, and then
    written over the old ones; a job that is lost before that has changed nothing, and applying changes again makes those
    that are left. Applied twice, changes change nothing the second time, and no partition is written.
    """
    asked = stored(_placed(changes.select("id", "text", "expected"), parts), "changes")
    touched = [r["part"] for r in asked.filter("part is not null").select("part").distinct().collect()]  # at most `parts`
    now = read(spark, path).filter(F.col("part").isin(touched))
    told = stored(_placed(outcomes(now, asked), parts), "outcomes")
    made = told.filter("outcome in ('new', 'changed')")
    moved = [r["part"] for r in made.select("part").distinct().collect()]
    if moved:
        kept = now.filter(F.col("part").isin(moved)).join(made.select("id"), "id", "left_anti")
        staged = stored(kept.select("id", "text", "digest", "part").unionByName(made.select("id", "text", F.sha2("text", 256).alias("digest"), "part")), "staged")
        staged.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return told.select("id", "outcome")


def _with_field(front: Column, name: str, line: Column) -> Column:
    """Frontmatter lines with line in place of the first of that name, or behind them."""
    at = F.array_position(F.transform(front, lambda x: F.regexp_extract(x, r"^([A-Za-z_][\w-]*)\s*:", 1)), F.lit(name)).cast("int")
    return F.when(at > 0, F.transform(front, lambda x, i: F.when(i + 1 == at, line).otherwise(x))).otherwise(F.concat(front, F.array(line)))


def upserted(text: Column, fields: dict[str, Column]) -> Column:
    """A claim file's text with frontmatter fields replaced where they stand, or added below the others; other lines stay.

    A text without frontmatter gets one, as does one whose frontmatter isn't closed. Of equal fields the first is replaced.
    """
    lines = F.split(F.regexp_replace(text, r"\R\z", ""), r"\R")
    opened = F.trim(F.get(lines, F.lit(0))) == "---"
    end = F.array_position(F.transform(F.slice(lines, F.lit(2), F.size(lines)), F.trim), F.lit("---")).cast("int")  # below the first line, from 1
    there = F.coalesce(opened & (end > 0), F.lit(False))
    front = F.when(there, F.slice(lines, F.lit(2), F.when(there, end - 1).otherwise(0))).otherwise(F.array().cast("array<string>"))
    rest = F.when(there, F.slice(lines, F.when(there, end + 2).otherwise(1), F.size(lines))).otherwise(F.when(text == "", F.array().cast("array<string>")).otherwise(lines))
    for name, value in fields.items():
        front = _with_field(front, name, F.concat(F.lit(f'{name}: "'), value, F.lit('"')))
    dash = F.array(F.lit("---"))
    return F.concat(F.array_join(F.concat(dash, front, dash, rest), "\n"), F.lit("\n"))


@F.pandas_udf(T.StringType())
def sealed_json(fields: pd.Series) -> pd.Series:
    """A record's JSON text as it is stored: its fields with its seal, sorted, and a line feed."""

    def row(text):
        value = json.loads(text)
        value[RECORD_SEAL] = digest(text)
        return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n"

    return fields.map(row, na_action="ignore")


def judgements(asked: DataFrame, claims: DataFrame, assessor: str, tool: str, version: str = "1") -> DataFrame:
    """id, text of records for judgements (id, kind, subject, grounding, span, disputes, reviews, assessed_date), sealed.

    claims: key, alias, body of every claim's names. A record is bound to its subject's body by digest, to none where the
    subject isn't there or names no file.
    """
    names = claims.select(F.concat_ws(":", "key", "alias").alias("__name"), F.sha2("body", 256).alias("__body")).dropDuplicates(["__name"])
    found = asked.join(names, F.lower(F.trim("subject")) == F.col("__name"), "left")
    none = F.array().cast("array<string>")
    flat = lambda name: F.coalesce(name, F.lit("")).alias(name)
    fields = F.struct("kind", "id", "subject", F.coalesce("grounding", none).alias("grounding"), flat("span"), F.coalesce("disputes", none).alias("disputes"), F.coalesce("reviews", none).alias("reviews"), "assessed_date", F.lit(assessor).alias("assessor"), F.lit(tool).alias("assessor_tool"), F.lit(version).alias("assess_version"), F.coalesce("__body", F.lit("")).alias("body_sha256"))
    return found.select("id", sealed_json(F.to_json(fields)).alias("text"))


def resealed(records: DataFrame, claims: DataFrame, assessor: str) -> DataFrame:
    """id, text, expected of changes that bind stored records (id, text, digest) to what their subjects say now; those that are bound already are left out."""
    names = claims.select(F.concat_ws(":", "key", "alias").alias("__name"), F.sha2("body", 256).alias("__body")).dropDuplicates(["__name"])
    each = records.select("id", "text", "digest", F.lower(F.trim(F.get_json_object("text", "$.subject"))).alias("__name"), F.get_json_object("text", "$.body_sha256").alias("__bound")).join(names, "__name", "left")
    moved = each.filter(~F.coalesce("__body", F.lit("")).eqNullSafe(F.col("__bound")))

    @F.pandas_udf("string")
    def bound(text: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series([json.dumps({**json.loads(t), "body_sha256": b, "assessor": assessor}) for t, b in zip(text, body, strict=True)], dtype=object)

    return moved.select("id", sealed_json(bound("text", F.coalesce("__body", F.lit("")))).alias("text"), F.col("digest").alias("expected"))
