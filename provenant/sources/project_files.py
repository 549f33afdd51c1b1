"""The files of a project that aren't Markdown: judgement records, run records, cases and verdicts a line each, overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Endings of records' files, and what lines and tables hold.
RECORD_ENDING, RUN_ENDING = ".json", ".run.json"
CASES = "id string, case string, source_key string, slug string, quote string, inference string, gold string, rationale string"
VERDICTS = "id string, verdict string, rationale string"
OVERRIDES = "filename string, author string, year string, status string, reason string"


def _whole(spark: SparkSession, path: str, ending: str, column: str) -> DataFrame:
    name = F.col("_metadata.file_name")
    found = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(name.alias("name"), F.col("value").alias("record"), F.col("_metadata.file_path").alias("path"))
    return found.filter(F.col("name").endswith(ending)).select(F.expr(f"left(name, length(name) - {len(ending)})").alias(column), "record", "path")


def read_records(spark: SparkSession, path: str, ending: str = RECORD_ENDING) -> DataFrame:
    """stem, record (JSON) and path of the judgement records in a folder, each a file with that ending."""
    return _whole(spark, path, ending, "stem")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """key, record (JSON) and path of the run records in a folder, each a file."""
    return _whole(spark, path, RUN_ENDING, "key")


def read_lines(spark: SparkSession, path: str, schema: str = CASES) -> DataFrame:
    """The rows of a JSON Lines file by a declared schema, with broken: the text of a line that isn't of it, else null. Files are split at lines."""
    return spark.read.schema(f"{schema}, broken string").option("columnNameOfCorruptRecord", "broken").json(path)


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """The rows of tables of overrides, tab-separated under a header; without a file name, or with a mark of a comment before it, a row is none."""
    found = spark.read.option("sep", "\t").option("header", True).option("quote", "").schema(OVERRIDES).csv(path)
    return found.filter(F.col("filename").isNotNull() & ~F.col("filename").startswith("#"))
