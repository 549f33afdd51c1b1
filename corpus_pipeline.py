"""A corpus in five stages, each over all that the one before kept and each written as Parquet.

Rules reject documents, a classifier rejects more, near-duplicates leave one document of each group, personal data are
replaced in the texts, and what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.llm.common import cut, table
from provenant.llm.minhash import near_duplicates
from provenant.llm.packing import best_fit_packing
from provenant.llm.pii import redacted
from provenant.llm.quality_classifier import predicted_good
from provenant.llm.quality_rules import quality_rules
from provenant.llm.queries import tokenizer_file


ROW = "__pipeline_row"


def _with_row(docs: DataFrame, *names: str) -> DataFrame:
    """Adds ROW, by which a decision finds its row again: doc_id, nulls last, and two hashes of the columns names.

    Rows of one id but of different contents are told apart; rows that are equal in all these columns are judged alike.
    """
    parts = [x for n in ("doc_id", *names) for x in (F.isnull(n), F.col(n))]
    return docs.withColumn(ROW, F.struct(F.isnull("doc_id").alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b")))


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs, with ROW, that are among kept, whose doc_id is a ROW."""
    return docs.join(kept.select(F.col("doc_id").alias(ROW)), ROW, "left_semi")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules keep, each judged by itself."""
    rows = _with_row(docs, "text", "lang", "source")
    return _only(rows, quality_rules(rows, id_col=ROW).filter("kept")).select(docs.columns)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good. It is fitted to labelled ones of the whole table, bad ones included."""
    return predicted_good(docs, table(spark, sf_dir, "labels"), known=table(spark, sf_dir, "documents"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, of the smallest id; nulls come last, and of rows of one id the least hash first."""
    rows = _with_row(docs, "text")
    return _only(rows, near_duplicates(rows, id_col=ROW).filter("kept")).dropDuplicates([ROW]).select(docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced and n_chars counted anew."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return best_fit_packing(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("MinHash near-dedup", near_dedup), ("PII", pii), ("best-fit packing", packing)]

#: SQL has neither the estimate of the rules, nor the classifier, nor the tokenizer; a test holds run() against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
