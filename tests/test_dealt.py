"""Texts made of a small file of keys are made in many tasks."""

from pyspark.sql import functions as F

from provenant.plans import projects as P
from provenant.sources import scratch


def _tasks(df):
    return df.select(F.spark_partition_id().alias("task")).distinct().count()


def test_claim_files_of_a_small_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "DEALT", 10, raising=False)
    spark.range(95).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    files = P._claim_files(spark, str(tmp_path))
    assert _tasks(files) > 5
    assert sorted(r.key for r in files.collect()) == sorted(["hub", *(f"k{i}" for i in range(95))])


def test_notes_of_a_small_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "DEALT", 10, raising=False)
    spark.range(95).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    notes, real = [], P.synthesis.unanchored
    monkeypatch.setattr(P.synthesis, "unanchored", lambda df: notes.append(df) or real(df))
    P.synthesis_gate(spark, str(tmp_path))
    assert _tasks(notes[0]) > 5 and notes[0].count() == 95
