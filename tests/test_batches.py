"""Whole texts reach Python workers in batches of few rows."""

from provenant.plans.queries import QUERIES
from provenant.sources import scratch


def test_queries_bound_the_rows_of_a_batch(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        spark.createDataFrame([(i, f"Text {i % 3}!") for i in range(9)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
        found = {r["doc_id"]: r["duplicate_of"] for r in QUERIES["register_canonical"](spark, str(tmp_path)).collect()}
        assert found == {i: i % 3 if i > 2 else None for i in range(9)}
        assert int(spark.conf.get(key)) == scratch.BATCH_ROWS
        spark.conf.set(key, "7")
        scratch.bounded_batches(spark)
        assert spark.conf.get(key) == "7"
    finally:
        spark.conf.set(key, before)
