"""Articles dealt over several XML files."""

import os

from provenant.plans import library


def _path(uri):
    return uri.removeprefix("file://").removeprefix("file:")


def test_articles_are_dealt_over_files_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(library, "ARTICLES", 10)
    rows = [(i, f"name {i}", "type", "brand", i % 7) for i in range(100)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    path = _path(library._article_files(spark, str(tmp_path)))
    held = [open(f"{path}/{f}").read().count("</set>") for f in os.listdir(path) if f.startswith("part-")]
    assert 5 < sum(held) <= 10 and max(held) == 1
    assert library.xml_metadata(spark, str(tmp_path)).select("i").distinct().count() == 100
