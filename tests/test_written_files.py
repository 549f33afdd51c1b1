"""Files that tasks write by name, whatever their number."""

import hashlib
import os

from pyspark.sql import functions as F

from provenant.sources import inventory, scratch


def _path(uri):
    return uri.removeprefix("file://").removeprefix("file:")


def test_files_are_written_below_folders_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(scratch, "FILES", 5)
    monkeypatch.setattr(scratch, "FOLDERS", 2)
    names = [f"a{i}.html" for i in range(98)] + ["a:b%c.txt", "x y@z'.txt"]
    rows = spark.createDataFrame([(n, f"text ö of {n}") for n in names], "file string, value string").coalesce(1)
    path = scratch.written_files(rows, "file", "value", "test-files")
    folders = [f for f in os.listdir(_path(path)) if f.startswith("task=")]
    assert 10 < len(folders) <= 20 and max(len(os.listdir(f"{_path(path)}/{f}")) for f in folders) < 25
    found = inventory.scan(spark, path, "*", recursive=True).select(F.regexp_extract("path", "file=([^/]*)/", 1).alias("file"), "sha256").collect()
    assert {r["sha256"] for r in found} == {hashlib.sha256(f"text ö of {n}\n".encode()).hexdigest() for n in names} and len(found) == 100
    # Spark's own writer names folders the same.
    rows.write.partitionBy("file").text(f"{path}-plain")
    assert {r["file"] for r in found} == {f.removeprefix("file=") for f in os.listdir(f"{_path(path)}-plain") if f.startswith("file=")}


def test_rows_of_one_name_are_lines_and_none_gives_no_file(spark):
    rows = spark.createDataFrame([("a", "one"), ("a", "two"), ("b", None)], "file string, value string")
    path = scratch.written_files(rows, "file", "value", "test-lines")
    found = {r["file"]: bytes(r["content"]) for r in inventory.scan(spark, path, "*", recursive=True).select(F.regexp_extract("path", "file=([^/]*)/", 1).alias("file"), "content").collect()}
    assert sorted(found["a"].split()) == [b"one", b"two"] and found["b"] == b"\n" and len(found) == 2
    assert os.listdir(_path(scratch.written_files(rows.limit(0), "file", "value", "test-none"))) == []
