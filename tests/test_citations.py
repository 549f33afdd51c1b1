import pytest
from pyspark.sql import functions as F

from provenant.operators import citations


@pytest.mark.parametrize(
    "text, want",
    [
        (None, []),
        ("", []),
        ("Since 2020, in Table (2019) and [12]", []),
        ("Ab (2020)", []),
        ("Miller, Young, and Baker (2009b #Two)", [("miller", "2009", "two")]),
        ("Miller & Young 2010; Miller and Young (2010)", [("miller", "2010", None)]),
        ("Müller et al., 1999", [("müller", "1999", None)]),
        ("O’Hara (2001) but (Stone, 2002 #c1)", [("o'hara", "2001", None), ("stone", "2002", "c1")]),
        ("Table and Miller (2004)", []),
        ("(Miller 2305)", []),
    ],
)
def test_cited(text, want):
    assert citations.cited(text) == want


def test_resolve(spark):
    cites = spark.createDataFrame([("smith", "2020"), ("o'hara", "2001"), ("stone", "2002"), ("chain", "2003"), ("smit", "2020"), ("year", "1202"), (None, "2020"), ("smith", "2020")], "author string, year string")
    files = spark.createDataFrame([("smithson_2020.md",), ("smith_b_2020.md",), ("Smith_a_2020.md",), ("ohara2001.md",), ("rock_2002.md",), ("smith_2020.txt",), ("stone_20021.md",), (None,)], "name string")
    aliases = spark.createDataFrame([("stone_2002", "rock_2002"), ("chain_2003", "stone_2002"), (None, "x")], "alias string, target string")
    got = {(r.author, r.year): r.name for r in citations.resolve(cites, files, aliases).collect()}
    assert got == {("smith", "2020"): "Smith_a_2020.md", ("o'hara", "2001"): "ohara2001.md", ("stone", "2002"): "rock_2002.md", ("chain", "2003"): None, ("smit", "2020"): None, ("year", "1202"): None, (None, "2020"): None}


def test_markers(spark):
    df = spark.createDataFrame([("seen [1–3], again.⁴² but κ² and O(n)³",), (None,)], "t string")
    assert [r.m for r in df.select(citations.numeric_markers(F.col("t")).alias("m")).collect()] == [["[1–3]", "⁴²"], None]
