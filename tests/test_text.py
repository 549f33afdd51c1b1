import random

import pytest
from pyspark.sql import functions as F

from provenant.functions import text as X
from provenant.operators import quotecheck
from provenant.sources import markdown
from provenant.streaming import quotes as quotes_watch


def test_norm_agrees(spark):
    df = spark.createDataFrame([("Größe, ÉTÉ 12",), (None,), ("",)], "t string")
    rows = df.select(X.norm("t").alias("a"), X.norm_latin(F.col("t")).alias("b")).collect()
    assert [r.a for r in rows] == ["grosseete12", None, ""] == [r.b for r in rows]
    assert X.norm_text("ﬁne²") == "fine2"


LONG = "these are words that are long enough"


@pytest.mark.parametrize(
    "span, source, want",
    [
        (LONG, LONG + " indeed", "PASS"),
        (LONG, "nothing like it", "FAIL"),
        ("short", "a short one", "SKIP"),
        ("short", "none", "FAIL"),
        ("  -- ", "x", "EMPTY"),
        ("it rose by 70 in the year after that", "it rose by 170 in the year after that", "FAIL"),
        ("in the year after that fell by 70", "in the year after that fell by 70%, 12 patients withdrew", "PASS"),
        ("in the year after that fell by 70", "in the year after that fell by 70.5 per cent", "FAIL"),
        ("in the year after that fell by 70", "in the year after that fell by 70, and so on", "PASS"),
        ("70 in the whole year after that, or so", "1,70 in the whole year after that, or so", "FAIL"),
        ("70 in the whole year after that, or so", "at 1. 70 in the whole year after that, or so", "PASS"),
        ("fell by 1,000 in the year after that", "it fell by 1000 in the year after that", "PASS"),
        (LONG, "these are words 12 that are long enough", "PASS*"),
        ("these are 3 words that are long enough", "these are 4 words that are long enough", "FAIL"),
        ("runs in O(n log n) time for every input at all", "runs in time for every input at all", "PASS~"),
        ("the ﬁnal oﬃce of this whole great empire", "the final office of this whole great empire", "PASS"),
        ("Größe und Maß aller dieser vielen Dinge", "GROSSE und MASS aller dieser vielen dinge", "PASS"),
        ("reordered words of that kind are here", "here are words of that kind reordered", "FAIL"),
    ],
)
def test_ladder(spark, span, source, want):
    assert quotecheck.Source(source).verdict(span) == want


def test_check_spans(spark):
    df = spark.createDataFrame([(1, LONG, LONG + "!"), (2, LONG, None), (3, None, "x"), (4, "short", "x")], "i int, span string, source string")
    assert {r.i: r.verdict for r in quotecheck.check_spans(df).collect()} == {1: "PASS", 2: None, 3: "EMPTY", 4: "FAIL"}
    assert quotecheck.tally(quotecheck.check_spans(df)).first().asDict() == {"passed": 1, "passed_letters": 0, "passed_mathless": 0, "failed": 1, "skipped": 0}


def test_contained_both_ways(spark, monkeypatch):
    """The automaton and the join find what a plain search finds: short quotes, repeated ones, overlaps, nulls, empty texts."""
    rng = random.Random(3)
    base = "".join(rng.choice("abcab 1") for _ in range(600))
    texts = [(i, base[rng.randrange(500) :][: rng.choice((0, 5, 40, 300))]) for i in range(30)] + [(90, None), (91, "Ünïcode ß")]
    quotes = [(i, base[a : a + rng.choice((1, 3, 9, 22, 24, 60))]) for i, a in enumerate(rng.sample(range(500), 25))] + [(80, None), (81, " -"), (82, "unicodess"), (83, quotes_at := base[7:40]), (84, quotes_at)]
    n = X.norm_text
    want = sorted((q, t) for q, a in quotes for t, b in texts if a and b and n(a) and n(a) in n(b))
    q, t = spark.createDataFrame(quotes, "quote_id int, quote string"), spark.createDataFrame(texts, "text_id int, text string")
    assert want and sorted(map(tuple, quotecheck.contained(q, t).collect())) == want
    monkeypatch.setattr(quotecheck, "BROADCAST_CHARS", -1)
    assert sorted(map(tuple, quotecheck.contained(q, t).collect())) == want
    assert quotecheck.contained(q.limit(0), t).count() == 0


def test_watch(spark, tmp_path):
    spark.createDataFrame([(1, "it says these words here"), (2, None)], "text_id int, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("text_id int, text string").parquet(f"{tmp_path}/in")
    quotes = spark.createDataFrame([(7, "These words!")], "quote_id int, quote string")
    quotes_watch.watch(quotes, stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(60)
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(7, 1)]


def test_check_files(spark):
    files = [("plain", f'> "{LONG}"\n'), ("short", '> "short"\n> "short ... a"\n'), ("open", f'  > “{LONG}\n'), ("notes", "> just a note with “a word”\n>\n"), ("gone", f'> "{LONG}"'), ("two", f'> "{LONG} ... {LONG}" and more\n> "{LONG} [...] invented by nobody at any time"\n'), ("empty", ""), ("null", None)]
    extracts = [(k, f"So {LONG}, a short one") for k, _ in files if k != "gone"]
    got = {r.key: (r.passed, r.failed, r.skipped, r.n_notes, r.verdict) for r in quotecheck.check_files(spark.createDataFrame(files, "key string, text string"), spark.createDataFrame(extracts, "key string, extract string")).collect()}
    assert got == {"plain": (1, 0, 0, 0, "pass"), "short": (0, 2, 3, 0, "fail"), "open": (1, 0, 0, 0, "pass"), "notes": (0, 1, 0, 1, "fail"), "gone": (0, 1, 0, 0, "fail"), "two": (3, 1, 0, 0, "fail"), "empty": (0, 1, 0, 0, "fail"), "null": (0, 1, 0, 0, "fail")}


def test_edge_and_address(spark):
    df = spark.createDataFrame([("**Supports:** Key:Slug (grounded by #g1) [rec: r-9]",), ("plain",)], "l string")
    a, b = (r.e for r in df.select(X.edge(F.col("l")).alias("e")).collect())
    assert (a.type, a.target, a.grounding, a.rec) == ("supports", "key:slug", "g1", "r-9") and b.type is None


def test_blocks_ignore_fences(spark):
    doc = "---\npaper: a\npaper: b\n---\n## Claim 1\n> \"quoted\"\n**ID:** One\n```\n## Claim 9\n**ID:** decoy\n```\n## Other\n## Claim 2\n**ID:** two\n"
    files = spark.createDataFrame([("k", doc), ("empty", ""), ("null", None)], "key string, text string")
    rows = markdown.claims(files).orderBy("ordinal").collect()
    assert [(r.ordinal, r.frontmatter["paper"], [f.value for f in r.fields]) for r in rows] == [(1, "b", ["One"]), (2, "b", ["two"])]
    assert {(r.alias, r.is_slug) for r in markdown.aliases(markdown.claims(files)).collect()} == {("c1", False), ("one", True), ("c2", False), ("two", True)}
