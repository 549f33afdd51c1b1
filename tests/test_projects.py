"""Operators on whole projects: what each rule finds in small files, and nothing in sound or empty ones."""

import json

import pytest
from pyspark.sql import functions as F

from provenant.functions import schema
from provenant.operators import assessment, citations, faithfulness, project, provenance, records, register, selection, synthesis
from provenant.sources import fields, html_units, markdown, sinks


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>one<b>two</b> three, and so on for a long while</p>", ["one two three, and so on for a long while"]),
        ("<li>own text of a container that is long<p>a nested block of enough length</p></li>", ["a nested block of enough length"]),
        ("<p>first paragraph of enough length<p>second paragraph of enough length", ["first paragraph of enough length", "second paragraph of enough length"]),
        ("<ul><li>outer item of enough length here<ul><li>inner item of enough length here</ul></ul>", ["inner item of enough length here"]),
        ("<h1>short</h1><p>A &amp; B are of enough length, they say</p>", ["A & B are of enough length, they say"]),
        ("<p>seen text of enough length here<script>var unseen = 1</script></p>", ["seen text of enough length here"]),
        (None, []),
        ("", []),
    ],
)
def test_units(page, want):
    assert html_units.leaf_blocks(page) == want


def test_schema():
    good = {"kind": "edge", "id": "a", "subject": "k:s", "grounding": [], "assessed_date": "20240101", "assessor": "x", "assessor_tool": "t", "assess_version": "1", "body_sha256": "", "record_sha256": ""}
    assert schema.errors(good, schema.RECORD) == []
    assert schema.errors(good | {"kind": "odd", "more": 1, "grounding": [1]}, schema.RECORD) == ["$: more is unknown", "$.kind: not one of the values", "$.grounding[0]: not string"]
    assert schema.errors([], schema.RECORD) == ["$: not object"]
    assert schema.errors(True, {"type": "integer"}) == ["$: not integer"] and schema.errors(None, {"type": ["string", "null"]}) == []


CLAIMS = '---\nfile: f\n---\n## Claim 1\n> "The words of it"\n**ID:** One\n**Supports:** b:two (grounded by #one)\n## Claim 2\n> "More  words"\n**ID:** other\n'


def _record(**more):
    made = {"kind": "edge", "id": "r1", "subject": "a:one", "grounding": ["a:other"], "assessed_date": "20240101", "assessor": "x", "assessor_tool": "t", "assess_version": "1", "body_sha256": ""} | more
    made["record_sha256"] = records.digest(json.dumps(made))
    return json.dumps(made)


def test_records(spark):
    files = spark.createDataFrame([("a", CLAIMS), ("null", None)], "key string, text string")
    body = assessment.claim_table(files).filter("alias = 'one'").select(F.sha2("body", 256)).first()[0]
    rows = [("r1.assess", _record(body_sha256=body)), ("r2.assess", _record(id="R2", kind="faithfulness", span="more words", body_sha256=body, disputes=["R1"])), ("r3.assess", "{"), ("r4.assess", _record(id="r4", subject="a:gone")), ("r5.assess", _record(id="r1", body_sha256=body)), ("r6.assess", None), ("r7.assess", _record(id="r7", kind="faithfulness-pass", body_sha256=body, reviews=["r2"]))]
    table = spark.createDataFrame(rows, "stem string, record string")
    got = {(r.id, r.code) for r in assessment.record_problems(table, files).collect()}
    assert got == {("r2", "span"), ("r3.assess", "unreadable"), ("r4", "subject"), ("r1", "duplicate"), ("r1", "filename"), ("r6.assess", "unreadable")}
    links = {(r.id, r.other, r.code) for r in assessment.link_problems(table).collect()}
    assert links == {("r7", "r2", "no edge record")}
    assert assessment.record_problems(table.limit(0), files).count() == 0


def test_markdown(spark):
    files = spark.createDataFrame([("k", "---\na: 1\n---\nbody\n\n"), ("bare", "x"), ("open", "---\na: 1"), ("null", None)], "key string, text string")
    got = {r.key: (r.frontmatter, r.body) for r in markdown.bodies(files).collect()}
    assert got == {"k": ({"a": "1"}, "body\n"), "bare": ({}, "x\n"), "open": ({"a": "1"}, ""), "null": ({}, "")}
    lines = spark.createDataFrame([("K", "```\n**Refines:** x:Y\n```\n> **Supports:** z\n** Supports:** q\n**supports:** Z1 (grounded by #G) [rec: R]")], "key string, text string")
    assert [(r.type, r.source, r.target, r.rec) for r in markdown.edges(lines).orderBy("line").collect()] == [("refines", None, "x:y", None), ("supports", "K:g", "K:z1", "r")]


def test_selection_words(spark):
    df = spark.createDataFrame([(" For: — x",), ("",), (None,), ("- a",)], "t string")
    assert [r.w for r in df.select(selection.first_word(F.col("t")).alias("w")).collect()] == ["for", "", None, ""]
    df = spark.createDataFrame([("1,200",), (" 7 ",), ("-1",), ("many",), ("",), (None,)], "t string")
    assert [r.n for r in df.select(selection.count(F.col("t")).alias("n")).collect()] == [1200, 7, None, None, None, None]


def test_fields():
    text = "**A:** x\n## One\n**B:** 1 \n### E\n**C-d:** 2\n<!-- a\n**No:** 3\n-->\n<!-- b --> \n**E:** 4"
    assert list(fields.field_lines(text)) == [(None, 0, None, "a", "x", 1), ("one", 0, None, "b", "1", 3), ("one", 1, "E", None, None, 4), ("one", 1, "E", "c-d", "2", 5), ("one", 1, "E", "e", "4", 10)]
    assert fields.settings("a: 1\n a: 2 # c\nb:\n") == {"a": "2", "b": ""} and list(fields.field_lines(None)) == []


@pytest.mark.parametrize(
    "text, want",
    [
        ("This is novel", [(1, "novelty")]),
        ("a novel-like thing", []),
        ("---\nnovel\n---\n# novel\n> novel\n```\nnovel\n```\nproven", [(9, "certainty")]),
        ('They "prove it is novel', []),
        ('They say "it is\nnovel" but\nwe beat it, proven', [(3, "certainty")]),
        ('an open " mark\n\nis novel', [(3, "novelty")]),
        ("novel, see [[note]]", []),
        ("It is NOT novel", []),
        ("<!-- novel -->\nunique", [(2, "novelty")]),
        (None, []),
    ],
)
def test_synthesis(text, want):
    assert synthesis.flagged(text) == want


def test_provenance(spark):
    files = spark.createDataFrame([("none", "x"), ("null", None)], "key string, text string")
    parsed = markdown.bodies(files)
    assert {r.code for r in provenance.identity_problems(parsed).collect()} == {"no file", "no source_version", "no retrieved", "no locator"}
    sealed = provenance.stamped_record(parsed, "20240101").select(records.sealed(F.col("run")).alias("s")).collect()
    assert [r.s for r in sealed] == [True, True]


def test_manifests(spark):
    units = spark.createDataFrame([("k", 2, "p2", "b"), ("k", 1, "p1", "a")], "key string, place int, locus string, text string")
    raw = spark.createDataFrame([("k", "html", "s"), ("none", "pdf", "t")], "key string, source_type string, source_sha256 string")
    rows = sinks.manifests(units, raw, "20240101").select("key", "manifest", records.sealed(F.col("manifest"), records.MANIFEST_SEAL).alias("ok")).collect()
    assert all(r.ok for r in rows) and {r.key: [u["locus"] for u in json.loads(r.manifest)["units"]] for r in rows} == {"k": ["p1", "p2"], "none": []}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b\tc"), (1, None)], "i int, t string")
    sinks.write_table(df.orderBy("i").coalesce(1), f"{tmp_path}/t")
    assert [r.i for r in spark.read.option("sep", "\t").option("header", True).schema("i int, t string").csv(f"{tmp_path}/t").orderBy("i").collect()] == [1, 2]
    assert json.loads(sinks.graph_json({"x": df.filter("i = 1"), "a": df.limit(0)})) == {"a": [], "x": [{"i": 1}]}


@pytest.mark.parametrize("name, want", [("smith_2020.pdf", ("smith", "2020", "")), ("Smith-Jones_2020b_draft.html", ("smith", "2020", "b")), ("Tørresen_1999.xml", ("torresen", "1999", "")), ("scan 2011 x.pdf", (None, "2011", None)), ("notes.md", (None, None, None))])
def test_names(spark, name, want):
    r = register.parse_names(spark.createDataFrame([(name,)], "filename string")).first()
    assert (r.fn_author, r.fn_year, r.fn_suffix) == want


def test_faithfulness_words(spark):
    df = spark.createDataFrame([(" OOC ",), ("Warranted",), ("maybe",), (None,)], "t string")
    assert [r.v for r in df.select(faithfulness.normal_verdict(F.col("t")).alias("v")).collect()] == ["out-of-context", "apt", None, None]
    cases = spark.createDataFrame([(1, None, None)], "id int, quote string, inference string")
    assert faithfulness.detect(cases).first().verdict == "apt"


def test_gated(spark):
    df = spark.createDataFrame([("x/content/a.md",), ("content/verified_claims/a.md",), ("other/a.md",)], "p string")
    assert [r.g for r in df.select(project.gated(F.col("p"), ["content/"]).alias("g")).collect()] == [True, False, False]


def test_empty_project(spark):
    """No files, no problems."""
    files = spark.createDataFrame([], "key string, text string")
    none = spark.createDataFrame([], "stem string, record string")
    qids = spark.createDataFrame([], "qid string")
    assert assessment.structure_problems(files, qids).count() == 0 and assessment.marker_problems(files, assessment.parse(none)).count() == 0
    rows = fields.fields(spark.createDataFrame([], "path string, text string")).withColumnRenamed("path", "project")
    keys = spark.createDataFrame([], "project string, key string")
    assert selection.selection_problems(rows, keys, keys, spark.createDataFrame([], "project string, qid string")).count() == 0
    assert selection.flow_problems(rows, keys, keys).count() == 0
    cites = spark.createDataFrame([], "author string, year string, claim string")
    assert citations.claim_problems(cites, spark.createDataFrame([], "name string"), spark.createDataFrame([], "alias string, target string"), spark.createDataFrame([], "key string, alias string, is_slug boolean")).count() == 0


def test_schema_without_python(spark):
    """Column expressions find what the general check finds, on records with one fault or several."""
    import random

    rng = random.Random(3)
    good = json.loads(_record())
    odd = [None, 1, 2.5, True, "", "edge", "20240101", [], ["a"], ["a", 1, None], {"x": 1}, "2024010", "é"]
    texts = [json.dumps({**{k: v for k, v in good.items() if rng.random() > 0.1}, **{rng.choice([*good, "span", "disputes", "new"]): rng.choice(odd) for _ in range(rng.choice((0, 1, 3)))}}) for _ in range(120)]
    texts += ["[]", "3", '"x"', "null", "{}", "{", "", None]

    def plain(t):
        try:
            return schema.errors(json.loads(t), schema.RECORD)
        except (TypeError, ValueError):
            return ["$: not JSON"]

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", schema.schema_errors(F.col("t")).alias("e")).collect()
    assert {r.i: sorted(r.e) for r in got} == {i: sorted(plain(t)) for i, t in enumerate(texts)}
