"""What projects show of themselves, in small files: traces, judgements, sources and their inventory, with nulls and empty tables."""

import json

from provenant.operators import assessment, views
from provenant.sources import markdown

FILES = [
    ("a", '---\ntitle: "The A paper"\n---\n## Claim 1\n> "The words of it"\n**ID:** one\n**Supports:** b:two (grounded by #one)\n**Rebuts:** B:TWO (grounded by #lost)\n**Supports:** b:two\n'),
    ("b", "## Claim 1\n**ID:** two\n"),
    ("null", None),
]


def _record(**more):
    return json.dumps({"kind": "edge", "subject": "b:two", "grounding": ["a:one"], "assessed_date": "20240101"} | more)


def _tables(spark):
    files = spark.createDataFrame(FILES, "key string, text string")
    records = spark.createDataFrame([("e1", _record(id="E1")), ("f1", _record(id="f1", kind="faithfulness", disputes=["E1"])), ("p1", _record(id="p1", kind="faithfulness-pass", reviews=["e1"])), ("z", "{"), ("n", None)], "stem string, record string")
    warnings = spark.createDataFrame([("b:two", "a", "c")], "target string, a string, b string")
    return files, records, assessment.parse(records).filter("readable and id <> 'p1'"), warnings


def test_trace(spark):
    files, records, good, warnings = _tables(spark)
    subjects = views.trace(warnings, good, spark.createDataFrame([("E1",), ("e1",), ("gone",), (None,)], "ref string"))
    assert [tuple(r) for r in subjects.collect()] == [("b:two", list(views.REASONS), 1, 2)]
    rows = views.trace_edges(subjects, files, records, good).drop("line").collect()
    assert {tuple(r) for r in rows} == {("b:two", "a:one", "supports", "The words of it", "The A paper", "e1", 1, 0), ("b:two", "a:lost", "rebuts", "", "The A paper", None, 0, 0)}
    assert [tuple(r) for r in views.trace(warnings, good.limit(0), good.selectExpr("id as ref").limit(0)).collect()] == [("b:two", ["derived warning"], 1, 0)]
    assert views.trace_edges(subjects.limit(0), files, records, good).count() == 0 and views.trace_edges(subjects, files.limit(0), records, good).count() == 0


def test_judgements(spark):
    _, records, good, warnings = _tables(spark)
    rows = {tuple(r) for r in views.judgements(records, good, warnings).collect()}
    assert rows == {
        ("e1", "edge", "20240101", "b:two", "verified", "sealed record", "b-two", True),
        ("f1", "faithfulness", "20240101", "b:two", "verified", "disputed", "b-two", True),
        ("p1", "faithfulness-pass", "20240101", "b:two", "unverified", "reviewed — held", "b-two", True),
    }
    assert not any(r.relevant for r in views.judgements(records, good, warnings.limit(0)).collect())
    assert views.judgements(records.limit(0), good, warnings).count() == 0
    assert [r.subject for r in views.contested(records).collect()] == ["b:two"]
    assert tuple(views.aptness(spark.createDataFrame([], "covering string")).first()) == (0, 0)


def test_sources(spark):
    present = spark.createDataFrame([("x", "pdf"), ("x", "html"), ("y", "xml"), ("z", "html"), ("w", "xml"), ("w", None)], "key string, extension string")
    cited = spark.createDataFrame([("y", "xml"), ("z", "pdf"), ("gone", "pdf")], "key string, extension string")
    got = lambda order: {tuple(r) for r in views.choose_sources(present, cited, order).collect()}
    assert got(views.FOR_EXTRACTS) == {("x", "pdf", False), ("y", "xml", False), ("z", "html", True)}
    assert got(views.FOR_UNITS) == {("x", "html", False), ("y", "xml", False), ("z", "html", True)}


def test_inventory(spark):
    texts = ['---\ndoi: "10.6028/x"\nfile: s.pdf\npaper: P\n---\n', "---\ndoi: 10.1/q\n---\n", "---\npmcid: PMC1\nurl: http://u\n---\n", "---\nfile: s.pdf\ntitle: <TITLE>\n---\n", None]
    files = markdown.bodies(spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)] + [("_draft", "x")], "key string, text string")).selectExpr("'c' as case", "*")
    rows = {r.source_key: r for r in views.inventory(files, spark.createDataFrame([("c", "s.pdf"), ("c", "s.pdf"), (None, None)], "case string, file string")).collect()}
    assert sorted(rows) == ["k0", "k1", "k2", "k4"]
    assert (rows["k0"].title, rows["k0"].corpus_present, rows["k0"].included_in_submission, rows["k0"].redistribution_status, rows["k0"].notes) == ("P", "yes", "yes", "public-domain", "")
    assert rows["k1"].evidence_for_status == "DOI registrant 10.1 not in the triage table" and rows["k2"].acquisition_command_or_instructions == "http://u"
    assert (rows["k2"].locator, rows["k2"].evidence_for_status, rows["k4"].evidence_for_status, rows["k4"].notes) == ("PMC1", "pmcid present, no DOI", "no DOI / pmcid in provenance", views.NOT_ON_DISK)
