"""Boards, documents, prose, papers and files on unplanned rows: nulls, empty and repeated ones, ties, hubs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from provenant.operators import assessment, board, citations, project, register
from provenant.sources import markdown, project_files


def test_counters(spark):
    rows = [("a", "edges"), ("a", "edges"), ("b", "records"), (None, "edges"), ("b", "no counter")]
    got = {r["project"]: (r["edges"], r["records"]) for r in board.counters(spark.createDataFrame(rows, "project string, what string")).collect()}
    assert got == {"a": (2, 0), "b": (0, 1), None: (3, 1)}
    empty = board.counters(spark.createDataFrame([], "project string, what string")).collect()
    assert all(r["edges"] == 0 for r in empty)


def test_adjacency(spark):
    rng = random.Random(2)
    edges = [("hub", f"n{i}") for i in range(300)] + [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(200)] + [("x", "x"), ("hub", "n1"), ("n1", "hub")]
    want = {}
    for a, b in edges:
        if a != b:
            want.setdefault(a, set()).add(b)
            want.setdefault(b, set()).add(a)
    rows = board.adjacency(spark.createDataFrame(edges, "source string, target string"), 20).collect()
    got = {}
    for r in rows:
        assert len(r["neighbours"]) == r["n"] < 60 and r["neighbours"] == sorted(r["neighbours"])
        assert not got.get(r["node"], set()) & set(r["neighbours"])
        got.setdefault(r["node"], set()).update(r["neighbours"])
    assert got == want and sum(r["node"] == "hub" for r in rows) > 10


def _lead(text):
    """Line by line, the first paragraph before a section."""
    lines = (text or "").split("\n")
    if lines[0].strip() == "---" and "---" in (x.strip() for x in lines[1:]):
        lines = lines[2 + [x.strip() for x in lines[1:]].index("---") :]
    kept = []
    for line in map(str.strip, lines):
        if line.startswith("## ") or (not line and kept):
            break
        if line and not line.startswith(("# ", "---")):
            kept.append(line)
    return " ".join(kept)


def test_leads(spark):
    rng = random.Random(4)
    bits = ["---", "# T", "## S", "", "one two", "  padded ", "x", "---- rule", "#tag", "##"]
    texts = [None, "", "---", "---\na\n---\nb"] + ["\n".join(rng.choice(bits) for _ in range(rng.choice((1, 3, 8)))) for _ in range(200)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", board.lead(F.col("t")).alias("l")).collect()
    assert {r["i"]: r["l"] for r in got} == {i: _lead(t) for i, t in enumerate(texts)}
    marked = spark.createDataFrame([("It is **bold** and `code`, see [[note]] [rec: r 1] now",)], "t string").select(board.lead(F.col("t"))).first()[0]
    assert marked == "It is bold and code, see note now"


def test_comments(spark):
    text = '## Claim 1\n**Assess-rhetorical:** a “bold span” — too bold [rec: R-1]\n**Status:** open\n```\n**Status:** no\n```\n**Crux-of:** q1\n## Claim 2\n**Correlated-with:** k:b [rec: x] [kind: other]\n'
    rows = board.annotations(markdown.claims(spark.createDataFrame([("k", text), ("n", None)], "key string, text string"))).collect()
    assert sorted((r["ordinal"], r["kind"], r["target"], r["span"], r["note"], r["record"]) for r in rows) == [(1, "crux", "q1", "", "", ""), (1, "rhetorical", "", "bold span", "a  — too bold", "r-1"), (1, "status", "", "", "open", ""), (2, "correlated", "k:b", "", "kind: other", "x")]


def test_pairs(spark):
    text = "---\nauthored_by: a\nlast_updated: b\nstatus: c\n---\n##  A ↔ b \n\ntext\n- Kind: shared-evidence\n- kind: overlapping-pools\n## b ↔ A\n## c ↔ d\n- kind: nonsense\n## B ↔ a\n- kind: shared-evidence\n"
    files = spark.createDataFrame([("p", text), ("q", None)], "path string, text string")
    assert sorted(tuple(r) for r in board.pair_kinds(files).collect()) == [("p", 9, "a", "b", "shared-evidence"), ("p", 13, "c", "d", "nonsense"), ("p", 15, "b", "a", "shared-evidence")]
    declared = spark.createDataFrame([("p", "a", "b"), ("p", "a", "b")], "path string, lo string, hi string")
    got = sorted(tuple(r) for r in board.pair_kind_problems(files, declared).collect())
    assert got == [("p", "duplicate", "b a"), ("p", "orphan", "c d"), ("p", "unknown kind", "c d nonsense")] + [("q", "no provenance", f) for f in ("authored_by", "last_updated", "status")]


def test_prefixes(spark):
    values = [None, "", "<paths>", "none # all", "NONE", "a/, b/  c/ # more", " # only"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(board.prefixes(F.col("v"))).collect()]
    usual = list(board.GATED)
    assert got == [usual, usual, usual, [], [], ["a/", "b/", "c/"], usual]
    paths = spark.createDataFrame([("x/log.md",), ("_ledger/a.md",), ("x_ledger/a.md",), ("finding.md",)], "p string").select(board.machinery(F.col("p"))).collect()
    assert [r[0] for r in paths] == [True, True, False, False]


def test_documents_and_numbers(spark):
    files = spark.createDataFrame([("a", "## Claim 1\n## Claim 3\n"), ("b", "---\npaper: \"In 1987 or 2001\"\n---\n##  CLAIM x\n## Claims 2\n"), ("c", None), ("d", "## Claim 1\n## Claim\n## Claim 2\n")], "key string, text string")
    rows = {r["key"]: r for r in board.documents(files, spark.createDataFrame([("A", "z"), ("a", "for")], "key string, position string")).collect()}
    assert [(k, rows[k]["paper"], rows[k]["year"], rows[k]["claims"], rows[k]["position"], rows[k]["verdict"]) for k in sorted(rows)] == [("a", "a", "", 2, "for", "unstamped"), ("b", "In 1987 or 2001", "1987", 1, "", "unstamped"), ("c", "c", "", 0, "", "unstamped"), ("d", "d", "", 3, "", "unstamped")]
    assert [(r["key"], r["numbers"]) for r in board.numbering(files).collect()] == [("a", [1, 3])]


def test_unsigned(spark):
    runs = spark.createDataFrame([("a", "{}"), ("b", "{}"), ("c", "{"), ("d", "{}"), ("e", None)], "name string, record string")
    signatures = spark.createDataFrame([("a.sig",), ("a.sig",), ("b.sig",), ("c.sig",), ("e.sig",)], "name string")
    got = sorted(tuple(r) for r in board.unsigned(runs, signatures, spark.createDataFrame([("a", True), ("b", False)], "name string, ok boolean")).collect())
    assert got == [("b", "not verified"), ("c", "unreadable"), ("d", "no signature"), ("e", "unreadable")]


def test_papers(spark):
    cites = spark.createDataFrame([("o'neil", "2001"), ("smith", "2002"), ("li", "2003"), ("li", "2003"), (None, "2001"), ("gone", "1999")], "author string, year string")
    rows = spark.createDataFrame([("Oneil_2001a", "pdf", "downloaded"), ("oneil_2001", "html", "downloaded"), ("smith_2002", "html", "unknown"), ("smith_2002b", "pdf", "mismatch"), ("smith_2002ab", "pdf", "verified"), (None, "pdf", "verified")], "key string, extension string, status string")
    files = spark.createDataFrame([("lin_2003.pdf",), ("Li-x_2003_draft.html",), ("smith_20021.pdf",), (None,)], "name string")
    got = {(r["author"], r["year"]): (r["by"], r["key"]) for r in citations.papers(cites, rows, files).collect()}
    assert got == {("o'neil", "2001"): ("register", "oneil_2001"), ("smith", "2002"): (None, "smith_2002"), ("li", "2003"): ("file", None), (None, "2001"): (None, None), ("gone", "1999"): (None, None)}


def test_review(spark):
    shape = "filename string, key string, status string, fn_author string, fn_year string, meta_author string, meta_year string, size_kb double, notes array<string>"
    rows = [(f"d{k}_{i}", f"k{k}", f"duplicate_of:k{k}", None, None, None, None, 1.0, []) for k in range(25) for i in range(1 + k % 3)] + [("m", "k0", "mismatch", "a", None, None, "2001", 1.0, None)]
    got = [tuple(r) for r in register.review(spark.createDataFrame(rows, shape)).collect()]
    clusters = [r for r in got if r[0] == "cluster"]
    want = sorted(((f"k{k}", 1 + k % 3) for k in range(25)), key=lambda x: (-x[1], x[0]))[:20]
    assert sorted((r[1], r[2]) for r in clusters) == sorted(want) and all(len(r[3].split(", ")) == r[2] for r in clusters)
    assert ("mismatch", "m", None, "a_? | ?_2001") in got and ("status", "keys", 1, None) in got and ("status", "verified", 0, None) in got
    assert {r[2] for r in map(tuple, register.review(spark.createDataFrame([], shape)).collect())} == {0}


def test_files(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.assess.json").write_text('{"id": "A",\n "kind": "edge"}\n')
    (tmp_path / "r" / "notes.txt").write_text("no record")
    (tmp_path / "r" / "k.run.json").write_text("{}")
    assert sorted((r["stem"], json.loads(r["record"]).get("id")) for r in project_files.read_records(spark, str(tmp_path / "r")).collect()) == [("a.assess", "A"), ("k.run", None)]
    assert [r["key"] for r in project_files.read_runs(spark, str(tmp_path / "r")).collect()] == ["k"]
    (tmp_path / "c.jsonl").write_text('{"id": "1", "gold": "apt", "more": 1}\n\n{broken\n{"id": 2}\n')
    rows = project_files.read_lines(spark, str(tmp_path / "c.jsonl")).select("id", "gold", "broken").collect()
    assert [(r["id"], r["gold"]) for r in rows if r["broken"] is None] == [("1", "apt"), ("2", None)] and [r["broken"] for r in rows if r["broken"]] == ["{broken"]
    (tmp_path / "o.tsv").write_text('filename\tauthor\tyear\tstatus\treason\nx.pdf\tA "q"\t2001\tverified\tseen\n# note\t\t\t\t\n')
    assert [(r["filename"], r["author"], r["year"]) for r in project_files.read_overrides(spark, str(tmp_path / "o.tsv")).collect()] == [("x.pdf", 'A "q"', "2001")]


@pytest.mark.parametrize("copies", [1, 2])
def test_lines_of_references(spark, copies):
    """Lines are those of the markers, also in a text that is there twice."""
    prose = spark.createDataFrame([("p", "a\nb [rec: x]\n\nc [rec:\ny] [rec: open\n[rec: z]")] * copies + [("q", None)], "path string, text string")
    records = spark.createDataFrame([("x",), ("y",)], "id string")
    got = sorted((r["line"], r["ref"], r["outcome"]) for r in assessment.prose_references(prose, records, records.filter("id = 'x'")).collect())
    assert got == sorted([(2, "x", "valid"), (4, "y", "invalid"), (6, "z", "absent")] * copies)


def test_missing_paths(spark):
    settings = spark.createDataFrame([("p", "gated_paths", "a/b, a/b/ c.md, d"), ("q", "gated_paths", "none"), ("r", "other", "x")], "project string, name string, value string")
    files = spark.createDataFrame([("p", "a/b/x.md"), ("p", "cc.md"), ("p", "c.md.bak"), ("r", "content/concept_notes/n.md")], "project string, path string")
    assert sorted(tuple(r) for r in project.missing_paths(settings, files).collect()) == [("p", "c.md"), ("p", "d"), ("r", "content/literature_reviews/")]


def test_ledger_scan(spark, tmp_path):
    for name, text in {"B_2001.md": "## Claim 1\n", "a.md": "\n", "empty.md": "", "TEMPLATE.md": "no", "notes.txt": "no"}.items():
        (tmp_path / name).write_text(text)
    rows = markdown.read_files(spark, f"{tmp_path}/*.md").collect()
    assert sorted((r["key"], r["text"]) for r in rows) == [("a", "\n"), ("b_2001", "## Claim 1\n")]
