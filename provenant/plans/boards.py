"""Queries of what a project's board shows, of its other documents and files, and of all its gates, with SQL for each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.operators import assessment, board, citations, faithfulness, project, register
from provenant.plans import projects as P
from provenant.sources import markdown, project_files
from provenant.sources.scratch import scratch_path, stored, written_files

C, _cat, _on, _t, _I = F.col, P._cat, P._on, P._t, P._I


def _none(s):
    return s.createDataFrame([], "lo string, hi string, kind string")


def _parts(s, d):
    """Claim files, records, edges with what covers them, and double counts, each stored."""
    good, records, files = P._valid(s, d)
    edges = stored(markdown.edges(files), "edges")
    covered = stored(assessment.edge_problems(edges, assessment.parse(records), assessment.coverage_of(good)), "covered")
    return files, records, edges, covered, stored(assessment.double_counts(files, records, _none(s)), "findings")


def project_counters(s, d):
    """All counters of each of four projects, and of all together, in a row."""
    files, records, edges, covered, findings = _parts(s, d)
    number = F.coalesce(F.regexp_extract("key", r"^k(\d+)$", 1).try_cast("long"), F.lit(0))
    of_key = files.select("key", _cat("p", number % 4).alias("project"))
    return board.counters(board.events(files, records, covered, findings, of_key)).select("project", *board.COUNTERS[:10])


def graph_nodes(s, d):
    files, records, edges, _, findings = _parts(s, d)
    made = board.nodes(files, edges, records, findings)
    return made.withColumns({"qids": F.array_join("qids", ","), "kinds": F.array_join("kinds", ",")})


def graph_edges(s, d):
    files, _, edges, covered, _ = _parts(s, d)
    return board.shown_edges(edges, assessment.claim_table(files), files, covered)


def graph_awaiting(s, d):
    files, _, edges, covered, _ = _parts(s, d)
    claims = assessment.claim_table(files)
    return board.awaiting(board.shown_edges(edges, claims, files, covered), claims)


def claim_neighbours(s, d):
    """What is one edge from each claim, the hub of every second supplier in chunks; a row for each neighbour."""
    edges = markdown.edges(P._claim_files(s, d)).filter("source is not null").select("source", "target")
    made = board.adjacency(edges, 20)
    wide = made.groupBy("node").agg(F.sum("n").alias("n_neighbours"), (F.max("n") <= 60).alias("split"))
    return made.select("node", F.explode("neighbours").alias("neighbour")).join(wide, "node")


def supplier_orders(s, d):
    """How many parts each supplier is one order line away from, its neighbours dealt out in chunks."""
    lines = _t(s, d, "lineitem").select(_cat("s", C("l_suppkey")).alias("source"), _cat("p", C("l_partkey")).alias("target"))
    return board.adjacency(lines, 50).groupBy("node").agg(F.sum("n").alias("n_neighbours"))


def document_table(s, d):
    i = C("s_suppkey")
    front = _cat("---\n", _on(i % 3 == 0, "paper: The ", F.lit(1990) + i % 40, " paper ", i, "\n"), _on(i % 4 != 1, "retrieved: in 20", F.lit(10) + i % 9, "\n"), _on(i % 5 == 0, "source_version: \"v", i, "\"\n"), _on(i % 7 == 2, "verified_verdict: pass\n"), _on(i % 6 == 1, "doi: 10.1371/", i, "\n"), _on(i % 6 > 3, "url: http://x/", i, "\n"), "---\n")
    text = _cat(front, "## Claim 1\n```\n## claim within\n```\n", _on(i % 2 == 0, "## Claim two\n## claims\n"))
    sup = _t(s, d, "supplier")
    positions = sup.filter("s_suppkey % 3 = 1").select(_cat("K", i).alias("key"), _cat("side", i % 2).alias("position"))
    return board.documents(sup.select(_cat("k", i).alias("key"), text.alias("text")), positions)


def finding_leads(s, d):
    """The leads of findings that open with documents' first lines in various ways."""
    i = C("doc_id")
    line = F.trim(F.regexp_replace(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), r"[`*\[\]#\-]|^\s+|\s+$", ""))
    body = F.when(i % 5 == 0, _cat("---\nauthor: x\n---\n# Title\n\n", line, "\nand **more** [rec: r1] of `it`\n\nnot this\n## Part\n")).when(i % 5 == 1, _cat("## First\n", line)).when(i % 5 == 2, _cat("\n\n", line, " see [[note]]\n---\nrule passed\n")).when(i % 5 == 3, _cat("---\nopen: x\n", line)).otherwise("")
    return _t(s, d, "documents").select("doc_id", F.sha2(board.lead(body), 256).alias("digest"))


def claim_comments(s, d):
    i = C("s_suppkey")
    text = _cat("## Claim 1\n**ID:** a\n", _on(i % 2 == 0, "**Assess-rhetorical:** \"so sure ", i, "\" — the tone [rec: R", i, "] is high\n"), _on(i % 3 == 0, "**Status:** settled (grounded by #x) — by ", i, "\n"), _on(i % 4 == 0, "**Correlated-with:** k", i, ":b [kind: shared-evidence] [rec: q]\n"), "## Claim 2\n", _on(i % 5 == 0, "**Crux-of:** q", i, " [if it holds]\n"))
    return board.annotations(markdown.claims(_t(s, d, "supplier").select(_cat("k", i).alias("key"), text.alias("text"))))


def _pair_documents(s, d):
    """Documents that classify pairs, one for each nation, with their faults, and the pairs that are declared."""
    i = C("n_nationkey")
    text = _cat(
        "---\n", _on(i % 3 != 0, "authored_by: someone\n"), "last_updated: 2024\n", _on(i % 4 != 1, "status: draft\n"), "---\n## Ka ↔ kb\n- kind: ", F.when(i % 5 == 2, "sameness").otherwise("Shared-Evidence"), "\n- kind: overlapping-pools\n",
        _on(i % 2 == 0, "## kb ↔ ka\nwords\n- kind: overlapping-pools\n"), "## kx ↔ ky", _on(i % 7 != 3, "\n- kind: exact-cohort-reuse\n"), _on(i % 7 == 3, " z\n- kind: exact-cohort-reuse\n"),
    )
    n = _t(s, d, "nation")
    pairs = n.select(_cat("n", i).alias("path"), F.lit("ka").alias("lo"), F.lit("kb").alias("hi")).unionByName(n.filter("n_nationkey % 6 = 4").select(_cat("n", i).alias("path"), F.lit("kx").alias("lo"), F.lit("ky").alias("hi")))
    return n.select(_cat("n", i).alias("path"), text.alias("text")), pairs


def pair_kinds(s, d):
    return board.pair_kinds(_pair_documents(s, d)[0])


def pair_kind_gate(s, d):
    return board.pair_kind_problems(*_pair_documents(s, d))


def _prose(s, d):
    """Notes of each nation's project, and its settings."""
    i = C("n_nationkey")
    n = _t(s, d, "nation")
    note = lambda path, on="true": n.filter(on).select(_cat("p", i).alias("project"), _cat(path, i, ".md").alias("path"))
    notes = note("content/finding", "n_nationkey % 3 <> 0").unionByName(note("content/concept_notes/c", "n_nationkey % 5 = 1")).unionByName(note("content/own/o")).unionByName(note("literature/verified_claims/content/own/v"))
    notes = notes.unionByName(n.select(_cat("p", i).alias("project"), F.lit("content/log.md").alias("path"))).unionByName(note("content/_ledger/x"))
    notes = notes.filter("not (project in ('p6', 'p16') and path like 'content/own/%')")
    setting = lambda name, value: n.select(_cat("p", i).alias("project"), F.lit(name).alias("name"), value.alias("value"))
    paths = F.when(i % 7 == 1, "content/own/, other/").when(i % 7 == 2, "none").when(i % 7 == 3, "nowhere/ # comment").when(i % 7 == 4, "<paths>")
    return notes, setting("project_state", F.when(i % 8 == 5, "pristine").otherwise("Configured # now")).unionByName(setting("gated_paths", paths).filter("value is not null"))


def gated_prose(s, d):
    notes, settings = _prose(s, d)
    return board.prose(notes, settings).select("project", "path", "gated", board.machinery(C("path")).alias("machinery"))


def unscanned_prose(s, d):
    return board.unscanned(*_prose(s, d))


def gated_paths(s, d):
    notes, settings = _prose(s, d)
    return project.missing_paths(settings, notes)


def project_states_on_disk(s, d):
    """States of projects whose settings are all filled in, by what they gate and what is there."""
    notes, settings = _prose(s, d)
    n = _t(s, d, "nation").select(_cat("p", C("n_nationkey")).alias("project"))
    filled = n.select("project", F.explode(F.array(*map(F.lit, project.REQUIRED))).alias("name")).withColumn("value", F.lit("given"))
    return project.states(settings.withColumn("value", F.trim(F.substring_index("value", "#", 1))).unionByName(filled), n.withColumn("written", F.lit(True)), notes)


def claim_numbering(s, d):
    i = C("s_suppkey")
    second = F.when(i % 4 == 0, "2").when(i % 4 == 1, "3").when(i % 4 == 2, "1").otherwise("two")
    text = _cat(_on(i % 9 != 5, "## Claim 1\ntext\n"), "## claim ", second, "\n```\n## Claim 7\n```\n")
    found = board.numbering(_t(s, d, "supplier").select(_cat("k", i).alias("key"), text.alias("text")))
    return found.select("key", F.array_join(F.transform("numbers", lambda n: n.cast("string")), ",").alias("numbers"))


def superseded_claims(s, d):
    i = C("s_suppkey")
    text = _cat("## Claim 1\n**ID:** a\n**Supersedes:** k", i % 7, ":a (grounded by #a)\n", _on(i % 5 == 0, "**Supersedes:** old", i, "\n**Supports:** z:z\n"))
    return board.superseded(markdown.edges(_t(s, d, "supplier").select(_cat("k", i).alias("key"), text.alias("text"))))


def attestation_gate(s, d):
    i = C("s_suppkey")
    sup = _t(s, d, "supplier").withColumn("name", _cat("k", i, ".run.json"))
    runs = sup.select("name", F.when(i % 5 == 2, "{").otherwise("{}").alias("record"))
    checked = sup.filter("s_suppkey % 4 <> 1").select("name", (i % 7 != 3).alias("ok"))
    return board.unsigned(runs, sup.filter("s_suppkey % 3 <> 0").select(F.concat("name", F.lit(".sig")).alias("name")), checked)


def analysis_report(s, d):
    """section, item, detail of a project's analysis: the ten claims that bear most, edges not judged, shared premises."""
    from provenant.operators import graph

    files, records, edges, covered, findings = _parts(s, d)
    bearing = graph.load_bearing(edges.select("target", C("source").alias("grounding"))).orderBy(F.desc("total"), "node").limit(10)
    told = lambda df, section, item, detail: df.select(F.lit(section).alias("section"), item.alias("item"), detail.alias("detail"))
    top = told(bearing, "load bearing", C("node"), F.concat_ws(" ", "in_degree", "grounding_degree"))
    shown = board.shown_edges(edges, assessment.claim_table(files), files, covered).filter("not assessed")
    return top.unionByName(told(shown, "not judged", C("source"), F.concat_ws(" ", "type", "target"))).unionByName(told(findings, "shared premise", C("target"), F.concat_ws(" ", "a", "b", "kind")))


def citation_papers(s, d):
    i = C("c_custkey")
    c = _t(s, d, "customer")
    name = F.translate((i % 300).cast("string"), "0123456789", "abcdefghij")
    cites = c.select(F.when(i % 3 == 0, _cat("o'", name, "-x")).otherwise(_cat("au", name)).alias("author"), (F.lit(1990) + i % 5).cast("string").alias("year"))
    status = F.when(i % 4 == 0, "verified").when(i % 4 == 1, "downloaded").when(i % 4 == 2, "mismatch").otherwise("duplicate_of:z")
    rows = c.filter("c_custkey % 300 < 200").select(_cat(F.when(i % 3 == 0, _cat("o", name, "x")).otherwise(_cat("Au", name)), "_", F.lit(1990) + i % 5, F.when(i % 2 == 0, "b").otherwise("")).alias("key"), F.when(i % 5 == 1, "pdf").when(i % 5 == 2, "html").otherwise("xml").alias("extension"), status.alias("status"))
    files = c.filter("c_custkey % 300 >= 150 and c_custkey % 300 < 250").select(_cat("Au", name, "_", F.lit(1990) + i % 5, "_draft.txt").alias("name"))
    return citations.papers(cites, rows, files)


def register_review(s, d):
    i = C("c_custkey")
    status = F.when(i % 9 == 0, "mismatch").when(i % 9 == 1, "landing_page").when(i % 9 == 2, "unknown").when(i % 9 > 5, _cat("duplicate_of:key", (i % 27) + (i % 5))).when(i % 9 == 3, "verified").otherwise("downloaded")
    made = _t(s, d, "customer").select(_cat("f", i, ".pdf").alias("filename"), F.when(i % 9 != 2, _cat("key", i % 100)).alias("key"), status.alias("status"), F.when(i % 2 == 0, _cat("au", i % 10)).alias("fn_author"), F.lit("2001").alias("fn_year"), _cat("other", i % 3).alias("meta_author"), F.when(i % 4 == 0, "2003").alias("meta_year"), F.lit(1.5).alias("size_kb"), F.array(F.lit("noted"), _cat(i)).alias("notes"))
    return register.review(made)


def register_divergence(s, d):
    """Rows of a register that claim files contradict, and those that a citation may rest on."""
    i = C("c_custkey")
    c = _t(s, d, "customer")
    rows = c.select(_cat("au_", F.lit(1000) + i, F.when(i % 6 == 0, "b").when(i % 6 == 1, "?").otherwise("")).alias("key"), F.when(i % 5 != 0, _cat("10.1/A", i)).otherwise("").alias("doi"), F.sha2(_cat(i), 256).alias("sha256"), F.when(i % 7 == 0, "duplicate_of:x").when(i % 7 == 1, "unknown").otherwise("verified").alias("status"))
    files = c.filter("c_custkey % 3 <> 2").select(_cat("au_", F.lit(1000) + i, F.when(i % 6 == 0, "b").when(i % 6 == 1, "?").otherwise("")).alias("key"), F.when(i % 4 == 0, _cat("10.1/b", i)).when(i % 4 == 1, "").otherwise(_cat("10.1/A", i, ".v2")).alias("doi"), F.when(i % 11 == 4, F.sha2(F.lit("x"), 256)).when(i % 11 == 5, "short").otherwise(F.sha2(_cat(i), 256)).alias("source_sha256"))
    made = register.divergence(rows, files)
    good = register.usable(made).select("key").distinct().withColumn("usable", F.lit(True))
    return made.join(good, "key", "left").select("key", "status", F.coalesce("usable", F.lit(False)).alias("usable"))


def record_files(s, d):
    """The record gate over records that are written as files, each in a folder of its name, and read from there."""
    records, files = P._records(s, d)
    # Two records may have one name, so their digests tell the folders apart.
    path = written_files(records.select(F.concat_ws("@", "stem", F.sha2("record", 256)).alias("stem"), "record"), "stem", "record", "record-files")
    read = project_files.read_records(s, path, "")
    back = read.select(F.regexp_extract("path", "stem=(.*?)(?:@|%40)[0-9a-f]{64}/", 1).alias("stem"), F.regexp_replace("record", r"\n$", "").alias("record"))
    return assessment.record_problems(stored(back, "records"), files).select("id", "code", "detail")


def case_files(s, d):
    """The case gate over cases that are written as JSON Lines, some of them broken, and read from there."""
    odd = P._cases(s, d).withColumns({"quote": F.when(C("id") % 4 != 1, C("quote")), "gold": F.when(C("id") % 9 == 0, "maybe").when(C("id") % 9 != 1, C("gold"))})
    lines = odd.select(F.concat(F.to_json(F.struct(*odd.columns)), F.when(C("id") % 13 == 5, "}{").otherwise("")).alias("value"))
    path = scratch_path(s, "cases")
    lines.select(F.when(F.contains("value", F.lit("}}{")), "{not json").otherwise(C("value")).alias("value")).write.text(path)
    read = stored(project_files.read_lines(s, path), "cases")
    broken = read.select("broken").filter("broken is not null").agg(F.count(F.lit(1)).alias("n")).select(F.lit(-1).cast("long").alias("id"), F.concat(F.lit("broken "), "n").alias("code"))
    return faithfulness.case_problems(read.filter("broken is null").withColumn("id", C("id").cast("long"))).unionByName(broken)


def override_files(s, d):
    i = C("c_custkey")
    path = scratch_path(s, "overrides")
    rows = _t(s, d, "customer").select(F.when(i % 10 == 3, _cat("# f", i)).otherwise(_cat("f", i, ".pdf")).alias("filename"), _cat('Au "', i).alias("author"), F.when(i % 4 != 0, "2011").alias("year"), F.lit("verified").alias("status"), F.lit("seen").alias("reason"))
    rows.write.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return project_files.read_overrides(s, path)


#: Gates over other rows than projects, each with its query and the column whose number says which project a row is of.
_GATED = {
    "quote check": ("quote_check_files", "key", "verdict = 'fail'"), "provenance stamps": ("stamp_gate", "key", "true"), "citation coverage": ("citation_gate", "author", "true"), "claim-graph structure": ("structure_gate", "key", "true"), "assessment records": ("record_gate", "id", "true"),
    "claim coverage": ("coverage_gate", "key", "true"), "run-record attestation": ("attestation_gate", "name", "true"), "synthesis claims": ("synthesis_gate", "path", "true"), "wiki health": ("wiki_gate", "path", "true"), "unit manifests": ("units_bind", "key", "true"),
}


def gate_run_all(s, d):
    """Every gate of each project over what all of them find, each with its setting, and the verdict."""
    settings, n = P._settings(s, d)
    from provenant.plans import queries

    number = lambda key: (F.coalesce(F.regexp_extract(key, r"(\d+)", 1).try_cast("long"), F.lit(0)) % 25)
    found = [stored(queries.QUERIES[q](s, d).filter(on).groupBy(_cat("p", number(F.col(key))).alias("project")).agg(F.count(F.lit(1)).alias("n")), "gate").withColumn("gate", F.lit(g)) for g, (q, key, on) in _GATED.items()]
    found += [stored(f(s, d).groupBy("project").agg(F.count(F.lit(1)).alias("n")), "gate").withColumn("gate", F.lit(g)) for f, g in ((P.selection_gate, "selection audit"), (P.flow_gate, "source flow"))]
    found.append(P.project_states(s, d).filter("state = 'broken'").groupBy("project").agg(F.count(F.lit(1)).alias("n")).withColumn("gate", F.lit("project health")))
    i = C("n_nationkey")
    modes = [(setting, ("required", "block", "warn", "off")[k % 4]) for k, (_, setting) in enumerate(project.GATES) if setting]
    own = s.createDataFrame([(k, name, v) for k, (name, v) in enumerate(modes)], "k int, name string, value string")
    held = n.join(F.broadcast(own)).filter((C("i") + C("k")) % 3 != 0).select(_cat("p", C("i")).alias("project"), "name", "value")
    projects = _t(s, d, "nation").select(_cat("p", i).alias("project"), (i % 2 == 0).alias("strict"), (i % 9).alias("n_files"))
    absent = _t(s, d, "nation").filter("n_nationkey % 10 = 6").select(_cat("p", i).alias("project"), F.lit("quote check").alias("gate"))
    gates = project.run_gates(reduce(DataFrame.unionByName, found), project.postures(held), projects, absent)
    return gates.select("project", "gate", "status", "n", "blocking")


QUERIES = {f.__name__: f for f in (project_counters, graph_nodes, graph_edges, graph_awaiting, claim_neighbours, supplier_orders, document_table, finding_leads, claim_comments, pair_kinds, pair_kind_gate, gated_prose, unscanned_prose, gated_paths, project_states_on_disk, claim_numbering, superseded_claims, attestation_gate, analysis_report, citation_papers, register_review, register_divergence, record_files, case_files, override_files)}
QUERIES["gate_run_all"] = gate_run_all

_PAIRED = "pairs AS (SELECT i FROM s WHERE i % 6 = 2 AND i + 2 <= top)"
_SHOWN = f"""WITH {P._COVERED}, x AS (SELECT c.*, key.i FROM (SELECT *, from_key || ':' || grounding AS source FROM c WHERE grounding IS NOT NULL) c JOIN (SELECT i, top, 'k' || i AS k FROM s) key ON key.k = c.from_key),
  shown AS (SELECT i, source, target, type, covering AS record, covering IS NOT NULL AS assessed, NOT (target <> 'hub:h1' AND (i % 10 = 9 OR i >= (SELECT max(i) FROM s))) AS target_resolved FROM x)"""
_QUOTE = "CASE WHEN {0} = 'hub:h1' THEN 'A claim that many support in this project' WHEN contains({0}, ':a') THEN '" + P.ONE + "' WHEN contains({0}, ':b') THEN '" + P.TWO + "' ELSE '' END"
_PD = """n AS (SELECT n_nationkey AS i, 'n' || n_nationkey AS path FROM nation)"""
_PROSE = """n AS (SELECT n_nationkey AS i, 'p' || n_nationkey AS project, CASE WHEN n_nationkey % 8 = 5 THEN false ELSE true END AS configured, n_nationkey % 7 AS w FROM nation),
  f AS (SELECT i, project, w, configured, 'content/finding' || i || '.md' AS path, false AS machinery FROM n WHERE i % 3 <> 0 UNION ALL SELECT i, project, w, configured, 'content/concept_notes/c' || i || '.md', false FROM n WHERE i % 5 = 1
    UNION ALL SELECT i, project, w, configured, 'content/own/o' || i || '.md', false FROM n WHERE i NOT IN (6, 16) UNION ALL SELECT i, project, w, configured, 'literature/verified_claims/content/own/v' || i || '.md', false FROM n
    UNION ALL SELECT i, project, w, configured, 'content/log.md', true FROM n UNION ALL SELECT i, project, w, configured, 'content/_ledger/x' || i || '.md', true FROM n),
  g AS (SELECT *, path NOT LIKE '%verified_claims/%' AND CASE w WHEN 1 THEN path LIKE '%content/own/%' WHEN 2 THEN false WHEN 3 THEN false ELSE path LIKE '%content/concept_notes/%' END AS gated FROM f)"""

_LOST = """asked AS (SELECT i, project, unnest(CASE w WHEN 1 THEN ['content/own/', 'other/'] WHEN 2 THEN [] WHEN 3 THEN ['nowhere/'] ELSE ['content/concept_notes/', 'content/literature_reviews/'] END) AS path FROM n),
  lost AS (SELECT project, path FROM asked WHERE path IN ('other/', 'nowhere/', 'content/literature_reviews/') OR (path = 'content/own/' AND i IN (6, 16)) OR (path = 'content/concept_notes/' AND i % 5 <> 1))"""

ORACLES = {
    "project_counters": f"""WITH {P._COVERED}, {_PAIRED}, fs AS (SELECT 'k' || i AS key, 'p' || (i % 4) AS project FROM s UNION ALL SELECT 'hub', 'p0'),
  ev AS (SELECT project, 'ledgers' AS what FROM fs UNION ALL SELECT project, 'edges' FROM c JOIN fs ON key = from_key UNION ALL SELECT project, 'assessed_edges' FROM c JOIN fs ON key = from_key UNION ALL SELECT project, 'unassessed_edges' FROM c JOIN fs ON key = from_key WHERE covering IS NULL
    UNION ALL SELECT project, 'records' FROM rec JOIN fs ON key = split_part(subject, ':', 1) UNION ALL SELECT project, CASE kind WHEN 'faithfulness' THEN 'faithfulness_records' ELSE 'faithfulness_passes' END FROM rec JOIN fs ON key = split_part(subject, ':', 1) WHERE kind <> 'edge'
    UNION ALL SELECT project, 'disputed_records' FROM (SELECT id, min(key) AS k FROM (SELECT split_part(subject, ':', 1) AS key, CASE WHEN i % 16 = 9 THEN 'gone' ELSE 'e' || i END AS id FROM rec WHERE kind = 'faithfulness' AND i % 8 <> 5) GROUP BY id) x JOIN fs ON fs.key = x.k
    UNION ALL SELECT project, 'double_count_findings' FROM pairs JOIN fs ON key = least('k' || i, 'k' || (i + 2)))
SELECT project, {", ".join(f"count(*) FILTER (what = '{w}') AS {w}" for w in board.COUNTERS[:10])} FROM ev GROUP BY GROUPING SETS ((project), ())""",
    "graph_edges": f"{_SHOWN} SELECT source, target, type, record, assessed, target_resolved FROM shown",
    "graph_awaiting": f"{_SHOWN} SELECT source, target, type, CASE WHEN target_resolved THEN {_QUOTE.format('target')} ELSE '' END AS subject_quote, {_QUOTE.format('source')} AS grounding_quote, 'k' || i || '-' || type || '-' || split_part(target, ':', 2) || '-apt' AS suggested_id FROM shown WHERE NOT assessed",
    "graph_nodes": f"""WITH {P._COVERED}, {_PAIRED}, twice AS (SELECT 'k' || i AS k FROM pairs UNION SELECT 'k' || (i + 2) FROM pairs),
  every AS (SELECT target AS id FROM c UNION SELECT from_key || ':' || grounding FROM c WHERE grounding IS NOT NULL UNION SELECT subject FROM rec UNION SELECT ground FROM rec),
  parts AS (SELECT id, split_part(id, ':', 1) AS ledger, split_part(id, ':', 2) AS slug FROM every), about AS (SELECT subject AS id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS n FROM rec GROUP BY 1),
  fought AS (SELECT DISTINCT subject AS id FROM rec WHERE kind = 'edge' AND id IN (SELECT 'e' || i FROM rec WHERE kind = 'faithfulness' AND i % 8 <> 5 AND i % 16 <> 9)),
  there AS (SELECT 'k' || i || ':a' || i AS id FROM s UNION ALL SELECT 'k' || i || ':b' || i FROM s UNION ALL SELECT 'hub:h1')
SELECT id, ledger, slug, CASE WHEN id IN (SELECT id FROM there) THEN {_QUOTE.format('id')} ELSE '' END AS quote, '' AS location, '' AS source, '' AS locator,
  CASE WHEN ledger IN (SELECT 'k' || i FROM s) THEN array_to_string(list_sort(list_distinct(['q' || (CAST(ledger[2:] AS BIGINT) % 5)] || CASE WHEN CAST(ledger[2:] AS BIGINT) % 9 = 4 AND CAST(ledger[2:] AS BIGINT) % 2 = 0 THEN ['q1'] ELSE [] END)), ',') ELSE '' END AS qids,
  coalesce(kinds, '') AS kinds, coalesce(n, 0) AS n_records, id IN (SELECT id FROM fought) AS contested, ledger IN (SELECT k FROM twice) AS double_count, id IN (SELECT id FROM there) AS resolved FROM parts LEFT JOIN about USING (id)""",
    "claim_neighbours": f"""WITH {P._EDGE}, b AS (SELECT DISTINCT target AS a, key || ':' || grounding AS b FROM e WHERE grounding IS NOT NULL), w AS (SELECT a AS node, b AS neighbour FROM b UNION SELECT b, a FROM b)
SELECT node, neighbour, count(*) OVER (PARTITION BY node) AS n_neighbours, true AS split FROM w""",
    "supplier_orders": "WITH b AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem) SELECT a AS node, count(*) AS n_neighbours FROM b GROUP BY a UNION ALL SELECT b, count(*) FROM b GROUP BY b",
    "document_table": """WITH s AS (SELECT s_suppkey AS i FROM supplier), x AS (SELECT i, CASE WHEN i % 3 = 0 THEN 'The ' || (1990 + i % 40) || ' paper ' || i ELSE 'k' || i END AS paper FROM s)
SELECT 'k' || i AS key, paper, CASE WHEN i % 3 = 0 THEN CAST(1990 + i % 40 AS VARCHAR) WHEN i % 4 <> 1 THEN '20' || (10 + i % 9) ELSE '' END AS year, CASE WHEN i % 5 = 0 THEN 'v' || i ELSE '' END AS version, CASE WHEN i % 3 = 1 THEN 'side' || i % 2 ELSE '' END AS position,
  CASE WHEN i % 2 = 0 THEN 3 ELSE 2 END AS claims, CASE WHEN i % 7 = 2 THEN 'pass' ELSE 'unstamped' END AS verdict, CASE WHEN i % 6 = 1 THEN '10.1371/' || i WHEN i % 6 > 3 THEN 'http://x/' || i ELSE '' END AS locator FROM x""",
    "finding_leads": r"""WITH x AS (SELECT doc_id AS i, trim(regexp_replace(split_part(coalesce(text, ''), chr(10), 1), '[`*\[\]#-]|^\s+|\s+$', '', 'g')) AS l FROM documents)
SELECT i AS doc_id, sha256(CASE i % 5 WHEN 0 THEN trim(l || ' and more of it') WHEN 2 THEN l || CASE WHEN l = '' THEN 'see note rule passed' ELSE ' see note rule passed' END WHEN 3 THEN trim('open: x ' || l) ELSE '' END) AS digest FROM x""",
    "claim_comments": """WITH s AS (SELECT s_suppkey AS i, 'k' || s_suppkey AS key FROM supplier)
SELECT key, 1 AS ordinal, 'rhetorical' AS kind, '' AS target, 'so sure ' || i AS span, 'the tone  is high' AS note, 'r' || i AS record FROM s WHERE i % 2 = 0
UNION ALL SELECT key, 1, 'status', '', '', 'settled  — by ' || i, '' FROM s WHERE i % 3 = 0 UNION ALL SELECT key, 1, 'correlated', 'k' || i || ':b', '', 'kind: shared-evidence', 'q' FROM s WHERE i % 4 = 0 UNION ALL SELECT key, 2, 'crux', 'q' || i, '', 'if it holds', '' FROM s WHERE i % 5 = 0""",
    "pair_kinds": f"""WITH {_PD}, h AS (SELECT *, 4 + (i % 3 <> 0)::INT + (i % 4 <> 1)::INT AS top FROM n)
SELECT path, top + 1 AS line, 'ka' AS a, 'kb' AS b, CASE WHEN i % 5 = 2 THEN 'sameness' ELSE 'shared-evidence' END AS kind FROM h UNION ALL SELECT path, top + 5, 'kb', 'ka', 'overlapping-pools' FROM h WHERE i % 2 = 0
UNION ALL SELECT path, top + CASE WHEN i % 2 = 0 THEN 7 ELSE 4 END, 'kx', 'ky', 'exact-cohort-reuse' FROM h WHERE i % 7 <> 3""",
    "pair_kind_gate": f"""WITH {_PD} SELECT path, 'no provenance' AS code, 'authored_by' AS detail FROM n WHERE i % 3 = 0 UNION ALL SELECT path, 'no provenance', 'status' FROM n WHERE i % 4 = 1 UNION ALL SELECT path, 'unknown kind', 'ka kb sameness' FROM n WHERE i % 5 = 2
UNION ALL SELECT path, 'duplicate', 'kb ka' FROM n WHERE i % 2 = 0 UNION ALL SELECT path, 'orphan', 'kx ky' FROM n WHERE i % 7 <> 3 AND i % 6 <> 4""",
    "gated_prose": f"WITH {_PROSE} SELECT project, path, gated, machinery FROM g",
    "unscanned_prose": f"""WITH {_PROSE}, r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY split_part(path, '/', -1)) AS k FROM g WHERE NOT machinery AND configured AND w <> 2),
  held AS (SELECT project FROM g WHERE gated) SELECT project, count(*) AS n_prose, string_agg(split_part(path, '/', -1), ', ' ORDER BY k) FILTER (k <= 5) AS examples FROM r WHERE project NOT IN (SELECT project FROM held) GROUP BY project""",
    "gated_paths": f"WITH {_PROSE}, {_LOST} SELECT project, path FROM lost",
    "project_states_on_disk": f"WITH {_PROSE}, {_LOST} SELECT project, CASE WHEN NOT configured OR project IN (SELECT project FROM lost) THEN 'broken' ELSE 'configured' END AS state FROM n",
    "claim_numbering": """WITH s AS (SELECT s_suppkey AS i, list_filter([CASE WHEN s_suppkey % 9 <> 5 THEN '1' END, CASE s_suppkey % 4 WHEN 0 THEN '2' WHEN 1 THEN '3' WHEN 2 THEN '1' END], lambda x: x IS NOT NULL) AS l FROM supplier)
SELECT 'k' || i AS key, array_to_string(l, ',') AS numbers FROM s WHERE len(l) > 0 AND array_to_string(l, ',') NOT IN ('1', '1,2')""",
    "superseded_claims": "SELECT DISTINCT 'k' || s_suppkey % 7 || ':a' AS target FROM supplier UNION SELECT 'k' || s_suppkey || ':old' || s_suppkey FROM supplier WHERE s_suppkey % 5 = 0",
    "attestation_gate": "SELECT 'k' || s_suppkey || '.run.json' AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'no signature' WHEN s_suppkey % 5 = 2 THEN 'unreadable' ELSE 'not verified' END AS code FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 5 = 2 OR s_suppkey % 4 = 1 OR s_suppkey % 7 = 3",
    "analysis_report": f"""{_SHOWN}, {_PAIRED}, ends AS (SELECT target AS node, 1 AS a, 0 AS b FROM c UNION ALL SELECT from_key || ':' || grounding, 0, 1 FROM c WHERE grounding IS NOT NULL), top AS (SELECT node, sum(a) AS a, sum(b) AS b FROM ends GROUP BY node ORDER BY count(*) DESC, encode(node) LIMIT 10)
SELECT 'load bearing' AS section, node AS item, a || ' ' || b AS detail FROM top UNION ALL SELECT 'not judged', source, type || ' ' || target FROM shown WHERE NOT assessed
UNION ALL SELECT 'shared premise', 'hub:h1', least('k' || i, 'k' || (i + 2)) || ' ' || greatest('k' || i, 'k' || (i + 2)) || ' shared-evidence' FROM pairs""",
    "citation_papers": """WITH c AS (SELECT c_custkey AS i, c_custkey % 300 AS m, translate(CAST(c_custkey % 300 AS VARCHAR), '0123456789', 'abcdefghij') AS w, CAST(1990 + c_custkey % 5 AS VARCHAR) AS year FROM customer),
  a AS (SELECT DISTINCT CASE WHEN i % 3 = 0 THEN 'o''' || w || '-x' ELSE 'au' || w END AS author, CASE WHEN i % 3 = 0 THEN 'o' || w || 'x' ELSE 'au' || w END AS plain, year FROM c),
  r AS (SELECT CASE WHEN i % 3 = 0 THEN 'o' || w || 'x' ELSE 'au' || w END AS plain, year, CASE WHEN i % 3 = 0 THEN 'o' || w || 'x' ELSE 'Au' || w END || '_' || year || CASE WHEN i % 2 = 0 THEN 'b' ELSE '' END AS key, CASE i % 5 WHEN 1 THEN 'pdf' WHEN 2 THEN 'html' ELSE 'xml' END AS extension,
    CASE i % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'downloaded' WHEN 2 THEN 'mismatch' ELSE 'duplicate_of:z' END AS status FROM c WHERE m < 200),
  k AS (SELECT *, row_number() OVER (PARTITION BY plain, year ORDER BY CASE status WHEN 'verified' THEN 0 WHEN 'downloaded' THEN 1 ELSE 2 END, CASE extension WHEN 'html' THEN 0 WHEN 'pdf' THEN 1 ELSE 2 END, encode(key), extension, status) AS n, bool_or(status <> 'mismatch') OVER (PARTITION BY plain, year) AS usable FROM r),
  f AS (SELECT DISTINCT 'au' || w AS plain, year FROM c WHERE m >= 150 AND m < 250)
SELECT a.author, a.year, CASE WHEN k.usable THEN 'register' WHEN f.plain IS NOT NULL THEN 'file' END AS "by", k.key, k.extension, k.status FROM a LEFT JOIN k ON k.plain = a.plain AND k.year = a.year AND k.n = 1 LEFT JOIN f ON f.plain = a.author AND f.year = a.year""",
    "register_review": f"""WITH c AS (SELECT c_custkey AS i, 'f' || c_custkey || '.pdf' AS f, c_custkey % 9 AS w, 'key' || (c_custkey % 27 + c_custkey % 5) AS dup FROM customer),
  s AS (SELECT i, f, dup, CASE WHEN w = 0 THEN 'mismatch' WHEN w = 1 THEN 'landing_page' WHEN w = 2 THEN 'unknown' WHEN w > 5 THEN 'duplicate_of' WHEN w = 3 THEN 'verified' ELSE 'downloaded' END AS st, CASE WHEN w <> 2 THEN 'key' || i % 100 END AS key FROM c),
  top AS (SELECT dup, count(*) AS n FROM s WHERE st = 'duplicate_of' GROUP BY dup ORDER BY n DESC, encode(dup) LIMIT 20), ex AS (SELECT s.dup, n, f, row_number() OVER (PARTITION BY s.dup ORDER BY encode(f)) AS k FROM s JOIN top USING (dup) WHERE st = 'duplicate_of')
SELECT 'status' AS section, t.st AS item, count(s.i) AS n, NULL AS detail FROM (VALUES {", ".join(f"('{x}')" for x in register.STATUSES)}) t(st) LEFT JOIN s ON s.st = t.st GROUP BY t.st
UNION ALL SELECT 'status', 'files', count(*), NULL FROM s UNION ALL SELECT 'status', 'keys', count(DISTINCT key) FILTER (st <> 'duplicate_of'), NULL FROM s
UNION ALL SELECT 'mismatch', f, NULL, CASE WHEN i % 2 = 0 THEN 'au' || i % 10 ELSE '?' END || '_2001 | other' || i % 3 || '_' || CASE WHEN i % 4 = 0 THEN '2003' ELSE '?' END FROM s WHERE st = 'mismatch'
UNION ALL SELECT st, f, NULL, 'noted; ' || i FROM s WHERE st IN ('landing_page', 'unknown') UNION ALL SELECT 'cluster', dup, any_value(n), string_agg(f, ', ' ORDER BY k) FROM ex WHERE k <= 3 GROUP BY dup""",
    "register_divergence": """WITH c AS (SELECT c_custkey AS i, 'au_' || (1000 + c_custkey) || CASE c_custkey % 6 WHEN 0 THEN 'b' WHEN 1 THEN '?' ELSE '' END AS key, CASE c_custkey % 7 WHEN 0 THEN 'duplicate_of:x' WHEN 1 THEN 'unknown' ELSE 'verified' END AS st FROM customer),
  x AS (SELECT *, i % 3 <> 2 AND (i % 5 <> 0 AND i % 4 = 0 OR i % 11 = 4) AND i % 7 <> 0 AS apart FROM c), y AS (SELECT key, i, CASE WHEN apart THEN 'mismatch' ELSE st END AS status FROM x)
SELECT key, status, i % 6 <> 1 AND length(CAST(1000 + i AS VARCHAR)) = 4 AND (status = 'verified' OR status = 'duplicate_of:x') AS usable FROM y""",
    "record_files": P.ORACLES["record_gate"],
    "case_files": """WITH p AS (SELECT p_partkey AS i FROM part), k AS (SELECT i FROM p WHERE i % 13 <> 5) SELECT i AS id, 'no quote' AS code FROM k WHERE i % 4 = 1 UNION ALL SELECT i, 'no gold' FROM k WHERE i % 9 = 1 UNION ALL SELECT i, 'gold' FROM k WHERE i % 9 = 0 UNION ALL SELECT -1, 'broken ' || count(*) FROM p WHERE i % 13 = 5""",
    "override_files": """SELECT 'f' || c_custkey || '.pdf' AS filename, 'Au "' || c_custkey AS author, CASE WHEN c_custkey % 4 <> 0 THEN '2011' END AS year, 'verified' AS status, 'seen' AS reason FROM customer WHERE c_custkey % 10 <> 3""",
}


def _gate_rows() -> str:
    """gate, place of its setting among settings, the value that gate_run_all gives it, or the usual one where it may not be, and the usual one."""
    settings, rows = [x for _, x in project.GATES if x], []
    for place, (gate, setting) in enumerate(project.GATES):
        if setting:
            value, usual = ("required", "block", "warn", "off")[place % 4], project.POSTURES[setting][0]
            rows.append(f"('{gate}', {settings.index(setting)}, '{value if value in project.POSTURES[setting] else usual}', '{usual}')")
        else:
            rows.append(f"('{gate}', NULL, NULL, NULL)")
    return ", ".join(rows)


def _gate_sql() -> str:
    from provenant.plans import queries

    texts = {**P.ORACLES, **ORACLES, **{"units_bind": queries.ORACLES["units_bind"]}}
    found = [f"SELECT 'p' || (coalesce(TRY_CAST(nullif(regexp_extract(CAST({key} AS VARCHAR), '([0-9]+)', 1), '') AS BIGINT), 0) % 25) AS project, '{gate}' AS gate FROM ({texts[q]}) WHERE {on}" for gate, (q, key, on) in _GATED.items()]
    found += [f"SELECT project, '{gate}' FROM ({texts[q]}) WHERE {on}" for gate, q, on in (("selection audit", "selection_gate", "true"), ("source flow", "flow_gate", "true"), ("project health", "project_states", "state = 'broken'"))]
    return f"""WITH g(gate, k, own, usual) AS (VALUES {_gate_rows()}), hits AS ({" UNION ALL ".join(found)}), counted AS (SELECT project, gate, count(*) AS n FROM hits GROUP BY ALL),
  each AS (SELECT 'p' || i AS project, g.gate, coalesce(n, 0) AS n, CASE WHEN k IS NULL THEN NULL WHEN (i + k) % 3 <> 0 THEN own ELSE usual END AS value, i % 2 = 0 AS strict, i % 9 AS files, i % 10 = 6 AND g.gate = 'quote check' AS absent
    FROM (SELECT n_nationkey AS i FROM nation) CROSS JOIN g LEFT JOIN counted c ON c.project = 'p' || i AND c.gate = g.gate),
  told AS (SELECT *, CASE WHEN gate = 'quote check' AND files = 0 THEN 'not applicable' WHEN absent THEN 'unavailable' WHEN n > 0 AND value IS DISTINCT FROM 'off' THEN CASE WHEN value NOT IN ('required', 'block') THEN 'warn' ELSE 'fail' END WHEN value = 'off' THEN 'inactive' ELSE 'pass' END AS status FROM each)
SELECT project, gate, status, n, status = 'fail' OR (status = 'unavailable' AND strict AND value IS DISTINCT FROM 'off') AS blocking FROM told"""
