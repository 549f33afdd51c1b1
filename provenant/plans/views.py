"""Queries of what projects show of themselves, over the claim files and records of plans.projects, with SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenant.operators import assessment, views
from provenant.plans import projects as P
from provenant.sources import markdown
from provenant.sources.scratch import stored

C = F.col


def _warnings(s, files, records):
    return assessment.double_counts(files, records, s.createDataFrame([], "lo string, hi string, kind string"))


def _subjects(s, d, good, records, files):
    refs = P._prose_refs(s, d, good, records).filter("outcome = 'valid'").select("ref")
    return views.trace(_warnings(s, files, records), good, refs)


def evidence_trace(s, d):
    found = _subjects(s, d, *P._valid(s, d))
    return found.select("subject", F.array_join("reasons", "; ").alias("reasons"), "n_warnings", "n_cited")


def evidence_edges(s, d):
    good, records, files = P._valid(s, d)
    subjects = stored(_subjects(s, d, good, records, files), "subjects")
    return views.trace_edges(subjects, files, records, good).drop("line")


def contested_claims(s, d):
    return views.contested(P._records(s, d)[0])


def recorded_judgements(s, d):
    good, records, files = P._valid(s, d)
    return views.judgements(records, good, _warnings(s, files, records))


def edge_targets(s, d):
    return views.targets(markdown.edges(P._claim_files(s, d)))


def edge_aptness(s, d):
    good, records, files = P._valid(s, d)
    return views.aptness(assessment.edge_problems(markdown.edges(files), assessment.parse(records), assessment.coverage_of(good)))


def source_choice(s, d):
    """The source of each customer's key, for extracts and for units."""
    c = P._t(s, d, "customer").select(C("c_custkey").alias("i"), P._cat("k", C("c_custkey")).alias("key"))
    there = F.array_compact(F.array(F.when(C("i") % 2 == 0, "pdf"), F.when(C("i") % 3 == 0, "html"), F.when(C("i") % 5 == 0, "xml")))
    present = c.select("key", F.explode(there).alias("extension"))
    cited = c.filter("i % 4 in (1, 2)").select("key", F.when(C("i") % 4 == 1, "html").otherwise("xml").alias("extension"))
    one = lambda name, order: views.choose_sources(present, cited, order).select(F.lit(name).alias("use"), "key", "extension", "fallback")
    return one("extract", views.FOR_EXTRACTS).unionByName(one("units", views.FOR_UNITS))


def corpus_inventory(s, d):
    files = P._parsed(s, d).withColumn("case", P._cat("c", F.substring("key", 2, 9).cast("int") % 3))
    present = P._suppliers(s, d).filter("i % 2 = 0").select(P._cat("c", C("i") % 3).alias("case"), P._cat("papers/k", C("i")).alias("file"))
    return views.inventory(files, present)


def corpus_status(s, d):
    return corpus_inventory(s, d).groupBy("case", "redistribution_status").agg(F.count(F.lit(1)).alias("sources"), F.count_if(C("corpus_present") == "yes").alias("present"), F.count_if(C("included_in_submission") == "yes").alias("included"))


QUERIES = {f.__name__: f for f in (evidence_trace, evidence_edges, contested_claims, recorded_judgements, edge_targets, edge_aptness, source_choice, corpus_inventory, corpus_status)}

_PAIRS = "fine AS (SELECT * FROM rec WHERE id NOT IN (SELECT id FROM wrong)), pairs AS (SELECT i FROM s WHERE i % 6 = 2 AND i + 2 <= top)"
_TRACE = f"""{_PAIRS}, told AS (SELECT 'hub:h1' AS subject, 1 AS w, 0 AS j, 0 AS c FROM pairs UNION ALL SELECT subject, 0, 1, 0 FROM fine UNION ALL SELECT subject, 0, 0, 1 FROM fine WHERE kind = 'edge'),
  trace AS (SELECT subject, sum(w) AS w, sum(j) AS j, sum(c) AS c FROM told GROUP BY subject)"""
_INVENTORY = f"""{P._STAMPS}, inv AS (SELECT 'c' || (i % 3) AS "case", key AS source_key, '' AS title, CASE WHEN i % 4 <> 2 THEN '10.1371/' || i ELSE '' END AS locator, 'papers/' || key AS local_filename,
    CASE WHEN st THEN sha256('s' || i) ELSE '' END AS expected_sha256, CASE WHEN i % 2 = 0 THEN 'yes' ELSE 'no' END AS corpus_present, CASE WHEN i % 4 = 0 THEN 'yes' ELSE 'no' END AS included_in_submission,
    CASE WHEN i % 4 <> 2 THEN 'permissive-licence' ELSE 'unknown' END AS redistribution_status, CASE WHEN i % 4 <> 2 THEN 'PLOS journals publish every article under CC-BY 4.0' ELSE 'no DOI or repository licence established' END AS licence_or_basis,
    CASE WHEN i % 4 <> 2 THEN 'DOI registrant 10.1371 = PLOS' ELSE 'no DOI / pmcid in provenance' END AS evidence_for_status, CASE WHEN i % 4 <> 2 THEN 'https://doi.org/10.1371/' || i ELSE '' END AS acquisition_command_or_instructions,
    'attested' AS verification_mode, CASE WHEN i % 2 = 0 THEN '' ELSE '{views.NOT_ON_DISK}' END AS notes FROM f WHERE i % 7 <> 1)"""

ORACLES = {
    "evidence_trace": f"WITH {P._RECORDS}, {_TRACE} SELECT subject, concat_ws('; ', CASE WHEN w > 0 THEN 'derived warning' END, CASE WHEN j > 0 THEN 'recorded judgement' END, CASE WHEN c > 0 THEN 'authored reference' END) AS reasons, CAST(w AS BIGINT) AS n_warnings, CAST(c AS BIGINT) AS n_cited FROM trace",
    "evidence_edges": f"""WITH {P._COVERED}, {_TRACE}, told_of AS (SELECT CASE WHEN kind = 'faithfulness' AND i % 16 = 9 THEN 'gone' ELSE 'e' || i END AS id, count(*) FILTER (kind = 'faithfulness') AS d, count(*) FILTER (kind <> 'faithfulness') AS r FROM fine WHERE kind <> 'edge' GROUP BY 1)
  SELECT c.target AS subject, c.from_key || ':' || c.grounding AS source, c.type, CASE WHEN c.grounding = 'nope' THEN '' WHEN c.grounding[1] = 'b' THEN '{P.TWO}' ELSE '{P.ONE}' END AS quote, '' AS paper, c.covering AS record, coalesce(d, 0) AS n_contests, coalesce(r, 0) AS n_upholds
  FROM c JOIN trace ON trace.subject = c.target LEFT JOIN told_of ON told_of.id = c.covering WHERE c.grounding IS NOT NULL""",
    "contested_claims": f"WITH {P._RECORDS} SELECT DISTINCT subject FROM rec WHERE i % 4 = 1 AND i % 8 <> 5 AND i % 16 <> 9",
    "recorded_judgements": f"""WITH {P._RECORDS}, {_PAIRS}, named AS (SELECT 'k' || i AS key FROM pairs UNION SELECT 'k' || (i + 2) FROM pairs)
  SELECT id, kind, CASE WHEN kind = 'edge' AND i % 5 = 2 THEN '2024' ELSE '20240101' END AS date, subject, CASE WHEN id IN (SELECT id FROM fine) THEN 'verified' ELSE 'unverified' END AS integrity, CASE kind WHEN 'faithfulness' THEN 'disputed' WHEN 'faithfulness-pass' THEN 'reviewed — held' ELSE 'sealed record' END AS label,
    replace(subject, ':', '-') AS anchor, 'k' || i IN (SELECT key FROM named) OR 'k' || (i + 1) IN (SELECT key FROM named) AS relevant FROM rec""",
    "edge_targets": f"WITH {P._EDGE} SELECT target AS claim, count(*) AS incoming FROM e GROUP BY target",
    "edge_aptness": f"WITH {P._COVERED} SELECT count(covering) AS reviewed, count(*) AS total FROM c",
    "source_choice": """WITH c AS (SELECT c_custkey AS i, 'k' || c_custkey AS key FROM customer), x AS (SELECT use, key, i, CASE WHEN i % 4 = 1 AND i % 3 = 0 THEN 'html' WHEN i % 4 = 2 AND i % 5 = 0 THEN 'xml' END AS cited,
    CASE WHEN use = 'extract' AND i % 2 = 0 THEN 'pdf' WHEN i % 3 = 0 THEN 'html' WHEN i % 2 = 0 THEN 'pdf' END AS usual FROM c, (VALUES ('extract'), ('units')) t(use))
  SELECT use, key, coalesce(cited, usual) AS extension, cited IS NULL AND i % 4 IN (1, 2) AS fallback FROM x WHERE coalesce(cited, usual) IS NOT NULL""",
    "corpus_inventory": f"WITH {_INVENTORY} SELECT * FROM inv",
    "corpus_status": f"""WITH {_INVENTORY} SELECT "case", redistribution_status, count(*) AS sources, count(*) FILTER (corpus_present = 'yes') AS present, count(*) FILTER (included_in_submission = 'yes') AS included FROM inv GROUP BY ALL""",
}
