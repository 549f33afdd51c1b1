"""Queries of the operators on whole projects: claim files, records and registers made out of the driver's tables, with SQL for each.

Every supplier is a claim file; what is wrong with it follows from its number, so SQL can say what has to be found.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from provenant.functions import text as X
from provenant.operators import assessment, citations, faithfulness, metrics, project, provenance, quotecheck, register, selection, synthesis
from provenant.sources import fields, html_units, markdown
from provenant.sources.scratch import bounded_batches, dealt, stored

C = F.col
NONE = "cast(null as string)"


def _t(s, d, name):
    bounded_batches(s)
    return s.read.parquet(f"{d}/{name}.parquet")


def _cat(*parts):
    """Parts joined; strings are texts, nulls empty."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def _on(condition, *parts):
    return F.when(condition, _cat(*parts)).otherwise("")


def _suppliers(s, d):
    return dealt(_t(s, d, "supplier").select(C("s_suppkey").alias("i")), "i")


ONE = 'The first finding of this file is long enough to count'
TWO = 'A second finding that says something else altogether'


def _claim_files(s, d):
    """key, text: two claims each; the first supports the next file's and may lack its parts, a fenced claim is none."""
    target = F.when(C("i") % 10 == 9, _cat("k", C("i") + 1, ":zz")).otherwise(_cat("k", C("i") + 1, ":a", C("i") + 1))
    ground = F.when(C("i") % 11 == 5, " (grounded by #nope)").when(C("i") % 13 == 6, "").otherwise(_cat(" (grounded by #a", C("i"), ")"))
    rec = F.when(C("i") % 4 == 1, _cat(" [rec: E", C("i"), "]")).when(C("i") % 4 == 2, " [rec: lost]").otherwise("")
    text = _cat(
        "---\nfile: papers/k", C("i"), ".html\nsource_version: v1\n---\nPreamble with **ID:** decoy\n## Claim 1\n> \"", ONE, "\"\n> a note\n**ID:** A", C("i"), "\n**Locus:** p", C("i") % 3, "\n**Addresses:** q", C("i") % 5, "\n**Supports:** ", target, ground, rec, "\n",
        _on(C("i") % 17 == 3, "**Rebuts:** ", target, ground, "\n"), _on(C("i") % 6 == 2, "**Correlated-with:** k", C("i") + 2, ":a", C("i") + 2, " [kind: shared-evidence; cohort ", C("i"), "]\n"),
        "## Claim 2\n> \"", TWO, "\"\n**ID:** b", C("i"), "\n", _on(C("i") % 9 == 4, "**Status:** performed-settling\n"), _on((C("i") % 9 == 4) & (C("i") % 2 == 0), "**Crux-of:** q1\n"), _on(C("i") % 2 == 0, "**Supports:** hub:h1 (grounded by #b", C("i"), ")\n"), "```\n## Claim 9\n**ID:** fenced\n```\n",
    )
    hub = s.createDataFrame([("hub", '## Claim 1\n> "A claim that many support in this project"\n**ID:** h1\n')], "key string, text string")
    return _suppliers(s, d).select(_cat("k", C("i")).alias("key"), text.alias("text")).unionByName(hub)


_I = "s AS (SELECT s_suppkey AS i, max(s_suppkey) OVER () AS top FROM supplier)"
_EDGE = f"""{_I}, one AS (SELECT i, top, 'k' || i AS key, CASE WHEN i % 10 = 9 THEN 'k' || (i + 1) || ':zz' ELSE 'k' || (i + 1) || ':a' || (i + 1) END AS target,
    CASE WHEN i % 11 = 5 THEN 'nope' WHEN i % 13 = 6 THEN NULL ELSE 'a' || i END AS grounding FROM s),
  e AS (SELECT i, top, key, 'supports' AS type, target, grounding, CASE i % 4 WHEN 1 THEN 'e' || i WHEN 2 THEN 'lost' END AS rec FROM one
    UNION ALL SELECT i, top, key, 'rebuts', target, grounding, NULL FROM one WHERE i % 17 = 3
    UNION ALL SELECT i, top, 'k' || i, 'supports', 'hub:h1', 'b' || i, NULL FROM s WHERE i % 2 = 0)"""


def claim_scan(s, d):
    return markdown.aliases(markdown.claims(_claim_files(s, d)))


def edge_scan(s, d):
    return markdown.edges(_claim_files(s, d)).drop("line")


def edge_resolution(s, d):
    files = _claim_files(s, d)
    asked = markdown.edges(files).select("from_key", "type", C("target").alias("address"))
    return assessment.resolve(asked, assessment.claim_table(files), files)


def _questions(s):
    return s.createDataFrame([("q0",), ("Q1",), ("q2",), ("q3",)], "qid string")


def structure_gate(s, d):
    return assessment.structure_problems(_claim_files(s, d), _questions(s))


def _records(s, d):
    """stem, record: an edge record for every third file's first edge, a judgement of it, and what may be wrong with them."""
    files = stored(_claim_files(s, d), "claim-files")
    claims = stored(assessment.claim_table(files).select(F.concat_ws(":", "key", "alias").alias("subject"), F.sha2("body", 256).alias("now")), "claims")
    to = F.when(C("i") % 10 == 9, _cat("k", C("i") + 1, ":zz")).otherwise(_cat("k", C("i") + 1, ":a", C("i") + 1))
    from_ = F.when(C("i") % 11 == 5, _cat("k", C("i"), ":nope")).otherwise(_cat("k", C("i"), ":a", C("i")))
    base = _suppliers(s, d).filter("i % 3 = 1 or i % 4 = 1")
    edges = base.select("i", _cat("e", C("i")).alias("id"), _cat("e", C("i"), ".assess").alias("stem"), F.lit("edge").alias("kind"), to.alias("subject"), from_.alias("ground"), F.when(C("i") % 5 == 2, "2024").otherwise("20240101").alias("day"), F.expr(NONE).alias("disputes"), F.expr(NONE).alias("reviews"), F.expr(NONE).alias("span"))
    told = base.filter("i % 2 = 1").select("i", _cat("f", C("i")).alias("id"), F.when(C("i") % 7 == 3, "other.assess").otherwise(_cat("f", C("i"), ".assess")).alias("stem"), F.when(C("i") % 4 == 1, "faithfulness").otherwise("faithfulness-pass").alias("kind"), to.alias("subject"), from_.alias("ground"), F.lit("20240101").alias("day"), F.when((C("i") % 4 == 1) & (C("i") % 8 != 5), F.when(C("i") % 16 == 9, "gone").otherwise(_cat("E", C("i")))).alias("disputes"), F.when(C("i") % 4 == 3, _cat("e", C("i"))).alias("reviews"), F.when(C("i") % 4 == 1, F.when(C("i") % 6 == 1, "never said").otherwise("first  finding")).alias("span"))
    each = edges.unionByName(told).join(claims, "subject", "left")
    each = each.withColumn("body", F.when((C("i") % 8 == 1) & (C("kind") == "edge"), "old").otherwise(F.coalesce("now", F.lit(""))))
    opt = lambda name, c: F.coalesce(F.concat(F.lit(f', "{name}": '), c), F.lit(""))
    plain = _cat('{"assess_version": "1", "assessed_date": "', C("day"), '", "assessor": "x", "assessor_tool": "t", "body_sha256": "', C("body"), '"', opt("disputes", F.concat(F.lit('["'), "disputes", F.lit('"]'))), ', "grounding": ["', C("ground"), '"], "id": "', C("id"), '", "kind": "', C("kind"), '"%s', opt("reviews", F.concat(F.lit('["'), "reviews", F.lit('"]'))), opt("span", F.concat(F.lit('"'), "span", F.lit('"'))), ', "subject": "', C("subject"), '"}')
    seal = F.when((C("i") % 12 == 1) & (C("kind") == "edge"), "broken").otherwise(F.sha2(F.replace(plain, F.lit("%s"), F.lit("")), 256))
    record = F.replace(plain, F.lit("%s"), F.concat(F.lit(', "record_sha256": "'), seal, F.lit('"')))
    return stored(each.select("stem", record.alias("record")), "records"), files


def record_gate(s, d):
    return assessment.record_problems(*_records(s, d)).select("id", "code", "detail")


def record_links(s, d):
    return assessment.link_problems(_records(s, d)[0])


def _valid(s, d):
    records, files = _records(s, d)
    return stored(assessment.valid(records, assessment.record_problems(records, files)), "valid"), records, files


def edge_assessment(s, d):
    good, records, files = _valid(s, d)
    return assessment.edge_problems(markdown.edges(files), assessment.parse(records), assessment.coverage_of(good)).select("from_key", "covering", "code")


def faithfulness_worklist(s, d):
    good, records, files = _valid(s, d)
    return assessment.worklist(markdown.edges(files), records, assessment.coverage_of(good)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


#: Records as SQL has them: each with the codes of what is wrong with it.
_RECORDS = f"""{_I}, base AS (SELECT * FROM s WHERE i % 3 = 1 OR i % 4 = 1),
  shape AS (SELECT i, top, 'e' || i AS id, 'edge' AS kind FROM base UNION ALL SELECT i, top, 'f' || i, CASE WHEN i % 4 = 1 THEN 'faithfulness' ELSE 'faithfulness-pass' END FROM base WHERE i % 2 = 1),
  rec AS (SELECT *, CASE WHEN i % 10 = 9 THEN 'k' || (i + 1) || ':zz' ELSE 'k' || (i + 1) || ':a' || (i + 1) END AS subject, CASE WHEN i % 11 = 5 THEN 'k' || i || ':nope' ELSE 'k' || i || ':a' || i END AS ground,
    CASE WHEN i >= top THEN 'no file' WHEN i % 10 = 9 THEN 'no claim' END AS lost FROM shape),
  wrong AS (SELECT id, 'schema' AS code, '$.assessed_date: not of the pattern' AS detail FROM rec WHERE kind = 'edge' AND i % 5 = 2
    UNION ALL SELECT id, 'seal', NULL FROM rec WHERE kind = 'edge' AND i % 12 = 1
    UNION ALL SELECT id, 'subject', lost FROM rec WHERE lost IS NOT NULL
    UNION ALL SELECT id, 'grounding', ground || ': no claim' FROM rec WHERE i % 11 = 5
    UNION ALL SELECT id, 'stale', NULL FROM rec WHERE kind = 'edge' AND i % 8 = 1 AND lost IS NULL
    UNION ALL SELECT id, 'span', ground FROM rec WHERE kind = 'faithfulness' AND (i % 6 = 1 OR i % 11 = 5)
    UNION ALL SELECT id, 'disputes', NULL FROM rec WHERE kind = 'faithfulness' AND i % 8 = 5
    UNION ALL SELECT id, 'filename', 'other.assess' FROM rec WHERE kind <> 'edge' AND i % 7 = 3)"""
_COVERED = f"""{_RECORDS}, {_EDGE[len(_I) + 2 :]},
  good AS (SELECT * FROM rec WHERE kind = 'edge' AND id NOT IN (SELECT id FROM wrong)),
  c AS (SELECT e.key AS from_key, e.type, e.rec, e.target, e.grounding, min(CASE WHEN e.rec IS NULL OR g.id = e.rec THEN g.id END) AS covering
    FROM e LEFT JOIN good g ON g.subject = e.target AND g.ground = e.key || ':' || coalesce(e.grounding, '?') GROUP BY e.key, e.type, e.rec, e.target, e.grounding)"""


def marker_gate(s, d):
    records, files = _records(s, d)
    return assessment.marker_problems(files, assessment.parse(records).filter("readable"))


def prose_refs(s, d):
    good, records, _ = _valid(s, d)
    return _prose_refs(s, d, good, records)


def _prose_refs(s, d, good, records):
    text = _cat("First line\nseen [rec: e", C("i"), "] and", _on(C("i") % 2 == 0, "\nthen [rec:\nF", C("i"), "]"), _on(C("i") % 5 == 0, " or [rec: two words]"))
    return assessment.prose_references(_suppliers(s, d).select(_cat("content/n", C("i"), ".md").alias("path"), text.alias("text")), assessment.parse(records), good)


def coverage_gate(s, d):
    files, empty = _claim_files(s, d), s.createDataFrame([], "stem string, record string")
    cited = _suppliers(s, d).select(_cat("k", C("i")).alias("key"), F.explode(F.array(_cat("B", C("i")), F.lit("c1"), F.lit("c2"), F.lit("none"))).alias("claim"))
    return assessment.unsituated(cited, assessment.claim_table(files), assessment.situated(markdown.edges(files), empty))


def correlated_support(s, d):
    records = s.createDataFrame([("z.assess", '{"id": "Z", "kind": "correlated-with", "subject": "k2:a2", "grounding": ["k2:a2", "k4:a4"]}')], "stem string, record string")
    kinds = s.createDataFrame([("k10", "k8", "overlapping-pools")], "lo string, hi string, kind string")
    return assessment.double_counts(_claim_files(s, d), records, kinds)


def _registers(s, d):
    """project, text: a register of sources for each customer nation, with its faults."""
    n = _t(s, d, "nation").select(C("n_nationkey").alias("i"))
    text = _cat("# Register\n<!-- an example\n**Position:** hidden\n-->\n## Positions\n**Position:** for — one side\n**Position:** against - the other\n## Sources\n### First\n**Source:** K", C("i"), "\n**Discovery:** a search\n", _on(C("i") % 3 != 0, "**Rationale:** apt\n"), "**Position:** for: mainly\n", _on(C("i") % 4 == 1, "**Position:** nowhere\n"), "**Addresses:** ", F.when(C("i") % 5 == 2, "q9").otherwise("q1"), " etc\n", _on(C("i") % 6 == 5, "### Second\n**Discovery:** luck\n**Rationale:** none\n**Position:** against\n"), "## Known gaps\n", _on(C("i") % 2 == 0, "**Gap:** nobody holds against, it seems\n"))
    return n.select(_cat("p", C("i")).alias("path"), text.alias("text")), n


def selection_gate(s, d):
    docs, n = _registers(s, d)
    files = n.filter("i % 7 <> 3").select(_cat("p", C("i")).alias("project"), _cat("k", C("i")).alias("key"))
    more = n.filter("i % 8 = 4").select(_cat("p", C("i")).alias("project"), F.lit("extra").alias("key"))
    questions = n.select(_cat("p", C("i")).alias("project"), F.lit("q1").alias("qid"))
    return selection.selection_problems(fields.fields(docs).withColumnRenamed("path", "project"), files, files.unionByName(more), questions)


def flow_gate(s, d):
    n = _t(s, d, "nation").select(C("n_nationkey").alias("i"))
    text = _cat("## Overview\n**Review-question:** what\n**Inclusion-criteria:** all\n**Exclusion-criteria:** none\n**Update-procedure:** yearly\n", _on(C("i") % 3 != 0, "**Last-updated:** 2024\n"), "## Searches\n### Web\n**Database:** d\n**Query:** q\n**Date:** 2024\n**Records-found:** ", F.when(C("i") % 4 == 1, "many").otherwise("1,200"), "\n**Records-screened:** ", F.when(C("i") % 5 == 2, "1300").otherwise("12"), "\n**Included:** k", C("i"), " (first), ", _on(C("i") % 6 == 3, "ghost"), "\n## Included sources\n### One\n**Source:** k", C("i"), "\n", _on(C("i") % 7 != 2, "**Reason:** apt\n"), "## Excluded\n### Bad\n", _on(C("i") % 2 == 0, "**Record:** r\n"), "**Reason:** off topic\n## Unavailable\n")
    files = n.filter("i % 8 <> 5").select(_cat("p", C("i")).alias("project"), _cat("k", C("i")).alias("key"))
    stamped = files.filter("cast(substring(key, 2) as int) % 9 <> 4")
    return selection.flow_problems(fields.fields(n.filter("i % 11 <> 7").select(_cat("p", C("i")).alias("path"), text.alias("text"))).withColumnRenamed("path", "project"), files, stamped)


def synthesis_gate(s, d):
    part = dealt(_t(s, d, "part").select(C("p_partkey").alias("i")), "i")
    text = _cat("---\ntitle: a novel front\n---\n# A novel heading\nThis is a novel result\n", F.when(C("i") % 3 == 0, "It beats all, see `tool`\n").when(C("i") % 3 == 1, "It outperforms the rest\n").otherwise("They say \"it is proven and\nexhaustive\" here\n"), "> a unique quote\n```\nproven code\n```\n\nWe do not claim it is unprecedented\n<!-- superior\nunique -->\n", _on(C("i") % 4 == 2, "Fully independent and definitively so\n"), "k1:a1 proves it\n")
    path = F.when(C("i") % 5 == 0, "finding.md").when(C("i") % 5 == 1, "notes.md").otherwise(_cat("assessments/n", C("i"), ".md"))
    return synthesis.unanchored(part.select(path.alias("path"), text.alias("text"))).groupBy("path", "line", "category").agg(F.count(F.lit(1)).alias("n"))


def _stamped(s, d):
    """Claim files with stamps over their bodies, some wrong: key, text, and i."""
    body = _cat("# k", C("i"), "\ntext\n")
    digest = F.when(C("i") % 5 == 3, F.sha2(F.lit("other"), 256)).when(C("i") % 11 == 2, "abc").otherwise(F.sha2(body, 256))
    src, ext = F.sha2(_cat("s", C("i")), 256), F.sha2(_cat("x", C("i")), 256)
    text = _cat("---\nfile: ", F.when(C("i") % 7 == 1, "<path>").otherwise(_cat("papers/k", C("i"))), "\n", _on(C("i") % 3 != 1, 'source_version: "v1"\n'), "retrieved: 20240101\n", _on(C("i") % 4 != 2, "doi: 10.1371/", C("i"), "\n"), _on(C("i") % 6 != 0, "source_sha256: ", src, "\nextract_sha256: \"", ext, "\"\nbody_sha256: ", digest, "\nverifier_version: ", F.when(C("i") % 8 == 3, "1").otherwise("2"), "\nverified_verdict: ", F.when(C("i") % 9 == 4, "fail").otherwise("pass"), "\nverified_date: 20240101\n"), _on(C("i") % 10 == 5, "extract_source_sha256: ", F.sha2(F.lit("z"), 256), "\n"), "---\n", body)
    return _suppliers(s, d).select(C("i"), _cat("k", C("i")).alias("key"), text.alias("text"))


_STAMPS = f"""{_I}, f AS (SELECT i, 'k' || i AS key, i % 6 <> 0 AS st, sha256('# k' || i || chr(10) || 'text' || chr(10)) AS body FROM s)"""


def _parsed(s, d):
    files = _stamped(s, d)
    return markdown.bodies(files)


def identity_gate(s, d):
    return provenance.identity_problems(_parsed(s, d))


def stamp_gate(s, d):
    return provenance.stamp_problems(_parsed(s, d))


def binding_gate(s, d):
    each = _suppliers(s, d)
    extracts = each.filter("i % 2 = 0").select(_cat("k", C("i")).alias("key"), F.when(C("i") % 12 == 8, "changed").otherwise(F.sha2(_cat("x", C("i")), 256)).alias("extract_sha"))
    sources = each.filter("i % 3 = 0").select(_cat("papers/k", C("i")).alias("file"), F.when(C("i") % 15 == 9, "changed").otherwise(F.sha2(_cat("s", C("i")), 256)).alias("source_sha"))
    return provenance.binding_problems(_parsed(s, d), extracts, sources)


def unbound_files(s, d):
    return provenance.unbound(_parsed(s, d))


def run_record_gate(s, d):
    files = _parsed(s, d)
    made = provenance.stamped_record(files, "20240202").join(_suppliers(s, d).select(_cat("k", C("i")).alias("key"), "i"), "key")
    run = F.when(C("i") % 14 == 5, "{").when(C("i") % 16 == 6, F.replace("run", F.lit("20240202"), F.lit("20240203"))).otherwise(C("run"))
    return provenance.run_problems(files, made.filter("i % 13 <> 1").select("key", run.alias("record")))


def verification_level(s, d):
    files = _parsed(s, d)
    one = lambda name, f, p, g: provenance.state(f, p, g).select(F.lit(name).alias("name"), "level")
    bad, none = stored(provenance.stamp_problems(files), "stamp-problems"), files.limit(0).select("key")
    sound = files.join(bad.select("key"), "key", "left_anti")
    return one("all", files, bad, none).unionByName(one("sound", sound, none, none)).unionByName(one("signed", sound, none, sound.select("key"))).unionByName(one("nothing", files.limit(0), none, none))


def _cases(s, d):
    p = _t(s, d, "part").select(C("p_partkey").alias("i"))
    quote = F.when(C("i") % 6 == 0, "the risk might rise").when(C("i") % 6 == 1, "it is associated with consumption").when(C("i") % 6 == 2, "a subgroup of diabetic people").otherwise("plain words")
    inference = F.when(C("i") % 7 == 0, "this proves it").when(C("i") % 7 == 1, "it is most likely so").when(C("i") % 7 == 2, "smoking causes it").when(C("i") % 7 == 3, "this independently confirms it").when(C("i") % 7 == 4, "for the General Population").otherwise("it might be")
    return p.select(C("i").alias("id"), F.lit("k").alias("source_key"), F.lit("a").alias("slug"), quote.alias("quote"), inference.alias("inference"), F.when(C("i") % 2 == 0, "apt").otherwise("out-of-context").alias("gold"))


def detector_rules(s, d):
    return faithfulness.detect(_cases(s, d)).select("id", "verdict", "rationale")


def detector_score(s, d):
    said = _cases(s, d).select("id", F.when(C("id") % 5 == 0, " Misuse ").when(C("id") % 5 == 1, "FINE").when(C("id") % 5 == 2, "perhaps").when(C("id") % 5 == 3, "out of context").otherwise("ok").alias("verdict")).filter("id % 11 <> 0")
    return faithfulness.score(_cases(s, d), said)


def case_gate(s, d):
    odd = _cases(s, d).withColumns({"quote": F.when(C("id") % 4 != 1, C("quote")), "gold": F.when(C("id") % 9 == 0, "maybe").when(C("id") % 9 != 1, C("gold"))})
    return faithfulness.case_problems(odd)


def case_balance(s, d):
    return faithfulness.balance(_cases(s, d))


def blind_cases(s, d):
    return faithfulness.blind(_cases(s, d))


def lost_quotes(s, d):
    b = _t(s, d, "benchmark")
    cases = b.select(C("item_id").alias("id"), C("item_id").cast("string").alias("source_key"), F.when(C("item_id") % 3 == 0, "words that it never said 7").otherwise(F.upper(F.substring("text", 5, 40))).alias("quote"))
    return faithfulness.lost_quotes(cases, b.filter("item_id % 4 <> 1").select(C("item_id").cast("string").alias("key"), F.concat(F.lit("---\n---\n> "), "text").alias("text")))


def quote_check_files(s, d):
    """Claim files over benchmark texts: each way of quoting, and files without quotes or extracts."""
    b = _t(s, d, "benchmark").select(C("item_id").alias("i"), F.regexp_replace(F.coalesce("text", F.lit("")), r'[\r\n"“”]|\.\.\.|…', " ").alias("t"))
    long_ = "in that long and happy year of ours"
    source = _cat(C("t"), " It rose by 1,170.5 units ", long_, ". The cost O(n log n) is small for the whole method here.")
    quote = F.when(C("i") % 8 == 0, C("t")).when(C("i") % 8 == 1, f"1,170.5 units {long_}").when(C("i") % 8 == 2, f"170.5 units {long_}").when(C("i") % 8 == 3, "It rose by ... ").when(C("i") % 8 == 4, "The cost is small for the whole method here").when(C("i") % 8 == 5, f"It rose by units {long_}").otherwise(f"It rose by … units {long_} [...] whole method here.")
    text = _cat("---\nfile: x\n---\n## Claim 1\n", F.when(C("i") % 8 == 6, "> only a note with a \"word\"\n").otherwise(_cat('> "', quote, '" (p. 3)\n>\n')), "**ID:** a\n")
    key = C("i").cast("string").alias("key")
    return quotecheck.check_files(b.select(key, text.alias("text")), b.filter("i % 8 <> 7").select(key, source.alias("extract")))


def _papers(s, d):
    """filename and metadata of files, by customer."""
    c = _t(s, d, "customer").select(C("c_custkey").alias("i"), C("c_nationkey").alias("n"))
    name = F.when(C("i") % 13 == 5, _cat("scan", C("i"), ".pdf")).otherwise(_cat("Au", F.translate(C("n").cast("string"), "0123456789", "abcdefghij"), "x_", F.lit(2000) + C("i") % 3, F.when(C("i") % 2 == 0, "").otherwise(_cat("_n", C("i"))), ".", F.element_at(F.array(F.lit("pdf"), F.lit("html"), F.lit("xml")), (C("i") % 3 + 1).cast("int"))))
    return c.select("i", "n", _cat(C("i"), "/").alias("folder"), name.alias("filename"))


def register_build(s, d):
    """The register from names to keys, statuses and rows."""
    files = register.parse_names(_papers(s, d)).withColumn("extension", F.regexp_extract("filename", r"\.([^.]*)$", 1))
    files = files.withColumns({"filename": F.concat("folder", "filename"), "size_kb": (C("i") % 97).cast("double"), "meta_author": F.when(C("i") % 5 == 1, "Óther-name").when(C("i") % 5 == 2, F.concat("fn_author", F.lit("son"))), "meta_year": F.when(C("i") % 7 == 3, "2009"), "doi": F.when(C("i") % 4 == 1, F.concat(F.lit("10.1371/"), (C("i") % 2).cast("string"))), "title": F.expr(NONE), "journal": F.expr(NONE)})
    files = register.resolve_identity(files.withColumn("meta_author", register.surname_key(C("meta_author"))))
    over = _t(s, d, "customer").filter("c_custkey % 29 = 3").select(F.concat(C("c_custkey").cast("string"), F.lit("/scan"), C("c_custkey").cast("string"), F.lit(".pdf")).alias("filename"), F.lit("Åke").alias("author"), F.lit("2011").alias("year"), F.lit("verified").alias("status"), F.lit("seen").alias("reason"))
    files = register.override(files, over).withColumn("landing", C("i") % 19 == 7)
    keyed = register.assign_keys(files, s.createDataFrame([("auax_2000",), ("auabx_2001",)], "key string"))
    return register.register_rows(keyed, "2024-01-01").select("filename", "first_author", "year", "key", "status", "notes")


def doi_triage(s, d):
    p = _t(s, d, "part").select(C("p_partkey").alias("i"), F.when(C("p_partkey") % 4 == 0, "10.1371/x").when(C("p_partkey") % 4 == 1, "10.9999/y").when(C("p_partkey") % 4 == 2, "10.1016/z").alias("doi"), F.when(C("p_partkey") % 8 == 3, "PMC1").alias("pmcid"))
    return register.triage(p).select("i", "prefix", "publisher", "redistribution", "basis")


def landing_pages(s, d):
    p = _t(s, d, "pages")
    text = F.when(C("page_id") % 5 == 0, F.concat(F.lit("Please LOG in"), "html")).otherwise(C("html"))
    return p.select("page_id", register.landing(text, F.when(C("page_id") % 2 == 0, "html").otherwise("xml"), F.octet_length("html")).alias("landing"))


def _settings(s, d):
    n = _t(s, d, "nation").select(C("n_nationkey").alias("i"))
    text = _cat("# settings\nclaim_ids: ", F.when(C("i") % 3 == 0, "required").when(C("i") % 3 == 1, "never").otherwise("off"), "  # comment\nprovenance: off\nprovenance: \"required\"\nnumeric_citations: ", F.when(C("i") % 2 == 0, "Block").otherwise("<choose>"), "\nstructure_layer: required\nassessment_layer: required\nproject_name: ", F.when(C("i") % 5 == 4, "<name>").otherwise("P"), "\ndeliverable: d\nsource_of_truth: s\nthe_reader: r\nsource_types: ", F.when(C("i") % 7 == 6, "").otherwise("t"), "\nskin_state: ", F.when(C("i") % 4 == 1, "draft").otherwise("confirmed"), "\nproject_state: ", F.when(C("i") % 6 == 5, "pristine").otherwise("configured"), "\n")
    return fields.setting_rows(n.select(_cat("p", C("i")).alias("path"), text.alias("text"))).withColumnRenamed("path", "project"), n


def posture_values(s, d):
    return project.postures(_settings(s, d)[0])


def profile_fit(s, d):
    return project.profile_distance(posture_values(s, d))


def strict_gaps(s, d):
    return project.strict_gaps(posture_values(s, d))


def project_states(s, d):
    settings, n = _settings(s, d)
    return project.states(settings, n.select(_cat("p", C("i")).alias("project"), (C("i") % 8 != 3).alias("written")))


def gate_run(s, d):
    """All gates of each project over the faults that the selection and flow gates find, and the verdict."""
    settings, n = _settings(s, d)
    more = n.crossJoin(F.broadcast(s.createDataFrame([("selection_audit", "required"), ("source_flow", "warn")], "name string, value string"))).select(_cat("p", C("i")).alias("project"), "name", "value")
    found = [f(s, d).groupBy("project").agg(F.count(F.lit(1)).alias("n")).withColumn("gate", F.lit(g)) for f, g in ((selection_gate, "selection audit"), (flow_gate, "source flow"))]
    projects = n.select(_cat("p", C("i")).alias("project"), (C("i") % 2 == 0).alias("strict"), (C("i") % 9).alias("n_files"))
    absent = n.filter("i % 10 = 6").select(_cat("p", C("i")).alias("project"), F.lit("quote check").alias("gate"))
    gates = project.run_gates(found[0].unionByName(found[1]), project.postures(settings.unionByName(more)), projects, absent)
    return project.verdicts(gates)


def review_staleness(s, d):
    c = _t(s, d, "customer").select(_cat("c", C("c_custkey")).alias("project"), F.when(C("c_custkey") % 3 == 0, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (C("c_custkey") % 400).cast("int")), "yyyyMMdd")).when(C("c_custkey") % 3 == 1, "soon").alias("last_review"))
    return project.review_problems(c, "20250101")


def wiki_gate(s, d):
    c = _t(s, d, "customer").select(C("c_custkey").alias("i"))
    path = F.when(C("i") % 4 == 0, _cat("concept_notes/Note", C("i"), ".md")).otherwise(_cat("note", C("i"), ".md"))
    text = _cat("See [[ Note", C("i") + 1, " | the next ]] and [[note", C("i") * 2, "#part]]", _on(C("i") % 5 == 0, " or [[sub/note1]]"), " [[note", C("i") + 1, "]]")
    notes = c.select(path.alias("path"), text.alias("text")).unionByName(s.createDataFrame([("index.md", "nothing")], "path string, text string"))
    return project.wiki_problems(notes, s.createDataFrame([("lists NOTE8 and note12",)], "text string"))


def calibration_gate(s, d):
    p = _t(s, d, "part").select(C("p_partkey").alias("i"))
    text = lambda c: c.cast("string")
    notes = p.select(_cat("n", C("i")).alias("note"), F.when(C("i") % 7 != 3, text(F.lit(0.5))).alias("inside_view"), F.when(C("i") % 5 == 2, "some").otherwise("0.1").alias("out_of_model_discount"), F.when(C("i") % 6 == 4, "").otherwise("0.1").alias("adversarial_discount"), F.when(C("i") % 4 == 1, "0.9").when(C("i") % 4 != 2, "0.3").alias("calibrated_confidence"))
    return register.calibration_faults(notes)


def _runs(s, d):
    """Two runs' claim files, by supplier."""
    text = lambda slug, quote, locus, qid: _cat("## Claim 1\n> \"", quote, "\n> goes on\"\n\n> alone\n**ID:** ", slug, "\n**Locus:** ", locus, "\n**Addresses:** ", qid, "\n")
    a = _suppliers(s, d).select(_cat("k", C("i")).alias("key"), text(_cat("s", C("i")), _cat("words ", C("i")), _cat("P", C("i")), _cat("q", C("i") % 4)).alias("text"))
    b = _suppliers(s, d).select(_cat("k", F.when(C("i") % 5 == 1, C("i") + 1000000).otherwise(C("i"))).alias("key"), text(F.when(C("i") % 3 == 0, _cat("t", C("i"))).otherwise(_cat("S", C("i"))), _cat(F.when(C("i") % 2 == 0, "Words").otherwise("other"), " ", C("i")), _cat("p", F.when(C("i") % 7 == 0, F.lit(0)).otherwise(C("i"))), _cat("q", C("i") % 3)).alias("text"))
    return a, b


def run_agreement(s, d):
    return metrics.run_agreement(*_runs(s, d))


def citation_gate(s, d):
    key = _cat("Key", C("i"), "x")
    cites = _suppliers(s, d).select(key.alias("author"), F.lit("2003").alias("year"), F.when(C("i") % 4 == 0, "c1").when(C("i") % 4 == 1, "own").when(C("i") % 4 == 2, "gone").alias("claim")).withColumn("author", F.lower("author"))
    files = _suppliers(s, d).filter("i % 5 <> 2").select(_cat(key, "_2003.md").alias("name"))
    claims = _suppliers(s, d).select(_cat("key", C("i"), "x_2003").alias("key"), F.explode(F.array(F.struct(F.lit("c1").alias("alias"), F.lit(False).alias("is_slug")), F.struct(F.lit("own").alias("alias"), F.lit(True).alias("is_slug")))).alias("c")).select("key", "c.*")
    return citations.claim_problems(cites, files, s.createDataFrame([], "alias string, target string"), claims, every=True)


def page_texts(s, d):
    return html_units.texts(_t(s, d, "pages"), "page_id", "html").select("page_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.regexp_replace("text", r"\s+", ""), 256).alias("digest"))


def graph_export(s, d):
    """part and item of a project's graph: nodes, edges, addressed questions, superseded and doubly counted claims."""
    files = _claim_files(s, d)
    edges = markdown.edges(files)
    nodes = assessment.situated(edges, s.createDataFrame([], "stem string, record string")).select(F.lit("node").alias("part"), C("node").alias("item"))
    shown = edges.select(F.lit("edge").alias("part"), F.concat_ws(" ", F.coalesce("source", F.lit("?")), "type", "target").alias("item"))
    asked = markdown.field(markdown.claims(files), "addresses").select(F.lit("address").alias("part"), F.concat_ws(" ", "key", F.lower("value")).alias("item"))
    return nodes.unionByName(shown).unionByName(asked)


QUERIES = {f.__name__: f for f in (claim_scan, edge_scan, edge_resolution, structure_gate, record_gate, record_links, edge_assessment, faithfulness_worklist, marker_gate, prose_refs, coverage_gate, correlated_support, selection_gate, flow_gate, synthesis_gate, identity_gate, stamp_gate, binding_gate, unbound_files, run_record_gate, verification_level, detector_rules, detector_score, case_gate, case_balance, blind_cases, lost_quotes, quote_check_files, register_build, doi_triage, landing_pages, posture_values, profile_fit, strict_gaps, project_states, gate_run, review_staleness, wiki_gate, calibration_gate, run_agreement, citation_gate, page_texts, graph_export)}


_N = "regexp_replace(lower(strip_accents(replace({0}, 'ß', 'ss'))), '[^a-z0-9]', '', 'g')"
_P = "p AS (SELECT p_partkey AS i FROM part)"
_PROJECT = "n AS (SELECT n_nationkey AS i, 'p' || n_nationkey AS project, 'k' || n_nationkey AS key FROM nation)"
_SELECTION = f"""{_PROJECT}, sel AS (
  SELECT project, 'phantom' AS code, 'First' AS subject, key AS detail FROM n WHERE i % 7 = 3
  UNION ALL SELECT project, 'missing field', 'First', 'rationale' FROM n WHERE i % 3 = 0
  UNION ALL SELECT project, 'orphan position', 'First', 'nowhere' FROM n WHERE i % 4 = 1
  UNION ALL SELECT project, 'orphan question', 'First', 'q9' FROM n WHERE i % 5 = 2
  UNION ALL SELECT project, 'no key', 'Second', NULL FROM n WHERE i % 6 = 5
  UNION ALL SELECT project, 'silent side', 'against', NULL FROM n WHERE i % 2 = 1 AND i % 6 <> 5
  UNION ALL SELECT project, 'unregistered', 'extra', NULL FROM n WHERE i % 8 = 4)"""
_FLOW = """flow AS (
  SELECT project, 'no flow' AS code, NULL AS subject, NULL AS detail FROM n WHERE i % 11 = 7 AND i % 8 <> 5 AND i % 9 <> 4
  UNION ALL SELECT project, code, subject, detail FROM (
    SELECT i, project, 'missing field' AS code, 'overview' AS subject, 'last-updated' AS detail FROM n WHERE i % 3 = 0 AND i % 8 <> 5 AND i % 9 <> 4
    UNION ALL SELECT i, project, 'no count', 'Web', 'records-found' FROM n WHERE i % 4 = 1
    UNION ALL SELECT i, project, 'more screened than found', 'Web', NULL FROM n WHERE i % 5 = 2 AND i % 4 <> 1
    UNION ALL SELECT i, project, 'missing field', 'One', 'reason' FROM n WHERE i % 7 = 2
    UNION ALL SELECT i, project, 'phantom', 'One', key FROM n WHERE i % 8 = 5
    UNION ALL SELECT i, project, 'included but not stamped', key, NULL FROM n WHERE i % 8 <> 5 AND i % 9 = 4
    UNION ALL SELECT i, project, 'searched but not included', 'ghost', NULL FROM n WHERE i % 6 = 3 AND i % 8 <> 5 AND i % 9 <> 4
    UNION ALL SELECT i, project, 'no record', 'Bad', 'excluded' FROM n WHERE i % 2 = 1) WHERE i % 11 <> 7)"""
_HELD = f"""{_PROJECT}, usual AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v[0]}')" for k, v in project.POSTURES.items())}) t(gate, usual)),
  held AS (SELECT project, i, gate, coalesce(own, usual) AS value, own IS NOT NULL AS given FROM (SELECT project, i, gate, usual, CASE gate WHEN 'claim_ids' THEN CASE i % 3 WHEN 0 THEN 'required' WHEN 2 THEN 'off' END
    WHEN 'provenance' THEN 'required' WHEN 'numeric_citations' THEN CASE WHEN i % 2 = 0 THEN 'block' END WHEN 'structure_layer' THEN 'required' WHEN 'assessment_layer' THEN 'required' END AS own FROM n, usual))"""
_PROFILES = ", ".join(f"('{p}', '{k}', '{v}')" for p, vs in project.PROFILES.items() for k, v in vs.items())
_PAPERS = """c AS (SELECT c_custkey AS i, c_nationkey AS n, translate(CAST(c_nationkey AS VARCHAR), '0123456789', 'abcdefghij') AS letters FROM customer)"""
_RULES = """r AS (SELECT i, i % 6 AS q, i % 7 AS f FROM p), v AS (SELECT i, CASE WHEN f = 0 THEN 'certainty' WHEN f = 1 AND q = 0 THEN 'likelihood' WHEN f = 2 AND q = 0 THEN 'hedge dropped' WHEN f = 3 AND q IN (0, 1) THEN 'independence' WHEN f = 4 AND q = 2 THEN 'generalised' WHEN f = 2 AND q = 1 THEN 'causation' END AS rationale FROM r)"""

ORACLES = {
    "claim_scan": f"WITH {_I}, a AS (SELECT 'k' || i AS key, i FROM s) SELECT key, 'c1' AS alias, FALSE AS is_slug, 1 AS ordinal FROM a UNION ALL SELECT key, 'a' || i, TRUE, 1 FROM a UNION ALL SELECT key, 'c2', FALSE, 2 FROM a UNION ALL SELECT key, 'b' || i, TRUE, 2 FROM a UNION ALL SELECT 'hub', 'c1', FALSE, 1 UNION ALL SELECT 'hub', 'h1', TRUE, 1",
    "edge_scan": f"WITH {_EDGE} SELECT key AS from_key, type, key || ':' || grounding AS source, target, grounding, rec FROM e",
    "edge_resolution": f"WITH {_EDGE} SELECT key AS from_key, type, target AS address, CASE WHEN target = 'hub:h1' THEN NULL WHEN i >= top THEN 'no file' WHEN i % 10 = 9 THEN 'no claim' END AS reason FROM e",
    "structure_gate": f"""WITH {_EDGE} SELECT key, 'target' AS code, target || CASE WHEN i >= top THEN ': no file' ELSE ': no claim' END AS detail FROM e WHERE target <> 'hub:h1' AND (i >= top OR i % 10 = 9)
  UNION ALL SELECT key, 'grounding', key || ':nope: no claim' FROM e WHERE grounding = 'nope' UNION ALL SELECT key, 'no grounding', target FROM e WHERE grounding IS NULL
  UNION ALL SELECT key, 'contradiction', coalesce(key || ':' || grounding, key) || ' > ' || target FROM e WHERE type = 'rebuts' UNION ALL SELECT 'k' || i, 'question', 'addresses q4' FROM s WHERE i % 5 = 4""",
    "record_gate": f"WITH {_RECORDS} SELECT * FROM wrong",
    "record_links": f"""WITH {_RECORDS} SELECT id, 'disputes' AS link, CASE WHEN i % 16 = 9 THEN 'gone' ELSE 'e' || i END AS other, 'no record' AS code FROM rec WHERE kind = 'faithfulness' AND i % 8 <> 5 AND i % 16 = 9""",
    "edge_assessment": f"WITH {_COVERED} SELECT from_key, covering, CASE WHEN covering IS NOT NULL THEN NULL WHEN rec IS NULL THEN 'no record' WHEN rec NOT IN (SELECT id FROM rec) THEN 'unknown record' ELSE 'not its record' END AS code FROM c",
    "faithfulness_worklist": f"""WITH {_COVERED}, told AS (SELECT 'e' || i AS id, bool_or(kind = 'faithfulness' AND i % 8 <> 5 AND i % 16 <> 9) AS d, bool_or(kind = 'faithfulness-pass') AS r FROM rec GROUP BY i)
  SELECT CASE WHEN covering IS NULL THEN 'no record' WHEN d THEN 'disputed' WHEN r THEN 'passed' ELSE 'unreviewed' END AS status, count(*) AS n FROM c LEFT JOIN told ON told.id = covering GROUP BY 1""",
    "marker_gate": f"WITH {_RECORDS}, m AS (SELECT i, CASE i % 4 WHEN 1 THEN 'E' || i WHEN 2 THEN 'lost' END AS rec FROM s) SELECT 'k' || i AS key, 'no record' AS code, rec AS detail FROM m WHERE lower(rec) NOT IN (SELECT id FROM rec) UNION ALL SELECT 'k' || i, 'no crux', NULL FROM s WHERE i % 9 = 4 AND i % 2 = 1",
    "prose_refs": f"""WITH {_RECORDS}, refs AS (SELECT i, 2 AS line, 'e' || i AS ref FROM s UNION ALL SELECT i, 3, 'F' || i FROM s WHERE i % 2 = 0 UNION ALL SELECT i, CASE WHEN i % 2 = 0 THEN 4 ELSE 2 END, 'two words' FROM s WHERE i % 5 = 0)
  SELECT 'content/n' || i || '.md' AS path, line, ref, CASE WHEN ref = 'two words' THEN 'malformed' WHEN lower(ref) NOT IN (SELECT id FROM rec) THEN 'absent' WHEN lower(ref) IN (SELECT id FROM wrong) THEN 'invalid' ELSE 'valid' END AS outcome FROM refs""",
    "coverage_gate": f"""WITH {_I}, open AS (SELECT 'k' || i AS key, i FROM s WHERE i % 2 = 1) SELECT key, 'b' || i AS claim FROM open UNION ALL SELECT key, 'c2' FROM open""",
    "correlated_support": f"""WITH {_I}, pairs AS (SELECT i, 'k' || i AS x, 'k' || (i + 2) AS y FROM s WHERE i % 6 = 2 AND i + 2 <= top)
  SELECT 'hub:h1' AS target, least(x, y) AS a, greatest(x, y) AS b, CASE WHEN i = 8 THEN 'overlapping-pools' ELSE 'shared-evidence' END AS kind, 'cohort ' || i AS basis, CASE WHEN i = 2 THEN 'z' END AS sealed FROM pairs""",
    "selection_gate": f"WITH {_SELECTION} SELECT * FROM sel",
    "flow_gate": f"WITH {_PROJECT}, {_FLOW} SELECT * FROM flow",
    "synthesis_gate": f"""WITH {_P}, f AS (SELECT i, CASE i % 5 WHEN 0 THEN 'finding.md' ELSE 'assessments/n' || i || '.md' END AS path FROM p WHERE i % 5 <> 1),
  l AS (SELECT path, 5 AS line, 'novelty' AS category FROM f UNION ALL SELECT path, 6, 'superiority' FROM f WHERE i % 3 = 1 UNION ALL SELECT path, CASE WHEN i % 3 = 2 THEN 16 ELSE 15 END, 'certainty' FROM f WHERE i % 4 = 2)
  SELECT path, line, category, count(*) AS n FROM l GROUP BY ALL""",
    "identity_gate": f"WITH {_I} SELECT 'k' || i AS key, 'no file' AS code FROM s WHERE i % 7 = 1 UNION ALL SELECT 'k' || i, 'no source_version' FROM s WHERE i % 3 = 1 UNION ALL SELECT 'k' || i, 'no locator' FROM s WHERE i % 4 = 2",
    "stamp_gate": f"""WITH {_STAMPS} SELECT key, 'no ' || f AS code FROM f, (VALUES {", ".join(f"('{x}')" for x in provenance.STAMP)}) t(f) WHERE NOT st
  UNION ALL SELECT key, 'body_sha256 is no hash' FROM f WHERE st AND i % 5 <> 3 AND i % 11 = 2 UNION ALL SELECT key, 'verdict' FROM f WHERE st AND i % 9 = 4 UNION ALL SELECT key, 'old version' FROM f WHERE st AND i % 8 = 3
  UNION ALL SELECT key, 'extract of another source' FROM f WHERE i % 10 = 5 UNION ALL SELECT key, 'body changed' FROM f WHERE st AND i % 5 = 3""",
    "binding_gate": f"""WITH {_STAMPS} SELECT key, 'no stamp' AS code FROM f WHERE NOT st UNION ALL SELECT key, code FROM (SELECT key, i, 'verdict' AS code FROM f WHERE i % 9 = 4 UNION ALL SELECT key, i, 'extract changed' FROM f WHERE i % 12 = 8
  UNION ALL SELECT key, i, 'extract of another source' FROM f WHERE i % 10 = 5 UNION ALL SELECT key, i, 'source changed' FROM f WHERE i % 15 = 9 AND i % 7 <> 1 UNION ALL SELECT key, i, 'body changed' FROM f WHERE i % 5 = 3 OR i % 11 = 2) WHERE i % 6 <> 0""",
    "unbound_files": f"WITH {_STAMPS} SELECT key FROM f WHERE st AND i % 10 <> 5",
    "run_record_gate": f"""WITH {_STAMPS} SELECT key, 'no run record' AS code FROM f WHERE i % 13 = 1 UNION ALL SELECT key, code FROM (SELECT key, i, 'unreadable' AS code FROM f WHERE i % 14 = 5 UNION ALL SELECT key, i, code FROM (
    SELECT key, i, 'seal' AS code FROM f WHERE i % 16 = 6 UNION ALL SELECT key, i, 'body differs from the stamp' FROM f WHERE NOT st OR i % 5 = 3 OR i % 11 = 2
    UNION ALL SELECT key, i, 'version differs' FROM f WHERE NOT st OR i % 8 = 3 UNION ALL SELECT key, i, 'no tool version' FROM f) WHERE i % 14 <> 5) WHERE i % 13 <> 1""",
    "verification_level": "",
    "detector_rules": f"WITH {_P}, {_RULES} SELECT i AS id, CASE WHEN rationale IS NULL THEN 'apt' ELSE 'out-of-context' END AS verdict, rationale FROM v",
    "detector_score": f"""WITH {_P}, x AS (SELECT i % 2 = 1 AS g, CASE WHEN i % 11 = 0 OR i % 5 = 2 THEN NULL ELSE i % 5 IN (0, 3) END AS v FROM p),
  c AS (SELECT count(*) FILTER (g AND v) AS tp, count(*) FILTER (NOT g AND v) AS fp, count(*) FILTER (NOT g AND NOT v) AS tn, count(*) FILTER (g AND NOT v) AS fn, count(*) FILTER (v IS NULL) AS unscored FROM x)
  SELECT *, tp / nullif(tp + fn, 0) AS recall, tn / nullif(tn + fp, 0) AS specificity, tp / nullif(tp + fp, 0) AS precision, (tp + tn) / nullif(tp + tn + fp + fn, 0) AS accuracy FROM c""",
    "case_gate": f"WITH {_P} SELECT i AS id, 'no quote' AS code FROM p WHERE i % 4 = 1 UNION ALL SELECT i, 'no gold' FROM p WHERE i % 9 = 1 UNION ALL SELECT i, 'gold' FROM p WHERE i % 9 = 0",
    "case_balance": f"WITH {_P} SELECT count(*) FILTER (i % 2 = 1) AS n_positive, count(*) FILTER (i % 2 = 0) AS n_negative FROM p",
    "blind_cases": f"""WITH {_P} SELECT i AS id, 'k' AS source, 'a' AS slug, CASE i % 6 WHEN 0 THEN 'the risk might rise' WHEN 1 THEN 'it is associated with consumption' WHEN 2 THEN 'a subgroup of diabetic people' ELSE 'plain words' END AS quote,
  CASE i % 7 WHEN 0 THEN 'this proves it' WHEN 1 THEN 'it is most likely so' WHEN 2 THEN 'smoking causes it' WHEN 3 THEN 'this independently confirms it' WHEN 4 THEN 'for the General Population' ELSE 'it might be' END AS inference FROM p""",
    "lost_quotes": "SELECT item_id AS id FROM benchmark WHERE item_id % 4 <> 1 AND item_id % 3 = 0",
    "quote_check_files": """WITH b AS (SELECT item_id AS i, CAST(item_id AS VARCHAR) AS key FROM benchmark), v AS (SELECT *, i % 8 AS w FROM b)
  SELECT key, CAST(w IN (0, 1) AS BIGINT) AS passed, CAST(w = 5 AS BIGINT) AS passed_letters, CAST(w = 4 AS BIGINT) AS passed_mathless, CAST(w IN (2, 3, 6, 7) AS BIGINT) AS failed, CAST(w = 3 AS BIGINT) AS skipped, CAST(w = 6 AS BIGINT) AS n_notes, CASE WHEN w IN (2, 3, 6, 7) THEN 'fail' ELSE 'pass' END AS verdict FROM v""",
    "register_build": f"""WITH {_PAPERS}, f AS (SELECT i, i % 13 = 5 AS scan, i || '/' || CASE WHEN i % 13 = 5 THEN 'scan' || i || '.pdf' ELSE 'Au' || letters || 'x_' || (2000 + i % 3) || CASE WHEN i % 2 = 0 THEN '' ELSE '_n' || i END || '.' || (['pdf', 'html', 'xml'])[i % 3 + 1] END AS filename,
    CASE WHEN i % 13 = 5 THEN NULL ELSE 'au' || letters || 'x' END AS fa, CASE WHEN i % 13 = 5 THEN NULL ELSE CAST(2000 + i % 3 AS VARCHAR) END AS fy, i % 97 AS size, CASE WHEN i % 13 = 5 THEN 'pdf' ELSE (['pdf', 'html', 'xml'])[i % 3 + 1] END AS ext,
    CASE WHEN i % 4 = 1 THEN '10.1371/' || (i % 2) END AS doi, i % 19 = 7 AS landing, i % 29 = 3 AND i % 13 = 5 AS o FROM c),
  m AS (SELECT *, CASE WHEN i % 5 = 1 THEN 'othername' WHEN i % 5 = 2 AND fa IS NOT NULL THEN fa || 'son' END AS ma, CASE WHEN i % 7 = 3 THEN '2009' END AS my FROM f),
  r AS (SELECT *, CASE WHEN o THEN 'ake' ELSE coalesce(ma, fa) END AS author, CASE WHEN o THEN '2011' ELSE coalesce(my, fy) END AS year, NOT o AND fa IS NOT NULL AND ma IS NOT NULL AND NOT (i % 5 = 2 AND length(fa) >= 5) AS bad_a, NOT o AND fy IS NOT NULL AND my IS NOT NULL AS bad_y FROM m),
  d AS (SELECT author, year, doi, row_number() OVER (PARTITION BY author, year ORDER BY doi) AS k, count(*) OVER (PARTITION BY author, year) AS n FROM (SELECT DISTINCT author, year, doi FROM r WHERE doi IS NOT NULL AND author IS NOT NULL AND year IS NOT NULL)),
  w AS (SELECT DISTINCT author, year FROM d WHERE n > 1),
  key AS (SELECT r.*, CASE WHEN r.author IS NULL OR r.year IS NULL THEN NULL ELSE r.author || '_' || r.year || CASE WHEN w.author IS NULL THEN '' ELSE coalesce(chr(CAST(96 + d.k AS INT)), '?') END END AS key FROM r LEFT JOIN w ON w.author = r.author AND w.year = r.year LEFT JOIN d ON d.author = r.author AND d.year = r.year AND d.doi = r.doi AND d.n > 1),
  first AS (SELECT *, first_value(filename) OVER (PARTITION BY key ORDER BY landing, list_position(['pdf', 'html', 'xml'], ext), size DESC, filename) AS best FROM key)
  SELECT filename, coalesce(author, '') AS first_author, coalesce(year, '') AS year, coalesce(key, '') AS key, CASE WHEN key IS NULL OR key LIKE '%?' THEN 'unknown' WHEN best <> filename THEN 'duplicate_of:' || key WHEN o THEN 'verified' WHEN landing THEN 'landing_page' WHEN bad_a OR bad_y THEN 'mismatch' WHEN key IN ('auax_2000', 'auabx_2001') THEN 'verified' ELSE 'downloaded' END AS status,
  concat_ws('; ', CASE WHEN o THEN 'override_applied: seen' END, CASE WHEN bad_a THEN 'filename_says_' || fa || '_but_metadata_says_' || ma END, CASE WHEN bad_y THEN 'filename_says_' || fy || '_but_metadata_says_' || my END) AS notes FROM first""",
    "doi_triage": """SELECT p_partkey AS i, CASE p_partkey % 4 WHEN 0 THEN '10.1371' WHEN 1 THEN '10.9999' WHEN 2 THEN '10.1016' ELSE '' END AS prefix, CASE p_partkey % 4 WHEN 0 THEN 'PLOS' WHEN 2 THEN 'Elsevier' END AS publisher, CASE p_partkey % 4 WHEN 0 THEN 'permissive-licence' WHEN 2 THEN 'restricted' ELSE 'unknown' END AS redistribution,
  CASE WHEN p_partkey % 4 = 0 THEN 'PLOS journals publish every article under CC-BY 4.0' WHEN p_partkey % 4 = 1 THEN 'publisher default not established for this DOI registrant' WHEN p_partkey % 4 = 2 THEN 'closed-access publisher default; per-article open licence not established' WHEN p_partkey % 8 = 3 THEN 'PMC hosting does not establish an item-level redistribution licence' ELSE 'no DOI or repository licence established' END AS basis FROM part""",
    "landing_pages": "SELECT page_id, page_id % 5 = 0 OR (page_id % 2 = 0 AND octet_length(encode(html)) < 20480) AS landing FROM pages",
    "posture_values": f"WITH {_HELD} SELECT project, gate, value, given FROM held",
    "profile_fit": f"WITH {_HELD}, f AS (SELECT * FROM (VALUES {_PROFILES}) t(profile, gate, wanted)), x AS (SELECT project, profile, count(*) FILTER (value <> wanted) AS distance FROM held JOIN f USING (gate) GROUP BY ALL) SELECT *, distance = min(distance) OVER (PARTITION BY project) AS nearest FROM x",
    "strict_gaps": f"WITH {_HELD}, w AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{v}')" for k, v in project.STRICT.items())}) t(gate, wanted)) SELECT project, gate, value, wanted FROM held JOIN w USING (gate) WHERE value <> wanted",
    "project_states": f"""WITH {_PROJECT}, x AS (SELECT *, CASE WHEN i % 5 <> 4 AND i % 7 <> 6 AND i % 4 = 1 THEN 'drafted' WHEN i % 5 <> 4 AND i % 7 <> 6 AND i % 8 <> 3 THEN 'configured' ELSE 'broken' END AS found, CASE WHEN i % 6 = 5 THEN 'pristine' ELSE 'configured' END AS declared FROM n)
  SELECT project, CASE WHEN (declared = 'configured' AND found = 'drafted') OR (declared = 'pristine' AND found = 'configured') THEN 'broken' ELSE found END AS state FROM x""",
    "gate_run": f"""WITH {_SELECTION}, {_FLOW}, x AS (SELECT project, i % 2 = 0 AND i % 10 = 6 AND i % 9 <> 0 AS absent, project IN (SELECT project FROM sel) AS bad FROM n)
  SELECT project, CASE WHEN absent OR bad THEN 1 ELSE 0 END AS exit, CASE WHEN absent THEN 'quote check' WHEN bad THEN 'selection audit' END AS next FROM x""",
    "review_staleness": "SELECT 'c' || c_custkey AS project, CASE WHEN c_custkey % 3 = 0 THEN 'stale' ELSE 'not set' END AS code FROM customer WHERE c_custkey % 3 <> 0 OR 366 - c_custkey % 400 > 180",
    "wiki_gate": """WITH c AS (SELECT c_custkey AS i, max(c_custkey) OVER () AS top FROM customer), p AS (SELECT *, CASE WHEN i % 4 = 0 THEN 'concept_notes/Note' || i || '.md' ELSE 'note' || i || '.md' END AS path FROM c)
  SELECT path, 'dead link' AS code, 'note' || (i + 1) AS detail FROM p WHERE i = top UNION ALL SELECT path, 'dead link', 'note' || (i * 2) FROM p WHERE i * 2 > top AND i * 2 <> i + 1 UNION ALL SELECT path, 'path link', 'sub/note1' FROM p WHERE i % 5 = 0
  UNION ALL SELECT path, 'orphan', NULL FROM p WHERE i = (SELECT min(i) FROM c) AND i * 2 <> i UNION ALL SELECT path, 'uncatalogued', NULL FROM p WHERE i % 4 = 0 AND NOT contains('lists note8 and note12', 'note' || i)""",
    "calibration_gate": f"""WITH {_P}, n AS (SELECT * FROM p WHERE i % 4 <> 2) SELECT 'n' || i AS note, 'missing' AS code, 'inside_view' AS field FROM n WHERE i % 7 = 3 UNION ALL SELECT 'n' || i, 'not numeric', 'out_of_model_discount' FROM n WHERE i % 5 = 2 UNION ALL SELECT 'n' || i, 'missing', 'adversarial_discount' FROM n WHERE i % 6 = 4 UNION ALL SELECT 'n' || i, 'above', 'calibrated_confidence' FROM n WHERE i % 4 = 1 AND i % 7 <> 3""",
    "run_agreement": f"""WITH {_I}, x AS (SELECT i, i % 5 <> 1 AS same, i % 3 <> 0 AS slug, i % 7 <> 0 AS loc, i % 2 = 0 AS said FROM s), n AS (SELECT count(*) AS n FROM s),
  m AS (SELECT 'locus' AS measure, count(*) FILTER (same AND (loc OR i = 0)) AS shared, 2 * any_value(n.n) - count(*) FILTER (same AND (loc OR i = 0)) AS total FROM x, n
    UNION ALL SELECT 'selection', count(*) FILTER (same AND said) + count(*) FILTER (same), 4 * any_value(n.n) - count(*) FILTER (same AND said) - count(*) FILTER (same) FROM x, n
    UNION ALL SELECT 'claim', count(*) FILTER (same AND slug), 2 * any_value(n.n) - count(*) FILTER (same AND slug) FROM x, n UNION ALL SELECT 'coverage', 3, 4)
  SELECT measure, shared, total, shared / total AS value FROM m UNION ALL SELECT 'attribution', count(*) FILTER (same), count(*), coalesce(count(*) FILTER (same) / nullif(count(*), 0), 1) FROM x WHERE slug""",
    "citation_gate": "SELECT 'key' || s_suppkey || 'x' AS author, '2003' AS year, CASE s_suppkey % 4 WHEN 0 THEN 'c1' WHEN 1 THEN 'own' WHEN 2 THEN 'gone' END AS claim, CASE WHEN s_suppkey % 5 = 2 THEN 'no file' WHEN s_suppkey % 4 = 0 THEN 'ordinal' WHEN s_suppkey % 4 = 2 THEN 'no claim' ELSE 'unnamed' END AS code FROM supplier WHERE s_suppkey % 5 = 2 OR s_suppkey % 4 <> 1",
    "graph_export": f"WITH {_EDGE}, b AS (SELECT DISTINCT unnest([target, key || ':' || grounding]) AS item FROM e) SELECT 'node' AS part, item FROM b WHERE item IS NOT NULL UNION ALL SELECT 'edge', coalesce(key || ':' || grounding, '?') || ' ' || type || ' ' || target FROM e UNION ALL SELECT 'address', 'k' || i || ' q' || (i % 5) FROM s",
}
ORACLES["verification_level"] = f"""WITH {_STAMPS}, good AS (SELECT count(*) AS n FROM f WHERE st AND key NOT IN (SELECT key FROM ({ORACLES["stamp_gate"]})))
SELECT t.name, CASE WHEN n = 0 AND t.name IN ('sound', 'signed') THEN 'empty' ELSE t.level END AS level FROM good, (VALUES ('all', 'unverified'), ('sound', 'reproducible'), ('signed', 'attested'), ('nothing', 'empty')) t(name, level)"""
