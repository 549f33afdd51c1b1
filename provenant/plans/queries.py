"""Queries of the evidence operators over the driver's tables, each with SQL that says the same to another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.functions import text as X
from provenant.operators import binding, citations, graph, mermaid, metrics, quotecheck, records, register
from provenant.plans import boards, library, projects, views
from provenant.sources import html_units
from provenant.sources.scratch import bounded_batches

F_ = F.col


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def norm_profile(s, d):
    n = _t(s, d, "documents").select("doc_id", X.norm("text").alias("n"))
    return n.select("doc_id", F.length("n").cast("long").alias("n_norm"), F.length(X.letters(F_("n"))).cast("long").alias("n_letters"), F.sha2("n", 256).alias("digest"))


def _quotes(s, d):
    return _t(s, d, "benchmark").select(F_("item_id").alias("quote_id"), F_("text").alias("quote"))


def quote_check_pairs(s, d):
    texts = _t(s, d, "documents").select(F_("doc_id").alias("text_id"), "text")
    return quotecheck.contained(_quotes(s, d), texts).select(F_("quote_id").alias("item_id"), F_("text_id").alias("doc_id"))


def quote_check_verdict(s, d):
    found = quote_check_pairs(s, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    each = _quotes(s, d).join(found, F_("quote_id") == F_("item_id"), "left")
    hit = F_("n").isNotNull()
    return each.select(F_("quote_id").alias("item_id"), X_verdict(X.norm("quote"), hit).alias("verdict"), F.coalesce("n", F.lit(0)).alias("n_docs"))


def X_verdict(needle, hit):
    return F.when(F.length(needle) == 0, "EMPTY").when(F.length(needle) < X.MIN_SPAN, F.when(hit, "SKIP").otherwise("FAIL")).when(hit, "PASS").otherwise("FAIL")


def quote_check_by_source(s, d):
    pairs = quote_check_pairs(s, d).join(_t(s, d, "documents").select("doc_id", "source"), "doc_id")
    return pairs.groupBy("source").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("item_id").alias("n_items"))


def span_split(s, d):
    b = _t(s, d, "benchmark").select("item_id", F.concat("text", F.lit(" ... "), F.reverse("text"), F.lit(" … end")).alias("q"))
    return b.select("item_id", F.posexplode(X.spans(F_("q"))).alias("place", "span"))


def quote_grammar(s, d):
    b = _t(s, d, "benchmark")
    lines = b.select("item_id", F.when(F_("item_id") % 3 == 0, F.concat(F.lit('> "'), "text", F.lit('" and more'))).when(F_("item_id") % 3 == 1, F.concat(F.lit("> "), "text")).otherwise(F.concat(F.lit('> "'), "text")).alias("line"))
    return lines.select("item_id", X.quote_text(F_("line")).alias("quote"))


def _edges(s, d):
    """Edges between suppliers' nations and regions, and orders and customers, as claims about one another."""
    n = _t(s, d, "nation")
    up = n.select(F.concat(F.lit("nation:n"), F_("n_nationkey").cast("string")).alias("source"), F.concat(F.lit("region:r"), F_("n_regionkey").cast("string")).alias("target"), F.when(F_("n_nationkey") % 5 == 0, "rebuts").otherwise("supports").alias("type"), F.when(F_("n_nationkey") % 2 == 0, F.concat(F.lit("nation:n"), ((F_("n_nationkey") + 1) % 25).cast("string"))).alias("grounding"))
    top = _t(s, d, "region").select(F.lit("top:all").alias("source"), F.concat(F.lit("region:r"), F_("r_regionkey").cast("string")).alias("target"), F.lit("depends-on").alias("type"), F.lit(None).cast("string").alias("grounding"))
    low = _t(s, d, "supplier").select(F.concat(F.lit("supplier:s"), F_("s_suppkey").cast("string")).alias("source"), F.concat(F.lit("nation:n"), F_("s_nationkey").cast("string")).alias("target"), F.lit("supports").alias("type"), F.lit(None).cast("string").alias("grounding"))
    return up.unionByName(top).unionByName(low)


_EDGES = """edges AS (
  SELECT 'nation:n' || n_nationkey AS source, 'region:r' || n_regionkey AS target, CASE WHEN n_nationkey % 5 = 0 THEN 'rebuts' ELSE 'supports' END AS type, CASE WHEN n_nationkey % 2 = 0 THEN 'nation:n' || ((n_nationkey + 1) % 25) END AS grounding FROM nation
  UNION ALL SELECT 'top:all', 'region:r' || r_regionkey, 'depends-on', NULL FROM region
  UNION ALL SELECT 'supplier:s' || s_suppkey, 'nation:n' || s_nationkey, 'supports', NULL FROM supplier)"""
_UNDER = """under AS (SELECT DISTINCT CASE type WHEN 'supports' THEN source ELSE target END AS lower_, CASE type WHEN 'supports' THEN target ELSE source END AS upper_ FROM edges WHERE type IN ('supports', 'depends-on'))"""


def edge_parse(s, d):
    e = _edges(s, d)
    label = F.when(F_("type") == "supports", "Supports").when(F_("type") == "rebuts", "Rebuts").otherwise("Depends-on")
    line = F.concat(F.lit("**"), label, F.lit(":** "), F.upper("target"), F.coalesce(F.concat(F.lit(" (grounded by #"), F.regexp_replace("grounding", "^.*:", ""), F.lit(")")), F.lit("")), F.lit(" [rec: R-1]"))
    p = e.select("source", X.edge(line).alias("e"), X.address(F_("target")).alias("a"))
    return p.select("source", F_("e.type").alias("type"), F_("e.target").alias("target"), F_("e.grounding").alias("grounding"), F_("e.rec").alias("rec"), F_("a.key").alias("key"), F_("a.slug").alias("slug"))


def structure_problems(s, d):
    e = _edges(s, d)
    claims = _t(s, d, "region").filter("r_regionkey < 4").select(F.concat(F.lit("region:r"), F_("r_regionkey").cast("string")).alias("claim")).unionByName(_t(s, d, "nation").filter("n_nationkey <> 3").select(F.concat(F.lit("nation:n"), F_("n_nationkey").cast("string")).alias("claim")))
    twice = e.filter("type = 'rebuts'").withColumn("type", F.lit("supports"))
    return graph.structure_problems(e.unionByName(twice), claims)


def load_bearing(s, d):
    return graph.load_bearing(_edges(s, d))


def principal_claims(s, d):
    return _t(s, d, "orders").groupBy(F_("o_custkey").alias("claim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "claim").limit(10)


def dependency_closure(s, d):
    return graph.closure(graph.underpins(_edges(s, d)))


def articulation(s, d):
    return graph.cuts(graph.underpins(_edges(s, d)))


def articulation_all(s, d):
    """As articulation, which once took the edges of few suppliers."""
    return articulation(s, d)


def double_count(s, d):
    e = _edges(s, d).filter("type = 'supports'")
    n = _t(s, d, "nation").select(F.concat(F.lit("nation:n"), F_("n_nationkey").cast("string")).alias("node"), F_("n_nationkey").alias("k"))
    pair = n.join(n.select(F_("node").alias("other"), (F_("k") - 5).alias("k")), "k").select(F.least("node", "other").alias("lo"), F.greatest("node", "other").alias("hi"), F.lit("shared-data").alias("kind"))
    return graph.double_count(e, pair)


def coverage_records(s, d):
    e = _edges(s, d).filter("grounding is not null").withColumn("rec", F.when(F_("source").endswith("4"), F.concat(F.lit("rec-"), "source")))
    r = e.filter("source <> 'nation:n2'").select("target", "grounding", F.concat(F.lit("rec-"), "source").alias("id"))
    return graph.coverage(e, r).select("source", "target", "covering")


def unassessed_edges(s, d):
    return coverage_records(s, d).filter("covering is null").select("source", "target")


def faithfulness_status(s, d):
    lab = _t(s, d, "labels")
    j = _t(s, d, "documents").select("doc_id").join(lab, "doc_id", "left")
    return j.select("doc_id", F.when(F_("toxic") == 1, "disputed").when(F_("quality") == 1, "passed").when(F_("quality").isNotNull(), "unreviewed").otherwise("no-record").alias("status"))


def confusion_matrix(s, d):
    j = _t(s, d, "labels").join(_t(s, d, "documents").select("doc_id", "lang", "text"), "doc_id")
    rule = F.lower("text").rlike("idiot|scum|stupid|loser")
    return metrics.confusion(j.select("lang", (F_("toxic") == 1).alias("gold"), F.when(F_("doc_id") % 7 != 0, rule).alias("verdict")), "lang")


def _runs(s, d):
    n = _t(s, d, "documents").select("lang", X.norm_digest("text").alias("span"), F.regexp_extract("source", "[0-9]+", 0).cast("int").alias("k"))
    return n.filter("k % 2 = 0").select("lang", "span"), n.filter("k % 2 = 1").select("lang", "span")


def agreement_jaccard(s, d):
    a, b = _runs(s, d)
    return metrics.agreement(a, b, "lang", "span")


def residual(s, d):
    a, b = _runs(s, d)
    return metrics.residual(a, b).groupBy("lang", "side").agg(F.count(F.lit(1)).alias("n"))


def turn_units(s, d):
    from pyspark.sql import Window

    c = _t(s, d, "conversations")
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select("conv_id", "turn", X.slug(F.concat_ws(" ", F.lit("t"), F_("turn").cast("string"), F_("role"))).alias("locus"), n.cast("long").alias("place"))


def register_canonical(s, d):
    f = _t(s, d, "documents").select(X.norm_digest("text").alias("key"), F_("doc_id").alias("filename"), F.length("text").alias("size"))
    return register.canonical(f, "key", -F_("size")).select(F_("filename").alias("doc_id"), "duplicate_of", "canonical")


def register_status_counts(s, d):
    return register_canonical(s, d).groupBy(F.when(F_("canonical"), "verified").otherwise("duplicate").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def register_suffixes(s, d):
    w = _t(s, d, "part").select(F_("p_partkey"), F_("p_brand").alias("author"), F_("p_size").alias("year"), F.when(F_("p_partkey") % 4 != 0, F_("p_type")).alias("doi"))
    return register.suffixes(w).select("p_partkey", "suffix")


def host_triage(s, d):
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    kinds = s.createDataFrame([("com", "commercial"), ("org", "organisation"), ("net", "network")], "suffix string, kind string")
    p = _t(s, d, "pages").select("page_id", F.substring_index(host, ".", -1).alias("suffix")).join(F.broadcast(kinds), "suffix", "left")
    return p.groupBy(F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def selection_gaps(s, d):
    docs = _t(s, d, "documents")
    declared = s.range(0, 25).select(F.concat(F.lit("src"), F_("id").cast("string")).alias("source"))
    return register.against(declared, docs.join(_t(s, d, "labels").filter("toxic = 1"), "doc_id").unionByName(docs.limit(0).withColumns({"quality": F.lit(0), "toxic": F.lit(0)})), "source")


def identity_mismatch(s, d):
    c = _t(s, d, "customer").select("c_custkey", F.lower("c_mktsegment").alias("name_author"), F.when(F_("c_custkey") % 3 == 0, F.substring(F.lower("c_mktsegment"), 1, 6)).when(F_("c_custkey") % 3 == 1, F.lit("other")).otherwise(F.lower("c_mktsegment")).alias("meta_author"), (F.lit(2000) + F_("c_nationkey")).alias("name_year"), F.lit(2010).alias("meta_year"))
    return register.identity_problems(c).select("c_custkey", "problem")


def dead_links(s, d):
    return register.dead_links(*_links(s, d))


def wiki_orphans(s, d):
    return register.orphans(*_links(s, d))


def _links(s, d):
    p = _t(s, d, "pages")
    links = p.select(F_("page_id").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1)))).alias("target"))
    notes = p.select(F.regexp_extract("html", "<h1>([^ <]*)", 1).alias("note")).filter("note <> ''").distinct()
    return links, notes


def staleness(s, d):
    last = _t(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    age = F.datediff(F.lit("2025-01-01").cast("date"), F.to_date("last"))
    return last.select("user_id", age.cast("long").alias("age_days"), (age > 180).alias("stale"))


def calibration_check(s, d):
    n = _t(s, d, "part").select("p_partkey", F.when(F_("p_size") % 9 == 0, "high").otherwise((F_("p_size") / 50).cast("string")).alias("inside_view"), (F_("p_retailprice") / 2000).cast("string").alias("calibrated"))
    return register.calibration_problems(n).select("p_partkey", "problem")


def units_html(s, d):
    return html_units.units(_t(s, d, "pages"), "page_id", "html").select("page_id", "locus", "text")


def _prose(s, d):
    """A sentence for each supplier that cites in one of five ways."""
    key, way = F.concat(F.lit("Key"), F_("s_suppkey").cast("string"), F.lit("x")), F_("s_suppkey") % 5
    text = F.when(way == 0, F.concat(F.lit("As "), key, F.lit(" et al. (2003a #C1) say"))).when(way == 1, F.concat(key, F.lit(", Other, and Third 2004 agree")))
    text = text.when(way == 2, F.concat(F.lit("by "), key, F.lit("&Other (2005)"))).when(way == 3, F.concat(F.lit("("), key, F.lit(" 2006), see Table (2007)"))).otherwise(F.concat(F.lit("since 2008 "), key, F.lit(" went on")))
    return _t(s, d, "supplier").select("s_suppkey", text.alias("text"))


def citations_extract(s, d):
    return citations.citations(_prose(s, d), "s_suppkey", "text")


def citations_resolve(s, d):
    key = F.concat(F_("s_suppkey").cast("string"), F.lit("x"))  # no name is the start of another's
    files = _t(s, d, "supplier").filter("s_suppkey % 5 IN (0, 1)").select(F.when(F_("s_suppkey") % 5 == 0, F.concat(F.lit("Key"), key, F.lit("_2003_notes.md"))).otherwise(F.concat(F.lit("other"), key, F.lit("_2011.md"))).alias("name"))
    aliases = _t(s, d, "supplier").filter("s_suppkey % 5 IN (1, 2)").select(F.concat(F.lit("key"), key, F.when(F_("s_suppkey") % 5 == 1, "_2004").otherwise("_2005")).alias("alias"), F.concat(F.lit("other"), key, F.lit("_2011")).alias("target"))
    return citations.resolve(citations_extract(s, d), files, aliases)


def numeric_markers(s, d):
    text = F.when(F_("doc_id") % 2 == 0, F.concat("text", F.lit(" seen [7, 9] before.⁵⁴ and x²"))).otherwise(F_("text"))
    return _t(s, d, "documents").select("doc_id", F.size(citations.numeric_markers(text)).cast("long").alias("n_markers"))


def mermaid_lines(s, d):
    n = F.concat(F.lit("nation:n"), F_("n_nationkey").cast("string"))
    nation = _t(s, d, "nation")
    edges = nation.select(F.when(F_("n_nationkey") % 4 > 0, n).alias("source"), F.concat(F.lit("region:r"), F_("n_regionkey").cast("string")).alias("target"), F.when(F_("n_nationkey") % 5 == 0, "rebuts").otherwise("supports").alias("type"))
    return mermaid.mermaid(nation.select(n.alias("node"), (F_("n_nationkey") % 7 == 0).alias("superseded")), edges)


def seal_check(s, d):
    """Records of every benchmark item, every third one with a seal of something else."""
    item, subject = F_("item_id").cast("string"), F.sha2("text", 256)
    seal = F.sha2(F.concat(F.lit('{"id": "r'), item, F.lit('", "subject": "'), subject, F.lit('"}')), 256)
    record = F.to_json(F.struct(subject.alias("subject"), F.when(F_("item_id") % 3 > 0, seal).otherwise("0").alias("record_sha256"), F.concat(F.lit("r"), item).alias("id")))
    return _t(s, d, "benchmark").select("item_id", record.alias("record")).select("item_id", records.seal_of(F_("record")).alias("digest"), records.sealed(F_("record")).alias("sealed"))


def units_bind(s, d):
    """Turns as units, each quoted by a claim in one of several ways."""
    c = _t(s, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    key, locus = F.concat(F.lit("c"), F_("conv_id").cast("string")).alias("key"), F.concat(F.lit("t"), F_("turn").cast("string"))
    quote = F.when(F_("turn") % 3 == 2, "7 that no turn says 7").when(F_("turn") % 7 != 3, F.substring("text", 3, 30))
    claims = c.select(key, F.when(F_("turn") % 5 == 4, "T99").otherwise(F.upper(locus)).alias("locus"), quote.alias("quote"), F.when(F_("conv_id") % 6 == 5, "x").otherwise("y").alias("stamp"))
    manifests = c.select("conv_id").distinct().filter("conv_id % 9 > 0").select(key, F.lit("y").alias("source_sha256"), (F_("conv_id") % 4 != 1).alias("fully_enumerable"))
    return binding.problems(claims, manifests, c.select(key, locus.alias("locus"), "text"))


QUERIES = {f.__name__: f for f in (norm_profile, quote_check_pairs, quote_check_verdict, quote_check_by_source, span_split, quote_grammar, edge_parse, structure_problems, load_bearing, principal_claims, dependency_closure, articulation, articulation_all, double_count, coverage_records, unassessed_edges, faithfulness_status, confusion_matrix, agreement_jaccard, residual, turn_units, register_canonical, register_status_counts, register_suffixes, host_triage, selection_gaps, identity_mismatch, dead_links, wiki_orphans, staleness, calibration_check, units_html, citations_extract, citations_resolve, numeric_markers, mermaid_lines, seal_check, units_bind)}

QUERIES |= projects.QUERIES | views.QUERIES | library.QUERIES | boards.QUERIES

_N = "regexp_replace(lower(strip_accents(replace({0}, 'ß', 'ss'))), '[^a-z0-9]', '', 'g')"
_D, _B = _N.format("d.text"), _N.format("b.text")
_PAIRS = f"pairs AS (SELECT b.item_id, d.doc_id FROM (SELECT item_id, {_N.format('text')} AS n FROM benchmark) b JOIN (SELECT doc_id, {_N.format('text')} AS n FROM documents) d ON contains(d.n, b.n) AND b.n <> '')"
_CANON = f"""canon AS (SELECT doc_id, CASE WHEN first <> doc_id THEN first END AS duplicate_of FROM (
  SELECT doc_id, first_value(doc_id) OVER (PARTITION BY {_N.format('text')} ORDER BY length(text) DESC, doc_id) AS first FROM documents))"""
_RUNS = f"runs AS (SELECT DISTINCT lang, {_N.format('text')} AS span, CAST(regexp_extract(source, '[0-9]+') AS INT) % 2 AS side FROM documents)"
_LINKS = """links AS (SELECT DISTINCT page_id AS source, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS target FROM pages),
  notes AS (SELECT DISTINCT regexp_extract(html, '<h1>([^ <]*)', 1) AS note FROM pages WHERE regexp_extract(html, '<h1>([^ <]*)', 1) <> '')"""
_COVER = """covered AS (SELECT e.source, e.target, CASE WHEN e.source LIKE '%4' THEN max(CASE WHEN r.id = 'rec-' || e.source THEN r.id END) ELSE min(r.id) END AS covering
  FROM edges e LEFT JOIN (SELECT target, grounding, 'rec-' || source AS id FROM edges WHERE grounding IS NOT NULL AND source <> 'nation:n2') r ON r.target = e.target AND r.grounding = e.grounding WHERE e.grounding IS NOT NULL GROUP BY e.source, e.target, e.grounding)"""
_REACH = "reach AS (SELECT upper_ AS node, lower_ AS ancestor FROM under UNION SELECT r.node, u.lower_ FROM reach r JOIN under u ON u.upper_ = r.ancestor)"

ORACLES = {
    "norm_profile": f"SELECT doc_id, CAST(length(n) AS BIGINT) AS n_norm, CAST(length(regexp_replace(n, '[0-9]', '', 'g')) AS BIGINT) AS n_letters, sha256(n) AS digest FROM (SELECT doc_id, {_N.format('text')} AS n FROM documents)",
    "quote_check_pairs": f"WITH {_PAIRS} SELECT item_id, doc_id FROM pairs",
    "quote_check_verdict": f"WITH {_PAIRS} SELECT b.item_id, CASE WHEN length({_B}) = 0 THEN 'EMPTY' WHEN length({_B}) < 25 THEN CASE WHEN count(p.doc_id) > 0 THEN 'SKIP' ELSE 'FAIL' END WHEN count(p.doc_id) > 0 THEN 'PASS' ELSE 'FAIL' END AS verdict, count(p.doc_id) AS n_docs FROM benchmark b LEFT JOIN pairs p USING (item_id) GROUP BY b.item_id, b.text",
    "quote_check_by_source": f"WITH {_PAIRS} SELECT source, count(*) AS n_pairs, count(DISTINCT item_id) AS n_items FROM pairs JOIN documents USING (doc_id) GROUP BY source",
    "span_split": "SELECT item_id, CAST(unnest(range(3)) AS INT) AS place, trim(unnest([text, reverse(text), 'end'])) AS span FROM benchmark",
    "quote_grammar": "SELECT item_id, CASE item_id % 3 WHEN 1 THEN NULL ELSE text END AS quote FROM benchmark",
    "edge_parse": f"WITH {_EDGES} SELECT source, type, target, regexp_replace(grounding, '^.*:', '') AS grounding, 'r-1' AS rec, split_part(target, ':', 1) AS key, split_part(target, ':', 2) AS slug FROM edges",
    "structure_problems": f"WITH {_EDGES}, twice AS (SELECT * FROM edges UNION ALL SELECT source, target, 'supports', grounding FROM edges WHERE type = 'rebuts'), claims AS (SELECT 'region:r' || r_regionkey AS c FROM region WHERE r_regionkey < 4 UNION ALL SELECT 'nation:n' || n_nationkey FROM nation WHERE n_nationkey <> 3) SELECT source, target, 'dangling' AS code FROM twice WHERE target NOT IN (SELECT c FROM claims) UNION ALL SELECT source, target, 'contradiction' FROM twice GROUP BY source, target HAVING bool_or(type = 'supports') AND bool_or(type = 'rebuts')",
    "load_bearing": f"WITH {_EDGES} SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(1 - i) AS BIGINT) AS grounding_degree, count(*) AS total FROM (SELECT target AS node, 1 AS i FROM edges UNION ALL SELECT grounding, 0 FROM edges WHERE grounding IS NOT NULL) GROUP BY node",
    "principal_claims": "SELECT o_custkey AS claim, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, claim LIMIT 10",
    "dependency_closure": f"WITH RECURSIVE {_EDGES}, {_UNDER}, {_REACH} SELECT node, ancestor FROM reach",
    "articulation": f"WITH RECURSIVE {_EDGES}, {_UNDER}, {_REACH}, blocked AS (SELECT r.node, r.ancestor, c.ancestor AS cut FROM reach r JOIN reach c ON r.node = c.node WHERE FALSE UNION SELECT u.upper_, u.lower_, c.ancestor FROM under u JOIN reach c ON c.node = u.upper_ UNION SELECT b.node, u.lower_, b.cut FROM blocked b JOIN under u ON u.upper_ = b.ancestor AND b.ancestor <> b.cut) SELECT DISTINCT r.node, c.ancestor AS cut FROM reach r JOIN reach c ON r.node = c.node AND r.ancestor <> c.ancestor AND c.ancestor <> c.node WHERE NOT EXISTS (SELECT 1 FROM blocked b WHERE b.node = r.node AND b.ancestor = r.ancestor AND b.cut = c.ancestor)",
    "double_count": f"WITH {_EDGES}, pairs AS (SELECT least('nation:n' || a.n_nationkey, 'nation:n' || b.n_nationkey) AS lo, greatest('nation:n' || a.n_nationkey, 'nation:n' || b.n_nationkey) AS hi FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 5) SELECT DISTINCT a.target, lo, hi, 'shared-data' AS kind FROM pairs JOIN edges a ON a.source = lo AND a.type = 'supports' JOIN edges b ON b.source = hi AND b.type = 'supports' AND a.target = b.target",
    "coverage_records": f"WITH {_EDGES}, {_COVER} SELECT * FROM covered",
    "unassessed_edges": f"WITH {_EDGES}, {_COVER} SELECT source, target FROM covered WHERE covering IS NULL",
    "faithfulness_status": "SELECT doc_id, CASE WHEN toxic = 1 THEN 'disputed' WHEN quality = 1 THEN 'passed' WHEN quality IS NOT NULL THEN 'unreviewed' ELSE 'no-record' END AS status FROM documents LEFT JOIN labels USING (doc_id)",
    "confusion_matrix": "WITH c AS (SELECT lang, count(*) FILTER (g AND v) AS tp, count(*) FILTER (NOT g AND v) AS fp, count(*) FILTER (NOT g AND NOT v) AS tn, count(*) FILTER (g AND NOT v) AS fn, count(*) FILTER (v IS NULL) AS unscored FROM (SELECT lang, toxic = 1 AS g, CASE WHEN doc_id % 7 <> 0 THEN regexp_matches(lower(text), 'idiot|scum|stupid|loser') END AS v FROM labels JOIN documents USING (doc_id)) GROUP BY lang) SELECT *, tp / nullif(tp + fn, 0) AS recall, tn / nullif(tn + fp, 0) AS specificity, tp / nullif(tp + fp, 0) AS precision, (tp + tn) / nullif(tp + tn + fp + fn, 0) AS accuracy FROM c",
    "agreement_jaccard": f"WITH {_RUNS}, e AS (SELECT lang, span, count(*) AS n FROM runs GROUP BY lang, span) SELECT count(*) FILTER (n = 2) AS n_both, count(*) AS n_either, count(*) FILTER (n = 2) / count(*) AS jaccard FROM e",
    "residual": f"WITH {_RUNS}, e AS (SELECT lang, span, min(side) AS s, count(*) AS n FROM runs GROUP BY lang, span) SELECT lang, CASE s WHEN 0 THEN 'a' ELSE 'b' END AS side, count(*) AS n FROM e WHERE n = 1 GROUP BY lang, s",
    "turn_units": "SELECT conv_id, turn, 't-' || turn || '-' || role AS locus, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations",
    "register_canonical": f"WITH {_CANON} SELECT doc_id, duplicate_of, duplicate_of IS NULL AS canonical FROM canon",
    "register_status_counts": f"WITH {_CANON} SELECT CASE WHEN duplicate_of IS NULL THEN 'verified' ELSE 'duplicate' END AS status, count(*) AS n FROM canon GROUP BY 1",
    "register_suffixes": "WITH w AS (SELECT p_partkey, p_brand AS a, p_size AS y, CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS doi FROM part), r AS (SELECT a, y, doi, row_number() OVER (PARTITION BY a, y ORDER BY doi) AS k, count(*) OVER (PARTITION BY a, y) AS n FROM (SELECT DISTINCT a, y, doi FROM w WHERE doi IS NOT NULL)) SELECT p_partkey, CASE WHEN n > 1 THEN chr(CAST(96 + k AS INT)) END AS suffix FROM w LEFT JOIN r ON w.a = r.a AND w.y = r.y AND w.doi = r.doi",
    "host_triage": "SELECT CASE regexp_extract(url, '^[a-z]+://[^/]*?([^./]+)(/|$)', 1) WHEN 'com' THEN 'commercial' WHEN 'org' THEN 'organisation' WHEN 'net' THEN 'network' ELSE 'unknown' END AS kind, count(*) AS n FROM pages GROUP BY 1",
    "selection_gaps": "WITH d AS (SELECT 'src' || i AS source FROM range(25) t(i)), p AS (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) SELECT source, 'missing' AS \"where\" FROM d WHERE source NOT IN (SELECT source FROM p) UNION ALL SELECT source, 'undeclared' FROM p WHERE source NOT IN (SELECT source FROM d)",
    "identity_mismatch": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN 'author' WHEN abs(c_nationkey - 10) > 1 THEN 'year' END AS problem FROM customer",
    "dead_links": f"WITH {_LINKS} SELECT source, target FROM links WHERE target NOT IN (SELECT note FROM notes)",
    "wiki_orphans": f"WITH {_LINKS} SELECT note FROM notes WHERE note NOT IN (SELECT target FROM links)",
    "staleness": "SELECT user_id, date_diff('day', CAST(max(ts) AS DATE), DATE '2025-01-01') AS age_days, date_diff('day', CAST(max(ts) AS DATE), DATE '2025-01-01') > 180 AS stale FROM events GROUP BY user_id",
    "calibration_check": "SELECT p_partkey, CASE WHEN p_size % 9 = 0 OR p_retailprice / 2000 > 1 THEN 'range' WHEN p_retailprice / 2000 > p_size / 50 THEN 'above' END AS problem FROM part",
    "citations_extract": "SELECT s_suppkey, 'key' || s_suppkey || 'x' AS author, CAST(2003 + s_suppkey % 5 AS VARCHAR) AS year, CASE WHEN s_suppkey % 5 = 0 THEN 'c1' END AS claim FROM supplier WHERE s_suppkey % 5 < 4",
    "citations_resolve": "SELECT 'key' || s_suppkey || 'x' AS author, CAST(2003 + s_suppkey % 5 AS VARCHAR) AS year, CASE s_suppkey % 5 WHEN 0 THEN 'Key' || s_suppkey || 'x_2003_notes.md' WHEN 1 THEN 'other' || s_suppkey || 'x_2011.md' END AS name FROM supplier WHERE s_suppkey % 5 < 4",
    "numeric_markers": r"SELECT doc_id, len(regexp_extract_all(t, '\[\d{1,3}(?:\s*[,–-]\s*\d{1,3})*\]')) + len(regexp_extract_all(t, '(?:[A-Za-z]{2}|[.,;:])[⁰¹²³⁴-⁹]+')) AS n_markers FROM (SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN ' seen [7, 9] before.⁵⁴ and x²' ELSE '' END AS t FROM documents)",
    "mermaid_lines": """SELECT 0 AS part, 'graph TD' AS line UNION ALL SELECT 1, '  n_nation_n' || n_nationkey || CASE WHEN n_nationkey % 7 = 0 THEN '(["nation:n' || n_nationkey || '"])' ELSE '["nation:n' || n_nationkey || '"]' END FROM nation
  UNION ALL SELECT 2, '  n_nation_n' || n_nationkey || CASE WHEN n_nationkey % 5 = 0 THEN ' -.->|rebuts|' ELSE ' -->|supports|' END || ' n_region_r' || n_regionkey FROM nation WHERE n_nationkey % 4 > 0""",
    "seal_check": """SELECT item_id, sha256('{"id": "r' || item_id || '", "subject": "' || sha256(text) || '"}') AS digest, item_id % 3 > 0 AS sealed FROM benchmark""",
    "units_bind": f"""WITH c AS (SELECT 'c' || conv_id AS key, conv_id AS i, turn, coalesce(text, '') AS text FROM conversations),
  e AS (SELECT key, i, turn, {_N.format('text')} AS n, {_N.format("CASE WHEN turn % 3 = 2 THEN '7 that no turn says 7' WHEN turn % 7 <> 3 THEN substr(text, 3, 30) END")} AS q FROM c WHERE i % 9 > 0)
  SELECT DISTINCT key, CAST(NULL AS VARCHAR) AS locus, 'no manifest' AS problem, TRUE AS hard FROM c WHERE i % 9 = 0
  UNION ALL SELECT DISTINCT key, NULL, 'other bytes', i % 4 <> 1 FROM e WHERE i % 6 = 5
  UNION ALL SELECT key, CASE WHEN turn % 5 = 4 THEN 't99' ELSE 't' || turn END, CASE WHEN turn % 5 = 4 THEN 'unknown locus' WHEN q IS NULL THEN 'no quote' ELSE 'outside' END, i % 4 <> 1
  FROM e WHERE turn % 5 = 4 OR q IS NULL OR NOT contains(n, q)""",
}
#: articulation's SQL over all edges.
ORACLES["articulation_all"] = ORACLES["articulation"]
#: Pages' blocks by their tags alone: what opens a block is marked, what closes one ends it, other tags part pieces by a space.
_BLOCK = "(h[1-6]|p|li|blockquote)"
ORACLES["units_html"] = rf"""WITH seen AS (SELECT page_id, regexp_replace(regexp_replace(html, '<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', '', 'gs'), '<!--.*?-->', '', 'gs') AS h FROM pages),
  marked AS (SELECT page_id, regexp_replace(regexp_replace(h, '<{_BLOCK}(\s[^>]*)?>', chr(1), 'g'), '</{_BLOCK}>|</?(ul|ol|div|article|nav|footer|table|form|aside|header|main|section)(\s[^>]*)?>', chr(2), 'g') AS h FROM seen),
  parts AS (SELECT page_id, unnest(string_split(h, chr(1))[2:]) AS part, generate_subscripts(string_split(h, chr(1))[2:], 1) AS nth FROM marked),
  pieces AS (SELECT page_id, nth, list_filter(list_transform(string_split(regexp_replace(split_part(part, chr(2), 1), '<[^>]*>', chr(3), 'g'), chr(3)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS p FROM parts),
  texts AS (SELECT page_id, nth, replace(replace(replace(replace(replace(array_to_string(p, ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&') AS text FROM pieces)
  SELECT page_id, 'p' || row_number() OVER (PARTITION BY page_id ORDER BY nth) AS locus, text FROM texts WHERE length({_N.format("text")}) >= 25"""
_PLAIN = "replace(replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', chr(39)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
ORACLES["page_texts"] = rf"""WITH seen AS (SELECT page_id, regexp_replace(regexp_replace(html, '<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', '<x>', 'gs'), '<!--.*?-->', '<x>', 'gs') AS h FROM pages),
  pieces AS (SELECT page_id, list_filter(list_transform(string_split(regexp_replace(h, '<[^>]*>', chr(3), 'g'), chr(3)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS p FROM seen),
  texts AS (SELECT page_id, {_PLAIN.format("array_to_string(p, ' ')")} AS t FROM pieces)
  SELECT page_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(regexp_replace(t, '\s+', '', 'g')) AS digest FROM texts"""
ORACLES |= projects.ORACLES | views.ORACLES | library.ORACLES | boards.ORACLES
ORACLES["gate_run_all"] = boards._gate_sql()
