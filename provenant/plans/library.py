"""Queries of a project's files and pages: rewriting of names, aliases, metadata, manifests, bundles and stores, with SQL for each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from provenant.operators import aliases, bundle, rewrite, store
from provenant.plans.projects import _cat, _on, _t
from provenant.sources import article_xml, bibliography, inventory
from provenant.sources.scratch import scratch_path, stored, written_files

C = F.col


def _names(s, d):
    """Names to replace: those of parts, their last words, and the first words of benchmark texts, alone and in pairs."""
    parts = _t(s, d, "part").select(F.explode(F.array("p_name", F.substring_index("p_name", " ", -1))).alias("name"))
    first = _t(s, d, "benchmark").select(F.explode(F.array(F.regexp_extract("text", r"^(\p{L}+)", 1), F.regexp_extract("text", r"^(\p{L}+ \p{L}+)", 1))).alias("name"))
    return parts.unionByName(first).filter("name <> ''").distinct()


def name_links(s, d):
    """Documents, each with names of parts behind its text, as HTML with a link for each name that stands by itself."""
    names = _names(s, d)
    parts = _t(s, d, "part").select(C("p_partkey").alias("at"), C("p_name").alias("a"), F.substring_index("p_name", " ", -1).alias("b"))
    n = parts.count()
    docs = _t(s, d, "documents").select("doc_id", "text").withColumn("at", F.pmod("doc_id", F.lit(n))).join(parts, "at")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" See "), "a", F.lit(" "), "a", F.lit(", ("), "b", F.lit(") not "), "a", F.lit("-x, "), "b", F.lit(":1 or <"), "b", F.lit(">."))
    made = rewrite.rewrite(docs.select(C("doc_id").alias("text_id"), rewrite.escaped(text).alias("text")), names.select("name", rewrite.jump(C("name"), C("name")).alias("replacement")))
    return made.select(C("text_id").alias("doc_id"), "n_replaced", F.sha2("text", 256).alias("digest"))


def record_references(s, d):
    """Documents with markers of records behind their texts, those of every second supplier known."""
    ids = _t(s, d, "supplier").filter("s_suppkey % 2 = 0").select(_cat("e", C("s_suppkey")).alias("id"))
    text = _cat(C("text"), " seen [rec: E", C("doc_id") % 9, "] and [rec:e", C("doc_id") % 5, "] or [rec: e", C("doc_id") % 9, "x]")
    made = rewrite.linked_records(_t(s, d, "documents").select(C("doc_id").alias("text_id"), text.alias("text")), ids, "../")
    return made.select(C("text_id").alias("doc_id"), F.sha2("text", 256).alias("digest"))


def _aliases(s, d):
    """project, alias, target of settings, one for each customer: a chain through every tenth, short chains, circles, faults."""
    c = _t(s, d, "customer").select(C("c_custkey").alias("i"))
    c = c.withColumn("top", F.lit(c.agg(F.max("i")).first()[0]))
    k, m = _cat("K", C("i")), C("i") % 10
    to = F.when((m == 0) & (C("i") + 10 <= C("top")), _cat("a", C("i") + 10)).when((m == 1) & (C("i") < C("top")), _cat("a", C("i") + 1)).when((m == 5) & (C("i") < C("top")), _cat("a", C("i") + 1)).when((m == 6) | (m == 7), _cat("A", C("i") - 1)).when(m == 8, _cat("gone", C("i"))).otherwise(k)
    setting = _cat(F.when(m == 3, k).otherwise(_cat("a", C("i"))), " -> ", to, F.when(m == 9, _cat(", A", C("i"), "->zz, broken, ->x")).otherwise(""))
    rows = c.select(F.explode(F.array(F.struct(F.lit("p").alias("project"), setting.alias("s")), F.struct(F.lit("q").alias("project"), F.when(m.isin(5, 6, 8), setting).otherwise("<none>").alias("s")))).alias("x")).select("x.*")
    return rows.select("project", F.explode(aliases.pairs(C("s"))).alias("a")).select("project", "a.alias", "a.target"), c


def alias_sanity(s, d):
    found, c = _aliases(s, d)
    return aliases.problems(found, c.select(F.lit("p").alias("project"), _cat("k", C("i")).alias("key")))


#: About how many articles a file holds; Spark reads an XML file in one task.
ARTICLES = 20_000


def _article_files(s, d):
    """A folder of XML files of about ARTICLES articles, one a line, of parts: two kinds of markup, with titles, names and dates that need care."""
    i = C("p_partkey")
    title = _cat("\n The <i>", C("p_name"), "</i> &amp; its ", C("p_type"), " ")
    pub = _cat(
        "<PubmedArticle><MedlineCitation><PMID>", i, "</PMID><Article><Journal><Title>", C("p_brand"), "</Title><JournalIssue>", _on(i % 4 != 1, "<PubDate><Year>", F.lit(1990) + i % 30, "</Year></PubDate>"), "</JournalIssue></Journal><ArticleTitle>", F.replace(title, F.lit("\n"), F.lit(" ")),
        "</ArticleTitle>", _on(i % 3 == 0, "<ELocationID EIdType=\"doi\">10.1371/P", i, "</ELocationID>"), "<AuthorList><Author><LastName>Ó'Neil-", C("p_size"), "</LastName><Initials>A</Initials></Author><Author><LastName>Second</LastName></Author></AuthorList></Article></MedlineCitation>",
        "<PubmedData><ArticleIdList><ArticleId IdType=\"pubmed\">", i, "</ArticleId><ArticleId IdType=\"doi\">10.9999/q", i, "</ArticleId></ArticleIdList></PubmedData></PubmedArticle>",
    )
    jats = _cat(
        "<article article-type=\"x\"><front><journal-meta><journal-title-group><journal-title>", C("p_brand"), "</journal-title></journal-title-group></journal-meta><article-meta><article-id pub-id-type=\"publisher-id\">", i, "</article-id>", _on(i % 5 == 1, "<article-id pub-id-type=\"doi\">doi:10.1016/J", i, "</article-id>"),
        "<title-group><article-title>", F.replace(title, F.lit("\n"), F.lit(" ")), "</article-title></title-group><contrib-group><contrib><collab>A group</collab></contrib><contrib><name><surname> Löwe", C("p_size"), " </surname></name></contrib></contrib-group><pub-date><day>1</day><year>in ", F.lit(2000) + i % 20, "</year></pub-date></article-meta></front><body><p>text</p></body></article>",
    )
    path, parts = scratch_path(s, "articles"), _t(s, d, "part")
    files = -(-parts.count() // ARTICLES)
    parts.repartition(max(1, files), "p_partkey").select(F.when(i % 2 == 0, pub).otherwise(jats).alias("value")).mapInArrow(_one_root, "value string").write.text(path)
    return path


def _one_root(batches):
    """An element around all the articles of a file."""
    import pyarrow as pa

    made = lambda lines: pa.RecordBatch.from_arrays([lines], names=["value"])
    yield made(pa.array(["<set>"]))
    for batch in batches:
        yield made(batch.column(0))
    yield made(pa.array(["</set>"]))


def xml_metadata(s, d):
    """Metadata of every part's article, out of files that are written first and read by Spark's XML source."""
    found = article_xml.read_articles(s, _article_files(s, d))
    own = F.coalesce("MedlineCitation.PMID", F.get("front.`article-meta`.`article-id`", F.lit(0)))
    return article_xml.metadata(found.withColumn("i", own.cast("long"))).drop("file")


def xml_column_metadata(s, d):
    """The same out of a column of XML texts."""
    rows = s.read.text(_article_files(s, d)).select(C("value").alias("xml")).filter(F.length("xml") > 10)
    found = article_xml.parsed(rows, "xml").drop("xml")
    own = F.coalesce("MedlineCitation.PMID", F.get("front.`article-meta`.`article-id`", F.lit(0)))
    return article_xml.metadata(found.withColumn("i", own.cast("long")))


def _tagged(s, d):
    """Pages with tags of each kind put into their heads, and decoys."""
    i = C("page_id")
    tag = lambda name, *value: _cat(f'<meta name="{name}" content="', *value, '">')
    head = (
        F.when(i % 8 == 0, _cat(tag("citation_author", "Óther-Név, Given"), tag("citation_author", "Second, A."), tag("citation_title", "  T", i, " &amp; more "), tag("citation_publication_date", "in May"), tag("citation_publication_date", F.lit(1990) + i % 30, "/05/03"), tag("citation_doi", "doi:10.1371/X", i, ".y"), tag("citation_journal_title", "J", i % 5)))
        .when(i % 8 == 1, _cat(tag("DC.Creator", "Given van Name", i), tag("DC.Title", "D", i), tag("DC.Date", F.lit(2000) + i % 20, "-01-01"), tag("DC.Identifier", "issn 12"), tag("DC.Identifier", "10.1016/Z", i)))
        .when(i % 8 == 2, _cat('<script type="application/ld+json">{"headline": "L', i, '", "author": [{"name": "Ada Löwe', i, '"}, {"name": "B"}], "datePublished": "2011-02-03", "isPartOf": {"name": "LJ"}, "identifier": {"value": "10.9999/L', i, '"}}</script>'))
        .when(i % 8 == 3, _cat("<!-- ", tag("citation_title", "decoy"), " --><script>var t = '", tag("citation_author", "Decoy"), "';</script>", tag("citation_author", " ")))
        .when(i % 8 == 4, _cat(tag("citation_date", "no year"), tag("DC.Date", "1999"), tag("citation_doi", "none"), tag("DC.Creator", "Single")))
        .otherwise("")
    )
    return _t(s, d, "pages").select("page_id", F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), head)).alias("html"))


def page_metadata(s, d):
    return bibliography.metadata(_tagged(s, d)).drop("html")


def author_surnames(s, d):
    """Surnames by form of name, of one author and of several, and years and DOIs in lines of text, by customer."""
    i = C("c_custkey")
    text = F.when(i % 6 == 0, _cat("Name", i, ", Given")).when(i % 6 == 1, _cat("Given  Middle Name", i)).when(i % 6 == 2, _cat("A Name", i, "; B Other, C.")).when(i % 6 == 3, _cat("A Name", i, " and B Other")).when(i % 6 == 4, " ").otherwise(_cat("Van Name", i, ", A.; B Other"))
    line = _cat("in 18", i % 90 + 10, " or ", F.lit(1950) + i % 100, ", see DOI:10.", F.lit(1000) + i, "/A(", i, ")b; 2001")
    return _t(s, d, "customer").select(i, bibliography.surname(text).alias("one"), bibliography.surname_of_list(text).alias("first"), bibliography.year(line).alias("year"), bibliography.doi(line).alias("doi"))


def _file_of(i, changed=None):
    body = _cat("<p>Text of ", i, "</p>")
    return body if changed is None else F.when(changed, _cat("<p>New text of ", i, "</p>")).otherwise(body)


def _files(s, d, rows, changed=None):
    """scan()ned files, one for each supplier in rows, that are written first, each in a folder of its name."""
    i = C("s_suppkey")
    path = written_files(rows.select(_cat("k", i, F.when(i % 3 == 0, ".html").when(i % 3 == 1, ".xml").otherwise(".txt")).alias("file"), _file_of(i, changed).alias("value")), "file", "value", "files")
    found = inventory.scan(s, path, "*", recursive=True).withColumn("path", F.regexp_extract("path", "file=([^/]*)/", 1))
    return found.withColumn("extension", F.regexp_extract("path", r"\.([^.]*)$", 1))


def file_manifest(s, d):
    """The nodes of the manifest over a file for each supplier."""
    return inventory.tree(stored(_files(s, d, _t(s, d, "supplier")).select("path", "sha256"), "manifest"))  # else each level reads the files anew


def _two_states(s, d):
    rows = _t(s, d, "supplier")
    return _files(s, d, rows.filter("s_suppkey % 7 <> 2")), _files(s, d, rows.filter("s_suppkey % 11 <> 4"), C("s_suppkey") % 13 == 5)


def manifest_changes(s, d):
    before, after = (stored(x.select("path", "sha256"), "manifest") for x in _two_states(s, d))
    lines = inventory.checksum_lines(before)
    told = inventory.checksum_problems(lines, after)
    return inventory.changes(before, after).select(F.lit("tree").alias("by"), "path", "code").unionByName(told.select(F.lit("checksums").alias("by"), "path", "code"))


def extract_staleness(s, d):
    """Texts and their sources' digests, taken from files and stored, against the files as they are later."""
    before, after = _two_states(s, d)
    made = stored(inventory.extracts(before), "extracts")
    told = inventory.stale(made, after.select("path", "sha256"))
    return made.join(told, "path", "left").select("path", "text", inventory.sidecar(F.concat("source_sha256", F.lit("  "), "path")).alias("source_sha256"), "code")


def _bundles(s, d):
    """bundle (host), path and html of pages, each with a link to the host's next page, put in several ways, and faults."""
    i = C("page_id")
    p = _t(s, d, "pages").select(i, F.regexp_extract("url", "://([^/]*)", 1).alias("bundle"), F.regexp_replace(F.regexp_extract("url", "://[^/]*/([^?#]*)", 1), "/$", "").alias("path"), "html")
    nexts = p.withColumn("to", F.lead("path").over(Window.partitionBy("bundle").orderBy("page_id"))).withColumn("first", F.min("page_id").over(Window.partitionBy("bundle")) == i)
    up = F.regexp_replace(F.regexp_replace("path", "[^/]*$", ""), "[^/]+/", "../")
    link = F.when(i % 5 == 0, _cat("/", C("to"))).when(i % 5 == 1, _cat(up, "./", C("to"), "?q=1#top")).when(i % 5 == 2, _cat(up, "x/.././", C("to"))).when(i % 5 == 3, _cat("/", C("to"), "#part")).otherwise(_cat("//elsewhere/", C("to")))
    more = _cat("<a href='", link, "' id=\"top\">next</a>", _on(i % 11 == 3, '<script src="https://cdn.example/x.js"></script>'), _on(i % 13 == 4, '<a href="../../../up.html">up</a>'), _on(i % 17 == 6, "<style>@import 'http://a.example/b.css';</style>"), '<a href="mailto:x@y">m</a><a href="#here">h</a>')
    return nexts.select("bundle", "path", F.concat("html", F.when(C("to").isNull(), "").otherwise(more)).alias("html"), "first")


def bundle_integrity(s, d):
    files = _bundles(s, d)
    return bundle.problems(files.drop("first"), files.filter("first").select("bundle", "path"))


def record_store(s, d):
    """What becomes of judgements of every supplier that are written, written again, and written over by one that has not seen the last text."""
    i = C("s_suppkey")
    sup = _t(s, d, "supplier")
    none = F.lit(None).cast("array<string>")
    asked = sup.select(_cat("r", i).alias("id"), F.lit("status").alias("kind"), _cat("K", i, ":c1").alias("subject"), none.alias("grounding"), F.lit(None).cast("string").alias("span"), none.alias("disputes"), none.alias("reviews"), F.lit("20240101").alias("assessed_date"))
    claims = sup.filter("s_suppkey % 3 <> 0").select(_cat("k", i).alias("key"), F.lit("c1").alias("alias"), _cat("body ", i).alias("body"))
    path = scratch_path(s, "store")
    store.create(store.judgements(asked.filter("substring(id, 2) % 4 <> 1"), claims, "a person", "tool"), path)
    first = store.judgements(asked, claims, "a person", "tool").withColumn("expected", F.lit(None).cast("string"))
    rounds = [store.apply(s, path, first), store.apply(s, path, first)]
    newer = claims.withColumn("body", F.when(F.substring("key", 2, 9).cast("int") % 5 == 2, F.concat(F.lit("new "), "body")).otherwise(C("body")))
    seen = stored(store.resealed(store.read(s, path), newer, "another"), "resealed")
    rounds.append(store.apply(s, path, seen))
    late = seen.withColumn("text", F.concat("text", F.lit(" ")))  # made from texts that have changed by now
    rounds.append(store.apply(s, path, late))
    told = [r.select(F.lit(k + 1).alias("round"), "id", "outcome") for k, r in enumerate(rounds)]
    now = store.read(s, path).select(F.lit(5).alias("round"), "id", F.get_json_object("text", "$.body_sha256").alias("outcome"))
    return told[0].unionByName(told[1]).unionByName(told[2]).unionByName(told[3]).unionByName(now)


def stamped_files(s, d):
    """Claim files with stamps put into their frontmatter."""
    i = C("s_suppkey")
    front = F.when(i % 4 == 0, "").when(i % 4 == 1, _cat("---\npaper: k", i, "\nverified_verdict: fail\n---\n")).when(i % 4 == 2, "---\npaper: open\n").otherwise("---\n---\n")
    text = _cat(front, "## Claim 1\n> \"words\"\nverified_verdict: not this one", F.when(i % 3 == 0, "\n").otherwise(""))
    made = store.upserted(text, {"verified_verdict": F.lit("pass"), "body_sha256": F.sha2(_cat(i), 256)})
    return _t(s, d, "supplier").select(i, made.alias("text"))


QUERIES = {f.__name__: f for f in (name_links, record_references, alias_sanity, xml_metadata, xml_column_metadata, page_metadata, author_surnames, file_manifest, manifest_changes, extract_staleness, bundle_integrity, record_store, stamped_files)}

_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_XML = """WITH p AS (SELECT p_partkey AS i, * FROM part)
SELECT i, 'The ' || p_name || ' & its ' || p_type AS meta_title, CASE WHEN i % 2 = 0 THEN 'oneil-' || p_size ELSE 'lowe' || p_size END AS meta_author,
  CASE WHEN i % 2 = 1 THEN CAST(2000 + i % 20 AS VARCHAR) WHEN i % 4 <> 1 THEN CAST(1990 + i % 30 AS VARCHAR) END AS meta_year,
  CASE WHEN i % 2 = 0 AND i % 3 = 0 THEN '10.1371/p' || i WHEN i % 2 = 0 THEN '10.9999/q' || i WHEN i % 5 = 1 THEN '10.1016/j' || i END AS meta_doi, p_brand AS meta_journal FROM p"""
_FILES = """f AS (SELECT s_suppkey AS i, 'k' || s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN '.html' WHEN 1 THEN '.xml' ELSE '.txt' END AS path, sha256('<p>Text of ' || s_suppkey || '</p>' || chr(10)) AS old,
    CASE WHEN s_suppkey % 13 = 5 THEN sha256('<p>New text of ' || s_suppkey || '</p>' || chr(10)) ELSE sha256('<p>Text of ' || s_suppkey || '</p>' || chr(10)) END AS new, s_suppkey % 7 <> 2 AS before, s_suppkey % 11 <> 4 AS after FROM supplier)"""
_LEVEL = "SELECT {0} AS level, left(prefix, {0}) AS prefix, sha256(string_agg(digest, '' ORDER BY prefix)) AS digest, sum(files) AS files FROM {1} GROUP BY ALL"

ORACLES = {
    "name_links": f"""
WITH names AS (SELECT DISTINCT name FROM (SELECT p_name AS name FROM part UNION ALL SELECT split_part(p_name, ' ', -1) FROM part
    UNION ALL SELECT regexp_extract(text, '^(\\p{{L}}+)', 1) FROM benchmark UNION ALL SELECT regexp_extract(text, '^(\\p{{L}}+ \\p{{L}}+)', 1) FROM benchmark) WHERE name <> ''),
  listed AS (SELECT list(name ORDER BY length(name) DESC, encode(name)) AS names FROM names),
  parts AS (SELECT p_partkey AS at, p_name AS a, split_part(p_name, ' ', -1) AS b FROM part),
  docs AS (SELECT doc_id, coalesce(text, '') || ' See ' || a || ' ' || a || ', (' || b || ') not ' || a || '-x, ' || b || ':1 or <' || b || '>.' AS t FROM documents JOIN parts ON parts.at = doc_id % (SELECT count(*) FROM part)),
  folded AS (SELECT doc_id, names, list_reduce(list_prepend({_ESC.format("t")}, names), lambda acc, name: CASE WHEN contains(acc, name) THEN
      regexp_replace(regexp_replace(acc, '(^|[^\\p{{L}}\\p{{N}}_:-])' || name || '($|[^\\p{{L}}\\p{{N}}_:-])', '\\1' || chr(57344 + list_position(names, name)) || '\\2', 'g'),
        '(^|[^\\p{{L}}\\p{{N}}_:-])' || name || '($|[^\\p{{L}}\\p{{N}}_:-])', '\\1' || chr(57344 + list_position(names, name)) || '\\2', 'g') ELSE acc END) AS t FROM docs, listed),
  shown AS (SELECT doc_id, len(regexp_extract_all(t, '[\\x{{E000}}-\\x{{F8FF}}]')) AS n, list_reduce(list_prepend(t, list_transform(names, lambda x: chr(57344 + list_position(names, x)) || x)),
      lambda acc, m: replace(acc, m[1:1], '<a class="jump" data-goto="' || m[2:] || '">' || m[2:] || '</a>')) AS t FROM folded)
SELECT doc_id, CAST(n AS BIGINT) AS n_replaced, sha256(t) AS digest FROM shown""",
    "record_references": """
WITH known AS (SELECT list('e' || s_suppkey) AS ids FROM supplier WHERE s_suppkey % 2 = 0),
  m AS (SELECT doc_id, coalesce(text, '') AS t, ids, 'E' || doc_id % 9 AS a, 'e' || doc_id % 5 AS b FROM documents, known)
SELECT doc_id, sha256(t || ' seen ' || CASE WHEN list_contains(ids, lower(a)) THEN '<a class="recref" href="../assessments.html#rec-' || a || '">' || a || '</a>' ELSE '[rec: ' || a || ']' END
  || ' and ' || CASE WHEN list_contains(ids, b) THEN '<a class="recref" href="../assessments.html#rec-' || b || '">' || b || '</a>' ELSE '[rec:' || b || ']' END || ' or [rec: ' || lower(a) || 'x]') AS digest FROM m""",
    "alias_sanity": """
WITH RECURSIVE c AS (SELECT c_custkey AS i, c_custkey % 10 AS m, max(c_custkey) OVER () AS top FROM customer),
  raw AS (SELECT i, m, CASE WHEN m = 3 THEN 'k' || i ELSE 'a' || i END AS alias, CASE WHEN m = 0 AND i + 10 <= top THEN 'a' || (i + 10) WHEN m IN (1, 5) AND i < top THEN 'a' || (i + 1) WHEN m IN (6, 7) THEN 'a' || (i - 1) WHEN m = 8 THEN 'gone' || i ELSE 'k' || i END AS target FROM c),
  one AS (SELECT 'p' AS project, * FROM raw UNION ALL SELECT 'q', * FROM raw WHERE m IN (5, 6, 8)),
  walk AS (SELECT project, alias, target AS here, 1 AS k FROM one UNION SELECT w.project, w.alias, o.target, w.k + 1 FROM walk w JOIN one o ON o.project = w.project AND o.alias = w.here WHERE w.here <> w.alias AND w.k <= (SELECT count(*) FROM one)),
  circles AS (SELECT DISTINCT project, alias FROM walk WHERE here = alias),
  finish AS (SELECT w.project, w.alias, w.here, w.k FROM walk w LEFT JOIN one o ON o.project = w.project AND o.alias = w.here WHERE o.alias IS NULL)
SELECT project, 'duplicate' AS code, alias, '2' AS detail FROM one WHERE m = 9
UNION ALL SELECT project, 'shadow', alias, NULL FROM one WHERE project = 'p' AND m = 3
UNION ALL SELECT project, 'missing', alias, target FROM one WHERE project = 'p' AND target NOT IN (SELECT 'k' || i FROM c)
UNION ALL SELECT project, 'loop', alias, target FROM one JOIN circles USING (project, alias)
UNION ALL SELECT project, 'chain', alias, here FROM finish WHERE k > 1
UNION ALL SELECT project, 'into loop', alias, NULL FROM one WHERE (project, alias) NOT IN (SELECT project, alias FROM circles) AND (project, alias) NOT IN (SELECT project, alias FROM finish)""",
    "xml_metadata": _XML,
    "xml_column_metadata": _XML,
    "page_metadata": """
WITH p AS (SELECT page_id AS i, replace(replace(trim(regexp_extract(html, '(?i)<title>([^<]*)</title>', 1)), '&quot;', '"'), '&amp;', '&') AS t FROM pages)
SELECT i AS page_id, CASE i % 8 WHEN 0 THEN 'T' || i || ' & more' WHEN 1 THEN 'D' || i WHEN 2 THEN CASE WHEN t = '' THEN 'L' || i ELSE t END ELSE nullif(t, '') END AS meta_title,
  CASE i % 8 WHEN 0 THEN 'other-nev' WHEN 1 THEN 'name' || i WHEN 2 THEN 'lowe' || i WHEN 4 THEN 'single' END AS meta_author, CASE i % 8 WHEN 0 THEN CAST(1990 + i % 30 AS VARCHAR) WHEN 1 THEN CAST(2000 + i % 20 AS VARCHAR) WHEN 2 THEN '2011' END AS meta_year,
  CASE i % 8 WHEN 0 THEN '10.1371/x' || i || '.y' WHEN 1 THEN '10.1016/z' || i WHEN 2 THEN '10.9999/l' || i END AS meta_doi, CASE i % 8 WHEN 0 THEN 'J' || i % 5 WHEN 2 THEN 'LJ' END AS meta_journal FROM p""",
    "author_surnames": """
WITH c AS (SELECT c_custkey AS i FROM customer)
SELECT i AS c_custkey, CASE i % 6 WHEN 4 THEN NULL WHEN 0 THEN 'Name' || i WHEN 2 THEN 'A Name' || i || '; B Other' WHEN 3 THEN 'Other' WHEN 5 THEN 'Van Name' || i ELSE 'Name' || i END AS one,
  CASE i % 6 WHEN 4 THEN NULL WHEN 2 THEN 'Other' ELSE 'Name' || i END AS first, CAST(1950 + i % 100 AS VARCHAR) AS year, '10.' || (1000 + i) || '/a(' || i || ')b;' AS doi FROM c""",
    "file_manifest": f"""
WITH {_FILES}, leaf AS (SELECT left(sha256(path), 4) AS prefix, sha256(path) AS place, sha256(path || chr(0) || old) AS digest FROM f),
  l4 AS (SELECT 4 AS level, prefix, sha256(string_agg(digest, '' ORDER BY place)) AS digest, count(*) AS files FROM leaf GROUP BY prefix),
  l3 AS ({_LEVEL.format(3, "l4")}), l2 AS ({_LEVEL.format(2, "l3")}), l1 AS ({_LEVEL.format(1, "l2")}), l0 AS ({_LEVEL.format(0, "l1")}),
  every AS (SELECT * FROM l4 UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l0)
SELECT level, prefix, digest, CAST(files AS BIGINT) AS files FROM every""",
    "manifest_changes": f"""
WITH {_FILES}, x AS (SELECT path, CASE WHEN before AND NOT after THEN 'removed' WHEN after AND NOT before THEN 'added' WHEN before AND after AND old <> new THEN 'changed' END AS code FROM f)
SELECT 'tree' AS "by", path, code FROM x WHERE code IS NOT NULL
UNION ALL SELECT 'checksums', path, CASE code WHEN 'removed' THEN 'absent' WHEN 'added' THEN 'unlisted' ELSE 'mismatch' END FROM x WHERE code IS NOT NULL""",
    "extract_staleness": f"""
WITH {_FILES} SELECT path, 'Text of ' || i AS text, old AS source_sha256, CASE WHEN NOT after THEN 'gone' WHEN old <> new THEN 'changed' END AS code FROM f WHERE before AND i % 3 <> 2""",
    "bundle_integrity": """
WITH RECURSIVE p AS (SELECT page_id AS i, regexp_extract(url, '://([^/]*)', 1) AS bundle, regexp_replace(regexp_extract(url, '://[^/]*/([^?#]*)', 1), '/$', '') AS path, html FROM pages),
  nexts AS (SELECT *, lead(path) OVER (PARTITION BY bundle ORDER BY i) AS nxt, i = min(i) OVER (PARTITION BY bundle) AS first FROM p),
  ups AS (SELECT *, repeat('../', len(string_split(path, '/')) - 1) AS up FROM nexts),
  planted AS (SELECT bundle, path, i, CASE i % 5 WHEN 0 THEN '/' || nxt WHEN 1 THEN up || './' || nxt || '?q=1#top' WHEN 2 THEN up || 'x/.././' || nxt WHEN 3 THEN '/' || nxt || '#part' END AS url, nxt AS leads, CASE i % 5 WHEN 1 THEN 'top' WHEN 3 THEN 'part' END AS fragment, false AS outside FROM ups WHERE nxt IS NOT NULL AND i % 5 <> 4
    UNION ALL SELECT bundle, path, i, '../../../up.html', NULL, NULL, true FROM ups WHERE nxt IS NOT NULL AND i % 13 = 4),
  own AS (SELECT DISTINCT bundle, path, url, url[2:] AS leads, NULL AS fragment, false AS outside FROM (SELECT bundle, path, unnest(regexp_extract_all(html, 'href="(/[^"/][^"]*)"', 1)) AS url FROM p)),
  links AS (SELECT DISTINCT bundle, path, url, leads, fragment, outside FROM planted UNION SELECT * FROM own),
  parts AS (SELECT bundle, string_split(path, '/') AS s FROM p), places AS (SELECT DISTINCT bundle, array_to_string(s[:k], '/') AS place FROM (SELECT bundle, s, unnest(range(0, len(s) + 1)) AS k FROM parts)),
  tops AS (SELECT DISTINCT bundle, path FROM nexts WHERE nxt IS NOT NULL), files AS (SELECT DISTINCT bundle, path FROM p),
  reach AS (SELECT DISTINCT bundle, path FROM nexts WHERE first UNION SELECT l.bundle, l.leads FROM reach r JOIN links l ON l.bundle = r.bundle AND l.path = r.path AND NOT l.outside)
SELECT bundle, path, 'dead' AS code, url AS detail FROM links WHERE NOT outside AND (bundle, leads) NOT IN (SELECT bundle, place FROM places)
UNION ALL SELECT bundle, path, 'outside', url FROM links WHERE outside
UNION ALL SELECT bundle, path, 'no anchor', url FROM links WHERE fragment = 'part' OR fragment = 'top' AND (bundle, leads) NOT IN (SELECT bundle, path FROM tops)
UNION ALL SELECT DISTINCT bundle, path, 'remote', NULL FROM nexts WHERE nxt IS NOT NULL AND (i % 11 = 3 OR i % 17 = 6)
UNION ALL SELECT bundle, path, 'unreachable', NULL FROM files WHERE (bundle, path) NOT IN (SELECT bundle, path FROM reach)""",
    "record_store": """
WITH s AS (SELECT s_suppkey AS i, 'r' || s_suppkey AS id FROM supplier), moved AS (SELECT * FROM s WHERE i % 3 <> 0 AND i % 5 = 2)
SELECT 1 AS round, id, CASE WHEN i % 4 = 1 THEN 'new' ELSE 'same' END AS outcome FROM s UNION ALL SELECT 2, id, 'same' FROM s UNION ALL SELECT 3, id, 'changed' FROM moved UNION ALL SELECT 4, id, 'stale' FROM moved
UNION ALL SELECT 5, id, CASE WHEN i % 3 = 0 THEN '' WHEN i % 5 = 2 THEN sha256('new body ' || i) ELSE sha256('body ' || i) END FROM s""",
    "stamped_files": """
WITH s AS (SELECT s_suppkey AS i, 'verified_verdict: "pass"' || chr(10) AS v, 'body_sha256: "' || sha256(CAST(s_suppkey AS VARCHAR)) || '"' || chr(10) AS b, '---' || chr(10) AS d,
  '## Claim 1' || chr(10) || '> "words"' || chr(10) || 'verified_verdict: not this one' || chr(10) AS body FROM supplier)
SELECT i AS s_suppkey, d || CASE i % 4 WHEN 1 THEN 'paper: k' || i || chr(10) || v || b ELSE v || b END || d || CASE WHEN i % 4 = 2 THEN d || 'paper: open' || chr(10) ELSE '' END || body AS text FROM s""",
}
