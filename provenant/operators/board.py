"""What a project's board shows: counters in one pass, the graph around each claim, documents, and what of prose is checked at all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant.functions import text as X
from provenant.operators import assessment
from provenant.sources import markdown

# Counters in their order, paths that are gated where none are named, files that a project keeps as state, and fields of who classified pairs.
COUNTERS = ("ledgers", "stamped", "edges", "assessed_edges", "unassessed_edges", "records", "faithfulness_records", "faithfulness_passes", "disputed_records", "double_count_findings", "selection_gaps", "source_flow_gaps", "run_records", "signed", "questions")
GATED = ("content/concept_notes/", "content/literature_reviews/")
MACHINERY_FILES, MACHINERY_FOLDERS = ("log.md", "crosswalk.md", "source_register.md", "source_flow.md"), ("_ledger",)
AUTHORED = ("authored_by", "last_updated", "status")
PAIR, KIND = r"(?U)^##\s+(\S+)\s*↔\s*(\S+)\s*$", r"(?iU)^-\s*kind:\s*([\w-]+)\s*$"
#: Most neighbours in a row.
CHUNK = 1000


def counters(events: DataFrame) -> DataFrame:
    """project and a column for each of COUNTERS, with a row for all projects together, whose project is null.

    events: project, what (one of COUNTERS), a row for each thing that counts. All are counted in one pass, by grouping sets;
    each task sends one row a project.
    """
    each = events.rollup("project").agg(F.grouping("project").alias("__all"), *(F.count_if(F.col("what") == w).alias(w) for w in COUNTERS))
    return each.filter("__all = 1 or project is not null").drop("__all")


def events(files: DataFrame, records: DataFrame, covered: DataFrame, findings: DataFrame, of_key: DataFrame) -> DataFrame:
    """project, what of claim files (key, text), records (stem, record), edge_problems() and double_counts(); of_key: key, project.

    A record is its subject's project's, a disputed one that of the record which disputes it.
    """
    said = lambda df, key, what: df.select(F.col(key).alias("key") if isinstance(key, str) else key.alias("key"), F.lit(what).alias("what"))
    bodies = markdown.bodies(files)
    edges = markdown.edges(files)
    each = assessment.parse(records).filter("readable").withColumn("key", F.substring_index("subject", ":", 1))
    disputed = each.select("key", F.explode("disputes").alias("id")).groupBy("id").agg(F.min("key").alias("key"))
    told = [
        said(files, "key", "ledgers"), said(bodies.filter("frontmatter['body_sha256'] <> ''"), "key", "stamped"), said(edges, "from_key", "edges"),
        said(edges.filter(F.col("type").isin(*assessment.ASSESSED)), "from_key", "assessed_edges"), said(covered.filter("code is not null"), "from_key", "unassessed_edges"), said(each, "key", "records"),
        said(each.filter("kind = 'faithfulness'"), "key", "faithfulness_records"), said(each.filter("kind = 'faithfulness-pass'"), "key", "faithfulness_passes"), said(disputed, "key", "disputed_records"), said(findings, "a", "double_count_findings"),
    ]
    return reduce(DataFrame.unionByName, told).join(of_key, "key").select("project", "what")


def _front(name: str) -> Column:
    return F.coalesce(F.regexp_extract(F.col("frontmatter")[name], r'^\s*"?(.*?)"?\s*$', 1), F.lit(""))


def nodes(files: DataFrame, edges: DataFrame, records: DataFrame, findings: DataFrame) -> DataFrame:
    """A row for each claim that an edge or a record names: id, ledger, slug, quote, location, source, locator, qids, kinds, n_records, contested, double_count, resolved.

    What is joined is first made one row a key or claim, so no claim is multiplied. A claim of many records has their number
    and kinds; the records themselves are judgements().
    """
    every = assessment.situated(edges, records).withColumns({"key": F.substring_index("node", ":", 1), "slug": F.when(F.instr("node", ":") > 0, F.regexp_replace("node", "^[^:]*:", "")).otherwise("")})
    claims = assessment.claim_table(files)
    said = claims.groupBy(F.concat_ws(":", "key", "alias").alias("node")).agg(F.min_by(F.struct("quote", F.regexp_extract("body", r"(?im)^\s*\*\*Location:\*\*\s*(.+?)\s*$", 1).alias("location")), "ordinal").alias("c"))
    front = markdown.bodies(files).select("key", F.coalesce(F.nullif(_front("paper"), F.lit("")), _front("title")).alias("source"), F.coalesce(*(F.nullif(_front(n), F.lit("")) for n in ("doi", "pmcid", "url")), F.lit("")).alias("locator"), F.lit(True).alias("there"))
    asked = markdown.field(markdown.claims(files), "addresses", "crux-of").select("key", F.lower(F.regexp_extract("value", r"(?U)^([\w-]+)", 1)).alias("qid")).filter("qid <> ''").groupBy("key").agg(F.array_sort(F.collect_set("qid")).alias("qids"))
    each = assessment.parse(records).filter("readable")
    about = each.groupBy(F.col("subject").alias("node")).agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.count(F.lit(1)).alias("n_records"))
    fought = each.join(each.select(F.explode("disputes").alias("id")).distinct(), "id", "left_semi").select(F.col("subject").alias("node")).distinct().withColumn("contested", F.lit(True))
    twice = findings.select(F.explode(F.array("a", "b")).alias("key")).distinct().withColumn("double_count", F.lit(True))
    found = every.join(said, "node", "left").join(front, "key", "left").join(asked, "key", "left").join(about, "node", "left").join(fought, "node", "left").join(twice, "key", "left")
    none, flat, no = F.array().cast("array<string>"), lambda n: F.coalesce(n, F.lit("")), lambda n: F.coalesce(n, F.lit(False))
    quote = flat("c.quote")
    return found.select(F.col("node").alias("id"), F.col("key").alias("ledger"), "slug", quote.alias("quote"), flat("c.location").alias("location"), flat("source").alias("source"), flat("locator").alias("locator"), F.coalesce("qids", none).alias("qids"), F.coalesce("kinds", none).alias("kinds"), F.coalesce("n_records", F.lit(0)).alias("n_records"), no("contested").alias("contested"), no("double_count").alias("double_count"), (no("there") & (quote != "")).alias("resolved"))


def shown_edges(edges: DataFrame, claims: DataFrame, files: DataFrame, covered: DataFrame) -> DataFrame:
    """source, target, type, record, assessed, target_resolved of every edge with a source; kinds that aren't judged count as assessed.

    covered: edge_problems().
    """
    each = assessment.resolve(edges.filter("source is not null").withColumn("address", F.col("target")), claims, files)
    by = covered.select("from_key", "line", F.col("covering").alias("record"))
    judged = F.col("type").isin(*assessment.ASSESSED)
    return each.join(by, ["from_key", "line"], "left").select("source", "target", "type", "record", (~judged | F.col("record").isNotNull()).alias("assessed"), F.col("reason").isNull().alias("target_resolved"))


def awaiting(shown: DataFrame, claims: DataFrame) -> DataFrame:
    """source, target, type, subject_quote, grounding_quote, suggested_id of edges that still have to be judged."""
    quotes = claims.groupBy(F.concat_ws(":", "key", "alias").alias("node")).agg(F.min_by("quote", "ordinal").alias("quote"))
    open_ = shown.filter("not assessed")
    found = open_.join(quotes.select(F.col("node").alias("source"), F.col("quote").alias("g")), "source", "left").join(quotes.select(F.col("node").alias("target"), F.col("quote").alias("s")), "target", "left")
    name = F.concat_ws("-", F.substring_index(F.substring_index("source", ":", 1), "_", 1), "type", F.substring_index("target", ":", -1), F.lit("apt"))
    return found.select("source", "target", "type", F.coalesce("s", F.lit("")).alias("subject_quote"), F.coalesce("g", F.lit("")).alias("grounding_quote"), X.slug(name).alias("suggested_id"))


def adjacency(edges: DataFrame, most: int = CHUNK) -> DataFrame:
    """node, chunk, neighbours, n: what is one edge from a node, either way, at most about twice most neighbours a row.

    A node with more is dealt out by a hash of its neighbours, so a hub is in as many rows as it needs and in no single task.
    edges: source, target; repeated ones count once, and a node isn't its own neighbour.
    """
    both = F.explode(F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("next")), F.struct(F.col("target").alias("node"), F.col("source").alias("next"))))
    each = edges.filter("source <> target").select(both.alias("e")).select("e.*").distinct()
    sizes = each.groupBy("node").agg(F.count(F.lit(1)).alias("__n"))
    hubs = sizes.filter(F.col("__n") > most).select("node", F.ceil(F.col("__n") / most).alias("__parts"))
    dealt = each.join(hubs, "node", "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("next"), F.col("__parts")), F.lit(0)).cast("int"))
    return dealt.groupBy("node", "chunk").agg(F.array_sort(F.collect_list("next")).alias("neighbours"), F.count(F.lit(1)).alias("n"))


def documents(files: DataFrame, positions: DataFrame) -> DataFrame:
    """key, paper, year, version, position, claims, verdict, locator of every claim file. positions: key, position.

    claims are the headers of claims, those within fences too. The year is the first in the paper's name, else in the day it
    was retrieved; a file without a stamp is unstamped.
    """
    each = markdown.bodies(files).join(files.select("key", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\R"), lambda x: x.rlike(r"(?iU)^\s*##\s+claim\b"))).alias("claims")), "key")
    paper = F.coalesce(F.nullif(_front("paper"), F.lit("")), F.col("key"))
    year = lambda c: F.nullif(F.regexp_extract(c, r"\b((?:19|20)\d{2})\b", 1), F.lit(""))
    where = positions.groupBy(F.lower("key").alias("key")).agg(F.min("position").alias("position"))
    locator = F.coalesce(*(F.nullif(_front(n), F.lit("")) for n in ("doi", "pmcid", "url")), F.lit(""))
    return each.join(where, "key", "left").select("key", paper.alias("paper"), F.coalesce(year(paper), year(_front("retrieved")), F.lit("")).alias("year"), _front("source_version").alias("version"), F.coalesce("position", F.lit("")).alias("position"), "claims", F.coalesce(F.nullif(_front("verified_verdict"), F.lit("")), F.lit("unstamped")).alias("verdict"), locator.alias("locator"))


def lead(text: Column) -> Column:
    """The first paragraph of a text before its first section, in plain words; empty if a section comes first.

    Frontmatter, the title and rules are passed over; markers of records and of emphasis go.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    close = F.array_position(F.slice(lines, F.lit(2), F.size(lines)), "---").cast("int")
    body = F.when((F.get(lines, F.lit(0)) == "---") & (close > 0), F.slice(lines, close + 2, F.size(lines))).otherwise(lines)
    section = F.array_position(F.transform(body, lambda x: F.when(x.startswith("## "), 1).otherwise(0)), 1).cast("int")
    first = F.when(section > 0, F.slice(body, F.lit(1), section - 1)).otherwise(body)
    kept = F.array_join(F.filter(first, lambda x: ~(x.startswith("# ") | x.startswith("---"))), "\n")
    words = F.replace(F.regexp_extract(kept, r"(?s)\A\n*([^\n].*?)(?:\n\n|\n*\z)", 1), F.lit("\n"), F.lit(" "))
    return F.regexp_replace(F.regexp_replace(words, r"\s*\[rec:\s*[^\]]*\]", ""), r"\*\*|\*|`|\[\[|\]\]", "")


def annotations(claims: DataFrame) -> DataFrame:
    """key, ordinal, kind, target, span, note, record of the comments that claims carry (markdown.claims): rhetorical, status, correlated, crux."""
    kinds = {"assess-rhetorical": "rhetorical", "status": "status", "correlated-with": "correlated", "crux-of": "crux"}
    each = markdown.field(claims, *kinds)
    rest = F.col("value")
    record = F.lower(F.regexp_extract(rest, r"(?iU)\[rec:\s*([\w-]+)\]", 1))
    clean = lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"(?i)\(grounded by[^)]*\)", ""), r"(?iU)\[rec:\s*[\w-]+\]", ""), r"^[ \t—–-]+|[ \t—–-]+$", "")
    quoted = '["“”]([^"“”]+)["“”]'
    told = F.col("name").isin("correlated-with", "crux-of")
    note = F.when(F.col("name") == "assess-rhetorical", clean(F.regexp_replace(rest, "^([^\"“”]*)" + quoted, "$1"))).when(F.col("name") == "status", clean(rest)).otherwise(F.trim(F.regexp_extract(rest, r"(?i)\[(?!rec:)([^\]]+)\]", 1)))
    kind = reduce(lambda c, kv: c.when(F.col("name") == kv[0], kv[1]), kinds.items(), F.when(F.lit(False), ""))
    return each.select("key", "ordinal", kind.alias("kind"), F.when(told, F.regexp_extract(rest, r"^(\S+)", 1)).otherwise("").alias("target"), F.when(F.col("name") == "assess-rhetorical", F.regexp_extract(rest, quoted, 1)).otherwise("").alias("span"), note.alias("note"), record.alias("record"))


def pair_kinds(files: DataFrame) -> DataFrame:
    """path, line, a, b, kind of the entries of documents (path, text) that classify pairs: a heading of two keys, then a line of a kind."""
    each = files.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\R")).alias("at", "raw")).withColumn("raw", F.trim(F.regexp_replace("raw", r"^\s+|\s+$", "")))
    told = each.filter(F.col("raw").rlike(PAIR) | F.col("raw").rlike(KIND)).withColumn("pair", F.when(F.col("raw").rlike(PAIR), F.struct(F.lower(F.regexp_extract("raw", PAIR, 1)).alias("a"), F.lower(F.regexp_extract("raw", PAIR, 2)).alias("b"))))
    # A kind belongs to the heading right before it among these lines; a second kind has none.
    kinds = told.withColumn("pair", F.lag("pair").over(Window.partitionBy("path").orderBy("at"))).filter(F.col("raw").rlike(KIND) & F.col("pair").isNotNull())
    return kinds.select("path", (F.col("at") + 1).alias("line"), "pair.a", "pair.b", F.lower(F.regexp_extract("raw", KIND, 1)).alias("kind"))


def pair_kind_problems(files: DataFrame, declared: DataFrame) -> DataFrame:
    """path, code, detail of documents (path, text) that classify pairs, against pairs that claim files declare (path, lo, hi).

    no provenance (a field of its frontmatter is missing), unknown kind, duplicate (of unordered pairs, from the second on),
    orphan (no claim file declares the pair).
    """
    c = F.col
    front = markdown.bodies(files.select(c("path").alias("key"), "text"))
    lacks = front.select(c("key").alias("path"), F.explode(F.array_compact(F.array(*(F.when(F.trim(_front(n)) == "", n) for n in AUTHORED)))).alias("detail")).select("path", F.lit("no provenance").alias("code"), "detail")
    each = pair_kinds(files).withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b"), "detail": F.concat_ws(" ", "a", "b")})
    again = each.withColumn("n", F.row_number().over(Window.partitionBy("path", "lo", "hi").orderBy("line"))).filter("n > 1")
    odd = each.filter(~c("kind").isin(*assessment.CAUSES))
    lone = each.join(declared.select("path", "lo", "hi").distinct(), ["path", "lo", "hi"], "left_anti")
    told = lambda df, code: df.select("path", F.lit(code).alias("code"), "detail")
    return lacks.unionByName(told(odd.withColumn("detail", F.concat_ws(" ", "detail", "kind")), "unknown kind")).unionByName(told(again, "duplicate")).unionByName(told(lone, "orphan"))


def prefixes(value: Column) -> Column:
    """The paths that a setting gates: the usual ones where it is empty or a placeholder, nothing where it says none."""
    plain = F.trim(F.substring_index(F.coalesce(value, F.lit("")), "#", 1))
    usual = F.array(*map(F.lit, GATED))
    parts = F.filter(F.split(plain, r"[,\s]+"), lambda p: p != "")
    return F.when((plain == "") | plain.startswith("<"), usual).when(F.lower(plain) == "none", F.array().cast("array<string>")).otherwise(parts)


def machinery(path: Column) -> Column:
    """Whether a file is a project's bookkeeping and not prose."""
    name = F.substring_index(path, "/", -1)
    return name.isin(*MACHINERY_FILES) | F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, MACHINERY_FOLDERS)))


def prose(files: DataFrame, settings: DataFrame) -> DataFrame:
    """Adds gated to files (project, path): whether a prefix that the project gates stands anywhere in the path, and it is no claim file."""
    own = settings.filter("name = 'gated_paths'").groupBy("project").agg(F.max("value").alias("__v"))
    each = files.join(own, "project", "left")
    hit = F.exists(prefixes(F.col("__v")), lambda p: F.contains(F.col("path"), p)) & ~F.contains("path", F.lit("verified_claims/"))
    return each.withColumn("gated", hit).drop("__v")


def unscanned(files: DataFrame, settings: DataFrame) -> DataFrame:
    """project, n_prose, examples (five at most, by name) of configured projects that gate none of their prose without saying so.

    files: project, path of all notes. settings: project, name, value.
    """
    get = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    held = settings.groupBy("project").agg(get("project_state").alias("state"), get("gated_paths").alias("paths"))
    sure = held.filter((F.lower(F.trim(F.substring_index("state", "#", 1))) == "configured") & (F.size(prefixes(F.col("paths"))) > 0)).select("project")
    each = prose(files, settings).join(sure, "project", "left_semi")
    name = F.when(~machinery(F.col("path")), F.substring_index("path", "/", -1))
    found = each.groupBy("project").agg(F.count_if("gated").alias("n"), F.count(name).alias("n_prose"))
    bare = found.filter("n = 0 and n_prose > 0").select("project", "n_prose")
    first = each.withColumn("name", name).filter("name is not null").withColumn("k", F.row_number().over(Window.partitionBy("project").orderBy("name", "path"))).filter("k <= 5")
    return bare.join(first.groupBy("project").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("examples")), "project").select("project", "n_prose", "examples")


def numbering(files: DataFrame) -> DataFrame:
    """key, numbers of claim files (key, text) whose numbered claims don't run 1, 2, 3, ... in order; claims without a number are passed over."""
    headers = markdown.claims(files).select("key", "ordinal", F.regexp_extract("header", r"(?iU)^##\s+claim\s+(\d+)\b", 1).alias("n")).filter("n <> ''")
    each = headers.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.col("n").cast("long").alias("n")))), lambda x: x["n"]).alias("numbers"))
    return each.filter(F.col("numbers") != F.sequence(F.lit(1).cast("long"), F.size("numbers").cast("long")))


def superseded(edges: DataFrame) -> DataFrame:
    """Distinct target of edges that supersede."""
    return edges.filter("type = 'supersedes'").select("target").distinct()


def unsigned(runs: DataFrame, signatures: DataFrame, checked: DataFrame) -> DataFrame:
    """name, code of run records (name, record) without a signature that holds: no signature, unreadable, not verified.

    signatures: name of signature files, a record's with .sig behind it. checked: name, ok, what a signing tool said of each;
    a record that it doesn't name isn't verified.
    """
    there = signatures.select(F.regexp_replace("name", r"\.sig$", "").alias("name")).distinct().withColumn("there", F.lit(True))
    each = runs.join(there, "name", "left").join(checked.groupBy("name").agg(F.bool_or("ok").alias("ok")), "name", "left")
    readable = F.coalesce(F.get_json_object("record", "$").startswith("{"), F.lit(False))
    code = F.when(F.col("there").isNull(), "no signature").when(~readable, "unreadable").when(~F.coalesce("ok", F.lit(False)), "not verified")
    return each.select("name", code.alias("code")).filter("code is not null")
