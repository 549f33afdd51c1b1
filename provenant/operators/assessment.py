"""Judgement records against the claims they are about: validity, identity, links between records, coverage of edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant.functions import text as X
from provenant.functions.schema import KINDS, schema_errors
from provenant.operators.records import sealed
from provenant.sources import markdown

# Edges whose inference is worth a judgement, and kinds of declared dependence.
ASSESSED = ("supports", "rebuts")
CAUSES = ("exact-cohort-reuse", "overlapping-pools", "shared-evidence", "other-declared-dependence")


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def claim_table(files: DataFrame) -> DataFrame:
    """key, alias, ordinal, body, quote of every name that a claim of files (key, text) has. quote joins its quotes by spaces."""
    parsed = markdown.claims(files)
    said = F.filter(F.transform("quotes", X.quote_text), lambda q: q.isNotNull())
    return markdown.aliases(parsed).join(parsed.select("key", "ordinal", F.col("text").alias("body"), F.array_join(said, " ").alias("quote")), ["key", "ordinal"])


def resolve(addresses: DataFrame, claims: DataFrame, files: DataFrame) -> DataFrame:
    """Adds reason to addresses (address: key:slug, both in lower case): null if a claim has it, else no key, no file or no claim."""
    have = files.select(F.col("key").alias("__file")).distinct()
    names = claims.select(F.concat_ws(":", "key", "alias").alias("__name")).distinct()
    key = F.when(F.instr("address", ":") > 1, F.substring_index("address", ":", 1))
    found = addresses.withColumn("__key", key).join(have, F.col("__key") == F.col("__file"), "left").join(names, F.col("address") == F.col("__name"), "left")
    reason = F.when(F.col("__key").isNull(), "no key").when(F.col("__file").isNull(), "no file").when(F.col("__name").isNull(), "no claim")
    return found.withColumn("reason", reason).drop("__key", "__file", "__name")


def parse(records: DataFrame) -> DataFrame:
    """records: stem, record (JSON). Adds id (of the stem if it has none), kind, subject, grounding, span, disputes, reviews, body_sha256, readable.

    Addresses and ids are in lower case; a bare grounding has the subject's key.
    """
    shape = "id string, kind string, subject string, grounding array<string>, span string, disputes array<string>, reviews array<string>, body_sha256 string"
    each = records.withColumn("r", F.from_json("record", shape))
    readable = F.coalesce(F.get_json_object("record", "$").startswith("{"), F.lit(False))
    key = F.when(F.instr("subject", ":") > 0, F.substring_index("subject", ":", 1))
    low = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)
    each = each.select("stem", "record", readable.alias("readable"), F.lower(F.coalesce("r.id", "stem")).alias("id"), "r.kind", F.lower("r.subject").alias("subject"), low(F.col("r.grounding")).alias("grounding"), "r.span", low(F.col("r.disputes")).alias("disputes"), low(F.col("r.reviews")).alias("reviews"), "r.body_sha256")
    return each.withColumn("grounding", F.transform("grounding", lambda g: F.when((F.instr(g, ":") > 0) | key.isNull(), g).otherwise(F.concat(key, F.lit(":"), g))))


def record_problems(records: DataFrame, files: DataFrame) -> DataFrame:
    """id, code, detail of what is wrong with records (stem, record) by themselves, by their names and by the claims of files.

    Codes: unreadable, schema, kind, seal, subject, grounding, stale, span, disputes, reviews, duplicate, filename.
    """
    each, claims = parse(records), claim_table(files)
    none = F.lit(None).cast("string")
    ok = each.filter("readable")
    told = lambda df, code, detail=none: df.select("id", F.lit(code).alias("code"), detail.alias("detail"))
    shape = ok.select("id", F.explode(schema_errors(F.col("record"))).alias("e"))
    subject = resolve(ok.withColumn("address", F.col("subject")), claims, files)
    ground = resolve(ok.select("id", F.explode("grounding").alias("address")), claims, files)
    names = claims.select(F.concat_ws(":", "key", "alias").alias("address"), F.sha2("body", 256).alias("now"), "quote")
    bound = ok.select("id", F.col("subject").alias("address"), "body_sha256").join(names, "address").filter(~F.col("body_sha256").eqNullSafe(F.col("now")))
    first = F.coalesce(F.get("grounding", F.lit(0)), "subject")
    pinned = ok.filter("kind in ('rhetorical', 'faithfulness') and span <> ''").select("id", "span", first.alias("address")).join(names, "address", "left")
    loose = pinned.filter(~F.contains(_squeezed(F.coalesce("quote", F.lit(""))), _squeezed(F.col("span"))))
    twice = ok.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return _all([
        told(each.filter("not readable"), "unreadable"), told(shape, "schema", F.col("e")), told(ok.filter(F.col("kind").isNotNull() & ~F.col("kind").isin(*KINDS)), "kind", F.col("kind")),
        told(ok.filter(~sealed(F.col("record"))), "seal"), told(subject.filter("reason is not null"), "subject", F.col("reason")), told(ground.filter("reason is not null"), "grounding", F.concat_ws(": ", "address", "reason")),
        told(bound, "stale"), told(loose, "span", F.col("address")), told(ok.filter("kind = 'faithfulness' and size(disputes) = 0"), "disputes"), told(ok.filter("kind = 'faithfulness-pass' and size(reviews) = 0"), "reviews"),
        told(twice, "duplicate"), told(ok.filter(F.lower(F.regexp_replace("stem", r"\.assess$", "")) != F.col("id")), "filename", F.col("stem")),
    ])


def valid(records: DataFrame, problems: DataFrame) -> DataFrame:
    """parse()d records without a problem."""
    return parse(records).filter("readable").join(problems.select("id"), "id", "left_anti")


def link_problems(records: DataFrame) -> DataFrame:
    """id, link (disputes or reviews), other, code: links to no record, from another subject, or reviews of what is no edge record."""
    each = parse(records).filter("readable")
    links = each.select("id", "subject", F.explode(F.concat(F.transform("disputes", lambda x: F.struct(F.lit("disputes").alias("link"), x.alias("other"))), F.transform("reviews", lambda x: F.struct(F.lit("reviews").alias("link"), x.alias("other"))))).alias("l")).select("id", "subject", "l.*")
    others = each.groupBy("id").agg(F.max_by(F.struct("kind", "subject"), "stem").alias("o")).select(F.col("id").alias("other"), F.lit(True).alias("there"), F.col("o.kind").alias("kind"), F.col("o.subject").alias("about"))
    code = F.when(F.col("there").isNull(), "no record").when((F.col("link") == "reviews") & ~F.col("kind").eqNullSafe(F.lit("edge")), "no edge record").when(~F.col("about").eqNullSafe(F.col("subject")), "other subject")
    return links.join(others, "other", "left").select("id", "link", "other", code.alias("code")).filter("code is not null")


def coverage_of(records: DataFrame) -> DataFrame:
    """target, grounding, id: edges that parse()d or valid() records of kind edge cover."""
    return records.filter("kind = 'edge' and size(grounding) > 0").select(F.col("subject").alias("target"), F.col("grounding")[0].alias("grounding"), "id")


def edge_problems(edges: DataFrame, ids: DataFrame, covered: DataFrame) -> DataFrame:
    """from_key, line, covering, code of edges that should be judged: code is null where a record covers the edge.

    edges: those of markdown.edges. ids: id of every record. covered: coverage_of valid records. An edge that names a record
    is covered by that one alone. Codes: no record, unknown record, not its record.
    """
    asked = edges.filter(F.col("type").isin(*ASSESSED)).withColumn("source", F.coalesce("source", F.concat("from_key", F.lit(":?"))))
    sets = covered.select("target", F.col("grounding").alias("source"), "id").groupBy("target", "source").agg(F.collect_set("id").alias("ids"))
    known = ids.select(F.col("id").alias("rec")).distinct().withColumn("known", F.lit(True))
    found = asked.join(sets, ["target", "source"], "left").join(known, "rec", "left")
    by = F.when(F.col("rec").isNotNull(), F.when(F.array_contains("ids", F.col("rec")), F.col("rec"))).otherwise(F.array_min("ids"))
    code = F.when(F.col("rec").isNull(), "no record").when(F.col("known").isNull(), "unknown record").otherwise("not its record")
    return found.withColumn("covering", by).select("from_key", "line", "covering", F.when(F.col("covering").isNull(), code).alias("code"))


def worklist(edges: DataFrame, records: DataFrame, covered: DataFrame) -> DataFrame:
    """from_key, line, status of edges that should be judged: no record, disputed, passed or unreviewed; a dispute counts before a pass."""
    each = parse(records).filter("readable")
    by = edge_problems(edges, each, covered)
    of = lambda kind, link: each.filter(F.col("kind") == kind).select(F.explode(link).alias("covering")).distinct().withColumn(link, F.lit(True))
    found = by.join(of("faithfulness", "disputes"), "covering", "left").join(of("faithfulness-pass", "reviews"), "covering", "left")
    return found.select("from_key", "line", F.when(F.col("covering").isNull(), "no record").when(F.col("disputes"), "disputed").when(F.col("reviews"), "passed").otherwise("unreviewed").alias("status"))


def marker_problems(files: DataFrame, ids: DataFrame) -> DataFrame:
    """key, code, detail: records named in claim files that aren't there, and a performed settling without an open crux."""
    each = markdown.lines(files).filter(F.contains("text", F.lit("[rec:")) | F.ltrim("text").startswith("**")).withColumn("text", F.trim("text"))
    named = each.select("key", F.explode(F.regexp_extract_all("text", F.lit(r"(?U)\[rec:\s*([\w-]+)\]"), F.lit(1))).alias("detail"))
    lost = named.withColumn("id", F.lower("detail")).join(ids.select("id").distinct(), "id", "left_anti").select("key", F.lit("no record").alias("code"), "detail")
    flags = each.groupBy("key").agg(F.bool_or(F.col("text").rlike(r"(?i)^\*\*Status:\*\*\s*performed-settling")).alias("done"), F.bool_or(F.col("text").rlike(r"(?i)^\*\*Crux-of:\*\*")).alias("crux"))
    return lost.unionByName(flags.filter("done and not crux").select("key", F.lit("no crux").alias("code"), F.lit(None).cast("string").alias("detail")))


def prose_references(prose: DataFrame, records: DataFrame, good: DataFrame) -> DataFrame:
    """path, line, ref, outcome of every record marker in prose (path, text), also one that lines part: valid, invalid, absent or malformed.

    records: id of every record; good: id of the valid ones.
    """
    # Pieces are numbered and their line feeds summed up in one window, which has a row for each marker of a text.
    rows = prose.filter(F.contains("text", F.lit("[rec:"))).select("path", "text", F.monotonically_increasing_id().alias("__row"))
    pieces = rows.select("path", "__row", F.posexplode(F.split("text", r"\[rec:")).alias("at", "tail"))
    before = F.sum(F.length("tail") - F.length(F.replace("tail", F.lit("\n"), F.lit("")))).over(Window.partitionBy("path", "__row").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    each = pieces.withColumn("line", (before + 1).cast("int")).filter("at > 0")
    each = each.filter(F.contains("tail", F.lit("]"))).select("path", "line", F.trim(F.regexp_replace(F.substring_index("tail", "]", 1), r"^\s+|\s+$", "")).alias("ref"))
    ids = records.select(F.col("id").alias("__id")).distinct().withColumn("there", F.lit(True))
    fine = good.select(F.col("id").alias("__good")).distinct()
    found = each.join(ids, F.lower("ref") == F.col("__id"), "left").join(fine, F.lower("ref") == F.col("__good"), "left")
    outcome = F.when(~F.col("ref").rlike(r"(?U)^[\w-]+$"), "malformed").when(F.col("__good").isNotNull(), "valid").when(F.col("there"), "invalid").otherwise("absent")
    return found.select("path", "line", "ref", outcome.alias("outcome"))


def situated(edges: DataFrame, records: DataFrame) -> DataFrame:
    """Distinct node: ends of edges and subjects and groundings of records."""
    each = parse(records).filter("readable")
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"))
    return ends.unionByName(each.select(F.explode(F.concat(F.array("subject"), "grounding")).alias("node"))).filter("node <> ''").distinct()


def unsituated(cited: DataFrame, claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct key, claim of cited (key, claim) that are claims without a role: no name of theirs is a node and no block of theirs addresses a question.

    claims: claim_table. What is no claim at all is left out.
    """
    asked = cited.select("key", F.lower("claim").alias("claim")).distinct()
    own = asked.join(claims.select("key", F.col("alias").alias("claim"), "ordinal", "body"), ["key", "claim"])
    names = own.join(claims.select("key", "ordinal", "alias"), ["key", "ordinal"])
    placed = names.join(nodes, F.concat_ws(":", "key", "alias") == F.col("node"), "left_semi").select("key", "claim").distinct()
    return own.filter(~F.contains("body", F.lit("**Addresses:**"))).select("key", "claim").distinct().join(placed, ["key", "claim"], "left_anti")


def correlations(files: DataFrame) -> DataFrame:
    """lo, hi, kind, basis of pairs of keys that claim files declare correlated; of several lines the last in the order of key and line."""
    each = markdown.lines(files).withColumn("text", F.trim("text")).select("key", "line", "text", F.lower(F.nullif(F.regexp_extract("text", r"(?iU)^\*\*Correlated-with:\*\*\s*([\w-]+(?::[\w-]+)?)", 1), F.lit(""))).alias("other")).filter("other is not null")
    other = F.when(F.instr("other", ":") > 0, F.substring_index("other", ":", 1)).otherwise(F.col("key"))
    inner = F.trim(F.regexp_extract("text", r"\[([^\]]*)\]", 1))
    typed = r"(?isU)^\s*kind:\s*([\w-]+)\s*[;—-]?\s*(.*)$"
    kind = F.lower(F.regexp_extract(inner, typed, 1))
    made = each.select(F.least("key", other).alias("lo"), F.greatest("key", other).alias("hi"), F.when(kind.isin(*CAUSES), kind).otherwise(CAUSES[-1]).alias("kind"), F.when(kind.isin(*CAUSES), F.trim(F.regexp_extract(inner, typed, 2))).otherwise(inner).alias("basis"), "key", "line")
    return made.groupBy("lo", "hi").agg(F.max_by(F.struct("kind", "basis"), F.struct("key", "line")).alias("c")).select("lo", "hi", "c.*")


def sealed_pairs(records: DataFrame) -> DataFrame:
    """lo, hi, id: pairs of keys that a correlated-with record grounds; the last by file name."""
    keys = F.array_sort(F.array_distinct(F.transform(F.filter("grounding", lambda g: F.instr(g, ":") > 1), lambda g: F.substring_index(g, ":", 1))))
    each = parse(records).filter("readable and kind = 'correlated-with'").withColumn("keys", keys).filter("size(keys) = 2")
    return each.groupBy(F.col("keys")[0].alias("lo"), F.col("keys")[1].alias("hi")).agg(F.max_by("id", "stem").alias("id"))


def double_counts(files: DataFrame, records: DataFrame, kinds: DataFrame) -> DataFrame:
    """target, a, b, kind, basis, sealed: two files that support one claim and are declared correlated. kinds: lo, hi, kind, authored apart."""
    supports = markdown.edges(files).filter("type = 'supports'").select("target", "from_key").distinct()
    named = kinds.filter(F.col("kind").isin(*CAUSES)).groupBy("lo", "hi").agg(F.max("kind").alias("authored"))
    causes = correlations(files).join(named, ["lo", "hi"], "left").join(sealed_pairs(records).withColumnRenamed("id", "sealed"), ["lo", "hi"], "left")
    causes = causes.select(F.col("lo").alias("a"), F.col("hi").alias("b"), F.coalesce("authored", "kind").alias("kind"), "basis", "sealed")
    # From the declared pairs, so supporters of one claim are never paired among themselves.
    one = causes.filter("a < b").join(supports.withColumnRenamed("from_key", "a"), "a")
    return one.join(supports.withColumnRenamed("from_key", "b"), ["b", "target"]).select("target", "a", "b", "kind", "basis", "sealed")


def structure_problems(files: DataFrame, questions: DataFrame) -> DataFrame:
    """key, code, detail of a project's graph: targets and groundings that no claim is, edges without a grounding, pairs both
    supported and rebutted, and fields that name no question (questions: qid)."""
    edges, claims = markdown.edges(files), claim_table(files)
    target = resolve(edges.withColumn("address", F.col("target")), claims, files).filter("reason is not null")
    ground = resolve(edges.filter("source is not null").withColumn("address", F.col("source")), claims, files).filter("reason is not null")
    both = edges.groupBy(F.coalesce("source", "from_key").alias("source"), "target").agg(F.bool_or(F.col("type") == "supports").alias("s"), F.bool_or(F.col("type") == "rebuts").alias("r"), F.min("from_key").alias("key")).filter("s and r")
    refs = markdown.field(markdown.claims(files), "addresses", "crux-of").withColumn("qid", F.lower(F.regexp_extract("value", r"(?U)^([\w-]+)", 1)))
    lost = refs.filter("qid <> ''").join(questions.select(F.lower("qid").alias("qid")).distinct(), "qid", "left_anti")
    told = lambda df, code, detail, key="key": df.select(F.col(key).alias("key"), F.lit(code).alias("code"), detail.alias("detail"))
    return _all([told(target, "target", F.concat_ws(": ", "address", "reason"), "from_key"), told(ground, "grounding", F.concat_ws(": ", "address", "reason"), "from_key"), told(edges.filter("grounding is null"), "no grounding", F.col("target"), "from_key"), told(both, "contradiction", F.concat_ws(" > ", "source", "target")), told(lost, "question", F.concat_ws(" ", "name", "qid"))])
