"""What a project shows of itself: why a claim is open to question, judgements, targets of edges, sources and their inventory.

Traces are rows, one for a subject and one for each edge at it, so that a claim with very many supporters is in no single row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions import text as X
from provenant.operators import assessment, register
from provenant.sources import markdown

# Reasons in their order, labels of records, sources by preference for extracts and for units, texts of the inventory.
REASONS = ("derived warning", "recorded judgement", "authored reference")
LABELS = {"faithfulness": "disputed", "faithfulness-pass": "reviewed — held"}
OTHER_LABEL = "sealed record"
FOR_EXTRACTS, FOR_UNITS = ("pdf", "html"), ("html", "pdf")
NOT_ON_DISK = "source bytes not on disk (git-ignored)"


def trace(warnings: DataFrame, good: DataFrame, cited: DataFrame) -> DataFrame:
    """subject, reasons, n_warnings, n_cited of every claim that a warning, a valid record or a reference puts in question.

    warnings: double_counts(). good: valid() records. cited: ref of references that hold. reasons are in the order of REASONS.
    Subjects that are null or empty have no trace.
    """
    about = cited.select(F.lower("ref").alias("id")).join(good.select("id", "subject"), "id")
    told = [(warnings.select(F.lower("target").alias("subject")), 1, 0, 0), (good.select("subject"), 0, 1, 0), (about.select("subject"), 0, 0, 1)]
    each = reduce(DataFrame.unionByName, [df.select(F.trim("subject").alias("subject"), *(F.lit(x).alias(n) for x, n in zip(by, ("w", "j", "c"), strict=True))) for df, *by in told])
    found = each.filter("subject <> ''").groupBy("subject").agg(*(F.sum(n).alias(n) for n in ("w", "j", "c")))
    reasons = F.array_compact(F.array(*(F.when(F.col(n) > 0, r) for n, r in zip(("w", "j", "c"), REASONS, strict=True))))
    return found.select("subject", reasons.alias("reasons"), F.col("w").alias("n_warnings"), F.col("c").alias("n_cited"))


def trace_edges(subjects: DataFrame, files: DataFrame, records: DataFrame, good: DataFrame) -> DataFrame:
    """subject, source, type, line, quote, paper, record, n_contests, n_upholds of every edge with a source at one of subjects (subject).

    quote is of the source's claim, empty if no claim is there; paper is the file's field paper, else title, else empty.
    record covers the edge; the counts are of valid records that dispute or review it.
    """
    edges = markdown.edges(files).filter("source is not null").withColumn("target", F.lower("target"))
    at = edges.join(subjects.select(F.col("subject").alias("target")).distinct(), "target", "left_semi")
    by = assessment.edge_problems(edges, assessment.parse(records).filter("readable"), assessment.coverage_of(good)).select("from_key", "line", F.col("covering").alias("record"))
    links = good.select(F.explode(F.concat(F.transform("disputes", lambda x: F.struct(x.alias("record"), F.lit(1).alias("c"))), F.transform("reviews", lambda x: F.struct(x.alias("record"), F.lit(0).alias("c"))))).alias("l")).select("l.*")
    links = links.groupBy("record").agg(F.sum("c").alias("contests"), F.sum(1 - F.col("c")).alias("upholds"))
    claims = assessment.claim_table(files).groupBy(F.concat_ws(":", "key", "alias").alias("source")).agg(F.min_by("quote", "ordinal").alias("quote"))
    papers = markdown.bodies(files).select(F.col("key").alias("from_key"), F.coalesce(_of("paper"), _of("title"), F.lit("")).alias("paper"))
    found = at.join(by, ["from_key", "line"], "left").join(links, "record", "left").join(claims, "source", "left").join(papers, "from_key", "left")
    none = lambda name, value: F.coalesce(name, F.lit(value))
    return found.select(F.col("target").alias("subject"), "source", "type", "line", none("quote", "").alias("quote"), none("paper", "").alias("paper"), "record", none("contests", 0).alias("n_contests"), none("upholds", 0).alias("n_upholds"))


def contested(records: DataFrame) -> DataFrame:
    """Distinct subject of records that another record disputes, valid or not."""
    each = assessment.parse(records).filter("readable")
    ids = each.select(F.explode("disputes").alias("id")).distinct()
    return each.join(ids, "id", "left_semi").filter("subject <> ''").select("subject").distinct()


def judgements(records: DataFrame, good: DataFrame, warnings: DataFrame) -> DataFrame:
    """id, kind, date, subject, integrity, label, anchor, relevant of every readable record; of equal ids the last by stem.

    integrity says if the record is valid, label which part it plays. A record is relevant if its subject or a grounding is of
    a file that a warning names.
    """
    shown = assessment.parse(records).filter("readable").withColumn("date", F.get_json_object("record", "$.assessed_date"))
    last = shown.groupBy("id").agg(F.max_by(F.struct("kind", "date", "subject", "grounding"), "stem").alias("r")).select("id", "r.*")
    key = lambda c: F.substring_index(c, ":", 1)
    named = warnings.select(F.explode(F.array("a", "b", key("target"))).alias("key")).distinct()
    near = last.select("id", F.explode(F.array_union(F.array("subject"), "grounding")).alias("address")).withColumn("key", key("address")).join(named, "key", "left_semi").select("id").distinct().withColumn("near", F.lit(True))
    sound = good.select("id").distinct().withColumn("sound", F.lit(True))
    label = reduce(lambda c, kv: c.when(F.col("kind") == kv[0], kv[1]), LABELS.items(), F.when(F.lit(False), "")).otherwise(OTHER_LABEL)
    found = last.join(sound, "id", "left").join(near, "id", "left")
    return found.select("id", "kind", "date", "subject", F.when(F.col("sound"), "verified").otherwise("unverified").alias("integrity"), label.alias("label"), X.slug(F.col("subject")).alias("anchor"), F.coalesce("near", F.lit(False)).alias("relevant"))


def targets(edges: DataFrame) -> DataFrame:
    """claim, incoming: edges of every type at each claim, most first."""
    return edges.groupBy(F.col("target").alias("claim")).agg(F.count(F.lit(1)).alias("incoming")).orderBy(F.desc("incoming"), "claim")


def aptness(covered: DataFrame) -> DataFrame:
    """reviewed, total of the edges that should be judged; covered: edge_problems()."""
    return covered.agg(F.count("covering").alias("reviewed"), F.count(F.lit(1)).alias("total"))


def choose_sources(present: DataFrame, cited: DataFrame, order: tuple[str, ...] = FOR_EXTRACTS) -> DataFrame:
    """key, extension, fallback of the file to read for each key of present (key, extension).

    The one that cited (key, extension) names, if it is there, else the first of order; keys with neither are left out.
    fallback tells that a file was named which isn't there.
    """
    named = cited.groupBy("key").agg(F.min("extension").alias("__named"))
    rank = F.when(F.col("extension") == F.col("__named"), 0)
    for i, extension in enumerate(order, 1):
        rank = rank.when(F.col("extension") == extension, i)
    each = present.join(named, "key", "left").withColumn("__rank", rank).filter("__rank is not null")
    best = each.groupBy("key").agg(F.min_by(F.struct("extension", F.col("__rank").alias("rank"), F.col("__named").alias("named")), "__rank").alias("b"))
    return best.select("key", "b.extension", (F.col("b.named").isNotNull() & (F.col("b.rank") > 0)).alias("fallback"))


def inventory(files: DataFrame, present: DataFrame) -> DataFrame:
    """A row for each claim file (case, key, frontmatter) with its source's place and terms; templates are left out.

    present: case, file of sources on disk. A source is included only if it is there and its registrant's terms are cleared.
    """
    flat = lambda name: F.coalesce(_of(name), F.lit(""))
    scaffold = reduce(Column.__or__, [flat(n).rlike(r"^[<\[]") for n in ("doi", "title", "file", "url")], F.upper("key").isin("TEMPLATE") | F.col("key").startswith("_"))
    names = ("doi", "pmcid", "url", "file", "source_sha256")
    own = files.filter(~scaffold).select("case", "key", F.coalesce(_of("title"), _of("paper"), F.lit("")).alias("title"), *(flat(n).alias(n) for n in names))
    there = present.select("case", "file").distinct().withColumn("there", F.lit(True))
    each = register.triage(own).join(there, ["case", "file"], "left").withColumn("there", F.coalesce("there", F.lit(False)) & (F.col("file") != ""))
    registrant = F.concat(F.lit("DOI registrant "), "prefix")
    evidence = F.when(F.col("publisher").isNotNull(), F.concat(registrant, F.lit(" = "), "publisher")).when(F.col("doi") != "", F.concat(registrant, F.lit(" not in the triage table"))).when(F.col("pmcid") != "", "pmcid present, no DOI").otherwise("no DOI / pmcid in provenance")
    yes = lambda c: F.when(c, "yes").otherwise("no")
    first = F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in ("doi", "pmcid", "url")), F.lit(""))
    return each.select(
        "case", F.col("key").alias("source_key"), "title", first.alias("locator"), F.col("file").alias("local_filename"), F.col("source_sha256").alias("expected_sha256"), yes(F.col("there")).alias("corpus_present"),
        yes(F.col("there") & F.col("redistribution").isin(*register.CLEARED)).alias("included_in_submission"), F.col("redistribution").alias("redistribution_status"), F.col("basis").alias("licence_or_basis"), evidence.alias("evidence_for_status"),
        F.when(F.col("doi") != "", F.concat(F.lit("https://doi.org/"), "doi")).otherwise(F.col("url")).alias("acquisition_command_or_instructions"), F.lit("attested").alias("verification_mode"), F.when(F.col("there"), "").otherwise(NOT_ON_DISK).alias("notes"),
    )


def _of(name: str) -> Column:
    """A frontmatter field without its quotes, null if it is empty."""
    return F.nullif(F.regexp_extract(F.col("frontmatter")[name], r'^\s*"?(.*?)"?\s*$', 1), F.lit(""))
