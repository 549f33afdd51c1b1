"""The source register: canonical files, suffixes, triage, and sources against declarations."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Settings that gates can have.
POSTURES = ("off", "optional", "warn", "required", "block")


def canonical(files: DataFrame, key: str, *order: Column) -> DataFrame:
    """Adds canonical (boolean) and duplicate_of, the first file of the key by order. files: filename and what order needs."""
    first = files.groupBy(key).agg(F.min(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.col("filename"))).alias("first"))
    return files.join(first, key).withColumn("duplicate_of", F.when(F.col("first.filename") != F.col("filename"), F.col("first.filename"))).drop("first").withColumn("canonical", F.col("duplicate_of").isNull())


# DOI registrants with their publishers and what their works may be used for.
_CLOSED = "closed-access publisher default; per-article open licence not established"
REGISTRANTS = (
    ("10.1371", "PLOS", "permissive-licence", "PLOS journals publish every article under CC-BY 4.0"),
    ("10.1038", "Springer Nature", "restricted", _CLOSED), ("10.1126", "AAAS (Science)", "restricted", _CLOSED), ("10.1016", "Elsevier", "restricted", _CLOSED), ("10.1103", "APS", "restricted", _CLOSED),
    ("10.1073", "PNAS", "unknown", "PNAS mixes open and closed access; per-article licence not established"),
    ("10.1101", "Cold Spring Harbor / bioRxiv", "unknown", "preprint or CSHL journal; author-selected licence not established"),
    ("10.48550", "arXiv", "unknown", "arXiv's non-exclusive distribution licence does not by default permit third-party redistribution"),
    ("10.1080", "Taylor & Francis", "restricted", _CLOSED), ("10.1093", "Oxford University Press", "restricted", _CLOSED),
    ("10.3390", "MDPI", "permissive-licence", "MDPI journals publish every article under CC-BY 4.0"),
    ("10.22331", "Quantum", "permissive-licence", "the journal Quantum publishes every article under CC-BY 4.0"),
    ("10.3389", "Frontiers", "permissive-licence", "Frontiers journals publish every article under CC-BY 4.0"),
    ("10.6028", "NIST", "public-domain", "NIST publications are US Government works (17 U.S.C. §105), public domain"),
    ("10.1001", "JAMA Network", "restricted", _CLOSED), ("10.1002", "Wiley", "restricted", _CLOSED), ("10.1007", "Springer", "restricted", _CLOSED), ("10.1088", "IOP Publishing", "restricted", _CLOSED), ("10.1109", "IEEE", "restricted", _CLOSED),
    ("10.1136", "BMJ", "restricted", "closed-access default; the BMJ Open subset is CC-BY but this item's licence is not established"),
    ("10.1137", "SIAM", "restricted", _CLOSED), ("10.1145", "ACM", "restricted", _CLOSED), ("10.1161", "AHA journals", "restricted", _CLOSED),
)
CLEARED = ("cleared", "public-domain", "permissive-licence", "competition-supplied-cleared")
# Phrases of pages that stand in for a paper, least bytes of a paper's file, and the register's columns.
LANDING = r"(?i)just a moment\.\.\.|enable javascript and cookies to continue|access to this article is restricted|you do not have access|subscribe to (read|view)|purchase (this )?article|sign in to continue|please log in|cloudflare|institutional login|request access"
LEAST_BYTES = {"html": 20 * 1024, "pdf": 50 * 1024}
COLUMNS = ("key", "filename", "extension", "title", "doi", "journal", "year", "first_author", "status", "size_kb", "added_on", "notes")
NAMED = r"^([a-z][a-z_\-]+?)[_\-](\d{4})([a-z]?)(?:[_\-](.+))?$"
DOI = r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+"
YEAR = r"\b((?:19|20)\d{2})\b"


@F.pandas_udf(T.StringType())
def ascii_fold(text: pd.Series) -> pd.Series:
    """Lower case without accents and apostrophes; hyphens stay."""

    def fold(t):
        plain = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
        return plain.translate({ord("ø"): "o", ord("ł"): "l", ord("æ"): "ae", ord("'"): None, ord("’"): None, ord("‘"): None})

    return text.map(fold, na_action="ignore")


def surname_key(text: Column) -> Column:
    return F.replace(ascii_fold(text), F.lit("-"), F.lit(""))


def parse_names(files: DataFrame) -> DataFrame:
    """Adds fn_author, fn_year, fn_suffix: what a file's name (column filename) says; of other names only a year."""
    stem = ascii_fold(F.regexp_replace("filename", r"\.[^.]*$", ""))
    each = files.withColumn("__stem", stem)
    get = lambda g: F.nullif(F.regexp_extract("__stem", NAMED, g), F.lit(""))
    year = F.coalesce(get(2), F.nullif(F.regexp_extract("__stem", YEAR, 1), F.lit("")))
    return each.withColumns({"fn_author": F.split(get(1), r"[_\-]")[0], "fn_year": year, "fn_suffix": F.when(get(1).isNotNull(), F.regexp_extract("__stem", NAMED, 3))}).drop("__stem")


def landing(text: Column, extension: Column, size: Column) -> Column:
    """Whether a file is a landing page: a telling phrase at its start, or too few bytes for its kind."""
    small = F.coalesce(*(F.when(extension == e, size < n) for e, n in LEAST_BYTES.items()), F.lit(False))
    return F.coalesce(F.substring(text, 1, 8000).rlike(LANDING), F.lit(False)) | small


def resolve_identity(files: DataFrame) -> DataFrame:
    """Adds author, year (metadata before the name), mismatch and notes to files with fn_* and meta_* columns."""
    each = files.withColumns({"__f": surname_key(F.col("fn_author")), "__m": surname_key(F.col("meta_author"))})
    f, m = F.col("__f"), F.col("__m")
    prefix = (F.length(f) >= 5) & (F.length(m) >= 5) & (f.startswith(m) | m.startswith(f))
    author = F.coalesce((f != "") & (m != "") & (f != m) & ~prefix, F.lit(False))
    years = F.coalesce(F.abs(F.expr("coalesce(try_cast(fn_year as int), -99)") - F.expr("coalesce(try_cast(meta_year as int), 9999)")) > 1, F.lit(False)) & F.col("fn_year").isNotNull() & F.col("meta_year").isNotNull()
    note = lambda on, a, b: F.when(on, F.concat(F.lit("filename_says_"), a, F.lit("_but_metadata_says_"), b))
    notes = F.array_compact(F.array(note(author, "fn_author", "meta_author"), note(years, "fn_year", "meta_year")))
    return each.withColumns({"author": F.coalesce(F.nullif("meta_author", F.lit("")), "fn_author"), "year": F.coalesce(F.nullif("meta_year", F.lit("")), "fn_year"), "mismatch": author | years, "notes": notes}).drop("__f", "__m")


def override(files: DataFrame, overrides: DataFrame) -> DataFrame:
    """files of resolve_identity with what overrides (filename, author, year, status, reason; one a file) say; adds forced.

    An override clears the mismatch and its notes. Comment rows, whose file begins with #, count for nothing.
    """
    said = overrides.filter("not startswith(trim(filename), '#')").select(F.trim("filename").alias("filename"), *(F.nullif(F.trim(c), F.lit("")).alias(f"o_{c}") for c in ("author", "year", "status", "reason")), F.lit(True).alias("o")).withColumn("o_author", ascii_fold("o_author"))
    notes = F.concat(F.filter("notes", lambda n: ~n.startswith("filename_says_")), F.array(F.concat(F.lit("override_applied: "), F.coalesce("o_reason", F.lit("")))))
    return files.join(said, "filename", "left").withColumns({"author": F.coalesce("o_author", "author"), "year": F.coalesce("o_year", "year"), "mismatch": F.col("mismatch") & F.col("o").isNull(), "notes": F.when(F.col("o"), notes).otherwise(F.col("notes")), "forced": F.col("o_status")}).drop("o", "o_author", "o_year", "o_status", "o_reason")


def assign_keys(files: DataFrame, verified: DataFrame) -> DataFrame:
    """Adds key and status. files: filename, extension, size_kb, author, year, doi, landing, mismatch, forced. verified: key.

    Works of one author and year with several DOIs get suffixes by DOI; their files without a DOI get a question mark and
    stay unknown. Of a key's files the canonical one is no landing page, then pdf, html, xml, then simply named, then
    largest, then first by name; the others are its duplicates. Files without author or year have no key and are unknown.
    """
    named = files.filter("author is not null and year is not null")
    dois = named.filter("doi is not null").select("author", "year", "doi").distinct()
    many = dois.groupBy("author", "year").agg(F.count(F.lit(1)).alias("__many")).filter("__many > 1")
    rank = F.row_number().over(Window.partitionBy("author", "year").orderBy("doi"))  # a row a work, not a file
    suffix = dois.join(many, ["author", "year"]).withColumn("suffix", F.chr(F.lit(96) + rank)).drop("__many")
    keyed = files.join(many, ["author", "year"], "left").join(suffix, ["author", "year", "doi"], "left")
    key = F.when(F.col("author").isNull() | F.col("year").isNull(), None).otherwise(F.concat("author", F.lit("_"), "year", F.when(F.col("__many").isNull(), "").otherwise(F.coalesce("suffix", F.lit("?")))))
    keyed = keyed.withColumn("key", key)
    kind = F.coalesce(*(F.when(F.col("extension") == e, i) for i, e in enumerate(("pdf", "html", "xml"))), F.lit(3))
    simple = F.lower("filename").rlike(r"^[a-z]+_\d{4}[a-z]?\.\w+$")
    order = F.struct(F.col("landing"), kind, ~simple, -F.col("size_kb"), F.col("filename"))
    first = keyed.filter("key is not null and key not like '%?'").groupBy("key").agg(F.min(order).alias("o")).select("key", F.col("o.filename").alias("first"))
    found = keyed.join(first, "key", "left").join(verified.select(F.col("key").alias("__v")).distinct(), F.col("key") == F.col("__v"), "left")
    own = F.coalesce("forced", F.when(F.col("landing"), "landing_page").when(F.col("mismatch"), "mismatch").when(F.col("__v").isNotNull(), "verified").otherwise("downloaded"))
    status = F.when(F.col("first").isNull(), "unknown").when(F.col("first") == F.col("filename"), own).otherwise(F.concat(F.lit("duplicate_of:"), "key"))
    return found.withColumn("status", status).drop("__many", "suffix", "first", "__v")


def divergence(register: DataFrame, claim_files: DataFrame) -> DataFrame:
    """register (key, doi, sha256, status, ...) with status mismatch where a claim file of the key (key, doi, source_sha256) says otherwise."""
    told = claim_files.select("key", F.lower("doi").alias("__doi"), F.col("source_sha256").alias("__sha"))
    each = register.join(told, "key", "left")
    doi = F.lower("doi")
    other = (F.col("__doi") != "") & (doi != "") & ~F.contains(doi, F.col("__doi")) & ~F.contains(F.col("__doi"), doi)
    bytes_ = F.col("__sha").rlike("^[0-9a-f]{64}$") & (F.col("sha256") != F.col("__sha"))
    apart = (F.coalesce(other, F.lit(False)) | F.coalesce(bytes_, F.lit(False))) & ~F.col("status").startswith("duplicate_of:")
    return each.withColumn("status", F.when(apart, "mismatch").otherwise(F.col("status"))).drop("__doi", "__sha")


def triage(works: DataFrame) -> DataFrame:
    """Adds prefix, publisher, redistribution and basis to works (doi, pmcid), by the DOI's registrant."""
    spark = works.sparkSession
    known = spark.createDataFrame(REGISTRANTS, "prefix string, publisher string, __status string, __basis string")
    prefix = F.trim(F.substring_index(F.coalesce("doi", F.lit("")), "/", 1))
    basis = F.when(F.col("prefix") != "", "publisher default not established for this DOI registrant").when(F.col("pmcid") != "", "PMC hosting does not establish an item-level redistribution licence").otherwise("no DOI or repository licence established")
    each = works.withColumn("prefix", prefix).join(F.broadcast(known), "prefix", "left")
    return each.withColumns({"redistribution": F.coalesce("__status", F.lit("unknown")), "basis": F.coalesce("__basis", basis)}).drop("__status", "__basis")


def register_rows(register: DataFrame, added_on: str) -> DataFrame:
    """The register's columns, for a tab-separated file, in the order of key, those without one last, then file name."""
    flat = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\t\n]", " ")
    made = register.select(F.coalesce("key", F.lit("")).alias("key"), "filename", "extension", F.substring(flat(F.col("title")), 1, 300).alias("title"), F.coalesce("doi", F.lit("")).alias("doi"), flat(F.col("journal")).alias("journal"), F.coalesce("year", F.lit("")).alias("year"), F.coalesce("author", F.lit("")).alias("first_author"), "status", F.round("size_kb", 1).alias("size_kb"), F.lit(added_on).alias("added_on"), F.array_join("notes", "; ").alias("notes"))
    return made.orderBy(F.coalesce(F.nullif("key", F.lit("")), F.lit("~")), "filename")


#: Statuses of the review in their order, and clusters of duplicates that it shows.
STATUSES, CLUSTERS = ("verified", "downloaded", "mismatch", "landing_page", "duplicate_of", "unknown"), 20


def review(register: DataFrame) -> DataFrame:
    """section, item, n, detail of what someone has to look at in a register (filename, key, status, fn_author, fn_year, meta_author, meta_year, size_kb, notes).

    status: how many files have each of STATUSES, and files and keys in all. mismatch: files whose name says another paper than
    their metadata, with both. landing_page and unknown: files, with what was noted. cluster: the CLUSTERS keys with most
    duplicates, ties by key, each with its first three files.
    """
    c = F.col
    kind = F.substring_index("status", ":", 1)
    empty = register.sparkSession.createDataFrame([(k,) for k in STATUSES], "item string")
    counts = empty.join(F.broadcast(register.groupBy(kind.alias("item")).agg(F.count(F.lit(1)).alias("n"))), "item", "left")
    whole = register.agg(F.count(F.lit(1)).alias("files"), F.countDistinct(F.when(kind != "duplicate_of", c("key"))).alias("keys"))
    totals = whole.select(F.explode(F.array(F.struct(F.lit("files").alias("item"), c("files").alias("n")), F.struct(F.lit("keys").alias("item"), c("keys").alias("n")))).alias("t")).select("t.*")
    none = F.lit(None)
    row = lambda df, section, item, n, detail: df.select(F.lit(section).alias("section"), item.alias("item"), n.cast("long").alias("n"), detail.cast("string").alias("detail"))
    says = lambda a, y: F.concat(F.coalesce(a, F.lit("?")), F.lit("_"), F.coalesce(y, F.lit("?")))
    apart = row(register.filter("status = 'mismatch'"), "mismatch", c("filename"), none, F.concat_ws(" | ", says("fn_author", "fn_year"), says("meta_author", "meta_year")))
    noted = register.filter("status in ('landing_page', 'unknown')").select(c("status").alias("section"), c("filename").alias("item"), F.lit(None).cast("long").alias("n"), F.array_join("notes", "; ").alias("detail"))
    groups = register.filter(kind == "duplicate_of").groupBy(F.substring_index("status", ":", -1).alias("to")).agg(F.count(F.lit(1)).alias("n"))
    top = groups.orderBy(F.desc("n"), "to").limit(CLUSTERS)
    first = register.filter(kind == "duplicate_of").select(F.substring_index("status", ":", -1).alias("to"), "filename").join(F.broadcast(top), "to").withColumn("k", F.row_number().over(Window.partitionBy("to").orderBy("filename"))).filter("k <= 3")
    shown = first.groupBy("to", "n").agg(F.array_join(F.array_sort(F.collect_list("filename")), ", ").alias("files"))
    return row(counts, "status", c("item"), F.coalesce("n", F.lit(0)), none).unionByName(row(totals, "status", c("item"), c("n"), none)).unionByName(apart).unionByName(noted).unionByName(row(shown, "cluster", c("to"), c("n"), c("files")))


def usable(register: DataFrame) -> DataFrame:
    """Rows of a register that a citation may rest on."""
    return register.filter(F.col("key").rlike(r"^[a-z][a-z'-]*_\d{4}[a-z]?$") & (F.col("status").isin("verified", "downloaded") | F.col("status").startswith("duplicate_of:")))


def suffixes(works: DataFrame) -> DataFrame:
    """Adds suffix a, b, c ... by DOI within author and year where they have several; works: author, year, doi."""
    w = Window.partitionBy("author", "year").orderBy("doi")
    ranked = works.filter("doi is not null").select("author", "year", "doi").distinct().withColumn("rank", F.row_number().over(w))
    many = ranked.groupBy("author", "year").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    named = ranked.join(many, ["author", "year"]).select("author", "year", "doi", F.chr(F.lit(96) + F.col("rank")).alias("suffix"))
    return works.join(named, ["author", "year", "doi"], "left")


def identity_problems(named: DataFrame) -> DataFrame:
    """Adds problem: author or year of a file's name against its metadata; a prefix of five letters or a year apart is none."""
    a, b = F.col("name_author"), F.col("meta_author")
    prefix = (F.least(F.length(a), F.length(b)) >= 5) & (a.startswith(b) | b.startswith(a))
    return named.withColumn("problem", F.when((a != b) & ~prefix, "author").when(F.abs(F.col("name_year") - F.col("meta_year")) > 1, "year"))


def against(declared: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """key and where: declared keys that aren't present and present ones that aren't declared."""
    left = declared.select(key).distinct().withColumn("d", F.lit(True))
    right = present.select(key).distinct().withColumn("p", F.lit(True))
    return left.join(right, key, "full_outer").filter("d is null or p is null").select(key, F.when(F.col("p").isNull(), "missing").otherwise("undeclared").alias("where"))


def dead_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """source, target of links (distinct) to no note."""
    return links.select("source", "target").distinct().join(notes.select(F.col("note").alias("target")), "target", "left_anti").select("source", "target")


def orphans(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes that no note links to; a link to itself counts."""
    return notes.select("note").distinct().join(links.select(F.col("target").alias("note")).distinct(), "note", "left_anti")


def calibration_faults(notes: DataFrame) -> DataFrame:
    """note, code, field of notes (note, and four strings) that declare a calibrated_confidence: missing, not numeric or above the inside view."""
    fields = ("inside_view", "out_of_model_discount", "adversarial_discount", "calibrated_confidence")
    own = notes.filter("calibrated_confidence is not null")
    each = own.select("note", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("")).alias("value")) for f in fields))).alias("f")).select("note", "f.*")
    code = F.when(F.col("value") == "", "missing").when(F.expr("try_cast(value as double)").isNull(), "not numeric")
    above = own.filter("try_cast(calibrated_confidence as double) > try_cast(inside_view as double)").select("note", F.lit("above").alias("code"), F.lit("calibrated_confidence").alias("field"))
    return each.select("note", code.alias("code"), "field").filter("code is not null").unionByName(above)


def calibration_problems(notes: DataFrame) -> DataFrame:
    """Adds problem to notes (inside_view, calibrated; strings): not a number from 0 to 1, or calibrated above the inside view."""
    x, y = F.expr("try_cast(inside_view as double)"), F.expr("try_cast(calibrated as double)")
    sound = x.between(0, 1) & y.between(0, 1)
    return notes.withColumn("problem", F.when(~F.coalesce(sound, F.lit(False)), "range").when(y > x, "above"))
