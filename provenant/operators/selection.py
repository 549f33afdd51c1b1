"""How a corpus was selected: the register of sources and the flow of searches, against the claim files that are stamped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields that entries must have.
SOURCE_FIELDS = ("discovery", "rationale", "position")
OVERVIEW = ("review-question", "inclusion-criteria", "exclusion-criteria", "update-procedure", "last-updated")
SEARCH = ("database", "query", "date", "records-found", "included")
INCLUDED = ("source", "reason")


def first_word(text: Column) -> Column:
    """The leading word in lower case, without marks around it; empty of nothing."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_extract(text, r"(?U)^\s*(\S*)", 1), "^[ —\\-:.,]+|[ —\\-:.,]+$", "")))


def key_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), first_word), lambda k: k != "")


def count(text: Column) -> Column:
    """A number that isn't negative, thousands parted by commas or not; else null."""
    plain = F.trim(F.replace(text, F.lit(","), F.lit("")))
    return F.when(plain.rlike("^[0-9]+$"), plain.try_cast("bigint"))


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _told(df: DataFrame, code: str, subject: Column, detail: Column | None = None) -> DataFrame:
    return df.select("project", F.lit(code).alias("code"), subject.alias("subject"), (F.lit(None).cast("string") if detail is None else detail).alias("detail"))


def _entries(rows: DataFrame, section: Column) -> DataFrame:
    """project, entry, heading, fields (map of name to values in order) of a section's entries."""
    each = rows.filter(section & (F.col("entry") > 0))
    heads = each.groupBy("project", "entry").agg(F.coalesce(F.nullif(F.max("heading"), F.lit("")), F.lit("(unnamed)")).alias("heading"))
    lists = each.filter("field is not null").groupBy("project", "entry", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]).alias("values"))
    maps = lists.groupBy("project", "entry").agg(F.map_from_entries(F.collect_list(F.struct("field", "values"))).alias("fields"))
    return heads.join(maps, ["project", "entry"], "left").withColumn("fields", F.coalesce("fields", F.create_map().cast("map<string,array<string>>")))


def _first(name: str) -> Column:
    return F.get(F.col("fields")[name], F.lit(0))


def _missing(entries: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return _told(entries.select("project", "heading", F.explode(F.filter(F.array(*map(F.lit, names)), lambda n: ~F.map_contains_key("fields", n))).alias("name")), "missing field", F.col("heading"), F.col("name"))


def selection_problems(rows: DataFrame, files: DataFrame, stamped: DataFrame, questions: DataFrame) -> DataFrame:
    """project, code, subject, detail of registers. rows: fields() with project for path. files and stamped: project, key. questions: project, qid.

    Codes: no key, phantom, missing field, orphan position, orphan question, silent side, unregistered.
    """
    section = F.col("section")
    places = rows.filter(section.startswith("position") & (F.col("field") == "position")).select("project", first_word(F.col("value")).alias("slug")).distinct()
    gaps = rows.filter(~section.startswith("position") & ~section.startswith("source") & F.contains(section, F.lit("gap")) & (F.col("field") == "gap")).groupBy("project").agg(F.lower(F.array_join(F.collect_list("value"), "\n")).alias("gaps"))
    entries = _entries(rows, section.startswith("source")).withColumn("key", F.lower(F.trim(F.coalesce(_first("source"), F.lit("")))))
    keyed = entries.filter("key <> ''")
    have = files.select("project", "key").distinct()
    of = lambda name: entries.select("project", "heading", F.explode(F.col("fields")[name]).alias("v")).withColumn("slug", first_word(F.col("v")))
    sides, asked = of("position"), of("addresses")
    asked = asked.join(questions.select("project").distinct(), "project", "left_semi").join(questions.select("project", F.col("qid").alias("slug")).distinct(), ["project", "slug"], "left_anti")
    bare = places.join(sides.select("project", "slug").distinct(), ["project", "slug"], "left_anti").join(gaps, "project", "left")
    word = F.expr("regexp_like(coalesce(gaps, ''), concat('(?<![\\\\w-])\\\\Q', slug, '\\\\E(?![\\\\w-])'))")
    return _all([
        _told(entries.filter("key = ''"), "no key", F.col("heading")), _told(keyed.join(have, ["project", "key"], "left_anti"), "phantom", F.col("heading"), F.col("key")), _missing(entries, SOURCE_FIELDS),
        _told(sides.join(places, ["project", "slug"], "left_anti"), "orphan position", F.col("heading"), F.col("slug")), _told(asked, "orphan question", F.col("heading"), F.col("slug")),
        _told(bare.filter(~word), "silent side", F.col("slug")), _told(stamped.select("project", "key").distinct().join(keyed.select("project", "key"), ["project", "key"], "left_anti"), "unregistered", F.col("key")),
    ])


def flow_problems(rows: DataFrame, files: DataFrame, stamped: DataFrame) -> DataFrame:
    """project, code, subject, detail of flows of sources. rows: fields() with project for path, its sections overview, searches,
    included sources, excluded and unavailable. files and stamped: project, key. Projects without stamped files need no overview.
    """
    section = F.col("section")
    marked = stamped.select("project", "key").distinct()
    busy = marked.select("project").distinct()
    there = rows.select("project").distinct()
    overview = rows.filter(section.startswith("overview") & F.col("field").isNotNull()).select("project", F.col("field").alias("name")).distinct()
    asked = busy.join(there, "project").select("project", F.explode(F.array(*map(F.lit, OVERVIEW))).alias("name"))
    searches, included = _entries(rows, section.startswith("search")), _entries(rows, section.startswith("included"))
    numbers = searches.withColumns({"f": _first("records-found"), "s": _first("records-screened")})
    found, screened = count(F.col("f")), count(F.col("s"))
    listed = searches.select("project", F.explode(F.col("fields")["included"]).alias("v")).select("project", F.explode(key_list(F.col("v"))).alias("key")).distinct()
    named = included.withColumn("key", first_word(F.coalesce(_first("source"), F.lit("")))).filter("key <> ''")
    keys, have = named.select("project", "key").distinct(), files.select("project", "key").distinct()
    no = lambda a, b: a.join(b, ["project", "key"], "left_anti")
    in_busy = lambda a: a.join(busy, "project", "left_semi")
    out = [
        _told(busy.join(there, "project", "left_anti"), "no flow", F.lit(None).cast("string")), _told(asked.join(overview, ["project", "name"], "left_anti"), "missing field", F.lit("overview"), F.col("name")),
        _told(busy.join(there, "project").join(searches.select("project"), "project", "left_anti"), "no searches", F.lit(None).cast("string")), _told(busy.join(there, "project").join(included.select("project"), "project", "left_anti"), "no included", F.lit(None).cast("string")),
        _missing(searches, SEARCH), _told(searches.filter(~F.map_contains_key("fields", "records-screened") & ~F.map_contains_key("fields", "included")), "nothing screened", F.col("heading")),
        _told(numbers.filter(F.col("f").isNotNull() & found.isNull()), "no count", F.col("heading"), F.lit("records-found")), _told(numbers.filter(F.col("s").isNotNull() & screened.isNull()), "no count", F.col("heading"), F.lit("records-screened")),
        _told(numbers.filter(screened > found), "more screened than found", F.col("heading")), _missing(included, INCLUDED), _told(no(named, have), "phantom", F.col("heading"), F.col("key")),
        _told(no(marked, keys).join(there, "project", "left_semi"), "stamped but not included", F.col("key")), _told(no(keys.join(have, ["project", "key"], "left_semi"), marked), "included but not stamped", F.col("key")),
        _told(in_busy(no(keys, listed)), "included by no search", F.col("key")), _told(in_busy(no(listed, keys)), "searched but not included", F.col("key")),
    ]
    for name in ("excluded", "unavailable"):
        entries = _entries(rows, section.startswith(name))
        out += [_told(entries.filter(~F.map_contains_key("fields", "record") & ~F.map_contains_key("fields", "source")), "no record", F.col("heading"), F.lit(name)), _told(entries.filter(~F.map_contains_key("fields", "reason")), "no reason", F.col("heading"), F.lit(name))]
    return _all(out)
