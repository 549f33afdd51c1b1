"""Author-year citations in prose, numeric markers, and the claim files that citations stand for."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The citation grammar, in order of priority, and words that aren't surnames.
_AUTHOR = r"[A-Z][\w'’-]+"
_YEAR = r"((?:19|20)\d{2})[a-z]?"
_AND = r"(?:\s*&\s*|\s+and\s+)"
_CLAIM = r"(?:\s*#([\w-]+))?"
_TAIL = rf",?\s*\(?{_YEAR}{_CLAIM}\)?"
FORMS = tuple(
    map(
        re.compile,
        (
            rf"({_AUTHOR})\s+et\s+al\.?{_TAIL}",
            rf"({_AUTHOR})(?:,\s*{_AUTHOR})+,?{_AND}{_AUTHOR}{_TAIL}",
            rf"({_AUTHOR}){_AND}{_AUTHOR}{_TAIL}",
            rf"\(({_AUTHOR}),?\s+{_YEAR}{_CLAIM}\)",
            rf"({_AUTHOR})\s+\({_YEAR}{_CLAIM}\)",
        ),
    )
)
NOT_SURNAMES = frozenset("""
    al et de van la von der del den und the of between since during figure
    table section chapter volume issue page review report code progress
    january february march april may june july august september october
    november december
    in by see ref refs vol no pp eq equation appendix fig figs model note
    before after around until over under from circa version release published
    updated accessed copyright
""".split())  # fmt: skip
BRACKETED, RAISED = r"(\[\d{1,3}(?:\s*[,–-]\s*\d{1,3})*\])", "(?:[A-Za-z]{2}|[.,;:])([⁰¹²³⁴-⁹]+)"
SHORTEST_SURNAME = 3


def _apart(matches: Iterable[re.Match]) -> Iterator[re.Match]:
    """Of matches in order of precedence, those that overlap none that was let through before them."""
    ends: list[int] = []
    starts: list[int] = []  # of matches let through, which are apart: both lists are in order
    for m in matches:
        i = bisect.bisect_right(ends, m.start())
        if i == len(starts) or m.end() <= starts[i]:
            starts.insert(i, m.start())
            ends.insert(i, m.end())
            yield m


def cited(text: str | None) -> list[tuple[str, str, str | None]]:
    """Distinct (author, year, claim) of a text, sorted; of a null text none.

    A form of higher priority takes its characters first, over the whole text, also where its author turns out to be no
    surname; a match of a later form that touches them counts for nothing.
    """
    groups = [m.groups() for m in _apart(m for form in FORMS for m in form.finditer(text or ""))]
    named = {(author.replace("’", "'").lower(), year, claim and claim.lower()) for author, year, claim in groups}
    return sorted((c for c in named if len(c[0]) >= SHORTEST_SURNAME and c[0] not in NOT_SURNAMES), key=lambda c: tuple(x or "" for x in c))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(name, T.StringType()) for name in ("author", "year", "claim")])))
def _cited(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"author": a, "year": y, "claim": c} for a, y, c in cited(t)])


def citations(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each distinct citation of each row of docs: the id, author, year, claim (null if it names none)."""
    each = docs.select(F.col(id_col), _cited(F.coalesce(F.col(text_col), F.lit(""))).alias("__cites"))
    return each.select(id_col, F.explode("__cites").alias("__c")).select(id_col, "__c.author", "__c.year", "__c.claim")


def numeric_markers(text: Column) -> Column:
    """Bracketed numbers, then raised digits after words or sentence marks; of a null text null."""
    return F.concat(F.regexp_extract_all(text, F.lit("(?U)" + BRACKETED), F.lit(1)), F.regexp_extract_all(text, F.lit(RAISED), F.lit(1)))


def _openings(files: DataFrame, ending: str = ".md") -> DataFrame:
    """name, author, year: all that the name of a file with that ending can be cited by. There are at most as many as its length squared."""
    low = files.select("name", F.lower("name").alias("low")).filter(F.col("low").endswith(ending))
    # An author is a start of the name that no letter follows; a year lies behind it and no digit follows that.
    ends = F.filter(F.sequence(F.lit(1), F.length("low")), lambda i: ~F.substring(F.col("low"), i + 1, F.lit(1)).rlike("[a-z]"))
    each = low.select("name", "low", F.explode(ends).alias("end"))
    years = F.array_distinct(F.regexp_extract_all(F.expr("substring(low, end + 1)"), F.lit(r"((?:19|20)\d{2})(?!\d)"), F.lit(1)))
    return each.select("name", F.expr("left(low, end)").alias("author"), F.explode(years).alias("year"))


def _by_name(cites: DataFrame, openings: DataFrame) -> DataFrame:
    """Distinct author, year with the first claim file by spelling of the author, then name."""
    spelt = F.array_distinct(F.array(F.col("author"), F.regexp_replace("author", "['-]", "")))
    wanted = cites.select("author", "year", F.posexplode(spelt).alias("place", "spelling"))
    o = openings.select(F.col("author").alias("spelling"), "year", "name")
    return wanted.join(o, ["spelling", "year"]).groupBy("author", "year").agg(F.min_by("name", F.struct("place", "name")).alias("name"))


def resolve(cites: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct author, year of cites, each with the name of its claim file, or null.

    Names are matched by joins on equal authors and years. Only what none matches is looked up in aliases (alias, target,
    both `author_year`), and targets among names alone, so aliases form no chain. Nulls match nothing and stay. Repeated
    aliases count by their smallest target.
    """
    openings, cites = _openings(files), cites.select("author", "year").distinct()
    same = ["author", "year"]
    direct = _by_name(cites, openings)
    missed = cites.join(direct, same, "left_anti")
    one = aliases.groupBy("alias").agg(F.min("target").alias("target"))
    split = r"^(.*)_([^_]*)$"
    led = missed.join(one, F.concat_ws("_", *same) == F.col("alias")).select(*same, F.regexp_extract("target", split, 1).alias("to_author"), F.regexp_extract("target", split, 2).alias("to_year"))
    through = _by_name(led.select(F.col("to_author").alias("author"), F.col("to_year").alias("year")).distinct(), openings)
    through = led.join(through.select(F.col("author").alias("to_author"), F.col("year").alias("to_year"), "name"), ["to_author", "to_year"]).select(*same, "name")
    return cites.join(direct.unionByName(through), same, "left").select(*same, "name")


def papers(cites: DataFrame, register: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct author, year of cites, each with by: register, file or null, and the register's best row for it: key, extension, status.

    A citation has a paper if a usable row of the register (key, extension, status) has its author and year as key, with a
    letter behind it or not, or if the name of one of files (name) does. Of several rows, usable or not, the best is verified
    before downloaded before others, then HTML before PDF before others, then first by key. Nulls have no paper.
    """
    c, same = F.col, ["author", "year"]
    asked = cites.select(*same).distinct()
    spelt = asked.select(*same, F.explode(F.array_distinct(F.array("author", F.regexp_replace("author", "['-]", "")))).alias("spelling"))
    parts = r"^(.*)_(\d{4})[a-z]?$"
    rows = register.withColumns({"spelling": F.regexp_extract(F.lower("key"), parts, 1), "year": F.regexp_extract(F.lower("key"), parts, 2)}).filter("spelling <> ''")
    usable = c("status").isin("verified", "downloaded") | c("status").startswith("duplicate_of:")
    rank = F.struct(F.when(c("status") == "verified", 0).when(c("status") == "downloaded", 1).otherwise(2).alias("s"), F.when(c("extension") == "html", 0).when(c("extension") == "pdf", 1).otherwise(2).alias("e"), c("key"), c("extension"), c("status"))
    best = spelt.join(rows, ["spelling", "year"]).groupBy(*same).agg(F.min(rank).alias("b"), F.bool_or(usable).alias("usable"))
    named = spelt.join(_openings(files, "").select(c("author").alias("spelling"), "year"), ["spelling", "year"], "left_semi").select(*same).distinct().withColumn("named", F.lit(True))
    found = asked.join(best, same, "left").join(named, same, "left")
    return found.select(*same, F.when(c("usable"), "register").when(c("named"), "file").alias("by"), "b.key", "b.extension", "b.status")


def claim_problems(cites: DataFrame, files: DataFrame, aliases: DataFrame, claims: DataFrame, every: bool = False) -> DataFrame:
    """author, year, claim, code of distinct cites (author, year, claim): no file, no claim, ordinal or, with every, unnamed.

    files: name. claims: key (a file's name without its ending, in lower case), alias, is_slug, as markdown.aliases gives
    them. A cite without a file has no other problem; a bare ordinal isn't stable unless a claim is named so.
    """
    placed = cites.select("author", "year", "claim").distinct().join(resolve(cites, files, aliases), ["author", "year"])
    named = placed.withColumn("key", F.lower(F.regexp_replace("name", r"\.md$", "")))
    known = claims.select("key", F.col("alias").alias("claim"), F.col("is_slug")).groupBy("key", "claim").agg(F.bool_or("is_slug").alias("is_slug"))
    found = named.join(known, ["key", "claim"], "left")
    code = F.when(F.col("name").isNull(), "no file").when(F.col("claim").isNull(), F.when(F.lit(every), "unnamed")).when(F.col("is_slug").isNull(), "no claim").when(F.lit(every) & ~F.col("is_slug"), "ordinal")
    return found.select("author", "year", "claim", code.alias("code")).filter("code is not null")

