"""Bibliographic metadata of HTML pages: tags in one pass over a page, then precedence among them as expressions."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.operators.register import DOI, YEAR, ascii_fold
from provenant.sources.html_units import closed_references

# Where a page says what it is, the first kind that it has counts. ld: is of JSON-LD, title of the element.
TITLE = ("citation_title", "DC.Title", "title", "ld:headline", "ld:name")
AUTHOR = ("citation_author", "DC.Creator", "ld:author")
DATE = ("citation_publication_date", "citation_date", "DC.Date", "ld:datePublished")
IDENTIFIER = ("citation_doi", "DC.Identifier", "ld:identifier", "ld:sameAs", "ld:@id")
JOURNAL = ("citation_journal_title", "ld:isPartOf")
_NAMES = frozenset(n for group in (TITLE, AUTHOR, DATE, IDENTIFIER, JOURNAL) for n in group)


def _said(value: object) -> list[str]:
    """Texts of a JSON-LD value: of objects their name or value, of lists those of all items."""
    if isinstance(value, str):
        return [value]
    if isinstance(value, list):
        return [x for v in value for x in _said(v)]
    if isinstance(value, dict):
        return _said(value.get("name", value.get("value")))
    return []


class _Tags(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.within, self.parts, self.titles = "", [], 0

    def handle_starttag(self, tag, attrs):
        at = {k: v or "" for k, v in attrs}
        if tag == "meta" and at.get("name") in _NAMES:
            self.found.append((at["name"], at.get("content", "").strip()))
        elif tag == "title" and not self.titles:
            self.within, self.parts, self.titles = "title", [], 1
        elif tag == "script" and at.get("type", "").strip().lower() == "application/ld+json":
            self.within, self.parts = "script", []

    def handle_data(self, data):
        if self.within:
            self.parts.append(data)

    def handle_endtag(self, tag):
        if self.within and tag == self.within:
            text = "".join(self.parts).strip()
            self.found += [("title", text)] if tag == "title" else self._linked(text)
            self.within = ""

    @staticmethod
    def _linked(text: str) -> list[tuple[str, str]]:
        try:
            whole = json.loads(text)
        except (ValueError, RecursionError):
            return []
        items = whole.get("@graph", [whole]) if isinstance(whole, dict) else whole
        return [(f"ld:{k}", x.strip()) for item in (items if isinstance(items, list) else []) if isinstance(item, dict) for k, v in item.items() if f"ld:{k}" in _NAMES for x in _said(v)]


def tags_of(page: str | None) -> list[dict[str, str]]:
    parser = _Tags()
    parser.feed(closed_references(page or ""))
    parser.close()
    return [{"name": n, "content": c} for n, c in parser.found if c]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("content", T.StringType())])))
def _tags(html: pd.Series) -> pd.Series:
    return html.map(tags_of)


def surname(author: Column) -> Column:
    """Of one author, what stands before a comma, else the last word; null of an empty text."""
    text = F.trim(F.regexp_replace(author, r"\s+", " "))
    return F.nullif(F.trim(F.when(F.contains(text, F.lit(",")), F.substring_index(text, ",", 1)).otherwise(F.substring_index(text, " ", -1))), F.lit(""))


def surname_of_list(authors: Column) -> Column:
    """Of several authors in one text, the first one's last word before a comma that comes before any semicolon, else the last word before a semicolon or ` and `."""
    text = F.trim(F.regexp_replace(authors, r"\s+", " "))
    head = F.when(F.contains(F.substring_index(text, ";", 1), F.lit(",")), F.substring_index(text, ",", 1)).when(F.contains(text, F.lit(",")), F.substring_index(text, ",", 1)).otherwise(F.substring_index(F.substring_index(text, ";", 1), " and ", 1))
    return F.nullif(F.substring_index(F.trim(head), " ", -1), F.lit(""))


def doi(text: Column) -> Column:
    """The first DOI in a text, in lower case, null if it has none."""
    return F.lower(F.nullif(F.regexp_extract(text, DOI, 0), F.lit("")))


def year(text: Column) -> Column:
    """The first year of the twentieth or twenty-first century in a text, null if it has none."""
    return F.nullif(F.regexp_extract(text, YEAR, 1), F.lit(""))


def _ranked(names: tuple[str, ...]) -> Column:
    """Contents of the first of names that the page has, in page order; null if it has none."""
    of = lambda n: F.filter("__tags", lambda t: t["name"] == n)
    own = [of(n) for n in names]
    return F.transform(F.coalesce(*(F.when(F.size(x) > 0, x) for x in own)), lambda t: t["content"])


def _first(values: Column, read) -> Column:
    return F.get(F.filter(F.transform(values, read), lambda v: v.isNotNull()), F.lit(0))


def metadata(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds meta_title, meta_author, meta_year, meta_doi, meta_journal to pages.

    Each is read from the first kind of tag that the page has, and of several such tags from the first that tells it; a kind
    that is there but tells nothing isn't passed over. Authors are folded surnames, DOIs in lower case. Tags within comments
    and scripts are none. A null page tells nothing.
    """
    each = pages.withColumn("__tags", _tags(html_col))
    made = {"meta_title": F.get(_ranked(TITLE), F.lit(0)), "meta_author": ascii_fold(surname(F.get(_ranked(AUTHOR), F.lit(0)))), "meta_year": _first(_ranked(DATE), year), "meta_doi": _first(_ranked(IDENTIFIER), doi), "meta_journal": F.get(_ranked(JOURNAL), F.lit(0))}
    return each.withColumns(made).drop("__tags")
