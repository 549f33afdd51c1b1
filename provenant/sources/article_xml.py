"""Bibliographic XML, of PubMed and of JATS, by declared schemas. Spark reads a file in one task, article by article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.operators.register import DOI, YEAR, ascii_fold

# The elements that hold an article, and where its parts are.
ROWS = ("PubmedArticle", "article")
SCHEMA = """
  MedlineCitation struct<PMID: string, Article: struct<ArticleTitle: string, ELocationID: array<string>, AuthorList: struct<Author: array<struct<LastName: string>>>,
    Journal: struct<Title: string, JournalIssue: struct<PubDate: struct<Year: string>>>>>,
  PubmedData struct<ArticleIdList: struct<ArticleId: array<string>>>,
  front struct<`journal-meta`: struct<`journal-title-group`: struct<`journal-title`: string>>,
    `article-meta`: struct<`article-id`: array<string>, `title-group`: struct<`article-title`: string>, `contrib-group`: array<struct<contrib: array<struct<name: struct<surname: string>>>>>, `pub-date`: array<struct<year: string>>>>"""
LONGEST_TITLE = 300
_OPTIONS = {"mode": "PERMISSIVE", "ignoreNamespace": "true"}


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """file and the columns of SCHEMA of each article in the XML files at path, whichever of ROWS it is in."""
    each = [spark.read.format("xml").option("rowTag", row).options(**_OPTIONS).schema(SCHEMA).load(path).withColumn("file", F.col("_metadata.file_name")) for row in ROWS]
    return each[0].unionByName(each[1])


def parsed(articles: DataFrame, xml_col: str) -> DataFrame:
    """articles with the columns of SCHEMA out of the XML text in a column, one article a row."""
    made = articles.withColumn("__x", F.from_xml(xml_col, SCHEMA, _OPTIONS))
    return made.select(*articles.columns, "__x.*")


def _text(c: Column) -> Column:
    """Text without the markup within it, white space at its ends gone, null if nothing is left."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", ""), r"^\s+|\s+$", ""))
    for name, to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(to))
    return F.nullif(plain, F.lit(""))


def _first(values: Column, pattern: str, group: int = 0) -> Column:
    """The first match in an array of texts, null if there is none."""
    found = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.regexp_extract(v, pattern, group)), lambda v: v != "")
    return F.get(found, F.lit(0))


def metadata(articles: DataFrame) -> DataFrame:
    """Adds meta_title, meta_author, meta_year, meta_doi, meta_journal to rows with the columns of SCHEMA, which go.

    Of several authors and dates the first counts, and of several ids the first that holds a DOI, in lower case. Authors are
    folded surnames. What isn't there is null.
    """
    c = F.col
    pub, jats = "MedlineCitation.Article", "front.`article-meta`"
    title = F.substring(F.coalesce(_text(c(f"{pub}.ArticleTitle")), _text(c(f"{jats}.`title-group`.`article-title`"))), 1, LONGEST_TITLE)
    given = F.flatten(F.transform(c(f"{jats}.`contrib-group`"), lambda g: F.coalesce(g["contrib"], F.array().cast("array<struct<name:struct<surname:string>>>"))))
    names = F.concat(F.coalesce(F.transform(c(f"{pub}.AuthorList.Author"), lambda a: a["LastName"]), F.array()), F.coalesce(F.transform(given, lambda a: a["name"]["surname"]), F.array()))
    author = F.get(F.filter(F.transform(names.cast("array<string>"), _text), lambda a: a.isNotNull()), F.lit(0))
    years = F.concat(F.array(c(f"{pub}.Journal.JournalIssue.PubDate.Year")), F.coalesce(F.transform(c(f"{jats}.`pub-date`"), lambda d: d["year"]), F.array().cast("array<string>")))
    year = F.regexp_extract(F.get(F.filter(F.transform(years, _text), lambda y: y.isNotNull()), F.lit(0)), YEAR, 1)
    none = F.array().cast("array<string>")
    ids = F.concat(*(F.coalesce(c(x), none) for x in (f"{pub}.ELocationID", "PubmedData.ArticleIdList.ArticleId", f"{jats}.`article-id`")))
    journal = F.coalesce(_text(c(f"{pub}.Journal.Title")), _text(c("front.`journal-meta`.`journal-title-group`.`journal-title`")))
    made = {"meta_title": title, "meta_author": ascii_fold(author), "meta_year": F.nullif(year, F.lit("")), "meta_doi": F.lower(_first(ids, DOI)), "meta_journal": journal}
    return articles.withColumns(made).drop("MedlineCitation", "PubmedData", "front")
