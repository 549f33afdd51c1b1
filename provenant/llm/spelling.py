"""Spelling variants: words one edit apart, found by a pigeonhole join over evenly partitioned words.

A word of L code points is two segments, its first L // 2 points and the rest. One edit leaves one of them whole, so a
word of equal length shares a segment in its place, and one longer by a point shares the first in its place or the second
one point further right. An index of both segments by length is probed with these substrings. A list of the index that is
long is split by the same principle: the other segment is partitioned evenly again, and one of its halves is whole as
well. That ends at the latest where a single point is open, so no list grows with the input, and none is cut short.
Candidates are verified, and a pair found in two lists counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import column, cut, is_empty

RUN = "([A-Za-zÀ-ÿ]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many, by a hash of its document and itself, loses a code point; 0 for none.
SLIPS = 199
LEAST_POINTS, LEAST_COUNT = 6, 5
#: A form is at least so many times as frequent as its variant.
RATIO = 5
#: Lists of more rows are split, while more than one point is open.
LIST = 200


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int = SLIPS, least_points: int = LEAST_POINTS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n (long): how often each lower-cased run of letters occurs, of those that are long and frequent enough."""
    text = F.translate(F.coalesce(column(docs, text_col), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(column(docs, id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), 1)).alias("run"))
    if slips:
        # A run that is too short stays so when it loses a point.
        h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
        runs = runs.filter(F.length("run") >= least_points).withColumn("h", h)
        at = (F.col("h") % F.length("run")).cast("int")
        without = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
        runs = runs.select(F.when(F.col("h") % slips == 0, without).otherwise(F.col("run")).alias("word"))
    else:
        runs = runs.select(F.col("run").alias("word"))
    return runs.filter(F.length("word") >= least_points).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """rows (word, n, role, size, low, high) with key: what of the word lies outside the open points low to high of an indexed one of size points.

    In a probe longer by a point, one more is open. Different keys may have one hash: that only adds candidates.
    """
    c = F.col
    left = F.substring(c("word"), F.lit(1), c("low"))
    right = F.substring(c("word"), c("high") + c("role") + 1, c("size") - c("high"))
    return rows.withColumn("key", F.xxhash64("size", "low", "high", left, right))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice, with the first and with the second half of its open points."""
    mid = ((F.col("low") + F.col("high")) / 2).cast("int")
    open_ = F.explode(F.array(F.struct(F.col("low").alias("a"), mid.alias("b")), F.struct(mid.alias("a"), F.col("high").alias("b"))))
    return rows.select("word", "n", "role", "size", open_.alias("o")).select("word", "n", "role", "size", F.col("o.a").alias("low"), F.col("o.b").alias("high"))


def _lists(rows: DataFrame) -> DataFrame:
    """key, indexed and probes of the lists that may hold a pair."""
    size = rows.groupBy("key").agg(F.sum(F.when(F.col("role") == 0, 1).otherwise(0)).alias("indexed"), F.sum("role").cast("long").alias("probes"), F.max(F.col("high") - F.col("low")).alias("open"))
    return size.filter("indexed >= 2 or (indexed >= 1 and probes >= 1)")


def near_pairs(words: DataFrame, most: int = LIST) -> DataFrame:
    """a, n_a, b, n_b: each pair of different words exactly one inserted, deleted or replaced code point apart, once.

    words: word, n; a word is there once. Words under two code points are not compared.
    """
    c = F.col
    whole = words.filter(F.length("word") >= 2).select("word", "n")
    roles = F.explode(F.array(F.lit(0), F.lit(1)))  # indexed under its own length, and a probe of the words shorter by one
    rows = whole.select("word", "n", roles.alias("role")).withColumn("size", F.length("word") - c("role")).filter("size >= 2")
    rows = _halves(rows.withColumns({"low": F.lit(0), "high": c("size")}))
    ready = []
    while True:
        rows = cut(_keyed(rows), "segments")
        lists = cut(_lists(rows), "lists")
        long = (c("indexed") + c("probes") > most) & (c("open") > 1)
        ready.append(rows.join(lists.filter(~long).select("key"), "key", "left_semi"))
        split = lists.filter(long).select("key")
        if is_empty(split):
            break
        rows = _halves(rows.join(split, "key", "left_semi"))
    found = ready[0]
    for more in ready[1:]:
        found = found.unionByName(more)
    held = found.filter("role = 0").select("key", c("word").alias("a"), c("n").alias("n_a"))
    probes = found.select("key", c("role"), c("word").alias("b"), c("n").alias("n_b"))
    met = held.join(probes, (held["key"] == probes["key"]) & ((c("role") == 1) | (c("a") < c("b"))))
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").dropDuplicates(["a", "b"])


def roots(forms: DataFrame) -> DataFrame:
    """word and root: where following forms (word, form) ends. Each round doubles the steps that a row has gone.

    Forms must not go in circles; those of variants() can't, as each is more frequent than its variant.
    """
    now = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = cut(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if is_empty(stepped.filter("moved")):
            return stepped.select("word", "root")
        now = stepped.select("word", "root")


def grouped(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """variants() of given words: word and n, each word once."""
    c = F.col
    pairs = near_pairs(words)
    ways = F.explode(F.array(F.struct(c("a").alias("word"), c("n_a").alias("n"), c("b").alias("near"), c("n_b").alias("n_near")), F.struct(c("b").alias("word"), c("n_b").alias("n"), c("a").alias("near"), c("n_a").alias("n_near"))))
    each = pairs.select(ways.alias("w")).select("w.*")
    # The least by (-n, word) is the most frequent one, and of these the first in code-point order.
    near = each.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-c("n_near")).alias("m"), c("near").alias("form"))).alias("top"))
    whole = words.join(near, "word", "left")
    told = -c("top.m") >= ratio * c("n")
    whole = cut(whole.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(told, c("top.form")).alias("form"), F.when(told, -c("top.m")).alias("form_n")), "near")
    ends = roots(whole.filter("form is not null").select("word", "form"))
    return whole.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int = SLIPS, least_points: int = LEAST_POINTS, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """The words of all texts: word, form, root (string), n, n_near, form_n (long).

    Words are lower-cased runs of letters (only A to Z change) of at least least_points code points that occur at least
    least_count times. Two are near if exactly one code point is inserted, deleted or replaced. A word's form is its most
    frequent near word, ties by code-point order, if that is ratio times as frequent or more, else null; root is where
    forms lead, the word itself if it has none. With slips, a run loses a point where slips divides a hash of its id and
    itself. A null text has no words; a null id hashes as an empty one; repeated rows count each; an empty table, or one
    without such words, gives an empty one; other columns are ignored.
    """
    return grouped(cut(words_of(docs, id_col, text_col, slips, least_points, least_count), "words"), ratio)
