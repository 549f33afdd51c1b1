"""Whether quotations occur in sources, under normalised text.

Many quotes in many texts: where the quotes are few enough, by a checked size, they become one automaton that is
broadcast, and each text is normalised and read once where it lies. Else containment is planned as an equality join:
windows of SEED characters of a quote at every STRIDE-th place of a text can't be missed by it, as any occurrence covers a
whole stride, so one of the quote's STRIDE first windows starts at a multiple of STRIDE; candidates are then tested.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.functions import text as X
from provenant.functions.automata import automaton
from provenant.sources.scratch import stored

SEED, STRIDE = 16, 8
#: Most characters of normalised quotes that are broadcast as one automaton, which takes about 50 bytes a character in each worker.
BROADCAST_CHARS = 1_000_000


def contained(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (quote_id, text_id) such that the text, normalised, contains the quote, normalised and not empty.

    quotes: quote_id, quote. texts: text_id, text; it may be a stream. Nulls contain nothing and are in nothing.
    """
    needles = stored(quotes.select("quote_id", X.norm("quote").alias("quote")).filter("quote <> ''"), "needles")  # normalised once
    size = needles.agg(F.coalesce(F.sum(F.length("quote") + 16), F.lit(0)).alias("n"), F.coalesce(F.sum(F.xxhash64("quote_id", "quote").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("key")).first()
    return _scanned(needles, texts, size["key"]) if size["n"] <= BROADCAST_CHARS else _joined(needles, texts)


def _scanned(needles: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    ids: dict[str, list] = {}
    for r in needles.collect():  # bounded by BROADCAST_CHARS
        ids.setdefault(r["quote"], []).append(r["quote_id"])
    owned = texts.sparkSession.sparkContext.broadcast(ids)
    kinds = {"quote_id": dict(needles.dtypes)["quote_id"], "text_id": dict(texts.dtypes)["text_id"]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = automaton(f"quotes {key}", owned.value)
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for text_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hit = {id(owners): owners for _, owners in scan.iter(X.norm_text(text))} if text and scan else {}
                for owners in hit.values():
                    found[0].extend(owners)
                    found[1].extend([text_id] * len(owners))
            yield pa.RecordBatch.from_arrays([pa.array(found[0], quote_type), pa.array(found[1], batch.schema.field(0).type)], names=["quote_id", "text_id"])

    from pyspark.sql.pandas.types import to_arrow_type

    quote_type = to_arrow_type(needles.schema["quote_id"].dataType)
    return texts.select("text_id", "text").mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()))


def _joined(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """Quotes shorter than a seed and a stride have seeds of their own length, at every place."""
    whole = texts.select("text_id", X.norm("text").alias("text"))
    window = lambda of, i, n: F.substring(of, i, F.lit(n))
    long_ = needles.filter(F.length("quote") >= SEED + STRIDE - 1)
    seeds = long_.select("quote_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(STRIDE)), lambda i: window("quote", i, SEED))).alias("seed"))
    places = whole.filter(F.length("text") >= SEED).select("text_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - SEED + 1, F.lit(STRIDE)), lambda i: window("text", i, SEED)))).alias("seed"))
    found = places.join(seeds, "seed").select("quote_id", "text_id").distinct()
    tested = found.join(needles, "quote_id").join(whole, "text_id").filter(F.contains("text", "quote")).select("quote_id", "text_id")
    short = needles.filter(F.length("quote") < SEED + STRIDE - 1).withColumn("n", F.length("quote"))
    sizes = short.select("n").distinct()  # fewer than SEED + STRIDE
    parts = whole.join(F.broadcast(sizes), F.length("text") >= F.col("n")).select("text_id", F.explode(F.expr("array_distinct(transform(sequence(1, length(text) - n + 1), i -> substring(text, i, n)))")).alias("quote"))
    return tested.unionByName(parts.join(short, "quote").select("quote_id", "text_id"))


def _goes_on(raw: str, at: int, step: int) -> bool:
    """Whether the number with its last digit at `at` has more digits in that direction, behind a separator or not."""
    near = raw[at + step : at + step + 1] if at + step >= 0 else ""
    beyond = raw[at + 2 * step : at + 2 * step + 1] if at + 2 * step >= 0 else ""
    return near.isdigit() or (near != "" and near in ".," and beyond.isdigit())


class Source:
    """A source's text in the forms that spans are looked up in, each made once."""

    def __init__(self, raw: str):
        self.raw = raw
        self.hay = X.norm_text(raw)
        self.letters, self.mathless = X.letters_text(raw), X.mathless_text(raw)
        self._places: list[int] | None = None

    def has(self, needle: str) -> bool:
        """A number at either end of needle must be a whole one in the source."""
        first, last = needle[0].isdigit(), needle[-1].isdigit()
        at = self.hay.find(needle)
        if at < 0 or not (first or last):
            return at >= 0
        if self._places is None:
            self._places = X.norm_places(self.raw)[1]
        while at >= 0:
            cut = first and _goes_on(self.raw, self._places[at], -1) or last and _goes_on(self.raw, self._places[at + len(needle) - 1], 1)
            if not cut:
                return True
            at = self.hay.find(needle, at + 1)
        return False

    def verdict(self, span: str) -> str:
        """The ladder: empty, short ones skipped if present, exact, and for spans without digits letters only, then without formulas."""
        needle = X.norm_text(span)
        if not needle:
            return "EMPTY"
        found = self.has(needle)
        if len(needle) < X.MIN_SPAN:
            return "SKIP" if found else "FAIL"
        if found:
            return "PASS"
        if re.search(r"\d", span):
            return "FAIL"
        if X.letters_text(span) in self.letters:
            return "PASS*"
        plain = X.mathless_text(span)
        return "PASS~" if plain and plain in self.mathless else "FAIL"


@F.pandas_udf(T.ArrayType(T.StringType()))
def verdicts(source: pd.Series, spans: pd.Series) -> pd.Series:
    """A verdict for each span of a row in the row's source; null without a source."""

    def row(raw, each):
        if raw is None or each is None:
            return None
        of = Source(raw)
        return [of.verdict(s or "") for s in each]

    return pd.Series([row(r, s) for r, s in zip(source, spans, strict=True)], dtype=object)


def check_spans(spans: DataFrame) -> DataFrame:
    """Adds verdict to rows of a span and its own source: span, source (both raw)."""
    return spans.withColumn("verdict", F.get(verdicts("source", F.array("span")), F.lit(0)))


def tally(checked: DataFrame, *by: str) -> DataFrame:
    return checked.groupBy(*by).agg(*(F.count_if(F.col("verdict") == v).alias(n) for v, n in (("PASS", "passed"), ("PASS*", "passed_letters"), ("PASS~", "passed_mathless"), ("FAIL", "failed"), ("SKIP", "skipped"))))


def quoted_spans(files: DataFrame) -> DataFrame:
    """key, text as of files with quotes (array), n_notes: quoted lines that quote and that only note.

    A line's quote is what quote_text says; lines with nothing after the mark count as neither.
    """
    lines = F.filter(F.split("text", r"\R"), lambda x: x.rlike(r"(?U)^\s*>\s*\S"))
    quotes = F.transform(lines, X.quote_text)
    return files.select("key", F.filter(quotes, lambda q: q.isNotNull()).alias("quotes"), F.size(F.filter(quotes, lambda q: q.isNull())).alias("n_notes"))


def check_files(files: DataFrame, extracts: DataFrame) -> DataFrame:
    """A row for each claim file: key, passed, passed_letters, passed_mathless, failed, skipped, n_notes, verdict.

    files: key, text. extracts: key, extract, one a key. A quote none of whose spans passes or fails is a failure, as is a
    file without quotes or without an extract; a file passes if nothing failed.
    """
    each = quoted_spans(files.select("key", F.coalesce("text", F.lit("")).alias("text"))).join(extracts.select("key", "extract"), "key", "left")
    each = each.withColumn("parts", F.transform("quotes", lambda q: F.split(q, X.ELLIPSIS)))
    each = each.withColumn("found", verdicts(F.col("extract"), F.flatten("parts")))
    # The verdicts of a quote are those at its spans' places in the flat list.
    ends = F.expr("transform(sequence(1, greatest(size(parts), 1)), i -> aggregate(slice(parts, 1, i), 0, (a, x) -> a + size(x)))")
    each = each.withColumn("ends", F.when(F.size("parts") > 0, ends).otherwise(F.array().cast("array<int>")))
    each = each.withColumn("by_quote", F.expr("transform(parts, (p, i) -> slice(found, ends[i] - size(p) + 1, size(p)))"))
    idle = F.size(F.filter("by_quote", lambda v: ~F.exists(v, lambda x: x.startswith("PASS") | (x == "FAIL"))))
    count = lambda v: F.size(F.filter("found", lambda x: x == v))
    none = F.col("extract").isNull()
    failed = F.when(none, 1).when(F.size("quotes") == 0, 1).otherwise(count("FAIL") + idle)
    zero = lambda c: F.when(none, 0).otherwise(c).cast("long")
    made = each.select("key", zero(count("PASS")).alias("passed"), zero(count("PASS*")).alias("passed_letters"), zero(count("PASS~")).alias("passed_mathless"), failed.cast("long").alias("failed"), zero(count("SKIP")).alias("skipped"), zero(F.col("n_notes")).alias("n_notes"))
    return made.withColumn("verdict", F.when(F.col("failed") > 0, "fail").otherwise("pass"))
