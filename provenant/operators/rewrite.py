"""Names in prose replaced by something else, such as links, the most specific name first.

Of all places where a name stands by itself, the longest names take theirs first, of equally long ones the first in
code-point order, and of one name the leftmost; a place that overlaps one that is taken counts for nothing. For names
whose ends are word characters, as those of claims are, that is what replacing name after name over the whole text gives,
without reading the text once for each name: every place is found in one pass. Where the names are few, by a checked size, they are one automaton that is broadcast. Else texts and names
meet by a join on the first words of a name, so no machine holds all names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions.automata import automaton

#: Most characters of names and their replacements that are broadcast. The automaton takes about 50 bytes a character in each worker.
BROADCAST_CHARS = 500_000
#: Words of a name that texts and names are joined by.
FIRST = 3
#: What a name that stands by itself has on neither side.
_INNER = re.compile(r"[\w:-]")
_WORDS = re.compile(r"[\w:-]+")
_BATCH = 500


def stands_alone(text: str, start: int, end: int) -> bool:
    return not (start and _INNER.match(text, start - 1)) and not _INNER.match(text, end)


def chosen(found: Iterable[tuple[int, str]]) -> list[tuple[int, str]]:
    """Of places (start, name), those that are replaced, in the order of the text."""
    taken: dict[int, str] = {}
    held: set[int] = set()
    for start, name in sorted(set(found), key=lambda f: (-len(f[1]), f[1], f[0])):
        span = range(start, start + len(name))
        if held.isdisjoint(span):
            taken[start] = name
            held.update(span)
    return sorted(taken.items())


def replaced(text: str, places: list[tuple[int, str]], to: dict[str, str]) -> str:
    parts, at = [], 0
    for start, name in places:
        parts += [text[at:start], to[name]]
        at = start + len(name)
    return "".join([*parts, text[at:]])


def rewrite(texts: DataFrame, names: DataFrame, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """text_id, text, n_replaced (long) of texts (text_id, text), with each name (names: name, replacement) replaced.

    A name stands by itself: no word character, colon or hyphen is next to it. Names are matched as they are written. Null
    and empty names, and those without a word character, are none; of repeated ones the least replacement counts, a null
    replacement is empty. A null text stays null, with none replaced. Repeated texts give repeated rows, an empty table of
    texts or names changes nothing; other columns are ignored.
    """
    used = names.select("name", F.coalesce("replacement", F.lit("")).alias("replacement")).filter(F.col("name").rlike(r"(?U)[\w:-]")).groupBy("name").agg(F.min("replacement").alias("replacement"))
    size = used.agg(F.coalesce(F.sum(F.length("name") + F.length("replacement")), F.lit(0)).alias("n"), F.coalesce(F.sum(F.xxhash64("name", "replacement").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("key")).first()
    plain = texts.select("text_id", "text")
    return _scanned(plain, used, size["key"]) if size["n"] <= broadcast_chars else _joined(plain, used)


def _schema(texts: DataFrame) -> str:
    return f"text_id {dict(texts.dtypes)['text_id']}, text string, n_replaced long"


def _scanned(texts: DataFrame, names: DataFrame, key: str) -> DataFrame:
    to = texts.sparkSession.sparkContext.broadcast({r["name"]: r["replacement"] for r in names.collect()})  # bounded by broadcast_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = automaton(f"names {key}", {name: name for name in to.value})
        for whole in batches:
            for at in range(0, whole.num_rows, _BATCH):
                batch = whole.slice(at, _BATCH)
                made, counts = [], []
                for text in batch.column(1).to_pylist():
                    found = [(end + 1 - len(name), name) for end, name in scan.iter(text) if stands_alone(text, end + 1 - len(name), end + 1)] if text and scan else []
                    places = chosen(found)
                    made.append(replaced(text, places, to.value) if places else text)
                    counts.append(len(places))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string()), pa.array(counts, pa.int64())], names=["text_id", "text", "n_replaced"])

    return texts.mapInArrow(run, _schema(texts))


def _first_words(text: str) -> Iterator[tuple[int, str]]:
    """Where each word starts, with the word, with the next one, and so on to FIRST."""
    words = [(m.start(), m[0]) for m in _WORDS.finditer(text)]
    for i, (start, _) in enumerate(words):
        for n in range(1, FIRST + 1):
            if i + n <= len(words):
                yield start, "\x1f".join(w for _, w in words[i : i + n])


def _joined(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Places are found by equal first words, gathered for each text, which holds no more of them than its length allows, and tested there."""

    @F.pandas_udf("struct<lead:int,key:string>")
    def opening(name):
        import pandas as pd

        each = [[(m.start(), m[0]) for m in _WORDS.finditer(n)][:FIRST] for n in name]
        return pd.DataFrame({"lead": [w[0][0] for w in each], "key": ["\x1f".join(x for _, x in w) for w in each]})

    keyed = names.withColumn("o", opening("name")).select("name", "replacement", F.col("o.lead").alias("lead"), F.xxhash64("o.key").alias("key"))
    own = texts.withColumns({"a": F.xxhash64("text_id", "text"), "b": F.xxhash64("text", "text_id", F.lit(1))})  # a row's content stands for it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                made = list(_first_words(text or ""))
                for at in range(0, len(made), 100_000):
                    part = made[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([a] * len(part), pa.int64()), pa.array([b] * len(part), pa.int64()), pa.array([s for s, _ in part], pa.int64()), pa.array([k for _, k in part], pa.string())], names=["a", "b", "start", "key"])

    words = own.select("a", "b", "text").mapInArrow(run, "a long, b long, start long, key string").withColumn("key", F.xxhash64("key"))
    met = words.join(keyed, "key").filter("start >= lead").select("a", "b", (F.col("start") - F.col("lead")).alias("start"), "name", "replacement").distinct()
    places = met.groupBy("a", "b").agg(F.collect_list(F.struct("start", "name", "replacement")).alias("places"))
    placed = own.join(places, ["a", "b"], "left").select("text_id", "text", "places")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, counts = [], []
            for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = [(p["start"], p["name"]) for p in places or [] if text.startswith(p["name"], p["start"]) and stands_alone(text, p["start"], p["start"] + len(p["name"]))]
                taken = chosen(found)
                made.append(replaced(text, taken, {p["name"]: p["replacement"] for p in places}) if taken else text)
                counts.append(len(taken))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string()), pa.array(counts, pa.int64())], names=["text_id", "text", "n_replaced"])

    return placed.mapInArrow(apply, _schema(texts))


def escaped(text: Column) -> Column:
    """A text as HTML shows it."""
    for c, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(c), F.lit(to))
    return text


def jump(name: Column, to: Column) -> Column:
    """A link to a node, that shows name."""
    return F.concat(F.lit('<a class="jump" data-goto="'), to, F.lit('">'), name, F.lit("</a>"))


def linked_records(texts: DataFrame, ids: DataFrame, prefix: str = "") -> DataFrame:
    """text_id, text of texts (text_id, text) with each marker [rec: id] of a known record (ids: id, in lower case) as a link.

    Markers of unknown records stay. Only the ids that texts name are looked up, and each text gets those that it names
    itself. A null text stays null; repeated texts give repeated rows.
    """
    marker = r"(?U)\[rec:\s*([\w-]+)\s*\]"
    named = F.array_distinct(F.regexp_extract_all("text", F.lit(marker), F.lit(1)))
    each = texts.select("text_id", "text", named.alias("named"), F.xxhash64("text_id", "text").alias("a"), F.xxhash64("text", "text_id", F.lit(1)).alias("b"))
    asked = each.select("a", "b", F.explode("named").alias("id")).distinct()
    known = asked.join(ids.select("id").distinct().withColumnRenamed("id", "low"), F.lower("id") == F.col("low"), "left_semi")
    mine = known.groupBy("a", "b").agg(F.array_sort(F.collect_list("id")).alias("known"))
    link = f"<a class=\"recref\" href=\"{prefix}assessments.html#rec-', id, '\">', id, '</a>"
    made = F.expr(f"aggregate(coalesce(known, cast(array() as array<string>)), text, (t, id) -> regexp_replace(t, concat('(?U)\\\\[rec:\\\\s*', id, '\\\\s*\\\\]'), concat('{link}')))")
    return each.join(mine, ["a", "b"], "left").select("text_id", made.alias("text"))
