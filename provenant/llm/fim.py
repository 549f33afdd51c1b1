"""Fill-in-middle: a text cut in three, its parts put in another order around sentinels, cut places found by a sparse scan.

One Aho-Corasick automaton passes over a text once and reports only events: ASCII characters at which the class of units
changes (white space, or line feeds) and sentinels. What lies between two events is one gap, whose units follow by
arithmetic from its length: as many as it has code points, one word, or none. Sums over events and gaps give the number
of units, and the place of the k-th by a binary search among them, so nothing is kept for each character.
"""

from __future__ import annotations

import functools
import hashlib
from typing import NamedTuple

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import bounded_batches, column, map_batches

SENTINELS = ("<P>", "<S>", "<M>")
#: ASCII characters at which units change class. A code point is a unit whatever its class, so words are counted beside it.
SPACE = " \t\n\x0b\x0c\r"
BREAKS = {"point": SPACE, "word": SPACE, "line": "\n"}
#: Of a hundred texts, so many are rearranged, and of a hundred of those so many have their suffix first.
RATE, SUFFIX_FIRST = 90, 20
SEED = 1


@functools.lru_cache(maxsize=16)
def automaton(breaks: str, sentinels: tuple[str, ...]) -> ahocorasick.Automaton:
    """Reports False for a break and True for a sentinel, each at its last code point."""
    if not sentinels or not all(sentinels) or any(c in s for s in sentinels for c in breaks):
        raise ValueError("sentinels are not empty and hold no white space")
    made = ahocorasick.Automaton()
    for c in breaks:
        made.add_word(c, False)
    for s in sentinels:
        made.add_word(s, True)
    made.make_automaton()
    return made


class Scan(NamedTuple):
    """Places of breaks, whether a sentinel occurs, and the text's length, all that is needed of a text."""

    breaks: np.ndarray
    marked: bool
    length: int

    def words(self) -> np.ndarray:
        """Where words start: behind breaks, and at the text's start, but not at a break."""
        ends = self.breaks
        after = ends[:-1][np.diff(ends) > 1] + 1 if len(ends) else ends
        last = ends[-1:] + 1
        first = np.zeros(int(self.length > 0 and (not len(ends) or ends[0] > 0)), np.int64)
        return np.concatenate([first, after, last[last < self.length]])

    def starts(self, unit: str) -> np.ndarray | None:
        """Where units start; None for code points, whose k-th starts at k."""
        if unit == "point":
            return None
        if unit == "line":
            after = np.concatenate([np.zeros(1, np.int64), self.breaks + 1])
            return after[after < self.length]
        ends = self.breaks
        spaces = ends[np.diff(ends, prepend=-2) > 1]  # a run of white space is a unit, as a word is
        return np.sort(np.concatenate([self.words(), spaces]))


def scan(text: str, breaks: str = SPACE, sentinels: tuple[str, ...] = SENTINELS) -> Scan:
    places, marked = [], False
    for end, sentinel in automaton(breaks, sentinels).iter(text):
        if sentinel:
            marked = True
        else:
            places.append(end)
    return Scan(np.array(places, np.int64), marked, len(text))


class Cut(NamedTuple):
    n: int
    form: str
    first: int
    second: int
    prefix_words: int
    middle_words: int


def draws(doc_id: object, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from a document's id; of a null id those of an empty one."""
    made = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(made[i : i + 8], 16) for i in (0, 8, 16, 24))


def cut_of(doc_id: object, text: str, unit: str = "point", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, ...] = SENTINELS, seed: int = SEED) -> Cut:
    """Where a text is cut, in code points, and in which order its parts come."""
    found = scan(text, BREAKS[unit], sentinels)
    starts = found.starts(unit)
    n = found.length if starts is None else len(starts)
    a, b, c, d = draws(doc_id, seed)
    if not text or found.marked or c % 100 >= rate:
        return Cut(n, "plain", 0, 0, 0, 0)
    first, second = sorted((a % (n + 1), b % (n + 1)))
    if starts is not None:
        first, second = (found.length if k == n else int(starts[k]) for k in (first, second))
    words = found.words() if unit != "line" else scan(text, SPACE, sentinels).words()
    before, until = np.searchsorted(words, (first, second))
    return Cut(n, "spm" if d % 100 < suffix_first else "psm", first, second, int(before), int(until - before))


def rearranged(text: str, at: Cut, sentinels: tuple[str, ...] = SENTINELS) -> str:
    if at.form == "plain":
        return text
    p, s, m = sentinels
    prefix, middle, suffix = text[: at.first], text[at.first : at.second], text[at.second :]
    return f"{p}{prefix}{s}{suffix}{m}{middle}" if at.form == "psm" else f"{s}{suffix}{p}{prefix}{m}{middle}"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "point", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, ...] = SENTINELS, seed: int = SEED) -> DataFrame:
    """Each text rearranged: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, prefix_words, middle_words and output.

    unit: point (code points), word (runs of white space and of other characters) or line. Cuts lie between units; chars
    are code points, words are runs without ASCII white space that start in the part, and all four are null for plain
    texts: empty ones, those that hold a sentinel, and those that the draw leaves as they are. A null text is an empty
    one, and a null id draws as an empty one does. Draws depend on the id alone, so repeated rows give repeated results;
    an empty table gives an empty one; other columns are ignored. Each text is worked on whole, in the task that reads it.
    """
    if unit not in BREAKS or len(sentinels) != 3:
        raise ValueError(f"unit is one of {', '.join(BREAKS)}, and there are three sentinels")
    automaton(BREAKS[unit], tuple(sentinels))
    bounded_batches(docs.sparkSession)
    plain = docs.select(column(docs, id_col).alias("doc_id"), F.coalesce(column(docs, text_col), F.lit("")).alias("text"))

    def rows(x):
        cuts = [cut_of(i, t, unit, rate, suffix_first, tuple(sentinels), seed) for i, t in zip(x["doc_id"], x["text"], strict=True)]
        told = [c.form != "plain" for c in cuts]
        return {
            "doc_id": x["doc_id"],
            "n": [c.n for c in cuts],
            "form": [c.form for c in cuts],
            "prefix_chars": [c.first if k else None for c, k in zip(cuts, told, strict=True)],
            "middle_chars": [c.second - c.first if k else None for c, k in zip(cuts, told, strict=True)],
            "prefix_words": [c.prefix_words if k else None for c, k in zip(cuts, told, strict=True)],
            "middle_words": [c.middle_words if k else None for c, k in zip(cuts, told, strict=True)],
            "output": [rearranged(t, c, tuple(sentinels)) for t, c in zip(x["text"], cuts, strict=True)],
        }

    return map_batches(plain, rows, f"doc_id {dict(plain.dtypes)['doc_id']}, n long, form string, prefix_chars long, middle_chars long, prefix_words long, middle_words long, output string")


def restored(output, form, sentinels: tuple[str, ...] = SENTINELS):
    """The text that a rearranged one was made of, as an expression of the columns output and form.

    A rearranged text holds each sentinel once, as texts with a sentinel stay plain and none can arise where parts meet.
    """
    p, s, m = sentinels
    first, second = (F.when(form == "psm", F.lit(x)).otherwise(F.lit(y)) for x, y in ((p, s), (s, p)))
    one = F.length(first) + 1
    at = F.locate(s, output, 1)
    at = F.when(form == "psm", at).otherwise(F.locate(p, output, 1))
    end = F.locate(m, output, 1)
    a = F.substring(output, one, at - one)
    b = F.substring(output, at + F.length(second), end - at - F.length(second))
    middle = F.substring(output, end + len(m), F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(a, middle, b)).otherwise(F.concat(b, middle, a))


def digests(made: DataFrame, sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """fill_in_middle's columns with SHA-256 digests of its output, and of the text rebuilt from that, in the output's place."""
    back = restored(F.col("output"), F.col("form"), sentinels)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"), "prefix_words", "middle_words")
