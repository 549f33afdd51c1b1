"""Personal data in whole texts, plain and disguised, by offsets in the source.

Plain identifiers are found by fixed patterns. Then three transducers rewrite the text, each keeping for every character
the source characters it stands for: homoglyphs become ASCII, spelled digits become digits, at/dot disguises become @
and a full stop. The same patterns run over the rewritten text, and what they find is mapped back to the source. A found
span is added if it holds a rewritten place and overlaps no other span of its kind. All patterns take time in proportion
to the text.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from provenant.llm.common import column, map_batches

KINDS = ("email", "ip", "card", "phone")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def plain_spans(text: str) -> list[Span]:
    """Leftmost spans of each kind that don't overlap; a match that fails its test is dropped."""
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append(Span("email", start, end))
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        found += [Span("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append(Span("card", *m.span()))
        if "+" in text:
            found += [Span("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return found


# Letters of other scripts that look like ASCII ones, number words, words for a full stop.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ո": "n", "ս": "u", "ց": "g", "ɡ": "g", "ɑ": "a", "ı": "i",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "｡": ".", "·": ".", " ": " ", " ": " ", " ": " ",
    "­": "", "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "",
}
_NUMBERS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_STOPS = ("dot", "punkt", "point", "punto")

_FLAGS = re.IGNORECASE
_NUMBER = "(?:" + "|".join(sorted(_NUMBERS, key=len, reverse=True)) + ")"
_ITEM = rf"(?:(?:{_NUMBER}|[0-9]++)(?!\w)|(?:{'|'.join(_STOPS)})(?=\W++(?:{_NUMBER}|[0-9]++)(?!\w)))"
#: Number words and digits in a row, two or more, with what separates them, however long that is; each stretch of it is read once or twice.
_SPELLED = re.compile(rf"(?<!\w)(?:plus\W++)?{_ITEM}(?:\W++{_ITEM})++", _FLAGS)
#: Least digits of an identifier.
_LEAST_DIGITS = 4
_TOKEN = re.compile(r"\w+|\+", _FLAGS)
#: Bracketed signs; white space around them goes too. They begin with the bracket, so runs of spaces are read once.
_AT = re.compile(r"[\[({<]\s*+(?:at|@)\s*+[\])}>]", _FLAGS)
_DOT = re.compile(rf"[\[({{<]\s*+(?:{'|'.join(_STOPS)}|\.)\s*+[\])}}>]", _FLAGS)
#: A name, the word at or a spaced @, and labels parted by the word dot or a full stop, the last of letters.
_SPACED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(\s++at\s++|\s*+@\s*+)[A-Za-z0-9-]+(?:(?:\s+dot\s+|\s*\.\s*)[A-Za-z0-9-]+)*(?:\s+dot\s+|\s*\.\s*)[A-Za-z]{2,}(?![A-Za-z0-9])", _FLAGS)
_LABEL_DOT = re.compile(r"\s+dot\s+|\s*\.\s*", _FLAGS)


class Mapped:
    """A text, and the start and end of the source characters that each of its characters stands for."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None, changed: np.ndarray | None = None):
        self.text = text
        self.starts = np.arange(len(text)) if starts is None else starts
        self.ends = self.starts + 1 if ends is None else ends
        self.changed = np.zeros(len(text), bool) if changed is None else changed

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """edits: start, end and new characters, in order and apart. Each new character stands for the whole edited place."""
        if not edits:
            return self
        lows, highs = (np.array([e[i] for e in edits], np.int64) for i in (0, 1))
        news = np.array([len(e[2]) for e in edits], np.int64)
        kept_from = np.concatenate(([0], highs))
        kept = np.concatenate((lows, [len(self.text)])) - kept_from
        # Stretches that stay and edited places take turns.
        sizes, firsts, lasts, is_new = (np.empty(2 * len(edits) + 1, np.int64) for _ in range(4))
        sizes[::2], sizes[1::2] = kept, news
        firsts[::2], firsts[1::2] = kept_from, lows
        lasts[::2], lasts[1::2] = 0, highs - 1
        is_new[::2], is_new[1::2] = 0, 1
        new = np.repeat(is_new, sizes).astype(bool)
        ends_at = np.cumsum(sizes)
        place = np.arange(ends_at[-1]) - np.repeat(ends_at - sizes, sizes)
        first = np.repeat(firsts, sizes) + np.where(new, 0, place)
        changed = self.changed[np.minimum(first, len(self.text) - 1)] & ~new | new
        gone = (news == 0) & (kept[:-1] > 0)  # nothing takes its place: the character before notes the change
        changed[ends_at[:-1:2][gone] - 1] = True
        texts, at = [], 0
        for low, high, put in edits:
            texts += (self.text[at:low], put)
            at = high
        texts.append(self.text[at:])
        return Mapped("".join(texts), self.starts[first], self.ends[np.where(new, np.repeat(lasts, sizes), first)], changed)

    def source(self, span: Span) -> tuple[Span, bool]:
        """The span's place in the source, and whether anything in it was rewritten."""
        return Span(span.kind, int(self.starts[span.start]), int(self.ends[span.end - 1])), bool(self.changed[span.start : span.end].any())


def _plain_of(c: str) -> str | None:
    """What a character becomes if it is disguised, else None."""
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    if c.isdecimal():
        return str(unicodedata.digit(c))
    new = unicodedata.normalize("NFKC", c)
    return new if new != c and new.isascii() and len(new) == 1 else None


_known: dict[str, str | None] = {}


def homoglyphs(m: Mapped) -> Mapped:
    """Letters that look like ASCII ones, wide and styled forms, other scripts' digits; characters without width go."""
    if m.text.isascii():
        return m
    for c in set(m.text):
        if c not in _known and c > "\x7f":
            _known[c] = _plain_of(c)
    odd = {c: _known[c] for c in set(m.text) if c > "\x7f" and _known[c] is not None}
    if not odd:
        return m
    # Most take one character's place.
    ones = {ord(c): new for c, new in odd.items() if len(new) == 1}
    points = np.frombuffer(m.text.encode("utf-32-le", "surrogatepass"), np.uint32)
    m = Mapped(m.text.translate(ones), m.starts, m.ends, m.changed | np.isin(points, list(ones)))
    rest = {c for c in odd if ord(c) not in ones}
    return m.rewritten([(i, i + 1, odd[c]) for i, c in enumerate(m.text) if c in rest]) if rest else m


def spelled_digits(m: Mapped, apart: bool = False) -> Mapped:
    """Runs of digits and number words, one at least, become digits; a leading plus becomes its sign, dot a full stop.

    What separates them goes; with apart, it stays between digits, and a full stop stays one.
    """
    edits = []
    for run in _SPELLED.finditer(m.text):
        found = list(_TOKEN.finditer(m.text, run.start(), run.end()))
        words = [t[0].lower() in _NUMBERS for t in found]
        if not any(words) or sum(words) < 2 and sum(len(t[0]) for t in found if t[0].isdecimal()) + 1 < _LEAST_DIGITS:
            continue
        last = None
        for token in found:
            word = token[0].lower()
            new = "+" if word in ("plus", "+") else "." if word in _STOPS else "".join(_NUMBERS.get(word, word))
            if last is not None and token.start() > last.end():
                between = m.text[last.end() : token.start()]
                stop = "." if apart and between.strip() == "." else ""
                if between != stop and not (apart and last[0].isdecimal() and token[0].isdecimal()):
                    edits.append((last.end(), token.start(), stop))
            if new != token[0]:
                edits.append((*token.span(), new))
            last = token
    return m.rewritten(edits)


def _bracketed(m: Mapped, sign: re.Pattern[str], new: str) -> Mapped:
    edits, at, text = [], 0, m.text
    for x in sign.finditer(text):
        a, b = x.span()
        while a > at and text[a - 1].isspace():
            a -= 1
        while b < len(text) and text[b].isspace():
            b += 1
        edits.append((a, b, new))
        at = b
    return m.rewritten(edits)


def at_and_dot(m: Mapped) -> Mapped:
    """Bracketed at and dot, then spaced or spelled ones within what would be an address."""
    low = m.text.lower()
    if any(x in low for x in "[({<"):
        m = _bracketed(_bracketed(m, _AT, "@"), _DOT, ".")
    if "@" not in m.text and "dot" not in low:
        return m
    edits = []
    for x in _SPACED.finditer(m.text):
        domain = m.text[x.end(1) : x.end()]
        spelled = " dot " in " ".join(domain.lower().split())
        # The word at is too common to be a sign unless dot is spelled as well.
        if "@" not in x[1] and not spelled:
            continue
        if x[1] != "@":
            edits.append((*x.span(1), "@"))
        edits += [(x.end(1) + d.start(), x.end(1) + d.end(), ".") for d in _LABEL_DOT.finditer(domain) if d[0] != "."]
    return m.rewritten(edits)


def find_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """Plain spans and added ones, each in order of start and then kind."""
    text = text or ""
    order = lambda s: (s.start, KINDS.index(s.kind))
    base = sorted(plain_spans(text), key=order)
    plain = homoglyphs(Mapped(text))
    close, apart = spelled_digits(plain), spelled_digits(plain, apart=True)
    added: list[Span] = []
    taken: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}  # spans of a kind, in order and apart
    for s in base:
        taken[s.kind].append((s.start, s.end))
    for m in map(at_and_dot, (close,) if close.text == apart.text else (close, apart)):
        if not m.changed.any():
            continue
        for span in plain_spans(m.text):
            at, rewritten = m.source(span)
            mine = taken[at.kind]
            i = bisect.bisect_left(mine, (at.start, at.end))
            if rewritten and not (i and mine[i - 1][1] > at.start) and not (i < len(mine) and mine[i][0] < at.end):
                mine.insert(i, (at.start, at.end))
                added.append(at)
    return base, sorted(added, key=order)


def render(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind))))


def redact(text: str | None) -> str | None:
    """The text with [KIND] in place of every span; overlapping spans are one place, named by the first."""
    if not text:
        return text
    base, added = find_spans(text)
    out, at = [], 0
    for s in sorted([*base, *added], key=lambda s: (s.start, KINDS.index(s.kind))):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone (long; plain spans), base_sha256, spans, n_added.

    spans lists plain and added ones as kind:start:end in code points, end exclusive; base_sha256 is the SHA-256 of the
    plain ones' list; n_added counts the others. A null text is an empty one, whose lists are empty strings. Repeated
    rows give repeated results; an empty table gives an empty one; other columns are ignored.
    """
    plain = docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).alias("text"))

    def rows(x):
        got = [find_spans(t) for t in x["text"]]
        made = {"doc_id": x["doc_id"]} | {f"n_{k}": [sum(s.kind == k for s in base) for base, _ in got] for k in KINDS}
        made["base_sha256"] = [hashlib.sha256(render(base).encode()).hexdigest() for base, _ in got]
        made["spans"] = [render(base + added) for base, added in got]
        made["n_added"] = [len(added) for _, added in got]
        return made

    return map_batches(plain, rows, f"doc_id {dict(plain.dtypes)['doc_id']}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(docs: DataFrame, text_col: str = "text", n_chars_col: str = "n_chars") -> DataFrame:
    """docs with personal data in text_col replaced, and n_chars_col, if there, counted anew. Null texts stay null."""
    kinds = dict(docs.dtypes)

    def rows(x):
        new = [redact(t) for t in x[text_col]]
        x = x | {text_col: new}
        if n_chars_col in x:
            x[n_chars_col] = [n if t is None else len(t) for n, t in zip(x[n_chars_col], new, strict=True)]
        return x

    return map_batches(docs, rows, ", ".join(f"`{c}` {kinds[c]}" for c in docs.columns))
