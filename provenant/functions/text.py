"""Text identity and grammar of quotes, edges and addresses, as column expressions; Arrow where Unicode needs it."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The grammar's literals.
ELLIPSIS = r"\[\s*\.\.\.\s*\]|\.\s\.\s\.|\.{3}|…"
EDGE_LABELS = ("Supports", "Rebuts", "Depends-on", "Refines", "Qualifies", "Restates", "Duplicate-of", "Supersedes")
MIN_SPAN = 25
MATH_GLYPHS = "κεǫλσςνμµδ∆θφϕψωρταβγ√∑∏∂ℏ⟨⟩∣∥×·∘≈∼≃≅≤≥≠≪≫∞⊗→∈±∓"
BIG_O = r"[Oo]\s*\(\s*[^)]*\)"

_KEPT = b"abcdefghijklmnopqrstuvwxyz0123456789"
_OTHERS = bytes(b for b in range(256) if b not in _KEPT)
_DIGITS = str.maketrans("", "", "0123456789")
_GLYPHS = str.maketrans("", "", MATH_GLYPHS)


def norm_text(text: str | None) -> str | None:
    if text is None:
        return None
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    return text.casefold().encode("ascii", "ignore").translate(None, _OTHERS).decode()


def norm_places(text: str) -> tuple[str, list[int]]:
    """The normalised text, and for each of its characters the place in text that it comes from."""
    made = [(c, i) for i, whole in enumerate(text) for c in (norm_text(whole) or "")]
    return "".join(c for c, _ in made), [i for _, i in made]


def letters_text(text: str) -> str:
    return norm_text(text).translate(_DIGITS)


def mathless_text(text: str) -> str:
    """Letters of a text without big-O terms and mathematical glyphs."""
    return letters_text(re.sub(BIG_O, " ", text).translate(_GLYPHS))


@F.pandas_udf(T.StringType())
def norm(text: pd.Series) -> pd.Series:
    """NFKD, case folding, then letters a-z and digits only. The general definition."""
    return text.map(norm_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def norm_digest(text: pd.Series) -> pd.Series:
    """SHA-256, in hex, of a text's normal form, which stays in the worker."""
    return text.map(lambda t: hashlib.sha256(norm_text(t).encode()).hexdigest(), na_action="ignore")


def norm_latin(text: Column) -> Column:
    """The same for Latin text with the accents of western European languages, inside the JVM."""
    return F.regexp_replace(F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"), "[^a-z0-9]", "")


def letters(normed: Column) -> Column:
    return F.regexp_replace(normed, "[0-9]", "")


@F.pandas_udf(T.StringType())
def mathless(text: pd.Series) -> pd.Series:
    return text.map(mathless_text, na_action="ignore")


def has_number(text: Column) -> Column:
    return text.rlike(r"(?U)\d")


def quote_text(line: Column) -> Column:
    """What a line that opens with a quotation mark quotes: up to its last mark, or to its end; null of a note."""
    body = F.regexp_replace(line, r"(?U)^\s*>\s*|\s+$", "")
    closed = F.regexp_extract(body, '(?s)^["“”](.*)["“”]', 1)
    return F.when(body.rlike('^["“”]'), F.when(body.rlike('(?s)^["“”].*["“”]'), closed).otherwise(F.substring(body, 2, 1 << 30)))


def spans(quote: Column) -> Column:
    """A quote's spans between ellipses, trimmed."""
    return F.transform(F.split(quote, ELLIPSIS), lambda x: F.trim(x))


def address(text: Column, default_key: Column | None = None) -> Column:
    """key:slug or slug, in lower case, as a struct; an empty key is the default."""
    low = F.lower(F.trim(text))
    key = F.when(F.instr(low, ":") > 0, F.nullif(F.trim(F.substring_index(low, ":", 1)), F.lit("")))
    slug = F.trim(F.when(F.instr(low, ":") > 0, F.regexp_replace(low, "^[^:]*:", "")).otherwise(low))
    return F.struct((F.coalesce(key, default_key) if default_key is not None else key).alias("key"), slug.alias("slug"))


def edge(line: Column) -> Column:
    """Label, target, grounding and record of an edge line; all null of other lines."""
    label = "|".join(EDGE_LABELS)
    pattern = rf"(?iU)^\s*\*\*({label}):\*\*\s+([\w-]+(?::[\w-]+)?)"
    kind = F.lower(F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")))
    get = lambda p, g=1: F.lower(F.nullif(F.regexp_extract(line, p, g), F.lit("")))
    return F.struct(kind.alias("type"), get(pattern, 2).alias("target"), get(pattern + r"\s*\(grounded by\s+#([\w-]+)\)", 3).alias("grounding"), F.when(kind.isNotNull(), get(r"(?iU)\[rec:\s*([\w-]+)\]")).alias("rec"))


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
