"""Language identification by hyperdimensional profiles.

Each letter has a random vector of signs. An n-gram's vector binds those of its letters: the vector of each is shifted
cyclically by its distance from the n-gram's end, and they are multiplied component by component. A text's vector
bundles, by addition, those of all its n-grams, and a language's prototype bundles the unit vectors of texts known to be
in it. A text has the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

import functools
import sys
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import bounded_batches, column, cut, held_out, map_batches, mix

#: Components of a vector, a multiple of 64, and letters of an n-gram, which fit in 63 bits.
DIMENSIONS, GRAM = 1024, 3
SEED = 12
#: Documents of one language that are learned from, in expectation: a bound on what is fitted, spread over all of them by a hash.
PER_LANGUAGE = 1000
#: Most values of lang that can be learned; more are refused, as their prototypes are sent to every task.
LANGUAGES = 4096
#: Code points of a text, texts and n-grams that are worked on at once.
BLOCK, AT_ONCE, SLICE = 1 << 18, 64, 4096
#: Unit vectors are added as integers of this scale, so that sums don't depend on their order.
SCALE = 1 << 24
NONE = "und"


@functools.cache
def _letters() -> np.ndarray:
    """By code point: the first of its lower case if it is a letter, else 0."""
    table = np.zeros(sys.maxunicode + 1, np.uint64)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            table[i] = ord(c.lower()[0])
    return table


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's different n-grams, 21 bits a letter, and how often each occurs.

    What isn't a letter parts words, and a word's ends are letters of their own, 0. A text without letters has no n-grams.
    """
    table, kept, counts = _letters(), [], []
    held = np.zeros(1, np.uint64)
    for at in range(0, len(text) + 1, BLOCK):
        part = table[np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "replace"), np.uint32)]
        codes = np.concatenate([held, part] if at + BLOCK <= len(text) else [held, part, np.zeros(1, np.uint64)])
        inside = np.ones(len(codes), bool)
        inside[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        codes = codes[inside]
        if len(codes) >= GRAM:
            end = len(codes) - GRAM + 1
            each = codes[:end].copy()
            for k in range(1, GRAM):
                each = (each << np.uint64(21)) | codes[k : end + k]
            found, n = np.unique(each, return_counts=True)
            kept.append(found)
            counts.append(n)
        held = codes[-(GRAM - 1) :]
    if not kept:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(kept) == 1:
        return kept[0], counts[0]
    found, place = np.unique(np.concatenate(kept), return_inverse=True)
    return found, np.bincount(place, np.concatenate(counts)).astype(np.int64)


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """Rows of -1 and 1, from a hash of the letter."""
    words = np.arange(DIMENSIONS // 64, dtype=np.uint64)
    with np.errstate(over="ignore"):
        bits = mix(mix(letters[:, None] * np.uint64(DIMENSIONS // 64) + words[None, :] + np.uint64(SEED << 40)))
    return np.unpackbits(bits.astype("<u8").view(np.uint8).reshape(len(letters), -1), axis=1).astype(np.int8) * 2 - 1


def gram_vectors(found: np.ndarray) -> np.ndarray:
    made = np.ones((len(found), DIMENSIONS), np.int8)
    for k in range(GRAM):
        letters, place = np.unique((found >> np.uint64(21 * k)) & np.uint64((1 << 21) - 1), return_inverse=True)
        made *= np.roll(letter_vectors(letters), k, axis=1)[place]
    return made


def text_vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A unit vector for each text, zero for one whose bundle is, and whether the text has a letter."""
    made = np.zeros((len(texts), DIMENSIONS))
    some = np.zeros(len(texts), bool)
    for first in range(0, len(texts), AT_ONCE):
        each = [grams(t or "") for t in texts[first : first + AT_ONCE]]
        some[first : first + AT_ONCE] = [len(found) > 0 for found, _ in each]
        known = np.unique(np.concatenate([found for found, _ in each]))
        # Sums of signs are exact in float32 below 2^24, so a text's vector doesn't depend on the texts beside it.
        kind = np.float32 if max((n.sum() for _, n in each), default=0) < 1 << 24 else np.float64
        for at in range(0, len(known), SLICE):
            part = known[at : at + SLICE]
            counts = np.zeros((len(each), len(part)), kind)
            for i, (found, n) in enumerate(each):
                a, b = np.searchsorted(found, part[0]), np.searchsorted(found, part[-1], side="right")
                counts[i, np.searchsorted(part, found[a:b])] = n[a:b]
            made[first : first + AT_ONCE] += counts @ gram_vectors(part).astype(kind)
    size = np.sqrt((made * made).sum(1))
    return made / np.where(size > 0, size, 1)[:, None], some


class Profiles(NamedTuple):
    """Languages, in code-point order, and their prototypes, unit vectors."""

    names: list[str]
    vectors: np.ndarray

    def closest(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Each text's language and its cosine, 0 at least; NONE and 0 without a letter or a language."""
        if not self.names:
            return [NONE] * len(texts), [0.0] * len(texts)
        made, some = text_vectors(texts)
        like = made @ self.vectors.T
        best = like.argmax(1)  # the first of equal ones
        score = np.clip(like[np.arange(len(texts)), best], 0, 1)
        return [self.names[k] if s else NONE for k, s in zip(best, some, strict=True)], [float(x) if s else 0.0 for x, s in zip(score, some, strict=True)]


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Profiles:
    """Prototypes from documents that have a language and aren't held out.

    Of a language with more than per_language of them, a hash of id and text picks about that many. Their vectors are added
    where they are made; the driver gets one for each language, of which there are at most LANGUAGES.
    """
    lang = column(docs, lang_col).cast("string")
    known = docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).alias("text"), lang.alias("lang")).filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = cut(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    if sizes.count() > LANGUAGES:
        raise ValueError(f"lang has more than {LANGUAGES} values")
    # At most LANGUAGES rows.
    picked = known.join(F.broadcast(sizes), "lang").filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < F.lit(float(1 << 40)) * per_language / F.col("n"))

    def rows(x):
        made, _ = text_vectors(x["text"])
        made = np.rint(made * SCALE).astype(np.int64)
        names = np.array(x["lang"], object)
        each = sorted(set(x["lang"]))
        return {"lang": each, "bundle": [made[names == k].sum(0).tolist() for k in each]}

    bundles = map_batches(picked.select("lang", "text"), rows, "lang string, bundle array<long>")
    total = bundles.select("lang", F.posexplode("bundle").alias("place", "x")).groupBy("lang", "place").agg(F.sum("x").alias("x"))
    found = total.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("v")).select("lang", F.col("v.x").alias("v"))
    got = {r["lang"]: np.array(r["v"], np.float64) for r in found.collect()}
    names = sorted(k for k, v in got.items() if v.any())
    vectors = np.array([got[k] / np.linalg.norm(got[k]) for k in names]).reshape(len(names), DIMENSIONS)
    return Profiles(names, vectors)


def identify(docs: DataFrame, found: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As language_id, with profiles that are given."""
    bounded_batches(docs.sparkSession)
    plain = docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).alias("text"))

    def rows(x):
        names, scores = found.closest(x["text"])
        return {"doc_id": x["doc_id"], "lang_pred": names, "score": scores}

    made = map_batches(plain, rows, f"doc_id {dict(plain.dtypes)['doc_id']}, lang_pred string, score double")
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The language of every text: doc_id, held_out (boolean), lang_pred (string), score (double, 0 to 1).

    Languages are learned from the table itself, from documents that aren't held out and whose lang is not null; a
    prediction depends on the text alone, and score is its cosine with the language's prototype, 0 at least. A null text,
    one without a letter, and every text where nothing was learned, is und with score 0. A null id is not held out. Of
    equal cosines the first language in code-point order counts. Whole texts are read, block by block. Repeated rows give
    repeated results; an empty table gives an empty one; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    return identify(docs, profiles(docs, id_col, text_col, lang_col), id_col, text_col)
