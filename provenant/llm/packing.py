"""Best-fit decreasing packing of tokenised documents into sequences.

Lengths are whole numbers up to the capacity, so what best-fit decreasing does depends on how many pieces have each
length, and on nothing else about them. The driver packs those counts: a segment tree over remaining capacities finds the
tightest open bin in logarithmic time, and bins that are in the same state are handled together. The plan has a bounded
number of rows whatever the corpus. Pieces of one length are then numbered, in salted groups whose sizes are summed, and
each number looks up its bin and offset in the plan. Pieces that fill a sequence, which nearly all of long documents do,
need no number: each is a sequence of its own, named after its row.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from provenant.llm.common import bounded_batches, column, cut, map_batches

CAPACITY = 2048
END = 0
#: Pieces of one length that are numbered in one group, on average: a length has as many groups as that takes.
NUMBERED = 50_000
#: Words that a worker remembers the ids of; beyond it, it starts anew.
REMEMBERED = 500_000


#: A comma or full stop after a letter, in lower case; to the tokenizer it begins a word of its own.
_MARK = re.compile("[.,](?<=[a-z\xdf-\xf6\xf8-\xff].)")


def _parted(text: str | None) -> list[str]:
    """A text's pieces between spaces and line feeds; of Latin letters alone, in lower case and with marks parted."""
    text = text or ""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:  # other letters have lower cases of their own
        return text.replace("\n", " ").split(" ")
    return _MARK.sub(r" \g<0>", text.lower()).replace("\n", " ").split(" ")


class WordIds:
    """Token ids, as little-endian 32-bit bytes, of a text by a tokenizer that never joins what white space parts.

    Texts are cut at spaces and line feeds and the pieces' ids remembered. What is new of plain letters is encoded many
    words at a time, parted by the ends of words in the ids; anything else is encoded by itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
            self.known[""] = b""
        known, plain, tails = self.known, set(), []
        for w in words:
            core = w.rstrip(".,") if w[-1] in ".," else w
            low = core.lower()
            # Letters below this bound have the same lower case here and there; marks are encoded as the run they are.
            if core.isalpha() and (core.isascii() or (max(core) < "\u0250" and "\u0130" not in core)):
                if low not in known:
                    plain.add(low)
                if low != w:
                    tails.append((w, low, w[len(core) :]))
            else:
                known[w] = self._encode(w)
        fresh = list(plain)
        parts = [fresh[i : i + 500] for i in range(0, len(fresh), 500)]
        for part, found in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                data, at = ids.tobytes(), 0
                for w, end in zip(part, (cuts * 4).tolist(), strict=True):
                    known[w] = data[at:end]
                    at = end
            else:  # some word is more than one word to the tokenizer
                for w in part:
                    known[w] = self._encode(w)
        for w, low, mark in tails:
            if mark and mark not in known:
                known[mark] = self._encode(mark)
            known[w] = known[low] + (known[mark] if mark else b"")

    def ids(self, texts: list[str | None]) -> list[bytes]:
        parted = [_parted(t) for t in texts]
        known = self.known
        new = {w for words in parted for w in words if w not in known}
        if new:
            before = len(known)
            self._learn(new)
            if len(known) < before + len(new) and (lost := {w for words in parted for w in words if w not in known}):
                self._learn(lost)
        return [b"".join([known[w] for w in words]) for words in parted]


_tokenizers: dict[str, WordIds] = {}


def _word_ids(path: str) -> WordIds:
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document; at least one piece each."""
    plain = docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).alias("text"))
    end = np.array([END], "<u4").tobytes()

    def rows(x):
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for lo in range(0, len(x["text"]), 64):
            for i, ids in enumerate(_word_ids(tokenizer_path).ids(x["text"][lo : lo + 64]), lo):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for name, v in zip(out, (x["doc_id"][i], k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        out[name].append(v)
        return out

    return map_batches(plain, rows, f"doc_id {dict(plain.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")


class Tightest:
    """A segment tree over remaining capacities 0 to capacity: which have open bins, and the least at or above a need."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, remaining: int, open_: bool) -> None:
        i = self.size + remaining
        self.any[i] = open_
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def at_least(self, need: int) -> int | None:
        i = self.size + need
        if self.any[i]:
            return need
        while i > 1:  # up to the first right neighbour with an open bin, then down its left edge
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """The plan: length, first number, first bin, pieces to a bin, offset, ordered by length and number.

    Piece k of a length, from its row's first number on, goes to bin `first + (k - number) // to_a_bin`, at the row's
    offset plus `length * ((k - number) % to_a_bin)`. Each bin takes pieces while they fit, as the tightest open bin stays
    the tightest when it has taken one more of the same length.
    """
    tree, runs, plan, bins = Tightest(capacity), {}, [], 0
    for length in sorted(counts, reverse=True):
        left, number = counts[length], 0
        while left:
            room = tree.at_least(length)
            if room is None:  # new bins for all that is left
                to_a_bin = capacity // length
                first, many, room = bins, -(-left // to_a_bin), capacity
                bins += many
            else:
                first, many = runs[room].pop()
                if not runs[room]:
                    tree.set(room, False)
                to_a_bin = room // length
            full, rest = divmod(min(left, many * to_a_bin), to_a_bin)
            plan.append((length, number, first, to_a_bin, capacity - room))
            number += full * to_a_bin + rest
            left -= full * to_a_bin + rest
            for start, n, now in ((first, full, room - to_a_bin * length), (first + full, 1 if rest else 0, room - rest * length), (first + full + bool(rest), many - full - bool(rest), room)):
                if n and now:
                    runs.setdefault(now, []).append((start, n))
                    tree.set(now, True)
    return sorted(plan)


def best_fit_packing(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: doc_id, piece (int), start, length, ids_crc32, sequence_id, offset (long).

    A document's ids are those of its text, END last; null texts are empty and give END alone. Documents of more than
    capacity ids are cut into pieces of capacity ids, the last of what is left. Pieces of a sequence lie without gaps from
    0. Equal lengths are ordered by a hash of id and piece, so results don't depend on partitions; repeated rows are packed
    each, in any order. An empty table gives an empty result; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    made = cut(pieces(docs, tokenizer_path, id_col, text_col, capacity), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # At most capacity rows, whatever the corpus.
    counts = {r["length"]: r["n"] for r in made.filter(F.col("length") < capacity).groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = F.lit([-(-counts.get(n, 0) // NUMBERED) or 1 for n in range(capacity)]).cast("array<int>")
    loose = made.filter(F.col("length") < capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.get(salts, F.col("length").cast("int"))).cast("int"))
    # A row for each length and NUMBERED pieces of it.
    sums = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = cut(loose.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(sums), F.lit(0))), "numbers")
    plan = best_fit_decreasing(counts, capacity)
    planned = [np.array(c, np.int64) for c in zip(*plan, strict=True)] if plan else [np.zeros(0, np.int64)] * 5
    order = Window.partitionBy("length", "salt").orderBy(F.xxhash64("doc_id", "piece"), "doc_id", "piece")
    numbered = loose.withColumn("rank", F.row_number().over(order)).join(before, ["length", "salt"]).withColumn("number", F.col("before") + F.col("rank") - 1).select(*columns, "number")
    shift = int(planned[1].max()) + 1 if plan else 1
    bins = sum(counts.values())  # no more than that

    def rows(x):
        length, number, first, to_a_bin, offset = planned
        of, k = np.array(x["length"], np.int64), np.array(x.pop("number"), np.int64)
        at = np.searchsorted(length * shift + number, of * shift + np.minimum(k, shift - 1), side="right") - 1
        k = k - number[at]
        return x | {"sequence_id": (first[at] + k // to_a_bin[at]).tolist(), "offset": (offset[at] + of * (k % to_a_bin[at])).tolist()}

    placed = map_batches(numbered, rows, f"doc_id {dict(made.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    # The stored table's rows have places that a task finds again when it is repeated.
    full = made.filter(F.col("length") == capacity).select(*columns, (F.monotonically_increasing_id() + bins).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)
