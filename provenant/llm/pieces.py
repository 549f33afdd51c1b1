"""Encoding and decoding with a SentencePiece model of byte-pair merges, chunk by chunk, by a max-plus scan.

A sequence of pieces is what the model's merges give if and only if that is so of every two neighbours in it. So encoding
is a best path: a transition between two pieces weighs 0 if merging their joined characters gives just these two, and
minus infinity if not, and exactly one path through a text has weight 0.

Texts of more than CHUNK characters are split. The state at a boundary is the piece that covers it. Each chunk yields a
matrix of the best path's weight from each state at its start to each at its end, whatever its neighbours are; matrices
are combined by the associative max-plus product, in order, which gives the state at every boundary; then each chunk is
traced back by itself between its two states. A text of one chunk has no inner boundary and one path.

No piece joins another character to a following space mark, so between such places a chunk's path doesn't depend on its
states: the matrix has a single column of states there, and the library encodes all between the first and the last at once.
The text's own start and end are such places too.

Decoding is split as well. Ids are cut where no character's bytes go on; the state at a boundary is whether the library
would still take a space mark for the text's own first one. Chunks yield matrices of these two states, and each is then
decoded by itself in the state it begins in.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import bounded_batches, column, cut, map_batches

CHUNK = 16384
SPACE = "▁"
NO = -np.inf
#: (start, end, id): a piece's place by characters from the text's start, and its id; -1 for a character without a piece.
State = tuple[int, int, int]


class Model:
    """A model's pieces, and what its merges make of short texts."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        plain = [i for i in range(n) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))]
        self.ids = {self.sp.id_to_piece(i): i for i in plain}
        self.score = {p: self.sp.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.bytes = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece joins a character to a following space mark")
        self._fits: dict[tuple[str, str], bool] = {}
        #: What each id stands for as a byte, -1 of other ids; an id of plain letters, and one with a space mark before them.
        self.byte = np.full(n, -1, np.int16)
        for value, i in enumerate(self.bytes):
            if self.sp.is_byte(i):
                self.byte[i] = value
        self.letters = next((i for p, i in self.ids.items() if p.isalpha() and SPACE not in p), None)
        self.spaced = next((i for p, i in self.ids.items() if p[0] == SPACE and p[1:].isalpha()), None)

    def merged(self, text: str) -> list[str]:
        """Best merge first, leftmost of equal ones, until none is left."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, a: str, b: str) -> bool:
        got = self._fits.get((a, b))
        if got is None:
            if len(self._fits) > 200_000:
                self._fits.clear()
            got = self._fits[a, b] = self.merged(a + b) == [a, b]
        return got

    def ids_of(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.bytes[b] for b in piece.encode("utf-8", "replace")]

    def pieces_at(self, text: str, i: int, limit: int) -> Iterator[tuple[int, int]]:
        """Ends and ids of pieces that start at i; a character without a piece stands alone."""
        found = False
        for end in range(i + 1, min(len(text), i + self.longest, limit) + 1):
            p = self.ids.get(text[i:end])
            if p is not None:
                found = found or end == i + 1
                yield end, p
        if not found:
            yield i + 1, -1

    def encode_between(self, text: str) -> list[int]:
        """Ids of marked text that begins with a space mark, which the library's own prefix stands for; it puts none before nothing."""
        return self.ids_of(SPACE) if text == SPACE else self.sp.encode(text[1:].replace(SPACE, " "))


@functools.lru_cache(maxsize=4)
def model(path: str) -> Model:
    return Model(path)


def marked(text: str | None) -> str:
    """The text as the merges see it: a space mark before it and in place of spaces; of an empty text nothing."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def states_at(m: Model, text: str, x: int, offset: int = 0) -> list[State]:
    """Pieces that could cover the boundary x of the text: they start before it and end at or after it."""
    found = []
    for start in range(max(0, x - m.longest), x):
        found += [(start + offset, end + offset, p) for end, p in m.pieces_at(text, start, len(text)) if end >= x]
    return sorted(found)


_FORCED = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")


def _paths(m: Model, text: str, starts: list[State | None], stop: int) -> dict[State | None, dict[State, State | None]]:
    """From each start, the pieces that some path of weight 0 reaches up to stop, each with one before it.

    A piece that ends at or after stop ends its path. None starts at the text's beginning.
    """
    out: dict[State | None, dict[State, State | None]] = {}
    for start in starts:
        came: dict[State, State | None] = {}
        ends: dict[int, list[State | None]] = {0 if start is None else start[1]: [start]}
        for i in range(min(ends), stop):
            for before in ends.pop(i, []):
                left = None if before is None else text[before[0] : before[1]]
                for end, p in m.pieces_at(text, i, len(text)):
                    now = (i, end, p)
                    if now not in came and (left is None or m.fits(left, text[i:end])):
                        came[now] = before
                        if end < stop:
                            ends.setdefault(end, []).append(now)
        out[start] = came
    return out


def _trace(came: dict[State, State | None], last: State | None, start: State | None) -> list[State]:
    path = []
    while last is not None and last != start:
        path.append(last)
        last = came[last]
    return path[::-1]


class Chunk:
    """Marked text from a to b of a text of n characters, with so much around it as pieces across its ends need."""

    def __init__(self, m: Model, around: str, offset: int, a: int, b: int, n: int):
        """around: the text from offset on."""
        self.m, self.text, self.offset, self.a, self.b, self.n = m, around, offset, a - offset, b - offset, n
        self.first: list[State | None] = [None] if a == 0 else list(states_at(m, around, self.a))
        self.last: list[State | None] = [None] if b == n else list(states_at(m, around, self.b))
        # The first and the last forced end of a piece in the chunk, the text's start and end included, that no piece across the chunk's ends can touch.
        self.lo: int | None = None
        self.hi: int | None = None
        if a == 0:
            self.lo = 0
        elif (found := _FORCED.search(around, self.a + 1, self.b + 1)) and found.start() < self.b:
            self.lo = found.start()
        if b == n:
            self.hi = self.b
            self.lo = self.hi if self.lo is None else self.lo
        elif self.lo is not None:
            self.hi = self.b
            while self.hi > self.lo:
                self.hi = max(around.rfind(SPACE, self.lo, self.hi), self.lo)
                if around[self.hi - 1 : self.hi] != SPACE:
                    break

    def _ends_at(self, came: dict[State, State | None], start: State | None, end: int) -> State | None:
        """The piece that ends at a forced end, reached from start."""
        if start is not None and start[1] == end:
            return start
        return next((s for s in sorted(came) if s[1] == end), None)

    def head(self, start: State | None) -> tuple[bool, list[State]]:
        """Whether a path leads from start to the first forced end, and its pieces."""
        if start is None and self.a == 0 and self.offset == 0 and self.lo == 0:
            return True, []
        if start is not None and start[1] > self.lo:
            return False, []
        came = _paths(self.m, self.text[: self.lo], [start], self.lo)[start]
        last = self._ends_at(came, start, self.lo)
        return last is not None, _trace(came, last, start) if last is not None else []

    def tail(self) -> dict[State, State | None]:
        """Paths from the last forced end over the chunk's end; none where that is the text's end."""
        if self.hi == len(self.text):
            return {}
        piece: dict[State, State | None] = {}
        shifted = _paths(self.m, self.text[self.hi :], [None], self.b - self.hi)[None]
        move = lambda s: None if s is None else (s[0] + self.hi, s[1] + self.hi, s[2])
        for s, before in shifted.items():
            piece[move(s)] = move(before)
        return piece

    def matrix(self) -> np.ndarray:
        """Weights of the best paths from each first state to each last one."""
        got = np.full((len(self.first), len(self.last)), NO)
        if self.lo is not None:
            to = self.tail()
            rows = np.array([0.0 if self.head(s)[0] else NO for s in self.first])
            ends = [0.0 if t is None or t in to else NO for t in self.last]
            return rows[:, None] + np.array(ends)[None, :]
        for i, s in enumerate(self.first):
            came = _paths(self.m, self.text, [s], self.b)[s] if s is None or s[1] < self.b else {}
            for j, t in enumerate(self.last):
                if (t == s and s is not None) or t in came or (t is None and (any(x[1] == len(self.text) for x in came) or (s is not None and s[1] == len(self.text)))):
                    got[i, j] = 0.0
        return got

    def ids(self, i: int, j: int) -> list[int]:
        """Ids of the pieces after first state i, up to and with last state j."""
        s, t = self.first[i], self.last[j]
        flat = lambda path: [x for p in path for x in self.m.ids_of(self.text[p[0] : p[1]])]
        if self.lo is not None:
            middle = self.m.encode_between(self.text[self.lo : self.hi]) if self.hi > self.lo else []
            return flat(self.head(s)[1]) + middle + flat(_trace(self.tail(), t, None))
        if s is not None and (t == s or (t is None and s[1] == len(self.text))):
            return []
        came = _paths(self.m, self.text, [s], self.b)[s]
        end = t if t is not None else next(x for x in sorted(came) if x[1] == len(self.text))
        return flat(_trace(came, end, s))


def chunk_places(n: int, size: int) -> list[tuple[int, int]]:
    return [(a, min(n, a + size)) for a in range(0, n, size)]


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (x[:, :, None] + y[None, :, :]).max(axis=1)


def prefixes(items: list[np.ndarray], join: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """All prefixes joined, by a tree: pairs first, their prefixes, and from these the ones between."""
    if len(items) < 2:
        return list(items)
    pairs = prefixes([join(a, b) for a, b in zip(items[::2], items[1::2], strict=False)], join)
    return [items[0]] + [pairs[k // 2] if k % 2 else join(pairs[k // 2 - 1], items[k]) for k in range(1, len(items))]


def boundary_states(matrices: list[np.ndarray]) -> list[int]:
    """The state at each inner boundary on the best path: products from the left and from the right meet there."""
    left = prefixes(matrices[:-1], product)
    right = prefixes(matrices[:0:-1], lambda x, y: product(y, x))[::-1]
    return [int((a[0] + b[:, 0]).argmax()) for a, b in zip(left, right, strict=True)]


def _chunk(m: Model, text: str, a: int, b: int) -> Chunk:
    lo, hi = max(0, a - m.longest), min(len(text), b + m.longest)
    return Chunk(m, text[lo:hi], lo, a, b, len(text))


def encode_text(m: Model, text: str | None, size: int = CHUNK) -> list[int]:
    """All chunks in one place; the operator spreads those of long texts over tasks."""
    text = marked(text)
    places = chunk_places(len(text), size)
    if not places:
        return []
    chunks = [_chunk(m, text, a, b) for a, b in places]
    inner = boundary_states([c.matrix() for c in chunks]) if len(chunks) > 1 else []
    return [x for c, i, j in zip(chunks, [0, *inner], [*inner, 0], strict=True) for x in c.ids(i, j)]


def _listed(ids: list[list[int]]) -> pa.Array:
    """Lists of ids as an Arrow array."""
    ends = np.cumsum([0, *map(len, ids)])
    flat = np.concatenate([np.array(i, np.int32) for i in ids]) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def _each(ids: pa.Array) -> list[np.ndarray]:
    """The ids of each row; none of a null one."""
    ends = np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return np.split(ids.flatten().to_numpy(zero_copy_only=False), ends[:-1])


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK) -> DataFrame:
    """A row for each row of docs: doc_id, ids (array of int). A null text is an empty one and has no ids.

    Texts of more than size characters are split into chunks that tasks share; the others are one chunk each. Repeated
    rows give repeated results; an empty table gives an empty one; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    plain = docs.select(column(docs, id_col).alias("doc_id"), F.coalesce(column(docs, text_col), F.lit("")).alias("text"))
    short = plain.filter(F.length("text") < size)

    def whole(x):
        m = model(model_path)
        return {"doc_id": x["doc_id"], "ids": _listed([encode_text(m, t, size) for t in x["text"]])}

    done = map_batches(short, whole, f"doc_id {kind}, ids array<int>")
    # A row's place is its id, its text's hash and its number among equals, so it is the same if a task runs again.
    long_ = plain.filter(F.length("text") >= size).withColumn("key", F.sha2(F.concat_ws("\x00", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"), 256))
    firsts = cut(long_.groupBy("key").agg(F.count(F.lit(1)).alias("copies")), "long-texts")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in batches:
            for id_, text, key in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                text = marked(text)
                for k, (a, b) in enumerate(chunk_places(len(text), size)):
                    lo, hi = max(0, a - m.longest), min(len(text), b + m.longest)
                    yield pa.RecordBatch.from_pydict({"key": [key], "chunk": pa.array([k], pa.int32()), "around": [text[lo:hi]], "lo": [lo], "a": [a], "b": [b], "n": [len(text)], "doc_id": pa.array([id_], batch.schema.field(0).type)})

    chunks = cut(long_.select("doc_id", "text", "key").mapInArrow(split, f"key string, chunk int, around string, lo long, a long, b long, n long, doc_id {kind}").dropDuplicates(["key", "chunk"]), "chunks")

    def matrices(x):
        m = model(model_path)
        got = [Chunk(m, t, lo, a, b, n).matrix() for t, lo, a, b, n in zip(x["around"], x["lo"], x["a"], x["b"], x["n"], strict=True)]
        return {"key": x["key"], "chunk": x["chunk"], "rows": [g.shape[0] for g in got], "best": [(g.ravel() == 0).tolist() for g in got]}

    def scan(group: pa.Table) -> pa.Table:
        # At most 2**31 / size rows of a few hundred weights: a text is no longer than that.
        rows = sorted(group.to_pylist(), key=lambda r: r["chunk"])
        inner = boundary_states([np.where(np.array(r["best"]).reshape(r["rows"], -1), 0.0, NO) for r in rows]) if len(rows) > 1 else []
        return pa.table({"key": [r["key"] for r in rows], "chunk": pa.array([r["chunk"] for r in rows], pa.int32()), "i": pa.array([0, *inner], pa.int32()), "j": pa.array([*inner, 0], pa.int32())})

    found = map_batches(chunks.select("key", "chunk", "around", "lo", "a", "b", "n"), matrices, "key string, chunk int, rows int, best array<boolean>")
    states = found.groupBy("key").applyInArrow(scan, "key string, chunk int, i int, j int")

    def back(x):
        m = model(model_path)
        ids = [Chunk(m, t, lo, a, b, n).ids(i, j) for t, lo, a, b, n, i, j in zip(x["around"], x["lo"], x["a"], x["b"], x["n"], x["i"], x["j"], strict=True)]
        return {"doc_id": x["doc_id"], "key": x["key"], "chunk": x["chunk"], "ids": _listed(ids)}

    traced = map_batches(chunks.join(states, ["key", "chunk"]), back, f"doc_id {kind}, key string, chunk int, ids array<int>")
    joined = traced.groupBy("key").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    joined = joined.join(firsts, "key").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return done.unionByName(joined.select("doc_id", F.flatten(F.col("parts.ids")).alias("ids")))


#: States between chunks of ids: nothing has been written yet, or something has.
NOTHING, SOMETHING = 0, 1


def id_places(m: Model, ids: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Chunks of about size ids that part no character's bytes: one begins with no continuation byte, or after three of them."""
    byte = m.byte[ids]
    goes_on = (byte >= 0x80) & (byte < 0xC0)
    cuts = [0]
    while cuts[-1] + size < len(ids):
        at = cuts[-1] + size
        while at < len(ids) and goes_on[at] and not goes_on[max(0, at - 3) : at].all():
            at += 1
        cuts.append(at)
    return [(a, b) for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True) if a < b]


def id_matrix(m: Model, ids: np.ndarray) -> np.ndarray:
    """Weights from each state before a chunk of ids to each after it."""
    got = np.full((2, 2), NO)
    alone = m.sp.decode(ids.tolist())
    begun = m.spaced is None or m.sp.decode([*ids.tolist(), m.spaced]) != alone + m.sp.decode([m.spaced])
    got[NOTHING, SOMETHING if begun else NOTHING] = got[SOMETHING, SOMETHING] = 0.0
    return got


def decode_chunk(m: Model, ids: np.ndarray, state: int) -> str:
    """What a chunk of ids stands for after nothing or something."""
    if state == NOTHING or m.letters is None:
        return m.sp.decode(ids.tolist())
    return m.sp.decode([m.letters, *ids.tolist()])[len(m.sp.decode([m.letters])) :]


def states_before(matrices: list[np.ndarray]) -> list[int]:
    """The state that each chunk begins in, the first after nothing."""
    return [NOTHING, *(int(x[NOTHING].argmax()) for x in prefixes(matrices[:-1], product))]


def decode_ids(m: Model, ids: np.ndarray, size: int = CHUNK) -> str:
    """All chunks in one place; the operator spreads those of long rows over tasks."""
    chunks = [ids[a:b] for a, b in id_places(m, ids, size)]
    states = states_before([id_matrix(m, c) for c in chunks]) if len(chunks) > 1 else [NOTHING] * len(chunks)
    return "".join(decode_chunk(m, c, s) for c, s in zip(chunks, states, strict=True))


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids", size: int = CHUNK) -> DataFrame:
    """doc_id and text of each row: what its ids stand for. Null or no ids give an empty text.

    Rows of size ids or more are split into chunks that tasks share. Repeated rows give repeated results; an empty table
    gives an empty one; other columns are ignored.
    """
    bounded_batches(encoded.sparkSession)
    plain = encoded.select(column(encoded, id_col).alias("doc_id"), F.coalesce(column(encoded, ids_col), F.array().cast("array<int>")).alias("ids"))
    kind = dict(plain.dtypes)["doc_id"]

    def whole(x):
        return {"doc_id": x["doc_id"], "text": [decode_ids(model(model_path), i, size) for i in _each(x["ids"])]}

    done = map_batches(plain.filter(F.size("ids") < size), whole, f"doc_id {kind}, text string", ("ids",))
    # As in encode, a row's place is its id, its ids' hash and its number among equals.
    long_ = plain.filter(F.size("ids") >= size).withColumn("key", F.sha2(F.concat_ws("\x00", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.array_join("ids", " ")), 256))
    firsts = cut(long_.groupBy("key").agg(F.count(F.lit(1)).alias("copies")), "long-ids")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in batches:
            for id_, ids, key in zip(batch.column(0).to_pylist(), _each(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                for k, (a, b) in enumerate(id_places(m, ids, size)):
                    yield pa.RecordBatch.from_pydict({"key": [key], "chunk": pa.array([k], pa.int32()), "ids": _listed([ids[a:b].tolist()]), "doc_id": pa.array([id_], batch.schema.field(0).type)})

    chunks = cut(long_.select("doc_id", "ids", "key").mapInArrow(split, f"key string, chunk int, ids array<int>, doc_id {kind}").dropDuplicates(["key", "chunk"]), "id-chunks")

    def matrices(x):
        return {"key": x["key"], "chunk": x["chunk"], "best": [(id_matrix(model(model_path), i).ravel() == 0).tolist() for i in _each(x["ids"])]}

    def scan(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["chunk"])
        states = states_before([np.where(np.array(r["best"]).reshape(2, 2), 0.0, NO) for r in rows])
        return pa.table({"key": [r["key"] for r in rows], "chunk": pa.array([r["chunk"] for r in rows], pa.int32()), "state": pa.array(states, pa.int32())})

    found = map_batches(chunks.select("key", "chunk", "ids"), matrices, "key string, chunk int, best array<boolean>", ("ids",))
    states = found.groupBy("key").applyInArrow(scan, "key string, chunk int, state int")

    def back(x):
        texts = [decode_chunk(model(model_path), i, s) for i, s in zip(_each(x["ids"]), x["state"], strict=True)]
        return {"doc_id": x["doc_id"], "key": x["key"], "chunk": x["chunk"], "text": texts}

    traced = map_batches(chunks.join(states, ["key", "chunk"]), back, f"doc_id {kind}, key string, chunk int, text string", ("ids",))
    joined = traced.groupBy("key").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("parts"))
    joined = joined.join(firsts, "key").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return done.unionByName(joined.select("doc_id", F.array_join("parts.text", "").alias("text")))


def digests(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens (long), ids_crc32 (long; of little-endian 32-bit ids), decoded_sha256 of the text decoded from ids. Null ids are none."""

    def rows(x):
        each = _each(x["ids"])
        return {
            "doc_id": x["doc_id"], "n_tokens": list(map(len, each)), "ids_crc32": [zlib.crc32(i.astype("<u4").tobytes()) for i in each],
            "decoded_sha256": [hashlib.sha256(decode_ids(model(model_path), i).encode("utf-8", "replace")).hexdigest() for i in each],
        }

    return map_batches(encoded, rows, f"doc_id {dict(encoded.dtypes)['doc_id']}, n_tokens long, ids_crc32 long, decoded_sha256 string", ("ids",))
