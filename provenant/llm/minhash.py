"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's shingles are hashed once; its sketch is its K least hash values (DEEP where lists are long). Inverted lists of the least INDEXED values
generate pairs that overlap, the union's sketch estimates their similarity, and full shingle sets confirm links.

Documents with equal sets are one class. In lists of any length each class is first compared with the list's hub, which
is linear in the list. Only classes that are still in different components then meet in pairs. Classes that could be
linked through lists longer than LONG_LIST alone are indexed again by their rarest values, few enough that any two that
could be linked must share one, so a passage that very many documents hold generates no pairs unless it makes up most of
them; parities of the full sets are compared inside that join, so only pairs that are similar become rows. No pair that could be linked is left out but with a chance of about 10**-8.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import bounded_batches, column, cut, is_empty, map_batches, mix, utf8
from provenant.llm.components import components

K = 64
#: Least values kept for classes that meet in long lists. Nearly all documents have fewer shingles, so these are their full sets.
DEEP = 256
#: Least values that have inverted lists. Of the INDEXED least values of two sets of similarity 0.8, SURE or more are
#: unshared with a chance of about 10**-8.
INDEXED, SURE = 20, 16
LONG_LIST = 40
#: Most ids that are broadcast, after a count; more are joined by a shuffle.
MOST_BROADCAST = 500_000
#: Bits of a set's parities.
PARITY = 8192
#: Standard errors of the union sketch's estimate that a pair may lie below the threshold and still be confirmed.
MARGIN = 6.0

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = np.uint64(0x5851F42D4C957F2D)
_BASE_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 2**64))
#: Bytes hashed at once; powers of the base are kept for so many.
_SEGMENT = 1 << 20
_powers: list[np.ndarray] = []


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 14)
        ones = np.ones(size, np.uint64)
        up, down = ones.copy(), ones.copy()
        up[1:], down[1:] = _BASE, _BASE_INVERSE
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0][:n], _powers[1][:n]


def _word_hashes_of(data: np.ndarray) -> np.ndarray:
    data = _LOWER[data]
    inside = np.concatenate(([False], ~_SPACE[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _powers_of(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up, dtype=np.uint64)))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words, ASCII letters in lower case; equal words have equal ones wherever they stand."""
    data = np.frombuffer(text, np.uint8)
    if len(data) <= _SEGMENT:
        return _word_hashes_of(data)
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + _SEGMENT)
        if end < len(data):
            space = re.compile(rb"[ \t-\r]").search(text, end)
            end = space.start() if space else len(data)
        found.append(_word_hashes_of(data[at:end]))
        at = end
    return np.concatenate(found)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of width words; of fewer words, one of the whole sequence."""
    words = word_hashes(utf8(text))
    if not len(words):
        return words
    if len(words) < width:
        whole = np.full(1, len(words), np.uint64)
        for i in range(len(words)):
            whole = mix(whole * np.uint64(3) + words[i : i + 1])
        return whole
    n = len(words) - width + 1
    got = np.full(n, width, np.uint64)
    for i in range(width):
        got = mix(got * np.uint64(3) + words[i : i + n])
    return np.unique(got)


def _fingerprint(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def parities(found: np.ndarray) -> np.ndarray:
    """PARITY bits, each telling whether oddly many of a set's values fall on it, as signed 64-bit integers.

    Two sets' bits differ in no more places than the sets do, so they can rule out a pair but never wrongly.
    """
    bits = np.bincount((found >> np.uint64(20)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _differ(per_cent: int) -> str:
    """That parities of a pair allow the similarity: sets of n_a and n_b values, so similar, differ in few enough."""
    return f"(100 + {per_cent}) * aggregate(zip_with(o_a, o_b, (x, y) -> bit_count(x ^ y)), 0L, (s, x) -> s + x) <= (100 - {per_cent}) * (n_a + n_b)"


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """Columns doc_id, n_shingles (long), node (binary; the set's fingerprint, null if empty), sketch (array of long)."""
    plain = docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).alias("text"))

    def rows(x):
        sets = [shingle_set(t, width) for t in x["text"]]
        return {"doc_id": x["doc_id"], "n_shingles": [len(s) for s in sets], "node": [_fingerprint(s) if len(s) else None for s in sets], "sketch": [s[:DEEP].view(np.int64) for s in sets]}

    return map_batches(plain, rows, f"doc_id {dict(plain.dtypes)['doc_id']}, n_shingles long, node binary, sketch array<long>")


def _close(per_cent: int) -> str:
    """A pair of sizes that allows the similarity."""
    return f"100 * least(n_a, n_b) >= {per_cent} * greatest(n_a, n_b)"


def _few(ids: DataFrame) -> DataFrame:
    """A stored table of ids, to be broadcast if it has MOST_BROADCAST rows or fewer."""
    return F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids


class _Classes:
    """The classes of one call and what confirms links between them."""

    def __init__(self, plain: DataFrame, nodes: DataFrame, width: int, per_cent: int):
        self.plain, self.nodes, self.width, self.per_cent = plain, nodes, width, per_cent

    def _in(self, pairs: DataFrame) -> DataFrame:
        """The classes in pairs a, b."""
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        return self.nodes.join(_few(cut(ids, "ids")), "id", "left_semi")

    def estimated(self, pairs: DataFrame) -> DataFrame:
        """Adds sure (boolean) to pairs a, b: true if linked, null if full sets have to tell; drops the others."""
        nodes = self._in(pairs)
        side = lambda s: nodes.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"s_{s}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")

        t = self.per_cent / 100
        low = t - MARGIN * math.sqrt(t * (1 - t) / K)
        # Least values are compared as unsigned integers, in which order the sketches were cut.
        least = "array_sort(array_union(s_a, s_b), (x, y) -> case when shiftrightunsigned(x, 1) < shiftrightunsigned(y, 1) then -1 when shiftrightunsigned(x, 1) > shiftrightunsigned(y, 1) then 1 when (x & 1) < (y & 1) then -1 when (x & 1) > (y & 1) then 1 else 0 end)"
        both = both.withColumn("exact", F.greatest("n_a", "n_b") <= K).withColumn("common", F.array_intersect("s_a", "s_b"))
        # The union's least values hold no more common ones than the two sketches do; few are enough to drop a pair.
        both = both.filter(F.col("exact") | (F.size("common") >= low * K))
        both = both.withColumn("top", F.when(~F.col("exact"), F.expr(f"slice({least}, 1, {K})")))
        both = both.withColumn("hits", F.when(F.col("exact"), F.size("common")).otherwise(F.size(F.array_intersect("common", "top"))).cast("long"))
        total = F.when(F.col("exact"), F.col("n_a") + F.col("n_b") - F.col("hits")).otherwise(F.size("top"))
        linked = F.col("hits") * 100 >= total * self.per_cent
        return both.filter(F.when(F.col("exact"), linked).otherwise(F.col("hits") >= total * low)).select("a", "b", F.when(F.col("exact"), F.lit(True)).alias("sure"))

    def sets(self, classes: DataFrame) -> DataFrame:
        """Columns id, n, odd (parities) and found (the full set's bytes) of classes, from their texts. Stored."""
        wanted = _few(cut(classes.select(F.col("doc_id").alias("wanted_id"), "id", "node"), "wanted"))
        texts = self.plain.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id"))).select("id", "node", "text")
        width = self.width

        def again(x):
            sets = [shingle_set(t, width) for t in x["text"]]
            same = [i for i, s in enumerate(sets) if len(s) and _fingerprint(s) == x["node"][i]]  # not another row of that id
            return {"id": [x["id"][i] for i in same], "n": [len(sets[i]) for i in same], "odd": [parities(sets[i]) for i in same], "found": [sets[i].tobytes() for i in same]}

        return cut(map_batches(texts, again, "id long, n long, odd array<long>, found binary").dropDuplicates(["id"]), "sets")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Those of pairs a, b whose full sets are similar enough; the others went by their sketches."""
        found = cut(self.estimated(cut(pairs, "pairs")), "estimated")
        open_ = found.filter("sure is null").select("a", "b")
        if is_empty(open_):
            return found.filter("sure").select("a", "b")
        sets = self.sets(self._in(open_))
        side = lambda s, *more: sets.select(F.col("id").alias(s), *(F.col(x).alias(f"{x[0]}_{s}") for x in more))
        near = open_.join(side("a", "n", "odd"), "a").join(side("b", "n", "odd"), "b").filter(_differ(self.per_cent)).select("a", "b")
        both = cut(near, "near").join(side("a", "found"), "a").join(side("b", "found"), "b")
        per_cent = self.per_cent

        def verify(x):
            good = []
            for i, (a, b) in enumerate(zip(x["f_a"], x["f_b"], strict=True)):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * common >= per_cent * (len(a) + len(b) - common):
                    good.append(i)
            return {s: [x[s][i] for i in good] for s in ("a", "b")}

        return found.filter("sure").select("a", "b").unionByName(map_batches(both, verify, "a long, b long"))


def _prefix(t: float) -> F.Column:
    """Of how many of its rarest sketch values a class must be indexed by so that no class it could be linked with is missed.

    A class whose partners all fit in their sketches shares at least t of its own set with each. Otherwise the union's
    sketch has DEEP * t common values but for MARGIN standard deviations. Where a partner may be of either kind, the
    smaller number holds.
    """
    common = max(1, math.floor(DEEP * t - MARGIN * math.sqrt(DEEP * t * (1 - t))))
    kept, own = F.least(F.col("n"), F.lit(DEEP)), F.ceil(F.col("n") * t)
    shared = F.when(F.col("n") <= math.floor(DEEP * t), own).otherwise(F.least(F.lit(common), own))
    return F.greatest(F.lit(1), kept - shared + 1).cast("int")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, per_cent: int = 80) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, kept.

    Documents whose shingle sets have 100 * intersection >= per_cent * union are linked; component_id is the smallest
    id reachable by links, itself included, and kept says whether that is the document itself. A null or empty text has
    no shingles and is linked with nothing. Equal sets are linked whatever their texts. A null id is never smallest;
    if all ids of a component are null, so is its component_id, and kept is true. Repeated rows of an id go together.
    An empty table gives an empty result. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    plain = docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).alias("text"))
    rows = cut(sketches(plain, width=width), "sketches")
    classes = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first(F.slice("sketch", 1, K)).alias("sketch"))
    nodes = cut(classes.withColumn("id", F.monotonically_increasing_id()), "nodes")  # ids are fixed as they are written
    of = _Classes(plain, nodes, width, per_cent)
    t = per_cent / 100

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.filter(_close(per_cent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    # Lists of at least two classes, each with a hub.
    values = nodes.select("id", "n", F.explode(F.slice("sketch", 1, INDEXED)).alias("value"))
    lists = values.groupBy("value").agg(F.count(F.lit(1)).alias("long"), F.min("id").alias("hub"), F.min_by("n", "id").alias("hub_n")).filter("long > 1")
    postings = cut(values.join(lists, "value"), "postings")
    stars = postings.filter("hub <> id").select(F.col("hub").alias("a"), F.col("id").alias("b"), F.col("hub_n").alias("n_a"), F.col("n").alias("n_b"))

    def together(roots: DataFrame | None, pairs: DataFrame, name: str) -> DataFrame:
        """Components, as node and root, of those so far and of what pairs link. What is linked so far goes on as a link to its root, so little is left to do."""
        links = cut(of.confirmed(ordered(pairs)), name)
        if roots is not None:
            if is_empty(links):
                return roots
            links = links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        return cut(components(links), "components")

    roots = together(None, stars, "links-stars")

    def labelled(table: DataFrame) -> DataFrame:
        """Adds comp, the smallest class of the component so far, and keeps lists that span several."""
        comp = cut(table.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root"), "labelled")
        open_ = comp.groupBy("value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("value")
        return comp.join(open_, "value")

    # Pairs of classes of one short list and of different components.
    open_ = cut(labelled(postings.select("value", "id", "n", "long")), "open")
    short = open_.filter(F.col("long") <= LONG_LIST)
    side = lambda s: short.select("value", F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("comp").alias(f"c_{s}"))
    roots = together(roots, side("a").join(side("b"), "value").filter("a < b and c_a <> c_b"), "links-lists")

    # A class of SURE values in short lists has met all it could be linked with there; so has one whose whole set is
    # indexed, if fewer of its values are in long lists than a linked set must share.
    long_ = open_.filter(F.col("long") > LONG_LIST)
    many = postings.filter(F.col("long") > LONG_LIST).groupBy("id", "n").agg(F.count(F.lit(1)).alias("m"))
    left = many.filter(F.when(F.col("n") <= INDEXED, F.col("m") >= F.ceil(F.col("n") * t)).otherwise(INDEXED - F.col("m") < SURE))
    held = cut(long_.select("id").distinct().join(left.select("id"), "id"), "held")
    if not is_empty(held):
        fewer = _few(cut(nodes.join(_few(held), "id", "left_semi").select("id", "node"), "held-nodes"))
        whole = rows.filter("node is not null").join(fewer, "node").groupBy("id").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
        deep = cut(whole.select("id", "n", F.explode("sketch").alias("value")), "deep")
        counts = cut(deep.groupBy("value").agg(F.count(F.lit(1)).alias("long")), "counts")
        ranked = deep.join(counts, "value").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("long", "value"))).alias("all"))
        ranked = cut(ranked.withColumn("central", F.expr("aggregate(all, 0d, (a, x) -> a + ln(x.long)) / size(all)")), "ranked")
        # An original that many copies were made from holds the most frequent values. As the hub of its lists it brings
        # together what pairs of copies, which differ from each other twice as much, would not.
        central = long_.join(ranked.select("id", "central"), "id")
        hubs = central.groupBy("value").agg(*(F.max_by(c, F.struct("central", "id")).alias(f"hub_{c}") for c in ("id", "n", "comp")))
        spread = central.join(hubs, "value").filter("hub_comp <> comp").select(F.col("hub_id").alias("a"), F.col("id").alias("b"), F.col("hub_n").alias("n_a"), F.col("n").alias("n_b"))
        roots = together(roots, spread, "links-hubs")
        # A posting carries the rarer values before it: a pair is weighed in the list of its first common value only. The
        # parities are compared inside the join, so pairs that aren't similar are never rows.
        rare = ranked.withColumn("prefix", F.slice("all.value", F.lit(1), _prefix(t)))
        rare = rare.select("id", "n", "prefix", F.posexplode("prefix").alias("place", "value")).withColumn("before", F.expr("slice(prefix, 1, place)")).drop("prefix", "place")
        table = cut(labelled(rare.join(counts.filter("long > 1").select("value"), "value")), "rare-open")
        # In each list the largest component meets the others, but not itself.
        sizes = table.groupBy("value", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("value").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"))
        table = table.join(sizes, "value").withColumn("main", F.col("main") == F.col("comp")).join(of.sets(nodes.join(_few(held), "id", "left_semi")).select("id", "odd"), "id")
        table = cut(table, "rare")
        near = f"c_a <> c_b and (m_b or a < b) and {_close(per_cent)} and not arrays_overlap(p_a, p_b) and {_differ(per_cent)}"
        side = lambda s, t: t.select("value", *(F.col(x).alias(f"{y}_{s}") for x, y in (("n", "n"), ("comp", "c"), ("main", "m"), ("before", "p"), ("odd", "o"))), F.col("id").alias(s))
        pairs = side("a", table.filter("not main")).join(side("b", table), "value").filter(near)
        roots = together(roots, pairs, "links-deep")

    roots = nodes.select("id", "node", "doc_id").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    roots = cut(roots, "roots")
    smallest = roots.groupBy("root").agg(F.min("doc_id").alias("component"))
    found = cut(roots.join(smallest, "root").select("node", "component"), "found")
    whole = rows.drop("sketch").join(found, "node", "left")
    linked = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return whole.select("doc_id", "n_shingles", linked.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
