"""Near-duplicate embeddings by randomised-rotation binary codes.

Each unit vector is rotated at random and kept as the signs of its coordinates, with one stored factor: the inner product
of the vector and its code. For any other unit vector, its inner product with the code, divided by that factor, estimates
their cosine without bias, and the factor bounds the error. Within a label, blocks of vectors meet block by block; only
pairs whose upper confidence bound reaches the threshold are computed again in double precision, and those alone decide.

A label of many blocks is indexed: more random directions give each vector a key of a few signs in each of several
tables, as many that two vectors of the threshold's cosine share no key with a chance of MISSED. Vectors meet where they
share a key, in blocks as well if a key has many, and a pair counts in the first table in which it does. So copies of a
vector grow with a small power of its label's size, not in proportion.

Equal vectors of a label are one class. A pair of blocks returns at most a row for each of its vectors: how many vectors
it is linked with there, and the smallest class that links connect it with there. Pairs are never rows.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import bounded_batches, column, cut, map_batches
from provenant.llm.components import components

THRESHOLD = 0.93
#: Classes in a block, on average; two blocks meet in one task.
BLOCK = 1024
#: Error bound in units of the estimate's deviation: exceeded with a chance below 10**-8.
CONFIDENCE = 6.0
#: Labels of at most so many blocks are compared as a whole; larger ones are indexed.
WHOLE = 32
#: Chance that a pair of the threshold's cosine shares no key.
MISSED = 1e-6
#: Most labels whose shapes are broadcast; those of more are joined by a shuffle.
MOST_BROADCAST = 100_000
#: Most signs in a key.
MOST_BITS = 40
SEED = 20240531


@functools.lru_cache(maxsize=8)
def rotation(n: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + n).normal(size=(n, n)))
    return q * np.sign(np.diag(r))


def encode(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of rotated unit vectors, and the inner product of each with its code."""
    turned = units @ rotation(units.shape[1])
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / math.sqrt(units.shape[1])


def tables_of(bits: int, threshold: float) -> int:
    """Tables of keys of so many signs that a pair of the threshold's cosine is missed with a chance of MISSED."""
    same = (1 - math.acos(min(threshold, 1.0)) / math.pi) ** bits
    return 1 if bits == 0 or same >= 1 - MISSED else math.ceil(math.log(MISSED) / math.log1p(-same))


def bits_of(n: int) -> int:
    """Signs in the keys of a label of n classes: none if it is compared as a whole, else so many that a key has about BLOCK of them."""
    return 0 if n <= WHOLE * BLOCK else min(MOST_BITS, math.ceil(math.log2(n / BLOCK)))


@functools.lru_cache(maxsize=8)
def directions(n: int, count: int) -> np.ndarray:
    """Random directions, the same everywhere."""
    return np.random.default_rng(SEED + 7919 * n + count).normal(size=(n, count))


def keys_of(units: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """A key for each vector and table."""
    if not bits:
        return np.zeros((len(units), 1), np.int64)
    signs = (units @ directions(units.shape[1], bits * tables) > 0).reshape(len(units), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def upper_bounds(queries: np.ndarray, codes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Upper confidence bounds of the cosine of each unit vector of queries and each coded one."""
    n = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=n).astype(np.float32) * 2 - 1
    turned = (queries @ rotation(n)).astype(np.float32)
    f = factors.astype(np.float32)
    error = CONFIDENCE * np.sqrt(np.maximum(1 - f * f, 0) / max(n - 1, 1)) / f + 1e-4
    return turned @ signs.T / (math.sqrt(n) * f) + error


def similar_pairs(a: np.ndarray, b: np.ndarray, codes: np.ndarray, factors: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of pairs whose cosine in double precision reaches the threshold. codes and factors are b's."""
    i, j = np.nonzero(upper_bounds(a, codes, factors) >= threshold)
    good = np.concatenate([np.einsum("ij,ij->i", a[i[k : k + 65536]], b[j[k : k + 65536]]) >= threshold for k in range(0, max(1, len(i)), 65536)])
    return i[good], j[good]


def _least_connected(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of n places, the least that each is connected with by the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of vectors: vec_id, n_links, component_id (long as vec_id), kept.

    Vectors of equal labels and lengths are linked if their cosine is threshold or more; threshold must be positive. A
    vector that is null, empty, zero, holds a null or a number that isn't finite, or has a null label, is linked with
    nothing and is its own component. n_links counts other rows. Ids are taken for unique: rows that repeat an id count as
    vectors of their own, and go together. A null id is never smallest; if all of a component's are null, so is its
    component_id. An empty table gives an empty result; other columns are ignored. Labels of up to WHOLE * BLOCK classes are
    compared exactly; of larger ones, a pair of the threshold's cosine is missed with a chance of MISSED, closer ones less.
    """
    bounded_batches(vectors.sparkSession)
    plain = vectors.select(column(vectors, id_col).alias("vec_id"), column(vectors, vector_col).cast("array<double>").alias("vector"), column(vectors, label_col).alias("label"))

    def coded(x):
        out = {k: [] for k in ("vec_id", "node", "dims", "unit", "code", "factor")}
        for id_, v, label in zip(x["vec_id"], x["vector"], x["label"], strict=True):
            row = (None,) * 5
            if v and label is not None and None not in v:
                v = np.array(v, np.float64)
                top = np.abs(v).max()
                if np.isfinite(top) and top > 0:
                    u = v / top
                    u = u / np.sqrt(u @ u)
                    code, factor = encode(u[None])
                    row = hashlib.blake2b(repr(label).encode() + b"\0" + (v + 0.0).tobytes(), digest_size=16).digest(), len(v), u.tobytes(), code[0].tobytes(), float(factor[0])
            for k, value in zip(out, (id_, *row), strict=True):
                out[k].append(value)
        return out | {"label": x["label"]}

    kinds = dict(plain.dtypes)
    rows = cut(map_batches(plain, coded, f"vec_id {kinds['vec_id']}, node binary, dims int, unit binary, code binary, factor double, label {kinds['label']}"), "coded")
    classes = rows.filter("node is not null").groupBy("node").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("many"), *(F.first(c).alias(c) for c in ("label", "dims", "unit", "code", "factor")))
    classes = cut(classes, "classes")
    # A row for each label, with its keys' signs and tables.
    sizes = classes.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("n"))

    def shaped(x):
        bits = list(map(bits_of, x["n"]))
        return {"label": x["label"], "dims": x["dims"], "bits": bits, "tables": [tables_of(b, threshold) for b in bits]}

    shapes = cut(map_batches(sizes.select("label", "dims", "n"), shaped, f"label {kinds['label']}, dims int, bits int, tables int"), "shapes")

    def keyed(x):
        keys = [keys_of(np.frombuffer(u, np.float64)[None], b, t)[0].tolist() for u, b, t in zip(x["unit"], x["bits"], x["tables"], strict=True)]
        return {c: x[c] for c in ("label", "dims", "bits", "tables", "node")} | {"keys": keys}

    few = shapes.count() <= MOST_BROADCAST
    placed = classes.join(F.broadcast(shapes) if few else shapes, ["label", "dims"])
    keys = cut(map_batches(placed.select("label", "dims", "bits", "tables", "node", "unit"), keyed, f"label {kinds['label']}, dims int, bits int, tables int, node binary, keys array<long>").select("label", "dims", "bits", "tables", "node", F.posexplode("keys").alias("table", "key")), "keys")
    place = ["label", "dims", "table", "key"]
    blocks = keys.groupBy(*place).agg(F.count(F.lit(1)).alias("m")).filter("m > 1").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).drop("m")
    placed = keys.join(blocks, place).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A row goes to each pair of blocks of its key that its own is in.
    copies = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    copies = copies.select(*place, "bits", "tables", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node").join(classes.select("node", "many", "unit", "code", "factor"), "node")

    def meet(group: pa.Table) -> pa.Table:
        d, lo, hi, table, bits, tables = (group.column(c)[0].as_py() for c in ("dims", "lo", "hi", "table", "bits", "tables"))
        node = group.column("node").to_pylist()
        many = group.column("many").to_numpy()
        units = np.frombuffer(b"".join(group.column("unit").to_pylist()), np.float64).reshape(-1, d)
        codes = np.frombuffer(b"".join(group.column("code").to_pylist()), np.uint8).reshape(len(units), -1)
        factors, block = group.column("factor").to_numpy(), group.column("block").to_numpy()
        order = np.array(sorted(range(len(node)), key=node.__getitem__), np.int64)  # so the least place is the least node
        a = order[block[order] == lo]
        b = a if lo == hi else order[block[order] == hi]
        i, j = similar_pairs(units[a], units[b], codes[b], factors[b], threshold)
        i, j = a[i], b[j]
        if lo == hi:
            # Either side may have been the coded one; a pair found from one side is a pair.
            pairs = np.unique(np.minimum(i, j) * len(node) + np.maximum(i, j))
            i, j = np.divmod(pairs, len(node))
            i, j = i[i != j], j[i != j]
        if table and len(i):  # pairs that share an earlier key count there
            seen = keys_of(units, bits, tables)[:, :table]
            new = np.concatenate([~(seen[i[k : k + 65536]] == seen[j[k : k + 65536]]).any(axis=1) for k in range(0, len(i), 65536)])
            i, j = i[new], j[new]
        place = np.empty(len(node), np.int64)
        place[order] = np.arange(len(node))
        count = np.bincount(i, many[j], len(node)) + np.bincount(j, many[i], len(node))
        root = order[_least_connected(len(node), place[i], place[j])][place]
        linked = np.flatnonzero(count)
        return pa.table({"node": pa.array([node[k] for k in linked], pa.binary()), "links": pa.array(count[linked].astype(np.int64)), "root": pa.array([node[root[k]] for k in linked], pa.binary())})

    met = cut(copies.groupBy(*place, "lo", "hi").applyInArrow(meet, "node binary, links long, root binary"), "met")
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = classes.select("node", "vec_id", "many").join(components(met.select(F.col("node").alias("a"), F.col("root").alias("b"))), "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = cut(roots.join(links, "node", "left").withColumn("links", F.coalesce("links", F.lit(0)) + F.col("many") - 1), "vector-roots")
    smallest = roots.groupBy("root").agg(F.min("vec_id").alias("component"))
    found = cut(roots.join(smallest, "root").select("node", "links", "component"), "vector-found")
    whole = rows.select("vec_id", "node").join(found, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return whole.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
