"""A byte-level convolutional network, in numpy, that scores whole texts for quality.

A text's UTF-8 bytes are read in chunks of CHUNK bytes that overlap by half a window, so every window of the text lies
in some chunk. Each byte has a learned embedding; each filter spans WINDOW bytes and moves by half of that. A chunk keeps
every filter's largest response; a linear layer turns these into the chunk's log-odds, and the log-odds' mean over
chunks, weighted by their bytes, is the document's.

The network is fitted on the driver to at most SAMPLE labelled documents of SAMPLE_BYTES bytes in all, taken in the
order of a hash of their ids, as many of either class; the shares of the classes among all labels then set the bias.
Scoring reads all bytes of all documents, batch by batch.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import bounded_batches, column, cut, held_out, map_batches, utf8

WIDTH, FILTERS, HALF = 8, 24, 8
WINDOW = 2 * HALF
CHUNK = 1024
#: Bounds of the labelled sample that is fitted: documents, and bytes of text.
SAMPLE, SAMPLE_BYTES = 2400, 12_000_000
EPOCHS, BATCH, RATE, DECAY, SEED = 5, 128, 0.004, 1e-4, 7
#: Chunks convolved at once while scoring.
AT_ONCE = 256


def chunks_of(text: str | None) -> np.ndarray:
    """A row of CHUNK bytes for each chunk, the last filled up with zeros; of an empty text, one row of zeros.

    Chunks after the first begin with the last half window of the one before.
    """
    data = np.frombuffer(utf8(text), np.uint8)
    step = CHUNK - HALF
    n = max(1, -(-max(0, len(data) - HALF) // step))
    whole = np.zeros(n * step + HALF, np.uint8)
    whole[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(whole, CHUNK)[::step]


def _weights_of(text: str | None, n: int) -> np.ndarray:
    """Bytes of each chunk, one at least."""
    got = np.full(n, CHUNK - HALF, np.float32)
    got[-1] = max(1, len(utf8(text)) - (n - 1) * (CHUNK - HALF))
    return got


class Network:
    """embedding (256, WIDTH), filters (WINDOW * WIDTH, FILTERS) with bias, head (FILTERS) with bias."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = {
            "embedding": rng.normal(0, 0.5, (256, WIDTH)).astype(np.float32),
            "filters": rng.normal(0, (WINDOW * WIDTH) ** -0.5, (WINDOW * WIDTH, FILTERS)).astype(np.float32),
            "shift": np.zeros(FILTERS, np.float32),
            "head": rng.normal(0, FILTERS**-0.5, FILTERS).astype(np.float32),
            "bias": np.zeros(1, np.float32),
        }
        self.p["embedding"][0] = 0

    def responses(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each chunk, and the window where it is."""
        half = HALF * WIDTH
        frames = self.p["embedding"][chunks].reshape(-1, half)
        sides = frames @ np.concatenate((self.p["filters"][:half], self.p["filters"][half:]), axis=1)
        sides = sides.reshape(len(chunks), CHUNK // HALF, 2 * FILTERS)
        got = sides[:, :-1, :FILTERS] + sides[:, 1:, FILTERS:]
        at = got.argmax(axis=1)
        return np.take_along_axis(got, at[:, None], axis=1)[:, 0] + self.p["shift"], at

    def log_odds(self, chunks: np.ndarray) -> np.ndarray:
        got = [np.tanh(self.responses(chunks[i : i + AT_ONCE])[0]) @ self.p["head"] for i in range(0, len(chunks), AT_ONCE)]
        return np.concatenate(got) + self.p["bias"]

    def gradients(self, chunks: np.ndarray, want: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        best, at = self.responses(chunks)
        act = np.tanh(best)
        error = (1 / (1 + np.exp(-(act @ self.p["head"] + self.p["bias"]))) - want) * weight
        back = error[:, None] * self.p["head"] * (1 - act**2)
        bytes_ = np.lib.stride_tricks.sliding_window_view(chunks, WINDOW, axis=1)[:, ::HALF][np.arange(len(chunks))[:, None], at]
        seen = self.p["embedding"][bytes_].reshape(len(chunks), FILTERS, -1)
        filters = np.einsum("bfw,bf->wf", seen, back)
        to = (back[:, :, None] * self.p["filters"].T[None]).reshape(-1, WIDTH)
        flat = bytes_.reshape(-1)
        embedding = np.stack([np.bincount(flat, to[:, i], 256) for i in range(WIDTH)], axis=1).astype(np.float32)
        embedding[0] = 0
        return {"embedding": embedding, "filters": filters, "shift": back.sum(0), "head": error @ act, "bias": error.sum(keepdims=True)}

    def fit(self, texts: list[str], labels: list[int], share: float) -> Network:
        """share: that of label 1 among all labels; the sample itself counts both classes alike."""
        made = [chunks_of(t) for t in texts]
        chunks = np.concatenate(made) if made else np.zeros((0, CHUNK), np.uint8)
        y = np.repeat(np.array(labels, np.float32), [len(c) for c in made]) if made else np.zeros(0, np.float32)
        weight = np.concatenate([np.full(len(c), 1 / len(c), np.float32) for c in made]) if made else y
        if len({*labels}) < 2:  # nothing to tell apart: the share alone
            self.p["head"][:] = 0
        else:
            for label in (0, 1):
                weight[y == label] *= 0.5 / weight[y == label].sum()
            weight *= len(y)
            weight = np.minimum(weight, 20)
            rng, step = np.random.default_rng(SEED), 0
            first = {k: np.zeros_like(v) for k, v in self.p.items()}
            second = {k: np.zeros_like(v) for k, v in self.p.items()}
            per = -(-len(y) // BATCH)
            epochs = max(EPOCHS, min(60, 300 // per))
            for epoch in range(epochs):
                order = rng.permutation(len(y))
                rate = RATE * (1 - epoch / epochs) + RATE / 20
                for i in range(0, len(y), BATCH):
                    part, step = order[i : i + BATCH], step + 1
                    for k, g in self.gradients(chunks[part], y[part], weight[part] / len(part)).items():
                        g = g + DECAY * self.p[k]
                        first[k] = 0.9 * first[k] + 0.1 * g
                        second[k] = 0.99 * second[k] + 0.01 * g * g
                        self.p[k] = (self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        share = min(max(share, 0.01), 0.99)
        self.p["bias"] = (self.p["bias"] + np.log(share / (1 - share))).astype(np.float32)
        return self


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[int], float]:
    """Texts and labels to fit, and the share of label 1 among all labels of docs that may be learned from.

    Labels whose id is held out, null or not 0 or 1, or whose document isn't in docs, are not used; an id labelled twice has
    its lower label. At most most documents are taken, half of either class, in the order of a hash of their ids; one that
    would exceed most_bytes bytes in all is passed over, so where that bound is reached the longest texts are rarer in the
    sample than in docs.
    """
    label = column(labels, label_col)
    usable = labels.select(column(labels, id_col).alias("doc_id"), label.cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    # Of documents that are there: a corpus that was filtered before has its own shares.
    there = docs.select(column(docs, id_col).alias("doc_id")).distinct()
    usable = cut(usable.groupBy("doc_id").agg(F.min("label").alias("label")).join(there, "doc_id", "left_semi"), "labels")
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    picked = [usable.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for k in (0, 1)]
    picked = picked[0].unionByName(picked[1])
    texts = docs.select(column(docs, id_col).alias("doc_id"), F.coalesce(column(docs, text_col), F.lit("")).alias("text"))
    # At most `most` rows of ids are broadcast.
    found = texts.join(F.broadcast(picked), "doc_id").withColumn("order", F.xxhash64("doc_id"))
    got, total = {}, 0
    sizes = found.select("doc_id", "label", "order", F.octet_length("text").alias("size")).groupBy("doc_id").agg(F.min("label").alias("label"), F.min("order").alias("order"), F.max("size").alias("size"))
    for r in sorted(sizes.collect(), key=lambda r: (r["order"], r["doc_id"])):
        if total + r["size"] <= most_bytes:
            got[r["doc_id"]] = r["label"]
            total += r["size"]
    few = docs.sparkSession.createDataFrame([(k,) for k in got], f"doc_id {dict(texts.dtypes)['doc_id']}")
    rows = texts.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], [got[r["doc_id"]] for r in rows], counts.get(1, 0) / max(1, sum(counts.values()))


def quality_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Scores every document: doc_id, held_out (boolean), score (double, 0 to 1), predicted (int, 1 if score >= 0.5).

    The score depends on the text alone. A null text is an empty one and has the score of a chunk of zeros. Without
    labels of both classes all scores are the share of label 1, kept within 0.01 and 0.99. A null id is not held out.
    Repeated rows give repeated results; an empty table gives an empty one; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    network = Network().fit(*labelled_sample(docs, labels, id_col, text_col, label_col))
    return score(docs, network, id_col, text_col)


def _scores(network: Network, texts: list[str | None]) -> list[float]:
    odds, at = [], 0
    while at < len(texts):  # so many documents as have about AT_ONCE chunks
        first, made, n = at, [], 0
        while at < len(texts) and n < AT_ONCE:
            made.append(chunks_of(texts[at]))
            n += len(made[-1])
            at += 1
        each, end = network.log_odds(np.concatenate(made)).astype(np.float64), 0
        for text, m in zip(texts[first:at], made, strict=True):
            odds.append(np.average(each[end : end + len(m)], weights=_weights_of(text, len(m))))
            end += len(m)
    return [float(1 / (1 + np.exp(-o))) for o in odds]


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As quality_classifier, with a network that is given: nulls, repeated rows and other columns count as there."""
    plain = docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).alias("text"))
    got = map_batches(plain, lambda x: {"doc_id": x["doc_id"], "score": _scores(network, x["text"])}, f"doc_id {dict(plain.dtypes)['doc_id']}, score double")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def predicted_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", known: DataFrame | None = None) -> DataFrame:
    """The rows of docs, all columns, whose score is 0.5 or more; they don't leave their partition.

    Learns from the labelled documents of known, by default docs. Where docs have been filtered before, known should be
    the table they come from, as what is left of them holds hardly a bad example.
    """
    network = Network().fit(*labelled_sample(docs if known is None else known, labels, id_col, text_col, label_col))
    kinds = dict(docs.dtypes)

    def rows(x):
        good = [i for i, s in enumerate(_scores(network, x[text_col])) if s >= 0.5]
        return {c: [v[i] for i in good] for c, v in x.items()}

    return map_batches(docs, rows, ", ".join(f"`{c}` {kinds[c]}" for c in docs.columns))
