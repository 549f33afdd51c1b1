"""Toxicity by a classifier chain of linear models over words.

The labels mark toxicity alone, so the sample tells its categories apart: the features that mark its toxic texts most
surely are parted in two by the sign of their weight in the main component of how they occur together there, and a toxic
text is of the kinds whose features it has. These two kinds and then toxicity as a whole are predicted one after another.
Each model sees which of its features, hashed words and word starts, a text has, and the probabilities of the categories
before it. It is fitted to out-of-fold predictions of those, so it learns how far they can be trusted on texts they
haven't seen. Its features are those that are far more frequent in the category than outside.

The chain is fitted on the driver to at most SAMPLE labelled documents, in the order of a hash of their ids, half of
either label; the labels' own shares set the bias. Scoring reads all words of all documents.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import bounded_batches, column, map_batches, utf8
from provenant.llm.quality_classifier import labelled_sample

#: Categories in the order of the chain; the last is what the labels mark.
CATEGORIES = ("kind_a", "kind_b", "toxic")
#: Bounds of the labelled sample that is fitted: documents, and bytes of text.
SAMPLE, SAMPLE_BYTES = 4000, 16_000_000
HASHED = 1 << 20
#: Least chi-squared and log odds ratio of a model's features, and most of them.
CHI2, LOG_ODDS, MOST_FEATURES = 9.0, 1.2, 400
#: Most features that tell the kinds apart.
TELLING = 60
FOLDS, STEPS, RIDGE = 3, 14, 3e-6
#: Lengths of word starts that are features beside the word itself.
STARTS = (4, 5)
REMEMBERED = 400_000
_STRIP = b".,;:!?\"'()[]{}|*#-_/\\<>"


def words_of(text: str | None) -> set[bytes]:
    """Distinct words in lower case, without marks around them."""
    return {w.strip(_STRIP) for w in utf8((text or "").lower()).split()}


def features_of(word: bytes) -> list[int]:
    """Places of a word and of its starts; none of an empty one."""
    if not word:
        return []
    text = word.decode("utf-8", "replace")
    found = [zlib.crc32(b"w" + word)] + [zlib.crc32(b"s%d" % n + text[:n].encode()) for n in STARTS if len(text) >= n]
    return [x % HASHED for x in found]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _marking(a: np.ndarray, c: np.ndarray, n1: int, n0: int) -> tuple[np.ndarray, np.ndarray]:
    """Chi-squared and log odds ratio of features that a of n1 and c of n0 texts have."""
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.nan_to_num((a * (n0 - c) - c * (n1 - a)) ** 2 * (n1 + n0) / ((a + c) * (n1 + n0 - a - c) * n1 * n0))
    return chi, np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((c + 0.5) / (n0 - c + 0.5))


class Present:
    """Which features each text has: pairs of a text's place and a feature."""

    def __init__(self, sets: list[set[int]]):
        self.n = len(sets)
        self.row = np.repeat(np.arange(self.n), [len(s) for s in sets])
        self.feature = np.fromiter((f for s in sets for f in s), np.int64, len(self.row))

    def only(self, rows: np.ndarray) -> Present:
        """The texts that rows, a mask, is true of."""
        part, on = Present([]), rows[self.row]
        part.n = int(rows.sum())
        part.row, part.feature = (np.cumsum(rows) - 1)[self.row[on]], self.feature[on]
        return part

    def matrix(self, features: np.ndarray) -> np.ndarray:
        """A row for each text, a column for each of the sorted features."""
        x = np.zeros((self.n, len(features)))
        if len(features):
            at = np.minimum(np.searchsorted(features, self.feature), len(features) - 1)
            on = features[at] == self.feature
            x[self.row[on], at[on]] = 1
        return x


def kinds_of(texts: Present, toxic: np.ndarray) -> np.ndarray:
    """A row for each text: whether it is toxic and of kind a, and of kind b. Kind a is that of the surest feature."""
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    if not n1 or not n0:
        return np.zeros((texts.n, 2), bool)
    c, a = (np.bincount(texts.feature[toxic[texts.row] == k], minlength=HASHED).astype(float) for k in (0, 1))
    chi, odds = _marking(a, c, n1, n0)
    good = np.flatnonzero((chi >= CHI2) & (odds >= LOG_ODDS) & (a >= 2))
    telling = np.sort(good[np.lexsort((good, -chi[good]))][:TELLING])
    if not len(telling):
        return np.zeros((texts.n, 2), bool)
    x = texts.matrix(telling)
    own = x[toxic] - x[toxic].mean(0)
    main = np.linalg.eigh(own.T @ own)[1][:, -1]
    first = main * np.sign(main[np.argmax(chi[telling])] or 1.0) > 0
    return np.column_stack((x[:, first].any(1), x[:, ~first].any(1))) & toxic[:, None]


class Linear:
    """Logistic regression on the presence of its features, and on earlier probabilities."""

    def __init__(self) -> None:
        self.features = np.zeros(0, np.int64)
        self.w, self.b = np.zeros(0), -4.0

    def matrix(self, texts: Present, dense: np.ndarray) -> np.ndarray:
        return np.column_stack((texts.matrix(self.features), dense))

    def odds(self, texts: Present, dense: np.ndarray) -> np.ndarray:
        return self.matrix(texts, dense) @ self.w + self.b

    def fit(self, texts: Present, dense: np.ndarray, y: np.ndarray) -> Linear:
        n1, n0 = int((y == 1).sum()), int((y == 0).sum())
        self.w = np.zeros(dense.shape[1])
        if not n1 or not n0:  # one label only
            self.b = 4.0 if n1 else -4.0
            return self
        c, a = (np.bincount(texts.feature[y[texts.row] == k], minlength=HASHED).astype(float) for k in (0, 1))
        chi, odds = _marking(a, c, n1, n0)
        good = np.flatnonzero((chi >= CHI2) & (odds >= LOG_ODDS) & (a >= 2))
        self.features = np.sort(good[np.lexsort((good, -chi[good]))][:MOST_FEATURES])
        x = self.matrix(texts, dense)
        weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
        x1 = np.column_stack((x, np.ones(len(x))))
        w = np.zeros(x1.shape[1])
        ridge = np.full(len(w), RIDGE)
        ridge[-1] = 1e-9
        for _ in range(STEPS):  # Newton
            p = _sigmoid(x1 @ w)
            g = x1.T @ (weight * (p - y)) + ridge * w
            h = (x1 * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x1 + np.diag(ridge)
            w = w - np.linalg.solve(h, g)
        self.w, self.b = w[:-1], float(w[-1])
        return self


class Chain:
    def __init__(self) -> None:
        self.models: list[Linear] = []

    def fit(self, texts: list[str], toxic: list[int]) -> Chain:
        """Both labels count alike, however many texts have each."""
        seen = Present([{f for w in words_of(t) for f in features_of(w)} for t in texts])
        y = np.array(toxic, int)
        kinds = kinds_of(seen, y == 1)
        wanted = {"kind_a": kinds[:, 0], "kind_b": kinds[:, 1], "toxic": y == 1}
        fold = np.arange(len(y)) % FOLDS
        dense = np.zeros((len(y), 0))
        for name in CATEGORIES:
            want = wanted[name].astype(int)
            self.models.append(Linear().fit(seen, dense, want))
            if name != CATEGORIES[-1]:
                out = np.zeros(len(y))
                for k in range(FOLDS):
                    on, off = fold != k, fold == k
                    out[off] = _sigmoid(Linear().fit(seen.only(on), dense[on], want[on]).odds(seen.only(off), dense[off]))
                dense = np.column_stack((dense, out))
        return self

    def probabilities(self, sets: list[set[int]]) -> np.ndarray:
        """A probability for each text and category, the earlier ones fed to the later."""
        seen, dense = Present(sets), np.zeros((len(sets), 0))
        for m in self.models:
            dense = np.column_stack((dense, _sigmoid(m.odds(seen, dense))))
        return dense


class _Seen:
    """Texts' features that some model uses; what each word has of them is remembered."""

    def __init__(self, chain: Chain):
        self.used = frozenset(f for m in chain.models for f in m.features.tolist())
        self.known: dict[bytes, tuple[int, ...]] = {}

    def sets(self, texts: list[str | None]) -> list[set[int]]:
        out = []
        for text in texts:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            found: set[int] = set()
            for w in words_of(text):
                got = self.known.get(w)
                if got is None:
                    got = self.known[w] = tuple(f for f in features_of(w) if f in self.used)
                if got:
                    found.update(got)
            out.append(found)
        return out


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """A row for each row of docs: doc_id, p_kind_a, p_kind_b, p_toxic (double), toxic (int, 1 if p_toxic >= 0.5).

    A null text is an empty one, scored by the biases alone. Labels of held-out ids aren't learned from. Without labels of
    both values, all texts have one score, on that value's side. Repeated rows give repeated results; an empty table gives an empty one;
    other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    texts, toxic, _ = labelled_sample(docs, labels, id_col, text_col, label_col, SAMPLE, SAMPLE_BYTES)
    chain = Chain().fit(texts, toxic)
    plain = docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).alias("text"))
    seen = _Seen(chain)

    def rows(x):
        p = chain.probabilities(seen.sets(x["text"]))
        return {"doc_id": x["doc_id"]} | {f"p_{c}": p[:, k].tolist() for k, c in enumerate(CATEGORIES)}

    got = map_batches(plain, rows, f"doc_id {dict(plain.dtypes)['doc_id']}, " + ", ".join(f"p_{c} double" for c in CATEGORIES))
    return got.withColumn("toxic", (F.col("p_toxic") >= 0.5).cast("int"))
