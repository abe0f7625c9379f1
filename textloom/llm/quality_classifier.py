"""Quality classifier: supervised subword embeddings.

Hashed word, word-pair and character n-gram vectors are averaged over a document and go through a softmax of two
classes; vectors and output weights are learned by stochastic gradient descent in numpy, on a bounded sample of
labelled documents. The output is linear in the mean vector, so that a trained model is one number for each bucket
and a bias: that is what travels to the executors, of fixed size, and a word's share is kept for its next occurrence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, batch, fold_of, labelled_sample


@dataclass(frozen=True)
class Settings:
    """`sample`: the most labelled rows that the fit uses, of texts of `longest` bytes at most; everything else covers all
    rows and whole texts."""

    sample: int = 4000
    longest: int = 32_768
    buckets: int = 1 << 16
    dim: int = 8
    epochs: int = 6
    rate: float = 0.3
    grams: tuple[int, ...] = (3, 4)
    seed: int = 7


#: Longer words, in bytes, are worked out each time, so that the kept ones are of bounded size.
LONG = 64


class Features:
    """Bucket ids of a text: each word, all its character n-grams within < and >, whatever its length, and each pair of
    neighbouring words (a word after itself has a bucket of its own)."""

    def __init__(self, s: Settings, most: int = 200_000):
        self.s, self.most = s, most
        self.words: dict[bytes, np.ndarray] = {}

    def word(self, w: bytes) -> np.ndarray:
        f = self.words.get(w)
        if f is None:
            mark = b"<" + w + b">"
            ids = chain((zlib.crc32(w),), (zlib.crc32(mark[i : i + k], k) for k in self.s.grams for i in range(len(mark) - k + 1)))
            f = np.fromiter(ids, "u4")
            f %= np.uint32(self.s.buckets)
            if len(w) <= LONG:
                if len(self.words) >= self.most:
                    self.words.clear()
                self.words[w] = f
        return f

    def pairs(self, first: np.ndarray) -> np.ndarray:
        """Buckets of the word pairs, from the words' own buckets."""
        a, b = first[:-1].astype("u8"), first[1:].astype("u8")
        return np.where(a == b, 1, ((a * np.uint64(0x9E3779B1) + b * np.uint64(0x85EBCA77)) >> np.uint64(7)) % np.uint64(self.s.buckets)).astype("i8")

    def text(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct buckets of a whole text and their shares of its features."""
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if not words:
            return np.empty(0, "i8"), np.empty(0)
        each = [self.word(w) for w in words]
        first = np.fromiter((e[0] for e in each), "i8", len(each))
        n = np.bincount(np.concatenate([*each, self.pairs(first)]), minlength=self.s.buckets)
        ids = np.flatnonzero(n)
        return ids, n[ids] / n.sum()


@dataclass(frozen=True)
class Model:
    settings: Settings
    weight: np.ndarray
    bias: float


def fit(rows: list[tuple[str, int]], settings: Settings = Settings()) -> Model:
    """Train on (text, 0 or 1) rows. Without rows of both labels every score is the share of label 1 (one half without any)."""
    s = settings
    y = np.array([v for _, v in rows], "f8")
    if not len(rows) or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(rows) else 0.5
        return Model(s, np.zeros(s.buckets, "f4"), float(np.log(share / (1 - share))))
    feats = Features(s)
    x = [feats.text(t) for t, _ in rows]
    rng = np.random.default_rng(s.seed)
    e = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim))
    w = np.zeros((2, s.dim))
    b = np.zeros(2)
    steps, done = s.epochs * len(rows), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(rows)):
            rate = s.rate * (1 - done / steps)
            done += 1
            ids, share = x[i]
            if not len(ids):
                continue
            h = share @ e[ids]
            z = w @ h + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(y[i])] -= 1
            back = w.T @ p
            w -= rate * np.outer(p, h)
            b -= rate * p
            e[ids] -= rate * len(ids) ** 0.5 * np.outer(share, back)
    return Model(s, (e @ (w[1] - w[0])).astype("f4"), float(b[1] - b[0]))


class Scorer:
    def __init__(self, model: Model, most: int = 250_000):
        self.m, self.most = model, most
        self.feats = Features(model.settings, 1000)
        self.known: dict[bytes, tuple[float, int, int]] = {}

    def _learn(self, w: bytes) -> tuple[float, int, int]:
        f = self.feats.word(w)
        v = (float(self.m.weight[f].sum()), len(f), int(f[0]))
        if len(self.known) < self.most and len(w) <= LONG:
            self.known[w] = v
        return v

    def score(self, text: str | None) -> float:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if not words:
            return float(1 / (1 + np.exp(-self.m.bias)))
        known = self.known
        each = np.array([known.get(w) or self._learn(w) for w in words])
        pairs = self.feats.pairs(each[:, 2])
        total = each[:, 0].sum() + float(self.m.weight[pairs].sum())
        z = total / (each[:, 1].sum() + len(pairs)) + self.m.bias
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of docs; null and empty texts get the model's prior.

    Repeated rows are scored alike; a null id counts as held out; other columns are left aside.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in it:
            p = np.array([scorer.score(t) for t in b.column(2).to_pylist()], "f8")
            yield batch(**{id_col: b.column(0)}, held_out=b.column(1), score=pa.array(p), predicted=pa.array((p >= threshold).astype("i4")))

    d = docs.select(id_col, (fold_of(F.col(id_col)) == 0).alias("held_out"), text_col)
    return arrow_pass(d, run, f"`{id_col}` {id_type}, held_out boolean, score double, predicted int")


def quality_classifier(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fit on labels.quality outside the held-out fold, then score all documents."""
    return score(docs, fit(labelled_sample(docs, labels, "quality", settings.sample, settings.longest), settings))
