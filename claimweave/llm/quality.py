"""Quality by nearest neighbours in a latent-semantic space."""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import documents, map_texts

DIMS = 2048
_LOWER, _UPPER, _DIGIT = re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+")
_REPEAT = re.compile(r"(.)\1+")
_FIRST = 4  # the dimensions before these count repeats


def shape(word: str) -> str:
    """``Thorble,`` -> ``Aa,``, ``THE!!`` -> ``A!``: runs of a kind become one sign."""
    out = _DIGIT.sub("0", _UPPER.sub("\x01", _LOWER.sub("\x02", word)))
    return _REPEAT.sub(r"\1", out)[:12]


def _slot(text: str, n: int) -> int:
    return crc32(text.encode("utf-8", "surrogatepass")) % n


class Features:
    """Hashed counts of word shapes, of shape pairs, of short words and of repeats."""

    def __init__(self, limit: int = 200_000):
        self.slots: dict[str, int] = {}
        self.limit = limit

    def _word(self, word: str) -> int:
        made = _slot(shape(word), 509) << 9 | (_slot(word.lower(), 511) if len(word) < 5 else 511)
        if len(self.slots) >= self.limit:
            self.slots.clear()
        self.slots[word] = made
        return made

    def __call__(self, text: str | None) -> np.ndarray:
        """A dense row of term frequencies, damped by a logarithm; zeros for a text without words."""
        row = np.zeros(DIMS, np.float32)
        words = (text or "").split()
        n = len(words)
        if not n:
            return row
        known, make = self.slots.get, self._word
        ids = np.array([known(w) or make(w) for w in words], np.int32)
        shapes = ids >> 9
        row[_FIRST:_FIRST + 509] = np.bincount(shapes, minlength=509)
        row[513:1024] = np.bincount(ids & 511, minlength=512)[:511]
        row[1024:] = np.bincount((shapes[:-1] * 31 + shapes[1:] * 7) & 1023, minlength=1024)
        same = sum(map(str.__eq__, words, words[1:]))
        row[0], row[1] = same, n - len(set(words))
        row[2] = sum(map(str.isupper, words))
        row[3] = n / 64
        return np.log1p(row * np.float32(256 / n))


@dataclass(frozen=True)
class NeighbourModel:
    weights: np.ndarray  # inverse document frequencies
    basis: np.ndarray  # DIMS x rank
    vectors: np.ndarray  # labelled, unit length
    labels: np.ndarray
    prior: float

    def embed(self, rows: np.ndarray) -> np.ndarray:
        out = (rows * self.weights) @ self.basis
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)

    def score(self, rows: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
        """Similarity-weighted share of label 1 among the ``k`` nearest, by exact products in blocks."""
        if not len(self.labels):
            return np.full(len(rows), self.prior)
        docs = self.embed(rows)
        k = min(k, len(self.labels))
        near = np.empty((len(docs), 0), np.float32)
        votes = np.empty((len(docs), 0), np.float32)
        for start in range(0, len(self.labels), block):
            near = np.hstack([near, docs @ self.vectors[start:start + block].T])
            votes = np.hstack([votes, np.broadcast_to(self.labels[start:start + block], (len(docs), len(self.labels[start:start + block])))])
            if near.shape[1] > k:
                top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                near, votes = np.take_along_axis(near, top, 1), np.take_along_axis(votes, top, 1)
        weight = np.clip(near, 0, 1).astype(np.float64) ** 8
        total = weight.sum(axis=1)
        blind = total < 1e-9
        share = (weight * votes).sum(axis=1) / np.where(blind, 1, total)
        return np.where(blind, self.prior, np.clip(share, 0, 1))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, rank: int = 48, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label") -> NeighbourModel:
    """Latent-semantic vectors of a bounded sample of labelled documents.

    The bound: ``max_rows`` documents, the first by a hash of their id (with fewer, all).
    Labels meet documents by id alone; the sample, ids and labels, is then broadcast to
    the texts, which are never shuffled. Executors turn whole texts into hashed rows;
    the driver gets at most ``max_rows`` rows of ``DIMS`` half-floats, weights them by
    inverse document frequency and keeps the ``rank`` strongest directions. Null labels
    and ids teach nothing; of labels that repeat an id the smallest counts, of texts that
    repeat one the smallest hashed row. Without rows every score is 0.5.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label IS NOT NULL AND doc_id IS NOT NULL")
    marks = marks.groupBy("doc_id").agg(F.min("label").alias("label"))
    picked = marks.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = documents(docs, id_col, text_col).join(F.broadcast(picked), "doc_id")

    def make():
        features = Features()

        def fn(columns):
            return {"doc_id": columns["doc_id"], "label": columns["label"], "row": [features(t).astype(np.float16).tobytes() for t in columns["text"]]}
        return fn

    got = map_texts(rows, make, "doc_id long, label int, row binary").groupBy("doc_id", "label").agg(F.min("row").alias("row")).limit(max_rows).toArrow()
    if not got.num_rows:
        return NeighbourModel(np.ones(DIMS, np.float32), np.zeros((DIMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), 0.5)
    got = got.sort_by("doc_id")
    matrix = np.stack([np.frombuffer(r, np.float16) for r in got["row"].to_pylist()]).astype(np.float32)
    labels = got["label"].to_numpy().astype(np.float32)
    weights = np.log((1 + len(matrix)) / (1 + (matrix > 0).sum(axis=0))).astype(np.float32) + 1
    weighted = matrix * weights
    # The directions of the term-document matrix, from its Gram matrix.
    values, directions = np.linalg.eigh(weighted.T @ weighted)
    basis = np.ascontiguousarray(directions[:, ::-1][:, :rank]).astype(np.float32)
    model = NeighbourModel(weights, basis, np.zeros((0, rank), np.float32), np.zeros(0, np.float32), float(labels.mean()))
    return NeighbourModel(weights, basis, model.embed(matrix), labels, float(labels.mean()))


def score(docs: DataFrame, model: NeighbourModel, k: int = 15, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, score, predicted``; whole texts, one narrow pass.

    Texts without words (null, empty) have no direction and get the share of label 1
    among the labelled rows. ``predicted`` is 1 from a score of 0.5.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit()

    def make():
        features, neighbours = Features(), sent.value

        def fn(columns):
            out = np.concatenate([
                neighbours.score(np.stack([features(t) for t in columns["text"][i:i + 512]]), k)
                for i in range(0, len(columns["text"]), 512)
            ])
            return {"doc_id": columns["doc_id"], "score": out.tolist(), "predicted": (out >= 0.5).astype(int).tolist()}
        return fn

    return map_texts(documents(docs, id_col, text_col), make, "doc_id long, score double, predicted int")
