"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes counts of hashed byte trigrams, of pairs of byte classes and of repeated words and lines over the whole
text, damped, weighted by inverse document frequency and projected on the leading singular vectors of a labelled
sample. The sample's unit vectors and labels (at most ``LABELLED`` rows of ``DIMS`` floats: under 2 MB) are broadcast.
Every document's cosines with all of them are computed exactly, a block of documents at a time; the ``NEIGHBOURS`` most
similar vote with a weight that grows with similarity.

The labelled sample is bounded (``LABELLED`` rows, the smallest hashes of doc_id outside the held-out fifth; of a doc_id
that is repeated, one text). Only it is collected; documents stream through mapInArrow with bounded memory and no shuffle.

Defined results: null and empty texts score as the zero vector, the share of label 1 among the sample; ties between
neighbours go to the earlier sample row; very long texts are counted whole, piece by piece; of several labels of a doc_id
the highest counts; repeated rows get equal scores; without labels every score is 0.5; other columns pass through
``accepted`` whatever their names, ``score`` replaces one named like its output; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from stratalyn.llm.common import beside, held_out, map_rows, one_text_each

LABELLED = 4000
BUCKETS = 1024
REPEATS = 2.0
DIMS = 48
NEIGHBOURS = 15
SHARPNESS = 20.0
BLOCK = 256
THRESHOLD = 0.3

#: Byte classes: control, newline, space, digit, lower, upper, non-ASCII, "!", "|", "#$%&*<>", stops, the rest.
_CLASS = np.zeros(256, np.int64)
_CLASS[33:127] = 11
_CLASS[10], _CLASS[32], _CLASS[48:58], _CLASS[97:123], _CLASS[65:91], _CLASS[128:] = 1, 2, 3, 4, 5, 6
for _i, _signs in enumerate((b"!", b"|", b"#$%&*<>", b".,;:?'\"()-")):
    _CLASS[list(_signs)] = 7 + _i
N_CLASSES = 12
#: Hashed trigrams; class pairs; words like the one before, words seen before, other words, lines seen before, other lines.
PARTS = (slice(0, BUCKETS), slice(BUCKETS, BUCKETS + N_CLASSES**2), slice(BUCKETS + N_CLASSES**2, BUCKETS + N_CLASSES**2 + 5))
WIDTH = PARTS[-1].stop
PIECE = 1 << 18


def counts(raw: bytes) -> np.ndarray:
    """Counts over the whole text, piece by piece but for its words and lines."""
    out = np.zeros(WIDTH, np.int64)
    for at in range(0, len(raw), PIECE):
        b = np.frombuffer(raw, np.uint8, min(PIECE + 2, len(raw) - at), at).astype(np.uint32)
        if len(b) > 2:
            h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
            out[PARTS[0]] += np.bincount((h >> np.uint32(16)) % BUCKETS, minlength=BUCKETS)
        c = _CLASS[b[: PIECE + 1]]
        if len(c) > 1:
            out[PARTS[1]] += np.bincount(c[:-1] * N_CLASSES + c[1:], minlength=N_CLASSES * N_CLASSES)
    words, lines = raw.split(), raw.split(b"\n")
    same, kinds, line_kinds = sum(map(eq, words, words[1:])), len(set(words)), len(set(lines))
    out[PARTS[2]] = same, len(words) - kinds - same if len(words) - kinds > same else 0, kinds, len(lines) - line_kinds, line_kinds
    return out


def damped(n: np.ndarray) -> np.ndarray:
    """Each part as shares of its sum, damped by a square root; words and lines count ``REPEATS`` times."""
    n = np.atleast_2d(n).astype(np.float32)
    for part in PARTS:
        n[:, part] = np.sqrt(n[:, part] / np.maximum(n[:, part].sum(axis=1, keepdims=True), 1))
    n[:, PARTS[2]] *= REPEATS
    return n


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # inverse document frequencies
    axes: np.ndarray  # WIDTH x DIMS
    vectors: np.ndarray  # unit vectors of the labelled sample
    labels: np.ndarray

    def latent(self, damped_counts: np.ndarray) -> np.ndarray:
        v = ((damped_counts * self.weights) @ self.axes).astype(np.float64)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, damped_counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(damped_counts), 0.5)
        like = self.latent(damped_counts) @ self.vectors.T
        k = min(NEIGHBOURS, like.shape[1])
        near = np.argsort(-np.round(like, 9), axis=1, kind="stable")[:, :k]
        vote = np.exp(SHARPNESS * (np.take_along_axis(like, near, axis=1) - 1))
        found = (vote * self.labels[near]).sum(axis=1) / vote.sum(axis=1)
        empty = ~damped_counts[:, PARTS[0]].any(axis=1)
        return np.clip(np.where(empty, self.labels.mean(), found), 0.0, 1.0)


def _leading(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` leading right singular vectors, by seeded subspace iteration."""
    q = np.random.default_rng(0).standard_normal((x.shape[1], k + 16)).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ vt.T)[:, :k])


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> Model:
    """Learn from at most ``bound`` labelled documents, one text a doc_id; their counts, not their texts, reach the driver."""
    able = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = able.groupBy("doc_id").agg(F.max("quality").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [counts(x.as_buffer().to_pybytes() if x.is_valid else b"").astype("<u4").tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["h", "label", "n"])

    sample = one_text_each(docs, ids).select(F.xxhash64("doc_id").alias("h"), F.col("label").cast("int"), F.col("text").cast("binary"))
    rows = sorted(sample.mapInArrow(run, "h long, label int, n binary").collect(), key=lambda r: (r.h, bytes(r.n)))
    if not rows:
        return Model(np.ones(WIDTH), np.zeros((WIDTH, DIMS)), np.zeros((0, DIMS)), np.zeros(0))
    marks = np.array([float(r.label) for r in rows])
    x = damped(np.stack([np.frombuffer(r.n, "<u4") for r in rows]))
    del rows
    weights = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    x *= weights
    axes = _leading(x, DIMS)
    v = x @ axes
    return Model(weights, axes, v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12), marks)


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with ``out``, the similarity-weighted share of label 1 (a column that has this name is replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(raw: pa.Array) -> pa.Array:
        scores = [np.zeros(0)]
        for at in range(0, len(raw), BLOCK):
            block = np.stack([counts(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in raw[at : at + BLOCK]])
            scores.append(shared.value.score(damped(block)))
        return pa.array(np.concatenate(scores), pa.float64())

    return map_rows(docs, F.col("text").cast("binary"), run, out, DoubleType())


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of op6."""
    found = score(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text"), labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    name = beside(docs, "score")
    return score(docs, fit(docs.select("doc_id", "text"), labels), out=name).where(F.col(name) >= THRESHOLD).drop(name)
