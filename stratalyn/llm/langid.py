"""Language identification by prediction by partial matching.

For every language a variable-order tree of byte contexts (up to ``ORDER`` bytes) is learned from a bounded sample and
frozen. The code length of a byte is that of escape method C: coded in the longest known context that has seen it,
after an escape from each longer one, down to a uniform order. The trees of all languages share one table of the pairs
of context and byte that occur in any sample, with the pair's code length in each language, and one of the escapes;
scoring a text looks its bytes up in numpy, longest context first, exactly. The language with the shortest code for the
whole text wins.

The alphabet is all 256 bytes and the start of a text. Bytes that no sample holds are in no context and cost the same
everywhere, so they share one symbol; that changes no code length. No context and no pair is left out, and the tables
follow the bounded sample in size.

The sample is bounded: ``PER_LANG`` documents of each of the ``LANGUAGES`` languages with most documents, the smallest
hashes of doc_id outside the held-out fifth, of at most ``MOST_BYTES`` each (so 2.5 MB a language at most), and of a doc_id
that is repeated one text. Texts are scored whole, streaming through mapInArrow; only ids are shuffled.

Defined results: null texts and texts without a letter (Unicode category L) are ``und`` with score 0; very long texts are
scored whole, piece by piece; ties go to the first language in code point order; without any learned language every text
is ``und``; repeated rows get equal results; bytes that are not UTF-8 count as replacement characters; other columns are
ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalyn.llm.common import held_out

ORDER = 3
PER_LANG = 150
SYMBOLS = 257
PIECE = 1 << 18
MOST_BYTES = 1 << 14
LANGUAGES = 64
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    languages: list[str]
    symbol: np.ndarray  # byte to symbol
    node: np.ndarray  # the last ORDER symbols, packed, to the longest known context
    shorter: np.ndarray  # context to the context without its first symbol
    escape: np.ndarray  # context x language: bits of an escape to the shorter context
    keys: np.ndarray  # known pairs of context and symbol, sorted by place in ``buckets``
    buckets: np.ndarray  # first place of each hash bucket of ``keys``
    bits: np.ndarray  # known pair x language: code length
    width: int  # number of symbols

    def _row(self, at: np.ndarray, s: np.ndarray) -> np.ndarray:
        """The known pair of each context and symbol, -1 where it is not known."""
        key = at * self.width + s
        bucket = _bucket(key, len(self.buckets) - 1)
        place, end = self.buckets[bucket], self.buckets[bucket + 1]
        out, left = np.full(len(key), -1), np.flatnonzero(place < end)
        while len(left):
            hit = self.keys[place[left]] == key[left]
            out[left[hit]] = place[left[hit]]
            left = left[~hit]
            place[left] += 1
            left = left[place[left] < end[left]]
        return out

    def code_lengths(self, raw: bytes) -> np.ndarray:
        """Bits of the whole text in each language."""
        total, n = np.zeros(len(self.languages)), self.width
        tail = np.zeros(ORDER, np.int64)  # the start symbol is 0
        for begin in range(0, len(raw), PIECE):
            s = np.concatenate((tail, self.symbol[np.frombuffer(raw, np.uint8, min(PIECE, len(raw) - begin), begin)]))
            packed = s[:-ORDER].copy()
            for i in range(1, ORDER):
                packed = packed * n + s[i : i - ORDER]
            at, s = self.node[packed].astype(np.int64), s[ORDER:]
            tail = np.concatenate((tail, s))[-ORDER:]
            while len(at):
                row = self._row(at, s)
                miss = row < 0
                total += self.bits[row[~miss]].sum(axis=0, dtype=np.float64)
                at, s = at[miss], s[miss]
                total += self.escape[at].sum(axis=0, dtype=np.float64)
                total += np.log2(SYMBOLS) * int((at == 0).sum())
                at, s = self.shorter[at[at > 0]], s[at > 0]
        return total

    def predict(self, raw: bytes | None) -> tuple[str, float]:
        if raw is None or not self.languages or not (re.search(rb"[A-Za-z]", raw) or _LETTER.search(raw.decode())):
            return "und", 0.0
        bits = self.code_lengths(raw)
        best = int(np.argmin(np.round(bits, 6)))
        # posterior under equal priors, per 16 bytes, so that long texts keep graded scores
        return self.languages[best], float(1 / np.exp2(-(bits - bits[best]) * min(1.0, 16 / len(raw))).sum())


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)


def train(samples: dict[str, list[bytes]]) -> Model:
    """Frozen statistics of each language's sample; tables hold what occurs, so their size follows the sample."""
    names = sorted(samples)
    seen = np.bincount(np.frombuffer(b"".join(b"".join(v) for v in samples.values()), np.uint8), minlength=256)
    own = np.flatnonzero(seen)
    symbol = np.ones(256, np.int64)  # 0: start, 1: any byte that no sample holds
    symbol[own] = np.arange(2, 2 + len(own))
    n = 2 + len(own)
    streams = {k: [np.concatenate((np.zeros(ORDER, np.int64), symbol[np.frombuffer(x, np.uint8)])) for x in v] for k, v in samples.items()}

    def grams(lang: str, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Packed (context, symbol) of an order, and counts."""
        packed = [sum(s[ORDER - order + i : len(s) - order + i] * n ** (order - i) for i in range(order + 1)) for s in streams[lang]]
        return np.unique(np.concatenate(packed or [np.zeros(0, np.int64)]), return_counts=True)

    node, first = np.zeros(n**ORDER, np.int32), 0
    keys, bits, escape, shorter, below, known = [], [], [], [], None, None
    for order in range(ORDER + 1):
        counted = {k: grams(k, order) for k in names}
        pairs = np.unique(np.concatenate([v[0] for v in counted.values()] or [np.zeros(0, np.int64)]))
        contexts, at = np.unique(pairs // n, return_inverse=True) if order else (np.zeros(1, np.int64), np.zeros(len(pairs), np.int64))
        suffix = contexts % n ** max(order - 1, 0)
        lower = np.full((len(pairs), len(names)), np.log2(SYMBOLS))
        if order:  # a pair's suffix occurs wherever the pair does
            lower = below[1][np.searchsorted(below[0], suffix[at] * n + pairs % n)]
            # every context of full length points to its longest known suffix: longer ones are written over shorter ones
            node.reshape(-1, n**order)[:, contexts] = first + np.arange(len(contexts))
        length, away = np.empty((len(pairs), len(names))), np.empty((len(contexts), len(names)))
        for j, k in enumerate(names):
            c = np.zeros(len(pairs))
            c[np.searchsorted(pairs, counted[k][0])] = counted[k][1]
            total, kinds = np.bincount(at, c, len(contexts)), np.bincount(at, c > 0, len(contexts))
            with np.errstate(divide="ignore", invalid="ignore"):
                away[:, j] = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                length[:, j] = np.where(c > 0, -np.log2(c / (total + kinds)[at]), away[at, j] + lower[:, j])
        shorter.append(known[1] + np.searchsorted(known[0], suffix) if order else np.zeros(1, np.int64))
        keys.append((first + at) * n + pairs % n)
        bits.append(length)
        escape.append(away)
        below, known, first = (pairs, length), (contexts, first), first + len(contexts)
    key, length = np.concatenate(keys), np.concatenate(bits)
    size = 1 << max(4, len(key).bit_length())
    order = np.argsort(_bucket(key, size), kind="stable")
    buckets = np.searchsorted(_bucket(key, size)[order], np.arange(size + 1))
    return Model(names, symbol, node, np.concatenate(shorter), np.concatenate(escape), key[order], buckets, length[order].astype(np.float32), n)


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Learn from at most ``per_lang`` documents of each language, picked by hash of doc_id (a bounded sample).

    Ids are ranked per language in two steps, within slices of the hash and then among the slices' first, so that a
    language that holds most rows is never ranked in one task; only the chosen texts reach the driver.
    """
    able = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (F.octet_length("text") <= MOST_BYTES))
    names = able.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang")
    # one row a language and doc_id, however often it is repeated
    ids = able.groupBy("lang", "doc_id").agg(F.min(F.xxhash64("text")).alias("t")).join(F.broadcast(names), "lang").withColumn("h", F.xxhash64("doc_id"))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id"))
    sliced = ids.withColumn("slice", F.pmod("h", F.lit(64))).withColumn("r", rank("lang", "slice")).where(F.col("r") <= per_lang)
    chosen = sliced.withColumn("r", rank("lang")).where(F.col("r") <= per_lang).select("lang", "doc_id", "t")
    found = able.select("lang", "doc_id", F.xxhash64("text").alias("t"), F.make_valid_utf8("text").alias("text")).join(F.broadcast(chosen), ["lang", "doc_id", "t"])
    texts = found.groupBy("lang", "doc_id").agg(F.min("text").cast("binary").alias("raw"))
    samples: dict[str, list[bytes]] = {}
    for r in texts.orderBy("lang", "doc_id").collect():
        samples.setdefault(r.lang, []).append(bytes(r.raw))
    return train(samples) if samples else train({})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.predict(x.as_buffer().to_pybytes() if x.is_valid else None) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.make_valid_utf8("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def report(docs: DataFrame) -> DataFrame:
    """The columns of op9."""
    found = identify(docs, fit(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
