"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learnt from labels of documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, hash_piece, hash_share, pack, text_buffers

#: Bounds of the training sample: documents by class, bytes of all their texts, and of one. All texts are scored.
SAMPLE_DOCS = {1: 1500, 0: 2500}
LEARN_BYTES = 24 << 20
LEARN_LONGEST = 4 << 20
#: A word is a feature if so many documents of the sample have it.
MIN_DOCS = 6
#: A sentence offends from this score on.
OFFENDS = 0.5
#: Steepness of a sentence's sigmoid, in training and scoring alike; of these, calibration rows choose. A steeper one parts sentences
#: further with the same weights, so thousands of clean sentences add up to less.
STEEP = (1.0, 2.0, 4.0)
#: One learning row in so many calibrates.
CALIBRATE = 5

#: Besides whole words, their first so many bytes are features: inflected forms share them.
HEADS = (4, 5, 6)

_byte = np.arange(256)
#: Words are runs of ASCII letters and digits, apostrophes, and all other letters' bytes.
BREAKS = ~((_byte >= 128) | ((_byte >= 48) & (_byte <= 57)) | ((_byte | 32) >= 97) & ((_byte | 32) <= 122) | (_byte == 39))
#: Sentences end at . ! ? and line ends.
ENDS = np.isin(_byte, [10, 13, 33, 46, 63])


def sentence_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes of a text's words (a row by kind), their sentence numbers, and the sentences' first and last byte (exclusive)."""
    starts, ends, hashes = hash_piece(raw, True, BREAKS, HEADS)
    number = np.concatenate(([0], np.cumsum(ENDS[raw])))
    _, first, sentence = np.unique(number[starts], return_index=True, return_inverse=True)
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    return hashes, sentence, starts[first], ends[last]


@dataclass
class Model:
    """Weights of words, which are kept by their full hash: others weigh nothing and none collide."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def sentences(self, hashes: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        """Log-odds of each of n sentences."""
        if not len(self.words):
            return np.full(n, self.bias)
        out = np.full(n, self.bias)
        for row in hashes:
            at = np.minimum(np.searchsorted(self.words, row), len(self.words) - 1)
            known = np.flatnonzero(self.words[at] == row)
            out += np.bincount(sentence[known], self.weights[at[known]], n)
        return out


def noisy_or(z: np.ndarray) -> float:
    """1 less the product of 1 - sigmoid(z)."""
    return float(-np.expm1(-np.logaddexp(0, z).sum()))


def loss(model: Model, docs: list[tuple[int, np.ndarray, np.ndarray]]) -> float:
    """Mean log-loss of noisy-or against the documents' labels."""
    none = [np.logaddexp(0, model.sentences(h, s, int(s.max()) + 1 if len(s) else 0)).sum() for _, h, s in docs]
    return float(np.mean([-np.log(max(-np.expm1(-n), 1e-9)) if y else min(n, 20.0) for (y, _, _), n in zip(docs, none)]))


def fit(docs: list[tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """The model of all docs with the steepness that, learnt from the rest, does best on every CALIBRATE-th."""
    held, rest = docs[::CALIBRATE], [d for i, d in enumerate(docs) if i % CALIBRATE]
    if not held or len({y for y, _, _ in rest}) < 2:
        return train(docs, STEEP[0])
    return train(docs, min(STEEP, key=lambda steep: loss(train(rest, steep), held)))


def gradient(w: np.ndarray, b: float, at: np.ndarray, sentence: np.ndarray, doc: np.ndarray, y: np.ndarray, steep: float = 1.0) -> tuple[np.ndarray, float]:
    """Of the mean log-loss by weights and bias. at: word numbers, sentence: theirs; doc: each sentence's document; y: labels."""
    z = np.clip(steep * (np.bincount(sentence, w[at], len(doc)) + b), -30, 30)
    none = np.bincount(doc, np.logaddexp(0, z), len(y))  # -log of the chance of no toxic sentence
    pull = np.where(y == 1, -np.exp(-none) / np.maximum(-np.expm1(-none), 1e-9), 1.0)
    dz = steep * pull[doc] / (1 + np.exp(-z)) / len(y)
    return np.bincount(at, dz[sentence], len(w)).astype(float), float(dz.sum())  # without a word counts are whole numbers


def train(docs: list[tuple[int, np.ndarray, np.ndarray]], steep: float = 1.0, epochs: int = 20, rate: float = 1.0, l2: float = 1e-5, seed: int = 5) -> Model:
    """docs: label, feature hashes and sentence numbers. Adaptive gradient steps on batches of documents. The model's weights include the steepness."""
    docs = [(y, h[h != 0], np.tile(s, len(h))[h.ravel() != 0]) for y, h, s in docs if h.size]
    if not docs or len({d[0] for d in docs}) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -9.0)
    seen, df = np.unique(np.concatenate([np.unique(d[1]) for d in docs]), return_counts=True)
    words = seen[df >= MIN_DOCS]
    parts = []  # label, word numbers, sentence numbers, sentences
    for y, h, s in docs:
        n = int(s.max()) + 1
        at = np.minimum(np.searchsorted(words, h), max(0, len(words) - 1))
        known = words[at] == h if len(words) else np.zeros(len(h), bool)
        parts.append((y, at[known], s[known], n))
    w, b = np.zeros(len(words)), -6.0
    gw, gb = np.full(len(words), 1e-3), 1e-3
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(parts))
        for k in range(0, len(order), 64):
            batch = [parts[i] for i in order[k : k + 64]]
            sizes = np.array([p[3] for p in batch])
            base = np.concatenate(([0], np.cumsum(sizes)))
            at = np.concatenate([p[1] for p in batch])
            sent = np.concatenate([p[2] + o for p, o in zip(batch, base)])
            doc = np.repeat(np.arange(len(batch)), sizes)
            g, db = gradient(w, b, at, sent, doc, np.array([p[0] for p in batch]), steep)
            g += l2 * w
            gw += g * g
            gb += db * db
            w -= rate * g / np.sqrt(gw)
            b -= 0.3 * rate * db / np.sqrt(gb)
    return Model(words, steep * w, float(steep * b))


def training_docs(docs: DataFrame, labels: DataFrame, learn: Column, text: str, key: str, label: str) -> list[tuple[int, np.ndarray, np.ndarray]]:
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & F.coalesce(learn, F.lit(False))).groupBy(F.col(key).alias("_k")).agg(F.max(label).cast("int").alias("_y"))
    sizes = {r["_y"]: r["n"] for r in marked.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.when(F.col("_y") == 1, min(1.0, SAMPLE_DOCS[1] / sizes.get(1, 1))).otherwise(min(1.0, SAMPLE_DOCS[0] / sizes.get(0, 1)))
    sample = F.broadcast(marked.where(hash_share(F.col("_k"), 21) < rate))  # its size is bounded by SAMPLE_DOCS

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffers(batch.column(1))
            rows = []
            for i, y in enumerate(batch.column(0).to_pylist()):
                h, s, _, _ = sentence_words(raw[off[i] : off[i + 1]])
                rows.append((y, pack(h), pack(s.astype(np.int32))))
            columns = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["y", "h", "s"])

    chosen = docs.select(F.col(key).alias("_d"), F.col(text).alias("_text")).where(F.coalesce(F.octet_length("_text"), F.lit(0)) <= LEARN_LONGEST).join(sample, F.col("_d") == F.col("_k"))
    # of long texts fewer are learnt from, by the key's hash and not by their length
    n_bytes = chosen.agg(F.sum(F.octet_length("_text").cast("long"))).first()[0] or 0
    if n_bytes > LEARN_BYTES:
        chosen = chosen.where(hash_share(F.col("_k"), 22) < LEARN_BYTES / n_bytes)
    got = chosen.select("_y", "_text").mapInArrow(features, "y int, h binary, s binary").collect()
    rows = [(r.y, np.frombuffer(r.h, np.uint64).reshape(1 + len(HEADS), -1), np.frombuffer(r.s, np.int32)) for r in got]
    return sorted(rows, key=lambda r: (r[0], r[1].size, r[1].tobytes()))


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """Per document: key, score (0 to 1), predicted (1 from 0.5 on) and offending: its sentences at or over OFFENDS.

    offending holds (first byte, last byte exclusive, score) of each such sentence in the UTF-8 text. Learns from a sample
    of labels rows for which ``learn`` holds, bounded by SAMPLE_DOCS, LEARN_BYTES and LEARN_LONGEST; a doc_id that is labelled twice counts as toxic
    if any row says so. Whole texts are scored, from the text alone. Null and empty texts, and all texts if there
    are no labels of both classes, have no toxic sentence and a score near 0. Repeated rows get equal results. One pass without a shuffle.
    """
    model = fit(training_docs(docs, labels, F.lit(True) if learn is None else learn, text, key, label))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            raw, off = text_buffers(batch.column(1))
            scores, where = [], []
            for i in range(len(off) - 1):
                logs, bad = [], []
                for base, piece in _pieces(raw[off[i] : off[i + 1]]):
                    h, s, first, last = sentence_words(piece)
                    z = model.sentences(h, s, len(first))
                    logs.append(z)
                    bad += [{"first": int(first[j]) + base, "last": int(last[j]) + base, "score": float(1 / (1 + np.exp(-z[j])))} for j in np.flatnonzero(z >= np.log(OFFENDS / (1 - OFFENDS)))]
                scores.append(noisy_or(np.concatenate(logs)) if logs else 0.0)
                where.append(bad)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32()), pa.array(where, found)], ["key", "score", "predicted", "offending"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(score, f"key {kind}, score double, predicted int, offending array<struct<first:long,last:long,score:double>>").withColumnRenamed("key", key)


def _pieces(raw: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """A text, or parts of a very long one that end with a sentence."""
    at = 0
    while at < len(raw):
        to = at + CHUNK_BYTES
        if to < len(raw):
            found = np.flatnonzero(ENDS[raw[to : to + CHUNK_BYTES]])
            to = to + int(found[0]) + 1 if len(found) else to + CHUNK_BYTES
        yield at, raw[at:to]
        at = to
