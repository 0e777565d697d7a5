"""Document quality: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.kernels import BASE, LOWER_VALUE, blocks, mix, prefix_hash, range_hash
from tidebook.llm.runtime import id_text, returns_memory, small_batches

BITS = 18
#: Labelled rows that train at most, and the bytes of their texts at most, in the order of a hash of their id: the
#: documented bounds of the sample. Rows beyond either bound are not in it.
TRAIN_ROWS, TRAIN_BYTES = 6000, 48 << 20
PASSES = 4
#: Updates at least: small samples take more passes.
LEAST_UPDATES = 8000
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.002, 0.01
SCALE = 8.0

#: Byte classes: 0 white space, 1 letters and all bytes of longer code points, 2 digits, 3 other.
KIND = np.full(256, 3, np.uint8)
KIND[[0x20, *range(0x09, 0x0E)]] = 0
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2
UPPER = np.zeros(256, np.int32)
UPPER[65:91] = 1


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each text: indices below 2**BITS, concatenated, and their n_texts + 1 offsets.

    Tokens are runs of one byte class. A token gives its lower-cased self and its shape (class, length, case); a pair
    of neighbours gives a bigram, in which a token after its equal counts as a repeat whatever it is.
    """
    n = len(off) - 1
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    kind = KIND[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[off] = True
    change = first[:-1].copy()
    change[0] = True
    change[1:] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(change)
    end = np.append(start[1:], len(buf))
    word = kind[start] != 0
    start, end = start[word], end[word]
    at = np.searchsorted(start, off)
    with np.errstate(over="ignore"):
        h = mix(range_hash(prefix_hash(LOWER_VALUE[buf]), start, end) + (end - start).astype(np.uint64))
        upper = np.concatenate([[0], np.cumsum(UPPER[buf])])
        capitals = upper[end] - upper[start]
        size = np.minimum(end - start, 15)
        case = np.where(capitals == 0, 0, np.where(capitals == 1, 1, np.where(2 * capitals > size, 3, 2)))
        shape = mix((kind[start].astype(np.uint64) * np.uint64(64) + size.astype(np.uint64) * np.uint64(4) + case.astype(np.uint64)) * np.uint64(BASE) + np.uint64(77))
        pair = h.copy()
        if len(h) > 1:
            gap = (start[1:] > end[:-1]).astype(np.uint64)
            same = h[1:] == h[:-1]
            pair[:-1] = np.where(same, np.uint64(12345), mix(h[:-1] * np.uint64(BASE) + h[1:] + gap))
    last = at[1:] - 1
    ok = np.ones(len(h), bool)
    ok[last[at[1:] > at[:-1]]] = False
    three = np.empty((len(h), 3), np.int64)
    for j, x in enumerate((h, shape, pair)):
        three[:, j] = (x >> np.uint64(64 - BITS)).astype(np.int64)
    three[~ok, 2] = three[~ok, 1]
    return three.reshape(-1), 3 * at


def _sums(weights: np.ndarray, index: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The sparse dot product of each text: mean weight of its n-grams, scaled."""
    out = np.zeros(len(off) - 1)
    has = np.flatnonzero(np.diff(off))
    if len(has):
        out[has] = np.add.reduceat(weights[index], off[has]) / np.diff(off)[has]
    return SCALE * out


class Leader:
    """Follow the regularised leader, per coordinate, with an intercept."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, i=slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(index)
        s = float(w @ value)
        p = 1 / (1 + math.exp(-max(-35.0, min(35.0, s))))
        g = (p - label) * value
        g2 = g * g
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g2) - np.sqrt(n)) / ALPHA * w
        self.n[index] = n + g2


def fitted(rows: Iterator[tuple[np.ndarray, int]]) -> np.ndarray:
    """The weights (the last is the intercept) learnt from (n-gram indices, label) rows in their order: PASSES passes,
    or as many as make LEAST_UPDATES updates."""
    leader, kept = Leader(), []
    for index, label in rows:
        ids, counts = np.unique(index, return_counts=True)
        kept.append((np.append(ids, 1 << BITS).astype(np.int32), np.append(SCALE * counts / max(1, len(index)), 1.0).astype(np.float32), label))
    for _ in range(max(PASSES, -(-LEAST_UPDATES // max(1, len(kept))))):
        for ids, values, label in kept:
            leader.learn(ids, values, label)
    return leader.weights().astype(np.float32)


@returns_memory
def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple[np.ndarray, int]]:
        size = 0
        for batch in batches:
            for part, buf, off in blocks(batch, "text"):
                size += len(buf)
                if size > TRAIN_BYTES:
                    return
                index, at = features(buf, off)
                for i, label in enumerate(part.column("label").to_pylist()):
                    yield index[at[i] : at[i + 1]], label

    weights = fitted(rows())
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], ["weights"])


def trained(texts: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """The weights (the last is the intercept) learnt from ``labels`` (doc_id, label 0 or 1) and the texts of those
    ids. At most ``rows`` rows count, those of the smallest hash of their id, and of these the first whose texts have
    TRAIN_BYTES together; one task streams them in that order, so the weights depend on the rows alone, not on their
    partitions. Without rows all weights are 0."""
    by = [F.xxhash64("doc_id"), "doc_id"]
    chosen = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(*by).limit(rows)
    # at most ``rows`` pairs of numbers: a bounded broadcast
    sample = texts.join(F.broadcast(chosen), "doc_id").orderBy(*by, "text").limit(rows)
    got = sample.repartition(1).sortWithinPartitions(*by, "text").select("label", "text").mapInArrow(_train, "weights binary").first()
    return np.frombuffer(got["weights"], np.float32) if got else np.zeros((1 << BITS) + 1, np.float32)


def _score(weights: np.ndarray):
    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in blocks(batch, "text"):
                index, at = features(buf, off)
                s = _sums(weights, index, at) + weights[-1]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(s, -35, 35))))], ["doc_id", "score"])

    return run


def held_out(doc_id="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def _learnt(docs: DataFrame, labels: DataFrame, label_col: str) -> np.ndarray:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    return trained(id_text(docs), known.where(~held_out()))


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``; labels of held-out ids never train.

    Only the text enters a score. Null and empty texts score by the intercept; a null id is never held out; repeated
    ids each score; of several labels of one id the least counts, null labels don't; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    scored = id_text(docs).mapInArrow(_score(_learnt(docs, labels, label_col)), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _accept(weights: np.ndarray, threshold: float):
    @returns_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in blocks(batch, "text"):
                index, at = features(buf, off)
                s = _sums(weights, index, at) + weights[-1]
                yield part.filter(pa.array(1 / (1 + np.exp(-np.clip(s, -35, 35))) >= threshold))

    return run


def accepted(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any other columns, as they are) that ``quality_scores`` predicts as 1.
    One narrow pass: no join and no shuffle of texts."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_accept(_learnt(docs, labels, label_col), threshold), docs.schema)
