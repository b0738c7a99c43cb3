"""A quality classifier: n-gram indicators scaled by log-count ratios, then a linear hinge-loss model.

The labelled sample's indicators of hashed words and pairs of words are scaled by r, the log of the ratio of
their shares in the good and the bad class; dual coordinate descent fits a support vector machine on them. A
logistic curve, fitted on a fifth of the sample that the machine didn't see, turns margins into scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, crc32_of_id, table, texts_in_pieces
from .quality_rules import Words, words_of

BITS = 18
#: Labelled rows that are learned from at most: those with the smallest crc32 of their id.
SAMPLE = 6_000
#: Penalty of the hinge loss, rounds over the sample, added count, share of the scaled features against their mean.
PENALTY, ROUNDS, ADDED = 1.0, 20, 1.0
THRESHOLD = 0.3
MIX = np.uint64(0x9E3779B97F4A7C15)
#: What stands for every pair of equal words.
SAME = np.uint64(2**63 + 1)


def features(words: list[bytes], known: Words) -> np.ndarray:
    """The indicators that are on: hashed words and pairs of words, each once, and one for any pair of equal words."""
    if not words:
        return np.empty(0, dtype=np.int64)
    h = known.hashed(words)
    pairs = h[:-1] * np.uint64(31) + h[1:] * np.uint64(1_000_003) + np.uint64(7)
    pairs = np.append(pairs, SAME) if (h[1:] == h[:-1]).any() else pairs
    return np.unique((np.concatenate((h, pairs)) * MIX) >> np.uint64(64 - BITS)).astype(np.int64)


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    counts = [np.full(1 << BITS, ADDED), np.full(1 << BITS, ADDED)]
    for x, y in zip(rows, good):
        counts[int(y)][x] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def descend(rows: list[np.ndarray], signs: np.ndarray, scale: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Dual coordinate descent for min |w|²/2 + C sum max(0, 1 - y w.x), rows x = scale[indices] / their norm, a last weight for the bias. Classes weigh the same in sum."""
    w = np.zeros(len(scale) + 1)
    values = [np.append(scale[x], 1.0) for x in rows]
    values = [v / np.sqrt(v @ v) for v in values]
    indices = [np.append(x, len(scale)) for x in rows]
    alpha = np.zeros(len(rows))
    upper = penalty * len(rows) / 2 / np.where(signs > 0, max(1, (signs > 0).sum()), max(1, (signs < 0).sum()))
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            x, v, y = indices[i], values[i], signs[i]
            gradient = y * float(w[x] @ v) - 1
            if (alpha[i] == 0 and gradient >= 0) or (alpha[i] == upper[i] and gradient <= 0):
                continue
            new = min(max(alpha[i] - gradient, 0.0), upper[i])  # rows have norm 1
            step = new - alpha[i]
            largest = max(largest, abs(step))
            alpha[i] = new
            w[x] += step * y * v
        if largest < 1e-3:
            break
    return w


def margin(x: np.ndarray, w: np.ndarray, scale: np.ndarray) -> float:
    v = scale[x]
    return float(w[x] @ v + w[-1]) / np.sqrt(v @ v + 1.0)


def logistic(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))), by Newton's method on smoothed targets."""
    n, p = (~good).sum(), good.sum()
    target = np.where(good, (p + 1) / (p + 2), 1 / (n + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((s - target) * margins).sum(), (s - target).sum()])
        q = s * (1 - s)
        h = np.array([[(q * margins * margins).sum() + 1e-6, (q * margins).sum()], [(q * margins).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(max(a, 0.0)), float(b)


class Classifier:
    def __init__(self, rows: list[np.ndarray], good: np.ndarray) -> None:
        """Without both classes every text gets the share of the one there is, or 0.5."""
        self.scale, self.w, self.a, self.b = np.zeros(1 << BITS), np.zeros((1 << BITS) + 1), 0.0, 0.0
        if not (good.any() and (~good).any()):
            self.b = 0.0 if not len(good) else 3.0 if good.all() else -3.0
            return
        check = np.arange(len(rows)) % 5 == 4
        if not (good[check].any() and (~good[check]).any() and good[~check].any() and (~good[~check]).any()):
            check = np.zeros(len(rows), dtype=bool)
        learn = [r for r, c in zip(rows, check) if not c]
        self.scale = log_count_ratios(learn, good[~check])
        self.w = descend(learn, np.where(good[~check], 1.0, -1.0), self.scale)
        seen = [i for i in range(len(rows)) if check[i] or not check.any()]
        self.a, self.b = logistic(np.array([margin(rows[i], self.w, self.scale) for i in seen]), good[seen])

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * margin(x, self.w, self.scale) + self.b, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Learns from at most `sample` labelled rows whose crc32(doc_id) mod 5 is not 0. Null ids and labels don't count; of several labels of an id the least does."""
    spark = docs.sparkSession
    train = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(crc32_of_id() % 5 != 0).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = [(r.doc_id, r.quality, r.at) for r in train.select("doc_id", F.col("quality").cast("int").alias("quality"), crc32_of_id().alias("at")).orderBy("at", "doc_id").limit(sample).collect()]
    small = spark.createDataFrame(chosen, "doc_id long, quality int, at long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(small), "doc_id")  # at most `sample` ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        schema = pa.schema([("at", pa.int64()), ("doc_id", pa.int64()), ("quality", pa.int32()), ("features", pa.binary())])
        for b in texts_in_pieces(batches, "text"):
            yield batch(schema, at=b.column("at"), doc_id=b.column("doc_id"), quality=b.column("quality"), features=[features(words_of(t), known).astype(np.int32).tobytes() for t in b.column("text").to_pylist()])

    found = sorted((r.at, r.doc_id, bytes(r.features), r.quality) for r in rows.mapInArrow(run, "at long, doc_id long, quality int, features binary").toLocalIterator())
    return Classifier([np.frombuffer(f[2], dtype=np.int32).astype(np.int64) for f in found], np.array([f[3] == 1 for f in found], dtype=bool))


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def predict(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, held_out, score, predicted of each row, from its whole text alone. Null and empty texts have no n-gram and get the score of the bias; repeated rows are each scored; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = Words(), shared.value
        for b in texts_in_pieces(batches, "text"):
            scores = [model.score(features(words_of(t), known)) for t in b.column("text").to_pylist()]
            yield batch(SCORED, doc_id=b.column("doc_id"), held_out=b.column("held_out"), score=scores, predicted=[int(s >= THRESHOLD) for s in scores])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc32_of_id() % 5 == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs, table(spark, sf_dir, "labels")))
