"""Quality rules and a log-likelihood ratio of hashed n-grams: trusted target against the raw corpus.

Words and pairs of words are hashed into buckets. The raw multinomial counts every document; the target counts
every row labelled as good. A document's score is the mean over its n-grams, and a few of ratio 0,
of log p(target) - log p(raw); the threshold is a low quantile of the trusted rows' own scores, so every document gets the
same verdict whenever it is asked for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, mark, marked, marks, materialize, table, texts_in_pieces

#: Buckets of the hashed n-grams; the counts that reach the driver have as many rows.
BUCKETS = 1 << 16
#: Added to every count, in buckets' shares of a sample of as many n-grams.
SMOOTHING = 1.0
#: The share of trusted rows that may lie below the threshold, and how far below that quantile it is put.
QUANTILE, MARGIN = 0.001, 0.05
#: n-grams of ratio 0 that are added to a text's own, so that a few words don't condemn a short text.
PRIOR = 20
#: Base rules: fixed values.
MIN_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MIX = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Numbers for words as they come, and a hash for each number."""

    def __init__(self, most: int = 400_000) -> None:
        self.most, self.hashes = most, np.empty(1024, dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        if n >= len(self.hashes):
            self.hashes = np.concatenate((self.hashes, np.empty_like(self.hashes)))
        self.hashes[n] = zlib.crc32(word.lower()) | (len(word) & 255) << 32
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers, which hold until the next call."""
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))

    def hashed(self, words: list[bytes]) -> np.ndarray:
        at = self.numbers(words)
        return self.hashes[at]


def words_of(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    """The buckets of a text's words and pairs of words."""
    pairs = hashes[:-1] * np.uint64(31) + hashes[1:] * np.uint64(1_000_003) + np.uint64(7)
    return ((np.concatenate((hashes, pairs)) * MIX) >> np.uint64(48)).astype(np.int64)


def repeated_words(numbers: np.ndarray) -> int:
    """Words in windows of five that occur twice or more in the text, the first time too."""
    if len(numbers) <= WINDOW:
        return 0
    n = len(numbers) - WINDOW + 1
    x = numbers.astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for i in range(WINDOW):
        key = (key + x[i : i + n] + np.uint64(1)) * MIX
        key ^= key >> np.uint64(29)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    cover = np.zeros(len(numbers) + 1, dtype=np.int64)
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    cover[at] += 1
    np.add.at(cover, at + WINDOW, -1)
    return int((np.cumsum(cover) > 0).sum())


def base(text: str | None, words: list[bytes], numbers: np.ndarray) -> tuple[int, int, int, int, bool]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    repeats = repeated_words(numbers)
    return chars, symbols, len(lines) - len(set(lines)), repeats, len(words) < MIN_WORDS or 100 * repeats > MOST_REPEATED * len(words)


def count_ngrams(docs: DataFrame) -> np.ndarray:
    """Counts by bucket over all rows of docs: each task sums its own, and only sums are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Words(), np.zeros(BUCKETS, dtype=np.int64)
        for b in texts_in_pieces(batches, "text", 1_000_000):
            parts = [buckets_of(words.hashed(w)) for t in b.column("text").to_pylist() if (w := words_of(t))]
            if parts:
                total += np.bincount(np.concatenate(parts), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield batch(pa.schema([("bucket", pa.int32()), ("n", pa.int64())]), bucket=at.astype(np.int32), n=total[at])

    counts = np.zeros(BUCKETS, dtype=np.int64)
    for r in docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.bucket] = r.n
    return counts


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id) whose labels all say quality 1. Null ids and null labels don't count."""
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("least")).where("least = 1")
    return good.select(F.col("doc_id").cast("long").alias("doc_id"))


def trusted_rows(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(text) of the rows (doc_id, text) whose id is in ids. Only texts that pass a filter of the ids are moved; the join is the same at every size."""
    bits = rows.sparkSession.sparkContext.broadcast(marks(ids, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield marked(b, "at", bits.value).select(["doc_id", "text"])

    likely = rows.where("doc_id IS NOT NULL").select("doc_id", "text", mark("doc_id").alias("at")).mapInArrow(run, "doc_id long, text string")
    return likely.join(ids.hint("merge"), "doc_id", "left_semi").select("text")


def ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p(target) - log p(raw) by bucket. Without trusted rows there is nothing to tell apart: all 0."""
    if not target.sum() or not raw.sum():
        return np.zeros(BUCKETS)
    share = lambda c: np.log(c + SMOOTHING) - np.log(c.sum() + SMOOTHING * BUCKETS)
    return share(target) - share(raw)


def score(hashes: np.ndarray, weights: np.ndarray) -> float:
    """The length-normalised ratio of a text."""
    return float(weights[buckets_of(hashes)].sum()) / (2 * len(hashes) - 1 + PRIOR) if len(hashes) else 0.0


def low_quantile(scores: DataFrame, share: float) -> float | None:
    """numpy's quantile of (score), or None without rows; only the scores up to it come to the driver."""
    n = scores.count()
    if not n:
        return None
    at = share * (n - 1)
    low = [r.score for r in scores.orderBy("score").limit(int(at) + 2).toLocalIterator()]
    return float(np.quantile([low[int(at)], low[min(int(at) + 1, n - 1)]], at - int(at)))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The buckets' weights and the threshold. Raw counts follow the whole corpus; target counts and threshold all trusted rows."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = materialize(trusted_rows(rows, trusted_ids(labels)), "trusted")
    weights = ratios(count_ngrams(sample), count_ngrams(rows))
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in texts_in_pieces(batches, "text"):
            found = [score(words.hashed(w), shared.value) for t in b.column("text").to_pylist() if len(w := words_of(t)) >= MIN_WORDS]
            yield batch(pa.schema([("score", pa.float64())]), score=found)

    bound = low_quantile(materialize(sample.mapInArrow(run, "score double"), "scores"), QUANTILE)
    return weights, -np.inf if bound is None else bound - MARGIN


VERDICTS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())])
VERDICT_TYPES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def judged(texts: list[str | None], words: Words, weights: np.ndarray, threshold: float) -> Iterator[tuple]:
    for t in texts:
        found = words_of(t)
        numbers = words.numbers(found)
        rules = base(t, found, numbers)
        s = score(words.hashes[numbers], weights)
        yield (len(found), *rules, not rules[-1] and s >= threshold, s)


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: its base figures, whether it failed them, whether it is kept, and its score.

    Null and empty texts have no words, fail and score 0. Repeated rows are each judged, other columns ignored.
    Without trusted rows only the base rules reject.
    """
    weights, threshold = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in texts_in_pieces(batches, "text"):
            got = list(judged(b.column("text").to_pylist(), words, shared.value, threshold))
            yield batch(VERDICTS, doc_id=b.column("doc_id"), **{n: [g[i] for g in got] for i, n in enumerate(VERDICTS.names[1:])})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, VERDICT_TYPES)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, all columns unchanged."""
    weights, threshold = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in texts_in_pieces(batches, "text"):
            yield b.filter(pa.array([g[6] for g in judged(b.column("text").to_pylist(), words, shared.value, threshold)], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
