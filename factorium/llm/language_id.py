"""Language identification by interpolated Kneser-Ney models of characters.

A model a language over the characters of words, a blank at each end, counted from all texts that may teach.
Its counts sit in sorted arrays of n-gram hashes and are found by binary search. The hashes have `BITS` bits, so
that a model has a bounded size however much it has read; n-grams of one hash share a row. The language with the
lowest cross-entropy a character wins; a text whose best entropy is beyond what nearly all held-back texts of that
language show is marked as rejected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bag_minhash import GOLD, mix
from .common import batch, crc32_of_id, materialize, table, texts_in_pieces

ORDER = 4
#: Bits of an n-gram's hash in a model: a language takes 20 bytes a hash and order at most, 20 MB in all.
BITS = 18
#: One text in so many that may teach is held back for calibration, and its counts for nothing else.
CALIBRATION = 16
#: Share of the calibration texts that lies above the limit before its margin.
REJECTED = 0.005
#: Entropies are gathered in steps of this size.
STEP = 0.01
#: Words, and n-grams, that a task gathers before it hands their counts on.
GATHERED = 200_000
#: Words kept with their scores in a task.
REMEMBERED = 400_000
#: Share of an unseen character.
FLOOR = 1e-5
NO_LETTER = "und"
#: Words: runs of letters and of the marks within them.
LETTERS = re.compile(r"[^\W\d_]+")


def spread(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of the words in a row, the start of each word in it, and the place of each code point in its word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    return codes, starts, np.arange(len(codes)) - np.repeat(starts, sizes)


def folded(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - BITS)).astype(np.uint32)


def ngrams(codes: np.ndarray, place: np.ndarray, inside: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-grams that end at the characters `inside`, none the first of its word: an array an order.

    Where a word has fewer characters before, the longest n-gram there is stands for the longer ones.
    """
    out = [mix(codes[inside] + GOLD)]
    for n in range(1, ORDER):
        longer = mix(out[-1] * np.uint64(31) + codes[np.maximum(inside - n, 0)] + np.uint64(n))
        out.append(np.where(place[inside] >= n, longer, out[-1]))
    return out


def contexts(codes: np.ndarray, place: np.ndarray, inside: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-1 characters before, alike."""
    out, key = [np.zeros(len(inside), dtype=np.uint64)], mix(codes[inside - 1] ^ GOLD)
    for n in range(1, ORDER):
        out.append(key)
        longer = mix(key * np.uint64(37) + codes[np.maximum(inside - 1 - n, 0)] + np.uint64(n))
        key = np.where(place[inside] > n, longer, key)
    return out


def of_words(words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of the characters of all ' word ' but the first: hashes of the different ones (those that end different n-grams), and which of these each character is."""
    codes, _, place = spread([f" {w} " for w in words])
    inside = np.flatnonzero(place > 0)
    grams = ngrams(codes, place, inside)
    _, first, which = np.unique(grams[-1], return_index=True, return_inverse=True)
    return [folded(g[first]) for g in grams], [folded(c) for c in contexts(codes, place, inside[first])], which


def of_grams(grams: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The hashes of each n-gram's last character."""
    codes, starts, place = spread(grams)
    last = np.append(starts[1:], len(codes)) - 1
    return [folded(g) for g in ngrams(codes, place, last)], [folded(c) for c in contexts(codes, place, last)]


@dataclass
class Table:
    """Rows of values by sorted hash; the row after the last is zero and stands for what isn't there."""

    keys: np.ndarray
    values: list[np.ndarray]

    @classmethod
    def of(cls, keys: np.ndarray, *values: np.ndarray) -> Table:
        order = np.argsort(keys)
        return cls(keys[order].astype(np.uint32), [np.append(v[order], 0).astype(np.float32) for v in values])

    def find(self, keys: np.ndarray) -> np.ndarray:
        n = len(self.keys)
        if not n:
            return np.zeros(len(keys), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), n - 1)
        return np.where(self.keys[at] == keys, at, n)


@dataclass
class Model:
    """Interpolated Kneser-Ney: the highest order counts occurrences, lower ones the different characters before.

    An order has the counts of its n-grams, the sums and the numbers of n-grams of its contexts, and its discount.
    """

    levels: list[tuple[Table, Table, float]]

    def log_probabilities(self, gram: list[np.ndarray], context: list[np.ndarray]) -> np.ndarray:
        p = np.full(len(gram[0]), FLOOR)
        for n, (counts, above, discount) in enumerate(self.levels):
            at = above.find(context[n])
            total, kinds = above.values[0][at], above.values[1][at]
            known = total > 0
            share = np.maximum(counts.values[0][counts.find(gram[n])] - discount, 0.0)
            p = np.where(known, (share + discount * kinds * p) / np.where(known, total, 1.0), p)
        return np.log(np.maximum(p, 1e-12))


class Scorer:
    """Summed log-probabilities of words, by language; common words are remembered."""

    def __init__(self, models: dict[str, Model]) -> None:
        self.models, self.names = list(models.values()), list(models)
        self.seen: dict[str, int] = {}
        self.scores = np.zeros((0, len(models)))

    def words(self, words: list[str]) -> None:
        """Scores those that are new."""
        new = [w for w in words if w not in self.seen]
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen, self.scores = {}, self.scores[:0]
            new = words
        size = len(self.seen)
        if size + len(new) > len(self.scores):
            self.scores = np.concatenate((self.scores[:size], np.zeros((size + 2 * len(new), len(self.models)))))
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            gram, context, which = of_words(part)
            sizes = np.fromiter(map(len, part), dtype=np.int64, count=len(part)) + 1
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            for i, m in enumerate(self.models):
                self.scores[size + at : size + at + len(part), i] = np.add.reduceat(m.log_probabilities(gram, context)[which], starts)
        self.seen.update(zip(new, range(size, size + len(new))))

    def texts(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Cross-entropies a character by language; None for a text without letters."""
        counted = [Counter(LETTERS.findall(t.lower())) if t else Counter() for t in texts]
        self.words(list(set().union(*counted)))
        out: list[np.ndarray | None] = []
        for c in counted:
            if not any(x.isalpha() for w in c for x in w):  # runs of letters can be numerals alone
                out.append(None)
                continue
            n = np.fromiter(c.values(), dtype=np.float64, count=len(c))
            size = n @ np.fromiter(map(len, c), dtype=np.float64, count=len(c)) + n.sum()
            out.append(-(n @ self.scores[np.fromiter(map(self.seen.__getitem__, c), dtype=np.int64, count=len(c))]) / size)
        return out


@dataclass
class Identifier:
    models: dict[str, Model]
    #: The entropy above which a text of the language is rejected, and what entropies are divided by for the score.
    limits: dict[str, float]
    scale: float

    def judge(self, texts: list[str | None], scorer: Scorer) -> list[tuple[str, float, bool, float | None]]:
        """(language, score, rejected, cross-entropy)."""
        out = []
        for x in scorer.texts(texts) if self.models else [None] * len(texts):
            if x is None:
                out.append((NO_LETTER, 0.0, True, None))
                continue
            best = int(np.argmin(x))
            odds = np.exp(-(x - x[best]) / self.scale)
            name = scorer.names[best]
            out.append((name, float(1 / odds.sum()), bool(x[best] > self.limits[name]), float(x[best])))
        return out


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each character occurs after the up to ORDER - 1 before it in its word, over all texts of `rows` (lang, text).

    A task hands its counts on whenever it holds GATHERED of them, so its memory is bounded; sums are added before they are shuffled.
    """
    schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])

    def taken(words: dict[str, Counter[str]], grams: dict[str, Counter[str]]) -> None:
        for lang, counted in words.items():
            total = grams.setdefault(lang, Counter())
            for w, n in counted.items():
                p = f" {w} "
                for i in range(2, len(p) + 1):
                    total[p[max(0, i - ORDER) : i]] += n
        words.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter[str]] = {}
        grams: dict[str, Counter[str]] = {}

        def rest() -> Iterator[pa.RecordBatch]:
            taken(words, grams)
            for lang, total in grams.items():
                yield batch(schema, lang=[lang] * len(total), gram=list(total), n=list(total.values()))
            grams.clear()

        for b in texts_in_pieces(batches, "text"):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                words.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
            if sum(map(len, words.values())) > GATHERED:
                taken(words, grams)
            if sum(map(len, grams.values())) > GATHERED:
                yield from rest()
        yield from rest()

    return rows.select("lang", "text").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(rows: DataFrame) -> dict[str, Model]:
    """The models of the languages in `rows` (lang, text). What comes to the driver is bounded by 2^BITS hashes an order and language."""
    level = materialize(gram_counts(rows), "language-grams").select(F.lit(ORDER).alias("level"), "lang", "gram", "n")
    levels = level
    for n in range(ORDER - 1, 0, -1):  # an n-gram counts once for each different longer one
        level = level.groupBy("lang", F.expr(f"right(gram, {n})").alias("gram")).agg(F.count("*").alias("n")).select(F.lit(n).alias("level"), "lang", "gram", "n")
        levels = levels.union(level)
    schema = pa.schema([("level", pa.int32()), ("lang", pa.string()), ("key", pa.int64()), ("above", pa.int64()), ("n", pa.int64())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                gram, context = of_grams(b.column("gram").to_pylist())
                at, row = b.column("level").to_numpy(zero_copy_only=False) - 1, np.arange(b.num_rows)
                yield batch(schema, level=b.column("level"), lang=b.column("lang"), key=np.stack(gram)[at, row].astype(np.int64), above=np.stack(context)[at, row].astype(np.int64), n=b.column("n"))

    found = materialize(levels.mapInArrow(hashed, "level int, lang string, key long, above long, n long"), "language-hashes")
    once = F.sum(F.when(F.col("n") == 1, 1).otherwise(0))
    twice = F.sum(F.when(F.col("n") == 2, 1).otherwise(0))
    rare = {(r.lang, r.level): (r.ones, r.twos) for r in found.groupBy("lang", "level").agg(once.alias("ones"), twice.alias("twos")).collect()}
    counts = found.groupBy("lang", "level", "key").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    above = found.groupBy("lang", "level", "above").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toArrow().to_pandas()
    tables = {at: Table.of(x["key"].to_numpy(), x["n"].to_numpy()) for at, x in counts.groupby(["lang", "level"])}
    over = {at: Table.of(x["above"].to_numpy(), x["n"].to_numpy(), x["kinds"].to_numpy()) for at, x in above.groupby(["lang", "level"])}
    discount = {at: float(np.clip(ones / (ones + 2 * twos), 0.1, 0.95)) if ones else 0.5 for at, (ones, twos) in rare.items()}
    return {k: Model([(tables[k, n], over[k, n], discount[k, n]) for n in range(1, ORDER + 1)]) for k in sorted({lang for lang, _ in rare})}


def calibrate(rows: DataFrame, models: dict[str, Model]) -> Identifier:
    """Limits and scale from all rows (lang, text): a histogram, in steps of STEP, of their entropies under their own language and of how far the next best language is."""
    shared = rows.sparkSession.sparkContext.broadcast(models)
    schema = pa.schema([("lang", pa.string()), ("own", pa.int32()), ("gap", pa.int32())])

    def entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in texts_in_pieces(batches, "text", 1_500_000):
            rows = [(lang, x, scorer.names.index(lang)) for lang, x in zip(b.column("lang").to_pylist(), scorer.texts(b.column("text").to_pylist())) if x is not None and lang in shared.value]
            gaps = [np.delete(x, i).min() - x[i] if len(x) > 1 else 1.0 for _, x, i in rows]
            yield batch(schema, lang=[r[0] for r in rows], own=[int(x[i] / STEP) for _, x, i in rows], gap=[int(np.floor(g / STEP)) for g in gaps])

    # Entropies end at -log(1e-12), so a language has at most some 6,000 steps in its two histograms.
    found = rows.select("lang", "text").mapInArrow(entropies, "lang string, own int, gap int")
    steps = found.select("lang", F.explode(F.array(F.struct(F.lit("own").alias("of"), F.col("own").alias("at")), F.struct(F.lit("gap").alias("of"), F.col("gap").alias("at")))).alias("x"))
    own: dict[str, Counter[int]] = {}
    gap: Counter[int] = Counter()
    for r in steps.groupBy("lang", "x.of", "x.at").agg(F.count("*").alias("n")).collect():
        (own.setdefault(r.lang, Counter()) if r.of == "own" else gap)[r["at"]] += r.n
    limits = {k: quantile(own[k], 1 - REJECTED) + 0.5 if k in own else np.inf for k in models}
    return Identifier(models, limits, max(0.05, quantile(gap, 0.5) / 8) if gap else 0.25)


def quantile(steps: Counter[int], share: float) -> float:
    """The upper end of the first step up to which at least the share lies."""
    at = np.array(sorted(steps))
    n = np.cumsum([steps[int(k)] for k in at])
    return float((at[np.searchsorted(n, share * n[-1])] + 1) * STEP)


def fit(docs: DataFrame) -> Identifier:
    """Learns from the text and lang of all documents that are not held out; the others' languages are never read.

    Rows without lang or text teach nothing. One document in CALIBRATION is held back for the limits, unless its language has no others.
    A language of which no text has a letter is not learned.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc32_of_id() % 4 != 2))
    back = F.floor(crc32_of_id() / 4) % CALIBRATION == 0
    few = [r.lang for r in known.groupBy("lang").agg(F.min(back).alias("all_back")).where("all_back").collect()]
    models = learn(known.where(~back | F.col("lang").isin(few)))
    return calibrate(known.where(back), models)


PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_()), ("cross_entropy", pa.float64())])


def predict(docs: DataFrame, identifier: Identifier) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, cross_entropy of each row, from its whole text alone.

    A null text and one without letters is `und` with score 0; so is every text if nothing could be learned.
    Ties go to the language that sorts first. Repeated rows are each judged; other columns are ignored. A text is
    scored whole, however long, as its words with their counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(identifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        scorer = Scorer(found.models)
        for b in texts_in_pieces(batches, "text", 1_500_000):
            got = found.judge(b.column("text").to_pylist(), scorer)
            yield batch(PREDICTED, doc_id=b.column("doc_id"), held_out=b.column("held_out"), lang_pred=[g[0] for g in got], score=[g[1] for g in got], rejected=[g[2] for g in got], cross_entropy=[g[3] for g in got])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc32_of_id() % 4 == 2).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean, cross_entropy double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
