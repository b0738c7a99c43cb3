"""Kneser-Ney models against a plain count over strings."""

import math
from collections import Counter

import numpy as np
import pytest

from factorium.llm import common, language_id


def keys(grams, order):
    """The hash of each n-gram, and of its context, at this order."""
    found, above = language_id.of_grams(grams)
    return found[order - 1].tolist(), above[order - 1].tolist()


def brute_models(rows):
    """lang -> {order: (counts by hash, contexts' sums, contexts' kinds, discount)}; counted over strings, rows of one hash added."""
    out = {}
    for lang in {r[0] for r in rows}:
        counts = Counter()
        for k, text in rows:
            for w in language_id.LETTERS.findall(text.lower()) if k == lang else ():
                p = f" {w} "
                counts.update(p[max(0, i - 3) : i + 1] for i in range(1, len(p)))
        levels = {}
        for order in (4, 3, 2, 1) if counts else ():
            by_hash, total, kinds = Counter(), Counter(), Counter()
            for n, g, c in zip(counts.values(), *keys(list(counts), order)):
                by_hash[g] += n
                total[c] += n
                kinds[c] += 1
            ones, twos = (sum(n == x for n in counts.values()) for x in (1, 2))
            levels[order] = by_hash, total, kinds, min(max(ones / (ones + 2 * twos), 0.1), 0.95) if ones else 0.5
            counts = Counter(g[-(order - 1) :] for g in counts) if order > 1 else counts
        if levels:
            out[lang] = levels
    return out


def brute_logs(levels, word):
    p, out = f" {word} ", 0.0
    for i in range(1, len(p)):
        q = language_id.FLOOR
        for order in (1, 2, 3, 4):
            (g,), (c,) = keys([p[max(0, i - 3) : i + 1]], order)
            counts, total, kinds, discount = levels[order]
            if total[c]:
                q = (max(counts[g] - discount, 0) + discount * kinds[c] * q) / total[c]
        out += math.log(max(q, 1e-12))
    return out


def test_hashes_tell_ngrams_apart():
    grams = [" a", " ab", " abc", "abcd", "bcd ", "cd ", "x東京 "]
    for order, tails in ((2, [g[-2:] for g in grams]), (3, [g[-3:] for g in grams]), (4, grams)):
        assert len(set(keys(grams, order)[0])) == len(set(tails))
        assert len(set(keys(grams, order)[1])) == len({g[:-1][-(order - 1) :] for g in grams})


@pytest.mark.parametrize("gathered", [1, 50, 200_000])
def test_models_are_brute_force(spark, sf, monkeypatch, gathered):
    monkeypatch.setattr(language_id, "GATHERED", gathered)
    rows = [("en", "the cat sat on the mat; a cat"), ("en", "that hat"), ("fr", "le chat est là, l'été"), ("zz", "東京 東京都 x"), ("zz", "12 !!"), ("fr", "")]
    rows += [(r.lang, r.text[:400]) for r in common.table(spark, sf, "documents").where("text IS NOT NULL AND lang IS NOT NULL").limit(30).collect()]
    found = language_id.learn(spark.createDataFrame(rows, "lang string, text string"))
    true = brute_models(rows)
    assert list(found) == sorted(true)
    words = sorted({w for _, t in rows for w in language_id.LETTERS.findall(t.lower())})[:300] + ["unseen", "q", "京都"]
    scorer = language_id.Scorer(found)
    scorer.words(words)
    want = np.array([[brute_logs(true[k], w) for k in found] for w in words])
    got = np.array([scorer.scores[scorer.seen[w]] for w in words])
    np.testing.assert_allclose(got, want, rtol=1e-4)


def test_counts_grow_with_the_input(spark):
    rows = [(i, f"word number {chr(97 + i % 26)}{chr(97 + i // 26 % 26)} again", "en") for i in range(3000)]
    few, many = (language_id.fit(spark.createDataFrame(rows[:n], "doc_id long, text string, lang string")).models["en"].levels[-1][0].values[0].sum() for n in (300, 3000))
    assert many > 8 * few


def test_scorer_forgets_and_stays_right(monkeypatch, spark):
    found = language_id.learn(spark.createDataFrame([("en", "the cat sat"), ("fr", "le chat est")], "lang string, text string"))
    texts = ["the cat", "le chat", None, "", "the " * 9, "sat est cat chat"]
    want = language_id.Scorer(found).texts(texts)
    monkeypatch.setattr(language_id, "REMEMBERED", 2)
    small = language_id.Scorer(found)
    got = [small.texts([t])[0] for t in texts]
    assert all((g is None) == (w is None) and (w is None or np.allclose(g, w)) for g, w in zip(got, want))


def test_quantile_takes_whole_steps():
    assert language_id.quantile(Counter({100: 99, 200: 1}), 0.99) == pytest.approx(1.01)
    assert language_id.quantile(Counter({100: 1}), 0.5) == pytest.approx(1.01)
