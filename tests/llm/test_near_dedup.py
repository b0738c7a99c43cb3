import random
from collections import Counter

import numpy as np

from factorium.llm import bag_minhash, common, near_dedup


def bag(text):
    """The multiset of shingles as a set: the k-th copy is an element of its own."""
    w = near_dedup.words_of(text)
    counts = Counter([b" ".join(w)]) if 0 < len(w) < 5 else Counter(b" ".join(w[i : i + 5]) for i in range(len(w) - 4))
    return {(s, k) for s, c in counts.items() for k in range(c)}


def brute(rows):
    """Classes by comparing all pairs of different texts."""
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    bags = [bag(t) for _, t in rows]
    for i, (_, s) in enumerate(rows):
        for j in range(i):
            t = rows[j][1]
            a, b = bags[i], bags[j]
            if a and b:
                alike = min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b) - 1e-9
            else:
                alike = not a and not b and s is not None and s == t or s is None and t is None and rows[i][0] == rows[j][0]
            if alike:
                top[find(i)] = find(j)
    key = lambda d: common.NULL_ID if d is None else d
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), common.NULL_ID), key(d))
    null = lambda d: None if d == common.NULL_ID else d
    return sorted(((d, null(least[find(i)])) for i, (d, _) in enumerate(rows)), key=str)


def fixture():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    rows = [(None, "some null id text of words"), (900, None), (901, None), (901, None), (902, ""), (903, ""), (904, "!!!"), (905, "???"), (906, "a b c"), (907, "A, b c!"), (908, "x " * 500), (909, "x " * 450), (910, "x " * 300)]
    for i in range(60):  # a hub with copies that are near it but not always each other
        w = list(base)
        for _ in range(r.randrange(1, 3)):
            w[r.randrange(120)] = word()
        rows.append((i, " ".join(w)))
    chain = [word() for _ in range(100)]
    for i in range(15):
        rows.append((100 + i, " ".join(chain)))
        chain[r.randrange(100)] = word()
    rows += [(200, rows[20][1].upper() + "."), (201, rows[20][1]), (201, rows[20][1]), (300, " ".join(word() for _ in range(40)))]
    return rows


def test_classes_are_brute_force(spark, docs, sf):
    real = [(r.doc_id + 1000, r.text) for r in common.table(spark, sf, "documents").select("doc_id", "text").collect()]
    rows = fixture() + real
    got = sorted((tuple(r) for r in near_dedup.near_classes(docs(rows)).collect()), key=str)
    assert got == brute(rows)


def test_bounds_lose_no_link(spark, docs):
    """Buckets of hundreds: near copies of one passage, and pairs that share a part of it and are like each other alone."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(100)]
    texts = []
    for _ in range(400):  # some within, some beyond the threshold
        w = list(passage)
        for _ in range(r.randrange(1, 8)):
            w[r.randrange(100)] = word()
        texts.append(w)
    for _ in range(60):
        both = passage[:60] + [word() for _ in range(30)]
        texts += [both, both[:-1] + [word()], both[3:], both[8:]]
    for _ in range(10):  # whatever the words, few keys are a text's own
        texts.append([x for i in range(0, 100, 5) for x in r.choice(([*passage[i : i + 5]], [*passage[:2], *passage[i : i + 3]]))])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = sorted((tuple(x) for x in near_dedup.near_classes(docs(rows)).collect()), key=str)
    assert got == brute(rows)


def test_own_keys_and_passages(spark, docs):
    """A common passage followed by text of its own, and a near copy of that."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows = []
    for family in range(12):
        passage = [word() for _ in range(60)]
        both = passage + [word() for _ in range(18)]
        texts = [passage[:-1] + [word()] for _ in range(5)] + [both, both[14:]]
        rows += [(family * 10 + i, " ".join(t)) for i, t in enumerate(texts)]
    want = brute(rows)
    assert sum(c % 10 == 5 and d % 10 == 6 for d, c in want) == 12
    got = sorted((tuple(x) for x in near_dedup.near_classes(docs(rows)).collect()), key=str)
    assert got == want


def test_one_of_a_class_stays(spark, docs):
    rows = fixture()
    kept = near_dedup.keep_one(docs(rows))
    assert kept.columns == docs(rows).columns
    want = {c for _, c in brute(rows)}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(spark, docs):
    assert near_dedup.near_classes(docs([])).count() == 0
    assert near_dedup.keep_one(docs([])).count() == 0


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(0)
    n, m = 60, 4000
    for _ in range(4):
        a = r.integers(0, 9, n)
        b = np.where(r.random(n) < 0.7, a, r.integers(0, 9, n))
        e = r.integers(0, 2**63, n).astype(np.uint64)
        both = np.concatenate((np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)))
        s = bag_minhash.signatures(2, both, np.concatenate((e[a > 0], e[b > 0])), np.concatenate((a[a > 0], b[b > 0])), m)
        assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03
