import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factorium.llm import common, decontaminate, fm_index, language_id, line_dedup, quality_classifier, quality_rules, sharding, warc

ROWS = [(None, "no id but lines\nA common line here\nx"), (1, None), (2, ""), (3, "A common line here\n  a COMMON line here\t\nshort"), (4, "\n\n a common line here"), (5, "A common line here" + "\nlong line number one" * 40), (6, "long line number one\n" + "y" * 30_000), (7, "unique words only in this one text"), (7, "unique words only in this one text"), (8, "éÉ\x0b\x0c\r ünïcode line of its own\n" * 2), (9, "ÉÉ ünïcode line of its own")]


def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    no = lambda d: common.NULL_ID if d is None else d
    holders = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(no(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(holders[key(x)]) > 1 and min(holders[key(x)]) != no(d))]
        out.append((d, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_line_dedup_is_brute_force(spark, docs, sf, partitions):
    rows = ROWS + [(r.doc_id + 100, r.text) for r in common.table(spark, sf, "documents").select("doc_id", "text").collect()] + [(2000 + i, "one line that very many hold\nown %d" % i) for i in range(300)]
    table = line_dedup.with_bitmaps(docs(rows), line_dedup.keep_bitmaps(docs(rows), partitions=partitions), "bits")
    got = sorted(((r.doc_id, *line_dedup.kept_lines(r.text, r.bits)) for r in table.collect()), key=str)
    assert got == sorted(brute_lines(rows), key=str)


def test_line_dedup_keeps_columns(spark, docs):
    out = line_dedup.drop_lines(docs(ROWS))
    assert out.columns == docs(ROWS).columns and out.count() == len(ROWS)
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert got == {(d, None if t is None else n) for (d, t), (_, n, _, _) in zip(ROWS, brute_lines(ROWS))}
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)
    assert line_dedup.drop_lines(docs([])).count() == 0


def test_shards_are_even_and_repeat(spark, docs):
    rows = [(i % 97 if i % 5 else None, "t%d" % (i % 11)) for i in range(1000)]
    a = sorted(map(tuple, sharding.shard(docs(rows)).collect()), key=str)
    b = sorted(map(tuple, sharding.shard(docs(rows[::-1]).repartition(7)).collect()), key=str)
    assert a == b
    by = defaultdict(list)
    for r in a:
        by[r[4]].append(r[5])
        assert (r[1], r[2]) == (8 + len(next(t for d, t in rows if zlib.crc32(t.encode()) == r[2])), r[2])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 24
    assert sharding.shard(docs([])).count() == 0
    assert [(r.size, r.text_crc32) for r in sharding.shard(docs([(1, None)])).collect()] == [(8, 0)]


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 2**32))
def test_permutation_is_a_bijection(n, seed):
    x = sharding.permute_numbers(np.arange(n), n, seed)
    for _ in range(sharding.walk_length(n, seed)):
        x = np.where(x < n, x, sharding.permute_numbers(x, n, seed))
    assert sorted(x.tolist()) == list(range(n))


def test_permutation_of_every_small_count():
    """With the shipped seed some counts have cycles that lie wholly beyond them."""
    for n in range(1, 3001):
        x = sharding.permute_numbers(np.arange(n), n, sharding.SEED)
        for _ in range(sharding.walk_length(n, sharding.SEED)):
            x = np.where(x < n, x, sharding.permute_numbers(x, n, sharding.SEED))
        assert (np.sort(x) == np.arange(n)).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=120), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=6), min_size=1, max_size=8))
def test_fm_index_finds_all(text, patterns):
    index = fm_index.FMIndex(np.array(text), 4)
    for p in patterns:
        lo, hi = index.search(np.array([p]))
        want = [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)] == p]
        assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


def brute_hits(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            wins[tuple(w[k : k + 13])].add("null" if i is None else str(i))
    sizes = {len(x) for x in wins}
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (own := wins.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= own
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_decontamination_is_brute_force(spark, docs):
    r = np.random.default_rng(3)
    text = lambda n: " ".join(r.choice(["the", "of", "Ab", "é", "x1", "q", "zz"], n))
    items = [(10, text(20)), (2, text(14)), (2, text(14)), (None, "only four words here"), (4, ""), (5, None), (6, text(13))]
    passage = items[0][1].replace("of", "OF").replace(" ", ", ")
    rows = [(1, None), (2, ""), (3, text(400)), (4, text(30) + " " + passage + " " + text(50)), (5, passage), (5, passage), (6, passage + " " + passage), (None, "ONLY four; words here"), (7, text(3000) + " " + items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(x) for x in decontaminate.find(docs(rows), bench).collect()), key=str)
    assert got == sorted(brute_hits(rows, items), key=str)
    spans = {x.doc_id: x for x in decontaminate.find(docs(rows), bench, with_spans=True).where("doc_id = 5").collect()}
    assert [(s.start, s.end) for s in spans[5].removal] == [(0, len(passage))]
    kept = decontaminate.drop_contaminated(docs(rows), bench)
    assert kept.columns == docs(rows).columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(str(x[0]) for x in brute_hits(rows, items) if not x[5])
    assert decontaminate.find(docs([]), bench).count() == 0
    assert decontaminate.find(docs(rows), bench.limit(0)).where("n_hit > 0").count() == 0


def test_tests_in_several_blocks(spark, docs, monkeypatch):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, t) for i, t in items] + [(99, items[3][1] + " gap " + items[20][1])]
    monkeypatch.setattr(decontaminate, "blocks_of", lambda b, f=decontaminate.blocks_of: f(b, 300))
    got = sorted(tuple(x) for x in decontaminate.find(docs(rows), bench).collect())
    assert got == sorted(brute_hits(rows, items))


def brute_rules(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def test_rules_are_brute_force(spark, docs, sf):
    rows = ROWS + [(20, "a b c d e f g h i j " * 3), (21, "# x\n# x\n\x85 y　z | <>")] + [(r.doc_id + 100, r.text) for r in common.table(spark, sf, "documents").select("doc_id", "text").collect()]
    labels = spark.createDataFrame([(i + 100, 1, 0) for i in range(0, 50)] + [(None, 1, 0), (130, None, None)], "doc_id long, quality int, toxic int")
    out = quality_rules.assess(docs(rows), labels)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect()), key=str)
    assert got == sorted(((d, *brute_rules(t)) for d, t in rows), key=str)
    assert out.where("kept AND base_failed").count() == 0
    kept = quality_rules.keep(docs(rows), labels)
    assert kept.columns == docs(rows).columns and kept.count() == out.where("kept").count()
    assert quality_rules.assess(docs(rows), labels.limit(0)).where("kept = base_failed").count() == 0
    assert quality_rules.assess(docs([]), labels).count() == 0


def test_target_counts_all_trusted_rows(spark):
    """20,001 trusted rows, each with a word of its own: target, weights and threshold are those of all."""
    n = 20_001
    rows = [(i, f"w{i} " + "plain words that all good texts of this table have here") for i in range(n)] + [(n + i, "bad junk " * 6) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality")
    weights, threshold = quality_rules.fit(docs, labels)
    words, count = quality_rules.Words(), lambda ts: np.bincount(np.concatenate([quality_rules.buckets_of(words.hashed(quality_rules.words_of(t))) for t in ts]), minlength=quality_rules.BUCKETS)
    texts = [t for _, t in rows]
    want = quality_rules.ratios(count(texts[:n]), count(texts))
    assert np.array_equal(weights, want)
    scores = [quality_rules.score(words.hashed(quality_rules.words_of(t)), want) for t in texts[:n]]
    assert np.isclose(threshold, np.quantile(scores, quality_rules.QUANTILE) - quality_rules.MARGIN, rtol=0, atol=1e-12)


def test_languages_are_found(spark):
    sf = "/root/testdata/sf0.01"
    t = common.table(spark, sf, "documents")
    out = language_id.op8_language_id(spark, sf).join(t.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_languages_edge_cases(spark):
    rows = [(i, ("the cat sat on the mat" if i % 2 else "le chat est sur la table") + " x" * (i % 3), "en" if i % 2 else "fr") for i in range(60)] + [(90, None, "en"), (91, "", "fr"), (92, "123 !!!", "fr"), (94, "½ ² ⅷ 7", "fr"), (None, "the mat", None), (93, "the mat " * 5000, None), (93, "le chat", None)]
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.predict(t, language_id.fit(t)).where("doc_id >= 90 OR doc_id IS NULL").collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in got) == sorted([("90", "und"), ("91", "und"), ("92", "und"), ("94", "und"), ("None", "en"), ("93", "en"), ("93", "fr")])
    empty = t.limit(0)
    assert language_id.predict(empty, language_id.fit(empty)).count() == 0
    assert {r.lang_pred for r in language_id.predict(t, language_id.fit(empty)).collect()} == {"und"}


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, "the cat sat on the mat", "en") for i in range(40)]
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {r.doc_id for r in language_id.predict(t, language_id.fit(t)).where("held_out").collect()}
    assert held == {i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2}
    lie = spark.createDataFrame([(i, x, "zz" if i in held else l) for i, x, l in rows], "doc_id long, text string, lang string")
    assert list(language_id.fit(lie).models) == ["en"]


def test_quality_is_learned(spark):
    sf = "/root/testdata/sf0.01"
    out = quality_classifier.op9_quality_classifier(spark, sf)
    assert out.count() == 1000
    held = out.where("held_out").join(common.table(spark, sf, "labels"), "doc_id").collect()
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert sum(r.predicted == r.quality for r in held) > 0.9 * len(held)


def test_quality_edge_cases(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    rows = [(1, "good words"), (2, None), (None, ""), (3, "x " * 20_000)]
    for lab in (labels, labels.limit(0)):
        got = quality_classifier.predict(docs(rows), quality_classifier.fit(docs(rows), lab)).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert quality_classifier.predict(docs([]), quality_classifier.fit(docs([]), labels)).count() == 0


PAGES = [(1, "http://a/\r\nX: y", "<p>" + "x" * 200), (2, None, "<p>" + "x" * 200), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\nContent-Length: 3\r\n\r\n" * 5 + "é😀"), (7, "u", "y" * 150), (8, "v", "y" * 150), (8, "v", "y" * 150), (None, "w", "y" * 150), (9, "big", "z" * 300_000)]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    records = warc.read(spark, str(tmp_path / "w"), with_payload=True)
    assert records.count() == 3 * len(PAGES)
    rows = warc.assemble(records).collect()
    assert len(rows) == len(PAGES) and all(r.request and r.metadata for r in rows)
    full = [r.response.payload for r in rows if r.response.warc_type == "response"]
    whole = {h or "" for _, _, h in PAGES}
    assert set(full) == whole
    for r in rows:
        digest = r.response.header_digest.removeprefix("sha256:")
        assert digest in {hashlib.sha256(h.encode()).hexdigest() for h in whole}
    assert sum(r.response.warc_type == "revisit" for r in rows) == 4


def test_revisits_of_frequent_payloads(spark):
    rows = [(i, f"u{i % 7}", h) for i in range(400) for h in [("p" * 150, None, "q" * (100 + i), "r" * 99)[i % 4]]]
    rows += [(None, None, "p" * 150), (3, "again", "p" * 150), (500, "u", "s" * 100), (500, "u", "s" * 100), (None, "u", "t" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((common.NULL_ID if r.page_id is None else r.page_id, r.url or "", r["__payload"], r["__first"]) for r in warc.mark_revisits(pages).select("page_id", "url", "__payload", F.coalesce("__first", F.lit(-1)).alias("__first")).collect())
    many = {h: [common.NULL_ID if p is None else p for p, _, x in rows if x == h] for _, _, h in rows if h and len(h) >= 100}
    want = sorted((common.NULL_ID if p is None else p, u or "", h or "", min(many[h]) if len(many.get(h, [])) > 1 else -1) for p, u, h in rows)
    assert got == want
    assert {r.page_id: r["__first"] for r in warc.mark_revisits(pages).where("url = 'again'").collect()} == {3: 0}


def test_warc_reads_members_and_plain():
    import gzip

    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    for content in (one * 3, gzip.compress(one * 3), gzip.compress(one) * 3):
        assert [b for _, b in warc.parse(content)] == [b"ab\r\nc"] * 3
    with pytest.raises(ValueError):
        list(warc.parse(one[:-8]))


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    assert warc.assemble(warc.read(spark, str(tmp_path / "w"))).count() == 0
