"""Benchmark decontamination: an FM-index for each training shard, searched for the test phrases.

A shard is some megabytes of whole texts. It is indexed over the alphabet of the test phrases: any other word
separates, since no phrase holds it. Every phrase is searched backwards, its occurrences are located by
sampled positions, and the spans that they cover are merged. Tests are searched in blocks of bounded size, so
what a task holds grows neither with the tests nor with the corpus.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, table, texts_in_pieces
from .fm_index import FMIndex

WINDOW = 13
#: A document is contaminated if hit words are at least this share: 1 in 20.
SHARE = 20
#: Bytes of text in a shard, and bytes of tests in a block.
SHARD_BYTES, BLOCK_BYTES = 6_000_000, 8_000_000

#: A-Z become a-z; the other bytes below 128 but 0-9 and a-z end a word.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


class Phrases:
    """The windows of a block of test items."""

    def __init__(self, items: list[tuple[str, str]]) -> None:
        self.numbers = Numbers()
        windows: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            words = words_of(text)
            for w in words:
                if w not in self.numbers:
                    self.numbers[w] = len(self.numbers) + 1
            ids = [self.numbers[w] for w in words]
            for i in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
                windows[tuple(ids[i : i + WINDOW])].add(item)
        by_length: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for w in windows:
            by_length[len(w)].append(w)
        self.groups = [(n, np.array(ws, dtype=np.int64), [sorted(windows[w]) for w in ws]) for n, ws in sorted(by_length.items())]


def search_shard(texts: list[str | None], blocks: Iterable[Phrases]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """(number of words, merged hit spans [start, end) in words, items found) of each text."""
    split = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))  # a separator after each text
    cover = np.zeros(int(begins[-1]) + 1, dtype=np.int32)
    items: list[set[str]] = [set() for _ in texts]
    for block in blocks:
        whole = np.zeros(int(begins[-1]), dtype=np.int64)
        get = block.numbers.__getitem__
        for at, n, words in zip(begins, sizes, split):
            whole[at : at + n] = np.fromiter(map(get, words), dtype=np.int64, count=int(n))
        # One separator stands for a run of them: `place` leads back.
        place = np.flatnonzero((whole != 0) | np.append(False, whole[:-1] != 0))
        text = whole[place]
        if not text.any():
            continue
        index = FMIndex(text, len(block.numbers))
        for length, patterns, owners in block.groups:
            lo, hi = index.search(patterns)
            found = np.flatnonzero(hi > lo)
            if not len(found):
                continue
            counts = hi[found] - lo[found]
            rows = np.repeat(lo[found] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
            at = place[index.locate(rows)]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length, -1)
            doc = np.searchsorted(begins, at, side="right") - 1
            for d, w in np.unique(np.stack((doc, np.repeat(found, counts)), axis=1), axis=0).tolist():
                items[d].update(owners[w])
    hit = np.cumsum(cover[:-1]) > 0
    out = []
    for i, n in enumerate(sizes):
        spans: list[tuple[int, int]] = []
        if items[i]:
            edges = np.flatnonzero(np.diff(np.concatenate(([0], hit[begins[i] : begins[i] + n].view(np.int8), [0]))))
            spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        out.append((int(n), spans, sorted(items[i])))
    return out


def contaminated(n_words: int, spans: list[tuple[int, int]]) -> bool:
    hit = sum(b - a for a, b in spans)
    return hit > 0 and SHARE * hit >= n_words


def character_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as code points of the text, end exclusive."""
    ends = [m.span() for m in WORD.finditer(text)] if spans else []
    return [(ends[a][0], ends[b - 1][1]) for a, b in spans]


def blocks_of(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list:
    """The tests as broadcast blocks of at most block_bytes of text (one item at least) each. Items without words have no window; a null id is written `null`; rows that repeat an id are one item."""
    context = benchmark.sparkSession.sparkContext
    out, held, size = [], [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    for r in rows.toLocalIterator():
        if held and size + len(r.text) > block_bytes:
            out.append(context.broadcast(held))
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += len(r.text)
    return [*out, context.broadcast(held)] if held else out


FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def one_at_a_time(blocks: list) -> Iterator[Phrases]:
    return (Phrases(b.value) for b in blocks)


def find(docs: DataFrame, benchmark: DataFrame, with_spans: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (with_spans: also item_ids, spans in words and removal, the spans in code points).

    Null and empty texts have no words and are not contaminated. Without tests nothing is hit. Repeated rows are
    each searched; other columns are ignored.
    """
    blocks = blocks_of(benchmark)
    schema = pa.schema([*FOUND, ("item_ids", pa.list_(pa.string())), ("spans", SPANS), ("removal", SPANS)]) if with_spans else FOUND
    as_rows = lambda spans: [{"start": a, "end": b} for a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(blocks[0].value) if len(blocks) == 1 else None
        for b in texts_in_pieces(batches, "text", SHARD_BYTES):
            texts = b.column("text").to_pylist()
            got = search_shard(texts, [phrases] if phrases else one_at_a_time(blocks))
            more = {"item_ids": [g[2] for g in got], "spans": [as_rows(g[1]) for g in got], "removal": [as_rows(character_spans(t or "", g[1])) for t, g in zip(texts, got)]} if with_spans else {}
            yield batch(schema, doc_id=b.column("doc_id"), n_words=[g[0] for g in got], n_hit=[sum(y - x for x, y in g[1]) for g in got], n_items=[len(g[2]) for g in got], items_sha256=[hashlib.sha256(",".join(g[2]).encode()).hexdigest() for g in got], contaminated=[contaminated(g[0], g[1]) for g in got], **more)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" + (", item_ids array<string>, spans array<struct<start:long,end:long>>, removal array<struct<start:long,end:long>>" if with_spans else ""))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows, all columns unchanged."""
    blocks = blocks_of(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(blocks[0].value) if len(blocks) == 1 else None
        for b in texts_in_pieces(batches, "text", SHARD_BYTES):
            got = search_shard(b.column("text").to_pylist(), [phrases] if phrases else one_at_a_time(blocks))
            yield b.filter(pa.array([not contaminated(g[0], g[1]) for g in got], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Words of a text in DuckDB.
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, len(w[i:i + {WINDOW - 1}]) AS n, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM wins),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
occ AS (SELECT p.doc_id, p.i, l.n, wins.item_id FROM pos p JOIN lengths l ON p.i + l.n - 1 <= len(p.w)
  JOIN wins ON wins.n = l.n AND wins.win = array_to_string(p.w[p.i:p.i + l.n - 1], ' ')),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM occ GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""
