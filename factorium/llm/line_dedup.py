"""Line dedup: hashes in ranges, streamed in order of document and position; keep bitmaps a document.

Only (hash, document, slot) rows move, never lines. They are dealt by range of the whole row, so the
lines of one frequent key spread over as many ranges as they need, and each range is streamed in order:
a group's first row names the smallest document that holds the key. Only a range's first group can have
begun in an earlier range; its rows stay open and are settled by the few edge rows (two a range) that
every range leaves. What is dropped becomes one compressed bitmap a document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch, fresh, id_key, materialize, table, texts_in_pieces

#: Code points that a line's key needs to be compared at all.
MIN_KEY = 10
#: The white space stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

EVENTS = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("slot", pa.int64())])
#: Dropped for certain; open until the edges are known; the smallest document of a range's first or last group.
DROPPED, OPEN, EDGE = 0, 1, 2


def text_tag(text: str = "text") -> Column:
    """31 bits of the text, so that rows that repeat an id with other texts stay apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(F.lit(2**31 - 1))


def line_hashes(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """(h1, h2, doc, slot) of every line whose key has at least min_key code points; slot holds the text's tag above the line's number."""
    lines = docs.select(id_key().alias("doc"), text_tag().alias("tag"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc", (F.shiftleft("tag", 32) + F.col("pos")).alias("slot"), F.translate(F.btrim("line", F.lit(BLANKS)), UPPER, LOWER).alias("key")).where(F.char_length("key") >= min_key)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "doc", "slot")


def stream_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range, in order: which rows are not of their group's first document."""
    last: tuple[int, int] | None = None
    first_doc, first_group = 0, True
    edges: list[tuple[int, int, int]] = []
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, doc, slot = (b.column(k).to_numpy() for k in ("h1", "h2", "doc", "slot"))
        starts = np.empty(len(h1), dtype=bool)
        starts[0] = (int(h1[0]), int(h2[0])) != last
        starts[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if last is None:
            edges.append((int(h1[0]), int(h2[0]), int(doc[0])))
        group = np.cumsum(starts)
        heads = np.concatenate(([first_doc], doc[starts]))
        is_open = (group == 0) & first_group if last is not None else group == 1
        if starts.any() and (last is not None or group[-1] > 1):
            first_group = False
        first_doc, last = int(heads[-1]), (int(h1[-1]), int(h2[-1]))
        kind = np.where(is_open, OPEN, DROPPED)
        out = is_open | (doc != heads[group])
        yield batch(EVENTS, kind=kind[out].astype(np.int32), h1=h1[out], h2=h2[out], doc=doc[out], slot=slot[out])
    if last is not None and not first_group:
        edges.append((*last, first_doc))
    if edges:
        yield batch(EVENTS, kind=[EDGE] * len(edges), h1=[e[0] for e in edges], h2=[e[1] for e in edges], doc=[e[2] for e in edges], slot=[0] * len(edges))


BITMAPS = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("keep", pa.binary())])


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dropped positions to compressed keep bitmaps; a line beyond the bitmap's end is kept."""
    for b in batches:
        out = []
        for positions in b.column("positions").to_pylist():
            bits = np.ones((max(positions) // 8 + 1) * 8, dtype=np.uint8)
            bits[positions] = 0
            out.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
        yield batch(BITMAPS, doc=b.column("doc"), tag=b.column("tag"), keep=out)


def unpack(keep: bytes | None, lines: int) -> np.ndarray | None:
    """Whether each line is kept; None: all of them."""
    if keep is None:
        return None
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8), bitorder="little")[:lines].astype(bool)
    return np.concatenate((bits, np.ones(lines - len(bits), dtype=bool)))


def keep_bitmaps(docs: DataFrame, min_key: int = MIN_KEY, partitions: int | None = None) -> DataFrame:
    """(doc, tag, keep) of the documents that lose a line. A null id counts as one id larger than all others; rows that repeat an id are one document. A null or empty text is one empty line and never loses it."""
    spark = docs.sparkSession
    keys = ("h1", "h2", "doc", "slot")
    hashes = line_hashes(docs, min_key)
    ranged = hashes.repartitionByRange(*([partitions] if partitions else []), *keys).sortWithinPartitions(*keys)
    events = materialize(ranged.mapInArrow(stream_range, "kind int, h1 long, h2 long, doc long, slot long"), "line-events")
    # Two edges a range at most: the number of partitions bounds what is broadcast.
    edges = events.where(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.min("doc").alias("first_doc"))
    settled = events.where(F.col("kind") == OPEN).join(F.broadcast(edges), ["h1", "h2"]).where("doc <> first_doc").select("doc", "slot")
    dropped = events.where(F.col("kind") == DROPPED).select("doc", "slot").unionByName(settled)
    by_doc = dropped.groupBy("doc", F.shiftright("slot", 32).alias("tag")).agg(F.collect_set(F.col("slot").bitwiseAND(F.lit(2**32 - 1)).cast("int")).alias("positions"))
    return by_doc.mapInArrow(pack, "doc long, tag long, keep binary")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, keep: str) -> DataFrame:
    """docs with its columns and their bitmap as column `keep`."""
    doc, tag = fresh(docs, "__doc", "__tag")
    found = bitmaps.select(F.col("doc").alias(doc), F.col("tag").alias(tag), F.col("keep").alias(keep))
    return docs.withColumns({doc: id_key(), tag: text_tag()}).join(found, [doc, tag], "left").select(*docs.columns, keep)


def kept_lines(text: str | None, keep: bytes | None) -> tuple[str, int, int]:
    lines = (text or "").split("\n")
    bits = unpack(keep, len(lines))
    if bits is None:
        return text or "", len(lines), 0
    left = [x for x, k in zip(lines, bits) if k]
    return "\n".join(left), len(lines), len(lines) - len(left)


def drop_lines(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """docs with the repeated lines taken out of text (a null text stays null) and n_chars, where there is one, counted anew. No row is dropped."""
    names, (keep,) = docs.columns, fresh(docs, "__keep")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in texts_in_pieces(batches, "text"):
            texts = [t if t is None else kept_lines(t, k)[0] for t, k in zip(b.column("text").to_pylist(), b.column(keep).to_pylist())]
            arrays = []
            for n in names:
                c = b.column(n)
                if n == "text":
                    c = pa.array(texts, type=c.type)
                elif n == "n_chars":
                    c = pa.array([None if t is None else len(t) for t in texts], type=c.type)
                arrays.append(c)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return with_bitmaps(docs, keep_bitmaps(docs, min_key), keep).mapInArrow(rebuild, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in texts_in_pieces(batches, "text"):
        rows = [kept_lines(t, k) for t, k in zip(b.column("text").to_pylist(), b.column("__keep").to_pylist())]
        yield batch(DIGESTS, doc_id=b.column("doc_id"), n_lines=[r[1] for r in rows], n_dropped=[r[2] for r in rows], kept_sha256=[hashlib.sha256(r[0].encode()).hexdigest() for r in rows])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_bitmaps(docs, keep_bitmaps(docs), "__keep").mapInArrow(digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM lines),
firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= {MIN_KEY} GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (
  SELECT keyed.*, first_doc IS NOT NULL AND keyed.doc_id <> first_doc AS dropped FROM keyed LEFT JOIN firsts ON keyed.key = firsts.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
