"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..n-1 without a global sort: a bucket of the id, the row's place in its bucket and
the bucket's offset. A keyed permutation of 0..n-1 turns the number into a position; the shard is the
position modulo the number of shards and the slot the quotient, so shard sizes differ by one at most,
and the place of a row can be computed from its number, n and the seed alone.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, id_key, table

SHARDS = 24
SEED = 20240501
ROUNDS = 8
#: Buckets of the row numbering. The offsets have one row a bucket, which bounds what is broadcast.
BUCKETS = 4096
#: Primes of the round function and of the bucket; products stay under 2**62.
P1, P2 = 2**31 - 1, 2**31 - 19
BUCKET_FACTOR = 1_103_515_245


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """(a, b, c) of f(x) = ((a x + b) mod P1) c mod P2, from the seed by a 64-bit mix."""
    out, state = [], seed & (2**64 - 1)
    for _ in range(rounds):
        key = []
        for _ in range(3):
            state = (state + 0x9E3779B97F4A7C15) & (2**64 - 1)
            z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
            key.append(1 + (z ^ (z >> 27)) % (P2 - 2))
        out.append(tuple(key))
    return out


def sides(n: int) -> tuple[int, int]:
    """The smallest nearly square grid a x b with a b >= n. Fewer than a of its cells lie beyond n."""
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, max(1, -(-n // a))


def permute_numbers(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """One pass of the Feistel network on the grid, without cycle walking."""
    a, b = sides(n)
    left, right, m, other = x // b, x % b, a, b
    for ka, kb, kc in round_keys(seed):
        left, right = right, (left + (ka * right + kb) % P1 * kc % P2) % m
        m, other = other, m
    return left * b + right


def walk_length(n: int, seed: int) -> int:
    """The most further passes that any number below n needs until it is below n again: exact, by walking all cells beyond n.

    A cycle that lies wholly beyond n is never entered from below; its cells stop where they began and count for nothing.
    """
    a, b = sides(n)
    start = now = np.arange(n, a * b, dtype=np.int64)
    steps = most = 0
    while len(now):
        steps += 1
        now = permute_numbers(now, n, seed)
        if (now < n).any():
            most = steps
        walking = (now >= n) & (now != start)
        start, now = start[walking], now[walking]
    return most


def whole(x: Column, by: int) -> Column:
    """The whole quotient of longs."""
    return F.call_function("div", x, F.lit(by).cast("long"))


def position(number: Column, n: int, seed: int) -> Column:
    """The permuted position of a row number, as a Column."""
    a, b = sides(n)
    sizes = [(a, b)[i % 2] for i in range(ROUNDS)]
    keys = F.array(*[F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip("abcm", (*key, m))]) for key, m in zip(round_keys(seed), sizes)])

    def once(x: Column) -> Column:
        start = F.struct(whole(x, b).alias("l"), (x % b).alias("r"))
        return F.aggregate(keys, start, lambda s, k: F.struct(s["r"].alias("l"), ((s["l"] + (k["a"] * s["r"] + k["b"]) % P1 * k["c"] % P2) % k["m"]).alias("r")), lambda s: s["l"] * b + s["r"])

    steps = walk_length(n, seed)
    first = once(number)
    if not steps:
        return first
    return F.aggregate(F.array(*[F.lit(i) for i in range(steps)]), first, lambda p, _: F.when(p < n, p).otherwise(once(p)))


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.pmod(key, F.lit(P1)) * BUCKET_FACTOR % P1, F.lit(buckets))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number, position.

    Row numbers order a bucket by (doc_id, size, text_crc32): rows equal in all three are interchangeable,
    so the result is the same whatever the partitions. A null doc_id counts as the largest id, a null text as
    no bytes (size 8, crc 0). Repeated rows each take their own position. An empty table gives no rows. Other
    columns are ignored. The law is `rows`.
    """
    n = docs.count()
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"), bucket_of(id_key(), buckets).alias("bucket"))
    counts = docs.select(bucket_of(id_key(), buckets).alias("bucket")).groupBy("bucket").count()
    offsets = counts.select("bucket", (F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("offset"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.coalesce("doc_id", F.lit(NULL_ID)), "size", "text_crc32")) - 1
    numbered = rows.withColumn("place", place).join(F.broadcast(offsets), "bucket").withColumn("row_number", F.col("offset") + F.col("place"))
    return numbered.withColumn("position", position(F.col("row_number"), max(n, 1), seed)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("position") % shards).cast("int").alias("shard"), whole(F.col("position"), shards).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number", "position"
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def oracle_sql(shards: int = SHARDS, seed: int = SEED, buckets: int = BUCKETS) -> str:
    """The same permutation in DuckDB: rounds as nested selects, cycle walking as a recursive query, CRC-32 by its table."""
    keys = round_keys(seed)

    def network(source: str) -> str:
        """Selects rn, a, b, n, p from `source` with columns rn, a, b, n, x."""
        q = f"SELECT rn, a, b, n, x // b AS l, x % b AS r FROM {source}"
        for i, (ka, kb, kc) in enumerate(keys):
            q = f"SELECT rn, a, b, n, r AS l, (l + ({ka} * r + {kb}) % {P1} * {kc} % {P2}) % {'ab'[i % 2]} AS r FROM ({q})"
        return f"SELECT rn, a, b, n, l * b + r AS x FROM ({q})"

    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    entry = reduce(lambda q, _: f"SELECT i, {step} AS c FROM ({q})", range(8), "SELECT i, i AS c FROM range(256) AS t(i)")
    return f"""
WITH RECURSIVE crc_table AS (SELECT list(c ORDER BY i) AS t FROM ({entry})),
bytes AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
base AS (
  SELECT doc_id, strlen(text)::BIGINT + 8 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '[0-9A-F]{{2}}'), lambda p: ((strpos('0123456789ABCDEF', p[1]) - 1) * 16 + strpos('0123456789ABCDEF', p[2]) - 1)::BIGINT)),
      lambda c, v: xor(c // 256, t[(xor(c % 256, v) + 1)::BIGINT])), 4294967295)::BIGINT AS text_crc32,
    ((coalesce(doc_id, {NULL_ID}) % {P1} + {P1}) % {P1} * {BUCKET_FACTOR} % {P1}) % {buckets} AS bucket
  FROM bytes, crc_table),
numbered AS (SELECT *, row_number() OVER (ORDER BY bucket, coalesce(doc_id, {NULL_ID}), size, text_crc32) - 1 AS rn FROM base),
total AS (SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM (SELECT n, (SELECT min(i) FROM range(1, 100000) AS t(i) WHERE i * i >= n) AS a FROM (SELECT count(*) AS n FROM documents))),
walk AS (
  {network("(SELECT rn, a, b, n, rn AS x FROM numbered, total)")}
  UNION ALL
  {network("(SELECT * FROM walk WHERE x >= n)")}),
placed AS (SELECT rn, x AS position FROM walk WHERE x < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (position % {shards})::INTEGER AS shard, (position // {shards})::BIGINT AS slot,
  CAST(NULL AS INTEGER) AS grown_shard, rn::BIGINT AS row_number, position::BIGINT AS position
FROM numbered JOIN placed USING (rn)"""
