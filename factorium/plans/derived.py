"""Graphs and matrices derived from the driver's tables, as DataFrames and as the SQL of the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Sizes of the derived matrices.
M, K, N = 97, 53, 41


def matrix_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries (i, j, x) of an M x K matrix, places repeat."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % M).alias("i"), (F.col("l_partkey") % K).alias("j"), F.col("l_quantity").alias("x"))


def matrix_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % K).alias("i"), (F.col("l_suppkey") % N).alias("j"), F.col("l_linenumber").cast("double").alias("x"))


def square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a K x K matrix."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % K).alias("i"), (F.col("l_suppkey") % K).alias("j"), F.col("l_quantity").alias("x"))


def vector(spark: SparkSession, n: int) -> DataFrame:
    """(i, x) with x = i mod 7 - 3."""
    return spark.range(n).select(F.col("id").alias("i"), (F.col("id") % 7 - 3).cast("double").alias("x"))


def rotation(spark: SparkSession, n: int, by: int = 5) -> DataFrame:
    """The permutation old -> (old * by + 1) mod n."""
    return spark.range(n).select(F.col("id").alias("old"), ((F.col("id") * by + 1) % n).alias("new"))


A = f"(SELECT l_orderkey % {M} AS i, l_partkey % {K} AS j, l_quantity AS x FROM lineitem)"
B = f"(SELECT l_partkey % {K} AS i, l_suppkey % {N} AS j, l_linenumber::DOUBLE AS x FROM lineitem)"
S = f"(SELECT l_partkey % {K} AS i, l_suppkey % {K} AS j, l_quantity AS x FROM lineitem)"


def vector_sql(n: int) -> str:
    return f"(SELECT i::BIGINT AS i, (i % 7 - 3)::DOUBLE AS x FROM range({n}) AS t(i))"


def rotation_sql(n: int, by: int = 5) -> str:
    return f"(SELECT i::BIGINT AS old, ((i * {by} + 1) % {n})::BIGINT AS new FROM range({n}) AS t(i))"


def odometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, k, event_id, x, y, t, seconds): the k-th pose of a user from its k-th event."""
    e = table(spark, sf_dir, "events")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select("user_id", k.cast("long").alias("k"), "event_id", (F.col("value") / 10.0).alias("x"), ((F.col("event_id") % 17 - 8) / 4.0).alias("y"), ((F.col("event_id") % 29 - 14) / 4.0).alias("t"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


ODOMETRY = """(SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, event_id,
  value / 10.0 AS x, (event_id % 17 - 8) / 4.0 AS y, (event_id % 29 - 14) / 4.0 AS t, epoch_us(ts) AS us FROM events)"""


def clamp_sql(a: str) -> str:
    return f"(({a}) % 6.283185307179586)"


def wrap_sql(e: str) -> str:
    c = clamp_sql(e)
    a, b = f"({c} - 6.283185307179586)", f"({c} + 6.283185307179586)"
    return f"(CASE WHEN abs({c}) <= abs({a}) AND abs({c}) <= abs({b}) THEN {c} WHEN abs({a}) <= abs({b}) THEN {a} ELSE {b} END)"


def clean(column, digits: int = 4):
    """Rounded, without a negative zero."""
    return F.round(column, digits) + 0.0


def clean_sql(x: str, digits: int = 4) -> str:
    return f"(round({x}, {digits}) + 0.0)"
