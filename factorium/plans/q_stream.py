"""Streaming queries: the batch form of online policies, and real streams drained to a table."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..streaming import incremental as inc
from .derived import table

QUERIES = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def arrivals(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select("user_id", e.alias("eid"), F.call_function("div", e, F.lit(7)).alias("v0"), (F.call_function("div", e, F.lit(7)) + e % 5 - 2).alias("v1"))


_ARR = "(SELECT user_id, event_id AS eid, event_id // 7 AS v0, event_id // 7 + event_id % 5 - 2 AS v1 FROM events)"


@query(f'SELECT user_id, eid, top + 1 AS n_vertices, g <= coalesce(max(g) OVER (PARTITION BY user_id ORDER BY eid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS is_closure, (top + 1) // 20 AS "window" FROM (SELECT *, greatest(v0, v1) AS g, max(greatest(v0, v1)) OVER (PARTITION BY user_id ORDER BY eid) AS top FROM {_ARR})')
def step_policy(spark, sf):
    return inc.step_types(arrivals(spark, sf), inc.Policy(nonlinear=20), ["user_id"]).select("user_id", "eid", "n_vertices", "is_closure", "window")


@query("WITH s AS (SELECT user_id, event_id AS line, event_type = 'click' AS m, coalesce(sum((event_type = 'click')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS segment FROM events) SELECT user_id, segment, count(*) FILTER (WHERE NOT m) AS n, min(line) AS first, max(line) AS last FROM s GROUP BY user_id, segment")
def segment_flush(spark, sf):
    lines = table(spark, sf, "events").select("user_id", F.col("event_id").alias("line"), (F.col("event_type") == "click").alias("is_marker"))
    return inc.flush_segments(lines, "user_id")


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def upsert_latest(spark, sf):
    e = table(spark, sf, "events")
    base = e.groupBy("user_id").agg(F.min_by("value", "event_id").alias("value"))
    return inc.upsert(base, e.select("user_id", "value", "event_id"), "user_id", "event_id")


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) + 0.0 AS total FROM events GROUP BY event_type")
def streamed_counts(spark, sf):
    """The events as a stream, drained into a table by one query."""
    from ..checkpoints import shared_folder

    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    e = table(spark, sf, "events")
    stream = spark.readStream.schema(e.schema).parquet(f"{sf}/events.parquet" if os.path.isdir(f"{sf}/events.parquet") else f"{sf}/events*.parquet")
    parts = []

    def take(batch, number):
        batch.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).write.parquet(f"{folder}/batch-{number}")
        parts.append(f"{folder}/batch-{number}")

    q = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(*parts).groupBy("event_type").agg(F.sum("n").alias("n"), (F.round(F.sum("total"), 2) + 0.0).alias("total"))
