"""Statistics and dataset upkeep over text graphs and logs; grouped sums and windows alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def update_statistics(updates: DataFrame) -> DataFrame:
    """Per line of updates (line, dx array): count, norm and how many sizes are over 1e-6 ... 1e-3. The last field of a line is passed over, as the format has it."""
    body = F.slice("dx", 1, F.greatest(F.size("dx") - 1, F.lit(0)))
    over = lambda t: F.size(F.filter(body, lambda x: F.abs(x) > t))
    return updates.select("line", F.size(body).alias("n"), F.sqrt(F.aggregate(body, F.lit(0.0), lambda a, x: a + x * x)).alias("norm"), *[over(10.0**-k).alias(f"over_1e{k}") for k in (6, 5, 4, 3)])


def ranges(t: DataFrame, *columns: str) -> DataFrame:
    return t.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def digest(t: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, population deviation and lower median by key."""
    return t.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").alias("median"))


def histogram(t: DataFrame, size: str, n: str | None = None) -> DataFrame:
    """Counts by size, summed over all rows."""
    return t.groupBy(size).agg((F.sum(n) if n else F.count("*")).alias("n"))


def block_sizes(layout: DataFrame) -> DataFrame:
    """Histogram of block sizes from cumulative ends (at), starting at 0."""
    before = F.coalesce(F.lag("at").over(Window.orderBy("at")), F.lit(0))
    return layout.select((F.col("at") - before).alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def running_counts(lines: DataFrame, group: str, order: str, **conditions: Column) -> DataFrame:
    """Running counts of conditions by group."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumns({k: F.count_if(c).over(w) for k, c in conditions.items()})


def last_iterations(names: DataFrame, pattern: str, order: str) -> DataFrame:
    """Rows (name, iteration) whose iteration is the last before a restart: the next one is not larger, or there is none."""
    it = names.withColumn("iteration", F.regexp_extract("name", pattern, 1).cast("int"))
    nxt = F.lead("iteration").over(Window.orderBy(order))
    return it.withColumn("next", nxt).where("next IS NULL OR next <= iteration").drop("next")


def drop_settled_markers(lines: DataFrame) -> DataFrame:
    """Lines (graph, line, kind in landmark, marker, other): a marker goes if since the marker before there were other lines but no new landmark; runs of markers are kept."""
    w = Window.partitionBy("graph").orderBy("line")
    upto = F.coalesce(F.sum((F.col("kind") == "marker").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = lines.withColumn("segment", upto)
    per = Window.partitionBy("graph", "segment")
    marked = s.withColumns({"landmarks": F.count_if(F.col("kind") == "landmark").over(per), "others": F.count_if(F.col("kind") == "other").over(per)})
    return marked.where((F.col("kind") != "marker") | (F.col("landmarks") > 0) | (F.col("others") == 0)).select(*lines.columns)


def synthetic_truth(edges: DataFrame) -> DataFrame:
    """Edges v1 = v0 + 1 with whole steps (halves away from zero) and angles at multiples of a right angle."""
    half = lambda x: F.signum(x) * F.floor(F.abs(x) + 0.5)
    right = 1.5707963267948966
    return edges.where("v1 = v0 + 1").select("v0", "v1", half(F.col("dx")).alias("dx"), half(F.col("dy")).alias("dy"), (half(F.col("dt") / right) * right).alias("dt"))


def pivot_log(lines: DataFrame, record: str, key: str, value: str, keys: list[str], missing: str | None = None) -> DataFrame:
    """Key/value lines to one wide row a record; of a key that repeats the largest value; what is missing is `missing`."""
    at = [F.max(F.when(F.col(key) == k, F.col(value))) for k in keys]
    return lines.groupBy(record).agg(*[(F.coalesce(a, F.lit(missing)) if missing is not None else a).alias(k) for a, k in zip(at, keys)])


def records_by_separator(lines: DataFrame, group: str, order: str, is_separator: Column) -> DataFrame:
    """lines with record, the number of separators up to the line; the separators themselves go."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("record", F.sum(is_separator.cast("int")).over(w)).where(~is_separator)


def first_timings(lines: DataFrame, record: list[str], order: str, value: str, most: int = 3) -> DataFrame:
    """The first `most` values of each record as columns t1, t2, ..."""
    n = F.row_number().over(Window.partitionBy(*record).orderBy(order))
    return lines.withColumn("n", n).where(F.col("n") <= most).groupBy(*record).agg(*[F.max(F.when(F.col("n") == i, F.col(value))).alias(f"t{i}") for i in range(1, most + 1)])


def transpose_lines(lines: DataFrame, file: str, order: str, value: str) -> DataFrame:
    """One row a file: its values in the order of its lines."""
    return lines.groupBy(file).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value].cast("string")).alias("v")).select(file, F.array_join("v", " ").alias("values"))


def pose_sort(edges: DataFrame) -> DataFrame:
    """(line, place) by larger id, smaller id, then the line's text."""
    return edges.select("line", F.row_number().over(Window.orderBy(F.greatest("v0", "v1"), F.least("v0", "v1"), "text")).alias("place"))


def segment_sort(lines: DataFrame) -> DataFrame:
    """(graph, line, place): by segment; within it vertices, then observations by landmark (and camera), each stable, the marker last."""
    return lines.select("graph", "line", F.row_number().over(Window.partitionBy("graph").orderBy("segment", "kind", "landmark", "cam", "line")).alias("place"))


def reorder_by_cameras(edges: DataFrame, order: DataFrame) -> DataFrame:
    """edges (eid, a, b) with place: by the later of their cameras' places (v, place)."""
    p = order.select(F.col("v"), F.col("place").alias("p"))
    both = edges.join(p.withColumnsRenamed({"v": "a", "p": "pa"}), "a").join(p.withColumnsRenamed({"v": "b", "p": "pb"}), "b")
    return both.select("eid", F.row_number().over(Window.orderBy(F.greatest("pa", "pb"), F.least("pa", "pb"), "eid")).alias("place"))
