"""Text graphs, sorting, renumbering, statistics and log upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats
from ..sources import graph_text as g
from .derived import clean, clean_sql, table

QUERIES = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def planar_lines(spark, sf):
    """A planar text graph, a line for each event: vertices, edges (some turned round), landmarks, comments, unknown tokens, markers."""
    e = F.col("event_id")
    user, other = F.col("user_id").cast("string"), (F.col("user_id") * 7 % 150).cast("string")
    v = F.col("value").cast("string")
    text = (
        F.when(e % 10 == 0, F.concat(F.lit("  vertex_se2 "), user, F.lit("\t"), v, F.lit(" 1.5 0.25 # a comment")))
        .when(e % 10 == 1, F.concat(F.lit("LANDMARK2:XY "), user, F.lit(" "), other, F.lit(" "), v, F.lit(" 2 1 0 1")))
        .when(e % 10 == 2, F.concat(F.lit("EDGE_SE2_RB "), user, F.lit(" "), other, F.lit(" "), v, F.lit(" 0.5 1 0 1")))
        .when(e % 10 == 3, F.concat(F.lit("UNKNOWN "), user))
        .when(e % 10 == 4, F.concat(F.lit("% "), v))
        .when(e % 10 == 5, F.when(e % 20 == 5, F.lit("CONSISTENCY_MARKER")).otherwise("EQUIV 1 2"))
        .otherwise(F.concat(F.lit("EDGE2 "), user, F.lit(" "), other, F.lit(" "), v, F.lit(" 0.5 0.25 1 2 3 4 5 6")))
    )
    return table(spark, sf, "events").select(e.alias("line"), text.alias("value"))


_E = "(SELECT event_id AS line, event_id % 10 AS r, user_id AS u, user_id * 7 % 150 AS o, value AS v, event_id % 20 AS s FROM events)"


@query(f"SELECT kind, type, count(*) AS n, sum(a) AS first_ids, {clean_sql('sum(z)', 2)} AS first_numbers FROM (SELECT u AS a, v AS z, CASE WHEN r = 0 THEN 'vertex' ELSE 'edge' END AS kind, CASE WHEN r = 1 THEN 'PoseLandmark2D_XY' WHEN r = 2 THEN 'PoseLandmark2D' ELSE 'Pose2D' END AS type FROM {_E} WHERE r NOT IN (3, 4, 5) UNION ALL SELECT NULL, NULL, 'marker', 'Marker' FROM {_E} WHERE s = 5) GROUP BY ALL")
def parse_graph(spark, sf):
    r = g.parse(planar_lines(spark, sf))
    return r.groupBy("kind", "type").agg(F.count("*").alias("n"), F.sum(F.try_element_at("ids", F.lit(1))).alias("first_ids"), clean(F.sum(F.try_element_at("z", F.lit(1))), 2).alias("first_numbers"))


@query(f"""SELECT line, least(u, o) AS v0, greatest(u, o) AS v1, {clean_sql('CASE WHEN u >= o THEN -cos(0.25) * v - sin(0.25) * 0.5 ELSE v END')} AS dx, {clean_sql('CASE WHEN u >= o THEN sin(0.25) * v - cos(0.25) * 0.5 ELSE 0.5 END')} AS dy,
  CASE WHEN u >= o THEN -0.25 ELSE 0.25 END::DOUBLE AS dt, CASE WHEN u >= o THEN 6.0 ELSE 3.0 END::DOUBLE AS i2 FROM {_E} WHERE r >= 6""")
def parse_edges_2d(spark, sf):
    e = g.edges_2d(g.parse(planar_lines(spark, sf)))
    return e.select("line", "v0", "v1", clean(F.col("dx")).alias("dx"), clean(F.col("dy")).alias("dy"), "dt", F.col("info")[2].alias("i2"))


def spatial_lines(spark, sf):
    """A spatial text graph, an edge for each event, with turns as roll, pitch and yaw."""
    e = F.col("event_id")
    info = F.lit(" 1 0 0 0 0 0 1 0 0 0 0 1 0 0 0 1 0 0 1 0 1")
    angles = [((e % m - h) / 8.0).cast("string") for m, h in ((17, 8), (11, 5), (23, 11))]
    return table(spark, sf, "events").select(e.alias("line"), F.concat(F.concat_ws(" ", F.lit("EDGE3"), "user_id", F.col("user_id") * 7 % 150, "value", F.lit("0.5 -1"), *angles), info).alias("value"))


@query(f"""WITH a AS (SELECT event_id AS line, user_id AS v0, user_id * 7 % 150 AS v1, value AS x, (event_id % 17 - 8) / 8.0 AS r, (event_id % 11 - 5) / 8.0 AS p, (event_id % 23 - 11) / 8.0 AS w FROM events WHERE user_id < user_id * 7 % 150),
m AS (SELECT *, cos(p) * sin(r) + cos(w) * sin(r) - sin(w) * sin(p) * cos(r) AS ax, sin(w) * sin(r) + cos(w) * sin(p) * cos(r) + sin(p) AS ay, sin(w) * cos(p) - cos(w) * sin(p) * sin(r) + sin(w) * cos(r) AS az,
  cos(w) * cos(p) + sin(w) * sin(p) * sin(r) + cos(w) * cos(r) + cos(p) * cos(r) - 1 AS c FROM a),
n AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS s FROM m),
f AS (SELECT *, CASE WHEN s < 1e-12 THEN 0 ELSE atan2(s, c) / s END AS k FROM n)
SELECT line, v0, v1, x, {clean_sql('k * ax')} AS turn_x, {clean_sql('k * ay')} AS turn_y, {clean_sql('k * az')} AS turn_z FROM f""")
def parse_edges_3d(spark, sf):
    e = g.edges_3d(g.parse(spatial_lines(spark, sf)))
    return e.select("line", F.col("ids")[0].alias("v0"), F.col("ids")[1].alias("v1"), F.col("z")[0].alias("x"), *[clean(F.col("z")[3 + i]).alias(f"turn_{c}") for i, c in enumerate("xyz")])


@query(f"SELECT u AS id, min(line) AS line, {clean_sql('min_by(v, line)', 2)} AS x FROM {_E} WHERE r = 0 GROUP BY u")
def first_vertices(spark, sf):
    return g.vertices(g.parse(planar_lines(spark, sf))).select("id", "line", clean(F.col("state")[0], 2).alias("x"))


@query(f"""WITH m AS (SELECT line, r, s, count(*) FILTER (WHERE s = 5) OVER (ORDER BY line) AS segment FROM {_E} WHERE r <> 4)
SELECT segment::BIGINT AS segment, count(*) AS n, min(line) AS first_line FROM m GROUP BY segment""")
def marker_segments(spark, sf):
    s = g.segments(g.fields(planar_lines(spark, sf)))
    return s.groupBy("segment").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


@query("SELECT true AS has_pose2d, true AS has_poselandmark2d, true AS has_poselandmark2d_xy, false AS has_pose3d, false AS has_pose3d_rpy, false AS has_poselandmark3d, false AS has_p2c3d, false AS has_p2ci3d, false AS has_p2sc3d, false AS has_spheronxyz, false AS has_range3d")
def dataset_peek(spark, sf):
    return g.peek(planar_lines(spark, sf))


@query(f"""WITH used AS (SELECT line, 0 AS p, u AS id FROM {_E} WHERE r NOT IN (3, 4, 5) UNION ALL SELECT line, 1, o FROM {_E} WHERE r NOT IN (0, 3, 4, 5)),
f AS (SELECT id, min(line * 2 + p) AS seen FROM used GROUP BY id)
SELECT 'pose' AS space, id, row_number() OVER (ORDER BY seen, id) - 1 AS new_id FROM f""")
def renumber_ids(spark, sf):
    return g.renumber(g.parse(planar_lines(spark, sf)))


@query(f"SELECT type, count(*) AS n FROM (SELECT CASE WHEN r = 1 THEN 'PoseLandmark2D_XY' ELSE 'Pose2D' END AS type FROM {_E} WHERE r NOT IN (2, 3, 4, 5)) GROUP BY type")
def route_types(spark, sf):
    return g.routed(g.parse(planar_lines(spark, sf)), ["Pose2D", "PoseLandmark2D_XY"], ["PoseLandmark2D", "Marker"]).groupBy("type").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS n FROM {_E} WHERE r NOT IN (3, 4, 5) AND line < 500")
def line_limit(spark, sf):
    return g.parse(planar_lines(spark, sf).where("line < 500")).where("kind <> 'marker'").agg(F.count("*").alias("n"))


_O = "(SELECT l_orderkey AS a, l_partkey AS b, l_quantity AS q, l_discount AS d, l_linenumber AS n, l_suppkey AS s FROM lineitem)"


@query(f"SELECT type, count(*) AS n, sum(a) AS i0, sum(b) AS i1, {clean_sql('sum(q)', 2)} AS z0, {clean_sql('sum(d)', 2)} AS z1 FROM (SELECT *, CASE n % 4 WHEN 0 THEN 'P2C3D' WHEN 1 THEN 'P2CI3D' WHEN 2 THEN 'PoseLandmark3D' ELSE 'SpheronXYZ' END AS type FROM {_O}) GROUP BY type")
def parse_projections(spark, sf):
    q = F.col
    ids = F.concat_ws(" ", q("l_orderkey"), q("l_partkey"))
    z = F.concat_ws(" ", q("l_quantity").cast("string"), q("l_discount").cast("string"))
    k = q("l_linenumber") % 4
    text = F.when(k == 0, F.concat_ws(" ", F.lit("EDGE_PROJECT_P2MC"), ids, z, F.lit("1 0 1"))).when(k == 1, F.concat_ws(" ", F.lit("EDGE_P2CI"), ids, q("l_suppkey"), z, F.lit("1 0 1"))).when(k == 2, F.concat_ws(" ", F.lit("LANDMARK3:XYZ"), ids, z, F.lit("0.5 1 0 0 1 0 1"))).otherwise(F.concat_ws(" ", F.lit("EDGE_SPHERON_XYZ"), ids, z, F.lit("0.5 1 0 0 1 0 1")))
    lines = table(spark, sf, "lineitem").select(F.monotonically_increasing_id().alias("line"), text.alias("value"))
    return g.parse(lines).groupBy("type").agg(F.count("*").alias("n"), F.sum(q("ids")[0]).alias("i0"), F.sum(q("ids")[1]).alias("i1"), clean(F.sum(q("z")[0]), 2).alias("z0"), clean(F.sum(q("z")[1]), 2).alias("z1"))


@query("SELECT user_id AS line, greatest(count(*) - 1, 0)::INTEGER AS n, round(sqrt(coalesce(sum(x * x) FILTER (WHERE k < c), 0)), 4) + 0.0 AS norm, (count(*) FILTER (WHERE k < c AND abs(x) > 1e-6))::INTEGER AS over_1e6, (count(*) FILTER (WHERE k < c AND abs(x) > 1e-5))::INTEGER AS over_1e5, (count(*) FILTER (WHERE k < c AND abs(x) > 1e-4))::INTEGER AS over_1e4, (count(*) FILTER (WHERE k < c AND abs(x) > 1e-3))::INTEGER AS over_1e3 FROM (SELECT user_id, value / 1e4 AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS c FROM events) GROUP BY user_id")
def update_statistics(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("line")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", (F.col("value") / 1e4).alias("x")))), lambda s: s["x"]).alias("dx"))
    return stats.update_statistics(e).withColumn("norm", clean(F.col("norm")))


@query("SELECT min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity, min(l_extendedprice) AS min_l_extendedprice, max(l_extendedprice) AS max_l_extendedprice FROM lineitem")
def observation_ranges(spark, sf):
    return stats.ranges(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@query(f"SELECT event_type, {clean_sql('avg(value)')} AS mean, {clean_sql('stddev_pop(value)')} AS sd, quantile_disc(value, 0.5) AS median FROM events GROUP BY event_type")
def timing_digest(spark, sf):
    d = stats.digest(table(spark, sf, "events"), "event_type", "value")
    return d.select("event_type", clean(F.col("mean")).alias("mean"), clean(F.col("sd")).alias("sd"), "median")


@query("SELECT p_size, count(*) AS n FROM part GROUP BY p_size")
def size_histogram(spark, sf):
    return stats.histogram(table(spark, sf, "part"), "p_size")


@query("SELECT size, count(*) AS n FROM (SELECT \"at\" - coalesce(lag(\"at\") OVER (ORDER BY \"at\"), 0) AS size FROM (SELECT sum(p_size) OVER (ORDER BY p_partkey)::BIGINT AS \"at\" FROM part)) GROUP BY size")
def block_size_histogram(spark, sf):
    from pyspark.sql import Window

    p = table(spark, sf, "part").select(F.sum("p_size").over(Window.orderBy("p_partkey")).alias("at"))
    return stats.block_sizes(p)


@query("SELECT event_id, count(*) FILTER (WHERE event_type = 'click') OVER w AS clicks, count(*) FILTER (WHERE event_type = 'error') OVER w AS errors FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def marker_running_counts(spark, sf):
    e = table(spark, sf, "events")
    return stats.running_counts(e, "user_id", "event_id", clicks=F.col("event_type") == "click", errors=F.col("event_type") == "error").select("event_id", "clicks", "errors")


@query("SELECT event_id, iteration FROM (SELECT event_id, it AS iteration, lead(it) OVER (ORDER BY event_id) AS nxt FROM (SELECT event_id, (user_id % 9)::INTEGER AS it FROM events)) WHERE nxt IS NULL OR nxt <= iteration")
def last_iterations(spark, sf):
    n = table(spark, sf, "events").select("event_id", F.concat(F.lit("step_"), F.col("event_id").cast("string"), F.lit("_iter_"), (F.col("user_id") % 9).cast("string"), F.lit(".txt")).alias("name"))
    return stats.last_iterations(n, "_iter_(\\d+)", "event_id").select("event_id", "iteration")


@query("""WITH l AS (SELECT user_id AS graph, event_id AS line, CASE WHEN event_type = 'click' THEN 'marker' WHEN value > 80 THEN 'landmark' ELSE 'other' END AS kind FROM events),
s AS (SELECT *, coalesce(sum((kind = 'marker')::INT) OVER (PARTITION BY graph ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM l),
c AS (SELECT *, count(*) FILTER (WHERE kind = 'landmark') OVER p AS ls, count(*) FILTER (WHERE kind = 'other') OVER p AS os FROM s WINDOW p AS (PARTITION BY graph, seg))
SELECT graph, line, kind FROM c WHERE kind <> 'marker' OR ls > 0 OR os = 0""")
def settled_markers(spark, sf):
    kind = F.when(F.col("event_type") == "click", "marker").when(F.col("value") > 80, "landmark").otherwise("other")
    return stats.drop_settled_markers(table(spark, sf, "events").select(F.col("user_id").alias("graph"), F.col("event_id").alias("line"), kind.alias("kind")))


@query("SELECT user_id, event_id, sign(x) * floor(abs(x) + 0.5) + 0.0 AS dx, round(sign(a) * floor(abs(a) + 0.5) * 1.5707963267948966, 4) + 0.0 AS dt FROM (SELECT user_id, event_id, value / 10 - 5 AS x, ((event_id % 29 - 14) / 4.0) / 1.5707963267948966 AS a FROM events WHERE event_id % 3 = 1)")
def synthetic_truth(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", (F.col("value") / 10 - 5).alias("dx"), ((F.col("event_id") % 29 - 14) / 4.0).alias("dt"))
    edges = e.select(F.col("event_id").alias("v0"), (F.col("event_id") + F.when(F.col("event_id") % 3 == 1, 1).otherwise(2)).alias("v1"), "dx", F.col("user_id").cast("double").alias("dy"), "dt")
    return stats.synthetic_truth(edges).select(F.col("dy").cast("long").alias("user_id"), F.col("v0").alias("event_id"), (F.col("dx") + 0.0).alias("dx"), clean(F.col("dt")).alias("dt"))


@query("SELECT user_id, coalesce(max(CASE WHEN event_type = 'click' THEN value END)::VARCHAR, 'N/A') AS click, coalesce(max(CASE WHEN event_type = 'error' THEN value END)::VARCHAR, 'N/A') AS error FROM events GROUP BY user_id")
def log_to_wide(spark, sf):
    e = table(spark, sf, "events")
    return stats.pivot_log(e, "user_id", "event_type", "value", ["click", "error"]).select("user_id", *[F.coalesce(F.col(k).cast("string"), F.lit("N/A")).alias(k) for k in ("click", "error")])


@query("""WITH r AS (SELECT user_id, event_id, value, event_type, sum((event_type = 'click')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS record FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, record ORDER BY event_id) AS n FROM r WHERE event_type <> 'click')
SELECT user_id, record::BIGINT AS record, max(CASE WHEN n = 1 THEN value END) AS t1, max(CASE WHEN n = 2 THEN value END) AS t2, max(CASE WHEN n = 3 THEN value END) AS t3 FROM n WHERE n <= 3 GROUP BY user_id, record""")
def benchmark_log(spark, sf):
    r = stats.records_by_separator(table(spark, sf, "events"), "user_id", "event_id", F.col("event_type") == "click")
    return stats.first_timings(r, ["user_id", "record"], "event_id", "value")


@query("SELECT user_id, string_agg(event_type, ' ' ORDER BY event_id) AS \"values\" FROM events GROUP BY user_id")
def transpose_results(spark, sf):
    return stats.transpose_lines(table(spark, sf, "events"), "user_id", "event_id", "event_type")


@query("SELECT event_id AS line, row_number() OVER (ORDER BY greatest(u, o), least(u, o), text)::INTEGER AS place FROM (SELECT event_id, user_id AS u, user_id * 7 % 150 AS o, event_type || event_id::VARCHAR AS text FROM events)")
def pose_dataset_sort(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("line"), F.col("user_id").alias("v0"), (F.col("user_id") * 7 % 150).alias("v1"), F.concat("event_type", F.col("event_id").cast("string")).alias("text"))
    return stats.pose_sort(e)


@query("SELECT user_id AS graph, event_id AS line, row_number() OVER (PARTITION BY user_id ORDER BY seg, kind, lm, cam, event_id)::INTEGER AS place FROM (SELECT *, event_id // 1000 AS seg, event_id % 3 AS kind, event_id % 11 AS lm, event_id % 5 AS cam FROM events)")
def segment_sort(spark, sf):
    e = F.col("event_id")
    lines = table(spark, sf, "events").select(F.col("user_id").alias("graph"), e.alias("line"), F.call_function("div", e, F.lit(1000)).alias("segment"), (e % 3).alias("kind"), (e % 11).alias("landmark"), (e % 5).alias("cam"))
    return stats.segment_sort(lines)


@query("WITH p AS (SELECT s_suppkey AS v, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS place FROM supplier), n AS (SELECT count(*) AS n FROM supplier), e AS (SELECT o_orderkey AS eid, o_orderkey % n AS a, (o_custkey * 3 + 1) % n AS b FROM orders, n) SELECT eid, row_number() OVER (ORDER BY greatest(x.place, y.place), least(x.place, y.place), eid)::INTEGER AS place FROM e JOIN p x ON e.a = x.v JOIN p y ON e.b = y.v")
def camera_reorder(spark, sf):
    from pyspark.sql import Window

    s = table(spark, sf, "supplier")
    n = s.count()
    order = s.select(F.col("s_suppkey").alias("v"), F.row_number().over(Window.orderBy("s_acctbal", "s_suppkey")).alias("place"))
    e = table(spark, sf, "orders").select(F.col("o_orderkey").alias("eid"), (F.col("o_orderkey") % n).alias("a"), ((F.col("o_custkey") * 3 + 1) % n).alias("b"))
    return stats.reorder_by_cameras(e, order)


@query("WITH a AS (SELECT c_custkey AS id, c_acctbal AS x FROM customer WHERE c_acctbal > 0), b AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY o_custkey) SELECT id, n FROM b WHERE id IN (SELECT id FROM a)")
def merge_graphs(spark, sf):
    a = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    b = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    return b.join(a, "id", "left_semi")


@query("SELECT id, min(x) AS x FROM (SELECT c_custkey AS id, c_acctbal AS x FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier) GROUP BY id")
def union_vertices(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))
    return a.unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"))).groupBy("id").agg(F.min("x").alias("x"))
