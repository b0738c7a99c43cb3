"""Graph queries over derived graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from .derived import table

QUERIES = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def observations(spark, sf):
    """(cam, landmark): orders see parts."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("cam"), F.col("l_partkey").alias("landmark"))


def supply(spark, sf):
    """Customers (v) and their links (a, b): from each order's customer to the next by key."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("v"))
    return c, table(spark, sf, "orders").select(F.col("o_custkey").alias("a"), ((F.col("o_custkey") * 17 + F.col("o_orderkey")) % c.count()).alias("b"))


_CUST = "(SELECT c_custkey AS v FROM customer)"
_LINKS = "(SELECT o_custkey AS a, (o_custkey * 17 + o_orderkey) % (SELECT count(*) FROM customer) AS b FROM orders)"
_BOTH = f"(SELECT DISTINCT a, b FROM (SELECT a, b FROM {_LINKS} WHERE a <> b UNION ALL SELECT b, a FROM {_LINKS} WHERE a <> b))"


@query("WITH l AS (SELECT l_orderkey AS cam, l_partkey AS lm, row_number() OVER () AS line FROM lineitem), p AS (SELECT least(a.cam, b.cam) AS lo, greatest(a.cam, b.cam) AS hi, count(*) AS weight FROM l a JOIN l b ON a.lm = b.lm AND a.line < b.line GROUP BY ALL) SELECT weight, count(*) AS n_pairs, sum(lo) AS sum_lo, sum(hi) AS sum_hi FROM p GROUP BY weight")
def covisibility(spark, sf):
    return graph.covisibility(observations(spark, sf)).groupBy("weight").agg(F.count("*").alias("n_pairs"), F.sum("lo").alias("sum_lo"), F.sum("hi").alias("sum_hi"))


@query("WITH l AS (SELECT DISTINCT l_orderkey AS cam, l_partkey AS lm FROM lineitem), p AS (SELECT a.cam AS lo, b.cam AS hi, count(*) AS shared FROM l a JOIN l b ON a.lm = b.lm AND a.cam < b.cam GROUP BY ALL) SELECT shared, count(*) AS n_pairs, sum(lo) AS sum_lo, sum(hi) AS sum_hi FROM p GROUP BY shared")
def co_observation(spark, sf):
    return graph.co_observation(observations(spark, sf)).groupBy("shared").agg(F.count("*").alias("n_pairs"), F.sum("lo").alias("sum_lo"), F.sum("hi").alias("sum_hi"))


@query("SELECT l_partkey AS landmark, count(*) AS degree FROM lineitem GROUP BY l_partkey")
def landmark_degree(spark, sf):
    return observations(spark, sf).groupBy("landmark").agg(F.count("*").alias("degree"))


@query(f"SELECT v, count(*) AS degree FROM (SELECT a AS v FROM {_LINKS} UNION ALL SELECT b FROM {_LINKS}) GROUP BY v")
def vertex_degree(spark, sf):
    return graph.degrees(supply(spark, sf)[1])


@query(f"WITH RECURSIVE r(v, c) AS (SELECT v, v FROM {_CUST} UNION SELECT b.b, r.c FROM r JOIN {_BOTH} b ON r.v = b.a WHERE r.c < b.b) SELECT v, min(c) AS component FROM r GROUP BY v")
def connected_components(spark, sf):
    return graph.components(*supply(spark, sf))


@query(f"WITH RECURSIVE r(v) AS (SELECT min(v) FROM {_CUST} UNION SELECT b.b FROM r JOIN {_BOTH} b ON r.v = b.a) SELECT count(*) = (SELECT count(*) FROM {_CUST}) AS connected FROM r")
def connectivity(spark, sf):
    return graph.is_connected(*supply(spark, sf))


@query(f"WITH RECURSIVE d(v, depth) USING KEY (v) AS (SELECT 0::BIGINT, 0 UNION SELECT b.b, min(d.depth) + 1 FROM d JOIN {_BOTH} b ON d.v = b.a WHERE b.b NOT IN (SELECT v FROM recurring.d) GROUP BY b.b) SELECT d.v, d.depth, min(CASE WHEN e.depth = d.depth - 1 THEN e.v END) AS parent FROM d LEFT JOIN {_BOTH} b ON d.v = b.a LEFT JOIN d e ON b.b = e.v GROUP BY d.v, d.depth")
def breadth_first(spark, sf):
    return graph.breadth_first(supply(spark, sf)[1], 0)


def nations(spark, sf):
    """Nations and their trade: weight = orders from customers of one nation with supplier numbers of another."""
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("a"))
    o = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("a", (F.col("o_orderkey") % 25).alias("b"))
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("v")), o.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("weight"))


_TRADE = "(SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS weight FROM (SELECT c_nationkey::BIGINT AS a, o_orderkey % 25 AS b FROM orders JOIN customer ON o_custkey = c_custkey) WHERE a <> b GROUP BY ALL)"


@query(f"""WITH RECURSIVE w AS (SELECT a, b, weight, row_number() OVER (ORDER BY weight DESC, a, b) AS r FROM {_TRADE}),
k(r, labels, a, b, weight, taken) AS (
  SELECT 0::BIGINT, list_transform(range(25), lambda i: i::BIGINT), NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, false
  UNION ALL
  SELECT w.r, CASE WHEN k.labels[w.a + 1] = k.labels[w.b + 1] THEN k.labels ELSE list_transform(k.labels, lambda x: CASE WHEN x = k.labels[w.b + 1] THEN k.labels[w.a + 1] ELSE x END) END, w.a, w.b, w.weight, k.labels[w.a + 1] <> k.labels[w.b + 1]
  FROM k JOIN w ON w.r = k.r + 1)
SELECT a, b, weight FROM k WHERE taken""")
def maximum_spanning_tree(spark, sf):
    return graph.maximum_spanning_tree(*nations(spark, sf))


@query(None)
def independent_set(spark, sf):
    return graph.maximal_independent_set(*supply(spark, sf))


@query(None)
def schur_ordering(spark, sf):
    v, e = supply(spark, sf)
    return graph.schur_ordering(v, graph.maximal_independent_set(v, e))


@query("SELECT p_partkey AS v, row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 AS place FROM part")
def guided_ordering(spark, sf):
    return graph.guided_ordering(table(spark, sf, "part").select(F.col("p_partkey").alias("v"), F.col("p_size").alias("dim")))


@query("WITH e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT l_suppkey AS a, (l_suppkey + l_quantity::BIGINT) % (SELECT count(*) FROM supplier) AS b FROM lineitem) WHERE a <> b) SELECT x.a AS x, x.b AS y, y.b AS z FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b")
def triangles(spark, sf):
    n = table(spark, sf, "supplier").count()
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), ((F.col("l_suppkey") + F.col("l_quantity").cast("long")) % n).alias("b"))
    return graph.triangles(e)


@query("WITH c AS (SELECT DISTINCT list_sort(list_distinct(list(p))) AS m FROM (SELECT l_orderkey, l_suppkey % 8 AS p FROM lineitem) GROUP BY l_orderkey) SELECT array_to_string(m, ' ') AS members FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE len(o.m) > len(c.m) AND list_has_all(o.m, c.m))")
def prune_cliques(spark, sf):
    c = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_suppkey") % 8)).alias("members"))
    return graph.prune_cliques(c).select(F.array_join(F.transform("members", lambda x: x.cast("string")), " ").alias("members"))


@query("SELECT eid, coalesce(greatest(v0, v1) <= max(greatest(v0, v1)) OVER (ORDER BY eid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS is_closure FROM (SELECT event_id AS eid, event_id // 7 AS v0, event_id // 7 + event_id % 5 - 2 AS v1 FROM events)")
def loop_closures(spark, sf):
    e = F.col("event_id")
    base = F.call_function("div", e, F.lit(7))
    return graph.odometry_split(table(spark, sf, "events").select(e.alias("eid"), base.alias("v0"), (base + e % 5 - 2).alias("v1"))).select("eid", "is_closure")


@query("WITH e AS (SELECT event_id AS eid, event_id // 7 AS v0, event_id // 7 + event_id % 5 - 2 AS v1 FROM events), c AS (SELECT *, coalesce(greatest(v0, v1) <= max(greatest(v0, v1)) OVER (ORDER BY eid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS z FROM e) SELECT eid, row_number() OVER (ORDER BY z, eid)::INTEGER AS place FROM c")
def odometry_first(spark, sf):
    from pyspark.sql import Window

    e = F.col("event_id")
    base = F.call_function("div", e, F.lit(7))
    c = graph.odometry_split(table(spark, sf, "events").select(e.alias("eid"), base.alias("v0"), (base + e % 5 - 2).alias("v1")))
    return c.select("eid", F.row_number().over(Window.orderBy("is_closure", "eid")).alias("place"))


@query("SELECT c_custkey AS v FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def uncovered_vertices(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("v")).join(table(spark, sf, "orders").select(F.col("o_custkey").alias("v")), "v", "left_anti")


@query("WITH g AS (SELECT p_partkey AS v, p_brand AS b FROM part) SELECT row_number() OVER (ORDER BY i, j) - 1 AS n, i, j, w FROM (SELECT row_number() OVER (ORDER BY b) AS i, w, row_number() OVER (ORDER BY b DESC) AS j FROM (SELECT b, count(*) AS w FROM g GROUP BY b))")
def graph_to_matrix_market(spark, sf):
    from pyspark.sql import Window

    w = table(spark, sf, "part").groupBy(F.col("p_brand").alias("b")).agg(F.count("*").alias("w"))
    p = w.select("w", F.row_number().over(Window.orderBy("b")).cast("long").alias("i"), F.row_number().over(Window.orderBy(F.desc("b"))).cast("long").alias("j"))
    return p.select((F.row_number().over(Window.orderBy("i", "j")) - 1).cast("long").alias("n"), "i", "j", "w")
