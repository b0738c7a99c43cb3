"""Least squares, trajectories, association and solver queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import angles, scalars
from ..operators import normal, trajectory
from .derived import ODOMETRY, clean, clean_sql, odometry, table, wrap_sql
from .q_geometry import NEXT, consecutive, erf_sql

QUERIES = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


_LINE = """(SELECT l_suppkey, n, sx, sxx, sy, sxy, syy, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b FROM (
  SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS sx, sum(l_quantity * l_quantity) AS sxx, sum(l_extendedprice / 1000) AS sy, sum(l_quantity * (l_extendedprice / 1000)) AS sxy, sum((l_extendedprice / 1000) * (l_extendedprice / 1000)) AS syy FROM lineitem GROUP BY l_suppkey))"""


@query(f"SELECT l_suppkey, n, {clean_sql('(sy - b * sx) / n')} AS a, {clean_sql('b')} AS b, {clean_sql('syy - (sy - b * sx) / n * sy - b * sxy', 2)} AS chi2 FROM {_LINE}")
def supplier_fit(spark, sf):
    """A line per supplier: vertex = supplier, measurement = lineitem; one step of normal equations."""
    s = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    f = normal.fit_lines(s, "l_suppkey", "x", "y")
    return f.select(F.col("v").alias("l_suppkey"), "n", clean(F.col("a")).alias("a"), clean(F.col("b")).alias("b"), clean(F.col("chi2"), 2).alias("chi2"))


def supplier_edges(spark, sf):
    """Edges (v0 supplier, v1 part) measuring x = quantity against states s and p: r = x - (s + p), information 0.5."""
    e = table(spark, sf, "lineitem").select(F.monotonically_increasing_id().alias("eid"), F.col("l_suppkey").alias("v0"), (F.col("l_partkey") + 1_000_000).alias("v1"), F.col("l_quantity").alias("z"))
    states = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("v"), (F.col("s_suppkey") % 10).cast("double").alias("s")).unionByName(table(spark, sf, "part").select((F.col("p_partkey") + 1_000_000).alias("v"), F.col("p_size").cast("double").alias("s")))
    m = normal.with_states(e, states, ["v0", "v1"], ["s"])
    return m.withColumn("r", F.col("z") - F.col("v0_s") - F.col("v1_s"))


_SE = "(SELECT l_suppkey AS v0, l_partkey + 1000000 AS v1, l_quantity - (l_suppkey % 10) - p_size AS r FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"


@query(f"SELECT count(*) AS n_edges, {clean_sql('sum(r * 0.5 * r)', 2)} AS chi2, {clean_sql('sum(r * 0.5 * r) / (count(*) - 1)')} AS chi2_normalized FROM {_SE}")
def total_chi2(spark, sf):
    c = normal.chi2(supplier_edges(spark, sf), F.col("r") * 0.5 * F.col("r"), 1)
    return c.select("n_edges", clean(F.col("chi2"), 2).alias("chi2"), clean(F.col("chi2_normalized")).alias("chi2_normalized"))


@query(f"SELECT v, 0 AS c, {clean_sql('sum(0.5 * r)')} AS x FROM (SELECT v0 AS v, r FROM {_SE} UNION ALL SELECT v1, r FROM {_SE}) GROUP BY v")
def right_side_reduction(spark, sf):
    m = supplier_edges(spark, sf)
    one = [[F.lit(1.0)]]
    return normal.right_side(m, ["v0", "v1"], [one, one], [F.col("r") * 0.5]).withColumn("x", clean(F.col("x")))


@query(f"SELECT bi, bj, 0 AS r, 0 AS c, count(*) * 0.5 AS x FROM (SELECT v0 AS bi, v0 AS bj FROM {_SE} UNION ALL SELECT v1, v1 FROM {_SE} UNION ALL SELECT v0, v1 FROM {_SE}) GROUP BY bi, bj")
def matrix_reduction(spark, sf):
    one = [[F.lit(1.0)]]
    return normal.blocks(supplier_edges(spark, sf), ["v0", "v1"], [one, one], [[F.lit(0.5)]])


@query(f"SELECT v, 0 AS c, {clean_sql('sum(0.5 * r)')} AS x FROM (SELECT v0 AS v, r FROM {_SE} UNION ALL SELECT v1, r FROM {_SE}) WHERE v BETWEEN 10 AND 20 GROUP BY v")
def partial_reduction(spark, sf):
    m = supplier_edges(spark, sf)
    one = [[F.lit(1.0)]]
    return normal.right_side(m, ["v0", "v1"], [one, one], [F.col("r") * 0.5]).where("v BETWEEN 10 AND 20").withColumn("x", clean(F.col("x")))


@query("SELECT max(0.5 * l_quantity * l_quantity) AS max_diagonal FROM lineitem")
def max_hessian_diagonal(spark, sf):
    m = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("v0"), F.col("l_quantity").alias("q"))
    return normal.largest_diagonal(normal.blocks(m, ["v0"], [[[F.col("q")]]], [[F.lit(0.5)]], reduce=False))


@query("SELECT (SELECT 2 * count(*) FROM supplier)::BIGINT AS unknowns, (SELECT count(*) FROM lineitem) AS measurements, (SELECT 2 * count(*) FROM supplier) > (SELECT count(*) FROM lineitem) AS underspecified")
def underspecified_check(spark, sf):
    e = table(spark, sf, "lineitem").select(F.lit(1).alias("rd"))
    return normal.underspecified(e, table(spark, sf, "supplier").select(F.lit(2).alias("dim")))


@query("WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem), t AS (SELECT DISTINCT l_suppkey FROM e WHERE l_orderkey % 1000 = 0) SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM e WHERE l_suppkey IN (SELECT * FROM t))")
def touched_edges(spark, sf):
    e = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return normal.touched(e, e.where("l_orderkey % 1000 = 0"), ["l_suppkey"]).agg(F.count("*").alias("n"))


_RB = {"r0": "2.0 - greatest(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)), 1e-5)", "r1": wrap_sql("0.1 - " + wrap_sql("atan2(y2 - y, x2 - x) - t"))}


@query(f"SELECT user_id, k, {', '.join(f'{clean_sql(v)} AS {n}' for n, v in _RB.items())} FROM {NEXT} WHERE x2 IS NOT NULL")
def range_bearing_residuals(spark, sf):
    r, b = angles.range_bearing(angles.pose2("a"), F.col("b_x"), F.col("b_y"))
    return consecutive(spark, sf).select("user_id", "k", clean(2.0 - r).alias("r0"), clean(angles.wrap_error(0.1 - b)).alias("r1"))


_PR = {"e0": "1.0 - (cos(t) * (x2 - x) + sin(t) * (y2 - y))", "e1": "0.5 - (cos(t) * (y2 - y) - sin(t) * (x2 - x))", "e2": wrap_sql("0.25 - ((t2 - t) % 6.283185307179586)")}


@query(f"SELECT user_id, count(*) AS n, {clean_sql('sum(45 * (e0 * e0 + e1 * e1 + e2 * e2))', 2)} AS chi2 FROM (SELECT user_id, {', '.join(f'{v} AS {n}' for n, v in _PR.items())} FROM {NEXT} WHERE x2 IS NOT NULL) GROUP BY user_id")
def pose_chi2(spark, sf):
    r = angles.relative(angles.pose2("a"), angles.pose2("b"))
    e = [1.0 - r.x, 0.5 - r.y, angles.wrap_error(0.25 - r.t)]
    chi = sum((x * x for x in e), F.lit(0.0)) * 45
    return consecutive(spark, sf).select("user_id", chi.alias("chi")).groupBy("user_id").agg(F.count("*").alias("n"), clean(F.sum("chi"), 2).alias("chi2"))


@query(f"SELECT user_id, k, {clean_sql('x2 - (x + t * d)')} AS r0, {clean_sql('y2 - (y + 0.5 * d)')} AS r1, {clean_sql('t2 - t')} AS r2, {clean_sql('sqrt(x * x + y * y)')} AS rng FROM (SELECT *, (us2 - us) / 1e9 AS d FROM {NEXT}) WHERE x2 IS NOT NULL")
def constant_velocity(spark, sf):
    d = (F.col("us2") - F.col("us")) / 1e9
    return consecutive(spark, sf).select("user_id", "k", clean(F.col("b_x") - (F.col("a_x") + F.col("a_t") * d)).alias("r0"), clean(F.col("b_y") - (F.col("a_y") + 0.5 * d)).alias("r1"), clean(F.col("b_t") - F.col("a_t")).alias("r2"), clean(F.sqrt(F.col("a_x") * F.col("a_x") + F.col("a_y") * F.col("a_y"))).alias("rng"))


def pairs(spark, sf):
    """Dimensions 1-3 of the embeddings against 4-6, by vector."""
    e = F.col("embedding")
    d = table(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), *[e[i].cast("double").alias(f"p{i}") for i in range(6)])
    return trajectory.pair(d.select("idx", *[F.col(f"p{i}").alias(k) for i, k in enumerate("xyz")]), d.select("idx", *[F.col(f"p{i + 3}").alias(k) for i, k in enumerate("xyz")]))


_PAIRS = "(SELECT vec_id AS idx, embedding[1]::DOUBLE AS ax, embedding[2]::DOUBLE AS ay, embedding[3]::DOUBLE AS az, embedding[4]::DOUBLE AS bx, embedding[5]::DOUBLE AS \"by\", embedding[6]::DOUBLE AS bz FROM embeddings)"
_SQ = "((ax - bx) * (ax - bx) + (ay - \"by\") * (ay - \"by\") + (az - bz) * (az - bz))"


@query(f"SELECT count(*) AS n, {clean_sql(f'sqrt(avg({_SQ}))')} AS rmse FROM {_PAIRS}")
def absolute_trajectory_error(spark, sf):
    return trajectory.absolute_error(pairs(spark, sf)).withColumn("rmse", clean(F.col("rmse")))


def planar_pairs(spark, sf):
    """Planar poses: dimensions 1-3 of the embeddings against 4-6, by vector."""
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), *[e[3 * i + j].cast("double").alias(f"{s}_{k}") for i, s in enumerate("ab") for j, k in enumerate("xyt")])


_PLANAR = "(SELECT vec_id AS idx, " + ", ".join(f"embedding[{3 * i + j + 1}]::DOUBLE AS {s}_{k}" for i, s in enumerate("ab") for j, k in enumerate("xyt")) + " FROM embeddings)"
#: The earlier pose q as it is seen from p, for each trajectory; then the one motion as seen from the other.
_MOTION = ", ".join(f"cos(p.{s}_t) * (q.{s}_x - p.{s}_x) + sin(p.{s}_t) * (q.{s}_y - p.{s}_y) AS {s}_dx, cos(p.{s}_t) * (q.{s}_y - p.{s}_y) - sin(p.{s}_t) * (q.{s}_x - p.{s}_x) AS {s}_dy, q.{s}_t - p.{s}_t AS {s}_dt" for s in "ab")
_OFF = f"SELECT *, cos(a_dt) * (b_dx - a_dx) + sin(a_dt) * (b_dy - a_dy) AS ex, cos(a_dt) * (b_dy - a_dy) - sin(a_dt) * (b_dx - a_dx) AS ey, degrees(abs({wrap_sql('((b_dt - a_dt) % 6.283185307179586)')})) AS turned"


@query(f"""WITH p AS {_PLANAR}, o AS ({_OFF} FROM (SELECT {_MOTION} FROM p JOIN p q ON q.idx = p.idx - 2)), f AS (SELECT sqrt(ex * ex + ey * ey) AS far, turned FROM o)
SELECT count(*) AS n, {clean_sql('sum(far)', 4)} AS translation, {clean_sql('sum(turned)', 4)} AS rotation, {clean_sql('sqrt(avg(far * far))')} AS rmse_translation, {clean_sql('sqrt(avg(turned * turned))')} AS rmse_rotation FROM f""")
def relative_pose_error(spark, sf):
    r = trajectory.relative_error(planar_pairs(spark, sf), 2)
    return r.select("n", clean(F.col("translation"), 4).alias("translation"), clean(F.col("rotation"), 4).alias("rotation"), *[clean(F.col(c)).alias(c) for c in ("rmse_translation", "rmse_rotation")])


@query(f"""WITH p AS (SELECT idx % 7 AS g, * FROM {_PLANAR}), o AS ({_OFF} FROM (SELECT p.g, {_MOTION} FROM p JOIN p q ON p.g = q.g AND q.idx < p.idx)), s AS (SELECT g, sum(ex * ex + ey * ey) AS s FROM o GROUP BY g)
SELECT p.g, count(*) AS n, {clean_sql('any_value(s) / count(*)', 4)} AS squared_translation FROM p JOIN s ON p.g = s.g GROUP BY p.g""")
def relative_pose_error_all(spark, sf):
    r = trajectory.relative_error_all(planar_pairs(spark, sf).withColumn("g", F.col("idx") % 7), ["g"])
    return r.withColumn("squared_translation", clean(F.col("squared_translation"), 4))


_MOM = {"ma": "avg(ax)", "mb": "avg(bx)", "cxx": "sum(ax * bx) - sum(ax) * sum(bx) / count(*)", "cyz": "sum(ay * bz) - sum(ay) * sum(bz) / count(*)", "spread": "sum(ax * ax + ay * ay + az * az) - (sum(ax) * sum(ax) + sum(ay) * sum(ay) + sum(az) * sum(az)) / count(*)"}


@query(f"SELECT count(*) AS n, {', '.join(f'{clean_sql(v)} AS {k}' for k, v in _MOM.items())} FROM {_PAIRS}")
def centroid_and_cross_covariance(spark, sf):
    m = trajectory.moments(pairs(spark, sf))
    return m.select("n", *[clean(F.col(c)).alias(k) for k, c in (("ma", "max"), ("mb", "mbx"), ("cxx", "cxx"), ("cyz", "cyz"), ("spread", "spread"))])


@query(None)
def rigid_alignment(spark, sf):
    p = pairs(spark, sf)
    r, t, s = trajectory.alignment(p, with_scale=True)
    return trajectory.absolute_error(trajectory.transform(p, r, t, s)).withColumn("scale", F.lit(s))


_PX = {c: f"(1.0 + {erf_sql(f'((2.0 - {d}) / sqrt(2.0 * {v}))')}) / 2.0 - (1.0 + {erf_sql(f'((-2.0 - {d}) / sqrt(2.0 * {v}))')}) / 2.0" for c, d, v in (("px", "(lx - x)", "1.5"), ("py", "(ly - y)", "2.5"))}


@query(f"SELECT user_id, k, {clean_sql(f'least({_PX["px"]}, {_PX["py"]})')} AS probability FROM (SELECT o.*, last_value(x) OVER w AS lx, last_value(y) OVER w AS ly, max(k) OVER w AS last FROM {ODOMETRY} o WINDOW w AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE k < last AND least({_PX['px']}, {_PX['py']}) > 0.1")
def association_candidates(spark, sf):
    """Earlier poses whose distance to the newest one is likely small on every axis."""
    w = Window.partitionBy("user_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    o = odometry(spark, sf).withColumns({"lx": F.last("x").over(w), "ly": F.last("y").over(w), "last": F.max("k").over(w)}).where("k < last")
    px = scalars.within_probability(F.lit(2.0), F.col("lx") - F.col("x"), F.lit(1.5))
    py = scalars.within_probability(F.lit(2.0), F.col("ly") - F.col("y"), F.lit(2.5))
    return o.withColumn("p", F.least(px, py)).where("p > 0.1").select("user_id", "k", clean(F.col("p")).alias("probability"))


@query("SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INTEGER AS rank FROM events) WHERE rank <= 5")
def rank_by_gain(spark, sf):
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return table(spark, sf, "events").select("user_id", "event_id", r.alias("rank")).where("rank <= 5")


@query("SELECT o_orderkey, c_custkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey AND o_orderkey % 1500 = c_custkey")
def closure_lookup(spark, sf):
    o = table(spark, sf, "orders").withColumn("k", F.col("o_orderkey") % 1500)
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").alias("o_custkey"), F.col("c_custkey").alias("k"))
    return o.join(c, ["o_custkey", "k"]).select("o_orderkey", "c_custkey", "o_totalprice")


@query(f"SELECT p_brand, {clean_sql('quantile_disc(e, 0.5)')} AS median_error FROM (SELECT p_brand, abs(p_retailprice - 1000) / (1 + p_size) AS e FROM part) GROUP BY p_brand")
def median_error(spark, sf):
    e = (F.abs(F.col("p_retailprice") - 1000) / (1 + F.col("p_size"))).alias("e")
    return table(spark, sf, "part").select("p_brand", e).groupBy("p_brand").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY e)").alias("m")).select("p_brand", clean(F.col("m")).alias("median_error"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {clean_sql('CASE WHEN greatest(abs(l_quantity - 25), abs(l_discount * 100)) > 9 THEN l_quantity - 25 ELSE 0 END')} AS d0, {clean_sql('CASE WHEN greatest(abs(l_quantity - 25), abs(l_discount * 100)) > 9 THEN l_discount * 100 ELSE 0 END')} AS d1 FROM lineitem")
def threshold_updates(spark, sf):
    d0, d1 = F.col("l_quantity") - 25, F.col("l_discount") * 100
    big = F.greatest(F.abs(d0), F.abs(d1)) > 9
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", clean(F.when(big, d0).otherwise(0.0)).alias("d0"), clean(F.when(big, d1).otherwise(0.0)).alias("d1"))


_POLY = "(SELECT l_suppkey % 10 AS g, l_quantity / 10 AS x, l_extendedprice / 10000 AS y FROM lineitem)"
_D = "(n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2))"


@query(f"""SELECT g, n, {clean_sql(f'(t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / {_D}', 3)} AS c0, {clean_sql(f'(n * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)) / {_D}', 3)} AS c1, {clean_sql(f'(n * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / {_D}', 3)} AS c2
FROM (SELECT g, count(*) AS n, sum(x) AS s1, sum(x * x) AS s2, sum(x * x * x) AS s3, sum(x * x * x * x) AS s4, sum(y) AS t0, sum(x * y) AS t1, sum(x * x * y) AS t2 FROM {_POLY} GROUP BY g)""")
def polynomial_fit(spark, sf):
    from ..operators.polynomial import fit_quadratics

    q = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 10).alias("g"), (F.col("l_quantity") / 10).alias("x"), (F.col("l_extendedprice") / 10000).alias("y"))
    return fit_quadratics(q, "g", "x", "y").select("g", "n", *[clean(F.col(f"c{i}"), 3).alias(f"c{i}") for i in range(3)])


@query(None)
def eigenvalues(spark, sf):
    from ..operators import coo
    from ..operators.linear import symmetric_eigenvalues
    from .derived import square

    s = coo.dedupe(square(spark, sf))
    return symmetric_eigenvalues(coo.add(s, coo.transpose(s)), 5)


@query(None)
def conjugate_gradient(spark, sf):
    """A'A + I against a right side of ones."""
    from ..operators import coo
    from ..operators.linear import conjugate_gradient as solve
    from .derived import K, matrix_a

    a = coo.dedupe(matrix_a(spark, sf))
    unit = spark.range(K).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1e6).alias("x"))
    return solve(coo.add(coo.multiply(coo.transpose(a), a), unit), spark.range(K).select(F.col("id").alias("i"), F.lit(1.0).alias("x")), steps=12)


@query(None)
def pose_graph_optimize(spark, sf):
    """Suppliers in a chain with closures to the start, solved by damped steps."""
    from ..operators.optimize import PoseGraph, levenberg_marquardt

    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    chain = s.select(k.alias("eid"), k.alias("v0"), (k + 1).alias("v1"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"), (F.lit(0.1) + F.col("s_acctbal") / 1e6).alias("dt"))
    loops = s.where("s_suppkey >= 20").select((k + 1_000_000).alias("eid"), (k - 20).alias("v0"), k.alias("v1"), F.lit(9.0).alias("dx"), F.lit(14.0).alias("dy"), F.lit(2.0).alias("dt"))
    return levenberg_marquardt(PoseGraph(chain.unionByName(loops))).states
