"""Scalar geometry queries: angles, planar poses, cameras, robust weights, polynomials, triangulation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import angles, scalars
from .derived import ODOMETRY, clamp_sql, clean, clean_sql, odometry, table, wrap_sql

QUERIES = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


TAU = "6.283185307179586"
NEXT = f"(SELECT user_id, k, x, y, t, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(t) OVER w AS t2, us, lead(us) OVER w AS us2 FROM {ODOMETRY} WINDOW w AS (PARTITION BY user_id ORDER BY k))"


def consecutive(spark, sf):
    w = Window.partitionBy("user_id").orderBy("k")
    o = odometry(spark, sf)
    return o.select("user_id", "k", F.col("x").alias("a_x"), F.col("y").alias("a_y"), F.col("t").alias("a_t"), *[F.lead(c).over(w).alias(f"b_{c}") for c in ("x", "y", "t")], "us", F.lead("us").over(w).alias("us2")).where("b_x IS NOT NULL")


@query(f"SELECT event_id, {clean_sql(clamp_sql('value'))} AS clamped, {clean_sql(wrap_sql('value - 50'))} AS wrapped, {clean_sql('CASE WHEN abs(value - 20) <= abs(value - 40) AND abs(value - 20) <= abs(value - 60) THEN value - 20 WHEN abs(value - 40) <= abs(value - 60) THEN value - 40 ELSE value - 60 END')} AS nearest FROM events")
def angle_functions(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", clean(angles.clamp_angle(v)).alias("clamped"), clean(angles.wrap_error(v - 50)).alias("wrapped"), clean(angles.min_abs3(v - 20, v - 40, v - 60)).alias("nearest"))


@query(f"SELECT event_id, {clean_sql('CASE WHEN event_id % 5 = 0 THEN 0 ELSE value % ' + TAU + ' END')} AS clamped FROM events")
def angle_not_finite(spark, sf):
    v = F.when(F.col("event_id") % 10 == 0, float("nan")).when(F.col("event_id") % 5 == 0, float("inf")).otherwise(F.col("value"))
    return table(spark, sf, "events").select("event_id", clean(angles.clamp_angle(v)).alias("clamped"))


_REL = {"dx": "cos(t) * (x2 - x) + sin(t) * (y2 - y)", "dy": "cos(t) * (y2 - y) - sin(t) * (x2 - x)", "dt": clamp_sql("t2 - t")}


@query(f"SELECT user_id, k, {', '.join(f'{clean_sql(v)} AS {k}' for k, v in _REL.items())} FROM {NEXT} WHERE x2 IS NOT NULL")
def odometry_relative(spark, sf):
    r = angles.relative(angles.pose2("a"), angles.pose2("b"))
    return consecutive(spark, sf).select("user_id", "k", clean(r.x).alias("dx"), clean(r.y).alias("dy"), clean(r.t).alias("dt"))


@query(f"SELECT user_id, k, {clean_sql('x + cos(t) * x2 - sin(t) * y2')} AS x, {clean_sql('y + sin(t) * x2 + cos(t) * y2')} AS y, {clean_sql(clamp_sql('t + t2'))} AS t FROM {NEXT} WHERE x2 IS NOT NULL")
def pose_compose(spark, sf):
    c = angles.compose(angles.pose2("a"), angles.pose2("b"))
    return consecutive(spark, sf).select("user_id", "k", clean(c.x).alias("x"), clean(c.y).alias("y"), clean(c.t).alias("t"))


@query(f"SELECT user_id, k, {clean_sql('-cos(t) * x - sin(t) * y')} AS x, {clean_sql('sin(t) * x - cos(t) * y')} AS y, {clean_sql(clamp_sql('-t'))} AS t FROM {ODOMETRY}")
def pose_invert(spark, sf):
    i = angles.invert(angles.Pose2(F.col("x"), F.col("y"), F.col("t")))
    return odometry(spark, sf).select("user_id", "k", clean(i.x).alias("x"), clean(i.y).alias("y"), clean(i.t).alias("t"))


@query(f"SELECT user_id, k, {clean_sql('greatest(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)), 1e-5)')} AS r, {clean_sql(wrap_sql('atan2(y2 - y, x2 - x) - t'))} AS b FROM {NEXT} WHERE x2 IS NOT NULL")
def range_bearing(spark, sf):
    r, b = angles.range_bearing(angles.pose2("a"), F.col("b_x"), F.col("b_y"))
    return consecutive(spark, sf).select("user_id", "k", clean(r).alias("r"), clean(b).alias("b"))


@query(f"SELECT user_id, k, {clean_sql('sqrt(x * x + y * y)')} AS r, {clean_sql('atan2(y, x)')} AS phi FROM {ODOMETRY}")
def cartesian_to_polar(spark, sf):
    r, phi = angles.polar(F.col("x"), F.col("y"))
    return odometry(spark, sf).select("user_id", "k", clean(r).alias("r"), clean(phi).alias("phi"))


_J = {"j02": "cos(t) * (y2 - y) - sin(t) * (x2 - x)", "j12": "-cos(t) * (x2 - x) - sin(t) * (y2 - y)", "c02": "-sin(t) * x2 - cos(t) * y2", "c12": "cos(t) * x2 - sin(t) * y2", "b00": "-(x2 - x) / r", "b10": "(y2 - y) / (r * r)"}


@query(f"SELECT user_id, k, {', '.join(f'{clean_sql(v)} AS {k}' for k, v in _J.items())} FROM (SELECT *, greatest(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)), 1e-5) AS r FROM {NEXT} WHERE x2 IS NOT NULL)")
def pose_jacobians(spark, sf):
    a, b = angles.pose2("a"), angles.pose2("b")
    rel, comp, rb = angles.relative_jacobians(a, b)[0], angles.compose_jacobians(a, b)[0], angles.range_bearing_jacobians(a, b.x, b.y)[0]
    picked = {"j02": rel[0][2], "j12": rel[1][2], "c02": comp[0][2], "c12": comp[1][2], "b00": rb[0][0], "b10": rb[1][0]}
    return consecutive(spark, sf).select("user_id", "k", *[clean(v).alias(k) for k, v in picked.items()])


_P = "(SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity - 25) / 10 AS x, l_discount * 20 - 1 AS y, 5 + l_tax * 50 AS z FROM lineitem)"


def points(spark, sf):
    q = F.col
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ((q("l_quantity") - 25) / 10).alias("x"), (q("l_discount") * 20 - 1).alias("y"), (5 + q("l_tax") * 50).alias("z"))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, {clean_sql('320 + u * f')} AS px, {clean_sql('240 + v * f')} AS py FROM (
  SELECT *, 1 + 0.1 / (505.0 * 505.0) * (u * u + v * v) AS f FROM (SELECT *, 500.0 * x / z AS u, 510.0 * y / z AS v FROM {_P}))""")
def project_mono(spark, sf):
    px, py = scalars.project_mono(F.col("x"), F.col("y"), F.col("z"), *map(F.lit, (500.0, 510.0, 320.0, 240.0, 0.1)))
    return points(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", clean(px).alias("px"), clean(py).alias("py"))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, {clean_sql('320 + u * (1 + 0.1 / 505.0 * sqrt(u * u + v * v))')} AS ul, {clean_sql('240 + v * (1 + 0.1 / 505.0 * sqrt(u * u + v * v))')} AS vl,
  {clean_sql('320 + w * (1 + 0.1 / 505.0 * sqrt(w * w + v * v))')} AS ur FROM (SELECT *, 500.0 * x / z AS u, 510.0 * y / z AS v, 500.0 * (x - 0.12) / z AS w FROM {_P})""")
def project_stereo(spark, sf):
    ul, vl, ur = scalars.project_stereo(F.col("x"), F.col("y"), F.col("z"), *map(F.lit, (500.0, 510.0, 320.0, 240.0, 0.1, 0.12)))
    return points(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", clean(ul).alias("ul"), clean(vl).alias("vl"), clean(ur).alias("ur"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, {clean_sql('0.5 + (x - 0.5) * (1 + 0.01 * r2 + 0.001 * r2 * r2)')} AS u, {clean_sql('0.25 + (y - 0.25) * (1 + 0.01 * r2 + 0.001 * r2 * r2)')} AS v FROM (SELECT *, (x - 0.5) * (x - 0.5) + (y - 0.25) * (y - 0.25) AS r2 FROM {_P})")
def distort_points(spark, sf):
    u, v = scalars.distort(F.col("x"), F.col("y"), *map(F.lit, (0.5, 0.25, 0.01, 0.001)))
    return points(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", clean(u).alias("u"), clean(v).alias("v"))


_D1 = "1 + 0.001 * (a * a + b * b)"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, {clean_sql('0.5 + a / (1 + 0.001 * (a2 * a2 + b2 * b2))')} AS u, {clean_sql('0.25 + b / (1 + 0.001 * (a2 * a2 + b2 * b2))')} AS v FROM (
  SELECT *, a / ({_D1}) AS a2, b / ({_D1}) AS b2 FROM (SELECT *, x - 0.5 AS a, y - 0.25 AS b FROM {_P}))""")
def undistort_points(spark, sf):
    u, v = scalars.undistort(F.col("x"), F.col("y"), *map(F.lit, (0.5, 0.25, 0.001)), steps=2)
    return points(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", clean(u).alias("u"), clean(v).alias("v"))


_ROBUST = {"huber": "CASE WHEN abs(e) <= 1.345 THEN 1.0 ELSE 1.345 / abs(e) END", "by_chi2": "CASE WHEN abs(e * e / 0.3) <= 1.345 THEN 1.0 ELSE 1.345 / abs(e * e / 0.3) END", "cauchy": "1.0 / (1.0 + e * e)", "tukey": "CASE WHEN abs(e) <= 4.685 THEN pow(1.0 - (e / 4.685) * (e / 4.685), 2.0) ELSE 0.0 END"}


@query(f"SELECT event_id, {', '.join(f'{clean_sql(v)} AS {k}' for k, v in _ROBUST.items())} FROM (SELECT event_id, value / 10 - 3 AS e FROM events)")
def robust_weights(spark, sf):
    e = F.col("value") / 10 - 3
    return table(spark, sf, "events").select("event_id", clean(scalars.huber(e)).alias("huber"), clean(scalars.robust_weight_by_chi2(e * e, 0.3)).alias("by_chi2"), clean(scalars.cauchy(e)).alias("cauchy"), clean(scalars.tukey(e)).alias("tukey"))


def erf_sql(x: str) -> str:
    t = f"(1.0 / (1.0 + 0.3275911 * abs({x})))"
    p = f"(((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t})"
    return f"(sign({x}) * (1.0 - {p} * exp(-({x}) * ({x}))))"


def cdf_sql(t: str, m: str, v: str) -> str:
    return f"((1.0 + {erf_sql(f'((({t}) - {m}) / sqrt(2.0 * {v}))')}) / 2.0)"


@query(f"SELECT event_id, {clean_sql(erf_sql('e'))} AS erf, {clean_sql(cdf_sql('e', '0.5', '2.0'))} AS cdf, {clean_sql(cdf_sql('e', '0.5', '2.0') + ' - ' + cdf_sql('-e', '0.5', '2.0'))} AS inside FROM (SELECT event_id, value / 20 - 2 AS e FROM events)")
def gaussian_probability(spark, sf):
    e = F.col("value") / 20 - 2
    m, v = F.lit(0.5), F.lit(2.0)
    return table(spark, sf, "events").select("event_id", clean(scalars.erf(e)).alias("erf"), clean(scalars.gaussian_cdf(e, m, v)).alias("cdf"), clean(scalars.within_probability(e, m, v)).alias("inside"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN q <= 0 THEN -1e100 ELSE 0.5 * ln(q) END, 4) + 0.0 AS gain FROM (SELECT *, (l_quantity * (l_quantity * 2.0 - 0.25) - (l_quantity - 0.5)) / (l_quantity * 3.0 * 2.0) AS q FROM lineitem)")
def information_gain(spark, sf):
    q = F.col("l_quantity")
    zero = F.lit(0.0)
    bottom = scalars.det3([q, zero, zero, zero, F.lit(3.0), zero, zero, zero, F.lit(2.0)])
    det = scalars.det2([q, F.lit(1.0), q - 0.5, q * 2.0 - 0.25])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", clean(scalars.information_gain(det, bottom)).alias("gain"))


_C = (1.0, -2.0, 0.5, 0.25)


@query(f"SELECT event_id, {clean_sql('1.0 + e * (-2.0 + e * (0.5 + e * 0.25))')} AS v, {clean_sql('-2.0 + e * (1.0 + e * 0.75)')} AS d1, {clean_sql('1.0 + e * 1.5')} AS d2, 1.5 AS d3 FROM (SELECT event_id, value / 10 - 5 AS e FROM events)")
def polynomial_values(spark, sf):
    e = F.col("value") / 10 - 5
    return table(spark, sf, "events").select("event_id", clean(scalars.polynomial(e, _C)).alias("v"), *[clean(scalars.polynomial(e, scalars.derivative(_C, n))).alias(f"d{n}") for n in (1, 2, 3)])


@query("""SELECT event_id, n::INTEGER AS n, round(CASE WHEN a = 0 THEN CASE WHEN b <> 0 THEN -c / b END WHEN d >= 0 THEN least((-b - sqrt(greatest(d, 0))) / (2 * a), (-b + sqrt(greatest(d, 0))) / (2 * a)) END, 4) + 0.0 AS low,
  round(CASE WHEN a <> 0 AND d > 0 THEN greatest((-b - sqrt(greatest(d, 0))) / (2 * a), (-b + sqrt(greatest(d, 0))) / (2 * a)) END, 4) + 0.0 AS high
FROM (SELECT *, b * b - 4 * a * c AS d, CASE WHEN a = 0 THEN CASE WHEN b <> 0 THEN 1 ELSE 0 END WHEN b * b - 4 * a * c > 0 THEN 2 WHEN b * b - 4 * a * c = 0 THEN 1 ELSE 0 END AS n
FROM (SELECT event_id, (event_id % 5 - 2)::DOUBLE AS a, (event_id % 7 - 3)::DOUBLE AS b, (event_id % 11 - 5)::DOUBLE AS c FROM events))""")
def quadratic_roots(spark, sf):
    e = table(spark, sf, "events").select("event_id", *[(F.col("event_id") % m - (m - 1) // 2).cast("double").alias(n) for m, n in ((5, "a"), (7, "b"), (11, "c"))])
    n, low, high = scalars.quadratic_roots(F.col("a"), F.col("b"), F.col("c"))
    return e.select("event_id", n.cast("int").alias("n"), clean(low).alias("low"), clean(high).alias("high"))


_MID = """(SELECT *, (de * ew - ee * dw) / b AS s, (dd * ew - de * dw) / b AS u FROM (SELECT *, dd * ee - de * de AS b FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, x, y, z, 1.0 + x * x + y * y AS dd, x + y * 0.5 + 1.0 AS de, 1.0 + 0.25 + 1.0 AS ee, -2.0 * x - 0.0 * y AS dw, -2.0 AS ew FROM """


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, {clean_sql('(s * x + 2.0 + u) / 2')} AS mx, {clean_sql('(s * y + u * 0.5) / 2')} AS my, {clean_sql('(s + u) / 2')} AS mz FROM {_MID} {_P})))")
def triangulate_midpoint(spark, sf):
    zero, one = F.lit(0.0), F.lit(1.0)
    m = scalars.triangulate_midpoint([zero, zero, zero], [F.col("x"), F.col("y"), one], [F.lit(2.0), zero, zero], [one, F.lit(0.5), one])
    return points(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", *[clean(c).alias(n) for c, n in zip(m, ("mx", "my", "mz"))])


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, {clean_sql('10.0 / (z + 0.5) * 0.5')} AS rx, {clean_sql('1.0 + 0.0 * x')} AS ry, {clean_sql('10.0 / (z + 0.5) * 1.0')} AS rz, {clean_sql('x * (500 * 0.12 / z) / 500')} AS dx, {clean_sql('500 * 0.12 / z')} AS dz FROM {_P}")
def triangulate_plane_disparity(spark, sf):
    zero, one = F.lit(0.0), F.lit(1.0)
    r = scalars.triangulate_ray_plane([zero, one, zero], [F.lit(0.5), zero, one], [one, zero, F.col("z")], F.lit(10.0))
    d = scalars.triangulate_disparity(F.col("x"), F.col("y"), F.col("z"), F.lit(500.0), zero, zero, F.lit(0.12))
    return points(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", *[clean(c).alias(n) for c, n in zip([*r, d[0], d[2]], ("rx", "ry", "rz", "dx", "dz"))])


_H = (1.1, 0.02, 0.3, -0.01, 0.95, -0.2, 0.001, 0.002, 1.0)


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, {clean_sql('((1.1 * x + 0.02 * y + 0.3) / w - x) * ((1.1 * x + 0.02 * y + 0.3) / w - x) + ((-0.01 * x + 0.95 * y - 0.2) / w - y) * ((-0.01 * x + 0.95 * y - 0.2) / w - y)')} AS transfer FROM (SELECT *, 0.001 * x + 0.002 * y + 1.0 AS w FROM {_P})")
def homography_transfer(spark, sf):
    return points(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", clean(scalars.homography_transfer(_H, F.col("x"), F.col("y"), F.col("x"), F.col("y"))).alias("transfer"))


@query("SELECT o_orderkey, ceil(log2(o_orderkey + 1))::INTEGER AS bits FROM orders")
def ceil_log2(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", scalars.ceil_log2(F.col("o_orderkey") + 1).alias("bits"))


_RPY = {"m00": "cos(w) * cos(p)", "m01": "cos(w) * sin(p) * sin(r) - sin(w) * cos(r)", "m12": "sin(w) * sin(p) * cos(r) - cos(w) * sin(r)", "m20": "-sin(p)", "m22": "cos(p) * cos(r)"}


@query(f"SELECT event_id, {', '.join(f'{clean_sql(v)} AS {k}' for k, v in _RPY.items())} FROM (SELECT event_id, value / 30 AS r, (event_id % 31 - 15) / 10.0 AS p, (event_id % 61 - 30) / 10.0 AS w FROM events)")
def rpy_rotation(spark, sf):
    m = scalars.rpy_matrix(F.col("value") / 30, (F.col("event_id") % 31 - 15) / 10.0, (F.col("event_id") % 61 - 30) / 10.0)
    return table(spark, sf, "events").select("event_id", *[clean(m[int(k[1]) * 3 + int(k[2])]).alias(k) for k in _RPY])
