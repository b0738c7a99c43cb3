"""Trajectories: alignment, absolute and relative errors, pairing by index."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import pose2, relative, wrap_error

AXES = ("x", "y", "z")


def pair(a: DataFrame, b: DataFrame) -> DataFrame:
    """Poses of two trajectories (idx, x, y, z) by index as ax.. and bx..; fails if they differ in length."""
    left = a.select("idx", *[F.col(k).alias(f"a{k}") for k in AXES])
    right = b.select("idx", *[F.col(k).alias(f"b{k}") for k in AXES])
    both = left.join(right, "idx", "full")
    whole = F.col("ax").isNotNull() & F.col("bx").isNotNull()
    return both.where(F.when(whole, True).otherwise(F.raise_error(F.lit("the trajectories differ in length")).cast("boolean")))


def moments(pairs: DataFrame) -> DataFrame:
    """One row: count, centroids, the nine centred cross sums and the centred spread of a; one pass, by raw sums."""
    raw = [F.count("*").alias("n")]
    for k in AXES:
        raw += [F.sum(f"a{k}").alias(f"sa{k}"), F.sum(f"b{k}").alias(f"sb{k}"), F.sum(F.col(f"a{k}") * F.col(f"a{k}")).alias(f"q{k}")]
        raw += [F.sum(F.col(f"a{k}") * F.col(f"b{m}")).alias(f"c{k}{m}") for m in AXES]
    r = pairs.agg(*raw)
    n = F.col("n")
    out = [n]
    for k in AXES:
        out += [(F.col(f"sa{k}") / n).alias(f"ma{k}"), (F.col(f"sb{k}") / n).alias(f"mb{k}")]
        out += [(F.col(f"c{k}{m}") - F.col(f"sa{k}") * F.col(f"sb{m}") / n).alias(f"c{k}{m}") for m in AXES]
    spread = sum((F.col(f"q{k}") - F.col(f"sa{k}") * F.col(f"sa{k}") / n for k in AXES), F.lit(0.0))
    return r.select(*out, spread.alias("spread"))


def alignment(pairs: DataFrame, with_scale: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """(R, t, s) with b ~ s R a + t, least squares, without reflection: sums in Spark, a 3 x 3 decomposition here."""
    m = moments(pairs).first()
    cross = np.array([[m[f"c{i}{j}"] for j in AXES] for i in AXES])
    u, s, vt = np.linalg.svd(cross)
    d = np.array([1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
    r = vt.T @ np.diag(d) @ u.T
    scale = float((s * d).sum() / m["spread"]) if with_scale and m["spread"] else 1.0
    t = np.array([m[f"mb{k}"] for k in AXES]) - scale * r @ np.array([m[f"ma{k}"] for k in AXES])
    return r, t, scale


def transform(pairs: DataFrame, r: np.ndarray, t: np.ndarray, scale: float = 1.0) -> DataFrame:
    """pairs with a moved onto b."""
    moved = {f"a{k}": sum((F.col(f"a{m}") * float(scale * r[i, j]) for j, m in enumerate(AXES)), F.lit(float(t[i]))) for i, k in enumerate(AXES)}
    return pairs.withColumns(moved)


def squared(pairs: DataFrame) -> Column:
    return sum(((F.col(f"a{k}") - F.col(f"b{k}")) * (F.col(f"a{k}") - F.col(f"b{k}")) for k in AXES), F.lit(0.0))


def absolute_error(pairs: DataFrame) -> DataFrame:
    """One row: n and the root mean square of the position errors."""
    return pairs.agg(F.count("*").alias("n"), F.sqrt(F.avg(squared(pairs))).alias("rmse"))


def relative_error(pairs: DataFrame, lag: int = 1) -> DataFrame:
    """One row over two trajectories of planar poses (idx, a_x, a_y, a_t, b_x, b_y, b_t), idx counting them without gaps:
    n, and the sums, means of squares' roots of what the motion over `lag` steps differs by, in position and in degrees.

    The motion of a pose is the earlier pose as it is seen from it, in each trajectory; the error is the one motion as
    seen from the other. Poses are matched by a join on idx, so no task sees a whole trajectory.
    """
    was = pairs.select((F.col("idx") + lag).alias("idx"), *[F.col(f"{s}_{k}").alias(f"was_{s}_{k}") for s in "ab" for k in "xyt"])
    both = pairs.join(was, "idx")
    motion = {s: relative(pose2(s), pose2(f"was_{s}")) for s in "ab"}
    e = relative(motion["a"], motion["b"])
    off = both.select(F.sqrt(e.x * e.x + e.y * e.y).alias("far"), F.degrees(F.abs(wrap_error(e.t))).alias("turned"))
    return off.agg(F.count("*").alias("n"), F.sum("far").alias("translation"), F.sum("turned").alias("rotation"), F.sqrt(F.avg(F.col("far") * F.col("far"))).alias("rmse_translation"), F.sqrt(F.avg(F.col("turned") * F.col("turned"))).alias("rmse_rotation"))


def relative_error_all(pairs: DataFrame, group: list[str]) -> DataFrame:
    """One row a group: n and the squared position errors of relative_error over every lag, summed and divided by the number of poses.

    The error of poses i and j < i is |R_b,i' (b_j - b_i) - R_a,i' (a_j - a_i)|^2. Over all j before i that expands into
    running sums, so no pair is formed. A trajectory is a group; the group column deals them out. Turns don't expand: take them lag by lag.
    """
    before = Window.partitionBy(*group).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    a, b = pose2("a"), pose2("b")
    n = F.count("*").over(before)

    def products(u: Column, v: Column) -> Column:
        """The sum over j < i of (u_j - u_i)(v_j - v_i)."""
        return total(u * v) - u * total(v) - v * total(u) + n * u * v

    cos, sin = F.cos(b.t - a.t), F.sin(b.t - a.t)
    turned = cos * (products(b.x, a.x) + products(b.y, a.y)) + sin * (products(b.y, a.x) - products(b.x, a.y))
    squares = products(a.x, a.x) + products(a.y, a.y) + products(b.x, b.x) + products(b.y, b.y) - 2 * turned
    return pairs.select(*group, squares.alias("s")).groupBy(*group).agg(F.count("*").alias("n"), (F.greatest(F.sum("s"), F.lit(0.0)) / F.count("*")).alias("squared_translation"))
