"""Spatial queries: poses in Arrow batches, bundle adjustment, eigen and marginal kernels over derived tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import spatial as sp
from .derived import clean, clean_sql, table
from .q_geometry import NEXT, consecutive

QUERIES = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _lifted(b: pd.DataFrame, p: str) -> np.ndarray:
    """Planar poses as spatial ones that turn about z."""
    z = np.zeros(len(b))
    return np.stack([b[f"{p}_x"], b[f"{p}_y"], z + 1.0, z, z, np.remainder(b[f"{p}_t"] + np.pi, 2 * np.pi) - np.pi], -1)


def _by_pose(spark, sf, f):
    def run(batches):
        for b in batches:
            out = f(_lifted(b, "a"), _lifted(b, "b"))
            yield pd.DataFrame({"user_id": b["user_id"], "k": b["k"], "x": out[:, 0], "y": out[:, 1], "z": out[:, 2], "s": np.sin(out[:, 5])})

    o = consecutive(spark, sf).select("user_id", "k", *[f"{e}_{c}" for e in "ab" for c in "xyt"]).mapInPandas(run, "user_id long, k long, x double, y double, z double, s double")
    return o.select("user_id", "k", *[clean(F.col(c)).alias(c) for c in "xyzs"])


@query(f"SELECT user_id, k, {clean_sql('cos(t) * (x2 - x) + sin(t) * (y2 - y)')} AS x, {clean_sql('cos(t) * (y2 - y) - sin(t) * (x2 - x)')} AS y, 0.0::DOUBLE AS z, {clean_sql('sin(t2 - t)')} AS s FROM {NEXT} WHERE x2 IS NOT NULL")
def spatial_relative(spark, sf):
    return _by_pose(spark, sf, sp.relative)


@query(f"SELECT user_id, k, {clean_sql('x + cos(t) * x2 - sin(t) * y2')} AS x, {clean_sql('y + sin(t) * x2 + cos(t) * y2')} AS y, 2.0::DOUBLE AS z, {clean_sql('sin(t + t2)')} AS s FROM {NEXT} WHERE x2 IS NOT NULL")
def spatial_compose(spark, sf):
    return _by_pose(spark, sf, sp.compose)


@query(f"SELECT user_id, k, {clean_sql('cos(t) * (x2 - x) + sin(t) * (y2 - y)')} AS x, {clean_sql('cos(t) * (y2 - y) - sin(t) * (x2 - x)')} AS y, 0.0::DOUBLE AS z, 0.0::DOUBLE AS s FROM {NEXT} WHERE x2 IS NOT NULL")
def spatial_to_frame(spark, sf):
    return _by_pose(spark, sf, lambda a, b: np.concatenate((sp.to_frame(a, b[:, :3]), np.zeros((len(a), 3))), -1))


@query(None)
def bundle_adjustment(spark, sf):
    """Parts as points, nations as cameras on a ring that look at the origin; every part is seen by three cameras, with small errors."""
    from ..operators.bundle import bundle_adjust

    n = 25
    angle = 2 * np.pi * np.arange(n) / n
    eye = np.stack([12 * np.cos(angle), 12 * np.sin(angle), 0.5 * np.sin(3 * angle)], -1)
    forward = -eye / np.linalg.norm(eye, axis=1, keepdims=True)
    right = np.cross(forward, np.array([0.0, 0.0, 1.0]))
    right /= np.linalg.norm(right, axis=1, keepdims=True)
    turn = np.stack([right, np.cross(forward, right), forward], -1)
    pose = np.concatenate((eye, sp.matrix_to_axis_angle(turn)), -1)
    k = [500.0, 500.0, 320.0, 240.0, 0.0]
    cams = spark.createDataFrame([(i, *map(float, pose[i]), *k) for i in range(n)], "cam long, " + ", ".join(f"{c} double" for c in ["c0", "c1", "c2", "c3", "c4", "c5", "fx", "fy", "cx", "cy", "k"]))
    p = F.col("p_partkey")
    points = table(spark, sf, "part").select(p.alias("point"), (F.col("p_size") / 25.0 - 1).alias("x"), ((p % 31) / 16.0 - 1).alias("y"), ((p % 17) / 9.0 - 1).alias("z"))
    seen = points.withColumn("cam", F.explode(F.array(*[((F.col("point") * 7 + 5 * i) % n).alias("c") for i in range(3)])))

    def measure(batches):
        for b in batches:
            uv = sp.project(pose[b["cam"].to_numpy()], np.tile(k, (len(b), 1)), b[["x", "y", "z"]].to_numpy())
            noise = np.stack([np.sin(b["point"] * 1.3 + b["cam"]), np.cos(b["point"] * 0.7 - b["cam"])], -1) * 0.5
            yield pd.DataFrame({"point": b["point"], "cam": b["cam"], "u": uv[:, 0] + noise[:, 0], "v": uv[:, 1] + noise[:, 1], "i00": 1.0, "i01": 0.0, "i11": 1.0})

    edges = seen.select("point", "cam", "x", "y", "z").mapInPandas(measure, "point long, cam long, u double, v double, i00 double, i01 double, i11 double")
    done = bundle_adjust(edges, cams, points, iterations=2, constant=[0, 1])
    return done.cameras.select("cam", *[f"c{i}" for i in range(6)]).withColumn("chi2", F.lit(done.chi2))


@query(None)
def marginal_covariances(spark, sf):
    """Diagonal of the covariance of a supplier-part system with a unit prior."""
    from ..operators.linear import dense, marginals

    m = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 50).alias("i"), (F.col("l_partkey") % 50).alias("j")).where("i <> j").groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.count("*").cast("double").alias("w"))
    off = m.select("i", "j", (-F.col("w")).alias("x")).unionByName(m.select(F.col("j").alias("i"), F.col("i").alias("j"), (-F.col("w")).alias("x")))
    own = m.select(F.explode(F.array("i", "j")).alias("i"), "w").groupBy("i").agg((F.sum("w") + 1.0).alias("x")).select("i", F.col("i").alias("j"), "x")
    sigma = marginals(dense(off.unionByName(own), 50))
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(np.diag(sigma))], "i long, variance double")
