"""Polynomial fits by power sums, plain, weighted and robust."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import HUBER_K, det3, huber


def fit_quadratics(samples: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, n, c0, c1, c2) of y = c0 + c1 x + c2 x² by key: one aggregation, then Cramer's rule."""
    X, Y = F.col(x), F.col(y)
    s = samples.groupBy(key).agg(F.count("*").alias("n"), F.sum(X).alias("s1"), F.sum(X * X).alias("s2"), F.sum(X * X * X).alias("s3"), F.sum(X * X * X * X).alias("s4"), F.sum(Y).alias("t0"), F.sum(X * Y).alias("t1"), F.sum(X * X * Y).alias("t2"))
    n, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("n", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
    m = [n, s1, s2, s1, s2, s3, s2, s3, s4]
    d = F.nullif(det3(m), F.lit(0.0))

    def replaced(k: int) -> list[Column]:
        out = list(m)
        out[k], out[k + 3], out[k + 6] = t0, t1, t2
        return out

    return s.select(key, "n", *[(det3(replaced(k)) / d).alias(f"c{k}") for k in range(3)])


def normal_sums(samples: DataFrame, x: str, y: str, powers: list[int], weight: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A'WA and A'Wy for a basis of powers: one row of sums comes back."""
    w = F.lit(1.0) if weight is None else weight
    X = F.col(x)
    power = lambda k: F.pow(X, F.lit(k)) if k else F.lit(1.0)
    row = samples.agg(*[F.sum(w * power(k)).alias(f"s{k}") for k in sorted({a + b for a in powers for b in powers})], *[F.sum(w * power(k) * F.col(y)).alias(f"t{k}") for k in powers]).first()
    return np.array([[row[f"s{a + b}"] for b in powers] for a in powers]), np.array([row[f"t{k}"] for k in powers])


def fit(samples: DataFrame, x: str, y: str, powers: list[int], weight: Column | None = None) -> np.ndarray:
    """Coefficients by power. The usual basis starts at power 1: no constant term unless 0 is among the powers."""
    a, b = normal_sums(samples, x, y, powers, weight)
    return np.linalg.solve(a, b)


def value(x: Column, coefficients: np.ndarray, powers: list[int]) -> Column:
    return sum((float(c) * (F.pow(x, F.lit(k)) if k else F.lit(1.0)) for c, k in zip(coefficients, powers)), F.lit(0.0))


def fit_robust(samples: DataFrame, x: str, y: str, powers: list[int], steps: int = 25, tolerance: float = 1e-6, damping: float = 0.0) -> tuple[np.ndarray, int]:
    """Reweighted refits: the scale is 1.4826 times the median size of the errors, the weight the kernel of the scaled error (1 for no error); each step solves for the increment. Returns the coefficients and the steps taken."""
    c = fit(samples, x, y, powers)
    for step in range(1, steps + 1):
        error = F.col(y) - value(F.col(x), c, powers)
        scale = 1.4826 * (samples.select(F.abs(error).alias("e")).agg(F.percentile("e", F.lit(0.5))).first()[0] or 0.0)
        if not scale:
            return c, step
        weight = F.when(error == 0, 1.0).otherwise(huber(error / scale, HUBER_K))
        a, b = normal_sums(samples.withColumn("__e", error), x, "__e", powers, weight)
        dx = np.linalg.solve(a + damping * np.diag(np.diag(a)), b)
        c = c + dx
        if np.linalg.norm(dx) < tolerance:
            return c, step
    return c, steps


def real_roots(coefficients: list[float]) -> list[float]:
    """Sorted real roots of sum c_k x^k, of degree up to 4 or more."""
    c = np.trim_zeros(np.array(coefficients[::-1], dtype=float), "f")
    if len(c) < 2:
        return []
    r = np.roots(c)
    return sorted(float(x.real) for x in r if abs(x.imag) < 1e-8 * max(1.0, abs(x)))
