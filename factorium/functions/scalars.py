"""Scalar functions of the measurement models: robust weights, error function, polynomials, cameras, triangulation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Our assumption of the Huber kernel's bend.
HUBER_K = 1.345
#: The coefficients of Abramowitz and Stegun 7.1.26.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def huber(x: Column, k: float = HUBER_K) -> Column:
    """The weight of a scaled residual: 1 up to k, then k over its size."""
    return F.when(F.abs(x) <= k, 1.0).otherwise(k / F.abs(x))


def cauchy(x: Column, k: float = 1.0) -> Column:
    return 1.0 / (1.0 + (x / k) * (x / k))


def tukey(x: Column, k: float = 4.685) -> Column:
    return F.when(F.abs(x) <= k, F.pow(1.0 - (x / k) * (x / k), F.lit(2.0))).otherwise(0.0)


def robust_weight_by_norm(norm: Column, scale: float) -> Column:
    return huber(norm / scale)


def robust_weight_by_chi2(chi2: Column, scale: float) -> Column:
    """The kernel of chi-square itself, not of its root."""
    return huber(chi2 / scale)


def erf(x: Column) -> Column:
    t = 1.0 / (1.0 + ERF_P * F.abs(x))
    poly: Column = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def gaussian_cdf(t: Column, mean: Column, variance: Column) -> Column:
    return (1.0 + erf((t - mean) / F.sqrt(2.0 * variance))) / 2.0


def within_probability(t: Column, mean: Column, variance: Column) -> Column:
    """The probability of lying in [-t, t]."""
    return gaussian_cdf(t, mean, variance) - gaussian_cdf(-t, mean, variance)


def det2(m: Sequence[Column]) -> Column:
    return m[0] * m[3] - m[1] * m[2]


def det3(m: Sequence[Column]) -> Column:
    a, b, c, d, e, f, g, h, i = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


#: What a gain that is not a number counts as.
NO_GAIN = -1e100


def information_gain(det_sum: Column, det_edge: Column) -> Column:
    """Half the log of det(edge + distance) over det(edge)."""
    gain = 0.5 * F.log(det_sum / det_edge)
    return F.when(gain.isNull() | F.isnan(gain), NO_GAIN).otherwise(gain)


def polynomial(x: Column, coefficients: Sequence[Column | float]) -> Column:
    """Value of sum c_k x^k, by Horner."""
    out: Column = F.lit(0.0)
    for c in reversed(list(coefficients)):
        out = out * x + (c if isinstance(c, Column) else F.lit(float(c)))
    return out


def derivative(coefficients: Sequence[Column | float], order: int = 1) -> list[Column | float]:
    """Coefficients of the derivative of that order."""
    out = list(coefficients)
    for _ in range(order):
        out = [c * k for k, c in enumerate(out)][1:] or [0.0]
    return out


def quadratic_roots(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """(number, smaller, larger) of the real roots of a x² + b x + c; with a = 0 the linear one; null where there is none."""
    d = b * b - 4.0 * a * c
    q = F.sqrt(F.greatest(d, F.lit(0.0)))
    low, high = (-b - q) / (2.0 * a), (-b + q) / (2.0 * a)
    linear = F.when((a == 0) & (b != 0), -c / b)
    real = (a != 0) & (d >= 0)
    n = F.when(a == 0, F.when(b != 0, 1).otherwise(0)).when(d > 0, 2).when(d == 0, 1).otherwise(0)
    return n, F.coalesce(linear, F.when(real, F.least(low, high))), F.when(real & (d > 0), F.greatest(low, high))


def project_mono(x: Column, y: Column, z: Column, fx: Column, fy: Column, cx: Column, cy: Column, k: Column) -> tuple[Column, Column]:
    """Pinhole with radial 1 + k' r²; k' is k over the square of the mean focal length, r in pixels."""
    u, v = fx * x / z, fy * y / z
    focal = (fx + fy) / 2.0
    radial = 1.0 + k / (focal * focal) * (u * u + v * v)
    return cx + u * radial, cy + v * radial


def project_stereo(x: Column, y: Column, z: Column, fx: Column, fy: Column, cx: Column, cy: Column, k: Column, baseline: Column) -> tuple[Column, Column, Column]:
    """Left pixel and right column; radial 1 + k' r, of the radius itself."""
    u, v, w = fx * x / z, fy * y / z, fx * (x - baseline) / z
    focal = (fx + fy) / 2.0
    scale = k / focal
    left, right = 1.0 + scale * F.sqrt(u * u + v * v), 1.0 + scale * F.sqrt(w * w + v * v)
    return cx + u * left, cy + v * left, cx + w * right


def undistort(u: Column, v: Column, cx: Column, cy: Column, k: Column, steps: int = 4) -> tuple[Column, Column]:
    """Fixed-point inverse of the radial factor 1 + k r²."""
    du, dv = u - cx, v - cy
    x, y = du, dv
    for _ in range(steps):
        radial = 1.0 + k * (x * x + y * y)
        x, y = du / radial, dv / radial
    return cx + x, cy + y


def distort(u: Column, v: Column, cx: Column, cy: Column, k1: Column, k2: Column) -> tuple[Column, Column]:
    du, dv = u - cx, v - cy
    r2 = du * du + dv * dv
    radial = 1.0 + k1 * r2 + k2 * r2 * r2
    return cx + du * radial, cy + dv * radial


def triangulate_midpoint(p: Sequence[Column], d: Sequence[Column], q: Sequence[Column], e: Sequence[Column]) -> list[Column]:
    """The middle of the shortest segment between the rays p + s d and q + t e; null if they are parallel."""
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    w = [a - b for a, b in zip(p, q)]
    dd, de, ee, dw, ew = dot(d, d), dot(d, e), dot(e, e), dot(d, w), dot(e, w)
    bottom = F.nullif(dd * ee - de * de, F.lit(0.0))
    s, t = (de * ew - ee * dw) / bottom, (dd * ew - de * dw) / bottom
    return [(a + s * b + c + t * f) / 2.0 for a, b, c, f in zip(p, d, q, e)]


def triangulate_ray_plane(p: Sequence[Column], d: Sequence[Column], n: Sequence[Column], h: Column) -> list[Column]:
    """Where the ray p + s d meets the plane n.x = h; null if it doesn't."""
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    s = (h - dot(n, p)) / F.nullif(dot(n, d), F.lit(0.0))
    return [a + s * b for a, b in zip(p, d)]


def triangulate_disparity(u: Column, v: Column, disparity: Column, f: Column, cx: Column, cy: Column, baseline: Column) -> list[Column]:
    z = f * baseline / F.nullif(disparity, F.lit(0.0))
    return [(u - cx) * z / f, (v - cy) * z / f, z]


def homography(h: Sequence[Column | float], x: Column, y: Column) -> tuple[Column, Column]:
    h = [c if isinstance(c, Column) else F.lit(float(c)) for c in h]
    w = h[6] * x + h[7] * y + h[8]
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def homography_transfer(h: Sequence[Column | float], x: Column, y: Column, u: Column, v: Column) -> Column:
    """Squared transfer error of (x, y) -> (u, v)."""
    a, b = homography(h, x, y)
    return (a - u) * (a - u) + (b - v) * (b - v)


def homography_symmetric(h: Sequence[float], back: Sequence[float], x: Column, y: Column, u: Column, v: Column) -> Column:
    return homography_transfer(h, x, y, u, v) + homography_transfer(back, u, v, x, y)


def homography_sampson(h: Sequence[float], x: Column, y: Column, u: Column, v: Column) -> Column:
    """First-order geometric error: e' (J J')^-1 e of the two algebraic equations."""
    w = h[6] * x + h[7] * y + h[8]
    e1, e2 = -(h[3] * x + h[4] * y + h[5]) + v * w, (h[0] * x + h[1] * y + h[2]) - u * w
    j1 = [-h[3] + v * h[6], -h[4] + v * h[7], F.lit(0.0), w]
    j2 = [h[0] - u * h[6], h[1] - u * h[7], -w, F.lit(0.0)]
    dot = lambda a, b: sum((p * q for p, q in zip(a[1:], b[1:])), a[0] * b[0])
    a, b, c = dot(j1, j1), dot(j1, j2), dot(j2, j2)
    return (c * e1 * e1 - 2.0 * b * e1 * e2 + a * e2 * e2) / (a * c - b * b)


def ceil_log2(n: Column) -> Column:
    """The least k with 2^k >= n, for whole n >= 1."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n.cast("long") - 1))).cast("int")


RADIANS = math.pi / 180.0


def rpy_matrix(roll: Column, pitch: Column, yaw: Column) -> list[Column]:
    """Rotation Rz(yaw) Ry(pitch) Rx(roll), row by row."""
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    return [cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr, sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr, -sp, cp * sr, cp * cr]
