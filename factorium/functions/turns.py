"""Spatial rotations as Column expressions, quaternions as (x, y, z, w)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[Column]


def rpy_quaternion(roll: Column, pitch: Column, yaw: Column) -> list[Column]:
    """The turn Rz(yaw) Ry(pitch) Rx(roll)."""
    (cr, sr), (cp, sp), (cy, sy) = ((F.cos(a / 2), F.sin(a / 2)) for a in (roll, pitch, yaw))
    return [sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy, cr * cp * cy + sr * sp * sy]


def inverse(q: Vector) -> list[Column]:
    return [-q[0], -q[1], -q[2], q[3]]


def axis_angle(q: Vector) -> list[Column]:
    """The shorter turn, its length the angle; q of any length but zero."""
    s = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2])
    scale = F.when(s > 0, 2 * F.atan2(s, F.abs(q[3])) / s * F.when(q[3] < 0, -1.0).otherwise(1.0)).otherwise(0.0)
    return [scale * q[0], scale * q[1], scale * q[2]]


def cross(a: Vector, b: Vector) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def turned(q: Vector, v: Vector) -> list[Column]:
    """v after the turn; q of any length but zero."""
    once = cross(q, v)
    twice = cross(q, once)
    f = F.lit(2.0) / (q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    return [v[i] + f * (q[3] * once[i] + twice[i]) for i in range(3)]
