"""Spatial poses in numpy: rotations, composition, cameras and their Jacobians; row-wise over arrays.

Rotations have no closed Column form that stays small, so these run inside Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def skew(v: np.ndarray) -> np.ndarray:
    z = np.zeros(v.shape[:-1])
    x, y, w = v[..., 0], v[..., 1], v[..., 2]
    return np.stack([np.stack([z, -w, y], -1), np.stack([w, z, -x], -1), np.stack([-y, x, z], -1)], -2)


def axis_angle_to_matrix(a: np.ndarray) -> np.ndarray:
    """Rodrigues' formula; small angles by its series."""
    t2 = (a * a).sum(-1)[..., None, None]
    t = np.sqrt(t2)
    small = t < 1e-6
    safe = np.where(small, 1.0, t)
    s = np.where(small, 1 - t2 / 6, np.sin(safe) / safe)
    c = np.where(small, 0.5 - t2 / 24, (1 - np.cos(safe)) / (safe * safe))
    k = skew(a)
    return np.eye(3) + s * k + c * (k @ k)


def matrix_to_quaternion(r: np.ndarray) -> np.ndarray:
    """(x, y, z, w) with w >= 0, by the largest of the four components."""
    m = r.reshape(-1, 3, 3)
    tr = m[:, 0, 0] + m[:, 1, 1] + m[:, 2, 2]
    q4 = np.stack([1 + 2 * m[:, 0, 0] - tr, 1 + 2 * m[:, 1, 1] - tr, 1 + 2 * m[:, 2, 2] - tr, 1 + tr], -1)
    big = q4.argmax(-1)
    out = np.empty((len(m), 4))
    off = {(0, 1): m[:, 1, 0] + m[:, 0, 1], (0, 2): m[:, 2, 0] + m[:, 0, 2], (1, 2): m[:, 2, 1] + m[:, 1, 2], (0, 3): m[:, 2, 1] - m[:, 1, 2], (1, 3): m[:, 0, 2] - m[:, 2, 0], (2, 3): m[:, 1, 0] - m[:, 0, 1]}
    for b in range(4):
        at = big == b
        top = np.sqrt(np.maximum(q4[at, b], 1e-300))
        for i in range(4):
            out[at, i] = top / 2 if i == b else off[min(i, b), max(i, b)][at] / (2 * top)
    out *= np.where(out[:, 3:] < 0, -1.0, 1.0)
    return out.reshape(*r.shape[:-2], 4)


def quaternion_to_axis_angle(q: np.ndarray) -> np.ndarray:
    q = q / np.linalg.norm(q, axis=-1, keepdims=True)
    q = q * np.where(q[..., 3:] < 0, -1.0, 1.0)
    s = np.linalg.norm(q[..., :3], axis=-1, keepdims=True)
    angle = 2 * np.arctan2(s, q[..., 3:])
    return q[..., :3] * np.where(s < 1e-9, 2.0, angle / np.where(s < 1e-9, 1.0, s))


def axis_angle_to_quaternion(a: np.ndarray) -> np.ndarray:
    t = np.linalg.norm(a, axis=-1, keepdims=True)
    half = np.where(t < 1e-9, 0.5, np.sin(t / 2) / np.where(t < 1e-9, 1.0, t))
    return np.concatenate((a * half, np.cos(t / 2)), -1)


def matrix_to_axis_angle(r: np.ndarray) -> np.ndarray:
    return quaternion_to_axis_angle(matrix_to_quaternion(r))


def rpy_to_matrix(rpy: np.ndarray) -> np.ndarray:
    """Rz(yaw) Ry(pitch) Rx(roll)."""
    (cr, cp, cy), (sr, sp, sy) = np.cos(np.moveaxis(rpy, -1, 0)), np.sin(np.moveaxis(rpy, -1, 0))
    return np.stack([np.stack([cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], -1), np.stack([sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], -1), np.stack([-sp, cp * sr, cp * cr], -1)], -2)


def matrix_to_rpy(r: np.ndarray) -> np.ndarray:
    return np.stack([np.arctan2(r[..., 2, 1], r[..., 2, 2]), np.arctan2(-r[..., 2, 0], np.hypot(r[..., 2, 1], r[..., 2, 2])), np.arctan2(r[..., 1, 0], r[..., 0, 0])], -1)


def rpy_to_axis_angle(rpy: np.ndarray) -> np.ndarray:
    return matrix_to_axis_angle(rpy_to_matrix(rpy))


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Poses (x, y, z, axis-angle): b, given in the frame of a."""
    ra, rb = axis_angle_to_matrix(a[..., 3:]), axis_angle_to_matrix(b[..., 3:])
    t = a[..., :3] + (ra @ b[..., :3, None])[..., 0]
    return np.concatenate((t, matrix_to_axis_angle(ra @ rb)), -1)


def relative(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """b as it is seen from a."""
    ra, rb = axis_angle_to_matrix(a[..., 3:]), axis_angle_to_matrix(b[..., 3:])
    rt = np.swapaxes(ra, -1, -2)
    return np.concatenate(((rt @ (b[..., :3] - a[..., :3])[..., None])[..., 0], matrix_to_axis_angle(rt @ rb)), -1)


def inverse(a: np.ndarray) -> np.ndarray:
    return relative(a, np.zeros_like(a))


def to_frame(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Points in the frame of poses."""
    return (np.swapaxes(axis_angle_to_matrix(a[..., 3:]), -1, -2) @ (p - a[..., :3])[..., None])[..., 0]


def pose_error(z: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Position difference and log(q_z conj(q_h)) of a measured relative pose."""
    h = relative(a, b)
    rz, rh = axis_angle_to_matrix(z[..., 3:]), axis_angle_to_matrix(h[..., 3:])
    return np.concatenate((z[..., :3] - h[..., :3], matrix_to_axis_angle(rz @ np.swapaxes(rh, -1, -2))), -1)


def camera_from_file(t: np.ndarray, q: np.ndarray, normalize: bool = True) -> np.ndarray:
    """The stored camera of a line with position and quaternion (x, y, z, w): the rotation inverted, c = q^-1 (-t)."""
    q = q / np.linalg.norm(q, axis=-1, keepdims=True) if normalize else q
    a = quaternion_to_axis_angle(q)
    r = axis_angle_to_matrix(a)
    return np.concatenate((-(np.swapaxes(r, -1, -2) @ t[..., None])[..., 0], -a), -1)


def project(camera: np.ndarray, intrinsics: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Pixels (u, v) of points in pinhole cameras with intrinsics fx, fy, cx, cy, k; the radial factor is 1 + k' r²."""
    x = to_frame(camera, p)
    fx, fy, cx, cy, k = np.moveaxis(intrinsics, -1, 0)
    u, v = fx * x[..., 0] / x[..., 2], fy * x[..., 1] / x[..., 2]
    focal = (fx + fy) / 2
    radial = 1 + k / (focal * focal) * (u * u + v * v)
    return np.stack([cx + u * radial, cy + v * radial], -1)


def project_stereo(camera: np.ndarray, intrinsics: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(u_left, v_left, u_right), intrinsics with the baseline last; the radial factor is 1 + k' r."""
    x = to_frame(camera, p)
    fx, fy, cx, cy, k, base = np.moveaxis(intrinsics, -1, 0)
    u, v, w = fx * x[..., 0] / x[..., 2], fy * x[..., 1] / x[..., 2], fx * (x[..., 0] - base) / x[..., 2]
    scale = k / ((fx + fy) / 2)
    left, right = 1 + scale * np.hypot(u, v), 1 + scale * np.hypot(w, v)
    return np.stack([cx + u * left, cy + v * left, cx + w * right], -1)


def epipolar_error(a: np.ndarray, b: np.ndarray, ka: np.ndarray, kb: np.ndarray, pa: np.ndarray, pb: np.ndarray) -> np.ndarray:
    """Distance of pixels pb to the epipolar lines of pixels pa (undistorted)."""
    rel = relative(a, b)
    r = np.swapaxes(axis_angle_to_matrix(rel[..., 3:]), -1, -2)
    e = r @ -skew(rel[..., :3])
    ray = lambda k, p: np.stack([(p[..., 0] - k[..., 2]) / k[..., 0], (p[..., 1] - k[..., 3]) / k[..., 1], np.ones(p.shape[:-1])], -1)
    line = (e @ ray(ka, pa)[..., None])[..., 0]
    x = ray(kb, pb)
    top = (line * x).sum(-1)
    return top / np.sqrt((line[..., 0] / kb[..., 0]) ** 2 + (line[..., 1] / kb[..., 1]) ** 2)


def numeric_jacobian(f: Callable[[np.ndarray], np.ndarray], x: np.ndarray, plus: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, delta: float = 1e-9) -> np.ndarray:
    """Forward differences of f at x along the axes of an update x (+) d."""
    plus = plus or (lambda a, d: a + d)
    base = f(x)
    columns = []
    for i in range(x.shape[-1]):
        d = np.zeros(x.shape[-1])
        d[i] = delta
        columns.append((f(plus(x, d)) - base) / delta)
    return np.stack(columns, -1)


def projection_jacobians(camera: np.ndarray, intrinsics: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of project() by the camera's update (composed on the right) and by the point, analytic."""
    r = axis_angle_to_matrix(camera[..., 3:])
    x = to_frame(camera, p)
    fx, fy, _, _, k = np.moveaxis(intrinsics, -1, 0)
    z = x[..., 2]
    u, v = fx * x[..., 0] / z, fy * x[..., 1] / z
    c = k / ((fx + fy) / 2) ** 2
    r2 = u * u + v * v
    zero = np.zeros_like(z)
    duv = np.stack([np.stack([fx / z, zero, -u / z], -1), np.stack([zero, fy / z, -v / z], -1)], -2)
    radial = np.stack([np.stack([1 + c * (r2 + 2 * u * u), 2 * c * u * v], -1), np.stack([2 * c * u * v, 1 + c * (r2 + 2 * v * v)], -1)], -2)
    by_x = radial @ duv
    by_camera = np.concatenate((-by_x, by_x @ skew(x)), -1)
    return by_camera, by_x @ np.swapaxes(r, -1, -2)


def kabsch(a: np.ndarray, b: np.ndarray, with_scale: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """(R, t, s) with b ~ s R a + t, without reflection."""
    ca, cb = a.mean(0), b.mean(0)
    u, s, vt = np.linalg.svd((a - ca).T @ (b - cb))
    d = np.array([1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
    r = vt.T @ np.diag(d) @ u.T
    spread = ((a - ca) ** 2).sum()
    scale = float((s * d).sum() / spread) if with_scale and spread else 1.0
    return r, cb - scale * r @ ca, scale


def average_structure(observations: list[np.ndarray], steps: int = 3) -> np.ndarray:
    """The mean shape of observations of the same points, each aligned to it in turn."""
    mean = observations[0]
    for _ in range(steps):
        moved = []
        for o in observations:
            r, t, s = kabsch(o, mean, True)
            moved.append(s * o @ r.T + t)
        mean = np.mean(moved, axis=0)
    return mean


def covariance_to_axis_angle(sigma: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Covariance of a quaternion (4 x 4) as that of its axis-angle."""
    j = numeric_jacobian(quaternion_to_axis_angle, q, delta=1e-7)
    return j @ sigma @ j.T


def covariance_to_rpy(sigma: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Covariance of an axis-angle (3 x 3) as that of roll, pitch, yaw."""
    j = numeric_jacobian(lambda x: matrix_to_rpy(axis_angle_to_matrix(x)), a, delta=1e-7)
    return j @ sigma @ j.T


def undistort_newton(u: np.ndarray, k1: float, k2: float, steps: int = 20) -> np.ndarray:
    """Radii r with r (1 + k1 r² + k2 r⁴) = u."""
    r = np.array(u, dtype=float)
    for _ in range(steps):
        f = r * (1 + k1 * r**2 + k2 * r**4) - u
        r = r - f / (1 + 3 * k1 * r**2 + 5 * k2 * r**4)
    return r


def fit_inverse_distortion(k1: float, k2: float, most: float, n: int = 200) -> np.ndarray:
    """(k1', k2', k3') of the polynomial inverse, by least squares on a grid of radii."""
    r = np.linspace(most / n, most, n)
    d = r * (1 + k1 * r**2 + k2 * r**4)
    a = np.stack([d**3, d**5, d**7], -1)
    return np.linalg.lstsq(a, r - d, rcond=None)[0]


def rotation_magnitude(pose: np.ndarray) -> np.ndarray:
    return np.linalg.norm(pose[..., 3:], axis=-1)


def view_direction(pose: np.ndarray, axis: int = 2) -> np.ndarray:
    """The direction in which a pose looks."""
    return axis_angle_to_matrix(pose[..., 3:])[..., :, axis]
