"""Homogeneous transforms and quaternions in numpy (w first), for kernels and UDFs."""

from __future__ import annotations

import numpy as np

TINY = np.finfo(float).eps * 4


def identity() -> np.ndarray:
    return np.eye(4)


def unit(v: np.ndarray, axis: int = -1) -> np.ndarray:
    v = np.asarray(v, float)
    n = np.linalg.norm(v, axis=axis, keepdims=True)
    return v / np.where(n > 0, n, 1.0)


def translation(t: np.ndarray) -> np.ndarray:
    m = np.eye(4)
    m[:3, 3] = t
    return m


def about(m3: np.ndarray, point: np.ndarray | None) -> np.ndarray:
    """A linear map as a transform that leaves the point in place."""
    m = np.eye(4)
    m[:3, :3] = m3
    if point is not None:
        p = np.asarray(point, float)[:3]
        m[:3, 3] = p - m3 @ p
    return m


def reflection(point: np.ndarray, normal: np.ndarray) -> np.ndarray:
    n = unit(normal[:3])
    return about(np.eye(3) - 2 * np.outer(n, n), point)


def rotation(angle: float, axis: np.ndarray, point: np.ndarray | None = None) -> np.ndarray:
    x, y, z = unit(axis[:3])
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return about(np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * (k @ k), point)


def scaling(factor: float, origin: np.ndarray | None = None, axis: np.ndarray | None = None) -> np.ndarray:
    if axis is None:
        return about(factor * np.eye(3), origin)
    d = unit(axis[:3])
    return about(np.eye(3) + (factor - 1) * np.outer(d, d), origin)


def shear(angle: float, direction: np.ndarray, point: np.ndarray, normal: np.ndarray) -> np.ndarray:
    d, n = unit(direction[:3]), unit(normal[:3])
    if abs(d @ n) > 1e-6:
        raise ValueError("direction and normal are not orthogonal")
    return about(np.eye(3) + np.tan(angle) * np.outer(d, n), point)


def projection(point: np.ndarray, normal: np.ndarray, direction: np.ndarray | None = None, eye: np.ndarray | None = None) -> np.ndarray:
    """Onto a plane: along the normal, along a direction, or from an eye point."""
    p, n = np.asarray(point, float)[:3], unit(normal[:3])
    m = np.eye(4)
    if eye is not None:
        e = np.asarray(eye, float)[:3]
        m[:3, :3] = (e - p) @ n * np.eye(3) - np.outer(e, n)
        m[:3, 3] = (p @ n) * e
        m[3, :3], m[3, 3] = -n, e @ n
        return m
    d = n if direction is None else np.asarray(direction, float)[:3]
    return about(np.eye(3) - np.outer(d, n) / (d @ n), p)


def clipping(left: float, right: float, bottom: float, top: float, near: float, far: float, perspective: bool = False) -> np.ndarray:
    if left >= right or bottom >= top or near >= far:
        raise ValueError("the box is empty")
    if perspective:
        if near <= TINY:
            raise ValueError("near must be positive")
        return np.array([[2 * near / (left - right), 0, (right + left) / (right - left), 0], [0, 2 * near / (bottom - top), (top + bottom) / (top - bottom), 0], [0, 0, (far + near) / (near - far), 2 * near * far / (far - near)], [0, 0, -1.0, 0]])
    return np.array([[2 / (right - left), 0, 0, (right + left) / (left - right)], [0, 2 / (top - bottom), 0, (top + bottom) / (bottom - top)], [0, 0, 2 / (far - near), (far + near) / (near - far)], [0, 0, 0, 1.0]])


def orthogonalization(lengths: np.ndarray, degrees: np.ndarray) -> np.ndarray:
    """Crystal cell to Cartesian coordinates."""
    a, b, c = lengths
    al, be, ga = np.deg2rad(degrees)
    co = (np.cos(al) * np.cos(be) - np.cos(ga)) / (np.sin(al) * np.sin(be))
    m = np.eye(4)
    m[:3, :3] = [[a * np.sin(be) * np.sqrt(1 - co * co), 0, 0], [-a * np.sin(be) * co, b * np.sin(al), 0], [a * np.cos(be), b * np.cos(al), c]]
    return m


def translation_of(m: np.ndarray) -> np.ndarray:
    return np.array(m)[:3, 3].copy()


def rotation_of(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(angle, axis, a fixed point) of a rotation."""
    r = np.asarray(m, float)[:3, :3]
    w, v = np.linalg.eig(r.T)
    axis = unit(v[:, np.argmin(abs(w - 1))].real)
    k = np.argmax(np.abs(axis))
    i, j = [(1, 2), (2, 0), (0, 1)][k]
    cos = (np.trace(r) - 1) / 2
    sin = (r[j, i] - r[i, j]) / (2 * axis[k])
    point = np.linalg.pinv(np.eye(3) - r) @ np.asarray(m, float)[:3, 3]
    return float(np.arctan2(sin, cos)), axis, point


def reflection_of(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(point, normal) of a reflection."""
    r = np.asarray(m, float)
    w, v = np.linalg.eig(r[:3, :3])
    n = unit(v[:, np.argmin(abs(w + 1))].real)
    return r[:3, 3] / 2, n


def scaling_of(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray | None]:
    """(factor, origin, axis or None for a uniform one)."""
    a = np.asarray(m, float)
    s = a[:3, :3]
    factor = np.trace(s) - 2
    w, v = np.linalg.eig(s)
    hit = np.flatnonzero(abs(w - factor) < 1e-8)
    if len(hit) == 1 and abs(factor - 1) > 1e-8:
        axis = unit(v[:, hit[0]].real)
    else:
        factor, axis = np.trace(s) / 3, None
    return float(factor), np.linalg.pinv(np.eye(3) - s) @ a[:3, 3], axis


def shear_of(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(angle, direction, point, normal) of a shear."""
    s = np.asarray(m, float)[:3, :3] - np.eye(3)
    u, w, vt = np.linalg.svd(s)
    d, n = u[:, 0], vt[0]
    return float(np.arctan(w[0])), d, np.linalg.pinv(-s) @ np.asarray(m, float)[:3, 3], n


def projection_of(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(point, normal) of a parallel projection."""
    p = np.asarray(m, float)
    u, w, vt = np.linalg.svd(np.eye(3) - p[:3, :3])
    return p[:3, 3], vt[0]


def decompose(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[float, float, float], np.ndarray]:
    """(scale, shears xy xz yz, angles about the fixed x, y, z axes, translation) of an affine transform."""
    a = np.asarray(m, float)
    q, r = np.linalg.qr(a[:3, :3])
    sign = np.sign(np.diag(r))
    sign[sign == 0] = 1
    q, r = q * sign, (r.T * sign).T
    if np.linalg.det(q) < 0:
        q, r = -q, -r
    scale = np.diag(r).copy()
    s = r / scale[:, None]
    return scale, np.array([s[0, 1], s[0, 2], s[1, 2]]), euler_of(q, "sxyz"), a[:3, 3].copy()


def compose(scale: np.ndarray | None = None, shears: np.ndarray | None = None, angles: tuple[float, float, float] | None = None, shift: np.ndarray | None = None) -> np.ndarray:
    m = np.eye(4)
    r = np.eye(3)
    if shears is not None:
        r[0, 1], r[0, 2], r[1, 2] = shears
    if scale is not None:
        r = np.diag(scale) @ r
    m[:3, :3] = (euler_matrix(*angles)[:3, :3] if angles is not None else np.eye(3)) @ r
    if shift is not None:
        m[:3, 3] = shift
    return m


_NEXT = (1, 2, 0, 1)


def _sequence(axes: str) -> tuple[int, int, int, bool]:
    """(first, second, third axis, turning frame) of a name such as sxyz or rzyz."""
    if len(axes) != 4 or axes[0] not in "sr" or any(c not in "xyz" for c in axes[1:]) or axes[1] == axes[2] or axes[2] == axes[3]:
        raise ValueError(f"unknown axes {axes!r}")
    return "xyz".index(axes[1]), "xyz".index(axes[2]), "xyz".index(axes[3]), axes[0] == "r"


def _turn(k: int, a: float) -> np.ndarray:
    return rotation(a, np.eye(3)[k])[:3, :3]


def euler_matrix(a: float, b: float, c: float, axes: str = "sxyz") -> np.ndarray:
    """Rotation by three turns: about fixed axes one after another (s), or about the turning frame's own (r)."""
    i, j, k, turning = _sequence(axes)
    r = _turn(i, a) @ _turn(j, b) @ _turn(k, c) if turning else _turn(k, c) @ _turn(j, b) @ _turn(i, a)
    return about(r, None)


def euler_of(m: np.ndarray, axes: str = "sxyz") -> tuple[float, float, float]:
    """Angles of euler_matrix; where two are tied the last one of the turning order is 0."""
    i, j, k, turning = _sequence(axes)
    r = np.asarray(m, float)[:3, :3]
    if not turning:  # fixed axes are the turning ones in reverse
        i, k = k, i
    if i == k:
        o = 3 - i - j
        sign = 1.0 if _NEXT[i] == j else -1.0
        s = np.hypot(r[i, j], r[i, o])
        if s > TINY:
            out = np.arctan2(r[j, i], -sign * r[o, i]), np.arctan2(s, r[i, i]), np.arctan2(r[i, j], sign * r[i, o])
        else:
            out = np.arctan2(sign * r[o, j], r[j, j]), np.arctan2(s, r[i, i]), 0.0
    else:
        sign = 1.0 if _NEXT[i] == j else -1.0
        c = np.hypot(r[i, i], r[i, j])
        if c > TINY:
            out = np.arctan2(-sign * r[j, k], r[k, k]), np.arctan2(sign * r[i, k], c), np.arctan2(-sign * r[i, j], r[i, i])
        else:
            out = np.arctan2(sign * r[k, j], r[j, j]), np.arctan2(sign * r[i, k], c), 0.0
    a, b, c = (float(x) for x in out)
    return (a, b, c) if turning else (c, b, a)


def quaternion_multiply(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    a, b = np.asarray(p, float), np.asarray(q, float)
    return np.concatenate([[a[0] * b[0] - a[1:] @ b[1:]], a[0] * b[1:] + b[0] * a[1:] + np.cross(a[1:], b[1:])])


def quaternion_conjugate(q: np.ndarray) -> np.ndarray:
    return np.asarray(q, float) * np.array([1, -1, -1, -1])


def quaternion_inverse(q: np.ndarray) -> np.ndarray:
    return quaternion_conjugate(q) / (np.asarray(q, float) @ np.asarray(q, float))


def quaternion_about(angle: float, axis: np.ndarray) -> np.ndarray:
    return np.concatenate([[np.cos(angle / 2)], np.sin(angle / 2) * unit(axis)])


def quaternion_matrix(q: np.ndarray) -> np.ndarray:
    w, x, y, z = unit(q)
    return about(np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]), None)


def quaternion_of(m: np.ndarray) -> np.ndarray:
    """The unit quaternion with w >= 0 of a rotation matrix: the top eigenvector of a symmetric 4 x 4 matrix."""
    r = np.asarray(m, float)[:3, :3]
    k = np.array([[np.trace(r), r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]], [0, r[0, 0] - r[1, 1] - r[2, 2], r[0, 1] + r[1, 0], r[0, 2] + r[2, 0]], [0, 0, r[1, 1] - r[0, 0] - r[2, 2], r[1, 2] + r[2, 1]], [0, 0, 0, r[2, 2] - r[0, 0] - r[1, 1]]])
    q = np.linalg.eigh(k + np.triu(k, 1).T)[1][:, -1]
    return q if q[0] >= 0 else -q


def quaternion_from_euler(a: float, b: float, c: float, axes: str = "sxyz") -> np.ndarray:
    i, j, k, turning = _sequence(axes)
    qa, qb, qc = (quaternion_about(t, np.eye(3)[x]) for t, x in ((a, i), (b, j), (c, k)))
    return quaternion_multiply(qa, quaternion_multiply(qb, qc)) if turning else quaternion_multiply(qc, quaternion_multiply(qb, qa))


def euler_from_quaternion(q: np.ndarray, axes: str = "sxyz") -> tuple[float, float, float]:
    return euler_of(quaternion_matrix(q), axes)


def slerp(p: np.ndarray, q: np.ndarray, share: float, shortest: bool = True) -> np.ndarray:
    a, b = unit(p), unit(q)
    d = float(a @ b)
    if shortest and d < 0:
        b, d = -b, -d
    t = np.arccos(np.clip(d, -1, 1))
    if t < TINY:
        return a
    return (np.sin((1 - share) * t) * a + np.sin(share * t) * b) / np.sin(t)


def random_quaternion(draw: np.random.Generator) -> np.ndarray:
    return unit(draw.standard_normal(4))


def random_rotation(draw: np.random.Generator) -> np.ndarray:
    return quaternion_matrix(random_quaternion(draw))


def superimpose(a: np.ndarray, b: np.ndarray, scale: bool = False) -> np.ndarray:
    """Least-squares rotation (and scale) with translation of the points a (3 x n) onto b."""
    ca, cb = a.mean(1, keepdims=True), b.mean(1, keepdims=True)
    u, s, vt = np.linalg.svd((b - cb) @ (a - ca).T)
    flip = np.diag([1, 1, np.sign(np.linalg.det(u @ vt))])
    r = u @ flip @ vt
    if scale:
        r = r * (s * np.diag(flip)).sum() / ((a - ca) ** 2).sum()
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = r, (cb - r @ ca).ravel()
    return m


def affine_from_points(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least-squares affine transform of the points a (d x n) onto b."""
    d = len(a)
    x = np.linalg.lstsq(np.vstack([a, np.ones(a.shape[1])]).T, b.T, rcond=None)[0].T
    m = np.eye(d + 1)
    m[:d] = x
    return m


def angle_between(a: np.ndarray, b: np.ndarray, directed: bool = True) -> float:
    d = float(unit(a) @ unit(b))
    return float(np.arccos(np.clip(d if directed else abs(d), -1, 1)))


def concatenate(*ms: np.ndarray) -> np.ndarray:
    out = np.eye(4)
    for m in ms:
        out = out @ m
    return out


def same_transform(a: np.ndarray, b: np.ndarray) -> bool:
    return bool(np.allclose(a / a[3, 3], b / b[3, 3]))


def same_quaternion(a: np.ndarray, b: np.ndarray) -> bool:
    return bool(np.allclose(a, b) or np.allclose(a, -np.asarray(b)))


class Arcball:
    """A virtual trackball: drags on a disc as rotations."""

    def __init__(self, centre: tuple[float, float] = (0.0, 0.0), radius: float = 1.0, axes: np.ndarray | None = None):
        self.centre, self.radius, self.axes = np.asarray(centre, float), radius, axes
        self.now = np.array([1.0, 0, 0, 0])
        self._start, self._base = np.array([0.0, 0, 1]), self.now

    def on_sphere(self, point: tuple[float, float]) -> np.ndarray:
        v = (np.asarray(point, float) - self.centre) / self.radius * [1, -1]
        n = v @ v
        p = np.array([*(v / np.sqrt(n)), 0.0]) if n > 1 else np.array([*v, np.sqrt(1 - n)])
        return p if self.axes is None else self.constrain(p, self.nearest(p))

    @staticmethod
    def constrain(p: np.ndarray, axis: np.ndarray) -> np.ndarray:
        v = p - axis * (p @ axis)
        n = np.linalg.norm(v)
        if n > TINY:
            return -v / n if v[2] < 0 else v / n
        return np.array([1.0, 0, 0]) if axis[2] == 1 else unit(np.array([-axis[1], axis[0], 0.0]))

    def nearest(self, p: np.ndarray) -> np.ndarray:
        return max(self.axes, key=lambda a: float(self.constrain(p, a) @ p))

    def down(self, point: tuple[float, float]) -> None:
        self._start, self._base = self.on_sphere(point), self.now

    def drag(self, point: tuple[float, float]) -> None:
        end = self.on_sphere(point)
        turn = np.concatenate([[self._start @ end], np.cross(self._start, end)])
        self.now = quaternion_multiply(turn, self._base) if turn[1:] @ turn[1:] > TINY else self._base

    def matrix(self) -> np.ndarray:
        return quaternion_matrix(self.now)
