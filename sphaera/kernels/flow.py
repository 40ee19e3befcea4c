"""Dense flow between two images by polynomial expansion over a pyramid.

Around every pixel an image is fitted by a quadratic polynomial under Gaussian weights.  If a second image is the first one
moved by d, its quadratic part is the same and its linear part differs by twice the quadratic part times d; d is solved for
over a window, and again with the second image's coefficients taken at the place that the last d points to.
"""

from __future__ import annotations

import numpy as np

from sphaera.kernels.images import gaussian_blur


def _correlate(img: np.ndarray, w: np.ndarray, axis: int) -> np.ndarray:
    r = len(w) // 2
    pad = [(r, r) if a == axis else (0, 0) for a in range(2)]
    return np.apply_along_axis(np.convolve, axis, np.pad(img, pad, mode="edge"), w[::-1], mode="valid")


def expansion(img: np.ndarray, size: int = 7, sigma: float = 1.5) -> tuple[np.ndarray, np.ndarray]:
    """(linear part: rows x columns x 2, quadratic part: rows x columns x 2 x 2) at every pixel, in (x, y)."""
    x = np.arange(-(size // 2), size // 2 + 1).astype(float)
    g = np.exp(-(x**2) / (2 * sigma**2))
    g /= g.sum()
    moment = [_correlate(img, g * x**k, 0) for k in range(3)]  # along y
    p = {(i, j): _correlate(moment[j], g * x**i, 1) for i, j in ((0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1))}
    m2, m4 = (g * x**2).sum(), (g * x**4).sum()
    # the normal equations of 1, x, y, x^2, y^2, xy: odd moments vanish, so all but 1, x^2, y^2 stand alone
    solve = np.linalg.inv(np.array([[1, m2, m2], [m2, m4, m2 * m2], [m2, m2 * m2, m4]]))
    even = np.stack([p[0, 0], p[2, 0], p[0, 2]], -1) @ solve.T
    quadratic = np.empty((*img.shape, 2, 2))
    quadratic[..., 0, 0], quadratic[..., 1, 1] = even[..., 1], even[..., 2]
    quadratic[..., 0, 1] = quadratic[..., 1, 0] = p[1, 1] / (m2 * m2) / 2
    return np.stack([p[1, 0], p[0, 1]], -1) / m2, quadratic


def sample(values: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values at (y, x), the border going on beyond it."""
    h, w = values.shape[:2]
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.minimum(y.astype(int), max(h - 2, 0)), np.minimum(x.astype(int), max(w - 2, 0))
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    extra = (slice(None), slice(None), *(None,) * (values.ndim - 2))
    fy, fx = (y - y0)[extra], (x - x0)[extra]
    return (values[y0, x0] * (1 - fx) + values[y0, x1] * fx) * (1 - fy) + (values[y1, x0] * (1 - fx) + values[y1, x1] * fx) * fy


def _resize(values: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    h, w = values.shape[:2]
    y = (np.arange(shape[0]) + 0.5) * h / shape[0] - 0.5
    x = (np.arange(shape[1]) + 0.5) * w / shape[1] - 0.5
    return sample(values, *np.meshgrid(y, x, indexing="ij"))


def _window(values: np.ndarray, size: int) -> np.ndarray:
    """Means over size x size pixels around each."""
    box = np.ones(size) / size
    return np.stack([_correlate(_correlate(v, box, 0), box, 1) for v in np.moveaxis(values, -1, 0)], -1)


def polynomial_flow(first: np.ndarray, second: np.ndarray, scale: float = 0.4, levels: int = 5, window: int = 21, rounds: int = 10, size: int = 7, sigma: float = 1.5, least: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Flow (x, y) from first to second; levels of the pyramid that would be smaller than `least` pixels are left out."""
    flow, n = None, 0
    while n + 1 < levels and min(first.shape) * scale ** (n + 1) >= least:
        n += 1
    for level in range(n, -1, -1):
        share = scale**level
        shape = tuple(max(1, int(round(k * share))) for k in first.shape)
        a, b = ((_resize(gaussian_blur(z, max((1 / share - 1) / 2, 1e-3)), shape) if level else z) for z in (first.astype(float), second.astype(float)))
        flow = np.zeros((*shape, 2)) if flow is None else _resize(flow, shape) * (np.array(shape[::-1]) / np.array(flow.shape[1::-1]))
        (b1, q1), (b2, q2) = expansion(a, size, sigma), expansion(b, size, sigma)
        y, x = np.mgrid[0 : shape[0], 0 : shape[1]].astype(float)
        for _ in range(rounds):
            at = (y + flow[..., 1], x + flow[..., 0])
            q = (q1 + sample(q2, *at)) / 2
            change = (b1 - sample(b2, *at)) / 2 + (q @ flow[..., None])[..., 0]
            normal, right = np.swapaxes(q, -1, -2) @ q, (np.swapaxes(q, -1, -2) @ change[..., None])[..., 0]
            m = _window(np.concatenate([normal.reshape(*shape, 4), right], -1), window)
            m00, m01, m11 = m[..., 0], m[..., 1], m[..., 3]
            det = m00 * m11 - m01 * m01
            tiny = 1e-9 * max(float(np.abs(m00 + m11).max()), 1e-300) ** 2
            top = np.stack([m11 * m[..., 4] - m01 * m[..., 5], m00 * m[..., 5] - m01 * m[..., 4]], -1)
            det = (det + tiny)[..., None]
            flow = np.divide(top, det, out=np.zeros_like(top), where=det > 0)  # a flat image does not move
    return flow[..., 0], flow[..., 1]
