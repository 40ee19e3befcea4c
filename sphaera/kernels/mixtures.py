"""One-dimensional mixtures for thresholds: two Gaussians by EM, and a decay with a bump by least squares."""

from __future__ import annotations

import numpy as np


def two_gaussians(x: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, means, deviations), the lower mean first; the start is the split at the median."""
    x = np.asarray(x, float)
    low = x <= np.median(x)
    r = np.stack([low, ~low], 1).astype(float)
    if not r.sum(0).all():
        r = np.full((len(x), 2), 0.5)
    for _ in range(rounds):
        n = r.sum(0) + 1e-12
        w, mu = n / n.sum(), (r * x[:, None]).sum(0) / n
        sd = np.sqrt((r * (x[:, None] - mu) ** 2).sum(0) / n + 1e-12)
        log = np.log(w) - np.log(sd) - 0.5 * ((x[:, None] - mu) / sd) ** 2
        new = np.exp(log - log.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        if np.abs(new - r).max() < 1e-9:
            break
        r = new
    order = np.argsort(mu)
    return w[order], mu[order], sd[order]


def gaussian_threshold(x: np.ndarray) -> float:
    """Largest value that belongs to the lower component."""
    w, mu, sd = two_gaussians(x)
    log = np.log(w) - np.log(sd) - 0.5 * ((np.asarray(x, float)[:, None] - mu) / sd) ** 2
    own = np.asarray(x, float)[(log[:, 0] >= log[:, 1]) & (np.asarray(x) <= mu[1])]
    return float(own.max()) if len(own) else float(np.min(x))


def decay_threshold(x: np.ndarray, bins: int = 30) -> float:
    """Where an exponential decay meets a Gaussian bump fitted to the histogram; a two-class split if they never meet."""
    x = np.asarray(x, float)
    h, edge = np.histogram(x, bins)
    c = (edge[1:] + edge[:-1]) / 2
    span = max(np.ptp(x), 1e-12)
    top = c[np.argmax(np.where(c > c.mean(), h, 0))]
    p = np.array([max(h[0], 1.0), 5 / span, max(h.max() / 2, 1.0), top, span / 6])

    def model(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return q[0] * np.exp(-q[1] * (c - edge[0])), q[2] * np.exp(-0.5 * ((c - q[3]) / q[4]) ** 2)

    damp, r = 1e-2, h - sum(model(p))
    for _ in range(300):
        j = np.stack([(sum(model(p + d)) - sum(model(p))) / d[k] for k in range(5) for d in [np.where(np.arange(5) == k, 1e-6 * max(abs(p[k]), 1e-3), 0)]], 1)
        m = j.T @ j
        q = p + np.linalg.solve(m + damp * np.diag(np.diag(m) + 1e-9), j.T @ r)
        s = h - sum(model(q))
        if s @ s < r @ r:
            p, r, damp = q, s, damp / 3
        else:
            damp *= 4
            if damp > 1e10:
                break
    grid = np.linspace(edge[0], p[3] if edge[0] < p[3] < edge[-1] else edge[-1], 1000)
    a, b = p[0] * np.exp(-p[1] * (grid - edge[0])), p[2] * np.exp(-0.5 * ((grid - p[3]) / p[4]) ** 2)
    cross = np.flatnonzero((a[:-1] > b[:-1]) & (a[1:] <= b[1:]))
    return float(grid[cross[0]]) if len(cross) else two_class_threshold(x)


def two_class_threshold(x: np.ndarray) -> float:
    """Largest value of the lower class of the best split in two."""
    v = np.sort(np.asarray(x, float))
    if len(v) < 2:
        return float(v[0]) if len(v) else float("nan")
    n = np.arange(1, len(v))
    s = np.cumsum(v)
    gain = s[:-1] ** 2 / n + (s[-1] - s[:-1]) ** 2 / (len(v) - n)
    return float(v[np.argmax(np.round(gain, 9))])


def valley_threshold(x: np.ndarray, bins: int = 50) -> float:
    """The lowest valley of the smoothed histogram between the two class centres; else the two-class split."""
    x = np.asarray(x, float)
    h, edge = np.histogram(x, bins)
    smooth = np.convolve(np.pad(h.astype(float), 3, mode="edge"), np.array([-2, 3, 6, 7, 6, 3, -2]) / 21, mode="valid")
    cut = two_class_threshold(x)
    low, high = x[x <= cut].mean(), x[x > cut].mean() if (x > cut).any() else cut
    c = (edge[1:] + edge[:-1]) / 2
    inside = np.flatnonzero((c > low) & (c < high))
    found = [k for k in inside if 0 < k < bins - 1 and smooth[k] <= smooth[k - 1] and smooth[k] <= smooth[k + 1]]
    return float(c[min(found, key=lambda k: (smooth[k], k))]) if found else cut
