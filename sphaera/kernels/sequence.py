"""Delay-embedded filtering of an ordered image sequence, and its one-dimensional coordinate."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from sphaera.kernels.diffusion import diffusion_map


def delay_matrix(d2: np.ndarray, window: int) -> np.ndarray:
    """Sum over the window of d2 along diagonals, for n - window starts."""
    m = len(d2) - window
    return sum(d2[c : c + m, c : c + m] for c in range(window))


def gram_svd(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Thin SVD by the eigenvectors of the smaller Gram matrix, values descending; vanishing ones are left out."""
    wide = a.shape[1] > a.shape[0]
    g = a @ a.T if wide else a.T @ a
    values, vectors = np.linalg.eigh(g)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    good = values > max(values[0], 0) * 1e-12
    s, vectors = np.sqrt(values[good]), vectors[:, good]
    other = (a.T @ vectors if wide else a @ vectors) / s
    return (vectors, s, other) if wide else (other, s, vectors)


def wiener_window(ctf: np.ndarray, window: int, snr: float = 5.0) -> np.ndarray:
    """Sliding sum of squared CTFs over the frames of each window, plus 1 / snr."""
    power = np.cumsum(np.concatenate([np.zeros((1, *ctf.shape[1:])), ctf**2]), 0)
    return power[window:] - power[:-window] + 1 / snr


def euclid(a: np.ndarray, b: np.ndarray, least: float = 1e-8) -> np.ndarray:
    """Distances of the columns of a and b."""
    d = np.sqrt(np.maximum((a * a).sum(0)[:, None] + (b * b).sum(0)[None, :] - 2 * a.T @ b, 0))
    return np.where(d < least, 0.0, d)


@dataclass(frozen=True)
class CurveFit:
    a: np.ndarray
    b: np.ndarray
    tau: np.ndarray


def _tau_of(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """tau in [0, 1] that minimises the residual of a_j cos(j pi tau) + b_j, one polynomial of degree 5 per row."""
    c = np.zeros((len(x), 6))
    y = x - b
    c[:, 0] = 48 * a[2] ** 2
    c[:, 2] = 8 * a[1] ** 2 - 48 * a[2] ** 2
    c[:, 3] = -12 * a[2] * y[:, 2]
    c[:, 4] = a[0] ** 2 - 4 * a[1] ** 2 + 9 * a[2] ** 2 - 4 * a[1] * y[:, 1]
    c[:, 5] = -a[0] * y[:, 0] + 3 * a[2] * y[:, 2]
    roots = np.full((len(x), 5), np.nan + 0j)
    full = (c[:, 0] != 0) & (c[:, -1] != 0)
    if full.any():  # all companion matrices at once
        companion = np.zeros((full.sum(), 5, 5))
        companion[:, np.arange(1, 5), np.arange(4)] = 1
        companion[:, 0] = -c[full, 1:] / c[full, :1]
        roots[full] = np.linalg.eigvals(companion)
    for i in np.flatnonzero(~full):
        r = np.roots(c[i])
        roots[i, : len(r)] = r
    good = (np.abs(roots.imag) < 1e-9) & (np.abs(roots.real) <= 1)
    t = np.hstack([np.arccos(np.where(good, roots.real, 0.0)) / np.pi, np.zeros((len(x), 1)), np.ones((len(x), 1))])
    left = sum((x[:, j, None] - b[j] - a[j] * np.cos(t * (j + 1) * np.pi)) ** 2 for j in range(3))
    left[:, :5][~good] = np.inf
    return t[np.arange(len(x)), left.argmin(1)]


def _start(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Amplitudes and offsets from a cubic of the third coordinate and a quadratic of the second in the first."""
    p, q, r, s = np.linalg.lstsq(np.stack([x[:, 0] ** k for k in (3, 2, 1, 0)], 1), x[:, 2], rcond=None)[0]
    disc = max(q * q - 3 * p * r, 0.0)
    if abs(p) < 1e-8:
        p = 1e-8
    a1, a3, b1 = 2 * np.sqrt(disc) / (3 * p), 2 * disc**1.5 / (27 * p * p), -q / (3 * p)
    b3 = 2 * q**3 / (27 * p * p) - q * r / (3 * p) + s
    u, v = np.linalg.lstsq(np.stack([x[:, 0] * (x[:, 0] - 2 * b1), np.ones(len(x))], 1), x[:, 1], rcond=None)[0]
    return np.array([a1, 2 * u * disc / (9 * p * p), a3]), np.array([b1, v + u * q * q / (9 * p * p) - 2 * u * r / (3 * p), b3])


def fit_curve(psi: np.ndarray, rounds: int = 100) -> CurveFit:
    """Alternating least squares of x_ij = a_j cos(j pi tau_i) + b_j on the first three coordinates."""
    x = psi[:, :3]
    a, b = _start(x)
    tau = _tau_of(x, a, b)
    for _ in range(rounds):
        cos = np.cos(np.outer(tau, np.arange(1, 4)) * np.pi)
        new = [np.linalg.lstsq(np.stack([cos[:, k], np.ones(len(x))], 1), x[:, k], rcond=None)[0] for k in range(3)]
        na, nb = np.array([n[0] for n in new]), np.array([n[1] for n in new])
        nt = _tau_of(x, na, nb)
        change = [100 * np.max(np.abs(na - a) / (np.abs(na) + 1e-12)), 100 * np.max(np.abs(nb - b) / (np.abs(nb) + 1e-12)), np.max(np.abs(nt - tau))]
        a, b, tau = na, nb, nt
        if change[0] < 1 and change[1] < 1 and change[2] < 0.01:
            break
    return CurveFit(a, b, tau)


@dataclass(frozen=True)
class Filtered:
    frames: np.ndarray  # pixels x frames
    topos: np.ndarray
    chronos: np.ndarray
    singular: np.ndarray
    psi: np.ndarray
    tau: np.ndarray


def filter_sequence(d2: np.ndarray, images: np.ndarray, window: int, tune: float = 3.0, trunc: int = 8, modes: tuple[int, ...] = (0, 1), ctf: np.ndarray | None = None, mask: np.ndarray | None = None, snr: float = 5.0) -> Filtered:
    """Singular-spectrum filter of images (frames x pixels) in rank order with squared distances d2.

    Windows of `window` frames are embedded by their summed distances; the lagged images are projected on the leading
    functions, decomposed, cut to the chosen modes and summed back over the lags.  Frames are z-scored, embedded once
    more, and fitted with a curve whose parameter tau orders them.
    """
    n = len(d2)
    e = diffusion_map(delay_matrix(d2, window), n - window, tune)
    psi = np.hstack([np.ones((n - window, 1)), e.psi[:, : trunc - 1]])
    weighted = e.mu[:, None] * psi
    side = int(round(np.sqrt(images.shape[1])))
    den = wiener_window(ctf, window, snr) if ctf is not None else None
    spectra = np.fft.fft2(images.reshape(n, side, side)) if ctf is not None else None
    lags = []
    for lag in range(window):
        rows = np.arange(n - window) + window - 1 - lag
        x = images[rows]
        if ctf is not None:
            x = np.fft.ifft2(spectra[rows] * ctf[rows] / den[: n - window]).real.reshape(n - window, -1)
            x = x * mask.ravel() if mask is not None else x
        lags.append(x.T @ weighted)
    u, s, v = gram_svd(np.vstack(lags))
    keep = [m for m in modes if m < len(s)]
    low = (u[:, keep] * s[keep]) @ v[:, keep].T
    pixels = images.shape[1]
    frames = np.zeros((pixels, n - 2 * window))
    for lag in range(window):
        frames += (low[lag * pixels : (lag + 1) * pixels] @ psi.T)[:, lag : lag + n - 2 * window]
    sd = frames.std(0)
    frames = (frames - frames.mean(0)) / np.where(sd > 0, sd, 1.0)
    again = diffusion_map(euclid(frames, frames) ** 2, min(frames.shape), tune)
    curve = fit_curve(again.psi)
    topos = u.reshape(window, pixels, -1).mean(0)[:, :trunc]
    return Filtered(frames, topos, v.T @ psi.T, s, again.psi, curve.tau)


def class_frames(tau: np.ndarray, n_class: int) -> np.ndarray:
    """Index of the first frame of every class of tau; an empty class is widened until it holds one."""
    t = (tau - tau.min()) / max(np.ptp(tau), 1e-300)
    n = int(min(n_class, len(tau) // 2)) or 1
    out = []
    for k in range(n):
        lo, hi = k / n, (k + 1) / n
        found = np.flatnonzero((t >= lo) & ((t <= hi) if k == n - 1 else (t < hi)))
        while not len(found):
            lo, hi = lo - lo / (2 * n) - (1e-12 if lo == 0 else 0), hi + hi / (2 * n)
            found = np.flatnonzero((t >= lo) & (t < hi))
        out.append(found[0])
    return np.array(out)


def mode_filter(stack: np.ndarray, modes: tuple[int, ...] = (0, 1)) -> tuple[np.ndarray, np.ndarray]:
    """SVD filter over a stack of volumes (volumes x voxels): the stack of the chosen modes, and all mode volumes."""
    u, s, v = gram_svd(stack.T)
    keep = [m for m in modes if m < len(s)]
    return ((u[:, keep] * s[keep]) @ v[:, keep].T).T, (u * s).T
