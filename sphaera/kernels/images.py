"""Image kernels: masks, Fourier filters, rotation and shift, diffusion, flow, histograms of gradients."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def radial_frequency(n: int) -> np.ndarray:
    """Frequency of each FFT cell, 1 at Nyquist, in FFT order."""
    f = np.fft.fftfreq(n) * n
    return (2.0 / n) * np.sqrt(f[:, None] ** 2 + f[None, :] ** 2)


def transfer(q: np.ndarray, kind: str, cutoff: float, order: int = 8) -> np.ndarray:
    if kind == "Gauss":
        return np.exp(-(np.log(2) / 2) * (q / cutoff) ** 2)
    if kind == "Butter":
        return np.sqrt(1 / (1 + (q / cutoff) ** (2 * order)))
    raise ValueError(f"unknown filter {kind!r}")


def contrast_transfer(n: int, defocus: float, pixel: float, cs: float, kilovolts: float, envelope: float, amplitude: float) -> np.ndarray:
    """Transfer function of an n x n image in FFT order; defocus and pixel in A, cs in mm, envelope's half width in 1 / A."""
    w = 12.3986 / np.sqrt((2 * 511.0 + kilovolts) * kilovolts)
    k2 = (radial_frequency(n) / (2 * pixel)) ** 2
    gamma = (0.5 * np.pi * cs * 1e7 * w**3 * k2 - np.pi * w * defocus) * k2
    sigma = envelope / np.sqrt(2 * np.log(2))
    return (np.sin(gamma) - amplitude * np.cos(gamma)) * np.exp(-k2 / (2 * sigma**2))


def fourier_filter(img: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.fft.ifft2(np.fft.fft2(img) * weight).real


def phase_flip(img: np.ndarray, ctf: np.ndarray) -> np.ndarray:
    return fourier_filter(img, np.sign(ctf))


def wiener_restore(imgs: np.ndarray, ctfs: np.ndarray, snr: float = 5.0) -> np.ndarray:
    """Each image restored against the group's summed CTF power."""
    den = (ctfs**2).sum(0) + 1 / snr
    return np.fft.ifft2(np.fft.fft2(imgs) * ctfs / den).real


def ctf_distances(imgs: np.ndarray, ctfs: np.ndarray) -> np.ndarray:
    """||C_i F_j - C_j F_i||^2 for all pairs by three matrix products; n x n, zero diagonal."""
    n = len(imgs)
    f = np.fft.fft2(imgs).reshape(n, -1) / np.sqrt(imgs[0].size)
    c = ctfs.reshape(n, -1)
    cross = c**2 @ (np.abs(f) ** 2).T
    mixed = c * f
    d = cross + cross.T - 2 * (mixed @ mixed.conj().T).real
    np.fill_diagonal(d, 0.0)
    return np.maximum(d, 0.0)


def annular_mask(inner: float, outer: float, n: int) -> np.ndarray:
    """inner^2 <= r^2 < outer^2 on an n x n grid; the centre is one pixel to the right in x."""
    y, x = np.mgrid[0:n, 0:n].astype(float)
    r2 = (x - (n / 2 + 1)) ** 2 + (y - n / 2) ** 2
    return ((r2 >= inner**2) & (r2 < outer**2)).astype(float)


def _cubic(t: np.ndarray) -> np.ndarray:
    """Catmull-Rom weights of the four neighbours at fraction t."""
    return np.stack([((-t + 2) * t - 1) * t / 2, ((3 * t - 5) * t * t + 2) / 2, ((-3 * t + 4) * t + 1) * t / 2, (t - 1) * t * t / 2])


def sample_wrapped(img: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bicubic values at (y, x); the image repeats beyond its borders."""
    n, m = img.shape
    iy, ix = np.floor(y).astype(int), np.floor(x).astype(int)
    wy, wx = _cubic(y - iy), _cubic(x - ix)
    out = np.zeros(y.shape)
    for a in range(4):
        for b in range(4):
            out += wy[a] * wx[b] * img[(iy + a - 1) % n, (ix + b - 1) % m]
    return out


def rotate_fill(img: np.ndarray, degrees: float) -> np.ndarray:
    """Counter-clockwise rotation about the centre; corners are filled from the repeated image."""
    n, m = img.shape
    y, x = np.mgrid[0:n, 0:m].astype(float)
    cy, cx, t = (n - 1) / 2, (m - 1) / 2, np.deg2rad(degrees)
    dy, dx = y - cy, x - cx
    return sample_wrapped(img, cy + np.cos(t) * dy + np.sin(t) * dx, cx - np.sin(t) * dy + np.cos(t) * dx)


def shift_wrapped(img: np.ndarray, dy: float, dx: float) -> np.ndarray:
    """Shift by a fraction of a pixel, in Fourier space, with wrap-around."""
    f = np.fft.fft2(img)
    ky, kx = np.fft.fftfreq(img.shape[0])[:, None], np.fft.fftfreq(img.shape[1])[None, :]
    return np.fft.ifft2(f * np.exp(-2j * np.pi * (ky * dy + kx * dx))).real


def project_mask(volume: np.ndarray, rotation: np.ndarray, above: float = 1.0) -> np.ndarray:
    """Volume turned by the rotation matrix (nearest voxel), summed along z, thresholded."""
    n = np.array(volume.shape)
    grid = np.stack(np.meshgrid(*(np.arange(k) for k in n), indexing="ij"), -1).reshape(-1, 3)
    at = np.rint((grid - (n - 1) / 2) @ rotation.T + (n - 1) / 2).astype(int)
    at = np.clip(at, 0, n - 1)
    return (volume[tuple(at.T)].reshape(volume.shape).sum(2) > above).astype(float)


def gaussian_blur(img: np.ndarray, sigma: float) -> np.ndarray:
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in range(img.ndim):
        pad = [(r, r) if a == axis else (0, 0) for a in range(img.ndim)]
        img = np.apply_along_axis(np.convolve, axis, np.pad(img, pad, mode="symmetric"), w, mode="valid")
    return img


def median_filter(vol: np.ndarray, size: int = 3) -> np.ndarray:
    lo = size // 2
    pad = np.pad(vol, [(lo, size - 1 - lo)] * vol.ndim, mode="symmetric")
    return np.median(np.lib.stride_tricks.sliding_window_view(pad, (size,) * vol.ndim).reshape(*vol.shape, -1), axis=-1)


def adaptive_mask(img: np.ndarray, sigma: float = 2.0, offset: float = 2.0) -> np.ndarray:
    """1 where a pixel exceeds its local Gaussian mean less the offset."""
    return (img > gaussian_blur(img, sigma) - offset).astype(float)


def smooth_movie(stack: np.ndarray, steps: int = 4, kappa: float = 50.0, gamma: float = 0.1, spacing: tuple[float, float, float] = (5.0, 3.0, 3.0), exponential: bool = True) -> np.ndarray:
    """Edge-preserving diffusion in time and space."""
    out = stack.astype(float).copy()
    for _ in range(steps):
        change = np.zeros_like(out)
        for axis, h in enumerate(spacing):
            d = np.diff(out, axis=axis)
            c = np.exp(-((d / kappa) ** 2)) if exponential else 1 / (1 + (d / kappa) ** 2)
            flow = c * d / h
            up, down = [slice(None)] * 3, [slice(None)] * 3
            up[axis], down[axis] = slice(0, -1), slice(1, None)
            change[tuple(up)] += flow
            change[tuple(down)] -= flow
        out += gamma * change
    return out


def horn_schunck(first: np.ndarray, second: np.ndarray, u: np.ndarray | None = None, v: np.ndarray | None = None, sigma: float = 1.5, alpha: float = 2.0, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Dense flow (x, y) from first to second by Horn and Schunck's iteration, from a start if given."""
    a, b = gaussian_blur(first, sigma), gaussian_blur(second, sigma)
    fy = (np.gradient(a, axis=0) + np.gradient(b, axis=0)) / 2
    fx = (np.gradient(a, axis=1) + np.gradient(b, axis=1)) / 2
    ft = b - a
    u = np.zeros_like(a) if u is None else u.copy()
    v = np.zeros_like(a) if v is None else v.copy()

    def around(z: np.ndarray) -> np.ndarray:
        p = np.pad(z, 1, mode="edge")
        cross = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]
        corner = p[:-2, :-2] + p[:-2, 2:] + p[2:, :-2] + p[2:, 2:]
        return cross / 6 + corner / 12

    den = alpha**2 + fx**2 + fy**2
    for _ in range(rounds):
        mu, mv = around(u), around(v)
        g = (fx * mu + fy * mv + ft) / den
        u, v = mu - fx * g, mv - fy * g
    return u, v


def movie_flow(movie: np.ndarray, block: int = 5, start: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None, **options: float) -> tuple[np.ndarray, np.ndarray]:
    """Summed frame-to-frame flow of a movie averaged over blocks of frames; the reverse sense has the opposite sign.

    start: a flow of two frames from which the iterations begin; they begin from zero without one.
    """
    k = max(1, len(movie) // block)
    frames = [movie[i * len(movie) // k : (i + 1) * len(movie) // k].mean(0) for i in range(k)]
    u, v = np.zeros_like(frames[0]), np.zeros_like(frames[0])
    for a, b in zip([frames[0], *frames], frames, strict=False):
        du, dv = horn_schunck(a, b, *(start(a, b) if start else ()), **options)
        u, v = u + du, v + dv
    return u, v


def select_flow(u: np.ndarray, v: np.ndarray, share: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Flow vectors above the magnitude percentile, the others 0; inputs are left alone."""
    m = np.hypot(u, v)
    keep = m > np.quantile(m, share)
    return np.where(keep, u, 0.0), np.where(keep, v, 0.0)


def gradient_histogram(gx: np.ndarray, gy: np.ndarray, cells: int = 4, bins: int = 9, signed: bool = True, eps: float = 1e-7) -> np.ndarray:
    """Histograms of gradient direction over a grid of cells: every pixel is shared linearly between the two nearest
    directions and the four nearest cells; blocks of 2 x 2 cells scale their first cell by the block's total, clipped
    at 0.2 and scaled again."""
    h, w = gx.shape
    turn = 360.0 if signed else 180.0
    mag, ang = np.hypot(gx, gy), np.degrees(np.arctan2(gy, gx)) % turn
    pos = ang / (turn / bins) - 0.5
    b0 = np.floor(pos).astype(int)
    fb = pos - b0
    cy, cx = (np.arange(h) + 0.5) / (h / cells) - 0.5, (np.arange(w) + 0.5) / (w / cells) - 0.5
    y0, x0 = np.floor(cy).astype(int), np.floor(cx).astype(int)
    fy, fx = (cy - y0)[:, None], (cx - x0)[None, :]
    out = np.zeros((cells + 2, cells + 2, bins))
    for dy, wy in ((0, 1 - fy), (1, fy)):
        for dx, wx in ((0, 1 - fx), (1, fx)):
            for db, wb in ((0, 1 - fb), (1, fb)):
                iy, ix = np.broadcast_arrays((y0 + dy + 1)[:, None], (x0 + dx + 1)[None, :])
                np.add.at(out, (iy, ix, (b0 + db) % bins), mag * wy * wx * wb)
    cell = out[1:-1, 1:-1]
    blocks = []
    for y in range(cells - 1):
        for x in range(cells - 1):
            total = np.sqrt(cell[y : y + 2, x : x + 2].sum() ** 2) + eps
            part = np.minimum(cell[y, x] / total, 0.2)
            blocks.append(part / (np.sqrt(part.sum() ** 2) + eps))
    return np.array(blocks).ravel()


def flow_distance(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], norm: str = "l2") -> float:
    """Norm of the difference of the gradient histograms of two selected flow fields."""
    d = gradient_histogram(*select_flow(*a)) - gradient_histogram(*select_flow(*b))
    return float(np.abs(d).sum() if norm == "l1" else np.sqrt((d * d).sum()))
