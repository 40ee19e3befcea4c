import itertools
import time

import numpy as np

from sphaera.kernels import diffusion, flow, images, mrf, sequence


def test_diffusion_map_orders_a_curve():
    rng = np.random.default_rng(0)
    t = rng.random(150)
    x = np.stack([np.cos(np.pi * t), np.sin(np.pi * t)], 1)
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    e = diffusion.diffusion_map(d2, 150, 3.0)
    rank = lambda v: np.argsort(np.argsort(v))
    assert abs(e.values[0] - 1) < 1e-9 and abs(e.mu.sum() - 1) < 1e-9 and e.bandwidth.r2 > 0.99
    assert abs(np.corrcoef(rank(e.psi[:, 0]), rank(t))[0, 1]) > 0.999
    again = diffusion.diffusion_map(d2, 150, 3.0)
    assert np.array_equal(e.psi, again.psi)


def test_curve_fit_recovers_tau():
    rng = np.random.default_rng(0)
    t = rng.random(200)
    x = np.stack([np.cos(np.pi * k * t) * w for k, w in ((1, 1), (2, 0.6), (3, 0.4))], 1) + 0.01 * rng.standard_normal((200, 3))
    assert abs(np.corrcoef(sequence.fit_curve(x).tau, t)[0, 1]) > 0.99


def test_filtered_sequence_is_ordered():
    rng = np.random.default_rng(2)
    t = np.sort(rng.random(150))
    img = np.exp(-((np.mgrid[0:8, 0:8][1][None] - 7 * t[:, None, None]) ** 2) / 4).reshape(150, 64)
    d2 = ((img[:, None] - img[None]) ** 2).sum(2)
    f = sequence.filter_sequence(d2, img, 4)
    assert f.frames.shape == (64, 142) and np.allclose(f.frames.mean(0), 0, atol=1e-9) and np.allclose(f.frames.std(0), 1)
    assert abs(np.corrcoef(f.tau, np.arange(142))[0, 1]) > 0.85
    assert len(sequence.class_frames(f.tau, 50)) == 50


def test_gram_svd_and_modes():
    rng = np.random.default_rng(3)
    for shape in ((20, 5), (5, 20)):
        a = rng.standard_normal(shape)
        u, s, v = sequence.gram_svd(a)
        assert np.allclose((u * s) @ v.T, a) and np.allclose(s, np.linalg.svd(a, compute_uv=False))
    low = rng.standard_normal((50, 2)) @ rng.standard_normal((2, 216))
    out, _ = sequence.mode_filter(low + 1e-6 * rng.standard_normal(low.shape))
    assert np.allclose(out, low, atol=1e-4)


def test_transfer_aware_distance():
    rng = np.random.default_rng(0)
    c, x = rng.standard_normal((6, 4, 4)), rng.standard_normal((6, 4, 4))
    f = np.fft.fft2(x) / 4
    brute = np.array([[(np.abs(c[i] * f[j] - c[j] * f[i]) ** 2).sum() for j in range(6)] for i in range(6)])
    d = images.ctf_distances(x, c)
    assert np.allclose(d, brute) and np.allclose(images.ctf_distances(x, np.ones_like(c)), ((x[:, None] - x[None]) ** 2).sum((2, 3)))


def test_image_kernels():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((6, 6))
    assert np.allclose(images.rotate_fill(x, 90), np.rot90(x)) and np.allclose(images.rotate_fill(x, 360), x)
    g = np.exp(-((np.mgrid[0:16, 0:16] - 7.5) ** 2).sum(0) / 8)
    assert np.allclose(images.shift_wrapped(g, 0, 1), np.roll(g, 1, 1))
    for start in (None, flow.polynomial_flow):
        u, v = images.movie_flow(np.array([np.roll(g, k, 1) for k in range(10)]), start=start)
        assert u.sum() > 0 and abs(v.sum()) < abs(u.sum()) / 10
    h = images.gradient_histogram(*np.gradient(g)[::-1])
    assert h.shape == (81,) and (h >= 0).all()
    before = u.copy()
    images.select_flow(u, v)
    assert np.array_equal(u, before)
    assert images.flow_distance((u, v), (u, v)) == 0 and images.flow_distance((u, v), (-u, -v)) > 0
    assert images.median_filter(np.pad(np.ones((1, 1, 1)), 2)).max() == 0
    assert images.annular_mask(0, 3, 8).sum() > 0
    assert np.isclose(images.smooth_movie(rng.random((4, 5, 5))).mean(), images.smooth_movie(rng.random((4, 5, 5))).mean(), atol=0.2)
    vol = np.zeros((6, 6, 6))
    vol[2:4, 2:4, :] = 1
    assert images.project_mask(vol, np.eye(3)).sum() == 4


def test_belief_propagation_is_exact_on_trees():
    rng = np.random.default_rng(0)
    edges = np.array([[0, 1], [1, 2], [1, 3], [3, 4]])
    node, pot = rng.standard_normal((5, 4)), rng.standard_normal((4, 4, 4))
    belief, pairs, _ = mrf.propagate(node, edges, pot, tolerance=1e-10)
    z, zz = np.zeros((5, 4)), np.zeros((4, 4, 4))
    for s in itertools.product(range(4), repeat=5):
        w = np.exp(sum(node[i, s[i]] for i in range(5)) + sum(pot[e, s[a], s[b]] for e, (a, b) in enumerate(edges)))
        for i in range(5):
            z[i, s[i]] += w
        for e, (a, b) in enumerate(edges):
            zz[e, s[a], s[b]] += w
    assert np.allclose(belief, z / z.sum(1, keepdims=True)) and np.allclose(pairs, zz / zz[0].sum())


def test_anchor_spreads_over_a_loop():
    edges = np.array([[0, 1], [1, 2], [2, 3], [0, 3]])
    m = np.array([[5.0, 45.0, 45.0, 45.0], [45.0, 5.0, 45.0, 45.0]])
    node, pot = mrf.potentials(4, {0: 3}, {e: m for e in range(4)}, 4, 2)
    belief, _, rounds = mrf.propagate(node, edges, pot, damping=0.8)
    psi, sense = mrf.decode(belief, 2)
    assert (psi == 1).all() and (sense == -1).all() and rounds < 300 and np.allclose(belief.sum(1), 1)


def test_mixture_thresholds():
    from sphaera.kernels import mixtures as mx

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, 300), rng.normal(10, 1, 300)])
    for f in (mx.gaussian_threshold, mx.two_class_threshold, mx.valley_threshold):
        assert 2 < f(x) < 8
    y = np.concatenate([rng.exponential(0.5, 500), rng.normal(6, 0.7, 300)])
    assert 1 < mx.decay_threshold(y) < 6
    w, mu, sd = mx.two_gaussians(x)
    assert np.allclose(w, 0.5, atol=0.05) and np.allclose(mu, [0, 10], atol=0.3) and np.allclose(sd, 1, atol=0.2)
    assert mx.two_class_threshold(np.array([1.0])) == 1.0


def _texture(n, seed, sigma=2.5):
    return images.gaussian_blur(np.random.default_rng(seed).normal(size=(n, n)), sigma) * 100


def test_expansion_finds_a_quadratic():
    y, x = np.mgrid[0:15, 0:15] - 7.0
    linear, quadratic = flow.expansion(3 + 2 * x - y + 0.5 * x * x - 0.25 * y * y + 0.75 * x * y)
    assert np.allclose(linear[7, 7], [2, -1]) and np.allclose(quadratic[7, 7], [[0.5, 0.375], [0.375, -0.25]])


def test_flow_of_shifts_and_turns():
    img = _texture(96, 1)
    y, x = np.mgrid[0:96, 0:96].astype(float)
    inner = (slice(24, 72), slice(24, 72))
    for dx, dy in ((0.0, 0.0), (1.3, -0.7), (-3.0, 2.0), (6.0, 5.0)):
        u, v = flow.polynomial_flow(img, images.shift_wrapped(img, dy, dx))
        assert np.abs(u[inner] - dx).mean() < 0.1 and np.abs(v[inner] - dy).mean() < 0.1
    t = np.deg2rad(2.0)
    # second(p) = first(R p): what lies at p in the first image is found at R^-1 p in the second
    cy, cx = y - 47.5, x - 47.5
    second = flow.sample(img, 47.5 + np.cos(t) * cy + np.sin(t) * cx, 47.5 - np.sin(t) * cy + np.cos(t) * cx)
    u, v = flow.polynomial_flow(img, second)
    want_y, want_x = np.cos(t) * cy - np.sin(t) * cx - cy, np.sin(t) * cy + np.cos(t) * cx - cx
    assert np.abs(u - want_x)[inner].mean() < 0.1 and np.abs(v - want_y)[inner].mean() < 0.1


def test_flow_of_flat_and_small_images():
    for img in (np.ones((8, 8)), np.zeros((1, 5))):
        u, v = flow.polynomial_flow(img, img)
        assert np.isfinite(u).all() and np.abs(u).max() < 1e-9 and np.abs(v).max() < 1e-9


def test_kernel_sums_equal_plain_sums_and_take_little_time():
    rng = np.random.default_rng(11)
    for v in (rng.gamma(2.0, size=3000), np.concatenate([np.zeros(50), rng.random(400) * 1e-20, rng.random(300) * 1e6]), np.zeros(7), np.full(90, 2.5)):
        limit = max(-np.log(0.01 * np.exp(-v / (2 * np.exp(150))).mean()), 10.0)
        want = [np.log(x) if (x := np.exp(-v[v < limit * 2 * e] / (2 * e)).sum()) else 0.0 for e in np.exp(diffusion.LOG_EPS)]
        assert np.allclose(diffusion.kernel_log_sums(v), want, rtol=0, atol=1e-12)
    began = time.process_time()
    diffusion.kernel_log_sums(rng.gamma(2.0, size=1_000_000))
    assert time.process_time() - began < 2.5  # plain sums of all bandwidths take over 8 s


def test_curve_parameters_equal_roots_row_by_row():
    rng = np.random.default_rng(12)
    x, j = rng.normal(size=(40, 3)), np.arange(1, 4)
    for a in (np.array([1.0, 0.6, 0.3]), np.array([1.0, 0.6, 0.0])):  # without a3 the degree is lower
        b = np.array([0.1, 0.0, -0.1])
        got = sequence._tau_of(x, a, b)
        for row, t in zip(x, got, strict=True):
            y = row - b
            r = np.roots([48 * a[2] ** 2, 0, 8 * a[1] ** 2 - 48 * a[2] ** 2, -12 * a[2] * y[2], a[0] ** 2 - 4 * a[1] ** 2 + 9 * a[2] ** 2 - 4 * a[1] * y[1], -a[0] * y[0] + 3 * a[2] * y[2]])
            at = np.concatenate([np.arccos(r[(np.abs(r.imag) < 1e-9) & (np.abs(r.real) <= 1)].real) / np.pi, [0.0, 1.0]])
            assert t == at[np.argmin(((y - a * np.cos(np.outer(at, j) * np.pi)) ** 2).sum(1))]


def test_coordinates_of_a_kernel_of_several_parts_are_bounded():
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.normal(size=(60, 3)) * 0.01, 50 + rng.normal(size=(60, 3)) * 0.01, -80 + rng.normal(size=(3, 3)) * 0.01])
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    e = diffusion.diffusion_map(d2, 10, 1e-3)
    assert np.abs(e.psi).max() < 1e3 and e.mu.min() > 0 and abs(e.mu.sum() - 1) < 1e-9
