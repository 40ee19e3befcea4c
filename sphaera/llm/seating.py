"""Chinese-restaurant seating of many Pitman-Yor restaurants at once, sampled by Gibbs in blocks, in numpy.

A row is a (restaurant, dish) with its customers; rows with one customer have one table and never change.  A Gibbs step
draws the number of a row's tables at once, given those of the restaurant's other rows: c customers sit at t tables with
weight S(c, t) * (parent's probability of the dish)^t * product over the restaurant's tables k of (strength + discount k),
where S are the generalised Stirling numbers of the discount, the weights of all seatings of c customers at t tables.  So a
step costs a row's customers at most, forgets where the row was, and a large row mixes as fast as a small one.  The rows of
a restaurant take turns in TURNS rounds, so those of a restaurant of up to TURNS movable rows go one by one; in larger
ones the rows of a turn go side by side, with the restaurant's tables as the turn found them.

S comes from its recurrence up to TABLE customers.  Beyond, from its alternating sum where few tables keep that exact, and
from a saddle point of its generating function where there are more; there the weight has one peak, and a row is drawn from
CELLS equal cells around it.

All random numbers follow from the row's own seed, so a repeated or otherwise dealt task draws the same.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from sphaera.llm.neardup import mix

_GOLD = np.uint64(0x9E3779B97F4A7C15)
EXACT, TURNS, TABLE, CELLS, SLAB = 16, 4, 4096, 256, 1 << 19
_DROP = 40.0  # in logarithms: what lies lower than the peak by more is not looked at


def uniform(seed: np.ndarray, step: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(seed + np.uint64(2 * step + 1) * _GOLD) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def first_tables(c: np.ndarray, fresh: np.ndarray, discount: float, seed: np.ndarray) -> np.ndarray:
    """Tables to begin with: customers come one after another (later ones in runs that grow with those seated, by the mean
    of their new tables); fresh: a new table's weight.  The sweeps start from here."""
    t = np.ones(len(c))
    at, n, step = np.arange(len(c)), 1, 1 << 20
    while len(at):
        run = 1 if n < EXACT else n // 4
        chance = fresh[at] / (fresh[at] + n - discount * t[at])
        m = np.minimum(run, c[at] - n)
        t[at] += uniform(seed[at], step) < chance if run == 1 else np.minimum(m * chance, m)
        n += run
        step += 1
        at = at[c[at] > n]
    return np.minimum(np.floor(t + uniform(seed, 1 << 21)), c).astype(np.int64)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For positive x."""
    x = np.asarray(x, float)
    small = np.where(x < 10, x, 10.0)
    back = np.where(x < 10, sum(np.log(small + k) for k in range(10)), 0.0)
    y = np.where(x < 10, x + 10, x)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - back


def stirling(counts: np.ndarray, discount: float) -> dict[int, np.ndarray]:
    """log S(c, 1..c) for each c of counts, by the recurrence over customers."""
    out, want = {}, set(counts.tolist())
    row = np.zeros(1)
    for n in range(1, max(want, default=0) + 1):
        if n in want:
            out[n] = row
        stay = np.append(row + np.log(n - discount * np.arange(1, n + 1)), -np.inf)
        row = np.logaddexp(np.append(-np.inf, row), stay)
    return out


def _exponent(y: np.ndarray, d: float) -> np.ndarray:
    """How far S(c, y c^d) lies below its plain power law, in logarithms: its alternating sum loses twice as much."""
    return (1 - d) * d ** (d / (1 - d)) * y ** (1 / (1 - d))


def log_stirling(c: int, t: np.ndarray, d: float) -> np.ndarray:
    """log S(c, t) of a large c; t: whole numbers."""
    t = np.asarray(t, float)
    out = np.empty(len(t))
    few = _exponent(t / float(c) ** d, d) < 9
    if few.any():
        x = t[few]
        # terms peak at 9 / (1 - d) tables at most; a term follows from the one before
        k = np.arange(1, int(min(40 / (1 - d) + 60, x.max())) + 1)
        g = log_gamma(1 + d * np.append(0, k)) + log_gamma(c - d * np.append(0, k))
        terms = np.cumprod(np.maximum(x - k[:, None] + 1, 0.0) * (np.exp(np.diff(g)) / k)[:, None], axis=0)
        sums = (np.where(k % 2 == 1, 1.0, -1.0) * np.sin(np.pi * d * k) / np.pi) @ terms
        out[few] = np.log(np.maximum(sums, 1e-300)) + log_gamma(np.array(float(c))) - x * np.log(d) - log_gamma(x + 1)
    if not few.all():
        x = t[~few]
        lo, hi = np.full(len(x), -700.0), np.full(len(x), -1e-12)  # log(1 - z) of the saddle point
        for _ in range(60):
            m = (lo + hi) / 2
            slope = -np.expm1(m) * d * np.exp((d - 1) * m) / -np.expm1(d * m)  # of t * log f by log z, for one table
            over = slope > c / x
            lo, hi = np.where(over, m, lo), np.where(over, hi, m)
        m = (lo + hi) / 2
        z = -np.expm1(m)
        f, f1 = -np.expm1(d * m) / d, np.exp((d - 1) * m)
        f2 = (1 - d) * np.exp((d - 2) * m)
        spread = x * (z * f1 / f + z * z * (f2 / f - (f1 / f) ** 2))
        spread = np.where(x >= c, 1 / (2 * np.pi), np.maximum(spread, 1e-300))
        at = x * np.log(f) - c * np.log(z)
        out[~few] = log_gamma(np.array(c + 1.0)) - log_gamma(x + 1) + np.where(x >= c, 0.0, at) - 0.5 * np.log(2 * np.pi * spread)
    return out


def _draw_large(c: int, weight: Callable[[np.ndarray], np.ndarray], u: float) -> int:
    """A draw of 1..c by a log-weight with one peak."""
    lo, hi = 1, c
    while hi - lo > 32:
        x = np.unique(np.linspace(lo, hi, 33).round())
        k = int(weight(x).argmax())
        lo, hi = int(x[max(k - 1, 0)]), int(x[min(k + 1, len(x) - 1)])
    x = np.arange(lo, hi + 1)
    w = weight(x)
    peak, top = int(x[w.argmax()]), w.max()
    far = 2 ** np.arange(0, int(np.log2(c)) + 2)
    below, above = np.maximum(peak - far, 1), np.minimum(peak + far, c)
    ends = []
    for side in (below, above):
        low = weight(side) < top - _DROP
        ends.append(int(side[low.argmax() if low.any() else -1]))
    lo, hi = ends
    edge = np.unique(np.linspace(lo, hi + 1, CELLS + 1).round().astype(np.int64))
    middle = (edge[:-1] + edge[1:] - 1) // 2
    mass = np.cumsum(np.exp(weight(middle) - top) * np.diff(edge))
    v = u * mass[-1]
    k = int(min(np.searchsorted(mass, v, side="right"), len(mass) - 1))
    within = (v - (mass[k - 1] if k else 0.0)) / (mass[k] - (mass[k - 1] if k else 0.0))
    return int(min(edge[k] + int(within * (edge[k + 1] - edge[k])), edge[k + 1] - 1))


def sample_tables(c: np.ndarray, of: np.ndarray, parent: np.ndarray, elsewhere: np.ndarray, seed: np.ndarray, strength: float, discount: float, burn_in: int, samples: int) -> np.ndarray:
    """Tables of every row, summed over the samples.

    c: customers, one or more; of: the row's restaurant, ascending; parent: the parent's probability of its dish;
    elsewhere: for each restaurant its tables that are not among the rows; seed: uint64.
    """
    total = np.where(c == 1, samples, 0)
    moving = np.flatnonzero(c > 1)
    if not len(moving):
        return total
    cm, om, sm = c[moving], of[moving], seed[moving]
    # the other rows' tables are taken to be one each while the first tables are dealt out
    tables = elsewhere + np.bincount(of, minlength=len(elsewhere))
    t = first_tables(cm, (strength + discount * tables[om]) * parent[moving], discount, sm)
    tables = tables + np.bincount(om, t - 1, len(elsewhere)).astype(np.int64)
    step_up = np.log(discount * parent[moving])
    nth = np.arange(len(om)) - np.searchsorted(om, om)  # place among the restaurant's movable rows
    logs = stirling(np.unique(cm[cm <= TABLE]), discount)
    order = np.argsort(cm, kind="stable")
    turns = [order[nth[order] % TURNS == k] for k in range(TURNS)]
    sums = np.zeros(len(moving), np.int64)
    for sweep in range(burn_in + samples):
        for rows in turns:
            # strength / discount + the tables of the others
            others = strength / discount + tables[om[rows]] - t[rows]
            new = _draw(cm[rows], others, step_up[rows], uniform(sm[rows], sweep + 1), logs, discount)
            np.add.at(tables, om[rows], new - t[rows])
            t[rows] = new
        if sweep >= burn_in:
            sums += t
    total[moving] = sums
    return total


def _draw(c: np.ndarray, others: np.ndarray, step_up: np.ndarray, u: np.ndarray, logs: dict[int, np.ndarray], discount: float) -> np.ndarray:
    """Tables of rows in ascending order of customers."""
    out = np.empty(len(c), np.int64)
    edge = np.append(np.flatnonzero(np.diff(c, prepend=-1)), len(c))
    for begin, end in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        n = int(c[begin])
        if n > TABLE:
            for i in range(begin, end):
                a, b = others[i], step_up[i]
                out[i] = _draw_large(n, lambda x, a=a, b=b: log_stirling(n, x, discount) + b * x + log_gamma(a + x), u[i])
            continue
        k = np.arange(1, n + 1)
        per = max(1, SLAB // n)
        for i in range(begin, end, per):
            j = min(i + per, end)
            w = np.log(others[i:j, None] + (k - 1))
            w[:, 0] = 0.0  # the first table's factor is in all weights
            w = np.cumsum(w, axis=1) + step_up[i:j, None] * k + logs[n]
            w = np.cumsum(np.exp(w - w.max(1, keepdims=True)), axis=1)
            out[i:j] = np.minimum((w <= (u[i:j] * w[:, -1])[:, None]).sum(1), n - 1) + 1
    return out
