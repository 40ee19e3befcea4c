"""Belief propagation on a small graph (one node per group): the sequential schedule, in log space."""

from __future__ import annotations

import numpy as np


def _log_sum(x: np.ndarray, axis: int, largest: bool) -> np.ndarray:
    top = x.max(axis)
    return top if largest else top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def propagate(node: np.ndarray, edges: np.ndarray, edge_pot: np.ndarray, order: np.ndarray | None = None, tolerance: float = 1e-4, rounds: int = 300, damping: float = 1.0, max_product: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """Node beliefs (nodes x states), edge beliefs (edges x states x states) and the number of rounds.

    node: log potentials (nodes x states); edge_pot: log potentials per edge (states of src x states of dst).  Messages
    are updated one after another along `order`, so later ones use earlier ones of the same round.
    """
    n, s = node.shape
    out: list[list[tuple[int, int, bool]]] = [[] for _ in range(n)]
    for e, (a, b) in enumerate(edges):
        out[a].append((e, b, False))
        out[b].append((e, a, True))
    m = np.full((len(edges), 2, s), -np.log(s))  # [edge, 0] to dst, [edge, 1] to src
    order = np.arange(n) if order is None else order
    used = 0
    for used in range(1, rounds + 1):
        before = m.copy()
        for u in order:
            incoming = node[u] + sum((m[e, 0 if back else 1] for e, _, back in out[u]), np.zeros(s))
            for e, _, back in out[u]:
                pot = edge_pot[e].T if back else edge_pot[e]
                new = _log_sum((incoming - m[e, 0 if back else 1])[:, None] + pot, 0, max_product)
                new -= _log_sum(new, 0, False)
                slot = 1 if back else 0
                if damping < 1:
                    new = np.log(damping * np.exp(new) + (1 - damping) * np.exp(m[e, slot]))
                m[e, slot] = new
        if np.abs(np.exp(m) - np.exp(before)).sum() < tolerance:
            break
    belief = node.astype(float).copy()
    for u in range(n):
        for e, _, back in out[u]:
            belief[u] += m[e, 0 if back else 1]
    norm = lambda x: np.exp(x - _log_sum(x.ravel(), 0, False))
    pairs = np.array([norm((belief[a] - m[e, 1])[:, None] + (belief[b] - m[e, 0])[None, :] + edge_pot[e]) for e, (a, b) in enumerate(edges)]).reshape(len(edges), s, s)
    return np.array([norm(x) for x in belief]), pairs, used


def potentials(n: int, anchors: dict[int, int], measures: dict[int, np.ndarray], n_edges: int, psis: int, weight: float = 110.0, width: float = 1.2, bad: set[tuple[int, int]] = frozenset(), least: float = 1e-10, tiny: float = 1e-20) -> tuple[np.ndarray, np.ndarray]:
    """Log potentials of nodes and edges over 2 * psis states (each coordinate in either sense).

    anchors: node to state; measures: edge to a psis x 2 psis matrix, the distances forward and reversed; bad: (node,
    coordinate) pairs that are suppressed.
    """
    node = np.zeros((n, 2 * psis))
    for u, state in anchors.items():
        node[u, state] = weight
    for u, psi in bad:
        node[u, [psi, psi + psis]] = np.log(tiny)
    edge = np.full((n_edges, 2 * psis, 2 * psis), np.log(least))
    for e, m in measures.items():
        f, r = -m[:, :psis] / (2 * width**2), -m[:, psis:] / (2 * width**2)
        edge[e] = np.maximum(np.block([[f, r], [r, f]]), np.log(least))
    return node, edge


def decode(belief: np.ndarray, psis: int) -> tuple[np.ndarray, np.ndarray]:
    """(coordinate, sense) of the most probable state; ties go to the lowest."""
    state = belief.argmax(1)
    return state % psis, np.where(state < psis, 1, -1)
