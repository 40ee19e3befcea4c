"""Belief propagation as rounds of joins and sums over a table of messages.

A graph has nodes (id, pot: log potential of each state) and edges (edge, src, dst, pot: log potentials of all pairs of
states, row by row of the source's states).  A row of the message table holds both directions of one edge: `ahead` to dst,
`back` to src, as log values.  In a round every node's incoming messages are added up (a partial sum and a shuffle of as many
numbers as a node has states), the sums join the edges at both ends, and each edge makes its two new messages by itself.  All
messages of a round use those of the round before.  Rounds are written tables; only their change, one number for every CHECKED
rounds, reaches the driver.  Nothing is collected, so the graph may be of any size; a row holds the square of the number of
states, the edge's potentials, which go along with its messages so that a round joins nothing but the sums.

Nodes without edges keep their own potential.  An edge of a node that is no row of `nodes` is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sphaera.operators.graphs import Rounds

MESSAGES = "edge long, src long, dst long, pot array<double>, ahead array<double>, back array<double>, change double"
CHECKED = 3


def _log_sum(x: np.ndarray, axis: int, largest: bool = False) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top if largest else top + np.log(np.exp(x - top).sum(axis, keepdims=True)), axis)


def first_messages(nodes: DataFrame, edges: DataFrame, states: int) -> DataFrame:
    """Uniform messages in both directions of every edge whose two nodes exist."""
    ids = nodes.select("id")
    known = edges.select("edge", "src", "dst", "pot").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    even = F.array_repeat(F.lit(float(-np.log(states))), states)
    return known.select(F.col("edge").cast("long").alias("edge"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "pot", even.alias("ahead"), even.alias("back"), F.lit(None).cast("double").alias("change"))


def node_sums(nodes: DataFrame, messages: DataFrame, states: int) -> DataFrame:
    """id, total: a node's log potential and all messages that come in."""
    both = F.array(F.struct(F.col("dst").alias("id"), F.col("ahead").alias("m")), F.struct(F.col("src").alias("id"), F.col("back").alias("m")))
    into = nodes.select(F.col("id").cast("long").alias("id"), F.col("pot").alias("m")).unionByName(messages.select(F.explode(both).alias("e")).select("e.id", "e.m"))
    sums = into.groupBy("id").agg(*(F.sum(F.element_at("m", k + 1)).alias(f"s{k}") for k in range(states)))
    return sums.select("id", F.array(*(f"s{k}" for k in range(states))).alias("total"))


def _at_both_ends(messages: DataFrame, totals: DataFrame) -> DataFrame:
    at = lambda end: totals.select(F.col("id").alias(end), F.col("total").alias(f"{end}_total"))
    return messages.join(at("src"), "src").join(at("dst"), "dst").select("edge", "src", "dst", "pot", "ahead", "back", "src_total", "dst_total")


def _columns(b: pa.RecordBatch, states: int) -> dict[str, np.ndarray]:
    """The array columns of a batch as one array each, a row per edge."""
    shape = {"pot": (b.num_rows, states, states)}
    return {n: b.column(k).flatten().to_numpy().reshape(shape.get(n, (b.num_rows, states))) for k, n in enumerate(b.schema.names) if k > 2}


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def step(nodes: DataFrame, messages: DataFrame, states: int, damping: float = 1.0, max_product: bool = False) -> DataFrame:
    """The messages of the next round, with the sum of their changes on every edge.

    A message is the share `damping` of what the round gives and the rest of what it was.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _columns(b, states)

            def new(held: np.ndarray, pot: np.ndarray, old: np.ndarray) -> np.ndarray:
                m = _log_sum(held[:, :, None] + pot, 1, max_product)
                m -= _log_sum(m, 1)[:, None]
                return m if damping == 1 else np.log(damping * np.exp(m) + (1 - damping) * np.exp(old))

            ahead = new(x["src_total"] - x["back"], x["pot"], x["ahead"])
            back = new(x["dst_total"] - x["ahead"], x["pot"].transpose(0, 2, 1), x["back"])
            change = np.abs(np.exp(ahead) - np.exp(x["ahead"])).sum(1) + np.abs(np.exp(back) - np.exp(x["back"])).sum(1)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], _lists(ahead), _lists(back), pa.array(change)], names=["edge", "src", "dst", "pot", "ahead", "back", "change"])

    return _at_both_ends(messages, node_sums(nodes, messages, states)).mapInArrow(run, MESSAGES)


def propagate(nodes: DataFrame, edges: DataFrame, states: int, tolerance: float = 1e-4, rounds: int = 300, damping: float = 1.0, max_product: bool = False) -> tuple[DataFrame, int]:
    """The messages after they settle (a round changes them by less than `tolerance` in all) or after `rounds`, and the
    number of rounds.  On a tree they settle after as many rounds as its longest path; on loops damping helps."""
    written = Rounds(nodes, "messages")
    nodes = nodes.checkpoint()
    messages, used = first_messages(nodes, edges, states).checkpoint(), 0
    for used in range(1, rounds + 1):
        messages = written.keep(step(nodes, messages, states, damping, max_product), f"round-{used}")
        if used > 1:
            written.drop(f"round-{used - 1}")
        if tolerance > 0 and used % CHECKED == 0 and (messages.agg(F.sum("change")).first()[0] or 0.0) < tolerance:
            break
    return messages, used


def beliefs(nodes: DataFrame, messages: DataFrame, states: int) -> DataFrame:
    """id, belief: normalised products of a node's potential and its incoming messages."""
    top = F.array_max("total")
    shifted = node_sums(nodes, messages, states).select("id", F.transform("total", lambda x: F.exp(x - top)).alias("w"))
    return shifted.select("id", F.transform("w", lambda x: x / F.aggregate("w", F.lit(0.0), lambda acc, y: acc + y)).alias("belief"))


def edge_beliefs(nodes: DataFrame, messages: DataFrame, states: int) -> DataFrame:
    """edge, src, dst, belief: normalised beliefs of all pairs of states of an edge's ends, row by row of the source's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _columns(b, states)
                joint = (x["src_total"] - x["back"])[:, :, None] + (x["dst_total"] - x["ahead"])[:, None, :] + x["pot"]
                joint = joint.reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], _lists(np.exp(joint - _log_sum(joint, 1)[:, None]))], names=["edge", "src", "dst", "belief"])

    return _at_both_ends(messages, node_sums(nodes, messages, states)).mapInArrow(run, "edge long, src long, dst long, belief array<double>")


def decode(believed: DataFrame, psis: int) -> DataFrame:
    """id, psi, sense, belief of the most probable state (ties: the lowest): a coordinate, forward or reversed."""
    top = F.array_max("belief")
    state = F.array_position("belief", top) - 1
    return believed.select("id", (state % psis).cast("int").alias("psi"), F.when(state < psis, 1).otherwise(-1).alias("sense"), top.alias("belief"))


def node_potentials(nodes: DataFrame, psis: int, anchors: DataFrame, bad: DataFrame | None = None, weight: float = 110.0, tiny: float = 1e-20) -> DataFrame:
    """id, pot for nodes (id): anchors (id, state) get `weight` at their state, coordinates in bad (id, psi) are shut out."""
    known = nodes.select(F.col("id").cast("long").alias("id")).distinct().join(anchors.groupBy(F.col("id").cast("long").alias("id")).agg(F.max("state").alias("state")), "id", "left")
    shut = F.array().cast("array<int>")
    if bad is not None:
        known = known.join(bad.groupBy(F.col("id").cast("long").alias("id")).agg(F.collect_set(F.col("psi").cast("int")).alias("shut")), "id", "left")
        shut = F.coalesce("shut", shut)
    value = lambda k: F.when(F.array_contains(shut, F.lit(k % psis)), float(np.log(tiny))).when(F.col("state") == k, weight).otherwise(0.0)
    return known.select("id", F.array(*(value(k) for k in range(2 * psis))).alias("pot"))


def edge_potentials(measures: DataFrame, psis: int, width: float = 1.2, least: float = 1e-10, missing: float = 45.0) -> DataFrame:
    """edge, src, dst, pot for measures (edge, src, dst, psi_a, psi_b, sense, v).

    Two states of the same sense meet by the forward measure, others by the reversed one: exp(-v / 2 width^2), at least
    `least`; a pair without a measure counts as `missing`.
    """
    slot = (F.col("psi_a") * 2 * psis + F.col("psi_b") + F.when(F.col("sense") > 0, 0).otherwise(psis)).cast("int")
    held = measures.groupBy("edge", "src", "dst").agg(F.map_from_entries(F.collect_list(F.struct(slot, F.col("v").cast("double")))).alias("at"))  # psis^2 x 2 numbers
    cell = lambda k: F.greatest(-F.coalesce(F.element_at("at", F.lit(k)), F.lit(missing)) / (2 * width * width), F.lit(float(np.log(least))))
    cells = [cell((i % psis) * 2 * psis + j % psis + (0 if (i < psis) == (j < psis) else psis)) for i in range(2 * psis) for j in range(2 * psis)]
    return held.select("edge", "src", "dst", F.array(*cells).alias("pot"))
