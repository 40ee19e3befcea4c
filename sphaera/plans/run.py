"""A whole run over a ledger: from aligned snapshots to embeddings, sequences, flows, measures, labels and energies."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphaera.config import Config
from sphaera.functions.geometry import thermal_energy
from sphaera.operators import sequences as seq
from sphaera.operators.thresholds import tau_quality
from sphaera.plans import stages
from sphaera.plans.base import r6, snapshots
from sphaera.plans.exchange import new_folder
from sphaera.sources.ledger import Ledger, Step

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return keep


def keys_of(rows: DataFrame, key: str = "prd") -> DataFrame:
    return rows.select(F.col(key).cast("long").alias("key")).distinct()


def labels_of(members: DataFrame, sequences: DataFrame, measures: DataFrame, anchors: DataFrame | None, cfg: Config) -> DataFrame:
    """Labels of all groups; without anchors the first group's first coordinate is one."""
    nodes = members.select("prd").distinct()
    bad = tau_quality(sequences, "tau", ["prd", "psi"]).where("bad").select("prd", "psi")
    anchors = anchors if anchors is not None else nodes.agg(F.min("prd").alias("prd")).select("prd", F.lit(0).alias("state"))
    return stages.label_nodes(measures, nodes, anchors, 2, cfg, bad)


def energies_of(sequences: DataFrame, labels: DataFrame, states: int = 50) -> DataFrame:
    """Free energy over the states of the coordinate that each group was labelled with, turned where its sense is -1."""
    tau = sequences.join(labels.select("prd", "psi", "sense"), ["prd", "psi"]).select(F.when(F.col("sense") < 0, 1 - F.col("tau")).otherwise(F.col("tau")).alias("tau"))
    return seq.energy(seq.histogram(tau, "tau", states), thermal_energy())


def steps(cfg: Config, eps: float, anchors: DataFrame | None = None) -> list[Step]:
    """The steps of a run; the stage `members` (prd, img_id, px, q0..q3) comes from outside.

    Embeddings prune the members, sequences follow the kept ones.  Every step names only the settings it depends on, so a
    change of one of them puts that step and its followers to work again and no other.
    """
    c = {k: v for k, v in asdict(cfg).items() if isinstance(v, (int, float))}
    some = lambda *names: {n: c[n] for n in names}
    kept = lambda m, e: m.join(e.where("kept").select("prd", "img_id"), ["prd", "img_id"], "left_semi")
    return [
        Step("embedding", ("members",), lambda m: stages.embed(m, cfg), settings=some("radius", "tune", "num_eigs", "high")),
        Step("sequences", ("members", "embedding"), lambda m, e: stages.filtered(kept(m, e), cfg), settings=some("tune", "num_eigs", "psi_trunc", "con_order_range", "high")),
        Step("flows", ("sequences",), stages.flows),
        Step("measures", ("members", "flows"), lambda m, f: stages.edge_measures(stages.direction_graph(m, eps), f), whole=True, settings={"eps": eps}),
        Step("labels", ("members", "sequences", "measures"), lambda m, s, d: labels_of(m, s, d, anchors, cfg), whole=True, settings=some("bp_tolerance", "bp_rounds", "bp_damping", "bp_max_product")),
        Step("energies", ("sequences", "labels"), energies_of, whole=True),
    ]


def run(members: DataFrame, ledger: Ledger, cfg: Config, eps: float, anchors: DataFrame | None = None) -> dict[str, int]:
    """Bring a run up to date with cfg; members are taken in once, for groups that the ledger does not know yet."""
    fresh = keys_of(members).join(ledger.entries("members").select("key"), "key", "left_anti")
    if not fresh.isEmpty():
        ledger.write("members", members.join(fresh, members["prd"].cast("long") == fresh["key"], "left_semi"), fresh)
    return ledger.run(steps(cfg, eps, anchors))


def reembed(ledger: Ledger, cfg: Config, chosen: DataFrame, eps: float) -> dict[str, int]:
    """New embeddings of the groups of chosen (prd, img_id) from the chosen snapshots alone, and all that follows from them.

    The former ones stay in the ledger: `ledger.revert("embedding", keys)` and another run bring them back.
    """
    todo = steps(cfg, eps)
    keys = keys_of(chosen)
    rows = ledger.read("members", keys).join(chosen.select("prd", "img_id").distinct(), ["prd", "img_id"], "left_semi")
    ledger.write("embedding", stages.embed(rows, cfg), keys, todo[0].settings)
    return ledger.run(todo)


@query("""SELECT label AS prd, count(*) AS n, round(sum(embedding[1]::DOUBLE), 6) + 0.0 AS total, (SELECT count(*) FROM embeddings WHERE NOT (label % 3 = 1 AND label % 2 = 1) OR vec_id % 2 = 0) AS of_all
FROM embeddings WHERE NOT (label % 3 = 1 AND label % 2 = 1) OR vec_id % 2 = 0 GROUP BY 1""")
def ledger_revert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed and a whole step, brought up to date after some groups were replaced and some of these brought back."""
    book = Ledger(spark, new_folder(spark, "ledger"), per_part=4)
    s = snapshots(spark, sf_dir).select("prd", "img_id", F.element_at("px", 1).alias("v"))
    todo = [Step("sums", ("members",), lambda m: m.groupBy("prd").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))), Step("all", ("sums",), lambda t: t.agg(F.sum("n").alias("of_all")), whole=True)]
    book.write("members", s, keys_of(s))
    book.run(todo)
    some = s.where("prd % 3 = 1")
    book.write("members", some.where("img_id % 2 = 0"), keys_of(some))
    book.run(todo)
    book.revert("members", keys_of(some.where("prd % 2 = 0")))
    book.run(todo)
    return book.read("sums").crossJoin(book.read("all")).select("prd", "n", r6(F.col("total")).alias("total"), "of_all")  # one row


@query()
def stage_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of a run: the energy over the states of the labelled coordinates."""
    book = Ledger(spark, new_folder(spark, "run"))
    run(snapshots(spark, sf_dir), book, stages.SMALL, 1.2)
    return book.read("energies")
