"""Graphs of groups: neighbourhoods, components, search orders, incident edges."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sphaera.sources.files import locate

#: Rows of a table that one task sorts or hashes, about.
ROWS = 500_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> None:
    """Make sure that checkpoint() has a folder: the one the cluster names, or one of our own where none is set."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            at = tempfile.mkdtemp(prefix="sphaera-checkpoint-")
        if "://" not in at:
            os.makedirs(at, exist_ok=True)
        spark.sparkContext.setCheckpointDir(at)


class Rounds:
    """Tables of the rounds, written to the shared folder.  A checkpoint would hand on its plan's estimated size, which is
    the product of what a round joins and so grows with the power of the rounds; a file's size is what it is."""

    def __init__(self, df: DataFrame, name: str) -> None:
        self.spark = df.sparkSession
        checkpoint_dir(self.spark)
        self.tables: dict[str, str] = {}
        self.root = f"{self.spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/{name}-{uuid.uuid4().hex}"

    @contextmanager
    def _once(self) -> Iterator[None]:
        """What a round exchanges is of no use once its table is written; else it stays until the driver collects garbage."""
        conf, was = self.spark.conf, self.spark.conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")
        try:
            yield
        finally:
            conf.set(CLEANUP, was)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        with self._once():
            df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def keep_by(self, df: DataFrame, name: str, key: str | tuple[str, ...], buckets: int) -> DataFrame:
        """As keep(), in buckets of a key, one file each: a join on the key moves only the other side."""
        table = f"{name}_{uuid.uuid4().hex}"
        key = (key,) if isinstance(key, str) else key
        with self._once():
            df.repartition(buckets, *key).write.bucketBy(buckets, *key).option("path", f"{self.root}/{name}").saveAsTable(table)
        self.tables[name] = table
        return self.spark.table(table)

    def drop(self, name: str) -> None:
        if name in self.tables:
            self.spark.sql(f"DROP TABLE {self.tables.pop(name)}")
        fs, at = locate(f"{self.root}/{name}")
        fs.delete_dir(at)


def parts_of(spark: SparkSession, rows: int) -> int:
    """Partitions of a table by its rows, so that a task's share does not grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))


def _both_ways(written: Rounds, edges: DataFrame, key: str, other: str) -> DataFrame:
    """Edges and their reverses in buckets of one end, with as many buckets as the rows ask for.  Edges are read twice."""
    both = edges.select(F.col("src").alias(other), F.col("dst").alias(key)).union(edges.select("dst", "src"))
    return written.keep_by(both, "edges", key, parts_of(edges.sparkSession, 2 * edges.count()))


def neighbourhood(points: DataFrame, eps: float, id_col: str = "bin") -> DataFrame:
    """Edges src < dst of points (id, x, y, z) at most eps apart, but not at the same place.

    Points meet by cell of a grid of width eps: each looks into the 27 cells around, an equi-join of bounded fan-out.
    """
    at = lambda c: F.floor(F.col(c) / eps)
    a = points.select(F.col(id_col).alias("src"), *(F.col(c).alias(f"a{c}") for c in "xyz"), *(at(c).alias(f"c{c}") for c in "xyz"))
    for c in "xyz":
        a = a.withColumn("s", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn(f"c{c}", F.col(f"c{c}") + F.col("s")).drop("s")
    b = points.select(F.col(id_col).alias("dst"), *(F.col(c).alias(f"b{c}") for c in "xyz"), *(at(c).alias(f"c{c}") for c in "xyz"))
    d2 = sum(((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in "xyz"), F.lit(0.0))
    return a.join(b, ["cx", "cy", "cz"]).where("src < dst").withColumn("d2", d2).where((F.col("d2") > 0) & (F.sqrt("d2") <= eps)).select("src", "dst", F.sqrt("d2").alias("dist"))


def epsilon_rule(least: Column, groups: Column, active: Column) -> Column:
    """min(max(m + 1e-10, m * groups / active), 2 sqrt(2) m + 1e-10) for the least non-zero distance m."""
    return F.least(F.greatest(least + 1e-10, least * groups / active), 2 * 2**0.5 * least + 1e-10)


def directed(edges: DataFrame) -> DataFrame:
    """Numbered edges in lexicographic order and their reverses, whose number is larger by the count of edges.

    Edges are sorted over range partitions and checkpointed; a number is the partition's offset and the place in it.
    """
    checkpoint_dir(edges.sparkSession)
    e = numbered(edges.select("src", "dst").orderBy("src", "dst").checkpoint(), "edge").withColumn("edge", F.col("edge") + 1)
    n = e.agg(F.count(F.lit(1)).alias("n_edges"))
    back = e.crossJoin(F.broadcast(n)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("edge") + F.col("n_edges")).alias("edge"))  # one row
    return e.select("src", "dst", "edge").unionByName(back)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Rows with a number from 0 in their order: counts per partition, then offsets; only the counts reach the driver."""
    m = rows.withColumn("_m", F.monotonically_increasing_id())
    part = F.shiftright("_m", 33).cast("long")
    counts = m.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()  # a row per partition
    at, starts = 0, {}
    for r in counts:
        starts[r["p"]] = at
        at += r["n"]
    if not starts:
        return m.select(F.lit(0).cast("long").alias(name), *rows.columns)
    offset = F.element_at(F.create_map(*(F.lit(x) for kv in starts.items() for x in kv)), part)
    return m.select((offset + F.col("_m") % F.lit(1 << 33)).alias(name), *rows.columns)


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """id, component (the least id of the component) for every node.

    Every round takes the least label among a node's neighbours, hands it to the root of the node's old label, and then takes
    the label of that label, so trees of labels join and paths shrink geometrically; every round's labels are a written table.  Nodes without edges keep their own id.
    The edges lie still in buckets and pass by a hash table of their bucket's labels, so a task holds labels, never edges.
    """
    written = Rounds(nodes, "components")
    both = _both_ways(written, edges, "v", "u")
    label = nodes.select("id", F.col("id").alias("component")).checkpoint()
    parts = parts_of(nodes.sparkSession, label.count())
    for step_no in range(max_rounds):
        near = both.join(label.select(F.col("id").alias("v"), F.col("component").alias("c")).hint("shuffle_hash"), "v").groupBy(F.col("u").alias("id")).agg(F.min("c").alias("c"))
        step = label.repartition(parts, "id").join(near.hint("shuffle_hash"), "id", "left").select("id", F.least("component", F.coalesce("c", "component")).alias("component"), F.col("component").alias("old"))
        hook = step.groupBy(F.col("old").alias("id")).agg(F.min("component").alias("h"))  # what a component's members saw reaches its root
        step = step.join(hook.hint("shuffle_hash"), "id", "left").select("id", F.least("component", F.coalesce("h", "component")).alias("component"), "old")
        # labels in use that have moved on: few after the first rounds, so the rows of a large component need not meet in one task
        jump = step.where("id <> component").select(F.col("id").alias("component"), F.col("component").alias("far")).join(step.select("component").distinct(), "component", "left_semi")
        new = step.join(jump, "component", "left").select("id", F.coalesce("far", "component").alias("component"), "old")
        new = written.keep(new, f"labels-{step_no}")
        if step_no:
            written.drop(f"labels-{step_no - 1}")
        label = new.select("id", "component")
        if not new.where("component <> old").limit(1).count():
            written.drop("edges")
            return label
    raise RuntimeError("components did not settle")


def search_levels(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """id, level: steps from the nearest seed (0 for seeds); unreachable nodes come last, at null."""
    written = Rounds(nodes, "levels")
    both = _both_ways(written, edges, "u", "id")
    seen = seeds.select("id").distinct().join(nodes, "id", "left_semi").select("id", F.lit(0).alias("level")).checkpoint()
    front = seen
    for level in range(1, max_rounds):
        front = both.join(front.select(F.col("id").alias("u")).hint("shuffle_hash"), "u").select("id").distinct().join(seen, "id", "left_anti").select("id", F.lit(level).alias("level")).checkpoint()
        if not front.limit(1).count():
            written.drop("edges")
            return nodes.select("id").join(seen, "id", "left")
        seen = seen.unionByName(front).checkpoint()
    raise RuntimeError(f"the search did not end in {max_rounds} levels")


def prune(edges: DataFrame, bad: DataFrame) -> DataFrame:
    """Edges without those at a bad node; node ids stay as they are."""
    return edges.join(bad.select(F.col("id").alias("src")), "src", "left_anti").join(bad.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")


def touching(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with either end among the chosen nodes."""
    a = edges.join(chosen.select(F.col("id").alias("src")), "src", "left_semi")
    b = edges.join(chosen.select(F.col("id").alias("dst")), "dst", "left_semi")
    return a.select("src", "dst").union(b.select("src", "dst")).distinct()
