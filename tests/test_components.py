import random

from pyspark.sql import functions as F

from sphaera.operators import graphs
from sphaera.operators.graphs import components
from sphaera.plans import graph as plans


def test_long_paths_without_order_settle_in_few_rounds(spark):
    ids = list(range(900))
    random.Random(3).shuffle(ids)
    halves = ids[:600], ids[600:]
    edges = spark.createDataFrame([e for h in halves for e in zip(h, h[1:])], "src long, dst long").repartition(3)
    nodes = spark.createDataFrame([(i,) for i in [*ids, 5000]], "id long").repartition(3)
    got = {r["id"]: r["component"] for r in components(nodes, edges, max_rounds=16).collect()}
    assert got == {i: min(h) for h in halves for i in h} | {5000: 5000}


def test_a_task_gets_rows_by_their_number(spark, monkeypatch):
    """rows of the largest file of edges, and of the largest bucket, where a task may have 200."""
    monkeypatch.setattr(graphs, "ROWS", 200, raising=False)
    nodes, edges = plans._bipartite(spark, "/root/testdata/sf0.001")
    share = lambda df: [r["count"] for r in df.groupBy(F.input_file_name()).count().collect()]
    assert sum(share(edges)) == edges.count() and max(share(edges)) < 400
    written = graphs.Rounds(edges, "test")
    both = graphs._both_ways(written, edges, "v", "u")
    assert sum(share(both)) == 2 * edges.count() and max(share(both)) < 2000  # ten suppliers have half of the rows
    want = {r["id"]: r["component"] for r in components(nodes, edges).collect()}
    near = edges.groupBy("dst").agg(F.min("src").alias("least")).collect()
    assert all(want[r["dst"]] == want[r["least"]] for r in near) and len(want) == nodes.count()
    written.drop("edges")


def test_repeated_edges_loops_and_no_edges(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "id long")
    edges = spark.createDataFrame([(4, 1), (1, 4), (4, 1), (2, 2), (5, 4)], "src long, dst long")
    assert {r["id"]: r["component"] for r in components(nodes, edges).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 1, 5: 1}
    assert {r["id"]: r["component"] for r in components(nodes, edges.where("false")).collect()} == {i: i for i in range(6)}
