import numpy as np
from pyspark.sql import functions as F

from sphaera.config import Config
from sphaera.kernels import mrf
from sphaera.operators import distances, graphs, messages, sequences
from sphaera.plans import stages
from sphaera.sources import stages as tables


def test_versions_and_resume(spark, tmp_path):
    df = spark.range(6).select((F.col("id") % 3).alias("prd"), F.col("id").alias("v"))
    root = str(tmp_path)
    tables.write_stage(df, root, "tau")
    tables.write_stage(df.where("prd = 1").withColumn("v", F.lit(9).cast("long")), root, "tau")  # one partition replaced
    assert sorted((r["prd"], r["v"]) for r in tables.read_stage(spark, root, "tau").collect()) == [(0, 0), (0, 3), (1, 9), (1, 9), (2, 2), (2, 5)]
    tables.write_stage(df, root, "tau", 1)
    assert tables.read_stage(spark, root, "tau", 1).count() == 6
    todo = tables.pending(spark.range(5).withColumnRenamed("id", "prd"), tables.read_stage(spark, root, "tau"), ["prd"])
    assert sorted(r["prd"] for r in todo.collect()) == [3, 4]
    tables.write_columns(df, root + "/tsv")
    assert tables.read_columns(spark, root + "/tsv", "prd long, v long").count() == 6


def test_embedding_orders_a_group(spark):
    rng = np.random.default_rng(0)
    t = rng.random(80)
    px = np.exp(-((np.arange(16)[None] - 15 * t[:, None]) ** 2) / 8)
    df = spark.createDataFrame([(0, i, px[i].tolist()) for i in range(80)] + [(1, 100 + i, px[i].tolist()) for i in range(3)], "prd int, img_id long, px array<double>")
    out = stages.embed(df, Config()).collect()
    big = sorted((r["img_id"], r["psi"]) for r in out if r["prd"] == 0 and r["kept"])
    rank = lambda v: np.argsort(np.argsort(v))
    assert abs(np.corrcoef(rank([p[0] for _, p in big]), rank(t[[i for i, _ in big]]))[0, 1]) > 0.95
    assert [r["kept"] for r in out if r["prd"] == 1] == [False] * 3
    assert stages.embed(df, Config(high=10)).where("prd = 0").count() == 10


MEASURES = "edge int, src int, dst int, psi_a int, psi_b int, sense int, dist double"


def _ids(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "prd int")


def _anchors(spark, at):
    return spark.createDataFrame(list(at.items()), "prd int, state int")


def test_labels_follow_the_anchor(spark):
    rows = [(e, a, b, i, j, s, 0.0 if i == j and s == 1 else 1.0) for e, (a, b) in enumerate([(0, 1), (1, 2)]) for i in range(2) for j in range(2) for s in (1, -1)]
    out = stages.label_nodes(spark.createDataFrame(rows, MEASURES), _ids(spark, 0, 1, 2), _anchors(spark, {0: 1}), 2, Config()).collect()
    assert {(r["prd"], r["psi"], r["sense"]) for r in out} == {(0, 1, 1), (1, 1, 1), (2, 1, 1)}


def test_labels_by_hand_and_trash(spark):
    m = spark.createDataFrame([(0, 0, 1, 0, 0, 1, 0.0), (1, 1, 2, 0, 0, 1, 0.0)], MEASURES)
    out = stages.label_nodes(m, _ids(spark, 0, 1, 2), _anchors(spark, {0: 3, 1: 0, 2: 1}), 2, Config(), trash=_ids(spark, 2)).collect()
    assert {(r["prd"], r["psi"], r["sense"], r["belief"]) for r in out} == {(0, 1, -1, 1.0), (1, 0, 1, 1.0)}
    assert {r["prd"] for r in stages.label_nodes(m, _ids(spark, 0, 1, 2), _anchors(spark, {0: 0}), 2, Config(), trash=_ids(spark, 1)).collect()} == {0, 2}


def _random_graph(spark, rng, edges, n, psis):
    s = 2 * psis
    node = rng.normal(size=(n, s))
    pot = rng.normal(size=(len(edges), s, s)) * 0.7
    nodes = spark.createDataFrame([(i, node[i].tolist()) for i in range(n)], "id int, pot array<double>")
    table = spark.createDataFrame([(k, a, b, pot[k].ravel().tolist()) for k, (a, b) in enumerate(edges)], "edge int, src int, dst int, pot array<double>")
    return node, pot, nodes, table


def test_messages_equal_the_sequential_schedule(spark):
    rng = np.random.default_rng(5)
    trees = [[(0, 1), (1, 2), (1, 3), (4, 3)]]
    loops = [[(i, (i + 1) % 6) for i in range(6)] + [(0, 3), (2, 6)]]
    for edges, damping in [(t, 1.0) for t in trees] + [(x, 0.5) for x in loops]:
        n = max(max(e) for e in edges) + 2  # one node stands alone
        node, pot, nodes, table = _random_graph(spark, rng, edges, n, 2)
        for largest in (False, True) if damping == 1.0 else (False,):
            want, pairs, _ = mrf.propagate(node, np.array(edges), pot, tolerance=1e-10, rounds=500, max_product=largest)
            held, used = messages.propagate(nodes, table, 4, 1e-6, 60, damping, largest)
            got = {r["id"]: r["belief"] for r in messages.beliefs(nodes, held, 4).collect()}
            assert used < 60 and np.allclose([got[i] for i in range(n)], want, atol=1e-5)
            joint = {r["edge"]: r["belief"] for r in messages.edge_beliefs(nodes, held, 4).collect()}
            assert np.allclose([joint[k] for k in range(len(edges))], pairs.reshape(len(edges), -1), atol=1e-5)
            state = want.argmax(1)
            assert {(r["id"], r["psi"], r["sense"]) for r in messages.decode(messages.beliefs(nodes, held, 4), 2).collect()} == {(i, int(k % 2), 1 if k < 2 else -1) for i, k in enumerate(state)}


def test_potentials_equal_the_kernel(spark):
    rng = np.random.default_rng(6)
    v = rng.random((2, 2, 4)) * 60
    rows = [(e, e, e + 1, i, j % 2, 1 if j < 2 else -1, float(v[e, i, j])) for e in range(2) for i in range(2) for j in range(4)]
    node, edge = mrf.potentials(3, {0: 3}, dict(enumerate(v)), 2, 2, bad={(1, 1)})
    got = messages.edge_potentials(spark.createDataFrame(rows, "edge int, src int, dst int, psi_a int, psi_b int, sense int, v double"), 2)
    assert all(np.allclose(r["pot"], edge[r["edge"]].ravel()) for r in got.collect()) and got.count() == 2
    ids = spark.createDataFrame([(0,), (1,), (2,)], "id int")
    pots = messages.node_potentials(ids, 2, spark.createDataFrame([(0, 3)], "id int, state int"), spark.createDataFrame([(1, 1)], "id int, psi int"))
    assert all(np.allclose(r["pot"], node[r["id"]]) for r in pots.collect()) and pots.count() == 3


def test_messages_of_an_empty_graph(spark):
    nodes = spark.createDataFrame([(4, [0.0, 1.0])], "id int, pot array<double>")
    none = spark.createDataFrame([], "edge int, src int, dst int, pot array<double>")
    held, used = messages.propagate(nodes, none, 2)
    out = messages.beliefs(nodes, held, 2).collect()
    assert used == messages.CHECKED and len(out) == 1 and abs(sum(out[0]["belief"]) - 1) < 1e-12


def test_laplacian_is_symmetric_with_unit_top_value(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(0, i, rng.random(3).tolist()) for i in range(12)], "prd int, img_id long, px array<double>")
    w = np.zeros((12, 12))
    for r in distances.laplacian(distances.full_matrix(distances.pair_distances(df), df), 0.5).collect():
        w[r["i"], r["j"]] = r["w"]
    assert np.allclose(w, w.T) and abs(np.linalg.eigvalsh(w).max() - 1) < 1e-9


def test_components_of_a_path_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 100 + (i + 1) % 9) for i in range(9)]
    nodes = spark.createDataFrame([(i,) for i in [*range(61), *range(100, 109), 500]], "id long")
    out = {r["id"]: r["component"] for r in graphs.components(nodes, spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(out[i] == 0 for i in range(61)) and all(out[i] == 100 for i in range(100, 109)) and out[500] == 500
    level = {r["id"]: r["level"] for r in graphs.search_levels(nodes, spark.createDataFrame(edges, "src long, dst long"), nodes.where("id = 0")).collect()}
    assert level[60] == 60 and level[104] is None


def test_matching_is_monotone_and_clamped(spark):
    rng = np.random.default_rng(2)
    cdf = lambda v: sequences.ecdf(spark.createDataFrame([(0, float(x)) for x in np.round(v, 2)], "k int, value double"), "value", ["k"]).select("value", "q")
    a, b = rng.normal(0, 1, 200), rng.normal(5, 2, 100)
    out = sequences.match_histograms(cdf(a), cdf(b)).orderBy("value").collect()
    m = [r["matched"] for r in out]
    assert m == sorted(m) and m[-1] == np.round(b, 2).max() and m[0] >= np.round(b, 2).min()
    v, c = np.unique(np.round(a, 2), return_counts=True)
    w, d = np.unique(np.round(b, 2), return_counts=True)
    assert np.allclose(m, np.interp(np.cumsum(c) / 200, np.cumsum(d) / 100, w)) and len(v) == len(m)


def test_quartiles_equal_sorted_ranks(spark):
    import numpy as np

    from sphaera.operators.thresholds import quartiles

    rng = np.random.default_rng(3)
    for values in ([2.5], [1.0, 4.0], [7.0] * 40 + [1.0, 9.0], rng.normal(size=997).round(2).tolist()):
        df = spark.createDataFrame([(x,) for x in [*values, None]], "x double").repartition(5)
        got = quartiles(df, "x").collect()
        assert len(got) == 1
        assert np.allclose([got[0]["q1"], got[0]["q3"]], np.quantile(values, [0.25, 0.75]), rtol=0, atol=1e-12)
    empty = quartiles(spark.createDataFrame([(None,)], "x double"), "x").collect()
    assert [tuple(r) for r in empty] == [(None, None)]
