import numpy as np

from sphaera.operators.thresholds import group_quantiles, tau_quality


def test_equal_to_numpy_with_a_hot_group_ties_and_nulls(spark):
    rng = np.random.default_rng(4)
    sizes = [("hot", 1, 3000), ("a", 1, 2), ("a", 2, 1), (None, 1, 40), ("b", None, 7)]
    rows = [(k, u, float(x)) for k, u, n in sizes for x in np.round(rng.normal(size=n), 1)]
    rows += [("a", 2, None), ("none", 1, None), ("none", 1, None)]
    df = spark.createDataFrame(rows, "k string, u int, v double").repartition(7)
    shares = {"low": 0.0, "q1": 0.25, "mid": 0.5, "top": 0.95, "high": 1.0}
    got = {(r["k"], r["u"]): r for r in group_quantiles(df, "v", ["k", "u"], shares).collect()}
    assert len(got) == len(sizes) + 1
    for k, u, _ in sizes:
        own = np.array([v for a, b, v in rows if (a, b) == (k, u) and v is not None])
        assert np.allclose([got[k, u][s] for s in shares], np.quantile(own, list(shares.values())))
        assert (got[k, u]["lo"], got[k, u]["hi"]) == (own.min(), own.max())
    assert all(got["none", 1][s] is None for s in (*shares, "lo", "hi"))
    assert group_quantiles(df.where("false"), "v", ["k", "u"], shares).count() == 0
    q = {r["k"]: r for r in tau_quality(df.where("u = 1 AND k IS NOT NULL"), "v", ["k", "u"]).collect()}
    assert q["none"]["bad"] and not q["hot"]["bad"]


def test_rounded_as_in_sql(spark):
    import duckdb

    rng = np.random.default_rng(8)
    rows = [(int(k), float(x)) for k in range(200) for x in rng.random(6) * 100] + [(900, 0.1)] * 6 + [(901, float("inf"))] * 3
    df = spark.createDataFrame(rows, "k int, v double").repartition(3)
    got = {r["k"]: (r["q1"], r["q3"]) for r in group_quantiles(df, "v", ["k"], {"q1": 0.25, "q3": 0.75}).collect()}
    values = ", ".join(f"({k}, '{v!r}'::DOUBLE)" for k, v in rows)
    want = {k: (a, b) for k, a, b in duckdb.sql(f"SELECT k, quantile_cont(v, 0.25), quantile_cont(v, 0.75) FROM (VALUES {values}) t(k, v) GROUP BY k").fetchall()}
    assert got == want  # to the last bit: cut-offs are compared with <
