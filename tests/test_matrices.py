"""The matrix queries: whole groups, no exchange of pairs, odd rows as in SQL."""

import re

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sphaera import registry
from sphaera.operators import tiles

MATRICES = "delay_distance diffusion_laplacian order_along_psi pair_distance reduced_distance_matrix sub_matrix stage_ctf_distances".split()
SUMS = "kernel_threshold kernel_bandwidth_sums".split()


def written(folder, images, labels):
    pq.write_table(pa.table({"vec_id": pa.array(range(len(images)), pa.int64()), "embedding": pa.array(images, pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())}), f"{folder}/embeddings.parquet")
    return str(folder)


def vectors(n, seed=0):
    return list((np.random.default_rng(seed).normal(size=(n, 64)) * 0.2).astype(np.float32))


def equal_to_sql(spark, name, folder):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    df = registry.QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    theirs = duck.sql(registry.ORACLE_SQL[name]).select(*cols).fetchall()
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, theirs)) and theirs


@pytest.mark.parametrize("name", MATRICES + SUMS)
def test_pairs_pass_no_exchange(spark, tmp_path, name):
    """What is made of pairs within a tile is a result, or a few numbers a row."""
    df = registry.QUERIES[name](spark, written(tmp_path, vectors(40), [k % 2 for k in range(40)]))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    made = plan[: plan.index("MapInArrow")] if "MapInArrow" in plan else plan
    if name in SUMS:  # their first exchange carries sums, made inside the tiles
        assert re.search(r"MapInArrow", plan)
        assert not re.search(r"Generate|Expand", made)
    else:
        assert not re.search(r"Join|Window|Aggregate|Repartition|Generate|Sort", made)


@pytest.mark.parametrize("name", ["delay_distance", "order_along_psi"])
def test_rows_without_image_or_group(spark, tmp_path, name):
    images, labels = vectors(14, 1), [1] * 8 + [2] * 6
    images[3] = images[9] = None
    labels[5] = labels[6] = None
    images[10] = images[11]
    equal_to_sql(spark, name, written(tmp_path, images, labels))


def test_windows_across_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(37, 5))
    rows = spark.createDataFrame([(7, int(k), v.tolist()) for k, v in enumerate(x)], "prd int, img_id long, px array<double>").repartition(3)
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    for size, window in ((2, 4), (10, 4), (64, 3)):
        held = tiles.blocks(rows, None, size, halo=window - 1)
        got = {(r["i"], r["j"]): r["d2"] for r in tiles.matrix_rows(tiles.tiles(held), 5, window=window).collect()}
        want = {(i, j): sum(d2[i + k, j + k] for k in range(window)) for i in range(37 - window + 1) for j in range(37 - window + 1)}
        assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-5 for k, v in want.items())


def test_a_row_goes_to_a_bounded_number_of_tiles(spark):
    """Blocks grow with their group, so what an exchange carries grows as the rows do."""
    for n in (4_000, 16_000):
        rows = spark.range(n).selectExpr("0 AS prd", "id AS img_id", "array(id / 3.0D, 1.5D, -id * 1.0D, 0.25D) AS px")
        moved = tiles.tiles(tiles.blocks(rows, None)).selectExpr("sum(length(a_f) + length(b_f)) AS n").first()["n"]
        assert moved <= (tiles.PARTS + 1) * n * 4 * 8


def test_rounding_is_that_of_plain_sums():
    rng = np.random.default_rng(6)
    x = rng.integers(-8, 8, (60, 64)) / 2000  # many sums lie half-way between two roundings
    row = {"prd": 1, "a": 0, "b": 0, **{f"{s}_{k}": v for s in "ab" for k, v in {"ids": range(60), "own": 60, "pixels": 64, "f": x.tobytes(), "have": b"", "c": b""}.items()}}
    t = tiles.Tile(row)
    plain = np.zeros((60, 60))
    for k in range(64):
        plain += (x[:, k][:, None] - x[:, k]) ** 2
    assert t.close and (t.rounded(slice(0, 60), 6) == tiles.rounded(plain, 6)).all()
    assert (tiles.rounded(np.array([0.5, 1.5, 2.5, 0.49999999999999994]), 0) == [1, 2, 3, 0]).all()


def test_neighbour_tiles_with_ties(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 3, (50, 2)).astype(float)
    rows = [(g, 100 * g + i, v.tolist()) for g in (1, 2) for i, v in enumerate(x[: 50 if g == 1 else 3])]
    df = spark.createDataFrame(rows, "prd int, img_id long, px array<double>").repartition(3)
    for size in (7, 64):
        held = tiles.blocks(df, None, size)
        ids = {(r["prd"], r["block"]): r["ids"] for r in held.collect()}
        got = {}
        for r in tiles.neighbour_tiles(held, 6).collect():
            a, b = ids[r["prd"], r["a"]], ids[r["prd"], r["b"]]
            assert (r["na"], r["nb"]) == (len(a), len(b)) and r["a"] <= r["b"]
            for at, d in zip(np.frombuffer(r["at"], np.uint32), np.frombuffer(r["d2"]), strict=True):
                i, j = a[at // len(b)], b[at % len(b)]
                assert (i, j) not in got
                got[i, j] = d
                if r["a"] != r["b"]:  # a block with itself has both
                    got[j, i] = d
        want = {}
        for g in (1, 2):
            own = [(i, np.array(v)) for h, i, v in rows if h == g]
            for i, v in own:
                for _, d, j in sorted((j != i, ((v - w) ** 2).sum(), j) for j, w in own)[:6]:
                    want[i, j] = want[j, i] = d
        assert got == want


def test_sparse_products_equal_dense_ones(monkeypatch):
    from sphaera.operators import spectrum

    rng = np.random.default_rng(9)
    at = np.sort(rng.choice(30 * 20, 90, replace=False)).astype(np.uint32)
    r = {"a": 1, "b": 2, "na": 30, "nb": 20, "at": at.tobytes(), "w": rng.normal(size=90).tobytes(), "xa": rng.normal(size=(30, 4)).tobytes(), "xb": rng.normal(size=(20, 4)).tobytes()}
    dense = spectrum._products(r)
    monkeypatch.setattr(spectrum, "DENSE", 10)
    for (p, x), (q, y) in zip(dense, spectrum._products(r), strict=True):
        assert p == q and np.allclose(x, y, atol=1e-12)


def test_rounds_leave_no_exchange_behind(spark):
    import time

    from sphaera.operators.graphs import CLEANUP, Rounds

    blocks = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").count("shuffle_")
    was, kept = blocks(), spark.conf.get(CLEANUP)
    rounds = Rounds(spark.range(1), "test")
    for n in range(3):
        rounds.keep(spark.range(1000).repartition(3, "id").groupBy("id").count(), f"t{n}")
    for _ in range(50):
        if blocks() <= was:
            break
        time.sleep(0.1)
    assert blocks() <= was and spark.conf.get(CLEANUP) == kept
