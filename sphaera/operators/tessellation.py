"""Sphere tessellation and binning of directions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tables of centres up to so many rows are broadcast; above, centres and rows meet by grid cell.
BROADCAST_CENTRES = 5_000


def sphere_points(k: int, rounds: int = 100) -> np.ndarray:
    """About k nearly uniform points: rings of equal latitude step, each with steps of equal arc.

    The step is rescaled until the rings hold k points.  Where that never happens the last layout is cut to k points,
    and it may hold fewer (no made-up zero rows are added).
    """
    step = math.sqrt(4 * math.pi / k)
    for _ in range(rounds):
        rings = np.arange(0.5 * step, math.pi, step)
        parts = []
        for w in rings:
            arc = step / math.sin(w)
            turn = np.arange(0.5 * arc, 2 * math.pi, arc)
            parts.append(np.stack([np.full(len(turn), math.cos(w)), math.sin(w) * np.cos(turn), math.sin(w) * np.sin(turn)], 1))
        points = np.concatenate(parts)
        if len(points) == k:
            break
        step *= math.sqrt(len(points) / k)
    return points[:k]


def centres(spark: SparkSession, k: int) -> DataFrame:
    """bin, x, y, z of the tessellation."""
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(sphere_points(k))], "bin int, x double, y double, z double")


def _square(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return sum(((p - q) * (p - q) for p, q in zip(a, b, strict=True)), F.lit(0.0))


def assign(rows: DataFrame, bins: DataFrame, k: int, id_col: str = "img_id") -> DataFrame:
    """id, bin of the nearest centre (ties: the lowest bin).  rows: id, sx, sy, sz; bins: bin, x, y, z; k: number of bins.

    The nearest centre is found per row from one array of all centres while that array is small; beyond that, rows and
    centres meet by cell of a cubic grid wider than the covering radius, an equi-join of bounded fan-out.
    """
    mine = (F.col("sx"), F.col("sy"), F.col("sz"))
    if k <= BROADCAST_CENTRES:
        packed = bins.agg(F.array_sort(F.collect_list(F.struct("bin", "x", "y", "z"))).alias("all"))
        near = F.array_min(F.transform("all", lambda c: F.struct(_square(mine, (c["x"], c["y"], c["z"])).alias("d"), c["bin"].alias("bin"))))
        return rows.crossJoin(F.broadcast(packed)).select(id_col, near["bin"].alias("bin"))
    cell = 2.5 * math.sqrt(4 * math.pi / k)
    at = lambda c: F.floor(F.col(c) / cell)
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    spread = rows.select(id_col, "sx", "sy", "sz", (at("sx")).alias("cx"), at("sy").alias("cy"), at("sz").alias("cz"))
    for c in ("cx", "cy", "cz"):
        spread = spread.withColumn("step", around).withColumn(c, F.col(c) + F.col("step")).drop("step")
    grid = bins.select("bin", "x", "y", "z", at("x").alias("cx"), at("y").alias("cy"), at("z").alias("cz"))
    met = spread.join(grid, ["cx", "cy", "cz"])
    best = F.min(F.struct(_square(mine, (F.col("x"), F.col("y"), F.col("z"))).alias("d"), F.col("bin").alias("bin")))
    return met.groupBy(id_col).agg(best.alias("best")).select(id_col, F.col("best.bin").alias("bin"))


def occupancy(members: DataFrame, bins: DataFrame) -> DataFrame:
    """bin, n for every bin, empty ones included."""
    return bins.select("bin").join(members.groupBy("bin").agg(F.count(F.lit(1)).alias("n")), "bin", "left").fillna(0, ["n"])


def chosen_half(counts: DataFrame, k: int) -> Column:
    """The predicate of the reported hemisphere: the lower half of the bins if it is not the shorter, by full counts.

    With counts of full length the lower half wins for an even k, the upper one for an odd k.
    """
    mid = k // 2
    return (F.col("bin") < mid) if mid >= k - mid else (F.col("bin") >= mid)


def threshold_bins(counts: DataFrame, k: int, low: int) -> DataFrame:
    """Bins of the chosen half with at least low members, numbered from 0: bin, n, prd."""
    kept = counts.where(chosen_half(counts, k) & (F.col("n") >= low))
    return kept.withColumn("prd", (F.row_number().over(Window.orderBy("bin")) - 1).cast("int"))


def cap_members(members: DataFrame, high: int, key: str = "bin", id_col: str = "img_id") -> DataFrame:
    """The first `high` members of each group by id, with their rank from 0."""
    w = Window.partitionBy(key).orderBy(id_col)
    # the filter on the plain row number lets every task drop what is beyond it before the exchange
    first = members.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= high)
    return first.withColumn("rank", (F.col("rank") - 1).cast("int"))


def member_lists(members: DataFrame, key: str = "bin", id_col: str = "img_id") -> DataFrame:
    return members.groupBy(key).agg(F.sort_array(F.collect_list(id_col)).alias("members"))


def mean_directions(rows: DataFrame, key: str) -> DataFrame:
    """Mean direction per group: the sum of unit vectors, renormalised."""
    s = rows.groupBy(key).agg(*(F.sum(c).alias(c) for c in ("sx", "sy", "sz")))
    n = F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy") + F.col("sz") * F.col("sz"))
    return s.select(key, (F.col("sx") / n).alias("mx"), (F.col("sy") / n).alias("my"), (F.col("sz") / n).alias("mz"))


def best_partner_bins(members: DataFrame, n: int) -> DataFrame:
    """For each bin the other bin that shares most snapshots with it as twins: bin, partner, shared (ties: lowest bin)."""
    m = members.select("bin", F.pmod(F.col("img_id"), F.lit(n)).alias("base"))
    pairs = m.alias("a").join(m.alias("b"), F.col("a.base") == F.col("b.base")).where(F.col("a.bin") != F.col("b.bin"))
    counts = pairs.groupBy(F.col("a.bin").alias("bin"), F.col("b.bin").alias("partner")).agg(F.count(F.lit(1)).alias("shared"))
    return counts.groupBy("bin").agg(F.max(F.struct("shared", (-F.col("partner")).alias("p"))).alias("top")).select("bin", (-F.col("top.p")).cast("int").alias("partner"), F.col("top.shared").alias("shared"))


def nearest_direction(bins: DataFrame, phi: Column, theta: Column) -> DataFrame:
    """The one bin nearest to a direction in degrees."""
    p, t = F.radians(phi), F.radians(theta)
    v = (F.sin(t) * F.cos(p), F.sin(t) * F.sin(p), F.cos(t))
    d = _square((F.col("x"), F.col("y"), F.col("z")), v)
    return bins.agg(F.min_by("bin", F.struct(d, "bin")).alias("bin"), F.sqrt(F.min(d)).alias("dist"))
