"""Pairwise distances within groups and the kernel built on them, as long tables (group, i, j, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def pair_distances(rows: DataFrame, key: str = "prd", id_col: str = "img_id", px: str = "px") -> DataFrame:
    """key, i, j, d2 for i < j: an equi-join on the group, so a group of n gives n (n-1) / 2 rows; callers cap the groups."""
    a = rows.select(key, F.col(id_col).alias("i"), F.col(px).alias("a"))
    b = rows.select(key, F.col(id_col).alias("j"), F.col(px).alias("b"))
    return a.join(b, key).where("i < j").select(key, "i", "j", squared_distance(F.col("a"), F.col("b")).alias("d2"))


def full_matrix(pairs: DataFrame, rows: DataFrame, key: str = "prd", id_col: str = "img_id") -> DataFrame:
    """Both triangles, turned in one pass over the pairs, and the zero diagonal of the rows."""
    both = F.explode(F.array(F.struct(F.col("i").alias("i"), F.col("j").alias("j")), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    sides = pairs.select(key, both.alias("e"), "d2").select(key, "e.i", "e.j", "d2")
    return sides.unionByName(rows.select(key, F.col(id_col).alias("i"), F.col(id_col).alias("j"), F.lit(0.0).alias("d2")))


def nearest(matrix: DataFrame, k: int, key: str = "prd") -> DataFrame:
    """The k nearest of every row, itself first, ties by id."""
    w = Window.partitionBy(key, "i").orderBy((F.col("i") != F.col("j")).cast("int"), "d2", "j")
    return matrix.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def symmetrise(graph: DataFrame, key: str = "prd") -> DataFrame:
    """Union of a directed graph and its reverse, every edge once."""
    both = graph.select(key, "i", "j", "d2").union(graph.select(key, F.col("j"), F.col("i"), "d2"))
    return both.groupBy(key, "i", "j").agg(F.max("d2").alias("d2"))


def _normalised(m: DataFrame, key: str, power: Column) -> DataFrame:
    degree = m.groupBy(key, "i").agg(F.sum("w").alias("deg"))
    d = power
    return m.join(degree.select(key, "i", d.alias("di")), [key, "i"]).join(degree.select(key, F.col("i").alias("j"), d.alias("dj")), [key, "j"]).select(key, "i", "j", (F.col("w") / (F.col("di") * F.col("dj"))).alias("w"))


def laplacian(matrix: DataFrame, sigma: Column | float, alpha: float = 1.0, key: str = "prd") -> DataFrame:
    """Gaussian kernel, density normalisation of power alpha, then symmetric degree normalisation: key, i, j, w."""
    s = sigma if isinstance(sigma, Column) else F.lit(sigma)
    w = matrix.select(key, "i", "j", F.exp(-F.col("d2") / (s * s)).alias("w"))
    once = _normalised(w, key, F.col("deg") if alpha == 1.0 else F.pow("deg", F.lit(alpha)))
    return _normalised(once, key, F.sqrt("deg"))


def kernel_sums(matrix: DataFrame, log_eps: DataFrame, key: str = "prd") -> DataFrame:
    """log of sum exp(-d2 / 2 eps) per group over a small table of log bandwidths."""
    met = matrix.crossJoin(F.broadcast(log_eps))  # a grid of fixed size
    return met.groupBy(key, "log_eps").agg(F.log(F.sum(F.exp(-F.col("d2") / (2 * F.exp("log_eps"))))).alias("log_sum"))


def delay_distances(ordered: DataFrame, window: int, key: str = "prd") -> DataFrame:
    """Sum of d2 over `window` steps along each diagonal of a matrix in rank order (key, i, j, d2), full windows only."""
    w = Window.partitionBy(key, F.col("j") - F.col("i")).orderBy("i").rowsBetween(0, window - 1)
    return ordered.withColumn("con", F.sum("d2").over(w)).withColumn("len", F.count(F.lit(1)).over(w)).where(F.col("len") == window).select(key, "i", "j", F.col("con").alias("d2"))
