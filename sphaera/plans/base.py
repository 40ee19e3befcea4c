"""Inputs that the registered queries share, as DataFrames and as the same thing in oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sphaera.operators.tessellation import sphere_points

K = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column, digits: int = 6) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img_id, prd, px (64 pixels of an 8 x 8 image, row by row), unit quaternion q0..q3 and defocus df."""
    e = table(spark, sf_dir, "embeddings")
    px = F.transform("embedding", lambda x: x.cast("double"))
    q = [F.element_at("px", k) for k in range(1, 5)]
    n = F.sqrt(sum((x * x for x in q[1:]), q[0] * q[0]))
    out = e.select(F.col("vec_id").alias("img_id"), F.col("label").alias("prd"), px.alias("px"))
    return out.withColumn("qn", n).select("img_id", "prd", "px", *((x / F.col("qn")).alias(f"q{k}") for k, x in enumerate(q)), (10000 + 100 * (F.col("img_id") % 50)).cast("double").alias("df"))


def quaternion() -> tuple[Column, Column, Column, Column]:
    return F.col("q0"), F.col("q1"), F.col("q2"), F.col("q3")


def points_values() -> str:
    return ", ".join(f"({i}, {x!r}::DOUBLE, {y!r}::DOUBLE, {z!r}::DOUBLE)" for i, (x, y, z) in enumerate(sphere_points(K).tolist()))


#: snap(img_id, prd, px, q0..q3, df), dirs(img_id, sx, sy, sz, conj) of originals and twins, centres(bin, x, y, z).
SNAP = """snap0 AS (SELECT vec_id AS img_id, label AS prd, list_transform(embedding, lambda x: x::DOUBLE) AS px FROM embeddings),
snap1 AS (SELECT *, sqrt(px[1]*px[1]+px[2]*px[2]+px[3]*px[3]+px[4]*px[4]) AS qn FROM snap0),
snap AS (SELECT img_id, prd, px, px[1]/qn AS q0, px[2]/qn AS q1, px[3]/qn AS q2, px[4]/qn AS q3, (10000+100*(img_id % 50))::DOUBLE AS df FROM snap1)"""
TWINS = SNAP + """,
nn AS (SELECT count(*) AS n FROM snap),
twin AS (SELECT img_id, prd, q0, q1, q2, q3, df, false AS conj FROM snap UNION ALL SELECT img_id+(SELECT n FROM nn), prd, -q1, q0, -q3, q2, df, true FROM snap),
dirs AS (SELECT *, 2*(q1*q3-q0*q2) AS sx, 2*(q0*q1+q2*q3) AS sy, 2*(q0*q0+q3*q3-0.5) AS sz FROM twin)"""
CENTRES = TWINS + f""",
centres(bin, x, y, z) AS (VALUES {points_values()}),
member AS (SELECT img_id, arg_min(bin, (d, bin)) AS bin FROM (SELECT img_id, bin, (sx-x)*(sx-x)+(sy-y)*(sy-y)+(sz-z)*(sz-z) AS d FROM dirs, centres) GROUP BY img_id)"""
