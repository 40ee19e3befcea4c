"""Ordered-sequence operators: ranks, sliding and overlapping windows, pooled histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def equal_bin(tau: Column, n: int) -> Column:
    """Bin of a value in [0, 1]; the last bin is closed."""
    return F.least(F.floor(tau * n), F.lit(n - 1)).cast("int")


def histogram(rows: DataFrame, tau: str, n: int) -> DataFrame:
    """bin, occupancy for all n bins.  Partial counts per task, so the exchange carries n rows of each task."""
    counts = rows.where(F.col(tau).isNotNull()).groupBy(equal_bin(F.col(tau), n).alias("bin")).agg(F.count(F.lit(1)).alias("occupancy"))
    bins = rows.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    return bins.join(counts, "bin", "left").fillna(0, ["occupancy"])


def energy(counts: DataFrame, kt: float) -> DataFrame:
    """-kT log of the occupancy (at least 1), least value 0."""
    e = -F.lit(kt) * F.log(F.greatest(F.col("occupancy"), F.lit(1)).cast("double"))
    low = counts.agg(F.min(e).alias("low"))
    return counts.crossJoin(F.broadcast(low)).select("bin", "occupancy", (e - F.col("low")).alias("energy"))  # low: one row


def overlapping_bins(tau: Column, n: int, width: int) -> Column:
    """All bins b of 0..n-width that hold tau, [b/n, (b+width)/n); the last one is closed."""
    k = equal_bin(tau, n)
    return F.sequence(F.greatest(k - (width - 1), F.lit(0)), F.least(k, F.lit(n - width)))


def ranked(rows: DataFrame, key: str, order: list[str | Column], name: str = "rn") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def trimmed(rows: DataFrame, key: str, window: int, rn: str = "rn") -> DataFrame:
    """Without the first window - 1 and the last window rows of each ordered group."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return rows.withColumn("_n", n).where((F.col(rn) > window - 1) & (F.col(rn) <= F.col("_n") - window)).drop("_n")


def ecdf(rows: DataFrame, value: str, key: list[str]) -> DataFrame:
    """key, value, q: the share of rows at most value, one row per distinct value."""
    n = rows.groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy(*key).orderBy(value)
    return n.select(*key, value, (F.sum("n").over(run) / F.sum("n").over(Window.partitionBy(*key))).alias("q"))


def match_histograms(source: DataFrame, template: DataFrame, slices: int = 256) -> DataFrame:
    """value, matched: each source quantile's value in the template, linear between its steps, clamped at its ends.

    source and template: value, q (see ecdf).  The bracket of every quantile comes from a window over both tables in one
    slice of the quantile, or, where the slice ends first, from the nearest slices' ends (a row per slice).  So nothing is
    joined by inequality and no task sees more than a slice.
    """
    at = F.least(F.floor(F.col("q") * slices), F.lit(slices - 1)).cast("int").alias("slice")
    none = F.lit(None).cast("double")
    s = source.select("q", at, F.col("value").alias("sv"), none.alias("tq"), none.alias("tv"))
    t = template.select("q", at, none.alias("sv"), F.col("q").alias("tq"), F.col("value").alias("tv"))
    step = F.when(F.col("tq").isNotNull(), F.struct("tq", "tv"))
    ends = source.sparkSession.range(slices).select(F.col("id").cast("int").alias("slice")).join(t.groupBy("slice").agg(F.max(step).alias("top"), F.min(step).alias("low")), "slice", "left")
    over = Window.orderBy("slice")
    carry = ends.select("slice", F.max("top").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.min("low").over(over.rowsBetween(1, Window.unboundedFollowing)).alias("behind"))
    own = Window.partitionBy("slice").orderBy("q")
    b = s.unionByName(t).select("slice", "q", "sv", F.max(step).over(own.rangeBetween(Window.unboundedPreceding, 0)).alias("lo"), F.min(step).over(own.rangeBetween(0, Window.unboundedFollowing)).alias("hi")).where("sv IS NOT NULL")
    b = b.join(F.broadcast(carry), "slice").select("q", "sv", F.coalesce("lo", "before").alias("lo"), F.coalesce("hi", "behind").alias("hi"))  # a row per slice
    lo, hi = F.col("lo"), F.col("hi")
    part = lo["tv"] + (hi["tv"] - lo["tv"]) * (F.col("q") - lo["tq"]) / (hi["tq"] - lo["tq"])
    return b.select(F.col("sv").alias("value"), F.when(lo.isNull(), hi["tv"]).when(hi.isNull() | (hi["tq"] == lo["tq"]), lo["tv"]).otherwise(part).alias("matched"))
