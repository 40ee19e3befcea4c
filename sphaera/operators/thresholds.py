"""Data-driven thresholds on one column, and quality rules for coordinates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sphaera.operators.graphs import checkpoint_dir
from sphaera.operators.sequences import equal_bin


def tau_quality(rows: DataFrame, tau: str, key: list[str], bins: int = 50, low_iqr: float = 0.02, low_occupancy: float = 0.35) -> DataFrame:
    """key, iqr, occ (share of the bins of the group's own range that hold rows) and bad."""
    q = group_quantiles(rows, tau, key, {"q1": 0.25, "q3": 0.75})
    stats = q.select(*key, "lo", "hi", (F.col("q3") - F.col("q1")).alias("iqr"))
    unit = F.when(F.col("hi") > F.col("lo"), (F.col(tau) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)
    filled = rows.join(stats, key).groupBy(*key, "iqr").agg((F.count_distinct(equal_bin(unit, bins)) / bins).alias("occ"))
    return filled.withColumn("bad", (F.col("iqr") < low_iqr) | (F.col("occ") <= low_occupancy))


def otsu(counts: DataFrame, key: list[str]) -> DataFrame:
    """key, threshold: the bin after which the between-class variance is largest (ties: the first).  counts: key, bin, n."""
    run = Window.partitionBy(*key).orderBy("bin")
    whole = Window.partitionBy(*key)
    n, m = F.col("n").cast("double"), F.col("n") * F.col("bin").cast("double")
    c = counts.select(*key, "bin", F.sum(n).over(run).alias("w0"), F.sum(m).over(run).alias("m0"), F.sum(n).over(whole).alias("w"), F.sum(m).over(whole).alias("m"))
    w1 = F.col("w") - F.col("w0")
    gap = F.col("m0") / F.col("w0") - (F.col("m") - F.col("m0")) / w1
    between = F.when((F.col("w0") > 0) & (w1 > 0), F.col("w0") * w1 * gap * gap).otherwise(-1.0)
    best = c.withColumn("v", F.round(between, 6)).groupBy(*key).agg(F.max(F.struct("v", (-F.col("bin")).alias("b"))).alias("top"))
    return best.select(*key, (-F.col("top.b")).alias("threshold"))


def split_in_two(rows: DataFrame, value: str, key: list[str]) -> DataFrame:
    """key, threshold: the largest value of the lower class of the best split into two classes (exact 2-means in 1-D).

    Rows of equal value go together; a running sum over the sorted distinct values gives every split's within-class sum.
    """
    v = F.col(value)
    d = rows.groupBy(*key, v.alias("v")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    run, whole = Window.partitionBy(*key).orderBy("v"), Window.partitionBy(*key)
    n, s = F.col("n"), F.col("n") * F.col("v")
    c = d.select(*key, "v", F.sum(n).over(run).alias("n0"), F.sum(s).over(run).alias("s0"), F.sum(n).over(whole).alias("nn"), F.sum(s).over(whole).alias("ss"))
    n1 = F.col("nn") - F.col("n0")
    gain = F.when(n1 > 0, F.col("s0") * F.col("s0") / F.col("n0") + (F.col("ss") - F.col("s0")) * (F.col("ss") - F.col("s0")) / n1)
    return c.withColumn("gain", F.round(gain, 6)).where("gain IS NOT NULL").groupBy(*key).agg(F.min_by("v", F.struct(-F.col("gain"), "v")).alias("threshold"))


def winsorise(value: Column, q1: Column, q3: Column) -> Column:
    """Capped at the third quartile plus 1.5 interquartile ranges."""
    return F.least(value, q3 + 1.5 * (q3 - q1))


def quartiles(rows: DataFrame, value: str) -> DataFrame:
    """One row q1, q3 of a whole column, linear between ranks; nulls are left out, no values give nulls.

    Distinct values are counted, sorted over range partitions and checkpointed.  Running counts are taken only in the
    partitions that hold a wanted rank, four at most, so no task holds more than one partition.
    """
    checkpoint_dir(rows.sparkSession)
    v = F.col(value).cast("double")
    counts = rows.where(v.isNotNull()).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy("v").checkpoint()
    d = counts.withColumn("p", F.spark_partition_id())
    # a row per partition
    ends = d.groupBy("p").agg(F.sum("n").alias("m")).select("p", "m", F.sum("m").over(Window.orderBy("p")).alias("upto"), F.sum("m").over(Window.partitionBy()).alias("total"))
    places = [F.lit(share) * (F.col("total") - 1) for share in (0.25, 0.75)]
    wanted = F.array(*(f(x) for x in places for f in (F.floor, F.ceil)))
    held = ends.where(F.exists(wanted, lambda r: (r >= F.col("upto") - F.col("m")) & (r < F.col("upto"))))
    run = F.sum("n").over(Window.partitionBy("p").orderBy("v"))
    near = d.join(F.broadcast(held), "p").select("v", "total", (F.col("upto") - F.col("m") + run).alias("end"))  # four rows
    at = lambda rank: F.min(F.when(F.col("end") > rank, F.col("v")))
    return near.agg(*_ranks(at, dict(zip(("q1", "q3"), places, strict=True)))).select(_between("q1"), _between("q3"))


def _between(name: str) -> Column:
    """The value at `part` between neighbouring ranks from the columns that _ranks names.

    lo (1 - part) + hi part with the first product unrounded, as SQL's quantile_cont has it to the last bit: quantiles are
    compared with each other, and equal spreads of two-decimal values would fall to either side of a cut-off.
    """
    lo, hi, part = (F.col(f"_{name}_{c}") for c in ("lo", "hi", "part"))
    w, c = 1 - part, hi * part
    p = lo * w
    head = lambda x: x * 134217729 - (x * 134217729 - x)  # noqa: E731  26 bits of it
    lh, wh = head(lo), head(w)
    lost = ((lh * wh - p) + lh * (w - wh) + (lo - lh) * wh) + (lo - lh) * (w - wh)  # by rounding lo w
    s = p + c
    more = (p - (s - (s - p))) + (c - (s - p))  # by rounding the sum
    return F.when((part > 0) & (hi > lo), F.when(F.greatest(F.abs(lo), F.abs(hi)) < 1e290, s + (more + lost)).otherwise(s)).otherwise(lo).alias(name)


def _ranks(at: Callable[[Column], Column], places: dict[str, Column]) -> list[Column]:
    return [e.alias(f"_{name}_{c}") for name, x in places.items() for c, e in (("lo", at(F.floor(x))), ("hi", at(F.ceil(x))), ("part", F.max(x - F.floor(x))))]


def group_quantiles(rows: DataFrame, value: str, key: list[str], shares: dict[str, float]) -> DataFrame:
    """key, lo, hi and a column per share: exact quantiles of every group, linear between ranks.

    Nulls are left out, a group of nulls only has nulls; groups of null keys are groups; NaN is larger than all.  Distinct
    values are counted, sorted by (key, value) over range partitions and checkpointed, so a group of any size is spread; its
    pieces' counts, a row per partition at most, say which pieces hold a wanted rank, and running counts are taken only there.
    """
    checkpoint_dir(rows.sparkSession)
    v = F.col(value).cast("double")
    keys = [f"_k{i}" for i in range(len(key))]
    counts = rows.groupBy(*(F.col(c).alias(k) for c, k in zip(key, keys, strict=True)), v.alias("_v")).agg(F.count(v).alias("_n")).orderBy(*keys, "_v").checkpoint()
    d = counts.withColumn("_p", F.spark_partition_id())
    whole = Window.partitionBy(*keys)
    pieces = d.groupBy(*keys, "_p").agg(F.sum("_n").alias("_m"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    ends = pieces.select(*keys, "_p", "_m", F.sum("_m").over(whole.orderBy("_p")).alias("_upto"), F.sum("_m").over(whole).alias("_total"), F.min("_lo").over(whole).alias("lo"), F.max("_hi").over(whole).alias("hi"))
    places = {name: F.lit(share) * (F.col("_total") - 1) for name, share in shares.items()}
    wanted = F.array(*(f(x) for x in places.values() for f in (F.floor, F.ceil)))
    here = F.exists(wanted, lambda r: (r >= F.col("_upto") - F.col("_m")) & (r < F.col("_upto")))
    held = ends.where(here | (F.col("_total") == 0)).select("*", *(F.col(k).alias(f"{k}h") for k in keys)).drop(*keys).withColumnRenamed("_p", "_ph")
    met = d.join(held, [F.col("_p") == F.col("_ph"), *(F.col(k).eqNullSafe(F.col(f"{k}h")) for k in keys)])
    near = met.withColumn("_end", F.col("_upto") - F.col("_m") + F.sum("_n").over(Window.partitionBy(*keys, "_p").orderBy("_v")))
    at = lambda rank: F.min(F.when(F.col("_end") > rank, F.col("_v")))
    out = near.groupBy(*keys).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), *_ranks(at, places))
    return out.select(*(F.col(k).alias(c) for c, k in zip(key, keys, strict=True)), "lo", "hi", *(_between(name) for name in shares))


def rescale(rows: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Capped as above and mapped linearly onto [low, high], over all rows; the statistics are one row."""
    q = quartiles(rows, value)
    capped = rows.crossJoin(F.broadcast(q)).withColumn("_c", winsorise(F.col(value), F.col("q1"), F.col("q3"))).drop("q1", "q3")
    ends = capped.agg(F.min("_c").alias("_lo"), F.max("_c").alias("_hi"))
    return capped.crossJoin(F.broadcast(ends)).withColumn("scaled", F.when(F.col("_hi") > F.col("_lo"), low + (high - low) * (F.col("_c") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(low)).drop("_c", "_lo", "_hi")
