"""Incremental occupancy and energy over a stream of coordinates: the counts are sums, so they update in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sphaera.operators.sequences import energy, equal_bin


def windowed_occupancy(events: DataFrame, low: float, high: float, n: int = 50, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts per time window and bin of a stream (ts, value) whose value range is known; late rows are dropped."""
    tau = F.greatest(F.least((F.col("value") - low) / (high - low), F.lit(1.0)), F.lit(0.0))
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), equal_bin(tau, n).alias("bin")).agg(F.count(F.lit(1)).alias("occupancy"))


def running_occupancy(events: DataFrame, low: float, high: float, n: int = 50) -> DataFrame:
    """Counts per bin over all of a stream (complete or update mode)."""
    tau = F.greatest(F.least((F.col("value") - low) / (high - low), F.lit(1.0)), F.lit(0.0))
    return events.groupBy(equal_bin(tau, n).alias("bin")).agg(F.count(F.lit(1)).alias("occupancy"))


def energy_of(counts: DataFrame, kt: float) -> DataFrame:
    """Energy of the current counts, for use in foreachBatch or on a result table."""
    return energy(counts, kt)
