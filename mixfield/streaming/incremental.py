"""Sufficient statistics of a stream of observations.

They are sums, so a streaming aggregation keeps them; the design is a static table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import masking


def running_products(stream: DataFrame, design: DataFrame, p: int, thresh: float | None = None) -> DataFrame:
    """voxel_id, n, yty, xty_i, xtx_ij, updated as observations arrive."""
    rows = masking.usable(stream, thresh).join(design.select("obs_id", "x"), "obs_id")
    sums = [F.sum(F.col("x")[i] * F.col("y")).alias(f"xty_{i}") for i in range(p)]
    sums += [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"xtx_{i}{j}") for i in range(p) for j in range(p)]
    return rows.groupBy("voxel_id").agg(F.count("*").alias("n"), F.sum(F.col("y") * F.col("y")).alias("yty"), *sums)


def windowed_counts(stream: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Usable observations per voxel and time window, with a bound on lateness."""
    rows = masking.usable(stream).withWatermark(time, late)
    return rows.groupBy(F.window(time, width), "voxel_id").agg(F.count("*").alias("n"))
