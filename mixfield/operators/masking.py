"""Masks, thresholds and missingness: which values and which voxels count.

A value that is 0, null or NaN is missing.  NaN is tested on its own, as it differs from 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(obs: DataFrame, thresh: float | None = None, data_mask: DataFrame | None = None, analysis_mask: DataFrame | None = None, only=None) -> DataFrame:
    """Values that count: times their own mask, not under ``thresh`` (of voxels for which
    ``only`` holds), in the analysis mask, and not missing."""
    if data_mask is not None:
        obs = obs.join(data_mask, ["obs_id", "voxel_id"]).withColumn("y", F.col("y") * F.col("m")).drop("m")
    if thresh is not None:
        low = F.col("y") < thresh
        obs = obs.where(~((low & only) if only is not None else low))
    if analysis_mask is not None:
        obs = obs.join(analysis_mask.select("voxel_id"), "voxel_id", "left_semi")
    return obs.where(F.col("y").isNotNull() & ~F.isnan("y") & (F.col("y") != 0) & (F.abs("y") != float("inf")))


def counts(obs: DataFrame) -> DataFrame:
    """voxel_id, n: observations of each voxel."""
    return obs.groupBy("voxel_id").agg(F.count("*").alias("n"))


def kept(n: DataFrame, total: int, p: int, q: int, min_percent: float | None = None, min_n: int | None = None, safe_mode: bool = True) -> DataFrame:
    """Voxels that hold enough observations, with edf = n - p and whether any is missing."""
    ok = F.col("n") > p + 1
    if min_percent is not None:
        ok &= F.col("n") >= min_percent * total
    if min_n is not None:
        ok &= F.col("n") >= min_n
    if safe_mode:
        ok &= F.col("n") > q
    return n.where(ok).select("voxel_id", "n", (F.col("n") < total).alias("is_ring"), (F.col("n") - p).alias("edf"))


def ranked(ids: DataFrame, column: str, width: int = 1 << 16) -> DataFrame:
    """``ids`` (distinct whole numbers in ``column``) with rank (from 0) and total.  Ranks are
    counted inside runs of ``width`` ids, in parallel, and shifted by the sizes of the runs
    before, of which there are few; no task sorts all ids."""
    rows = ids.withColumn("run", F.floor(F.col(column) / width))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("run").agg(F.count("*").alias("size"))
    runs = runs.select("run", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"), F.sum("size").over(Window.partitionBy()).alias("total"))
    own = F.row_number().over(Window.partitionBy("run").orderBy(column)) - 1
    return rows.join(runs, "run").withColumn("rank", F.col("shift") + own).drop("run", "shift")


def voxel_blocks(voxels: DataFrame, blocks: int, universe: int | None = None) -> DataFrame:
    """Block (from 1) of each voxel: nearly equal runs of voxel order, the first ones larger.

    With ``universe`` (voxel ids below it), runs of ids, for which no sort is needed."""
    if universe is not None:
        return voxels.withColumn("block", (F.floor(F.col("voxel_id") * F.lit(blocks) / F.lit(universe)) + 1).cast("int"))
    size, more = F.floor(F.col("total") / blocks), F.col("total") % blocks
    large = more * (size + 1)
    block = F.when(F.col("rank") < large, F.floor(F.col("rank") / (size + 1))).otherwise(more + F.floor((F.col("rank") - large) / F.greatest(size, F.lit(1))))
    return ranked(voxels, "voxel_id").withColumn("block", (block + 1).cast("int")).drop("rank", "total")


def block_count(voxels: int, levels: list[int], effects: list[int], p: int, max_memory: float, most: int | None = None) -> int:
    """Blocks in which voxels' sufficient statistics fit ``max_memory`` bytes, ``most`` at most."""
    q = sum(a * b for a, b in zip(levels, effects, strict=True))
    dense = q * q if len(levels) > 1 else sum(a * b * b for a, b in zip(levels, effects, strict=True))
    n = max(1, -(-voxels * 8 * (dense + q * (p + 1) + p * (p + 1) + 1) // int(max_memory)))
    return min(n, most, voxels or 1) if most else min(n, voxels or 1)
