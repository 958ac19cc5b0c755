"""Closed forms in columns: two-column least squares, residuals, starting variances.

All work on the arrays that products makes, inside code generation; no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def beta2(df: DataFrame) -> DataFrame:
    """Adds beta (two coefficients) from xtx (4) and xty (2); null if X'X is singular."""
    a, b, d = (F.col("xtx")[i] for i in (0, 1, 3))
    u, v = F.col("xty")[0], F.col("xty")[1]
    det = a * d - b * b
    return df.withColumn("beta", F.when(det != 0, F.array(F.try_divide(d * u - b * v, det), F.try_divide(a * v - b * u, det))))


def quadratic(v: Column, m: Column, p: int) -> Column:
    """v' M v for an array v and a row-by-row array M."""
    return sum((v[i] * v[j] * m[i * p + j] for i in range(p) for j in range(p)), F.lit(0.0))


def dot(a: Column, b: Column, p: int) -> Column:
    return sum((a[i] * b[i] for i in range(p)), F.lit(0.0))


def ssr(df: DataFrame, p: int) -> DataFrame:
    """Adds ssr = y'y - 2 b'X'y + b'X'X b."""
    return df.withColumn("ssr", F.col("yty") - 2 * dot(F.col("beta"), F.col("xty"), p) + quadratic(F.col("beta"), F.col("xtx"), p))


def sigma2(df: DataFrame) -> DataFrame:
    """Adds sigma2 = ssr / n."""
    return df.withColumn("sigma2", F.try_divide(F.col("ssr"), F.col("n")))


def resms(df: DataFrame, p: int) -> DataFrame:
    """Adds resms = ssr / (n - p)."""
    return df.withColumn("resms", F.try_divide(F.col("ssr"), F.col("n") - p))


def start_d(levels: DataFrame) -> DataFrame:
    """voxel_id, d: starting variance of one factor of one effect, from rows (voxel_id,
    sigma2, t = z'z, e = z'e) per level; negative ones are 0."""
    top = F.sum(F.col("e") * F.col("e") / F.col("sigma2") - F.col("t"))
    return levels.groupBy("voxel_id").agg(F.greatest(F.try_divide(top, F.sum(F.col("t") * F.col("t"))), F.lit(0.0)).alias("d"))
