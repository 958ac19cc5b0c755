"""Sufficient statistics by partial and final aggregation, and missingness patterns.

Y products are sums per voxel.  Design products depend on the pattern of missing
observations only, so they are summed once per pattern, over the observations of the
pattern's first voxel, and joined back.  Zeros of Z'Z never appear: it is grouped by level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .masking import ranked


def _sums(columns: list[Column], name: str) -> Column:
    return F.array(*[F.sum(c) for c in columns]).alias(name)


def _outer(a: Column, n: int, b: Column, m: int) -> list[Column]:
    return [a[i] * b[j] for i in range(n) for j in range(m)]


def attached(obs: DataFrame, design: DataFrame, *columns: str) -> DataFrame:
    """``obs`` with columns of its design: its own where it carries them, else by a join."""
    if all(c in obs.columns for c in columns):
        return obs
    return obs.join(design.select("obs_id", *columns), "obs_id")


def y_products(obs: DataFrame, design: DataFrame, p: int) -> DataFrame:
    """voxel_id, n, xty, yty."""
    rows = attached(obs, design, "x")
    return rows.groupBy("voxel_id").agg(F.count("*").alias("n"), _sums([F.col("x")[i] * F.col("y") for i in range(p)], "xty"), F.sum(F.col("y") * F.col("y")).alias("yty"))


def zty(obs: DataFrame, design: DataFrame, k: int, q: int) -> DataFrame:
    """voxel_id, level, zty: of factor k (from 1)."""
    rows = attached(obs, design, f"f_{k}", f"z_{k}").withColumnsRenamed({f"f_{k}": "level", f"z_{k}": "z"})
    return rows.groupBy("voxel_id", "level").agg(_sums([F.col("z")[i] * F.col("y") for i in range(q)], "zty"))


def patterns(obs: DataFrame, numbered: bool = False) -> DataFrame:
    """voxel_id, n, pattern_id: voxels that lack the same observations share an id.

    A pattern is told by an order-free digest of its observations (count, sum and xor of
    hashes), of constant size however many there are.  Its id is its first voxel or, if
    ``numbered``, the rank of that among all (which sorts the distinct patterns once)."""
    h1, h2 = F.xxhash64("obs_id"), F.xxhash64("obs_id", F.lit("pattern"))
    own = obs.groupBy("voxel_id").agg(F.count("*").alias("n"), F.bit_xor(h1).alias("h1"), F.bit_xor(h2).alias("h2"), F.sum(F.shiftright(h2, 24)).alias("h3"))
    keys = ["n", "h1", "h2", "h3"]
    first = own.groupBy(*keys).agg(F.min("voxel_id").alias("first_voxel"))
    if not numbered:
        return own.join(first, keys).select("voxel_id", "n", F.col("first_voxel").alias("pattern_id"), "first_voxel")
    ids = ranked(first.select("first_voxel"), "first_voxel").select("first_voxel", (F.col("rank") + 1).alias("pattern_id"))
    return own.join(first, keys).join(ids, "first_voxel").select("voxel_id", "n", "pattern_id", "first_voxel")


def pattern_rows(obs: DataFrame, voxel_pattern: DataFrame) -> DataFrame:
    """pattern_id, obs_id and what else ``obs`` carries of the design: the observations of each
    pattern, from its first voxel."""
    lead = voxel_pattern.where("voxel_id = first_voxel").select("voxel_id", "pattern_id")
    return obs.drop("y").join(lead, "voxel_id").drop("voxel_id")


def design_products(rows: DataFrame, design: DataFrame, p: int) -> DataFrame:
    """pattern_id, xtx (row by row)."""
    met = attached(rows, design, "x")
    return met.groupBy("pattern_id").agg(_sums(_outer(F.col("x"), p, F.col("x"), p), "xtx"))


def z_products(rows: DataFrame, design: DataFrame, k: int, q: int, p: int) -> DataFrame:
    """pattern_id, level, n_level, ztz, ztx: of factor k, level by level."""
    met = attached(rows, design, "x", f"f_{k}", f"z_{k}").withColumnsRenamed({f"f_{k}": "level", f"z_{k}": "z"})
    return met.groupBy("pattern_id", "level").agg(F.count("*").alias("n_level"), _sums(_outer(F.col("z"), q, F.col("z"), q), "ztz"), _sums(_outer(F.col("z"), q, F.col("x"), p), "ztx"))


def cross_products(rows: DataFrame, design: DataFrame, k: int, m: int, qk: int, qm: int) -> DataFrame:
    """pattern_id, level, other, ztz: blocks of Z'Z across factors k and m that hold data."""
    met = attached(rows, design, f"f_{k}", f"z_{k}", f"f_{m}", f"z_{m}").withColumnsRenamed({f"f_{k}": "level", f"z_{k}": "z", f"f_{m}": "other", f"z_{m}": "w"})
    return met.groupBy("pattern_id", "level", "other").agg(_sums(_outer(F.col("z"), qk, F.col("w"), qm), "ztz"))
