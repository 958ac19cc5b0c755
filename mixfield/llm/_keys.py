"""The least id of each key, however many rows one key holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import stash

#: Keys with at least 1 / HOT_KEYS of all rows are hot: there are at most that many.
HOT_KEYS = 4096


def with_least(rows: DataFrame, key: str, ident: str, to: str) -> DataFrame:
    """``rows`` (a written table) and ``to``: the least ``ident`` of the rows that share its key.

    Minima come from a combined aggregate and only keys of several rows are joined back: hot
    ones, HOT_KEYS at most, by a broadcast, the others in a join in which no key is hot."""
    total = rows.count()
    least = stash(rows.groupBy(key).agg(F.min(ident).alias(to), F.count("*").alias("__many")).where("__many > 1"), "least")
    hot = F.broadcast(least.where(F.col("__many") * HOT_KEYS >= total).drop("__many"))
    cold = least.where(F.col("__many") * HOT_KEYS < total).drop("__many")
    rest = rows.join(hot, key, "left_anti").join(cold, key, "left").withColumn(to, F.coalesce(to, ident))
    return rows.join(hot, key).unionByName(rest)
