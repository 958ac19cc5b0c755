"""Tables of the driver as observations (obs_id, voxel_id, y) and designs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every vector is an image: its places are voxels, its label the factor."""
    t = _read(spark, sf_dir, "embeddings")
    obs = t.select(F.col("vec_id").alias("obs_id"), F.posexplode("embedding").alias("voxel_id", "y")).withColumn("y", F.col("y").cast("double"))
    design = t.select(F.col("vec_id").alias("obs_id"), F.array(F.lit(1.0), F.col("vec_id") / 1000.0).alias("x"), F.col("label").alias("f_1"), F.array(F.lit(1.0)).alias("z_1"))
    return obs, design


def lineitem(spark: SparkSession, sf_dir: str, slopes: bool = False, crossed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows are observations, (return flag, status) the voxels, suppliers the factor;
    ``crossed`` adds the shipping month as a second factor, ``slopes`` a random slope."""
    own = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    t = _read(spark, sf_dir, "lineitem")
    voxel = (F.ascii("l_returnflag") * 256 + F.ascii("l_linestatus")).cast("int")
    z = F.array(F.lit(1.0), F.col("l_quantity") / 50) if slopes else F.array(F.lit(1.0))
    columns = [F.array(F.lit(1.0), F.col("l_quantity")).alias("x"), F.col("l_suppkey").cast("int").alias("f_1"), z.alias("z_1")]
    if crossed:
        columns += [F.month("l_shipdate").alias("f_2"), F.array(F.lit(1.0)).alias("z_2")]
    # order and line are not a key, so an observation carries its design instead of joining it;
    # the hash only tells which observations a voxel has
    obs = t.select(F.xxhash64(*own).alias("obs_id"), voxel.alias("voxel_id"), (F.col("l_extendedprice") / 1000).alias("y"), *columns)
    return obs, obs.drop("voxel_id", "y")


def events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events by type, with the hour as covariate and the user as factor."""
    t = _read(spark, sf_dir, "events")
    code = (F.ascii("event_type") * 65536 + F.ascii(F.substring("event_type", 2, 1)) * 256 + F.length("event_type")).cast("int")
    obs = t.select(F.col("event_id").alias("obs_id"), code.alias("voxel_id"), F.col("value").alias("y"))
    return obs, t.select(F.col("event_id").alias("obs_id"), F.array(F.lit(1.0), F.hour("ts").cast("double")).alias("x"), F.col("user_id").cast("int").alias("f_1"), F.array(F.lit(1.0)).alias("z_1"))
