"""Domain tables derived from the given star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of scenes: one row per (scene, cell, line)."""
    lines, scenes = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    rows = lines.join(scenes, F.col("l_orderkey") == F.col("o_orderkey"))
    qa = F.when(F.col("l_linenumber") == 7, 8).when(F.col("l_linenumber") == 6, 16).otherwise(F.col("l_linenumber") % 2)
    return rows.select(
        (F.col("l_partkey") % 48).alias("gx"), F.floor(F.col("l_partkey") / 48).alias("gy"), F.col("l_orderkey").alias("scene_id"),
        F.col("l_shipdate").alias("acquired_at"), (F.col("o_totalprice") % 100).alias("scene_cloud"), (F.col("l_discount") * 1000).alias("cloud_prob"), qa.alias("qa"),
        F.when(F.col("l_tax") > 0, 0).otherwise(1).alias("sat"), (F.col("l_linenumber") + 2).alias("scl"), F.col("l_extendedprice").alias("nir"),
        (F.col("l_quantity") * 1000).alias("red"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("swir"), (F.col("l_quantity") * 800).alias("green"), (40000 + F.col("l_quantity") * 200).alias("lst_raw"),
    )


def zone_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell for each part, 48 a row, in zones of 12 x 12 cells: the grid grows with the table."""
    key = F.col("p_partkey")
    grid = load(spark, sf_dir, "part").select((key % 48).alias("gx"), F.floor(key / 48).alias("gy")).distinct()
    return grid.withColumn("zone_id", F.floor(F.col("gy") / 12) * 4 + F.floor(F.col("gx") / 12))


def zone_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of side 10 for each nation, five in a row; the upper right corner of the last row is cut."""
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("zone_id"))
    x, y = (F.col("zone_id") % 5) * 10.0, F.floor(F.col("zone_id") / 5) * 10.0
    cut = F.when(F.col("zone_id") >= 20, 4.0).otherwise(0.0)
    corners = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, y), (x + 10, y), (x + 10, y + 10 - cut), (x + 10 - cut, y + 10), (x, y + 10), (x, y))])
    pairs = F.zip_with(F.slice(corners, 1, 5), F.slice(corners, 2, 5), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    return n.select("zone_id", F.explode(pairs).alias("e")).select("zone_id", "e.*")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select(k.alias("point_id"), ((k * 37) % 6000 / 100.0 + 0.003).alias("x"), ((k * 91) % 6000 / 100.0 + 0.007).alias("y"))


def heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean heat of each zone by three variants."""
    q = F.col("l_quantity")
    by = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("zone_id"))
    return by.agg(F.avg(q).alias("lst_native30"), F.avg(q * (1 - F.col("l_discount"))).alias("lst_bicubic10"), F.avg(q * (1 - F.col("l_tax"))).alias("lst_regress10"))


def pillars(spark: SparkSession, sf_dir: str, variant: str = "lst_native30") -> DataFrame:
    """Zones with heat, sensitivity and greenery; a zone that lacks one is left out."""
    key = F.col("s_suppkey")
    social = load(spark, sf_dir, "supplier").select(key.alias("zone_id"), F.col("s_acctbal").alias("sensitivity_raw"), ((key * 37) % 100 / 100.0).alias("greenery_fraction"))
    return heat(spark, sf_dir).select("zone_id", F.round(variant, 9).alias("exposure")).join(social, "zone_id")


def heldout(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return load(spark, sf_dir, "supplier").select(key.alias("zone_id"), (20 + key % 9).cast("double").alias("lst_heldout_c"))


def scored_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = (F.col("vec_id") % 5 == 0).cast("int")
    return load(spark, sf_dir, "embeddings").select("vec_id", (1 + F.col("label") % 4).cast("int").alias("true"), (1 + (F.col("label") + hit) % 4).cast("int").alias("pred"))


def cluster_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    return e.select("vec_id", (F.col("label") % 4).cast("int").alias("cluster"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(64)])
