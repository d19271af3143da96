"""Samples that depend on keys and seeds only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonalis.functions.expressions import uniform


def allocate(hist: DataFrame, total: int, boost: int, least: int = 8) -> DataFrame:
    """(class, n) to (class, take): by share, the boosted class counted twice, half-even, then levelled to the total.

    No class goes below 1, so a total under the number of classes gives 1 each. The histogram has a row per class, so one task holds it.
    """
    every = W.partitionBy()
    weight = F.col("n") / F.sum("n").over(every) * F.when(F.col("class") == boost, 2.0).otherwise(1.0)
    first = hist.withColumn("w", weight).withColumn("take", F.greatest(F.bround(F.col("w") / F.sum("w").over(every) * total).cast("long"), F.lit(least)))
    gap = F.lit(total) - F.sum("take").over(every)
    k = F.count(F.lit(1)).over(every)
    up, down = F.row_number().over(W.orderBy("take", "class")), F.row_number().over(W.orderBy(F.desc("take"), "class"))
    levelled = first.withColumns({"gap": gap, "k": k, "up": up, "down": down, "spare": F.col("take") - 1})
    more = F.floor(F.col("gap") / F.col("k")) + (F.col("up") <= F.col("gap") % F.col("k")).cast("int")
    # Taking away: whole turns over the classes above 1, then one each from the first of those that are left.
    below = W.orderBy("spare", "class").rowsBetween(W.unboundedPreceding, -1)
    turns = F.floor((-F.col("gap") - F.coalesce(F.sum("spare").over(below), F.lit(0))) / (F.col("k") - F.row_number().over(W.orderBy("spare", "class")) + 1))
    turned = levelled.withColumn("turns", turns).withColumn("turns", F.max("turns").over(every)).withColumn("less", F.least("spare", "turns"))
    rest = -F.col("gap") - F.sum("less").over(every)
    left = F.col("spare") > F.col("turns")
    last = left & (F.row_number().over(W.partitionBy(left).orderBy("down")) <= rest)
    return turned.select("class", F.when(F.col("gap") >= 0, F.col("take") + more).otherwise(F.col("take") - F.col("less") - last.cast("int")).cast("long").alias("take"))


def stratified_sample(cells: DataFrame, key: str, stratum: str, sizes: DataFrame, seed: str) -> DataFrame:
    """The first of each stratum in a hashed order, or all of a smaller one.

    Only rows under a bound are ranked, so that no task sorts a whole stratum; a stratum with too few rows under its bound
    is ranked as a whole.
    """
    drawn = cells.where(F.col(stratum).isNotNull()).withColumn("__draw", uniform(F.col(key), seed))
    counts = drawn.groupBy(stratum).agg(F.count(F.lit(1)).alias("__n"))
    wanted = sizes.select(stratum, F.col("take").alias("__take")).join(counts, stratum).withColumn("__guess", 4 * (F.col("__take") + 16) / F.col("__n"))
    under = drawn.join(F.broadcast(wanted.select(stratum, "__guess")), stratum).groupBy(stratum).agg(F.count_if(F.col("__draw") <= F.col("__guess")).alias("__under"))
    enough = F.col("__under") >= F.least("__take", "__n")
    bound = F.broadcast(wanted.join(under, stratum).select(stratum, "__take", F.when(enough, F.col("__guess")).otherwise(1.0).alias("__bound")))
    ranked = drawn.join(bound, stratum).where("__draw <= __bound").withColumn("__rank", F.row_number().over(W.partitionBy(stratum).orderBy("__draw", key)))
    return ranked.where("__rank <= __take").select(*cells.columns)


def shortfall(sample: DataFrame, stratum: str, sizes: DataFrame) -> DataFrame:
    """(stratum, wanted, taken, short) for each stratum of sizes that has fewer rows in the sample than were asked for."""
    taken = sample.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    rows = sizes.select(stratum, F.col("take").cast("long").alias("wanted")).join(taken, stratum, "left").select(stratum, "wanted", F.coalesce("n", F.lit(0)).alias("taken"))
    return rows.where("taken < wanted").withColumn("short", F.col("wanted") - F.col("taken"))


def hash_split(df: DataFrame, key: str, fraction: float, seed: str) -> DataFrame:
    return df.withColumn("is_train", uniform(F.col(key), seed) >= fraction)
