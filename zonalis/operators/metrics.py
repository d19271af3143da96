"""Counts, agreement, accuracy and rank statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Ordered ranges that values are dealt into for ranking.
RANGES = 1024


def class_histogram(df: DataFrame, col: str) -> DataFrame:
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))  # one row a class


def confusion_matrix(df: DataFrame, true: str, pred: str, labels: list[int]) -> DataFrame:
    """Label rows and columns in a fixed order, zeros kept."""
    spine = df.sparkSession.createDataFrame([(k,) for k in labels], f"{true} int")
    counts = df.select(F.col(true).cast("int").alias(true), F.col(pred).cast("int").alias(pred)).groupBy(true).pivot(pred, labels).count()
    return F.broadcast(spine).join(counts, true, "left").na.fill(0).select(true, *[F.col(str(k)).alias(f"pred_{k}") for k in labels])


def classification_report(df: DataFrame, true: str, pred: str) -> DataFrame:
    """precision, recall, f1, support by class; 0 where nothing is divided."""
    long = df.select(F.explode(F.array(F.struct(F.col(true).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(true) == F.col(pred)).cast("int").alias("tp")), F.struct(F.col(pred).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("tp")))).alias("e"))
    sums = long.groupBy(F.col("e.c").alias("class")).agg(*[F.sum(f"e.{x}").alias(x) for x in ("t", "p", "tp")])
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.select("class", zero("tp", "p").alias("precision"), zero("tp", "t").alias("recall"), zero(2 * F.col("tp"), F.col("t") + F.col("p")).alias("f1"), F.col("t").alias("support"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, share of equal labels, Cohen's kappa."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    n = pairs.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("observed"))
    of = lambda c, name: pairs.groupBy(F.col(c).alias("k")).agg(F.count(F.lit(1)).alias(name))
    expected = of(a, "ca").join(of(b, "cb"), "k").agg(F.sum(F.col("ca") * F.col("cb")).alias("s"))
    both = n.crossJoin(expected)  # one row each
    chance = F.coalesce("s", F.lit(0)) / (F.col("n") * F.col("n"))
    return both.select("n", "observed", F.try_divide(F.col("observed") - chance, 1 - chance).alias("kappa"))


def agreement_report(df: DataFrame, key: str, a: str, b: str, least: float = 0.60) -> tuple[DataFrame, DataFrame]:
    """One row of agreement() with the number of disagreements and whether kappa reaches least; and the rows (key, a, b) that differ. A row that lacks a label is neither."""
    differ = df.where(F.col(a) != F.col(b)).select(key, a, b)
    counted = agreement(df, a, b).crossJoin(differ.agg(F.count(F.lit(1)).alias("disagreements")))  # one row each
    return counted.withColumn("passed", F.coalesce(F.col("kappa") >= least, F.lit(False))), differ


def average_ranks(df: DataFrame, col: str, name: str, by: list[str] = ()) -> DataFrame:
    """(by, col, name): the rank of each value from 1, within each group of by; equal values share the mean of theirs.

    Values are counted, dealt into ordered ranges, and ranked by the ranges' sums and their place in the range. The ranges
    end at approximate quantiles of the different values, so that they are about equally full however the values lie; only
    their size depends on the approximation, not the ranks. Groups of by are few; RANGES rows of each are broadcast.
    """
    by = list(by)
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
    cuts = [k / RANGES for k in range(1, RANGES)]
    bounds = F.broadcast(counts.groupBy(*by).agg(F.array_sort(F.array_distinct(F.approx_percentile(col, cuts, 20 * RANGES))).alias("bounds")))  # a row for each group
    dealt = (counts.join(bounds, by) if by else counts.crossJoin(bounds)).select(*by, col, "n", _bounds_below(F.col(col), F.col("bounds")).alias("range"))
    before = W.partitionBy(*by).orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # at most RANGES rows
    sums = dealt.groupBy(*by, "range").agg(F.sum("n").alias("s")).select(*by, "range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
    within = W.partitionBy(*by, "range").orderBy(col).rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("lower", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(sums), [*by, "range"])
    return placed.select(*by, col, (F.col("start") + F.col("lower") + (F.col("n") + 1) / 2).alias(name))


def _bounds_below(value: Column, bounds: Column) -> Column:
    """How many of the sorted bounds lie below a value, by halving."""
    both = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))
    middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")

    def halve(s: Column, _: Column) -> Column:
        below = (s["lo"] < s["hi"]) & (F.get(bounds, middle(s)) < value)
        return F.struct(F.when(below, middle(s) + 1).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(middle(s)).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(RANGES.bit_length())), both, halve, lambda s: s["lo"])


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("x"), F.col(b).alias("y"))
    ranked = pairs.join(average_ranks(pairs, "x", "rx"), "x").join(average_ranks(pairs, "y", "ry"), "y")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("spearman"))


def top_n_overlap(a: DataFrame, b: DataFrame, score: str, n: int = 20) -> DataFrame:
    """The share of n that both tables have among their first n; ties by zone_id."""
    first = lambda d: d.orderBy(F.desc(score), "zone_id").limit(n).select("zone_id")
    return first(a).join(first(b), "zone_id", "left_semi").agg((F.count(F.lit(1)) / n).alias("overlap"))


def rmse(a: DataFrame, b: DataFrame, key: str, x: str, y: str) -> DataFrame:
    return a.join(b, key).agg(F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("n"), F.sqrt(F.avg(F.pow(F.col(x) - F.col(y), 2))).alias("rmse"))


def zonal_change(early: DataFrame, late: DataFrame, zone_cells: DataFrame) -> DataFrame:
    """Of cells valid in both periods, the share whose class differs; and the valid cells of each."""
    both = early.select("gx", "gy", F.col("class").alias("e")).join(late.select("gx", "gy", F.col("class").alias("l")), ["gx", "gy"], "full").join(zone_cells, ["gx", "gy"])
    valid = F.col("e").isNotNull() & F.col("l").isNotNull()
    return both.groupBy("zone_id").agg(F.avg(F.when(valid, (F.col("e") != F.col("l")).cast("double"))).alias("change_fraction"), F.count_if(valid).alias("n_valid"), F.count("e").alias("n_early"), F.count("l").alias("n_late"))


def monthly_counts(scenes: DataFrame, at: str) -> DataFrame:
    """A row for each month from the first to the last, months without scenes too."""
    month = F.date_trunc("month", F.col(at))
    ends = scenes.agg(F.min(month).alias("a"), F.max(month).alias("b"))
    spine = ends.where("a IS NOT NULL").select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    counts = scenes.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, "month", "left").select(F.date_format("month", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("n"))


def season_windows(scenes: DataFrame, at: str, cloud: str, candidates: dict[str, list[int]], thresholds: list[float], least: int = 8) -> DataFrame:
    """Scenes of each set of months under each cloud threshold, zeros kept; defensible from least scenes on."""
    spark = scenes.sparkSession
    months = F.broadcast(spark.createDataFrame([(c, m) for c, ms in candidates.items() for m in ms], "candidate string, month int"))
    grid = F.broadcast(spark.createDataFrame([(c, float(t)) for c in candidates for t in thresholds], "candidate string, threshold double"))
    counted = scenes.withColumn("month", F.month(at)).join(months, "month").join(grid, "candidate").where(F.col(cloud) < F.col("threshold")).groupBy("candidate", "threshold").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counted, ["candidate", "threshold"], "left").select("candidate", "threshold", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) >= least).alias("defensible"))


def profile_clusters(df: DataFrame, cluster: str, features: list[str]) -> DataFrame:
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f) for f in features])


def standardize(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows with all features, by mean and population deviation; a constant feature is divided by 1."""
    rows = df.dropna(subset=features)
    stats = rows.agg(*[f(c).alias(f"__{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = {c: (F.col(c) - F.col(f"__m_{c}")) / F.coalesce(F.nullif(F.col(f"__s_{c}"), F.lit(0.0)), F.lit(1.0)) for c in features}
    return rows.crossJoin(F.broadcast(stats)).withColumns(z).select(*df.columns)  # one row


def davies_bouldin(df: DataFrame, cluster: str, features: list[str]) -> DataFrame:
    """One row; the table of clusters is small beside the rows."""
    centre = df.groupBy(cluster).agg(*[F.avg(f).alias(f"c_{f}") for f in features])
    far = lambda a, b: F.sqrt(sum((F.pow(F.col(a.format(f)) - F.col(b.format(f)), 2) for f in features[1:]), F.pow(F.col(a.format(features[0])) - F.col(b.format(features[0])), 2)))
    scatter = df.join(centre, cluster).groupBy(cluster).agg(F.avg(far("{}", "c_{}")).alias("s")).join(centre, cluster)
    x = scatter.select(F.col(cluster).alias("kx"), F.col("s").alias("sx"), *[F.col(f"c_{f}").alias(f"x_{f}") for f in features])
    y = scatter.select(F.col(cluster).alias("ky"), F.col("s").alias("sy"), *[F.col(f"c_{f}").alias(f"y_{f}") for f in features])
    ratio = x.join(F.broadcast(y), x.kx != y.ky).groupBy("kx").agg(F.max(F.try_divide(F.col("sx") + F.col("sy"), far("x_{}", "y_{}"))).alias("r"))
    return ratio.agg(F.avg("r").alias("davies_bouldin"))
