"""Reports that compare variants, models and periods. Tables of zones in, small tables out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonalis.functions.distributions import student_p
from zonalis.functions.expressions import rule_landcover, uniform
from zonalis.operators.metrics import average_ranks, spearman
from zonalis.operators.raster import coarsen_mean, tile_zonal_stats, zonal_mean
from zonalis.operators.scores import build_score, equal_score, first_component
from zonalis.operators.zones import point_in_zone


def stacked(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(key, variant, value): a row for each column."""
    parts = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in cols)
    return df.select(key, F.expr(f"stack({len(cols)}, {parts}) AS (variant, value)"))


def describe_variants(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Count, mean, deviation, quartiles and coefficient of variation of each column; NULL is left out."""
    by = stacked(df, key, cols).where("value IS NOT NULL").groupBy("variant")
    out = by.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.percentile("value", [0.0, 0.25, 0.5, 0.75, 1.0]).alias("q"))
    quartiles = [F.col("q")[i].alias(c) for i, c in enumerate(("least", "p25", "p50", "p75", "most"))]
    return out.select("variant", "n", "mean", "std", *quartiles, F.try_divide("std", F.abs("mean")).alias("cv"))


def pairwise_differences(df: DataFrame, reference: str, others: list[str]) -> DataFrame:
    return df.withColumns({f"{reference}_minus_{c}": F.col(reference) - F.col(c) for c in others})


def linear_gap_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, Pearson's r, slope, intercept, r2, t and its two-sided p of y over x, on rows with both, and a warning.

    The warning stands where r is above 0.4 with p below 0.05. A perfect fit has no t and p 0; under three rows there is no p.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    fit = both.agg(F.count(F.lit(1)).alias("n"), F.corr(y, x).alias("r"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
    fit = fit.withColumn("t", F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r"))))
    perfect = (F.col("n") > 2) & (F.abs("r") >= 1)
    fit = fit.withColumn("p", F.when(perfect, 0.0).otherwise(student_p(F.col("t"), F.col("n") - 2)))
    return fit.withColumn("warning", F.coalesce((F.col("r") > 0.4) & (F.col("p") < 0.05), F.lit(False)))


def rank_impact(pillars: DataFrame, heldout: DataFrame, variants: list[str], reference: str, n: int = 20) -> DataFrame:
    """A row per variant and weighting (equal, pca): RMSE against held-out heat, and Spearman and top-n overlap of its score with the reference's.

    All variants stand in one table, one below another: each step, from normalising to ranking, goes over all of them at
    once. A zone that lacks a pillar is an error with pca weights.
    """
    long = pillars.select("zone_id", "sensitivity_raw", (1 - F.col("greenery_fraction")).alias("deficit"), F.expr(f"stack({len(variants)}, {', '.join(f"'{v}', CAST({v} AS DOUBLE)" for v in variants)}) AS (variant, exposure)"))
    parts = ["exposure", "sensitivity_raw", "deficit"]
    bounds = F.broadcast(long.groupBy("variant").agg(*[f(c).alias(f"{k}_{c}") for c in parts for k, f in (("lo", F.min), ("hi", F.max))]))  # a row for each variant
    norm = [F.when(F.col(c).isNotNull(), F.when(F.col(f"hi_{c}") == F.col(f"lo_{c}"), 0.0).otherwise((F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}")))) for c in parts]
    named = long.join(bounds, "variant").select("variant", "zone_id", *[c.alias(x) for c, x in zip(norm, "abc", strict=True)])
    fitted = first_component(named, ["variant"])
    whole = F.when(F.col("missing") > 0, F.raise_error(F.concat(F.col("missing").cast("string"), F.lit(" rows lack a pillar")))).otherwise(F.col("w1"))
    fitted = F.broadcast(fitted.withColumn("w1", whole))  # a row for each variant
    weighed = F.col("w1") * F.col("a") + F.col("w2") * F.col("b") + F.col("w3") * F.col("c")
    both = F.explode(F.array(F.struct(F.lit("equal").alias("weighting"), equal_score(*map(F.col, "abc")).alias("score")), F.struct(F.lit("pca").alias("weighting"), weighed.alias("score"))))
    # Scores are rounded before they are ranked: sums in another order must not part equal ones.
    scored = named.join(fitted, "variant").select("variant", "zone_id", both.alias("s")).select("variant", "s.weighting", "zone_id", F.round("s.score", 12).alias("score"))
    key = ["variant", "weighting"]
    ranked = scored.join(average_ranks(scored, "score", "rank", key), [*key, "score"])
    first = ranked.where(F.col("variant") == reference).select("weighting", "zone_id", F.col("rank").alias("reference"))
    rank = ranked.join(first, ["weighting", "zone_id"]).groupBy(*key).agg(F.corr("rank", "reference").alias("spearman"))
    top = scored.withColumn("at", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("score"), "zone_id"))).where(F.col("at") <= n)
    leading = F.broadcast(top.where(F.col("variant") == reference).select("weighting", "zone_id", F.lit(1).alias("leads")))  # n rows a weighting
    overlap = top.join(leading, ["weighting", "zone_id"], "left").groupBy(*key).agg((F.count("leads") / n).alias("overlap"))
    error = long.join(heldout, "zone_id").groupBy("variant").agg(F.sqrt(F.avg(F.pow(F.col("exposure") - F.col("lst_heldout_c"), 2))).alias("rmse"))
    return rank.join(overlap, key).join(error, "variant", "left").select(*key, "rmse", "spearman", "overlap")


def adjacent_band_overlap(bands: DataFrame, n: int = 20) -> DataFrame:
    """Of the n zones with the highest point score: how many neighbours in rank have bands that overlap."""
    top = bands.orderBy(F.desc("point"), "zone_id").limit(n)
    following = F.lead("p95").over(W.orderBy(F.desc("point"), "zone_id"))  # n rows
    return top.select((F.col("p05") <= following).alias("overlap")).agg(F.count_if("overlap").alias("overlaps"), F.count("overlap").alias("pairs"))


def classifier_summary(df: DataFrame, model: str, true: str, pred: str, labels: list[int]) -> DataFrame:
    """A row per model: labels and predictions dropped, accuracy, and macro and weighted F1 over a fixed list of labels.

    Rows without a label are dropped, then those without a prediction or with prediction 0. A label that is never true nor
    predicted has F1 0 in the macro mean.
    """
    known = F.col(true).isin(labels)
    used = known & F.col(pred).isNotNull() & (F.col(pred) != 0)
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    sums = [f(k).alias(f"{c}_{k}") for k in labels for c, f in (
        ("t", lambda k: F.count_if(used & (F.col(true) == k))), ("p", lambda k: F.count_if(used & (F.col(pred) == k))), ("h", lambda k: F.count_if(used & (F.col(true) == k) & (F.col(pred) == k))),
    )]
    counts = df.groupBy(model).agg(F.count_if(~F.coalesce(known, F.lit(False))).alias("unlabelled"), F.count_if(known & ~F.coalesce(used, F.lit(False))).alias("unpredicted"), F.count_if(used).alias("n"), *sums)
    f1 = {k: zero(2 * F.col(f"h_{k}"), F.col(f"t_{k}") + F.col(f"p_{k}")) for k in labels}
    total = lambda parts: reduce(lambda a, b: a + b, parts)
    return counts.select(model, "unlabelled", "unpredicted", "n", F.try_divide(total([F.col(f"h_{k}") for k in labels]), "n").alias("accuracy"), (total(list(f1.values())) / len(labels)).alias("macro_f1"), F.try_divide(total([f1[k] * F.col(f"t_{k}") for k in labels]), "n").alias("weighted_f1"))


def recall_standard_error(df: DataFrame, true: str, pred: str, label: int) -> DataFrame:
    """One row: n, recall and sqrt(recall (1 - recall) / n) of a class; fails without a row of that class."""
    of = df.where(F.col(true) == label).agg(F.count(F.lit(1)).alias("n"), F.avg((F.coalesce(F.col(pred) == label, F.lit(False))).cast("double")).alias("recall"))
    n = F.when(F.col("n") == 0, F.raise_error(F.lit(f"no row of class {label}"))).otherwise(F.col("n"))
    return of.select(n.alias("n"), "recall", F.sqrt(F.col("recall") * (1 - F.col("recall")) / F.col("n")).alias("standard_error"))


def direction_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: on rows with both, the share whose two changes have the same sign."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg((F.signum(a) == F.signum(b)).cast("double")).alias("agreement"))


def prediction_residuals(df: DataFrame, actual: str, predicted: str, split: str) -> DataFrame:
    """A row per value of split: n, RMSE, R2 and the mean residual (predicted less actual)."""
    gap = F.col(predicted) - F.col(actual)
    by = df.where(gap.isNotNull()).groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.avg(gap * gap).alias("ms"), F.var_pop(actual).alias("var"), F.avg(gap).alias("mean_residual"))
    return by.select(split, "n", F.sqrt("ms").alias("rmse"), (1 - F.try_divide("ms", "var")).alias("r2"), "mean_residual")


def weighted_scores(df: DataFrame, actual: str, predicted: str, weight: str) -> DataFrame:
    """One row: accuracy and RMSE by weights; weight 0 is ignored, and a sum of weights is taken as 1e-8 at least."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    share = lambda x: F.sum(w * x) / F.greatest(F.sum(w), F.lit(1e-8))
    return df.agg(share((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"), F.sqrt(share(F.pow(F.col(predicted) - F.col(actual), 2))).alias("rmse"))


def overall_change(both: DataFrame, early: str, late: str) -> DataFrame:
    """One row: cells valid in both periods, and the share of them whose class differs."""
    valid = both.where(F.col(early).isNotNull() & F.col(late).isNotNull())
    return valid.agg(F.count(F.lit(1)).alias("n_valid"), F.avg((F.col(early) != F.col(late)).cast("double")).alias("change_fraction"))


def coverage_gap_report(change: DataFrame) -> DataFrame:
    """One row over zones (n_valid, n_early, n_late): how many lack jointly valid cells, and which period they lack."""
    no = F.col("n_valid") == 0
    lacks_early, lacks_late = F.col("n_early") == 0, F.col("n_late") == 0
    return change.agg(F.count_if(no).alias("gaps"), F.count_if(no & lacks_early & ~lacks_late).alias("lack_early"), F.count_if(no & ~lacks_early & lacks_late).alias("lack_late"), F.count_if(no & lacks_early & lacks_late).alias("lack_both"))


def class_mean_vectors(cells: DataFrame, col: str, features: list[str], classes: list[int]) -> DataFrame:
    """A row per class: the mean of each feature over cells with all of them; 0 for a class without cells."""
    spine = F.broadcast(cells.sparkSession.createDataFrame([(k,) for k in classes], f"{col} int"))
    means = cells.dropna(subset=features).groupBy(F.col(col).cast("int").alias(col)).agg(*[F.avg(f).alias(f) for f in features])
    return spine.join(means, col, "left").select(col, *[F.coalesce(f, F.lit(0.0)).alias(f) for f in features])


def silhouette_squared(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """One row: the mean silhouette by squared Euclidean distance, 0 for single members; one pass over the clusters' sums.

    The mean squared distance to a cluster is |x|^2 - 2 x.m + s, with the cluster's mean m and mean square s. Clusters
    are few; their table is broadcast.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    rows = df.select(cluster, F.transform(vector, lambda x: x.cast("double")).alias("x")).withColumn("xx", dot(F.col("x"), F.col("x")))
    sums = rows.select(cluster, F.posexplode("x").alias("at", "v")).groupBy(cluster, "at").agg(F.avg("v").alias("v"))
    means = sums.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("m"))
    about = rows.groupBy(cluster).agg(F.avg("xx").alias("s"), F.count(F.lit(1)).alias("c")).join(means, cluster)
    about = about.agg(F.collect_list(F.struct(F.col(cluster).alias("k"), "s", "c", "m")).alias("all"))
    every = rows.crossJoin(F.broadcast(about))  # one row
    far = F.transform("all", lambda k: F.struct(k["k"].alias("k"), k["c"].alias("c"), (F.col("xx") - 2 * dot(F.col("x"), k["m"]) + k["s"]).alias("d")))
    placed = every.select(cluster, far.alias("far"))
    own = F.filter("far", lambda k: k["k"] == F.col(cluster))[0]
    a = own["d"] * own["c"] / (own["c"] - 1)
    b = F.array_min(F.transform(F.filter("far", lambda k: k["k"] != F.col(cluster)), lambda k: k["d"]))
    value = F.when(own["c"] == 1, 0.0).otherwise(F.try_divide(b - a, F.greatest(a, b)))
    return placed.agg(F.avg(value).alias("silhouette"))


def cluster_quality(sizes: DataFrame, silhouette: DataFrame, *others: DataFrame) -> DataFrame:
    """One row from (cluster, n), the Euclidean silhouette and other one-row tables: clusters, sizes, the other tables' statistics, and degenerate.

    Degenerate is a labelling with a cluster of under 3 members or a silhouette under 0.15.
    """
    ends = sizes.agg(F.count(F.lit(1)).alias("clusters"), F.min("n").alias("smallest"), F.max("n").alias("largest"))
    both = reduce(DataFrame.crossJoin, [ends, *[t.drop("labelling", "n") for t in (silhouette, *others)]])  # one row each
    return both.withColumn("degenerate", (F.col("smallest") < 3) | (F.col("silhouette") < 0.15))


def landcover_coherence(profile: DataFrame, cluster: str, heat: str, built: str, vegetation: str) -> DataFrame:
    """One row from a profile of clusters: whether the hottest cluster is the most built-up, and the least vegetated; ties by lowest cluster."""
    top = lambda c, sign: F.max_by(cluster, F.struct(sign * F.col(c), -F.col(cluster)))
    out = profile.agg(top(heat, 1).alias("hottest"), top(built, 1).alias("most_built"), top(vegetation, -1).alias("least_vegetated"))
    return out.select("hottest", (F.col("hottest") == F.col("most_built")).alias("built_agrees"), (F.col("hottest") == F.col("least_vegetated")).alias("vegetation_agrees"))


def choose_k(sweep: DataFrame, least_k: int = 3) -> DataFrame:
    """One row of (k, silhouette, ...): the highest silhouette with k >= least_k, or over all; the lowest k of equal ones."""
    return sweep.orderBy((F.col("k") >= least_k).desc(), F.col("silhouette").desc_nulls_last(), "k").limit(1)


def check_summary(checks: DataFrame, gates: list[str]) -> DataFrame:
    """(gate, ok) rows to PASS, FAIL or NOT RUN for each gate."""
    spine = checks.sparkSession.createDataFrame([(g,) for g in gates], "gate string")
    ran = checks.groupBy("gate").agg(F.bool_and("ok").alias("ok"))
    return F.broadcast(spine).join(ran, "gate", "left").select("gate", F.when(F.col("ok").isNull(), "NOT RUN").when(F.col("ok"), "PASS").otherwise("FAIL").alias("status"))


def lookup(df: DataFrame, table: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """df with the table's columns, unmatched rows left out; and one row with their number. Keys of the table must be unique."""
    twice = table.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).agg(F.count_if(F.col("__n") > 1).alias("__twice"))
    checked = table.crossJoin(F.broadcast(twice)).withColumn("__ok", F.when(F.col("__twice") > 0, F.raise_error(F.lit(f"{key} is not unique"))).otherwise(True)).where("__ok").drop("__ok", "__twice")
    return df.join(checked, key), df.join(table.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("unmatched"))


def rescale_delta(delta: Column, edit_area: Column, zone_area: Column) -> Column:
    """An edit's effect spread over its zone; a zone without area is an error."""
    return F.when(zone_area <= 0, F.raise_error(F.lit("a zone's area must be above 0"))).otherwise(delta * edit_area / zone_area)


def adaptive_source(ndvi: DataFrame, landcover: DataFrame, prefer: str = "landcover") -> DataFrame:
    """(zone_id, greenery_fraction, fell_back) from either source: the preferred one, NDVI's where that has none."""
    both = ndvi.select("zone_id", F.col("greenery_fraction").alias("n")).join(landcover.select("zone_id", F.col("greenery_fraction").alias("l")), "zone_id", "full")
    chosen = F.coalesce("l", "n") if prefer == "landcover" else F.col("n")
    fell = (F.col("l").isNull() & F.col("n").isNotNull()) if prefer == "landcover" else F.lit(False)
    return both.select("zone_id", chosen.alias("greenery_fraction"), fell.alias("fell_back"))


def adaptive_report(ndvi: DataFrame, landcover: DataFrame, prefer: str = "landcover") -> tuple[DataFrame, DataFrame]:
    """adaptive_source()'s rows, and one row: zones, those that fell back, and Spearman's correlation of the two sources where both have a value (NULL under two such zones)."""
    rows = adaptive_source(ndvi, landcover, prefer)
    both = ndvi.select("zone_id", F.col("greenery_fraction").alias("n")).join(landcover.select("zone_id", F.col("greenery_fraction").alias("l")), "zone_id")
    counted = rows.agg(F.count(F.lit(1)).alias("zones"), F.count_if("fell_back").alias("fell_back"))
    ranked = spearman(both, "n", "l").select(F.col("n").alias("compared"), F.when(F.col("n") >= 2, F.col("spearman")).alias("spearman"))
    return rows, counted.crossJoin(ranked)  # one row each


def depth_gate(days: DataFrame, window: int = 7, least_days: int = 5) -> DataFrame:
    """One row from reading_depth()'s days: of the last days of the window, those that are readable, and whether they are enough."""
    last = days.agg(F.max("day").alias("last"))
    recent = days.crossJoin(F.broadcast(last)).where(F.date_diff("last", "day") < window)  # one row
    return recent.agg(F.count(F.lit(1)).alias("days"), F.count_if("readable").alias("readable"), (F.count_if("readable") >= least_days).alias("passed"))


def reading_depth(readings: DataFrame, at: str, station: str, least_stations: int = 10) -> DataFrame:
    """A row per day from the first to the last, days without readings too: readings, stations, and whether there are enough."""
    day = F.to_date(at)
    spine = readings.agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a IS NOT NULL").select(F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("day"))
    counts = readings.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("readings"), F.count_distinct(station).alias("stations"))
    return spine.join(counts, "day", "left").select("day", F.coalesce("readings", F.lit(0)).alias("readings"), F.coalesce("stations", F.lit(0)).alias("stations"), (F.coalesce("stations", F.lit(0)) >= least_stations).alias("readable"))


def sample_at_points(cells: DataFrame, points: DataFrame, col: str) -> DataFrame:
    """points (gx, gy, ...) with the value of their cell; NULL outside of the grid."""
    return points.join(cells.select("gx", "gy", col), ["gx", "gy"], "left")


def station_heldout(stations: DataFrame, edges: DataFrame, readings: DataFrame, zones: DataFrame) -> DataFrame:
    """(zone_id, lst_heldout_c, n): the mean of all readings of the stations (station_id, x, y) within each known zone."""
    placed = point_in_zone(stations.select(F.col("station_id").alias("point_id"), "x", "y"), edges).withColumnRenamed("point_id", "station_id")
    by_station = readings.where("value IS NOT NULL").groupBy("station_id").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("c"))
    means = by_station.join(placed, "station_id").groupBy("zone_id").agg((F.sum("s") / F.sum("c")).alias("lst_heldout_c"), F.sum("c").alias("n"))
    return means.join(zones.select("zone_id").distinct(), "zone_id", "left_semi")


def coarse_heldout(cells: DataFrame, zone_cells: DataFrame, zones: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """(zone_id, lst_heldout_c) of zones with a valid coarse cell, and one row: these zones, all zones and their share."""
    means = zonal_mean(cells, zone_cells, zones, col).withColumnRenamed(col, "lst_heldout_c")
    covered = F.count("lst_heldout_c")
    return means.dropna(), means.agg(covered.alias("covered"), F.count(F.lit(1)).alias("zones"), F.try_divide(covered, F.count(F.lit(1))).alias("coverage"))


def crosscheck(heat: DataFrame, sources: dict[str, DataFrame], variants: list[str]) -> DataFrame:
    """A row per variant and held-out source (zone_id, lst_heldout_c): n, RMSE and Spearman over zones with both; all pairs in one table."""
    named = reduce(DataFrame.unionByName, [t.select("zone_id", F.lit(name).alias("source"), F.col("lst_heldout_c").cast("double").alias("b")) for name, t in sources.items()])
    both = stacked(heat, "zone_id", variants).withColumnRenamed("value", "a").join(named, "zone_id").where("a IS NOT NULL AND b IS NOT NULL")
    key = ["variant", "source"]
    ranked = both.join(average_ranks(both, "a", "ra", key), [*key, "a"]).join(average_ranks(both, "b", "rb", key), [*key, "b"])
    return ranked.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.pow(F.col("a") - F.col("b"), 2))).alias("rmse"), F.corr("ra", "rb").alias("spearman"))


def enrich(zones: DataFrame, tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """zones with each table's columns by zone_id, and one row: how many zones each table lacks, as missing_<name>."""
    out = zones
    for name, t in tables.items():
        out = out.join(t.withColumn(f"__has_{name}", F.lit(1)), "zone_id", "left")
    report = out.agg(*[F.count_if(F.col(f"__has_{n}").isNull()).alias(f"missing_{n}") for n in tables])
    return out.drop(*[f"__has_{n}" for n in tables]), report


def zone_map(zones: DataFrame, scored: DataFrame, bands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every zone with its score and band width, and one row: zones missing from either, and the ends of the colour scale."""
    table, missing = enrich(zones, {"score": scored.select("zone_id", "score"), "bands": bands.select("zone_id", "band_width")})
    return table, missing.crossJoin(table.agg(F.min("score").alias("lowest"), F.max("score").alias("highest")))  # one row each


def tile_smoke_score(cells: DataFrame, zone_cells: DataFrame, factor: int = 1, seed: str = "tile") -> DataFrame:
    """(zone_id, score) of a tile with ndvi, ndbi, ndwi and lst: classes, vegetation's share, coarse cells, zones, equal score.

    A tile has no population: its sensitivity is a hashed number from 0.3 to 1.
    """
    green = (rule_landcover(F.col("ndwi"), F.col("ndvi"), F.col("ndbi")) == 1).cast("double")
    coarse = coarsen_mean(cells.withColumn("green", green), ["lst", "green"], factor)
    stats, _ = tile_zonal_stats(coarse, zone_cells, "lst", "green")
    pillars = stats.select("zone_id", F.col("lst").alias("exposure"), (0.3 + 0.7 * uniform(F.col("zone_id"), seed)).alias("sensitivity_raw"), F.col("green").alias("greenery_fraction"))
    return build_score(pillars).select("zone_id", "score")
