"""Raster operators on cell tables keyed by (gx, gy). A masked value is NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonalis.functions.expressions import uniform
from zonalis.operators.zones import point_in_zone

CELL = ["gx", "gy"]


def composite_median(obs: DataFrame, bands: list[str]) -> DataFrame:
    """The median of each band over a cell's scenes."""
    return obs.groupBy(*CELL).agg(*[F.median(b).alias(b) for b in bands])


def composite_mode(obs: DataFrame, col: str) -> DataFrame:
    """A cell's most frequent class; of equal ones the lowest."""
    counts = obs.where(F.col(col).isNotNull()).groupBy(*CELL, col).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*CELL).agg(F.max_by(col, F.struct("n", -F.col(col))).alias(col))


def coarsen_mean(cells: DataFrame, cols: list[str], factor: int = 3) -> DataFrame:
    key = [F.floor(F.col(c) / factor).alias(c) for c in CELL]
    return cells.groupBy(*key).agg(*[F.avg(c).alias(c) for c in cols])


def _spread(cells: DataFrame, col: str, factor: int, reach: int, kernel) -> DataFrame:
    """Each coarse cell gives its share to the fine cells within reach; shares of missing neighbours are left out."""
    offsets = F.explode(F.sequence(F.lit(-reach * factor), F.lit((reach + 1) * factor - 1)))
    wide = cells.where(F.col(col).isNotNull()).withColumn("ox", offsets).withColumn("oy", offsets)

    def weight(o: Column) -> Column:
        """By the distance of the fine cell's centre from the coarse one's, in coarse cells."""
        return kernel(F.abs((o + 0.5) / factor - 0.5))

    wide = wide.withColumn("w", weight(F.col("ox")) * weight(F.col("oy"))).where("w <> 0")
    fine = wide.groupBy((F.col("gx") * factor + F.col("ox")).alias("gx"), (F.col("gy") * factor + F.col("oy")).alias("gy"))
    summed = fine.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col(col)).alias("v"))
    inside = cells.select(F.col("gx").alias("cx"), F.col("gy").alias("cy"))
    out = summed.join(inside, (F.floor(F.col("gx") / factor) == F.col("cx")) & (F.floor(F.col("gy") / factor) == F.col("cy")), "left_semi")
    return out.select(*CELL, F.try_divide("v", "w").alias(col))


def refine_bilinear(cells: DataFrame, col: str, factor: int) -> DataFrame:
    """Four neighbours, by distance of centres; shares of missing ones go to the others."""
    return _spread(cells, col, factor, 1, lambda d: F.greatest(1 - d, F.lit(0.0)))


def refine_bicubic(cells: DataFrame, col: str, factor: int, a: float = -0.5) -> DataFrame:
    """Cubic convolution over 16 neighbours."""
    near = lambda d: (a + 2) * d * d * d - (a + 3) * d * d + 1
    far = lambda d: a * d * d * d - 5 * a * d * d + 8 * a * d - 4 * a
    return _spread(cells, col, factor, 2, lambda d: F.when(d <= 1, near(d)).when(d < 2, far(d)).otherwise(0.0))


def refine_nearest(cells: DataFrame, col: str, factor: int) -> DataFrame:
    steps = F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))
    wide = cells.withColumn("ox", steps).withColumn("oy", steps)
    return wide.select((F.col("gx") * factor + F.col("ox")).alias("gx"), (F.col("gy") * factor + F.col("oy")).alias("gy"), col)


def coverage_fraction(cells: DataFrame, region: DataFrame, cols: list[str]) -> DataFrame:
    """One row: of the region's cells, the share with a value, by column."""
    joined = region.select(*CELL).join(cells, CELL, "left")
    return joined.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in cols])


def zonal_mean(cells: DataFrame, zone_cells: DataFrame, zones: DataFrame, col: str) -> DataFrame:
    """One row per zone: NULL without a valid cell."""
    means = zone_cells.join(cells, CELL).groupBy("zone_id").agg(F.avg(col).alias(col))
    return zones.select("zone_id").join(means, "zone_id", "left")


def zonal_class_fractions(cells: DataFrame, zone_cells: DataFrame, zones: DataFrame, classes: dict[int, str]) -> DataFrame:
    """Shares over valid cells; a zone without any has n 0 and NULL shares."""
    valid = zone_cells.join(cells.where("class IS NOT NULL AND class <> 0"), CELL)
    sums = valid.groupBy("zone_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("class") == k).alias(f"n_{name}") for k, name in classes.items()])
    out = zones.select("zone_id").join(sums, "zone_id", "left")
    return out.select("zone_id", F.coalesce("n", F.lit(0)).alias("n"), *[F.try_divide(f"n_{name}", "n").alias(f"fraction_{name}") for name in classes.values()])


def adaptive_pillar_landcover(cells: DataFrame, zone_cells: DataFrame, zones: DataFrame) -> DataFrame:
    """(zone_id, greenery_fraction) of the known zones: vegetation's share of their classified cells, NULL without any."""
    shares = zonal_class_fractions(cells, zone_cells, zones.select("zone_id").distinct(), {1: "vegetation"})
    return shares.select("zone_id", F.col("fraction_vegetation").alias("greenery_fraction"))


def seasonal_composites(obs: DataFrame, season: Column, bands: list[str]) -> DataFrame:
    """(gx, gy, season, bands): the median of each band over a cell's scenes in each season; scenes without a season are left out."""
    return obs.withColumn("season", season).where("season IS NOT NULL").groupBy(*CELL, "season").agg(*[F.median(b).alias(b) for b in bands])


def seasonal_features(composites: DataFrame, zone_cells: DataFrame, features: list[str], seasons: tuple[str, str] = ("dry", "wet")) -> DataFrame:
    """One row per zone: <feature>_<season> and <feature>_delta, the second season less the first.

    Features of a zone are means over its cells. A season in which a zone lacks one of them is missing as a whole; zones with
    either season stay, and those with both are complete.
    """
    means = composites.join(zone_cells, CELL).groupBy("zone_id", "season").agg(*[F.avg(f).alias(f) for f in features]).dropna(subset=features)
    pick = lambda f, s: F.max(F.when(F.col("season") == s, F.col(f))).alias(f"{f}_{s}")  # noqa: E731  one row a season
    wide = means.where(F.col("season").isin(*seasons)).groupBy("zone_id").agg(*[pick(f, s) for f in features for s in seasons])
    return wide.withColumns({f"{f}_delta": F.col(f"{f}_{seasons[1]}") - F.col(f"{f}_{seasons[0]}") for f in features})


def completeness(features: DataFrame, zones: DataFrame) -> DataFrame:
    """One row: zones, those with any feature, those with all."""
    cols = [c for c in features.columns if c != "zone_id"]
    gaps = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
    rows = zones.select("zone_id").distinct().join(features.withColumn("__gaps", gaps), "zone_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("zones"), F.count("__gaps").alias("with_features"), F.count_if(F.col("__gaps") == 0).alias("complete"))


def period_report(obs: DataFrame, scene: str, least: int = 20) -> DataFrame:
    """One row: a period's scenes and whether they are fewer than they should be; a period without scenes is an error."""
    n = F.count_distinct(scene)
    return obs.agg(F.when(n == 0, F.raise_error(F.lit("the period has no scenes"))).otherwise(n).alias("scenes"), (n < least).alias("few"))


def assign_patch(cells: DataFrame, size: int, per_row: int) -> DataFrame:
    """Row-major patch number and the place in the patch."""
    patch = F.floor(F.col("gy") / size) * per_row + F.floor(F.col("gx") / size)
    return cells.withColumns({"patch_idx": patch, "row": F.pmod("gy", F.lit(size)), "col": F.pmod("gx", F.lit(size))})


def from_patch(patches: DataFrame, size: int, per_row: int) -> DataFrame:
    """assign_patch()'s rows with gx and gy rebuilt from patch_idx, row and col."""
    gx, gy = F.pmod("patch_idx", F.lit(per_row)) * size + F.col("col"), F.floor(F.col("patch_idx") / per_row) * size + F.col("row")
    return patches.withColumns({"gx": gx, "gy": gy})


def labelled_patches(patches: DataFrame, label: str) -> DataFrame:
    """Cells of the patches that have a labelled cell: 0 and NULL are no labels."""
    some = patches.groupBy("patch_idx").agg(F.max(F.coalesce(label, F.lit(0))).alias("most")).where("most > 0")
    return patches.join(some.select("patch_idx"), "patch_idx", "left_semi")


def feature_table(composite: DataFrame, labels: DataFrame | None = None, valid: str = "red") -> DataFrame:
    """A composite's cells with label (0 without one) and valid: whether the band named valid has a value. Labels (gx, gy, label) of no cell are left out."""
    rows = composite.withColumn("label", F.lit(0)) if labels is None else composite.join(labels.select(*CELL, "label"), CELL, "left").withColumn("label", F.coalesce("label", F.lit(0)))
    return rows.withColumn("valid", F.col(valid).isNotNull())


def coverage_gate(fractions: DataFrame, least: float = 0.90) -> DataFrame:
    """coverage_fraction()'s row with passed: every column covers at least so much of the region."""
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.col(c) >= least, F.lit(False)) for c in fractions.columns])
    return fractions.withColumn("passed", ok)


def neighbourhood_features(cells: DataFrame, col: str | list[str], radius: int = 1) -> DataFrame:
    """Mean and deviation of each column over the square around each cell, from sums along rows and then along columns; all columns in one go."""
    cols = [col] if isinstance(col, str) else list(col)
    steps = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    # Sums leave NULLs out, and are NULL where a square has no value.
    parts = {c: (F.when(F.col(c).isNotNull(), 1), F.col(c), F.col(c) * F.col(c)) for c in cols}
    named = [v.alias(f"__{k}{i}") for i, vs in enumerate(parts.values()) for k, v in zip("nsq", vs, strict=True)]
    valid = cells.where(reduce(lambda x, y: x | y, [F.col(c).isNotNull() for c in cols])).select(*CELL, *named)
    sums = [F.sum(c).alias(c) for c in valid.columns if c not in CELL]
    for axis in CELL:
        valid = valid.withColumn("o", steps).withColumn(axis, F.col(axis) + F.col("o")).groupBy(*CELL).agg(*sums)
    found = []
    for i, c in enumerate(cols):
        mean = F.col(f"__s{i}") / F.col(f"__n{i}")
        spread = F.sqrt(F.greatest(F.col(f"__q{i}") / F.col(f"__n{i}") - mean * mean, F.lit(0.0)))
        found += [mean.alias(f"{c}_mean"), F.when(mean.isNotNull(), spread).alias(f"{c}_std")]
    return cells.join(valid.select(*CELL, *found), CELL, "left")


def align_rasters(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: cells valid in both, in the first only, in the second only, and the share of both."""
    both = a.select(*CELL, F.lit(1).alias("a")).join(b.select(*CELL, F.lit(1).alias("b")), CELL, "full")
    has = {"n_both": "a IS NOT NULL AND b IS NOT NULL", "n_a_only": "b IS NULL", "n_b_only": "a IS NULL"}
    return both.agg(*[F.count_if(F.expr(e)).alias(n) for n, e in has.items()]).withColumn("share_both", F.try_divide("n_both", F.col("n_both") + F.col("n_a_only") + F.col("n_b_only")))


def soft_vote(models: DataFrame, n_models: int) -> DataFrame:
    """(gx, gy, model, probs, valid) to the mean probabilities and their class; only where all models are valid, else NULL.

    Means are taken to nine digits, and of classes with equal ones the lowest is chosen: the last bits of a sum of doubles decide nothing.
    """
    vote = F.when(F.col("valid") & F.col("probs").isNotNull(), F.struct("model", "probs"))
    cells = models.groupBy(*CELL).agg(F.collect_list(vote).alias("votes"))

    def of(k: Column) -> Column:
        """The mean of class k over those that have it, where these are all models."""
        own = F.filter("votes", lambda v: F.size(v["probs"]) > k)
        named = F.filter(F.array_distinct(F.transform(own, lambda v: v["model"])), lambda m: m.isNotNull())
        known = F.filter(F.transform(own, lambda v: F.get(v["probs"], k)), lambda p: p.isNotNull())
        mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda t, p: t + p), F.size(known))
        return F.when(F.size(named) == n_models, F.struct(F.round(mean, 9).alias("p"), (-k).alias("k")))

    most = F.coalesce(F.array_max(F.transform("votes", lambda v: F.size(v["probs"]))), F.lit(0))
    ks = F.when(most > 0, F.sequence(F.lit(0), most - 1)).otherwise(F.array().cast("array<int>"))
    best = F.when(F.col(CELL[0]).isNotNull() & F.col(CELL[1]).isNotNull(), F.array_max(F.transform(ks, of)))
    return cells.select(*CELL, best.alias("b")).select(*CELL, (1 - F.col("b.k")).alias("class"), "b.p")


def vote_report(models: DataFrame, n_models: int) -> DataFrame:
    """One row: cells, those valid in all models, and the mean sum of these cells' mean probabilities, which should be 1. NULL validity is not valid."""
    whole = F.aggregate("probs", F.lit(0.0), lambda t, p: t + p)
    by = models.groupBy(*CELL).agg(F.count_if(F.coalesce("valid", F.lit(False))).alias("v"), F.avg(F.when(F.col("valid"), whole)).alias("p"))
    valid = F.col("v") == n_models
    return by.agg(F.count(F.lit(1)).alias("cells"), F.count_if(valid).alias("valid"), F.avg(F.when(valid, F.col("p"))).alias("mean_sum"))


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy(key).orderBy(order))).where("__rn = 1").drop("__rn")


def union_sensors(tables: dict[str, DataFrame]) -> DataFrame:
    """One table of all sensors' observations with the sensor's name; a band that a sensor lacks is NULL."""
    named = [df.withColumn("sensor", F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def clip_to_boundary(cells: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """cells (key, x, y, ...) whose centre is within any zone."""
    inside = point_in_zone(cells.select(F.col(key).alias("point_id"), "x", "y"), edges).select(F.col("point_id").alias(key))
    return cells.join(inside, key, "left_semi")


def regression_weights(coarse: DataFrame, target: str, features: list[str], sample: int, seed: str) -> DataFrame:
    """One row w0, w1, w2, w3, n: least squares of target over three features, on at most sample cells by hashed order.

    One aggregate gives means and covariances; the three equations are solved by determinants within the plan.
    """
    rows = coarse.dropna(subset=[target, *features]).orderBy(uniform(F.concat_ws("/", *CELL), seed), *CELL).limit(sample)
    names = dict(zip("abc", features, strict=True))
    pairs = [(p, q) for i, p in enumerate("abc") for q in "abc"[i:]]
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("my"), *[F.avg(f).alias(f"m{k}") for k, f in names.items()], *[F.covar_pop(names[p], names[q]).alias(p + q) for p, q in pairs], *[F.covar_pop(f, target).alias(f"y{k}") for k, f in names.items()])
    m = [[F.col(min(p, q) + max(p, q)) for q in "abc"] for p in "abc"]
    y = [F.col(f"y{k}") for k in "abc"]

    def det(a: list[list[Column]]) -> Column:
        return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])

    slopes = [F.try_divide(det([[y[r] if c == k else m[r][c] for c in range(3)] for r in range(3)]), det(m)).alias(f"w{k + 1}") for k in range(3)]
    fitted = sums.select("n", "my", "ma", "mb", "mc", *slopes)
    return fitted.select((F.col("my") - F.col("w1") * F.col("ma") - F.col("w2") * F.col("mb") - F.col("w3") * F.col("mc")).alias("w0"), "w1", "w2", "w3", "n")


def variant_regress(coarse: DataFrame, fine: DataFrame, target: str, features: list[str], factor: int = 3, sample: int = 5000, seed: str = "regress") -> DataFrame:
    """Fine cells with <target>_regress: the fit of coarse cells on the features' means, and the coarse residuals refined.

    What the fit leaves over is spread bilinearly, so that a coarse cell's heat is kept. NULL where a feature or the
    residual is missing. regression_weights gives the number of cells it rests on; under 30 it is noise.
    """
    table = coarse.select(*CELL, target).join(coarsen_mean(fine, features, factor), CELL)
    weights = F.broadcast(regression_weights(table, target, features, sample, seed))  # one row
    guess = F.col("w0") + F.col("w1") * F.col(features[0]) + F.col("w2") * F.col(features[1]) + F.col("w3") * F.col(features[2])
    rest = table.crossJoin(weights).select(*CELL, (F.col(target) - guess).alias("rest"))
    return fine.crossJoin(weights).join(refine_bilinear(rest, "rest", factor), CELL, "left").select(*CELL, (guess + F.col("rest")).alias(f"{target}_regress"))


def variant_native(coarse: DataFrame, target: str) -> DataFrame:
    return coarse.select(*CELL, F.col(target).alias(f"{target}_native"))


def tile_zonal_stats(cells: DataFrame, zone_cells: DataFrame, heat: str, greenery: str) -> tuple[DataFrame, DataFrame]:
    """(zone_id, heat over values above 0, greenery) of zones with both, and one row with the number of zones without."""
    means = zone_cells.join(cells, CELL).groupBy("zone_id").agg(F.avg(F.when(F.col(heat) > 0, F.col(heat))).alias(heat), F.avg(greenery).alias(greenery)).dropna()
    return means, zone_cells.select("zone_id").distinct().join(means.select("zone_id"), "zone_id", "left_anti").agg(F.count(F.lit(1)).alias("dropped"))
