"""Priority scores, their uncertainty, and what-if edits of zone tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.functions.expressions import uniform
from zonalis.operators.zones import scaled

PILLARS = ["exposure", "sensitivity_raw", "greenery_fraction"]


#: The normalised pillars; what lacks in greenery is normalised, so that a constant greenery counts for nothing.
NORMED = ["exposure_norm", "sensitivity_raw_norm", "deficit_norm"]


def normalised(pillars: DataFrame) -> DataFrame:
    """pillars with NORMED, over the whole table."""
    return scaled(pillars.withColumn("deficit", 1 - F.col("greenery_fraction")), ["exposure", "sensitivity_raw", "deficit"]).drop("deficit")


def equal_score(*parts: Column) -> Column:
    """The mean of the normalised pillars that are there."""
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    return F.try_divide(total, sum((p.isNotNull().cast("int") for p in parts[1:]), parts[0].isNotNull().cast("int")))


def build_score(pillars: DataFrame) -> DataFrame:
    """(zone_id, exposure, sensitivity_raw, greenery_fraction) with score: equal weights."""
    return normalised(pillars).withColumn("score", equal_score(*map(F.col, NORMED))).select(*pillars.columns, "score")


def first_component(norm: DataFrame, by: list[str], rounds: int = 64) -> DataFrame:
    """norm (by, a, b, c) to by, missing, w1, w2, w3: the first principal component over its sum, a loading positive.

    Six covariances in one aggregate, then power iteration within the plan; missing counts rows without all three.
    """
    pairs = [(x, y) for i, x in enumerate("abc") for y in "abc"[i:]]
    lacks = F.col("a").isNull() | F.col("b").isNull() | F.col("c").isNull()
    cov = norm.groupBy(*by).agg(F.count_if(lacks).alias("missing"), *[F.covar_samp(x, y).alias(x + y) for x, y in pairs])
    m = {x + y: F.col(min(x, y) + max(x, y)) for x in "abc" for y in "abc"}

    def step(v: Column, _: Column) -> Column:
        new = [m[x + "a"] * v["a"] + m[x + "b"] * v["b"] + m[x + "c"] * v["c"] for x in "abc"]
        size = F.sqrt(new[0] * new[0] + new[1] * new[1] + new[2] * new[2])
        return F.struct(*[F.coalesce(F.try_divide(n, size), F.lit(0.0)).alias(x) for n, x in zip(new, "abc", strict=True)])

    start = F.struct(*[F.lit(v).alias(x) for v, x in zip((1.0, 0.9, 0.8), "abc", strict=True)])
    v = cov.select(*by, "missing", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("v"))
    sign = F.when(F.col("v.a") < 0, -1.0).otherwise(1.0)
    total = sign * (F.col("v.a") + F.col("v.b") + F.col("v.c"))
    return v.select(*by, "missing", *[F.try_divide(sign * F.col(f"v.{x}"), total).alias(w) for x, w in zip("abc", ("w1", "w2", "w3"), strict=True)])


def pca_weights(pillars: DataFrame, rounds: int = 64) -> DataFrame:
    """One row w1, w2, w3 over the normalised pillars; a zone that lacks a pillar is an error."""
    found = first_component(normalised(pillars).select(*[F.col(c).alias(x) for c, x in zip(NORMED, "abc", strict=True)]), [], rounds)
    ok = F.when(F.col("missing") > 0, F.raise_error(F.concat(F.col("missing").cast("string"), F.lit(" rows lack a pillar")))).otherwise(True)
    return found.withColumn("ok", ok).where("ok").select("w1", "w2", "w3")


def build_score_pca(pillars: DataFrame) -> DataFrame:
    norm = normalised(pillars).crossJoin(F.broadcast(pca_weights(pillars)))  # one row
    score = sum((F.col(w) * F.col(c) for w, c in zip(("w2", "w3"), NORMED[1:], strict=True)), F.col("w1") * F.col(NORMED[0]))
    return norm.select(*pillars.columns, score.alias("score"))


def bootstrap_bands(pillars: DataFrame, exposure_std: float | None, greenery_std: float | None, draws: int = 1000, seed: str = "draw", weights: str = "equal") -> DataFrame:
    """zone_id, point (the score without noise), p05, p50, p95, band_width of the score under Gaussian noise.

    weights: "equal" or "pca". Every draw is normalised anew, and its components are fitted anew. A deviation that is None, NaN or not above 0 means no noise.
    """
    wide = pillars.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))

    def noisy(value: Column, name: str, std: float | None) -> Column:
        if not (std and std > 0):
            return value
        key = F.concat_ws("/", F.col("zone_id").cast("string"), F.col("draw").cast("string"))
        u1, u2 = F.greatest(uniform(key, f"{seed}-{name}-1"), F.lit(1e-12)), uniform(key, f"{seed}-{name}-2")
        return value + F.lit(std) * F.sqrt(-2 * F.log(u1)) * F.cos(2 * F.pi() * u2)

    greenery = noisy(F.col("greenery_fraction"), "greenery", greenery_std)
    drawn = wide.withColumns({"exposure": noisy(F.col("exposure"), "exposure", exposure_std), "deficit": 1 - F.least(F.greatest(greenery, F.lit(0.0)), F.lit(1.0))})
    if not (greenery_std and greenery_std > 0):
        drawn = drawn.withColumn("deficit", 1 - F.col("greenery_fraction"))
    drawn = drawn.select("zone_id", "draw", "exposure", "sensitivity_raw", "deficit")
    parts = ["exposure", "sensitivity_raw", "deficit"]
    bounds = drawn.groupBy("draw").agg(*[f(c).alias(f"{n}_{c}") for c in parts for n, f in (("lo", F.min), ("hi", F.max))])
    scored = drawn.join(F.broadcast(bounds), "draw")  # a row for each draw
    norm = [F.when(F.col(c).isNotNull(), F.when(F.col(f"hi_{c}") == F.col(f"lo_{c}"), 0.0).otherwise((F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}")))) for c in parts]
    named = scored.select("zone_id", "draw", *[c.alias(x) for c, x in zip(norm, "abc", strict=True)])
    if weights == "pca":
        fitted = F.broadcast(first_component(named, ["draw"]))  # a row for each draw
        value = F.col("w1") * F.col("a") + F.col("w2") * F.col("b") + F.col("w3") * F.col("c")
        valued, point = named.join(fitted, "draw").withColumn("score", value), build_score_pca(pillars)
    else:
        valued, point = named.withColumn("score", equal_score(*map(F.col, "abc"))), build_score(pillars)
    bands = valued.groupBy("zone_id").agg(F.percentile("score", [0.05, 0.5, 0.95]).alias("p"))
    point = point.select("zone_id", F.col("score").alias("point"))
    out = point.join(bands, "zone_id", "left")
    return out.select("zone_id", "point", *[F.col("p")[i].alias(n) for i, n in enumerate(("p05", "p50", "p95"))], (F.col("p")[2] - F.col("p")[0]).alias("band_width"))


def sensitivity_pillar(population: DataFrame, ids: DataFrame) -> DataFrame:
    """population (name, total, elderly) of known zones, with elderly_proportion (NULL for 0 of 0) and sensitivity_raw.

    sensitivity_raw: half the normalised total and half the normalised proportion, over the known zones only.
    """
    known = population.join(ids.select("name").distinct(), "name", "left_semi").withColumn("elderly_proportion", F.try_divide("elderly", "total"))
    norm = scaled(known.withColumn("share", F.coalesce("elderly_proportion", F.lit(0.0))), ["total", "share"])
    return norm.select("name", "total", "elderly", "elderly_proportion", (0.5 * F.col("total_norm") + 0.5 * F.col("share_norm")).alias("sensitivity_raw"))


def redistribute_vegetation(zones: DataFrame, delta: float | Column) -> DataFrame:
    """More vegetation, taken from built-up and bare in proportion; water stays."""
    veg = F.least(F.greatest(F.col("fraction_vegetation") + delta, F.lit(0.0)), F.lit(1.0))
    actual = veg - F.col("fraction_vegetation")
    rest = F.col("fraction_built_up") + F.col("fraction_bare")
    less = lambda c: F.when(rest > 1e-9, F.greatest(F.col(c) - actual * F.col(c) / rest, F.lit(0.0))).otherwise(F.col(c))
    return zones.withColumns({"actual_delta": actual, "fraction_built_up": less("fraction_built_up"), "fraction_bare": less("fraction_bare"), "fraction_vegetation": veg})


def toy_pillars(ids: DataFrame, seed: str) -> DataFrame:
    """Uniform placeholder pillars for wiring tests: the same for the same ids and seed."""
    return ids.select("zone_id", *[uniform(F.col("zone_id"), f"{seed}-{c}").alias(c) for c in PILLARS])


def flag_unstable(zones: DataFrame, change: DataFrame, most: float = 0.15, least_pixels: int = 30) -> DataFrame:
    """flagged, stable or insufficient_data for every zone."""
    n = F.coalesce("n_valid", F.lit(0))
    status = F.when((n < least_pixels) | F.col("change_fraction").isNull(), "insufficient_data").when(F.col("change_fraction") > most, "flagged").otherwise("stable")
    return zones.select("zone_id").join(change, "zone_id", "left").select("zone_id", "change_fraction", n.alias("n_valid"), status.alias("status"))


def score_breakdown(normed: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One row per zone and pillar: its weighted share of the score."""
    parts = ", ".join(f"'{c}', {w} * {c}" for c, w in weights.items())
    return normed.select("zone_id", F.expr(f"stack({len(weights)}, {parts}) AS (pillar, contribution)"))
