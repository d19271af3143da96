"""Registered queries of the validation reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.functions import expressions as X
from zonalis.operators import clusters, metrics, raster, scores, validation
from zonalis.plans import views as V
from zonalis.plans.queries import INDEXED, ORACLES, ZONE, _composite, _indexed, norm, query, rounded

VARIANTS = ["lst_native30", "lst_bicubic10", "lst_regress10"]
HEAT = """heat AS (SELECT l_suppkey AS zone_id, avg(l_quantity) AS lst_native30, avg(l_quantity * (1 - l_discount)) AS lst_bicubic10, avg(l_quantity * (1 - l_tax)) AS lst_regress10 FROM lineitem GROUP BY 1),
held AS (SELECT s_suppkey AS zone_id, (20 + s_suppkey % 9)::DOUBLE AS lst_heldout_c FROM supplier)"""


@query(f"WITH {HEAT}, s AS (SELECT unnest(['lst_native30', 'lst_bicubic10', 'lst_regress10']) AS variant, unnest([lst_native30, lst_bicubic10, lst_regress10]) AS v FROM heat) SELECT variant, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS least, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, round(max(v), 6) AS most, round(stddev_samp(v) / abs(avg(v)), 6) AS cv FROM s GROUP BY 1")
def describe_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validation.describe_variants(V.heat(spark, sf_dir), "zone_id", VARIANTS)
    return rounded(out, *out.columns[2:])


def student_sql(t: str, df: str) -> str:
    """The two-sided tail by Simpson's rule over the middle of the density, with t as a tangent: smooth, and bounded at both ends."""
    step = f"(atan(abs({t}) / sqrt({df})) / 2000)"
    scale = f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi())"
    return f"1 - 2 * {scale} * {step} / 3 * list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos(i * {step}), {df} - 1)))"


@query(f"WITH {HEAT}, g AS (SELECT lst_native30 AS x, lst_native30 - lst_bicubic10 AS y FROM heat), f AS (SELECT count(*) AS n, corr(y, x) AS r, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2 FROM g), t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM f), p AS (SELECT *, {student_sql('t', '(n - 2)')} AS p FROM t) SELECT n, round(r, 6) AS r, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, round(t, 4) AS t, round(p, 8) + 0.0 AS p, r > 0.4 AND p < 0.05 AS warning FROM p")
def linear_gap_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = validation.pairwise_differences(V.heat(spark, sf_dir), "lst_native30", VARIANTS[1:])
    fit = validation.linear_gap_fit(gaps, "lst_native30", "lst_native30_minus_lst_bicubic10")
    return rounded(rounded(rounded(fit, "r", "slope", "intercept", "r2"), "t", digits=4), "p", digits=8)


def _rank_sql() -> str:
    cov = ", ".join(f"covar_samp({x}, {y}) AS {x}{y}" for x, y in ("aa", "ab", "ac", "bb", "bc", "cc"))
    turned = ["aa * x + ab * y + ac * z", "ab * x + bb * y + bc * z", "ac * x + bc * y + cc * z"]
    return f"""WITH RECURSIVE {HEAT}, v AS (SELECT zone_id, variant, exposure, s_acctbal AS sens, (s_suppkey * 37) % 100 / 100.0::DOUBLE AS green
  FROM (SELECT zone_id, unnest({VARIANTS}) AS variant, unnest([{', '.join(f'round({v}, 9)' for v in VARIANTS)}]) AS exposure FROM heat) JOIN supplier ON s_suppkey = zone_id),
n AS (SELECT variant, zone_id, {norm('exposure', 'PARTITION BY variant')} AS a, {norm('sens', 'PARTITION BY variant')} AS b, {norm('(1 - green)', 'PARTITION BY variant')} AS c FROM v),
m AS (SELECT variant, {cov} FROM n GROUP BY 1),
it AS (SELECT 0 AS k, variant, 1.0::DOUBLE AS x, 0.9::DOUBLE AS y, 0.8::DOUBLE AS z FROM m UNION ALL SELECT k + 1, variant, p / s, q / s, r / s
  FROM (SELECT *, sqrt(p * p + q * q + r * r) AS s FROM (SELECT k, variant, {turned[0]} AS p, {turned[1]} AS q, {turned[2]} AS r FROM it JOIN m USING (variant))) WHERE k < 64),
s AS (SELECT variant, 'equal' AS weighting, zone_id, round((a + b + c) / 3, 12) AS score FROM n UNION ALL SELECT variant, 'pca', zone_id, round((x * a + y * b + z * c) / (x + y + z), 12) FROM n JOIN it USING (variant) WHERE k = 64),
r AS (SELECT *, rank() OVER (PARTITION BY variant, weighting ORDER BY score) + (count(*) OVER (PARTITION BY variant, weighting, score) - 1) / 2 AS rank, row_number() OVER (PARTITION BY variant, weighting ORDER BY score DESC, zone_id) AS at FROM s),
e AS (SELECT variant, sqrt(avg(pow(exposure - lst_heldout_c, 2))) AS rmse FROM v JOIN held USING (zone_id) GROUP BY 1)
SELECT r.variant, r.weighting, round(any_value(rmse), 6) AS rmse, round(corr(r.rank, f.rank), 6) AS spearman, round(count(*) FILTER (r.at <= 20 AND f.at <= 20) / 20, 6) AS overlap
FROM r JOIN r f ON f.variant = '{VARIANTS[0]}' AND f.weighting = r.weighting AND f.zone_id = r.zone_id JOIN e ON e.variant = r.variant GROUP BY 1, 2"""


@query(_rank_sql())
def rank_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    pillars = V.pillars(spark, sf_dir).drop("exposure").join(V.heat(spark, sf_dir).select("zone_id", *[F.round(v, 9).alias(v) for v in VARIANTS]), "zone_id")
    return rounded(validation.rank_impact(pillars, V.heldout(spark, sf_dir), VARIANTS, VARIANTS[0]), "rmse", "spearman", "overlap")


@query(f"WITH b AS ({ORACLES['bootstrap_bands_all']}), t AS (SELECT * FROM b ORDER BY point DESC, zone_id LIMIT 20), o AS (SELECT p05 <= lead(p95) OVER (ORDER BY point DESC, zone_id) AS overlap FROM t) SELECT count(*) FILTER (overlap) AS overlaps, count(overlap) AS pairs FROM o")
def adjacent_band_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = rounded(scores.bootstrap_bands(V.pillars(spark, sf_dir), 1.5, 0.05), "point", "p05", "p95")
    return validation.adjacent_band_overlap(bands)


_MODELS = "m AS (SELECT unnest(['a', 'b']) AS model, nullif(1 + label % 4, 5 * (vec_id % 11 = 0)::INT + label % 4 - 4) AS t, unnest([1 + (label + (vec_id % 5 = 0)::INT) % 4, (label + vec_id % 3) % 5]) AS p FROM embeddings)"
_F1 = [f"coalesce(2 * count(*) FILTER (t = {k} AND p = {k}) / nullif(count(*) FILTER (t = {k}) + count(*) FILTER (p = {k}), 0), 0)" for k in (1, 2, 3, 4)]


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.load(spark, sf_dir, "embeddings")
    true = F.nullif(1 + F.col("label") % 4, 5 * (F.col("vec_id") % 11 == 0).cast("int") + F.col("label") % 4 - 4).cast("int")
    a, b = 1 + (F.col("label") + (F.col("vec_id") % 5 == 0).cast("int")) % 4, (F.col("label") + F.col("vec_id") % 3) % 5
    preds = F.explode(F.array(F.struct(F.lit("a").alias("model"), a.cast("int").alias("p")), F.struct(F.lit("b").alias("model"), b.cast("int").alias("p"))))
    return e.select(true.alias("t"), preds.alias("x")).select("x.model", "t", "x.p")


@query(f"WITH {_MODELS}, d AS (SELECT model, count(*) FILTER (t IS NULL) AS unlabelled, count(*) FILTER (t IS NOT NULL AND (p IS NULL OR p = 0)) AS unpredicted FROM m GROUP BY 1), u AS (SELECT model, count(*) AS n, round(avg((t = p)::INT), 6) AS accuracy, round(({' + '.join(_F1)}) / 4, 6) AS macro_f1, round(({' + '.join(f'{f} * count(*) FILTER (t = {k})' for k, f in zip((1, 2, 3, 4), _F1, strict=True))}) / count(*), 6) AS weighted_f1 FROM m WHERE t IS NOT NULL AND p <> 0 GROUP BY 1) SELECT * FROM d JOIN u USING (model)")
def compare_classifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.classifier_summary(_models(spark, sf_dir), "model", "t", "p", [1, 2, 3, 4]), "accuracy", "macro_f1", "weighted_f1")


@query(f"WITH {_MODELS}, r AS (SELECT count(*) AS n, avg((p = 1)::INT) AS recall FROM m WHERE model = 'a' AND t = 1) SELECT n, round(recall, 6) AS recall, round(sqrt(recall * (1 - recall) / n), 6) AS standard_error FROM r")
def recall_standard_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.recall_standard_error(_models(spark, sf_dir).where("model = 'a'"), "t", "p", 1), "recall", "standard_error")


@query(f"WITH {HEAT}, m AS (SELECT avg(lst_native30) AS a, avg(lst_regress10) AS b FROM heat) SELECT count(*) AS n, round(avg((sign(round(lst_native30 - a, 9)) = sign(round(lst_regress10 - b, 9)))::INT), 6) AS agreement FROM heat, m")
def direction_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    heat = V.heat(spark, sf_dir)
    means = heat.agg(F.avg("lst_native30").alias("ma"), F.avg("lst_regress10").alias("mb"))  # one row
    deltas = heat.crossJoin(F.broadcast(means)).select(F.round(F.col("lst_native30") - F.col("ma"), 9).alias("a"), F.round(F.col("lst_regress10") - F.col("mb"), 9).alias("b"))
    return rounded(validation.direction_agreement(deltas, "a", "b"), "agreement")


@query(f"WITH {HEAT}, j AS (SELECT zone_id % 5 = 0 AS held, lst_heldout_c AS y, lst_native30 - lst_heldout_c AS g FROM heat JOIN held USING (zone_id)) SELECT held, count(*) AS n, round(sqrt(avg(g * g)), 6) AS rmse, round(1 - avg(g * g) / var_pop(y), 6) AS r2, round(avg(g), 6) AS mean_residual FROM j GROUP BY 1")
def prediction_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.heat(spark, sf_dir).join(V.heldout(spark, sf_dir), "zone_id").withColumn("held", F.col("zone_id") % 5 == 0)
    return rounded(validation.prediction_residuals(rows, "lst_heldout_c", "lst_native30", "held"), "rmse", "r2", "mean_residual")


@query("SELECT round(sum(w * (t = p)::INT) / greatest(sum(w), 1e-8), 6) AS accuracy, round(sqrt(sum(w * pow(p - t, 2)) / greatest(sum(w), 1e-8)), 6) AS rmse FROM (SELECT 1 + label % 4 AS t, 1 + (label + (vec_id % 5 = 0)::INT) % 4 AS p, (vec_id % 7)::DOUBLE AS w FROM embeddings)")
def weighted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.scored_points(spark, sf_dir).withColumn("w", F.col("vec_id") % 7)
    return rounded(validation.weighted_scores(rows, "true", "pred", "w"), "accuracy", "rmse")


@query(f"WITH {INDEXED}, k AS (SELECT CASE WHEN ndwi > 0.1 THEN 4 WHEN ndvi > 0.35 THEN 1 WHEN ndbi > 0 THEN 2 ELSE 3 END AS class, ndvi, ndbi, lst FROM ix WHERE ndvi IS NOT NULL AND ndbi IS NOT NULL AND lst IS NOT NULL) SELECT c AS class, round(coalesce(avg(ndvi), 0), 6) AS ndvi, round(coalesce(avg(ndbi), 0), 6) AS ndbi, round(coalesce(avg(lst), 0), 6) AS lst FROM (SELECT unnest([1, 2, 3, 4]) AS c) LEFT JOIN k ON c = class GROUP BY 1")
def class_mean_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _indexed(spark, sf_dir).withColumn("class", X.rule_landcover(F.col("ndwi"), F.col("ndvi"), F.col("ndbi")))
    return rounded(validation.class_mean_vectors(cells, "class", ["ndvi", "ndbi", "lst"], [1, 2, 3, 4]), "ndvi", "ndbi", "lst")


@query(f"WITH {INDEXED}, z AS (SELECT {ZONE} AS zone_id, avg((ndvi > 0.35)::INT) AS greenery FROM ix GROUP BY 1), s AS (SELECT DISTINCT ((p_partkey // 48) // 12) * 4 + (p_partkey % 48) // 12 AS zone_id FROM part) SELECT zone_id, round(greenery, 6) AS greenery_fraction FROM s LEFT JOIN z USING (zone_id)")
def adaptive_pillar_ndvi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zonal mean of a threshold mask."""
    zone = V.zone_cells(spark, sf_dir)
    cells = _indexed(spark, sf_dir).select("gx", "gy", (F.col("ndvi") > 0.35).cast("int").alias("greenery_fraction"))
    return rounded(raster.zonal_mean(cells, zone, zone.select("zone_id").distinct(), "greenery_fraction"), "greenery_fraction")


_SIL = """r AS (SELECT label % 4 AS k, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), r2 AS (SELECT *, list_dot_product(x, x) AS xx FROM r),
e AS (SELECT k, unnest(range(1, 65)) AS i, unnest(x) AS v FROM r), m AS (SELECT k, list(v ORDER BY i) AS m FROM (SELECT k, i, avg(v) AS v FROM e GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT k, avg(xx) AS s, count(*) AS c FROM r2 GROUP BY 1), d AS (SELECT r2.k, a.k AS o, c, xx - 2 * list_dot_product(x, m) + s AS d, row_number() OVER () AS u, r2.x FROM r2, a JOIN m ON a.k = m.k),
p AS (SELECT x, k, max(d * c / (c - 1)) FILTER (k = o) AS a, min(d) FILTER (k <> o) AS b FROM d GROUP BY x, k)"""


@query(f"""WITH {_SIL}, n AS (SELECT k, count(*) AS n FROM r GROUP BY 1), q AS (SELECT count(*) AS clusters, min(n) AS smallest, max(n) AS largest FROM n),
sq AS (SELECT round(sum((b - a) / greatest(a, b) * w) / sum(w), 6) AS silhouette_squared FROM p JOIN (SELECT x, k, count(*) AS w FROM r GROUP BY 1, 2) USING (x, k)),
y AS (SELECT row_number() OVER () AS i, k, x FROM r), f AS (SELECT g.i, g.k AS own, h.k, sum(list_distance(g.x, h.x)) AS d FROM y g, y h GROUP BY 1, 2, 3),
v AS (SELECT i, max(d / (n - 1)) FILTER (own = f.k AND n > 1) AS a, min(d / n) FILTER (own <> f.k) AS b FROM f JOIN n USING (k) GROUP BY 1),
s AS (SELECT round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 6) AS silhouette FROM v),
w AS (SELECT r.k, any_value(m) AS m, avg(list_distance(x, m)) AS s FROM r JOIN m USING (k) GROUP BY 1),
db AS (SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT g.k, max((g.s + h.s) / list_distance(g.m, h.m)) AS r FROM w g JOIN w h ON g.k <> h.k GROUP BY 1))
SELECT clusters, smallest, largest, silhouette, davies_bouldin, silhouette_squared, smallest < 3 OR silhouette < 0.15 AS degenerate FROM q, s, sq, db""")
def cluster_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.load(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 4).cast("int").alias("cluster"), "embedding")
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    placed = rows.select(F.col("vec_id").alias("key"), F.lit("given").alias("labelling"), "cluster", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    near = rounded(clusters.labelled_silhouettes(placed.select("key", "x", F.create_map("labelling", "cluster").alias("own"))), "silhouette")
    spread = rounded(clusters.davies_bouldins(placed), "davies_bouldin")
    plain = rounded(validation.silhouette_squared(rows, "cluster", "embedding").withColumnRenamed("silhouette", "silhouette_squared"), "silhouette_squared")
    return validation.cluster_quality(sizes, near, spread, plain)


@query("WITH p AS (SELECT label % 4 AS k, avg(embedding[1]::DOUBLE) AS h, avg(embedding[2]::DOUBLE) AS b, avg(embedding[3]::DOUBLE) AS v FROM embeddings GROUP BY 1), t AS (SELECT (SELECT k FROM p ORDER BY h DESC, k LIMIT 1) AS hottest, (SELECT k FROM p ORDER BY b DESC, k LIMIT 1) AS mb, (SELECT k FROM p ORDER BY v, k LIMIT 1) AS lv) SELECT hottest, hottest = mb AS built_agrees, hottest = lv AS vegetation_agrees FROM t")
def landcover_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = metrics.profile_clusters(V.cluster_rows(spark, sf_dir), "cluster", ["f0", "f1", "f2"])
    return validation.landcover_coherence(profile, "cluster", "f0", "f1", "f2")


@query("WITH d AS (SELECT ts::DATE AS day, count(*) AS readings, count(DISTINCT user_id) AS stations FROM events GROUP BY 1), s AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d) SELECT strftime(day, '%Y-%m-%d') AS day, coalesce(readings, 0) AS readings, coalesce(stations, 0) AS stations, coalesce(stations, 0) >= 10 AS readable FROM s LEFT JOIN d USING (day)")
def reading_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.reading_depth(V.load(spark, sf_dir, "events"), "ts", "user_id").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("SELECT user_id % 10 AS zone_id, round(avg(value), 6) AS mean_value, count(*) AS n FROM events GROUP BY 1")
def zone_reading_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = V.load(spark, sf_dir, "events")
    return rounded(events.groupBy((F.col("user_id") % 10).alias("zone_id")).agg(F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("n")), "mean_value")


@query(f"WITH {INDEXED}, p AS (SELECT c_custkey AS point_id, floor((c_custkey * 37) % 6000 / 100.0::DOUBLE + 0.003)::BIGINT AS gx, floor((c_custkey * 91) % 6000 / 100.0::DOUBLE + 0.007)::BIGINT AS gy FROM customer) SELECT point_id, round(lst, 6) AS lst FROM p LEFT JOIN ix ON p.gx = ix.gx AND p.gy = ix.gy")
def sample_at_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = V.points(spark, sf_dir).select("point_id", F.floor("x").alias("gx"), F.floor("y").alias("gy"))
    return rounded(validation.sample_at_points(_composite(spark, sf_dir), points, "lst").select("point_id", "lst"), "lst")


_PERIODS = "e AS (SELECT l_partkey % 48 AS gx, l_partkey // 48 AS gy, 1 + l_linenumber % 4 AS c, l_shipdate FROM lineitem)"


def _first(when: str) -> str:
    return f"(SELECT gx, gy, c FROM (SELECT gx, gy, c, row_number() OVER (PARTITION BY gx, gy ORDER BY count(*) DESC, c) AS k FROM e WHERE {when} GROUP BY 1, 2, 3) WHERE k = 1)"


_BOTH = f"WITH {_PERIODS}, j AS (SELECT coalesce(x.gx, y.gx) AS gx, coalesce(x.gy, y.gy) AS gy, x.c AS e, y.c AS l FROM {_first('year(l_shipdate) = 1993')} x FULL JOIN {_first('year(l_shipdate) = 1997')} y ON x.gx = y.gx AND x.gy = y.gy)"


def _periods(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = V.load(spark, sf_dir, "lineitem")
    cells = lines.select((F.col("l_partkey") % 48).alias("gx"), F.floor(F.col("l_partkey") / 48).alias("gy"), (1 + F.col("l_linenumber") % 4).alias("class"), F.year("l_shipdate").alias("y"))
    return raster.composite_mode(cells.where("y = 1993"), "class"), raster.composite_mode(cells.where("y = 1997"), "class")


@query(f"{_BOTH} SELECT count(*) AS n_valid, round(avg((e <> l)::INT), 6) AS change_fraction FROM j WHERE e IS NOT NULL AND l IS NOT NULL")
def overall_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    early, late = _periods(spark, sf_dir)
    both = early.withColumnRenamed("class", "e").join(late.withColumnRenamed("class", "l"), ["gx", "gy"], "full")
    return rounded(validation.overall_change(both, "e", "l"), "change_fraction")


@query(f"{_BOTH}, s AS (SELECT {ZONE} AS zone_id, count(*) FILTER (e IS NOT NULL AND l IS NOT NULL) AS n, count(e) AS a, count(l) AS b FROM j GROUP BY 1) SELECT count(*) FILTER (n = 0) AS gaps, count(*) FILTER (n = 0 AND a = 0 AND b > 0) AS lack_early, count(*) FILTER (n = 0 AND a > 0 AND b = 0) AS lack_late, count(*) FILTER (n = 0 AND a = 0 AND b = 0) AS lack_both FROM s")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.coverage_gap_report(metrics.zonal_change(*_periods(spark, sf_dir), V.zone_cells(spark, sf_dir)))
