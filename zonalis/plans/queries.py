"""Registered queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.functions import expressions as X
from zonalis.operators import metrics, raster, sampling, scores, zones
from zonalis.plans import views as V
from zonalis.streaming.readings import hourly_means

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

OBS = """obs AS (SELECT l_partkey % 48 AS gx, l_partkey // 48 AS gy, l_orderkey AS scene_id, l_shipdate AS acquired_at, o_totalprice % 100 AS scene_cloud, l_discount * 1000 AS cloud_prob,
  CASE l_linenumber WHEN 7 THEN 8 WHEN 6 THEN 16 ELSE l_linenumber % 2 END AS qa, CASE WHEN l_tax > 0 THEN 0 ELSE 1 END AS sat, l_linenumber + 2 AS scl, l_extendedprice AS nir,
  l_quantity * 1000 AS red, l_extendedprice * (1 - l_discount) AS swir, l_quantity * 800 AS green, 40000 + l_quantity * 200 AS lst_raw FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
CLEAR = OBS + """, clear AS (SELECT * FROM obs WHERE scene_cloud < 70 AND (qa & 62) = 0 AND sat = 0 AND cloud_prob < 70)"""
COMPOSITE = CLEAR + """, comp AS (SELECT gx, gy, median(lst_raw * 0.00341802 + 149.0 - 273.15) AS lst, median(nir) AS nir, median(red) AS red, median(swir) AS swir, median(green) AS green FROM clear GROUP BY 1, 2)"""
ZONE = "(gy // 12) * 4 + gx // 12"
PILLARS = """heat AS (SELECT l_suppkey AS zone_id, round(avg(l_quantity), 9) AS exposure FROM lineitem GROUP BY 1),
pillars AS (SELECT h.zone_id, exposure, s_acctbal AS sensitivity_raw, (s_suppkey * 37) % 100 / 100.0::DOUBLE AS greenery_fraction FROM heat h JOIN supplier ON h.zone_id = s_suppkey)"""


def norm(c: str, over: str = "") -> str:
    return f"CASE WHEN max({c}) OVER ({over}) = min({c}) OVER ({over}) THEN 0.0 ELSE ({c} - min({c}) OVER ({over})) / (max({c}) OVER ({over}) - min({c}) OVER ({over})) END"


SCORED = PILLARS + f""", scored AS (SELECT *, ({norm('exposure')} + {norm('sensitivity_raw')} + {norm('(1 - greenery_fraction)')}) / 3 AS score FROM pillars)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Sums of doubles depend on their order; the last digits are cut. Adding 0 makes -0 plain."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


def _clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.observations(spark, sf_dir).where((F.col("scene_cloud") < 70) & X.qa_clear(F.col("qa"), F.col("sat")) & X.cloud_free(F.col("cloud_prob")))


def _composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = _clear(spark, sf_dir).withColumn("lst", X.thermal_celsius(F.col("lst_raw")))
    return raster.composite_median(scaled, ["lst", "nir", "red", "swir", "green"])


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    nd, c = X.normalized_difference, F.col
    return _composite(spark, sf_dir).withColumns({"ndvi": nd(c("nir"), c("red")), "ndbi": nd(c("swir"), c("nir")), "ndwi": nd(c("green"), c("nir"))})


INDEXED = COMPOSITE + """, ix AS (SELECT *, (nir - red) / nullif(nir + red, 0) AS ndvi, (swir - nir) / nullif(swir + nir, 0) AS ndbi, (green - nir) / nullif(green + nir, 0) AS ndwi FROM comp)"""


@query(f"WITH {INDEXED} SELECT gx, gy, round(lst, 6) AS lst, round(ndvi, 6) AS ndvi, round(ndbi, 6) AS ndbi, round(ndwi, 6) AS ndwi FROM ix")
def composite_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_indexed(spark, sf_dir).select("gx", "gy", "lst", "ndvi", "ndbi", "ndwi"), "lst", "ndvi", "ndbi", "ndwi")


@query(f"WITH {OBS} SELECT scl, count(*) AS n, count(*) FILTER (scl NOT IN (3, 8, 9, 10, 11)) AS kept, count(*) FILTER ((qa & 62) = 0 AND sat = 0) AS clear FROM obs GROUP BY 1")
def mask_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = V.observations(spark, sf_dir)
    return obs.groupBy("scl").agg(F.count(F.lit(1)).alias("n"), F.count_if(X.scene_class_kept(F.col("scl"))).alias("kept"), F.count_if(X.qa_clear(F.col("qa"), F.col("sat"))).alias("clear"))


@query(f"WITH {OBS} SELECT count(*) AS n, count(*) FILTER (acquired_at >= TIMESTAMP '1997-01-01' AND acquired_at < TIMESTAMP '1998-01-01') AS in_period, count(*) FILTER (month(acquired_at) IN (6, 7, 8) AND year(acquired_at) IN (1996, 1997, 1998)) AS in_season, count(*) FILTER (month(acquired_at) IN (6, 7, 8) AND acquired_at >= TIMESTAMP '1997-01-01' AND acquired_at < TIMESTAMP '1998-01-01') AS both_ FROM obs")
def season_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("acquired_at")
    obs = V.observations(spark, sf_dir)
    season, period = X.in_season(at, [1996, 1997, 1998], [6, 7, 8]), X.in_period(at, "1997-01-01", "1998-01-01")
    return obs.agg(F.count(F.lit(1)).alias("n"), F.count_if(period).alias("in_period"), F.count_if(season).alias("in_season"), F.count_if(X.in_period(at, "1997-01-01", "1998-01-01", [6, 7, 8])).alias("both_"))


@query(f"WITH {INDEXED}, k AS (SELECT CASE WHEN ndwi > 0.1 THEN 4 WHEN ndvi > 0.35 THEN 1 WHEN ndbi > 0 THEN 2 ELSE 3 END AS class FROM ix) SELECT class, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM k GROUP BY 1")
def landcover_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _indexed(spark, sf_dir).withColumn("class", X.rule_landcover(F.col("ndwi"), F.col("ndvi"), F.col("ndbi")))
    return rounded(metrics.class_histogram(cells, "class"), "share")


@query(f"WITH {COMPOSITE} SELECT gx // 3 AS gx, gy // 3 AS gy, round(avg(lst), 6) AS lst FROM comp GROUP BY 1, 2")
def coarsen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.coarsen_mean(_composite(spark, sf_dir), ["lst"], 3), "lst")


_REFINE = """, c AS (SELECT gx, gy, lst AS v FROM comp), o AS (SELECT range AS o FROM range(-{reach}, {end})), k AS (SELECT o, abs((o + 0.5) / 2 - 0.5) AS d FROM o), w AS (SELECT o, {kernel} AS w FROM k),
s AS (SELECT gx * 2 + a.o AS gx, gy * 2 + b.o AS gy, sum(a.w * b.w) AS w, sum(a.w * b.w * v) AS v FROM c, w a, w b WHERE a.w * b.w <> 0 GROUP BY 1, 2)
SELECT s.gx, s.gy, round(s.v / s.w + 1e-8, 6) AS lst FROM s JOIN c ON floor(s.gx / 2) = c.gx AND floor(s.gy / 2) = c.gy"""


@query(f"WITH {COMPOSITE}" + _REFINE.format(reach=2, end=4, kernel="greatest(1 - d, 0.0)"))
def refine_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = raster.refine_bilinear(_composite(spark, sf_dir).select("gx", "gy", "lst"), "lst", 2)
    return rounded(fine.withColumn("lst", F.col("lst") + 1e-8), "lst")  # sixteenths: off the halves


@query(f"WITH {COMPOSITE}" + _REFINE.format(reach=4, end=6, kernel="CASE WHEN d <= 1 THEN 1.5 * d * d * d - 2.5 * d * d + 1 WHEN d < 2 THEN -0.5 * d * d * d + 2.5 * d * d - 4 * d + 2 ELSE 0 END"))
def refine_bicubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = raster.refine_bicubic(_composite(spark, sf_dir).select("gx", "gy", "lst"), "lst", 2)
    return rounded(fine.withColumn("lst", F.col("lst") + 1e-8), "lst")


@query(f"WITH {COMPOSITE} SELECT z.zone_id, round(avg(lst), 6) AS lst FROM (SELECT DISTINCT {ZONE.replace('gy', 'b').replace('gx', 'a')} AS zone_id, a, b FROM (SELECT p_partkey % 48 AS a, p_partkey // 48 AS b FROM part)) z LEFT JOIN comp ON gx = a AND gy = b GROUP BY 1")
def zonal_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = V.zone_cells(spark, sf_dir)
    return rounded(raster.zonal_mean(_composite(spark, sf_dir), zone, zone.select("zone_id").distinct(), "lst"), "lst")


@query(f"WITH {INDEXED}, k AS (SELECT {ZONE} AS zone_id, CASE WHEN ndwi > 0.1 THEN 4 WHEN ndvi > 0.35 THEN 1 WHEN ndbi > 0 THEN 2 ELSE 3 END AS class FROM ix), z AS (SELECT DISTINCT ((p_partkey // 48) // 12) * 4 + (p_partkey % 48) // 12 AS zone_id FROM part), s AS (SELECT zone_id, count(*) AS n, count(*) FILTER (class = 1) AS v, count(*) FILTER (class = 2) AS b, count(*) FILTER (class = 3) AS r, count(*) FILTER (class = 4) AS w FROM k GROUP BY 1) SELECT z.zone_id, coalesce(n, 0) AS n, round(v / n, 6) AS fraction_vegetation, round(b / n, 6) AS fraction_built_up, round(r / n, 6) AS fraction_bare, round(w / n, 6) AS fraction_water FROM z LEFT JOIN s USING (zone_id)")
def zonal_class_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _indexed(spark, sf_dir).withColumn("class", X.rule_landcover(F.col("ndwi"), F.col("ndvi"), F.col("ndbi")))
    zone = V.zone_cells(spark, sf_dir)
    out = raster.zonal_class_fractions(cells, zone, zone.select("zone_id").distinct(), {1: "vegetation", 2: "built_up", 3: "bare", 4: "water"})
    return rounded(out, *[c for c in out.columns if c.startswith("fraction")])


@query(f"WITH {COMPOSITE} SELECT (gy // 8) * 6 + gx // 8 AS patch_idx, count(*) AS n, max(gy % 8) AS last_row, max(gx % 8) AS last_col FROM comp GROUP BY 1")
def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = raster.assign_patch(_composite(spark, sf_dir), 8, 6)
    return cells.groupBy("patch_idx").agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("last_row"), F.max("col").alias("last_col"))


@query(f"WITH {COMPOSITE} SELECT a.gx, a.gy, round(avg(b.lst), 6) AS lst_mean FROM comp a JOIN comp b ON abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 GROUP BY 1, 2")
def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.neighbourhood_features(_composite(spark, sf_dir).select("gx", "gy", "lst"), "lst", 1).select("gx", "gy", "lst_mean"), "lst_mean")


_EDGES = """c AS (SELECT n_nationkey::BIGINT AS zone_id, (n_nationkey % 5) * 10.0::DOUBLE AS x, (n_nationkey // 5) * 10.0::DOUBLE AS y, CASE WHEN n_nationkey >= 20 THEN 4.0 ELSE 0.0 END::DOUBLE AS k FROM nation),
e AS (SELECT zone_id, x AS x1, y AS y1, x + 10 AS x2, y AS y2 FROM c UNION ALL SELECT zone_id, x + 10, y, x + 10, y + 10 - k FROM c UNION ALL SELECT zone_id, x + 10, y + 10 - k, x + 10 - k, y + 10 FROM c UNION ALL SELECT zone_id, x + 10 - k, y + 10, x, y + 10 FROM c UNION ALL SELECT zone_id, x, y + 10, x, y FROM c),
p AS (SELECT c_custkey AS point_id, (c_custkey * 37) % 6000 / 100.0::DOUBLE + 0.003 AS x, (c_custkey * 91) % 6000 / 100.0::DOUBLE + 0.007 AS y FROM customer)"""


@query(f"WITH {_EDGES} SELECT point_id, zone_id FROM p JOIN e ON (y1 > p.y) <> (y2 > p.y) AND p.x < x1 + (p.y - y1) * (x2 - x1) / (y2 - y1) GROUP BY 1, 2 HAVING count(*) % 2 = 1")
def point_in_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.point_in_zone(V.points(spark, sf_dir), V.zone_edges(spark, sf_dir))


_INSIDE = "h AS (SELECT point_id, zone_id FROM p JOIN e ON (y1 > p.y) <> (y2 > p.y) AND p.x < x1 + (p.y - y1) * (x2 - x1) / (y2 - y1) GROUP BY 1, 2 HAVING count(*) % 2 = 1)"


@query(f"WITH {_EDGES}, {_INSIDE}, q AS (SELECT count(*) AS points, count(*) FILTER (point_id NOT IN (SELECT point_id FROM h)) AS outside FROM p), z AS (SELECT count(*) AS zones, count(*) FILTER (zone_id IN (SELECT zone_id FROM h)) AS covered FROM c) SELECT points, outside, zones, covered, round(100.0::DOUBLE * covered / zones, 6) AS coverage_pct FROM q, z")
def placement_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, edges = V.points(spark, sf_dir), V.zone_edges(spark, sf_dir)
    return rounded(zones.placement_report(points, zones.point_in_zone(points, edges), edges), "coverage_pct")


@query(f"WITH {_EDGES}, g AS (SELECT DISTINCT p_partkey % 48 AS gx, p_partkey // 48 AS gy FROM part), o AS (SELECT gx, gy, (gx + 0.5::DOUBLE) * 0.8 AS x, (gy + 0.5::DOUBLE) * 0.8 AS y FROM g) SELECT gx, gy, zone_id FROM o JOIN e ON (y1 > o.y) <> (y2 > o.y) AND o.x < x1 + (o.y - y1) * (x2 - x1) / (y2 - y1) GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1")
def zone_cells_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells 0.8 wide in zones: most tiles are wholly inside, so their cells take an equi-join only."""
    return zones.zone_cells_of(V.zone_cells(spark, sf_dir).select("gx", "gy"), V.zone_edges(spark, sf_dir), pixel=0.8, size=2.5)


@query(f"WITH {_EDGES} SELECT zone_id, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 6) AS area, round(sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)), 6) AS cx, round(sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)), 6) AS cy FROM e GROUP BY 1")
def zone_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(zones.zone_area(V.zone_edges(spark, sf_dir)), "area", "cx", "cy")


@query(f"WITH {COMPOSITE}, {_EDGES} SELECT gx, gy FROM comp WHERE NOT EXISTS (SELECT 1 FROM p WHERE pow(gx - p.x, 2) + pow(gy - p.y, 2) <= 0.25)")
def exclude_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _composite(spark, sf_dir).select("gx", "gy", F.col("gx").cast("double").alias("x"), F.col("gy").cast("double").alias("y"))
    return zones.exclude_near(cells, V.points(spark, sf_dir).select("x", "y"), 0.5).select("gx", "gy")


@query(f"WITH {SCORED} SELECT zone_id, round(score, 6) AS score FROM scored ORDER BY score DESC, zone_id LIMIT 20")
def priority_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the 20 zones that come first, of all zones."""
    scored = scores.build_score(V.pillars(spark, sf_dir))
    return rounded(scored.orderBy(F.desc("score"), "zone_id").limit(20).select("zone_id", "score"), "score")


@query(f"WITH {SCORED} SELECT zone_id, round(score, 6) AS score FROM scored")
def priority_score_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every zone."""
    return rounded(scores.build_score(V.pillars(spark, sf_dir)).select("zone_id", "score"), "score")


_PCA = f""", n AS (SELECT zone_id, {norm('exposure')} AS a, {norm('sensitivity_raw')} AS b, {norm('(1 - greenery_fraction)')} AS c FROM pillars),
m AS (SELECT covar_samp(a, a) AS aa, covar_samp(a, b) AS ab, covar_samp(a, c) AS ac, covar_samp(b, b) AS bb, covar_samp(b, c) AS bc, covar_samp(c, c) AS cc FROM n),
it AS (SELECT 0 AS k, 1.0::DOUBLE AS x, 0.9::DOUBLE AS y, 0.8::DOUBLE AS z UNION ALL SELECT k + 1, (aa * x + ab * y + ac * z) / s, (ab * x + bb * y + bc * z) / s, (ac * x + bc * y + cc * z) / s
  FROM (SELECT *, sqrt(pow(aa * x + ab * y + ac * z, 2) + pow(ab * x + bb * y + bc * z, 2) + pow(ac * x + bc * y + cc * z, 2)) AS s FROM it, m) WHERE k < 64)"""


@query(f"WITH RECURSIVE {PILLARS} {_PCA} SELECT round(x / (x + y + z), 5) AS w1, round(y / (x + y + z), 5) AS w2, round(z / (x + y + z), 5) AS w3 FROM it WHERE k = 64")
def pca_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scores.pca_weights(V.pillars(spark, sf_dir)), "w1", "w2", "w3", digits=5)


@query(f"""WITH {PILLARS}, d AS (SELECT *, unnest(range(1000)) AS draw FROM pillars),
u AS (SELECT *, zone_id || '/' || draw AS k FROM d), g AS (SELECT *, {", ".join(f"greatest(('0x' || left(md5(k || '|draw-{n}-1'), 8))::BIGINT / 4294967296.0::DOUBLE, 1e-12) AS {n[0]}1, ('0x' || left(md5(k || '|draw-{n}-2'), 8))::BIGINT / 4294967296.0::DOUBLE AS {n[0]}2" for n in ("exposure", "greenery"))} FROM u),
x AS (SELECT zone_id, draw, exposure + 1.5 * sqrt(-2 * ln(e1)) * cos(2 * pi() * e2) AS exposure, sensitivity_raw, least(greatest(greenery_fraction + 0.05 * sqrt(-2 * ln(g1)) * cos(2 * pi() * g2), 0.0), 1.0) AS greenery_fraction FROM g),
s AS (SELECT zone_id, ({norm('exposure', 'PARTITION BY draw')} + {norm('sensitivity_raw', 'PARTITION BY draw')} + {norm('(1 - greenery_fraction)', 'PARTITION BY draw')}) / 3 AS score FROM x),
w AS (SELECT zone_id, ({norm('exposure')} + {norm('sensitivity_raw')} + {norm('(1 - greenery_fraction)')}) / 3 AS point FROM pillars)
SELECT zone_id, round(any_value(point), 6) AS point, round(quantile_cont(score, 0.05), 6) AS p05, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.95), 6) AS p95, round(quantile_cont(score, 0.95) - quantile_cont(score, 0.05), 6) AS band_width FROM s JOIN w USING (zone_id) GROUP BY 1""")
def bootstrap_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All zones with the operator's 1,000 draws."""
    return rounded(scores.bootstrap_bands(V.pillars(spark, sf_dir), 1.5, 0.05), "point", "p05", "p50", "p95", "band_width")


@query(f"WITH {PILLARS}, h AS (SELECT s_suppkey AS zone_id, (20 + s_suppkey % 9)::DOUBLE AS y FROM supplier) SELECT count(*) AS n, round(sqrt(avg(pow(exposure - y, 2))), 6) AS rmse FROM heat JOIN h USING (zone_id)")
def heldout_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    heat = V.heat(spark, sf_dir).select("zone_id", F.round("lst_native30", 9).alias("exposure"))
    return rounded(metrics.rmse(heat, V.heldout(spark, sf_dir), "zone_id", "exposure", "lst_heldout_c"), "rmse")


@query(f"WITH {PILLARS}, r AS (SELECT rank() OVER (ORDER BY exposure) + (count(*) OVER (PARTITION BY exposure) - 1) / 2 AS ra, rank() OVER (ORDER BY greenery_fraction) + (count(*) OVER (PARTITION BY greenery_fraction) - 1) / 2 AS rb FROM pillars) SELECT count(*) AS n, round(corr(ra, rb), 6) AS spearman FROM r")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.spearman(V.pillars(spark, sf_dir), "exposure", "greenery_fraction"), "spearman")


_PAIR = "s AS (SELECT vec_id, 1 + label % 4 AS t, 1 + (label + (vec_id % 5 = 0)::INT) % 4 AS p FROM embeddings)"


@query(f"WITH {_PAIR} SELECT t AS \"true\", count(*) FILTER (p = 1) AS pred_1, count(*) FILTER (p = 2) AS pred_2, count(*) FILTER (p = 3) AS pred_3, count(*) FILTER (p = 4) AS pred_4 FROM s GROUP BY 1")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_matrix(V.scored_points(spark, sf_dir), "true", "pred", [1, 2, 3, 4])


@query(f"WITH {_PAIR}, k AS (SELECT DISTINCT t AS class FROM s) SELECT class, round(count(*) FILTER (t = class AND p = class) / count(*) FILTER (p = class), 6) AS precision, round(count(*) FILTER (t = class AND p = class) / count(*) FILTER (t = class), 6) AS recall, round(2 * count(*) FILTER (t = class AND p = class) / (count(*) FILTER (t = class) + count(*) FILTER (p = class)), 6) AS f1, count(*) FILTER (t = class) AS support FROM k, s GROUP BY 1")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.classification_report(V.scored_points(spark, sf_dir), "true", "pred"), "precision", "recall", "f1")


@query("WITH n AS (SELECT count(*) AS n, avg((quality = toxic)::INT) AS o, sum(quality) AS qa, sum(toxic) AS qb FROM labels) SELECT n, round(o, 6) AS observed, round((o - e) / (1 - e), 6) AS kappa, CASE WHEN (o - e) / (1 - e) < 0 THEN 'poor (worse than chance)' WHEN (o - e) / (1 - e) < 0.2 THEN 'slight' WHEN (o - e) / (1 - e) < 0.4 THEN 'fair' WHEN (o - e) / (1 - e) < 0.6 THEN 'moderate' WHEN (o - e) / (1 - e) < 0.8 THEN 'substantial' ELSE 'almost perfect' END AS band FROM (SELECT *, (qa * qb + (n - qa) * (n - qb)) / (n * n) AS e FROM n)")
def annotator_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.agreement(V.load(spark, sf_dir, "labels"), "quality", "toxic")
    return rounded(out.withColumn("band", X.kappa_band(F.col("kappa"))), "observed", "kappa")


_LC = "e AS (SELECT l_partkey % 48 AS gx, l_partkey // 48 AS gy, 1 + l_linenumber % 4 AS c, l_shipdate FROM lineitem)"
_MODE = "(SELECT gx, gy, c, row_number() OVER (PARTITION BY gx, gy ORDER BY count(*) DESC, c) AS k FROM e WHERE {when} GROUP BY 1, 2, 3)"


@query(f"WITH {_LC}, a AS {_MODE.format(when='l_shipdate < TIMESTAMP ' + chr(39) + '1998-01-01' + chr(39))}, b AS {_MODE.format(when='l_shipdate >= TIMESTAMP ' + chr(39) + '1998-06-01' + chr(39))}, j AS (SELECT coalesce(x.gx, y.gx) AS gx, coalesce(x.gy, y.gy) AS gy, x.c AS e, y.c AS l FROM (SELECT * FROM a WHERE k = 1) x FULL JOIN (SELECT * FROM b WHERE k = 1) y ON x.gx = y.gx AND x.gy = y.gy), s AS (SELECT {ZONE} AS zone_id, avg((e <> l)::INT) AS f, count(*) FILTER (e IS NOT NULL AND l IS NOT NULL) AS n FROM j GROUP BY 1), z AS (SELECT DISTINCT ((p_partkey // 48) // 12) * 4 + (p_partkey % 48) // 12 AS zone_id FROM part) SELECT zone_id, round(f, 6) AS change_fraction, coalesce(n, 0) AS n_valid, CASE WHEN coalesce(n, 0) < 30 OR f IS NULL THEN 'insufficient_data' WHEN f > 0.15 THEN 'flagged' ELSE 'stable' END AS status FROM z LEFT JOIN s USING (zone_id)")
def land_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = V.load(spark, sf_dir, "lineitem")
    cells = lines.select((F.col("l_partkey") % 48).alias("gx"), F.floor(F.col("l_partkey") / 48).alias("gy"), (1 + F.col("l_linenumber") % 4).alias("class"), "l_shipdate")
    early = raster.composite_mode(cells.where("l_shipdate < timestamp '1998-01-01'"), "class")
    late = raster.composite_mode(cells.where("l_shipdate >= timestamp '1998-06-01'"), "class")
    zone = V.zone_cells(spark, sf_dir)
    change = metrics.zonal_change(early, late, zone).select("zone_id", "change_fraction", "n_valid")
    return rounded(scores.flag_unstable(zone.select("zone_id").distinct(), change), "change_fraction")


@query("WITH m AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS month FROM m) SELECT strftime(month, '%Y-%m') AS month, coalesce(n, 0) AS n FROM s LEFT JOIN m USING (month)")
def monthly_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.monthly_counts(V.load(spark, sf_dir, "orders"), "o_orderdate")


@query("WITH g AS (SELECT * FROM (VALUES ('dry', 20.0::DOUBLE), ('dry', 70.0), ('wet', 20.0), ('wet', 70.0)) t(candidate, threshold)), n AS (SELECT candidate, threshold, count(o_orderkey) AS n FROM g LEFT JOIN orders ON o_totalprice % 100 < threshold AND month(o_orderdate) IN (6, 7, 8) = (candidate = 'dry') AND (month(o_orderdate) IN (6, 7, 8) OR month(o_orderdate) IN (11, 12)) GROUP BY 1, 2) SELECT candidate, threshold, n, n >= 8 AS defensible FROM n")
def season_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = V.load(spark, sf_dir, "orders").select("o_orderdate", (F.col("o_totalprice") % 100).alias("cloud"))
    return metrics.season_windows(scenes, "o_orderdate", "cloud", {"dry": [6, 7, 8], "wet": [11, 12]}, [20.0, 70.0])


@query("SELECT user_id % 10 AS zone_id, time_bucket(INTERVAL 1 HOUR, ts) AS hour, round(avg(value), 6) AS mean_value, count(*) AS n FROM events GROUP BY 1, 2")
def zone_reading_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = V.load(spark, sf_dir, "events").select(F.col("user_id").alias("station_id"), "ts", "value")
    stations = events.select("station_id").distinct().withColumn("zone_id", F.col("station_id") % 10)
    return rounded(hourly_means(events, stations), "mean_value")


_F64 = ", ".join(f"embedding[{i + 1}]::DOUBLE AS f{i}" for i in range(64))


@query(f"WITH r AS (SELECT label % 4 AS cluster, {_F64} FROM embeddings) SELECT cluster, count(*) AS n, {', '.join(f'round(avg(f{i}), 6) AS f{i}' for i in range(64))} FROM r GROUP BY 1")
def cluster_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = [f"f{i}" for i in range(64)]
    return rounded(metrics.profile_clusters(V.cluster_rows(spark, sf_dir), "cluster", f), *f)


@query(f"WITH r AS (SELECT label % 4 AS cluster, {_F64} FROM embeddings), c AS (SELECT cluster, {', '.join(f'avg(f{i}) AS c{i}' for i in range(64))} FROM r GROUP BY 1), s AS (SELECT cluster, avg(sqrt({' + '.join(f'pow(f{i} - c{i}, 2)' for i in range(64))})) AS s FROM r JOIN c USING (cluster) GROUP BY 1), p AS (SELECT x.cluster, max((sx.s + sy.s) / sqrt({' + '.join(f'pow(x.c{i} - y.c{i}, 2)' for i in range(64))})) AS r FROM c x JOIN c y ON x.cluster <> y.cluster JOIN s sx ON sx.cluster = x.cluster JOIN s sy ON sy.cluster = y.cluster GROUP BY 1) SELECT round(avg(r), 6) AS davies_bouldin FROM p")
def davies_bouldin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.davies_bouldin(V.cluster_rows(spark, sf_dir), "cluster", [f"f{i}" for i in range(64)]), "davies_bouldin")


@query("WITH h AS (SELECT l_linenumber AS class, count(*) AS n FROM lineitem GROUP BY 1) SELECT class::INT AS class, n, n / sum(n) OVER () > 0.2 AS large FROM h")
def line_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_histogram(V.load(spark, sf_dir, "lineitem"), "l_linenumber").select(F.col("l_linenumber").alias("class"), "n", (F.col("share") > 0.2).alias("large"))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_linenumber ORDER BY ('0x' || left(md5((l_orderkey * 10 + l_linenumber) || '|pick'), 8))::BIGINT, l_orderkey) AS k FROM lineitem) WHERE k <= 12")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = V.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"))
    sizes = lines.select("l_linenumber").distinct().withColumn("take", F.lit(12))
    return sampling.stratified_sample(lines, "key", "l_linenumber", sizes, "pick").select("l_orderkey", "l_linenumber")


@query("SELECT count(*) FILTER (('0x' || left(md5(c_custkey || '|split'), 8))::BIGINT / 4294967296.0::DOUBLE >= 0.2) AS train, count(*) AS n FROM customer")
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hash_split(V.load(spark, sf_dir, "customer"), "c_custkey", 0.2, "split").agg(F.count_if("is_train").alias("train"), F.count(F.lit(1)).alias("n"))


@query("WITH a AS (SELECT DISTINCT s_nationkey AS k FROM supplier), b AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal < 0) SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS matched, count(*) FILTER (b.k IS NULL) AS only_left, count(*) FILTER (a.k IS NULL) AS only_right FROM a FULL JOIN b ON a.k = b.k")
def match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = V.load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return zones.match_report(a, V.load(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("k")), "k")


@query("WITH p AS (SELECT upper(trim(n_name)) AS name, sum(greatest(c_acctbal, 0)) AS total, sum(CASE WHEN c_mktsegment = 'BUILDING' THEN greatest(c_acctbal, 0) ELSE 0 END) AS elderly FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), s AS (SELECT *, coalesce(elderly / nullif(total, 0), 0) AS share FROM p), m AS (SELECT name, elderly / nullif(total, 0) AS elderly_proportion, 0.5 * (total - min(total) OVER ()) / (max(total) OVER () - min(total) OVER ()) + 0.5 * (share - min(share) OVER ()) / (max(share) OVER () - min(share) OVER ()) AS raw FROM s) SELECT name, round(elderly_proportion, 6) AS elderly_proportion, round(raw, 6) AS sensitivity_raw FROM m")
def sensitivity_pillar(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = F.greatest("c_acctbal", F.lit(0.0))
    people = V.load(spark, sf_dir, "customer").join(V.load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    by = people.groupBy(X.normalize_name(F.col("n_name")).alias("name")).agg(F.sum(money).alias("total"), F.sum(F.when(F.col("c_mktsegment") == "BUILDING", money).otherwise(0.0)).alias("elderly"))
    ids = V.load(spark, sf_dir, "nation").select(X.normalize_name(F.col("n_name")).alias("name"))
    return rounded(scores.sensitivity_pillar(by, ids).select("name", "elderly_proportion", "sensitivity_raw"), "elderly_proportion", "sensitivity_raw")


#: Earlier names of five queries, which stay valid.
for _name in ("monthly_scenes", "pca_weights", "spearman", "heldout_rmse", "bootstrap_bands"):
    QUERIES[f"{_name}_all"], ORACLES[f"{_name}_all"] = QUERIES[_name], ORACLES[_name]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
