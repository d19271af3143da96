"""Registered queries of the counts and checks that go with results, of places and of small raster steps, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.functions import expressions as X
from zonalis.functions import projections as P
from zonalis.operators import labelling, metrics, models, raster, sampling, scores, validation, zones
from zonalis.plans import views as V
from zonalis.plans.queries import _EDGES, CLEAR, COMPOSITE, INDEXED, PILLARS, ZONE, _clear, _composite, _indexed, norm, query, rounded

SEASONS = ["lst", "ndvi", "ndbi"]
_SEASONAL = f"""{CLEAR}, m AS (SELECT gx, gy, CASE WHEN month(acquired_at) IN (6, 7, 8, 9) THEN 'dry' WHEN month(acquired_at) IN (11, 12, 1, 2) THEN 'wet' END AS season, lst_raw * 0.00341802 + 149.0 - 273.15 AS lst, nir, red, swir FROM clear),
k AS (SELECT gx, gy, season, median(lst) AS lst, median(nir) AS nir, median(red) AS red, median(swir) AS swir FROM m WHERE season IS NOT NULL GROUP BY 1, 2, 3),
z AS (SELECT {ZONE} AS zone_id, season, avg(lst) AS lst, avg((nir - red) / nullif(nir + red, 0)) AS ndvi, avg((swir - nir) / nullif(swir + nir, 0)) AS ndbi FROM k GROUP BY 1, 2),
s AS (SELECT zone_id, {", ".join(f"max({f}) FILTER (season = '{s}') AS {f}_{s}" for f in SEASONS for s in ("dry", "wet"))} FROM z WHERE lst IS NOT NULL AND ndvi IS NOT NULL AND ndbi IS NOT NULL GROUP BY 1),
f AS (SELECT *, {", ".join(f"{f}_wet - {f}_dry AS {f}_delta" for f in SEASONS)} FROM s)"""
_SEASONAL_COLUMNS = [f"{f}_{s}" for f in SEASONS for s in ("dry", "wet", "delta")]


def _seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.month("acquired_at")
    season = F.when(month.isin(6, 7, 8, 9), "dry").when(month.isin(11, 12, 1, 2), "wet")
    scenes = _clear(spark, sf_dir).withColumn("lst", X.thermal_celsius(F.col("lst_raw")))
    cells = raster.seasonal_composites(scenes, season, ["lst", "nir", "red", "swir"])
    cells = cells.withColumns({"ndvi": X.normalized_difference(F.col("nir"), F.col("red")), "ndbi": X.normalized_difference(F.col("swir"), F.col("nir"))})
    return raster.seasonal_features(cells, V.zone_cells(spark, sf_dir), SEASONS)


@query(f"WITH {_SEASONAL} SELECT zone_id, {', '.join(f'round({c}, 5) AS {c}' for c in _SEASONAL_COLUMNS)} FROM f")
def seasonal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_seasonal(spark, sf_dir), *_SEASONAL_COLUMNS, digits=5)


@query(f"WITH {_SEASONAL}, a AS (SELECT DISTINCT ((p_partkey // 48) // 12) * 4 + (p_partkey % 48) // 12 AS zone_id FROM part) SELECT count(*) AS zones, count(f.zone_id) AS with_features, count(*) FILTER (lst_dry IS NOT NULL AND lst_wet IS NOT NULL) AS complete FROM a LEFT JOIN f USING (zone_id)")
def seasonal_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.completeness(_seasonal(spark, sf_dir), V.zone_cells(spark, sf_dir))


@query("SELECT count(DISTINCT o_orderkey) AS scenes, count(DISTINCT o_orderkey) < 20 AS few FROM orders WHERE year(o_orderdate) = 1997")
def period_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.period_report(V.load(spark, sf_dir, "orders").where("year(o_orderdate) = 1997"), "o_orderkey")


def _krueger_sql() -> str:
    """to_utm in SQL, of (id, lon, lat) rows called g."""
    a, e = P.coefficients(P.FORWARD), repr(P.ECCENTRICITY)
    x = " + ".join(f"{c!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(a, 1))
    y = " + ".join(f"{c!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(a, 1))
    k = repr(P.SCALE * P.RECTIFYING)
    return f"""t AS (SELECT *, sinh(atanh(sin(radians(lat))) - {e} * atanh({e} * sin(radians(lat)))) AS t, radians(lon - 105.0) AS lam FROM g),
h AS (SELECT *, atan2(t, cos(lam)) AS xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) AS eta FROM t),
xy AS (SELECT *, 500000.0 + {k} * (eta + {x}) AS x, {k} * (xi + {y}) AS y FROM h)"""


@query(f"WITH g AS (SELECT c_custkey AS id, 103.4 + (c_custkey * 37 % 1000) / 1000.0::DOUBLE AS lon, 1.1 + (c_custkey * 91 % 500) / 1000.0::DOUBLE AS lat FROM customer), {_krueger_sql()} SELECT id, round(x, 3) AS x, round(y, 3) AS y, trunc((x - 370000) / 100)::BIGINT AS gx, trunc((150000 - y) / 100)::BIGINT AS gy, round(lon, 9) AS lon, round(lat, 9) AS lat FROM xy")
def projected_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places to metres, to cells of a grid whose origin lies among them (offsets are cut towards zero), and back to degrees."""
    k = F.col("c_custkey")
    places = V.load(spark, sf_dir, "customer").select(k.alias("id"), (103.4 + (k * 37 % 1000) / 1000.0).alias("lon"), (1.1 + (k * 91 % 500) / 1000.0).alias("lat"))
    metres = places.select("id", *[v.alias(n) for n, v in P.to_utm(F.col("lon"), F.col("lat")).items()])
    cells = metres.withColumns(X.to_cell(F.col("x"), F.col("y"), (370000.0, 150000.0), 100.0)).withColumns(P.from_utm(F.col("x"), F.col("y")))
    return rounded(rounded(cells, "x", "y", digits=3), "lon", "lat", digits=9)


@query("WITH h AS (SELECT DISTINCT l_suppkey AS zone_id FROM lineitem), s AS (SELECT s_suppkey AS zone_id FROM supplier WHERE s_acctbal > 0), g AS (SELECT s_suppkey AS zone_id FROM supplier WHERE s_suppkey % 17 > 0) SELECT count(*) AS rows, count(*) FILTER (zone_id NOT IN (SELECT zone_id FROM s)) AS missing_sensitivity, count(*) FILTER (zone_id NOT IN (SELECT zone_id FROM g)) AS missing_greenery, count(*) FILTER (zone_id NOT IN (SELECT zone_id FROM s) OR zone_id NOT IN (SELECT zone_id FROM g)) AS dropped, count(*) FILTER (zone_id IN (SELECT zone_id FROM s) AND zone_id IN (SELECT zone_id FROM g)) AS joined FROM h")
def join_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What joining the pillars drops, and which pillar lacks it."""
    supplier = V.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("zone_id"), "s_acctbal")
    others = {"sensitivity": supplier.where("s_acctbal > 0"), "greenery": supplier.where("zone_id % 17 > 0").select("zone_id")}
    return zones.join_counted(V.heat(spark, sf_dir).select("zone_id", "lst_native30"), others, "zone_id")[1]


@query("WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0), b AS (SELECT DISTINCT o_custkey AS k FROM orders), l AS (SELECT k FROM a WHERE k NOT IN (SELECT k FROM b)), r AS (SELECT k FROM b WHERE k NOT IN (SELECT k FROM a)) SELECT (SELECT count(*) FROM a WHERE k IN (SELECT k FROM b)) AS matched, (SELECT count(*) FROM l) AS only_left, (SELECT count(*) FROM r) AS only_right, (SELECT coalesce(string_agg(k, ',' ORDER BY k), '') FROM (SELECT k FROM l ORDER BY k LIMIT 5)) AS left_names, (SELECT coalesce(string_agg(k, ',' ORDER BY k), '') FROM (SELECT k FROM r ORDER BY k LIMIT 5)) AS right_names")
def match_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = V.load(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    out = zones.match_report(a, V.load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k", names=5)
    return out.withColumns({c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",") for c in ("left_names", "right_names")})


@query(f"WITH {COMPOSITE}, {_EDGES}, n AS (SELECT count(*) AS cells, count(*) FILTER (EXISTS (SELECT 1 FROM p WHERE pow(gx - p.x, 2) + pow(gy - p.y, 2) <= 0.25)) AS excluded FROM comp) SELECT cells, excluded, excluded * 100.0::DOUBLE AS excluded_area, excluded * 100.0 < 1000 AS small FROM n")
def exclusion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _composite(spark, sf_dir).select("gx", "gy", F.col("gx").cast("double").alias("x"), F.col("gy").cast("double").alias("y"))
    return zones.exclusion_report(cells, zones.exclude_near(cells, V.points(spark, sf_dir).select("x", "y"), 0.5), pixel=10.0)


@query("WITH t AS (SELECT CASE WHEN c_acctbal < 0 THEN '-' ELSE c_acctbal::VARCHAR END AS a, CASE WHEN c_custkey % 9 = 0 THEN 'n/a' WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey::VARCHAR END AS b FROM customer) SELECT 'balance' AS field, count(*) FILTER (a = '-') AS suppressed, count(*) FILTER (a <> '-' AND try_cast(a AS DOUBLE) IS NULL) AS not_numeric FROM t UNION ALL SELECT 'number', count(*) FILTER (b = '-'), count(*) FILTER (b <> '-' AND try_cast(b AS DOUBLE) IS NULL) FROM t")
def suppression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from zonalis.sources.readers import suppression_report as report

    k = F.col("c_custkey")
    balance = F.when(F.col("c_acctbal") < 0, "-").otherwise(F.col("c_acctbal").cast("string"))
    number = F.when(k % 9 == 0, "n/a").when(k % 10 == 0, F.lit(None)).otherwise(k.cast("string"))
    return report(V.load(spark, sf_dir, "customer").select(balance.alias("balance"), number.alias("number")), ["balance", "number"])


@query("WITH n AS (SELECT count(*) AS n, avg((quality = toxic)::INT) AS o, sum(quality) AS qa, sum(toxic) AS qb, count(*) FILTER (quality <> toxic) AS d FROM labels), k AS (SELECT *, (qa * qb + (n - qa) * (n - qb)) / (n * n) AS e FROM n) SELECT n, round(o, 6) AS observed, round((o - e) / (1 - e), 6) AS kappa, d AS disagreements, (o - e) / (1 - e) >= 0.6 AS passed FROM k")
def agreement_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.agreement_report(V.load(spark, sf_dir, "labels"), "doc_id", "quality", "toxic")[0], "observed", "kappa")


_TAKES = "w AS (SELECT s_nationkey AS k, count(*) AS n, 2 + s_nationkey AS wanted FROM supplier GROUP BY 1)"


@query(f"WITH {_TAKES} SELECT k AS stratum, wanted::BIGINT AS wanted, least(n, wanted) AS taken, wanted - least(n, wanted) AS short FROM w WHERE n < wanted")
def sample_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("stratum"))
    sizes = rows.select("stratum").distinct().withColumn("take", 2 + F.col("stratum"))
    return sampling.shortfall(sampling.stratified_sample(rows, "key", "stratum", sizes, "short"), "stratum", sizes)


_SOURCES = "a AS (SELECT s_suppkey AS zone_id, (s_suppkey * 37 % 100) / 100.0::DOUBLE AS n FROM supplier WHERE s_suppkey % 5 > 0), b AS (SELECT s_suppkey AS zone_id, round(abs(s_acctbal) / 10000, 6) AS l FROM supplier WHERE s_suppkey % 3 > 0), j AS (SELECT zone_id, n, l FROM a FULL JOIN b USING (zone_id))"


def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("zone_id")
    supplier = V.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("zone_id"), "s_acctbal")
    ndvi = supplier.where(k % 5 > 0).select("zone_id", (k * 37 % 100 / 100.0).alias("greenery_fraction"))
    return ndvi, supplier.where(k % 3 > 0).select("zone_id", F.round(F.abs("s_acctbal") / 10000, 6).alias("greenery_fraction"))


@query(f"WITH {_SOURCES} SELECT zone_id, coalesce(l, n) AS greenery_fraction, l IS NULL AND n IS NOT NULL AS fell_back FROM j")
def adaptive_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.adaptive_source(*_sources(spark, sf_dir))


@query(f"WITH {_SOURCES}, r AS (SELECT rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2 AS x, rank() OVER (ORDER BY l) + (count(*) OVER (PARTITION BY l) - 1) / 2 AS y FROM j WHERE n IS NOT NULL AND l IS NOT NULL) SELECT (SELECT count(*) FROM j) AS zones, (SELECT count(*) FROM j WHERE l IS NULL) AS fell_back, count(*) AS compared, round(corr(x, y), 6) AS spearman FROM r")
def adaptive_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.adaptive_report(*_sources(spark, sf_dir))[1], "spearman")


@query("WITH d AS (SELECT ts::DATE AS day, count(DISTINCT user_id) AS s FROM events GROUP BY 1), l AS (SELECT max(day) AS last FROM d), w AS (SELECT last - b::INT AS day FROM l, range(7) t(b) WHERE last - b::INT >= (SELECT min(day) FROM d)) SELECT count(*) AS days, count(*) FILTER (coalesce(s, 0) >= 10) AS readable, count(*) FILTER (coalesce(s, 0) >= 10) >= 5 AS passed FROM w LEFT JOIN d USING (day)")
def depth_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.depth_gate(validation.reading_depth(V.load(spark, sf_dir, "events"), "ts", "user_id"))


#: Raw codes to four classes, as the query's parameter.
_CODES = {1: 1, 2: 1, 3: 2, 4: 3, 5: 4}


@query("WITH k AS (SELECT l_linenumber AS code, CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 4 END AS class FROM lineitem) SELECT code, class::INT AS class, count(*) AS n FROM k GROUP BY 1, 2")
def remap_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = V.load(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("code"))
    return lines.select("code", X.remap_class(F.col("code"), _CODES).cast("int").alias("class")).groupBy("code", "class").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {INDEXED}, o AS (SELECT range AS o FROM range(0, 3)) SELECT gx * 3 + a.o AS gx, gy * 3 + b.o AS gy, CASE WHEN ndwi > 0.1 THEN 4 WHEN ndvi > 0.35 THEN 1 WHEN ndbi > 0 THEN 2 ELSE 3 END AS class FROM ix, o a, o b")
def refine_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _indexed(spark, sf_dir).withColumn("class", X.rule_landcover(F.col("ndwi"), F.col("ndvi"), F.col("ndbi")))
    return raster.refine_nearest(cells, "class", 3)


@query(f"WITH {COMPOSITE}, g AS (SELECT DISTINCT p_partkey % 48 AS gx, p_partkey // 48 AS gy FROM part) SELECT round(count(lst) / count(*), 6) AS lst, round(count(*) FILTER (nir > 40000) / count(*), 6) AS nir FROM g LEFT JOIN (SELECT gx, gy, lst, nir FROM comp) USING (gx, gy)")
def coverage_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _composite(spark, sf_dir).select("gx", "gy", "lst", F.when(F.col("nir") > 40000, F.col("nir")).alias("nir"))
    return rounded(raster.coverage_fraction(cells, V.zone_cells(spark, sf_dir), ["lst", "nir"]), "lst", "nir")


@query("WITH a AS (SELECT DISTINCT l_partkey % 48 AS gx, l_partkey // 48 AS gy FROM lineitem WHERE l_discount > 0.09), b AS (SELECT DISTINCT l_partkey % 48 AS gx, l_partkey // 48 AS gy FROM lineitem WHERE l_tax > 0.07), j AS (SELECT a.gx AS x, b.gx AS y FROM a FULL JOIN b ON a.gx = b.gx AND a.gy = b.gy) SELECT count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n_both, count(*) FILTER (y IS NULL) AS n_a_only, count(*) FILTER (x IS NULL) AS n_b_only, round(count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) / count(*), 6) AS share_both FROM j")
def align_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = V.load(spark, sf_dir, "lineitem")
    cells = lambda rows: rows.select((F.col("l_partkey") % 48).alias("gx"), F.floor(F.col("l_partkey") / 48).alias("gy")).distinct()
    return rounded(raster.align_rasters(cells(lines.where("l_discount > 0.09")), cells(lines.where("l_tax > 0.07"))), "share_both")


_VOTERS = "v AS (SELECT DISTINCT p_partkey % 48 AS gx, p_partkey // 48 AS gy FROM part), w AS (SELECT gx, gy, [(1 + (gx * 7 + gy * 3) % 11)::DOUBLE, 1 + (gx + gy) % 7, 1 + gx % 5, 1 + gy % 3] AS a, [(1 + (gx * 5 + gy) % 9)::DOUBLE, 1 + (gx * gy) % 6, 1 + gy % 7, 2] AS b FROM v), n AS (SELECT gx, gy, list_transform(a, lambda x: x / list_sum(a)) AS a, list_transform(b, lambda x: x / list_sum(b)) AS b FROM w)"


@query(f"WITH {_VOTERS}, m AS (SELECT gx, gy, list_transform(range(1, 5), lambda i: round((a[i] + b[i]) / 2, 9)) AS p FROM n) SELECT gx, gy, CASE WHEN gx % 7 > 0 AND gy % 11 > 0 THEN list_position(p, list_max(p)) END::INT AS class, CASE WHEN gx % 7 > 0 AND gy % 11 > 0 THEN round(list_max(p), 6) END AS p FROM m")
def soft_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of cells where both voters are valid."""
    return rounded(raster.soft_vote(_votes(spark, sf_dir), 2), "p")


@query(f"WITH {_VOTERS} SELECT count(*) AS cells, count(*) FILTER (gx % 7 > 0 AND gy % 11 > 0) AS valid, round(avg((list_sum(a) + list_sum(b)) / 2) FILTER (gx % 7 > 0 AND gy % 11 > 0), 6) AS mean_sum FROM n")
def vote_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.vote_report(_votes(spark, sf_dir), 2), "mean_sum")


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two voters' probabilities, from the cells' places."""
    x, y = F.col("gx"), F.col("gy")
    weights = {"a": [1 + (x * 7 + y * 3) % 11, 1 + (x + y) % 7, 1 + x % 5, 1 + y % 3], "b": [1 + (x * 5 + y) % 9, 1 + (x * y) % 6, 1 + y % 7, F.lit(2)]}
    cells = V.zone_cells(spark, sf_dir).select("gx", "gy")
    votes = [cells.select("gx", "gy", F.lit(n).alias("model"), F.array(*[(v.cast("double") / sum(ws, F.lit(0))).alias("p") for v in ws]).alias("probs"), ok.alias("valid")) for (n, ws), ok in zip(weights.items(), (x % 7 > 0, y % 11 > 0), strict=True)]
    return votes[0].unionByName(votes[1])


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) JOIN customer ON o_custkey = c_custkey WHERE k = 1 AND c_acctbal > 0")
def join_save_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first secondary row of each primary; primaries without one are dropped."""
    first = raster.first_per_key(V.load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")
    primary = V.load(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return primary.join(first, "o_custkey")


_H = "h AS (SELECT l_suppkey AS zone_id, avg(l_quantity) AS a FROM lineitem GROUP BY 1), b AS (SELECT s_suppkey AS zone_id, s_acctbal AS b FROM supplier WHERE s_acctbal > 0), c AS (SELECT n_nationkey AS zone_id, n_regionkey AS c FROM nation)"


@query(f"WITH {_H} SELECT zone_id, round(a, 6) AS a, b, c FROM (SELECT zone_id, a FROM h WHERE zone_id % 4 > 0) FULL JOIN b USING (zone_id) FULL JOIN c USING (zone_id)")
def outer_join_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    heat = V.heat(spark, sf_dir).where("zone_id % 4 > 0").select("zone_id", F.col("lst_native30").alias("a"))
    wealth = V.load(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("zone_id"), F.col("s_acctbal").alias("b"))
    region = V.load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("zone_id"), F.col("n_regionkey").alias("c"))
    return rounded(zones.outer_join_all([heat, wealth, region], "zone_id"), "a")


@query(f"WITH {PILLARS}, n AS (SELECT zone_id, {norm('exposure')} AS a, {norm('sensitivity_raw')} AS b, {norm('(1 - greenery_fraction)')} AS c FROM pillars) SELECT zone_id, unnest(['exposure', 'sensitivity', 'deficit']) AS pillar, round(unnest([0.5 * a, 0.3 * b, 0.2 * c]), 6) AS contribution FROM n")
def score_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = V.pillars(spark, sf_dir).withColumn("deficit", 1 - F.col("greenery_fraction")).withColumnRenamed("sensitivity_raw", "sensitivity")
    normed = zones.scaled(table, ["exposure", "sensitivity", "deficit"])
    normed = normed.select("zone_id", *[F.col(f"{c}_norm").alias(c) for c in ("exposure", "sensitivity", "deficit")])
    return rounded(scores.score_breakdown(normed, {"exposure": 0.5, "sensitivity": 0.3, "deficit": 0.2}), "contribution")


@query(f"WITH {_EDGES}, a AS (SELECT zone_id, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area FROM e GROUP BY 1) SELECT zone_id, round(-1.5 * 12.0 / area, 6) AS delta FROM a")
def rescale_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = zones.zone_area(V.zone_edges(spark, sf_dir))
    return rounded(area.select("zone_id", validation.rescale_delta(F.lit(-1.5), F.lit(12.0), F.col("area")).alias("delta")), "delta")


@query("WITH h AS (SELECT l_suppkey AS zone_id, round(avg(l_quantity), 9) AS lst FROM lineitem GROUP BY 1) SELECT zone_id, round(lst, 6) AS lst, zone_id % 3 AS primary_cluster, s_acctbal AS sensitivity_raw FROM h JOIN supplier ON s_suppkey = zone_id WHERE s_acctbal > 0 AND zone_id % 6 > 0")
def zone_heat_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    heat = V.heat(spark, sf_dir).select("zone_id", F.round("lst_native30", 9).alias("lst"))
    clustered = heat.where("zone_id % 6 > 0").select("zone_id", (F.col("zone_id") % 3).alias("primary_cluster"))
    social = V.load(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("zone_id"), F.col("s_acctbal").alias("sensitivity_raw"))
    return rounded(models.zone_heat_table(heat, clustered, social, "lst", ["primary_cluster", "sensitivity_raw"])[0], "lst")


@query("SELECT k::INT AS k, silhouette FROM (SELECT 2 + l_linenumber AS k, round(avg(l_discount), 9) AS silhouette FROM lineitem GROUP BY 1) ORDER BY silhouette DESC, k LIMIT 1")
def choose_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweep = V.load(spark, sf_dir, "lineitem").groupBy((2 + F.col("l_linenumber")).cast("int").alias("k")).agg(F.round(F.avg("l_discount"), 9).alias("silhouette"))
    return validation.choose_k(sweep)


def _allocation_sql(total: int, boost: int, least: int) -> str:
    """Shares rounded half to even, then one more each in order of size until the total is reached; no class is cut back here."""
    return f"""WITH h AS (SELECT c_nationkey AS class, count(*) AS n FROM customer GROUP BY 1), w AS (SELECT *, n / sum(n) OVER () * CASE WHEN class = {boost} THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM h),
t AS (SELECT class, greatest(round_even(w / sum(w) OVER () * {total}, 0)::BIGINT, {least}) AS take FROM w), g AS (SELECT *, {total} - sum(take) OVER () AS gap, count(*) OVER () AS k, row_number() OVER (ORDER BY take, class) AS up, row_number() OVER (ORDER BY take DESC, class) AS down FROM t)
SELECT class, (CASE WHEN gap >= 0 THEN take + gap // k + (up <= gap % k)::INT ELSE take - (-gap) // k - (down <= (-gap) % k)::INT END)::BIGINT AS take FROM g"""


@query(_allocation_sql(1000, 3, 8))
def allocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = metrics.class_histogram(V.load(spark, sf_dir, "customer"), "c_nationkey").select(F.col("c_nationkey").alias("class"), "n")
    return sampling.allocate(hist, 1000, 3)


@query("WITH d AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey BETWEEN 5 AND 9 ORDER BY ('0x' || left(md5(c_custkey || '|region'), 8))::BIGINT, c_custkey LIMIT 100), k AS (SELECT *, row_number() OVER (ORDER BY ('0x' || left(md5(c_custkey || '|region'), 8))::BIGINT, c_custkey) AS i FROM d) SELECT 'pt_' || CASE WHEN i < 10 THEN '0' ELSE '' END || i AS point_id, c_custkey, c_mktsegment FROM k")
def cells_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred places to label, all of one region."""
    inside = V.load(spark, sf_dir, "customer").where("c_nationkey BETWEEN 5 AND 9").select("c_custkey", "c_mktsegment")
    return labelling.random_cells(inside, "c_custkey", 100, "region")


@query(f"WITH {COMPOSITE} SELECT gx, gy, (gy // 8) * 6 + gx // 8 AS patch_idx, CASE WHEN (gx + gy) % 5 = 0 AND gx >= 16 THEN 1 ELSE 0 END AS label FROM comp WHERE (gy // 8) * 6 + gx // 8 IN (SELECT (gy // 8) * 6 + gx // 8 FROM comp WHERE (gx + gy) % 5 = 0 AND gx >= 16)")
def labelled_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of patches with a label, and back from the patches to the cells' places."""
    label = F.when(((F.col("gx") + F.col("gy")) % 5 == 0) & (F.col("gx") >= 16), 1).otherwise(0)
    patches = raster.assign_patch(_composite(spark, sf_dir).select("gx", "gy", label.alias("label")), 8, 6)
    return raster.from_patch(raster.labelled_patches(patches, "label").drop("gx", "gy"), 8, 6).select("gx", "gy", "patch_idx", "label")


@query(f"WITH {INDEXED}, l AS (SELECT DISTINCT p_partkey % 48 AS gx, p_partkey // 48 AS gy, p_partkey % 4 + 1 AS label FROM part WHERE p_partkey % 3 = 0) SELECT gx, gy, round(ndvi, 6) AS ndvi, round(ndbi, 6) AS ndbi, round(ndwi, 6) AS ndwi, coalesce(label, 0)::INT AS label, red IS NOT NULL AS valid FROM ix LEFT JOIN l USING (gx, gy)")
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    labels = V.load(spark, sf_dir, "part").where(k % 3 == 0).select((k % 48).alias("gx"), F.floor(k / 48).alias("gy"), (k % 4 + 1).cast("int").alias("label")).distinct()
    return rounded(raster.feature_table(_indexed(spark, sf_dir), labels).select("gx", "gy", "ndvi", "ndbi", "ndwi", "label", "valid"), "ndvi", "ndbi", "ndwi")


@query(f"WITH {COMPOSITE}, g AS (SELECT DISTINCT p_partkey % 48 AS gx, p_partkey // 48 AS gy FROM part), f AS (SELECT count(lst) / count(*) AS lst, count(*) FILTER (nir > 40000) / count(*) AS nir FROM g LEFT JOIN (SELECT gx, gy, lst, nir FROM comp) USING (gx, gy)) SELECT round(lst, 6) AS lst, round(nir, 6) AS nir, lst >= 0.9 AND nir >= 0.9 AS passed FROM f")
def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _composite(spark, sf_dir).select("gx", "gy", "lst", F.when(F.col("nir") > 40000, F.col("nir")).alias("nir"))
    return rounded(raster.coverage_gate(raster.coverage_fraction(cells, V.zone_cells(spark, sf_dir), ["lst", "nir"])), "lst", "nir")


@query(f"WITH {INDEXED}, k AS (SELECT {ZONE} AS zone_id, (NOT ndwi > 0.1 AND ndvi > 0.35)::INT AS v FROM ix), z AS (SELECT DISTINCT ((p_partkey // 48) // 12) * 4 + (p_partkey % 48) // 12 AS zone_id FROM part) SELECT zone_id, round(avg(v), 6) AS greenery_fraction FROM z LEFT JOIN k USING (zone_id) GROUP BY 1")
def adaptive_pillar_landcover(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _indexed(spark, sf_dir).withColumn("class", X.rule_landcover(F.col("ndwi"), F.col("ndvi"), F.col("ndbi")))
    zone = V.zone_cells(spark, sf_dir)
    return rounded(raster.adaptive_pillar_landcover(cells, zone, zone), "greenery_fraction")


@query(f"WITH {COMPOSITE}, p AS (SELECT a.gx, a.gy, avg(b.lst) AS m, stddev_pop(b.lst) AS s FROM comp a JOIN comp b ON abs(a.gx - b.gx) <= 2 AND abs(a.gy - b.gy) <= 2 GROUP BY 1, 2) SELECT gx, gy, round(m, 4) AS lst_mean, round(s, 4) AS lst_std FROM p")
def neighbourhood_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = raster.neighbourhood_features(_composite(spark, sf_dir).select("gx", "gy", "lst"), "lst", 2)
    return rounded(out.select("gx", "gy", "lst_mean", "lst_std"), "lst_mean", "lst_std", digits=4)
