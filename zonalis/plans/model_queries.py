"""Registered queries of models, labelling tables and regression downscaling, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.functions import expressions as X
from zonalis.operators import clusters, labelling, models, raster, scores, validation
from zonalis.plans import views as V
from zonalis.plans.queries import _EDGES, INDEXED, ZONE, _indexed, norm, query, rounded
from zonalis.plans.validation_queries import HEAT, VARIANTS
from zonalis.sources import readers

INDICES = ["ndvi", "ndbi", "ndwi"]
EMBEDDED = [f"f{i}" for i in range(64)]
_RULE = "CASE WHEN ndwi > 0.1 THEN 4 WHEN ndvi > 0.35 THEN 1 WHEN ndbi > 0 THEN 2 ELSE 3 END"


def _md5(key: str, seed: str) -> str:
    return f"('0x' || left(md5({key} || '|{seed}'), 8))::BIGINT / 4294967296.0::DOUBLE"


_FIT = f"""{INDEXED}, c AS (SELECT gx // 3 AS gx, gy // 3 AS gy, avg(lst) AS lst, avg(ndvi) AS a, avg(ndbi) AS b, avg(ndwi) AS d FROM ix GROUP BY 1, 2),
s AS (SELECT * FROM c ORDER BY {_md5("gx || '/' || gy", 'regress')}, gx, gy LIMIT 5000),
v AS (SELECT avg(lst) AS my, avg(a) AS ma, avg(b) AS mb, avg(d) AS md, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(a, d) AS ad, covar_pop(b, b) AS bb, covar_pop(b, d) AS bd, covar_pop(d, d) AS dd, covar_pop(a, lst) AS ya, covar_pop(b, lst) AS yb, covar_pop(d, lst) AS yd FROM s),
e AS (SELECT *, aa * bb - ab * ab AS p, aa * bd - ab * ad AS q, aa * dd - ad * ad AS r, aa * yb - ab * ya AS t, aa * yd - ad * ya AS u FROM v),
w AS (SELECT *, (p * u - q * t) / (p * r - q * q) AS w3 FROM e), x AS (SELECT *, (t - q * w3) / p AS w2 FROM w), y AS (SELECT *, (ya - ab * w2 - ad * w3) / aa AS w1 FROM x)"""


@query(f"WITH {_FIT} SELECT round(my - w1 * ma - w2 * mb - w3 * md, 3) AS w0, round(w1, 3) AS w1, round(w2, 3) AS w2, round(w3, 3) AS w3, (SELECT count(*) FROM s) AS n FROM y")
def regression_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = raster.coarsen_mean(_indexed(spark, sf_dir), ["lst", *INDICES], 3)
    return rounded(raster.regression_weights(coarse, "lst", INDICES, 5000, "regress"), "w0", "w1", "w2", "w3", digits=3)


@query(f"""WITH {_FIT}, z AS (SELECT my - w1 * ma - w2 * mb - w3 * md AS w0, w1, w2, w3 FROM y), rest AS (SELECT gx, gy, lst - (w0 + w1 * a + w2 * b + w3 * d) AS v FROM c, z),
o AS (SELECT range AS o FROM range(-3, 6)), k AS (SELECT o, greatest(1 - abs((o + 0.5) / 3 - 0.5), 0.0) AS w FROM o),
f AS (SELECT gx * 3 + i.o AS gx, gy * 3 + j.o AS gy, sum(i.w * j.w * v) / sum(i.w * j.w) AS rest FROM rest, k i, k j WHERE i.w * j.w <> 0 GROUP BY 1, 2)
SELECT ix.gx, ix.gy, round(w0 + w1 * ndvi + w2 * ndbi + w3 * ndwi + rest, 4) AS lst_regress FROM ix, z, f WHERE ix.gx = f.gx AND ix.gy = f.gy""")
def variant_regress(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = _indexed(spark, sf_dir)
    return rounded(raster.variant_regress(raster.coarsen_mean(fine, ["lst"], 3), fine, "lst", INDICES), "lst_regress", digits=4)


@query(f"WITH {_EDGES}, h AS (SELECT point_id FROM p JOIN e ON (y1 > p.y) <> (y2 > p.y) AND p.x < x1 + (p.y - y1) * (x2 - x1) / (y2 - y1) GROUP BY point_id, zone_id HAVING count(*) % 2 = 1) SELECT point_id, x, y FROM p WHERE point_id IN (SELECT point_id FROM h)")
def clip_to_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.clip_to_boundary(V.points(spark, sf_dir), "point_id", V.zone_edges(spark, sf_dir)).select("point_id", "x", "y")


@query(f"WITH {INDEXED} SELECT {ZONE} AS zone_id, round(avg(lst) FILTER (lst > 0), 6) AS lst, round(avg(ndvi), 6) AS ndvi FROM ix GROUP BY 1")
def tile_zonal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.tile_zonal_stats(_indexed(spark, sf_dir), V.zone_cells(spark, sf_dir), "lst", "ndvi")[0], "lst", "ndvi")


@query(f"WITH {INDEXED}, s AS (SELECT {ZONE} AS zone_id, avg(lst) AS lst, avg(({_RULE} = 1)::INT) AS g FROM ix GROUP BY 1), t AS (SELECT *, 0.3 + 0.7 * {_md5('zone_id', 'tile')} AS toy FROM s) SELECT zone_id, round(({norm('lst')} + {norm('toy')} + {norm('(1 - g)')}) / 3, 6) AS score FROM t")
def tile_smoke_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.tile_smoke_score(_indexed(spark, sf_dir), V.zone_cells(spark, sf_dir)), "score")


@query(f"WITH {_EDGES}, h AS (SELECT point_id, zone_id FROM p JOIN e ON (y1 > p.y) <> (y2 > p.y) AND p.x < x1 + (p.y - y1) * (x2 - x1) / (y2 - y1) GROUP BY 1, 2 HAVING count(*) % 2 = 1) SELECT zone_id, round(avg(o_totalprice), 4) AS lst_heldout_c, count(*) AS n FROM h JOIN orders ON o_custkey = point_id GROUP BY 1")
def station_heldout(spark: SparkSession, sf_dir: str) -> DataFrame:
    stations = V.points(spark, sf_dir).withColumnRenamed("point_id", "station_id")
    readings = V.load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("station_id"), F.col("o_totalprice").alias("value"))
    edges = V.zone_edges(spark, sf_dir)
    return rounded(validation.station_heldout(stations, edges, readings, edges), "lst_heldout_c", digits=4)


@query(f"WITH {INDEXED}, c AS (SELECT gx // 3 AS gx, gy // 3 AS gy, avg(lst) AS lst FROM ix GROUP BY 1, 2) SELECT (gy // 4) * 4 + gx // 4 AS zone_id, round(avg(lst), 6) AS lst_heldout_c FROM c GROUP BY 1")
def coarse_heldout(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = V.zone_cells(spark, sf_dir).select(F.floor(F.col("gx") / 3).alias("gx"), F.floor(F.col("gy") / 3).alias("gy"), "zone_id").distinct()
    coarse = raster.coarsen_mean(_indexed(spark, sf_dir), ["lst"], 3)
    return rounded(validation.coarse_heldout(coarse, zone, zone, "lst")[0].distinct(), "lst_heldout_c")


def _crosscheck_sql() -> str:
    rows = " UNION ALL ".join(
        f"(WITH t AS (SELECT {v} AS a, {h} AS b FROM r), k AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM t) SELECT '{v}' AS variant, '{s}' AS source, count(*) AS n, round(sqrt(avg(pow(a - b, 2))), 6) AS rmse, round(corr(ra, rb), 6) AS spearman FROM k)"
        for v in VARIANTS for s, h in (("stations", "lst_heldout_c"), ("coarse", "other"))
    )
    return f"WITH {HEAT}, r AS (SELECT {', '.join(f'round({v}, 9) AS {v}' for v in VARIANTS)}, lst_heldout_c, (20 + zone_id % 7)::DOUBLE AS other FROM heat JOIN held USING (zone_id)) {rows}"


@query(_crosscheck_sql())
def crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    heat = V.heat(spark, sf_dir).select("zone_id", *[F.round(v, 9).alias(v) for v in VARIANTS])
    stations = V.heldout(spark, sf_dir)
    coarse = stations.select("zone_id", (20 + F.col("zone_id") % 7).cast("double").alias("lst_heldout_c"))
    return rounded(validation.crosscheck(heat, {"stations": stations, "coarse": coarse}, VARIANTS), "rmse", "spearman")


@query(f"WITH {HEAT}, s AS (SELECT zone_id, round(lst_native30, 9) AS score FROM heat WHERE zone_id % 3 > 0), b AS (SELECT s_suppkey AS zone_id, abs(s_acctbal) AS band_width FROM supplier WHERE s_acctbal > 0) SELECT s_suppkey AS zone_id, score, band_width FROM supplier LEFT JOIN s ON s_suppkey = s.zone_id LEFT JOIN b ON s_suppkey = b.zone_id")
def zone_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = V.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("zone_id"), "s_acctbal")
    scored = V.heat(spark, sf_dir).where("zone_id % 3 > 0").select("zone_id", F.round("lst_native30", 9).alias("score"))
    bands = supplier.where("s_acctbal > 0").select("zone_id", F.abs("s_acctbal").alias("band_width"))
    return validation.zone_map(supplier.select("zone_id"), scored, bands)[0]


@query("SELECT s_suppkey AS zone_id, " + ", ".join(f"round({_md5('s_suppkey', f'toy-{c}')}, 9) AS {c}" for c in scores.PILLARS) + " FROM supplier")
def toy_pillars(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = V.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("zone_id"))
    return rounded(scores.toy_pillars(ids, "toy"), *scores.PILLARS, digits=9)


@query("SELECT 'east' AS sensor, count(*) AS n, count(l_tax) AS n_tax FROM lineitem WHERE l_suppkey % 2 = 0 UNION ALL SELECT 'west', count(*), 0 FROM lineitem WHERE l_suppkey % 2 = 1")
def union_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = V.load(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_tax")
    both = raster.union_sensors({"east": lines.where("l_suppkey % 2 = 0"), "west": lines.where("l_suppkey % 2 = 1").drop("l_tax")})
    return both.groupBy("sensor").agg(F.count(F.lit(1)).alias("n"), F.count("l_tax").alias("n_tax"))


@query("SELECT count(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY')) AS migrated, count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')) AS unrecognised, count(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')) AS known FROM customer")
def migrate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.createDataFrame([("BUILDING", "HOUSEHOLD"), ("MACHINERY", "HOUSEHOLD")], "old string, new string")
    rows, report = labelling.migrate_labels(V.load(spark, sf_dir, "customer"), "c_mktsegment", table)
    return report.drop("labels").crossJoin(rows.agg(F.count_if(F.col("c_mktsegment") == "HOUSEHOLD").alias("known")))


@query("WITH n AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Total' WHEN 1 THEN c_mktsegment || ' - Total' ELSE c_mktsegment END AS name FROM customer) SELECT c_custkey, name FROM n WHERE c_custkey % 3 = 2")
def drop_subtotals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    name = F.when(k == 0, "Total").when(k == 1, F.concat("c_mktsegment", F.lit(" - Total"))).otherwise(F.col("c_mktsegment"))
    return labelling.drop_subtotals(V.load(spark, sf_dir, "customer").select("c_custkey", name.alias("name")), "name")[0]


_DRAWN = f"d AS (SELECT * FROM customer ORDER BY {_md5('c_custkey', 'label')}, c_custkey LIMIT 200)"


@query(f"WITH {_DRAWN}, k AS (SELECT *, row_number() OVER (ORDER BY {_md5('c_custkey', 'label')}, c_custkey) AS i FROM d) SELECT 'pt_' || CASE WHEN i < 10 THEN '0' ELSE '' END || i AS point_id, c_custkey FROM k")
def random_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelling.random_cells(V.load(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 200, "label")


@query(f"WITH {_DRAWN}, k AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS i FROM d) SELECT 'P' || lpad(i::VARCHAR, 4, '0') AS point_id, c_custkey AS lon, c_acctbal AS lat, c_nationkey % 5 AS class, CASE c_nationkey % 5 WHEN 1 THEN 'vegetation' WHEN 2 THEN 'built_up' ELSE 'class_' || (c_nationkey % 5) END AS class_name, c_nationkey AS class_raw, n_name AS class_raw_name, '' AS agreed_label, '' AS confidence, '' AS notes FROM k JOIN nation ON c_nationkey = n_nationkey")
def labelling_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = labelling.random_cells(V.load(spark, sf_dir, "customer"), "c_custkey", 200, "label")
    sample = drawn.select(F.col("c_custkey").alias("lon"), F.col("c_acctbal").alias("lat"), (F.col("c_nationkey") % 5).alias("class"), F.col("c_nationkey").alias("class_raw"))
    names = spark.createDataFrame([(1, "vegetation"), (2, "built_up")], "class int, name string")
    raw = V.load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("class"), F.col("n_name").alias("name"))
    return labelling.labelling_table(sample, names, raw, "lon")


@query("SELECT count(*) FILTER (toxic = 1) AS labelled, count(*) AS n, min(doc_id) FILTER (toxic IS NULL OR toxic <> 1) AS next FROM labels")
def labelling_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = V.load(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("").alias("label"))
    return labelling.labelling_progress(labels, "label", "doc_id")


@query(f"WITH l AS (SELECT max(o_orderdate)::DATE AS last FROM orders), d AS (SELECT strftime(last - back::INT, '%Y-%m-%d') AS day FROM l, range(1, 180) t(back)) SELECT day FROM d ORDER BY {_md5('day', 'days')}, day LIMIT 30")
def sample_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelling.sample_days(V.load(spark, sf_dir, "orders"), "o_orderdate", 30, 6, "days").select(F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("""WITH r AS (SELECT vec_id, label % 4 AS k, embedding::DOUBLE[] AS x FROM embeddings), s AS (SELECT k, count(*) AS size FROM r GROUP BY 1),
m AS (SELECT a.vec_id, a.k AS own, b.k, sum(list_distance(a.x, b.x)) AS d FROM r a, r b GROUP BY 1, 2, 3),
n AS (SELECT vec_id, max(d / (size - 1)) FILTER (k = own AND size > 1) AS a, min(d / size) FILTER (k <> own) AS b FROM m JOIN s USING (k) GROUP BY 1)
SELECT count(*) AS n, round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM n""")
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.cluster_rows(spark, sf_dir)
    named = clusters.vectors(rows.withColumn("key", F.struct("vec_id", "cluster")), "key", EMBEDDED).select(F.col("key.vec_id").alias("key"), "x", F.create_map(F.lit("given"), F.col("key.cluster")).alias("own"))
    return rounded(clusters.labelled_silhouettes(named).select("n", "silhouette"), "silhouette")


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones with shares of land cover, NDVI, a cluster and heat."""
    k, out = F.col("zone_id"), V.heat(spark, sf_dir).select("zone_id", F.round("lst_native30", 9).alias("lst"))
    shares = {"fraction_vegetation": (k % 50) / 100.0, "fraction_built_up": (k % 30) / 100.0, "fraction_bare": 0.1 + (k % 7) / 100.0}
    return out.withColumns({**shares, "primary_cluster": (k % 3).cast("int"), "ndvi_dry": (k % 50) / 125.0 + (k % 11) / 100.0, "ndvi_wet": (k % 50) / 100.0})


_ZONES = """z AS (SELECT l_suppkey AS zone_id, (l_suppkey % 50) / 100.0::DOUBLE AS v, (l_suppkey % 30) / 100.0::DOUBLE AS b, 0.1 + (l_suppkey % 7) / 100.0::DOUBLE AS r, (l_suppkey % 50) / 125.0::DOUBLE + (l_suppkey % 11) / 100.0::DOUBLE AS nd, (l_suppkey % 50) / 100.0::DOUBLE AS nw FROM (SELECT DISTINCT l_suppkey FROM lineitem)),
d AS (SELECT unnest([-0.2, 0.1, 0.3]::DOUBLE[]) AS delta), sl AS (SELECT regr_slope(nd, v) AS slope FROM z), e AS (SELECT *, least(greatest(v + delta, 0), 1) - v AS act FROM z, d, sl)"""


@query(f"WITH {_ZONES} SELECT zone_id, delta AS requested_delta, round(act, 6) AS actual_delta, round(greatest(b - act * b / (b + r), 0), 6) AS fraction_built_up, round(greatest(r - act * r / (b + r), 0), 6) AS fraction_bare, round(nd + act * slope, 6) AS ndvi_dry, round(nw + act * slope, 6) AS ndvi_wet FROM e")
def vegetation_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["actual_delta", "fraction_built_up", "fraction_bare", "ndvi_dry", "ndvi_wet"]
    out = models.vegetation_edits(_zones(spark, sf_dir).drop("lst"), [-0.2, 0.1, 0.3])
    return rounded(out.select("zone_id", "requested_delta", *cols), *cols)


@query(f"WITH {INDEXED}, c AS (SELECT *, {_RULE} AS class FROM ix), m AS (SELECT avg(ndvi) AS ndvi, avg(ndbi) AS ndbi, avg(ndwi) AS ndwi FROM c WHERE class = 1) SELECT c.gx, c.gy, pow(gx - 24, 2) + pow(gy - 24, 2) <= 100 AS edited, round(CASE WHEN edited THEN m.ndvi ELSE c.ndvi END, 6) AS ndvi, CASE WHEN edited OR class = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS class_1, CASE WHEN NOT edited AND class = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS class_2 FROM c, m")
def edit_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _edited(_classed(spark, sf_dir)).select("gx", "gy", "edited", "ndvi", "class_1", "class_2")
    return rounded(out, "ndvi")


def _classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _indexed(spark, sf_dir).withColumn("class", X.rule_landcover(F.col("ndwi"), F.col("ndvi"), F.col("ndbi")))
    return cells.withColumns(X.one_hot(F.col("class"), [1, 2, 3, 4], "class"))


def _edited(cells: DataFrame) -> DataFrame:
    means = validation.class_mean_vectors(cells, "class", INDICES, [1, 2, 3, 4])
    return models.edit_cells(cells, X.in_disc(F.col("gx"), F.col("gy"), 24, 24, 10.0, 1.0), 1, means, INDICES, [1, 2, 3, 4])


_ROWS = """r AS (SELECT vec_id AS key, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT key, i, e[i] AS v FROM r, range(1, 65) t(i)), st AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM u GROUP BY 1),
x AS MATERIALIZED (SELECT key, list((v - m) / CASE WHEN s > 0 THEN s ELSE 1 END ORDER BY i) AS x FROM u JOIN st USING (i) GROUP BY 1)"""


@query(f"""WITH RECURSIVE {_ROWS},
o AS (SELECT start, x, row_number() OVER (PARTITION BY start ORDER BY ('0x' || left(md5(key || '|kmeans-' || start), 8))::BIGINT, key) - 1 AS cluster FROM x, range(0, 10) t(start)),
it AS (SELECT 0 AS r, k, start, cluster, x AS c FROM o, range(2, 9) t(k) WHERE cluster < k
  UNION ALL SELECT r + 1, k, start, cluster, coalesce(n.c, it.c) FROM it LEFT JOIN (SELECT k, start, cluster, list(v ORDER BY i) AS c FROM (
    SELECT k, start, cluster, i, avg(x.x[i]) AS v FROM (SELECT key, k, start, arg_min(cluster, (d2, cluster)) AS cluster FROM (SELECT key, k, start, cluster, pow(list_distance(x, c), 2) AS d2 FROM x, it) GROUP BY 1, 2, 3)
    JOIN x USING (key), range(1, 65) t(i) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) n USING (k, start, cluster) WHERE r < 20),
d AS MATERIALIZED (SELECT key, k, start, min((d2, cluster)) AS b FROM (SELECT key, k, start, cluster, pow(list_distance(x, c), 2) AS d2 FROM x, it WHERE r = 20) GROUP BY 1, 2, 3),
n AS (SELECT k, min((inertia, start)) AS b FROM (SELECT k, start, sum(b[1]) AS inertia FROM d GROUP BY 1, 2) GROUP BY 1),
l AS MATERIALIZED (SELECT d.k, key, d.b[2] AS cluster FROM d JOIN n ON d.k = n.k AND d.start = n.b[2]),
z AS (SELECT k, cluster, count(*) AS size FROM l GROUP BY 1, 2), p AS MATERIALIZED (SELECT a.key AS a, b.key AS b, list_distance(a.x, b.x) AS far FROM x a, x b),
m AS (SELECT y.k, p.a, y.cluster, sum(far) AS d FROM p JOIN l y ON y.key = p.b GROUP BY 1, 2, 3),
q AS (SELECT m.k, a, max(d / (size - 1)) FILTER (m.cluster = l.cluster AND size > 1) AS own, min(d / size) FILTER (m.cluster <> l.cluster) AS near FROM m JOIN z USING (k, cluster) JOIN l ON l.k = m.k AND l.key = a GROUP BY 1, 2),
s AS (SELECT k, avg(coalesce((near - own) / nullif(greatest(own, near), 0), 0)) AS silhouette FROM q GROUP BY 1),
c AS (SELECT k, cluster, list(v ORDER BY i) AS c FROM (SELECT k, cluster, i, avg(x[i]) AS v FROM l JOIN x USING (key), range(1, 65) t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
w AS (SELECT k, cluster, any_value(c) AS c, avg(list_distance(x, c)) AS s FROM l JOIN x USING (key) JOIN c USING (k, cluster) GROUP BY 1, 2),
g AS (SELECT k, avg(r) AS db FROM (SELECT a.k, a.cluster, max((a.s + b.s) / list_distance(a.c, b.c)) AS r FROM w a JOIN w b ON a.k = b.k AND a.cluster <> b.cluster GROUP BY 1, 2) GROUP BY 1)
SELECT k::INT AS k, round(n.b[1], 4) AS inertia, round(silhouette, 6) AS silhouette, round(db, 6) AS davies_bouldin FROM n JOIN s USING (k) JOIN g USING (k)""")
def sweep_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clusters.standardized(clusters.vectors(V.cluster_rows(spark, sf_dir), "vec_id", EMBEDDED))
    return rounded(rounded(clusters.sweep(rows), "silhouette", "davies_bouldin"), "inertia", digits=4)


@query()
def sweep_gmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clusters.standardized(clusters.vectors(V.cluster_rows(spark, sf_dir), "vec_id", EMBEDDED))
    return models.sweep_gmm(rows)


@query()
def classified_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each cell by two forests. What they learn from is written once: each reads it several times."""
    cells, remove_cells = readers.step(_classed(spark, sf_dir).select("gx", "gy", F.col("class").alias("label"), *INDICES), "cells")
    around, names = models.with_context(cells, INDICES)
    table, remove_table = readers.step(around, "surroundings")
    remove_cells()
    votes = None
    for voter, features in (("cells", INDICES), ("context", names)):
        own = models.classify(table.select("gx", "gy", "label", *features), models.train_pixel_classifier(table, "label", features, trees=40), features)
        own = own.select("gx", "gy", F.lit(voter).alias("model"), "probs", "valid")
        votes = own if votes is None else votes.unionByName(own)
    out, _ = readers.step(raster.soft_vote(votes, 2).select("gx", "gy", "class"), "classes")
    remove_table()
    return out


@query()
def counterfactual_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, features = _zones(spark, sf_dir), ["fraction_vegetation", "fraction_built_up", "fraction_bare", "ndvi_dry", "ndvi_wet", "primary_cluster"]
    model, _, _ = models.train_heat_model(table, "zone_id", "lst", features, ["primary_cluster"], rounds=30)
    return models.counterfactual_zones(model, table, [-0.2, 0.1, 0.3])


@query()
def counterfactual_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat of cells by bands, indices, class and surroundings, before and after a disc of them turns green."""
    bands, around, classes = ["nir", "red", "swir", "green", *INDICES], ["ndvi", "ndbi"], [1, 2, 3, 4]
    cells, features = models.pixel_heat_table(_classed(spark, sf_dir), "lst", classes, bands, around)
    cells = cells.withColumn("key", F.concat_ws("/", "gx", "gy"))
    model, _, _ = models.train_heat_model(cells, "key", "lst", features, rounds=30)
    means = validation.class_mean_vectors(cells, "class", bands, classes)
    edited = models.edit_cells(cells, X.in_disc(F.col("gx"), F.col("gy"), 24, 24, 10.0, 1.0), 1, means, bands, classes)
    return models.counterfactual_cells(model, edited, around)[0]


@query()
def downscale_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = raster.coarsen_mean(_indexed(spark, sf_dir), ["lst", *INDICES], 3).withColumn("key", F.concat_ws("/", "gx", "gy"))
    return models.downscale_feasibility(coarse, "key", "lst", INDICES, trees=60)
