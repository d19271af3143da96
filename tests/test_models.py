"""Clusters, classifiers, heat models, labelling tables and files, on small tables with known results."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalis.operators import clusters, labelling, models, raster, scores, validation
from zonalis.sources import readers


@pytest.fixture(scope="module")
def blobs(spark):
    rows = [(k, float(10 * (k % 3) + (k * 37 % 60) / 60), float(5 * (k % 3) + (k * 23 % 60) / 60), k % 3) for k in range(60)] + [(99, None, 1.0, 0)]
    return spark.createDataFrame(rows, "key long, a double, b double, true int")


def test_cluster_sweeps_and_labels(spark, blobs):
    rows = clusters.standardized(clusters.vectors(blobs, "key", ["a", "b"]))
    sweep = clusters.sweep(rows, range(2, 5), starts=3)
    assert {r.k for r in sweep.collect()} == {2, 3, 4} and validation.choose_k(sweep).head()["k"] == 3
    by_k = {r.k: r for r in sweep.collect()}
    assert by_k[2].inertia > by_k[3].inertia >= 0 and by_k[3].silhouette > 0.9 and by_k[3].davies_bouldin < 0.2
    mixed = models.sweep_gmm(rows, range(2, 4), starts=2)
    assert {r.k for r in mixed.collect()} == {2, 3} and all(r.bic > r.aic for r in mixed.collect())
    rows = models.assembled(blobs, ["a", "b"])
    hard = models.label_clusters(rows, models.fit_kmeans(rows, 3, starts=3), "kmeans_cluster")
    assert hard.count() == 60 and hard.groupBy("true").agg(F.count_distinct("kmeans_cluster").alias("n")).where("n > 1").count() == 0
    soft = models.label_clusters(hard, models.fit_gmm(rows, 2, starts=1), "gmm_cluster")
    assert soft.where("abs(gmm_cluster_prob_0 + gmm_cluster_prob_1 - 1) > 1e-6").count() == 0
    assert models.select_primary(soft, 0.5, 0.5).where("primary_cluster <> kmeans_cluster").count() == 0
    assert models.select_primary(soft, 0.4, 0.5).where("primary_cluster <> gmm_cluster").count() == 0


def test_sweep_of_64_features(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(200, 64)) + 6 * rnd.integers(0, 4, 200)[:, None]
    x[:, 5], x[7] = 2.5, x[3]  # a constant feature and two equal rows
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "key long, " + ", ".join(f"f{i} double" for i in range(64)))
    rows = clusters.standardized(clusters.vectors(df, "key", [f"f{i}" for i in range(64)])).persist()
    z = np.array([r.x for r in rows.orderBy("key").collect()])
    spread = x.std(axis=0)
    assert np.allclose(z, (x - x.mean(axis=0)) / np.where(spread > 1e-12, spread, 1))
    got = {r.k: r for r in clusters.sweep(rows, range(2, 6), starts=4, block=50).collect()}
    assert max(got, key=lambda k: got[k].silhouette) == 4 and got[4].inertia < got[3].inertia < got[2].inertia
    assert {r.k for r in models.sweep_gmm(rows, range(2, 3), starts=1).collect()} == {2}


def test_lloyds_rounds(spark):
    """Every round against plain numpy; a cluster without rows keeps its centre, a k above the rows has a centre a row."""
    rnd = np.random.default_rng(8)
    x = np.concatenate([rnd.normal(size=(40, 3)), np.ones((5, 3))])
    rows = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "key long, x array<double>").repartition(3)
    first = clusters.first_centres(rows, range(2, 5), 2, "s").collect()
    models_ = {(k, s): np.array([r.c for r in sorted(first, key=lambda r: r.cluster) if (r.k, r.start) == (k, s)]) for k in range(2, 5) for s in range(2)}
    for _ in range(20):
        for at, c in models_.items():
            own = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            models_[at] = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
    cost = {at: ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum() for at, c in models_.items()}
    for r in clusters.kmeans(rows, range(2, 5), 2, 20, "s").collect():
        assert r.inertia == pytest.approx(min(cost[r.k, 0], cost[r.k, 1])) and r.c == pytest.approx(models_[r.k, r.start][r.cluster].tolist())
    few = clusters.kmeans(rows.where("key < 2"), range(2, 5), 1)
    assert {(r.k, r.cluster) for r in few.collect()} == {(k, c) for k in range(2, 5) for c in range(2)}
    assert clusters.kmeans(rows.limit(0), range(2, 5), 1).count() == 0


@pytest.mark.parametrize("block", [1000, 50, 7])
def test_silhouettes_in_blocks(spark, block):
    rnd = np.random.default_rng(1)
    x = np.round(rnd.normal(size=(130, 4)), 1)
    x[:20] = x[20:40]  # equal rows
    labels = {"a": rnd.integers(0, 5, 130), "b": np.where(np.arange(130) == 3, 1, 0), "one": np.zeros(130, int)}
    rows = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "key long, x array<double>")
    table = spark.createDataFrame([(k, name, int(c)) for name, cs in labels.items() for k, c in enumerate(cs)], "key long, labelling string, cluster int")
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = {}
    for name, cs in labels.items():
        s = []
        for k in range(130):
            mean = {c: far[k][cs == c].sum() / max(1, (cs == c).sum() - (c == cs[k])) for c in set(cs.tolist())}
            b = min((m for c, m in mean.items() if c != cs[k]), default=None)
            s.append(0.0 if b is None or (cs == cs[k]).sum() == 1 else (b - mean[cs[k]]) / max(b, mean[cs[k]]))
        want[name] = sum(s) / 130
    got = {r.labelling: (r.n, r.silhouette) for r in clusters.silhouettes(rows, table, block).collect()}
    assert got == {name: (130, pytest.approx(v)) for name, v in want.items()}


def test_silhouette_of_single_members(spark):
    rows = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [10.0])], "key long, x array<double>")
    labels = spark.createDataFrame([(1, "k", 0), (2, "k", 0), (3, "k", 1)], "key long, labelling string, cluster int")
    want = ((10 - 1) / 10 + (9 - 1) / 9 + 0) / 3
    got = clusters.silhouettes(rows, labels).head()
    assert (got.n, got.silhouette) == (3, pytest.approx(want))
    assert clusters.silhouettes(rows.limit(0), labels.limit(0)).count() == 0


def test_classifier(spark, blobs):
    cells = blobs.withColumn("label", F.col("true") + 1)
    out = models.classify(cells, models.train_pixel_classifier(cells, "label", ["a", "b"], trees=10), ["a", "b"])
    assert out.where("valid AND class <> label").count() <= 3
    gone = out.where("NOT valid").collect()
    assert [(r.key, r["class"], r.probs) for r in gone] == [(99, None, None)]
    assert all(sum(r.probs) == pytest.approx(1) for r in out.where("valid").collect())


@pytest.fixture(scope="module")
def zone_table(spark):
    rows = [(z, 40 - 10 * (z % 10) / 10 + (z % 4), (z % 10) / 10, (10 - z % 10) / 20, (10 - z % 10) / 20, (z % 10) / 10 * 0.8, (z % 10) / 10 * 0.9, z % 4) for z in range(200)]
    return spark.createDataFrame(rows, "zone_id long, lst double, fraction_vegetation double, fraction_built_up double, fraction_bare double, ndvi_dry double, ndvi_wet double, cluster int")


def test_heat_model_and_counterfactual(zone_table):
    features = ["fraction_vegetation", "fraction_built_up", "fraction_bare", "ndvi_dry", "ndvi_wet", "cluster"]
    model, report, importance = models.train_heat_model(zone_table, "zone_id", "lst", features, ["cluster"], rounds=40, rate=0.2)
    assert report["test_r2"] > 0.9 and report["n_train"] + report["n_test"] == 200
    ranked = [(r.feature, r.importance) for r in importance.collect()]
    assert {f for f, _ in ranked} == set(features) and sum(v for _, v in ranked) == pytest.approx(1) and ranked == sorted(ranked, key=lambda kv: -kv[1])
    out = models.counterfactual_zones(model, zone_table, [0.0, 0.3])
    assert out.where("requested_delta = 0 AND abs(delta_lst) > 1e-9").count() == 0
    assert out.where("requested_delta = 0.3").agg(F.avg("delta_lst")).head()[0] < 0  # more vegetation, less heat


def test_vegetation_edits_keep_the_whole(zone_table):
    edits = models.vegetation_edits(zone_table, [-0.5, 0.2, 2.0])
    whole = F.col("fraction_vegetation") + F.col("fraction_built_up") + F.col("fraction_bare")
    assert edits.count() == 600 and edits.where(F.abs(whole - 1) > 1e-9).count() == 0
    assert edits.where(F.abs(F.col("ndvi_dry") - 0.8 * F.col("fraction_vegetation")) > 1e-9).count() == 0


def test_heat_table(spark):
    heat = spark.createDataFrame([(1, 30.0), (2, 31.0), (3, 32.0)], "zone_id long, lst double")
    clusters = spark.createDataFrame([(1, 0.1, 0), (2, 0.2, 1)], "zone_id long, ndvi double, cluster int")
    people = spark.createDataFrame([(1, 10.0), (2, 20.0)], "zone_id long, total double")
    table, dropped = models.zone_heat_table(heat, clusters, people, "lst", ["ndvi", "cluster", "total"])
    assert table.count() == 2 and dropped.head()[0] == 1
    with pytest.raises(ValueError, match="nothing"):
        models.zone_heat_table(heat, clusters, people, "lst", ["nothing"])


def test_cell_edits(spark):
    rows = [(x, y, 1 + (x + y) % 2, float(x), 30.0 - x) for x in range(12) for y in range(12)]
    cells = spark.createDataFrame(rows, "gx long, gy long, class int, ndvi double, lst double").withColumns({f"class_{k}": (F.col("class") == k).cast("double") for k in (1, 2)})
    means = validation.class_mean_vectors(cells, "class", ["ndvi"], [1, 2])
    edited = models.edit_cells(cells, F.col("gx") == 0, 1, means, ["ndvi"], [1, 2])
    assert edited.where("edited").select("ndvi", "class_1", "class_2").distinct().collect() == [(5.5, 1.0, 0.0)]
    assert edited.drop("before").where("NOT edited").exceptAll(cells.withColumn("edited", F.lit(False)).where("gx > 0")).count() == 0
    model, _, _ = models.train_heat_model(cells.withColumn("key", F.col("gx") * 12 + F.col("gy")), "key", "lst", ["ndvi", "class_1", "class_2"], rounds=20, rate=0.3)
    _, total = models.counterfactual_cells(model, edited)
    assert total.head().n_edited == 12 and total.head().mean_delta < -2
    none = models.edit_cells(cells, F.lit(None).cast("boolean"), 1, means, ["ndvi"], [1, 2])
    assert tuple(models.counterfactual_cells(model, none)[1].head()) == (0.0, 0)


def test_feasibility(spark):
    cells = spark.createDataFrame([(k, 20 + k % 10 + 0.01 * (k % 3), float(k % 10)) for k in range(120)], "key long, lst double, ndvi double")
    out = models.downscale_feasibility(cells, "key", "lst", ["ndvi"], trees=10).collect()
    assert {r.model for r in out} == {"baseline", "linear", "forest"} and all(r.passed for r in out)
    assert not any(r.passed for r in models.downscale_feasibility(cells.limit(20), "key", "lst", ["ndvi"], trees=5).collect())


def test_regression_keeps_a_linear_field(spark):
    fine = [(x, y, float(x * x % 7), float(y * 3 % 5), float((x + y) % 4)) for x in range(18) for y in range(18)]
    cells = spark.createDataFrame(fine, "gx long, gy long, a double, b double, c double").withColumn("lst", 20 + 2 * F.col("a") - F.col("b") + 0.5 * F.col("c"))
    coarse = raster.coarsen_mean(cells, ["lst", "a", "b", "c"], 3)
    w = raster.regression_weights(coarse, "lst", ["a", "b", "c"], 1000, "s").head()
    assert tuple(w) == (pytest.approx(20), pytest.approx(2), pytest.approx(-1), pytest.approx(0.5), 36)
    out = raster.variant_regress(coarse.select("gx", "gy", "lst"), cells, "lst", ["a", "b", "c"]).join(cells, ["gx", "gy"])
    assert out.count() == 324 and out.where("abs(lst_regress - lst) > 1e-6").count() == 0


def test_tile_stats_and_union(spark):
    cells = spark.createDataFrame([(0, 0, -1.0, 0.2), (1, 0, 3.0, 0.4), (2, 0, -5.0, 0.1)], "gx long, gy long, lst double, green double")
    zone = spark.createDataFrame([(0, 0, 1), (1, 0, 1), (2, 0, 2), (3, 0, 3)], "gx long, gy long, zone_id long")
    stats, dropped = raster.tile_zonal_stats(cells, zone, "lst", "green")
    assert [tuple(r) for r in stats.collect()] == [(1, 3.0, pytest.approx(0.3))] and dropped.head()[0] == 2
    both = raster.union_sensors({"a": cells, "b": cells.drop("green")})
    assert both.count() == 6 and both.where("sensor = 'b' AND green IS NULL").count() == 3
    assert raster.variant_native(cells, "lst").columns == ["gx", "gy", "lst_native"]


def test_labelling(spark):
    old = spark.createDataFrame([(1, "tree"), (2, "grass"), (3, "vegetation"), (4, "moon"), (5, ""), (6, None)], "i int, label string")
    table = spark.createDataFrame([("tree", "vegetation"), ("grass", "vegetation")], "old string, new string")
    rows, report = labelling.migrate_labels(old, "label", table)
    assert {r.i: r.label for r in rows.collect()} == {1: "vegetation", 2: "vegetation", 3: "vegetation", 4: "moon", 5: "", 6: None}
    assert tuple(report.head()) == (2, 1, ["moon"])
    names = spark.createDataFrame([("Total",), ("A - Total",), ("A",), ("Totally",), (None,)], "name string")
    kept, counts = labelling.drop_subtotals(names, "name")
    assert {r.name for r in kept.collect()} == {"A", "Totally", None} and tuple(counts.head()) == (1, 1)
    assert tuple(labelling.labelling_progress(old, "label", "i").head()) == (4, 6, 5)
    assert labelling.random_cells(old, "i", 3, "s").collect() == labelling.random_cells(old.repartition(3), "i", 3, "s").collect()
    at = spark.createDataFrame([("2024-03-01 12:00:00",)], "at string").withColumn("at", F.to_timestamp("at"))
    days = [str(r.day) for r in labelling.sample_days(at, "at", 500, 1, "s").collect()]
    assert len(days) == 29 and days == sorted(days) and days[-1] == "2024-02-29"
    assert labelling.sample_days(at.limit(0), "at", 5, 1, "s").count() == 0


def test_zone_reports(spark):
    zones = spark.createDataFrame([(1,), (2,), (3,)], "zone_id long")
    scored = spark.createDataFrame([(1, 0.5), (2, 0.9)], "zone_id long, score double")
    bands = spark.createDataFrame([(1, 0.1)], "zone_id long, band_width double")
    table, report = validation.zone_map(zones, scored, bands)
    assert table.count() == 3 and tuple(report.head()) == (1, 2, 0.5, 0.9)
    assert scores.toy_pillars(zones, "s").collect() == scores.toy_pillars(zones, "s").collect() != scores.toy_pillars(zones, "t").collect()
    cells = spark.createDataFrame([(0, 0, 7.0), (1, 0, None)], "gx long, gy long, t double")
    zone = spark.createDataFrame([(0, 0, 1), (1, 0, 2)], "gx long, gy long, zone_id long")
    means, coverage = validation.coarse_heldout(cells, zone, zones, "t")
    assert [tuple(r) for r in means.collect()] == [(1, 7.0)] and tuple(coverage.head()) == (1, 3, pytest.approx(1 / 3))


def test_files(spark, tmp_path):
    obs = spark.createDataFrame([("l8", "2024-01-05", 1), ("l8", "2024-02-01", 2), ("l9", "2024-01-06", 3), ("l8", "2023-01-06", 4)], "sensor string, acquired_at string, v int").withColumn("acquired_at", F.to_date("acquired_at"))
    readers.write_observations(obs, f"{tmp_path}/obs")
    got = readers.read_observations(spark, f"{tmp_path}/obs", "l8", "2024-01-01", "2024-02-01", ["v"])
    assert [r.v for r in got.collect()] == [1]
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "sensor" in plan.split("PartitionFilters")[1].split("]")[0]
    grid = {"patchesPerRow": 4, "totalPatches": 12, "projection": {"crs": "EPSG:32648", "affine": {"doubleMatrix": [10, 0, 1, 0, -10, 2]}}}
    (tmp_path / "grid.json").write_text(json.dumps(grid))
    assert readers.read_grid(spark, f"{tmp_path}/grid.json").head().affine == [10, 0, 1, 0, -10, 2]
    del grid["projection"]["affine"]
    (tmp_path / "bad.json").write_text(json.dumps(grid))
    with pytest.raises(Exception, match="affine"):
        readers.read_grid(spark, f"{tmp_path}/bad.json").collect()
    readers.write_table(obs, f"{tmp_path}/out", "csv")
    table = readers.read_zone_table(spark, f"{tmp_path}/out", "v int", ["v", "sensor"])
    assert sorted(r.v for r in table.collect()) == [1, 2, 3, 4]
    assert readers.read_zone_table(spark, f"{tmp_path}/none", "v int", ["v"]) is None
    with pytest.raises(ValueError, match="missing"):
        readers.read_zone_table(spark, f"{tmp_path}/out", "v int", ["nothing"])
    with pytest.raises(Exception, match="exists"):
        readers.write_table(obs, f"{tmp_path}/out", "csv")
