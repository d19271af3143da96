"""Reports of variants, models and periods, and the scores they rest on, against hand-computed tables."""

import math

import pytest
from pyspark.sql import functions as F

from zonalis.operators import metrics, sampling, scores, validation


def test_constant_greenery_counts_for_nothing(spark):
    pillars = spark.createDataFrame([(1, 0.0, 0.0, 0.4), (2, 2.0, 1.0, 0.4)], "zone_id long, exposure double, sensitivity_raw double, greenery_fraction double")
    assert {r.zone_id: r.score for r in scores.build_score(pillars).collect()} == pytest.approx({1: 0.0, 2: 2 / 3})


def test_sensitivity_pillar(spark):
    people = spark.createDataFrame([("A", 100.0, 10.0), ("B", 200.0, 60.0), ("C", 400.0, 80.0), ("D", 0.0, 0.0), ("X", 900.0, 1.0)], "name string, total double, elderly double")
    ids = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "name string")
    got = {r.name: r for r in scores.sensitivity_pillar(people, ids).collect()}
    assert got["D"].elderly_proportion is None and "X" not in got
    assert {k: r.sensitivity_raw for k, r in got.items()} == pytest.approx({"A": 0.125 + 0.5 / 3, "B": 0.75, "C": 0.5 + 1 / 3, "D": 0.0})


@pytest.mark.parametrize("none", [None, float("nan"), 0.0])
def test_bands_without_noise(spark, none):
    pillars = spark.createDataFrame([(k, float(k), float(k * k), k / 10) for k in range(5)], "zone_id long, exposure double, sensitivity_raw double, greenery_fraction double")
    assert all(r.band_width == 0 and r.p50 == pytest.approx(r.point) for r in scores.bootstrap_bands(pillars, none, none, 20).collect())


def test_bands_by_components(spark):
    pillars = spark.createDataFrame([(k, float(k), float(k * k), (k * 7 % 5) / 10) for k in range(6)], "zone_id long, exposure double, sensitivity_raw double, greenery_fraction double")
    still = scores.bootstrap_bands(pillars, None, None, 10, weights="pca").collect()
    want = {r.zone_id: r.score for r in scores.build_score_pca(pillars).collect()}
    assert all(r.band_width == pytest.approx(0, abs=1e-9) and r.point == pytest.approx(want[r.zone_id]) and r.p50 == pytest.approx(want[r.zone_id]) for r in still)
    assert any(r.band_width > 0.01 for r in scores.bootstrap_bands(pillars, 1.0, 0.1, 50, weights="pca").collect())


def test_average_ranks(spark):
    rows = spark.createDataFrame([(x,) for x in (3.0, 1.0, 3.0, 2.0, 100.0, None)], "x double")
    assert {r.x: r.rank for r in metrics.average_ranks(rows, "x", "rank").collect()} == {1.0: 1.0, 2.0: 2.0, 3.0: 3.5, 100.0: 5.0}


def test_classifier_summary(spark):
    rows = [("m", 1, 1), ("m", 1, 2), ("m", 2, 2), ("m", 2, 0), ("m", None, 1), ("m", 2, None)]
    r = validation.classifier_summary(spark.createDataFrame(rows, "model string, t int, p int"), "model", "t", "p", [1, 2, 3]).head()
    assert (r.unlabelled, r.unpredicted, r.n, r.accuracy) == (1, 2, 3, pytest.approx(2 / 3))
    assert r.macro_f1 == pytest.approx(4 / 9) and r.weighted_f1 == pytest.approx(2 / 3)


def test_recall_standard_error(spark):
    rows = spark.createDataFrame([(1, 1)] * 3 + [(1, 2)], "t int, p int")
    assert validation.recall_standard_error(rows, "t", "p", 1).head().standard_error == pytest.approx(math.sqrt(0.75 * 0.25 / 4))
    with pytest.raises(Exception, match="no row of class 3"):
        validation.recall_standard_error(rows, "t", "p", 3).collect()


def test_choose_k_and_gates(spark):
    sweep = spark.createDataFrame([(2, 0.9), (3, 0.4), (4, 0.5), (5, 0.5)], "k int, silhouette double")
    assert validation.choose_k(sweep).head().k == 4 and validation.choose_k(sweep.where("k = 2")).head().k == 2
    checks = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "gate string, ok boolean")
    assert {r.gate: r.status for r in validation.check_summary(checks, ["a", "b", "c"]).collect()} == {"a": "FAIL", "b": "PASS", "c": "NOT RUN"}


def test_lookup(spark):
    rows, table = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int"), spark.createDataFrame([("a", "x"), ("b", "y")], "k string, z string")
    found, report = validation.lookup(rows, table, "k")
    assert sorted(map(tuple, found.collect())) == [("a", 1, "x"), ("b", 2, "y")] and report.head().unmatched == 1
    with pytest.raises(Exception, match="not unique"):
        validation.lookup(rows, table.union(table), "k")[0].collect()


def test_adaptive_source_and_delta(spark):
    schema = "zone_id int, greenery_fraction double"
    ndvi, cover = spark.createDataFrame([(1, 0.1), (2, 0.2)], schema), spark.createDataFrame([(1, 0.5), (3, 0.7)], schema)
    assert sorted(map(tuple, validation.adaptive_source(ndvi, cover).collect())) == [(1, 0.5, False), (2, 0.2, True), (3, 0.7, False)]
    areas = spark.createDataFrame([(2.0, 10.0)], "d double, area double")
    assert areas.select(validation.rescale_delta(F.col("d"), F.lit(5.0), F.col("area"))).head()[0] == 1.0
    with pytest.raises(Exception, match="above 0"):
        areas.select(validation.rescale_delta(F.col("d"), F.lit(5.0), F.lit(0.0))).collect()


def test_silhouette_squared(spark):
    rows = [(0, [0.0, 0.0]), (0, [0.0, 2.0]), (1, [5.0, 0.0]), (1, [5.0, 1.0]), (2, [9.0, 9.0])]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    want = []
    for i, (k, x) in enumerate(rows):
        own = [far(x, y) for j, (c, y) in enumerate(rows) if c == k and j != i]
        others = [sum(d) / len(d) for o in {0, 1, 2} - {k} if (d := [far(x, y) for c, y in rows if c == o])]
        want.append((min(others) - sum(own) / len(own)) / max(min(others), sum(own) / len(own)) if own else 0.0)
    df = spark.createDataFrame(rows, "cluster int, v array<double>")
    assert validation.silhouette_squared(df, "cluster", "v").head().silhouette == pytest.approx(sum(want) / len(want))


def test_stratified_sample_keeps_columns_and_takes_enough(spark):
    cells = spark.createDataFrame([(k, k % 3, k) for k in range(90)], "key long, kind int, draw long")
    sizes = spark.createDataFrame([(0, 5), (1, 40)], "kind int, take int")
    got = sampling.stratified_sample(cells, "key", "kind", sizes, "s")
    assert got.columns == cells.columns and {r.kind: r.n for r in got.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {0: 5, 1: 30}
