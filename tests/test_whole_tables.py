"""Queries and views that take whole tables."""

import datetime
import hashlib
import math

import numpy as np
import pytest

from zonalis.operators import metrics, scores
from zonalis.plans import queries as spatial
from zonalis.plans import views

DATA = "/root/testdata/sf0.001"


def test_monthly_scenes_all(spark):
    rows = spatial.queries()["monthly_scenes_all"](spark, DATA).collect()
    assert sum(r.n for r in rows) == spark.read.parquet(f"{DATA}/orders.parquet").count()


def test_months_without_scenes(spark):
    days = spark.createDataFrame([(datetime.datetime(2024, 1, 31),), (datetime.datetime(2024, 4, 1),)], "at timestamp")
    assert {r.month: r.n for r in metrics.monthly_counts(days, "at").collect()} == {"2024-01": 1, "2024-02": 0, "2024-03": 0, "2024-04": 1}


def test_all_zones_with_pillars(spark, tmp_path):
    lines = [(k, 10.0 + k, 0.1, 0.0) for k in (1, 8, 17, 34, 99)]  # 99 is no supplier
    spark.createDataFrame(lines, "l_suppkey long, l_quantity double, l_discount double, l_tax double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, 1.0 * k) for k in (1, 8, 17, 34, 51)], "s_suppkey long, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))  # 51 has no heat
    assert {r.zone_id: r.exposure for r in views.pillars(spark, str(tmp_path)).collect()} == {1: 11.0, 8: 18.0, 17: 27.0, 34: 44.0}
    assert {r.zone_id for r in views.heldout(spark, str(tmp_path)).collect()} == {1, 8, 17, 34, 51}


def test_bootstrap_bands_all_draws(spark, monkeypatch):
    asked, bands = [], scores.bootstrap_bands

    def count(pillars, exposure_std, greenery_std, draws=1000, seed="draw"):
        asked.append(draws)
        return bands(pillars, exposure_std, greenery_std, draws, seed)

    monkeypatch.setattr(scores, "bootstrap_bands", count)
    spatial.queries()["bootstrap_bands_all"](spark, DATA)
    assert asked == [1000]


def test_bootstrap_bands_brute_force(spark):
    rows, draws = [(1, 20.0, 5.0, 0.1), (2, 25.0, -3.0, 0.9), (3, 30.0, 1.0, 0.5)], 7
    uniform = lambda key: int(hashlib.md5(key.encode()).hexdigest()[:8], 16) / 4294967296
    found = {z: [] for z, *_ in rows}
    for d in range(draws):
        noise = lambda z, n, d=d: math.sqrt(-2 * math.log(max(uniform(f"{z}/{d}|draw-{n}-1"), 1e-12))) * math.cos(2 * math.pi * uniform(f"{z}/{d}|draw-{n}-2"))
        table = np.array([(e + 1.5 * noise(z, "exposure"), s, min(max(g + 0.05 * noise(z, "greenery"), 0.0), 1.0)) for z, e, s, g in rows])
        unit = (table - table.min(0)) / (table.max(0) - table.min(0))
        for k, (z, *_) in enumerate(rows):
            found[z].append((unit[k, 0] + unit[k, 1] + 1 - unit[k, 2]) / 3)
    pillars = spark.createDataFrame(rows, "zone_id long, exposure double, sensitivity_raw double, greenery_fraction double")
    for r in scores.bootstrap_bands(pillars, 1.5, 0.05, draws).collect():
        assert [r.p05, r.p50, r.p95] == pytest.approx(np.percentile(found[r.zone_id], [5, 50, 95]).tolist())
