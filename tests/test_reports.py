"""Tails, projections, ranks under skew, staleness, files with faults, and the counts beside results."""

import json
import math

import pytest
from pyspark.sql import functions as F

from zonalis.functions import distributions, projections
from zonalis.operators import metrics, raster, sampling, validation, zones
from zonalis.sources import readers


def tail(t, df):
    """Student's two-sided tail by Simpson's rule in 20,000 steps."""
    n = 20_000
    a = math.atan(t / math.sqrt(df))
    f = lambda k: math.cos(k * a / n) ** (df - 1)
    total = f(0) + f(n) + 4 * sum(f(k) for k in range(1, n, 2)) + 2 * sum(f(k) for k in range(2, n, 2))
    return 1 - 2 * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi) * total * a / n / 3


def test_student_p(spark):
    cases = [(t, df) for t in (0.0, 0.1, 0.7, 1.0, 1.96, 2.5, 4.0, 7.0, -2.5) for df in (1, 2, 3, 7, 30, 98, 1000, 20_000, 49_000)]
    rows = spark.createDataFrame(cases, "t double, df int").select("t", "df", distributions.student_p(F.col("t"), F.col("df")).alias("p"))
    for r in rows.collect():
        assert r.p == pytest.approx(tail(abs(r.t), r.df), abs=1e-9)
    # Tabulated: the 5 % and 1 % points.
    table = [(12.706204736, 1, 0.05), (4.302652730, 2, 0.05), (2.228138852, 10, 0.05), (2.042272456, 30, 0.05), (3.169272667, 10, 0.01)]
    for r in spark.createDataFrame(table, "t double, df int, want double").withColumn("p", distributions.student_p(F.col("t"), F.col("df"))).collect():
        assert r.p == pytest.approx(r.want, abs=1e-9)
    many = spark.createDataFrame([(t, df) for t in (0.2, 1.0, 2.9, 3.1, 6.0) for df in (50_001, 10**6, 10**12)], "t double, df long")
    for r in many.withColumn("p", distributions.student_p(F.col("t"), F.col("df"))).collect():
        z = r.t * (1 - 1 / (4 * r.df)) / math.sqrt(1 + r.t**2 / (2 * r.df))
        assert r.p == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-12)
        assert r.df > 50_001 or r.p == pytest.approx(tail(r.t, r.df), abs=1e-9)
    odd = spark.createDataFrame([(1.0, 0), (None, 5), (2.0, None)], "t double, df int").select(distributions.student_p(F.col("t"), F.col("df")).alias("p"))
    assert [r.p for r in odd.collect()] == [None, None, None]


def test_gap_fit_warns(spark):
    rows = spark.createDataFrame([(float(k), 2.0 * k + (k * 37 % 11)) for k in range(40)] + [(1.0, None)], "x double, y double")
    got = validation.linear_gap_fit(rows, "x", "y").head()
    assert got.n == 40 and got.r > 0.9 and got.p < 1e-9 and got.warning
    line = validation.linear_gap_fit(rows.select("x", F.col("x").alias("y")), "x", "y").head()
    assert line.p == 0.0 or line.p < 1e-12
    short = validation.linear_gap_fit(rows.limit(2), "x", "y").head()
    assert short.p in (None, 0.0) and not (short.p is None and short.warning)


def meridian_arc(lat):
    """Metres from the equator along a meridian, by Simpson's rule."""
    e2, n, top = projections.ECCENTRICITY**2, 20_000, math.radians(lat)
    f = lambda k: (1 - e2 * math.sin(k * top / n) ** 2) ** -1.5
    total = f(0) + f(n) + 4 * sum(f(k) for k in range(1, n, 2)) + 2 * sum(f(k) for k in range(2, n, 2))
    return projections.RADIUS * (1 - e2) * total * top / n / 3


def test_projection_both_ways(spark):
    places = [(105.0 + d, lat) for d in (-3.0, -1.15, 0.0, 0.4, 3.0) for lat in (0.0, 1.29, 10.0, 45.0, 70.0)]
    rows = spark.createDataFrame(places, "lon double, lat double")
    metres = rows.withColumns(projections.to_utm(F.col("lon"), F.col("lat")))
    back = projections.from_utm(F.col("x"), F.col("y"))
    found = metres.select("lon", "lat", "x", "y", back["lon"].alias("lon2"), back["lat"].alias("lat2")).collect()
    for r in found:
        assert abs(r.lon - r.lon2) * 111_320 < 1e-3 and abs(r.lat - r.lat2) * 111_320 < 1e-3
        if r.lon == 105.0:  # on the meridian
            assert r.x == pytest.approx(500_000, abs=1e-6) and r.y == pytest.approx(0.9996 * meridian_arc(r.lat), abs=1e-3)
    # Mirrored at the meridian, and scaled as the projection says: distances near the meridian are 0.9996 of the ground's.
    by = {(r.lon, r.lat): r for r in found}
    assert by[102.0, 45.0].x + by[108.0, 45.0].x == pytest.approx(1_000_000, abs=1e-6)
    assert by[102.0, 45.0].y == pytest.approx(by[108.0, 45.0].y, abs=1e-6)


def test_projection_keeps_angles(spark):
    """A conformal map's step north and step east have one length and a right angle between them: this fixes x where y is known."""
    h = 1e-5
    for lon, lat in ((103.85, 1.29), (107.5, 40.0)):
        steps = spark.createDataFrame([(lon - h, lat), (lon + h, lat), (lon, lat - h), (lon, lat + h)], "lon double, lat double")
        w, e, s, n = (complex(r.x, r.y) for r in steps.select(*[v.alias(k) for k, v in projections.to_utm(F.col("lon"), F.col("lat")).items()]).collect())
        e2, phi = projections.ECCENTRICITY**2, math.radians(lat)
        wide = projections.RADIUS * math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2)
        high = projections.RADIUS * (1 - e2) / (1 - e2 * math.sin(phi) ** 2) ** 1.5
        ratio = ((n - s) / high) / ((e - w) / wide)
        assert ratio.real == pytest.approx(0, abs=1e-6) and ratio.imag == pytest.approx(1, abs=1e-6)


def test_ranks_of_skewed_values(spark):
    values = [1e12, -1e12, *[1 / (k + 1) for k in range(5000)], *[0.5] * 300, *[k * 1e-9 for k in range(3000)]]
    rows = spark.createDataFrame([(float(v),) for v in values], "x double")
    places = {}
    for k, v in enumerate(sorted(values), 1):
        places.setdefault(v, []).append(k)
    assert {r.x: r.rank for r in metrics.average_ranks(rows, "x", "rank").collect()} == {v: sum(ks) / len(ks) for v, ks in places.items()}
    counts = rows.distinct()
    bounds = F.broadcast(counts.agg(F.array_sort(F.array_distinct(F.approx_percentile("x", [k / metrics.RANGES for k in range(1, metrics.RANGES)], 20 * metrics.RANGES))).alias("b")))
    sizes = counts.crossJoin(bounds).groupBy(metrics._bounds_below(F.col("x"), F.col("b")).alias("range")).count()
    assert sizes.agg(F.max("count")).head()[0] <= 5 * len(places) / metrics.RANGES
    assert metrics.average_ranks(rows.limit(0), "x", "rank").count() == 0


def test_staleness(spark, tmp_path):
    path, source = str(tmp_path / "out"), spark.range(5)
    calls = []

    def build(n):
        def made():
            calls.append(n)
            return spark.range(n)

        return made

    keep = lambda n, rows, **more: readers.materialize(spark, build(n), path, inputs=[rows], **more).count()
    assert keep(3, source) == 3 and keep(4, source) == 3 and keep(4, source.orderBy(F.desc("id"))) == 3 and calls == [3]
    assert keep(6, spark.range(6)) == 6 and keep(7, spark.range(6)) == 6 and calls == [3, 6]  # a changed row
    assert keep(8, spark.range(6), force=True) == 8
    changed = spark.range(9)
    with pytest.raises(RuntimeError):
        readers.materialize(spark, lambda: (_ for _ in ()).throw(RuntimeError("stopped")), path, inputs=[changed])
    assert readers.materialize(spark, build(1), path).count() == 8  # the old table is whole
    (tmp_path / "out" / "_SUCCESS").unlink()  # a write that was cut off
    assert keep(2, spark.range(6)) == 2 and not (tmp_path / "out.new").exists()


def test_days_of_readings(spark, tmp_path):
    folder = tmp_path / "days"
    folder.mkdir()
    day = lambda k: {"data": {"readings": [{"timestamp": f"2026-01-0{k}T00:00:00", "data": [{"stationId": "S1", "value": 30.0 + k}]}]}}
    for k in (1, 2):
        (folder / f"{k}.json").write_text(json.dumps(day(k)))
    (folder / "3.json").write_text('{"data": {"readings": [')
    (folder / "4.json").write_text('{"error": "none"}')
    rows, days = readers.read_reading_days(spark, str(folder))
    assert sorted((r.station_id, r.value) for r in rows.collect()) == [("S1", 31.0), ("S1", 32.0)]
    assert tuple(days.head()) == (2, 2)
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "1.json").write_text("{")
    with pytest.raises(ValueError):
        readers.read_reading_days(spark, str(bad))
    (bad / "s.json").write_text('{"data": {"stations": []}}')
    with pytest.raises(ValueError):
        readers.read_stations(spark, str(bad / "s.json"))


def test_seasons(spark):
    obs = [(0, 0, "dry", 1.0), (0, 0, "dry", 3.0), (0, 0, "dry", 50.0), (1, 0, "dry", 5.0), (0, 0, "wet", 7.0), (9, 9, "wet", 2.0), (0, 0, None, 99.0)]
    scenes = spark.createDataFrame([(*o[:3], o[3], None if o[2] == "wet" and o[0] == 9 else 1.0) for o in obs], "gx int, gy int, s string, a double, b double")
    cells = raster.seasonal_composites(scenes, F.col("s"), ["a", "b"])
    zone = spark.createDataFrame([(0, 0, 1), (1, 0, 1), (9, 9, 2), (5, 5, 3)], "gx int, gy int, zone_id int")
    got = raster.seasonal_features(cells, zone, ["a", "b"])
    # Zone 2 lacks b in its only season, so that season is missing, and the zone with it.
    assert [(r.zone_id, r.a_dry, r.a_wet, r.a_delta, r.b_delta) for r in got.collect()] == [(1, 4.0, 7.0, 3.0, 0.0)]
    assert tuple(raster.completeness(got, zone).head()) == (3, 1, 1)


def test_counts_beside_results(spark):
    base = spark.createDataFrame([(k, k * 1.0) for k in range(6)], "zone_id int, v double")
    rows, report = zones.join_counted(base, {"a": base.where("zone_id > 1").withColumnRenamed("v", "x"), "b": base.where("zone_id < 4").select("zone_id")}, "zone_id")
    assert sorted(r.zone_id for r in rows.collect()) == [2, 3] and rows.columns == ["zone_id", "v", "x"]
    assert report.head().asDict() == {"rows": 6, "missing_a": 2, "missing_b": 2, "dropped": 4, "joined": 2}
    names = zones.match_report(base, base.where("zone_id % 2 = 0"), "zone_id", names=2).head()
    assert names.asDict() == {"matched": 3, "only_left": 3, "only_right": 0, "left_names": [1, 3], "right_names": []}
    with pytest.raises(Exception, match="no scenes"):
        raster.period_report(base.limit(0), "zone_id").collect()
    assert raster.period_report(base, "zone_id").head().few
    sizes = spark.createDataFrame([("x", 3), ("y", 1), ("z", 2)], "kind string, take int")
    cells = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "y")], "key int, kind string")
    short = sampling.shortfall(sampling.stratified_sample(cells, "key", "kind", sizes, "s"), "kind", sizes)
    assert sorted(map(tuple, short.collect())) == [("x", 3, 2, 1), ("z", 2, 0, 2)]
    labels = spark.createDataFrame([(k, k % 2, (k % 2) if k else 1) for k in range(10)] + [(99, None, 1)], "id int, a int, b int")
    counted, differ = metrics.agreement_report(labels, "id", "a", "b")
    assert [r.id for r in differ.collect()] == [0] and counted.head().disagreements == 1 and counted.head().passed
    numbers = readers.suppression_report(spark.createDataFrame([("-", "1"), ("3", "x"), (None, "-"), ("-", "")], "p string, q string"), ["p", "q"])
    assert sorted(map(tuple, numbers.collect())) == [("p", 2, 0), ("q", 1, 2)]
    ndvi = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3)], "zone_id int, greenery_fraction double")
    fallen = validation.adaptive_report(ndvi, ndvi.where("zone_id > 1"))[1].head()
    assert (fallen.zones, fallen.fell_back, fallen.compared, fallen.spearman) == (3, 1, 2, 1.0)


def test_rank_impact_of_both_weightings(spark):
    zones_ = [(k, float(k), float(-k), (k * 37 % 100) / 10.0, (k * 53 % 90) / 100.0) for k in range(60)]
    pillars = spark.createDataFrame(zones_, "zone_id int, same double, turned double, sensitivity_raw double, greenery_fraction double")
    pillars = pillars.withColumn("scaled", 3 * F.col("same") + 1)
    held = pillars.select("zone_id", (F.col("same") + 2).alias("lst_heldout_c"))
    got = {(r.variant, r.weighting): r for r in validation.rank_impact(pillars, held, ["same", "scaled", "turned"], "same").collect()}
    assert len(got) == 6
    for weighting in ("equal", "pca"):
        assert got["same", weighting].spearman == pytest.approx(1) and got["same", weighting].overlap == 1.0 and got["same", weighting].rmse == pytest.approx(2)
        assert got["scaled", weighting].spearman == pytest.approx(1)  # normalised alike
        assert got["turned", weighting].spearman < 0.9
    with pytest.raises(Exception, match="lack a pillar"):
        validation.rank_impact(pillars.withColumn("greenery_fraction", F.when(F.col("zone_id") > 3, F.col("greenery_fraction"))), held, ["same"], "same").collect()


def test_patches_and_features(spark):
    cells = spark.createDataFrame([(x, y, 1 if (x, y) == (3, 2) else None, None if x == 5 else 1.0) for x in range(8) for y in range(4)], "gx int, gy int, label int, red double")
    patches = raster.assign_patch(cells, 4, 2)
    back = raster.from_patch(patches.drop("gx", "gy"), 4, 2)
    assert {(r.gx, r.gy, r.label) for r in back.collect()} == {(r.gx, r.gy, r.label) for r in cells.collect()}
    assert {r.patch_idx for r in raster.labelled_patches(patches, "label").collect()} == {0}
    table = raster.feature_table(cells.drop("label"), cells.where("label IS NOT NULL").select("gx", "gy", "label"))
    assert sorted((r.gx, r.label, r.valid) for r in table.where("gy = 2 AND gx IN (3, 5)").collect()) == [(3, 1, True), (5, 0, False)]
    assert raster.feature_table(cells.drop("label")).where("label <> 0").count() == 0
    fractions = raster.coverage_fraction(cells, cells.select("gx", "gy"), ["red"])
    assert not raster.coverage_gate(fractions).head().passed and raster.coverage_gate(fractions, 0.8).head().passed


def test_depth_gate(spark):
    days = [(d, s) for d in range(1, 11) if d != 9 for s in range(12 if d > 4 else 3)]
    readings = spark.createDataFrame([(f"2026-03-{d:02d} 10:00:00", f"s{s}") for d, s in days], "ts string, station string").withColumn("ts", F.to_timestamp("ts"))
    report = validation.depth_gate(validation.reading_depth(readings, "ts", "station")).head()
    assert tuple(report) == (7, 5, True)  # of days 4 to 10, day 4 has too few stations and day 9 has none


def test_votes_of_invalid_cells(spark):
    nan = float("nan")
    rows = [(0, 0, "a", [0.9, 0.1], True), (0, 0, "b", [0.3, 0.7], True), (1, 0, "a", [0.0, 1.0], True), (1, 0, "b", [1.0, 0.0], None), (2, 0, "a", [nan, nan], False), (2, 0, "b", [0.5, 0.5], True), (3, 0, "a", [0.0, 1.0], True), (3, 0, "b", [0.0, 1.0], True)]
    votes = spark.createDataFrame(rows, "gx int, gy int, model string, probs array<double>, valid boolean")
    assert {r.gx: r["class"] for r in raster.soft_vote(votes, 2).collect()} == {0: 1, 1: None, 2: None, 3: 2}
    report = raster.vote_report(votes, 2).head()
    assert (report.cells, report.valid, report.mean_sum) == (4, 2, pytest.approx(1.0))
