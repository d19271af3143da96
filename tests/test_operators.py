"""Operators on small fixtures."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from zonalis.functions import expressions as X
from zonalis.functions import projections as P
from zonalis.operators import raster, sampling, scores, zones
from zonalis.sources import readers
from zonalis.streaming.readings import hourly_means, stream_zone_readings


def test_projection(spark):
    row = spark.range(1).select(*[v.alias(k) for k, v in P.to_utm(F.lit(103.85), F.lit(1.29)).items()]).head()
    assert row.x == pytest.approx(372039.5, abs=30) and row.y == pytest.approx(142615.0, abs=60)


def test_redistribute(spark):
    df = spark.createDataFrame([(0.2, 0.6, 0.1), (0.9, 0.05, 0.05)], "fraction_vegetation double, fraction_built_up double, fraction_bare double")
    a = scores.redistribute_vegetation(df, 0.15).collect()[0]
    assert a.fraction_vegetation + a.fraction_built_up + a.fraction_bare == pytest.approx(0.9)
    assert scores.redistribute_vegetation(df, 0.5).collect()[1].actual_delta == pytest.approx(0.1)


def test_soft_vote(spark):
    rows = [(0, 0, "a", [0.9, 0.1], True), (0, 0, "b", [0.7, 0.3], True), (1, 0, "a", [0.5, 0.5], True), (1, 0, "b", [0.5, 0.5], False)]
    got = {r.gx: r for r in raster.soft_vote(spark.createDataFrame(rows, "gx long, gy long, model string, probs array<double>, valid boolean"), 2).collect()}
    assert got[0]["class"] == 1 and got[0].p == pytest.approx(0.8) and got[1]["class"] is None


def test_allocation_reaches_total(spark):
    hist = spark.createDataFrame([(1, 500), (2, 300), (3, 20), (4, 5)], "class int, n long")
    assert sum(r["take"] for r in sampling.allocate(hist, 200, 3).collect()) == 200


@pytest.mark.parametrize(("counts", "total"), [([1] * 20, 100), ([90, 5, 3, 1, 1], 12), ([1000, 10, 1], 25), ([5, 5, 5], 2), ([7], 30), ([900, 50, 30, 10, 5, 3, 1, 1], 40), ([500, 300, 20, 5], 200)])
def test_allocation_by_turns(spark, counts, total):
    weights = [n * (2 if c == 2 else 1) for c, n in enumerate(counts, 1)]
    take = {c: max(8, round(w / sum(weights) * total)) for c, w in enumerate(weights, 1)}
    excess = sum(take.values()) - total
    turn = sorted(take, key=lambda c: (-take[c] if excess > 0 else take[c], c))
    while sum(take.values()) != total and (total > sum(take.values()) or max(take.values()) > 1):
        for c in turn:
            if sum(take.values()) > total and take[c] > 1:
                take[c] -= 1
            elif sum(take.values()) < total:
                take[c] += 1
    hist = spark.createDataFrame(list(enumerate(counts, 1)), "class int, n long")
    assert {r["class"]: r["take"] for r in sampling.allocate(hist, total, 2).collect()} == take


def test_stations_and_population(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"data": {"stations": [{"id": "S1", "name": "A", "location": {"latitude": 1.5, "longitude": 103.5}}]}}))
    assert list(map(tuple, readers.read_stations(spark, str(tmp_path / "s.json")).collect())) == [("S1", "A", 1.5, 103.5)]
    (tmp_path / "p.json").write_text(json.dumps({"success": True, "result": {"records": [{"name": "X", "total": "-"}]}}))
    rows = readers.read_population(spark, str(tmp_path / "p.json"), ["name", "total"])
    assert rows.select(X.parse_suppressed(F.col("total")).alias("t"), "name").head() == (0.0, "X")
    (tmp_path / "bad.json").write_text(json.dumps({"success": False, "result": {"records": []}}))
    with pytest.raises(Exception, match="not successful"):
        readers.read_population(spark, str(tmp_path / "bad.json"), ["name"]).collect()
    with pytest.raises(ValueError, match="missing columns"):
        readers.require(rows, ["nope"])


def test_points_geojson(spark, tmp_path):
    readers.write_points_geojson(spark.createDataFrame([(7, 103.5, 1.5, "a")], "point_id long, lon double, lat double, k string"), str(tmp_path / "g"))
    line = spark.read.text(str(tmp_path / "g")).head().value
    assert json.loads(line) == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [103.5, 1.5]}, "properties": {"point_id": 7, "k": "a"}}


def test_hole_is_outside(spark):
    def ring(pts):
        return [(1, *a, *b) for a, b in zip(pts, pts[1:] + pts[:1], strict=True)]

    edges = spark.createDataFrame(ring([(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)]) + ring([(3.0, 3.0), (3.0, 6.0), (6.0, 6.0), (6.0, 3.0)]), "zone_id long, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, 1.0, 4.5), (2, 4.0, 4.5), (3, 20.0, 4.5)], "point_id long, x double, y double")
    assert [r.point_id for r in zones.point_in_zone(points, edges).collect()] == [1]
    assert zones.zone_area(edges).head().area == pytest.approx(72)


def test_tiles_of_zones(spark):
    """1,000 zones (holes, two parts, stars that overlap, edges on tile borders) against a ray cast, for several tile sizes."""
    rnd, edges = random.Random(4), []

    def ring(z, pts):
        edges.extend((z, *map(float, a), *map(float, b)) for a, b in zip(pts, pts[1:] + pts[:1], strict=True))

    for z in range(1000):
        cx, cy = (z % 40) * 10 + 5, (z // 40) * 10 + 5
        if z % 4 == 0:
            ring(z, [(cx - 5, cy - 5), (cx + 5, cy - 5), (cx + 5, cy + 5), (cx - 5, cy + 5)])
            ring(z, [(cx - 2, cy - 2), (cx - 2, cy + 2), (cx + 2, cy + 2), (cx + 2, cy - 2)])
        elif z % 4 == 1:
            ring(z, [(cx - 5, cy), (cx, cy - 5), (cx + 5, cy), (cx, cy + 5)])
        elif z % 4 == 2:
            n = rnd.randint(5, 40)
            ring(z, [(cx + (3 + 6 * rnd.random()) * math.cos(2 * math.pi * k / n), cy + (3 + 6 * rnd.random()) * math.sin(2 * math.pi * k / n)) for k in range(n)])
        else:
            ring(z, [(cx - 4, cy - 4), (cx - 1, cy - 4), (cx - 3, cy + 4)])
            ring(z, [(cx + 1, cy - 3), (cx + 4, cy - 3), (cx + 4, cy + 3), (cx + 1, cy + 3)])
    place = lambda most: rnd.choice([rnd.uniform(-10, most + 10), rnd.randint(-2, most) + 0.5, float(rnd.randint(-2, most))])
    points = [(k, place(400), place(250)) for k in range(2000)]
    by = {}
    for z, *e in edges:
        by.setdefault(z, []).append(e)
    crossed = lambda x, y, e: (e[1] > y) != (e[3] > y) and x < e[0] + (y - e[1]) * (e[2] - e[0]) / (e[3] - e[1])
    want = {(k, z) for k, x, y in points for z, es in by.items() if abs((z % 40) * 10 + 5 - x) < 10 and abs((z // 40) * 10 + 5 - y) < 10 and sum(crossed(x, y, e) for e in es) % 2}
    outlines = spark.createDataFrame(edges, "zone_id int, x1 double, y1 double, x2 double, y2 double").persist()
    table = spark.createDataFrame([*points, (9999, None, 1.0)], "point_id int, x double, y double")
    for size in (None, 2.5, 0.9, 30.0):
        assert {tuple(r) for r in zones.point_in_zone(table, outlines, size).collect()} == want
    # No row meets an edge of another tile: a point has a row for each zone of its tile, with that tile's edges only.
    tiles = zones.zone_tiles(outlines, 1.25).persist()
    assert tiles.groupBy("tx", "ty", "zone_id").count().where("count > 1").count() == 0
    assert tiles.agg(F.max(F.size("edges"))).head()[0] < 8 and tiles.where("size(edges) = 0").count() > 10_000
    report = zones.placement_report(table, zones.point_in_zone(table, outlines, 1.25, tiles), outlines).head()
    assert (report.points, report.outside, report.zones, report.covered) == (2001, 2001 - len({k for k, _ in want}), 1000, len({z for _, z in want}))
    assert zones.point_in_zone(table.limit(0), outlines).count() == 0 and zones.point_in_zone(table, outlines.limit(0)).count() == 0


def test_geojson(spark, tmp_path):
    feature = {"type": "Feature", "properties": {"a.b": "x", "id": "z1"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}
    (tmp_path / "z.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}))
    found, edges = readers.read_zones(spark, str(tmp_path / "z.json"), "id")
    assert found.head().props == {"a_b": "x", "id": "z1"} and edges.count() == 3
    with pytest.raises(ValueError, match="no property"):
        readers.read_zones(spark, str(tmp_path / "z.json"), "nope")


def test_stream_equals_batch(spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()
    data = {"data": {"readings": [{"timestamp": f"2024-01-01T0{h}:10:00Z", "data": [{"stationId": "S1", "value": h + 1.0}, {"stationId": "S2", "value": h + 3.0}]} for h in range(3)]}}
    (landed / "a.json").write_text(json.dumps(data))
    stations = spark.createDataFrame([("S1", 7), ("S2", 7)], "station_id string, zone_id long")
    batch = {(r.zone_id, r.hour): (r.mean_value, r.n) for r in hourly_means(readers.read_readings(spark, str(landed)), stations).collect()}
    q = stream_zone_readings(spark, str(landed), stations).writeStream.format("memory").queryName("hours").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.zone_id, r.hour): (r.mean_value, r.n) for r in spark.table("hours").collect()} == batch and len(batch) == 3


def test_materialize_and_fingerprint(spark, tmp_path):
    path = str(tmp_path / "t")
    one = readers.materialize(spark, lambda: spark.range(5), path)
    assert readers.materialize(spark, lambda: spark.range(9), path).count() == 5
    assert readers.table_fingerprint(one).head() == readers.table_fingerprint(one.orderBy(F.desc("id"))).head()
