"""Zones: polygons as edges, points in zones, and joins of zone tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: What is taken from a tile's border to either side, in tiles: an edge that touches a tile is one of its edges.
MARGIN = 1e-6


def _crossing(y: Column, e) -> Column:
    """Whether an edge crosses the height y; its upper end counts, its lower one doesn't."""
    return (e["y1"] > y) != (e["y2"] > y)


def _at(y: Column, e) -> Column:
    """Where it does."""
    return e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])


def tile_size(edges: DataFrame, tiles: int = 8) -> float:
    """So that a zone of mean width and height has some tiles to each side."""
    wide = edges.groupBy("zone_id").agg((F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2"))).alias("w"), (F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2"))).alias("h"))
    found = wide.agg(F.avg(F.greatest("w", "h"))).first()[0]
    return found / tiles if found else 1.0


def zone_tiles(edges: DataFrame, size: float) -> DataFrame:
    """(tx, ty, zone_id, base, edges): the tiles that a zone covers wholly or in part.

    edges holds those that touch the tile, none for a tile wholly inside. base counts, at the tile's lower border, the
    zone's edges that pass to the right of it. With the tile's own edges that is all within_tile() needs, so a zone's other
    edges play no part. The table grows with the outlines' length and the zones' area in tiles; write it to use it twice.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = F.explode(F.sequence(F.floor(low / size - MARGIN), F.floor(high / size + MARGIN)))
    banded = edges.select("zone_id", "x1", "y1", "x2", "y2", rows.alias("ty"))
    clip = lambda y: F.greatest(low, F.least(high, y))
    sloped = lambda y: F.when(F.col("y1") == F.col("y2"), None).otherwise(_at(clip(y), {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}))
    ends = [sloped((F.col("ty") + k) * size) for k in (0, 1)]
    left, right = F.coalesce(F.least(*ends), F.least("x1", "x2")), F.coalesce(F.greatest(*ends), F.greatest("x1", "x2"))
    columns = F.explode(F.sequence(F.floor(left / size - MARGIN), F.floor(right / size + MARGIN)))
    cut = banded.select("*", columns.alias("tx")).groupBy("zone_id", "ty", "tx").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    # Where a zone's edges cross the lower border of each row of tiles.
    floor = F.col("ty") * size
    edge = {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}
    lines = banded.where(_crossing(floor, edge)).groupBy("zone_id", "ty").agg(F.array_sort(F.collect_list(_at(floor, edge))).alias("xs"))
    passing = lambda tx: F.size(F.filter(F.coalesce("xs", F.array().cast("array<double>")), lambda x: x > (tx + 1) * size))
    cut = cut.join(lines, ["zone_id", "ty"], "left").select("tx", "ty", "zone_id", passing(F.col("tx")).alias("base"), "edges")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1), lambda i: F.struct(F.get("xs", 2 * i).alias("a"), F.get("xs", 2 * i + 1).alias("b"))))
    spans = lines.where(F.size("xs") > 1).select("zone_id", "ty", pair.alias("p"))
    covered = spans.select("zone_id", "ty", F.explode(F.sequence(F.floor(F.col("p.a") / size) - 1, F.floor(F.col("p.b") / size))).alias("tx"), "p")
    covered = covered.where(((F.col("tx") + 1) * size >= F.col("p.a")) & ((F.col("tx") + 1) * size < F.col("p.b"))).select("tx", "ty", "zone_id")
    whole = covered.distinct().join(cut.select("tx", "ty", "zone_id"), ["tx", "ty", "zone_id"], "left_anti")
    return cut.unionByName(whole.select("tx", "ty", "zone_id", F.lit(1).alias("base"), F.array().cast(cut.schema["edges"].dataType).alias("edges")))


def within_tile(x: Column, y: Column, size: float) -> Column:
    """Whether a point is within the zone of a row of zone_tiles: what a ray to its right crosses, over all of the zone's edges, is odd.

    In the tile the ray crosses the tile's edges. What it crosses beyond the right border, at the point's height, differs
    from base by the tile's edges that cross this border: each counts where its end beyond is above one height and not the
    other, or where it is itself crossed beyond at one of them.
    """
    border, floor = (F.col("tx") + 1) * size, F.col("ty") * size

    def beyond(e, at: Column) -> Column:
        end = F.when(e["x1"] > border, e["y1"]).otherwise(e["y2"])
        crossed = _crossing(at, e) & F.coalesce(F.when(_crossing(at, e), _at(at, e) > border), F.lit(False))
        return (end > at).cast("int") + crossed.cast("int")

    def count(total: Column, e) -> Column:
        own = F.when(_crossing(y, e), (x < _at(y, e)) & (_at(y, e) <= border)).otherwise(False).cast("int")
        over = F.when((e["x1"] > border) != (e["x2"] > border), beyond(e, y) + beyond(e, floor)).otherwise(0)
        return total + own + over

    return F.aggregate("edges", F.col("base"), count) % 2 == 1


def point_in_zone(points: DataFrame, edges: DataFrame, size: float | None = None, tiles: DataFrame | None = None) -> DataFrame:
    """points (point_id, x, y) strictly within zones: (point_id, zone_id), a row for each zone that a point is in.

    Points meet the zones of their tile only. tiles: zone_tiles(edges, size), if it is written already. Points or edges
    with NULL are outside; a point on an outline may be in either of the zones it divides.
    """
    size = size or tile_size(edges)
    tiles = zone_tiles(edges, size) if tiles is None else tiles
    tiled = points.select("point_id", "x", "y", F.floor(F.col("x") / size).alias("tx"), F.floor(F.col("y") / size).alias("ty"))
    return tiled.join(tiles, ["tx", "ty"]).where(within_tile(F.col("x"), F.col("y"), size)).select("point_id", "zone_id")


def placement_report(points: DataFrame, placed: DataFrame, zones: DataFrame) -> DataFrame:
    """One row: points, those outside of all zones, zones, those with a point and their share in per cent."""
    hit = placed.select("point_id").distinct().withColumn("in", F.lit(1))
    counted = points.select("point_id").join(hit, "point_id", "left").agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("in").isNull()).alias("outside"))
    used = zones.select("zone_id").distinct().join(placed.select("zone_id").distinct().withColumn("has", F.lit(1)), "zone_id", "left")
    covered = used.agg(F.count(F.lit(1)).alias("zones"), F.count("has").alias("covered"))
    return counted.crossJoin(covered).withColumn("coverage_pct", F.try_divide(100.0 * F.col("covered"), "zones"))  # one row each


def zone_cells_of(cells: DataFrame, edges: DataFrame, origin: tuple[float, float] = (0.0, 0.0), pixel: float = 1.0, size: float | None = None) -> DataFrame:
    """(gx, gy, zone_id): the zones that the centre of each cell lies in; rows go up from the origin, or down with a negative pixel height."""
    centres = cells.select(F.struct("gx", "gy").alias("point_id"), (origin[0] + (F.col("gx") + 0.5) * pixel).alias("x"), (origin[1] + (F.col("gy") + 0.5) * pixel).alias("y"))
    return point_in_zone(centres, edges, size).select("point_id.gx", "point_id.gy", "zone_id")


def zone_area(edges: DataFrame) -> DataFrame:
    """Area and centroid from the shoelace sums; holes run the other way round."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    sums = edges.groupBy("zone_id").agg(F.sum(cross).alias("s"), F.sum((F.col("x1") + F.col("x2")) * cross).alias("sx"), F.sum((F.col("y1") + F.col("y2")) * cross).alias("sy"))
    return sums.select("zone_id", (F.abs("s") / 2).alias("area"), F.try_divide("sx", 3 * F.col("s")).alias("cx"), F.try_divide("sy", 3 * F.col("s")).alias("cy"))


def exclude_near(cells: DataFrame, points: DataFrame, reach: float) -> DataFrame:
    """cells (x, y, ...) further than reach from all points: points go to the 3 x 3 buckets around them."""
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    spread = points.select(F.col("x").alias("px"), F.col("y").alias("py")).withColumn("dx", near).withColumn("dy", near)
    spread = spread.select("px", "py", (F.floor(F.col("px") / reach) + F.col("dx")).alias("bx"), (F.floor(F.col("py") / reach) + F.col("dy")).alias("by"))
    bucketed = cells.withColumns({"bx": F.floor(F.col("x") / reach), "by": F.floor(F.col("y") / reach)})
    close = (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py")) <= reach * reach
    c, p = bucketed.alias("c"), spread.alias("p")
    return c.join(p, (F.col("c.bx") == F.col("p.bx")) & (F.col("c.by") == F.col("p.by")) & close, "left_anti").drop("bx", "by")


def exclusion_report(cells: DataFrame, kept: DataFrame, pixel: float = 1.0, least_area: float = 1000.0) -> DataFrame:
    """One row: cells, those that exclude_near() left out, their area, and whether that is less than it should be."""
    counted = cells.agg(F.count(F.lit(1)).alias("cells")).crossJoin(kept.agg(F.count(F.lit(1)).alias("__kept")))  # one row each
    out = F.col("cells") - F.col("__kept")
    return counted.select("cells", out.alias("excluded"), (out * pixel * pixel).alias("excluded_area"), (out * pixel * pixel < least_area).alias("small"))


def join_counted(base: DataFrame, others: dict[str, DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """base's rows with the columns of all others, which have unique keys; and one row: rows, missing_<name> of each, dropped, joined.

    Value and counts come from the same left joins: rows that lack a partner are marked and counted, then left out.
    """
    wide = base
    for name, other in others.items():
        wide = wide.join(other.withColumn(f"__{name}", F.lit(1)), key, "left")
    has = [F.col(f"__{n}").isNotNull() for n in others]
    every = reduce(lambda a, b: a & b, has)
    report = wide.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(~h).alias(f"missing_{n}") for n, h in zip(others, has, strict=True)], F.count_if(~every).alias("dropped"), F.count_if(every).alias("joined"))
    return wide.where(every).drop(*[f"__{n}" for n in others]), report


def match_report(a: DataFrame, b: DataFrame, key: str, names: int = 0) -> DataFrame:
    """One row: keys in both tables, in the first only, in the second only; with so many names of each kind of the unmatched, if asked."""
    both = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full")
    out = both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("matched"), F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"))
    if names:
        for name, lacks in (("left_names", "b"), ("right_names", "a")):
            first = both.where(F.col(lacks).isNull()).orderBy(key).limit(names)
            out = out.crossJoin(first.agg(F.array_sort(F.collect_list(key)).alias(name)))  # names rows at most
    return out


def outer_join_all(tables: list[DataFrame], key: str) -> DataFrame:
    return reduce(lambda a, b: a.join(b, key, "full"), tables)


def minmax(col: str, over) -> Column:
    """0 to 1 over a window; a constant column is 0, NULL stays NULL."""
    lo, hi = F.min(col).over(over), F.max(col).over(over)
    return F.when(F.col(col).isNotNull(), F.when(hi == lo, F.lit(0.0)).otherwise((F.col(col) - lo) / (hi - lo)))


def scaled(df: DataFrame, cols: list[str]) -> DataFrame:
    """Each column from 0 to 1 over the whole table, by two aggregates that are joined back."""
    bounds = df.agg(*[f(c).alias(f"__{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.crossJoin(F.broadcast(bounds))  # one row
    lo, hi = lambda c: F.col(f"__lo_{c}"), lambda c: F.col(f"__hi_{c}")
    named = {f"{c}_norm": F.when(F.col(c).isNotNull(), F.when(hi(c) == lo(c), 0.0).otherwise((F.col(c) - lo(c)) / (hi(c) - lo(c)))) for c in cols}
    return out.withColumns(named).select(*df.columns, *named)
