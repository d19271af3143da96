"""Column expressions: masks, scaling, indices, names, classes and projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digital numbers to physical units.
OPTICAL, THERMAL, KELVIN, REFLECTANCE, COARSE_THERMAL = (0.0000275, -0.2), (0.00341802, 149.0), 273.15, 0.0001, 0.02
#: Bands of agreement, each up to its bound.
KAPPA_BANDS = [(0.0, "poor (worse than chance)"), (0.20, "slight"), (0.40, "fair"), (0.60, "moderate"), (0.80, "substantial")]


def qa_clear(qa: Column, saturated: Column, bits: range = range(1, 6)) -> Column:
    """True where none of the quality bits is set and nothing is saturated."""
    return (qa.bitwiseAND(sum(1 << b for b in bits)) == 0) & (saturated == 0)


def cloud_free(probability: Column, most: float = 70.0) -> Column:
    return probability < most


def scene_class_kept(scl: Column, drop: tuple[int, ...] = (3, 8, 9, 10, 11)) -> Column:
    return ~scl.isin(*drop)


def optical(dn: Column) -> Column:
    return dn * OPTICAL[0] + OPTICAL[1]


def thermal_celsius(dn: Column) -> Column:
    return dn * THERMAL[0] + THERMAL[1] - KELVIN


def coarse_celsius(dn: Column) -> Column:
    """0 means no data."""
    return F.nullif(dn.cast("double"), F.lit(0.0)) * COARSE_THERMAL - KELVIN


def normalized_difference(a: Column, b: Column, eps: float = 0.0) -> Column:
    return F.try_divide(a - b, a + b + eps)


def in_season(at: Column, years: list[int], months: list[int]) -> Column:
    """Whole months, each a half-open window."""
    return F.year(at).isin(*years) & F.month(at).isin(*months)


def in_period(at: Column, start: str, end: str, months: list[int] | None = None) -> Column:
    inside = (at >= F.to_timestamp(F.lit(start))) & (at < F.to_timestamp(F.lit(end)))
    return inside & F.month(at).isin(*months) if months else inside


def in_box(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def normalize_name(name: Column) -> Column:
    """White space at both ends goes, upper case."""
    return F.upper(F.regexp_replace(F.regexp_replace(name, r"^\s+", ""), r"\s+$", ""))


def parse_suppressed(text: Column) -> Column:
    """- is 0; what else isn't a number is NULL."""
    return F.when(text == "-", F.lit(0.0)).otherwise(text.try_cast("double"))


def rule_landcover(ndwi: Column, ndvi: Column, ndbi: Column) -> Column:
    """4 water, 1 vegetation, 2 built-up, 3 bare."""
    return F.when(ndwi > 0.1, 4).when(ndvi > 0.35, 1).when(ndbi > 0, 2).otherwise(3)


def remap_class(code: Column, mapping: dict[int, int], default: int = 0) -> Column:
    """0 means masked and becomes NULL."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.nullif(F.coalesce(F.try_element_at(table, code), F.lit(default)), F.lit(0))


def one_hot(code: Column, classes: list[int], prefix: str) -> dict[str, Column]:
    return {f"{prefix}_{k}": (code == k).cast("double") for k in classes}


def kappa_band(kappa: Column) -> Column:
    out = F.when(kappa < KAPPA_BANDS[0][0], KAPPA_BANDS[0][1])
    for bound, name in KAPPA_BANDS[1:]:
        out = out.when(kappa < bound, name)
    return F.when(kappa.isNotNull(), out.otherwise("almost perfect"))


def in_disc(gx: Column, gy: Column, cx: int, cy: int, radius: float, pixel: float) -> Column:
    return (gx - cx) * (gx - cx) + (gy - cy) * (gy - cy) <= (radius / pixel) ** 2


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed only, not on the layout of the data."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def to_cell(x: Column, y: Column, origin: tuple[float, float], pixel: float) -> dict[str, Column]:
    """Column and row, truncated towards zero; rows go down."""
    return {"gx": ((x - origin[0]) / pixel).cast("long"), "gy": ((origin[1] - y) / pixel).cast("long")}
