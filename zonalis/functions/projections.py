"""Transverse Mercator by Krüger's series, there and back, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The WGS84 ellipsoid's radius and flattening; scale and false easting of the zones.
RADIUS, FLATTENING, SCALE, EAST = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
N = FLATTENING / (2 - FLATTENING)
ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))
RECTIFYING = RADIUS / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)
#: The series to the sixth order in the third flattening N; each row has the factors of rising powers of N, row j from N**j on.
FORWARD = [
    [1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800],
    [13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360],
    [61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440],
    [49561 / 161280, -179 / 168, 6601661 / 7257600],
    [34729 / 80640, -3418889 / 1995840],
    [212378941 / 319334400],
]
BACKWARD = [
    [1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800],
    [1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720],
    [17 / 480, -37 / 840, -209 / 4480, 5569 / 90720],
    [4397 / 161280, -11 / 504, -830251 / 7257600],
    [4583 / 161280, -108847 / 3991680],
    [20648693 / 638668800],
]


def coefficients(table: list[list[float]]) -> list[float]:
    return [sum(c * N ** (j + k) for k, c in enumerate(row)) for j, row in enumerate(table, 1)]


def meridian(zone: int) -> float:
    return zone * 6.0 - 183.0


def to_utm(lon: Column, lat: Column, zone: int = 48) -> dict[str, Column]:
    """WGS84 degrees to x and y in metres, northern half: to well below a millimetre within some degrees of the zone's meridian."""
    sine, lam = F.sin(F.radians(lat)), F.radians(lon - meridian(zone))
    t = F.sinh(F.atanh(sine) - ECCENTRICITY * F.atanh(ECCENTRICITY * sine))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    x, y = eta, xi
    for j, a in enumerate(coefficients(FORWARD), 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return {"x": EAST + SCALE * RECTIFYING * x, "y": SCALE * RECTIFYING * y}


def from_utm(x: Column, y: Column, zone: int = 48) -> dict[str, Column]:
    """Metres to WGS84 degrees, the inverse of to_utm."""
    xi, eta = y / (SCALE * RECTIFYING), (x - EAST) / (SCALE * RECTIFYING)
    u, v = xi, eta
    for j, b in enumerate(coefficients(BACKWARD), 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    lam, conformal = F.atan2(F.sinh(v), F.cos(u)), F.asin(F.sin(u) / F.cosh(v))
    # Conformal to geographic latitude: each turn leaves a 150th of the error.
    target = F.atanh(F.sin(conformal))
    sine = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.sin(conformal), lambda s, _: F.tanh(target + ECCENTRICITY * F.atanh(ECCENTRICITY * s)))
    return {"lon": meridian(zone) + F.degrees(lam), "lat": F.degrees(F.asin(sine))}
