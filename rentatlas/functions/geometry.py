"""State-plane projection and point-in-polygon tests as plain column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

WGS84_SRID = 4326
STATE_PLANE_SRID = 26986

RINGS_TYPE = "array<array<struct<x:double,y:double>>>"

# The one projected system the data uses (Lambert conformal conic with two
# standard parallels on the GRS80 ellipsoid, metres).
LAT_1 = 41.71666666666667
LAT_2 = 42.68333333333333
LAT_0 = 41.0
LON_0 = -71.5
FALSE_EASTING = 200000.0
FALSE_NORTHING = 750000.0
SEMI_MAJOR = 6378137.0
INVERSE_FLATTENING = 298.257222101


@dataclass(frozen=True)
class Cone:
    """Constants of the conic projection that do not depend on the point."""

    e: float
    n: float
    scale: float
    rho_0: float

    @classmethod
    def of_state_plane(cls) -> Cone:
        flattening = 1 / INVERSE_FLATTENING
        e = math.sqrt(flattening * (2 - flattening))

        def m(lat: float) -> float:
            return math.cos(lat) / math.sqrt(1 - (e * math.sin(lat)) ** 2)

        def t(lat: float) -> float:
            s = e * math.sin(lat)
            return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (e / 2)

        lat_0, lat_1, lat_2 = (math.radians(v) for v in (LAT_0, LAT_1, LAT_2))
        n = (math.log(m(lat_1)) - math.log(m(lat_2))) / (math.log(t(lat_1)) - math.log(t(lat_2)))
        scale = SEMI_MAJOR * m(lat_1) / (n * t(lat_1) ** n)
        return cls(e, n, scale, scale * t(lat_0) ** n)


CONE = Cone.of_state_plane()


def to_state_plane(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres east and north for degrees; NULL outside the range of valid degrees."""
    ok = lon.between(-180, 180) & (F.abs(lat) < 90)
    lon, lat = F.when(ok, lon), F.when(ok, lat)
    s = CONE.e * F.sin(F.radians(lat))
    t = F.tan(math.pi / 4 - F.radians(lat) / 2) / F.pow((1 - s) / (1 + s), F.lit(CONE.e / 2))
    rho = CONE.scale * F.pow(t, F.lit(CONE.n))
    theta = CONE.n * F.radians(lon - LON_0)
    x = FALSE_EASTING + rho * F.sin(theta)
    y = FALSE_NORTHING + CONE.rho_0 - rho * F.cos(theta)
    return x, y


def to_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude for metres, by the series from conformal to geodetic latitude."""
    dx = x - FALSE_EASTING
    dy = CONE.rho_0 - (y - FALSE_NORTHING)
    rho = F.sqrt(dx * dx + dy * dy)
    chi = math.pi / 2 - 2 * F.atan(F.pow(rho / CONE.scale, F.lit(1 / CONE.n)))
    e2 = CONE.e**2
    series = [
        (2, e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360),
        (4, 7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520),
        (6, 7 * e2**3 / 120 + 81 * e2**4 / 1120),
        (8, 4279 * e2**4 / 161280),
    ]
    lat = chi
    for multiple, factor in series:
        lat = lat + factor * F.sin(multiple * chi)
    lon = LON_0 + F.degrees(F.atan2(dx, dy)) / CONE.n
    return lon, F.degrees(lat)


def edges_of(rings: Column) -> Column:
    """All ring edges as one array, each from its lower to its upper end.

    A ring that is not closed is closed by its last edge.
    """

    def ring_edges(ring: Column) -> Column:
        def edge(p: Column, i: Column) -> Column:
            q = F.get(ring, F.pmod(i + 1, F.size(ring)))
            return F.when(p["y"] <= q["y"], _edge(p, q)).otherwise(_edge(q, p))

        return F.transform(ring, edge)

    return F.flatten(F.transform(rings, ring_edges))


def _edge(low: Column, high: Column) -> Column:
    return F.struct(
        low["x"].alias("x1"), low["y"].alias("y1"), high["x"].alias("x2"), high["y"].alias("y2")
    )


def crossings(x: Column, y: Column, edges: Column) -> Column:
    """Edges a ray from (x, y) towards +x crosses, or -1 when the point lies on an edge."""

    def step(total: Column, e: Column) -> Column:
        side = (e["x1"] - x) * (e["y2"] - y) - (e["x2"] - x) * (e["y1"] - y)
        on_edge = (
            (side == 0)
            & (x >= F.least(e["x1"], e["x2"]))
            & (x <= F.greatest(e["x1"], e["x2"]))
        )
        return (
            F.when((y < e["y1"]) | (y > e["y2"]), total)
            .when((total < 0) | on_edge, F.lit(-1))
            .when((y < e["y2"]) & (side > 0), total + 1)
            .otherwise(total)
        )

    return F.aggregate(edges, F.lit(0), step)


def covers(x: Column, y: Column, edges: Column) -> Column:
    """Point in polygon by even-odd over all rings; the boundary counts as inside."""
    return F.pmod(crossings(x, y, edges), F.lit(2)) == 1
