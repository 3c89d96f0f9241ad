"""Geometry as column expressions; only the hull, which has no built-in form, is an Arrow function."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KM_PER_DEGREE, KM_PER_EQUATOR_DEGREE = 111.0, 111.320


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance about the middle latitude."""
    north = (lat2 - lat1) * KM_PER_DEGREE
    east = (lon2 - lon1) * KM_PER_EQUATOR_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    return F.hypot(north, east)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    a, b, turn = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(turn) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(turn)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    """Smaller angle between two bearings."""
    apart = F.abs(a - b)
    return F.least(apart, 360 - apart)


def generalised(value: Column, cell_km: float) -> Column:
    """A coordinate snapped to a grid of about ``cell_km``; halves go to the even cell."""
    step = cell_km / KM_PER_DEGREE
    return F.bround(value / step) * step


def utm(lat: Column, lon: Column, epsg: int) -> tuple[Column, Column]:
    """Easting and northing in metres on WGS84, zone and hemisphere from the EPSG code (326xx north, 327xx south).

    Krueger's series in the third flattening, to the third order: within a millimetre inside a zone.
    """
    a, f, scale = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    ecc = 2 * math.sqrt(n) / (1 + n)
    phi, turn = F.radians(lat), F.radians(lon - (epsg % 100 * 6 - 183))
    atanh = lambda x: 0.5 * F.log((1 + x) / (1 - x))
    t = F.sinh(atanh(F.sin(phi)) - ecc * atanh(ecc * F.sin(phi)))
    xi = F.atan2(t, F.cos(turn))
    eta = atanh(F.sin(turn) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    false_north = 0.0 if epsg // 100 == 326 else 10_000_000.0
    return scale * radius * east + 500_000.0, scale * radius * north + false_north


def shoelace(points: Column) -> Column:
    """Area of a ring of structs (x, y); 0 for fewer than three points."""
    following = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    crossed = F.zip_with(points, following, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.when(F.size(points) < 3, 0.0).otherwise(F.abs(F.aggregate(crossed, F.lit(0.0), lambda acc, c: acc + c)) / 2)


def _corners(points: list) -> list[int]:
    """Places in ``points`` of the corners of their convex hull, counter-clockwise by (lat, lon), without points on its edges; all distinct points if fewer than three."""
    place = {}
    for i, p in enumerate(points):
        place.setdefault((float(p["lat"]), float(p["lon"])), i)
    ordered = sorted(place)
    if len(ordered) < 3:
        return [place[p] for p in ordered]

    def chain(side):
        out = []
        for lat, lon in side:
            while len(out) >= 2:
                (a_lat, a_lon), (b_lat, b_lon) = out[-2:]
                if (b_lat - a_lat) * (lon - a_lon) - (b_lon - a_lon) * (lat - a_lat) > 0:
                    break
                out.pop()
            out.append((lat, lon))
        return out[:-1]

    return [place[p] for p in chain(ordered) + chain(ordered[::-1])]


def corners_of(points: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else _corners(p) for p in points])


corners_of.__annotations__ = {"points": pd.Series, "return": pd.Series}


def convex_hull(points: Column) -> Column:
    """Hull of an array of structs (lat, lon and other fields, which the corners keep)."""
    return F.transform(F.pandas_udf(corners_of, "array<int>")(points), lambda i: F.get(points, i))


def ring_area_km2(hull: Column) -> Column:
    """Area of a hull whose corners carry their projected x and y (``utm``); null for fewer than three corners or no area."""
    area = shoelace(hull) / 1e6
    return F.when((F.size(hull) >= 3) & (area > 0), F.round(area, 2))


def wkt(hull: Column) -> Column:
    """Closed ring as WKT, longitude first."""
    closed = F.concat(hull, F.slice(hull, 1, 1))
    pairs = F.transform(closed, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string")))
    return F.when(F.size(hull) >= 3, F.concat(F.lit("POLYGON(("), F.array_join(pairs, ", "), F.lit("))")))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (x, y, w, h)."""
    side = lambda p, s: F.greatest(F.lit(0.0), F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]))
    both = side("x", "w") * side("y", "h")
    either = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(either > 0, both / either).otherwise(0.0)


def _turn(a: Column, b: Column, p: Column) -> Column:
    """Positive where p lies to the left of the line from a to b."""
    return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def clipped(ring: Column, convex: Column) -> Column:
    """Part of a ring of structs (x, y) that lies in a convex ring in counter-clockwise order: cut by one edge after the other."""

    def cut(points: Column, edge: Column) -> Column:
        sided = F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), _turn(edge["a"], edge["b"], p).alias("side")))

        def corner(p: Column, q: Column) -> Column:
            share = p["side"] / F.when(p["side"] != q["side"], p["side"] - q["side"])
            between = F.struct((p["x"] + share * (q["x"] - p["x"])).alias("x"), (p["y"] + share * (q["y"] - p["y"])).alias("y"))
            crosses = ((q["side"] >= 0) & (p["side"] < 0)) | ((q["side"] < 0) & (p["side"] >= 0))
            return F.array(F.when(crosses, between), F.when(q["side"] >= 0, F.struct(q["x"].alias("x"), q["y"].alias("y"))))

        return _once(sided, lambda s: F.array_compact(F.flatten(F.zip_with(_turned(s), s, corner))))

    plain = F.transform(ring, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    edges = F.zip_with(_turned(convex), convex, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.when((F.size(ring) >= 3) & (F.size(convex) >= 3), F.aggregate(edges, plain, cut)).otherwise(F.slice(plain, 1, 0))


def _turned(points: Column) -> Column:
    """Each point's predecessor: the last point first."""
    return F.concat(F.slice(points, -1, 1), F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))))


def overlap(a: Column, b: Column) -> Column:
    """Area that two hulls (x, y; both convex, counter-clockwise) share, as a share of the smaller one; 0 without area."""
    smaller = F.least(shoelace(a), shoelace(b))
    return F.when(smaller > 0, F.least(F.lit(1.0), _once(clipped(a, b), shoelace) / smaller)).otherwise(0.0)
