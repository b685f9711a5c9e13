"""Geometry on GeoJSON text, in metres on the WGS84 ellipsoid.

Shapes are parsed with built-in JSON functions and tested with higher-order ones; only Vincenty's iteration runs in
Python, on Arrow batches, behind a box test that the JVM makes first. A shape's holes don't count.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

A, FLAT = 6_378_137.0, 1 / 298.257223563
MEAN_R = 6_371_008.8
AUTHALIC_R = 6_371_007.18091847
E2 = FLAT * (2 - FLAT)
_NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][+\-]?\d+)?"

Ring = list[tuple[float, float]]  # (lon, lat)


def kind(g: Column) -> Column:
    return F.get_json_object(g, "$.type")


def vertices(g: Column) -> Column:
    """All positions of a shape, as structs of lon and lat in order; NULL if there are none."""
    found = F.regexp_extract_all(g, F.lit(rf"\[\s*({_NUMBER}\s*,\s*{_NUMBER})"), 1)
    points = F.transform(found, lambda s: F.struct(F.split_part(s, F.lit(","), F.lit(1)).cast("double").alias("lon"), F.trim(F.split_part(s, F.lit(","), F.lit(2))).cast("double").alias("lat")))
    return F.when(F.size(points) > 0, points)


def rings(g: Column) -> Column:
    """Outer rings of a Polygon or MultiPolygon; an empty array for other shapes."""
    coords = F.get_json_object(g, "$.coordinates")
    one = F.slice(F.from_json(coords, "array<array<array<double>>>"), 1, 1)
    many = F.transform(F.from_json(coords, "array<array<array<array<double>>>>"), lambda p: F.get(p, F.lit(0)))
    raw = F.when(kind(g) == "Polygon", one).when(kind(g) == "MultiPolygon", many)
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat"))
    none = F.array().cast("array<array<struct<lon:double,lat:double>>>")
    return F.coalesce(F.transform(raw, lambda r: F.transform(r, point)), none)


def literal_ring(ring: Ring) -> Column:
    return F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ring])


def point_json(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit('{"coordinates":['), lon.cast("string"), F.lit(","), lat.cast("string"), F.lit('],"type":"Point"}'))


def centroid(g: Column) -> Column:
    """The mean of all positions, the closing one too, as a Point."""
    v = vertices(g)
    mean = lambda f: F.aggregate(v, F.lit(0.0), lambda s, p: s + p[f]) / F.size(v)
    return point_json(mean("lon"), mean("lat"))


def _edges(ring: Column, closed: bool = True) -> Column:
    """(a, b) for each side; closed also joins the ends."""
    n = F.size(ring)
    ends = F.concat(F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1)) if closed else F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0)))
    starts = ring if closed else F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def inside(lon: Column, lat: Column, ring: Column) -> Column:
    """Ray casting; a ring of fewer than 3 positions holds nothing."""
    crosses = lambda e: ((e.a.lat > lat) != (e.b.lat > lat)) & (lon < F.try_divide((e.a.lon - e.b.lon) * (lat - e.b.lat), e.a.lat - e.b.lat) + e.b.lon)
    return (F.size(ring) >= 3) & (F.size(F.filter(_edges(ring), crosses)) % 2 == 1)


def box(g: Column) -> Column:
    v = vertices(g)
    lons, lats = _axes(v)
    return F.struct(F.array_min(lons).alias("w"), F.array_max(lons).alias("e"), F.array_min(lats).alias("s"), F.array_max(lats).alias("n"))


def contains_point(g: Column, lon: float, lat: float) -> Column:
    return F.exists(rings(g), lambda r: inside(F.lit(float(lon)), F.lit(float(lat)), r))


def _holds(x: float, y: float):
    return lambda o: inside(F.lit(float(x)), F.lit(float(y)), o)


def contains_polygon(g: Column, ring: Ring) -> Column:
    """Every position of the polygon is in some ring."""
    r = rings(g)
    every = F.lit(bool(ring))
    for x, y in ring:
        every = every & F.exists(r, _holds(x, y))
    return every


def within_polygon(g: Column, ring: Ring) -> Column:
    """Every position is in the polygon."""
    q = literal_ring(ring)
    return F.coalesce(F.forall(vertices(g), lambda p: inside(p.lon, p.lat, q)), F.lit(False))


def _cross(p: Column, q: Column, r: Column) -> Column:
    return (q.lon - p.lon) * (r.lat - p.lat) - (q.lat - p.lat) * (r.lon - p.lon)


def _on(a: Column, b: Column, p: Column) -> Column:
    return p.lon.between(F.least(a.lon, b.lon), F.greatest(a.lon, b.lon)) & p.lat.between(F.least(a.lat, b.lat), F.greatest(a.lat, b.lat))


def _meet(e: Column, f: Column) -> Column:
    d = [_cross(e.a, e.b, f.a), _cross(e.a, e.b, f.b), _cross(f.a, f.b, e.a), _cross(f.a, f.b, e.b)]
    proper = (d[0] * d[1] < 0) & (d[2] * d[3] < 0)
    return proper | ((d[0] == 0) & _on(e.a, e.b, f.a)) | ((d[1] == 0) & _on(e.a, e.b, f.b)) | ((d[2] == 0) & _on(f.a, f.b, e.a)) | ((d[3] == 0) & _on(f.a, f.b, e.b))


def intersects_polygon(g: Column, ring: Ring) -> Column:
    """A position of either is in the other, or two sides meet."""
    q = literal_ring(ring)
    v = vertices(g)
    node_in = F.exists(v, lambda p: inside(p.lon, p.lat, q))
    ring_in = F.exists(rings(g), lambda r: F.exists(q, lambda p: inside(p.lon, p.lat, r)))
    sides = F.exists(_edges(v, closed=False), lambda e: F.exists(_edges(q), lambda f: _meet(e, f)))
    return F.coalesce(node_in | ring_in | sides, F.lit(False))


def vincenty_m(lat1, lon1, lat2, lon2) -> np.ndarray:
    """Metres between points in degrees, by Vincenty's inverse formula, on arrays."""
    p1, p2, dl = np.radians(lat1), np.radians(lat2), np.radians(np.asarray(lon2) - lon1)
    b = A * (1 - FLAT)
    u1, u2 = np.arctan((1 - FLAT) * np.tan(p1)), np.arctan((1 - FLAT) * np.tan(p2))
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = np.array(dl, float, copy=True)
    with np.errstate(all="ignore"):
        for _ in range(200):
            s, c = np.sin(lam), np.cos(lam)
            ss = np.hypot(cu2 * s, cu1 * su2 - su1 * cu2 * c)
            cs = su1 * su2 + cu1 * cu2 * c
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0, cu1 * cu2 * s / np.where(ss == 0, 1, ss))
            ca2 = 1 - sa**2
            c2m = np.where(ca2 == 0, 0, cs - 2 * su1 * su2 / np.where(ca2 == 0, 1, ca2))
            k = FLAT / 16 * ca2 * (4 + FLAT * (4 - 3 * ca2))
            new = dl + (1 - k) * FLAT * sa * (sigma + k * ss * (c2m + k * cs * (2 * c2m**2 - 1)))
            done = np.nanmax(np.abs(new - lam), initial=0) < 1e-12
            lam = new
            if done:
                break
        u = ca2 * (A**2 - b**2) / b**2
        big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        ds = small * ss * (c2m + small / 4 * (cs * (2 * c2m**2 - 1) - small / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))
    return np.where(ss == 0, 0.0, b * big * (sigma - ds))


@F.pandas_udf(DoubleType())
def vincenty(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    return pd.Series(vincenty_m(*(x.to_numpy(float) for x in (lat1, lon1, lat2, lon2)))).where(lat1.notna() & lon1.notna())


@F.pandas_udf(DoubleType())
def _nearest_vertex(lons: pd.Series, lats: pd.Series, lon: pd.Series, lat: pd.Series) -> pd.Series:
    sizes = [0 if x is None else len(x) for x in lons]
    if not sum(sizes):
        return pd.Series([None] * len(lons), dtype="float64")
    row = np.repeat(np.arange(len(sizes)), sizes)
    d = vincenty_m(np.concatenate([x for x in lats if x is not None]), np.concatenate([x for x in lons if x is not None]), lat.to_numpy()[row], lon.to_numpy()[row])
    return pd.Series(d).groupby(row).min().reindex(range(len(sizes)))


def _axes(v: Column) -> tuple[Column, Column]:
    return F.transform(v, lambda p: p.lon), F.transform(v, lambda p: p.lat)


def distance(g: Column, lon: float, lat: float) -> Column:
    """Metres from the nearest position of a shape to a point; NULL without a shape."""
    return _nearest_vertex(*_axes(vertices(g)), F.lit(float(lon)), F.lit(float(lat)))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * MEAN_R * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def _bearing(a: Column, b: Column) -> Column:
    p1, p2, dl = F.radians(a.lat), F.radians(b.lat), F.radians(b.lon - a.lon)
    return F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl))


def _to_segment(p: Column, e: Column) -> Column:
    da = haversine(e.a.lon, e.a.lat, p.lon, p.lat)
    dab = haversine(e.a.lon, e.a.lat, e.b.lon, e.b.lat)
    db = haversine(e.b.lon, e.b.lat, p.lon, p.lat)
    off = F.asin(F.sin(da / MEAN_R) * F.sin(_bearing(e.a, p) - _bearing(e.a, e.b)))
    before = F.cos(_bearing(e.a, p) - _bearing(e.a, e.b)) < 0  # the foot is behind a
    along = F.acos(F.least(F.greatest(F.cos(da / MEAN_R) / F.cos(off), F.lit(-1.0)), F.lit(1.0)))
    return F.when(dab < 1e-6, da).when(before, da).when(along > dab / MEAN_R, db).otherwise(F.abs(off) * MEAN_R)


def ring_distance(g: Column, lon: float, lat: float) -> Column:
    """Metres from a point to a polygon: 0 inside, else to its nearest side on the mean sphere."""
    r, x, y = rings(g), F.lit(float(lon)), F.lit(float(lat))
    p = F.struct(x.alias("lon"), y.alias("lat"))
    near = F.array_min(F.transform(r, lambda o: F.array_min(F.transform(_edges(o, closed=False), lambda e: _to_segment(p, e)))))
    return F.when(F.exists(r, lambda o: inside(x, y, o)), 0.0).otherwise(near)


def near_box(g: Column, lon: float, lat: float, metres: float) -> Column:
    """A cheap test that every shape within `metres` passes: its box meets the circle's."""
    up = math.degrees(metres / 6_335_000.0) + 1e-9
    top = min(90.0, abs(lat) + up)
    wide = 360.0 if top >= 89.9 else math.degrees(metres / (6_335_000.0 * math.cos(math.radians(top)))) + 1e-9
    b = box(g)
    test = (b.s <= lat + up) & (b.n >= lat - up)
    return test & (b.w <= lon + wide) & (b.e >= lon - wide) if lon - wide >= -180 and lon + wide <= 180 else test


def dwithin(g: Column, lon: float, lat: float, metres: float) -> tuple[Column, Column]:
    """(box test, exact test): a point by Vincenty, a polygon from its boundary, other shapes from their centroid."""
    v = vertices(g)
    mean = lambda f: F.aggregate(v, F.lit(0.0), lambda s, p: s + p[f]) / F.size(v)
    far = F.when(F.size(rings(g)) > 0, ring_distance(g, lon, lat))
    exact = F.coalesce(far, vincenty(mean("lat"), mean("lon"), F.lit(float(lat)), F.lit(float(lon))))
    return near_box(g, lon, lat, metres), F.coalesce(exact <= metres, F.lit(False))


def length(g: Column) -> Column:
    """Metres along a LineString or MultiLineString, part by part; 0 for other shapes."""
    coords = F.get_json_object(g, "$.coordinates")
    lines = F.when(kind(g) == "LineString", F.array(F.from_json(coords, "array<array<double>>"))).when(kind(g) == "MultiLineString", F.from_json(coords, "array<array<array<double>>>"))
    legs = F.flatten(F.transform(lines, lambda l: F.zip_with(F.slice(l, F.lit(1), F.greatest(F.size(l) - 1, F.lit(0))), F.slice(l, F.lit(2), F.greatest(F.size(l) - 1, F.lit(0))), lambda a, b: F.array(a[0], a[1], b[0], b[1]))))
    part = lambda i: F.transform(legs, lambda x: x[i])
    return F.when(g.isNotNull(), F.coalesce(_leg_lengths(part(0), part(1), part(2), part(3)), F.lit(0.0)))


@F.pandas_udf(DoubleType())
def _leg_lengths(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    sizes = np.fromiter((0 if x is None else len(x) for x in lon1), np.int64, len(lon1))
    joined = [np.concatenate([x for x in c if x is not None and len(x)]) if sizes.sum() else np.zeros(0) for c in (lat1, lon1, lat2, lon2)]
    metres = np.bincount(np.repeat(np.arange(len(sizes)), sizes), vincenty_m(*joined), len(sizes)) if sizes.sum() else np.zeros(len(sizes))
    return pd.Series(metres).where(lon1.notna().reset_index(drop=True))


def perimeter(g: Column) -> Column:
    """Metres around the outer rings; NULL for shapes that aren't areas."""
    sides = F.flatten(F.transform(rings(g), lambda r: _edges(r)))
    got = _leg_lengths(F.transform(sides, lambda e: e.a.lon), F.transform(sides, lambda e: e.a.lat), F.transform(sides, lambda e: e.b.lon), F.transform(sides, lambda e: e.b.lat))
    return F.when(F.size(rings(g)) > 0, got)


def area(g: Column) -> Column:
    """Square metres of the outer rings by spherical excess in authalic latitude; NULL if not an area."""
    e = math.sqrt(E2)

    def q(s):
        return (1 - E2) * (s / (1 - E2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))

    qp = (1 - E2) * (1 / (1 - E2) - math.log((1 - e) / (1 + e)) / (2 * e))
    half = lambda lat: F.tan(F.asin(F.least(F.greatest(q(F.sin(F.radians(lat))) / qp, F.lit(-1.0)), F.lit(1.0))) / 2)

    def excess(r):
        turn = lambda s: 2 * F.atan2(F.tan(F.radians(s.b.lon - s.a.lon) / 2) * (half(s.a.lat) + half(s.b.lat)), 1 + half(s.a.lat) * half(s.b.lat))
        return F.when(F.size(r) < 3, 0.0).otherwise(F.abs(F.aggregate(_edges(r), F.lit(0.0), lambda t, s: t + turn(s))))

    return F.when(F.size(rings(g)) > 0, F.aggregate(rings(g), F.lit(0.0), lambda t, r: t + excess(r)) * AUTHALIC_R**2)


def parse_polygon(text: str) -> Ring:
    """The outer ring of a GeoJSON polygon."""
    shape = json.loads(text)
    coords = shape["coordinates"][0] if shape["type"] == "Polygon" else shape["coordinates"][0][0]
    return [(float(p[0]), float(p[1])) for p in coords]
