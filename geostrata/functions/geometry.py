"""Geometry as plain columns.

A polygon is an array of rings, the first the shell and others holes; a ring is a closed array of
struct<x double, y double>; a line is one such array, open. Measures and reprojections are Column
expressions; predicates of two geometries run on Arrow batches with numpy.
"""

from __future__ import annotations

import json
import math
import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
RING = f"array<{POINT}>"
POLYGON = f"array<{RING}>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rectangle(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return F.array(F.array(point(xmin, ymin), point(xmax, ymin), point(xmax, ymax), point(xmin, ymax), point(xmin, ymin)))


def flat(ring3d: Column) -> Column:
    """A ring of points without their z."""
    return F.transform(ring3d, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))


def _steps(ring: Column) -> Column:
    return F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def length(line: Column) -> Column:
    return F.when(F.size(line) < 2, 0.0).otherwise(F.aggregate(_steps(line), F.lit(0.0), lambda s, e: s + F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])))


def ring_area(ring: Column) -> Column:
    twice = F.aggregate(_steps(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.when(F.size(ring) < 4, 0.0).otherwise(F.abs(twice) / 2)


def area(polygon: Column) -> Column:
    """The shell's area without the holes'."""
    holes = F.aggregate(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), F.lit(0.0), lambda s, r: s + ring_area(r))
    return ring_area(polygon[0]) - holes


def without_small_holes(polygon: Column, least: float) -> Column:
    return F.filter(polygon, lambda r, k: (k == 0) | (ring_area(r) >= least))


def bounds(polygon: Column) -> Column:
    xs, ys = F.transform(polygon[0], lambda p: p["x"]), F.transform(polygon[0], lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def boxes_meet(a: str, b: str) -> Column:
    """Whether bounding boxes in columns <prefix>xmin and so on meet; touching ones do."""
    c = F.col
    return (c(f"{a}xmin") <= c(f"{b}xmax")) & (c(f"{a}xmax") >= c(f"{b}xmin")) & (c(f"{a}ymin") <= c(f"{b}ymax")) & (c(f"{a}ymax") >= c(f"{b}ymin"))


# --- reprojection, closed forms

EARTH = 6378137.0
FLATTENING = 1 / 298.257222101


def mercator(lon: Column, lat: Column) -> Column:
    """Spherical Mercator (3857) of degrees."""
    return point(F.radians(lon) * EARTH, F.ln(F.tan(math.pi / 4 + F.radians(lat) / 2)) * EARTH)


def from_mercator(x: Column, y: Column) -> Column:
    return point(F.degrees(x / EARTH), F.degrees(2 * F.atan(F.exp(y / EARTH)) - math.pi / 2))


def albers_constants() -> tuple[float, float, float, float]:
    """Eccentricity, cone constant, C and rho of the origin, of the conterminous Albers projection (5072)."""
    e = math.sqrt(2 * FLATTENING - FLATTENING**2)

    def m(p: float) -> float:
        return math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)

    def q(p: float) -> float:
        s = math.sin(p)
        return (1 - e * e) * (s / (1 - (e * s) ** 2) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    first, second, origin = (math.radians(x) for x in (29.5, 45.5, 23.0))
    n = (m(first) ** 2 - m(second) ** 2) / (q(second) - q(first))
    c = m(first) ** 2 + n * q(first)
    return e, n, c, EARTH * math.sqrt(c - n * q(origin)) / n


def albers(lon: Column, lat: Column) -> Column:
    """Equal-area Albers (5072) of degrees, after Snyder (1987)."""
    e, n, c, rho0 = albers_constants()
    s = F.sin(F.radians(lat))
    q = (1 - e * e) * (s / (1 - (e * s) * (e * s)) - F.ln((1 - e * s) / (1 + e * s)) / (2 * e))
    rho, theta = EARTH * F.sqrt(c - n * q) / n, n * F.radians(lon + 96)
    return point(rho * F.sin(theta), rho0 - rho * F.cos(theta))


def utm17(lon: Column, lat: Column) -> Column:
    """Transverse Mercator of zone 17 north (32617) of degrees, by the series in Snyder (1987)."""
    f = 1 / 298.257223563
    e2 = 2 * f - f * f
    ep = e2 / (1 - e2)
    p = F.radians(lat)
    n = EARTH / F.sqrt(1 - e2 * F.sin(p) * F.sin(p))
    t, c, a = F.tan(p) * F.tan(p), ep * F.cos(p) * F.cos(p), F.radians(lon + 81) * F.cos(p)
    arc = EARTH * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * p - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * p)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * p) - 35 * e2**3 / 3072 * F.sin(6 * p)
    )
    a2 = a * a
    x = 500000 + 0.9996 * n * (a + (1 - t + c) * a * a2 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * a * a2 * a2 / 120)
    y = 0.9996 * (arc + n * F.tan(p) * (a2 / 2 + (5 - t + 9 * c + 4 * c * c) * a2 * a2 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * a2 * a2 * a2 / 720))
    return point(x, y)


PROJECTIONS = {3857: mercator, 5072: albers, 32617: utm17}


def project(lon: Column, lat: Column, srid: int) -> Column:
    if srid not in PROJECTIONS:
        raise ValueError(f"projection {srid} is not known; there are {sorted(PROJECTIONS)}")
    return PROJECTIONS[srid](lon, lat)


def reprojected(polygon: Column, srid: int, to: int) -> Column:
    """A polygon's points from one reference system to another: degrees (4326) and PROJECTIONS, Mercator (3857) also back."""
    if srid == to:
        return polygon

    def moved(p: Column) -> Column:
        if srid not in (4326, 3857):
            raise ValueError(f"from {srid} there is no way back to degrees")
        degrees = p if srid == 4326 else from_mercator(p["x"], p["y"])
        return degrees if to == 4326 else project(degrees["x"], degrees["y"], to)

    return F.transform(polygon, lambda ring: F.transform(ring, moved))


# --- predicates and cuts, numpy


def as_text(geometry: Column | str) -> Column:
    """A geometry as Python functions take it: JSON. Arrow hands over nested arrays as objects, slower, and fails on a batch that has only nulls or empty ones."""
    return F.to_json(geometry)


def _array(ring) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2)


def _sides(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sign of the turn from segments a-b to points p, a matrix."""
    d = b - a
    return np.sign(d[:, None, 0] * (p[None, :, 1] - a[:, None, 1]) - d[:, None, 1] * (p[None, :, 0] - a[:, None, 0]))


def edges_meet(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether any segment of one chain of points touches or crosses any of another."""
    a, b, c, d = p[:-1], p[1:], q[:-1], q[1:]
    s1, s2, s3, s4 = _sides(a, b, c), _sides(a, b, d), _sides(c, d, a).T, _sides(c, d, b).T
    boxes = np.ones(s1.shape, bool)
    for k in (0, 1):
        boxes &= (np.minimum(a, b)[:, None, k] <= np.maximum(c, d)[None, :, k]) & (np.maximum(a, b)[:, None, k] >= np.minimum(c, d)[None, :, k])
    return bool((boxes & (s1 * s2 <= 0) & (s3 * s4 <= 0)).any())


def ring_holds(ring: np.ndarray, x: float, y: float) -> bool:
    """Whether a point off the ring's edges is within, by crossings."""
    a, b = ring[:-1], ring[1:]
    over = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
    return bool((over & (x < at)).sum() % 2)


def row_holds(ring: np.ndarray, xs: np.ndarray, y: float) -> np.ndarray:
    """Which of the points (xs, y) off the ring's edges are within, by crossings."""
    a, b = ring[:-1], ring[1:]
    over = (a[:, 1] > y) != (b[:, 1] > y)
    a, b = a[over], b[over]
    at = np.sort(a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1]))
    return (len(at) - np.searchsorted(at, xs, "right")) % 2 == 1


def polygon_holds(rings: list[np.ndarray], x: float, y: float) -> bool:
    return sum(ring_holds(r, x, y) for r in rings) % 2 == 1


def polygons_meet(a: list[np.ndarray], b: list[np.ndarray]) -> bool:
    """Whether two polygons with holes share a point; touching counts."""
    if not a or not b or not len(a[0]) or not len(b[0]):
        return False
    return any(edges_meet(r, s) for r in a for s in b) or polygon_holds(a, *b[0][0]) or polygon_holds(b, *a[0][0])


def _meet(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if p is None or q is None else polygons_meet(list(map(_array, json.loads(p))), list(map(_array, json.loads(q)))) for p, q in zip(a, b, strict=True)], dtype=object)


def intersects(a: Column | str, b: Column | str) -> Column:
    """Whether polygons meet; null with a null one. Apply it behind a test of bounding boxes."""
    return F.pandas_udf(_meet, "boolean")(as_text(a), as_text(b))


def clipped_ring(ring: np.ndarray, xmin: float, ymin: float, xmax: float, ymax: float) -> np.ndarray:
    """The ring within a rectangle, edge by edge; empty if outside."""
    points = ring[:-1]
    for axis, bound, sign in ((0, xmin, 1), (0, xmax, -1), (1, ymin, 1), (1, ymax, -1)):
        if not len(points):
            break
        depth = sign * (points[:, axis] - bound)
        kept = []
        for k in range(len(points)):
            p, d, q, e = points[k - 1], depth[k - 1], points[k], depth[k]
            if (d < 0) != (e < 0):
                kept.append(p + (q - p) * (d / (d - e)))
            if e >= 0:
                kept.append(q)
        points = np.array(kept).reshape(-1, 2)
    return np.vstack([points, points[:1]]) if len(points) >= 3 else np.zeros((0, 2))


def _clip(polygon: pd.Series, box: pd.DataFrame) -> pd.Series:
    out = []
    for p, b in zip(polygon, box.itertuples(index=False), strict=True):
        rings = [clipped_ring(_array(r), *b) for r in (json.loads(p) if p is not None else [])]
        rings = [r for k, r in enumerate(rings) if len(r)] if rings and len(rings[0]) else []
        out.append([[{"x": float(x), "y": float(y)} for x, y in r] for r in rings])
    return pd.Series(out)


def clip(polygon: Column | str, box: Column) -> Column:
    """Polygons within boxes (xmin, ymin, xmax, ymax); an empty array where nothing is left."""
    return F.pandas_udf(_clip, POLYGON)(as_text(polygon), box)


def simplified(line: np.ndarray, tolerance: float) -> np.ndarray:
    """The line by Douglas and Peucker's rule, iteratively."""
    keep = np.zeros(len(line), bool)
    keep[[0, -1]] = True
    stack = [(0, len(line) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d = line[b] - line[a]
        rest = line[a + 1 : b] - line[a]
        norm = np.hypot(*d)
        off = np.abs(d[0] * rest[:, 1] - d[1] * rest[:, 0]) / norm if norm else np.hypot(rest[:, 0], rest[:, 1])
        if off.max() > tolerance:
            k = a + 1 + int(off.argmax())
            keep[k] = True
            stack += [(a, k), (k, b)]
    return line[keep]


def simplify(line: Column, tolerance: float) -> Column:
    def run(lines: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else [{"x": float(x), "y": float(y)} for x, y in (simplified(r, tolerance) if len(r) > 2 else r)] for r in (None if t is None else _array(json.loads(t)) for t in lines)])

    return F.pandas_udf(run, RING)(as_text(line))


class PolygonCells:
    """Cells of a grid that a polygon (as JSON rings) meets; with all_touched false, whose centre it holds."""

    def eval(self, rings: str, size: float, all_touched: bool):
        polygon = [_array(r) for r in json.loads(rings)]
        if not polygon or not len(polygon[0]):
            return
        low, high = np.floor(polygon[0].min(0) / size).astype(int), np.floor(polygon[0].max(0) / size).astype(int)
        xs = np.arange(low[0], high[0] + 1)
        for py in range(low[1], high[1] + 1):  # a row of cells at a time
            held = np.zeros(len(xs), bool)
            for ring in polygon:
                held ^= row_holds(ring, (xs + 0.5) * size, (py + 0.5) * size)
            if all_touched:
                y0, y1 = py * size, (py + 1) * size
                for ring in polygon:
                    for (ax, ay), (bx, by) in zip(ring, ring[1:]):  # noqa: B905
                        if min(ay, by) > y1 or max(ay, by) < y0:
                            continue
                        # the edge's part within the row, and the cells that it meets
                        ends = [ax, bx] if ay == by else [ax + (bx - ax) * min(max((y - ay) / (by - ay), 0.0), 1.0) for y in (y0, y1)]
                        held |= (xs * size <= max(ends)) & ((xs + 1) * size >= min(ends))
            for px in xs[held].tolist():
                yield px, py


def polygon_cells():
    """PolygonCells as a table function, for lateral joins or registration: (rings, size, all_touched) to (px, py)."""
    return F.udtf(PolygonCells, returnType="px bigint, py bigint")


# --- text and bytes


def rings_of_wkt(text: str) -> list[list[list[tuple[float, float]]]]:
    """Polygons of a POLYGON or MULTIPOLYGON text, each a list of rings; any z is dropped."""
    match = re.fullmatch(r"\s*(MULTIPOLYGON|POLYGON)\s*(?:Z\s*)?(\(.*\))\s*", text, re.I | re.S)
    if not match:
        raise ValueError("only POLYGON and MULTIPOLYGON texts are read")
    rings = re.sub(r"([-+0-9.eE]+)\s+([-+0-9.eE]+)(?:\s+[-+0-9.eE]+)?", r"[\1,\2]", match[2]).replace("(", "[").replace(")", "]")
    found = json.loads(rings)
    return [[[tuple(map(float, p)) for p in r] for r in polygon] for polygon in ([found] if match[1].upper() == "POLYGON" else found)]


def wkt(polygon: Column) -> Column:
    def written(ring: Column) -> Column:
        return F.concat(F.lit("("), F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))

    return F.concat(F.lit("POLYGON ("), F.array_join(F.transform(polygon, written), ", "), F.lit(")"))


def wkb_of(rings: list[list[tuple[float, float]]]) -> bytes:
    out = struct.pack("<BII", 1, 3, len(rings))
    for r in rings:
        out += struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", x, y) for x, y in r)
    return out


def rings_of_wkb(raw: bytes) -> list[list[tuple[float, float]]]:
    order = "<" if raw[0] else ">"
    kind, n = struct.unpack_from(order + "II", raw, 1)
    if kind != 3:
        raise ValueError("only polygons in two dimensions are read")
    at, rings = 9, []
    for _ in range(n):
        (m,) = struct.unpack_from(order + "I", raw, at)
        values = struct.unpack_from(f"{order}{2 * m}d", raw, at + 4)
        rings.append(list(zip(values[::2], values[1::2], strict=True)))
        at += 4 + 16 * m
    return rings
