"""Plane and sphere geometry on columns; polygons are arrays of struct<x,y>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helioscope.functions.special import haversine  # noqa: F401


def distance(x1, y1, x2, y2) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    t = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.pmod(t + 360, F.lit(360.0))


def destination(lat, lon, bearing_, km, radius: float = 6371.0) -> tuple[Column, Column]:
    a, d, b = F.radians(lat), km / radius, F.radians(bearing_)
    lat2 = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(b))
    lon2 = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(lat2))
    return F.degrees(lat2), F.pmod(F.degrees(lon2) + 540, F.lit(360.0)) - 180


def cross(ox, oy, ax, ay, bx, by) -> Column:
    return (ax - ox) * (by - oy) - (ay - oy) * (bx - ox)


def _turned(p: Column) -> Column:
    return F.concat(F.slice(p, F.lit(2), F.size(p) - 1), F.slice(p, 1, 1))


def signed_area(p: Column) -> Column:
    """Positive if the corners go counter-clockwise."""
    parts = F.zip_with(p, _turned(p), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v) / 2


def area(p: Column) -> Column:
    return F.abs(signed_area(p))


def perimeter(p: Column) -> Column:
    parts = F.zip_with(p, _turned(p), lambda a, b: distance(a["x"], a["y"], b["x"], b["y"]))
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)


def centroid(p: Column) -> Column:
    """struct<x,y>; null for an area of zero."""
    def along(c: str) -> Column:
        parts = F.zip_with(p, _turned(p), lambda a, b: (a[c] + b[c]) * (a["x"] * b["y"] - b["x"] * a["y"]))
        return F.try_divide(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v), 6 * signed_area(p))

    return F.struct(along("x").alias("x"), along("y").alias("y"))


def contains(p: Column, x: Column, y: Column) -> Column:
    """Ray casting: whether a point is inside; points on the border count by half-open edges."""
    def hit(a: Column, b: Column) -> Column:
        spans = (a["y"] > y) != (b["y"] > y)
        return F.when(spans & (x < a["x"] + F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"])), 1).otherwise(0)

    return F.aggregate(F.zip_with(p, _turned(p), hit), F.lit(0), lambda s, v: s + v) % 2 == 1


def triangle_area_3d(a: Column, b: Column, c: Column) -> Column:
    """Of three arrays of coordinates."""
    u, v = ([q[i] - a[i] for i in range(3)] for q in (b, c))
    w = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    return F.sqrt(w[0] * w[0] + w[1] * w[1] + w[2] * w[2]) / 2


def circumradius(a: Column, b: Column, c: Column) -> Column:
    """By the lengths of the sides."""
    s = (a + b + c) / 2
    return a * b * c / (4 * F.sqrt(s * (s - a) * (s - b) * (s - c)))


def inradius(a: Column, b: Column, c: Column) -> Column:
    s = (a + b + c) / 2
    return F.sqrt(s * (s - a) * (s - b) * (s - c)) / s


def triangle_quality(ax, ay, bx, by, cx, cy) -> Column:
    """4 sqrt(3) times the area over the sum of squared sides: one for equal sides, zero for a line."""
    area = F.abs(cross(ax, ay, bx, by, cx, cy)) / 2
    sides = sum((p - q) * (p - q) + (r - s) * (r - s) for p, r, q, s in ((ax, ay, bx, by), (bx, by, cx, cy), (cx, cy, ax, ay)))
    return F.coalesce(F.try_divide(4 * 3**0.5 * area, sides), F.lit(0.0))


def cross3(a: Column, b: Column) -> Column:
    """Cross product of arrays of three."""
    x, y = [F.get(a, F.lit(i)) for i in range(3)], [F.get(b, F.lit(i)) for i in range(3)]
    return F.array(x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0])


def dot3(a: Column, b: Column) -> Column:
    return sum((F.get(a, F.lit(i)) * F.get(b, F.lit(i)) for i in range(1, 3)), F.get(a, F.lit(0)) * F.get(b, F.lit(0)))


def tetrahedron_volume(a: Column, b: Column, c: Column, d: Column) -> Column:
    minus = lambda p: F.zip_with(p, d, lambda x, y: x - y)
    return F.abs(dot3(minus(a), cross3(minus(b), minus(c)))) / 6


def polar_angle(x, y) -> Column:
    """Angle from the x axis, 0 to 2 pi."""
    return F.pmod(F.atan2(y, x), F.lit(6.283185307179586))


def hulls(points, by: list[str], x: str = "x", y: str = "y"):
    """(by, hull, area, diameter) of the points of each group: tasks keep the corners of their own points, and a group's corners are merged in one row."""
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    def corners(p: np.ndarray) -> np.ndarray:
        p = np.unique(p, axis=0)
        if len(p) < 3:
            return p

        def chain(q: np.ndarray) -> list:
            out: list = []
            for r in q:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (r[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (r[0] - out[-2][0]):
                    out.pop()
                out.append(r)
            return out

        low, high = chain(p), chain(p[::-1])
        return np.array(low[:-1] + high[:-1])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.select(*by).schema)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, g in pdf.dropna(subset=[x, y]).groupby(by):
                c = corners(g[[x, y]].to_numpy(float))
                yield pd.DataFrame({**dict(zip(by, ([k] * len(c) for k in key))), "x": c[:, 0], "y": c[:, 1]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        c = corners(pdf[["x", "y"]].to_numpy(float))
        u, v = c[:, 0], c[:, 1]
        area = abs(float((u * np.roll(v, -1) - v * np.roll(u, -1)).sum()) / 2) if len(c) > 2 else 0.0
        far = max((float(np.hypot(c[i:, 0] - c[i, 0], c[i:, 1] - c[i, 1]).max()) for i in range(len(c))), default=0.0)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in by}, "corners": [len(c)], "area": [area], "diameter": [far]})

    parts = points.select(*by, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).mapInPandas(part, f"{kind}, x double, y double")
    return parts.groupBy(*by).applyInPandas(whole, f"{kind}, corners bigint, area double, diameter double")
