"""Geometry of polylines as column expressions; a polyline is an array<struct<x: double, y: double>>."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY_SEGMENT = "cast(array() as array<struct<x0: double, y0: double, x1: double, y1: double, d: double>>)"


def ordered(position: str = "pos", x: str = "x", y: str = "y") -> Column:
    """Aggregate: the points of a group as a polyline, by position."""
    return F.transform(F.array_sort(F.collect_list(F.struct(position, x, y))), lambda p: F.struct(p[x].alias("x"), p[y].alias("y")))


def segments(line: Column) -> Column:
    """Consecutive point pairs with their length d."""
    starts, ends = F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0)))
    pair = F.zip_with(starts, ends, lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1"), F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("d")))
    return F.when(F.size(line) > 1, pair).otherwise(F.expr(EMPTY_SEGMENT))


def length(line: Column) -> Column:
    return F.aggregate(segments(line), F.lit(0.0), lambda s, e: s + e["d"])


def _along(segs: Column, first: Column, s: Column) -> Column:
    """The point at distance s along segments, their ends beyond; one walk over them."""
    start = F.struct(F.lit(0.0).alias("done"), first["x"].alias("x"), first["y"].alias("y"))

    def step(a: Column, e: Column) -> Column:
        t = F.when(e["d"] > 0, F.least(F.greatest((s - a["done"]) / e["d"], F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
        moved = s > a["done"]
        return F.struct(
            (a["done"] + e["d"]).alias("done"),
            F.when(moved, e["x0"] + t * (e["x1"] - e["x0"])).otherwise(a["x"]).alias("x"),
            F.when(moved, e["y0"] + t * (e["y1"] - e["y0"])).otherwise(a["y"]).alias("y"),
        )

    return F.aggregate(segs, start, step, lambda a: F.struct(a["x"].alias("x"), a["y"].alias("y")))


def point_at(line: Column, s: Column) -> Column:
    """The point at distance s along the line, its ends beyond."""
    return _along(segments(line), line[0], s)


def points_at(line: Column, stations: Column) -> Column:
    """The points at an array of distances along the line; its segments are built once for all of them."""
    return F.transform(F.array(segments(line)), lambda segs: F.transform(stations, lambda s: _along(segs, line[0], s)))[0]


def resample(line: Column, total: Column, n: int) -> Column:
    """n points at equal distances along the line, ends included; total: its length."""
    return points_at(line, F.transform(F.array(*[F.lit(float(k)) for k in range(n)]), lambda k: total * k / (n - 1)))


def project(line: Column, x: Column, y: Column) -> Column:
    """Nearest point of the line: struct of distance and station along it (the first of equal distances)."""
    start = F.struct(F.lit(0.0).alias("done"), F.lit(float("inf")).alias("distance"), F.lit(0.0).alias("station"))

    def step(a: Column, e: Column) -> Column:
        dx, dy = e["x1"] - e["x0"], e["y1"] - e["y0"]
        t = F.when(e["d"] > 0, F.least(F.greatest(((x - e["x0"]) * dx + (y - e["y0"]) * dy) / (e["d"] * e["d"]), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
        far = F.hypot(e["x0"] + t * dx - x, e["y0"] + t * dy - y)
        nearer = far < a["distance"] - 1e-9
        return F.struct((a["done"] + e["d"]).alias("done"), F.when(nearer, far).otherwise(a["distance"]).alias("distance"), F.when(nearer, a["done"] + t * e["d"]).otherwise(a["station"]).alias("station"))

    return F.aggregate(segments(line), start, step, lambda a: F.struct(a["distance"].alias("distance"), a["station"].alias("station")))


def ring_area(ring: Column) -> Column:
    """Signed area of a ring of corners (closed or not): positive counter-clockwise."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v) / 2


def degrees(dx: Column, dy: Column) -> Column:
    """Direction in degrees from 0 to 360, counter-clockwise from x."""
    return F.pmod(F.degrees(F.atan2(dy, dx)) + 360.0, F.lit(360.0))


def direction_bit(dx: Column, dy: Column) -> Column:
    """One of 8 bits for the sector of 45 degrees around each of the eight winds."""
    sector = F.pmod(F.floor((degrees(dx, dy) + 22.5) / 45.0), F.lit(8)).cast("int")
    return F.expr("1") * F.pow(F.lit(2), sector).cast("int")


def turn_degrees(before: Column, after: Column) -> Column:
    """Change of direction in degrees, from -180 (excluded) to 180."""
    turned = F.pmod(after - before + 540.0, F.lit(360.0)) - 180.0
    return F.when(turned == -180.0, 180.0).otherwise(turned)


def offset(line: Column, d: float | Column) -> Column:
    """The parallel line at distance d to the left; corners move along the mean of their segments' normals.

    A point that repeats the one before it is left out, as a step without length has no normal."""
    whole = line
    line = F.filter(whole, lambda p, i: (i == 0) | (p["x"] != F.get(whole, i - 1)["x"]) | (p["y"] != F.get(whole, i - 1)["y"]))
    segs = segments(line)

    def normal(e: Column) -> Column:
        return F.struct((-(e["y1"] - e["y0"]) / e["d"]).alias("x"), ((e["x1"] - e["x0"]) / e["d"]).alias("y"))

    normals = F.transform(F.filter(segs, lambda e: e["d"] > 0), normal)
    before = F.concat(F.slice(normals, 1, 1), normals)
    after = F.concat(normals, F.slice(F.reverse(normals), 1, 1))

    def moved(p: Column, n: Column) -> Column:
        return F.struct((p["x"] + d * n["x"]).alias("x"), (p["y"] + d * n["y"]).alias("y"))

    def mean(a: Column, b: Column) -> Column:
        x, y = a["x"] + b["x"], a["y"] + b["y"]
        size = F.hypot(x, y)
        return F.struct(F.when(size > 1e-9, x / size).otherwise(a["x"]).alias("x"), F.when(size > 1e-9, y / size).otherwise(a["y"]).alias("y"))

    return F.zip_with(line, F.zip_with(before, after, mean), moved)


def arc(x: Column, y: Column, heading: Column, curvature: Column, s: Column) -> Column:
    """Position on an arc after s; a line where the curvature is nearly 0."""
    straight = F.struct((x + s * F.cos(heading)).alias("x"), (y + s * F.sin(heading)).alias("y"))
    turned = heading + curvature * s
    curved = F.struct((x + (F.sin(turned) - F.sin(heading)) / curvature).alias("x"), (y - (F.cos(turned) - F.cos(heading)) / curvature).alias("y"))
    return F.when(F.abs(curvature) < 1e-12, straight).otherwise(curved)


def cubic(s: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    return a + s * (b + s * (c + s * d))


def bezier(points: list[tuple[Column, Column]], t: Column) -> tuple[Column, Column]:
    """A Bezier curve by Bernstein polynomials."""
    n = len(points) - 1
    weights = [math.comb(n, k) * F.pow(t, F.lit(k)) * F.pow(1 - t, F.lit(n - k)) for k in range(n + 1)]
    return sum((w * p[0] for w, p in zip(weights, points, strict=True)), F.lit(0.0)), sum((w * p[1] for w, p in zip(weights, points, strict=True)), F.lit(0.0))


#: Metres a degree, two fixed pairs: plain (both axes) and the one used for round trips (x, y).
METRES_A_DEGREE, ROUND_TRIP_METRES = (111320.0, 111320.0), (111320.0, 110540.0)


def equirectangular(lon: Column, lat: Column, lon0: Column, lat0: Column, scale: tuple[float, float] = METRES_A_DEGREE) -> tuple[Column, Column]:
    return (lon - lon0) * F.cos(F.radians(lat0)) * scale[0], (lat - lat0) * scale[1]


def utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing by a third-order Krueger series (WGS 84); the southern false northing is added below 0 degrees."""
    f, a = 1 / 298.257223563, 6378137.0
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    k = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - k * F.atanh(k * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, v in enumerate(alpha, 1):
        east = east + v * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + v * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000.0 + 0.9996 * radius * east, F.when(lat < 0, 10000000.0).otherwise(0.0) + 0.9996 * radius * north


def normal_hit(line: Column, x: Column, y: Column, nx: Column, ny: Column) -> Column:
    """Signed distance along a normal from (x, y) to where it meets the line, the nearest of several (of equal ones the right); null if none."""

    def station(e: Column) -> Column:
        # along the direction that the normal stands on
        a, b = (e["x0"] - x) * ny - (e["y0"] - y) * nx, (e["x1"] - x) * ny - (e["y1"] - y) * nx
        u = F.when(a != b, a / (a - b))
        met = u.between(0, 1)
        return F.when(met, (e["x0"] - x + u * (e["x1"] - e["x0"])) * nx + (e["y0"] - y + u * (e["y1"] - e["y0"])) * ny)

    hits = F.filter(F.transform(segments(line), station), lambda t: t.isNotNull())
    nearest = F.array_min(F.transform(hits, lambda t: F.struct(F.round(F.abs(t), 6).alias("far"), t.alias("t"))))
    return nearest["t"]


def local_hit(line: Column, x: Column, y: Column, nx: Column, ny: Column) -> Column:
    """normal_hit, but null where it lies on a remote part: over 4 times the line's own distance plus 0.5 away, and over 2."""
    t = normal_hit(line, x, y, nx, ny)
    return F.when(F.abs(t) <= F.greatest(F.lit(2.0), 4.0 * project(line, x, y)["distance"] + 0.5), t)


def section_width(left: Column, right: Column, x: Column, y: Column, nx: Column, ny: Column) -> Column:
    """Distance between where a normal meets two boundaries; null where it misses one."""
    return F.abs(normal_hit(left, x, y, nx, ny) - normal_hit(right, x, y, nx, ny))


def geographic_distance(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """Metres between two near places, by the scale at their mean latitude."""
    middle = F.radians((lat0 + lat1) / 2)
    return F.hypot((lon0 - lon1) * ROUND_TRIP_METRES[0] * F.cos(middle), (lat0 - lat1) * ROUND_TRIP_METRES[1])
