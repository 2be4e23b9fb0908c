"""Geometry as Spark columns: rings and lines are arrays of struct<x, y>, boxes four columns. Built-in functions only."""

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"


def point(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_ring(x, y, w, h) -> Column:
    """A closed ring of a box: top left, top right, bottom right, bottom left, and the first again."""
    return F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h), point(x, y))


def pairs(points: Column) -> Column:
    """Consecutive points of a line, as structs a, b."""
    n = F.size(points)
    return F.zip_with(F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def length(points: Column) -> Column:
    return F.aggregate(pairs(points), F.lit(0.0), lambda s, p: s + F.hypot(p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"]))


def signed_area(ring: Column) -> Column:
    return F.aggregate(pairs(ring), F.lit(0.0), lambda s, p: s + (p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"])) / 2


def area(ring: Column) -> Column:
    """The area of a closed ring."""
    return F.abs(signed_area(ring))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a closed ring holds a point, by the parity of half-open crossings."""
    a, b = (lambda p: p["a"]), (lambda p: p["b"])
    crosses = lambda p: ((a(p)["y"] > y) != (b(p)["y"] > y)) & (x < (b(p)["x"] - a(p)["x"]) * (y - a(p)["y"]) / F.nullif(b(p)["y"] - a(p)["y"], F.lit(0.0)) + a(p)["x"])
    return F.size(F.filter(pairs(ring), lambda p: F.coalesce(crosses(p), F.lit(False)))) % 2 == 1


def affine(points: Column, a, b, c, d, e, f) -> Column:
    """x' = a x + b y + c, y' = d x + e y + f."""
    return F.transform(points, lambda p: F.struct((a * p["x"] + b * p["y"] + c).alias("x"), (d * p["x"] + e * p["y"] + f).alias("y")))


def inverse_affine(points: Column, a, b, c, d, e, f) -> Column:
    det = a * e - b * d
    return F.transform(points, lambda p: F.struct((((p["x"] - c) * e - (p["y"] - f) * b) / det).alias("x"), (((p["y"] - f) * a - (p["x"] - c) * d) / det).alias("y")))


def open_ring(ring: Column) -> Column:
    """A ring without its closing point, if it repeats the first."""
    n = F.size(ring)
    return F.when((n > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1)), F.slice(ring, 1, n - 1)).otherwise(ring)


def ring_centre(ring: Column) -> Column:
    """The mean of a ring's vertices, without the closing one: not the centroid of its area."""
    points = open_ring(ring)
    total = lambda k: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[k])
    return F.struct((total("x") / F.size(points)).alias("x"), (total("y") / F.size(points)).alias("y"))


def bounds(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def segment_distance(x, y, ax, ay, bx, by) -> Column:
    """The distance of a point to a segment."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / F.nullif(n, F.lit(0.0))))).otherwise(F.lit(0.0))
    return F.hypot(x - (ax + t * dx), y - (ay + t * dy))


def rotate(x, y, cx, cy, cosine, sine) -> tuple[Column, Column]:
    """A point in the frame that is turned about (cx, cy): along, offset."""
    dx, dy = x - cx, y - cy
    return dx * cosine + dy * sine, dy * cosine - dx * sine


def strip_width(perimeter, area_m2) -> Column:
    """The shorter side of the rectangle with this perimeter and area."""
    return (perimeter - F.sqrt(F.greatest(F.lit(0.0), perimeter * perimeter - 16 * area_m2))) / 4


def boxes_overlap(a: tuple, b: tuple, strict: bool = False) -> Column:
    """Whether boxes (x0, y0, x1, y1) overlap; touching counts unless strict."""
    if strict:
        return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def common_box_area(a: tuple, b: tuple) -> Column:
    """The area that boxes (x0, y0, x1, y1) which overlap have in common: a box clipped to a box is a box, so no ring is built."""
    return (F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * (F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def clip_box(ring: Column, axis: str, limit, keep_below: bool) -> Column:
    """An open ring's part on one side of a line parallel to an axis (Sutherland-Hodgman)."""
    other = "y" if axis == "x" else "x"
    inside = lambda p: (p[axis] <= limit) if keep_below else (p[axis] >= limit)
    n = F.size(ring)
    rotated = F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))
    edges = F.zip_with(ring, rotated, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def cross(e):
        t = (limit - e["a"][axis]) / F.nullif(e["b"][axis] - e["a"][axis], F.lit(0.0))
        v = e["a"][other] + t * (e["b"][other] - e["a"][other])
        x, y = (F.lit(limit).cast("double"), v) if axis == "x" else (v, F.lit(limit).cast("double"))
        return F.struct(x.alias("x"), y.alias("y"))

    piece = lambda e: F.when(inside(e["a"]) & inside(e["b"]), F.array(e["b"])).when(inside(e["a"]), F.array(cross(e))).when(inside(e["b"]), F.array(cross(e), e["b"])).otherwise(F.array().cast(f"array<{POINT}>"))
    return F.flatten(F.transform(edges, piece))


def close_ring(ring: Column) -> Column:
    return F.concat(ring, F.slice(ring, 1, 1))


def cut_line(points: Column, at: Column) -> Column:
    """A line cut at its at-th point (from 1): two lines that share it."""
    return F.struct(F.slice(points, 1, at).alias("head"), F.slice(points, at, F.size(points) - at + 1).alias("tail"))


# The ellipsoid WGS 84 and the constants of UTM zone 35 north.
AXIS, FLATTENING, SCALE, FALSE_EAST, MERIDIAN = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 27.0


def _series():
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    return n, radius, alpha, beta, delta


def to_utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to metres in UTM zone 35 north, by the Krueger series."""
    n, radius, alpha, _, _ = _series()
    k = 2 * n**0.5 / (1 + n)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - k * F.atanh(k * s))
    d = F.radians(lon - MERIDIAN)
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east = eta + sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(alpha, 1)), F.lit(0.0))
    north = xi + sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(alpha, 1)), F.lit(0.0))
    return FALSE_EAST + SCALE * radius * east, SCALE * radius * north


def from_utm(x: Column, y: Column) -> tuple[Column, Column]:
    """Metres in UTM zone 35 north to degrees (lon, lat)."""
    _, radius, _, beta, delta = _series()
    xi0, eta0 = y / (SCALE * radius), (x - FALSE_EAST) / (SCALE * radius)
    xi = xi0 - sum((b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0) for j, b in enumerate(beta, 1)), F.lit(0.0))
    eta = eta0 - sum((b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0) for j, b in enumerate(beta, 1)), F.lit(0.0))
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi + sum((d * F.sin(2 * j * chi) for j, d in enumerate(delta, 1)), F.lit(0.0))
    return F.lit(MERIDIAN) + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(lat)


def mercator_bounds(z, x, y) -> Column:
    """Bounds in metres of a web map tile."""
    edge = 20037508.342789244
    size = 2 * edge / F.pow(F.lit(2.0), z)
    return F.struct((x * size - edge).alias("x0"), (edge - (y + 1) * size).alias("y0"), ((x + 1) * size - edge).alias("x1"), (edge - y * size).alias("y1"))


def mercator_lon_lat(x, y) -> tuple[Column, Column]:
    edge = 20037508.342789244
    return x / edge * 180, F.degrees(2 * F.atan(F.exp(y / edge * 3.141592653589793)) - 3.141592653589793 / 2)
