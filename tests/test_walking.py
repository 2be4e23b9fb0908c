"""Buffers, corridors, headlands, attachment to the network, and routes with shortcuts."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrasurvey.functions import kernel
from terrasurvey.operators import routes

AREA = "site long, label string, ring array<array<double>>"


def box(x0, y0, x1, y1):
    return [[float(x), float(y)] for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def turned(ring, degrees, at=(0.0, 0.0)):
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return [[at[0] + c * x - s * y, at[1] + s * x + c * y] for x, y in ring]


@settings(max_examples=50, deadline=None)
@given(st.floats(0, 179), st.floats(0.5, 30), st.floats(0.1, 4))
def test_a_buffered_segment_has_the_area_of_a_capsule(angle, length, radius):
    a = math.radians(angle)
    line = np.array([[3.0, 4.0], [3 + length * math.cos(a), 4 + length * math.sin(a)]])
    polygon = 2 * radius * length + 16 * radius**2 * math.sin(math.pi / 16)
    assert math.isclose(kernel.union_area(kernel.buffered(line, radius)), polygon, rel_tol=1e-6)


def test_buffer_of_a_bent_line_is_where_its_distance_says():
    line = np.array([[0.0, 0.0], [10.0, 0.0], [10.0, 8.0]])
    rings = kernel.buffered(line, 1.5, 32)
    rng = np.random.default_rng(4)
    for x, y in rng.uniform(-3, 13, (300, 2)):
        d = min(math.hypot(x - min(max(x, 0), 10), y), math.hypot(x - 10, y - min(max(y, 0), 8)))
        if abs(d - 1.5) > 0.02:
            assert any(kernel.holds(r, x, y) for r in rings) == (d < 1.5)


def test_corridors_and_insets_of_turned_strips():
    strip = np.array(turned(box(0, 0, 20, 2), 33, (5, 7)))
    long = kernel.corridor(strip, 10.0)
    assert math.isclose(kernel.union_area([long]), 40 * 2, rel_tol=1e-9)
    assert all(kernel.holds(long, *p) for p in strip + (strip.mean(axis=0) - strip) * 1e-6)
    assert math.isclose(kernel.union_area([kernel.inset(kernel.hull(strip), 0.25)]), 19.5 * 1.5, rel_tol=1e-9)
    assert len(kernel.inset(kernel.hull(strip), 1.1)) == 0
    assert kernel.corridor(np.array([[0.0, 0.0], [1.0, 1.0]]), 5) is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8), st.integers(1, 5), st.integers(1, 5)), min_size=1, max_size=5), *[st.integers(0, 24)] * 4)
def test_covers_line_agrees_with_the_length_inside(shapes, px, py, qx, qy):
    rings = [np.array(box(x, y, x + w, y + h), float) for x, y, w, h in shapes]
    cells = np.array([(x0, x1, *t) for x0, x1, pieces in kernel.slabs([rings], lambda on: on[0]) for t in pieces], float)
    cells = cells[:, [0, 1, 2, 3, 4, 5]]
    p, q = np.array([px / 2, py / 2]), np.array([qx / 2, qy / 2])
    whole = math.hypot(*(q - p))
    if whole:
        assert kernel.covers_line(cells, p, q) == (kernel.line_inside(np.array([p, q]), rings) > whole - 1e-6)


@pytest.fixture(scope="module")
def ground(spark):
    # two lanes joined by a passage at one end, and a lane apart
    areas = [(1, "lane", box(0, 0, 2, 30)), (1, "lane", box(4, 0, 6, 30)), (1, "passage", box(0, -2, 6, 0.5)), (1, "lane", box(20, 0, 22, 30))]
    return routes.walkable_cells(spark.createDataFrame(areas, AREA), ["lane", "passage"], ["stone"]).cache()


def test_terminals_are_attached_to_the_cells_they_lie_in(spark, ground):
    ends = spark.createDataFrame([(1, 0, 1.0, -1.0), (1, 5, 1.0, 29.0), (1, 6, 6.0 + 5e-8, 20.0)], "site long, terminal long, x double, y double")
    edges, places = routes.with_terminals(ground, ends)
    at = {r.terminal: (r.x, r.y) for r in places.collect()}
    assert at[0] == (1.0, -1.0) and at[5] == (1.0, 29.0) and 5.99999 < at[6][0] < 6.0
    lengths = {(r.source, r.target): r.metres for r in routes.path_lengths(edges, places).collect()}
    assert lengths[0, 5] >= 30 and lengths[5, 6] > lengths[0, 5]
    gap = spark.createDataFrame([(1, 7, 3.0, 20.0)], ends.schema)
    with pytest.raises(Exception, match="lies in no cell"):
        routes.attached(ground, gap).collect()
    start = spark.createDataFrame([(1, 0, 6.0 + 5e-8, 20.0)], ends.schema)
    assert routes.attached(ground, start).select("a.x").first()[0] == 6.0 + 5e-8  # the start never moves


def test_attachment_does_not_hang_on_the_grid(spark, ground):
    rng = np.random.default_rng(3)
    held = ground.collect()
    places = []
    for k in range(1, 60):
        c = held[rng.integers(len(held))]
        t = rng.choice([0.0, 1.0, rng.random()])  # on the borders of slabs too
        low, high = c.a0 + (c.a1 - c.a0) * t, c.b0 + (c.b1 - c.b0) * t
        places.append((c.site, k, float(c.x0 + (c.x1 - c.x0) * t), float(low + (high - low) * rng.choice([0.0, 1.0, rng.random()]))))
    ends = spark.createDataFrame(places, "site long, terminal long, x double, y double")
    links = [sorted(map(str, routes.attached(ground, ends, grid=grid).collect())) for grid in (0.37, 16.0, 1e6)]
    assert links[0] == links[1] == links[2] and len(links[0]) >= 59


def test_start_snaps_to_the_nearest_node(spark):
    rng = np.random.default_rng(4)
    nodes = [(int(s), float(x), float(y)) for s, x, y in zip(rng.integers(0, 9, 400), rng.integers(-40, 40, 400) / 2, rng.integers(-40, 40, 400) / 2, strict=True)]
    starts = [(s, *(float(v) for v in rng.integers(-12, 12, 2) / 2)) for s in range(9)]
    got = {r.site: (r.connector_m, r.x, r.y) for r in routes.snapped_start(spark.createDataFrame(starts, "site long, x double, y double"), spark.createDataFrame(nodes, "site long, x double, y double"), most=9.0).collect()}
    assert got == {s: min((math.hypot(x - nx, y - ny), nx, ny) for site, nx, ny in nodes if site == s) for s, x, y in starts}
    for far in ([(1, 5.1, 0.0)], [(1, 1e6, 0.0)], [(2, 0.0, 0.0)]):
        with pytest.raises(Exception, match="too far"):
            routes.snapped_start(spark.createDataFrame(far, "site long, x double, y double"), spark.createDataFrame([(1, 0.0, 0.0)], "site long, x double, y double")).collect()


def test_routes_take_shortcuts_on_walkable_ground(spark, ground):
    ends = spark.createDataFrame([(1, 0, 1.0, -1.0), (1, 5, 1.0, 29.0), (1, 6, 5.0, 20.0)], "site long, terminal long, x double, y double")
    edges, places = routes.with_terminals(ground, ends)
    lengths = routes.path_lengths(edges, places)
    stops = routes.tours(lengths)
    paths = routes.expanded(edges, routes.legs_of(stops, places), ground)
    got = {r.leg: r for r in paths.collect()}
    shape = np.array([tuple(r)[2:] for r in ground.collect()])
    shortest = {(r.source, r.target): r.metres for r in lengths.collect()}
    order = [r.terminal for r in stops.orderBy("stop_order").collect()]
    for leg, (a, b) in enumerate(zip(order, [*order[1:], order[0]])):
        line = [(p.x, p.y) for p in got[leg].points]
        assert all(kernel.covers_line(shape, np.array(p), np.array(q)) for p, q in zip(line, line[1:]))
        assert got[leg].metres <= shortest[a, b] + 1e-9
        # no point can be left out
        assert not any(kernel.covers_line(shape, np.array(p), np.array(q)) for p, q in zip(line, line[2:]))
    route = routes.route_lines(paths).first()
    assert route.points[0] == route.points[-1] and math.isclose(route.length_m, sum(r.metres for r in got.values()))
    apart = spark.createDataFrame([(1, 0, (1.0, -1.0), (21.0, 5.0))], "site long, leg long, a struct<x:double,y:double>, b struct<x:double,y:double>")
    with pytest.raises(Exception, match="no path"):
        routes.expanded(edges, apart, ground).collect()


def test_headlands_roads_and_strips_join_lanes(spark):
    block = turned(box(0, 0, 60, 40), 20)
    rows = [(1, turned([[4, y], [56, y]], 20)) for y in range(4, 37, 4)]
    blocks, lines = spark.createDataFrame([(1, block)], "site long, ring array<array<double>>"), spark.createDataFrame(rows, "site long, line array<array<double>>")
    ring = F.col("ring")
    head = routes.headland_areas(blocks, lines)
    assert math.isclose(sum(kernel.union_area([np.array(r.ring)]) for r in head.collect()), 60 * 40 - 51.5 * 31.5, rel_tol=1e-6)
    for bad, message in ((lines.limit(1), "needs two rows"), (lines.limit(1).union(lines.limit(1)), "lie on one line"), (lines.union(spark.createDataFrame([(1, [[0.0, 0.0], [-9.0, 0.0]])], lines.schema)), "leave block")):
        with pytest.raises(Exception, match=message):
            routes.headland_areas(blocks, bad).collect()
    strips = spark.createDataFrame([(1, turned(box(4, y + 1, 56, y + 3), 20)) for y in range(4, 33, 4)], "site long, ring array<array<double>>")
    lanes = strips.select("site", F.lit("lane").alias("label"), ring)
    road = routes.road_areas(spark.createDataFrame([(1, turned([[-3, -20], [-3, 60]], 20))], "site long, line array<array<double>>"), strips.limit(0))

    def parts(cells):
        near = {}
        for r in routes.network(cells).collect():
            near.setdefault(r.a, set()).add(r.b)
            near.setdefault(r.b, set()).add(r.a)
        seen, n = set(), 0
        for k in near:
            if k not in seen:
                n, todo = n + 1, [k]
                while todo:
                    u = todo.pop()
                    if u not in seen:
                        seen.add(u)
                        todo += near[u]
        return n

    assert parts(routes.walkable_cells(lanes, ["lane"], [])) == 8
    assert parts(routes.walkable_cells(lanes.unionByName(head), ["lane", "passage"], [])) == 1
    assert parts(routes.cells_with_access(lanes, road, strips, ["lane", "passage"], [])) == 1
    # too many cells: without the strips the road meets no lane
    assert parts(routes.cells_with_access(lanes, road, strips, ["lane", "passage"], [], most=1)) == 9


def test_clearance_and_study_area(spark):
    areas = [(1, "lane", box(0, 0, 20, 20)), (1, "stone", box(9, 9, 11, 11)), (1, "study", box(0, 0, 20, 15))]
    df = spark.createDataFrame(areas, AREA)
    size = lambda cells: cells.agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("b0") - F.col("a0") + F.col("b1") - F.col("a1")) / 2)).first()[0]
    assert math.isclose(size(routes.walkable_cells(df, ["lane"], ["stone"])), 396, rel_tol=1e-6)
    round_corners = 16 * math.sin(math.pi / 16)
    assert math.isclose(size(routes.walkable_cells(df, ["lane"], ["stone"], 1.0)), 400 - (4 + 8 + round_corners), rel_tol=1e-6)
    assert math.isclose(size(routes.walkable_cells(df, ["lane"], ["stone"], 0.0, "study")), 296, rel_tol=1e-6)


def test_utm_equals_the_meridian_arc_series(spark):
    """Another way to the same coordinates: the meridian arc and the series in powers of the distance from the meridian, good to a millimetre nearby."""
    from math import cos, radians, sin, sqrt, tan

    from pyspark.sql import functions as F

    from terrasurvey.functions import geometry as g

    places = [(27.0 + i / 7, 44.0 + i / 3) for i in range(12)]
    x, y = g.to_utm(F.col("lon"), F.col("lat"))
    rows = spark.createDataFrame(places, "lon double, lat double").select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = g.from_utm(F.col("x"), F.col("y"))
    a, ee = 6378137.0, 2 / 298.257223563 - 1 / 298.257223563**2
    for r in rows.withColumn("lon2", lon).withColumn("lat2", lat).collect():
        assert abs(r.lon2 - r.lon) < 1e-10 and abs(r.lat2 - r.lat) < 1e-10
        phi, ep = radians(r.lat), ee / (1 - ee)
        q, t, c = radians(r.lon - 27) * cos(phi), tan(phi) ** 2, ep * cos(phi) ** 2
        nu = a / sqrt(1 - ee * sin(phi) ** 2)
        arc = a * ((1 - ee / 4 - 3 * ee**2 / 64 - 5 * ee**3 / 256) * phi - (3 * ee / 8 + 3 * ee**2 / 32 + 45 * ee**3 / 1024) * sin(2 * phi) + (15 * ee**2 / 256 + 45 * ee**3 / 1024) * sin(4 * phi) - 35 * ee**3 / 3072 * sin(6 * phi))
        east = 500000 + 0.9996 * nu * (q + (1 - t + c) * q**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * q**5 / 120)
        north = 0.9996 * (arc + nu * tan(phi) * (q**2 / 2 + (5 - t + 9 * c + 4 * c * c) * q**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * q**6 / 720))
        assert abs(r.x - east) < 2e-3 and abs(r.y - north) < 2e-3
