import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasurvey.functions import kernel
from terrasurvey.operators import overlay, slanted

SHAPES = "site int, layer int, shape int, ring array<struct<x:double,y:double>>"


def points(ring):
    return [(float(x), float(y)) for x, y in ring]


def scattered(n, seed, span=60.0, size=6.0):
    rng = np.random.default_rng(seed)
    return [rng.random(2) * span + rng.random((rng.integers(3, 7), 2)) * size for _ in range(n)]


def net(parts):
    return sum(kernel.turned_area(o) + sum(map(kernel.turned_area, holes)) for o, holes in parts)


def inside_share(polygons, rule, n=200_000, span=66.0):
    """The share of random places at which a rule of the parities holds, by ray casting."""
    rng = np.random.default_rng(9)
    x, y = rng.random((2, n)) * span
    flags = []
    for layer in polygons:
        covered = np.zeros(n, bool)
        for ring in layer:
            odd = np.zeros(n, bool)
            for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
                if ay != by:
                    odd ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
            covered |= odd
        flags.append(covered)
    return rule(flags).mean() * span * span


def test_sweep_equals_counting_of_places():
    layers = [scattered(25, 1), scattered(25, 2)]
    for rule, flags in ((lambda on: on[0] and not on[1], lambda f: f[0] & ~f[1]), (lambda on: on[0] and on[1], lambda f: f[0] & f[1]), (any, lambda f: f[0] | f[1])):
        assert math.isclose(kernel.overlay_area(layers, rule), inside_share(layers, flags), rel_tol=0.05, abs_tol=2)


@pytest.mark.parametrize("size", [3.0, 17.0, 500.0])
def test_overlay_by_cells_equals_one_sweep(spark, size):
    layers = [scattered(60, 3), scattered(60, 4)]
    # a long ring over many cells, one with a dent, one on the cells' borders
    layers[0] += [np.array([[0, 0], [60, 2], [60, 5], [1, 3]], float), np.array([[10, 10], [50, 10], [50, 50], [30, 12], [10, 50]], float), np.array([[17, 17], [34, 17], [34, 34], [17, 34]], float)]
    rows = [(1, k, i, points(r)) for k, layer in enumerate(layers) for i, r in enumerate(layer)]
    rows = [(s, k, i + 1000 * k, r) for s, k, i, r in rows]
    wanted = {"cut": lambda on: on[0] and not on[1], "both": lambda on: on[0] and on[1]}
    found = overlay.overlay_areas(spark.createDataFrame(rows, SHAPES), ["site"], wanted, 2, size).collect()
    assert len(found) == 1
    for name, rule in wanted.items():
        assert math.isclose(found[0][name], kernel.overlay_area(layers, rule), rel_tol=1e-9)


def test_cells_of_columns_cover_the_same_ground(spark):
    layers = [scattered(40, 5), scattered(10, 6)]
    rows = [(1, k, i + 1000 * k, points(r)) for k, layer in enumerate(layers) for i, r in enumerate(layer)]
    rule = lambda on: on[0] and not on[1]
    size = F.sum((F.col("x1") - F.col("x0")) * (F.col("b0") - F.col("a0") + F.col("b1") - F.col("a1")) / 2)
    for most in (10, 10_000):
        cells = overlay.passable_cells(spark.createDataFrame(rows, SHAPES), ["site"], rule, 2, most)
        found = cells.agg(size.alias("area"), F.count("*").alias("n"), F.count_distinct("cell").alias("ids")).first()
        assert math.isclose(found.area, kernel.overlay_area(layers, rule), rel_tol=1e-9) and found.n == found.ids


def test_many_edges_take_little_memory():
    """50,000 edges in one place: no table of pairs of edges is made (it would take 20 GB)."""
    import tracemalloc

    rng = np.random.default_rng(7)
    at = rng.random((12_500, 2)) * 4000
    squares = [p + np.array([[0, -3], [3, 0.1], [0, 3], [-3, 0]]) for p in at[:2_000]]
    tracemalloc.start()
    area = kernel.union_area(squares)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 < area <= 2_000 * 18.1 and most < 100e6


def test_bow_tie_gives_two_triangles_and_loops_count_once(spark):
    rows = [
        (1, [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0), (0.0, 0.0)]),
        (2, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)] * 2),
        (3, [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0), (1.0, 0.0)]),
        (4, None),
        (5, [(0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (0.0, 6.0), (0.0, 0.0), (2.0, 4.0), (4.0, 4.0), (4.0, 2.0), (2.0, 2.0), (2.0, 4.0), (0.0, 0.0)]),
        (6, [(0.0, 0.0), (5.0, 0.0), (5.0, 5.0), (5.0, 0.0), (0.0, 5.0)]),
        (7, [(1.0, float("nan")), (0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]),
    ]
    found = {r.id: r.parts for r in overlay.repaired(spark.createDataFrame(rows, "id int, ring array<struct<x:double,y:double>>")).collect()}
    corners = lambda p: {(round(q.x, 6), round(q.y, 6)) for q in p.outer}
    assert {frozenset(corners(p)) for p in found[1]} == {frozenset({(0, 0), (1, 1), (0, 2)}), frozenset({(2, 0), (2, 2), (1, 1)})}
    assert [p.area for p in found[2]] == [16.0] and found[3] == found[4] == []
    assert [(round(p.area, 9), len(p.holes)) for p in found[5]] == [(32.0, 1)]
    assert [round(p.area, 9) for p in found[6]] == [12.5] and [p.area for p in found[7]] == [0.5]
    largest = {r.id: r.ring for r in overlay.largest_repaired(spark.createDataFrame(rows, "id int, ring array<struct<x:double,y:double>>")).collect()}
    assert sorted(largest) == [1, 2, 5, 6, 7] and len(largest[1]) == 4


@pytest.mark.parametrize("seed", range(12))
def test_dissolved_rings_have_the_area_of_the_union(seed):
    polygons = scattered(14, 100 + seed, 14.0)
    if seed % 3 == 0:
        polygons = [np.round(p) for p in polygons]
    parts = kernel.dissolved(polygons, winding=False)
    assert math.isclose(net(parts), kernel.union_area(polygons), rel_tol=1e-5, abs_tol=1e-4)
    for outer, holes in parts:  # sound: dissolving a part by itself changes nothing
        edges = kernel.layered([[outer, *holes]])
        edges[:, 5] = 0  # one shape: its holes are not filled
        again = kernel.dissolved_edges(edges, winding=True)
        assert math.isclose(net(again), kernel.turned_area(outer) + sum(map(kernel.turned_area, holes)), rel_tol=1e-5, abs_tol=1e-4)


@pytest.mark.parametrize("most", [20, 100_000])
def test_a_closed_road_is_one_ring_with_a_hole(spark, most):
    road = kernel.buffered(np.array([[0, 0], [40, 3], [42, 30], [-3, 28], [0, 0]], float), 1.5)
    rows = [(1, 0, i, points(r)) for i, r in enumerate(road)] + [(2, 0, i, points(r)) for i, r in enumerate(scattered(30, 8))]
    found = overlay.dissolved(spark.createDataFrame(rows, SHAPES), ["site"], most).collect()
    (one,) = [r for r in found if r.site == 1]
    assert len(one.holes) == 1 and math.isclose(one.area, kernel.union_area(road), rel_tol=1e-6)
    ring = np.array([[p.x, p.y] for p in one.outer])
    assert len(ring) < 4 * 2 * 17 and (ring[0] == ring[-1]).all()
    others = [r for r in found if r.site == 2]
    assert math.isclose(sum(r.area for r in others), net(kernel.dissolved(scattered(30, 8))), rel_tol=1e-6)


def test_distances_and_common_areas_of_bent_shapes(spark):
    schema = "id int, ring array<struct<x:double,y:double>>"
    bent = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (9.0, 10.0), (9.0, 1.0), (1.0, 1.0), (1.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    left = spark.createDataFrame([(1, bent), (2, square(100.0, 100.0, 40.0))], schema)
    right = spark.createDataFrame([(1, square(4.0, 4.0, 2.0)), (2, square(119.0, 119.0, 2.0)), (3, square(12.0, 3.0, 1.0)), (4, square(8.5, 5.0, 3.0)), (5, square(300.0, 0.0, 1.0))], schema)
    found = {(r.id, r.r_id): round(r.distance, 9) for r in slanted.distances(left, right, 3.5).collect()}
    assert found == {(1, 1): 3.0, (2, 2): 0.0, (1, 3): 2.0, (1, 4): 0.0}
    common = {(r.id, r.r_id): round(r.area, 9) for r in slanted.common_areas(left, right).collect()}
    assert common == {(2, 2): 4.0, (1, 4): 3.0}
