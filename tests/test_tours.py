import math
import time

import numpy as np
import pytest

from terrasurvey.operators import routes

AREA = "site long, label string, ring array<array<double>>"


def between(n, seed):
    p = np.random.default_rng(seed).random((n, 2)) * 100
    return np.hypot(*(p[:, None] - p[None, :]).transpose(2, 0, 1))


@pytest.mark.parametrize("n", [4, 5, 6, 8])
def test_small_tours_are_the_shortest(n):
    import itertools

    for seed in range(6):
        d = between(n, seed)
        order, size, base = routes.tour(d)
        best = min(routes.length_of([0, *rest], d) for rest in itertools.permutations(range(1, n)))
        assert math.isclose(size, best, rel_tol=1e-9) and sorted(order) == list(range(n)) and order[0] == 0 and size <= base + 1e-9


def test_guided_search_shortens_local_optima_in_time():
    gained = 0
    for seed in range(3):
        d = between(201, seed)
        began = time.process_time()
        order, size, base = routes.tour(d)
        took = time.process_time() - began
        local = routes.length_of(routes.settled(np.arange(201), d).tolist(), d)
        assert size <= base and math.isclose(size, routes.length_of(order, d)) and took < 10
        gained += size < local
    assert gained == 3


def test_settled_moves_keep_all_stops():
    for seed in range(20):
        n = 4 + seed
        order = routes.settled(np.arange(n), between(n, seed))
        assert sorted(order.tolist()) == list(range(n)) and order[0] == 0


def test_a_plan_along_one_lane_has_a_known_length(spark):
    """A straight lane: out to the farthest target and back; targets on the way are met in order of distance, also those beside the line by less than 2 m."""
    lane = [[0.0, 0.0], [60.0, 0.0], [60.0, 2.0], [0.0, 2.0]]
    areas = spark.createDataFrame([(1, "lane", lane), (2, "lane", lane)], AREA)
    ends = [(1, 0, 1.0, 1.0), (1, 1, 50.0, 1.0), (1, 2, 20.0, 1.0), (1, 3, 30.0, 1.5), (2, 0, 1.0, 1.0)]
    ground = routes.walkable_cells(areas, ["lane"], [])
    found = routes.planned(ground, spark.createDataFrame(ends, "site long, terminal long, x double, y double"), areas.select("site", "ring")).collect()
    (one,) = [r for r in found if r.site == 1]
    assert 98 <= one.length_m <= 98.1 and one.outside_m <= 1e-6
    assert [s.terminal for s in one.stops] == [2, 3, 1]
    assert abs(one.stops[0].distance_m - 17) < 0.1 and abs(one.stops[2].distance_m - 47) < 0.1
    with pytest.raises(Exception, match="leaves permitted ground"):
        short = spark.createDataFrame([(1, "lane", [[0.0, 0.0], [30.0, 0.0], [30.0, 2.0], [0.0, 2.0]])], AREA)
        routes.planned(ground, spark.createDataFrame(ends[:4], "site long, terminal long, x double, y double"), short.select("site", "ring")).collect()
