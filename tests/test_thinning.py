import math
import random

import numpy as np
import pandas as pd
import pytest

from terrasurvey.operators import lines, thinning

POINTS = "id int, points array<struct<x:double,y:double>>"


def bars(x0, x1, y0, y1):
    return {(x, y) for x in range(x0, x1) for y in range(y0, y1)}


def table(spark, pixels, tile=1):
    return spark.createDataFrame([(tile, x, y) for x, y in sorted(pixels)], "tile int, px long, py long")


def whole(pixels):
    """Thinning of one image that holds everything."""
    x, y = np.array(sorted(pixels)).T
    image = np.zeros((y.max() + 2, x.max() + 2), bool)
    image[y, x] = True
    while True:
        before = image
        for second in (False, True):
            image = image & ~thinning.peeled(image, second)
        if np.array_equal(before, image):
            return {(int(a), int(b)) for b, a in zip(*np.nonzero(image), strict=True)}


@pytest.mark.parametrize(("cell", "halo"), [(256, 64), (20, 4), (17, 2)])
def test_thinning_by_cells_equals_thinning_of_the_whole(spark, cell, halo):
    rng = random.Random(1)
    blobs = bars(3, 80, 5, 12) | bars(30, 37, 5, 60) | bars(2, 60, 50, 55) | {(rng.randrange(90), rng.randrange(70)) for _ in range(300)}
    found = thinning.thinned(table(spark, blobs), ["tile"], cell, halo).collect()
    assert {(r.px, r.py) for r in found} == whole(blobs) and len(found) == len(whole(blobs))


def test_two_rows_joined_by_a_bridge_are_two_lines(spark):
    pixels = bars(0, 401, 10, 15) | bars(0, 401, 70, 75) | bars(199, 202, 14, 71)
    found = sorted(thinning.split_rows(table(spark, pixels), "tile").collect(), key=lambda r: r.y0)
    assert [round(r.y0) for r in found] == [12, 72] and all(abs(r.y1 - r.y0) < 1 for r in found)
    assert all(r.x0 < 5 and r.x1 > 396 for r in found)


def test_rows_of_two_directions_and_small_pieces(spark):
    slanted = {(x, 300 + round(x * 0.7) + d) for x in range(200) for d in range(4)}
    pixels = bars(0, 200, 10, 13) | slanted | bars(400, 410, 400, 410) | bars(0, 15, 100, 103)
    found = thinning.split_rows(table(spark, pixels), "tile").collect()
    angles = sorted(round(math.degrees(math.atan2(r.y1 - r.y0, r.x1 - r.x0)) % 180) for r in found)
    assert len(found) == 2 and angles[0] in (0, 180) and abs(angles[1] - 35) <= 1 and {r.direction for r in found} == {0, 1}


def test_pieces_outside_keep_what_is_walked_twice(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    walked = spark.createDataFrame([(1, [(0.0, 5.0), (10.0, 5.0), (0.0, 5.0), (0.0, 5.0)]), (2, [(2.0, 0.0), (2.0, 10.0)]), (3, [(3.0, 3.0), (5.0, 5.0)])], POINTS)
    areas = spark.createDataFrame([(square(2.0, 2.0, 3.0),), (square(5.0, 2.0, 3.0),)], "ring array<struct<x:double,y:double>>")
    found = sorted((r.id, r.segment, round(r["from"], 6), round(r["to"], 6), round(r.length_m, 6)) for r in lines.pieces_outside(walked, areas, "id").collect())
    assert [f for f in found if f[0] == 1] == [(1, 0, 0.0, 0.2, 2.0), (1, 0, 0.8, 1.0, 2.0), (1, 1, 0.0, 0.2, 2.0), (1, 1, 0.8, 1.0, 2.0)]
    assert [f for f in found if f[0] == 2] == [(2, 0, 0.0, 0.2, 2.0), (2, 0, 0.5, 1.0, 5.0)] and not [f for f in found if f[0] == 3]


def test_brush_splits_a_bent_line(spark):
    bent = spark.createDataFrame([(1, [(0.0, 0.0), (20.0, 0.0), (20.0, 20.0)]), (2, [(0.0, 50.0), (9.0, 50.0)]), (3, [(19.5, 0.5), (20.0, 0.0)])], POINTS)
    discs = spark.createDataFrame([(20.0, 0.0), (20.0, 12.0)], "x double, y double")
    found = lines.brushed(bent, discs, "id", 3.0).collect()
    parts = sorted(((r.id, (r.points[0].x, r.points[0].y), (r.points[-1].x, r.points[-1].y)) for r in found))
    assert parts == [(1, (0.0, 0.0), (16.0, 0.0)), (1, (20.0, 4.0), (20.0, 8.0)), (1, (20.0, 16.0), (20.0, 20.0)), (2, (0.0, 50.0), (9.0, 50.0))]
    assert pd.Series([len(r.points) for r in found]).min() >= 2


@pytest.mark.parametrize("whole_bounds", [0, 1 << 22])
def test_a_tile_thinned_in_one_task_equals_thinning_of_the_whole(monkeypatch, whole_bounds):
    rng = random.Random(4)
    monkeypatch.setattr(thinning, "WHOLE", whole_bounds)
    blobs = bars(3, 80, 5, 12) | bars(30, 37, 5, 60) | bars(2, 60, 50, 55) | {(rng.randrange(90), rng.randrange(70)) for _ in range(300)}
    x, y = np.array(sorted(blobs)).T
    for cell, halo in ((256, 64), (20, 4), (17, 2)):
        px, py = thinning.middle_pixels(x - 40, y - 30, cell, halo)
        assert {(int(a) + 40, int(b) + 30) for a, b in zip(px, py, strict=True)} == whole(blobs) and len(px) == len(whole(blobs))


def test_pieces_are_joined_over_eight_neighbours():
    x, y = np.array([(0, 0), (1, 1), (2, 0), (5, 0), (5, 1), (0, 5), (9, 1), (0, 2)]).T
    piece = thinning.joined_pixels(x, y)
    assert [np.flatnonzero(piece == p).tolist() for p in dict.fromkeys(piece.tolist())] == [[0, 1, 2, 7], [3, 4], [5], [6]]


def test_rows_of_many_tiles_move_once(spark):
    pixels = bars(0, 301, 10, 13)
    rows = spark.createDataFrame([(x, y) for x, y in sorted(pixels)], "px long, py long").crossJoin(spark.range(150).withColumnRenamed("id", "tile"))
    found = thinning.split_rows(rows, "tile")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "FlatMapGroups" not in plan
    assert sorted((r.tile, r.y0, r.y1) for r in found.collect()) == [(i, 11.5, 11.5) for i in range(150)]
