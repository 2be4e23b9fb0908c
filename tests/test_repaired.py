"""Rings repaired many at once give what the sweep of each by itself gives."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasurvey.functions import geometry as g
from terrasurvey.functions import kernel
from terrasurvey.operators import overlay


@pytest.mark.parametrize("n", [3, 4, 5, 6, 9])
def test_plain_parts_equal_the_sweep(n):
    rng = np.random.default_rng(n)
    rings = np.concatenate((rng.integers(0, 9, (120, n, 2)).astype(float), rng.integers(-50, 50, (200, n, 2)) / 8))
    turns = np.arange(n) * 2 * np.pi / n  # rings around a middle: simple ones, and with two corners exchanged
    rings = np.concatenate((rings, rng.uniform(1, 4, (60, n, 1)) * np.stack((np.cos(turns), np.sin(turns)), 1)))
    rings[-30:, [0, 1]] = rings[-30:, [1, 0]]
    rings = np.round(rings * 8) / 8  # the sweep fails on some edges that are all but vertical
    seen = 0
    for which, outer, areas in kernel.plain_parts(rings):
        for row, i in enumerate(which):
            want = kernel.dissolved([rings[i]])
            assert len(want) == len(outer) and not any(holes for _, holes in want)
            by_place = lambda rings: sorted(rings, key=lambda r: np.round(r, 6).tolist())
            for got, o in zip(by_place([r[row] for r in outer]), by_place([o for o, _ in want]), strict=True):
                assert np.allclose(got, o, atol=1e-6)
            assert np.allclose(areas[row], sorted(kernel.turned_area(o) for o, _ in want), atol=1e-6)
            seen += 1
    assert seen > 60


def test_loop_within_a_loop_is_one_part():
    ring = np.array([[0, 0], [9, 0], [9, 9], [2, 9], [2, 3], [6, 3], [6, 6], [0, 6]], float)
    ((which, outer, areas),) = kernel.plain_parts(ring[None])
    ((want, holes),) = kernel.dissolved([ring])
    assert which.tolist() == [0] and len(outer) == 1 and np.array_equal(outer[0][0], want) and not holes
    assert np.allclose(areas, kernel.turned_area(want))


def test_touching_and_twice_crossed_rings_are_left_to_the_sweep():
    touching = np.array([[0, 0], [4, 0], [2, 3], [2, 0], [1, 4]], float)
    twice = np.array([[0, 0], [2, 2], [4, 0], [4, 2], [2, 0], [0, 2]], float)
    assert kernel.plain_parts(touching[None]) == kernel.plain_parts(twice[None]) == []


def test_many_bow_ties_take_little_time(spark):
    x, w, h = (F.col("id") % 60).cast("double"), (F.col("id") % 9 + 1).cast("double"), (F.col("id") % 11 + 1).cast("double")
    bow = F.array(g.point(x, x), g.point(x + w, x + h), g.point(x + w, x), g.point(x, x + h), g.point(x, x))
    rings = spark.range(100_000).select("id", bow.alias("ring"), (w * h / 4).alias("half"))
    began = time.time()
    found = overlay.repaired(rings).where("size(parts) = 2 and abs(parts[0].area - half) < 1e-6 and abs(parts[1].area - half) < 1e-6").count()
    assert found == 100_000 and time.time() - began < 25
