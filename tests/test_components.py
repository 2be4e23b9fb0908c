import random

import pytest
from pyspark.sql import functions as F

from terrasurvey.operators import graph, masks
from terrasurvey.sources.shared import forget, stored


def roots(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def links(spark, pairs):
    return spark.createDataFrame(pairs, "a long, b long").repartition(4)


@pytest.mark.parametrize("kind", ["random", "chain", "star", "none", "loops"])
def test_components_equal_union_find(spark, kind):
    rng = random.Random(2)
    pairs = {
        "random": [(rng.randrange(600), rng.randrange(600)) for _ in range(450)],
        "chain": [(i * 7919 % 3000, (i + 1) * 7919 % 3000) for i in range(2999)],
        "star": [(5000, i) for i in range(2000)] + [(-7, -8)],
        "none": [],
        "loops": [(3, 3), (4, 4), (4, 5)],
    }[kind]
    assert {r.node: r.root for r in graph.components(links(spark, pairs)).collect()} == roots(pairs)


def test_rounds_follow_the_logarithm_of_a_chain(spark, monkeypatch):
    """Plans do not grow with the rounds, and a chain whose links are dealt at random settles in few of them."""
    rounds, settled = [], graph.is_settled
    monkeypatch.setattr(graph, "is_settled", lambda ends: (rounds.append(len(ends._jdf.queryExecution().optimizedPlan().toString())), settled(ends))[1])
    n = 50_000
    chain = spark.range(n - 1).select((F.col("id") * 7919 % n).alias("a"), ((F.col("id") + 1) * 7919 % n).alias("b")).repartition(8)
    found = graph.components(chain)
    assert found.where("root <> 0").count() == 0 and found.count() == n
    assert len(rounds) < 25 and max(rounds) < 2 * min(rounds)


def test_forgotten_tables_are_gone(spark):
    table = stored(spark.range(3).toDF("n"))
    folder = table.inputFiles()[0].rsplit("/", 1)[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert files.exists(path)
    forget(table)
    assert not files.exists(path)


def test_regions_of_pixels(spark):
    """Runs of pixels link over sides and corners, also across the cells in which they meet."""
    rng = random.Random(3)
    pixels = {(t, x, y) for t in (1, 2) for x in range(200) for y in range(12) if rng.random() < 0.42} | {(3, x, y) for y in (0, 2) for x in range(300)} | {(3, 299, 1)}
    near = [(p, (p[0], p[1] + dx, p[2] + dy)) for p in pixels for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    want = roots([(a, b) for a, b in near if b in pixels])
    table = spark.createDataFrame(sorted(pixels), "tile int, px long, py long")
    groups = {}
    for r in masks.regions(table, ["tile"]).collect():
        groups.setdefault(r.region, set()).add((r.tile, r.px, r.py))
    expected = {}
    for pixel, root in want.items():
        expected.setdefault(root, set()).add(pixel)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))
    seeds = spark.createDataFrame([(3, 0, 0), (1, -5, 0)], "tile int, px long, py long")
    assert masks.flooded(table, seeds).count() == 601
