"""Folds in order that are run in many tasks give what one loop gives."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrasurvey.operators import labels, ordered
from terrasurvey.operators.ranges import in_ranges, running
from terrasurvey.streaming import presence


def test_running_sums_over_ranges(spark):
    rows = [(i * 37 % 101, i % 7) for i in range(101)]
    found = running(in_ranges(spark.createDataFrame(rows, "k int, v long"), "k", most=10), total="v").collect()
    so_far, want = 0, {}
    for k, v in sorted(rows):
        so_far += v
        want[k] = so_far
    assert {r.k: r.total for r in found} == want and len({r._range for r in found}) > 3


def parts_of(sizes, limit):
    out, part, held = [], 1, 0
    for n in sizes:
        if held and held + n > limit:
            part, held = part + 1, 0
        held += n
        out.append(part)
    return out


@pytest.mark.parametrize("kind", ["mixed", "large", "zeros", "exact", "one", "none"])
def test_parts_of_files(spark, kind):
    rng = random.Random(6)
    sizes = {
        "mixed": [rng.choice([1, 5, 20, 60, 99]) for _ in range(400)],
        "large": [rng.choice([0, 1, 100, 101, 350]) for _ in range(200)],
        "zeros": [0] * 30 + [500] + [0] * 20 + [40, 70, 0, 0, 30],
        "exact": [50] * 101,
        "one": [7],
        "none": [],
    }[kind]
    files = spark.createDataFrame([(f"f{i:05}", n) for i, n in enumerate(sizes)], "name string, size_bytes long").repartition(3)
    found = sorted(labels.next_fit(files, 100).collect())
    assert [r.part for r in found] == parts_of(sizes, 100)
    assert [r.size_bytes for r in found] == sizes


def test_many_files(spark):
    n = 200_000
    files = spark.range(n).select(F.format_string("f%07d", "id").alias("name"), (F.col("id") * 7919 % 977 + 1).alias("size_bytes"))
    found = labels.next_fit(files, 90_000).groupBy("part").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes")).orderBy("part").collect()
    want = pd.Series(parts_of([i * 7919 % 977 + 1 for i in range(n)], 90_000)).value_counts().sort_index()
    assert [r.n for r in found] == want.tolist() and max(r.bytes for r in found) <= 90_000


def test_claims_equal_the_loop(spark):
    rng = random.Random(8)
    rows = [(t, q, p) for t in range(3) for q in range(25) for p in rng.sample(range(60), rng.randint(1, 30))] + [(9, 1, 1)]
    found = ordered.claimed(spark.createDataFrame(rows + rows[:5], "tile int, quad long, pixel long"), ["tile"], 6)
    want = set()
    for tile in {r[0] for r in rows}:
        taken = set()
        for quad in sorted({q for t, q, _ in rows if t == tile}):
            mine = {p for t, q, p in rows if (t, q) == (tile, quad)} - taken
            if len(mine) >= 6:
                taken |= mine
                want.add((tile, quad, len(mine)))
    assert {tuple(r) for r in found.select("tile", "quad", "pixels").collect()} == want


@pytest.mark.parametrize("most", [40, 100_000])
def test_a_tile_that_is_never_silent_is_folded_in_ranges(spark, most):
    rng, at, rows = random.Random(10), 0.0, []
    for i in range(1500):
        at += rng.choice([0.0, 0.5, 2.0, 9.0, 9.0, 19.9])
        rows.append((1 if i % 10 else 2, i, rng.choice(["claim", "heartbeat", "heartbeat", "heartbeat", "release", "view", "force_release"]), rng.choice("abc"), at))
    events = spark.createDataFrame(rows, "tile long, event_id long, kind string, client string, at double")
    found = {tuple(r) for r in presence.lock_history(events, most=most).collect()}
    table = pd.DataFrame(rows, columns=["tile", "event_id", "kind", "client", "at"])
    want = pd.concat([presence.fold(part, None, presence.TTL)[0] for _, part in table.groupby("tile")])
    assert found == {tuple(None if pd.isna(v) else v for v in r) for r in want.itertuples(index=False)}
    assert len({r[3] for r in found}) == 4
