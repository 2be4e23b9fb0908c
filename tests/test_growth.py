"""Work that must grow with the input and not with its square: how the plans are made, and that results stay."""

from pyspark.sql import functions as F

from terrasurvey.operators import spatial


def logical(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_row_reads_no_frame_again(spark):
    rows = spark.createDataFrame([(1, 0.0, 10), (1, 4.0, 14), (1, 9.0, 19)], "block int, off double, row int")
    p = spark.createDataFrame([(i, b, o) for i, (b, o) in enumerate([(1, 2.0), (1, 4.0), (1, 6.6), (1, 20.0), (2, 1.0), (1, None), (1, -1.0)])], "id int, block int, off double")
    got = spatial.nearest_on_axis(p, rows, ["block"], "off", 3.0)
    assert "unboundedfollowing" not in logical(got)
    assert [r.row for r in got.orderBy("id").collect()] == [10, 14, 19, None, None, None, 10]


def test_nearest_within_looks_a_place_up_once(spark):
    t = spark.range(40).select(F.col("id").alias("target"), (F.col("id") % 2 * 9).cast("double").alias("x"), F.lit(0.0).alias("y"))
    c = spark.range(60).select((100 - F.col("id")).alias("candidate"), (F.col("id") % 3).cast("double").alias("x"), F.lit(1.0).alias("y"))
    got = spatial.nearest_within(t, c, 2.0)
    join = next(n for n in logical(got).split("Join Inner") if "_cx" in n.split("\n")[0])
    assert join.count("Aggregate") >= 2
    assert [tuple(r) for r in got.orderBy("target").collect()] == [(i, 43, 1.0) for i in range(0, 40, 2)]


def test_first_areas_of_a_cell_are_tested_first(spark, monkeypatch):
    from terrasurvey.functions import geometry as g

    a = spark.range(60).select((60 - F.col("id")).alias("area"), (F.col("id") % 7).alias("x0"), (F.col("id") % 5).alias("y0"), (F.col("id") % 4 + 1).alias("w"))
    areas = a.select("area", F.col("area").alias("place"), g.box_ring(F.col("x0"), F.col("y0"), F.col("w"), F.col("w")).alias("ring"))
    points = spark.range(150).select("id", (F.col("id") % 15 - 0.5).cast("double").alias("x"), F.floor(F.col("id") / 15).cast("double").alias("y"))
    boxes = [tuple(r) for r in a.collect()]
    want = {(r.id, min((k for k, x, y, w in boxes if x <= r.x <= x + w and y <= r.y <= y + w), default=None)) for r in points.collect()}
    for levels in (spatial.LEVELS, ((0, 1), (1, 3), (3, 1 << 31))):
        monkeypatch.setattr(spatial, "LEVELS", levels)
        assert {tuple(r) for r in spatial.first_containing(points, areas, "id", 3.0).collect()} == want


def test_burnt_lines_are_not_shuffled_as_pixels(spark):
    from terrasurvey.operators import raster
    from terrasurvey.plans.registry import QUERIES

    plan = QUERIES["w10_priority_overlay"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # shapes, and the sums by label
    rows = [(None, 0, 0, 5, "waste", 1), (None, 0, 2, 9, "vineyard", 9), ("a", 0, 0, 4, "row", 1), ("a", 0, 1, 3, "row", 2), ("a", 0, 3, 6, "other", 7), ("a", 1, 0, 2, "waste", 3), (None, 0, 20, 21, "row", None)]
    runs = spark.createDataFrame(rows, "t string, y int, start long, end long, label string, id long")
    got = sorted(((r.t or "", r.y, r.start, r.end, r.label) for r in raster.burnt_runs(runs, ["t"], "y", "id").collect()))
    assert got == [("", 0, 0, 2, "waste"), ("", 0, 2, 5, "waste"), ("", 0, 5, 9, "vineyard"), ("", 0, 20, 21, "row"), ("a", 0, 0, 1, "row"), ("a", 0, 1, 3, "row"), ("a", 0, 3, 4, "row"), ("a", 1, 0, 2, "waste")]


def test_corridors_are_dealt_to_all_tasks(spark):
    from terrasurvey.operators import routes

    strips = spark.range(3).coalesce(1).select(F.col("id").alias("site"), F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (5, 0), (5, 2), (0, 2))]).alias("ring"))
    assert routes.corridors(strips).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_thinning_looks_at_the_pixels_and_not_at_the_whole_window(monkeypatch):
    import numpy as np

    from terrasurvey.operators import thinning

    seen, peeled = [], thinning.peeled
    monkeypatch.setattr(thinning, "peeled", lambda image, second: seen.append(image.size) or peeled(image, second))
    x, y = (c.ravel() for c in np.meshgrid(np.arange(60, 120), np.arange(70, 73)))
    px, py, more = thinning.thin_window(x, y, 256, 64)
    whole = np.zeros((384, 384), bool)
    whole[y, x] = True
    for i in range(64):
        whole &= ~peeled(whole, i % 2 == 1)
    assert not more and max(seen) == 180 and [*zip(py, px, strict=True)] == [*zip(*np.nonzero(whole[64:320, 64:320]), strict=True)]
    seen.clear()
    px, _, more = thinning.thin_window(x - 60, y, 256, 64)  # all in the halo
    assert not len(px) and not more and not seen


def test_outlines_need_no_call_for_each_group(spark):
    from terrasurvey.operators import masks

    pixels = spark.createDataFrame([(None, 0, 0), (None, 1, 0), (4, 0, 0), (5, 0, 0), (5, 1, 1)], "id long, px long, py long")
    rings = masks.outlines(pixels, ["id"])
    assert "FlatMapGroupsInPandas" not in logical(rings)
    assert sorted((r.id or 0, r.area, len(r.ring)) for r in rings.collect()) == [(0, 2.0, 4), (4, 1.0, 4), (5, 1.0, 4), (5, 1.0, 4)]


def test_pieces_outside_do_not_gather_in_the_cells_of_few_areas(spark, monkeypatch):
    from terrasurvey.operators import lines

    ring = lambda *p: [(float(x), float(y)) for x, y in [*p, p[0]]]
    rings = [ring((-50, -40), (-40, -50), (50, 40), (40, 50)), ring((0, 20), (8, 20), (8, 28), (4, 22), (0, 28)), ring((20, 0), (28, 0), (28, 8), (20, 8)), ring((24, 0), (32, 0), (32, 8), (24, 8))]
    areas = spark.createDataFrame([(r,) for r in rings], "ring array<struct<x:double,y:double>>")
    walks = [[(float(i * 7 % 60 - 10), float(i * 11 % 47 - 10)) for i in range(k, k + 9)] for k in range(40)] + [[(18.0, 0.0), (34.0, 0.0), (34.0, 0.0), (18.0, 0.0)], [(28.0, -3.0), (28.0, 11.0)]]
    routes = spark.createDataFrame(list(enumerate(walks)), "id long, points array<struct<x:double,y:double>>")
    found = lines.pieces_outside(routes, areas, "id")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # the shares of a segment
    rows = lambda df: sorted((r.id, r.segment, r.piece, round(r["from"], 6), round(r["to"], 6), round(r.length_m, 6)) for r in df.collect())
    got = rows(found)
    assert [r for r in got if r[0] >= 40] == [(40, 0, 0, 0.0, 0.125, 2.0), (40, 0, 1, 0.875, 1.0, 2.0), (40, 2, 0, 0.0, 0.125, 2.0), (40, 2, 1, 0.875, 1.0, 2.0), (41, 0, 0, 0.0, round(3 / 14, 6), 3.0), (41, 0, 1, round(11 / 14, 6), 1.0, 3.0)]

    def holds(r, x, y):
        return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(r, r[1:], strict=False)) % 2

    total = {}
    for i, s, _, a, b, metres in got:
        total[i, s] = total.get((i, s), 0) + (b - a)
    for i, walk in enumerate(walks[:40]):
        for s, (p, q) in enumerate(zip(walk, walk[1:], strict=False)):
            out = sum(not any(holds(r, p[0] + (q[0] - p[0]) * (k + 0.5) / 500, p[1] + (q[1] - p[1]) * (k + 0.5) / 500) for r in rings) for k in range(500)) / 500
            assert abs(out - total.get((i, s), 0)) < 0.02
    monkeypatch.setattr(lines, "SENT", (0, 0))
    monkeypatch.setattr(lines, "AT_ONCE", 7)
    assert rows(lines.pieces_outside(routes, areas, "id")) == got
    assert lines.pieces_outside(routes, areas.limit(0), "id").count() == sum(p != q for w in walks for p, q in zip(w, w[1:], strict=False))


def test_sampled_points_stay_where_their_polygon_is(spark):
    from terrasurvey.operators import segments

    star = [(0.0131, 0.0073), (30.3117, 2.0293), (14.0571, 12.0837), (29.0173, 41.7331), (11.0393, 22.0617), (-3.0719, 39.0437)]
    rings = [(i, [(x + i * 0.37, y * (1 + i % 3) - i) for x, y in [*star, star[0]]]) for i in range(12)]
    shapes = spark.createDataFrame(rings, "id long, ring array<struct<x:double,y:double>>")
    points = segments.sampled_polygons(shapes, "id")
    plan = points.groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan  # only the polygons themselves are moved
    got = {r.id: (r.n, round(r.sx, 3)) for r in points.groupBy("id").agg(F.count("*").alias("n"), F.sum("x").alias("sx")).collect()}
    for i, ring in rings:
        x0, y0, x1, y1 = min(p[0] for p in ring), min(p[1] for p in ring), max(p[0] for p in ring), max(p[1] for p in ring)
        held = []
        for k in range(int((y1 - y0) * 4) + 2):
            y = y0 + (k + 0.5) * 0.25
            cuts = [a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in zip(ring, ring[1:], strict=False) if (a[1] > y) != (b[1] > y)]
            held += [x for x in (x0 + (j + 0.5) * 0.25 for j in range(int((x1 - x0) * 4) + 2)) if sum(c > x for c in cuts) % 2]
        assert got[i][0] == len(held) and abs(got[i][1] - sum(held)) < 0.01
