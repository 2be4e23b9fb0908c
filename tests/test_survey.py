"""Scenarios of the survey's operators: overlays, networks, tours, files, locks as a stream."""

import json
import math
import struct
import time

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrasurvey.functions import kernel
from terrasurvey.operators import labels, measures, ordered, routes, segments, spatial
from terrasurvey.sources import files
from terrasurvey.sources.shared import checkpoint_folder
from terrasurvey.streaming import presence


def box(x0, y0, x1, y1):
    return np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], float)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12), st.integers(1, 6), st.integers(1, 6)), min_size=1, max_size=8))
def test_union_area_counts_unit_squares(shapes):
    cells = {(x + i, y + j) for x, y, w, h in shapes for i in range(w) for j in range(h)}
    assert math.isclose(kernel.union_area([box(x, y, x + w, y + h) for x, y, w, h in shapes]), len(cells), abs_tol=1e-6)


def test_overlay_of_slanted_shapes():
    diamond = np.array([[0, 2], [2, 0], [4, 2], [2, 4]], float)
    assert math.isclose(kernel.union_area([diamond]), 8)
    assert math.isclose(kernel.overlay_area([[diamond], [box(0, 0, 2, 4)]], lambda on: on[0] and not on[1]), 4)
    assert math.isclose(kernel.union_area([diamond, diamond + [4, 0]]), 16)
    assert math.isclose(kernel.line_inside(np.array([[-1.0, 2.0], [5.0, 2.0]]), [diamond]), 4)
    assert kernel.holds(diamond, 1, 1) and not kernel.holds(diamond, 0.5, 0.5)


def plan(spark, areas, ends):
    a = spark.createDataFrame([(1, label, ring.tolist()) for label, ring in areas], "site long, label string, ring array<array<double>>")
    t = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(ends)], "site long, terminal long, x double, y double")
    return routes.path_lengths(*routes.with_terminals(routes.walkable_cells(a, ["interrow_area", "passage"], ["forbidden", "canopy"]), t))


def test_routes_go_round_obstacles(spark):
    areas = [("interrow_area", box(0, 0, 20, 10)), ("forbidden", box(8, 0, 12, 8)), ("canopy", box(2, 2, 4, 4))]
    found = routes.tours(plan(spark, areas, [(1, 1), (19, 1)])).collect()
    assert [r.terminal for r in found] == [0, 1] and found[0].length_m > 36 and found[0].length_m <= found[0].baseline_m + 1e-9


def test_parts_that_do_not_meet_are_not_reached(spark):
    assert plan(spark, [("interrow_area", box(0, 0, 5, 5)), ("interrow_area", box(10, 0, 20, 5))], [(1, 1), (19, 1)]).count() == 0


def test_narrow_passage(spark):
    areas = [("interrow_area", box(0, 0, 10, 0.2)), ("interrow_area", box(0, 2, 10, 2.2)), ("passage", box(9.8, 0, 10.2, 2.2))]
    found = {(r["source"], r["target"]): r["metres"] for r in plan(spark, areas, [(1, 0.1), (1, 2.1)]).collect()}
    assert 15 < found[0, 1] < 30


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 9), st.integers(0, 999))
def test_tour_is_closed_and_no_longer_than_nearest_neighbour(n, seed):
    p = np.random.default_rng(seed).random((n, 2))
    order, best, base = routes.tour(np.hypot(*(p[:, None] - p[None, :]).transpose(2, 0, 1)))
    assert sorted(order) == list(range(n)) and order[0] == 0 and best <= base + 1e-9


def test_first_entry_two_metre_rule(spark):
    path = spark.createDataFrame([("r", 0, 1.0, 1.0), ("r", 1, 19.0, 1.0)], "route_id string, at int, x double, y double")
    targets = spark.createDataFrame([("far", 19.0, 1.0), ("near", 1.0, -1.0), ("out", 1.0, -1.01), ("side", 10.0, 2.0)], "target_id string, x double, y double")
    got = {r.target_id: r.distance_m for r in ordered.first_entry(path, targets).collect()}
    assert set(got) == {"far", "near", "side"} and got["near"] == 0 and math.isclose(got["far"], 16) and math.isclose(got["side"], 9 - math.sqrt(3))


def test_gap_rules(spark):
    p = spark.createDataFrame([("a", 0.0, 2.0), ("a", 1.0, 1.5), ("a", 3.5, 4.0), ("a", 15.0, 16.0), ("b", 0.0, 1.0), ("b", 2.6, 2.9)], "row string, a double, b double")
    assert sorted((r.row, r.gap_start, r.gap_end) for r in ordered.gaps(p, ["row"]).collect()) == [("a", 2.0, 3.5), ("a", 4.0, 15.0)]
    assert [(r.gap_start, r.gap_end) for r in ordered.gaps(p.where("row = 'a'"), ["row"], "points").collect()] == [(2.0, 3.5)]


def test_measurements_scenario(spark):
    pieces = spark.createDataFrame([("V1", "R1", "regular", 0.0, 8.0), ("V1", "R1", "regular", 0.0, 8.0), ("", "R9", "disrupted", 0.0, 3.0)], "vineyard_id string, row_id string, row_structure string, a double, b double")
    boxes = spark.createDataFrame([("V1", "vineyard", 0, 0, 2, 2), (None, "vineyard", 5, 5, 1, 1), ("V1", "interrow_area", 1, 0, 2, 8)], "vineyard_id string, label string, x long, y long, w long, h long")
    got = {(r.level, r.row_id): r for r in measures.measurements(pieces, boxes).collect()}
    total = got["total", None]
    assert (total.row_count, total.row_length_m, total.canopy_area_m2, total.interrow_area_m2, total.block_count) == (2, 8.0, 5.0, 16.0, 1)
    assert got["row", "R1"].row_length_m == 8.0 and got["block", None].canopy_area_m2 == 4.0 and ("row", "R9") not in got


def test_budget_of_targets_never_goes_below_zero(spark):
    gaps = spark.createDataFrame([("a", 3.0), ("b", 2.0)], "row string, gap_m double")
    assert ordered.top_gaps(gaps, 199, ["row"]).count() == 1 and ordered.top_gaps(gaps, 250, ["row"]).count() == 0


def test_clusters_and_hulls(spark):
    checkpoint_folder(spark)
    boxes = spark.createDataFrame([(i, 4.0 * i, 0.0, 4.0 * i + 3, 3.0) for i in range(5)] + [(9, 100.0, 0.0, 102.0, 2.0)], "id long, x0 double, y0 double, x1 double, y1 double")
    assert {(r.id, r.cluster) for r in spatial.clusters(boxes, 1.0, 15.0, 8.0).collect()} == {(i, 0) for i in range(5)}
    points = spark.createDataFrame([("k", float(x), float(y)) for x in range(5) for y in range(3)], "key string, x double, y double")
    hull = spatial.hulls(points, ["key"]).first()
    assert (hull.n, hull.area) == (4, 8.0)
    b = spatial.oriented_boxes(points, ["key"]).first()
    assert (b.long_m, b.short_m, round(b.fill, 9)) == (4.0, 2.0, 1.0)


def test_simplify_with_a_cap():
    line = np.array([[x, math.sin(x / 9)] for x in range(200)])
    assert len(spatial.simplified(line, 0.0)) > 60 and len(spatial.simplified(line, 5.0)) == 2


def test_row_direction(spark):
    a = math.radians(37)
    p = [("b", s * math.cos(a) - 2.5 * r * math.sin(a), s * math.sin(a) + 2.5 * r * math.cos(a)) for r in range(6) for s in range(60)]
    assert abs(segments.row_direction(spark.createDataFrame(p, "block string, x double, y double"), ["block"]).first().theta - 37) <= 0.5


def test_instances(spark):
    px = [(1, r, c, 1.0, 1.0 if c == 6 else 0.0) for r in range(6) for c in range(12)] + [(1, 10, c, 1.0, 1.0) for c in range(3)]
    got = segments.split_instances(spark.createDataFrame(px, "tile long, row int, col int, vine double, edge double"), 16).collect()
    assert sorted(r.pixels for r in got)[0] == 3 and sum(r.pixels for r in got) == 75 and len(got) == 3


def test_next_fit(spark):
    f = spark.createDataFrame([("a", 50), ("b", 50), ("c", 30), ("d", 200)], "name string, size_bytes long")
    assert [r.part for r in labels.next_fit(f, 90).orderBy("name").collect()] == [1, 2, 2, 3]


def tiff(width=2048, epsg=32635, scale=0.025):
    tags = [(256, 4, (width,)), (257, 4, (width,)), (277, 3, (4,)), (33550, 12, (scale, scale, 0.0)), (33922, 12, (0.0, 0.0, 0.0, 629000.0, 5220000.0, 0.0)), (34735, 3, (1, 1, 0, 1, 3072, 0, 1, epsg))]
    head, body = b"", b""
    after = 8 + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        code = {3: "H", 4: "I", 12: "d"}[kind]
        raw = struct.pack(f"<{len(values)}{code}", *values)
        head += struct.pack("<HHI", tag, kind, len(values))
        if len(raw) <= 4:
            head += raw.ljust(4, b"\0")
        else:
            head += struct.pack("<I", after + len(body))
            body += raw
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + head + b"\0" * 4 + body


def test_tile_headers(spark, tmp_path):
    for name, content in (("good", tiff()), ("crs", tiff(epsg=4326)), ("size", tiff(width=512)), ("gsd", tiff(scale=0.05)), ("bad", b"nothing")):
        (tmp_path / f"{name}.tif").write_bytes(content)
    got = {r.name: r for r in files.read_tiles(spark, str(tmp_path)).collect()}
    assert {k: r.error for k, r in got.items()} == {"good": None, "crs": "wrong_crs", "size": "wrong_size", "gsd": "wrong_resolution", "bad": "not_a_tiff"}
    assert got["good"].bounds == [629000.0, 5220000.0 - 51.2, 629051.2, 5220000.0] and got["good"].bands == 4


def test_geojson(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    shapes = [("Polygon", [ring, ring]), ("MultiPolygon", [[ring], [ring, ring]]), ("LineString", [[0, 0], [2, 2]]), ("Point", [3, 4])]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"label": k}, "geometry": {"type": k, "coordinates": c}} for k, c in shapes] + [{"type": "Feature", "properties": {}, "geometry": None}]}
    (tmp_path / "t1__labels.geojson").write_text(json.dumps(doc))
    (tmp_path / "t2__rows__x.geojson").write_text("{not json")
    got = files.read_geojson(spark, f"{tmp_path}/*.geojson").collect()
    assert sorted((r.kind, r.part, len(r.ring)) for r in got) == [("LineString", 0, 2), ("MultiPolygon", 0, 4), ("MultiPolygon", 1, 4), ("Point", 0, 1), ("Polygon", 0, 4)]
    assert {(r.base, r.suffix) for r in got} == {("t1", "labels")}


def test_annotation_xml_round_trip(spark, tmp_path):
    text = """<annotations><image id="0" name="t.tif" width="10" height="20"><polygon label="vineyard" source="manual" occluded="0" points="0.00,0.00;4.00,0.00;4.00,3.00" z_order="1"><attribute name="row_id">R1</attribute><attribute name="note"></attribute></polygon>
    <box label="waste" source="auto" occluded="1" xtl="1.0" ytl="2.0" xbr="3.0" ybr="4.0" z_order="0"/><cuboid label="x"/></image></annotations>"""
    (tmp_path / "a.xml").write_text(text)
    first = files.read_annotation_xml(spark, f"{tmp_path}/a.xml")
    files.write_annotation_xml(first, f"{tmp_path}/out")
    rows = lambda df: sorted(json.dumps(r.asDict(True), sort_keys=True) for r in df.collect())
    assert rows(files.read_annotation_xml(spark, f"{tmp_path}/out")) == rows(first) and first.count() == 2
    shape = first.where("shape_type = 'polygon'").first()
    assert shape.attributes == {"row_id": "R1", "note": ""} and len(shape.points) == 3


def test_locks():
    run = lambda kinds: [s for s in fold(kinds)]

    def fold(kinds):
        holder = None
        for kind, client, at in kinds:
            holder, ok = presence.step(holder, kind, client, at, 20.0)
            yield ok, holder and holder[0]

    assert run([("claim", "a", 0), ("claim", "b", 5), ("release", "b", 6), ("heartbeat", "b", 7), ("claim", "a", 20)]) == [(True, "a"), (False, "a"), (False, "a"), (False, "a"), (True, "a")]
    assert run([("claim", "a", 0), ("claim", "b", 20), ("claim", "b", 20.1)]) == [(True, "a"), (False, "a"), (True, "b")]
    assert run([("heartbeat", "a", 0), ("verified", "x", 1), ("claim", "b", 2)]) == [(True, "a"), (True, None), (True, "b")]


def test_lock_stream_equals_the_table(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"tile": rng.integers(0, 4, 80), "event_id": range(80), "kind": rng.choice(["claim", "heartbeat", "release", "force_release"], 80), "client": rng.choice(list("abc"), 80), "at": np.sort(rng.integers(0, 300, 80)).astype(float)})
    fields = "tile long, event_id long, kind string, client string, at double"
    for i in range(4):
        spark.createDataFrame(rows[i * 20 : i * 20 + 20], fields).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q = presence.lock_stream(spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), 20.0).writeStream.format("memory").queryName("locks").option("checkpointLocation", f"{tmp_path}/cp").start()
    for _ in range(240):  # with a timeout in processing time there is always another batch to come
        if spark.table("locks").count() >= len(rows):
            break
        time.sleep(0.5)
    q.stop()
    got = sorted(map(tuple, spark.table("locks").collect()))
    assert got == sorted(map(tuple, presence.lock_history(spark.createDataFrame(rows, fields), 20.0).collect()))


def test_survey_files(spark, tmp_path):
    layers = {name: spark.createDataFrame([], schema) for name, schema in files.LAYERS.items()}
    files.write_survey(layers, f"{tmp_path}/s")
    assert set(files.read_survey(spark, f"{tmp_path}/s")) == set(files.LAYERS)
    with pytest.raises(ValueError, match="lacks"):
        files.write_survey(layers | {"rows": layers["rows"].drop("row_id")}, f"{tmp_path}/t")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_survey(spark, f"{tmp_path}/none")["rows"].count()
    assert spark.range(1).select(files.safe_tile_name(F.lit("a.tif")).alias("n")).first().n == "a.tif"
