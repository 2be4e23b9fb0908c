"""Annotation schemas, archives, constraints, parcels, roads, masks and results as files; masks and segmenters."""

import json
import zipfile
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrasurvey.functions import kernel
from terrasurvey.operators import masks
from terrasurvey.sources import files

XML = """<?xml version="1.0"?><annotations><meta><job><labels>
<label><name>row</name><type>polyline</type><attributes><attribute><name>row_id</name><mutable>False</mutable><input_type>text</input_type><default_value></default_value><values></values></attribute>
<attribute><name>cover</name><mutable>True</mutable><input_type>select</input_type><default_value>bare</default_value><values>bare\nmixed</values></attribute></attributes></label>
<label><name>waste</name><type>polygon</type></label></labels></job></meta>
<image id="0" name="a.tif" width="4" height="4"><polygon label="waste" points="0,0;3,0;3,3"/></image></annotations>"""


def feature(kind, coordinates, **properties):
    return {"type": "Feature", "geometry": {"type": kind, "coordinates": coordinates}, "properties": properties}


def collection(path, *features):
    path.write_text(json.dumps({"type": "FeatureCollection", "features": list(features)}))


def test_label_schema_and_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "job.zip", "w") as z:
        z.writestr("inner/annotations.xml", XML)
        z.writestr("readme.txt", "no")
    (tmp_path / "out").mkdir()
    found = [r.file for r in files.unzipped(spark, str(tmp_path / "job.zip"), str(tmp_path / "out")).collect()]
    assert [f.rsplit("/", 1)[1] for f in found] == ["job.zip__annotations.xml"]
    got = {tuple(r) for r in files.read_label_schema(spark, found[0]).collect()}
    assert got == {("row", "polyline", "row_id", "False", "text", "", ""), ("row", "polyline", "cover", "True", "select", "bare", "bare\nmixed"), ("waste", "polygon", None, None, None, None, None)}
    assert [r.label for r in files.read_annotation_xml(spark, found[0]).collect()] == ["waste"]


def test_holes_parcels_constraints_and_roads(spark, tmp_path):
    square, hole = [[0, 0], [9, 0], [9, 9], [0, 9], [0, 0]], [[3, 3], [4, 3], [4, 4], [3, 3]]
    collection(tmp_path / "passages.geojson", feature("Polygon", [square, hole], pid="7"), feature("MultiPolygon", [[square], [square, hole]]), feature("LineString", [[0, 0], [20, 0]]))
    for name in ("forbidden", "study_area"):
        collection(tmp_path / f"{name}.geojson", feature("Point", [1, 2]))
    found = files.read_constraints(spark, str(tmp_path), "siret3")
    assert files.read_constraints(spark, str(tmp_path), "other") == {} and set(found) == {"passages", "forbidden", "study_area"}
    rows = found["passages"].orderBy("position", "part").collect()
    assert [(r.kind, r.part, len(r.ring), len(r.holes)) for r in rows] == [("Polygon", 0, 5, 1), ("MultiPolygon", 0, 5, 0), ("MultiPolygon", 1, 5, 1), ("LineString", 0, 2, 0)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.read_constraints(spark, str(tmp_path / "no"), "siret3")
    assert [r.pid for r in files.read_parcels(found["passages"], None).orderBy("position", "part").collect()] == [7, 1, 1, 2]
    assert files.read_parcels(found["passages"], found["study_area"]).first().pid == 0
    roads = files.read_road_areas(spark, str(tmp_path / "passages.geojson"))
    assert roads.count() == 4 and files.read_road_areas(spark, str(tmp_path / "none.geojson")) is None
    wide = [np.array(r.ring) for r in roads.collect() if len(r.ring) > 5]
    assert abs(kernel.union_area(wide) - (60 + 36 * np.sin(np.pi / 16))) < 1e-6


def test_mask_tiff_keeps_the_tile_s_place(spark, tmp_path):
    t = [0.025, 0.0, 600000.0, 0.0, -0.025, 5200000.0]
    pixels = np.arange(12, dtype=np.uint8)
    header = files.tile_header(files.mask_tiff(pixels.tobytes(), 4, 3, t, 32635), check=False)
    assert header["ok"] and (header["width"], header["height"], header["bands"], header["epsg"], header["transform"]) == (4, 3, 1, 32635, t)
    headers = spark.createDataFrame([("a", 4, 3, t, 32635), ("empty", 2, 2, t, 32635)], "name string, width int, height int, transform array<double>, epsg int")
    shape = spark.createDataFrame([("a", [[(0.0, 0.0), (3.0, 0.0), (3.0, 2.0), (0.0, 2.0), (0.0, 0.0)]])], "name string, rings array<array<struct<x:double,y:double>>>")
    runs = masks.rasterised(shape, ["name"]).withColumn("value", F.lit(9))
    got = {r.name: bytes(r.content) for r in files.mask_tiffs(runs, headers).collect()}
    n = int.from_bytes(got["a"][4:8], "little")
    assert np.frombuffer(zlib.decompress(got["a"][8:n]), np.uint8).reshape(3, 4).tolist() == [[9, 9, 9, 0], [9, 9, 9, 0], [0, 0, 0, 0]]
    assert set(got) == {"a", "empty"}


def test_tile_contract_names_the_first_broken_rule():
    t = [0.025, 0.0, 0.0, 0.0, -0.025, 0.0]
    make = lambda size=2048, epsg=32635, t=t: files.tile_header(files.mask_tiff(bytes(size * size), size, size, t, epsg))["error"]
    assert make() is None and make(epsg=4326) == "wrong_crs" and make(size=16, epsg=4326) == "wrong_crs" and make(size=16) == "wrong_size"
    assert make(t=[0.025, 0.1, 0.0, 0.0, -0.025, 0.0]) == "not_north_up" and make(t=[0.05, 0.0, 0.0, 0.0, -0.05, 0.0]) == "wrong_resolution"


def test_outlines_with_holes_and_corners(spark):
    rows = [(1, x, y) for x in range(4) for y in range(4) if (x, y) not in ((1, 1), (2, 1))] + [(2, 0, 0), (2, 1, 1)]
    got = masks.outlines(spark.createDataFrame(rows, "id long, px long, py long"), ["id"]).collect()
    assert sorted((r.id, r.area, len(r.ring)) for r in got) == [(1, -2.0, 4), (1, 16.0, 4), (2, 1.0, 4), (2, 1.0, 4)]


def test_rasterised_rings_with_holes(spark):
    ring = lambda *p: [(float(x), float(y)) for x, y in p]
    shapes = [(1, [ring((0, 0), (6, 0), (6, 6), (0, 6), (0, 0)), ring((2, 2), (4, 2), (4, 4), (2, 4), (2, 2))])]
    runs = masks.rasterised(spark.createDataFrame(shapes, "id long, rings array<array<struct<x:double,y:double>>>"), ["id"]).collect()
    assert {(r.px, r.py) for r in []} | {(x, r.py) for r in runs for x in range(r.start, r.end)} == {(x, y) for x in range(6) for y in range(6) if not (2 <= x < 4 and 2 <= y < 4)}


def test_segmenter_contract(spark):
    tiles = spark.createDataFrame([("siret3_r001_c002", b"x")], "name string, content binary")
    labels = spark.createDataFrame([("siret3_r001_c002", "vineyard", "Polygon", [[0.0, 0.0]]), ("siret3_r001_c002", "row", "Polygon", [[0.0, 0.0]])], "name string, label string, kind string, ring array<array<double>>")

    def model(batches):
        for rows in batches:
            yield pd.DataFrame({"name": rows["name"], "class": "waste", "ring": [[[0.0, 0.0]]] * len(rows)})

    assert [(r["class"], r.source) for r in masks.segmented(tiles, model).collect()] == [("waste", "model")]
    assert [(r["class"], r.source) for r in masks.segmented(tiles, None, labels, True).collect()] == [("canopy", "precomputed")]
    for bad in ({}, {"precomputed": labels}):
        with pytest.raises(ValueError, match="not allowed"):
            masks.segmented(tiles, None, **bad)
    with pytest.raises(Exception, match="no precomputed labels"):
        masks.segmented(spark.createDataFrame([("other", b"")], tiles.schema), None, labels, True).collect()


def test_results_as_json(spark, tmp_path):
    files.write_results({"stops": spark.createDataFrame([(1, "a")], "id long, name string"), "none": spark.createDataFrame([], "id long")}, str(tmp_path))
    assert (tmp_path / "stops" / "_SUCCESS").exists() and (tmp_path / "none" / "_SUCCESS").exists()
    assert spark.read.json(str(tmp_path / "stops")).collect() == [(1, "a")]


def test_rings_that_cross_themselves_and_the_largest_part(spark):
    from terrasurvey.operators import edits

    ring = lambda *p: [(float(x), float(y)) for x, y in p]
    square, bow = ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), ring((0, 0), (4, 3), (4, 0), (0, 4), (0, 0))
    touching, open_ring = ring((0, 0), (4, 0), (2, 0), (2, 3), (0, 0)), ring((0, 0), (4, 0), (4, 4), (0, 4))
    small, slanted = ring((9, 9), (10, 9), (10, 10), (9, 9)), ring((0, 0), (5, 1), (7, 6), (1, 4), (0, 0))
    df = spark.createDataFrame([(0, square), (1, bow), (2, touching), (3, open_ring), (4, slanted)], "id long, ring array<struct<x:double,y:double>>")
    assert [r.v for r in df.orderBy("id").select(edits.valid_ring(F.col("ring")).alias("v")).collect()] == [True, False, False, False, True]
    parts = spark.createDataFrame([([small, square, bow],), ([bow],)], "parts array<array<struct<x:double,y:double>>>")
    best = [r.b for r in parts.select(edits.largest_valid(F.col("parts")).alias("b")).collect()]
    assert [(p.x, p.y) for p in best[0]] == square and best[1] is None


def test_joined_strips_are_a_hull_within_the_tile(spark):
    from terrasurvey.operators import edits

    rows = [("V1", "b", "mixed", 0, 0, 2, 2), ("V1", "a", "bare_soil", 8, 8, 4, 2)]
    strip = edits.joined_strips(spark.createDataFrame(rows, "vineyard_id string, interrow_id string, cover string, x long, y long, w long, h long"), ["vineyard_id"], 10.0, 20.0).first()
    points = [(p.x, p.y) for p in strip.ring]
    # the hull of both boxes has 6 corners; the tile's right edge cuts it
    assert (strip.x0, strip.y0, strip.x1, strip.y1, strip.cover) == (0.0, 0.0, 10.0, 10.0, "bare_soil") and (2.0, 0.0) in points and (0.0, 2.0) in points
    assert abs(kernel.union_area([np.array(points)]) - 42.4) < 1e-9


def test_locks_are_folded_from_silence_to_silence(spark):
    from terrasurvey.streaming import presence

    rng = np.random.default_rng(8)
    at = np.cumsum(rng.choice([1.0, 5.0, 19.5, 20.0, 20.5, 90.0], 300))
    rows = pd.DataFrame({"tile": rng.integers(0, 3, 300), "event_id": range(300), "kind": rng.choice(["claim", "heartbeat", "release", "force_release"], 300), "client": rng.choice(list("abc"), 300), "at": at})
    whole = pd.concat([presence.fold(part, None, 20.0)[0] for _, part in rows.groupby("tile")])
    got = presence.lock_history(spark.createDataFrame(rows, "tile long, event_id long, kind string, client string, at double"), 20.0)
    key = lambda r: r[1]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(whole.itertuples(index=False, name=None), key=key)


def test_touches_of_the_circle_count_as_entries(spark):
    from terrasurvey.operators import ordered

    path = spark.createDataFrame([("r", 0, 0.0, 0.0), ("r", 1, 10.0, 0.0), ("r", 2, 10.0, 10.0)], "route_id string, at int, x double, y double")
    targets = spark.createDataFrame([("touch", 5.0, 2.0), ("out", 5.0, 2.001), ("end", 12.0, 12.0), ("tip", 10.0, 12.0), ("on", 0.0, 2.0)], "target_id string, x double, y double")
    got = {r.target_id: round(r.distance_m, 6) for r in ordered.first_entry(path, targets).collect()}
    assert got == {"touch": 5.0, "tip": 20.0, "on": 0.0}
