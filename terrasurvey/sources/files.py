"""Readers and writers of the survey's files: GeoJSON, annotation XML, GeoTIFF headers, image folders and layers."""

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g

#: The contract of a tile.
EPSG, SIZE, METRES, SLACK = 32635, 2048, 0.025, 0.0005

#: TIFF field types (bytes, struct code) and the tags that are read.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 12: (8, "d"), 16: (8, "Q")}
WIDTH, HEIGHT, BITS, BANDS, PIXEL_SCALE, TIE_POINT, TRANSFORM, GEO_KEYS, PROJECTED, GEOGRAPHIC = 256, 257, 258, 277, 33550, 33922, 34264, 34735, 3072, 2048

HEADER = "name string, ok boolean, error string, width int, height int, bands int, epsg int, transform array<double>, bounds array<double>"


def tile_header(content: bytes, check: bool = True) -> dict:
    """A GeoTIFF's size, projection, transform (a, b, c, d, e, f) and bounds, or the rule it breaks, by name."""
    out: dict = dict.fromkeys(("error", "width", "height", "bands", "epsg", "transform", "bounds")) | {"ok": False}
    try:
        order = {b"II": "<", b"MM": ">"}[content[:2]]
        if struct.unpack_from(order + "H", content, 2)[0] != 42:
            raise KeyError
        tags = {}
        at = struct.unpack_from(order + "I", content, 4)[0]
        for i in range(struct.unpack_from(order + "H", content, at)[0]):
            tag, kind, n = struct.unpack_from(order + "HHI", content, at + 2 + 12 * i)
            if kind not in TYPES:
                continue
            size, code = TYPES[kind]
            place = at + 10 + 12 * i if size * n <= 4 else struct.unpack_from(order + "I", content, at + 10 + 12 * i)[0]
            tags[tag] = content[place : place + n] if code == "s" else struct.unpack_from(f"{order}{n * len(code)}{code[0]}", content, place)
    except (KeyError, struct.error):
        return out | {"error": "not_a_tiff"}
    out |= {"width": tags.get(WIDTH, (None,))[0], "height": tags.get(HEIGHT, (None,))[0], "bands": tags.get(BANDS, (1,))[0]}
    keys = tags.get(GEO_KEYS, ())
    named = {int(keys[i]): int(keys[i + 3]) for i in range(4, len(keys) - 3, 4)}
    out["epsg"] = named.get(PROJECTED, named.get(GEOGRAPHIC))
    if check and out["epsg"] != EPSG:
        return out | {"error": "wrong_crs"}
    if check and not out["width"] == out["height"] == SIZE:
        return out | {"error": "wrong_size"}
    if TRANSFORM in tags and len(tags[TRANSFORM]) >= 8:
        m = tags[TRANSFORM]
        t = [m[0], m[1], m[3], m[4], m[5], m[7]]
    elif PIXEL_SCALE in tags and TIE_POINT in tags:
        (sx, sy), (i, j, _, x, y) = tags[PIXEL_SCALE][:2], tags[TIE_POINT][:5]
        t = [sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy]
    else:
        return out | {"error": "no_georeference"}
    out["transform"] = [float(v) for v in t]
    if out["width"] and out["height"]:
        out["bounds"] = [t[2], t[5] + t[4] * out["height"], t[2] + t[0] * out["width"], t[5]]
    if check:
        rules = (
            ("not_north_up", t[1] == 0 and t[3] == 0 and t[0] > 0 > t[4]),
            ("wrong_resolution", abs(t[0] - METRES) <= SLACK and abs(-t[4] - METRES) <= SLACK),
        )
        broken = next((name for name, holds in rules if not holds), None)
        if broken:
            return out | {"error": broken}
    return out | {"ok": True}


def read_tiles(spark: SparkSession, folder: str, check: bool = True) -> DataFrame:
    """The headers of all tiles of a folder, by name; a file that breaks the contract has ok = false and the rule's name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(folder).select(F.regexp_extract("path", r"([^/]+)\.tif$", 1).alias("name"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [f.split()[0] for f in HEADER.split(", ")]
        for rows in batches:
            yield pd.DataFrame([{"name": n} | tile_header(bytes(c), check) for n, c in zip(rows["name"], rows["content"], strict=True)], columns=columns)

    return files.mapInPandas(run, HEADER)


def safe_tile_name(name) -> object:
    """A tile's name, or an error if it is a path or not a .tif."""
    return F.when(~name.rlike(r"[/\\]") & name.endswith(".tif"), name).otherwise(F.raise_error(F.lit("not a tile name")).cast("string"))


def read_images(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """(path, label, length) of images below a folder; the label is the first folder; with `limit`, so many of each by path."""
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).drop("content").where(F.lower("path").rlike(r"\.(jpg|jpeg|png|tif|tiff)$"))
    inside = F.regexp_replace("path", r"^.*?" + folder.rstrip("/").replace("file://", "") + "/", "")
    out = files.select("path", F.when(F.contains(inside, F.lit("/")), F.split(inside, "/")[0]).otherwise("").alias("label"), "length")
    if limit is None:
        return out
    return out.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("path"))).where(F.col("k") <= limit).drop("k")


FEATURES = "type string, features array<struct<type:string, properties:map<string,string>, geometry:struct<type:string, coordinates:string>>>"


def read_geojson(spark: SparkSession, paths: str) -> DataFrame:
    """(file, base, suffix, position, properties, kind, part, ring, holes): one row for each part of each feature's geometry.

    Unreadable files and features without geometry are skipped. ring: an array of [x, y], of polygons the outer one, of points one position;
    holes: a polygon's inner rings. The base of a file's name is what stands before the first '__'.
    """
    raw = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").schema(FEATURES).json(paths).withColumn("file", F.input_file_name())
    name = F.regexp_extract("file", r"([^/]+)\.geojson$", 1)
    parts = F.split(name, "__", 2)
    f = raw.select("file", parts[0].alias("base"), F.get(parts, F.lit(1)).alias("suffix"), F.posexplode("features").alias("position", "f"))
    c, kind = F.col("f.geometry.coordinates"), F.col("f.geometry.type")
    pts = "array<array<double>>"
    shaped = (
        F.when(kind == "Polygon", F.array(F.from_json(c, f"array<{pts}>")))
        .when(kind == "MultiPolygon", F.from_json(c, f"array<array<{pts}>>"))
        .when(kind == "LineString", F.array(F.array(F.from_json(c, pts))))
        .when(kind == "MultiLineString", F.transform(F.from_json(c, f"array<{pts}>"), lambda line: F.array(line)))
        .when(kind == "Point", F.array(F.array(F.array(F.from_json(c, "array<double>")))))
    )
    rows = f.where(kind.isNotNull()).select("file", "base", "suffix", "position", F.col("f.properties").alias("properties"), kind.alias("kind"), F.posexplode(shaped).alias("part", "rings"))
    rows = rows.withColumn("ring", F.get("rings", F.lit(0))).withColumn("holes", F.slice("rings", 2, F.greatest(F.size("rings") - 1, F.lit(0)))).drop("rings")
    return rows.where(F.size("ring") > 0)


def write_geojson(features: DataFrame, path: str, geometry: str = "LineString") -> None:
    """Features (ring: array of struct<x, y>, properties: map) as one line of JSON each, closed if they are polygons."""
    ring = F.when(F.lit(geometry == "Polygon") & (F.element_at("ring", 1) != F.element_at("ring", -1)), g.close_ring(F.col("ring"))).otherwise(F.col("ring"))
    xy = F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    coordinates = F.array(xy) if geometry == "Polygon" else xy
    row = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(geometry).alias("type"), coordinates.alias("coordinates")).alias("geometry"), "properties")
    features.select(F.to_json(row).alias("value")).write.mode("overwrite").text(path)


SHAPE = "struct<_label:string,_source:string,_occluded:int,_points:string,_z_order:int,_xtl:double,_ytl:double,_xbr:double,_ybr:double,attribute:array<struct<_name:string,_VALUE:string>>>"
IMAGES = f"_id long, _name string, _width int, _height int, polygon array<{SHAPE}>, polyline array<{SHAPE}>, box array<{SHAPE}>"


def read_annotation_xml(spark: SparkSession, path: str) -> DataFrame:
    """(image, tile_name, width, height, shape_type, label, source, occluded, z_order, points, attributes) of an annotation file's shapes.

    Boxes have two points. Elements other than polygons, polylines and boxes are skipped; an attribute without text is ''.
    """
    from ..functions.text import parse_points

    images = spark.read.format("xml").option("rowTag", "image").schema(IMAGES).load(path)
    tag = lambda kind: F.transform(F.coalesce(kind, F.array().cast(f"array<{SHAPE}>")), lambda s: F.struct(F.lit(kind).alias("shape_type"), s.alias("s")))
    tagged = [tag(kind) for kind in ("polygon", "polyline", "box")]
    rows = images.select(F.col("_id").alias("image"), F.col("_name").alias("tile_name"), F.col("_width").alias("width"), F.col("_height").alias("height"), F.explode(F.concat(*tagged)).alias("t"))
    s = F.col("t.s")
    corners = F.array(g.point(s["_xtl"], s["_ytl"]), g.point(s["_xbr"], s["_ybr"]))
    attributes = F.map_from_entries(F.transform(F.coalesce(s["attribute"], F.array().cast("array<struct<_name:string,_VALUE:string>>")), lambda a: F.struct(a["_name"], F.coalesce(a["_VALUE"], F.lit("")))))
    return rows.select("image", "tile_name", "width", "height", "t.shape_type", s["_label"].alias("label"), s["_source"].alias("source"), F.coalesce(s["_occluded"], F.lit(0)).alias("occluded"), F.coalesce(s["_z_order"], F.lit(0)).alias("z_order"), F.when(F.col("t.shape_type") == "box", corners).otherwise(parse_points(s["_points"])).alias("points"), attributes.alias("attributes"))


def write_annotation_xml(shapes: DataFrame, path: str) -> None:
    """Shapes, as read_annotation_xml gives them, as files of <image> elements. All shapes of a tile meet in one row."""
    from ..functions.text import format_points

    def of(kind: str):
        p = F.col("points")
        box = kind == "box"
        return F.when(
            F.col("shape_type") == kind,
            F.struct(
                F.col("label").alias("_label"), F.col("source").alias("_source"), F.col("occluded").alias("_occluded"), (F.lit(None).cast("string") if box else format_points(p)).alias("_points"), F.col("z_order").alias("_z_order"),
                *[(v if box else F.lit(None).cast("double")).alias(n) for n, v in (("_xtl", F.get(p, F.lit(0))["x"]), ("_ytl", F.get(p, F.lit(0))["y"]), ("_xbr", F.get(p, F.lit(1))["x"]), ("_ybr", F.get(p, F.lit(1))["y"]))],
                F.transform(F.map_entries("attributes"), lambda a: F.struct(a["key"].alias("_name"), a["value"].alias("_VALUE"))).alias("attribute"),
            ),
        )

    images = shapes.groupBy(F.col("image").alias("_id"), F.col("tile_name").alias("_name"), F.col("width").alias("_width"), F.col("height").alias("_height")).agg(*[F.array_compact(F.collect_list(of(k))).alias(k) for k in ("polygon", "polyline", "box")])
    images.write.mode("overwrite").format("xml").option("rootTag", "annotations").option("rowTag", "image").save(path)


#: The layers of a survey and the columns they must have.
LAYERS = {
    "blocks": "vineyard_id string, ring array<array<double>>",
    "rows": "vineyard_id string, row_id string, row_structure string, length_m double, line array<array<double>>",
    "canopy": "vineyard_id string, area_m2 double, ring array<array<double>>",
    "interrows": "vineyard_id string, interrow_id string, interrow_cover string, area_m2 double, ring array<array<double>>",
    "waste": "waste_id string, vineyard_id string, reachable boolean, ring array<array<double>>",
    "start": "x double, y double",
}


def read_survey(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The survey's layers; a layer that is missing is an error, never an empty one."""
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in LAYERS.items()}


def write_survey(layers: dict[str, DataFrame], folder: str) -> None:
    """All layers, once all have the columns they must have."""
    for name, schema in LAYERS.items():
        missing = {f.split()[0] for f in schema.split(", ")} - set(layers[name].columns)
        if missing:
            raise ValueError(f"{name} lacks {sorted(missing)}")
    for name in LAYERS:
        layers[name].write.mode("overwrite").parquet(f"{folder}/{name}")


def unzipped(spark: SparkSession, archives: str, folder: str, member: str = ".xml") -> DataFrame:
    """(archive, file): the members of zip files with this ending, written below a shared folder by the tasks that read the archives."""
    import io
    import os
    import zipfile

    raw = spark.read.format("binaryFile").load(archives).select(F.col("path").alias("archive"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for archive, content in zip(rows["archive"], rows["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    for name in sorted(n for n in z.namelist() if n.endswith(member)):
                        path = os.path.join(folder, os.path.basename(archive) + "__" + os.path.basename(name))
                        with open(path + ".part", "wb") as f:
                            f.write(z.read(name))
                        os.replace(path + ".part", path)  # a task that runs again gives the same file
                        out.append((archive, path))
            yield pd.DataFrame(out, columns=["archive", "file"])

    return raw.mapInPandas(run, "archive string, file string")


def read_label_schema(spark: SparkSession, path: str) -> DataFrame:
    """(label, type, attribute, mutable, input_type, default_value, values): the labels that an annotation file declares, a row for each attribute, or one without."""
    attribute = "struct<name:string,mutable:string,input_type:string,default_value:string,values:string>"
    rows = spark.read.format("xml").option("rowTag", "label").schema(f"name string, type string, attributes struct<attribute:array<{attribute}>>").load(path).where("name is not null")
    a = rows.select(F.col("name").alias("label"), F.coalesce("type", F.lit("")).alias("type"), F.explode_outer("attributes.attribute").alias("a"))
    default = lambda field, value: F.when(F.col("a").isNotNull(), F.coalesce(F.col("a")[field], F.lit(value))).alias(field)
    return a.select("label", "type", default("name", "").alias("attribute"), default("mutable", "False"), default("input_type", "text"), default("default_value", ""), default("values", ""))


def read_constraints(spark: SparkSession, folder: str, constraint_set: str, own: str = "siret3") -> dict[str, DataFrame]:
    """The passages, forbidden areas and study area of the set that has them; none for other sets. A missing file is an error."""
    if constraint_set != own:
        return {}
    return {name: read_geojson(spark, f"{folder}/{name}.geojson") for name in ("passages", "forbidden", "study_area")}


def read_parcels(original: DataFrame, edited: DataFrame | None) -> DataFrame:
    """Parcels with `pid`: the edited copy if there is one, else the original; a parcel without a pid is numbered by its place in the file."""
    parcels = original if edited is None else edited
    return parcels.withColumn("pid", F.coalesce(F.try_element_at("properties", F.lit("pid")).cast("long"), F.col("position").cast("long")))


def read_road_areas(spark: SparkSession, path: str, site: int = 0) -> DataFrame | None:
    """Roads as passages (site, label, ring): lines 1.5 m to either side, polygons as they are; None where there is no such file."""
    from pyspark.errors import AnalysisException

    from ..operators.routes import road_areas

    try:
        parts = read_geojson(spark, path)
    except AnalysisException:
        return None
    of = lambda *kinds: parts.where(F.col("kind").isin(*kinds)).withColumn("site", F.lit(site).cast("long"))
    return road_areas(of("LineString", "MultiLineString").withColumnRenamed("ring", "line"), of("Polygon", "MultiPolygon"))


def write_route(route: DataFrame, path: str, stops: DataFrame) -> None:
    """A route (site, points, length_m) as a line with the number of its stops and where it begins and ends."""
    n = stops.groupBy("site").agg(F.count("*").alias("stops"))
    ends = F.create_map(F.lit("length_m"), F.round("length_m", 2).cast("string"), F.lit("stops"), F.col("stops").cast("string"), F.lit("closed"), (F.element_at("points", 1) == F.element_at("points", -1)).cast("string"))
    write_geojson(route.join(n, "site").select(F.col("points").alias("ring"), ends.alias("properties")), path)


def mask_tiff(pixels: bytes, width: int, height: int, transform: list[float], epsg: int) -> bytes:
    """A GeoTIFF of one band of bytes, deflated, with a tile's size, transform (a, b, c, d, e, f) and projection."""
    import zlib

    data = zlib.compress(pixels, 6)
    a, b, c, d, e, f = transform
    entries = [
        (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (259, 3, [8]), (262, 3, [1]), (273, 4, [8]), (BANDS, 3, [1]), (278, 4, [height]), (279, 4, [len(data)]),
        (TRANSFORM, 12, [a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]), (GEO_KEYS, 3, [1, 1, 0, 2, 1024, 0, 1, 1, PROJECTED, 0, 1, epsg]),
    ]
    data += b"\0" * (len(data) % 2)
    at = 8 + len(data)
    values = at + 2 + 12 * len(entries) + 4
    head, tail = b"", b""
    for tag, kind, value in entries:
        size, code = TYPES[kind]
        packed = struct.pack(f"<{len(value)}{code}", *value)
        place = packed.ljust(4, b"\0") if size * len(value) <= 4 else struct.pack("<I", values + len(tail))
        tail += b"" if size * len(value) <= 4 else packed
        head += struct.pack("<HHI", tag, kind, len(value)) + place
    return b"II*\0" + struct.pack("<I", at) + data + struct.pack("<H", len(entries)) + head + b"\0" * 4 + tail


def mask_tiffs(runs: DataFrame, headers: DataFrame) -> DataFrame:
    """(name, content): a mask GeoTIFF for each tile of headers (see read_tiles), painted with runs (name, py, start, end, value). One tile is one group."""
    fields = headers.select("name", "width", "height", "transform", "epsg")

    def run(key, rows: pd.DataFrame, tiles: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        out = []
        for t in tiles.itertuples():
            mask = np.zeros((t.height, t.width), np.uint8)
            for r in rows.itertuples():
                if 0 <= r.py < t.height:
                    mask[r.py, max(0, r.start) : max(0, r.end)] = r.value
            out.append((key[0], mask_tiff(mask.tobytes(), t.width, t.height, list(t.transform), t.epsg)))
        return pd.DataFrame(out, columns=["name", "content"])

    return runs.groupBy("name").cogroup(fields.groupBy("name")).applyInPandas(run, "name string, content binary")


def write_results(layers: dict[str, DataFrame], folder: str) -> None:
    """Each layer as lines of JSON in a folder of its own. A layer's files appear when all of its tasks are done, and a mark of success after them."""
    for name, layer in layers.items():
        layer.write.mode("overwrite").json(f"{folder}/{name}")
