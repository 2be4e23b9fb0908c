"""Text functions of the survey as Spark columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks, and the letters without them.
MARKED = "àáâãäåāăąçćĉčďđèéêëēĕęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöøōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżžșț"
PLAIN = "aaaaaaaaaccccddeeeeeeeegggghiiiiiiiijklllnnnnooooooooorrrssssttuuuuuuuuuuwyyyzzzst"


def grid_place(name: Column) -> Column:
    """struct<row, col> of a tile name ..._r003_c012; null without one."""
    row, col = (F.nullif(F.regexp_extract(name, r"_r(\d+)_c(\d+)", i), F.lit("")).cast("int") for i in (1, 2))
    return F.struct(row.alias("row"), col.alias("col"))


def parse_points(text: Column) -> Column:
    """'x,y;x,y' as an array of points."""
    parts = F.filter(F.split(text, ";"), lambda p: F.trim(p) != "")
    return F.transform(parts, lambda p: F.struct(F.split(p, ",")[0].cast("double").alias("x"), F.split(p, ",")[1].cast("double").alias("y")))


def format_points(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.format_string("%.2f,%.2f", p["x"], p["y"])), ";")


def slug(name: Column, most: int = 32) -> Column:
    """Lower-case letters and digits with single hyphens between, at most `most` characters; 'vineyard' if nothing is left."""
    plain = F.translate(F.lower(name), MARKED, PLAIN)
    s = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, most), F.lit("")), F.lit("vineyard"))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def quote_literal(text: Column) -> Column:
    return F.replace(text, F.lit("'"), F.lit("''"))


def read_hectares(text: Column) -> Column:
    """The first number of a text, with a decimal comma or point; null if there is none."""
    return F.try_to_number(F.nullif(F.regexp_extract(F.replace(text, F.lit(","), F.lit(".")), r"(\d+(?:\.\d+)?)", 1), F.lit("")), F.lit("999999999999.9999")).cast("double")


def read_coordinates(text: Column) -> Column:
    """struct<kind, a, b> of two numbers in a text: 'geographic' (lat, lon), 'utm' (east, north), or null."""
    clean = F.regexp_replace(F.regexp_replace(text, r"[°NnEe]", " "), r"(\d),(\d)", "$1.$2")
    numbers = F.transform(F.regexp_extract_all(clean, F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))
    a, b = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
    kind = F.when((F.abs(a) <= 90) & (F.abs(b) <= 180), "geographic").when(a.between(100_000, 900_000) & b.between(0, 10_000_000), "utm")
    return F.when((F.size(numbers) == 2) & kind.isNotNull(), F.struct(kind.alias("kind"), a.alias("a"), b.alias("b")))


def is_cadastral(number: Column) -> Column:
    return number.rlike(r"^\d{10,11}$")


def report_number(survey: Column, at: Column) -> Column:
    return F.concat(F.lit("VIN-"), F.upper(survey), F.lit("-"), F.date_format(at, "yyyyMMdd"), F.lit("-"), F.date_format(at, "HHmm"))


def duration(minutes: Column) -> Column:
    """'1 h 05 min', or '45 min' below an hour."""
    m = F.round(minutes).cast("int")
    return F.when(m < 60, F.concat(m.cast("string"), F.lit(" min"))).otherwise(F.format_string("%d h %02d min", F.floor(m / 60).cast("int"), m % 60))


def walking_minutes(metres: Column, kmh) -> Column:
    return metres / 1000 / kmh * 60


def hectares(area_m2: Column) -> Column:
    return F.round(area_m2 / 10_000, 4)


def scale_bar(span: Column) -> Column:
    """The largest of the usual lengths that is at most a quarter of the span, else the least."""
    steps = F.array(*[F.lit(float(x)) for x in (10, 20, 50, 100, 200, 500, 1000)])
    return F.coalesce(F.array_max(F.filter(steps, lambda s: s <= span / 4)), F.lit(10.0))


def mean_axis(angle: Column) -> Column:
    """The mean of axes in degrees, 0 to 180, by doubled angles; an aggregate expression."""
    return F.pmod(F.degrees(F.atan2(F.sum(F.sin(2 * F.radians(angle))), F.sum(F.cos(2 * F.radians(angle))))) / 2, F.lit(180.0))


def whole(number: Column) -> Column:
    """A whole number with groups of three, as in British English."""
    return F.format_number(F.round(number), 0)


def square_metres(area: Column) -> Column:
    return F.concat(whole(area), F.lit(" m²"))


def metres(length: Column) -> Column:
    return F.concat(whole(length), F.lit(" m"))


def hectares_text(area_m2: Column) -> Column:
    return F.concat(F.format_number(F.round(area_m2 / 10_000, 2), 2), F.lit(" ha"))


def quantity(count: Column, one: str, many: str) -> Column:
    return F.concat(whole(count), F.lit(" "), F.when(count == 1, one).otherwise(many))


def percent(ratio: Column) -> Column:
    return F.concat(F.format_number(F.round(ratio * 100, 1), 1), F.lit("%"))
