"""Well-known text by column expressions: rings as arrays of points, lengths and areas as folds. No Python in the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, and the rest; SRID and dimension marks are left aside.
_HEAD = r"^\s*(?:SRID=\d+;)?\s*([A-Za-z]+?)\s*(?:ZM|Z|M)?\s*\(.*\)\s*$"
#: A ring, and the brackets before it: the first ring of a polygon has some.
_RING = r"(\(*)\(([^()]*)\)"


def kind(c: str) -> Column:
    """POINT, POLYGON, ...; empty for other texts."""
    return F.upper(F.regexp_extract(c, f"(?s){_HEAD}", 1))


def rings(c: str) -> Column:
    """array<struct<outer, points>>: each ring, whether it begins a polygon, and its points; a point that is no pair of numbers is null."""
    number = lambda p, i: F.get(p, F.lit(i)).try_cast("double")

    def point(text: Column) -> Column:
        p = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
        x, y = number(p, 0), number(p, 1)
        return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))

    parts = lambda i: F.regexp_extract_all(c, F.lit(_RING), F.lit(i))
    return F.zip_with(parts(1), parts(2), lambda before, body: F.struct((before != "").alias("outer"), F.transform(F.split(body, ","), point).alias("points")))


def _steps(points: Column) -> Column:
    """Each point of a ring with the next one, both from the ring's first point (o)."""
    o = F.get(points, F.lit(0))
    off = lambda p: F.struct((p["x"] - o["x"]).alias("x"), (p["y"] - o["y"]).alias("y"))
    n = F.greatest(F.size(points) - 1, F.lit(0))
    return F.zip_with(F.slice(points, 1, n), F.slice(points, 2, n), lambda a, b: F.struct(off(a).alias("a"), off(b).alias("b")))


def _total(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda sum_, e: sum_ + value(e))


def _middle(x: Column, y: Column, weight: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), weight.alias("w"))


def _line(ring: Column) -> Column:
    """Middle of a line by length."""
    steps, o = _steps(ring["points"]), F.get(ring["points"], F.lit(0))
    length = lambda s: F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"])
    whole = _total(steps, length)
    at = lambda c: o[c] + F.coalesce(F.try_divide(_total(steps, lambda s: (s["a"][c] + s["b"][c]) / 2 * length(s)), whole), F.lit(0.0))
    return _middle(at("x"), at("y"), whole)


def _area(ring: Column) -> Column:
    """Centroid of a ring by area; a hole's area is taken off."""
    steps, o = _steps(ring["points"]), F.get(ring["points"], F.lit(0))
    cross = lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
    twice = _total(steps, cross)
    at = lambda c: o[c] + F.coalesce(F.try_divide(_total(steps, lambda s: (s["a"][c] + s["b"][c]) * cross(s)), 3 * twice), F.lit(0.0))
    return _middle(at("x"), at("y"), F.abs(twice) / 2 * F.when(ring["outer"], 1.0).otherwise(-1.0))


def with_centroid(df: DataFrame, wkt: str = "geometry") -> DataFrame:
    """df with centroid_lon and centroid_lat of its WKT column.

    POINT and MULTIPOINT: the mean; lines: by length; polygons: by area, holes
    taken off; without length or area the mean of all points. Null for null,
    bad, empty or unknown geometry.
    """
    df = df.withColumns({"__kind": kind(wkt), "__rings": rings(wkt)})
    points = F.flatten(F.transform("__rings", lambda r: r["points"]))
    good = (F.size("__rings") > 0) & F.forall(points, lambda p: p.isNotNull())
    parts = (
        F.when(F.col("__kind").isin("LINESTRING", "MULTILINESTRING"), F.transform("__rings", _line)).when(F.col("__kind").isin("POLYGON", "MULTIPOLYGON"), F.transform("__rings", _area))
        .when(F.col("__kind").isin("POINT", "MULTIPOINT"), F.array().cast("array<struct<x:double,y:double,w:double>>"))
    )
    df = df.withColumns({"__points": F.when(good, points), "__parts": F.when(good, parts)})
    weight = _total(F.col("__parts"), lambda p: p["w"])
    df = df.withColumn("__weight", weight)

    def middle(c: str) -> Column:
        by_weight = _total(F.col("__parts"), lambda p: F.when(p["w"] != 0, p[c] * p["w"]).otherwise(0.0)) / F.col("__weight")
        return F.when(F.col("__weight") != 0, by_weight).when(F.col("__parts").isNotNull(), _total(F.col("__points"), lambda p: p[c]) / F.size("__points"))

    return df.withColumns({"centroid_lon": middle("x"), "centroid_lat": middle("y")}).drop("__kind", "__rings", "__points", "__parts", "__weight")
