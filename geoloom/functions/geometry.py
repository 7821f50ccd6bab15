"""Geometry as a struct of parts, rings and points, with measures as higher-order expressions.

geom: struct<gtype, srid, has_z, parts: array<struct<kind, rings: array<array<struct<x,y,z>>>>>>. Filters belong on the
plain bounding-box columns; these expressions run per row after them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT_TYPE = "struct<x:double,y:double,z:double>"
GEOM_TYPE = f"struct<gtype:string,srid:int,has_z:boolean,parts:array<struct<kind:string,rings:array<array<{POINT_TYPE}>>>>>"


def point(x: Column, y: Column, z: Column | None = None) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), (F.lit(None) if z is None else z).cast("double").alias("z"))


def geometry(gtype: str, srid: int, rings: Column, has_z: bool = False) -> Column:
    """A geometry of one part from its rings (array of arrays of points)."""
    part = F.struct(F.lit(gtype).alias("kind"), rings.alias("rings"))
    return F.struct(F.lit(gtype).alias("gtype"), F.lit(srid).alias("srid"), F.lit(has_z).alias("has_z"), F.array(part).alias("parts")).cast(GEOM_TYPE)


def make_point(x: Column, y: Column, srid: int = 4326) -> Column:
    return geometry("Point", srid, F.array(F.array(point(x, y))))


def make_line(points: Column, srid: int = 4326) -> Column:
    return geometry("LineString", srid, F.array(points))


def make_box(xmin: Column, ymin: Column, xmax: Column, ymax: Column, srid: int = 4326) -> Column:
    ring = F.array(point(xmin, ymin), point(xmax, ymin), point(xmax, ymax), point(xmin, ymax), point(xmin, ymin))
    return geometry("Polygon", srid, F.array(ring))


def _segments(ring: Column, term) -> Column:
    """Sum of term(a, b) over neighbouring points of a ring."""
    ends = F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0)))
    starts = F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))
    return F.aggregate(F.zip_with(starts, ends, term), F.lit(0.0), lambda a, v: a + v)


def _cross(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - b["x"] * a["y"]


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))


def _over_parts(geom: Column, kinds: tuple[str, ...], value) -> Column:
    """Sum of value(part) over the parts of the given kinds."""
    chosen = F.filter(geom["parts"], lambda p: p["kind"].isin(*kinds))
    return F.aggregate(F.transform(chosen, value), F.lit(0.0), lambda a, v: a + v)


def area(geom: Column) -> Column:
    """Planar; holes (all rings but the first) are taken off."""

    def of_part(part: Column) -> Column:
        sizes = F.transform(part["rings"], lambda ring, i: F.when(i == 0, 1.0).otherwise(-1.0) * F.abs(_segments(ring, _cross)) / 2)
        return F.aggregate(sizes, F.lit(0.0), lambda a, v: a + v)

    return _over_parts(geom, ("Polygon",), of_part)


def _ring_lengths(part: Column) -> Column:
    return F.aggregate(F.transform(part["rings"], lambda ring: _segments(ring, _distance)), F.lit(0.0), lambda a, v: a + v)


def length(geom: Column) -> Column:
    return _over_parts(geom, ("LineString",), _ring_lengths)


def perimeter(geom: Column) -> Column:
    return _over_parts(geom, ("Polygon",), _ring_lengths)


def num_geometries(geom: Column) -> Column:
    return F.size(geom["parts"])


def centroid(geom: Column) -> Column:
    """By area for polygons (outer rings), by length for lines, the mean for points: struct<x, y>."""
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def weigh(points: Column, term) -> Column:
        ends = F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0)))
        starts = F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0)))
        return F.zip_with(starts, ends, term)

    def polygon(a: Column, b: Column) -> Column:
        w = _cross(a, b)
        return F.struct(w.alias("w"), (w * (a["x"] + b["x"]) / 3).alias("x"), (w * (a["y"] + b["y"]) / 3).alias("y"))

    def line(a: Column, b: Column) -> Column:
        w = _distance(a, b)
        return F.struct(w.alias("w"), (w * (a["x"] + b["x"]) / 2).alias("x"), (w * (a["y"] + b["y"]) / 2).alias("y"))

    kind = F.regexp_replace(geom["gtype"], "^Multi", "")
    of_polygon = F.flatten(F.transform(geom["parts"], lambda p: weigh(F.get(p["rings"], 0), polygon)))
    of_line = F.flatten(F.transform(geom["parts"], lambda p: F.flatten(F.transform(p["rings"], lambda r: weigh(r, line)))))
    of_point = F.flatten(
        F.transform(geom["parts"], lambda p: F.transform(F.flatten(p["rings"]), lambda q: F.struct(F.lit(1.0).alias("w"), q["x"].alias("x"), q["y"].alias("y"))))
    )
    terms = F.when(kind == "Polygon", of_polygon).when(kind == "LineString", of_line).otherwise(of_point)
    total = F.aggregate(
        terms, zero, lambda a, v: F.struct((a["w"] + v["w"]).alias("w"), (a["x"] + v["x"]).alias("x"), (a["y"] + v["y"]).alias("y"))
    )
    return F.struct((total["x"] / F.nullif(total["w"], F.lit(0.0))).alias("x"), (total["y"] / F.nullif(total["w"], F.lit(0.0))).alias("y"))


def point_buffer(geom: Column, distance: Column, sides: int = 32) -> Column:
    """A regular polygon around a point; null for lines and polygons, which would need a geometry solver."""
    centre = F.get(F.get(F.get(geom["parts"], 0)["rings"], 0), 0)
    ring = F.transform(
        F.sequence(F.lit(0), F.lit(sides)),
        lambda i: point(
            centre["x"] + distance * F.cos(2 * F.pi() * (i % sides) / sides), centre["y"] + distance * F.sin(2 * F.pi() * (i % sides) / sides)
        ),
    )
    return F.when(geom["gtype"] == "Point", geometry("Polygon", 0, F.array(ring)).withField("srid", geom["srid"]))


def forced_z(geom: Column) -> Column:
    """z = 0 where it is missing."""
    parts = F.transform(
        geom["parts"],
        lambda p: F.struct(
            p["kind"].alias("kind"),
            F.transform(p["rings"], lambda r: F.transform(r, lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"), F.coalesce(q["z"], F.lit(0.0)).alias("z")))).alias("rings"),
        ),
    )
    return F.struct(geom["gtype"].alias("gtype"), geom["srid"].alias("srid"), F.lit(True).alias("has_z"), parts.alias("parts"))


def forced_multi(geom: Column) -> Column:
    plain = geom["gtype"].isin("Point", "LineString", "Polygon")
    return geom.withField("gtype", F.when(plain, F.concat(F.lit("Multi"), geom["gtype"])).otherwise(geom["gtype"]))


def as_type(geom: Column, gtype: str) -> Column:
    """`geom` as another type where that is a legal change, else null (the caller puts such rows aside):
    the same type, a polygon's outer ring as a line, a closed line as a polygon, anything as a collection."""
    ring = F.get(F.get(geom["parts"], 0)["rings"], 0)
    single = F.size(geom["parts"]) == 1
    closed = (F.size(ring) >= 4) & (F.get(ring, 0) == F.element_at(ring, -1))
    if gtype == "GeometryCollection":
        return geom.withField("gtype", F.lit(gtype))
    made = F.when(geom["gtype"] == gtype, geom)
    kind = lambda: F.transform(geom["parts"], lambda p: F.struct(F.lit(gtype).alias("kind"), p["rings"].alias("rings")))
    if gtype == "LineString":
        made = made.when((geom["gtype"] == "Polygon") & single & (F.size(F.get(geom["parts"], 0)["rings"]) == 1), geom.withField("gtype", F.lit(gtype)).withField("parts", kind()))
    if gtype == "Polygon":
        made = made.when((geom["gtype"] == "LineString") & single & closed, geom.withField("gtype", F.lit(gtype)).withField("parts", kind()))
    return made


def _by_kind(kind: Column, point: Column, line: Column, polygon: Column) -> Column:
    return F.when(kind == "Point", point).when(kind == "LineString", line).when(kind == "Polygon", polygon)


def _joined(parts: Column, one) -> Column:
    return F.array_join(F.transform(parts, one), ", ")


def wkt(geom: Column) -> Column:
    """Well-known text of all parts; with has_z each vertex has three numbers."""
    z = F.when(geom["has_z"], " Z").otherwise("")

    def vertex(q: Column) -> Column:
        plain = F.concat_ws(" ", q["x"].cast("string"), q["y"].cast("string"))
        return F.when(geom["has_z"], F.concat_ws(" ", plain, F.coalesce(q["z"], F.lit(0.0)).cast("string"))).otherwise(plain)

    ring = lambda r: F.concat(F.lit("("), _joined(r, vertex), F.lit(")"))
    first = lambda p: ring(F.get(p["rings"], 0))
    rings = lambda p: F.concat(F.lit("("), _joined(p["rings"], ring), F.lit(")"))
    body = lambda p: _by_kind(p["kind"], first(p), first(p), rings(p))
    tagged = lambda p: F.concat(F.upper(p["kind"]), z, F.lit(" "), body(p))
    multi = F.concat(F.upper(geom["gtype"]), z, F.lit(" ("), _joined(geom["parts"], body), F.lit(")"))
    return (
        F.when(geom["gtype"] == "GeometryCollection", F.concat(F.lit("GEOMETRYCOLLECTION"), z, F.lit(" ("), _joined(geom["parts"], tagged), F.lit(")")))
        .when(geom["gtype"].startswith("Multi"), multi)
        .otherwise(tagged(F.get(geom["parts"], 0)))
    )


def geojson(geom: Column) -> Column:
    """A geometry as JSON text, coordinates nested as its type asks."""

    def vertex(q: Column) -> Column:
        plain = F.array(q["x"], q["y"])
        return F.when(geom["has_z"], F.array(q["x"], q["y"], F.coalesce(q["z"], F.lit(0.0)))).otherwise(plain)

    line = lambda r: F.to_json(F.transform(r, vertex))
    ring = lambda p: F.get(p["rings"], 0)
    polygon = lambda p: F.to_json(F.transform(p["rings"], lambda r: F.transform(r, vertex)))
    coordinates = lambda p: _by_kind(p["kind"], F.to_json(vertex(F.get(ring(p), 0))), line(ring(p)), polygon(p))
    shape = lambda kind, inner: F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), inner, F.lit("}"))
    listed = lambda one: F.concat(F.lit("["), F.array_join(F.transform(geom["parts"], one), ","), F.lit("]"))
    part = F.get(geom["parts"], 0)
    return (
        F.when(geom["gtype"] == "GeometryCollection", F.concat(F.lit('{"type":"GeometryCollection","geometries":'), listed(lambda p: shape(p["kind"], coordinates(p))), F.lit("}")))
        .when(geom["gtype"].startswith("Multi"), shape(geom["gtype"], listed(coordinates)))
        .otherwise(shape(geom["gtype"], coordinates(part)))
    )


def vertices(geom: Column) -> Column:
    """All points of all rings of all parts."""
    return F.flatten(F.flatten(F.transform(geom["parts"], lambda p: p["rings"])))


def box(geom: Column) -> dict[str, Column]:
    """xmin, ymin, xmax, ymax of the vertices."""
    x, y = F.transform(vertices(geom), lambda q: q["x"]), F.transform(vertices(geom), lambda q: q["y"])
    return {"xmin": F.array_min(x), "ymin": F.array_min(y), "xmax": F.array_max(x), "ymax": F.array_max(y)}
