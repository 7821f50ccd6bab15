import json
import math

import pytest
from pyspark.sql import functions as F

from geoloom.functions import catalogue, crs, names
from geoloom.functions import geometry as G


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    ("name", "most", "want"),
    [
        ("a b", 255, "a_b"), ("", 255, "unnamed"), (None, 255, "unnamed"), ("__", 255, "unnamed"), ("a//b??c", 255, "a_b_c"), (" x ", 255, "x"),
        ("a" * 70, 63, "a" * 63), ("a" * 62 + " b", 63, "a" * 62), ("naïve.tif", 255, "naïve.tif"), ("(1)[2]{3}", 255, "1_2_3"), ("a`b~c", 255, "a_b_c"),
    ],
)
def test_sanitized(spark, name, most, want):
    assert one(spark, names.sanitized(F.lit(name).cast("string"), most))[0] == want


def test_paths(spark):
    path = F.lit("dir.d/a.b.tar.gz")
    assert tuple(one(spark, names.basename(path), names.extension(path), names.stem(path), names.restore_folder(path))) == ("a.b.tar.gz", ".gz", "dir.d/a.b.tar", "dir.d/a.b.tar_files")
    assert one(spark, names.extension(F.lit("x/.hidden")))[0] == ""
    assert one(spark, names.relative_to(F.lit("/root/a/b.txt"), "/root/"))[0] == "a/b.txt"


def test_sources(spark):
    cls = lambda s: one(spark, names.source_class(F.lit(s).cast("string")))[0]
    assert [cls(s) for s in ("", None, "wms:x", "https://h", "/a/b.gpkg|layername=x", "postgis:")] == ["scratch", "scratch", "remote", "remote", "file", "remote"]
    path = lambda s: one(spark, names.source_path(F.lit(s), "/p/"))[0]
    assert [path(s) for s in ("/a/b.shp|x", "b.shp", "./b.shp", "GPKG:/a/c.gpkg:roads", "http://x", "")] == ["/a/b.shp", "/p/b.shp", "/p/b.shp", "/a/c.gpkg", None, None]


def test_addresses_types_uris(spark):
    address = lambda p, n: one(spark, names.layer_address(F.lit(p), F.lit(n)))[0]
    assert address("/a.gpkg", "roads") == "/a.gpkg|layername=roads"
    assert address("/a.gpkg", 'my "x"') == '/a.gpkg|layername="my ""x"""'
    assert address("/a.gpkg", "") == "/a.gpkg"
    kinds = [one(spark, names.entry_type(F.lit(n)))[0] for n in ("project.qgs", "manifest.json", "layer_tree.json", "vectors/a.qml", "raster/x", "a.sld", "b")]
    assert kinds == ["project", "manifest", "arcpy", "vector", "raster", "style", "resource"]
    assert one(spark, names.from_bundle_uri(names.to_bundle_uri(F.lit("a/b"))), names.from_bundle_uri(F.lit("x://a")))[:] == ("a/b", None)
    assert one(spark, names.text_like(F.lit("a.GeoJSON")), names.text_like(F.lit("a.png")))[:] == (True, False)


def test_template(spark):
    made = names.from_template("{layer_name} {date} {time} {crs} {datetime}", F.lit("my roads"), F.lit("EPSG:4326"), F.to_timestamp(F.lit("2024-01-02 03:04:05")))
    assert one(spark, made)[0] == "my_roads_2024-01-02_030405_EPSG_4326_2024-01-02_030405"
    assert one(spark, names.from_template("  ", F.lit("a"), F.lit(""), F.current_timestamp()))[0] == "a"


def test_projections(spark):
    x, y = one(spark, *crs.reprojected(F.lit(9.0), F.lit(48.0), 4326, 32632))
    # The central meridian: false easting; the northing is the scaled meridian arc.
    assert x == pytest.approx(500000.0, abs=1e-6) and y == pytest.approx(5316300.0, abs=1500)
    for lon, lat in ((6.2, 1.0), (11.9, 60.0), (9.5, -45.0)):
        srid = 32632 if lat > 0 else 32732
        back = crs.reprojected(*crs.reprojected(F.lit(lon), F.lit(lat), 4326, srid), srid, 4326)
        assert tuple(one(spark, *back)) == pytest.approx((lon, lat), abs=1e-8)  # a millimetre
    x, y = one(spark, *crs.reprojected(F.lit(180.0), F.lit(45.0), 4326, 3857))
    assert (x, y) == pytest.approx((20037508.342789244, 5621521.486192066), abs=1e-6)
    assert one(spark, crs.reprojected(F.lit(0.0), F.lit(90.0), 4326, 3857)[1])[0] is None
    with pytest.raises(ValueError, match="not supported"):
        crs.reprojected(F.lit(0.0), F.lit(0.0), 4326, 2154)


def test_geometry(spark):
    p = lambda x, y: G.point(F.lit(x), F.lit(y))
    square = F.array(p(0, 0), p(4, 0), p(4, 4), p(0, 4), p(0, 0))
    hole = F.array(p(1, 1), p(2, 1), p(2, 2), p(1, 2), p(1, 1))
    polygon = G.geometry("Polygon", 4326, F.array(square, hole))
    assert tuple(one(spark, G.area(polygon), G.perimeter(polygon), G.length(polygon), G.num_geometries(polygon))) == (15.0, 20.0, 0.0, 1)
    line = G.make_line(F.array(p(0, 0), p(3, 4), p(3, 10)))
    assert tuple(one(spark, G.length(line), G.area(line))) == (11.0, 0.0)
    c = one(spark, G.centroid(G.make_box(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(6.0))).alias("c")).c
    assert (c.x, c.y) == (1.0, 3.0)
    c = one(spark, G.centroid(line).alias("c")).c
    assert (c.x, c.y) == pytest.approx(((1.5 * 5 + 3 * 6) / 11, (2 * 5 + 7 * 6) / 11))
    point = G.make_point(F.lit(1.0), F.lit(2.0))
    ring = one(spark, G.area(G.point_buffer(point, F.lit(2.0), 64)))[0]
    assert ring == pytest.approx(0.5 * 64 * 4 * math.sin(2 * math.pi / 64))
    assert one(spark, G.point_buffer(line, F.lit(1.0)))[0] is None
    assert one(spark, G.wkt(point), G.wkt(line))[:] == ("POINT (1.0 2.0)", "LINESTRING (0.0 0.0, 3.0 4.0, 3.0 10.0)")
    forced = one(spark, G.forced_z(point).alias("g"), G.forced_multi(point).alias("m"))
    assert forced.g.parts[0].rings[0][0].z == 0.0 and forced.g.has_z and forced.m.gtype == "MultiPoint"
    box = G.make_box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    ring_line = G.as_type(box, "LineString")
    assert one(spark, G.length(ring_line), G.area(G.as_type(ring_line, "Polygon")), G.as_type(point, "Polygon"), G.as_type(polygon, "LineString"))[:] == (4.0, 1.0, None, None)


def test_catalogue(spark):
    catalogue.register(spark)
    row = spark.sql(
        "SELECT title('ab cd'), regexp_match('abc', 'b'), natural_log(1.0D), to_int('2.7'), to_int('x'), to_real('1e3'), to_text(5), as_date('2024-02-30'), as_datetime('2024-01-02 03:04:05'), "
        "age(TIMESTAMP '2024-01-03 00:00:00', TIMESTAMP '2024-01-01 00:00:00')"
    ).first()
    assert row[:8] == ("Ab Cd", True, 0.0, 2, None, 1000.0, "5", None) and row[8].hour == 3 and row[9].days == 2


def test_texts_of_all_shapes(spark):
    p = lambda x, y: G.point(F.lit(x), F.lit(y))
    box = lambda a: G.make_box(F.lit(a), F.lit(0.0), F.lit(a + 1), F.lit(1.0))
    line, dot = G.make_line(F.array(p(0, 0), p(1, 2))), G.make_point(F.lit(1.0), F.lit(2.0))
    many = lambda kind, *g: g[0].withField("gtype", F.lit(kind)).withField("parts", F.concat(*[x["parts"] for x in g]))
    ring = lambda a: f"(({a}.0 0.0, {a + 1}.0 0.0, {a + 1}.0 1.0, {a}.0 1.0, {a}.0 0.0))"
    wanted = {
        "MULTIPOINT ((1.0 2.0), (1.0 2.0))": many("MultiPoint", dot, dot), "MULTILINESTRING ((0.0 0.0, 1.0 2.0), (0.0 0.0, 1.0 2.0))": many("MultiLineString", line, line),
        f"MULTIPOLYGON ({ring(0)}, {ring(5)})": many("MultiPolygon", box(0.0), box(5.0)),
        f"GEOMETRYCOLLECTION (POLYGON {ring(0)}, POINT (1.0 2.0), LINESTRING (0.0 0.0, 1.0 2.0))": many("GeometryCollection", box(0.0), dot, line),
        "POINT Z (1.0 2.0 0.0)": G.forced_z(dot), "MULTIPOINT ((1.0 2.0)) ".strip(): G.forced_multi(dot),
    }
    assert list(one(spark, *[G.wkt(g) for g in wanted.values()])) == list(wanted)
    shapes = [json.loads(t) for t in one(spark, *[G.geojson(g) for g in wanted.values()])]
    square = lambda a: [[[a, 0], [a + 1, 0], [a + 1, 1], [a, 1], [a, 0]]]
    assert [s.get("coordinates") for s in shapes] == [[[1, 2], [1, 2]], [[[0, 0], [1, 2]], [[0, 0], [1, 2]]], [square(0), square(5)], None, [1, 2, 0], [[1, 2]]]
    assert [g["coordinates"] for g in shapes[3]["geometries"]] == [square(0), [1, 2], [[0, 0], [1, 2]]]
    assert tuple(one(spark, *G.box(many("MultiPolygon", box(0.0), box(5.0))).values())) == (0.0, 0.0, 6.0, 1.0)
    assert one(spark, G.wkt(F.lit(None).cast(G.GEOM_TYPE)), G.geojson(F.lit(None).cast(G.GEOM_TYPE)))[:] == (None, None)


def test_filter_texts(spark):
    sql = catalogue.spark_sql
    assert sql("\"pop\" > 10 AND $area >= 2") == "`pop` > 10 AND area(geom) >= 2"
    assert sql("attribute($currentfeature, 'my name') = 'it''s'") == r"`my name` = 'it\'s'"
    assert sql("to_date('2024-01-01') < now() AND length($geometry) > 3 AND length(name) > 2 AND name LIKE '$x%'") == "as_date('2024-01-01') < now() AND line_length(geom) > 3 AND length(name) > 2 AND name LIKE '$x%'"
    with pytest.raises(ValueError, match="unknown variable"):
        sql("$nothing = 1")


def test_measures_as_sql_functions(spark):
    catalogue.register(spark)
    p = lambda x, y: G.point(F.lit(x), F.lit(y))
    square, hole = F.array(p(0, 0), p(4, 0), p(4, 4), p(0, 4), p(0, 0)), F.array(p(1, 1), p(2, 1), p(2, 2), p(1, 2), p(1, 1))
    shapes = spark.range(1).select(
        G.geometry("Polygon", 4326, F.array(square, hole)).alias("poly"), G.make_line(F.array(p(0, 0), p(3, 4), p(3, 10))).alias("line"), G.make_point(F.lit(1.0), F.lit(2.0)).alias("dot")
    )
    for g in ("poly", "line", "dot"):
        c = G.centroid(F.col(g))
        row = shapes.select(
            F.expr(f"area({g})"), G.area(F.col(g)), F.expr(f"perimeter({g})"), G.perimeter(F.col(g)), F.expr(f"line_length({g})"), G.length(F.col(g)),
            F.expr(f"centroid({g}).x"), c["x"], F.expr(f"centroid({g}).y"), c["y"], F.expr(f"num_geometries({g})"), G.num_geometries(F.col(g)),
            F.expr(f"area(buffer({g}, 2))"), G.area(G.point_buffer(F.col(g), F.lit(2.0))),
        ).first()
        assert row[0::2] == pytest.approx(row[1::2]), g
    assert shapes.selectExpr("point_x(dot)", "point_y(dot)", "point_x(line)").first()[:] == (1.0, 2.0, None)
