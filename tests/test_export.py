import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions import geometry as G
from geoloom.operators import batch, export, raster, registry, sinks, tree
from geoloom.operators.export import ExportSpec
from geoloom.sources import views
from geoloom.streaming.export import start_export


@pytest.fixture
def layer(spark):
    schema = T.StructType(
        [
            T.StructField("FID", T.LongType()), T.StructField("title", T.StringType(), metadata={"alias": "Heading"}), T.StructField("n", T.StringType()),
            T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()),
        ]
    )
    rows = [(1, "a", "1", 0.0, 0.0), (2, "b", "2.7", 10.0, 10.0), (3, None, "bad", 20.0, -95.0), (4, "d", None, 30.0, 30.0)]
    return spark.createDataFrame(rows, schema)


def test_columns(layer):
    spec = lambda **k: export.exported(layer, ExportSpec("l", "out", **k)).columns
    assert spec() == ["title", "n", "x", "y"]
    assert spec(field_names=("n",)) == ["n", "x", "y"] and spec(field_names=()) == ["x", "y"]
    assert spec(use_aliases=True) == ["Heading", "n", "x", "y"]
    assert spec(use_aliases=True, field_export_names={"title": "t"}) == ["t", "n", "x", "y"]
    assert spec(driver="GeoRSS") == ["title", "x", "y"] and spec(driver="DGN") == ["x", "y"] and spec(skip_attributes=True) == ["x", "y"]
    assert spec(geometry_type="NoGeometry") == ["title", "n"]
    kept = export.exported(layer, ExportSpec("l", "out", include_constraints=True)).schema["title"].metadata
    assert kept == {"alias": "Heading"}


def test_types(layer):
    wide = lambda t, **k: [r.n for r in export.exported(layer, ExportSpec("l", "o", field_types={"n": t}, **k)).orderBy("x").collect()]
    assert wide("Integer") == [1, 2, None, None]
    assert wide("Double") == [1.0, 2.7, None, None] and wide("What") == ["1", "2.7", "bad", None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        wide("Integer", strict_types=True)


def test_rows(spark, layer):
    run = lambda **k: [r.title for r in export.exported(layer, ExportSpec("l", "o", **k), selection=spark.createDataFrame([(2,), (4,)], "FID long").withColumnRenamed("FID", "fid")).orderBy("x").collect()]
    assert run(filter_expression=" ") == ["a", "b", None, "d"]
    assert run(filter_expression="n > '1'", extent=(5.0, 5.0, 40.0, 40.0)) == ["b"]
    assert run(selected_only=True) == ["b", "d"] and run(selected_only=True, filter_expression="title = 'd'") == ["d"]
    assert export.parse_extent("1,2,3") is None and export.parse_extent("1,2,3,x") is None and export.parse_extent(" 1,2 ,3,4") == (1, 2, 3, 4)
    none = export.preview(layer.limit(0), "n > 1").first()
    assert (none.matched, none.total, none.percent) == (0, 0, 0.0)


def test_reprojection_and_quarantine(layer):
    out = export.reprojected_points(layer, 4326, 3857)
    good, bad = export.quarantined(out, "y", "outside")
    assert good.count() == 3 and [(r.FID, r.reason) for r in bad.collect()] == [(3, "outside")]
    with pytest.raises(Exception, match="outside the target"):
        export.reprojected_points(layer, 4326, 3857, strict=True).collect()
    assert export.target_srid(ExportSpec("l", "o", driver="KML", target_srid=3857), 3857) == 4326
    with pytest.raises(ValueError, match="MBTiles"):
        export.target_srid(ExportSpec("l", "o", driver="MBTiles", target_srid=32632), 4326)
    assert export.effective_extent((1, 2, 3, 4), (0, 0, 9, 9), 4326, 3857) == (1, 2, 3, 4)
    assert export.effective_extent(None, (0.0, 0.0, 1.0, 1.0), 4326, 3857)[2] == pytest.approx(111319.49079327358)


def test_extent_reaches_the_scan(spark, sf_dir, tmp_path):
    layer = views.features(spark, sf_dir)
    sinks.clustered(layer, 8).write.parquet(f"{tmp_path}/f")
    plan = export.by_extent(spark.read.parquet(f"{tmp_path}/f"), (0.0, 0.0, 20.0, 20.0)).select("fid")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(x), IsNotNull(y), GreaterThanOrEqual(x,0.0)" in plan and "ReadSchema: struct<fid:bigint,x:double,y:double>" in plan


@pytest.mark.parametrize("driver", ["CSV", "GeoJSONSeq", "Parquet", "PGDUMP", "OGR_GMT", "XYZ", "KML"])
def test_files(spark, layer, tmp_path, driver):
    spec = ExportSpec("l", "out", driver=driver, output_path=f"file://{tmp_path}", datasource_options="compression=none")
    path = sinks.write(export.exported(layer.filter("FID < 3"), spec), spec)
    assert path.endswith("out" + registry.extension_of(driver))
    form = registry.SPARK_FORMAT[driver]
    reader = spark.read.option("rowTag", "Placemark") if form == "xml" else spark.read
    assert reader.format(form).option("header", str(driver == "CSV").lower()).load(path).count() == 2
    with pytest.raises(Exception, match="already exists"):
        sinks.write(layer, spec)
    with pytest.raises(ValueError, match="no writer"):
        sinks.write(layer, ExportSpec("l", "o", driver="PNG"))


def test_tables_and_options(spark, layer):
    spark.sql("CREATE DATABASE IF NOT EXISTS exports")
    spec = ExportSpec("l", "roads", driver="GPKG", target_mode="gpkg", output_path="exports", overwrite="layer", description="it's roads")
    for _ in range(2):
        assert sinks.write(layer.withColumnRenamed("FID", "id"), spec) == "exports.roads"
    assert spark.table("exports.roads").count() == 4
    assert sinks.writer_options(ExportSpec("l", "o", description="d", layer_options="SPATIAL_INDEX=NO;a=b")) == {"DESCRIPTION": "d", "SPATIAL_INDEX": "NO", "a": "b"}


def test_batch(spark, layer, tmp_path):
    base = dict(output_path=f"file://{tmp_path}")
    specs = [ExportSpec("l", "a", **base), ExportSpec("l", "b", filter_expression="nope > 1", **base), ExportSpec("gone", "c", **base), ExportSpec("l", "d", driver="CSV", filter_expression="n = '1'", **base)]

    def layer_of(spec):
        if spec.layer_id == "gone":
            raise KeyError("layer not found")
        return layer, 4326

    results = batch.run(spark, specs, layer_of)
    assert [(r.name, r.success, r.features_written) for r in results.collect()] == [("a", True, 4), ("b", False, 0), ("c", False, 0), ("d", True, 1)]
    total = batch.summary(results).first()
    assert (total.ok, total.failed) == (2, 2)
    assert [r.line.split(" ")[0] for r in batch.result_lines(results).collect()] == ["OK", "FAILED", "FAILED", "OK"]


def test_registry(spark):
    formats = registry.formats(spark)
    assert {r["kind"]: r["count"] for r in formats.groupBy("kind").count().collect()} == {"vector": 36, "raster": 32}
    both = formats.filter("kind = 'vector'").select("driver").intersect(formats.filter("kind = 'raster'").select("driver"))
    assert {r.driver for r in both.collect()} == {"MBTiles", "PDF"}
    assert formats.filter("kind = 'vector'").select("label").distinct().count() == 36
    offered = spark.createDataFrame([(d, "vector") for d in ("CSV", "ZZZ", "GPKG", "PostgreSQL", "AAA")], "driver string, kind string")
    rows = registry.ordered_formats(offered, "vector").orderBy("pos").collect()
    assert [(r.pos, r.label) for r in rows] == [(0, "GeoPackage"), (1, "CSV"), (2, "AAA"), (3, "ZZZ")]
    assert registry.extension_of("CSV") == ".csv" and registry.extension_of("nope") == ".gpkg"


def test_specs_and_settings(spark, sf_dir):
    layers = views.layers(spark, sf_dir)
    formats = registry.formats(spark).filter("driver IN ('CSV', 'Parquet', 'XYZ')")
    own = spark.createDataFrame([(0, "KML")], "layer_id int, driver string")
    specs = batch.fanned_out(layers, formats, own)
    assert [r.driver for r in specs.filter("layer_id = 0").collect()] == ["KML"]
    assert {r.driver for r in specs.filter("layer_id = 3").collect()} == {"CSV", "Parquet"}
    assert batch.current_settings(spark.createDataFrame([(0,), (99,)], "layer_id int"), layers).count() == 1
    assert batch.by_kind(layers, "mesh").count() < layers.count() == batch.by_kind(layers, None).count()
    counts = batch.layer_counts(layers, spark.createDataFrame([(0,), (1,)], "layer_id int"), "kind = 'vector'").first()
    assert (counts.loaded, counts.selected) == (layers.count(), 2)


def test_geometry_export(spark, sf_dir):
    boxes = views.boxes(spark, sf_dir)
    lines = export.exported(boxes, ExportSpec("b", "o", geometry_type="LineString", force_z=True, force_multi=True)).first()
    assert lines.geom.gtype == "MultiLineString" and lines.geom.has_z
    moved = export.exported(boxes.filter("ymax < 80 AND ymin > -80"), ExportSpec("b", "o", target_srid=3857)).first()
    assert moved.geom.srid == 3857 and abs(moved.geom.parts[0].rings[0][0].x) > 180


def test_raster(spark, tmp_path):
    cells = spark.createDataFrame([(0.5, 0.5, 1.0), (1.5, 0.5, 2.0), (0.5, 1.5, -1.0), (1.5, 1.5, 4.0)], "x double, y double, value double")
    clean = raster.without_nodata(cells, -1.0)
    assert raster.resampled(clean, 0, 0, 2, 2, "average").first().value == pytest.approx(7 / 3)
    assert raster.resampled(clean, 0, 0, 2, 2).first().value == 1.0
    raster.write_xyz(clean, f"{tmp_path}/g", -9999.0)
    assert sorted(r.value for r in raster.read_xyz(spark, f"{tmp_path}/g").collect()) == [-9999.0, 1.0, 2.0, 4.0]
    assert raster.cropped(cells, (0, 0, 1, 1)).count() == 1 and raster.labelled(cells, 3857).first().srid == 3857
    assert raster.warped(cells, 4326, 3857, 0, 0, 1e6, 1e6).count() == 1
    raster.write_container(cells.withColumn("layer", F.lit("a")), f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/c").filter("layer = 'a'").count() == 4


def test_tree(spark):
    nodes = spark.createDataFrame([("a", None, "Top Level", False), ("b", "a", "Sub/Group", False), ("c", "b", "roads", True), ("d", None, "x", True)], "id string, parent string, name string, layer boolean")
    assert {r.id: r.group_path for r in tree.group_paths(nodes).collect()} == {"c": "top_level_sub_group", "d": ""}
    assert '"children":["c"]' in {r.id: r.value for r in tree.tree_json(nodes).collect()}["b"]


def test_stream(spark, sf_dir, tmp_path):
    views.features(spark, sf_dir).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    spec = ExportSpec("s", "out", filter_expression="event_type = 'click'", output_path=f"{tmp_path}/x", target_srid=3857)
    start_export(stream, spec, f"{tmp_path}/state").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/x/out.parquet").count() == views.features(spark, sf_dir).filter("event_type = 'click'").count()


def test_dense_ids(spark, sf_dir):
    rows = export.with_dense_ids(views.features(spark, sf_dir).select("ts", "fid", "value"), ["ts", "value"], "fid").collect()
    assert sorted(r.fid for r in rows) == list(range(1, len(rows) + 1))
    assert [r.ts for r in sorted(rows, key=lambda r: r.fid)] == sorted(r.ts for r in rows)


def test_geojson_of_boxes(spark, sf_dir):
    row = sinks.geojson_rows(views.boxes(spark, sf_dir).select("name", "geom")).first()
    assert row.type == "Feature" and row.geometry.type == "Polygon" and len(row.geometry.coordinates[0]) == 5
    assert G.GEOM_TYPE


def test_overrides_and_reprojection_together(spark, sf_dir):
    far = G.make_line(F.array(G.point(F.lit(0.0), F.lit(80.0)), G.point(F.lit(0.0), F.lit(95.0))))
    layer = views.shapes(spark, sf_dir).withColumn("geom", F.when(F.col("shape_id") == 1, far).otherwise(F.col("geom")))
    spec = ExportSpec("s", "o", field_names=("shape_id",), geometry_type="LineString", force_z=True, force_multi=True, target_srid=3857)
    good, bad = export.exported(layer, spec).collect(), export.rejected(layer, spec).collect()
    assert len(good) + len(bad) == layer.count() and {r.reason for r in bad} == {export.ILLEGAL, export.OUTSIDE}
    assert {f.name for f in export.rejected(layer, spec).schema} == {*layer.columns, "reason"}
    assert any(r.geom is None for r in good)
    for r in good:
        if r.geom is not None:
            xs = [q.x for q in r.geom.parts[0].rings[0]]
            assert r.geom.gtype == "MultiLineString" and r.geom.has_z and r.geom.srid == 3857 and (r.xmin, r.xmax) == (min(xs), max(xs))
    none = export.exported(layer, ExportSpec("s", "o", geometry_type="NoGeometry", target_srid=3857))
    assert none.count() == layer.count() and not {"geom", "xmin"} & set(none.columns)


def test_shape_files(spark, sf_dir, tmp_path):
    layer = views.shapes(spark, sf_dir).select("shape_id", "geom")
    specs = [ExportSpec("s", "o", driver=d, output_path=f"file://{tmp_path}") for d in ("GeoJSONSeq", "OGR_GMT", "CSV", "PGDUMP")]
    paths = sinks.write_many(export.exported(layer, specs[0]), specs)
    features = [json.loads(r.value) for r in spark.read.text(paths[0]).collect()]
    assert len(features) == layer.count()
    by_type = {f["geometry"]["type"]: f["geometry"]["coordinates"] for f in features if f["geometry"]}
    assert set(by_type) == {"Point", "LineString", "Polygon", "MultiPolygon"} and len(by_type["MultiPolygon"]) == 2 and isinstance(by_type["Point"][0], float)
    rings = layer.filter("geom IS NOT NULL").selectExpr("sum(aggregate(geom.parts, 0, (a, p) -> a + size(p.rings)))").first()[0]
    assert spark.read.text(paths[1]).filter("value = '>'").count() == rings
    rows = spark.read.option("header", "true").csv(paths[2])
    assert rows.filter("wkt LIKE 'MULTIPOLYGON%'").count() == layer.filter("geom.gtype = 'MultiPolygon'").count() > 0
    assert spark.read.text(paths[3]).filter("value LIKE '%MULTIPOLYGON (((%'").count() == rows.filter("wkt LIKE 'MULTIPOLYGON%'").count()
    existing = spark.createDataFrame([(paths[0],), ("/other",)], "path string")
    planned = spark.createDataFrame([(sinks.output_path(s),) for s in specs], "path string")
    assert [r.path for r in sinks.clashes(planned, existing).collect()] == [paths[0]]


def test_names_and_counts(spark, sf_dir):
    specs = spark.createDataFrame([("a_b", "my roads"), ("", "x"), (None, "y" * 80)], "group_path string, name string")
    assert [r.table_name for r in sinks.table_names(specs).collect()] == ["a_b_my_roads", "x", "y" * 63]
    assert {r.kind: r.n for r in registry.counts_by_kind(registry.formats(spark)).collect()} == {"vector": 36, "raster": 32}
    layers = spark.createDataFrame([("WMS:url=x",), ("/a/b.tif",), ("https://h/x.tif",), (None,)], "source string")
    assert [r.source for r in batch.remote_rasters(layers).collect()] == ["WMS:url=x", "https://h/x.tif"]
    boxes = views.boxes(spark, sf_dir)
    assert [r.fid for r in export.in_row_order(boxes.select("fid")).collect()] == sorted(r.fid for r in boxes.collect())


def test_not_null_constraints(spark):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType(), metadata={"not_null": True}), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    layer = spark.createDataFrame([(1, "a", 0.0, 0.0), (2, None, 0.0, 0.0), (3, "c", 0.0, 90.0)], schema)
    spec = ExportSpec("l", "o", include_constraints=True, target_srid=3857)
    assert [r.id for r in export.exported(layer, spec).collect()] == [1]
    assert {r.id: r.reason for r in export.rejected(layer, spec).collect()} == {2: "no value in name", 3: export.OUTSIDE}
    assert export.exported(layer, ExportSpec("l", "o")).count() == 3
    assert export.exported(layer, ExportSpec("l", "o", include_constraints=True, field_names=("id",))).count() == 3
