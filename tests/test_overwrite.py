"""What overwrites stands whole before the old output goes."""

import json
import os

import pytest

from geoloom.operators import sinks
from geoloom.operators.export import ExportSpec


def layer(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, name string")


@pytest.mark.parametrize("driver", ["CSV", "Parquet", "GeoJSONSeq"])
def test_a_late_failure_leaves_the_old_rows(spark, tmp_path, driver):
    spec = ExportSpec("l", "out", driver=driver, output_path=f"file://{tmp_path}", overwrite="file")
    path = sinks.write(layer(spark, ["a", "b"]), spec)
    before = sorted(os.listdir(tmp_path))
    bad = layer(spark, ["1", "x"]).selectExpr("id", "CAST(assert_true(name <> 'x') AS STRING) AS name")
    with pytest.raises(Exception):
        sinks.write(bad, spec)
    assert sorted(os.listdir(tmp_path)) == before  # nothing staged is left either
    form = {"CSV": "csv", "Parquet": "parquet", "GeoJSONSeq": "text"}[driver]
    assert spark.read.format(form).option("header", "true").load(path).count() == 2
    sinks.write(layer(spark, ["c"]), spec)
    assert spark.read.format(form).option("header", "true").load(path).count() == 1
    with pytest.raises(Exception):
        sinks.write(layer(spark, ["d"]), ExportSpec("l", "out", driver=driver, output_path=f"file://{tmp_path}"))
    assert spark.read.format(form).option("header", "true").load(path).count() == 1


def test_a_layer_overwrites_what_it_reads(spark, tmp_path):
    spec = ExportSpec("l", "out", output_path=f"file://{tmp_path}", overwrite="layer")
    path = sinks.write(layer(spark, ["a", "b", "c"]), spec)
    sinks.write(spark.read.parquet(path).filter("name <> 'b'"), spec)
    assert sorted(r.name for r in spark.read.parquet(path).collect()) == ["a", "c"]


def test_file_replaces_the_container_and_layer_one_table(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS container")
    spec = lambda name, over: ExportSpec("l", name, driver="GPKG", target_mode="gpkg", output_path="container", overwrite=over, description="it's new")
    tables = lambda: {t.name for t in spark.catalog.listTables("container")}
    try:
        for name in ("roads", "rivers"):
            sinks.write(layer(spark, ["a"]), spec(name, "error"))
        sinks.write(layer(spark, ["b", "c"]), spec("roads", "layer"))
        assert tables() == {"roads", "rivers"} and spark.table("container.roads").count() == 2
        with pytest.raises(Exception):
            sinks.write(layer(spark, ["x"]).selectExpr("CAST(assert_true(id > 5) AS STRING) AS name"), spec("roads", "file"))
        assert tables() == {"roads", "rivers"} and spark.table("container.roads").count() == 2
        sinks.write(spark.table("container.roads").filter("name = 'c'"), spec("roads", "file"))
        assert tables() == {"roads"} and [r.name for r in spark.table("container.roads").collect()] == ["c"]
    finally:
        spark.sql("DROP DATABASE container CASCADE")


def test_null_properties_and_quoted_names(spark):
    rows = spark.createDataFrame([(1, None)], 'id int, `a"b` string')
    assert json.loads(sinks.geojson_lines(rows).first().value)["properties"] == {"id": 1, 'a"b': None}
    assert sinks.insert_lines(rows, 'my"t').first().value == 'INSERT INTO "my""t" ("id", "a""b") VALUES (\'1\', NULL);'


def test_encodings(spark, tmp_path):
    made = lambda driver: ExportSpec("l", "out", driver=driver, output_path=f"file://{tmp_path}", encoding="ISO-8859-1")
    path = sinks.write(layer(spark, ["é"]), made("CSV"))
    assert spark.read.option("header", "true").option("encoding", "ISO-8859-1").csv(path).first().name == "é"
    assert json.loads(spark.read.text(sinks.write(layer(spark, ["é"]), made("GeoJSONSeq"))).first().value)["properties"]["name"] == "é"
    with pytest.raises(ValueError, match="UTF-8 only"):
        sinks.write(layer(spark, ["é"]), made("PGDUMP"))


def test_a_table_comes_back_if_the_new_one_cannot_take_its_place(spark):
    layer(spark, ["a", "b"]).write.saveAsTable("kept")
    try:
        with pytest.raises(Exception):
            sinks.replaced_table(spark, "kept", lambda staged: None)  # nothing to take its place
        assert spark.table("kept").count() == 2
        sinks.replaced_table(spark, "kept", layer(spark, ["c"]).write.saveAsTable)
        assert spark.table("kept").first().name == "c" and [t.name for t in spark.catalog.listTables() if t.name.startswith("kept")] == ["kept"]
    finally:
        spark.sql("DROP TABLE kept")
