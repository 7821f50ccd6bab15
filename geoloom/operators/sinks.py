"""Sinks: one layer to files or tables, with options, overwrite policy and spatial clustering.

What overwrites is first written beside its target and takes its place when it stands whole. A layer that fails midway
leaves the old output as it was, and a layer may be read from the place that it overwrites."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.functions import names
from geoloom.operators import registry
from geoloom.operators.export import GEOMETRY_COLUMNS, ExportSpec, by_extent
from geoloom.operators.ranks import durable


#: The column of a row's place on the curve.
MORTON = "morton"


def parse_options(text: str) -> dict[str, str]:
    """KEY=VALUE pairs, one a line or separated by semicolons; others are passed over."""
    pairs = (p.split("=", 1) for p in text.replace(";", "\n").splitlines() if "=" in p)
    return {k.strip(): v.strip() for k, v in pairs if k.strip()}


def writer_options(spec: ExportSpec) -> dict[str, str]:
    """The spec's own options first, then the user's, which win."""
    named = {"DESCRIPTION": spec.description, "FID": spec.layer_fid, "GEOMETRY_NAME": spec.geometry_name, "IDENTIFIER": spec.identifier, "SPATIAL_INDEX": spec.spatial_index}
    return {k: v for k, v in named.items() if v} | parse_options(spec.datasource_options) | parse_options(spec.layer_options)


def morton_key(x: Column, y: Column, extent=(-180.0, -90.0, 180.0, 90.0), bits: int = 15) -> Column:
    """Interleaved bits of the cell of a point in a square grid over the extent."""
    xmin, ymin, xmax, ymax = extent
    cell = lambda v, lo, hi: F.least(F.greatest(F.floor((v - lo) / (hi - lo) * (1 << bits)), F.lit(0)), F.lit((1 << bits) - 1)).cast("long")

    def spread(v: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    return spread(cell(x, xmin, xmax)).bitwiseOR(F.shiftleft(spread(cell(y, ymin, ymax)), 1))


def morton_ranges(box: tuple[float, float, float, float], extent=(-180.0, -90.0, 180.0, 90.0), bits: int = 15, most: int = 64) -> list[tuple[int, int]]:
    """At most `most` ranges of keys that hold all cells which a box meets: squares of the grid are quartered as long as
    they lie in part inside the box and the number allows it; what is still in part inside is taken whole."""
    xmin, ymin, xmax, ymax = extent
    cell = lambda v, lo, hi: min(max(math.floor((v - lo) / (hi - lo) * (1 << bits)), 0), (1 << bits) - 1)
    x0, x1, y0, y1 = cell(box[0], xmin, xmax), cell(box[2], xmin, xmax), cell(box[1], ymin, ymax), cell(box[3], ymin, ymax)
    if x0 > x1 or y0 > y1:
        return []
    whole: list[tuple[int, int]] = []
    partly = [(0, 0, 0)]  # key of the first cell and its place, for squares of one size
    for level in range(bits, -1, -1):
        side = 1 << level
        cut = []
        for key, x, y in partly:
            if x0 <= x and x + side - 1 <= x1 and y0 <= y and y + side - 1 <= y1:
                whole.append((key, key + side * side - 1))
            elif x <= x1 and x + side - 1 >= x0 and y <= y1 and y + side - 1 >= y0:
                cut.append((key, x, y))
        if level == 0 or len(whole) + 4 * len(cut) > most:
            whole += [(key, key + side * side - 1) for key, _, _ in cut]
            break
        half = side // 2
        partly = [(key + i * half * half, x + (i & 1) * half, y + (i >> 1) * half) for key, x, y in cut for i in range(4)]
    merged: list[tuple[int, int]] = []
    for low, high in sorted(whole):
        if merged and merged[-1][1] + 1 == low:
            merged[-1] = merged[-1][0], high
        else:
            merged.append((low, high))
    return merged


def clustered(df: DataFrame, partitions: int | None = None, keep_key: bool = False) -> DataFrame:
    """Rows near each other in the plane in one file, so that box filters skip files by their statistics. With
    `keep_key` the place on the curve stays as MORTON, by which `by_extent_on_curve` skips files for boxes of any shape."""
    x, y = (F.col("x"), F.col("y")) if "x" in df.columns else ((F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2)
    keyed = df.withColumn(MORTON, morton_key(x, y))
    dealt = keyed.repartitionByRange(partitions, MORTON) if partitions else keyed.repartitionByRange(MORTON)
    rows = dealt.sortWithinPartitions(MORTON)
    return rows if keep_key else rows.drop(MORTON)


def by_extent_on_curve(df: DataFrame, extent: tuple[float, float, float, float], margin: float = 0.0, most: int = 64) -> DataFrame:
    """`export.by_extent` on rows that `clustered` wrote with their key: ranges of the key reach the scan beside the
    comparisons, so that files and row groups outside the box go unread even where both its sides are long. `margin`
    is half the longest side of a box among the rows, as a box has the key of its centre."""
    xmin, ymin, xmax, ymax = extent
    wanted = F.lit(False)
    for low, high in morton_ranges((xmin - margin, ymin - margin, xmax + margin, ymax + margin), most=most):
        wanted = wanted | F.col(MORTON).between(low, high)
    return by_extent(df.filter(wanted), extent).drop(MORTON)


def shape_text(df: DataFrame) -> Column | None:
    if "geom" in df.columns:
        return G.wkt(F.col("geom"))
    if "x" in df.columns:
        return F.concat(F.lit("POINT ("), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit(")"))
    return None


def geojson_rows(df: DataFrame) -> DataFrame:
    """(type, geometry, properties): a feature a row, for points and for polygons of one part, whose coordinates have a
    fixed nesting; see `geojson_lines` for all shapes."""
    plain = [c for c in df.columns if c not in GEOMETRY_COLUMNS]
    if "geom" in df.columns:
        rings = F.transform(F.get(F.col("geom.parts"), 0)["rings"], lambda r: F.transform(r, lambda q: F.array(q["x"], q["y"])))
        shape = F.when(F.col("geom.gtype") == "Polygon", F.struct(F.col("geom.gtype").alias("type"), rings.alias("coordinates")))
    elif "x" in df.columns:
        shape = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))
    else:
        shape = F.lit(None).cast("struct<type:string,coordinates:array<double>>")
    return df.select(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*plain).alias("properties") if plain else F.lit(None).cast("string").alias("properties"))


def geojson_lines(df: DataFrame) -> DataFrame:
    """(value): a feature a line, of any shape; a missing geometry is null."""
    plain = [c for c in df.columns if c not in GEOMETRY_COLUMNS]
    if "geom" in df.columns:
        shape = G.geojson(F.col("geom"))
    elif "x" in df.columns:
        shape = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.concat(F.lit('{"type":"Point","coordinates":'), F.to_json(F.array("x", "y")), F.lit("}")))
    else:
        shape = F.lit(None).cast("string")
    properties = F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}) if plain else F.lit("{}")
    return df.select(F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(shape, F.lit("null")), F.lit(',"properties":'), properties, F.lit("}")).alias("value"))


def insert_lines(df: DataFrame, table: str) -> DataFrame:
    """INSERT statements, one a row."""
    plain = [c for c in df.columns if c not in GEOMETRY_COLUMNS]
    shape = shape_text(df)
    quoted = [F.coalesce(F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL")) for c in plain]
    if shape is not None:
        quoted.append(F.coalesce(F.concat(F.lit("ST_GeomFromText('"), shape, F.lit("')")), F.lit("NULL")))
    name = lambda c: '"' + c.replace('"', '""') + '"'
    columns = ", ".join(name(c) for c in [*plain, *(["geom"] if shape is not None else [])])
    return df.select(F.concat(F.lit(f"INSERT INTO {name(table)} ({columns}) VALUES ("), F.concat_ws(", ", *quoted), F.lit(");")).alias("value"))


def gmt_lines(df: DataFrame) -> DataFrame:
    """Points as 'x y' lines; of other shapes each ring of each part as a '>' line and its points."""
    if "x" in df.columns and "geom" not in df.columns:
        return df.select(F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string")).alias("value"))
    rings = F.flatten(F.transform(F.col("geom.parts"), lambda p: p["rings"]))
    block = lambda ring: F.concat(F.lit(">\n"), F.array_join(F.transform(ring, lambda q: F.concat_ws(" ", q["x"].cast("string"), q["y"].cast("string"))), "\n"))
    return df.select(F.array_join(F.transform(rings, block), "\n").alias("value"))


def flat(df: DataFrame) -> DataFrame:
    """Attributes and the geometry as well-known text: what text formats hold."""
    shape = shape_text(df)
    plain = [c for c in df.columns if c not in GEOMETRY_COLUMNS]
    return df.select(*plain, *([shape.alias("wkt")] if shape is not None else []))


def output_path(spec: ExportSpec) -> str:
    return f"{spec.output_path.rstrip('/')}/{spec.name}{registry.extension_of(spec.driver)}"


OVERWRITING = ("file", "layer", "overwrite")


def replaced(spark: SparkSession, path: str, save: Callable[[str], None]) -> None:
    """Let `save` write to a folder beside `path` and move it there when it is whole. The old one is moved aside first
    and comes back if the new one cannot take its place."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    files = target.getFileSystem(context._jsc.hadoopConfiguration())
    mark = uuid.uuid4().hex
    # Names with a leading underscore or dot are passed over by readers of the folder.
    beside = lambda kind: context._jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{target.getName()}.{kind}-{mark}")
    staged, old = beside("staged"), beside("old")
    try:
        save(staged.toString())
        there = files.exists(target)
        if there and not files.rename(target, old):
            raise OSError(f"{path} cannot be moved aside")
        if not files.rename(staged, target):
            if there:
                files.rename(old, target)
            raise OSError(f"{path} cannot be replaced")
        if there:
            files.delete(old, True)
    finally:
        if files.exists(staged):
            files.delete(staged, True)


def replaced_table(spark: SparkSession, name: str, save: Callable[[str], None]) -> None:
    """The same for a table: a new one of another name takes the old one's when it stands, and the old one, moved aside
    for that, comes back if it cannot."""
    mark = uuid.uuid4().hex
    staged, old = f"{name}_staged_{mark}", f"{name}_old_{mark}"
    rename = lambda a, b: spark.sql(f"ALTER TABLE {a} RENAME TO {b}")
    try:
        save(staged)
        there = spark.catalog.tableExists(name)
        if there:
            rename(name, old)
        try:
            rename(staged, name)
        except Exception:
            if there:
                rename(old, name)
            raise
        if there:
            spark.sql(f"DROP TABLE {old}")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {staged}")


def write(df: DataFrame, spec: ExportSpec, seen: Observation | None = None) -> str:
    """Write to the format's files, or as a table of the schema named by output_path. Gives the path or table name.

    `overwrite` is "error" (what exists stays and the export fails), "layer" (this layer is replaced, others of its
    container stay) or "file" (the container is replaced: of a schema other than `default` all other tables go, once
    the new one stands); files hold one layer, so for them both are one.

    `encoding` holds for CSV and its kin and for JSON records. GeoJSON is UTF-8 always, as its definition has it; Spark
    writes other lines of text in UTF-8 too, so another encoding is refused for them.

    `seen` counts the rows as `n` right before the writer: further up, the sample that a range partitioning takes of
    its input would be counted too."""
    form = registry.SPARK_FORMAT.get(spec.driver)
    if form is None:
        raise ValueError(f"{spec.driver} has no writer")
    spark, over = df.sparkSession, spec.overwrite in OVERWRITING
    rows = clustered(df) if spec.spatial_index.upper() == "YES" and form in ("parquet", "table") and {"x", "xmin"} & set(df.columns) else df
    if seen is not None:
        rows = rows.observe(seen, F.count(F.lit(1)).alias("n"))
    if form == "table" or spec.target_mode == "gpkg":
        schema = spec.output_path or "default"
        name = f"{schema}.{spec.name}"
        save = lambda to: rows.write.mode("errorifexists").options(**writer_options(spec)).saveAsTable(to)
        replaced_table(spark, name, save) if over else save(name)
        if spec.overwrite == "file" and schema.lower() != "default":
            for other in spark.catalog.listTables(schema):
                if not other.isTemporary and other.name.lower() != spec.name.lower():
                    spark.sql(f"DROP TABLE {schema}.`{other.name}`")
        if spec.description:
            text = spec.description.replace("'", "\\'")
            spark.sql(f"COMMENT ON TABLE {name} IS '{text}'")
        return name
    path = output_path(spec)
    if spec.driver in ("GeoJSON", "GeoJSONSeq"):
        rows, form = geojson_lines(rows), "text"
    elif spec.driver == "PGDUMP":
        rows = insert_lines(rows, spec.name)
    elif spec.driver == "OGR_GMT":
        rows = gmt_lines(rows)
    elif form in ("csv", "xml"):
        rows = flat(rows)
    if form == "text" and not spec.driver.startswith("GeoJSON") and spec.encoding.upper().replace("-", "") != "UTF8":
        raise ValueError(f"{spec.driver} is written in UTF-8 only")
    out = rows.write.mode("errorifexists").options(**writer_options(spec))
    if form in ("csv", "json"):
        out = out.option("encoding", spec.encoding)
    if form == "csv":
        out = out.option("header", "true") if spec.driver == "CSV" else out.option("sep", " ")
    if form == "xml":
        out = out.option("rowTag", {"GPX": "wpt", "GeoRSS": "item", "GML": "featureMember"}.get(spec.driver, "Placemark")).option("rootTag", spec.driver.lower())
    if over:
        replaced(spark, path, out.format(form).save)
    else:
        out.format(form).save(path)
    return path


def write_many(df: DataFrame, specs: list[ExportSpec]) -> list[str]:
    """Several formats of one layer: its plan runs once, and all are written from what that gave."""
    rows = durable(df) if len(specs) > 1 else df
    return [write(rows, s) for s in specs]


def clashes(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """Planned paths that exist, to be asked about before a run."""
    return planned.join(existing.select("path"), "path", "left_semi")


def table_names(specs: DataFrame) -> DataFrame:
    """Container names of specs (group_path, name): the group's path before the name, both cut to 63 characters."""
    joined = F.concat_ws("_", F.nullif(F.col("group_path"), F.lit("")), F.col("name"))
    return specs.withColumn("table_name", names.table_name(joined))


