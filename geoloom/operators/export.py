"""Layer export: filter, extent, columns, types, reprojection and geometry of one layer, as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions import catalogue, crs
from geoloom.functions import geometry as G

GEOMETRY_COLUMNS = ("geom", "x", "y", "xmin", "ymin", "xmax", "ymax")
WORLD = (-180.0, -90.0, 180.0, 90.0)
# Column types that a user can pick, columns that GeoRSS takes, drivers that force EPSG:4326 or drop columns.
TYPES = {
    "Integer": "int", "Integer64": "bigint", "Double": "double", "DecimalNumber": "decimal(38,10)", "String": "string",
    "Date": "date", "DateTime": "timestamp", "Time": "string", "Boolean": "boolean", "Binary": "binary",
}
GEORSS_COLUMNS = (
    "title", "description", "link", "author", "author_name", "author_email", "author_link", "category", "category_label",
    "category_scheme", "comments", "pubdate", "source", "source_url", "guid", "guid_permalink",
)
LONLAT_DRIVERS = ("GeoRSS", "GML", "KML")
BARE_DRIVERS = ("DXF", "DGN")
TILE_CRS = (4326, 3857)
#: Why a row is put aside.
OUTSIDE, ILLEGAL = "outside the target system", "geometry type"


@dataclass(frozen=True)
class ExportSpec:
    """What to export and how; the fields that carry data decisions."""

    layer_id: int | str
    name: str
    driver: str = "Parquet"
    output_path: str = ""
    target_mode: str = "file"
    filter_expression: str = ""
    selected_only: bool = False
    field_names: tuple[str, ...] | None = None
    field_export_names: dict[str, str] = field(default_factory=dict)
    use_aliases: bool = False
    field_types: dict[str, str] = field(default_factory=dict)
    strict_types: bool = False
    include_constraints: bool = False
    skip_attributes: bool = False
    target_srid: int | None = None
    strict_reprojection: bool = False
    extent: tuple[float, float, float, float] | None = None
    geometry_type: str = ""
    force_z: bool = False
    force_multi: bool = False
    encoding: str = "UTF-8"
    overwrite: str = "error"
    datasource_options: str = ""
    layer_options: str = ""
    description: str = ""
    layer_fid: str = ""
    geometry_name: str = ""
    identifier: str = ""
    spatial_index: str = "YES"


# --- rows ---------------------------------------------------------------------------------------------------------


def by_expression(df: DataFrame, expression: str) -> DataFrame:
    """Rows for which a filter text (see `catalogue`) holds; a blank one keeps all. A bad one raises when the plan is made."""
    return df.filter(catalogue.condition(df.sparkSession, expression)) if expression.strip() else df


def by_selection(df: DataFrame, selection: DataFrame, key: str = "fid") -> DataFrame:
    return df.join(selection.select(key), key, "left_semi")


def parse_extent(text: str | None) -> tuple[float, float, float, float] | None:
    """Four numbers from 'xmin,ymin,xmax,ymax'; None where the text is malformed."""
    try:
        values = [float(v) for v in (text or "").split(",")]
    except ValueError:
        return None
    return tuple(values) if len(values) == 4 else None


def by_extent(df: DataFrame, extent: tuple[float, float, float, float] | None) -> DataFrame:
    """Rows whose bounding box meets the extent: comparisons on plain columns, so they reach the Parquet scan."""
    if extent is None:
        return df
    xmin, ymin, xmax, ymax = extent
    if "xmin" in df.columns:
        return df.filter((F.col("xmax") >= xmin) & (F.col("xmin") <= xmax) & (F.col("ymax") >= ymin) & (F.col("ymin") <= ymax))
    return df.filter((F.col("x") >= xmin) & (F.col("x") <= xmax) & (F.col("y") >= ymin) & (F.col("y") <= ymax))


def preview(df: DataFrame, expression: str) -> DataFrame:
    """(matched, total, percent) of a filter, in one pass."""
    matched = F.count_if(catalogue.condition(df.sparkSession, expression)) if expression.strip() else F.count(F.lit(1))
    counts = df.agg(matched.alias("matched"), F.count(F.lit(1)).alias("total"))
    return counts.withColumn("percent", F.when(F.col("total") == 0, 0.0).otherwise(F.round(100.0 * F.col("matched") / F.col("total"), 1)))


# --- columns ------------------------------------------------------------------------------------------------------


def attributes(df: DataFrame) -> list[str]:
    """Attribute columns: all but geometry and a key called fid in any case."""
    return [c for c in df.columns if c not in GEOMETRY_COLUMNS and c.lower() != "fid"]


def chosen(df: DataFrame, names: tuple[str, ...] | None) -> list[str]:
    """The wanted attributes in source order; None is all, empty is none."""
    return [c for c in attributes(df) if names is None or c in names]


def export_name(f: T.StructField, renames: dict[str, str], use_aliases: bool) -> str:
    alias = (f.metadata or {}).get("alias", "")
    return renames.get(f.name) or (alias if use_aliases and alias else f.name)


def retyped(column: Column, wanted: str | None, strict: bool) -> Column:
    """A column as another type. Values that do not fit are null, or with `strict` an error; unknown type names are text."""
    if wanted is None:
        return column
    kind = TYPES.get(wanted, "string")
    if kind in ("int", "bigint") and not strict:
        column = column.cast("string").try_cast("double")
    made = column.cast(kind) if strict else column.try_cast(kind)
    return F.date_format(column.try_cast("timestamp"), "HH:mm:ss") if wanted == "Time" else made


def bound_columns(driver: str, names: list[str]) -> list[str]:
    """The attributes that a format can hold."""
    if driver in BARE_DRIVERS:
        return []
    if driver == "GeoRSS":
        return [n for n in names if n.lower() in GEORSS_COLUMNS]
    return [n for n in names if n.lower() != "fid"] if driver == "GPX" else names


def with_dense_ids(df: DataFrame, order: list[str], name: str = "fid") -> DataFrame:
    """Ids 1, 2, ... in total order, in place of any column of that name."""
    from geoloom.operators.ranks import running_sum

    kept = df if name in order else df.drop(*[c for c in df.columns if c.lower() == name.lower()])
    ranked = running_sum(kept.withColumn("_one", F.lit(1)), "_one", order, "_rank")
    return ranked.withColumn(name, (F.col("_rank") + 1).cast("long")).drop("_one", "_rank")


# --- geometry -----------------------------------------------------------------------------------------------------


def target_srid(spec: ExportSpec, source: int) -> int:
    """The target system: the spec's, else the source's; some formats force EPSG:4326; tiles allow two only."""
    wanted = spec.target_srid or source
    if not crs.known(wanted):
        raise ValueError(f"EPSG:{wanted} is not supported")
    if spec.driver in LONLAT_DRIVERS:
        return 4326
    if spec.driver == "MBTiles" and wanted not in TILE_CRS:
        raise ValueError("MBTiles takes EPSG:4326 and EPSG:3857 only")
    return wanted


def reprojected_points(df: DataFrame, source: int, target: int, strict: bool = False) -> DataFrame:
    """x and y in another system. Points outside its domain are null, or with `strict` an error."""
    if source == target:
        return df
    x, y = crs.reprojected(F.col("x"), F.col("y"), source, target)
    if strict:
        y = F.when(F.col("y").isNull() | y.isNotNull(), y).otherwise(F.raise_error(F.lit("point outside the target system")).cast("double"))
    return df.withColumns({"x": x, "y": y})


def reprojected_boxes(df: DataFrame, source: int, target: int) -> DataFrame:
    """Boxes without a geometry: the least boxes that hold them in another system, null where an edge leaves its domain.
    Corners bound them exactly between EPSG:4326 and EPSG:3857; elsewhere edges are curves, followed point by point."""
    if source == target:
        return df
    sides = ("xmin", "ymin", "xmax", "ymax")
    if crs.straight(source, target):
        low = crs.reprojected(F.col("xmin"), F.col("ymin"), source, target)
        high = crs.reprojected(F.col("xmax"), F.col("ymax"), source, target)
        return df.withColumns(dict(zip(sides, (*low, *high), strict=True)))
    made = df.withColumn("_edges", crs.edges(*map(F.col, sides), source, target))
    whole = ~F.exists(F.flatten("_edges"), lambda q: q["x"].isNull() | q["y"].isNull())

    def along(axis: str, sign: int) -> Column:
        return F.transform("_edges", lambda e: F.transform(e, lambda q: q[axis] * sign))

    values = {"_xp": along("x", 1), "_yp": along("y", 1), "_xn": along("x", -1), "_yn": along("y", -1)}
    made = made.withColumn("_inside", whole).withColumns(values)
    least = lambda name: F.when(F.col("_inside"), F.array_min(crs.least_of_edges(F.col(name))))
    box = {"xmin": least("_xp"), "ymin": least("_yp"), "xmax": -least("_xn"), "ymax": -least("_yn")}
    return made.withColumns(box).drop("_edges", "_inside", *values)


def extent_in(spark: SparkSession, extent: tuple[float, float, float, float], source: int, target: int) -> tuple[float, float, float, float] | None:
    """The least extent in another system that holds one; None where it leaves the system's domain."""
    sides = ("xmin", "ymin", "xmax", "ymax")
    row = reprojected_boxes(spark.range(1).select(*[F.lit(float(v)).alias(c) for c, v in zip(sides, extent, strict=True)]), source, target).select(*sides).first()
    return None if None in row else tuple(row)


def quarantined(df: DataFrame, column: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """Rows with and without a value in `column`; the latter with a reason."""
    return df.filter(F.col(column).isNotNull()), df.filter(F.col(column).isNull()).withColumn("reason", F.lit(reason))


def layer_extent(df: DataFrame) -> DataFrame:
    """(xmin, ymin, xmax, ymax) of all rows."""
    box = ("xmin", "ymin", "xmax", "ymax") if "xmin" in df.columns else ("x", "y", "x", "y")
    return df.agg(F.min(box[0]).alias("xmin"), F.min(box[1]).alias("ymin"), F.max(box[2]).alias("xmax"), F.max(box[3]).alias("ymax"))


def global_extent(extents: DataFrame) -> DataFrame:
    """The union of extents; the world where there is none."""
    union = layer_extent(extents)
    return union.select(*[F.coalesce(c, F.lit(w)).alias(c) for c, w in zip(("xmin", "ymin", "xmax", "ymax"), WORLD, strict=True)])


def effective_extent(own, overall, overall_srid: int, layer_srid: int):
    """The extent to use for a layer: its own, given in its own system, else the overall one in the layer's system, so
    that no point inside the overall one is outside. Both are tuples or None."""
    if own is not None or overall is None or overall_srid == layer_srid:
        return own if own is not None else overall
    return extent_in(SparkSession.active(), overall, overall_srid, layer_srid)


def effective_extents(specs: DataFrame, overall: tuple[float, float, float, float] | None, overall_srid: int, srids: tuple[int, ...]) -> DataFrame:
    """`specs` (layer_srid and an extent of their own or null) with the extent to use: their own, else the overall one
    in the layer's system, which must be one of `srids`."""
    if overall is None:
        return specs
    moved = {s: extent_in(specs.sparkSession, overall, overall_srid, s) for s in srids}
    own = F.col("xmin").isNotNull() & F.col("ymin").isNotNull() & F.col("xmax").isNotNull() & F.col("ymax").isNotNull()
    out = {}
    for i, name in enumerate(("xmin", "ymin", "xmax", "ymax")):
        shared = F.lit(None).cast("double")
        for s, box in moved.items():
            shared = F.when(F.col("layer_srid") == s, F.lit(None if box is None else box[i]).cast("double")).otherwise(shared)
        out[name] = F.when(own, F.col(name)).otherwise(shared)
    return specs.withColumns(out)


def target_srids(specs: DataFrame) -> DataFrame:
    """`specs` (driver, target_srid, layer_srid) with `target` and, where there is none, `reason`: `target_srid` for many."""
    wanted = F.coalesce("target_srid", "layer_srid").cast("int")
    zones = (wanted.between(32601, 32660)) | (wanted.between(32701, 32760))
    reason = (
        F.when(~(wanted.isin(4326, 3857) | zones), "unknown reference system")
        .when((F.col("driver") == "MBTiles") & ~wanted.isin(*TILE_CRS), "system not allowed")
    )
    target = F.when(F.col("driver").isin(*LONLAT_DRIVERS), F.lit(4326)).otherwise(wanted)
    return specs.withColumn("reason", reason).withColumn("target", F.when(F.col("reason").isNull(), target))


def in_row_order(rows: DataFrame, key: str = "fid") -> DataFrame:
    """Rows in the order of their table."""
    return rows.orderBy(key)


# --- the whole ----------------------------------------------------------------------------------------------------


def worked_out_once(reason: Column) -> Column:
    """The same value. The partition's number changes nothing, but keeps the optimiser from copying a filter on the reason
    down through the steps below it, where each copy would be worked out anew. The user's filters stand below already."""
    return F.when(F.spark_partition_id() >= 0, reason)


def missing_value(layer: DataFrame, spec: ExportSpec) -> Column:
    """Why a row breaks the constraints that a spec keeps: a column whose metadata says not_null holds none."""
    reason = F.lit(None).cast("string")
    if spec.include_constraints and not spec.skip_attributes:
        for f in layer.schema.fields:
            if (f.metadata or {}).get("not_null") and f.name in chosen(layer, spec.field_names):
                reason = F.coalesce(reason, F.when(F.col(f.name).isNull(), F.lit(f"no value in {f.name}")))
    return reason


def prepared(layer: DataFrame, spec: ExportSpec, source_srid: int = 4326, selection: DataFrame | None = None) -> DataFrame:
    """The rows that a spec asks for with their geometry changed (type, Z, Multi), then reprojected, then their boxes
    taken anew; `_reason` says why a row cannot be written, null where it can. Filters come first and on plain columns."""
    rows = by_extent(layer, spec.extent)
    if spec.selected_only:
        if selection is None:
            raise ValueError("no selection was given")
        rows = by_selection(rows, selection)
    rows = by_expression(rows, spec.filter_expression)
    target = target_srid(spec, source_srid)
    reason = missing_value(layer, spec)
    if spec.geometry_type == "NoGeometry":
        return rows.withColumn("_reason", reason)
    if "x" in rows.columns and source_srid != target:
        there = F.col("x").isNotNull() & F.col("y").isNotNull()
        moved = reprojected_points(rows.withColumn("_there", there), source_srid, target)
        outside = F.col("_there") & (F.col("x").isNull() | F.col("y").isNull())
        rows = moved.withColumn("_reason", worked_out_once(F.coalesce(reason, F.when(outside, OUTSIDE)))).drop("_there")
    else:
        rows = rows.withColumn("_reason", reason)
    if "geom" not in rows.columns:
        if "xmin" not in rows.columns or source_srid == target:
            return rows
        there = F.col("xmin").isNotNull() & F.col("ymin").isNotNull() & F.col("xmax").isNotNull() & F.col("ymax").isNotNull()
        moved = reprojected_boxes(rows.withColumn("_there", there), source_srid, target)
        outside = F.col("_there") & (F.col("xmin").isNull() | F.col("ymin").isNull() | F.col("xmax").isNull() | F.col("ymax").isNull())
        return moved.withColumn("_reason", worked_out_once(F.coalesce("_reason", F.when(outside, OUTSIDE)))).drop("_there")
    geom = F.col("geom")
    if spec.geometry_type:
        made = G.as_type(geom, spec.geometry_type)
        rows = rows.withColumns({"_reason": F.coalesce("_reason", F.when(geom.isNotNull() & made.isNull(), ILLEGAL)), "geom": made})
    if spec.force_z or spec.driver == "DGN":
        rows = rows.withColumn("geom", F.when(geom.isNotNull(), G.forced_z(geom)))
    if spec.force_multi:
        rows = rows.withColumn("geom", F.when(geom.isNotNull(), G.forced_multi(geom)))
    if source_srid != target:
        rows = rows.withColumn("geom", F.when(geom.isNotNull(), reprojected_geometry(geom, source_srid, target)))
        lost = F.exists(G.vertices(geom), lambda q: q["x"].isNull() | q["y"].isNull())
        rows = rows.withColumn("_reason", F.coalesce("_reason", F.when(lost, OUTSIDE)))
        if "xmin" in rows.columns:
            rows = rows.withColumns(G.box(geom))
    return rows.withColumn("_reason", worked_out_once(F.col("_reason")))


def written_columns(layer: DataFrame, rows: DataFrame, spec: ExportSpec) -> list[Column]:
    """The attributes of a spec under their names and types, then the geometry columns."""
    names = [] if spec.skip_attributes else bound_columns(spec.driver, chosen(layer, spec.field_names))
    shape = [] if spec.geometry_type == "NoGeometry" else [c for c in GEOMETRY_COLUMNS if c in rows.columns]
    out = []
    for f in layer.schema.fields:
        if f.name in names:
            made = retyped(F.col(f.name), spec.field_types.get(f.name), spec.strict_types)
            metadata = f.metadata if spec.include_constraints else {}
            out.append(made.alias(export_name(f, spec.field_export_names, spec.use_aliases), metadata=metadata))
    return [*out, *map(F.col, shape)]


def exported(layer: DataFrame, spec: ExportSpec, source_srid: int = 4326, selection: DataFrame | None = None) -> DataFrame:
    """The rows and columns that a spec writes. Rows without a geometry stay; see `rejected` for those that cannot be
    written. With `strict_reprojection` a row outside the target system fails the layer."""
    rows = prepared(layer, spec, source_srid, selection)
    good = F.col("_reason").isNull()
    if spec.strict_reprojection:
        good = F.when(F.col("_reason") == OUTSIDE, F.raise_error(F.lit(f"{spec.name}: {OUTSIDE}")).cast("boolean")).otherwise(good)
    return rows.filter(good).select(*written_columns(layer, rows, spec))


def rejected(layer: DataFrame, spec: ExportSpec, source_srid: int = 4326, selection: DataFrame | None = None) -> DataFrame:
    """The rows, as they are in the layer, that a spec asks for and cannot write, with `reason`."""
    whole = layer.withColumn("_whole", F.struct(*layer.columns))
    return prepared(whole, spec, source_srid, selection).filter("_reason IS NOT NULL").select("_whole.*", F.col("_reason").alias("reason"))


def reprojected_geometry(geom: Column, source: int, target: int) -> Column:
    """Every vertex of a geometry in another system."""

    def vertex(q: Column) -> Column:
        x, y = crs.reprojected(q["x"], q["y"], source, target)
        return F.struct(x.alias("x"), y.alias("y"), q["z"].alias("z"))

    parts = F.transform(
        geom["parts"], lambda p: F.struct(p["kind"].alias("kind"), F.transform(p["rings"], lambda r: F.transform(r, vertex)).alias("rings"))
    )
    return F.struct(geom["gtype"].alias("gtype"), F.lit(target).alias("srid"), geom["has_z"].alias("has_z"), parts.alias("parts"))
