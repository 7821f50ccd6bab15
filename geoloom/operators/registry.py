"""The format registry as a constant table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Drivers in preferred order, with label, extension and, where Spark has a writer, its format.
VECTOR = (
    ("GPKG", "GeoPackage", ".gpkg", "table"),
    ("ESRI Shapefile", "Shapefile", ".shp", None),
    ("GeoJSON", "GeoJSON", ".geojson", "json"),
    ("GeoJSONSeq", "GeoJSON (Newline Delimited)", ".geojsonl", "json"),
    ("KML", "KML", ".kml", "xml"),
    ("LIBKML", "LIBKML", ".kml", "xml"),
    ("CSV", "CSV", ".csv", "csv"),
    ("FlatGeobuf", "FlatGeobuf", ".fgb", None),
    ("GPX", "GPX", ".gpx", "xml"),
    ("GML", "GML", ".gml", "xml"),
    ("TopoJSON", "TopoJSON", ".topojson", None),
    ("SQLite", "SQLite", ".sqlite", "table"),
    ("SpatiaLite", "SpatiaLite", ".sqlite", "table"),
    ("DXF", "DXF", ".dxf", None),
    ("DGN", "Microstation DGN", ".dgn", None),
    ("MapInfo File", "MapInfo TAB", ".tab", None),
    ("Parquet", "GeoParquet", ".parquet", "parquet"),
    ("Arrow", "Arrow", ".arrow", None),
    ("MBTiles", "MBTiles", ".mbtiles", None),
    ("OpenFileGDB", "OpenFileGDB", ".gdb", "table"),
    ("FileGDB", "ESRI File Geodatabase", ".gdb", "table"),
    ("GeoRSS", "GeoRSS", ".xml", "xml"),
    ("MVT", "MVT (Mapbox Vector Tiles)", ".mvt", None),
    ("PMTiles", "PMTiles", ".pmtiles", None),
    ("JSONFG", "JSONFG (OGC JSON)", ".json", None),
    ("MapML", "MapML", ".mapml", None),
    ("PDF", "PDF (Geospatial)", ".pdf", None),
    ("VDV", "VDV (Transit Data)", ".vdv", None),
    ("JML", "JML (OpenJUMP)", ".jml", None),
    ("PGDUMP", "PGDUMP (PostgreSQL SQL)", ".sql", "text"),
    ("MiraMonVector", "MiraMon Vector", ".pol", None),
    ("OGR_GMT", "GMT ASCII (.gmt)", ".gmt", "text"),
    ("Selafin", "Selafin", ".slf", None),
    ("WAsP", "WAsP (.map)", ".map", None),
    ("XLSX", "XLSX", ".xlsx", None),
    ("ODS", "ODS", ".ods", None),
)
RASTER = (
    ("GTiff", "GeoTIFF", ".tif", None),
    ("COG", "Cloud Optimized GeoTIFF", ".tif", None),
    ("VRT", "Virtual Raster", ".vrt", None),
    ("ENVI", "ENVI (.hdr)", ".dat", None),
    ("EHdr", "EHdr (ESRI BIL)", ".bil", None),
    ("ECW", "ECW (Wavelet)", ".ecw", None),
    ("PNG", "PNG", ".png", None),
    ("JPEG", "JPEG", ".jpg", None),
    ("JPEG2000", "JPEG2000", ".jp2", None),
    ("WEBP", "WebP", ".webp", None),
    ("JPEGXL", "JPEG XL", ".jxl", None),
    ("GIF", "GIF", ".gif", None),
    ("NetCDF", "NetCDF", ".nc", None),
    ("BMP", "BMP", ".bmp", None),
    ("MBTiles", "MBTiles", ".mbtiles", None),
    ("HFA", "ERDAS Imagine (.img)", ".img", None),
    ("PCIDSK", "PCIDSK", ".pix", None),
    ("NITF", "NITF", ".ntf", None),
    ("GRIB", "GRIB (.grb)", ".grb", None),
    ("SAGA", "SAGA GIS (.sdat)", ".sdat", None),
    ("Zarr", "Zarr", ".zarr", None),
    ("AAIGrid", "AAIGrid (ASCII)", ".asc", None),
    ("DTED", "DTED", ".dt2", None),
    ("SRTMHGT", "SRTMHGT", ".hgt", None),
    ("XYZ", "XYZ Grid", ".xyz", "csv"),
    ("PDF", "PDF (Geospatial)", ".pdf", None),
    ("PCRaster", "PCRaster", ".map", None),
    ("ILWIS", "ILWIS", ".mpr", None),
    ("RST", "RST (Idrisi)", ".rst", None),
    ("ZMap", "ZMap", ".zmap", None),
    ("SIGDEM", "SIGDEM", ".sigdem", None),
    ("Terragen", "Terragen", ".ter", None),
)
# Drivers that need a live connection.
CONNECTED = (
    "MySQL", "PostgreSQL", "PGeo", "MSSQLSpatial", "SDE", "Oracle", "Carto", "AmigoCloud", "Elasticsearch", "CouchDB",
    "MongoDBv3", "GNS", "WFS", "OAPIF", "GPSBabel", "BAG",
)
FALLBACK_EXTENSION = ".gpkg"


def _rows(formats, kind: str) -> list[tuple[str, str, str, str, int, str | None]]:
    return [(driver, kind, label, ext, i, fmt) for i, (driver, label, ext, fmt) in enumerate(formats)]


ROWS = _rows(VECTOR, "vector") + _rows(RASTER, "raster")
EXTENSION = {driver: ext for driver, _, _, ext, _, _ in ROWS}
SPARK_FORMAT = {driver: fmt for driver, _, _, _, _, fmt in ROWS if fmt}


def extension_of(driver: str) -> str:
    return EXTENSION.get(driver, FALLBACK_EXTENSION)


def values_sql(rows, columns: str) -> str:
    quote = lambda v: "CAST(NULL AS STRING)" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) AS v({columns})"


def formats(spark: SparkSession) -> DataFrame:
    """(driver, kind, label, ext, ord, spark_format)"""
    return spark.sql(values_sql(ROWS, "driver, kind, label, ext, ord, spark_format"))


def counts_by_kind(formats: DataFrame) -> DataFrame:
    """(kind, n)"""
    return formats.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def connected(spark: SparkSession) -> DataFrame:
    return spark.sql(values_sql([(d,) for d in CONNECTED], "driver"))


def ordered_formats(available: DataFrame, kind: str) -> DataFrame:
    """(pos, label, driver): the available drivers of a kind in preferred order; unknown ones by name at the end, with
    the driver as label; connection-type drivers are left out."""
    spark = available.sparkSession
    known = formats(spark).filter(F.col("kind") == kind)
    offered = available.filter(F.col("kind") == kind).select("driver").distinct().join(F.broadcast(connected(spark)), "driver", "left_anti")
    named = offered.join(F.broadcast(known), "driver", "left").select(F.coalesce("label", "driver").alias("label"), "driver", "ord")
    from pyspark.sql import Window as W

    # A registry of a few dozen rows; its order is a single window.
    order = W.orderBy(F.col("ord").asc_nulls_last(), "driver")
    return named.select((F.row_number().over(order) - 1).alias("pos"), "label", "driver")
