"""The given tables, and the feature, file and cell tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geometry as G

FEATURES_SQL = """SELECT event_id AS fid, ((event_id * 7919) % 360000) / 1000.0{d} - 180.0{d} AS x,
  ((event_id * 104729) % 170000) / 1000.0{d} - 85.0{d} AS y, event_type, value, ts, user_id FROM events"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as points (EPSG:4326)."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS fid", "((event_id * 7919) % 360000) / 1000.0d - 180.0d AS x", "((event_id * 104729) % 170000) / 1000.0d - 85.0d AS y",
        "event_type", "value", "ts", "user_id",
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`part` as squares."""
    corner = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS fid", "p_name AS name", "((p_partkey * 7919) % 360000) / 1000.0d - 180.0d AS xmin",
        "((p_partkey * 104729) % 170000) / 1000.0d - 85.0d AS ymin", "p_size / 10.0d AS side",
    )
    full = corner.withColumns({"xmax": F.col("xmin") + F.col("side"), "ymax": F.col("ymin") + F.col("side")})
    return full.withColumn("geom", G.make_box(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`part` as squares, open lines, pairs of squares and points, by turns; every 11th has no geometry."""
    at = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS shape_id", "p_partkey % 4 AS turn", "CAST(p_partkey % 100 AS DOUBLE) AS x0", "CAST(p_partkey % 50 AS DOUBLE) AS y0", "CAST(p_size AS DOUBLE) AS side",
    )
    x, y, side = F.col("x0"), F.col("y0"), F.col("side")
    square = G.make_box(x, y, x + side, y + side)
    line = G.make_line(F.array(G.point(x, y), G.point(x + side, y), G.point(x + side, y + side)))
    pair = F.struct(
        F.lit("MultiPolygon").alias("gtype"), F.lit(4326).alias("srid"), F.lit(False).alias("has_z"),
        F.concat(square["parts"], G.make_box(x + 60, y, x + 60 + side, y + side)["parts"]).alias("parts"),
    ).cast(G.GEOM_TYPE)
    turn = F.col("turn")
    geom = F.when(F.col("shape_id") % 11 == 0, F.lit(None)).when(turn == 0, square).when(turn == 1, line).when(turn == 2, pair).otherwise(G.make_point(x, y))
    made = at.withColumn("geom", geom)
    return made.withColumns(G.box(F.col("geom")))


def archives(spark: SparkSession, sf_dir: str, magic: bytes) -> DataFrame:
    """`documents` as packed archives (path, content) of version 4, each of a text and an empty entry; every 13th is cut off."""

    def number(value, width: int):
        """Little-endian hexadecimal digits of a column or an integer."""
        if isinstance(value, int):
            return F.lit(value.to_bytes(width, "little").hex())
        digits = F.lpad(F.hex(value.cast("long")), 2 * width, "0")
        return F.concat(*[F.substring(digits, 2 * i - 1, 2) for i in range(width, 0, -1)])

    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    named = docs.select("doc_id", "text", F.format_string("%s/%d.txt", "lang", "doc_id").alias("name"), F.format_string("styles/%d.qml", "doc_id").alias("style"), F.octet_length("text").alias("size"))
    first = F.concat(number(7, 4), number(F.length("name"), 4), number(0, 12), number(F.col("size"), 8), number(F.col("size"), 8), number(F.col("doc_id") * 2654435761, 8))
    second = F.concat(number(1, 4), number(F.length("style"), 4), number(0, 4), number(F.col("size"), 8), number(0, 24))
    indexed = named.withColumn("index", F.concat(number(2, 4), first, second, F.hex(F.encode("name", "UTF-8")), F.hex(F.encode("style", "UTF-8"))))
    total = number(F.col("size"), 8)
    head = F.concat(F.lit(magic.hex()), number(4, 4), number(0, 8), number(48, 8), number(F.lit(48) + F.length("index") / 2, 8), total, total)
    whole = indexed.select("doc_id", F.concat(head, "index", F.hex(F.encode("text", "UTF-8"))).alias("whole"))
    cut = F.when(F.col("doc_id") % 13 == 0, F.substring("whole", 1, 40)).otherwise(F.col("whole"))
    return whole.select(F.format_string("%d.arc", "doc_id").alias("path"), F.unhex(cut).alias("content"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as raster cells; -9999 is no data."""
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(event_id DIV 100 AS BIGINT) AS row", "event_id % 100 AS col", "CAST(event_id % 100 AS DOUBLE) AS x",
        "CAST(event_id DIV 100 AS DOUBLE) AS y", "CASE WHEN event_id % 97 = 0 THEN -9999.0d ELSE value END AS value",
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as snapshot entries."""
    return table(spark, sf_dir, "documents").select(
        F.format_string("%s/%d.txt", "lang", "doc_id").alias("name"), F.encode("text", "UTF-8").alias("content"), "doc_id"
    )


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources that a project names: (pos, path)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.format_string("%s/%d.txt", "lang", "doc_id").alias("path"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that exist: sources but every 11th, with styles beside every 5th and 7th."""
    docs = table(spark, sf_dir, "documents")
    made = lambda ext, cond: docs.filter(cond).select(F.format_string(f"%s/%d{ext}", "lang", "doc_id").alias("path"))
    return made(".txt", "doc_id % 11 <> 0").unionByName(made(".qml", "doc_id % 5 = 0")).unionByName(made(".sld", "doc_id % 7 = 0"))


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`nation` as a layer registry."""
    return table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS layer_id", "n_name AS name", "CASE n_nationkey % 3 WHEN 0 THEN 'vector' WHEN 1 THEN 'raster' ELSE 'mesh' END AS kind",
        "CASE n_nationkey % 2 WHEN 0 THEN 4326 ELSE 3857 END AS srid", "n_regionkey AS group_id",
    )


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("fid"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region -> nation -> supplier as nodes (id, parent, name, layer)."""
    regions = table(spark, sf_dir, "region").selectExpr("concat('r', r_regionkey) AS id", "CAST(NULL AS STRING) AS parent", "r_name AS name", "false AS layer")
    nations = table(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey) AS id", "concat('r', n_regionkey) AS parent", "n_name AS name", "false AS layer")
    suppliers = table(spark, sf_dir, "supplier").selectExpr("concat('s', s_suppkey) AS id", "concat('n', s_nationkey) AS parent", "s_name AS name", "true AS layer")
    return regions.unionByName(nations).unionByName(suppliers)
