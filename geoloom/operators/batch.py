"""Batches: building specs, checking them, running them one by one, and summing up."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.functions import names
from geoloom.operators import sinks
from geoloom.operators.export import ExportSpec, exported

RESULTS = "name string, driver string, success boolean, output_path string, error string, features_written long, seconds double"


def fanned_out(layers: DataFrame, formats: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """Specs: every layer in every format of its kind. A layer with formats of its own in `settings` (layer_id,
    driver) uses those instead of the global ones."""
    wide = layers.join(F.broadcast(formats.select("driver", "kind")), "kind")  # the registry: a few dozen rows
    if settings is not None:
        own = settings.select("layer_id", F.col("driver").alias("own")).distinct()
        has_own = own.select("layer_id").distinct()
        wide = wide.join(has_own, "layer_id", "left_anti").unionByName(
            layers.join(own, "layer_id").withColumnRenamed("own", "driver").select(*wide.columns)
        )
    return wide.select("layer_id", "name", "kind", "srid", "driver")


def validated(specs: DataFrame, layers: DataFrame, known_srids: tuple[int, ...] = (4326, 3857)) -> DataFrame:
    """`specs` (layer_id, target_srid, ...) with `reason`, null where a spec can run. The others go on without it."""
    known = layers.select("layer_id", F.col("kind").alias("layer_kind"), F.col("srid").alias("layer_srid"))
    joined = specs.join(known, "layer_id", "left")
    reason = (
        F.when(F.col("layer_kind").isNull(), "layer not found")
        .when(~F.col("layer_kind").isin("vector", "raster"), "layer type not supported")
        .when(~F.coalesce("target_srid", "layer_srid").isin(*known_srids), "unknown reference system")
    )
    return joined.withColumn("reason", reason)


def by_kind(layers: DataFrame, kind: str | None) -> DataFrame:
    return layers if kind is None else layers.filter(F.col("kind") == kind)


def current_settings(settings: DataFrame, layers: DataFrame) -> DataFrame:
    """Settings of layers that still exist."""
    return settings.join(layers.select("layer_id"), "layer_id", "left_semi")


def duplicate_names(df: DataFrame, name: str) -> DataFrame:
    """(name, n) of names used more than once."""
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def overwriting(df: DataFrame, name: str, order: str) -> DataFrame:
    """Rows that would overwrite an earlier row's output; names used once fall out before the window."""
    shared = df.join(duplicate_names(df, name).select(name), name, "left_semi")
    return shared.withColumn("rank", F.row_number().over(W.partitionBy(name).orderBy(order))).filter("rank > 1")


def run(
    spark: SparkSession, specs: list[ExportSpec], layer_of: Callable[[ExportSpec], tuple[DataFrame, int]], selection: DataFrame | None = None
) -> DataFrame:
    """Run specs in order; a spec that fails leaves an error row and the rest go on. `layer_of` gives a spec's rows and
    reference system. Rows are counted while they are written."""
    rows = []
    for spec in specs:
        began = time.monotonic()
        path, error, written = "", "", 0
        try:
            layer, srid = layer_of(spec)
            seen = Observation()
            path = sinks.write(exported(layer, spec, srid, selection), spec, seen)
            written = seen.get["n"]
        except Exception as e:  # noqa: BLE001  (the batch goes on)
            error = str(e).splitlines()[0] if str(e) else type(e).__name__
        rows.append((spec.name, spec.driver, not error, path if not error else "", error, written, time.monotonic() - began))
    return spark.createDataFrame(rows, RESULTS)


def summary(results: DataFrame) -> DataFrame:
    """(ok, failed, seconds)"""
    return results.agg(F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"), F.round(F.sum("seconds"), 3).alias("seconds"))


def result_lines(results: DataFrame) -> DataFrame:
    line = F.when(F.col("success"), F.format_string("OK %s -> %s (%d)", "name", "output_path", "features_written")).otherwise(F.format_string("FAILED %s: %s", "name", "error"))
    return results.select(line.alias("line"))


def layer_counts(layers: DataFrame, selected: DataFrame, condition: str) -> DataFrame:
    """(loaded, selected, filtered)"""
    marked = layers.join(selected.select("layer_id").distinct().withColumn("_on", F.lit(True)), "layer_id", "left")
    return marked.agg(F.count(F.lit(1)).alias("loaded"), F.count_if("_on").alias("selected"), F.count_if(F.expr(condition)).alias("filtered"))


def storage_classes(df: DataFrame, source: str) -> DataFrame:
    """(storage, n): sources that are files, remote or scratch."""
    return df.groupBy(names.source_class(F.col(source)).alias("storage")).agg(F.count(F.lit(1)).alias("n"))


def remote_rasters(layers: DataFrame, source: str = "source") -> DataFrame:
    return layers.filter(names.starts_with_any(F.lower(source), names.REMOTE_RASTERS))
