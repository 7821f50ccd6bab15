"""Exports of streams: the row operators are stateless, so a spec runs on a streaming DataFrame as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from geoloom.operators import registry
from geoloom.operators.export import ExportSpec, exported


def start_export(stream: DataFrame, spec: ExportSpec, checkpoint: str, source_srid: int = 4326) -> StreamingQuery:
    """Append what the spec keeps of the stream to the format's files, once for each input row."""
    form = registry.SPARK_FORMAT.get(spec.driver)
    if form not in ("parquet", "json", "csv"):
        raise ValueError(f"{spec.driver} has no streaming writer")
    rows = exported(stream, spec, source_srid)
    path = f"{spec.output_path.rstrip('/')}/{spec.name}{registry.extension_of(spec.driver)}"
    return rows.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
