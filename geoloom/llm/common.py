"""What the operators of this subpackage share: durable intermediates, ranks, and byte slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.sources.scratch import scratch_path

MIN_LONG = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(key: Column, text: Column) -> Column:
    """24 bytes that stand for an id and a text: the id, so that keys are in the order of ids (null first), and 128 bits
    of the text's digest (a null text is empty)."""
    number = F.coalesce(key.cast("long"), F.lit(MIN_LONG)).bitwiseXOR(F.lit(MIN_LONG))
    digest = F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32)
    return F.unhex(F.concat(F.lpad(F.hex(number), 16, "0"), digest))


def saved(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage is cut, and a lost executor loses no copy."""
    return Work(df.sparkSession, name).saved(df, "rows", codec)


class Work:
    """The tables that one job writes to the shared folder and reads back, by name, so that it can drop those that
    nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, scratch_path(spark, name), {}

    def saved(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        known = self.paths.setdefault(name, [])
        known.append(f"{self.root}/{name}-{len(known)}")
        df.write.option("compression", codec).parquet(known[-1])
        return self.spark.read.schema(df.schema).parquet(known[-1])

    def drop(self, *names: str) -> None:
        context = self.spark.sparkContext
        for path in [p for name in names for p in self.paths.pop(name, [])]:
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def long_literals(values: list[int]):
    """An array column of integers that the driver already holds (bounded by its caller)."""
    return F.expr("array(" + ", ".join(f"{v}L" for v in values) + ")") if values else F.expr("cast(array() as array<bigint>)")


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """`df` in total order: `_part` and `_row` (position within the part) are stored with the rows, so they are durable."""
    sorted_df = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    return saved(
        sorted_df.withColumn("_part", F.shiftright(at, 33)).withColumn("_row", at.bitwiseAND(F.lit((1 << 33) - 1))),
        name,
    )


def arrow_slices(batch, column: str, most: int):
    """Cut an Arrow batch into slices whose `column` holds at most `most` bytes (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
