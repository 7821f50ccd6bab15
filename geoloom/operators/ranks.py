"""Ranks and running sums in a total order without a single-task window: range partitions, their sums, and offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.sources.scratch import shared_folder


def durable(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that the session names."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """`df` range-partitioned and sorted, with `_part` and `_row` stored."""
    at = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return durable(rows.withColumn("_part", F.shiftright(at, 33)).withColumn("_row", at.bitwiseAND(F.lit((1 << 33) - 1))))


def ranked_within(df: DataFrame, by: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """`name`: rank from 1 within the values of `by`, in the given order. A value may span partitions; its runs'
    counts are joined back by partition and value."""
    rows = in_order(df, [*by, *order])
    runs = rows.groupBy("_part", *by).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # A value's runs: one a partition at most.
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = runs.select("_part", *by, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    same = [rows[c].eqNullSafe(shifts[c]) for c in ("_part", *by)]
    joined = rows.join(shifts, _all(same)).select(rows["*"], "_shift")
    return joined.withColumn(name, F.col("_row") + F.col("_shift") + 1).drop("_part", "_row", "_shift")


def running_sum(df: DataFrame, size: str, order: list[str], name: str = "offset") -> DataFrame:
    """`name`: the sum of `size` over the rows before this one."""
    rows = in_order(df, order)
    sums = rows.groupBy("_part").agg(F.sum(size).alias("_sum"))
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_part").orderBy("_row").rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .drop("_part", "_row", "_before")
    )


def with_previous(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """`df` with prev_<column>: the values of the row before in the given order within the values of `by`, null for the
    first. A value may span partitions; the last row of each partition is handed to the next."""
    rows = in_order(df, [*by, *order])
    held = F.struct(*by, *columns)
    ends = rows.groupBy("_part").agg(F.max_by(held, "_row").alias("_end"))
    ahead = ends.select("_part", F.lag("_end").over(W.orderBy("_part")).alias("_before"))  # one row a partition
    inside = F.lag(held).over(W.partitionBy("_part").orderBy("_row"))
    joined = rows.join(F.broadcast(ahead), "_part").withColumn("_prev", F.coalesce(inside, "_before"))
    same = _all([F.col(f"_prev.{c}").eqNullSafe(F.col(c)) for c in by])
    return joined.withColumns({f"prev_{c}": F.when(same, F.col(f"_prev.{c}")) for c in columns}).drop("_part", "_row", "_before", "_prev")


def _all(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
