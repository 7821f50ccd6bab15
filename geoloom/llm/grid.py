"""Held rows against streamed rows, block by block: neither side passes one task, and no pair of rows is emitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dealt(held: DataFrame, streamed: DataFrame, groups: int, tasks: int, key: Column, order: list[str]) -> DataFrame:
    """Both sides in cells, one cell a task: every row of `held` (which has `group`, 0 to groups - 1) meets every row of
    `streamed` in exactly one cell. `held` marks the rows of the first side; within a cell rows come in the given order,
    held rows before streamed ones.

    A held row goes to as many cells as its group has (tasks // groups, one at least), a streamed row to one cell of
    each group, by `key`. Groups are of bounded size, so a task holds one of them and lets the streamed rows pass."""
    shares = max(1, tasks // groups)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    first = held.withColumn("held", F.lit(True)).withColumn("share", numbers(shares))
    second = streamed.withColumns({"held": F.lit(False), "share": F.pmod(F.xxhash64(key), F.lit(shares)).cast("int")}).withColumn("group", numbers(groups))
    cells = first.unionByName(second, allowMissingColumns=True).withColumn("cell", (F.col("group") * shares + F.col("share")).cast("int"))
    return cells.drop("group", "share").repartitionById(groups * shares, F.col("cell")).sortWithinPartitions("cell", *order, F.desc("held"))


def group_of(key: Column, groups: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")
