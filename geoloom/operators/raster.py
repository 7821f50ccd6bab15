"""Raster cells as tables (x, y, value): crop, resample, no data, systems.

A finer grid or another system is filled from the target's side (`on_grid`): each target centre is mapped back to the
source and takes the cell it falls into, so that no cell stays empty. `resampled` and `warped` gather source cells into
coarser ones."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import crs

#: Rows and columns of the tiles in which a target grid is made.
TILE = 256


@dataclass(frozen=True)
class Grid:
    """Cells counted from (x0, y0), the outer corner of cell (0, 0). Where yres is negative, rows go down."""

    x0: float
    y0: float
    xres: float
    yres: float
    columns: int
    rows: int
    srid: int = 4326

    @property
    def extent(self) -> tuple[float, float, float, float]:
        x, y = self.x0 + self.columns * self.xres, self.y0 + self.rows * self.yres
        return min(self.x0, x), min(self.y0, y), max(self.x0, x), max(self.y0, y)


def grid_over(extent: tuple[float, float, float, float], xres: float, yres: float, srid: int = 4326) -> Grid:
    """The cells of a size that cover an extent, from its lower left corner."""
    xmin, ymin, xmax, ymax = extent
    count = lambda size, res: max(1, math.ceil(size / res - 1e-9))
    return Grid(xmin, ymin, xres, yres, count(xmax - xmin, xres), count(ymax - ymin, yres), srid)


def grid_cells(spark: SparkSession, grid: Grid) -> DataFrame:
    """(trow, tcol, x, y): all cells of a grid with their centres, tile by tile."""
    across, down = -(-grid.columns // TILE), -(-grid.rows // TILE)
    tiles = spark.range(across * down).select((F.floor(F.col("id") / across) * TILE).alias("top"), (F.col("id") % across * TILE).alias("left"))
    until = lambda start, size: F.sequence(F.col(start), F.least(F.col(start) + TILE, F.lit(size)) - 1)
    rows = tiles.select("left", F.explode(until("top", grid.rows)).alias("trow"))
    cells = rows.select("trow", F.explode(until("left", grid.columns)).alias("tcol"))
    return cells.withColumns({"x": grid.x0 + (F.col("tcol") + 0.5) * grid.xres, "y": grid.y0 + (F.col("trow") + 0.5) * grid.yres})


def on_grid(cells: DataFrame, source: Grid, target: Grid, method: str = "nearest") -> DataFrame:
    """(trow, tcol, x, y, value, srid) for every cell of `target`; `cells` (x, y, value) are centres on `source`.

    Nearest takes the cell that the target's centre falls into; bilinear weighs the four cells around it, without those
    that have no value. Null where there is none, and outside the source. Of several rows for one source cell the lowest
    and leftmost counts."""
    spark = cells.sparkSession
    wanted = grid_cells(spark, target)
    x, y = crs.reprojected(F.col("x"), F.col("y"), target.srid, source.srid)
    wanted = wanted.withColumns({"_col": (x - source.x0) / source.xres, "_row": (y - source.y0) / source.yres})
    at = {"_row": F.floor((F.col("y") - source.y0) / source.yres), "_col": F.floor((F.col("x") - source.x0) / source.xres)}
    known = cells.withColumns(at).groupBy("_row", "_col").agg(F.min_by("value", F.struct("y", "x")).alias("value"))
    kept = ["trow", "tcol", "x", "y"]
    if method == "nearest":
        placed = wanted.withColumns({"_row": F.floor("_row"), "_col": F.floor("_col")})
        return placed.join(known, ["_row", "_col"], "left").select(*kept, "value", F.lit(target.srid).alias("srid"))
    if method != "bilinear":
        raise ValueError(f"unknown method {method}")
    inside = F.col("_row").between(0, source.rows) & F.col("_col").between(0, source.columns)
    up, right = F.col("_row") - 0.5 - F.col("_r"), F.col("_col") - 0.5 - F.col("_c")
    weights = {(0, 0): (1 - up) * (1 - right), (0, 1): (1 - up) * right, (1, 0): up * (1 - right), (1, 1): up * right}
    # A source cell is a corner of four squares between centres, so squares with their four values are few, and a target
    # cell meets one of them, instead of four cells that would have to be brought together again.
    corners = F.explode(F.array(*[F.struct((F.col("_row") - r).alias("_r"), (F.col("_col") - c).alias("_c"), F.lit(2 * r + c).alias("i")) for r, c in weights]))
    squares = known.filter("value IS NOT NULL").select(corners.alias("q"), "value").groupBy("q._r", "q._c")
    values = squares.agg(*[F.max(F.when(F.col("q.i") == 2 * r + c, F.col("value"))).alias(f"_v{r}{c}") for r, c in weights])
    low = {c: F.when(inside, F.floor(F.col(of) - 0.5)) for c, of in (("_r", "_row"), ("_c", "_col"))}
    met = wanted.withColumns(low).join(values, ["_r", "_c"], "left")
    total, weight = F.lit(0.0), F.lit(0.0)
    for (r, c), w in weights.items():
        counts = (w > 0) & F.col(f"_v{r}{c}").isNotNull()
        total, weight = total + F.when(counts, w * F.col(f"_v{r}{c}")).otherwise(0.0), weight + F.when(counts, w).otherwise(0.0)
    return met.select(*kept, F.when(weight > 0, total / weight).alias("value"), F.lit(target.srid).alias("srid"))


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """Cells from 'x y value' lines."""
    return spark.read.schema("x double, y double, value double").option("sep", " ").csv(path)


def write_xyz(cells: DataFrame, path: str, nodata: float | None = None) -> None:
    value = F.col("value") if nodata is None else F.coalesce("value", F.lit(nodata))
    cells.select("x", "y", value.alias("value")).write.option("sep", " ").csv(path)


def cropped(cells: DataFrame, extent: tuple[float, float, float, float]) -> DataFrame:
    xmin, ymin, xmax, ymax = extent
    return cells.filter(F.col("x").between(xmin, xmax) & F.col("y").between(ymin, ymax))


def without_nodata(cells: DataFrame, nodata: float | None) -> DataFrame:
    return cells if nodata is None else cells.withColumn("value", F.nullif("value", F.lit(nodata)))


def resampled(cells: DataFrame, x0: float, y0: float, xres: float, yres: float, method: str = "nearest", by: tuple[str, ...] = ()) -> DataFrame:
    """Coarser cells, counted from (x0, y0), where there is a source cell; see `on_grid` for finer ones. Nearest takes the cell nearest to the new centre, then the lowest
    and leftmost; average takes the mean of the cells that have a value. Partial aggregates only."""
    at = cells.withColumns({"tcol": F.floor((F.col("x") - x0) / xres), "trow": F.floor((F.col("y") - y0) / yres)})
    centre_x, centre_y = x0 + (F.col("tcol") + 0.5) * xres, y0 + (F.col("trow") + 0.5) * yres
    distance = (F.col("x") - centre_x) ** 2 + (F.col("y") - centre_y) ** 2
    value = F.avg("value") if method == "average" else F.min_by("value", F.struct(distance, F.col("y"), F.col("x")))
    return (
        at.groupBy(*by, "trow", "tcol")
        .agg(value.alias("value"))
        .withColumns({"x": x0 + (F.col("tcol") + 0.5) * xres, "y": y0 + (F.col("trow") + 0.5) * yres})
    )


def labelled(cells: DataFrame, srid: int) -> DataFrame:
    """The reference system set, coordinates unchanged."""
    return cells.withColumn("srid", F.lit(srid))


def warped(cells: DataFrame, source: int, target: int, x0: float, y0: float, xres: float, yres: float, method: str = "nearest") -> DataFrame:
    """Cell centres in another system, gathered into coarser cells of its grid; see `on_grid` for a grid without holes."""
    x, y = crs.reprojected(F.col("x"), F.col("y"), source, target)
    moved = cells.withColumns({"x": x, "y": y}).filter("x IS NOT NULL AND y IS NOT NULL")
    return labelled(resampled(moved, x0, y0, xres, yres, method), target)


def read_container(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """One raster of a container; the others' files are not read."""
    return spark.read.parquet(path).filter(F.col("layer") == layer)


def write_container(cells: DataFrame, path: str) -> None:
    """Many rasters in one table, a partition for each `layer`."""
    cells.write.partitionBy("layer").parquet(path)
