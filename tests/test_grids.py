"""Rasters on other grids, and boxes in systems where their edges are curves."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import crs
from geoloom.operators import export, raster
from geoloom.operators.export import ExportSpec

SOURCE = raster.Grid(0.0, 0.0, 1.0, 1.0, 4, 4)


def cells_on(spark, grid, missing=()):
    cells = raster.grid_cells(spark, grid).withColumn("value", (F.col("trow") * 10 + F.col("tcol")).cast("double"))
    return cells.withColumn("value", F.when(~F.col("value").isin(*missing), F.col("value"))) if missing else cells


def table_of(df):
    return {(r.trow, r.tcol): r.value for r in df.collect()}


@pytest.mark.parametrize("tile", [256, 3])
def test_a_finer_grid_has_no_holes(spark, monkeypatch, tile):
    monkeypatch.setattr(raster, "TILE", tile)
    fine = raster.grid_over(SOURCE.extent, 0.25, 0.25)
    got = table_of(raster.on_grid(cells_on(spark, SOURCE), SOURCE, fine))
    assert len(got) == 256 and got == {(r, c): r // 4 * 10.0 + c // 4 for r in range(16) for c in range(16)}


def test_rows_that_go_down_and_cells_outside(spark):
    down = raster.Grid(0.0, 4.0, 1.0, -1.0, 4, 4)
    assert down.extent == SOURCE.extent
    wide = raster.Grid(-1.0, -1.0, 1.0, 1.0, 6, 6)
    got = table_of(raster.on_grid(cells_on(spark, down), down, wide))
    assert len(got) == 36 and got == {(r, c): (4 - r) * 10.0 + c - 1 if 1 <= r <= 4 and 1 <= c <= 4 else None for r in range(6) for c in range(6)}


def test_repeated_cells_and_no_cells(spark):
    cells = cells_on(spark, SOURCE)
    twice = cells.unionByName(cells.withColumns({"y": F.col("y") + 0.2, "value": F.lit(99.0)}))
    assert table_of(raster.on_grid(twice, SOURCE, SOURCE)) == table_of(cells)
    assert set(table_of(raster.on_grid(cells.limit(0), SOURCE, SOURCE)).values()) == {None}
    with pytest.raises(ValueError):
        raster.on_grid(cells, SOURCE, SOURCE, "cubic")


@pytest.mark.parametrize("missing", [(), (11.0, 22.0, 23.0)])
def test_bilinear_against_numpy(spark, missing):
    fine = raster.grid_over(SOURCE.extent, 0.3, 0.25)
    got = table_of(raster.on_grid(cells_on(spark, SOURCE, missing), SOURCE, fine, "bilinear"))
    assert len(got) == fine.rows * fine.columns
    for (r, c), value in got.items():
        x, y = (c + 0.5) * 0.3, (r + 0.5) * 0.25
        total = weight = 0.0
        for row in range(4):
            for col in range(4):
                w = max(0.0, 1 - abs(y - row - 0.5)) * max(0.0, 1 - abs(x - col - 0.5))
                if w and row * 10 + col not in missing:
                    total, weight = total + w * (row * 10 + col), weight + w
        inside = 0 <= x <= 4 and 0 <= y <= 4
        assert value == pytest.approx(total / weight) if weight and inside else value is None, (r, c)


def test_warp_by_inverse_mapping(spark):
    extent = export.extent_in(spark, SOURCE.extent, 4326, 3857)
    target = raster.grid_over(extent, 40000, 40000, 3857)
    got = table_of(raster.on_grid(cells_on(spark, SOURCE), SOURCE, target))
    want = {}
    for r in range(target.rows):
        for c in range(target.columns):
            lon = (target.x0 + (c + 0.5) * target.xres) / crs.DEGREE
            lat = math.degrees(2 * math.atan(math.exp((target.y0 + (r + 0.5) * target.yres) / crs.RADIUS)) - math.pi / 2)
            want[r, c] = math.floor(lat) * 10.0 + math.floor(lon) if lon < 4 and lat < 4 else None
    assert got == want and sum(v is not None for v in want.values()) > 100


# --- curved edges ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("box", "source", "target"), [
    ((6, 50, 12, 60), 4326, 32632), ((2, -3, 11, 5), 4326, 32632), ((300000, 5000000, 800000, 9000000), 32632, 4326), ((300000, 5000000, 800000, 6000000), 32632, 3857), ((8, -40, 20, -10), 4326, 32733),
])
def test_the_least_box_along_the_edges(spark, box, source, target):
    """No point of a finely cut box lies outside, and the box is hardly larger than what they need."""
    got = export.extent_in(spark, box, source, target)
    t = np.linspace(0, 1, 1501)
    x = np.concatenate([box[0] + (box[2] - box[0]) * t] * 2 + [np.full_like(t, box[0]), np.full_like(t, box[2])])
    y = np.concatenate([np.full_like(t, box[1]), np.full_like(t, box[3])] + [box[1] + (box[3] - box[1]) * t] * 2)
    points = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    r = export.layer_extent(export.reprojected_points(points, source, target)).first()
    unit = 1e-9 if target == 4326 else 1e-3
    assert got[0] <= r.xmin + unit and got[1] <= r.ymin + unit and got[2] >= r.xmax - unit and got[3] >= r.ymax - unit
    size = max(r.xmax - r.xmin, r.ymax - r.ymin)
    assert max(abs(a - b) for a, b in zip(got, r, strict=True)) < 1e-4 * size


def test_points_at_the_edge_stay(spark):
    extent = export.effective_extent(None, (6.0, 50.0, 12.0, 60.0), 4326, 32632)
    layer = export.reprojected_points(spark.createDataFrame([(9.0, 50.0), (9.0, 49.99), (6.0, 60.0)], "x double, y double"), 4326, 32632)
    assert export.by_extent(layer, extent).count() == 2
    specs = spark.createDataFrame([(1, 32632, None), (2, 3857, None), (3, 32632, 1.0), (4, 2154, None)], "id int, layer_srid int, xmin double").selectExpr("*", "xmin AS ymin", "xmin AS xmax", "xmin AS ymax")
    rows = {r.id: r for r in export.effective_extents(specs, (6.0, 50.0, 12.0, 60.0), 4326, (32632, 3857)).collect()}
    assert (rows[1].xmin, rows[1].ymin) == extent[:2] and rows[2].xmin == pytest.approx(6 * crs.DEGREE) and rows[3].xmax == 1.0 and rows[4].xmin is None


def test_boxes_that_leave_the_domain(spark):
    boxes = spark.createDataFrame([(1, 6.0, 50.0, 7.0, 51.0), (2, 6.0, 80.0, 7.0, 95.0), (3, None, None, None, None)], "id int, xmin double, ymin double, xmax double, ymax double")
    for target in (3857, 32632):
        spec = ExportSpec("b", "b", target_srid=target)
        assert {r.id for r in export.exported(boxes, spec).collect()} == {1, 3}
        assert {r.id: r.reason for r in export.rejected(boxes, spec).collect()} == {2: export.OUTSIDE}


def test_strict_reprojection_fails_the_layer(spark):
    layer = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 90.0)], "id int, x double, y double")
    assert export.exported(layer, ExportSpec("l", "o", target_srid=3857)).count() == 1
    with pytest.raises(Exception, match="outside the target system"):
        export.exported(layer, ExportSpec("l", "o", target_srid=3857, strict_reprojection=True)).collect()
    assert export.exported(layer.limit(1), ExportSpec("l", "o", target_srid=3857, strict_reprojection=True)).count() == 1


def test_boxes_are_worked_out_once(spark, sf_dir):
    """A filter on the reason goes round the reprojection instead of copying it, and points are taken through in steps."""
    boxes = spark.createDataFrame([(1, 6.0, 50.0, 7.0, 51.0)], "id int, xmin double, ymin double, xmax double, ymax double")
    plan = export.exported(boxes, ExportSpec("b", "b", target_srid=32632))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SINH") + plan.count("sinh") < 60 and len(plan) < 40_000


def test_bilinear_brings_no_target_cells_together(spark):
    cells = spark.range(16).selectExpr("CAST(id % 4 AS DOUBLE) AS x", "CAST(id DIV 4 AS DOUBLE) AS y", "CASE WHEN id <> 5 THEN CAST(id AS DOUBLE) END AS value")
    fine = raster.on_grid(cells, raster.Grid(-0.5, -0.5, 1.0, 1.0, 4, 4), raster.Grid(-1.0, -0.5, 0.5, 0.5, 10, 8), "bilinear")
    assert "keys=[trow" not in fine._jdf.queryExecution().executedPlan().toString()
    got = {(r.trow, r.tcol): r.value for r in fine.collect()}
    # Between cells 0, 1, 4 and 5, of which 5 has no value; and a centre left of the source.
    assert len(got) == 80 and abs(got[1, 2] - (0.5625 * 0 + 0.1875 * 1 + 0.1875 * 4) / 0.9375) < 1e-12 and got[0, 0] is None
