"""Ranges of the Morton curve, and the look-up of one content."""

import random

import pytest

from geoloom.operators import bundle, export, sinks
from geoloom.sources import views


def key(x, y):
    return sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(15))


@pytest.mark.parametrize("most", [1, 8, 64, 4000])
def test_ranges_hold_the_box(most):
    rng = random.Random(most)
    for _ in range(30):
        xs, ys = sorted(rng.uniform(-180, 180) for _ in "ab"), sorted(rng.uniform(-90, 90) for _ in "ab")
        found = sinks.morton_ranges((xs[0], ys[0], xs[1], ys[1]), most=most)
        assert 1 <= len(found) <= most and all(a[1] + 1 < b[0] for a, b in zip(found, found[1:]))
        cells = 0
        for _ in range(50):
            x, y = rng.uniform(*xs), rng.uniform(*ys)
            cell = key(int((x + 180) / 360 * 32768), int((y + 90) / 180 * 32768))
            assert any(low <= cell <= high for low, high in found)
        cells = sum(high - low + 1 for low, high in found)
        area = (int((xs[1] + 180) / 360 * 32768) - int((xs[0] + 180) / 360 * 32768) + 1) * (int((ys[1] + 90) / 180 * 32768) - int((ys[0] + 90) / 180 * 32768) + 1)
        assert cells >= area and (most < 4000 or cells == area or cells < 1.5 * area + 4**7)
    assert sinks.morton_ranges((-180, -90, 180, 90)) == [(0, 4**15 - 1)]
    assert sinks.morton_ranges((5, 5, 4, 6)) == []


def rows_read(df):
    """Rows that the scans of a plan gave, after it has run."""
    df.collect()
    total, open_ = 0, [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            open_.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan") and node.metrics().contains("numOutputRows"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        open_ += [children.apply(i) for i in range(children.size())]
        if "QueryStage" in node.nodeName():
            open_.append(node.plan())
    return total


def test_long_boxes_skip_files(spark, tmp_path):
    layer = views.features(spark, "/root/testdata/sf0.01").select("fid", "x", "y")
    sinks.clustered(layer, 64, keep_key=True).write.parquet(f"{tmp_path}/f")
    stored = spark.read.parquet(f"{tmp_path}/f")
    for box in ((-175.0, 12.0, 175.0, 16.0), (100.0, -85.0, 104.0, 85.0), (-10.0, -10.0, 10.0, 10.0), (0.1, 0.1, 0.1, 0.1)):
        got = sinks.by_extent_on_curve(stored, box)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, export.by_extent(layer, box).collect()))
        assert rows_read(got) < layer.count() / 2, box
    plan = sinks.by_extent_on_curve(stored, (-175.0, 12.0, 175.0, 16.0))._jdf.queryExecution().executedPlan().toString()
    assert "Or(And(GreaterThanOrEqual(" in plan.split("PushedFilters: ")[1]


def test_boxes_with_a_margin(spark, sf_dir, tmp_path):
    boxes = views.boxes(spark, sf_dir).select("fid", "xmin", "ymin", "xmax", "ymax")
    sinks.clustered(boxes, 8, keep_key=True).write.parquet(f"{tmp_path}/b")
    box = (20.0, -30.0, 90.0, 40.0)
    got = sinks.by_extent_on_curve(spark.read.parquet(f"{tmp_path}/b"), box, margin=2.5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, export.by_extent(boxes, box).collect()))


def test_one_entry_reads_one_row_group(spark, tmp_path):
    rows = [(f"f{i:04}", bytearray(random.Random(i).randbytes(2000))) for i in range(400)] + [("same", bytearray(random.Random(7).randbytes(2000)))]
    entries = spark.createDataFrame(rows, "name string, content binary")
    bundle.pack(entries, f"{tmp_path}/b", row_group=64 << 10)
    for name, body in (rows[7], rows[399], rows[400]):
        found = bundle.entry(spark, f"{tmp_path}/b", name)
        assert [(r.name, r.content) for r in found.collect()] == [(name, body)]
        assert rows_read(found) <= 100  # the fewest that the writer puts into a row group
    assert bundle.entry(spark, f"{tmp_path}/b", "none").collect() == []
    assert bundle.verified(bundle.index(entries), spark.read.parquet(f"{tmp_path}/b/blobs")).count() == 0
