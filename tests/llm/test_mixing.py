import re
from collections import defaultdict

import duckdb
import pytest

from geoloom.llm import mixing as mx


def targets(rows):
    """Source sizes and targets by sharing out again until none is above."""
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    full, left = {}, sum(size.values())
    while True:
        free = [s for s in order if s not in full]
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > 3 * size[s]]
        if not over:
            return size, {s: full.get(s, weight[s] * level) for s in order}
        for s in over:
            full[s] = 3.0 * size[s]
            left -= 3 * size[s]


def mixed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS key", "3 AS target", "4 AS place", "5 AS n")
    return [r.asDict() for r in mx.mixed(df).collect()]


def check(rows, got, near):
    size, target = targets(rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted(
        (i is None, i or 0, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _ in rows
    )
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]], rel=1e-12)
        assert r["size"] == 0 == r["taken"] or r["taken"] % r["size"] == 0 and r["taken"] // r["size"] <= 3
        taken[r["source"]] += r["taken"]
    for s in size:
        assert abs(taken[s] - target[s]) <= near(s, target[s]), s


def test_targets_and_takes(spark, prose):
    """Small sources that reach three times their size, a hot source, nulls, blanks."""
    rows = [(i, prose(i, 1 + i % 50), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(600)]
    rows += [(700 + i, prose(i, 3), "tiny") for i in range(4)] + [(800, None, "tiny"), (801, " \n", "none"), (None, "a b", None), (None, "c", None), (1, "x", "É"), (1, "x", "É")]
    got = mixed(spark, rows)
    check(rows, got, lambda s, wanted: 50)  # no text is longer
    assert sorted(map(str, got)) == sorted(map(str, mixed(spark, rows[::-1])))
    assert all(r["taken"] == 3 * r["size"] for r in got if r["source"] == "tiny")


def test_refined_to_the_last_row(spark, monkeypatch, prose):
    """The bucket in which the rest ends is cut again, down to rows that agree in id and size."""
    monkeypatch.setattr(mx, "REFINED", 2)
    rows = [(i, prose(i, 5), "a") for i in range(300)] + [(7, f"w w{i}", "b") for i in range(500)] + [(9, "w", "c")] * 100
    got = mixed(spark, rows)
    check(rows, got, lambda s, wanted: 5)
    counts = defaultdict(int)
    for r in got:
        counts[r["source"], r["taken"]] += 1
    assert sorted(map(str, got)) == sorted(map(str, mixed(spark, rows)))
    assert len({t for s, t in counts if s == "b"}) == 2


def test_one_source_and_none(spark):
    assert mixed(spark, []) == []
    assert [r["taken"] for r in mixed(spark, [(1, "a b", None)])] == [2]
    assert [(r["taken"], r["target"]) for r in mixed(spark, [(1, None, "x"), (2, "", "y")])] == [(0, 0.0)] * 2


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_the_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf{sf}/documents.parquet'")
    got = mx.op13_mixing(spark, f"/root/testdata/sf{sf}")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(mx.oracle()).fetchall())
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()
