"""Layer trees that are deep, wide or broken, and the nested document."""

import json
import random

from pyspark.sql import functions as F

from geoloom.operators import tree

SCHEMA = "id string, parent string, name string, layer boolean"


def brute(nodes):
    """{id: (depth, path)} by walking up from each node."""
    above = {i: (p, n) for i, p, n, _ in nodes}
    out = {}
    for i, p, _, _ in nodes:
        names = []
        while p is not None:
            names.insert(0, above[p][1].lower())
            p = above[p][0]
        out[i] = (len(names), "_".join(names))
    return out


def nested(nodes):
    """{root: document}"""
    def doc(i, name, layer):
        if layer:
            return {"type": "layer", "name": name or ""}
        return {"type": "group", "name": name or "", "children": [doc(*c) for c in sorted((j, n, la) for j, p, n, la in nodes if p == i)]}

    return {i: doc(i, n, la) for i, p, n, la in nodes if p is None}


def test_deep_and_random_trees(spark):
    chain = [(f"n{i}", f"n{i - 1}" if i else None, f"g{i}", False) for i in range(150)]
    rng = random.Random(1)
    bushy = [(f"b{i}", f"b{rng.randrange(i)}" if i > 3 else None, f"x{i % 7}", False) for i in range(200)]
    bushy += [(f"l{i}", f"b{rng.randrange(200)}", f"layer {i}", True) for i in range(100)]
    for nodes in (chain, bushy, chain + bushy):
        df = spark.createDataFrame(nodes, SCHEMA)
        got = {r.id: (r.depth, r.path) for r in tree.with_paths(df).collect()}
        assert got == brute(nodes)
        assert tree.faults(df).count() == 0
    paths = {r.id: r.group_path for r in tree.group_paths(spark.createDataFrame(bushy, SCHEMA)).collect()}
    assert paths == {i: p if len(p) <= 63 else p[:63].rstrip("_") for i, (_, p) in brute(bushy).items() if i[0] == "l"}


def test_wide_tree(spark):
    nodes = spark.range(1_200_000).selectExpr("CAST(id AS STRING) AS id", "CASE WHEN id > 0 THEN CAST(id % 2000 DIV 40 AS STRING) END AS parent", "'n' AS name", "id >= 2000 AS layer")
    nodes = nodes.withColumn("parent", F.when(F.col("id") == F.col("parent"), F.lit(None)).otherwise(F.col("parent")))
    r = tree.group_paths(nodes).agg(F.count(F.lit(1)).alias("n"), F.max(F.length("group_path")).alias("longest")).first()
    assert r.n == 1_198_000 and r.longest >= 3


def test_broken_nodes_are_reported(spark):
    rows = [("r", None, "R", False), ("a", "r", "A", False), ("x", "y", "X", False), ("y", "z", "Y", False), ("z", "x", "Z", False), ("below", "x", "B", True), ("self", "self", "S", False),
            ("lost", "gone", "L", False), ("under", "lost", "U", False), ("leaf", "a", "F", True), ("odd", "leaf", "O", False), ("odder", "odd", "P", True)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.id: r.fault for r in tree.faults(df).collect()} == {
        **dict.fromkeys(("x", "y", "z", "below", "self"), tree.CYCLE), **dict.fromkeys(("lost", "under"), tree.ORPHAN), **dict.fromkeys(("odd", "odder"), tree.UNDER_LAYER),
    }
    assert {r.id for r in tree.with_paths(df).collect()} == {"r", "a", "leaf"}
    assert {r.root: json.loads(r.value) for r in tree.tree_documents(df).collect()} == nested(rows[:2] + [rows[9]])


def test_nested_documents(spark):
    rng = random.Random(2)
    nodes = [(f"g{i:03}", f"g{rng.randrange(max(0, i - 9), i):03}" if i > 2 else None, ['a "q"', "b\\c", None, "日本\n", "{}"][i % 5], False) for i in range(120)]
    nodes += [(f"l{i:03}", f"g{rng.randrange(120):03}" if i % 20 else None, f"L{i}", True) for i in range(80)]
    df = spark.createDataFrame(nodes, SCHEMA)
    got = {r.root: json.loads(r.value) for r in tree.tree_documents(df).collect()}
    assert got == nested(nodes) and len(got) == 7
    assert tree.tree_documents(df.limit(0)).count() == 0 and tree.with_paths(df.limit(0)).count() == 0


def test_long_paths_are_written_down_for_few_nodes(spark, monkeypatch):
    written, durable = [], tree.durable

    def kept(df):
        out = durable(df)
        if "path" in out.columns:
            written.append(out.selectExpr("coalesce(sum(length(path)), 0)").first()[0])
        return out

    monkeypatch.setattr(tree, "durable", kept)
    n = 240
    nodes = spark.range(n).selectExpr("id", "CASE WHEN id > 0 THEN id - 1 END AS parent", "concat('n', id) AS name", "false AS layer")
    got = {r.id: (r.depth, r.path) for r in tree.with_paths(nodes).collect()}
    assert got == {i: (i, "_".join(f"n{j}" for j in range(i))) for i in range(n)}
    assert sum(written) < 2 * sum(len(p) for _, p in got.values())
