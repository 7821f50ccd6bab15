import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import negatives as ng


def brute(rows, positives=5, negatives=5):
    """(anchor, positive, rank, negative, positive score, negative score) from (id, vector, label) with Python integers."""
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            key = (label, list(map(float, v)))
            good[i] = min(good.get(i, key), key)
    ints = {i: (label, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, (label, v) in good.items()}
    out = set()
    for a, (label, v) in ints.items():
        if a % 100:
            continue
        score = {i: sum(map(int.__mul__, v, w)) for i, (_, w) in ints.items() if i != a and len(w) == len(v)}
        best = sorted((i for i in score if ints[i][0] == label), key=lambda i: (-score[i], i))[:positives]
        other = sorted((i for i in score if ints[i][0] != label), key=lambda i: (-score[i], i))
        for p in best:
            inside = [i for i in other if 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:negatives]
            out |= {(a, p, k + 1, n, score[p], score[n]) for k, n in enumerate(inside)}
    return out


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS id", "2 AS score", "label AS cell")
    return {tuple(r) for r in ng.mined(df, "vec_id", "embedding", F.col("label"), F.col("id") % 100 == 0, **more).collect()}


@pytest.mark.parametrize("largest", [1, 300, 10**7, 2**29 - 1])
def test_products_are_exact(largest):
    rng = np.random.default_rng(largest)
    a, b = (rng.integers(-largest, largest, (n, 2500)) for n in (7, 11))
    a[0], b[0] = largest, -largest  # the largest product there can be
    if largest > 2**25:
        a, b = a[:, :3], b[:, :3]
    got = ng.scores(ng.Block(a), ng.Block(b), slice(0, 7), slice(0, 11))
    assert got.tolist() == (a.astype(object) @ b.astype(object).T).tolist()


def test_primes_tell_apart():
    product = 1
    for count, prime in enumerate(ng.PRIMES):
        assert all(prime % d for d in range(2, 16))
        assert ng.primes_for((product - 1) / 2 * 0.99) <= max(1, count) and ng.primes_for(product) > count
        product *= prime
    assert product > 2 * ng.LARGEST_SQUARES and (ng.PRIMES[0] // 2) ** 2 * ng.WIDTH < 2**24


@pytest.mark.parametrize("group_bytes", [16 << 20, 3000])
def test_against_brute_force(spark, monkeypatch, group_bytes):
    """Few groups and many, with ties, repeats, clashing columns and a label that holds most rows."""
    monkeypatch.setattr(ng, "GROUP_BYTES", group_bytes)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=12)
    rows = [(i, (centre + 0.4 * rng.normal(size=12)).astype(np.float32).tolist(), 0 if i % 3 else i % 5) for i in range(900)]
    rows += [(1000 + i, rows[0][1], i % 4) for i in range(120)]  # equal vectors under several labels
    rows += rows[5:9] + [(200, [1.0] * 12, 7), (100, None, 1)]
    want = brute(rows)
    assert len(want) > 100 and mined(spark, rows) == want


def test_rows_that_take_no_part(spark):
    rows = [
        (0, [1.0, 2.0], 1), (1, [1.0, 2.5], 1), (2, [1.0, 2.25], 2), (3, None, 2), (4, [1.0, None], 2), (5, [float("nan"), 1.0], 2), (6, [float("inf"), 1.0], 2),
        (7, [1.0, 2.0], None), (None, [1.0, 2.4], 2), (8, [1.0, 2.0, 3.0], 2), (9, [3e38, 1.0], 2), (10, [], 2), (100, [], 1), (200, [], 1), (300, [-1.0, -2.0], 1),
    ]
    got = mined(spark, rows)
    assert got == brute([r for r in rows if r[0] != 9])
    assert {r[:4] for r in got if r[0] == 0} == {(0, 1, 1, 2)} and (100, 200, 1, 10, 0, 0) in got
    assert not any(r[0] == 300 for r in got)  # all its scores with others are below zero
    assert mined(spark, rows[:1]) == set() and mined(spark, []) == set()


def test_the_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    got = ng.op11_hard_negatives(spark, sf_dir)
    want = con.execute(ng.oracle()).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50
