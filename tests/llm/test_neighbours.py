import numpy as np
import pytest

from geoloom.llm import neighbours as nb


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, ids int")


def found(spark, rows, nearest=10, shard_nodes=nb.SHARD_NODES):
    df = frame(spark, [(i, v, 0, 0) for i, v in rows])
    good = df.filter(nb.valid(df.embedding) & df.vec_id.isNotNull()).select("vec_id", "embedding")
    graphs = nb.index(nb.nodes(good, "vec_id", "embedding", nearest + 1), shard_nodes)
    queries = good.filter("vec_id % 100 = 0").groupBy("vec_id").agg({"embedding": "min"}).toDF("id", "vector").selectExpr("id", "vector", "size(vector) AS dim")
    out = {}
    for r in nb.search(graphs, queries, nearest).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


def test_recall_scores_and_ties(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16))
    points = (centres[rng.integers(0, 20, 2000)] + 0.3 * rng.normal(size=(2000, 16))).astype(np.float32)
    points[1000:1300] = points[0]  # one vector many times
    points[1400:1500] = points[5] + 1e-4 * rng.normal(size=(100, 16)).astype(np.float32)
    got = found(spark, [(i, p.tolist()) for i, p in enumerate(points)], shard_nodes=700)
    exact = points.astype(np.float64)
    recall = []
    for q in range(0, 2000, 100):
        dist = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(2000), dist)) if i != q][:10]
        assert len(got[q]) == 10 and all(abs(s - dist[v]) < 1e-12 for v, s in got[q])
        assert got[q] == sorted(got[q], key=lambda x: (x[1], x[0]))
        recall.append(len({v for v, _ in got[q]} & set(order)) / 10)
    assert np.mean(recall) >= 0.95
    assert [v for v, _ in got[1000]] == [0, *range(1001, 1010)]


def test_invalid_vectors_and_small_tables(spark):
    rows = [(0, [1.0, 2.0]), (100, None), (200, [0.0, 0.0]), (300, [float("nan"), 1.0]), (400, [float("inf"), 1.0]), (500, [None, 1.0]), (600, []), (None, [1.0, 1.0]), (7, [1.0, 3.0]), (8, [1.0, 2.0, 3.0]), (9, [1.0, 1.0]), (9, [1.0, 1.0])]
    got = found(spark, rows)
    assert list(got) == [0] and [v for v, _ in got[0]] == [7, 9]
    assert found(spark, rows[1:3]) == {}


def test_ties_between_different_vectors_go_to_smaller_ids(spark):
    rows = [(0, [0.0] * 15 + [1e-3])]
    for i in range(32):  # all at one distance of the query, no two of them equal
        v = [0.0] * 16
        v[i % 15] = 1.0 if i < 15 else -1.0 if i < 30 else 0.0
        if i >= 30:
            v = [0.25 if k < 15 else 0.0 for k in range(16)]
            v[i - 30] = (1 - 14 / 16) ** 0.5
        rows.append((1 + (i * 7) % 32, v))
    exact = {i: np.sqrt(((np.array(v, np.float32).astype(float) - np.array(rows[0][1], np.float32).astype(float)) ** 2).sum()) for i, v in rows[1:]}
    want = sorted(exact, key=lambda i: (exact[i], i))[:10]
    assert len({exact[i] for i in want}) < 5
    assert [v for v, _ in found(spark, rows)[0]] == want


def brute(points, ids, q, nearest=10):
    dist = np.sqrt(((points - points[q]) ** 2).sum(1))
    return [ids[i] for i in np.lexsort((ids, dist)) if i != q][:nearest]


def test_recall_on_the_given_table(spark):
    """The registered query, and shards of a fifth of the table, against brute force."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in table.filter(nb.valid(table.embedding)).collect())
    ids, points = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    queries = [k for k, i in enumerate(ids) if i % 100 == 0]
    want = {int(ids[k]): set(brute(points, ids, k)) for k in queries}
    got = {}
    for r in nb.op8_neighbours(spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == set(want) and np.mean([len(got[q] & want[q]) / 10 for q in want]) >= 0.9
    good = table.filter(nb.valid(table.embedding))
    graphs = nb.index(nb.nodes(good, "vec_id", "embedding", 11), shard_nodes=100)
    asked = good.filter("vec_id % 100 = 0").selectExpr("vec_id AS id", "embedding AS vector", "size(embedding) AS dim")
    assert graphs.count() >= 4
    again = {}
    for r in nb.search(graphs, asked).collect():
        again.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(again[q] & want[q]) / 10 for q in want]) >= 0.9


def test_several_vectors_under_one_id(spark):
    rows = [(0, [1.0, 2.0]), (0, [5.0, 5.0]), (1, [1.0, 2.0]), (1, [9.0, 9.0]), (2, [4.0, 4.0])]
    got = found(spark, rows)[0]
    assert [v for v, _ in got] == [1, 2] and got[0][1] == 0.0


def clustered(clusters, spread, nodes=6000, width=128):
    rng = np.random.default_rng(clusters)
    return (rng.normal(size=(clusters, width))[rng.integers(0, clusters, nodes)] + spread * rng.normal(size=(nodes, width))).astype(np.float32)


@pytest.mark.parametrize(("clusters", "spread"), [(60, 0.3), (400, 0.1), (1, 1.0)])
def test_recall_and_reach_of_a_whole_shard(clusters, spread):
    """Shards as large as in production, with fewer and with more clusters than entries: no query is lost, and every
    node can be reached."""
    points = clustered(clusters, spread)
    edges, entries = nb.build_graph(points)
    queries = np.arange(0, len(points), 20)
    hits = nb.beam_search(points, edges, points[queries], entries, nb.SEARCH_BEAM)
    exact = nb.between(points[queries].astype(float), points.astype(float))
    exact[np.arange(len(queries)), queries] = np.inf
    want = np.argpartition(exact, 10, axis=1)[:, :10]
    recall = np.array([len(set(a) & set(b)) / 10 for a, b in zip(hits, want, strict=True)])
    assert recall.mean() >= 0.9 and recall.min() > 0
    reached, front = set(entries.tolist()), entries
    while len(front):
        front = np.array(sorted(set(edges[front].ravel().tolist()) - reached - {-1}), int)
        reached |= set(front.tolist())
    assert len(reached) == len(points)


def test_entries_lie_apart():
    points = clustered(30, 0.01, 900, 16)
    seeds = nb.spread(points, 40)
    assert len(set(seeds.tolist())) == 40
    groups = {tuple(np.round(points[i]).astype(int)) for i in seeds[:30]}
    assert len(groups) >= 28
    assert sorted(nb.spread(points[:3], 40).tolist()) == [0, 1, 2]


def test_empty_table_through_the_query(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert nb.op8_neighbours(spark, str(tmp_path)).collect() == []
