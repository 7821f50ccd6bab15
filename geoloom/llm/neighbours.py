"""Approximate nearest neighbours: one robust-pruned directed graph per shard, searched by beam.

Equal vectors are one node that keeps its smallest ids, so a vector held by a third of all rows is one node. Nodes are
dealt to shards of bounded size by hash. A shard's graph is built in rounds of growing size: a greedy search from the
entries proposes neighbours among the nodes already in, pruning keeps an edge only if no kept neighbour is nearer to its
target by the factor ALPHA, and reverse edges are pruned alike. Entries lie spread over the shard, each as far from those
before it as any node. When the graph stands, every node is searched for by its own vector; those that this does not
find, as in clusters that hold no entry, become entries too, so that every node can be reached. Every query then searches
every shard: a shard's graph goes to one task once, the queries stream in behind it in blocks, and the ten best of all
shards are exact distances on the original vectors.

Searches run for many queries at once in numpy: each step expands the best unexpanded node of every query. All nodes
of the beam that are as near as the last one wanted count, so ties are settled by id; only where more than SEARCH_BEAM
distinct vectors of a shard are equally near may some of them be missing.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors are
compared with those of their own length only; rows that repeat an id and a vector are candidates once; of several
vectors under one id all are candidates, each id is ranked once by its nearest, and the least vector is the query; a
null id takes no part; fewer than ten candidates give all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.llm.common import Work, table

SHARD_NODES = 6000
DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 160
#: Spread entries of a shard, and the nearest of all entries at which a search starts.
ENTRIES, STARTS = 256, 32
#: Beam by which each node must be found when the graph stands.
CHECK_BEAM = 32
ALPHA = 1.2
QUERY_BLOCK = 512
NEAREST = 10
#: Differences of vectors that are held at a time, and vectors of one block of queries.
DISTANCE_BYTES = 64 << 20
BLOCK_BYTES = 256 << 10


def valid(vector):
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def nodes(rows: DataFrame, key: str, vector: str, keep: int) -> DataFrame:
    """(vector, dim, ids): distinct vectors with their `keep` smallest ids; the ranks are cut before the shuffle."""
    # -0.0 equals 0.0: adding 0.0 makes them one.
    clean = rows.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x + F.lit(0.0).cast("float")).alias("vector"))
    ranked = clean.withColumn("rank", F.row_number().over(W.partitionBy("vector").orderBy("id"))).filter(F.col("rank") <= keep)
    return ranked.groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids")).withColumn("dim", F.size("vector"))


# --- graphs ------------------------------------------------------------------------------------------------------


def distances(points, a, b):
    """Squared distances between rows a (n) of `points` and rows b (n, m), in slices of bounded size."""
    import numpy as np

    out = np.empty(b.shape, np.float32)
    rows = max(1, DISTANCE_BYTES // max(1, 4 * b.shape[1] * points.shape[1]))
    for at in range(0, len(a), rows):
        diff = points[b[at : at + rows]] - points[a[at : at + rows]][:, None, :]
        np.einsum("nmd,nmd->nm", diff, diff, out=out[at : at + rows])
    return out


def between(a, b):
    """Squared distances between all rows of a and all rows of b, without their differences in memory."""
    import numpy as np

    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.maximum(squares, 0)


def beam_search(points, edges, queries, entries, beam: int):
    """The `beam` nearest nodes found for each query (rows of `queries`), nearest first; -1 where there are fewer.

    `edges` holds neighbours, -1 for none; a search starts at the STARTS of `entries` that are nearest to its query."""
    import numpy as np

    entries = np.asarray(entries, np.int32)
    q, d = len(queries), edges.shape[1]
    near = np.full((q, beam + d), np.inf, np.float32)
    node = np.full((q, beam + d), -1, np.int32)
    done = np.ones((q, beam + d), bool)
    seen = np.zeros((q, len(points)), bool)
    m = min(len(entries), beam, STARTS)
    start = between(queries, points[entries])
    order = np.argsort(start, axis=1)[:, :m]
    node[:, :m], done[:, :m], near[:, :m] = entries[order], False, np.take_along_axis(start, order, 1)
    seen[np.arange(q)[:, None], entries[order]] = True
    live = np.arange(q)
    while len(live):
        # The beam is kept sorted: the first that is not done is the best.
        first = np.argmin(done[live, :beam], axis=1)
        open_ = ~done[live, first]
        live, first = live[open_], first[open_]
        if not len(live):
            break
        done[live, first] = True
        found = edges[node[live, first]]
        fresh = (found >= 0) & ~seen[live[:, None], np.maximum(found, 0)]
        rows, cols = np.nonzero(fresh)
        targets = found[rows, cols]
        seen[live[rows], targets] = True
        tail = np.full((len(live), d), np.inf, np.float32)
        diff = points[targets] - queries[live[rows]]
        tail[rows, cols] = np.einsum("nd,nd->n", diff, diff)
        near[live, beam:], node[live, beam:], done[live, beam:] = tail, found, ~fresh
        order = np.argsort(near[live], axis=1)[:, :beam]
        at = live[:, None]
        near[live, :beam], node[live, :beam], done[live, :beam] = near[at, order], node[at, order], done[at, order]
        near[live, beam:] = np.inf
    nearest = node[:, :beam]
    nearest[~np.isfinite(near[:, :beam])] = -1
    return nearest


def robust_prune(points, centres, candidates, degree: int):
    """Diverse edges for each centre from its candidates (-1 for none): the nearest is kept, then every candidate that
    is nearer to it by ALPHA than to the centre is dropped, and so on."""
    import numpy as np

    dist = distances(points, centres, np.maximum(candidates, 0))
    dist[(candidates < 0) | (candidates == centres[:, None])] = np.inf
    order = np.argsort(dist, axis=1, kind="stable")
    candidates, dist = np.take_along_axis(candidates, order, 1), np.take_along_axis(dist, order, 1)
    # Repeats of one node are neighbours in this order.
    dist[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = np.inf
    out = np.full((len(centres), degree), -1, np.int32)
    rows = np.arange(len(centres))
    for k in range(degree):
        best = np.argmin(dist, axis=1)
        good = np.isfinite(dist[rows, best])
        if not good.any():
            break
        chosen = candidates[rows, best]
        out[good, k] = chosen[good]
        dist[rows, best] = np.inf
        between = distances(points, np.maximum(chosen, 0), np.maximum(candidates, 0))
        dist[ALPHA * ALPHA * between <= dist] = np.inf
    return out


def spread(points, most: int):
    """`most` nodes (all, if fewer), the most central first, then always the one that is farthest from those before."""
    import numpy as np

    near = ((points - points.mean(0)) ** 2).sum(1)
    found = [int(np.argmin(near))]
    near = ((points - points[found[0]]) ** 2).sum(1)
    while len(found) < min(most, len(points)):
        found.append(int(np.argmax(near)))
        near = np.minimum(near, ((points - points[found[-1]]) ** 2).sum(1))
        near[found] = -1.0
    return np.array(found, np.int64)


def build_graph(points, degree: int = DEGREE, beam: int = BUILD_BEAM):
    """(edges, entries) for the rows of `points` (float32), which come in random order."""
    import numpy as np

    n = len(points)
    seeds = spread(points, ENTRIES)
    edges = np.full((n, degree), -1, np.int32)
    order = np.concatenate((seeds, np.delete(np.arange(n), seeds)))
    have = 1
    while have < n:
        step = min(n - have, max(1, have), QUERY_BLOCK)
        new = order[have : have + step]
        found = beam_search(points, edges, points[new], order[: min(have, len(seeds))], beam)
        # The round's own nodes propose each other too, as none of them is in the graph yet.
        near = np.argsort(between(points[new], points[new]), axis=1)[:, : 1 + min(8, step)]
        edges[new] = robust_prune(points, new, np.concatenate((found, new[near].astype(np.int32)), axis=1), degree)
        sources = np.repeat(new, degree)
        targets = edges[new].ravel()
        back = targets >= 0
        add_reverse(points, edges, targets[back], sources[back], degree)
        have += step
    lost = [at + np.flatnonzero((beam_search(points, edges, points[at : at + QUERY_BLOCK], seeds, CHECK_BEAM) != np.arange(at, min(n, at + QUERY_BLOCK))[:, None]).all(1)) for at in range(0, n, QUERY_BLOCK)]
    return edges, np.concatenate((seeds, *lost)).astype(np.int32)


def add_reverse(points, edges, owners, others, degree: int) -> None:
    """Edges owner -> other that are not there yet; an owner with too many is pruned."""
    import numpy as np

    new = ~(edges[owners] == others[:, None]).any(1)
    owners, others = owners[new], others[new]
    if not len(owners):
        return
    order = np.argsort(owners, kind="stable")
    owners, others = owners[order], others[order]
    heads = np.flatnonzero(np.diff(owners, prepend=-1) != 0)
    counts = np.diff(np.concatenate((heads, [len(owners)])))
    slot = np.arange(len(owners)) - np.repeat(heads, counts)
    wide = np.full((len(heads), degree + int(counts.max(initial=0))), -1, np.int32)
    centres = owners[heads]
    wide[:, :degree] = edges[centres]
    wide[np.repeat(np.arange(len(heads)), counts), degree + slot] = others
    full = (wide >= 0).sum(1) > degree
    if full.any():
        edges[centres[full]] = robust_prune(points, centres[full], wide[full], degree)
    for row in np.flatnonzero(~full):
        kept = wide[row][wide[row] >= 0]
        edges[centres[row], : len(kept)] = kept


# --- jobs --------------------------------------------------------------------------------------------------------


def index(found: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """(dim, shard, n, entries, points, edges, ids, id_counts): one graph per shard of distinct vectors, as bytes."""

    def build(part):
        import numpy as np
        import pyarrow as pa

        order = np.argsort([int.from_bytes(h, "big") for h in (i[:8] for i in map(_digest, part.column("vector").to_pylist()))])
        part = part.take(pa.array(order))
        points = np.array(part.column("vector").to_pylist(), np.float32)
        edges, entries = build_graph(points)
        ids = part.column("ids").to_pylist()
        return pa.table(
            {
                "dim": part.column("dim").slice(0, 1), "shard": part.column("shard").slice(0, 1), "n": [len(points)], "entries": [entries.tobytes()],
                "points": [points.tobytes()], "edges": [edges.tobytes()],
                "ids": [np.array([x for i in ids for x in i], np.int64).tobytes()], "id_counts": [np.array([len(i) for i in ids], np.int64).tobytes()],
            }
        )

    sizes = found.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    shards = found.join(F.broadcast(sizes), "dim").withColumn(  # one row per vector length
        "shard", F.pmod(F.xxhash64("vector"), F.ceil(F.col("n") / shard_nodes))
    )
    return shards.select("dim", "shard", "vector", "ids").groupBy("dim", "shard").applyInArrow(
        build, "dim int, shard long, n long, entries binary, points binary, edges binary, ids binary, id_counts binary"
    )


def _digest(vector: list[float]) -> bytes:
    """An order that has nothing to do with the vectors' places, the same on every run."""
    import hashlib
    import struct

    return hashlib.blake2b(struct.pack(f"<{len(vector)}f", *vector), digest_size=8).digest()


def search(graphs: DataFrame, queries: DataFrame, nearest: int = NEAREST, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): `queries` (id, vector, dim) against every shard of their length."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        graph, shard = (), None
        for batch in batches:
            at = 0
            of_graph = batch.column("n").is_valid().to_pylist()
            shards = list(zip(batch.column("dim").to_pylist(), batch.column("shard").to_pylist(), strict=True))
            while at < batch.num_rows:
                if of_graph[at]:  # a shard's first row
                    shard = shards[at]
                    r = batch.slice(at, 1).to_pylist()[0]
                    counts = np.frombuffer(r["id_counts"], np.int64)
                    graph = (
                        np.frombuffer(r["points"], np.float32).reshape(r["n"], -1), np.frombuffer(r["edges"], np.int32).reshape(r["n"], -1),
                        np.frombuffer(r["entries"], np.int32), np.frombuffer(r["ids"], np.int64), np.cumsum(counts) - counts, counts,
                    )
                    at += 1
                    continue
                if shards[at] == shard:  # else the hash has left that shard empty
                    yield answers(graph, batch.column("asked_ids")[at].as_py(), batch.column("asked")[at].as_py())
                at += 1

    def answers(graph: tuple, query_ids, vectors):
        import numpy as np
        import pyarrow as pa

        points, edges, entries, ids, begins, counts = graph
        wanted = np.array(vectors, np.float32)
        found = beam_search(points, edges, wanted, entries, min(beam, len(points)))
        rows = []
        for q, vector, hits in zip(query_ids, wanted.astype(np.float64), found, strict=True):
            hits = hits[hits >= 0]
            diff = points[hits].astype(np.float64) - vector
            score = np.sqrt((diff * diff).sum(1))
            # The query's own node is one of them; all that are as near as the last wanted one stay.
            take = np.flatnonzero(score <= np.partition(score, nearest)[nearest]) if len(score) > nearest + 1 else range(len(score))
            rows += [(q, int(v), float(score[i])) for i in take for v in ids[begins[hits[i]] : begins[hits[i]] + counts[hits[i]]]]
        return pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"]
        )

    last = graphs.groupBy("dim").agg(F.max("shard").alias("last"))
    sizes = queries.groupBy("dim").agg(F.ceil(F.sum(F.col("dim").cast("long") * 4) / BLOCK_BYTES).alias("blocks"))
    spans = last.join(sizes, "dim")  # one row per vector length
    dealt = queries.join(F.broadcast(spans), "dim").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    blocks = dealt.groupBy("dim", "block", "last").agg(F.collect_list(F.struct("id", "vector")).alias("asked"))
    asked = blocks.select(
        "dim", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("shard"), F.col("asked.id").alias("asked_ids"), F.col("asked.vector").alias("asked")
    )
    sent = graphs.unionByName(asked, allowMissingColumns=True).repartition("dim", "shard").sortWithinPartitions("dim", "shard", F.col("n").isNull())
    hits = sent.mapInArrow(run, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        hits.filter("vec_id <> query_id")
        .groupBy("query_id", "vec_id")
        .agg(F.min("score").alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= nearest)
        .select("query_id", "rank", "vec_id", "score")
    )


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("embedding")).filter(valid(F.col("embedding")) & F.col("vec_id").isNotNull())
    work = Work(spark, "vectors")
    graphs = work.saved(index(work.saved(nodes(rows, "vec_id", "embedding", NEAREST + 1), "nodes")), "graphs")
    work.drop("nodes")
    queries = rows.filter("vec_id % 100 = 0").groupBy(F.col("vec_id").alias("id")).agg(F.min("embedding").alias("vector")).withColumn("dim", F.size("vector"))
    return search(graphs, queries)
