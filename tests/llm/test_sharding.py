import random
import zlib

import pytest

from geoloom.llm import sharding


def least_capacity(sizes, shards):
    def fits(c):
        n, now = 1, 0
        for s in sizes:
            if now + s > c:
                n, now = n + 1, 0
            now += s
        return n <= shards

    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("held", [16384, 40])
def test_smallest_capacity_and_slots(docs_of, prose, monkeypatch, held):
    monkeypatch.setattr(sharding, "HELD", held)
    rows = [(i, prose(i % 150, 1 + i * 7 % 90)) for i in range(300)] + [(1000 + i, "hot text") for i in range(150)] + [(5000, None), (5001, ""), (None, "é"), (7, prose(7, 50))]
    out = sharding.sharded(docs_of(rows), 24).collect()
    assert len(out) == len(rows)
    groups = {}
    for i, t in rows:
        at = -(2**63) if i is None else i
        first, size = groups.get(t, (at, 0))
        groups[t] = (min(first, at), size + len((t or "").encode()) + 8)
    sizes = [s for _, s in sorted(groups.values())]
    load, slots, home = {}, {}, {}
    for r in out:
        load[r.shard] = load.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
        assert home.setdefault(r.group, r.shard) == r.shard
    assert max(load.values()) == least_capacity(sizes, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = {r.doc_id: r for r in out}
    assert by_id[5000].text_crc32 == 0 and by_id[5000]["size"] == 8 and by_id[5000].group != by_id[5001].group
    assert by_id[None].text_crc32 == zlib.crc32("é".encode())


def test_empty_and_single(docs_of):
    assert sharding.sharded(docs_of([]).limit(0), 24).count() == 0
    one = sharding.sharded(docs_of([(1, "a")]), 24).collect()
    assert [(r.shard, r.slot) for r in one] == [(0, 0)]


def test_near_equal_around_a_giant_group(docs_of, prose):
    rows = [(i, prose(i, 60)) for i in range(300)] + [(300, "giant " * 30_000)] + [(301 + i, prose(400 + i, 60)) for i in range(300)]
    load = {}
    for r in sharding.sharded(docs_of(rows), 24).collect():
        load[r.shard] = load.get(r.shard, 0) + r["size"]
    assert sorted(load) == list(range(24))
    others = sorted(load.values())[:-1]
    assert max(load.values()) == 180_008 and max(others) < 1.35 * min(others)


def test_even_cuts_stay_within_the_least_capacity():
    rng = random.Random(1)
    for _ in range(500):
        sizes = [rng.choice([1, 2, 5, rng.randint(1, 50)]) for _ in range(rng.randint(1, 60))]
        if rng.random() < 0.5:
            sizes[rng.randrange(len(sizes))] = rng.randint(1, 2 * sum(sizes))
        shards = rng.choice([1, 2, 3, 5, 24])
        ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
        capacity = least_capacity(sizes, shards)
        giants = sorted(zip(sizes, ends), key=lambda x: (-x[0], x[1]))[:shards]
        cuts = sharding.even_cuts(ends, capacity, shards, giants)
        loads = [b - a for a, b in zip([0, *cuts], cuts)]
        assert len(cuts) == shards and cuts[-1] == ends[-1] and set(cuts) <= set(ends) and max(loads) <= capacity
        assert sum(x > 0 for x in loads) == min(shards, len(sizes))


def test_the_query_on_the_given_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = sharding.op4_sharding(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    groups, home, slots, load = {}, {}, {}, {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        groups[texts[i]] = groups.get(texts[i], 0) + len(raw) + 8  # in order of their smallest id
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        assert home.setdefault(texts[r.doc_id], r.shard) == r.shard and 0 <= r.shard < 24
        slots.setdefault(r.shard, []).append(r.slot)
        load[r.shard] = load.get(r.shard, 0) + r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) == least_capacity(list(groups.values()), 24)
    in_order = [home[t] for t in groups]
    assert in_order == sorted(in_order)
