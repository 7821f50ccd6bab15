import random
import re
from itertools import combinations

import pytest

from geoloom.llm import minhash
from geoloom.llm.graph import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        inter = len(sets[a] & sets[b])
        if inter and 100 * inter >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("hot", [128, 3])
def test_components_match_brute_force(docs_of, prose, monkeypatch, hot):
    monkeypatch.setattr(minhash, "HOT_LIST", hot)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(5)
    rows = [(100 + i, prose(i, 40 + i * 11 % 200)) for i in range(30)]
    base = prose(99, 150).split()
    for i in range(60):  # variants of one text, from equal to far
        words = list(base)
        for _ in range(rng.randint(0, 12)):
            words[rng.randrange(len(words))] = f"new{rng.randint(0, 40)}"
        rows.append((1000 + i, " ".join(words)))
    chain = prose(77, 200).split()
    for i in range(12):  # neighbours are alike, ends are not
        rows.append((2000 + i, " ".join(chain[i * 4 : i * 4 + 150])))
    rows += [(3000 + i, "Exact Copy of One text here" if i % 2 else "exact copy of one TEXT  here") for i in range(20)]
    rows += [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One two"), (6, "a b c d e"), (7, "a b c d e f"), (8, prose(8, 6000)), (9, prose(8, 6000) + " end"), (10, "É é"), (11, "é é")]
    got = {r.doc_id: r for r in minhash.near_duplicates(docs_of(rows)).collect()}
    assert len(got) == len(rows)
    for i, n, c in brute(rows):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, c, i == c), i


def test_repeated_rows_nulls_and_empty(docs_of, prose):
    text = prose(1, 50)
    rows = [(5, text), (5, text), (None, text), (7, None), (7, None)]
    got = minhash.near_duplicates(docs_of(rows)).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("5", "None", False), ("5", "None", False), ("7", "7", True), ("7", "7", True), ("None", "None", True)]
    assert minhash.near_duplicates(docs_of([]).limit(0)).count() == 0
    docs = docs_of(rows)
    kept = minhash.deduplicated(docs)
    assert kept.schema == docs.schema and sorted(str(r.doc_id) for r in kept.collect()) == ["7", "7", "None"]


def test_graph_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (4, 1), (5, 5), *((100 + i, 101 + i) for i in range(40)), *((0, 200 + i) for i in range(30))]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {n: 1 for n in (1, 2, 3, 4)} | {n: 7 for n in (7, 8, 9)} | {100 + i: 100 for i in range(41)} | {0: 0} | {200 + i: 0 for i in range(30)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketch_plan_and_low_thresholds(docs_of, prose):
    assert [minhash.sketch_plan(p) for p in (85, 80, 50, 100)] == [(32, 14), (32, 11), (32, 2), (32, 32)]
    assert all((1 - p / 100) ** minhash.sketch_plan(p)[0] <= minhash.MISS for p in (1, 20, 40))
    rows = []
    for i in range(60):  # pairs at 0.5 and a little more, each alike to its partner only
        words = [f"w{i}n{j}" for j in range(304)]
        rows += [(2 * i, " ".join(words[:200])), (2 * i + 1, " ".join(words[64:264]))]
    assert all(0.5 <= len(shingles(rows[k][1]) & shingles(rows[k + 1][1])) / len(shingles(rows[k][1]) | shingles(rows[k + 1][1])) < 0.52 for k in range(0, 120, 2))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs_of(rows), percent=50).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_texts_of_one_id_are_kept_apart(docs_of, prose):
    rows = []
    for i in range(40):  # a pair at a time, all under the null id, and one copy under an id of its own
        rows += [(None, prose(5000 + i, 100)), (None, prose(5000 + i, 100) + " end"), (900 + i, prose(5000 + i, 100) + " other")]
    rows += [(7, prose(6000, 80)), (7, prose(6001, 80)), (7, prose(6001, 80)), (8, prose(6001, 80))]
    got = minhash.near_duplicates(docs_of(rows)).collect()
    assert {r.component_id for r in got if r.doc_id is None or r.doc_id >= 900} == {None}
    assert sum(r.kept for r in got if r.doc_id is None) == 40 and not any(r.kept for r in got if (r.doc_id or 0) >= 900)
    assert sorted((r.component_id, r.kept) for r in got if r.doc_id in (7, 8)) == [(7, False), (7, True), (7, True), (7, True)]
    left = minhash.deduplicated(docs_of(rows)).collect()
    assert len(left) == 42 and len({r.text.split()[50] + r.text[:40] for r in left}) == 42
