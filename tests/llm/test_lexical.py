import math
import re
from collections import Counter

import duckdb
import pytest

from geoloom.llm import lexical as lx

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, most=10):
    counted = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    pooled = {}
    for item, text in items:
        pooled.setdefault(item, set()).update(terms(text))
    out = []
    for item, asked in pooled.items():
        scores = []
        for i, c in counted:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if score:
                scores.append((-score, i is not None, i or 0, i))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:most])]
    return sorted(out, key=str)


def ranked(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS segment", "3 AS n")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "'x' AS term")
    return sorted(map(tuple, lx.ranked(d, i).collect()), key=str)


@pytest.mark.parametrize(("segment_bytes", "group_bytes"), [(16 << 20, 8 << 20), (3000, 400)])
def test_against_brute_force(spark, monkeypatch, prose, segment_bytes, group_bytes):
    """One segment a task and many, one group of items and many; equal scores, nulls, repeats, long texts, letters
    beyond ASCII."""
    monkeypatch.setattr(lx, "SEGMENT_BYTES", segment_bytes)
    monkeypatch.setattr(lx, "GROUP_BYTES", group_bytes)
    docs = [(i, prose(i, 5 + 7 * (i % 40))) for i in range(300)] + [(1000 + i, prose(3, 50)) for i in range(30)]
    docs += [(2000, None), (2001, ""), (2002, "...!"), (2003, "Über ÉTÉ x1Y2 日本語 日本語"), (None, prose(3, 50)), (2004, prose(9, 30000)), (2005, "\x00a\x7fB"), (5, prose(5, 40))]
    items = [(i, prose(500 + i, 20)) for i in range(40)] + [(100, "über été X1y2 日本語"), (101, None), (102, "nowhereseen"), (103, prose(3, 50).upper()), (None, prose(7, 5)), (1, prose(3, 3))]
    want = brute(docs, items)
    assert ranked(spark, docs, items) == want
    assert any(r[0] == 100 for r in want) and not any(r[0] in (101, 102) for r in want)


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lx, "SLICE_BYTES", 7)
    segment = lx.Segment()
    text = "alpha be alpha, gamma-delta be" * 5
    segment.add(1, text.encode().translate(lx._separators()))
    names = list(segment.vocabulary)
    assert {names[t].decode(): n for t, n in zip(segment.terms, segment.tfs, strict=True)} == Counter(terms(text)) and segment.lengths[0] == len(terms(text))


def test_visits_end_at_the_bound(prose):
    """A stratum whose bound is below the last score kept is not opened."""
    segment = lx.Segment()
    for i in range(400):
        segment.add(i, (prose(i, 20 + i) + (" rare" * 3 if i < 20 else "")).encode())
    strata, best, opened = lx.Strata([segment.rows(0, 400, sum(segment.lengths))]), lx.Best(10), []
    names = strata.terms.to_pylist()
    keep = best.add
    best.add = lambda score, ids: (opened.append(int((score > 0).sum())), keep(score, ids))
    import numpy as np

    strata.search(np.array([names.index("rare"), names.index(prose(0, 1))]), np.array([9000, 10]), best)
    assert len(best.ids) == 10 and set(best.ids.tolist()) <= set(range(20)) and sum(opened) < 200


def test_empty_tables(spark):
    assert ranked(spark, [], [(1, "a")]) == ranked(spark, [(1, "a")], []) == ranked(spark, [(1, None)], [(1, "a")]) == []
    assert ranked(spark, [(1, "a b")], [(1, "b")]) == brute([(1, "a b")], [(1, "b")])


def test_the_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = sorted(map(tuple, lx.op12_lexical_search(spark, sf_dir).collect()))
    assert got == sorted(con.execute(lx.oracle()).fetchall()) and len(got) > 100
