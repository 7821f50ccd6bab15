"""Paths anywhere in texts."""

import random

import pytest
from pyspark.sql import functions as F

from geoloom.operators import rewriting


def brute(text, pairs):
    out, at = "", 0
    while at < len(text):
        best = max((f for f in pairs if text.startswith(f, at)), key=len, default=None)
        out, at = (out + pairs[best], at + len(best)) if best else (out + text[at], at + 1)
    return out


@pytest.mark.parametrize("group", [200_000, 5])
def test_overlapping_paths_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(rewriting, "GROUP", group)
    rng = random.Random(3)
    pairs = {"".join(rng.choices("ab/.", k=rng.randint(1, 5))): f"<{i}>" for i in range(60)} | {"/data/é": "ü", "/data/éa": "日本", "a/b/aa": "/data/é"}
    texts = ["".join(rng.choices("ab/.é", k=rng.randint(0, 80))) for _ in range(200)] + ["/data/éa/data/é/data", None, ""]
    docs = spark.createDataFrame([(i, t, 1.5) for i, t in enumerate(texts)], "id int, xml string, f double")
    got = rewriting.rewritten_everywhere(docs, spark.createDataFrame(list(pairs.items()), "f string, t string"), "xml")
    assert got.schema == docs.schema
    for r in got.collect():
        assert r.xml == (None if texts[r.id] is None else brute(texts[r.id], pairs)) and r.f == 1.5


def test_no_pairs_and_no_texts(spark):
    none = spark.createDataFrame([], "f string, t string")
    docs = spark.createDataFrame([(1, "a/b")], "id int, xml string")
    assert rewriting.rewritten_everywhere(docs, none, "xml").collect() == docs.collect()
    assert rewriting.rewritten_everywhere(docs.limit(0), none, "xml").count() == 0


def test_absolute_and_relative_forms(spark):
    pairs = spark.createDataFrame([("C:\\gis\\data\\a.shp", "b://a"), ("C:/gis/project/x/b.tif", "b://b"), ("C:/c.csv", "b://c"), ("D:/d.csv", "b://d"), ("", "b://e"), ("C:/f", None), ("C:/c.csv", "b://z")], "f string, t string")
    got = {r.f: r.t for r in rewriting.path_forms(pairs, "C:/gis/project/").collect()}
    assert got == {
        "C:/gis/data/a.shp": "b://a", "../data/a.shp": "b://a", "C:/gis/project/x/b.tif": "b://b", "x/b.tif": "b://b", "C:/c.csv": "b://c", "../../c.csv": "b://c",
        "D:/d.csv": "b://d", "../../../D:/d.csv": "b://d",
    }
    xml = '<ds>../data/a.shp|layername=a</ds><p>C:/gis/data/a.shp</p> x/b.tif "C:/c.csv"'
    docs = spark.createDataFrame([(xml,)], "xml string")
    forms = rewriting.path_forms(pairs, "C:/gis/project")
    assert rewriting.rewritten_everywhere(docs, forms, "xml").first().xml == '<ds>b://a|layername=a</ds><p>b://a</p> b://b "b://c"'
    same = spark.createDataFrame([("/p/q",), ("/p",), ("/p/q/r",)], "p string").select(rewriting.relative_path(F.col("p"), "/p/q").alias("r"))
    assert [r.r for r in same.collect()] == ["", "..", "r"]
