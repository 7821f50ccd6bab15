import base64
import gzip
import hashlib

import pytest

from geoloom.llm import warc


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.fixture
def pages(spark):
    rows = [(1, "http://a/", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b/\r\nX: y", ""), (4, "u", None), (5, "u", "WARC/1.1\r\n\r\n\r\nx"), (6, "u", "a\r\n\r\n"), (2, None, "<p>é</p>"), (None, "u", "only"), (9, "http://big/", "x" * 300_000)]
    return rows, spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")


@pytest.mark.parametrize("codec", ["gzip", "none"])
def test_round_trip(spark, pages, tmp_path, codec):
    rows, df = pages
    path = f"file://{tmp_path}/warc"
    warc.write_warc(df, path, codec=codec)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(rows)
    keep = {}
    for i, _, html in rows:
        keep[html or ""] = max(keep.get(html or "", -1), -1 if i is None else i)
    for r in got:
        i = r.record_id.rsplit(":", 1)[1]
        html = next(h or "" for p, _, h in rows if str(p).replace("None", "null") == i)
        assert r.payload_digest == f"sha1:{digest(html)}"
        assert r.http_length == len(html.encode())
        if r.warc_type == "response":
            assert bytes(r.payload) == html.encode() and (i == "null" or int(i) == keep[html])
        else:
            assert r.payload == b"" and r.refers_to.endswith(f":{keep[html]}") and int(i) < keep[html]


def test_pushdown_and_skipped_payloads(spark, pages, tmp_path):
    _, df = pages
    path = f"file://{tmp_path}/warc"
    warc.write_warc(df, path)
    some = warc.read_warc(spark, path, payload=False).filter("warc_type = 'revisit'")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "= revisit" not in plan  # the source has taken the predicate
    assert {r.payload for r in some.collect()} == {None} and some.count() == 2
    assert warc.read_warc(spark, path).filter("target_uri LIKE 'http://b/%'").count() == 1
    assert warc.read_warc(spark, path).filter("content_length >= 300000").count() == 1


def test_foreign_files(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nX: a\r\n b\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    (tmp_path / "b.warc").write_bytes(record)
    got = warc.read_warc(spark, f"file://{tmp_path}").collect()
    assert [bytes(r.payload) for r in got] == [b"hello"] * 3 and {r.warc_type for r in got} == {"warcinfo"}
    (tmp_path / "c.warc").write_bytes(b"garbage\r\n\r\n")
    with pytest.raises(Exception, match="no WARC version line"):
        warc.read_warc(spark, f"file://{tmp_path}").collect()


def test_empty_table(spark, pages, tmp_path):
    path = f"file://{tmp_path}/warc"
    warc.write_warc(pages[1].limit(0), path)
    assert warc.read_warc(spark, path).count() == 0


def test_partitions_follow_the_cores(tmp_path):
    for i in range(40):
        (tmp_path / f"{i:02}.warc").write_bytes(b"x" * 300_000)
    plan = lambda **options: warc.WarcReader({"path": f"file://{tmp_path}", **options}).partitions()
    assert len(plan()) == 1 and 8 <= len(plan(cores="8")) <= 14 and sum(len(p.paths) for p in plan(cores="8")) == 40
    assert len(plan(cores="1000")) == 14 and len(plan(targetBytes="300000")) == 40
