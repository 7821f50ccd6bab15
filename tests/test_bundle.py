import glob
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from geoloom.functions import names
from geoloom.operators import bundle
from geoloom.operators.ranks import ranked_within, running_sum, with_previous
from geoloom.sources import archives, views

MAGIC = b"ARCH"


@pytest.fixture
def entries(spark):
    rows = [("b.txt", b"same"), ("a.txt", b"same"), ("dir with blank/[x]&y.txt", "é".encode()), ("empty", b""), ("deep/er/z.bin", bytes(range(256)))]
    return spark.createDataFrame([(n, bytearray(c)) for n, c in rows], "name string, content binary")


def test_index_and_totals(entries):
    rows = {r.name: r for r in bundle.index(entries).collect()}
    assert rows["b.txt"].stored_as == "a.txt" and not rows["b.txt"].is_stored and rows["b.txt"].offset == rows["a.txt"].offset == 0
    assert rows["deep/er/z.bin"].offset == 4 and rows["dir with blank/[x]&y.txt"].offset == 260
    t = bundle.totals(bundle.index(entries)).first()
    assert (t.entries, t.raw_bytes, t.stored_bytes, t.duplicates) == (5, 266, 262, 1)
    none = bundle.totals(bundle.index(entries.limit(0))).first()
    assert (none.entries, none.raw_bytes, none.ratio) == (0, 0, None)


def test_pack_open_restore(spark, entries, tmp_path):
    bundle.pack(entries, f"{tmp_path}/b")
    opened = bundle.open_bundle(spark, f"{tmp_path}/b")
    assert bundle.differences(entries, opened).count() == 0
    assert bytes(bundle.entry(spark, f"{tmp_path}/b", "empty").first().content) == b"" and bundle.entry(spark, f"{tmp_path}/b", "no").count() == 0
    assert bundle.restore(opened, f"{tmp_path}/out") == 5
    back = bundle.read_files(spark, f"file://{tmp_path}/out")
    assert bundle.differences(entries, back.select("name", "content")).count() == 0
    assert [r.name for r in bundle.in_path_order(back.select("name")).collect()] == sorted(r.name for r in entries.collect())
    assert bundle.read_files(spark, f"file://{tmp_path}/out").select("name").distinct().count() == back.count() == 5
    escape = spark.createDataFrame([("../x", bytearray(b"1"))], "name string, content binary")
    with pytest.raises(ValueError, match="leaves the folder"):
        bundle.restore(escape, f"{tmp_path}/out")
    shuffled = entries.orderBy(F.desc("name"))
    assert bundle.index(entries).exceptAll(bundle.index(shuffled)).count() == 0


def test_verify(spark, entries):
    index, stored = bundle.index(entries), bundle.blobs(entries)
    assert bundle.verified(index, stored).count() == 0
    bad = stored.withColumn("content", F.when(F.octet_length("content") == 4, F.lit(b"Same")).when(F.octet_length("content") == 2, F.lit(b"x")).otherwise(F.col("content"))).filter("raw_size > 0")
    assert {r.name: r.problem for r in bundle.verified(index, bad).collect()} == {"a.txt": "hash", "b.txt": "hash", "dir with blank/[x]&y.txt": "size", "empty": "missing"}


@pytest.mark.parametrize(
    ("files", "want"),
    [
        (["a.txt", "a.txt", "a_1.txt"], ["a.txt", "a_1.txt", "a_1_1.txt"]),
        (["a_1.txt", "a.txt", "a.txt"], ["a_1.txt", "a.txt", "a_2.txt"]),
        (["x", "x", "x"], ["x", "x_1", "x_2"]),
        (["a.txt", "b.txt", "a.csv", ".h", ".h"], ["a.txt", "b.txt", "a.csv", ".h", ".h_1"]),
        (["a_1", "a_2", "a_4", "a", "a", "a", "a_01", "a_2"], ["a_1", "a_2", "a_4", "a", "a_3", "a_5", "a_01", "a_2_1"]),
        (["a", "a", "a_1", "a_1", "a_1_1", "a"], ["a", "a_1", "a_1_1", "a_1_2", "a_1_1_1", "a_2"]),
    ],
)
def test_bundle_names(spark, files, want):
    df = spark.createDataFrame([(i, f"/d{i}/{f}", "resources") for i, f in enumerate(files)], "pos int, path string, folder string")
    assert [r.name for r in bundle.bundle_names(df).orderBy("pos").collect()] == [f"resources/{w}" for w in want]


def test_bundle_names_against_taking_turns(spark):
    rng = random.Random(3)
    for most in (2, 4, 9):
        files = [(i, f"/d/{rng.choice('ab')}{''.join(f'_{rng.randint(1, most)}' for _ in range(rng.choice((0, 0, 1, 2))))}.txt", "r") for i in range(60)]
        taken, want = set(), []
        for _, path, _ in files:
            stem = path[3:-4]
            free = next(n for n in (f"{stem}{f'_{k}' if k else ''}.txt" for k in range(100)) if n not in taken)
            taken.add(free)
            want.append(f"r/{free}")
        df = spark.createDataFrame(files, "pos int, path string, folder string").repartition(3)
        assert [r.name for r in bundle.bundle_names(df).orderBy("pos").collect()] == want


def taking_turns(paths):
    taken, out = set(), []
    for path in paths:
        stem, ext = path.rsplit("/", 1)[-1].rsplit(".", 1)
        k = 0
        while f"{stem}{f'_{k}' if k else ''}.{ext}" in taken:
            k += 1
        taken.add(f"{stem}{f'_{k}' if k else ''}.{ext}")
        out.append(f"r/{stem}{f'_{k}' if k else ''}.{ext}")
    return out


def test_many_clashes_take_no_rounds(spark, monkeypatch):
    """Numbers held before, between and after the files that pass over them, all of one stem: one level, one pass."""
    levels, count = [], bundle.passed_over
    monkeypatch.setattr(bundle, "passed_over", lambda *a: levels.append(1) or count(*a))
    names_ = [f"a_{k}" for k in range(1, 100, 2)] + ["a"] * 40 + [f"a_{k}" for k in range(2, 160, 4)] + ["a"] * 40 + [f"a_{k}" for k in range(60, 200)] + ["a", "a_3", "a_200"]
    paths = [f"/d/{n}.txt" for n in names_]
    df = spark.createDataFrame([(i, p, "r") for i, p in enumerate(paths)], "pos int, path string, folder string")
    assert [r.name for r in bundle.bundle_names(df).orderBy("pos").collect()] == taking_turns(paths)
    assert len(levels) == 1


def test_the_query_of_clashing_names(spark, sf_dir):
    from geoloom.plans import queries

    rows = sorted(queries.clashing_names(spark, sf_dir).collect(), key=lambda r: r.pos)
    assert [r.name for r in rows] == taking_turns([r.path for r in rows])
    assert sum(r.name[2:] != r.path for r in rows) > len(rows) / 4


def test_manifest_size(entries):
    none = entries.limit(0)
    with pytest.raises(ValueError, match="stays in tables"):
        bundle.manifest_json(bundle.manifest_entries(entries), none, none, "", "", most=4)


def test_previous(spark):
    df = spark.createDataFrame([(i % 3 if i % 7 else None, i, f"v{i}") for i in range(100)], "k int, v int, t string").repartition(6)
    got = {r.v: r.prev_t for r in with_previous(df, ["k"], ["v"], ["t"]).collect()}
    last, want = {}, {}
    for i in range(100):
        k = i % 3 if i % 7 else None
        want[i] = last.get(k)
        last[k] = f"v{i}"
    assert got == want and with_previous(df.limit(0), ["k"], ["v"], ["t"]).count() == 0


def test_gathering(spark):
    paths = lambda *p: spark.createDataFrame([(i, x) for i, x in enumerate(p)], "pos int, path string")
    listing = paths("/a/r.shp", "/a/r.qml", "/a/r.aux.xml", "/a/s.tif", "/b/r.qml", "/a/t.qml")
    assert {r.path for r in bundle.sidecars(paths("/a/r.shp", "/a/s.tif", "/a/t.qml"), listing).collect()} == {"/a/r.qml", "/a/r.aux.xml"}
    assert {r.path for r in bundle.missing_files(paths("/a/r.shp", "/x"), listing).collect()} == {"/x"}
    assert {r.path for r in bundle.existing_files(paths("/a/r.shp", "/x"), listing).collect()} == {"/a/r.shp"}
    seen = {r.path: tuple(r.pos) for r in bundle.first_seen(paths("/a", "/b", "/a"), paths("/c", "/b")).collect()}
    assert seen == {"/a": (0, 0), "/b": (0, 1), "/c": (1, 0)}
    layers = spark.createDataFrame([("/a/r.shp|layer=1",), ("s.tif",), ("wms:x",), ("/gone",)], "source string")
    assert [r.path for r in bundle.resolved_sources(layers, listing, "/a").orderBy("source").collect()] == ["/a/r.shp", None, "/a/s.tif", None]


def test_rewriting(spark):
    df = spark.createDataFrame([("see /a/b and /a/b2 and /a",)], "t string")
    pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(t).alias("t")) for f, t in (("/a/b", "X/a"), ("/a/b2", "Y"), ("/a", "Z"))])
    assert df.select(bundle.rewritten(F.col("t"), pairs)).first()[0] == "see X/a and Y and Z"
    assert df.select(bundle.rewritten(F.col("t"), pairs, compat=True)).first()[0] == "see XZ and XZ2 and Z"
    flag = spark.range(1).select(bundle.absolute_flag(F.lit('<Relative type="int">1</Relative>')).alias("a"), bundle.absolute_flag(F.lit('<Relative type="int">2</Relative>'), False).alias("b")).first()
    assert ">2<" in flag.a and ">0<" in flag.b


def test_manifest(spark, entries, tmp_path):
    described = bundle.manifest_entries(entries)
    depends = bundle.dependencies(spark.createDataFrame([("s", 2, "b"), ("s", 1, "a"), ("t", 1, "c")], "source string, pos int, name string"))
    rewrites = entries.select(names.to_bundle_uri(F.col("name")).alias("uri"), F.concat(F.lit("/old/"), "name").alias("path"))
    doc = bundle.manifest_json(described, depends, rewrites, "2024-01-01T00:00:00", "1.0")
    m = json.loads(doc.first().manifest)
    assert m["dependencies"] == {"a": ["b"], "c": []} and m["entries"]["b.txt"]["size"] == 4 and m["version"] == 4
    for kept in (entries.count(), 0):
        some = [t.limit(kept) for t in (described, depends, rewrites)]
        one = bundle.manifest_json(*some, "2024", 'v "1"').first().manifest
        bundle.write_manifest(bundle.manifest_fragments(*some, "2024", 'v "1"'), f"{tmp_path}/{kept}")
        whole = "".join(open(p).read().replace("\n", "") for p in sorted(glob.glob(f"{tmp_path}/{kept}/part-*")))
        filled = {"entries": {}, "dependencies": {}, "uri_rewrites": {}} | json.loads(one)
        assert json.loads(whole) == {k: v or {} for k, v in filled.items()}
    back = bundle.read_manifest(doc.select(F.encode("manifest", "UTF-8").alias("content")).unionByName(spark.createDataFrame([(bytearray(b"{bad"),)], "content binary"))).collect()
    assert back[0].manifest.entries["b.txt"].hash == m["entries"]["b.txt"]["hash"] and (back[1].manifest is None or back[1].manifest.version is None)
    assert bundle.original_paths(described, rewrites).count() == 5


def archive(version, items):
    if version == 2:
        body = b"".join(struct.pack("<II", 0, len(n.encode())) + n.encode() + struct.pack("<Q", len(c)) + c for n, c in items)
        return MAGIC + struct.pack("<IQQQ", 2, 0, len(body), sum(len(c) for _, c in items)) + body
    table, at = b"", 0
    for n, c in items:
        table += struct.pack("<IIIQQQQ", 7, len(n.encode()), 0, at, len(c), len(c) + 1, 2**63 + len(c))
        at += len(c)
    seek = struct.pack("<I", len(items)) + table + b"".join(n.encode() for n, _ in items)
    return MAGIC + struct.pack("<IQQQQQ", version, 0, 48, 48 + len(seek), at, at) + seek + b"".join(c for _, c in items)


def test_archive_listing(spark):
    items = [("ä.txt", b"abc"), ("b/c", b""), ("z", b"x" * 300)]
    files = [("v4", archive(4, items)), ("v3", archive(3, items[:1])), ("none", archive(4, [])), ("v2", archive(2, items)), ("short", b"AR"), ("cut", MAGIC + struct.pack("<I", 4)), ("odd", b"XXXX" + bytes(60)), ("v9", MAGIC + struct.pack("<I", 9) + bytes(60))]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")
    rows = {(r.path, r.entry): r for r in archives.listed(df, MAGIC).collect()}
    assert [(rows["v4", i].name, rows["v4", i].data_size, rows["v4", i].raw_size, int(rows["v4", i].hash), rows["v4", i]["flags"]) for i in range(3)] == [(n, len(c), len(c) + 1, 2**63 + len(c), 7) for n, c in items]
    assert len(rows) == 4
    assert {r.path: r.problem for r in archives.quarantined(df, MAGIC).collect()} == {"short": "truncated", "cut": "truncated", "odd": "bad magic", "v9": "unknown version"}
    assert [(r.name, r.data_size) for r in archives.listed_v2(df, MAGIC).orderBy("entry").collect()] == [(n, len(c)) for n, c in items]


def test_ranks(spark):
    df = spark.createDataFrame([(i % 3 if i % 7 else None, i) for i in range(100)], "k int, v int").repartition(6)
    got = {r.v: r["rank"] for r in ranked_within(df, ["k"], ["v"]).collect()}
    groups = {}
    for i in range(100):
        groups.setdefault(i % 3 if i % 7 else None, []).append(i)
    assert got == {v: n for g in groups.values() for n, v in enumerate(g, 1)}
    assert {r.v: r.offset for r in running_sum(df, "v", ["v"]).collect()} == {i: i * (i - 1) // 2 for i in range(100)}


def test_views(spark, sf_dir):
    assert views.cells(spark, sf_dir).columns == ["row", "col", "x", "y", "value"]


def test_a_written_manifest_is_read_in_pieces(spark, tmp_path):
    odd = ["a", ',b":{', 'c\\":"d', "line\nend\r", "\u00e9\U0001f600", "{", ""]
    described = spark.createDataFrame([(n, "resource", i, f"h{i}") for i, n in enumerate(odd)], "name string, type string, size long, hash string")
    depends = spark.createDataFrame([(n, ["x", n]) for n in odd], "primary string, companions array<string>")
    rewrites = spark.createDataFrame([(n, f"{{{n}") for n in odd], "uri string, path string")
    path = f"file://{tmp_path}/manifest"
    bundle.write_manifest(bundle.manifest_fragments(described, depends, rewrites, "2024", "1"), path)
    entries, uris = bundle.read_written(spark, path)
    assert {(r.version, r.name, r.type, r.size, r.hash) for r in entries.collect()} == {(4, n, "resource", i, f"h{i}") for i, n in enumerate(odd)}
    assert {(r.uri, r.path) for r in uris.collect()} == {(n, f"{{{n}") for n in odd}
