"""Contents in chunks, and archives listed by ranged reads."""

import hashlib
import os
import struct

import pytest

from geoloom.operators import bundle, chunks
from geoloom.sources import archives, folders

MAGIC = b"ARC0"


def files_of(folder):
    out = {}
    for top, _, names in os.walk(folder):
        for n in names:
            with open(os.path.join(top, n), "rb") as f:
                out[os.path.relpath(os.path.join(top, n), folder)] = f.read()
    return out


@pytest.fixture
def folder(tmp_path):
    made = tmp_path / "in"
    (made / "sub").mkdir(parents=True)
    block = os.urandom(1000)
    for name, body in {"a.bin": block * 30 + b"end", "sub/b.bin": b"head" + block * 3, "sub/c.bin": block * 30 + b"END", "empty": b"", "one": b"x", "even": block * 10}.items():
        (made / name).write_bytes(body)
    return made


def test_files_come_back_whole_and_equal_chunks_are_stored_once(spark, folder, tmp_path):
    chunks.pack_files(spark, f"file://{folder}", f"{tmp_path}/snap", 1000)
    parts, stored = spark.read.parquet(f"{tmp_path}/snap/parts"), spark.read.parquet(f"{tmp_path}/snap/chunks")
    want = files_of(folder)
    pieces = [body[i : i + 1000] for body in want.values() for i in range(0, max(1, len(body)), 1000)]
    assert parts.count() == len(pieces) and sorted(r.content for r in stored.collect()) == sorted(set(map(bytes, pieces)))
    assert stored.selectExpr("max(octet_length(content))").first()[0] == 1000
    rows = {r.name: r for r in spark.read.parquet(f"{tmp_path}/snap/files").collect()}
    for name, body in want.items():
        hashes = "".join(hashlib.sha256(body[i : i + 1000]).hexdigest() for i in range(0, max(1, len(body)), 1000))
        assert (rows[name].size, rows[name].digest) == (len(body), hashlib.sha256(hashes.encode()).hexdigest())
    assert chunks.restore_files(spark, f"{tmp_path}/snap", f"file://{tmp_path}/out") == len(want)
    assert files_of(tmp_path / "out") == want
    assert chunks.changed(spark, f"{tmp_path}/snap", f"file://{tmp_path}/out", 1000).count() == 0


def test_changes_are_found_and_bad_names_refused(spark, folder, tmp_path):
    chunks.pack_files(spark, f"file://{folder}", f"{tmp_path}/snap", 4096)
    (folder / "one").write_bytes(b"y")
    (folder / "even").write_bytes(b"short")
    (folder / "empty").unlink()
    assert {r.name: r.problem for r in chunks.changed(spark, f"{tmp_path}/snap", f"file://{folder}", 4096).collect()} == {"one": "content", "even": "size", "empty": "missing"}
    spark.createDataFrame([("../x", 0, "h")], "name string, number long, hash string").write.parquet(f"{tmp_path}/bad/parts")
    with pytest.raises(ValueError, match="leaves the folder"):
        chunks.restore_files(spark, f"{tmp_path}/bad", f"file://{tmp_path}/out")


class Counting:
    """An open archive that counts what is read."""

    def __init__(self, head, hole, tail=b""):
        self.head, self.hole, self.tail, self.read = head, hole, tail, 0

    def read_at(self, n, at):
        self.read += n
        whole = len(self.head) + self.hole
        first = self.head[at : at + n]
        if at + n > whole and self.tail:
            first += self.tail[max(0, at - whole) : at + n - whole]
        return first


def v4(entries, payload):
    names = b"".join(n.encode() for n, _, _ in entries)
    table = struct.pack("<I", len(entries)) + b"".join(struct.pack("<IIIQQQQ", f, len(n.encode()), 0, 0, 5, s, 2**64 - 1) for n, f, s in entries) + names
    return MAGIC + struct.pack("<IQQQQQ", 4, 0, 48, 48 + len(table), payload, payload) + table


def test_what_is_read_does_not_follow_the_size(monkeypatch):
    monkeypatch.setattr(archives, "AT_ONCE", 7)
    entries = [(f"dir/é{i}.txt", i % 4, 10 * i) for i in range(40)]
    head = v4(entries, 10**12)
    f = Counting(head, 10**12)
    rows = list(archives.walk(f, len(head) + 10**12, MAGIC))
    assert [(r[3], r[4], r[6]) for r in rows] == entries and rows[3][:3] == (4, None, 3) and rows[0][7] == 2**64 - 1
    assert f.read <= len(head) + 64
    second = struct.pack("<II", 1, 3) + b"two" + struct.pack("<Q", 0)
    first = struct.pack("<II", 0, 3) + b"one" + struct.pack("<Q", 10**9)
    head = MAGIC + struct.pack("<IQQQ", 2, 0, len(first) + 10**9 + len(second), 10**9) + first
    f = Counting(head, 10**9, second)
    assert [r[2:6] for r in archives.walk(f, len(head) + 10**9 + len(second), MAGIC)] == [(0, "one", 0, 10**9), (1, "two", 1, 0)]
    assert f.read < 200


def test_folders_of_archives(spark, tmp_path):
    good = v4([("a", 1, 2), ("b", 0, 0)], 0)
    bodies = {"good": good, "empty": v4([], 0), "cut": good[:60], "names": good[:-1], "head": good[:20], "few": b"AR", "other": b"ZIP!" + good[4:], "new": MAGIC + struct.pack("<I", 9) + good[8:]}
    bodies["old"] = MAGIC + struct.pack("<IQQQ", 2, 0, 17, 1) + struct.pack("<II", 5, 1) + b"n" + struct.pack("<Q", 1)
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    rows = archives.files_listed(spark, f"file://{tmp_path}", MAGIC).collect()
    assert sorted((r.path, r.name, r.flags, r.raw_size) for r in rows if r.problem is None) == [("good", "a", 1, 2), ("good", "b", 0, 0), ("old", "n", 5, 1)]
    assert {r.path: r.problem for r in rows if r.problem} == {
        "cut": "truncated", "names": "truncated", "head": "truncated", "few": "truncated", "other": "bad magic", "new": "unknown version",
    }
    assert all(r.entry is None for r in rows if r.problem)


def test_a_flat_folder_is_no_partition_a_file(spark, tmp_path):
    made = tmp_path / "made"
    (made / "sub" / "deep").mkdir(parents=True)
    (made / "none").mkdir()
    names = {f"{i}.arc": i for i in range(300)} | {"sub/x": 3, "sub/deep/y z": 0}
    for name, size in names.items():
        (made / name).write_bytes(b"x" * size)
    found = folders.listing(spark, str(made))
    assert {r["name"]: r["size"] for r in found.collect()} == names
    assert found.rdd.getNumPartitions() == 3
    dealt = folders.dealt(spark, str(made))
    assert {r["name"]: r["size"] for r in dealt.collect()} == names
    assert dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(lambda n: n > 0).count() > 3
    assert folders.listing(spark, str(tmp_path / "missing")).count() == 0


def test_small_files_are_read_by_few_tasks(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    files = {f"sub/{i}.txt": b"x" * i for i in range(400)} | {"a.txt": b"\x00\xff"}
    for name, body in files.items():
        (tmp_path / "in" / name).write_bytes(body)
    read = bundle.read_files(spark, f"file://{tmp_path}/in")
    assert {r["name"]: (bytes(r["content"]), r["size"]) for r in read.collect()} == {n: (b, len(b)) for n, b in files.items()}
    assert read.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism * 4


def test_small_ranges_go_on_together(tmp_path):
    import pyarrow as pa

    (tmp_path / "a").write_bytes(b"abcdefghij")
    (tmp_path / "b").write_bytes(b"")
    rows = [("a", 0, 0, 4), ("a", 1, 4, 4), ("b", 0, 0, 0), ("a", 2, 8, 2)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["name", "number", "start", "size"])
    for with_content in (False, True):
        made = list(chunks._reading(str(tmp_path), with_content)(iter([batch])))
        assert len(made) == 1 and made[0].column("hash").to_pylist() == [hashlib.sha256(p).hexdigest() for p in (b"abcd", b"efgh", b"", b"ij")]
    assert made[0].column("content").to_pylist() == [b"abcd", b"efgh", b"", b"ij"]
