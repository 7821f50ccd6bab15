"""Snapshots of files of any size: byte ranges are hashed where they are read, each content is stored once, and no row
holds more than a chunk.

Files are cut into ranges of one size. A first pass reads the ranges and keeps their hashes only; of equal ranges the
first by name and number is read again and stored, so contents never go through a shuffle. A file's digest is the hash
of its ranges' hashes in order, which tasks can work out apart and which tells whether a file came back whole."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.sources import folders

#: Bytes of a range.
CHUNK = 64 << 20
#: Bytes of small ranges that a task hands over at a time.
AT_ONCE = 4 << 20


def ranges(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(name, number, start, size) of `files` (name, size): ranges in order; an empty file has one of no bytes."""
    last = F.greatest(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / chunk))
    cut = files.select("name", F.col("size").alias("_whole"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("number"))
    start = F.col("number") * chunk
    return cut.select("name", "number", start.alias("start"), F.least(F.lit(chunk).cast("long"), F.col("_whole") - start).alias("size"))


def _reading(folder: str, with_content: bool):
    """For mapInArrow: the ranges of files below `folder` with their hash, and their bytes where they are wanted."""

    def run(batches: Iterator) -> Iterator:
        import hashlib
        import posixpath

        import pyarrow as pa

        columns = {"name": pa.string(), "number": pa.int64(), "start": pa.int64(), "size": pa.int64(), "hash": pa.string()} | ({"content": pa.binary()} if with_content else {})

        def made(rows: list):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(columns.values())], names=list(columns))

        store, root = folders.store_of(folder)
        for batch in batches:
            held, bytes_held, opened, f = [], 0, None, None
            for name, number, start, size in zip(*(batch.column(c).to_pylist() for c in ("name", "number", "start", "size")), strict=True):
                if name != opened:
                    if f is not None:
                        f.close()
                    opened, f = name, store.open_input_file(posixpath.join(root, name))
                content = f.read_at(size, start)
                if len(content) != size:
                    raise OSError(f"{name} has changed while it was read")
                held.append((name, number, start, size, hashlib.sha256(content).hexdigest(), *([content] if with_content else [])))
                bytes_held += size
                if with_content and bytes_held >= AT_ONCE:  # a large range goes on alone
                    yield made(held)
                    held, bytes_held = [], 0
            if f is not None:
                f.close()
            yield made(held)

    return run


def hashed_ranges(wanted: DataFrame, folder: str) -> DataFrame:
    """(name, number, start, size, hash)"""
    return wanted.mapInArrow(_reading(folder, False), "name string, number long, start long, size long, hash string")


def contents(wanted: DataFrame, folder: str) -> DataFrame:
    """(name, number, start, size, hash, content)"""
    return wanted.mapInArrow(_reading(folder, True), "name string, number long, start long, size long, hash string, content binary")


def digest(parts: Column) -> Column:
    """The digest of a file from its ranges' hashes in order."""
    return F.sha2(F.array_join(parts, ""), 256)


def described(parts: DataFrame) -> DataFrame:
    """(name, size, parts, digest) from (name, number, size, hash); one short hash for each CHUNK bytes meets in a row."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("number", "hash"))), lambda p: p["hash"])
    lists = parts.groupBy("name").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("parts"), ordered.alias("hashes"))
    return lists.select("name", "size", "parts", digest(F.col("hashes")).alias("digest"))


def pack_files(spark: SparkSession, folder: str, path: str, chunk: int = CHUNK) -> None:
    """Tables below `path` for the files below `folder`: parts (name, number, start, size, hash), chunks (hash, content),
    files (name, size, parts, digest)."""
    out = lambda df, table: df.write.option("compression", "zstd").parquet(f"{path}/{table}")
    back = lambda table: spark.read.parquet(f"{path}/{table}")
    tasks = spark.sparkContext.defaultParallelism * 4
    wanted = ranges(folders.listing(spark, folder), chunk)
    out(hashed_ranges(wanted.repartition(tasks, "name", "number"), folder), "parts")
    first = back("parts").groupBy("hash").agg(F.min(F.struct("name", "number", "start", "size")).alias("_at")).select("_at.*")
    out(contents(first.repartition(tasks, "name", "number"), folder).select("hash", "content"), "chunks")
    out(described(back("parts")), "files")


def changed(spark: SparkSession, path: str, folder: str, chunk: int = CHUNK) -> DataFrame:
    """(name, problem): files of a snapshot that are missing below `folder` or differ there."""
    now = described(hashed_ranges(ranges(folders.dealt(spark, folder), chunk), folder)).select("name", F.col("size").alias("_size"), F.col("digest").alias("_digest"))
    problem = F.when(F.col("_digest").isNull(), "missing").when(F.col("_size") != F.col("size"), "size").when(F.col("_digest") != F.col("digest"), "content")
    return spark.read.parquet(f"{path}/files").join(now, "name", "left").select("name", problem.alias("problem")).filter("problem IS NOT NULL")


def restore_files(spark: SparkSession, path: str, folder: str) -> int:
    """Write the files of a snapshot below `folder` and give their number. A file's chunks stream through one task in
    order, as stores only append; it gets its name when it is whole. Names that leave the folder are refused."""
    parts = spark.read.parquet(f"{path}/parts").select("name", "number", "hash")
    bad = parts.filter(F.col("name").startswith("/") | F.array_contains(F.split("name", "/"), "..")).select("name").take(1)
    if bad:
        raise ValueError(f"entry leaves the folder: {bad[0]['name']}")

    def write(batches: Iterator) -> Iterator:
        import posixpath
        import uuid

        import pyarrow as pa

        store, root = folders.store_of(folder)
        name, part, stream, count, there = None, "", None, 0, set()

        def close():
            stream.close()
            store.move(part, posixpath.join(root, name))

        for batch in batches:
            for this, content in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if this != name:
                    if stream is not None:
                        close()
                    name = this
                    whole = posixpath.join(root, name)
                    if posixpath.dirname(whole) not in there:
                        store.create_dir(posixpath.dirname(whole), recursive=True)
                        there.add(posixpath.dirname(whole))
                    part = f"{whole}.{uuid.uuid4().hex}.part"
                    stream, count = store.open_output_stream(part), count + 1
                stream.write(content.as_buffer())
        if stream is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], names=["n"])

    chunks = spark.read.parquet(f"{path}/chunks")
    rows = parts.join(chunks, "hash").select("name", "number", "content").repartition("name").sortWithinPartitions("name", "number")
    return rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
