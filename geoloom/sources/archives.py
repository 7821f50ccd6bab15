"""Listing of packed archives: header and seek table are decoded, payloads are not.

Layout (all little-endian): 4 bytes of magic, version as 32 bits, then 64-bit fields. Versions 3 and 4: flags, seek
offset, payload offset, payload size, raw total; at the seek offset the number of entries (32 bits), entries of 44 bytes
(flags, name length, name offset as 32 bits; data offset, data size, raw size, hash as 64 bits), then the names one
after another. Version 2: flags, payload size, raw total; then flags, name length (32 bits), name, data length (64
bits) and data, entry by entry.

`files_listed` reads archives where they lie: of each the header and the seek table, or of version 2 the entries' heads
with a seek over each payload, so what is read does not follow the archives' size. The other functions take contents.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.sources import folders


def unsigned(data: Column, at, width: int) -> Column:
    """Little-endian number of `width` bytes at byte `at` (from 0)."""
    start = (F.lit(at) if isinstance(at, int) else at) + 1
    piece = F.substr(data, start.cast("int"), F.lit(width))
    bytes_hex = F.hex(piece)
    # Bytes in reverse order: pairs of hexadecimal digits from the end.
    turned = F.concat(*[F.substring(bytes_hex, 2 * i - 1, 2) for i in range(width, 0, -1)])
    return F.conv(turned, 16, 10).cast("decimal(20,0)")


def headers(files: DataFrame, magic: bytes) -> DataFrame:
    """`files` (path, content) with version, seek_offset, payload_offset, payload_size, raw_total and problem."""
    data = F.col("content")
    size = F.octet_length(data)
    good = (size >= 8) & (F.substr(data, F.lit(1), F.lit(4)) == F.lit(magic))
    version = F.when(good, unsigned(data, 4, 4).cast("int"))
    problem = (
        F.when(size < 8, "truncated").when(~good, "bad magic").when(~version.isin(2, 3, 4), "unknown version")
        .when(size < F.when(version == 2, 32).otherwise(48), "truncated")
    )
    out = files.withColumns({"version": version, "problem": problem})
    late = F.col("problem").isNull() & F.col("version").isin(3, 4)
    early = F.col("problem").isNull() & (F.col("version") == 2)
    return out.withColumns(
        {
            "seek_offset": F.when(late, unsigned(data, 16, 8).cast("long")),
            "payload_offset": F.when(late, unsigned(data, 24, 8).cast("long")).when(early, 32),
            "payload_size": F.when(late, unsigned(data, 32, 8).cast("long")).when(early, unsigned(data, 16, 8).cast("long")),
            "raw_total": F.when(late, unsigned(data, 40, 8).cast("long")).when(early, unsigned(data, 24, 8).cast("long")),
        }
    )


def quarantined(files: DataFrame, magic: bytes) -> DataFrame:
    """(path, problem) of files that are no archives."""
    return headers(files, magic).filter("problem IS NOT NULL").select("path", "problem")


def listed(files: DataFrame, magic: bytes) -> DataFrame:
    """(path, entry, name, flags, data_size, raw_size, hash) of archives of versions 3 and 4: of an archive only its
    seek table and names go on, and each is gone through once."""

    def entries(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        row = np.dtype([("flags", "<u4"), ("length", "<u4"), ("at", "<u4"), ("data_at", "<u8"), ("data_size", "<u8"), ("raw_size", "<u8"), ("hash", "<u8")])
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = min(int.from_bytes(index[:4], "little"), (len(index) - 4) // row.itemsize)
                found = np.frombuffer(index, row, max(n, 0), 4) if n > 0 else np.empty(0, row)
                heap = index[4 + n * row.itemsize :]
                stops = np.cumsum(found["length"], dtype=np.int64)
                names = [heap[stop - size : stop].decode("utf-8", "replace") for stop, size in zip(stops.tolist(), found["length"].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * n), pa.array(range(n), pa.int32()), pa.array(names, pa.string()),
                        *(pa.array(found[c].astype(np.int64)) for c in ("flags", "data_size", "raw_size")),
                        pa.array(map(Decimal, found["hash"].tolist()), pa.decimal128(20, 0)),
                    ],
                    names=["path", "entry", "name", "flags", "data_size", "raw_size", "hash"],
                )

    good = headers(files, magic).filter("problem IS NULL AND version IN (3, 4)")
    start = F.col("seek_offset")
    stop = F.when(F.col("payload_offset") > start, F.col("payload_offset")).otherwise(F.octet_length("content"))
    index = F.substr("content", (start + 1).cast("int"), (stop - start).cast("int"))
    return good.select("path", index.alias("index")).mapInArrow(
        entries, "path string, entry int, name string, flags long, data_size long, raw_size long, hash decimal(20,0)"
    )


def listed_v2(files: DataFrame, magic: bytes) -> DataFrame:
    """(path, entry, name, flags, data_size, raw_size, hash) of archives of version 2: their entries follow one another,
    so a step needs the one before; a higher-order aggregate walks them."""
    good = headers(files, magic).filter("problem IS NULL AND version = 2")
    data = F.col("content")
    end = F.lit(32) + F.col("payload_size")
    kind = "array<struct<name:string,flags:bigint,data_size:bigint>>"
    zero = F.struct(F.lit(32).cast("long").alias("at"), F.array().cast(kind).alias("found"))

    def step(acc: Column, _: Column) -> Column:
        at = acc["at"]
        length = unsigned(data, at + 4, 4).cast("long")
        size = unsigned(data, at + 8 + length, 8).cast("long")
        one = F.struct(
            F.decode(F.substr(data, (at + 9).cast("int"), length.cast("int")), "UTF-8").alias("name"), unsigned(data, at, 4).cast("long").alias("flags"), size.alias("data_size")
        )
        return F.when(at < end, F.struct((at + 16 + length + size).alias("at"), F.concat(acc["found"], F.array(one)).cast(kind).alias("found"))).otherwise(acc)

    # An entry takes 16 bytes at the least, which bounds their number.
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), (F.col("payload_size") / 16).cast("int")))
    walked = good.withColumn("found", F.aggregate(steps, zero, step)["found"])
    return walked.select("path", F.posexplode("found").alias("entry", "e")).select(
        "path", "entry", "e.name", "e.flags", "e.data_size", F.col("e.data_size").alias("raw_size"), F.lit(0).cast("decimal(20,0)").alias("hash")
    )


# --- ranged reads -------------------------------------------------------------------------------------------------

#: Entries of a seek table that are read at a time.
AT_ONCE = 65_536
LISTED = "path string, version int, problem string, entry long, name string, flags long, data_size long, raw_size long, hash decimal(20,0)"


def walk(f, size: int, magic: bytes) -> Iterator[tuple]:
    """(version, problem, entry, name, flags, data_size, raw_size, hash) of an open archive of `size` bytes: one row for
    each entry, or one with a problem and no entry. `f` is read by read_at(bytes, place) only."""
    import struct

    def broken(version: int | None, problem: str) -> tuple:
        return version, problem, None, None, None, None, None, None

    head = f.read_at(min(size, 48), 0)
    if len(head) < 8:
        yield broken(None, "truncated")
        return
    if head[:4] != magic:
        yield broken(None, "bad magic")
        return
    version = int.from_bytes(head[4:8], "little")
    if version not in (2, 3, 4):
        yield broken(version, "unknown version")
        return
    if len(head) < (32 if version == 2 else 48):
        yield broken(version, "truncated")
        return
    if version == 2:
        (payload,) = struct.unpack_from("<Q", head, 16)
        at, stop, entry = 32, 32 + payload, 0
        while at < stop:
            flags, length = struct.unpack("<II", f.read_at(8, at)) if at + 8 <= size else (0, size)
            if at + 16 + length > size:
                yield broken(version, "truncated")
                return
            tail = f.read_at(length + 8, at + 8)
            data_size = int.from_bytes(tail[length:], "little")
            yield version, None, entry, tail[:length].decode("utf-8", "replace"), flags, data_size, data_size, 0
            at, entry = at + 16 + length + data_size, entry + 1
        return
    (seek,) = struct.unpack_from("<Q", head, 16)
    if seek + 4 > size:
        yield broken(version, "truncated")
        return
    count = int.from_bytes(f.read_at(4, seek), "little")
    table, heap = seek + 4, seek + 4 + 44 * count
    if heap > size:
        yield broken(version, "truncated")
        return
    for first in range(0, count, AT_ONCE):
        n = min(AT_ONCE, count - first)
        rows = list(struct.iter_unpack("<IIIQQQQ", f.read_at(44 * n, table + 44 * first)))
        names = f.read_at(sum(r[1] for r in rows), heap)
        if len(names) < sum(r[1] for r in rows):
            yield broken(version, "truncated")
            return
        at = 0
        for k, (flags, length, _, _, data_size, raw_size, digest) in enumerate(rows):
            yield version, None, first + k, names[at : at + length].decode("utf-8", "replace"), flags, data_size, raw_size, digest
            at += length
        heap += at


def files_listed(spark: SparkSession, folder: str, magic: bytes) -> DataFrame:
    """(path, version, problem, entry, name, flags, data_size, raw_size, hash) of the archives below a folder, by ranged
    reads; a file that is no archive or is cut off has a row with a problem and no entry."""

    def run(batches: Iterator) -> Iterator:
        import posixpath

        import pyarrow as pa

        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.decimal128(20, 0))
        names = [c.split()[0] for c in LISTED.split(", ")]
        store, root = folders.store_of(folder)

        def made(rows: list):
            rows = [(*r[:-1], None if r[-1] is None else Decimal(r[-1])) for r in rows]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

        for batch in batches:
            held: list = []
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(posixpath.join(root, name)) as f:
                    for row in walk(f, size, magic):
                        held.append((name, *row))
                        if len(held) >= AT_ONCE:
                            yield made(held)
                            held = []
            yield made(held)

    return folders.dealt(spark, folder).mapInArrow(run, LISTED)
