"""Packing: tokenised documents into sequences of bounded length, by bounded-space online best fit.

Each partition keeps a fixed number of open windows. A document longer than a window first fills whole windows of its
own; its rest goes to the open window that it fills best; when none has room, the fullest window is emitted and a new
one opened. What is still open at the end of the partitions is merged in groups of bounded size, largest first; emitted
windows are final. Sequences are written down before the merge, so a retried task cannot change what others have used.

Ids: those of the byte-level BPE in the tokenizer file, built from its vocabulary (its ids are its merge ranks), plus
an end id. Texts are cut at single spaces between non-blank characters, where the pre-tokenizer always cuts, and the
ids of a word are kept in a table of bounded size: 5 times fewer CPU seconds than encoding each text.
A string of an added token inside a text is that token's id, and the text before and after it is encoded apart.

Defined results: a null or empty text is the end id alone; repeated rows are packed each for itself; null and repeated
ids are carried as they are; other columns are not read; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm.common import saved, table

LENGTH = 1024
OPEN_WINDOWS = 64
END_ID = 0
#: Words whose ids a Python worker keeps (about 150 bytes each); beyond that the table starts anew.
KEPT_WORDS = 400_000
#: Open windows that one task merges.
MERGED_AT_ONCE = 4096

# Fixed value: the pre-tokenizer's pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# White space other than the space and the line feed: texts that hold any are encoded whole.
OTHER_BLANKS = [*map(chr, (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]


def byte_of_symbol() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Texts to little-endian 32-bit ids."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        added = model.get("added_tokens", [])
        if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens must stand for their exact strings")
        self.added = {t["content"]: t["id"].to_bytes(4, "little") for t in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        symbols = byte_of_symbol()
        ranks = {bytes(symbols[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in self.added}
        self.bpe = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words: dict[str, bytes] = {}
        self.most = KEPT_WORDS

    def whole(self, text: str) -> bytes:
        import numpy as np

        return np.asarray(self.bpe.encode_ordinary(text), dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            return b"".join(self.added[p] if p in self.added else self.plain(p) for p in self.cut.split(text))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        if not text:
            return b""
        if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or any(b in text for b in OTHER_BLANKS):
            return self.whole(text)
        first, *rest = text.split(" ")
        known, out = self.words, [self.whole(first)]
        for word in rest:
            ids = known.get(word)
            if ids is None:
                ids = self.whole(" " + word)
                if len(word) <= 64:
                    if len(known) >= self.most:
                        known.clear()
                    known[word] = ids
            out.append(ids)
        return b"".join(out)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def texts_of(column) -> list[str]:
    """The strings of an Arrow column; nulls are empty, bytes that are no UTF-8 are replaced."""
    try:
        return [t or "" for t in column.to_pylist()]
    except UnicodeDecodeError:
        import pyarrow as pa

        return [(b or b"").decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


class Windows:
    """The open windows of one partition."""

    def __init__(self, length: int, most: int, first_id: int):
        self.length, self.most, self.next_id = length, most, first_id
        self.open: list[list[int]] = []  # [fill, window id]

    def fresh(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def place(self, size: int) -> tuple[int, int]:
        """Window and offset for a piece of `size` < length: best fit, else a new window in place of the fullest."""
        best, room = None, self.length + 1
        for w in self.open:
            left = self.length - w[0] - size
            if 0 <= left < room:
                best, room = w, left
        if best is None:
            if len(self.open) >= self.most:
                self.open.remove(max(self.open))
            best = [0, self.fresh()]
            self.open.append(best)
        offset = best[0]
        best[0] += size
        window = best[1]
        if best[0] == self.length:
            self.open.remove(best)
        return window, offset


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, with_ids: bool = False, kept_words: int = KEPT_WORDS) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, window, offset, [ids]) before the merge, written down. A window that
    is open at the end of its partition has a row of length 0 at its end."""
    fields = [
        T.StructField(key, docs.schema[key].dataType), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("window", T.LongType()), T.StructField("offset", T.LongType()),
    ] + [T.StructField("ids", T.BinaryType())] * with_ids

    def pack(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        encoder(tokenizer).most = kept_words
        encode, end = encoder(tokenizer).ids, END_ID.to_bytes(4, "little")
        windows = Windows(length, OPEN_WINDOWS, TaskContext.get().partitionId() << 40)
        for batch in batches:
            names = ["row", "start", "length", "ids_crc32", "doc_tokens", "window", "offset", "ids"]
            out: dict[str, list] = {n: [] for n in names}
            for row, body in enumerate(texts_of(batch.column(1))):
                ids = encode(body) + end
                n = len(ids) // 4
                for start in range(0, n, length):
                    part = ids[4 * start : 4 * (start + length)]
                    size = len(part) // 4
                    window, offset = (windows.fresh(), 0) if size == length else windows.place(size)
                    values = (row, start, size, zlib.crc32(part), n, window, offset, part if with_ids else None)
                    for name, value in zip(names, values, strict=True):
                        out[name].append(value)
            rows = pa.array(out.pop("row"), pa.int64())
            ids_column = out.pop("ids")
            arrays = [batch.column(0).take(rows), *(pa.array(v, pa.int64()) for v in out.values())]
            if with_ids:
                arrays.append(pa.array(ids_column, pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])
            key_type = batch.schema.field(0).type
        if windows.open:
            n = len(windows.open)
            zero, (fill, window) = pa.array([0] * n, pa.int64()), (pa.array(c, pa.int64()) for c in zip(*windows.open, strict=True))
            ends = [pa.nulls(n, key_type), zero, zero, zero, zero, window, fill, *[pa.nulls(n, pa.binary())] * with_ids]
            yield pa.RecordBatch.from_arrays(ends, names=[f.name for f in fields])

    return saved(docs.select(key, text).mapInArrow(pack, T.StructType(fields)), "packed-pieces")


def merge_windows(windows: DataFrame, length: int) -> DataFrame:
    """(window, sequence_id, base) for open windows (window, fill): groups of about MERGED_AT_ONCE, largest first."""
    import pandas as pd

    count = windows.count()
    groups = max(1, -(-count // MERGED_AT_ONCE))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        from bisect import bisect_left, insort

        rooms: list[tuple[int, int, int]] = []  # (room, sequence id, fill), sorted
        out = []
        for fill, window in sorted(zip(pdf["fill"], pdf["window"], strict=True), key=lambda x: (-x[0], x[1])):
            at = bisect_left(rooms, (fill, -1, -1))
            room, sequence, base = rooms.pop(at) if at < len(rooms) else (length, window, 0)
            out.append((window, sequence, base))
            if room > fill:
                insort(rooms, (room - fill, sequence, base + fill))
        return pd.DataFrame(out, columns=["window", "sequence_id", "base"])

    grouped = windows.withColumn("group", F.pmod(F.xxhash64("window"), F.lit(groups)))
    return grouped.groupBy("group").applyInPandas(merge, "window long, sequence_id long, base long")


def packed(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, with_ids: bool = False, kept_words: int = KEPT_WORDS) -> DataFrame:
    """The pieces of all documents with sequence_id and offset; with `with_ids` also their ids (little-endian)."""
    placed = pieces(docs, tokenizer, key, text, length, with_ids, kept_words)
    left_open = placed.filter("length = 0").select("window", F.col("offset").alias("fill"))
    moved = saved(merge_windows(left_open, length), "packed-moves")
    return placed.filter("length > 0").join(moved, "window", "left").select(
        key, "start", "length", "ids_crc32", "doc_tokens",
        F.coalesce("sequence_id", "window").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
        *(["ids"] if with_ids else []),
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), default_tokenizer())
