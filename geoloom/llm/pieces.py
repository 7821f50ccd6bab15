"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces with log scores.

A model file's pieces and scores are read from its protocol buffer. Pieces that hold the white-space marker only at
their front let a text be cut before each marker that follows another character, and the best segmentation of the text
is that of its parts; parts are kept with their ids in a table of bounded size, so Viterbi runs once per distinct part.
Models with markers inside pieces are segmented whole. A character that no piece covers becomes its UTF-8 bytes'
pieces where the model has them, else the unknown id, at a penalty below every score.

Of the model's normaliser only two settings are followed, the marker put in front and the squeezing of spaces; its
character map is not, so texts are taken as they are (the map of the vocabulary used here changes nothing).

Decoding joins the pieces, collects byte pieces into characters, turns markers into spaces and drops the first one
that encoding has put in front.

Defined results: a null or empty text has no ids and decodes to the empty text; ties go to the segmentation whose last
piece starts first, so to the longest last piece; the marker character itself decodes to a space; bytes that are no
UTF-8 decode to U+FFFD; repeated rows and null or repeated ids are carried through; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from geoloom.llm.common import table
from geoloom.llm.packing import texts_of

MARK = "▁"
KEPT_PARTS = 300_000
UNKNOWN_PENALTY = 10.0
# Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol-buffer message: integers, 4-byte floats as bytes, or bytes."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
            yield tag >> 3, data[at : at + size]
            at += size


class DoubleArray:
    """A trie over bytes in two integer arrays: the child of state s by byte b is base[s] + b + 1, if check there is s."""

    def __init__(self, keys: list[bytes], values: list[int]):
        """`keys` sorted and distinct."""
        self.base, self.check, self.value = [0], [-1], [-1]
        self.free_from = 1
        stack = [(0, 0, len(keys), 0)]
        while stack:
            state, lo, hi, depth = stack.pop()
            if lo < hi and len(keys[lo]) == depth:
                self.value[state] = values[lo]
                lo += 1
            groups: list[tuple[int, int, int]] = []
            while lo < hi:
                byte, start = keys[lo][depth], lo
                while lo < hi and keys[lo][depth] == byte:
                    lo += 1
                groups.append((byte, start, lo))
            if not groups:
                continue
            base = self._place([g[0] for g in groups])
            self.base[state] = base
            for byte, _, _ in groups:
                self.check[base + byte + 1] = state
            stack += [(base + byte + 1, a, b, depth + 1) for byte, a, b in groups]

    def _place(self, labels: list[int]) -> int:
        """The least base at which every label's cell is free."""
        while self.free_from < len(self.check) and self.check[self.free_from] != -1:
            self.free_from += 1
        base = max(0, self.free_from - labels[0] - 1)
        misses = 0
        while True:
            need = base + labels[-1] + 2
            if need > len(self.check):
                more = need - len(self.check)
                self.base += [0] * more
                self.check += [-1] * more
                self.value += [-1] * more
            # Cell 0 is the root's; it is never a child.
            if base + labels[0] + 1 > 0 and all(self.check[base + x + 1] == -1 for x in labels):
                return base
            base += 1
            misses += 1
            if misses > 256:  # a crowded stretch: go on from its end
                base, misses = max(base, len(self.check) - labels[0] - 1), 0

    def closed(self) -> DoubleArray:
        """With spare cells at the end, so that a walk needs no bounds."""
        spare = max(self.base) + 258 - len(self.check)
        self.base += [0] * spare
        self.check += [-1] * spare
        self.value += [-1] * spare
        return self


class Model:
    """Pieces, scores and settings of a SentencePiece model file, segmented as a Unigram model."""

    def __init__(self, data: bytes):
        import struct

        self.pieces: list[str] = []
        scores, kinds = [], []
        self.add_front, self.squeeze = True, True
        for number, value in fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                scores.append(score)
                kinds.append(kind)
            elif number == 3:
                for n, v in fields(value):
                    if n == 3:
                        self.add_front = bool(v)
                    elif n == 4:
                        self.squeeze = bool(v)
        self.kinds = kinds
        self.unknown = kinds.index(UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == BYTE}
        normal = [s for s, k in zip(scores, kinds, strict=True) if k == NORMAL]
        low, high = min(normal, default=0.0), max(normal, default=0.0)
        self.unknown_score = low - UNKNOWN_PENALTY
        self.scores = [len(p) * high - 0.1 if k == USER_DEFINED else s for p, s, k in zip(self.pieces, scores, kinds, strict=True)]
        keys = sorted((p.encode(), i) for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k in (NORMAL, USER_DEFINED) and p)
        self.trie = DoubleArray([k for k, _ in keys], [i for _, i in keys]).closed()
        self.cuts = all(MARK not in p.lstrip(MARK) for p, k in zip(self.pieces, kinds, strict=True) if k in (NORMAL, USER_DEFINED))
        self.parts: dict[str, tuple[int, ...]] = {}

    def viterbi(self, text: str) -> tuple[int, ...]:
        """Ids of the best segmentation of `text` (markers in place of spaces)."""
        raw = text.encode()
        n = len(raw)
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        lowest = float("-inf")
        best, back, ident = [0.0] + [lowest] * n, [0] * (n + 1), [0] * (n + 1)
        at = 0
        while at < n:
            lead = raw[at]
            here, end = best[at], at
            after = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            state, single = 0, False
            while end < n:
                child = base[state] + raw[end] + 1
                if check[child] != state:
                    break
                state = child
                end += 1
                piece = value[state]
                if piece >= 0:
                    score = here + scores[piece]
                    if end == after:
                        single = True
                    if score > best[end]:
                        best[end], back[end], ident[end] = score, at, piece
            if not single:
                score = here + self.unknown_score
                if score > best[after]:
                    best[after], back[after], ident[after] = score, at, -1
            at = after
        out: list[int] = []
        while n:
            start = back[n]
            if ident[n] >= 0:
                out.append(ident[n])
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in reversed(raw[start:n])]
            else:
                out.append(self.unknown)
            n = start
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return []
        marked = (MARK if self.add_front else "") + text.replace(" ", MARK)
        if not self.cuts:
            return list(self.viterbi(marked))
        known, out, held = self.parts, [], ""
        # Parts: a run of markers with what follows it up to the next marker.
        for i, word in enumerate(marked.split(MARK)):
            held += MARK if i else ""
            if not word:
                continue
            part, held = held + word, ""
            ids = known.get(part)
            if ids is None:
                ids = self.viterbi(part)
                if len(part) <= 64:
                    if len(known) >= KEPT_PARTS:
                        known.clear()
                    known[part] = ids
            out.extend(ids)
        if held:
            out.extend(self.viterbi(held))
        return out

    def decode(self, ids: list[int]) -> str:
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if self.kinds[i] == BYTE:
                run.append(int(self.pieces[i][3:5], 16))
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(" ⁇ " if self.kinds[i] == UNKNOWN else "" if self.kinds[i] == CONTROL else self.pieces[i])
        out.append(run.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if self.add_front and text[:1] == " " else text


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    """One model per Python worker and file."""
    if path not in _models:
        with open(path, "rb") as f:
            _models[path] = Model(f.read())
    return _models[path]


def fields_of(rows: DataFrame, key: str, **others: T.DataType) -> T.StructType:
    """The key's field as it is in `rows`, and others."""
    return T.StructType([T.StructField(key, rows.schema[key].dataType), *(T.StructField(n, t) for n, t in others.items())])


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the pieces of every text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = model(path).encode
        for batch in batches:
            ids = pa.array([encode(t) for t in texts_of(batch.column(1))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, fields_of(docs, key, ids=T.ArrayType(T.IntegerType())))


def decoded(rows: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the texts that the ids stand for."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        decode = model(path).decode
        for batch in batches:
            texts = pa.array([decode(i or []) for i in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=[key, "text"])

    return rows.select(key, ids).mapInArrow(run, fields_of(rows, key, text=T.StringType()))


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_byte_tokens, ids_crc32, decoded_crc32, round_trip) without shipping the ids themselves:
    crc32 of the little-endian 32-bit ids and of the decoded text, and whether that is the text again."""

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        m = model(path)
        byte_ids = np.zeros(len(m.pieces), bool)
        byte_ids[list(m.byte_ids.values())] = True
        for batch in batches:
            rows = []
            for body in texts_of(batch.column(1)):
                ids = m.encode(body)
                array = np.array(ids, "<u4")
                back = m.decode(ids)
                rows.append((len(ids), int(byte_ids[array].sum()), zlib.crc32(array.tobytes()), zlib.crc32(back.encode()), back == body))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 4 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=[key, "n_tokens", "n_byte_tokens", "ids_crc32", "decoded_crc32", "round_trip"],
            )

    numbers = dict.fromkeys(("n_tokens", "n_byte_tokens", "ids_crc32", "decoded_crc32"), T.LongType())
    return docs.select(key, text).mapInArrow(run, fields_of(docs, key, **numbers, round_trip=T.BooleanType()))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_model())
