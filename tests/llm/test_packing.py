import struct
import zlib
from collections import defaultdict

import pytest

from geoloom.llm import packing

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

ODD = [
    None, "", " ", "a", " lead", "trail ", "two  spaces", "tab\tin", "line\n\nfeeds\n", "it's we'll I'D", "123 4 5x", "日本語 テキスト", "😀 ok", "a b c", "x　y z",
    "<|endoftext|> as text", "a<|endoftext|>b", "two <|endoftext|><|endoftext|> in a row", " <|endoftext|> ", "<|endoftext", "end .", "\n", "a \n b", "é" * 50, "word " * 3000 + "end",
]


def expected(text):
    t = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    return t.encode(text or "", add_special_tokens=False).ids + [0]


def test_ids_are_the_tokenizers(prose):
    e = packing.Encoder(packing.default_tokenizer())
    for text in [*ODD, prose(1, 500), prose(2, 500)]:
        ids = e.ids(text or "")
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) + [0] == expected(text), text


def test_every_id_in_one_piece(spark, docs_of, prose, monkeypatch):
    monkeypatch.setattr(packing, "OPEN_WINDOWS", 3)
    monkeypatch.setattr(packing, "MERGED_AT_ONCE", 8)
    texts = [*ODD, *(prose(i, 5 + i * 13 % 700) for i in range(150)), "same text", "same text"]
    docs = docs_of(enumerate(texts)).repartition(7)
    out = packing.packed(docs, packing.default_tokenizer(), with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert len(by_doc) == len(texts)
    for i, rows in by_doc.items():
        rows.sort(key=lambda r: r.start)
        ids = b"".join(r.ids for r in rows)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == expected(texts[i])
        assert [r.start for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))]
        assert {r.doc_tokens for r in rows} == {len(ids) // 4}
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))]
        assert sum(r.length for r in rows) <= 1024
    fill = sum(r.length for r in out) / (1024 * len(by_sequence))
    assert fill > 0.9


def test_empty_table(docs_of):
    assert packing.packed(docs_of([]).limit(0), packing.default_tokenizer()).count() == 0


def test_best_fit_and_fullest_out():
    w = packing.Windows(10, 2, 0)
    assert w.place(6) == (0, 0) and w.place(7) == (1, 0)
    assert w.place(3) == (1, 7)  # fills window 1, which closes
    assert w.place(5) == (2, 0) and w.place(4) == (0, 6)
    assert w.place(6) == (3, 0)


def test_the_query_on_the_given_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    t = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in packing.op7_packing(spark, sf_dir).collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, rows in by_doc.items():
        ids = t.encode(texts[i] or "", add_special_tokens=False).ids + [0]
        rows.sort(key=lambda r: r.start)
        assert [r.start for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))]
        for r in rows:
            part = ids[r.start : r.start + r.length]
            assert len(part) == r.length > 0 and zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r.ids_crc32 and r.doc_tokens == len(ids)
        assert sum(r.length for r in rows) == len(ids)
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))] and sum(r.length for r in rows) <= 1024
