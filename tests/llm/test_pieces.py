import functools
import re
import struct
import zlib

import pytest

from geoloom.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")

TEXTS = ["", "  a  b ", "the hewh and", "日本語 text", "😀 x", "a▁b", "\tq\n\nz", " lead", "trail ", "Über die straße", "x" * 300, "no break"]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


@pytest.fixture(scope="module")
def data():
    with open(pieces.default_model(), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def ours(data):
    return pieces.Model(data)


@pytest.fixture(scope="module")
def library(data):
    """The same pieces and scores as a Unigram model of the library."""
    out = b""
    for number, value in pieces.fields(data):
        if number == 2:
            value = varint(3 << 3) + varint(1) + varint(35 << 3) + varint(1)
        out += varint(number << 3 | 2) + varint(len(value)) + value
    return sentencepiece.SentencePieceProcessor(model_proto=out)


@functools.cache
def vocabulary_of(model):
    vocabulary = {p: s for p, s, k in zip(model.pieces, model.scores, model.kinds) if k in (pieces.NORMAL, pieces.USER_DEFINED)}
    return vocabulary, max(map(len, vocabulary))


def best(model, text):
    """The best score over all segmentations, by plain dynamic programming over a dictionary."""
    vocabulary, longest = vocabulary_of(model)
    score = [0.0] + [float("-inf")] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - longest), j):
            if text[i:j] in vocabulary:
                score[j] = max(score[j], score[i] + vocabulary[text[i:j]])
        if text[j - 1] not in vocabulary:
            score[j] = max(score[j], score[j - 1] + model.unknown_score)
    return score[-1]


def score_of(model, ids):
    total, run = 0.0, bytearray()
    for i in ids:
        if model.kinds[i] == pieces.BYTE:
            run.append(int(model.pieces[i][3:5], 16))
        else:
            total += model.scores[i]
    return total + len(run.decode()) * model.unknown_score


def test_best_scores_and_library(ours, library, prose):
    for text in [*TEXTS, prose(1, 8), prose(2, 8)]:
        ids = ours.encode(text)
        marked = "▁" + text.replace(" ", "▁") if text else ""
        assert score_of(ours, ids) == pytest.approx(best(ours, marked), abs=1e-3), text
        for other in library.nbest_encode_as_ids(text, 2)[:1] if text and len(text) < 60 else []:
            assert score_of(ours, ids) >= score_of(ours, other) - 1e-3
        assert ours.decode(ids) == library.decode(ids)


def test_round_trip(ours, prose):
    for text in [*TEXTS, prose(3, 2000)]:
        assert ours.decode(ours.encode(text)) == text.replace("▁", " ")


def test_double_array():
    keys = sorted({bytes([a, b]) for a in range(0, 256, 5) for b in (0, 1, 255)} | {b"a", b"ab", b"abc", b"\xff"})
    trie = pieces.DoubleArray(keys, list(range(len(keys)))).closed()

    def get(key):
        state = 0
        for b in key:
            child = trie.base[state] + b + 1
            if trie.check[child] != state:
                return -1
            state = child
        return trie.value[state]

    assert [get(k) for k in keys] == list(range(len(keys)))
    assert get(b"zz") == get(b"abd") == get(b"\x01") == -1


def test_jobs(spark, docs_of):
    docs = docs_of([*enumerate(TEXTS), (None, "x"), (90, None), (90, None)])
    path = pieces.default_model()
    back = {r.doc_id: r.text for r in pieces.decoded(pieces.encoded(docs, path), path).collect()}
    assert all(back[i] == t.replace("▁", " ") for i, t in enumerate(TEXTS)) and back[90] == ""
    rows = pieces.digests(docs, path).collect()
    assert len(rows) == len(TEXTS) + 3 and sum(not r.round_trip for r in rows) == 1
    assert pieces.digests(docs.limit(0), path).count() == 0


def test_the_query_on_the_given_table(spark, sf_dir, ours):
    """Every distinct part between white-space markers reaches the greatest score that any segmentation has; the query's
    ids are those of the parts in turn, and decode to the text."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = pieces.op2_sentencepiece(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    parts = {}
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = ours.encode(text)
        marked = "▁" + text.replace(" ", "▁") if text else ""
        mine = []
        for part in re.findall("▁+[^▁]*", marked):
            if part not in parts:
                parts[part] = ours.encode(part[1:])
                assert score_of(ours, parts[part]) == pytest.approx(best(ours, part), abs=1e-3), part
            mine += parts[part]
        assert ids == mine
        assert zlib.crc32(struct.pack(f"<{len(ids)}i", *ids)) == r.ids_crc32
        back = ours.decode(ids)
        assert r.decoded_crc32 == zlib.crc32(back.encode()) and r.round_trip == (back == text)
    assert len(parts) > 5000
