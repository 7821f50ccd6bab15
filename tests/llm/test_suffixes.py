import hashlib

import numpy as np
import pyarrow as pa
import pytest

from geoloom.llm import suffixes


def brute(rows, length=100):
    seen, out = {}, []
    order = sorted({(-(2**63) if i is None else i, t or "") for i, t in rows})
    result = {}
    for key, text in order:
        raw = text.encode()
        gone = np.zeros(len(raw) + 1, int)
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = 1
            else:
                seen[w] = (key, p)
        mask = gone[:-1] > 0
        left = bytes(b for b, m in zip(raw, mask) if not m)
        result[(key, text)] = (len(raw), int(mask.sum()), int((np.diff(mask.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest())
    return [result[(-(2**63) if i is None else i, t or "")] for i, t in rows] + out


def rows_of(prose):
    passage, other = prose(1, 60), prose(2, 40)
    rows = [(i, prose(10 + i, 30 + i) + " " + passage[i : i + 180] + " " + prose(200 + i, 20)) for i in range(25)]
    rows += [(100 + i, other + prose(300 + i, 3)) for i in range(10)] + [(150 + i, prose(400 + i, 3) + other) for i in range(10)]
    rows += [(200, passage), (201, passage), (202, passage * 4), (203, "x" * 700), (204, "xy" * 300), (205, "x" * 99), (206, "x" * 100), (207, "日本語テキスト" * 30), (208, "語テキスト日本" * 30)]
    rows += [(300, None), (301, ""), (302, None), (None, passage), (400, prose(5, 3000)), (401, prose(5, 3000)[50:4000] + "!" + prose(5, 3000)[4000:9000]), (500, passage + other), (500, passage + other)]
    return rows


def same(got, rows, prose):
    want = brute(rows)
    for (i, t), w in zip(rows, want, strict=True):
        found = {(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id == i}
        assert w in found, (i, w, found)
    assert len(got) == len(rows)


@pytest.mark.parametrize(("hot", "bucket", "piece"), [(8192, 1 << 20, 4 << 20), (1, 1 << 20, 4 << 20), (8192, 2000, 700)])
def test_spans_match_brute_force(docs_of, prose, monkeypatch, hot, bucket, piece):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(suffixes, "PIECE_BYTES", piece)
    rows = rows_of(prose)
    same(suffixes.cut(docs_of(rows).repartition(5)).collect(), rows, prose)


def test_common_grams_are_dealt_by_context(docs_of, prose, monkeypatch):
    monkeypatch.setattr(suffixes, "SAMPLE", 1.0)
    monkeypatch.setattr(suffixes, "COMMON", 3)
    rows = rows_of(prose)
    docs = docs_of(rows).repartition(5)
    assert suffixes.common_grams(docs.select(suffixes.doc_key(docs.doc_id, docs.text, 0).alias("doc"), "text"), 100)
    same(suffixes.cut(docs).collect(), rows, prose)


def test_repeated_rows_keep_what_stands_once(docs_of, prose):
    def text(seed):
        return "".join(prose(seed + i, 40) + prose(700 + i, 30)[:80] for i in range(6))

    rows = [(1, text(600))] * 2 + [(2, text(650))]
    assert all(w[1] == 0 for w in brute([rows[0], rows[2]]))
    got = suffixes.cut(docs_of(rows).repartition(3)).collect()
    assert sorted((r.doc_id, r.n_removed, r.n_spans) for r in got) == [(1, 0, 0), (1, 0, 0), (2, 0, 0)]


def test_texts_stay_valid_and_columns_stay(docs_of, prose):
    rows = [(1, "日本語テキスト" * 30), (2, "a" + "日本語テキスト" * 30 + "b"), (3, None), (4, prose(1, 10))]
    docs = docs_of(rows)
    out = suffixes.deduplicated(docs)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    got = {r.doc_id: r for r in out.collect()}
    assert got[3].text is None and got[4].text == rows[3][1] and got[2].text[0] == "a" and got[2].text[-1] == "b"
    assert got[2].n_chars == len(got[2].text) and len(got[2].text) < len(rows[1][1])
    assert suffixes.cut(docs.limit(0)).count() == 0


def test_suffix_steps_against_sorting():
    rng = np.random.default_rng(3)
    for size, depth in ((50, 4), (400, 12), (900, 30)):
        text = rng.integers(97, 99, size).astype(np.uint8)
        text = np.concatenate((text, text[: size // 2], np.array([255], np.uint8)))
        order = suffixes.suffix_order(text, depth)
        raw = text.tobytes() * 2
        keys = [raw[i : i + depth] for i in order]
        assert keys == sorted(keys)
        differ = suffixes.equal_groups(text, order, depth)
        assert differ.tolist() == [True] + [a != b for a, b in zip(keys, keys[1:])]


def test_texts_of_one_id_are_kept_apart(docs_of, prose):
    rows = [(None, prose(2000 + i, 60)) for i in range(600)] + [(None, prose(2000 + i, 30)) for i in range(0, 600, 10)]
    key = lambda t: (hashlib.sha256(t.encode()).digest(), t)
    want = brute([(k, t) for k, (_, t) in enumerate(sorted(rows, key=lambda r: key(r[1])))])
    got = suffixes.cut(docs_of(rows).repartition(5)).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want) and any(w[1] for w in want)


def test_a_bucket_is_taken_some_grams_at_a_time(monkeypatch):
    rng = np.random.default_rng(7)
    rows = []  # (gram, id, mark, place, context): 40 grams of 60 contexts each, of one bucket
    for gram in range(40):
        edge = bytes(rng.integers(97, 123, 100, np.uint8))
        tails = [bytes([48 + i]) + bytes(rng.integers(97, 123, 39, np.uint8)) for i in range(30)]
        rows += [(gram, i, 0, (1000 * gram + 40 << 16) | (40 << 8) | 40, edge + tails[i % 30]) for i in range(60)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    schema = pa.schema([("gram", pa.int64()), ("id", pa.int64()), ("mark", pa.int64()), ("place", pa.int64()), ("context", pa.binary())])
    bucket = pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
    sizes, compare = [], suffixes.repeated_windows
    monkeypatch.setattr(suffixes, "repeated_windows", lambda bodies, length: sizes.append(sum(map(len, bodies))) or compare(bodies, length))
    one = 60 * 140  # bytes of a gram's contexts
    results = []
    for most, arrays in ((1, 40), (3 * one, 14), (3 * one + 5, 14), (1 << 30, 1)):
        monkeypatch.setattr(suffixes, "BUCKET_BYTES", most)
        sizes.clear()
        results.append(sorted(suffixes.bucket_spans(100)(bucket).to_pylist(), key=lambda r: tuple(r.values())))
        assert len(sizes) == arrays and max(sizes) <= max(most, one) and sum(sizes) == 40 * one
    # The first text keeps all windows; the next 29 lose the one of the common edge, the rest all of them.
    want = [{"id": i, "mark": 0, "start": 1000 * g, "stop": 1000 * g + (140 if i >= 30 else 100)} for i in range(1, 60) for g in range(40)]
    assert all(r == want for r in results)


def test_anchors_are_sent_by_bytes_of_texts(prose, monkeypatch):
    class Docs:
        def mapInArrow(self, run, schema):
            return run

    texts = [prose(800 + i % 15, 60) for i in range(40)]
    keys = [(i ^ 1 << 63).to_bytes(8, "big") + (1 << 63 | i).to_bytes(8, "big") for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(texts)], names=["doc", "text"])
    longest = max(map(len, texts))
    found = []
    for most in (1 << 30, 4 * longest):
        monkeypatch.setattr(suffixes, "SENT_BYTES", most, raising=False)
        sent = list(suffixes.found_anchors(Docs(), 100, [])(iter([batch])))
        assert all(sum(len(texts[i]) for i in set(part.column("id").to_pylist())) <= most for part in sent)
        found.append(sorted((r["id"], r["mark"], r["place"], r["check"]) for part in sent for r in part.to_pylist()))
    assert found[0] == found[1] and len({r[0] for r in found[0]}) == 40
