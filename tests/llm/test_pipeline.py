import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from geoloom.llm import minhash, packing, quality, suffixes
from test_minhash import brute as near_brute
from test_quality import brute as quality_brute


def test_stages_hand_on_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs
    counts = [rows.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, sf_dir)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(rows.count())
    assert counts[0] > counts[1] > counts[2] == counts[3]
    pieces = corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir)
    assert pieces.select("doc_id").distinct().count() == counts[3]
    whole = corpus_pipeline.run(spark, sf_dir)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, whole.select(columns).collect())) == sorted(map(tuple, pieces.select(columns).collect()))


def test_each_stage_is_its_operator(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = {r.doc_id for r in quality.judged(docs).filter("kept").collect()}
    assert {r.doc_id for r in stages["quality_rules"](spark, docs, sf_dir).collect()} == kept
    one = {r.doc_id for r in minhash.near_duplicates(docs, percent=80).filter("kept").collect()}
    assert {r.doc_id for r in stages["minhash_dedup"](spark, docs, sf_dir).collect()} == one
    gone = {r.doc_id: r.n_bytes - r.n_removed for r in suffixes.cut(docs).collect()}
    for r in stages["suffix_dedup"](spark, docs, sf_dir).collect():
        assert gone[r.doc_id] - 6 * 20 <= len(r.text.encode()) <= gone[r.doc_id]
    total = packing.packed(docs, packing.default_tokenizer()).selectExpr("sum(length)").first()[0]
    assert stages["packing"](spark, docs, sf_dir).selectExpr("sum(length)").first()[0] == total


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def quality_kept(text):
    n, chars, symbols, dup_lines, repeats = quality_brute(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    values = {
        "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_lines": len(lines),
        "n_stop_words": sum(w in quality.STOP_WORDS for w in words),
    }
    ratios = [(r, values[r.numerator] / max(1, values[r.denominator])) for r in quality.RULES]
    good = all((r.low is None or x >= r.low) and (r.high is None or x <= r.high) for r, x in ratios)
    return not (n < 50 or 100 * repeats > 50 * n) and good


def without_repeats(rows, length=100):
    """Texts without the bytes of windows that stand earlier; characters cut in two go whole."""
    seen, out = set(), {}
    for i, text in sorted(rows.items()):
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            window = raw[p : p + length]
            gone[p : p + length] |= window in seen
            seen.add(window)
        out[i] = bytes(np.frombuffer(raw, np.uint8)[~gone]).decode("utf-8", "ignore")
    return out


def test_the_pipeline_against_brute_force(spark, sf_dir):
    """Every stage worked out anew in plain Python, from the table to the tokens."""
    tokenizers = pytest.importorskip("tokenizers")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    good = [(i, t) for i, t in sorted(texts.items()) if quality_kept(t)]
    single = {i for i, n, c in near_brute(good, 80) if i == c or n == 0}
    left = without_repeats({i: t for i, t in good if i in single})
    encoder = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    pieces, fill = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        pieces[r.doc_id].append(r)
        fill[r.sequence_id].append(r)
    assert set(pieces) == set(left) and len(left) < len(good) < len(texts)
    for i, rows in pieces.items():
        ids = np.array(encoder.encode(left[i], add_special_tokens=False).ids + [0], "<u4")
        rows.sort(key=lambda r: r.start)
        assert [r.start for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))] and rows[-1].start + rows[-1].length == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids) for r in rows)
    for rows in fill.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))] and sum(r.length for r in rows) <= 1024


def test_nulls_repeats_and_clashing_names(spark, sf_dir, prose):
    text = lambda seed: "the of and " + prose(seed, 60) + " the is of " + prose(seed + 1, 60)
    rows = [(1, text(1)), (1, text(1)), (None, text(3)), (2, None), (3, ""), (4, text(1) + " end"), (5, text(5) + " the ".join(prose(100 + i, 10) for i in range(300)) + "\u65e5\u672c" * 20), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None, "x", 1.0, True) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, value string, _once double, kept boolean")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "value", "_once", "kept"], name
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "5", "None"]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in pieces.collect()} == {1, 5, None}


def test_near_copies_between_80_and_85(spark, sf_dir, docs_of, prose):
    """Links at four fifths, none below."""
    words = prose(1, 204).split()  # 200 shingles
    near = words[:-19] + prose(2, 19).split()  # 181 of 219
    far = words[:-24] + prose(3, 24).split()  # 176 of 224
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))]
    assert [c for _, _, c in near_brute(rows[:2])] == [1, 2] and [c for _, _, c in near_brute(rows[:2], 80)] == [1, 1]
    kept = corpus_pipeline.near_dedup_stage(spark, docs_of(rows), sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in near_brute(rows, 80)}) == [1, 3]
