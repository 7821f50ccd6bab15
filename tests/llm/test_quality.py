import re
from collections import Counter

from geoloom.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {p for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_match_brute_force(docs_of, prose):
    texts = [
        None, "", "   \n\t ", "one", "a b", "a b c", "a b c a b c", "a a a a a a", "x\ny\nx\n \nx", "é# ü* 日本 < > | & % $", "a b c d a b c x a b c",
        "\x0b\x0cv f\r\nz", "z " * 3000, prose(1, 20_000), prose(2, 300), prose(2, 300), "nb\u00a0sp em\u2003sp",
    ]
    rows = quality.judged(docs_of(enumerate(texts))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id]), r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_filter_keeps_rows_and_columns(docs_of, prose):
    good = "the of and " + prose(3, 40) + " the is of " + prose(4, 40)
    docs = docs_of([(1, good), (2, None), (1, good), (3, "*** " * 80), (None, good)])
    out = quality.filtered(docs)
    assert out.schema == docs.schema
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "1", "None"]
    assert quality.filtered(docs.limit(0)).count() == 0


def test_plan_has_no_python_and_no_shuffle(docs_of, prose):
    plan = quality.judged(docs_of([(1, prose(1, 60))]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_clashing_columns(spark, prose):
    good = "the of and " + prose(3, 40) + " the is of " + prose(4, 40)
    docs = spark.createDataFrame([(1, good, "w", "l", 7, "yes", "c")], "doc_id long, text string, _words string, _lines string, n_words int, kept string, c1 string")
    row = quality.judged(docs).first()
    assert (row.n_words, row.kept, row._words, row.c1) == (86, True, "w", "c")
    assert quality.filtered(docs).collect() == docs.collect() and quality.filtered(docs).schema == docs.schema
