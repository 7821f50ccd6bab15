import re

from geoloom.llm import licenses


def brute(text):
    words = licenses.template_words(text or "")
    grams = list(zip(words, words[1:]))
    found = []
    for name, notice in licenses.TEMPLATES:
        t = licenses.template_words(notice)
        other = set(zip(t, t[1:]))
        best = 0
        for i, gram in enumerate(grams):
            if gram in other:
                run = set(grams[i : i + len(t) - 1])
                best = max(best, 2 * len(run & other) / (len(run) + len(other)))
        if best >= licenses.THRESHOLD:
            found.append((-best, name))
    return len(found), min(found, default=(None, None))


def texts_of(prose):
    notices = [notice for _, notice in licenses.TEMPLATES]
    mit = dict(licenses.TEXTS)["MIT"]
    words = mit.split()
    comment = "\n".join(f" * {' '.join(words[i : i + 7])}" for i in range(0, len(words), 7))
    changed = " ".join("other" if i % 25 == 0 else w for i, w in enumerate(words))
    broken = " ".join("other" if i % 6 == 0 else w for i, w in enumerate(words))
    return [
        None, "", "\n\n", "license", *notices, "\n".join(notices), "LICENSED under the apache license version 2.0", "Licensed under the Apache License",
        "This work is licensed under the GNU General Public License, version 4.", prose(1, 5000), prose(2, 50) + "\nReleased under the MIT License.\n" + prose(3, 10),
        "Released under the MIT License. " * 20, re.sub(" ", "  ", notices[0]), "Use of this source code is governed by a\nBSD-style license that can be\nfound in the LICENSE file.",
        "/*\n" + comment + "\n */\n" + prose(4, 300), prose(5, 300) + changed + prose(6, 3000), prose(7, 20) + broken, mit.upper(), mit[: len(mit) // 2],
    ]


def test_matches_brute_force(docs_of, prose):
    texts = texts_of(prose)
    rows = licenses.scanned(docs_of(enumerate(texts))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, (score, name) = brute(texts[r.doc_id])
        assert (r.n_templates, r.license) == (n, name), texts[r.doc_id]
        assert (r.dice is None) if score is None else abs(r.dice + score) < 1e-8
    found = {r.doc_id: r.license for r in rows}
    assert [found[len(texts) - k] for k in (6, 5, 4, 3, 2, 1)] == ["BSD-3-Clause", "MIT", "MIT", None, "MIT", None]
    assert licenses.scanned(docs_of([]).limit(0)).count() == 0


def test_repeated_rows_and_clashing_columns(spark, docs_of):
    text = "Released under the MIT License."
    rows = licenses.scanned(docs_of([(1, text), (1, text), (None, text)])).collect()
    assert sorted((str(r.doc_id), r.license) for r in rows) == [("1", "MIT"), ("1", "MIT"), ("None", "MIT")]
    docs = spark.createDataFrame([(1, text, "a", "b", 2.0, "c")], "doc_id long, text string, license string, grams string, dice double, _words string")
    out = licenses.scanned(docs)
    assert out.columns == ["doc_id", "n_templates", "license", "dice"] and out.first().license == "MIT"


def test_templates_from_files(spark, docs_of, tmp_path, prose):
    (tmp_path / "Own-1.0.txt").write_text("You may read this work on Tuesdays\nand at no other time of the week.")
    own = licenses.templates_in(spark, f"file://{tmp_path}")
    rows = licenses.scanned(docs_of([(1, prose(1, 30) + " you may read this work on tuesdays and at no other time of the week"), (2, prose(1, 30))]), templates=own).collect()
    assert {r.doc_id: r.license for r in rows} == {1: "Own-1.0", 2: None}


def test_native_plan(docs_of):
    plan = licenses.scanned(docs_of([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
