"""License scans: normalised texts compared with licence templates by the Dice coefficient over word bigrams, native.

A whole text is normalised (lower case, other than letters, digits and dots become blanks; lines do not matter) and
set against each template of m words: every run of m words that starts with one of the template's bigrams (shorter at
the text's end) is compared by its distinct bigrams. Templates are one-line notices and whole licences alike.

Two sets of a and b bigrams can reach the coefficient t only if a lies between b*t/(2-t) and b*(2-t)/t, so a run
outside these bounds is not compared; and a run that reaches t holds at least t/(2-t) of the template's bigrams, so a
template is a candidate only for texts that hold so many anywhere. Texts without any word that a match must hold are
passed over before that. One projection, no shuffle.

Defined results: a null or blank text has no match; a text of one word has no bigram and no match; of equal scores the
template that comes first by name is taken; repeated rows are judged one by one; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import table
from geoloom.llm.license_texts import NOTICES, TEXTS

THRESHOLD = 0.8
#: (license, text); a license may have several.
TEMPLATES = [*NOTICES.items(), *TEXTS.items()]


def templates_in(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """Templates from files, each named by its file; as many as there are licences."""
    files = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value")
    return sorted((r["name"].rsplit(".", 1)[0] if r["name"].endswith((".txt", ".md")) else r["name"], r["value"]) for r in files.collect())


def template_words(notice: str) -> list[str]:
    cleaned = re.sub(r"[^a-z0-9.]+", " ", notice.lower())
    return [w for w in (x.strip(".") for x in cleaned.split(" ")) if w]


def bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def text_words(lowered: Column) -> Column:
    cleaned = F.regexp_replace(lowered, r"[^a-z0-9.]+", " ")
    return F.array_remove(F.transform(F.split(cleaned, " "), lambda w: F.btrim(w, F.lit("."))), "")


def least_shared(n: int, threshold: float) -> int:
    """Bigrams of a template of n that a run at the threshold holds at least: with s shared and a in the run,
    2s >= t(a + n) and a >= s give s >= tn / (2 - t)."""
    return max(1, -int(-n * threshold // (2 - threshold) + 1e-9))


def hints(grams: list[list[str]], threshold: float) -> list[str]:
    """Words of which a text with a match holds at least one: a match lacks so few of a template's bigrams that one of
    those with these words is left. Few words do, as those that most bigrams of most templates hold are taken first;
    short ones, which stand in any text, only where nothing else is left."""
    spare = [len(g) - least_shared(len(g), threshold) for g in grams]
    holders = [{w: {x for x in g if w in x.split(" ")} for x in g for w in x.split(" ")} for g in grams]
    covered: list[set[str]] = [set() for _ in grams]
    words: set[str] = set()
    # Long words first, then numbers, then the others by length.
    rank = lambda w: 0 if len(w) >= 7 else 1 if any(c.isdigit() for c in w) else 9 - len(w)
    while open_ := [i for i in range(len(grams)) if len(covered[i]) <= spare[i]]:
        gains: dict[str, int] = {}
        for i in open_:
            for w, held in holders[i].items():
                gains[w] = gains.get(w, 0) + min(len(held - covered[i]), spare[i] + 1 - len(covered[i]))
        best = min((w for w in gains if gains[w]), key=lambda w: (rank(w), -gains[w], w))
        words.add(best)
        for i in open_:
            covered[i] |= holders[i].get(best, set())
    return sorted(words)


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_templates, license, dice) for every row: how many templates reach the threshold, and the best match."""
    wanted = [(name, template_words(notice)) for name, notice in (TEMPLATES if templates is None else templates)]
    wanted = sorted((name, len(words), bigrams(words)) for name, words in wanted if len(words) > 1)
    match = "struct<dice:double,license:string>"
    if not wanted:
        return docs.select(key, F.lit(0).cast("long").alias("n_templates"), F.lit(None).cast("string").alias("license"), F.lit(None).cast("double").alias("dice"))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    all_grams = sorted({x for _, _, g in wanted for x in g})
    table_of = F.array(
        *[
            F.struct(F.lit(name).alias("license"), F.lit(m).alias("words"), F.lit(least_shared(len(g), threshold)).alias("need"), F.array(*map(F.lit, g)).alias("grams"))
            for name, m, g in wanted
        ]
    )

    def best_run(t: Column) -> Column:
        """The best coefficient of a run with template t."""
        n = F.size(t["grams"])

        def dice(at: Column) -> Column:
            run = F.array_distinct(F.slice("grams", at + 1, t["words"] - 1))
            fits = F.size(run).between(F.ceil(n * low - 1e-9), F.floor(n * high + 1e-9))
            return F.when(fits, 2.0 * F.size(F.array_intersect(run, t["grams"])) / (F.size(run) + n))

        starts = F.filter(F.sequence(F.lit(0), F.size("grams") - 1), lambda i: F.array_contains(t["grams"], F.get("grams", i)))
        return F.struct(F.array_max(F.transform(starts, dice)).alias("dice"), t["license"].alias("license"))

    hinted = F.lit(False)
    for word in hints([g for _, _, g in wanted], threshold):
        hinted = hinted | F.contains(F.col("_text"), F.lit(word))
    none = F.array().cast("array<string>")
    lowered = docs.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    words = lowered.select(key, F.when(hinted, text_words(F.col("_text"))).otherwise(none).alias("_words"))
    grams = words.select(key, F.transform(F.slice("_words", 1, F.greatest(F.size("_words") - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get("_words", i + 1))).alias("grams"))
    held = grams.select(key, "grams", F.array_distinct(F.filter("grams", lambda g: g.isin(*all_grams))).alias("held"))
    candidates = F.filter(table_of, lambda t: F.size(F.array_intersect("held", t["grams"])) >= t["need"])
    few = F.size("held") < min(least_shared(len(g), threshold) for _, _, g in wanted)
    matches = F.when(few, F.array().cast(f"array<{match}>")).otherwise(F.filter(F.transform(candidates, best_run), lambda x: x["dice"] >= threshold))
    found = held.select(key, matches.alias("matches"))
    # The largest coefficient; of equals the first by name.
    top = F.element_at(F.array_sort(F.transform("matches", lambda x: F.struct((-x["dice"]).alias("d"), x["license"].alias("license")))), 1)
    best = F.when(F.size("matches") > 0, top)
    return found.select(key, F.size("matches").cast("long").alias("n_templates"), best["license"].alias("license"), F.round(-best["d"], 9).alias("dice"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same runs of words, without the filters before them."""
    texts = [(name, template_words(text)) for name, text in TEMPLATES]
    rows = ", ".join(f"({i}, '{name}', {len(words)}, [{', '.join(map(repr, bigrams(words)))}])" for i, (name, words) in enumerate(texts))
    low, high = THRESHOLD / (2 - THRESHOLD), (2 - THRESHOLD) / THRESHOLD
    return f"""
WITH t(id, license, m, g) AS (VALUES {rows}),
w AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9.]+', ' ', 'g'), ' '), lambda w: trim(w, '.')), lambda w: w <> '') AS w FROM documents),
b AS (SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS b FROM w WHERE len(w) > 1),
p AS (SELECT doc_id, unnest(b) AS gram, unnest(range(1, len(b) + 1)) AS place FROM b),
s AS (SELECT doc_id, place, id, license, m, g FROM p JOIN (SELECT id, license, m, g, unnest(g) AS gram FROM t) USING (gram)),
r AS (SELECT doc_id, id, license, g, list_distinct(b[place:place + m - 2]) AS h FROM s JOIN b USING (doc_id)),
d AS (SELECT doc_id, id, license, 2.0 * len(list_intersect(h, g)) / (len(h) + len(g)) AS dice FROM r WHERE len(h) BETWEEN len(g) * {low} - 1e-9 AND len(g) * {high} + 1e-9),
x AS (SELECT doc_id, id, license, max(dice) AS dice FROM d GROUP BY doc_id, id, license HAVING max(dice) >= {THRESHOLD}),
a AS (SELECT doc_id, count(*) AS n, arg_min(license, struct_pack(d := -dice, l := license)) AS license, max(dice) AS dice FROM x GROUP BY doc_id)
SELECT d.doc_id, coalesce(a.n, 0)::bigint AS n_templates, a.license, round(a.dice, 9) AS dice FROM documents d LEFT JOIN a USING (doc_id)"""
