"""Quality rules: a threshold table compiled into one projection, without user functions.

Words are maximal runs of `[^\\x20\\x09-\\x0D]`. Repeats are found per row: each 3-word window becomes one
long (its hash above, its position below), the row's longs are sorted as primitives, and equal neighbours
give the positions. No shuffle, no Python, memory bounded by one text.

Defined results: a null or blank text has no words, all counts are 0 and it fails the base rule; repeated rows
and repeated ids are judged one by one; other columns are passed through, and one with the name of a result gives way
to it (`filtered` adds none, so there all stay). The hash that stands for
a window keeps 64 - log2(n_words) bits, so two different windows of one text are taken for equal with a
probability under n_words**3 / 2**65 (2e-12 for 400 words, 2e-7 for 20,000).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import table

WORD_GAP = r"[\x20\x09-\x0D]+"

# Common function words of the four languages of the corpora.
STOP_WORDS = (
    "the of and to in is that it for was on with as be at by this are he an or of "
    "der die das und ist nicht von zu den mit für auf ein eine im dem des sich als auch "
    "le la les de des et un une est en que qui dans pour pas par sur au il elle "
    "el los las del y una que con por para se su no es lo como al"
).split()


@dataclass(frozen=True)
class Rule:
    """A ratio must lie in [low, high]; either bound may be None."""

    name: str
    numerator: str
    denominator: str
    low: float | None
    high: float | None


#: The method's verdict. Only texts that pass the base rule reach it.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 16.0),
    Rule("symbols_to_words", "n_symbols", "n_words", None, 0.30),
    Rule("stop_words", "n_stop_words", "n_words", 0.04, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.50),
)


def compiled(rules=RULES) -> Column:
    """All thresholds as one boolean expression."""
    verdict = F.lit(True)
    for rule in rules:
        ratio = F.col(rule.numerator).cast("double") / F.greatest(F.col(rule.denominator), F.lit(1))
        if rule.low is not None:
            verdict = verdict & (ratio >= rule.low)
        if rule.high is not None:
            verdict = verdict & (ratio <= rule.high)
    return verdict


def with_repeat_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds `out`: words inside a 3-word window that occurs at least twice in the array column `words`.

    Each step is a column of its own, so that the sorts run on primitive longs in generated code and the position
    width is worked out once a row."""
    n, bits, s = F.size(words), F.col("_bits"), F.col("_sorted")
    steps = df.withColumn(
        "_bits", F.when(n >= 4, F.greatest(F.lit(1), F.ceil(F.log2(n.cast("double")))).cast("int"))
    ).withColumn(
        "_sorted",
        F.sort_array(
            F.transform(
                F.when(n >= 4, F.slice(words, 1, n - 2)),
                lambda w, i: F.call_function(
                    "shiftleft", F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)), bits
                ).bitwiseOR(i.cast("long")),
            )
        ),
    )
    gram = lambda packed: F.call_function("shiftright", packed, bits)
    # Of sorted longs, the later of two equal neighbours; the first of each group follows from these.
    steps = steps.withColumn("_grams", F.transform(s, gram)).withColumn(
        "_later", F.filter(F.col("_grams"), lambda g, j: F.coalesce(g == F.get("_grams", j - 1), F.lit(False)))
    )
    steps = steps.withColumn(
        "_at",
        F.when(
            F.size("_later") > 0,
            F.sort_array(
                F.transform(
                    F.filter(
                        s,
                        lambda x, j: F.coalesce(F.get("_grams", j) == F.get("_grams", j - 1), F.lit(False))
                        | F.coalesce(F.get("_grams", j) == F.get("_grams", j + 1), F.lit(False)),
                    ),
                    lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1),
                )
            ),
        ),
    )
    covered = F.aggregate(
        F.transform(F.col("_at"), lambda p, j: F.least(F.coalesce(F.get("_at", j + 1) - p, F.lit(3)), F.lit(3))),
        F.lit(0).cast("long"),
        lambda total, gap: total + gap,
    )
    return steps.withColumn(out, F.coalesce(covered, F.lit(0).cast("long"))).drop("_bits", "_sorted", "_grams", "_later", "_at")


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words and n_lines."""
    body = F.coalesce(F.col(text), F.lit(""))
    has_word = lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))
    first = df.withColumn("_words", F.array_remove(F.split(body, WORD_GAP), "")).withColumn(
        "_lines", F.filter(F.split(body, "\n"), has_word)
    )
    return (
        with_repeat_words(first, "_words", "n_repeat_words")
        .withColumns(
            {
                "n_words": F.size("_words").cast("long"),
                "word_chars": F.aggregate(F.col("_words"), F.lit(0).cast("long"), lambda t, w: t + F.length(w)),
                "n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                "n_stop_words": F.size(F.filter(F.col("_words"), lambda w: w.isin(*STOP_WORDS))).cast("long"),
                "n_lines": F.size("_lines").cast("long"),
            }
        )
        .drop("_words", "_lines")
    )


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "base_failed", "kept")


def numbered(df: DataFrame, text: str, rules) -> DataFrame:
    """The columns of `df` as c0, c1, ..., which no working column is called, with the results.

    The row number in `kept` changes nothing in it, but keeps the optimiser from copying a filter's expression down
    through the steps of the repeat count, where each copy would be worked out anew (and doubles at every step)."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~F.col("base_failed") & compiled(rules) & (F.monotonically_increasing_id() >= 0)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return measured(plain, f"c{df.columns.index(text)}").withColumn("base_failed", failed).withColumn("kept", kept)


def judged(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Counts, base_failed and kept for every row, behind its other columns."""
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns) if c not in RESULTS]
    return numbered(df, text, rules).select(*own, *RESULTS)


def filtered(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows that are kept, with the columns of `docs`."""
    own = [F.col(f"c{i}").alias(c, metadata=docs.schema[c].metadata) for i, c in enumerate(docs.columns)]
    return numbered(docs, text, rules).filter("kept").select(*own)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def oracle() -> str:
    """The same counts by sets of windows instead of sorted positions."""
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    bounds = []
    for r in RULES:
        ratio = f"{r.numerator}::double / greatest({r.denominator}, 1)"
        bounds += [f"{ratio} >= {r.low}"] if r.low is not None else []
        bounds += [f"{ratio} <= {r.high}"] if r.high is not None else []
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
       list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
       list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
h AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) >= 2),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h) GROUP BY doc_id),
c AS (SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint AS word_chars,
       len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint AS n_symbols, (len(l) - len(list_distinct(l)))::bigint AS n_dup_lines,
       coalesce(r.n, 0)::bigint AS n_repeat_words, len(list_filter(w, lambda x: x IN ({stops})))::bigint AS n_stop_words, len(l)::bigint AS n_lines
  FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(bounds)} AS kept FROM b"""
