"""Mixing sources to target weights, with DataFrame functions alone.

A document's key is a 60-bit hash of its id and size. The words of each source are summed by the key's first 12 bits; the
histogram gives sizes, sizes give targets, and a target is some whole copies of the source and a rest. The rest takes
documents from the smallest key up: whole buckets as long as they fit, then only the bucket in which the rest ends is
looked at again, by the next 12 bits, until at most REFINED documents are left in it. Of these, and of the buckets behind
it up to that number, each document is taken that still fits. A document's copies then follow from its key and its
source's thresholds, without a sort. Rows that agree in id and size share a key; they are told apart by their place in
the table written down, and as they are alike, it does not matter which of them are taken.

Targets: sources in code point order, null last, weigh 1, 2, 3 and so on again, and share all words; no target is above
3 times its source's words, what is above is shared out again by weight.

Defined results: a null or blank text has size 0 and is taken with 0 words; a source without words has target 0;
repeated rows are documents of their own; no documents give no rows; other columns are ignored. Several words that share
a hot source are pre-aggregated, and the source's thresholds meet its documents in as many parts as there are partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.llm.common import Work, numbered, partitions, table
from geoloom.llm.sharding import with_running_sum

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = 3
MOST_COPIES = 3
#: Documents of a source that are looked at one by one.
REFINED = 256
BITS = 12
#: What is cut at each step: the key's bits from the top, then those of the row's place.
LEVELS = (*(("key", s) for s in (48, 36, 24, 12, 0)), *(("place", s) for s in (52, 40, 28, 16, 4, 0)))
SOURCE = ("no_source", "source_text")
ALL = 2**63 - 1


def narrow(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(doc_id, source, no_source, source_text, size, key)."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size.alias("size"))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("size").cast("string")))
    return rows.withColumns(
        {"no_source": F.col("source").isNull(), "source_text": F.coalesce(F.col("source"), F.lit("")), "key": F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")}
    )


def histogram(rows: DataFrame, column: str, shift: int) -> DataFrame:
    return rows.groupBy(*SOURCE, F.shiftright(column, shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))


def water_levels(sizes: DataFrame) -> DataFrame:
    """`sizes` (number, size) with `target`: weights by number share all words, no target above MOST_COPIES sizes.

    Each round fixes the sources above their bound; only sums reach the driver."""
    rows = sizes.withColumns({"weight": (F.col("number") - 1) % WEIGHTS + 1, "bound": F.col("size") * MOST_COPIES})
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    level, known = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > F.col("bound")
        fixed, given, weights = rows.agg(
            F.coalesce(F.sum(over.cast("long")), F.lit(0)), F.coalesce(F.sum(F.when(over, F.col("bound"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))
        ).first()
        if fixed == known or weights == 0:
            break
        level, known = float(total - given) / float(weights), fixed
    return rows.withColumn("target", F.when(over, F.col("bound").cast("double")).otherwise(F.col("weight") * F.lit(level))).drop("weight", "bound")


def salted(rows: DataFrame, states: DataFrame) -> DataFrame:
    """Each row with its source's state; the states are copied so that a hot source's rows meet them in many tasks."""
    parts = partitions(rows.sparkSession)
    copies = states.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("place"), F.lit(parts)).cast("int")).join(copies, [*SOURCE, "salt"]).drop("salt")


def inside() -> Column:
    return F.col("key").between(F.col("key_from"), F.col("key_to")) & F.col("place").between(F.col("place_from"), F.col("place_to"))


def refined(states: DataFrame, counts: DataFrame, column: str, shift: int) -> DataFrame:
    """Open states one level further: the bucket in which the rest ends, or the few documents from it on."""
    by = W.partitionBy(*SOURCE).orderBy("bucket")
    before = F.coalesce(F.sum("words").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    met = states.drop("n").join(counts.withColumn("before", before), list(SOURCE)).filter(F.col("before") + F.col("words") > F.col("rest"))
    # From the bucket in which the rest ends: the buckets behind it while they hold few documents.
    seen = F.sum("n").over(by.rowsBetween(W.unboundedPreceding, 0))
    ends = met.withColumns({"first": F.min("bucket").over(W.partitionBy(*SOURCE)), "seen": seen}).filter((F.col("bucket") == F.col("first")) | (F.col("seen") <= REFINED))
    keep = [c for c in states.columns if c not in ("rest", "n")]
    cut = ends.groupBy(*keep).agg(F.min("first").alias("first"), F.max("bucket").alias("last"), F.min("rest").alias("rest"), F.min("before").alias("before"), F.max("seen").alias("n"))
    low, high = F.shiftleft(F.col("first"), shift), F.shiftleft(F.col("last") + 1, shift) - 1
    at = {f"{column}_from": F.greatest(low, F.col(f"{column}_from")), f"{column}_to": F.least(high, F.col(f"{column}_to"))}
    return cut.withColumns({**at, "rest": F.col("rest") - F.col("before")}).select(states.columns)


def chosen(rows: DataFrame, states: DataFrame) -> DataFrame:
    """`states` with `taken`: the places of the documents, of the few left, that still fit, by key."""
    few = salted(rows, states.select(*SOURCE, "rest", "key_from", "key_to", "place_from", "place_to")).filter(inside())
    lists = few.groupBy(*SOURCE).agg(F.array_sort(F.collect_list(F.struct("key", "place", "size"))).alias("few"))  # REFINED a source
    start = F.struct(F.col("rest").alias("rest"), F.expr("cast(array() as array<bigint>)").alias("taken"))
    step = lambda acc, d: F.when(
        d["size"] <= acc["rest"], F.struct((acc["rest"] - d["size"]).alias("rest"), F.concat(acc["taken"], F.array(d["place"])).alias("taken"))
    ).otherwise(acc)
    picked = states.join(lists, list(SOURCE), "left").withColumn("picked", F.when(F.col("few").isNotNull(), F.aggregate("few", start, step)))
    return picked.withColumn("taken", F.coalesce("picked.taken", F.expr("cast(array() as array<bigint>)"))).drop("few", "picked")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) for every row of `docs`."""
    work = Work(docs.sparkSession, "mixing")
    at = F.monotonically_increasing_id()
    rows = work.saved(narrow(docs, key, text, source).withColumn("place", at), "rows")
    counts = work.saved(histogram(rows, *LEVELS[0]), "counts")
    sizes = counts.groupBy(*SOURCE).agg(F.sum("words").alias("size"))
    ranked = with_running_sum(numbered(sizes, list(SOURCE), "mixing-sources"), "size").select(*SOURCE, "number", "size")
    levels = water_levels(ranked).withColumnRenamed("size", "source_size").withColumn("budget", F.round("target").cast("long"))
    copies = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0).cast("long"))
    targets = work.saved(levels.withColumn("copies", copies).withColumn("rest", F.col("budget") - F.col("copies") * F.col("source_size")), "targets")
    bounds = {"key_from": 0, "key_to": ALL, "place_from": 0, "place_to": ALL, "n": ALL}
    states = targets.filter("rest > 0").select(*SOURCE, "rest", *[F.lit(v).cast("long").alias(k) for k, v in bounds.items()])
    done = None
    for column, shift in LEVELS:
        counts = counts if done is None else histogram(salted(rows, states).filter(inside()), column, shift)
        states = work.saved(refined(states, counts, column, shift), "states")
        small = states.filter(F.col("n") <= REFINED)
        done = small if done is None else done.unionByName(small)
        states = states.filter(F.col("n") > REFINED)
        if states.isEmpty():
            break
    ends = work.saved(chosen(rows, done), "ends").select(*SOURCE, "key_from", "place_from", "taken")
    thresholds = targets.select(*SOURCE, "source_size", "target", "copies").join(ends, list(SOURCE), "left")
    below = (F.col("key") < F.col("key_from")) | ((F.col("key") == F.col("key_from")) & (F.col("place") < F.col("place_from")))
    more = F.coalesce(below | F.array_contains("taken", F.col("place")), F.lit(False)).cast("long")
    return salted(rows, thresholds).select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("copies") + more)).alias("taken"), "source")


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """For sources of which no bucket holds more than REFINED documents, as in the given tables."""
    return f"""WITH RECURSIVE sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint AS size FROM documents),
  kinds AS (SELECT source, sum(size)::bigint AS total, row_number() OVER (ORDER BY source IS NULL, source) AS number FROM sized GROUP BY source),
  weighed AS (SELECT *, (number - 1) % 3 + 1 AS weight, row_number() OVER (ORDER BY 3.0::double * total / ((number - 1) % 3 + 1), number) AS k FROM kinds),
  steps AS (SELECT k, weight, total, ((SELECT sum(total) FROM kinds) - coalesce(sum(3 * total) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::double
    / (sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::double AS level FROM weighed),
  levels AS (SELECT level FROM steps WHERE weight * level <= 3 * total ORDER BY k LIMIT 1),
  aimed AS (SELECT source, number, total, CASE WHEN weight * level > 3 * total THEN (3 * total)::double ELSE weight * level END AS target FROM weighed, levels),
  targets AS (SELECT *, CASE WHEN total > 0 THEN round(target)::bigint // total ELSE 0 END AS copies, CASE WHEN total > 0 THEN round(target)::bigint % total ELSE 0 END AS rest FROM aimed),
  keyed AS (SELECT s.*, number, ('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':' || size), 1, 15))::bigint AS key, row_number() OVER () AS place FROM sized s JOIN kinds k ON s.source IS NOT DISTINCT FROM k.source),
  buckets AS (SELECT number, key >> 48 AS bucket, sum(size) AS words, count(*) AS n FROM keyed GROUP BY ALL),
  reached AS (SELECT b.*, rest FROM (SELECT *, sum(words) OVER (PARTITION BY number ORDER BY bucket) AS upto FROM buckets) b JOIN targets t USING (number) WHERE rest > 0 AND upto > rest),
  seen AS (SELECT *, min(bucket) OVER (PARTITION BY number) AS first, sum(n) OVER (PARTITION BY number ORDER BY bucket) AS so_far, rest - (min(upto - words) OVER (PARTITION BY number)) AS open FROM reached),
  ends AS (SELECT number, first, max(bucket) AS last, min(open)::bigint AS open FROM seen WHERE bucket = first OR so_far <= {REFINED} GROUP BY number, first),
  few AS (SELECT number, place, size, open, row_number() OVER (PARTITION BY number ORDER BY key, place) AS i FROM keyed JOIN ends USING (number) WHERE key >> 48 BETWEEN first AND last),
  fitted AS (SELECT number, i, place, size <= open AS got, open - CASE WHEN size <= open THEN size ELSE 0 END AS open FROM few WHERE i = 1
    UNION ALL SELECT f.number, f.i, f.place, f.size <= p.open, p.open - CASE WHEN f.size <= p.open THEN f.size ELSE 0 END FROM fitted p JOIN few f ON f.number = p.number AND f.i = p.i + 1)
  SELECT doc_id, size, t.total AS source_size, target, (size * (copies + CASE WHEN coalesce(key >> 48 < first, false) OR coalesce(got, false) THEN 1 ELSE 0 END))::bigint AS taken, k.source
  FROM keyed k JOIN targets t USING (number) LEFT JOIN ends USING (number) LEFT JOIN (SELECT place, got FROM fitted) USING (place)"""
