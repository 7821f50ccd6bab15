"""URL filters: a sort-merge range join of reversed-host keys with nested rule intervals, native throughout.

A host `www.example.com` becomes the key `com.example.www.`; a rule for a host and its subdomains covers the keys
that start with its own key, an interval ['com.example.', 'com.example/') because '/' follows '.'. Intervals of
prefixes nest or are disjoint, so a sweep in key order needs only a stack. The stack is kept by window functions:
the depth is a running sum of openings less closings, and the rule at depth d is the last one opened there.

The sweep runs over distinct hosts (a host may hold a third of all urls, yet is one row), range-partitioned; a rule
whose interval crosses a part's border is opened anew in each part it meets. The stacks go back to the urls by an
equi-join on the host, and the path part of a rule is tested on the few rules of the stack.

Defined results: a null url, or one without '://', has empty host and path and no rule; an empty path fits no rule
whose path is '/'; of two rules for the same host and path the blocking one holds; longest means most characters in
host and path together, then the longer host; no rule at all gives the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.llm.common import partitions, saved, table

# The rules of the registered query, (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
STACK = "array<struct<host:string,path:string,verdict:string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules as a DataFrame (verdict, host, path)."""
    if not rules:
        return spark.sql("SELECT '' AS verdict, '' AS host, '' AS path WHERE false")
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS r(verdict, host, path)")


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_stacks(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, stack): for each distinct host the rules whose interval holds its key, outermost first.

    `hosts` has one column `host` without repeats; `rules` has verdict, host, path."""
    spark = hosts.sparkSession
    keyed = hosts.withColumn("key", host_key(F.col("host")))
    parts = saved(
        keyed.repartitionByRange(partitions(spark), "key").withColumn("part", F.spark_partition_id()), "url-hosts"
    )
    by_host = (
        rules.withColumn("key", host_key(F.col("host")))
        .groupBy("key")
        .agg(F.sort_array(F.collect_set(F.struct("host", "path", "verdict"))).alias("here"))
    )
    # One row per part at most: the driver holds as many borders as there are partitions.
    borders = parts.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last")).collect()
    if not borders:
        return hosts.withColumn("stack", F.array().cast(STACK))
    listed = F.array(*[F.struct(F.lit(r["part"]).alias("part"), F.lit(r["first"]).alias("first"), F.lit(r["last"]).alias("last")) for r in borders])
    closing = F.concat(F.col("key").substr(F.lit(1), F.length("key") - 1), F.lit("/"))
    met = by_host.withColumn("end", closing).withColumn(
        "b", F.explode(F.filter(listed, lambda b: (b["last"] >= F.col("key")) & (b["first"] < F.col("end"))))
    )
    # Kinds in order at one key: close, open (outer before inner: shorter keys first), host.
    opened = met.select(
        F.col("b.part").alias("part"), F.greatest("key", "b.first").alias("at"), F.lit(1).alias("kind"),
        F.length("key").alias("depth_key"), "here", F.lit(None).cast("string").alias("host"),
    )
    closed = met.filter(F.col("end") <= F.col("b.last")).select(
        F.col("b.part").alias("part"), F.col("end").alias("at"), F.lit(0).alias("kind"),
        F.length("key").alias("depth_key"), F.lit(None).cast(by_host.schema["here"].dataType).alias("here"), F.lit(None).cast("string").alias("host"),
    )
    points = parts.select(
        "part", F.col("key").alias("at"), F.lit(2).alias("kind"), F.lit(0).alias("depth_key"),
        F.lit(None).cast(by_host.schema["here"].dataType).alias("here"), "host",
    )
    sweep = W.partitionBy("part").orderBy("at", "kind", "depth_key").rowsBetween(W.unboundedPreceding, 0)
    # Depth of nesting is at most the number of labels in a rule's host: a small number from the rules alone.
    deepest = by_host.agg(F.max(F.size(F.split("key", r"\.")))).first()[0] or 0
    swept = opened.unionByName(closed).unionByName(points).withColumn(
        "depth", F.sum(F.when(F.col("kind") == 1, 1).when(F.col("kind") == 0, -1).otherwise(0)).over(sweep)
    )
    levels = [
        F.last(F.when((F.col("kind") == 1) & (F.col("depth") == d), F.col("here")), ignorenulls=True).over(sweep)
        for d in range(1, deepest + 1)
    ]
    if not levels:
        return hosts.withColumn("stack", F.array().cast(STACK))
    stack = F.flatten(F.slice(F.array(*levels), F.lit(1), F.col("depth").cast("int")))
    return swept.withColumn("stack", stack).filter("kind = 2").select("host", "stack")


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """`pages` (all its columns in the struct `row`) with host, path, rule and verdict for each row."""
    host, path = split_url(F.col(url))
    rows = pages.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"))
    stacks = host_stacks(rows.select("host").distinct(), rules)
    fitting = F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"]))
    ranked = F.transform(
        fitting,
        lambda r: F.struct(
            (F.length(r["host"]) + F.length(r["path"])).alias("n"), F.length(r["host"]).alias("m"),
            r["verdict"].alias("verdict"), F.concat(r["host"], r["path"]).alias("rule"),
        ),
    )
    return rows.join(stacks, "host").select(
        "row", "host", "path", F.array_max(ranked).alias("best")
    ).select("row", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, rule_table(spark)).select("row.page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rhost, rpath) AS (VALUES {rules}),
m AS (SELECT h.page_id, rhost || rpath AS rule, verdict FROM h JOIN r
        ON (h.host = rhost OR ends_with(h.host, '.' || rhost)) AND starts_with(h.path, rpath)
     QUALIFY row_number() OVER (PARTITION BY h.page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, verdict DESC) = 1)
SELECT h.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)"""
