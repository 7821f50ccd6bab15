"""Ranked lexical search over a length-stratified index.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lowered. Documents are taken in segments
of bounded size; in a segment, documents with equal length normaliser m are one stratum, and a term's postings lie by
stratum and, within it, by frequency, highest first. A run of postings with one term, stratum and frequency has one
impact, worked out once; the head of a term's runs in a stratum bounds all of them. A search adds the bounds of the
item's terms for each stratum, visits strata from the highest bound down, and ends where the bound falls below the score
of the last document kept. The postings' weights are exact integers, sums below 2**53 are exact in float64.

Counts of documents and terms take one pass over the texts without user functions, the index a second one. It is
written down, a row for each term of a segment and one for the segment's documents; document frequencies are sums over
it, and only rows of asked terms are read for a search. Items are held in groups of bounded size, segments stream past
each group (`grid.dealt`); what a task has found for an item so far ends its visits in later segments too.

Defined results: every row is a document, repeated rows and ids too (among rows with one id and score the order is
open, as they cannot be told apart); null and blank texts have no terms; a null doc_id comes before all others; rows of
one item_id are one item with the terms of all their texts; items without known terms give no rows; no documents or no
items give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.llm.common import MIN_LONG, Work, arrow_slices, partitions, table
from geoloom.llm.grid import dealt, group_of

#: ASCII other than letters and digits, one by one: a class of single characters is one look-up in Java's patterns.
SEPARATORS = [b for b in range(128) if not chr(b).isalnum()]
TERM = "[^" + "".join(f"\\x{b:02X}" for b in SEPARATORS) + "]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text in a segment, of an Arrow slice, and of items that one task holds.
SEGMENT_BYTES, SLICE_BYTES, GROUP_BYTES = 16 << 20, 4 << 20, 8 << 20
#: Strata that a search visits first; each further step takes twice as many.
FIRST_VISIT = 16
BEST = 10
#: Terms of one item up to which sums of float64 are exact.
EXACT_TERMS = 100_000

#: A term's runs (stratum, tf, number of documents) and their documents, by place in `doc_ids`; or, with a null term,
#: the segment's documents and its strata's normalisers.
INDEX = "segment long, term string, df int, strata array<int>, tfs array<int>, lengths array<int>, docs array<int>, doc_ids array<long>, ms array<long>"


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def totals(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(documents with a term, terms of all documents)."""
    n = F.regexp_count(F.col(text), F.lit(TERM)).cast("long")
    r = docs.select(n.alias("n")).filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return r[0], r[1]


def _separators() -> bytes:
    """A byte table: terms' bytes lowered, all others a blank."""
    return bytes(b + 32 if 65 <= b <= 90 else 32 if b in SEPARATORS else b for b in range(256))


class Segment:
    """Documents of one segment while it grows."""

    def __init__(self):
        from array import array

        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.lengths, self.distinct = array("q"), array("q"), array("q")
        self.terms, self.tfs = array("i"), array("i")
        self.bytes = 0

    def add(self, doc_id: int, body: bytes) -> None:
        from collections import Counter

        counts: Counter = Counter()
        at, length = 0, 0
        while at < len(body):  # a long text is cut between terms, so that its list of words stays small
            stop = at + SLICE_BYTES
            while stop < len(body) and body[stop] != 32:
                stop += 1
            words = body[at:stop].split()
            counts.update(words)
            at, length = stop, length + len(words)
        if not length:
            return
        known = self.vocabulary
        self.terms.extend([known.setdefault(w, len(known)) for w in counts])
        self.tfs.extend(counts.values())
        self.ids.append(doc_id)
        self.lengths.append(length)
        self.distinct.append(len(counts))
        self.bytes += len(body)

    def rows(self, number: int, n_docs: int, n_terms: int):
        """The segment by strata, as rows of INDEX: the documents first, then a row for each term."""
        import numpy as np
        import pyarrow as pa

        ids, lengths = np.frombuffer(self.ids, np.int64), np.frombuffer(self.lengths, np.int64)
        m = np.array([10 + 90 * int(n) * n_docs // n_terms for n in lengths], np.int64)
        order = np.lexsort((ids, m))
        place = np.empty(len(ids), np.int32)
        place[order] = np.arange(len(ids))
        values = np.unique(m)
        stratum = np.searchsorted(values, m).astype(np.int32)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), np.frombuffer(self.distinct, np.int64))
        term, tf = np.frombuffer(self.terms, np.int32), np.frombuffer(self.tfs, np.int32)
        by = np.lexsort((place[doc], -tf, stratum[doc], term))
        term, tf, doc = term[by], tf[by], doc[by]
        s = stratum[doc]
        heads = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (s[1:] != s[:-1]) | (tf[1:] != tf[:-1]))))
        terms = np.arange(len(self.vocabulary) + 1)
        runs, posts = np.searchsorted(term[heads], terms), np.searchsorted(term, terms)

        def lists(offsets, items, kind=None):
            kind = kind or pa.int32()
            return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], offsets)), pa.int32()), pa.array(items, kind))

        whole = lambda items: pa.array([items.tolist(), *[None] * len(self.vocabulary)], pa.list_(pa.int64()))
        length = np.diff(np.concatenate((heads, [len(term)])))
        columns = {
            "segment": pa.array(np.full(len(terms), number), pa.int64()), "term": pa.array([None, *(t.decode("utf-8", "replace") for t in self.vocabulary)], pa.string()),
            "df": pa.array([None, *np.diff(posts).tolist()], pa.int32()), "strata": lists(runs, s[heads]), "tfs": lists(runs, tf[heads]), "lengths": lists(runs, length),
            "docs": lists(posts, place[doc]), "doc_ids": whole(ids[order]), "ms": whole(values),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def index(docs: DataFrame, n_docs: int, n_terms: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of INDEX for all segments of documents."""

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        table_of, segment, number = _separators(), Segment(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in arrow_slices(batch, "text", SLICE_BYTES):
                ids = part.column("id").to_pylist()
                for doc_id, body in zip(ids, part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    segment.add(doc_id, (body or b"").translate(table_of))
                    if segment.bytes >= SEGMENT_BYTES:
                        yield segment.rows(number, n_docs, n_terms)
                        segment, number = Segment(), number + 1
        if len(segment.ids):
            yield segment.rows(number, n_docs, n_terms)

    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(MIN_LONG)).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(build, INDEX)


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term), each once."""
    found = F.array_distinct(F.regexp_extract_all(lowered(F.col(text)), F.lit(TERM), F.lit(0)))
    return items.select(F.col(key).cast("long").alias("item_id"), F.explode(found).alias("term")).distinct()


def of_terms(segments: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of asked terms."""
    return segments.join(asked.select("term").distinct(), "term", "left_semi")


def weighted(asked: DataFrame, segments: DataFrame, n_docs: int) -> DataFrame:
    """(item_id, terms, weights): terms that documents hold, with their weights in all documents."""
    known = of_terms(segments.select("term", "df"), asked).groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.ln(F.lit(float(2 * n_docs + 2)) / (F.col("df") * 2 + 1).cast("double"))).cast("long")
    pairs = asked.join(known, "term").select("item_id", F.struct("term", weight.alias("weight")).alias("x")).filter("x.weight > 0")
    lists = pairs.groupBy("item_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return lists.select("item_id", F.col("x.term").alias("item_terms"), F.col("x.weight").alias("weights"))


class Strata:
    """A segment opened for searching, from its rows of INDEX (all of its documents, some of its terms)."""

    def __init__(self, batches: list):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = pa.Table.from_batches(batches)
        head = rows.filter(pc.is_null(rows["term"]))
        rows = rows.filter(pc.is_valid(rows["term"]))
        flat = lambda name, of=rows: pc.list_flatten(of[name]).to_numpy()
        self.terms = rows["term"]
        self.doc_ids, m = flat("doc_ids", head), flat("ms", head)
        self.count = len(m)
        sizes = pc.list_value_length(rows["strata"]).to_numpy()
        self.term_runs = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        self.stratum, tf = flat("strata"), flat("tfs").astype(np.int64)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.stratum])
        self.length = flat("lengths").astype(np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.postings = flat("docs")
        self.heads = np.ones(len(tf), bool)  # the highest frequency of a term in a stratum
        self.heads[1:] = self.stratum[1:] != self.stratum[:-1]
        self.heads[self.term_runs[:-1]] = True

    def search(self, terms, weights, best: "Best") -> None:
        """Puts into `best` what this segment adds; `terms` are positions in the segment's own list."""
        import numpy as np

        if not len(terms):
            return
        begins, ends = self.term_runs[terms], self.term_runs[terms + 1]
        sizes = ends - begins
        runs = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        value = self.impact[runs] * np.repeat(weights, sizes)
        stratum, head = self.stratum[runs], self.heads[runs]
        bounds = sums(stratum[head], value[head], self.count, len(terms))
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        at, step = 0, FIRST_VISIT
        wanted = np.zeros(self.count, bool)
        while at < len(order):
            some = order[at : at + step]
            some = some[bounds[some] >= best.least]
            if not len(some):
                return
            wanted[some] = True
            chosen = np.flatnonzero(wanted[stratum])
            wanted[some] = False
            length = self.length[runs[chosen]]
            places = np.repeat(self.start[runs[chosen]] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            score = sums(self.postings[places], np.repeat(value[chosen], length), len(self.doc_ids), len(terms))
            best.add(score, self.doc_ids)
            at, step = at + step, 2 * step


def sums(places, values, size: int, terms: int):
    """The values added up by place, exactly."""
    import numpy as np

    if terms <= EXACT_TERMS:
        return np.bincount(places, weights=values, minlength=size).astype(np.int64)
    total = np.zeros(size, np.int64)
    np.add.at(total, places, values)
    return total


class Best:
    """The highest scores above 0 of one item, equal ones by smaller doc_id."""

    def __init__(self, most: int):
        import numpy as np

        self.most, self.least = most, 1
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score, ids) -> None:
        import numpy as np

        found = np.flatnonzero(score >= self.least)
        if len(found) > 4 * self.most:
            cut = np.partition(score[found], -self.most)[-self.most]
            found = found[score[found] >= cut]
        s, i = np.concatenate((self.scores, score[found])), np.concatenate((self.ids, ids[found]))
        order = np.lexsort((i, -s))[: self.most]
        self.scores, self.ids = s[order], i[order]
        if len(order) == self.most:
            self.least = int(self.scores[-1])


def search(segments: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score) for `items` (item_id, item_terms, weights) over `segments`, which hold the items'
    terms and every segment's documents."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def opened(parts: list, asked: list) -> None:
            """Every item against one segment."""
            strata = Strata(parts)
            names = pa.concat_arrays([terms for _, terms, _, _ in asked])
            places = pc.fill_null(pc.index_in(names, value_set=strata.terms), -1).to_numpy().astype(np.int64)
            at = 0
            for _, terms, weights, kept in asked:
                mine = places[at : at + len(terms)]
                at += len(terms)
                strata.search(mine[mine >= 0], weights[mine >= 0], kept)

        def found(asked: list):
            rows = [(item, s, i) for item, _, _, kept in asked for s, i in zip(kept.scores.tolist(), kept.ids.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int64()) for k in (0, 1, 2)], names=["item_id", "score", "doc_id"])

        at, parts, asked = (None, None, None), [], []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("cell", "held", "segment")), strict=True))
            start = 0
            while start < len(keys):
                stop = start + 1
                while stop < len(keys) and keys[stop] == keys[start]:
                    stop += 1
                if keys[start] != at:
                    if parts and asked:
                        opened(parts, asked)
                    parts = []
                    if keys[start][0] != at[0] and asked:
                        yield found(asked)
                        asked = []
                    at = keys[start]
                part = batch.slice(start, stop - start)
                if at[1]:
                    columns = (part.column("item_id").to_pylist(), part.column("item_terms"), part.column("weights").to_pylist())
                    asked += [(item, terms.values, np.array(weights, np.int64), Best(best)) for item, terms, weights in zip(*columns, strict=True)]
                else:
                    parts.append(part.select(["term", "strata", "tfs", "lengths", "docs", "doc_ids", "ms"]))
                start = stop
        if parts and asked:
            opened(parts, asked)
        if asked:
            yield found(asked)

    weight = items.agg(F.coalesce(F.sum(F.aggregate("item_terms", F.lit(0).cast("long"), lambda t, x: t + F.octet_length(x) + 16)), F.lit(0))).first()[0]
    groups = max(1, -(-weight // GROUP_BYTES))
    cells = dealt(
        items.withColumn("group", group_of(F.col("item_id"), groups)), segments.drop("df"), groups, partitions(items.sparkSession), F.col("segment"), ["segment"]
    )
    order = W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    found = cells.mapInArrow(run, "item_id long, score long, doc_id long").withColumn("rank", F.row_number().over(order))
    return found.filter(F.col("rank") <= best).select("item_id", "rank", F.when(F.col("doc_id") != MIN_LONG, F.col("doc_id")).alias("doc_id"), "score")


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """Each item's best documents: counts, index and search."""
    work = Work(docs.sparkSession, "lexical")
    n_docs, n_terms = totals(docs)
    segments = work.saved(index(docs, n_docs, n_terms), "index")
    asked = work.saved(item_terms(items), "terms")
    needed = segments.filter("term IS NULL").unionByName(of_terms(segments, asked))
    return search(needed, work.saved(weighted(asked, segments, n_docs), "items"), best)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle() -> str:
    terms = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH words AS (SELECT doc_id, len(t) AS n, t FROM (SELECT doc_id, {terms} AS t FROM documents) WHERE len(t) > 0),
  lots AS (SELECT count(*)::bigint AS docs, sum(n)::bigint AS total FROM words),
  posts AS (SELECT doc_id, n, term, count(*)::bigint AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM words) GROUP BY ALL),
  weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint AS w FROM (SELECT term, count(*) AS df FROM posts GROUP BY term), lots),
  asked AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark),
  scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::bigint AS score FROM asked JOIN weights USING (term) JOIN posts USING (term), lots GROUP BY item_id, doc_id)
  SELECT item_id, (row_number() OVER w)::int AS rank, doc_id, score FROM scores WHERE score > 0 WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 10"""
