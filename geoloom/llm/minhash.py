"""Near-duplicate documents: bottom-k sketches, inverted lists of retained values, union-sketch filter, exact Jaccard.

1. One pass gives each text its shingle set's size, digest and k least hash values (the shingle hash is the only hash
   function). Texts of one digest are one class from here on, whatever their number.
2. A class lists itself under the rarest values of its sketch. Two sets at the threshold share at least `overlap` of
   their k values (but for a chance of MISS at most; `sketch_plan` works both out from the threshold), so they share
   one of the k - overlap + 1 rarest; values that only one class holds are dropped first. Frequent passages thus never make a list.
3. First round: each class is compared with one class only, the central member that it shares most lists with; links
   are confirmed on full sets and joined to components. Second round: only lists whose members lie in different
   components go on. Members of long ones are listed anew by the rarest values of their full sets, and the members of
   a list that lie in different components are compared, in blocks, inside the tasks; only pairs that pass leave them.
4. A comparison goes by set size and the union-sketch estimate; what passes is decided on full sets.

Texts take part once they are needed: those of listed classes are fetched once, and each round deals them to their
pairs. A pair's texts meet at its first class, whose partners are dealt to blocks of bounded size, so the centre of a
large group is no hot key. Joins that carry texts or sketches are sort-merge joins at every size.

Sets hold 64-bit hashes of shingles: sizes and similarities are exact but for two shingles of one pair with one hash.

A document is an id with a text (see `text_key`): rows that repeat both are one, rows that share the id only are not.
Classes are numbered in the order of their first documents. Defined results: a text without words has an empty set and
is linked with nothing; null ids count as the least id and come back as null; of a group the first document is kept, by
id, then by its text's digest; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import MIN_LONG, Work, arrow_slices, partitions, saved, table, text_key
from geoloom.llm.graph import components
from geoloom.llm.shingles import shingle_sets

#: Chance at most that a pair at the threshold shares fewer sketch values than is asked for.
MISS = 2e-8
#: Sketch sizes are multiples of this.
K = 32
PERCENT = 85
#: Members of a list, or partners of one class, that one block holds on average.
BLOCK = 256
#: Pairs that are estimated at a time.
PAIRS_AT_ONCE = 1 << 13
#: Members of blocks that a task unpacks at a time (two blocks at least).
MEMBERS_AT_ONCE = 4096
#: Members of a list beyond which they are listed anew by their full sets.
HOT_LIST = 128
#: Text that is shingled at a time; a worker keeps tables of 16 bytes for each byte of it.
SLICE_BYTES = 1 << 20


def sketch_plan(percent: int) -> tuple[int, int]:
    """(k, overlap): sketch size, and the values that two sketches at the threshold share at the least. Of k draws that
    each agree with probability percent / 100, fewer than `overlap` do with a chance of MISS at most: (32, 14) at 85,
    (32, 11) at 80, (32, 2) at 50; low thresholds have longer sketches."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be 1 to 100")
    p = percent / 100
    k = K
    while (1 - p) ** k > MISS:
        k += K
    overlap, chance = 0, 0.0
    while overlap < k and (chance := chance + comb(k, overlap) * p**overlap * (1 - p) ** (k - overlap)) <= MISS:
        overlap += 1
    return k, overlap


def sketches(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(id, doc, n, digest, sketch) per row: its key, set size, 16-byte digest of the set, its k least values in order."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        np.seterr(over="ignore")
        for batch in batches:
            for part in arrow_slices(batch, "text", SLICE_BYTES):
                sets = [np.sort(s.view(np.int64)) for s in shingle_sets(part.column(2))]
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array([s[:k] for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["id", "doc", "n", "digest", "sketch"],
                )

    number = F.coalesce(F.col(key).cast("long"), F.lit(MIN_LONG)).alias("id")
    rows = docs.select(number, text_key(F.col(key), F.col(text)).alias("doc"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, doc binary, n long, digest binary, sketch array<long>")


def shared_at_least(n: Column, percent: int) -> Column:
    return F.least(F.lit(sketch_plan(percent)[1]), F.ceil(n * percent / 100)).cast("int")


def rarest_first(held: DataFrame, work: Work) -> DataFrame:
    """(c, n, k, vs, central) from (c, n, k, value): a class's values that others hold too, rarest first. Its other
    values come before them in the order, so their number k - size(vs) counts as places taken."""
    # Written down, so that the join has an exchange of its own on this side and a very common value can be split.
    common = work.saved(held.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "common")
    return (
        held.join(common, "value")
        .groupBy("c", "n", "k")
        .agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("vs"), F.sum("df").alias("central"))  # one text's values
    )


def listed(classes: DataFrame, percent: int, work: Work) -> DataFrame:
    """(value, c, n, most, central): each class under the rarest values that a partner must share one of; `most` is the
    largest partner that the row stands for."""
    held = classes.filter("n > 0").select("c", "n", F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    unique = F.col("k") - F.size("vs")
    wanted = F.greatest(F.col("k") - shared_at_least(F.col("n"), percent) + 1 - unique, F.lit(0))
    return rarest_first(held, work).select("c", "n", "central", F.explode(F.slice("vs", F.lit(1), wanted)).alias("v")).select(
        F.col("v.value").alias("value"), "c", "n", F.floor(F.col("n") * 100 / percent).alias("most"), "central"
    )


def listed_in_full(texts: DataFrame, percent: int, work: Work) -> DataFrame:
    """Like `listed`, from the full sets of `texts` (c, text), without chance: two sets of n and m values at the
    threshold share percent * (n + m) / (100 + percent) values at least, so the j-th rarest value of a set need only be
    listed for partners whose share could still be met by the values from the j-th on."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        np.seterr(over="ignore")
        for batch in batches:
            for part in arrow_slices(batch, "text", SLICE_BYTES):
                sets = shingle_sets(part.column(1))
                sizes = np.array([len(s) for s in sets], np.int64)
                rows = pa.array(np.repeat(np.arange(len(sets)), sizes))
                values = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), pa.array(np.repeat(sizes, sizes)), pa.array(values)], names=["c", "n", "value"])

    held = texts.select("c", "text").mapInArrow(run, "c long, n long, value long").withColumn("k", F.col("n"))
    unique = F.col("n") - F.size("vs")
    least = F.ceil(F.col("n") * percent / 100)
    # The last place j at which a partner of the least size would do.
    wanted = F.greatest(F.col("n") - least + 1 - unique, F.lit(0)).cast("int")
    rows = rarest_first(held, work).select("c", "n", "central", unique.alias("unique"), F.posexplode(F.slice("vs", F.lit(1), wanted)).alias("at", "v"))
    rest = F.col("n") - F.col("unique") - F.col("at")  # values from this one on
    return rows.select(
        F.col("v.value").alias("value"), "c", "n", (F.floor(rest * (100 + percent) / percent) - F.col("n")).alias("most"), "central"
    )


def alike_sizes(a: str, b: str, percent: int) -> Column:
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent)


def estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The `pairs` (a, b) whose sketches agree: of the k least values of both together, enough lie in both."""
    k, overlap = sketch_plan(percent)
    side = lambda name, sketch: classes.select(F.col("c").alias(name), F.col("sketch").alias(sketch)).hint("merge")
    both = pairs.join(side("a", "sa"), "a").join(side("b", "sb"), "b")
    both = both.select("a", "b", F.slice(F.sort_array(F.array_union("sa", "sb")), 1, k).alias("least"), F.array_intersect("sa", "sb").alias("shared"))
    return both.filter(F.size(F.array_intersect("least", "shared")) * k >= overlap * F.size("least")).select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of `pairs` (written down) whose full sets are alike, from `texts` (c, text)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        np.seterr(over="ignore")
        centre = None
        for batch in batches:
            for part in arrow_slices(batch, "text", SLICE_BYTES):
                good = []
                for member, values in zip(part.column(1).to_pylist(), shingle_sets(part.column(3)), strict=True):
                    if not member:
                        centre = values  # the first row of its block
                        good.append(False)
                        continue
                    inter = len(np.intersect1d(centre, values, assume_unique=True))
                    good.append(inter > 0 and 100 * inter >= percent * (len(centre) + len(values) - inter))
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in (part.column(0), part.column(2))], names=["a", "b"])

    partners = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    dealt = pairs.join(partners, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / BLOCK)))
    members = dealt.select(F.col("b").alias("c"), "a", "block", F.lit(True).alias("member"))
    centres = dealt.select(F.col("a").alias("c"), "a", "block", F.lit(False).alias("member")).distinct()
    sent = members.unionByName(centres).join(texts.hint("merge"), "c")
    in_blocks = sent.repartition("a", "block").sortWithinPartitions("a", "block", "member")
    return in_blocks.select("a", "member", "c", "text").mapInArrow(run, "a long, b long")


def star_pairs(lists: DataFrame, percent: int, work: Work) -> DataFrame:
    """(a, b): each class b with the central member a that it shares most lists with."""
    centre = lists.groupBy("value").agg(F.max(F.struct("central", -F.col("c"), "n")).alias("m")).select(
        "value", (-F.col("m.col2")).alias("a"), F.col("m.n").alias("na")
    )
    centre = work.saved(centre, "centres")  # as above: long lists can be split
    pairs = lists.join(centre, "value").filter((F.col("c") != F.col("a")) & alike_sizes("n", "na", percent))
    shared = pairs.groupBy(F.col("c").alias("b"), "a").agg(F.count(F.lit(1)).alias("shared"))
    return shared.groupBy("b").agg(F.max(F.struct("shared", -F.col("a"))).alias("m")).select((-F.col("m.col2")).alias("a"), "b")


def open_lists(lists: DataFrame, labels: DataFrame, work: Work) -> DataFrame:
    """The rows of `lists` that may still bring a link, with `label` and their list's `size`: the list's members lie in
    different components, and not every partner in it is too large for the row."""
    member = lists.join(labels.select(F.col("node").alias("c"), "label"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    member = work.saved(member, "labelled")
    of_list = member.groupBy("value").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("least"), F.count(F.lit(1)).alias("size"))
    mixed = work.saved(of_list.filter("lo <> hi").select("value", "least", "size"), "mixed")
    return member.join(mixed, "value").filter("most >= least").drop("least")


def split_lists(lists: DataFrame, texts: DataFrame, labels: DataFrame, percent: int, work: Work) -> DataFrame:
    """`open_lists`, with the members of those of over HOT_LIST rows listed anew by their full sets, so that many
    variants of one text meet by what they share beyond it. A pair in a long list has both members there."""
    rows = work.saved(open_lists(lists.drop("central"), labels, work), "open-lists")
    members = rows.filter(F.col("size") > HOT_LIST).select("c").distinct()
    again = listed_in_full(texts.hint("merge").join(members, "c", "left_semi"), percent, work)
    return rows.filter(F.col("size") <= HOT_LIST).unionByName(open_lists(again.drop("central"), labels, work))


def agreeing(batch, k: int, overlap: int, percent: int):
    """Pairs (a, b) of an Arrow batch of blocks (one, other): members of both, or of `one` where `other` is null, that
    lie in different components, fit in size, and whose sketches agree."""
    import numpy as np
    import pyarrow.compute as pc

    pad = np.iinfo(np.int64).max
    held, begins = {name: [] for name in ("c", "n", "most", "label")}, []
    sketches, base = [], 0
    for column in (batch.column(0), batch.column(1)):
        counts = np.asarray(pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False), np.int64)
        begins.append((base + np.cumsum(counts) - counts, counts))
        rows = column.flatten()
        base += len(rows)
        for name, values in held.items():
            values.append(rows.field(name).to_numpy(zero_copy_only=False))
        lists = rows.field("sketch")
        sizes = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
        grid = np.full((len(rows), k), pad, np.int64)
        grid[np.repeat(np.arange(len(rows)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
        sketches.append(grid)
    held = {name: np.concatenate(values) for name, values in held.items()}
    grid = np.concatenate(sketches)

    def passing(i, j):
        """Of the pairs (i, j) those that agree, in slices of bounded size."""
        n, most, label = held["n"], held["most"], held["label"]
        fits = (label[i] != label[j]) & (n[i] <= most[j]) & (n[j] <= most[i]) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent)
        i, j = i[fits], j[fits]
        for at in range(0, len(i), PAIRS_AT_ONCE):
            x, y = i[at : at + PAIRS_AT_ONCE], j[at : at + PAIRS_AT_ONCE]
            both = np.sort(np.concatenate((grid[x], grid[y]), axis=1), axis=1)
            new = both != pad
            again = new[:, 1:] & (both[:, 1:] == both[:, :-1])
            new[:, 1:] &= ~again
            rank = np.cumsum(new, axis=1)
            shared = (again & (rank[:, 1:] <= k)).sum(1)
            good = shared * k >= overlap * np.minimum(rank[:, -1], k)
            yield held["c"][x[good]], held["c"][y[good]]

    found, waiting, held_back = [], [], 0
    (first_a, size_a), (first_b, size_b) = begins
    for row in range(batch.num_rows):
        if size_b[row]:
            i, j = (g.ravel() for g in np.meshgrid(np.arange(size_a[row]), np.arange(size_b[row]), indexing="ij"))
            waiting.append((i + first_a[row], j + first_b[row]))
        else:
            i, j = np.triu_indices(size_a[row], 1)
            waiting.append((i + first_a[row], j + first_a[row]))
        held_back += len(i)
        if held_back >= PAIRS_AT_ONCE or row == batch.num_rows - 1:
            found += passing(*(np.concatenate(c) for c in zip(*waiting, strict=True)))
            waiting, held_back = [], 0
    empty = [(np.empty(0, np.int64),) * 2]
    x, y = (np.concatenate(c) for c in zip(*(found or empty), strict=True))
    return np.minimum(x, y), np.maximum(x, y)


def open_pairs(rows: DataFrame, classes: DataFrame, percent: int, work: Work) -> DataFrame:
    """(a, b): members of one list (see `split_lists`) that lie in different components and whose sketches agree. Lists
    of over BLOCK members are cut into bands of set size, of which only neighbours can hold links, and these into blocks."""
    k, overlap = sketch_plan(percent)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sizes = [(len(one) if one.is_valid else 0) + (len(other) if other.is_valid else 0) for one, other in zip(*batch.columns, strict=True)]
            start = 0
            while start < batch.num_rows:
                stop, held = start + 1, sizes[start]
                while stop < batch.num_rows and held + sizes[stop] <= MEMBERS_AT_ONCE:
                    held += sizes[stop]
                    stop += 1
                a, b = agreeing(batch.slice(start, stop - start), k, overlap, percent)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                start = stop

    long_list = F.col("size") > BLOCK
    step = max(log(100 / percent), 0.05) * 1.000001  # alike sizes lie in one band or two neighbouring ones
    band = F.when(long_list, F.floor(F.log(F.col("n").cast("double")) / step)).otherwise(0)
    sub = F.when(long_list, F.pmod(F.xxhash64("c"), F.ceil(F.col("size") / BLOCK))).otherwise(0)
    member = rows.join(classes.select("c", "sketch").hint("merge"), "c").withColumns({"band": band, "sub": sub, "long": long_list})
    blocks = work.saved(
        member.groupBy("value", "long", "band", "sub").agg(F.collect_list(F.struct("c", "n", "most", "label", "sketch")).alias("one")),  # about BLOCK members at most
        "blocks",
    )
    other = blocks.filter("long").select("value", F.col("band").alias("band_2"), F.col("sub").alias("sub_2"), F.col("one").alias("other"))
    near = (F.col("band_2") == F.col("band") + 1) | ((F.col("band_2") == F.col("band")) & (F.col("sub_2") > F.col("sub")))
    crossed = blocks.filter("long").join(other.hint("merge"), "value").filter(near).select("one", "other")
    alone = blocks.select("one", F.lit(None).cast(blocks.schema["one"].dataType).alias("other"))
    return alone.unionByName(crossed).mapInArrow(run, "a long, b long").distinct()


def judged(docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """(id, doc, n, head_id, kept) for every row of `docs`: its group's least id, and whether it is the group's first document."""
    work = Work(docs.sparkSession, "near")
    rows = work.saved(sketches(docs, key, text, sketch_plan(percent)[0]), "sketches")
    sets = rows.groupBy("digest").agg(F.min("doc").alias("doc"), F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    in_order = sets.repartitionByRange(partitions(docs.sparkSession), "doc").sortWithinPartitions("doc")
    classes = work.saved(in_order.withColumn("c", F.monotonically_increasing_id()), "classes")
    lists = work.saved(listed(classes, percent, work), "lists")
    first_docs = classes.select("doc", "c").join(lists.select("c").distinct(), "c", "left_semi")
    keyed = docs.select(text_key(F.col(key), F.col(text)).alias("doc"), F.col(text).alias("text"))
    texts = work.saved(keyed.join(first_docs.hint("merge"), "doc").dropDuplicates(["doc"]).select("c", "text"), "texts")
    stars = work.saved(estimated(star_pairs(lists, percent, work), classes, percent), "stars")
    links = work.saved(confirmed(stars, texts, percent), "links")
    first = work.saved(components(links), "first")
    more = work.saved(open_pairs(split_lists(lists, texts, first, percent, work), classes, percent, work), "more")
    links_2 = work.saved(confirmed(more, texts, percent), "links-2")
    work.drop("common", "lists", "centres", "texts", "stars", "first", "labelled", "mixed", "open-lists", "blocks", "more")
    final = work.saved(components(links.unionByName(links_2)), "final")
    work.drop("links", "links-2")
    head = classes.select(F.col("c").alias("label"), F.col("doc").alias("head"), F.col("id").alias("head_id"))
    groups = (
        classes.select("digest", "c")
        .join(final.select(F.col("node").alias("c"), "label"), "c", "left")
        .select("digest", F.coalesce("label", "c").alias("label"))
        .join(head, "label")
    )
    empty = F.col("n") == 0
    return (
        rows.select("id", "doc", "n", "digest")
        .join(groups, "digest")
        .select("id", "doc", "n", F.when(empty, F.col("id")).otherwise(F.col("head_id")).alias("head_id"), (empty | (F.col("doc") == F.col("head"))).alias("kept"))
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of `docs`."""
    return judged(docs, key, text, percent).select(
        F.nullif("id", F.lit(MIN_LONG)).alias(key), F.col("n").alias("n_shingles"), F.nullif("head_id", F.lit(MIN_LONG)).alias("component_id"), "kept"
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row of `docs` for each group, and every row without words; all columns stay."""
    by_doc = judged(docs.select(key, text), key, text, percent).groupBy("doc").agg(F.min("kept").alias("kept"), F.max("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    marked = saved(by_doc.filter("not kept or (n > 0 and rows > 1)").select(F.col("doc").alias("_doc"), F.col("kept").alias("_once")), "near-marked")
    row = docs.select(F.struct("*").alias("_row"), text_key(docs[key], docs[text]).alias("_doc")).join(marked.hint("merge"), "_doc", "left")
    alone = row.filter("_once IS NULL")
    repeated = row.filter("_once").dropDuplicates(["_doc"])
    return alone.unionByName(repeated).select("_row.*")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def oracle() -> str:
    """The same groups by counting the shingles that two sets share."""
    upper = "".join(map(chr, range(65, 91)))
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
h AS (SELECT doc_id, len(g)::bigint AS n, CASE WHEN len(g) = 0 THEN 'empty ' || doc_id ELSE md5(array_to_string(g, chr(10))) END AS digest, g FROM s),
k AS (SELECT min(doc_id) AS c, digest, any_value(n) AS n, any_value(g) AS g FROM h GROUP BY digest),
e AS (SELECT c, n, unnest(g) AS v FROM k),
p AS (SELECT x.c AS a, y.c AS b FROM e x JOIN e y ON x.v = y.v AND x.c < y.c GROUP BY x.c, y.c HAVING 100 * count(*) >= {PERCENT} * (any_value(x.n) + any_value(y.n) - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT h.doc_id, h.n AS n_shingles, least(k.c, coalesce(m.least, k.c)) AS component_id, h.doc_id = least(k.c, coalesce(m.least, k.c)) AS kept
  FROM h JOIN k USING (digest) LEFT JOIN m ON m.a = k.c"""
