"""Hard-negative mining: exact integer scores by matrix products modulo small primes, then windows of scores.

Vectors become integers, floor(256 * x). A block of anchors and a block of rows are multiplied once per prime in
float32: residues lie within (p - 1) / 2 of zero, and 1,024 products of two of them stay below 2**24, so every sum is
exact in whatever order it is taken. Chinese remaindering (digits in a mixed radix, each within half its prime of zero)
gives the signed scores back; as many primes are taken as the two blocks' norms can need.

Anchors are held in groups of bounded size, all rows stream past each group (`grid.dealt`). Two passes: the first finds
each anchor's positives, the second, for each positive, the best rows of another label within the window below its
score. A task keeps only its best rows of each anchor, so what is shuffled afterwards does not grow with the pairs.

Defined results: rows with a null id, label or vector or a null or non-finite component take no part, nor does a vector
whose integers' squares add up to more than 2**60, as its scores need not fit 64 bits; one row stands for an id (of
several the least label, then the least vector); vectors of different lengths are never compared, empty vectors score 0;
an anchor without positives or negatives gives no rows; no rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.llm.common import Work, partitions, table
from geoloom.llm.grid import dealt, group_of

SCALE = 256
#: Odd, below 2**8; the product of all is over 2**62.
PRIMES = (251, 241, 239, 233, 229, 227, 223, 211)
#: Components multiplied at a time: 125 * 125 * 1024 < 2**24.
WIDTH = 1024
LARGEST_SQUARES = float(2**60)
POSITIVES, NEGATIVES = 5, 5
#: Bytes of anchors (as 64-bit integers) that one task holds, and anchors and rows in one matrix product.
GROUP_BYTES = 16 << 20
TILE_ANCHORS, TILE_ROWS = 256, 2048
#: Stands for no row; below every score.
NONE = -(2**62)


def taking_part(rows: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """(id, label, vector, dim): one row for each id."""
    v = F.col(vector)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    squares = F.aggregate(v, F.lit(0.0), lambda total, x: total + F.pow(F.floor(x.cast("double") * SCALE).cast("double"), F.lit(2.0)))
    good = rows.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("vector")).filter(
        F.col(key).isNotNull() & label.isNotNull() & v.isNotNull() & finite & (squares <= LARGEST_SQUARES)
    )
    one = good.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("_row"))
    return one.select("id", "_row.label", "_row.vector", F.size("_row.vector").alias("dim"))


# --- exact products --------------------------------------------------------------------------------------------------


def residues(values, prime: int):
    """Residues of an integer matrix within (prime - 1) / 2 of zero, as float32."""
    import numpy as np

    rest = np.mod(values, prime)
    rest[rest > prime // 2] -= prime
    return rest.astype(np.float32)


def balanced(x, prime: int):
    """x modulo prime, within (prime - 1) / 2 of zero, in place (float64 integers)."""
    import numpy as np

    x -= prime * np.rint(x * (1.0 / prime))
    return x


def product_modulo(a, b, prime: int):
    """a @ b.T modulo prime for residues in float32."""
    import numpy as np

    total = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], WIDTH):
        total += balanced((a[:, at : at + WIDTH] @ b[:, at : at + WIDTH].T).astype(np.float64), prime)
    return balanced(total, prime)


def primes_for(bound: float) -> int:
    """How many primes tell apart all integers of at most `bound`."""
    product, count = 1, 0
    while product <= 2 * int(bound * (1 + 1e-9)) + 2:
        product, count = product * PRIMES[count], count + 1
    return count


def reconstructed(parts: list):
    """The signed integers below half the product of the primes that leave these residues."""
    import numpy as np

    digits: list = []
    for i, x in enumerate(parts):
        for j, digit in enumerate(digits):
            x = balanced((x - digit) * pow(PRIMES[j], -1, PRIMES[i]), PRIMES[i])
        digits.append(balanced(x, PRIMES[i]))
    total, radix = np.zeros(parts[0].shape, np.int64), 1
    for digit, prime in zip(digits, PRIMES, strict=False):
        total += digit.astype(np.int64) * radix
        radix *= prime
    return total


class Block:
    """Integer vectors with their norms; residues are worked out when a product first asks for them."""

    def __init__(self, values):
        import numpy as np

        self.values, self.kept = values, {}
        self.norm = float(np.sqrt((values.astype(np.float64) ** 2).sum(1).max(initial=0.0)))

    def modulo(self, i: int):
        if i not in self.kept:
            self.kept[i] = residues(self.values, PRIMES[i])
        return self.kept[i]


def scores(anchors: Block, rows: Block, some: slice, others: slice):
    """Exact inner products of some anchors with some rows."""
    count = primes_for(anchors.norm * rows.norm)
    return reconstructed([product_modulo(anchors.modulo(i)[some], rows.modulo(i)[others], PRIMES[i]) for i in range(count)])


def integers(column, dim: int):
    """The rows of an Arrow list column as an integer matrix."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(len(column), dim)


# --- the best rows of a task -----------------------------------------------------------------------------------------


def merged(kept: tuple, new: tuple):
    """The best of two lists (scores, ids) along the last axis, as long as the first: higher scores, then smaller ids."""
    import numpy as np

    s, ids = (np.concatenate(pair, axis=-1) for pair in zip(kept, new, strict=True))
    order = np.lexsort((ids, -s))[..., : kept[0].shape[-1]]
    return np.take_along_axis(s, order, -1), np.take_along_axis(ids, order, -1)


def best_of(s, ids, chosen, most: int):
    """(scores, ids) of the `most` best chosen entries of each row of `s`; columns are in the order of ids."""
    import numpy as np

    out_s, out_i = np.full((len(s), most), NONE), np.full((len(s), most), NONE)
    r, c = np.nonzero(chosen)
    values = s[r, c]
    order = np.lexsort((c, -values, r))
    r, c, values = r[order], c[order], values[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    good = place < most
    out_s[r[good], place[good]], out_i[r[good], place[good]] = values[good], ids[c[good]]
    return out_s, out_i


def best_within(s, ids, chosen, wanted, most: int):
    """As best_of, for each column of `wanted` (positives' scores, NONE where there is none) only what lies in
    [0.8 * positive, positive]: (rows, positives, most)."""
    import numpy as np

    shape = (*wanted.shape, most)
    out_s, out_i = np.full(shape, NONE), np.full(shape, NONE)
    usable = wanted >= 0  # below zero the window is empty
    high = np.where(usable, wanted, -1).max(1, initial=-1)
    low = np.where(usable, wanted, 2**60).min(1, initial=2**60)
    r, c = np.nonzero(chosen & (s <= high[:, None]) & (5 * s >= 4 * low[:, None]))
    values = s[r, c]
    order = np.lexsort((c, -values, r))
    r, c, values = r[order], c[order], values[order]
    for j in range(wanted.shape[1]):
        limit = wanted[r, j]
        inside = (limit >= 0) & (values <= limit) & (5 * values >= 4 * limit)
        rows, cols, found = r[inside], c[inside], values[inside]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        good = place < most
        out_s[rows[good], j, place[good]], out_i[rows[good], j, place[good]] = found[good], ids[cols[good]]
    return out_s, out_i


class Anchors:
    """The anchors of one cell and length, and the best rows seen so far."""

    def __init__(self, batches: list, dim: int, positives: int, negatives: int):
        import numpy as np
        import pyarrow as pa

        held = pa.Table.from_batches(batches).combine_chunks()
        column = lambda name: held.column(name).combine_chunks()
        self.dim, self.negatives = dim, negatives
        self.block = Block(integers(column("vector"), dim))
        self.ids, self.labels = column("id").to_numpy(), column("label").to_numpy()
        if negatives:
            lists = zip(column("positives").to_pylist(), column("limits").to_pylist(), strict=True)
            self.positives, self.wanted = np.full((2, len(self.ids), positives), NONE)
            for row, (ids, limits) in enumerate(lists):
                self.positives[row, : len(ids)], self.wanted[row, : len(ids)] = ids, limits
        shape = (len(self.ids), positives, negatives) if negatives else (len(self.ids), positives)
        self.best = np.full(shape, NONE), np.full(shape, NONE)

    def meet(self, batch) -> None:
        import numpy as np
        import pyarrow as pa

        batch = batch.take(pa.array(np.argsort(batch.column("id").to_numpy())))
        rows, ids, labels = Block(integers(batch.column("vector"), self.dim)), batch.column("id").to_numpy(), batch.column("label").to_numpy()
        for top in range(0, len(self.ids), TILE_ANCHORS):
            some = slice(top, top + TILE_ANCHORS)
            for left in range(0, len(ids), TILE_ROWS):
                others = slice(left, left + TILE_ROWS)
                s = scores(self.block, rows, some, others)
                same = self.labels[some, None] == labels[None, others]
                if self.negatives:
                    new = best_within(s, ids[others], ~same, self.wanted[some], self.negatives)
                else:
                    new = best_of(s, ids[others], same & (self.ids[some, None] != ids[None, others]), self.best[0].shape[-1])
                better = merged(tuple(b[some] for b in self.best), new)
                for kept, found in zip(self.best, better, strict=True):
                    kept[some] = found

    def rows(self):
        import numpy as np
        import pyarrow as pa

        s, ids = self.best
        at = np.nonzero(s != NONE)
        out = {"anchor_id": self.ids[at[0]]}
        if self.negatives:
            out |= {"positive_id": self.positives[at[:2]], "positive_score": self.wanted[at[:2]]}
        out |= {"id": ids[at], "score": s[at]}
        return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})


def met(anchors: DataFrame, rows: DataFrame, groups: int, positives: int, negatives: int = 0) -> DataFrame:
    """The best rows of each anchor, as each task saw them: its positives, or with `negatives` those of each positive."""

    def run(batches: Iterator) -> Iterator:
        at, waiting, now = None, [], None
        for batch in batches:
            cells = list(zip(batch.column("cell").to_pylist(), batch.column("dim").to_pylist(), batch.column("held").to_pylist(), strict=True))
            start = 0
            while start < len(cells):
                stop = start + 1
                while stop < len(cells) and cells[stop] == cells[start]:
                    stop += 1
                cell, dim, held = cells[start]
                if (cell, dim) != at:
                    if now is not None:
                        yield now.rows()
                    at, waiting, now = (cell, dim), [], None
                part = batch.slice(start, stop - start)
                if held:
                    waiting.append(part)
                else:
                    if waiting:
                        now, waiting = Anchors(waiting, dim, positives, negatives), []
                    if now is not None:  # else no anchor of this length is in the cell
                        now.meet(part)
                start = stop
        if now is not None:
            yield now.rows()

    names = ["anchor_id", *["positive_id", "positive_score"] * bool(negatives), "id", "score"]
    cells = dealt(anchors.withColumn("group", group_of(F.col("id"), groups)), rows, groups, partitions(rows.sparkSession), F.col("id"), ["dim"])
    return cells.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def mined(rows: DataFrame, key: str, vector: str, label: Column, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); `anchor` is a condition on `id`."""
    work = Work(rows.sparkSession, "negatives")
    part = work.saved(taking_part(rows, key, vector, label), "rows").select("dim", "id", "label", "vector")
    asked = part.filter(anchor)
    weight = asked.agg(F.coalesce(F.sum(F.col("dim").cast("long") * 8 + 64), F.lit(0))).first()[0]
    groups = max(1, -(-weight // GROUP_BYTES))
    first = W.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    best = met(asked, part, groups, positives).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= positives)
    # An anchor's positives: `positives` at most.
    lists = best.groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("other"), "score"))).alias("_best"))
    wanting = asked.join(work.saved(lists, "positives"), "id").select("dim", "id", "label", "vector", F.col("_best.other").alias("positives"), F.col("_best.score").alias("limits"))
    order = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
    found = met(wanting, part, groups, positives, negatives).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label, F.col("id") % 100 == 0)


def oracle() -> str:
    return """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::double)) AS e
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.e, b.e)::bigint AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id),
  p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
  SELECT anchor_id, positive_id, (row_number() OVER w)::int AS rank, other AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
  WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 5"""
