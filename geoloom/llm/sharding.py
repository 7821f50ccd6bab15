"""Sharding: minimax contiguous partition of ordered, indivisible groups.

Groups are equal texts, ordered by their smallest id; all rows of a group share a shard, and a shard is a run of
groups. The smallest feasible shard capacity is found by binary search, each capacity checked greedily. The greedy
walk only asks "which group end lies last at or before x", so the driver keeps a bounded list of group ends: where
the list leaves a capacity open, the stretches in doubt are read again at a finer step, until they are whole.

The greedy walk leaves the last shards empty where one group sets the capacity. So the cuts are laid anew within that
capacity, as evenly as the listed ends allow; a group above the average counts as one shard, and what lies before and
behind it shares the other shards by size.

Defined results: a null text is one group of its own (crc32 of no bytes, size 8), an empty text another; null ids
come first in order; repeated rows keep their own slots; an empty table gives an empty result; shards stay empty
where there are fewer groups than shards.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import MIN_LONG, long_literals, numbered, saved, table

#: Group ends that the driver may hold at a time.
HELD = 16384


def greedy(ends: list[int], capacity: int, shards: int, last: int, low: bool) -> list[int] | None:
    """Cuts of a walk that fills each shard to `capacity`; None if `shards` do not reach `last`.

    With `low`, a cut is the last known group end (a true one, never too far); otherwise the capacity itself."""
    at, cuts = 0, []
    for _ in range(shards):
        if at + capacity >= last:
            return cuts + [last]
        reach = at + capacity
        at = ends[i - 1] if low and (i := bisect_right(ends, reach)) else (at if low else reach)
        cuts.append(at)
    return cuts if at >= last else None


def smallest(lo: int, hi: int, feasible) -> int:
    """The smallest value in [lo, hi] that is feasible; hi is taken to be."""
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if feasible(mid) else (mid + 1, hi)
    return lo


def even_cuts(ends: list[int], capacity: int, shards: int, giants: list[tuple[int, int]]) -> list[int]:
    """Cuts at known ends (the last is the total) into `shards` that hold `capacity` at most, which must be feasible, as
    even as can be. `giants`: (size, end) of the largest groups, descending."""
    total = ends[-1]
    rest, left, big = total, shards, []
    for size, end in giants:
        if left == 1 or size * left <= rest:
            break
        big.append((end, size))
        rest, left = rest - size, left - 1
    share = rest / left

    def place(x: int) -> float:
        """Where x lies if each giant took one share."""
        return x - sum(size - share for end, size in big if end <= x)

    known = [0, *ends]
    latest = [total] * (shards + 1)  # the least end at which shard i may stop, so that the rest can be reached
    for i in range(shards - 1, 0, -1):
        latest[i] = known[bisect_left(known, latest[i + 1] - capacity)] if latest[i + 1] > capacity else 0
    at, cuts = 0, []
    for i in range(1, shards):
        # Up to the next giant (or through it, if it comes first) as many shards as its bytes are worth, of one size each.
        average = (place(total) - place(at)) / (shards - i + 1)
        stop = next((end - size for end, size in sorted(big) if end > at), total)
        ahead = place(stop) - place(at)
        goal = place(at) + (ahead / max(1, round(ahead / average)) if ahead > 0 and average > 0 else share)
        lo = max(bisect_right(known, at), bisect_left(known, latest[i]))  # a group at least, while there are any
        hi = bisect_right(known, at + capacity)
        near = bisect_left(known, goal, lo, hi, key=place)
        at = min(known[max(lo, near - 1) : min(near + 1, hi)], key=lambda e: (abs(place(e) - goal), e), default=at)
        cuts.append(at)
    return [*cuts, total]


def minimax_cuts(groups: DataFrame, shards: int) -> list[int]:
    """Ends (running sums) at which to cut, for `groups` with columns `size` and `end` (running sum in order)."""
    total, largest, count = groups.agg(F.max("end"), F.max("size"), F.count(F.lit(1))).first()
    if not count:
        return []
    floor = max(-(-total // shards), largest)
    step, spans = max(1, -(-count // HELD)), [(0, total)]
    giants = [tuple(r) for r in groups.select("size", "end").orderBy(F.desc("size"), "end").limit(shards).collect()]
    ends: set[int] = {total} | {e for size, end in giants for e in (end - size, end) if e}
    while True:
        near = F.lit(False)
        for a, b in spans:
            near = near | F.col("end").between(a, b)
        fresh = groups.filter(near & ((F.col("number") % step == 0) | (F.lit(step) == 1))).select("end").collect()
        ends |= {r["end"] for r in fresh}
        known = sorted(ends)
        sure = smallest(floor, total, lambda c: greedy(known, c, shards, total, True) is not None)
        if step == 1:
            return even_cuts(known, sure, shards, giants)
        maybe = smallest(floor, sure, lambda c: greedy(known, c, shards, total, False) is not None)
        # A cut lies between the walk of known ends at the least capacity and the free walk at the largest.
        low, high = [], []
        at_low = at_high = 0
        for _ in range(shards):
            i = bisect_right(known, at_low + maybe)
            at_low = known[i - 1] if i else at_low
            at_high = min(total, at_high + sure)
            low.append(at_low)
            high.append(at_high)
        spans = merged([(a, b) for a, b in zip(low, high, strict=True)])
        inside = F.lit(False)
        for a, b in spans:
            inside = inside | F.col("end").between(a, b)
        left = groups.filter(inside).count()
        step = 1 if left <= HELD else min(max(1, -(-left // HELD)), step // 2 or 1)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def with_running_sum(ordered: DataFrame, size: str) -> DataFrame:
    """Rows of `numbered` with `end` (running sum in total order) and `number` (rank from 1).

    Sums per part are few (one row a partition); only they pass through a single window."""
    from pyspark.sql import Window as W

    inside = W.partitionBy("_part").orderBy("_row").rowsBetween(W.unboundedPreceding, 0)
    parts = ordered.groupBy("_part").agg(F.sum(size).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(
        "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum0"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0")
    )
    return (
        ordered.join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn("end", F.col("_sum0") + F.sum(size).over(inside))
        .withColumn("number", F.col("_n0") + F.col("_row") + 1)
        .drop("_sum0", "_n0")
    )


def sharded(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, group, shard, slot) for every row of `docs`."""
    body = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    rows = docs.select(
        F.col(key).alias("_key"),
        F.coalesce(F.col(key), F.lit(MIN_LONG)).alias("_at"),
        (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        # Equal texts: a digest of the whole text; 'n' marks null.
        F.coalesce(F.sha2(F.col(text), 256), F.lit("n")).alias("group"),
    )
    rows = saved(rows, "shard-rows")
    groups = rows.groupBy("group").agg(F.min("_at").alias("first"), F.sum("size").alias("size"))
    ordered = saved(with_running_sum(numbered(groups, ["first", "group"], "shard-groups"), "size"), "shard-ends")
    cuts = minimax_cuts(ordered, shards)
    shard = F.size(F.filter(long_literals(cuts[:-1]), lambda c: c < F.col("end"))).cast("int")
    placed = rows.join(ordered.select("group", "first", shard.alias("shard")), "group")
    by_shard = numbered(placed, ["shard", "first", "group", "_at"], "shard-slots")
    return by_shard.join(F.broadcast(slot_offsets(by_shard, "shard")), ["_part", "shard"]).select(
        F.col("_key").alias(key), "size", "text_crc32", "group", "shard", (F.col("_row") + F.col("_shift")).alias("slot")
    )


def slot_offsets(ordered: DataFrame, by: str) -> DataFrame:
    """(_part, by, _shift): what to add to `_row` for a rank from 0 within `by`; at most parts + values of `by` rows."""
    from pyspark.sql import Window as W

    runs = ordered.groupBy("_part", by).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return runs.select("_part", by, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharded(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
