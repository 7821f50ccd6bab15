"""Suffix-array dedup: remove every byte covered by a LENGTH-byte string that also starts earlier in the corpus.

1. Each LENGTH-byte window of a text belongs to its least GRAM-byte hash (the rightmost of equals): the anchor. Equal
   windows have equal anchors at equal offsets, whichever texts they stand in. An anchor's windows are one run of
   starts; the bytes they cover are its context.
2. Anchors meet by gram. Of equal contexts (by 128 bits of hash) the first occurrence stays in play and the others are
   settled: all their bytes go. (Within SENT_BYTES of texts this happens before the shuffle, so a common passage sends
   few rows.) Grams with one context are dropped. What is left is the contexts that share a gram but differ. A gram at
   the edge of a very common passage has as many contexts as texts: such grams are looked for in a sample of the texts,
   and their anchors are dealt by gram and context, so that no task gets them all. The sample decides nothing else.
3. Those contexts are read again from their texts and dealt into buckets by gram. In a bucket, a suffix array, its
   Burrows-Wheeler transform and a breadth-first backward extension of intervals give the common prefixes of
   neighbouring suffixes by increasing value, up to LENGTH - 1. Boundaries still unset lie inside groups of equal
   windows; all but the first of a group are removed. A gram with over HOT contexts (the edge of a passage that
   very many texts share) is decided by aggregating the digests of its windows instead, and a bucket is taken some
   grams at a time, so no suffix array grows unbounded.
4. The removed spans go back to the texts by their keys (id and text digest, see `doc_key`).

Order is by id, then position. Defined results: a null text is empty; a null id comes before all; rows that repeat an
id and a text are one document (each row gets its result); rows with one id and different texts are documents of their
own, in the order of their texts' digests; texts under LENGTH bytes lose nothing; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import MIN_LONG, Work, arrow_slices, table

LENGTH = 100
GRAM = 24
SLICE_BYTES = 512 << 10
#: Texts are taken in pieces of this size (with overlap), so memory does not follow the longest text.
PIECE_BYTES = 4 << 20
BUCKET_BYTES = 512 << 10
#: Contexts of one gram that one bucket takes: 355 bytes each at most. A bucket may get several such grams, so a suffix
#: array takes as many grams as fit BUCKET_BYTES, one at least: about 1.5 MB at most, at some 54 times that in memory.
HOT = 4096
#: Bytes of texts whose anchors are ordered and sent together, whatever an Arrow batch holds.
SENT_BYTES = 8 << 20
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

#: Share of the texts in which common grams are looked for, contexts there that make one common, and grams kept at most.
SAMPLE, COMMON, KEPT_GRAMS = 1 / 64, 48, 1024

# `place` packs one anchor: 34 bits of position, 8 bits of anchor - first start, 8 bits of last start - first start; bit
# 62 marks anchors of common grams on their way to the others.
OF_COMMON = 1 << 62
# A document is two longs (id, mark), the parts of its key, in whose order documents are.
DOC = ["id", "mark"]
DOC_FIELDS = "id long, mark long"


def unpacked(place):
    """(first start, last start) of packed anchors; numpy arrays or integers."""
    first = (place >> 16) - ((place >> 8) & 255)
    return first, first + (place & 255)


def doc_key(key: Column, text: Column, seed: int) -> Column:
    """16 bytes that stand for an id and a text: the id, so that keys are in the order of ids (null first), and 64 bits
    of the text's digest, other ones for each seed; see `seed_of`."""
    number = F.coalesce(key.cast("long"), F.lit(MIN_LONG)).bitwiseXOR(F.lit(MIN_LONG))
    mark = F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1 + 16 * seed, 16)
    return F.unhex(F.concat(F.lpad(F.hex(number), 16, "0"), mark))


def seed_of(docs: DataFrame, key: str, text: str) -> int:
    """The first seed with which different texts of one id have different keys, told by all 256 bits of their digests.
    It is 0 but for a chance of n * n / 2**65 where n texts share an id."""
    number, digest = F.coalesce(F.col(key).cast("long"), F.lit(MIN_LONG)), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    texts = docs.select(number.alias("id"), digest.alias("digest")).distinct()
    marks = [F.substring("digest", 1 + 16 * seed, 16).alias(f"m{seed}") for seed in range(4)]
    for seed in range(4):
        if texts.select("id", marks[seed]).groupBy("id", f"m{seed}").count().filter("count > 1").isEmpty():
            return seed
    raise ValueError("texts of one id share all parts of their digests")


def key_parts(column):
    """The two longs of each key of an Arrow column, as a (2, n) array."""
    import numpy as np

    words = np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64) ^ np.uint64(1 << 63)
    return words.reshape(-1, 2).T.view(np.int64)


def key_of_parts() -> Column:
    """The key that the two longs stand for."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.col(c).bitwiseXOR(F.lit(MIN_LONG))), 16, "0") for c in DOC]))


def gram_hashes(first, second, third):
    """Hashes of grams from their three 8-byte words."""
    import numpy as np

    grams = (first * np.uint64(_ODD[0])) ^ (second * np.uint64(_ODD[1])) ^ (third * np.uint64(_ODD[2]))
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(_ODD[1])
    return grams


def anchors(data, starts, stops, length: int):
    """Anchors of all windows inside the texts data[starts:stops]; texts stand 16 bytes apart at least.

    Gives (anchor, first start, last start, gram hash, two context hashes) as arrays; `data` ends with 256 spare bytes."""
    import numpy as np

    u64 = np.uint64
    n = len(data) - 256
    word = np.ndarray((n + 224,), "<u8", data, 0, (1,))
    grams = gram_hashes(word[:n], word[8 : n + 8], word[16 : n + 16])
    # The hash's upper half above, the position from the end below: the least key is the rightmost of the least hashes.
    keys = (grams & u64(0xFFFFFFFF00000000)) | (u64(0xFFFFFFFF) - np.arange(n, dtype=u64))
    width, span = 1, length - GRAM + 1
    while width * 2 <= span:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    if width < span:
        keys = np.minimum(keys[: len(keys) - (span - width)], keys[span - width :])
    inside = np.zeros(n + 1, np.int8)
    fits = stops - starts >= length
    np.add.at(inside, starts[fits], 1)
    np.add.at(inside, stops[fits] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside[: len(keys)], dtype=np.int8))
    if not len(windows):
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty, empty, empty
    owner = (u64(0xFFFFFFFF) - (keys[windows] & u64(0xFFFFFFFF))).astype(np.int64)
    new = np.flatnonzero(np.diff(owner) != 0) + 1
    heads, tails = np.concatenate(([0], new)), np.concatenate((new, [len(owner)])) - 1
    at, first, last = owner[heads], windows[heads], windows[tails]
    gram = grams[at]
    size = last - first + length
    masks = np.array([(1 << (8 * b)) - 1 for b in range(9)], u64)
    head = (((at - first) << 8) + (last - first)).astype(u64)
    context, check = head * u64(_ODD[0]), head * u64(_ODD[1])
    for k in range(-(-(2 * length) // 8)):
        left = np.clip(size - 8 * k, 0, 8)
        if not left.any():
            break
        piece = word[np.minimum(first + 8 * k, n + 200)] & masks[left]
        mixed = piece * u64(_ODD[k % 3] + 2 * k)
        context = (context + (mixed ^ (mixed >> u64(32)))) * u64(_ODD[2])
        context ^= context >> u64(33)
        # A second hash of its own: xor before the multiplication, another constant and shift.
        check = (check ^ (piece + u64(_ODD[(k + 1) % 3]))) * u64(_ODD[1] + 4 * k)
        check ^= check >> u64(29)
    return at, first, last, gram.view(np.int64), context.view(np.int64), check.view(np.int64)


def padded(pieces: list[bytes]):
    """The pieces in one array, 16 bytes apart, with the spare bytes that `anchors` wants, and where they stand."""
    import numpy as np

    data = np.frombuffer(bytearray((b"\0" * 16).join(pieces) + b"\0" * 256), np.uint8)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    stops = np.cumsum(sizes + 16) - 16
    return data, stops - sizes, stops


def found_anchors(docs: DataFrame, length: int, common: list[int]) -> DataFrame:
    """(gram, context, check, id, mark, place) for `docs` (doc, text). Rows of one gram have one `gram`, but those of
    the `common` ones, which have one for each context and a marked place; a null context marks a row that is settled."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        np.seterr(over="ignore")
        step = PIECE_BYTES - length + 1
        hot = np.array(sorted(common), np.int64)
        for batch in batches:
            for sent in arrow_slices(batch, "text", SENT_BYTES):
                out, base = [], 0
                for part in arrow_slices(sent, "text", SLICE_BYTES):
                    texts = [t or b"" for t in part.column(1).cast(pa.large_binary()).to_pylist()]
                    cut = [(row, o, t[o : o + PIECE_BYTES]) for row, t in enumerate(texts) for o in range(0, max(1, len(t) - length + 1), step)]
                    data, starts, stops = padded([piece for _, _, piece in cut])
                    at, first, last, gram, context, check = anchors(data, starts, stops, length)
                    which = np.searchsorted(starts, first, side="right") - 1
                    row = np.array([c[0] for c in cut], np.int64)[which]
                    shift = np.array([c[1] for c in cut], np.int64)[which] - starts[which]
                    place = ((at + shift) << 16) | ((at - first) << 8) | (last - first)
                    out.append((gram, context, check, base + row, place))
                    base += len(texts)
                gram, context, check, rows, place = (np.concatenate(c) for c in zip(*out, strict=True))
                parts = key_parts(sent.column(0))[:, rows]
                # Only grams that occur more than once here need an order among their rows.
                by_gram = np.argsort(gram, kind="stable")
                equal = gram[by_gram][1:] == gram[by_gram][:-1]
                several = np.zeros(len(gram), bool)
                several[1:] |= equal
                several[:-1] |= equal
                rest = by_gram[several]
                rest = rest[np.lexsort((place[rest], *parts[::-1, rest], check[rest], context[rest], gram[rest]))]
                order = np.concatenate((by_gram[~several], rest))
                gram, context, check, place, parts = gram[order], context[order], check[order], place[order], parts[:, order]
                again, same = np.zeros(len(gram), bool), np.zeros(len(gram), bool)
                again[1:] = (gram[1:] == gram[:-1]) & (context[1:] == context[:-1]) & (check[1:] == check[:-1])
                same[1:] = again[1:] & (parts[:, 1:] == parts[:, :-1]).all(0) & (place[1:] == place[:-1])
                # Settled rows need no partner: they spread over the shuffle. Rows of common grams meet by context.
                shared = hot[np.searchsorted(hot[:-1], gram)] == gram if len(hot) else np.zeros(len(gram), bool)
                gram = np.where(again, parts[1] + place * _ODD_SIGNED, np.where(shared, (gram ^ context) * _ODD_SIGNED, gram))
                place = np.where(shared, place | OF_COMMON, place)
                keep = ~same
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[keep]), pa.array(context[keep], mask=again[keep]), *(pa.array(c[keep]) for c in (check, *parts, place))],
                    names=["gram", "context", "check", *DOC, "place"],
                )

    return docs.mapInArrow(run, f"gram long, context long, check long, {DOC_FIELDS}, place long")


_ODD_SIGNED = 0x1E3779B97F4A7C15


def common_grams(docs: DataFrame, length: int) -> list[int]:
    """The grams with most contexts in a sample of `docs` (doc, text); a bounded number of them."""
    found = found_anchors(docs.sample(fraction=SAMPLE, seed=1), length, []).filter("context IS NOT NULL")
    counts = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON)
    return [r["gram"] for r in counts.orderBy(F.desc("n"), "gram").limit(KEPT_GRAMS).collect()]


def undecided(found: DataFrame) -> DataFrame:
    """(id, mark, place, settled): anchors whose bytes all go, and the first of each context whose gram has several."""
    from pyspark.sql import Window as W

    by_gram = W.partitionBy("gram")
    in_order = by_gram.orderBy("context", "check", *DOC, "place")
    body, whole = F.struct("context", "check"), F.struct(*DOC, "place")
    marked = (
        found.withColumn("before", F.lag(F.struct(body.alias("body"), whole.alias("whole"))).over(in_order))
        .withColumn("lo", F.min(body).over(by_gram))
        .withColumn("hi", F.max(body).over(by_gram))
    )
    again = F.col("context").isNotNull() & F.coalesce(F.col("before.body") == body, F.lit(False))
    same = again & (F.col("before.whole") == whole)
    settled = F.col("context").isNull() | again
    several = (F.col("lo") != F.col("hi")) | (F.col("place") >= OF_COMMON)
    return marked.filter(~same & (settled | several)).select(*DOC, F.col("place").bitwiseAND(F.lit(OF_COMMON - 1)).alias("place"), settled.alias("settled"))


def contexts(docs: DataFrame, open_rows: DataFrame, length: int) -> DataFrame:
    """(gram, id, mark, place, context): the bytes of each row of `open_rows` (id, mark, place), and its gram's hash."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        np.seterr(over="ignore")
        for batch in batches:
            for part in arrow_slices(batch, "text", 2 * SLICE_BYTES):
                place = part.column(2).flatten().to_numpy(zero_copy_only=False)
                texts = [t or b"" for t in part.column(1).cast(pa.large_binary()).to_pylist()]
                text = np.repeat(np.arange(len(texts)), np.diff(part.column(2).offsets.to_numpy()))
                first, last = unpacked(place)
                bodies = [texts[t][a : b + length] for t, a, b in zip(text.tolist(), first.tolist(), last.tolist(), strict=True)]
                data = np.frombuffer(b"".join(bodies), np.uint8)
                word = np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,))
                ends = np.cumsum(np.fromiter(map(len, bodies), np.int64, len(bodies)))
                at = np.concatenate(([0], ends))[: len(bodies)] + ((place >> 8) & 255)
                gram = gram_hashes(word[at], word[at + 8], word[at + 16]).view(np.int64)
                keys = [pa.array(c[text]) for c in key_parts(part.column(0))]
                yield pa.RecordBatch.from_arrays([pa.array(gram), *keys, pa.array(place), pa.array(bodies, pa.binary())], names=["gram", *DOC, "place", "context"])

    wanted = open_rows.groupBy(*DOC).agg(F.collect_list("place").alias("places"))  # as many as one text has
    # Rows that repeat an id and a text are read once, so that a context is one occurrence.
    once = docs.dropDuplicates(["doc"])
    joined = once.join(wanted.select(key_of_parts().alias("doc"), "places").hint("merge"), "doc")
    return joined.select("doc", "text", "places").mapInArrow(run, f"gram long, {DOC_FIELDS}, place long, context binary")


def suffix_order(text, depth: int):
    """Rotations of `text` sorted by their first `depth` bytes at least (ties in any order)."""
    import numpy as np

    n = len(text)
    twice = np.concatenate((text, np.resize(text, 8)))
    rank = np.ndarray((n,), ">u8", twice, 0, (1,)).astype(np.uint64)
    width = 8
    while True:
        order = np.argsort(rank).astype(np.int32)
        if width >= depth:
            return order
        in_order = rank[order]
        new = in_order[1:] != in_order[:-1]
        del in_order
        dense = np.zeros(n, np.int32)
        dense[order[1:]] = np.cumsum(new, dtype=np.int32)
        if dense[order[-1]] == n - 1:
            return order
        rank[:] = dense
        rank *= np.uint64(n)
        rank += np.roll(dense, -width % n).astype(np.uint32)
        width *= 2


def equal_groups(text, order, length: int):
    """True at i where the suffixes order[i-1] and order[i] differ within `length` bytes.

    Intervals of the Burrows-Wheeler transform are extended backwards breadth-first. The interval of a string w lists
    the suffixes that start with w; a step reads the characters before them, and the runs of each character are the
    intervals of the strings one longer. The end of such a run is a boundary whose common prefix is len(w), unless a
    shorter w has set it. So common prefixes appear by increasing value, and the search stops at `length` - 1."""
    import numpy as np

    n = len(text)
    bwt = text[order - 1]  # rotations: the first is preceded by the last
    before = np.argsort(bwt, kind="stable").astype(np.int32)  # for each place of the sorted column, the row of the transform it comes from
    column = bwt[before]
    step = np.empty(n, np.int32)
    step[before] = np.arange(n, dtype=np.int32)
    differ = np.zeros(n + 1, bool)
    differ[0] = differ[n] = True
    lo, hi = np.array([0], np.int32), np.array([n], np.int32)
    for _ in range(length):
        size = hi - lo
        total = int(size.sum(dtype=np.int64))
        if not total:
            break
        if total * 6 > n:  # most rows are in play: mark them all and read the runs off the sorted column
            mark = np.zeros(n + 1, np.int32)
            mark[lo] = 1
            ids = np.cumsum(mark[:n], dtype=np.int32)
            cover = np.zeros(n + 1, np.int32)
            np.add.at(cover, lo, 1)
            np.add.at(cover, hi, -1)
            ids[np.cumsum(cover[:n], dtype=np.int32) == 0] = 0
            del mark, cover
            seen = ids[before]
            edge = (np.flatnonzero((seen[1:] != seen[:-1]) | (column[1:] != column[:-1])) + 1).astype(np.int32)
            heads = np.concatenate((np.zeros(1, np.int32), edge))
            tails = np.concatenate((edge, np.array([n], np.int32)))
            live = seen[heads] > 0
            heads, tails = heads[live], tails[live]
        else:
            starts = np.cumsum(size) - size
            rows = np.arange(total) - np.repeat(starts - lo, size)
            sorted_steps = np.sort(step[rows])
            # Runs of neighbours in the sorted column with one character and one interval.
            owner = np.searchsorted(np.sort(lo), before[sorted_steps], side="right")
            chars = column[sorted_steps]
            edge = np.flatnonzero((owner[1:] != owner[:-1]) | (chars[1:] != chars[:-1])) + 1
            heads = sorted_steps[np.concatenate(([0], edge))]
            tails = sorted_steps[np.concatenate((edge, [total])) - 1] + 1
        new = ~differ[tails]
        differ[tails[new]] = True
        lo, hi = heads[new], tails[new]
    return differ[:n]


def repeated_windows(bodies: list[bytes], length: int):
    """Numbers (text, start) of the windows of `bodies` that equal an earlier one; bodies are in corpus order."""
    import numpy as np

    data = np.frombuffer(b"".join(bodies), np.uint8)
    unused = np.flatnonzero(np.bincount(data, minlength=256) == 0)
    mark = bytes([int(unused[-1])])  # UTF-8 leaves some byte values unused
    text = np.frombuffer(mark.join(bodies) + mark, np.uint8)
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    begins = np.cumsum(sizes + 1) - sizes - 1
    order = suffix_order(text, length)
    differ = equal_groups(text, order, length)
    heads = np.flatnonzero(differ)
    counts = np.diff(np.concatenate((heads, [len(order)])))
    earliest = np.repeat(np.minimum.reduceat(order, heads), counts)
    later = order[(order != earliest)]
    which = np.searchsorted(begins, later, side="right") - 1
    start = later - begins[which]
    whole = start + length <= sizes[which]
    return which[whole], start[whole]


def bucket_spans(length: int):
    """For applyInArrow: a bucket's contexts to spans (id, mark, start, stop). Equal windows have one gram, so a suffix
    array is made of whole grams, as many as fit BUCKET_BYTES."""
    most = BUCKET_BYTES

    def run(bucket):
        import numpy as np
        import pyarrow as pa

        parts = [bucket.column(c).to_numpy() for c in DOC]
        place, gram = bucket.column("place").to_numpy(), bucket.column("gram").to_numpy()
        first, last = unpacked(place)
        order = np.lexsort((first, *parts[::-1], gram))
        parts, first, last, gram = [c[order] for c in parts], first[order], last[order], gram[order]
        # Numbers of contexts and bytes up to the end of each gram.
        grams = np.append(np.flatnonzero(gram[1:] != gram[:-1]) + 1, len(gram))
        sums = np.cumsum(last - first + length)[grams - 1]
        found, row, done = [np.empty(0, np.int64)], 0, 0
        while row < len(gram):
            end = max(int(np.searchsorted(sums, done + most, side="right")) - 1, int(np.searchsorted(grams, row, side="right")))
            stop = int(grams[end])
            which, start = repeated_windows(bucket.column("context").take(pa.array(order[row:stop])).to_pylist(), length)
            found.append((row + which) * (1 << 20) + start)
            row, done = stop, int(sums[end])
        at = np.sort(np.concatenate(found))
        fresh = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        ends = np.concatenate((fresh[1:], [len(at)])) - 1 if len(at) else fresh
        run_first, run_last, owner = at[fresh] & 0xFFFFF, at[ends] & 0xFFFFF, at[fresh] >> 20
        spans = {"start": first[owner] + run_first, "stop": first[owner] + run_last + length}
        return pa.table({**{c: v[owner] for c, v in zip(DOC, parts, strict=True)}, **spans})

    return run


SPANS = f"{DOC_FIELDS}, start long, stop long"


def hot_spans(hot: DataFrame, length: int) -> DataFrame:
    """Spans of repeated windows for contexts of very common grams, by digests of single windows."""

    def windows(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):  # up to 224 windows each
                part = batch.slice(at, 1000)
                digests, row, starts = [], [], []
                for i, (place, body) in enumerate(zip(part.column("place").to_pylist(), part.column("context").to_pylist(), strict=True)):
                    first, last = unpacked(place)
                    for o in range(last - first + 1):
                        digests.append(hashlib.blake2b(body[o : o + length], digest_size=16).digest())
                        row.append(i)
                        starts.append(first + o)
                take = pa.array(np.array(row, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), *(part.column(c).take(take) for c in DOC), pa.array(starts, pa.int64())], names=["digest", *DOC, "start"]
                )

    rows = hot.mapInArrow(windows, f"digest binary, {DOC_FIELDS}, start long")
    whole = F.struct(*DOC, "start")
    first = rows.groupBy("digest").agg(F.min(whole).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(first.select("digest", "first"), "digest").filter(whole != F.col("first")).select(*DOC, "start", (F.col("start") + length).alias("stop"))


def removed_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, mark, start, stop), overlapping, for `docs` (doc, text): the bytes to remove. Written down."""
    if not GRAM + 8 <= length <= GRAM + 255:
        raise ValueError(f"length must be {GRAM + 8} to {GRAM + 255}")
    work = Work(docs.sparkSession, "suffix")
    rows = work.saved(undecided(found_anchors(docs, length, common_grams(docs, length))), "anchors")
    place = F.col("place")
    at = F.shiftright(place, 16) - F.shiftright(place, 8).bitwiseAND(F.lit(255))
    settled = rows.filter("settled").select(*DOC, at.alias("start"), (at + place.bitwiseAND(F.lit(255)) + length).alias("stop"))
    open_rows = rows.filter("not settled")
    size = open_rows.agg(F.sum(place.bitwiseAND(F.lit(255)) + length)).first()[0] or 0
    bodies = work.saved(contexts(docs, open_rows.select(*DOC, "place"), length), "contexts")
    # Few grams are hot; written down, they meet the rows in a join that can split a hot gram's rows.
    hot = work.saved(bodies.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("gram"), "hot")
    buckets = max(1, -(-size // BUCKET_BYTES))
    compared = (
        bodies.join(hot, "gram", "left_anti")
        .select(F.pmod(F.xxhash64("gram"), F.lit(buckets)).alias("bucket"), "gram", *DOC, "place", "context")
        .groupBy("bucket")
        .applyInArrow(bucket_spans(length), SPANS)
    )
    spans = work.saved(settled.unionByName(compared).unionByName(hot_spans(bodies.join(hot, "gram", "left_semi"), length)), "spans")
    work.drop("anchors", "hot", "contexts")
    return spans


def cut_rows(docs: DataFrame, key: str, text: str, length: int, with_text: bool, keep: list[str]) -> DataFrame:
    """(carried, n_bytes, n_removed, n_spans, kept_sha256, [kept]) for every row: `carried` is a struct of the key and
    the columns that `keep` names; `kept` is the text without its removed bytes (a character cut in two goes whole)."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in arrow_slices(batch, "text", 8 * SLICE_BYTES):
                sizes, removed, runs, digests, kept = [], [], [], [], []
                texts = part.column(0).cast(pa.large_binary())
                for body, spans in zip(texts.to_pylist(), part.column(1), strict=True):
                    raw = body or b""
                    gone = n_runs = 0
                    left = raw
                    if spans.is_valid:
                        values = spans.values
                        a, b = (values.field(f).to_numpy(zero_copy_only=False) for f in ("start", "stop"))
                        depth = np.zeros(len(raw) + 1, np.int64)
                        np.add.at(depth, a, 1)
                        np.add.at(depth, b, -1)
                        out = np.cumsum(depth[:-1]) > 0
                        gone, n_runs = int(out.sum()), int(np.count_nonzero(np.diff(out.astype(np.int8), prepend=0) == 1))
                        if gone:
                            left = np.frombuffer(raw, np.uint8)[~out].tobytes()
                    sizes.append(len(raw))
                    removed.append(gone)
                    runs.append(n_runs)
                    digests.append(hashlib.sha256(left).hexdigest())
                    if with_text:
                        kept.append(body if body is None else left.decode("utf-8", "ignore"))
                columns = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests)]
                names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    columns.append(pa.array(kept, pa.string()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays([part.column(2), *columns], names=["carried", *names])

    row = F.struct(F.col(key), *[F.col(c) for c in keep]).alias("carried")
    doc = doc_key(F.col(key), F.col(text), seed_of(docs, key, text)).alias("doc")
    # One row per text with spans: their number is bounded by the text's length.
    spans = removed_spans(docs.select(doc, F.col(text).alias("text")), length).groupBy(*DOC).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = docs.select(doc, F.col(text).alias("text"), row).join(spans.select(key_of_parts().alias("doc"), "spans").hint("merge"), "doc", "left")
    source = joined.select("text", "spans", "carried")
    carried = source.schema["carried"].dataType.simpleString()
    kept = ", kept string" if with_text else ""
    return source.mapInArrow(run, f"carried {carried}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{kept}")


def cut(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    return cut_rows(docs, key, text, length, False, []).select("carried.*", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """`docs` with the removed bytes taken out of its text; all columns stay, n_chars follows the text where present."""
    result = cut_rows(docs, key, text, length, True, [c for c in docs.columns if c not in (key, text)])
    values = {text: F.col("kept")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return result.select(*[values.get(c, F.col("carried")[c]).alias(c) for c in docs.columns])


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(table(spark, sf_dir, "documents").select("doc_id", "text"))


def oracle() -> str:
    """The same bytes by the digests of all windows."""
    return f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, ''))::bigint AS n FROM documents),
w AS (SELECT doc_id, s, md5(array_slice(b, s + 1, s + {LENGTH})) AS h FROM (SELECT doc_id, b, unnest(range(0, n - {LENGTH - 1})) AS s FROM d WHERE n >= {LENGTH})),
r AS (SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1),
i AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run
  FROM (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= {LENGTH} THEN 0 ELSE 1 END AS fresh FROM r)),
u AS (SELECT doc_id, min(s) AS a, max(s) + {LENGTH} AS z FROM i GROUP BY doc_id, run),
c AS (SELECT doc_id, sum(z - a)::bigint AS gone, count(*)::bigint AS runs, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS stops FROM u GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(runs, 0) AS n_spans,
       sha256(CASE WHEN runs IS NULL THEN b ELSE unhex(array_to_string(list_transform(range(0, runs + 1), lambda j: CASE
         WHEN j = runs THEN CASE WHEN stops[j] < n THEN hex(array_slice(b, stops[j] + 1, n)) ELSE '' END
         WHEN j = 0 THEN CASE WHEN starts[1] > 0 THEN hex(array_slice(b, 1, starts[1])) ELSE '' END
         ELSE hex(array_slice(b, stops[j] + 1, starts[j + 1])) END), '')) END) AS kept_sha256
  FROM d LEFT JOIN c USING (doc_id)"""
