"""Paths replaced anywhere in texts: one automaton finds all of many paths in one pass over a text.

At each place the longest path that starts there is replaced, from left to right, so a path cannot hit part of a longer
one or another path's target. Pairs are written down in groups of bounded size; tasks read them by file and keep few
automata at a time, so their number has no bound."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.sources import folders
from geoloom.sources.scratch import scratch_path

#: Paths of one automaton, and automata that a Python worker keeps.
GROUP, KEPT = 200_000, 2
_automata: dict[tuple[str, int], object] = {}


def relative_path(path: Column, folder: str) -> Column:
    """A path as seen from a folder, with .. for each step up."""
    parts, base = F.split(F.rtrim(path, F.lit("/")), "/"), folder.rstrip("/").split("/")
    common: Column = F.lit(0)
    for i in reversed(range(len(base))):
        common = F.when(F.get(parts, F.lit(i)) == base[i], common + 1).otherwise(F.lit(0))
    up = F.array_repeat(F.lit(".."), F.lit(len(base)) - common)
    down = F.slice(parts, common + 1, F.greatest(F.size(parts) - common, F.lit(0)))
    return F.array_join(F.concat(up, down), "/")


def path_forms(pairs: DataFrame, project_folder: str | None = None) -> DataFrame:
    """`pairs` (f, t) with f in every form that a project may hold: with forward slashes, and relative to its folder.
    Of several targets of one form the least is taken; empty forms go."""
    plain = pairs.select(F.replace("f", F.lit("\\"), F.lit("/")).alias("f"), "t").filter("f <> '' AND t IS NOT NULL")
    both = plain
    if project_folder:
        both = plain.unionByName(plain.select(relative_path(F.col("f"), project_folder).alias("f"), "t"))
    return both.filter("f <> ''").groupBy("f").agg(F.min("t").alias("t"))


def automaton(root: str, group: int):
    """The automaton of one group of pairs, from its files; None where the hash has left the group empty."""
    import ahocorasick
    import pyarrow.dataset as ds
    from pyarrow.fs import FileType

    if (root, group) not in _automata:
        while len(_automata) >= KEPT:
            _automata.pop(next(iter(_automata)))
        store, path = folders.store_of(f"{root}/part={group}")
        made = ahocorasick.Automaton()
        if store.get_file_info(path).type == FileType.Directory:
            for batch in ds.dataset(path, filesystem=store, format="parquet").to_batches(columns=["f", "t"]):
                for f, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    made.add_word(f, (len(f), t))
        made.make_automaton()
        _automata[root, group] = made if len(made) else None
    return _automata[root, group]


def replaced(text: str, found: dict[int, tuple[int, str]]) -> str:
    """`text` with the matches (start: length, target) replaced from left to right."""
    out, at = [], 0
    for start in sorted(found):
        if start >= at:
            length, target = found[start]
            out += [text[at:start], target]
            at = start + length
    return "".join([*out, text[at:]])


def rewritten_everywhere(documents: DataFrame, pairs: DataFrame, text: str) -> DataFrame:
    """`documents` with every path f of `pairs` (f, t; f distinct and not empty) in the column `text` replaced by t.
    A null text stays null."""
    root = scratch_path(documents.sparkSession, "paths")
    groups = max(1, -(-pairs.count() // GROUP))
    pairs.select("f", "t", F.pmod(F.xxhash64("f"), F.lit(groups)).cast("int").alias("part")).write.partitionBy("part").parquet(root)
    place = documents.columns.index(text)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(place).to_pylist()
            found: list[dict[int, tuple[int, str]]] = [{} for _ in texts]
            for group in range(groups):
                words = automaton(root, group)
                for matches, body in zip(found, texts, strict=True):
                    for end, (length, target) in words.iter(body) if words and body else ():
                        start = end - length + 1
                        if matches.get(start, (0, ""))[0] < length:
                            matches[start] = length, target
            done = [body if not matches else replaced(body, matches) for body, matches in zip(texts, found, strict=True)]
            yield batch.set_column(place, batch.schema.field(place), pa.array(done, batch.schema.field(place).type))

    return documents.mapInArrow(run, documents.schema)
