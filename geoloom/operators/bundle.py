"""Snapshots of file collections: gathering, naming, rewriting, storing once, describing, verifying, restoring."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import names
from geoloom.operators.ranks import durable, ranked_within, running_sum, with_previous
from geoloom.sources import folders

# --- gathering ----------------------------------------------------------------------------------------------------


def sidecars(sources: DataFrame, listing: DataFrame) -> DataFrame:
    """(path): existing files with a source's stem and a companion extension that are not sources themselves."""
    wanted = sources.select(F.explode(F.transform(F.array(*map(F.lit, names.SIDECAR_EXTENSIONS)), lambda e: F.concat(names.stem(F.col("path")), e))).alias("path"))
    return wanted.join(listing.select("path"), "path", "left_semi").distinct().join(sources.select("path"), "path", "left_anti")


def companions(listing: DataFrame) -> DataFrame:
    """(stem, files): files of one stem in order; as many as a data set has parts."""
    return listing.groupBy(names.stem(F.col("path")).alias("stem")).agg(F.sort_array(F.collect_list("path")).alias("files"))


def missing_files(sources: DataFrame, listing: DataFrame) -> DataFrame:
    return sources.join(listing.select("path"), "path", "left_anti")


def existing_files(sources: DataFrame, listing: DataFrame) -> DataFrame:
    return sources.join(listing.select("path"), "path", "left_semi")


def resolved_sources(layers: DataFrame, listing: DataFrame, project_folder: str, source: str = "source") -> DataFrame:
    """`layers` with `path`: the existing file that the source names, or null."""
    found = layers.withColumn("_path", names.source_path(F.col(source), project_folder))
    there = listing.select(F.col("path").alias("_there")).distinct()
    return found.join(there, F.col("_path") == F.col("_there"), "left").withColumn("path", F.col("_there")).drop("_path", "_there")


def referenced(documents: DataFrame, text: str) -> DataFrame:
    """(ref, n): what src and href attributes name, and how often."""
    refs = documents.select(F.explode(F.regexp_extract_all(text, F.lit('(?:src|href)="([^"]+)"'), 1)).alias("ref"))
    return refs.groupBy("ref").agg(F.count(F.lit(1)).alias("n"))


def first_seen(*frames: DataFrame) -> DataFrame:
    """(path, pos): the union of (path, pos), each path at its least position, lists one after the other."""
    tagged = [f.select("path", F.struct(F.lit(i).alias("list"), F.col("pos").alias("at")).alias("pos")) for i, f in enumerate(frames)]
    union = tagged[0]
    for f in tagged[1:]:
        union = union.unionByName(f)
    return union.groupBy("path").agg(F.min("pos").alias("pos"))


# --- names --------------------------------------------------------------------------------------------------------


def with_folders(files: DataFrame, sources: DataFrame) -> DataFrame:
    """`files` (path, source) with the folder of the source's kind; `sources` has (source, kind); else resources."""
    folder = F.when(F.col("kind").isin("vector", "raster"), F.col("kind")).otherwise("resources")
    return files.join(sources.select("source", "kind"), "source", "left").withColumn("folder", folder).drop("kind")


def bundle_names(files: DataFrame) -> DataFrame:
    """`files` (pos, path, folder) with `name`: folder/basename, or folder/stem_k.ext with the least k >= 1 that is free
    when files take their names in order of pos (unique).

    A basename is met by others in two places only: files of stem `s` take s_1, s_2, ... and the first file of stem s_k
    wants s_k itself. So where `s` has its own plain name, its files' numbers follow from their order and from the first
    files of the stems s_k: number k is passed over by the file that gets to it if the first file of s_k came before.
    Stems are taken level by level (s, then s_k, then s_k_l), numbers of all stems of a level at once by counting the
    numbers passed over; see `passed_over`. As many levels are gone through as the longest chain of such stems has; stems
    that no other could meet are numbered by rank alone."""
    split = files.withColumns({"_base": names.basename(F.col("path")), "_ext": names.extension(F.col("path"))})
    split = split.withColumn("_stem", F.substr("_base", F.lit(1), F.length("_base") - F.length("_ext"))).drop("_base")
    ranked = durable(ranked_within(split, BASE, ["pos"], "_rank").withColumn("_rank", F.col("_rank") - 1))
    stems = ranked.groupBy(*BASE).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    cut = stems.withColumn("_parent", F.regexp_extract("_stem", r"(?s)^(.*)_[1-9]\d{0,17}$", 1)).withColumn("_k", F.regexp_extract("_stem", r"_([1-9]\d{0,17})$", 1))
    children = cut.filter("_k <> ''").select("folder", F.col("_parent").alias("_stem"), "_ext", F.col("_k").cast("long").alias("_k"), "first", F.col("_stem").alias("_child"))
    links = durable(children.join(stems.select(*BASE), BASE, "left_semi"))
    below = links.select("folder", F.col("_child").alias("_stem"), "_ext").distinct()
    # A stem's level, whether its plain name is taken, then what its files passed over.
    level = stems.select(*BASE, "n").join(below, BASE, "left_anti").withColumn("taken", F.lit(0))
    taken_all, passed_all = [], []
    while True:
        here = durable(links.join(level, BASE).withColumn("n", F.col("n") - 1 + F.col("taken")))
        if here.isEmpty():
            break
        met = passed_over(here, ranked.join(here.select(*BASE, "taken").distinct(), BASE).select(*BASE, (F.col("_rank") + F.col("taken")).alias("_i"), "pos"))
        passed_all.append(met.filter("passed").select(*BASE, "_i"))
        children_of = met.select("folder", F.col("_child").alias("_stem"), "_ext", F.when(F.col("reached") & ~F.col("passed"), 1).otherwise(0).alias("taken"))
        taken_all.append(children_of.filter("taken = 1").select(*BASE))
        level = children_of.join(stems.select(*BASE, "n"), BASE)
    rows = ranked.withColumn("_taken", F.lit(0))
    for taken in taken_all:
        rows = rows.join(taken.withColumn("_one", F.lit(1)), BASE, "left").withColumn("_taken", F.col("_taken") + F.coalesce("_one", F.lit(0))).drop("_one")
    rows = rows.withColumn("_i", F.col("_rank") + F.col("_taken"))
    if passed_all:
        passed = passed_all[0]
        for more in passed_all[1:]:
            passed = passed.unionByName(more)
        rows = behind(rows, durable(passed))
    else:
        rows = rows.withColumn("_k", F.col("_i"))
    suffix = F.when(F.col("_k") > 0, F.concat(F.lit("_"), F.col("_k").cast("string"))).otherwise("")
    return rows.withColumn("name", F.concat("folder", F.lit("/"), "_stem", suffix, "_ext")).select(*files.columns, "name")


BASE = ["folder", "_stem", "_ext"]


def passed_over(children: DataFrame, files: DataFrame) -> DataFrame:
    """`children` (base, _k, first, n: files of the base that need a number, _child) with `_i`, the file that gets to
    number _k, `reached` (there is such a file) and `passed` (the child's first file came before it, so it goes on).

    Where b numbers were passed over before, the file that gets to _k is number _k - b. It comes after the child's first
    file if more than `_early` files do not, the files of the base that come before the child's. So one number decides
    on each child, and children stream through in the order of _k with a single count for each base."""
    both = files.filter("_i > 0").withColumn("_one", F.lit(1)).unionByName(
        children.select(*BASE, F.col("first").alias("pos"), "_k", "_child", "n", F.lit(0).alias("_one")), allowMissingColumns=True
    )
    counted = durable(running_sum(both.drop("_i"), "_one", [*BASE, "pos"], "_upto"))
    starts = counted.groupBy(*BASE).agg(F.min("_upto").alias("_start"))
    early = counted.filter("_one = 0").join(starts, BASE).select(*BASE, "_k", "_child", "n", (F.col("_upto") - F.col("_start")).alias("_early"))

    def stream(batches: Iterator) -> Iterator:
        import pyarrow as pa

        base, passed = None, 0
        for batch in batches:
            index, went = [], []
            for *key, k, n, early in zip(*(batch.column(c).to_pylist() for c in (*BASE, "_k", "n", "_early")), strict=True):
                if key != base:
                    base, passed = key, 0
                i = k - passed
                index.append(i)
                went.append(early < i <= n)
                passed += went[-1]
            columns = {**{c: batch.column(c) for c in (*BASE, "_child", "n")}, "_i": pa.array(index, pa.int64()), "passed": pa.array(went, pa.bool_())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    fields = ", ".join(f"{c} {dict(early.dtypes)[c]}" for c in (*BASE, "_child", "n"))
    met = early.repartition(*BASE).sortWithinPartitions(*BASE, "_k").mapInArrow(stream, f"{fields}, _i long, passed boolean")
    return durable(met.select(*BASE, "_child", "_i", (F.col("_i") <= F.col("n")).alias("reached"), "passed"))


def behind(rows: DataFrame, passed: DataFrame) -> DataFrame:
    """`rows` with `_k`: their `_i` and as many as the numbers that files up to them passed over."""
    bases = passed.select(*BASE).distinct()
    alone = rows.join(bases, BASE, "left_anti").withColumn("_k", F.col("_i"))
    some = rows.join(bases, BASE, "left_semi")
    both = some.withColumn("_flag", F.lit(0)).unionByName(passed.withColumn("_flag", F.lit(1)), allowMissingColumns=True).withColumn("_after", 1 - F.col("_flag"))
    summed = durable(running_sum(both, "_flag", [*BASE, "_i", "_after"], "_upto"))
    starts = summed.groupBy(*BASE).agg(F.min("_upto").alias("_start"))
    counted = summed.filter("_flag = 0").join(starts, BASE).withColumn("_k", F.col("_i") + F.col("_upto") - F.col("_start"))
    return alone.unionByName(counted.select(alone.columns))


# --- references ---------------------------------------------------------------------------------------------------


def rewritten(text: Column, pairs: Column, compat: bool = False) -> Column:
    """References replaced by `pairs` (array of struct<f, t>, bounded by the caller).

    In two passes, longest first: originals become numbered marks, marks become targets, so a pair cannot hit part of
    a longer path or another pair's target. With `compat`, plain replacement in list order."""
    if compat:
        return F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p["f"], p["t"]))
    ordered = F.transform(F.reverse(F.array_sort(F.transform(pairs, lambda p: F.struct(F.length(p["f"]).alias("n"), p["f"].alias("f"), p["t"].alias("t"))))), lambda p, i: F.struct(p["f"].alias("f"), p["t"].alias("t"), F.concat(F.lit("\x01"), i.cast("string"), F.lit("\x02")).alias("m")))
    marked = F.aggregate(ordered, text, lambda acc, p: F.replace(acc, p["f"], p["m"]))
    return F.aggregate(ordered, marked, lambda acc, p: F.replace(acc, p["m"], p["t"]))


def rewrite_attributes(documents: DataFrame, pairs: DataFrame, key: str, text: str) -> DataFrame:
    """Rewriting by many pairs (f, t): references are taken out of src and href attributes, joined, and only a
    document's own pairs are replaced in it, attribute and quotes included, so no path can hit part of another."""
    refs = documents.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit('(?:src|href)="([^"]+)"'), 1))).alias("f"))
    # Written down, so that the join has exchanges of its own and a very popular reference can be split.
    own = refs.join(durable(pairs), "f").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("pairs"))  # one document's
    one = lambda acc, p, name: F.replace(acc, F.concat(F.lit(f'{name}="'), p["f"], F.lit('"')), F.concat(F.lit(f'{name}="'), p["t"], F.lit('"')))
    done = F.aggregate("pairs", F.col(text), lambda acc, p: one(one(acc, p, "src"), p, "href"))
    return documents.join(own, key, "left").withColumn(text, F.when(F.col("pairs").isNull(), F.col(text)).otherwise(done)).drop("pairs")


def absolute_flag(text: Column, absolute: bool = True) -> Column:
    """The project's flag for relative paths set to absolute, or back."""
    if not absolute:
        return F.replace(text, F.lit('<Relative type="int">2</Relative>'), F.lit('<Relative type="int">0</Relative>'))
    return F.regexp_replace(text, r'<Relative type="int">[01]</Relative>', '<Relative type="int">2</Relative>')


# --- storing ------------------------------------------------------------------------------------------------------


#: Bytes of contents that a task hands over at a time, but for a larger content.
AT_ONCE = 4 << 20


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(name, content, size) of all files below a folder, empty ones too. The listing is dealt to tasks, so that neither
    the driver nor the plan follows the number of files; Spark's own reader lists on the driver and counts each file as
    4 MB, which makes a task of every thirty small ones."""

    def run(batches: Iterator) -> Iterator:
        import posixpath

        import pyarrow as pa

        store, folder = folders.store_of(root)
        for batch in batches:
            held, size = [], 0
            for name in batch.column(0).to_pylist():
                with store.open_input_file(posixpath.join(folder, name)) as f:
                    content = f.read()
                held.append((name, content, len(content)))
                size += len(content)
                if size >= AT_ONCE:
                    yield made(held, pa)
                    held, size = [], 0
            if held:
                yield made(held, pa)

    def made(rows: list, pa):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary(), pa.int64()))], names=["name", "content", "size"])

    return folders.dealt(spark, root).mapInArrow(run, "name string, content binary, size long")


def in_path_order(files: DataFrame) -> DataFrame:
    """Files sorted by name."""
    return files.orderBy("name")


def hashed(entries: DataFrame) -> DataFrame:
    """(name, hash, raw_size): the contents are read once and stay where they are."""
    return entries.select("name", F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("long").alias("raw_size"))


def index(entries: DataFrame) -> DataFrame:
    """(name, hash, raw_size, stored_as, is_stored, offset): each content is stored at its first name; offsets run over
    the stored contents in order of name."""
    return _indexed(hashed(entries))


def _indexed(rows: DataFrame) -> DataFrame:
    first = rows.groupBy("hash").agg(F.min("name").alias("stored_as"), F.first("raw_size").alias("size"))
    stored = running_sum(first, "size", ["stored_as"], "offset").select("hash", "stored_as", "offset")
    return rows.join(stored, "hash").select("name", "hash", "raw_size", "stored_as", (F.col("name") == F.col("stored_as")).alias("is_stored"), "offset")


def totals(indexed: DataFrame) -> DataFrame:
    """(entries, raw_bytes, stored_bytes, duplicates, ratio)"""
    sums = indexed.agg(
        F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("raw_size"), F.lit(0)).alias("raw_bytes"),
        F.coalesce(F.sum(F.when(F.col("is_stored"), F.col("raw_size"))), F.lit(0)).alias("stored_bytes"), F.count_if(~F.col("is_stored")).alias("duplicates"),
    )
    return sums.withColumn("ratio", F.round(F.col("raw_bytes") / F.nullif("stored_bytes", F.lit(0)), 6))


def blobs(entries: DataFrame) -> DataFrame:
    """(hash, content, raw_size), each content once; of equal contents one a task leaves it."""
    kept = entries.groupBy(F.sha2("content", 256).alias("hash")).agg(F.min_by("content", "name").alias("content"))
    return kept.select("hash", "content", F.octet_length("content").cast("long").alias("raw_size"))


#: Bytes of a row group of contents: what the look-up of one entry reads at most, but for a larger content.
ROW_GROUP = 16 << 20


def pack(
    entries: DataFrame, path: str, dependencies: DataFrame | None = None, rewrites: DataFrame | None = None, created: str = "", plugin_version: str = "", row_group: int = ROW_GROUP
) -> None:
    """Three tables below `path`: blobs, index (sorted by name), manifest. Blobs lie by hash within their files and have
    Bloom filters of it, so that a look-up opens the row group of its content. Contents are read twice: to be hashed, and
    to be stored; index and manifest come from the hashes."""
    rows = durable(hashed(entries))
    out = lambda df, table: df.write.option("compression", "zstd").parquet(f"{path}/{table}")
    contents = blobs(entries).sortWithinPartitions("hash").write.option("compression", "zstd").option("parquet.block.size", row_group)
    contents.option("parquet.bloom.filter.enabled#hash", "true").parquet(f"{path}/blobs")
    out(_indexed(rows).repartitionByRange("name").sortWithinPartitions("name"), "index")
    out(_described(rows), "manifest")
    if dependencies is not None:
        out(dependencies, "dependencies")
    if rewrites is not None:
        out(rewrites, "rewrites")


def open_bundle(spark: SparkSession, path: str) -> DataFrame:
    """(name, content, hash, raw_size) of a packed snapshot."""
    return spark.read.parquet(f"{path}/index").select("name", "hash", "raw_size").join(spark.read.parquet(f"{path}/blobs").select("hash", "content"), "hash")


def entry(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(name, content) of one entry, in two steps: its hash from the index that is sorted by name, then the content by
    the hash as a constant, which statistics and Bloom filters of the blobs are held against."""
    found = spark.read.parquet(f"{path}/index").filter(F.col("name") == name).select("hash").distinct().collect()  # of one name
    contents = spark.read.parquet(f"{path}/blobs").filter(F.col("hash").isin([r["hash"] for r in found]))
    return contents.select(F.lit(name).alias("name"), "content")


def verified(indexed: DataFrame, stored: DataFrame) -> DataFrame:
    """(name, problem): entries whose content is missing, of another size, or of another hash. None is the good case."""
    again = stored.select("hash", F.sha2("content", 256).alias("_hash"), F.octet_length("content").cast("long").alias("_size"))
    problem = F.when(F.col("_hash").isNull(), "missing").when(F.col("_size") != F.col("raw_size"), "size").when(F.col("_hash") != F.col("hash"), "hash")
    return indexed.join(again, "hash", "left").select("name", problem.alias("problem")).filter("problem IS NOT NULL")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, side): entries (name, content) that are in one only; empty where both are equal."""
    x, y = hashed(a), hashed(b)
    return x.exceptAll(y).select("name", F.lit("left").alias("side")).unionByName(y.exceptAll(x).select("name", F.lit("right").alias("side")))


def restore(bundle: DataFrame, folder: str) -> int:
    """Write every entry of `bundle` (name, content) below `folder` and give their number. Names that leave the folder
    are refused before anything is written. A task writes each file under a name of its own and then renames it, so a
    retried task does no harm."""
    bad = bundle.filter(F.col("name").startswith("/") | F.array_contains(F.split("name", "/"), "..")).select("name").take(1)
    if bad:
        raise ValueError(f"entry leaves the folder: {bad[0]['name']}")

    def write(batches: Iterator) -> Iterator:
        import posixpath
        import uuid

        import pyarrow as pa

        store, root = folders.store_of(folder)
        there = set()
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = posixpath.join(root, name)
                if posixpath.dirname(path) not in there:
                    store.create_dir(posixpath.dirname(path), recursive=True)
                    there.add(posixpath.dirname(path))
                part = f"{path}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as f:
                    f.write(content or b"")
                store.move(part, path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return bundle.select("name", "content").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


# --- the manifest -------------------------------------------------------------------------------------------------

MANIFEST_SCHEMA = (
    "version int, created string, plugin_version string, entries map<string,struct<type:string,size:bigint,hash:string>>, "
    "dependencies map<string,array<string>>, uri_rewrites map<string,string>"
)


def manifest_entries(entries: DataFrame) -> DataFrame:
    """(name, type, size, hash)"""
    return _described(hashed(entries))


def _described(rows: DataFrame) -> DataFrame:
    return rows.select("name", names.entry_type(F.col("name")).alias("type"), F.col("raw_size").alias("size"), "hash")


def dependencies(files: DataFrame) -> DataFrame:
    """(primary, companions) from (source, pos, name): the first file of a source and the others in order."""
    lists = files.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("l"))  # one data set's files
    ordered = F.transform("l", lambda x: x["name"])
    return lists.select(F.get(ordered, 0).alias("primary"), F.slice(ordered, F.lit(2), F.size("l")).alias("companions"))


def manifest_json(described: DataFrame, depends: DataFrame, rewrites: DataFrame, created: str, plugin_version: str, most: int = 1_000_000) -> DataFrame:
    """(manifest): one JSON document of (name, type, size, hash), (primary, companions) and (uri, path).

    A single document is the format; for collections of more than `most` entries see `manifest_fragments`, or keep the
    tables that `pack` writes."""
    if described.count() > most:
        raise ValueError(f"a manifest of more than {most} entries stays in tables")
    e = described.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", F.struct("type", "size", "hash"))))).alias("entries"))
    d = depends.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("primary", "companions")))).alias("dependencies"))
    r = rewrites.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("uri", "path")))).alias("uri_rewrites"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    joined = one(e).join(one(d), "_one").join(one(r), "_one")
    return joined.select(
        F.to_json(F.struct(F.lit(4).alias("version"), F.lit(created).alias("created"), F.lit(plugin_version).alias("plugin_version"), "entries", "dependencies", "uri_rewrites")).alias("manifest")
    )


def manifest_fragments(described: DataFrame, depends: DataFrame, rewrites: DataFrame, created: str, plugin_version: str) -> DataFrame:
    """(section, name, fragment): the document of `manifest_json` in pieces, an entry a row, in the order of section and
    name; strung together they are the document, however many there are."""
    spark = described.sparkSession
    text = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    pair = lambda section, key, value: (F.lit(section).alias("section"), F.col(key).alias("name"), F.concat(text(F.col(key)), F.lit(":"), value).alias("fragment"))
    members = described.select(*pair(1, "name", F.to_json(F.struct("type", "size", "hash"))))
    members = members.unionByName(depends.select(*pair(3, "primary", F.to_json("companions")))).unionByName(rewrites.select(*pair(5, "uri", text(F.col("path")))))
    ordered = with_previous(members, ["section"], ["name"], ["name"])
    joined = ordered.withColumn("fragment", F.concat(F.when(F.col("prev_name").isNull(), "").otherwise(","), "fragment")).select("section", "name", "fragment")
    head = F.concat(F.lit('{"version":4,"created":'), text(F.lit(created)), F.lit(',"plugin_version":'), text(F.lit(plugin_version)), F.lit(',"entries":{'))
    frame = {0: head, 2: F.lit('},"dependencies":{'), 4: F.lit('},"uri_rewrites":{'), 6: F.lit("}}")}
    between = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(i).alias("section"), F.lit(None).cast("string").alias("name"), v.alias("fragment")) for i, v in frame.items()])).alias("x"))
    return joined.unionByName(between.select("x.*"))


def write_manifest(fragments: DataFrame, path: str) -> None:
    """The document as text files whose lines, one file after another, are its pieces in order."""
    fragments.repartitionByRange("section", "name").sortWithinPartitions("section", "name").select("fragment").write.text(path)


def read_written(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(version, name, type, size, hash) of the entries and (uri, path) of the rewrites of a document that
    `write_manifest` wrote, piece by piece: what follows a piece's key tells its section, and no row holds more."""
    lines = spark.read.text(path)
    version = F.from_json(F.concat("value", F.lit("}}")), "version int")["version"]
    head = lines.filter(F.col("value").startswith('{"version":')).select(version.alias("version"))
    member = F.regexp_replace("value", "^,", "")
    pieces = lines.select(member.alias("value")).withColumn("_kind", F.regexp_extract("value", r'^"(?:[^"\\]++|\\.)*+":(.)', 1))
    of = lambda kind, value: pieces.filter(F.col("_kind") == kind).select(F.explode(F.from_json(F.concat(F.lit("{"), "value", F.lit("}")), f"map<string,{value}>")))
    entries = of("{", "struct<type:string,size:bigint,hash:string>").select(F.col("key").alias("name"), "value.*")
    return entries.crossJoin(F.broadcast(head)), of('"', "string").select(F.col("key").alias("uri"), F.col("value").alias("path"))


def read_manifest(df: DataFrame, content: str = "content") -> DataFrame:
    """`df` with `manifest`; null where the text is none."""
    return df.withColumn("manifest", F.from_json(F.decode(content, "UTF-8"), MANIFEST_SCHEMA, {"mode": "PERMISSIVE"}))


def original_paths(described: DataFrame, rewrites: DataFrame) -> DataFrame:
    """(name, path): where an entry came from."""
    return described.select("name").join(rewrites.select(names.from_bundle_uri(F.col("uri")).alias("name"), "path"), "name")
