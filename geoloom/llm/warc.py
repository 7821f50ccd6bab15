"""WARC: archives written by Spark's text sink and read by a PySpark Python data source.

Writing is native: a record is one string and the records' blank-line ends are the sink's line separator, so Spark's
commit protocol keeps retried tasks from leaving half files, on any store. A record of equal payload is a revisit of
the one with the largest id and holds HTTP headers only.

Reading: the source plans partitions of whole files, as many as the session has cores where the files allow it and up
to a target size each, takes predicates on the record type and on
named headers from Spark, parses the headers first and passes over the payload of records that fail them (or of
all, with option payload=false). Plain and gzip files are read.

Defined results: a null html is an empty payload, equal to an empty html; rows that share id and payload with the
response are responses too; a null id is smaller than any; control characters in a url become spaces; files without
a WARC version line raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThanOrEqual,
    StringStartsWith,
)

from geoloom.llm.common import scratch_path, table

SCHEMA = (
    "file string, position long, warc_type string, record_id string, target_uri string, payload_digest string, "
    "refers_to string, content_length long, http_length long, payload binary"
)
#: Columns that headers alone decide.
HEADER_COLUMNS = ("warc_type", "record_id", "target_uri", "payload_digest", "refers_to", "content_length", "http_length")
#: Bytes of files in a partition: at most, and at least where there are more cores than that makes partitions.
TARGET_BYTES, LEAST_BYTES = 128 << 20, 1 << 20
BATCH_BYTES = 8 << 20
RECORD_END = "\r\n\r\n"
PAGE_URN = "urn:geoloom:page:"


# --- reading ---------------------------------------------------------------------------------------------------


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcDataSource(DataSource):
    """spark.read.format("warc").option("path", folder).option("payload", "true"|"false")"""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.target = int(options.get("targetBytes", TARGET_BYTES))
        self.cores = int(options.get("cores", 1))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  (the interface's name)
        kinds = {EqualTo: "=", In: "in", StringStartsWith: "starts", GreaterThanOrEqual: ">=", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in kinds and len(f.attribute) == 1 and f.attribute[0] in HEADER_COLUMNS:
                self.tests.append((kinds[type(f)], f.attribute[0], f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, root = store_of(self.path)
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = [f for f in found if f.type == fs.FileType.File and f.size and not f.base_name.startswith(("_", "."))]
        target = min(self.target, max(LEAST_BYTES, -(-sum(f.size for f in files) // self.cores)))
        groups: list[Files] = []
        room = 0
        for f in sorted(files, key=lambda f: f.path):
            if not groups or room < f.size:
                groups.append(Files([]))
                room = target
            groups[-1].paths.append(f.path)
            room -= f.size
        return groups

    def read(self, partition: Files) -> Iterator:
        import gzip
        import io

        store, _ = store_of(self.path)
        rows: list[tuple] = []
        held = 0
        for path in partition.paths:
            with store.open_input_file(path) as raw:
                stream = io.BufferedReader(raw, 1 << 20)
                if path.endswith(".gz"):
                    stream = gzip.GzipFile(fileobj=stream)
                for row in records(stream, path, self.tests, self.payload):
                    rows.append(row)
                    held += len(row[-1] or b"") + 200
                    if held >= BATCH_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
        if rows:
            yield batch_of(rows)


def store_of(path: str):
    """The file system of an address, and the path in it; Hadoop's own name of the S3 scheme is known."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("s3" + path[3:] if path.startswith("s3a://") else path)


def batch_of(rows: list[tuple]):
    import pyarrow as pa

    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.int64(), pa.binary()]
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def header_block(stream) -> tuple[str, dict[str, str], int]:
    """The first line, the fields (names in lower case; a folded line goes on), and the bytes read."""
    first, fields, name, n = b"", {}, None, 0
    while line := stream.readline():
        n += len(line)
        if line in (b"\r\n", b"\n"):
            if first:
                break
            continue  # blank lines between records
        if not first:
            first = line.strip()
        elif line[:1] in b" \t" and name:
            fields[name] += " " + line.strip().decode("utf-8", "replace")
        else:
            key, _, value = line.partition(b":")
            name = key.strip().lower().decode("utf-8", "replace")
            fields[name] = value.strip().decode("utf-8", "replace")
    return first.decode("utf-8", "replace"), fields, n


def passes(values: dict, tests: list[tuple[str, str, object]]) -> bool:
    for kind, column, wanted in tests:
        have = values[column]
        if have is None:
            return False
        if not (
            (kind == "=" and have == wanted) or (kind == "in" and have in wanted) or (kind == "starts" and have.startswith(wanted))
            or (kind == ">=" and have >= wanted) or (kind == "<=" and have <= wanted)
        ):
            return False
    return True


def skip(stream, n: int) -> None:
    """Go on by n bytes; a seek in plain files, reading in bounded pieces in others."""
    import io

    if isinstance(stream, io.BufferedReader):
        stream.seek(n, 1)
        return
    while n > 0 and (got := len(stream.read(min(n, 1 << 20)))):
        n -= got


def records(stream, path: str, tests, payload: bool) -> Iterator[tuple]:
    position = 0
    while True:
        first, fields, n = header_block(stream)
        if not first:
            return
        if not first.startswith("WARC/"):
            raise ValueError(f"{path}: no WARC version line at byte {position}")
        length = int(fields.get("content-length", 0))
        bare = lambda key: (fields[key].strip("<>") if key in fields else None)
        values = {
            "warc_type": fields.get("warc-type"), "record_id": bare("warc-record-id"), "target_uri": fields.get("warc-target-uri"),
            "payload_digest": fields.get("warc-payload-digest"), "refers_to": bare("warc-refers-to"), "content_length": length, "http_length": None,
        }
        early = [t for t in tests if t[1] != "http_length"]
        read = 0
        if passes(values, early):
            if "application/http" in fields.get("content-type", ""):
                _, http, read = header_block(stream)
                values["http_length"] = int(http["content-length"]) if "content-length" in http else None
            if passes(values, tests):
                body = None
                if payload:
                    body, read = stream.read(length - read), length
                yield (path, position, *values.values(), body)
        skip(stream, length - read)
        position += n + length


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the files below `path`. Predicates reach a Python source only where the session allows it, so
    that setting is switched on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).option("cores", spark.sparkContext.defaultParallelism).load()


# --- writing ---------------------------------------------------------------------------------------------------


def base32_sha1(body: Column) -> Column:
    """SHA-1 of bytes in base 32: four groups of 40 bits, each turned from hexadecimal into eight digits."""
    hexed = F.sha1(body)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, digest, refers_to): the id of the equal payload that stands for this one, or null."""
    body = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), base32_sha1(body).alias("digest"), F.octet_length(body).alias("n"))
    keep = rows.filter(F.col("n") >= least).groupBy("digest").agg(F.max("page_id").alias("keep"))
    other = ~F.col("page_id").eqNullSafe(F.col("keep")) & F.col("keep").isNotNull()
    return rows.join(keep, "digest", "left").withColumn("refers_to", F.when(other, F.col("keep"))).drop("keep")


def record(html: Column, url: Column, page_id: Column, digest: Column, refers_to: Column, date: str) -> Column:
    """A record without its end."""
    revisit = refers_to.isNotNull()
    length = F.octet_length(html).cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length, F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, html))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda value: F.concat(F.lit(f"<{PAGE_URN}"), F.coalesce(value.cast("string"), F.lit("null")), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(page_id)),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace(url, r"[\x00-\x1f]", " ")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(refers_to)), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least: int = 0, codec: str = "gzip") -> None:
    """One record per row of `pages` (page_id, url, html). With codec "none" readers seek past payloads instead of
    inflating them, at three times the space."""
    rows = with_revisits(pages, least)
    texts = rows.select(record(F.col("html"), F.col("url"), F.col("page_id"), F.col("digest"), F.col("refers_to"), date).alias("value"))
    texts.write.option("lineSep", RECORD_END).option("compression", codec).text(path)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    kept = read_warc(spark, path)
    id_of = lambda urn: F.expr(f"try_cast(substr({urn}, {len(PAGE_URN) + 1}) AS BIGINT)")
    full = F.col("warc_type") == "response"
    return kept.select(
        id_of("record_id").alias("page_id"),
        F.when(full, F.octet_length("payload")).otherwise(F.col("http_length")).cast("long").alias("payload_bytes"),
        F.when(full, base32_sha1(F.col("payload"))).otherwise(F.substring("payload_digest", 6, 32)).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        id_of("refers_to").alias("refers_to"),
    )


def oracle() -> str:
    digits = " || ".join(
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {1 + 10 * g}, 10))::bigint >> {35 - 5 * d}) & 31)::int + 1, 1)" for g in range(4) for d in range(8)
    )
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::bigint AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keep FROM p)
SELECT page_id, payload_bytes, {digits} AS payload_digest, CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to FROM k"""
