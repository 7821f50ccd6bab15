"""Listing of a folder's files as a Python data source: a partition for each folder in it, and one for its own files."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class Below(InputPartition):
    path: str
    is_folder: bool


def store_of(path: str):
    """The file system of a path or address, and the path in it."""
    from pyarrow import fs

    if "://" not in path:
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class FolderDataSource(DataSource):
    """spark.read.format("folder_listing").option("path", folder): (name, size) of all files below."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return "name string, size long"

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options["path"])


def below(store, root: str, recursive: bool = True) -> Iterator[tuple[str, int | None]]:
    """(path, size) of what lies in a folder, size None for a folder; with `recursive` its files only, at any depth.
    Folders of this machine are gone through entry by entry and never held as a list."""
    import os

    from pyarrow import fs

    if not isinstance(store, fs.LocalFileSystem):
        for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=recursive)):
            if f.type == fs.FileType.File or not recursive:
                yield f.path, f.size if f.type == fs.FileType.File else None
        return
    open_ = [root] if os.path.isdir(root) else []
    while open_:
        with os.scandir(open_.pop()) as entries:
            for e in entries:
                if not e.is_dir():
                    if e.is_file():  # not a link to nowhere
                        yield e.path, e.stat().st_size
                elif recursive:
                    open_.append(e.path)
                else:
                    yield e.path, None


class FolderReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Below]:
        """One for the files that lie in the folder itself, however many, and one for each folder in it."""
        store, root = store_of(self.path)
        folders = sorted(path for path, size in below(store, root, recursive=False) if size is None)
        return [Below(root, False), *(Below(path, True) for path in folders)]

    def read(self, partition: Below) -> Iterator[tuple[str, int]]:
        store, root = store_of(self.path)
        for path, size in below(store, partition.path, partition.is_folder):
            if size is not None:
                yield path[len(root.rstrip("/")) + 1 :], size


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(name, size) of the files below a folder, names relative to it."""
    spark.dataSource.register(FolderDataSource)
    return spark.read.format("folder_listing").option("path", folder).load()


def dealt(spark: SparkSession, folder: str) -> DataFrame:
    """The listing in partitions of about equal numbers of files, for tasks that open them: a single task lists a flat
    folder, but need not read all of it."""
    return listing(spark, folder).repartition(spark.sparkContext.defaultParallelism * 4, "name")
