"""Scan of a mounted file tree as a Spark data source: folders are walked in parallel, and of a file its first bytes are read at most.

Spark's own file source leaves empty files out and knows neither inode nor device. This one lists what a mount shows, to every task that can see it:
``spark.read.format("file_scan").option("path", root).load()``.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from foliant.sources.listing import DOCUMENT_EXTENSIONS, excluded

SCHEMA = "path string, size_bytes long, modified_at_fs long, filesystem_device long, inode long, readable boolean, head binary"
#: Bytes of a file's beginning that are read, and of a digest's reads.
HEAD, PIECE = 1024, 1 << 20


@dataclass
class Folders(InputPartition):
    """Folders to walk: whole trees, or (flat) the files of one folder alone."""

    trees: list[str]
    flat: list[str]


def look(path: str, stat: os.stat_result | None, head: int) -> tuple:
    """A file's row. One whose beginning can't be read isn't readable; one that is gone has no more than its path."""
    if stat is None:
        return (path, None, None, None, None, False, None)
    first, readable = None, True
    if head:
        try:
            with open(path, "rb", buffering=0) as f:
                first = f.read(head)
        except OSError:
            readable = False
    return (path, stat.st_size, int(stat.st_mtime), stat.st_dev, stat.st_ino, readable, first)


def files_in(folder: str, deep: bool) -> Iterator[tuple[str, os.stat_result | None]]:
    """Regular files of a folder, or of its tree; links aren't followed, and a folder that can't be opened has none."""
    waiting = [folder]
    while waiting:
        try:
            entries = sorted(os.scandir(waiting.pop()), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            try:
                if e.is_dir(follow_symlinks=False):
                    if deep:
                        waiting.append(e.path)
                elif e.is_file(follow_symlinks=False):
                    yield e.path, e.stat(follow_symlinks=False)
            except OSError:
                yield e.path, None


class FileScanReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"].removeprefix("file://"))
        self.head = int(options.get("head", HEAD))
        self.parts = int(options.get("partitions", 64))

    def partitions(self) -> list[Folders]:
        """Trees of the first folder level that is wide enough, dealt out in turn; the files above are a part of their own."""
        level, flat = [self.root], []
        while 0 < len(level) < self.parts:
            below = []
            for folder in level:
                flat.append(folder)
                try:
                    below += sorted(e.path for e in os.scandir(folder) if e.is_dir(follow_symlinks=False))
                except OSError:
                    continue
            level = below
        dealt = [level[i :: self.parts] for i in range(min(self.parts, len(level)))]
        return [*[Folders(trees, []) for trees in dealt], *[Folders([], flat[i :: self.parts]) for i in range(min(self.parts, len(flat)))]]

    def read(self, partition: Folders) -> Iterator[tuple]:
        for folders, deep in ((partition.trees, True), (partition.flat, False)):
            for folder in folders:
                for path, stat in files_in(folder, deep):
                    yield look(path, stat, self.head)


class FileScan(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_scan"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FileScanReader:
        return FileScanReader(self.options)


def scan(spark: SparkSession, root: str, head: int = HEAD, partitions: int = 64) -> DataFrame:
    """(path, size_bytes, modified_at_fs, filesystem_device, inode, readable, head) of all files below a mounted folder, empty ones too.

    ``root`` must be mounted wherever tasks run. With ``head`` 0 no file is opened. A folder that isn't there has no files.
    """
    spark.dataSource.register(FileScan)
    return spark.read.format("file_scan").option("path", root).option("head", head).option("partitions", partitions).load()


def _digest(path: str | None) -> str | None:
    if path is None:
        return None
    found = hashlib.sha256()
    try:
        with open(path, "rb", buffering=0) as f:
            while piece := f.read(PIECE):
                found.update(piece)
    except OSError:
        return None
    return found.hexdigest()


def file_fingerprints(scanned: DataFrame, prior: DataFrame) -> DataFrame:
    """(path, hash_path, hash_head, content_sha256): digests of a scan; whole files are read for changed, non-empty documents only.

    prior: path, size_bytes, modified_at_fs, content_sha256. A file with the size and time that it had keeps its digest.
    """
    old = prior.where("path is not null").groupBy("path").agg(F.max(F.struct("modified_at_fs", "size_bytes", "content_sha256")).alias("_o"))
    same = (F.col("_o.size_bytes") == F.col("size_bytes")) & (F.col("_o.modified_at_fs") == F.col("modified_at_fs")) & F.col("_o.content_sha256").isNotNull()
    document = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(DOCUMENT_EXTENSIONS) & (F.col("size_bytes") > 0)
    digest = F.pandas_udf(lambda paths: pd.Series([_digest(p) for p in paths], dtype=object), "string")
    rows = scanned.join(old, "path", "left").withColumn("_kept", F.when(document & same, F.col("_o.content_sha256")))
    read = F.when(document & F.col("_kept").isNull() & F.col("readable"), F.col("path"))
    return rows.select("path", F.sha2("path", 256).alias("hash_path"), F.sha2("head", 256).alias("hash_head"), F.coalesce("_kept", digest(read)).alias("content_sha256"))


def listed(scanned: DataFrame, root: str) -> DataFrame:
    """Files of a scan outside the folders below its root that are never listed."""
    return scanned.where(~excluded(F.substring("path", len(root.rstrip("/")) + 1, 1 << 20)))
