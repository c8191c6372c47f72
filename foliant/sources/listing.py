"""Readers and writers of file listings, delimited files and JSON manifests, and rules about paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder names that are never listed, besides those that begin with @, . or #.
EXCLUDED_NAMES = ["node_modules", "__pycache__", "lost+found"]
DOCUMENT_EXTENSIONS = ["doc", "docx", "odt", "rtf", "txt", "md", "pdf", "xls", "xlsx", "ods", "csv", "ppt", "pptx", "odp"]


def file_listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified_at_fs, size_bytes) of all files below a folder; contents aren't read. Spark's file source leaves empty files out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select("path", F.unix_timestamp("modificationTime").alias("modified_at_fs"), F.col("length").alias("size_bytes"))


def excluded(path: Column, names: list[str] = EXCLUDED_NAMES, parts: tuple[str, ...] = ()) -> Column:
    """Whether a segment of a path is excluded by name or first character, or the path holds one of ``parts``."""
    out = F.exists(F.split(path, "/"), lambda s: s.isin(names) | s.rlike("^[@.#]"))
    for part in parts:
        out = out | path.contains(part)
    return out


def in_scope(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Files equal to or below one of the roots (column ``root``); blank, relative and top roots count for nothing.

    A path's ancestors are matched against the roots by equality, so any number of roots is one join.
    """
    valid = roots.where("root like '/_%' and root not like '%/'").select(F.col("root").alias("_up")).distinct()
    n = F.size(F.split("path", "/"))
    ups = F.explode(F.transform(F.sequence(F.lit(2), n), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/")))
    inside = files.where("path is not null").select("path", ups.alias("_up")).join(valid, "_up", "left_semi").select("path").distinct()
    return files.join(inside, "path", "left_semi")


def fingerprints(content: DataFrame, prior: DataFrame) -> DataFrame:
    """(path, hash_path, hash_head, content_sha256): the full hash for non-empty documents only, an unchanged file keeps its old one.

    content: path, text, size_bytes, modified_at_fs, extension; prior: path, size_bytes, modified_at_fs, content_sha256.
    """
    old = prior.select("path", F.col("size_bytes").alias("_s"), F.col("modified_at_fs").alias("_m"), F.col("content_sha256").alias("_h"))
    same = (F.col("_s") == F.col("size_bytes")) & (F.col("_m") == F.col("modified_at_fs"))
    full = F.when(F.col("extension").isin(DOCUMENT_EXTENSIONS) & (F.col("size_bytes") > 0), F.coalesce(F.when(same, F.col("_h")), F.sha2("text", 256)))
    joined = content.join(old, "path", "left")
    return joined.select("path", F.sha2("path", 256).alias("hash_path"), F.sha2(F.substring("text", 1, 1024), 256).alias("hash_head"), full.alias("content_sha256"))


def backfill(files: DataFrame, prefix: str) -> DataFrame:
    """Active documents below a prefix that have no full hash yet, as events in order of id."""
    rows = files.where(F.col("deleted_epoch").isNull() & F.col("content_sha256").isNull() & F.col("extension").isin(DOCUMENT_EXTENSIONS) & F.col("path").startswith(prefix + "/"))
    return rows.select("file_id", "path", F.lit("UPSERT").alias("event"), F.lit("hash_backfill").alias("source")).orderBy("file_id")


def write_delimited(df: DataFrame, folder: str, sep: str = ";") -> None:
    """Delimited UTF-8 files with a header and a byte-order mark before its first name."""
    first = df.columns[0]
    df.withColumnRenamed(first, "﻿" + first).write.option("sep", sep).option("header", True).option("lineSep", "\n").mode("error").csv(folder)


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """Delimited files, separated by what their first line holds more of, ; or ,; a byte-order mark is dropped. All strings."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0][:4096] if head else ""
    df = spark.read.option("sep", ";" if line.count(";") >= line.count(",") else ",").option("header", True).option("encoding", "UTF-8").csv(path)
    return df.withColumnsRenamed({c: c.removeprefix("﻿") for c in df.columns})


MANIFEST = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("files", T.ArrayType(T.StructType([T.StructField("file_id", T.LongType()), T.StructField("approval", T.StringType()), T.StructField("path", T.StringType())]))),
    ]
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(version, file_id, approval, path), one row for each listed file of JSON manifests."""
    return _listed(spark.read.option("multiLine", True).schema(MANIFEST).json(path))


def read_manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same of files with one manifest in each line."""
    return _listed(spark.read.schema(MANIFEST).json(path))


def _listed(docs: DataFrame) -> DataFrame:
    return docs.select("version", F.explode("files").alias("f")).select("version", "f.*")


def read_table(spark: SparkSession, url: str, table: str, split_by: str | None = None, parts: int = 8, options: dict[str, str] | None = None) -> DataFrame:
    """A table of a relational database over JDBC, read in ``parts`` ranges of the whole-number column ``split_by``, whose bounds are asked for first."""
    reader = spark.read.format("jdbc").options(url=url, **(options or {}))
    if not split_by:
        return reader.option("dbtable", table).load()
    low, high = reader.option("dbtable", f'(select min("{split_by}") as "low", max("{split_by}") as "high" from {table}) bounds').load().first()
    if low is None:
        return reader.option("dbtable", table).load()
    return reader.options(dbtable=table, partitionColumn=split_by, lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(parts)).load()


def write_table(df: DataFrame, url: str, table: str, mode: str = "error", parts: int = 8, options: dict[str, str] | None = None) -> None:
    """Writes a table of a relational database over JDBC, over ``parts`` connections at most."""
    df.write.format("jdbc").options(url=url, dbtable=table, numPartitions=str(parts), **(options or {})).mode(mode).save()
