"""Text and property extraction from files, one Arrow batch of files at a time."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLAIN = ("txt", "md", "csv")
#: Parts of office files that hold text: the body; shared strings, then strings written in cells; every slide.
PARTS = {"docx": r"word/document\.xml", "xlsx": r"xl/(sharedStrings|worksheets/sheet\d+)\.xml", "pptx": r"ppt/slides/slide\d+\.xml"}
STATS = "path string, size_bytes long, characters long, words long, status string"
DATES = "path string, date_type string, raw string"
_NAMES = {"created": "{http://purl.org/dc/terms/}created", "modified": "{http://purl.org/dc/terms/}modified"}


def _extension(path: str) -> str:
    return path.rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in path.rsplit("/", 1)[-1] else ""


def text_of(path: str, content: bytes) -> tuple[str | None, str]:
    """(text, status) of a file: plain text as UTF-8 or else Windows-1252, the texts of office XML."""
    kind = _extension(path)
    if kind in PLAIN:
        try:
            text = content.decode("utf-8")
        except UnicodeDecodeError:
            text = content.decode("cp1252", "replace")
    elif kind in PARTS:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                names = [n for n in archive.namelist() if re.fullmatch(PARTS[kind], n)]
                roots = [ElementTree.fromstring(archive.read(n)) for n in sorted(names, key=lambda n: (n.count("/"), len(n), n))]
        except (zipfile.BadZipFile, ElementTree.ParseError):
            return None, "error"
        if not roots and kind != "xlsx":
            return None, "error"
        text = " ".join(e.text for root in roots for e in root.iter() if e.tag.rpartition("}")[2] == "t" and e.text)
    else:
        return None, "needs_ocr" if kind in ("pdf", "jpg", "png", "tif") else "skipped"
    return text, "extracted" if text.strip() else "no_text"


def _counts(path: str, content: bytes) -> tuple[str, int, int, int, str]:
    text, status = text_of(path, content)
    return path, len(content), len(text or ""), len((text or "").split()), status


def text_stats(files: DataFrame) -> DataFrame:
    """(path, content) -> characters, words and status of each file."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # One text is held at a time.
            rows = [_counts(p, c) for p, c in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "size_bytes", "characters", "words", "status"])

    return files.select("path", "content").mapInPandas(read, STATS)


def stats_summary(stats: DataFrame) -> DataFrame:
    return stats.groupBy("status").agg(F.count("*").alias("files"), F.sum("characters").alias("characters"), F.sum("words").alias("words"))


def office_dates(files: DataFrame) -> DataFrame:
    """(path, content) of office files -> their created and modified properties as written."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        root = ElementTree.fromstring(archive.read("docProps/core.xml"))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                rows += [(path, kind, e.text) for kind, tag in _NAMES.items() for e in root.iter(tag) if e.text]
            yield pd.DataFrame(rows, columns=["path", "date_type", "raw"])

    return files.select("path", "content").mapInPandas(read, DATES)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
