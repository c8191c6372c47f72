"""Queries of file, manifest, stream and office sources (S), fed from the given tables, with their SQL.

What they read was written by the query itself from the tables, to a folder of the shared scratch.
"""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from foliant.plans.registry import query
from foliant.sources import extract, listing, scan
from foliant.sources.scratch import shared_dir
from foliant.streaming import jobs


def _folder(v) -> str:
    return f"{shared_dir(v.spark)}/foliant-{uuid.uuid4().hex}"


@query("s01_listing", "select 'source=' || source as folder, count(distinct source) as files, sum(length(doc_id::varchar) + 1)::bigint as size_bytes from documents where source is not null group by 1")
def _(v):
    root = f"{_folder(v)}/listed"
    rows = v.documents.where("source is not null").select("source", F.col("doc_id").cast("string").alias("value"))
    rows.repartition("source").write.partitionBy("source").text(root)
    found = listing.file_listing(v.spark, root).where(~listing.excluded(F.regexp_extract("path", "[^/]*$", 0), names=["_SUCCESS"]))
    return found.groupBy(F.regexp_extract("path", "([^/]*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes"))


def _written(v) -> str:
    """A file for each text, empty ones too, below a folder for each source: the tree that the scans below read."""
    root = f"{_folder(v)}/tree".removeprefix("file://")

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, doc_id, text in zip(batch["source"], batch["doc_id"], batch["text"], strict=True):
                os.makedirs(f"{root}/{source}", exist_ok=True)
                with open(f"{root}/{source}/{doc_id}{'.txt' if doc_id % 3 else '.bin'}", "wb") as f:
                    f.write(text.encode())
            yield batch[["doc_id"]]

    rows = v.documents.select(F.coalesce("source", F.lit("none")).alias("source"), "doc_id", F.when(F.col("doc_id") % 50 == 0, "").otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    rows.mapInPandas(written, "doc_id long").agg(F.count("*")).collect()
    return root


#: Below the tree's root, whose place differs from run to run.
BELOW = "select coalesce(source, 'none') || '/' || doc_id || case when doc_id % 3 = 0 then '.bin' else '.txt' end as path, case when doc_id % 50 = 0 then '' else coalesce(text, '') end as body, doc_id from documents"


@query("s01b_scan", f"select path, strlen(body) as size_bytes, true as readable, least(strlen(body), 1024) as head_bytes, 1 as links from ({BELOW})")
def _(v):
    root = _written(v)
    found = scan.listed(scan.scan(v.spark, root), root)
    inodes = found.groupBy("filesystem_device", "inode").agg(F.count("*").cast("int").alias("links"))
    here = found.join(inodes, ["filesystem_device", "inode"])
    return here.select(F.substring("path", len(root) + 2, 1000).alias("path"), "size_bytes", "readable", F.length("head").cast("long").alias("head_bytes"), "links")


@query("s08b_file_fingerprints", f"""select path, sha256(encode(body)[1:1024]) as hash_head, case when path like '%.txt' and body <> '' then case when doc_id % 4 = 1 then 'known' else sha256(body) end end as content_sha256 from ({BELOW})""")
def _(v):
    root = _written(v)
    found = scan.scan(v.spark, root)
    number = F.regexp_extract("path", "/([0-9]+)[.][a-z]+$", 1).cast("long")
    prior = found.where(number % 4 == 1).select("path", "size_bytes", "modified_at_fs", F.lit("known").alias("content_sha256"))
    return scan.file_fingerprints(found, prior).select(F.substring("path", len(root) + 2, 1000).alias("path"), "hash_head", "content_sha256")


@query("s04_event_stream", "select event, stream, count(*) as events, count(distinct path) as paths, sum(event_id)::bigint as ids from stream group by 1, 2")
def _(v):
    base = _folder(v)
    columns = [f.name for f in jobs.EVENTS]
    v.stream.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in jobs.EVENTS]).repartition(4).write.parquet(f"{base}/events")
    stream = jobs.event_source(v.spark, f"{base}/events", per_trigger=2).select(*columns)
    stream.writeStream.format("parquet").option("path", f"{base}/sink").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    seen = v.spark.read.schema(jobs.EVENTS).parquet(f"{base}/sink")
    return seen.groupBy("event", "stream").agg(F.count("*").alias("events"), F.countDistinct("path").alias("paths"), F.sum("event_id").alias("ids"))


@query("s06_delimited", "select file_id::varchar as file_id, path, filename, size_bytes::varchar as size_bytes, mime_type from files")
def _(v):
    folder = f"{_folder(v)}/csv"
    listing.write_delimited(v.files.select("file_id", "path", "filename", "size_bytes", "mime_type"), folder)
    return listing.read_delimited(v.spark, folder)


@query("s07_manifest", "select lang as version, file_id, case when file_id % 4 = 0 then 'pending' else 'approved' end as approval, path from files where lang is not null")
def _(v):
    folder = f"{_folder(v)}/manifests"
    row = F.struct("file_id", F.when(F.col("file_id") % 4 == 0, "pending").otherwise("approved").alias("approval"), "path")
    # A manifest lists about a thousand files.
    rows = v.files.where("lang is not null").select("lang", F.floor(F.col("file_id") / 1000).alias("part"), row.alias("f"))
    rows.groupBy(F.col("lang").alias("version"), "part").agg(F.collect_list("f").alias("files")).drop("part").write.json(folder)
    return listing.read_manifest_lines(v.spark, folder)


@query("s10_dead_letters", """select event_id, array_to_string(list_filter([case when event not in ('CREATE', 'UPSERT', 'MOVE', 'DELETE') then 'event' end, case when not coalesce(starts_with(path, '/'), false) then 'path' end, case when ts is null then 'ts' end, case when event = 'MOVE' and old_path is null then 'old_path' end], lambda x: x is not null), ',') as error
from (select event_id, case when event_id % 10 = 3 then 'RENAME' else event end as event, case event_id % 14 when 5 then null when 6 then substring(path, 2) else path end as path, case when event_id % 9 = 2 then null else ts end as ts, case when event_id % 4 = 1 then null else old_path end as old_path from stream) where error <> ''""")
def _(v):
    k = F.col("event_id")
    broken = v.stream.withColumns({"event": F.when(k % 10 == 3, "RENAME").otherwise(F.col("event")), "path": F.when(k % 14 == 5, None).when(k % 14 == 6, F.expr("substring(path, 2)")).otherwise(F.col("path")), "ts": F.when(k % 9 != 2, F.col("ts")), "old_path": F.when(k % 4 != 1, F.col("old_path"))})
    return jobs.split_valid(broken)[1].select("event_id", "error")


def _office(v):
    """(path, content): a word-processor file for every document, with its text in two paragraphs and its times as properties."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for body, created, modified in zip(batch["body"], batch["created"], batch["modified"], strict=True):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as archive:
                    archive.writestr("word/document.xml", f"<w:d xmlns:w='w'><w:t>{body}</w:t><w:t>last words</w:t></w:d>")
                    archive.writestr("docProps/core.xml", f"<c xmlns:t='http://purl.org/dc/terms/'><t:created>{created}</t:created><t:modified>{modified}</t:modified></c>")
                made.append(held.getvalue())
            yield pd.DataFrame({"path": batch["path"], "content": made})

    stamp = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    texts = v.documents.select(F.col("doc_id").alias("file_id"), F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 ]", "").alias("body"))
    rows = v.files.join(texts, "file_id").select(F.concat(F.lit("/o/"), "file_id", F.lit(".docx")).alias("path"), "body", stamp("created_epoch").alias("created"), stamp("modified_at_fs").alias("modified"))
    return rows.mapInPandas(build, "path string, content binary")


OFFICE = "select '/o/' || doc_id || '.docx' as path, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]', '', 'g') as body from documents"


@query("s12_text_stats", f"""select '/p/' || doc_id || '.txt' as path, octet_length(encode(coalesce(text, ''))) as size_bytes, length(coalesce(text, '')) as characters, len(regexp_extract_all(coalesce(text, ''), '[^\\s\\x0B\\x1C-\\x1F\\x85\\xA0]+')) as words, case when trim(coalesce(text, '')) = '' then 'no_text' else 'extracted' end as status from documents
union all select path, null, case when body = '' then 10 else length(body) + 11 end, len(regexp_extract_all(body, '[^ ]+')) + 2, 'extracted' from ({OFFICE})""")
def _(v):
    plain = v.documents.select(F.concat(F.lit("/p/"), "doc_id", F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    stats = extract.text_stats(plain.unionByName(_office(v)))
    return stats.withColumn("size_bytes", F.when(F.col("path").startswith("/p/"), F.col("size_bytes")))


@query("s12b_stats_summary", "select 'extracted' as status, count(*) as files from documents where trim(coalesce(text, '')) <> '' union all select 'no_text', count(*) from documents where trim(coalesce(text, '')) = '' having count(*) > 0")
def _(v):
    plain = v.documents.select(F.concat(F.lit("/p/"), "doc_id", F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return extract.stats_summary(extract.text_stats(plain)).select("status", "files")


@query("s13_office_dates", """select '/o/' || file_id || '.docx' as path, k as date_type, strftime(make_timestamp(case k when 'created' then created_epoch else modified_at_fs end * 1000000), '%Y-%m-%dT%H:%M:%SZ') as raw from files, (select unnest(['created', 'modified']) as k)""")
def _(v):
    return extract.office_dates(_office(v))
