"""Pages that arrive as files: features per micro-batch, merged into a snapshot."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import text as X
from lexforge.operators import merge as G
from lexforge.sources import html


def page_stream(spark: SparkSession, folder: str, lang: str, files_per_trigger: int = 1000) -> DataFrame:
    """(lang, path, sha256, html, arrived) of HTML files as they appear in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    files = files.where(F.lower("path").rlike(r"\.html?$"))
    return files.select(F.lit(lang).alias("lang"), html.relative_path(spark, folder).alias("path"), F.sha2("content", 256).alias("sha256"), html.decode_utf8(F.col("content")).alias("html"), F.col("modificationTime").alias("arrived"))


def distinct_pages(pages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The same content of a path once within the watermark."""
    return pages.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["lang", "path", "sha256"])


def merge_batches(store, pages: DataFrame, checkpoint: str, trigger: dict | None = None):
    """Starts a query that merges each batch into the store, of a path's versions the latest, with all that hangs on
    changed documents, as ingest() does: paths are relative to the folder, and pages that could not be read are listed in
    ingestion_errors under the checkpoint's and the batch's number. A batch that runs again finds its documents
    unchanged by (lang, path, sha256), so the merge may be repeated."""

    run = f"stream-{zlib.crc32(checkpoint.encode()):08x}"

    def merge(batch: DataFrame, number: int) -> None:
        latest = G.first_of(batch.withColumn("age", -F.unix_micros("arrived")), ["lang", "path"], ["age", "sha256"])
        out, tables, failed, stage = store.merged(html.extract_pages(latest.select("lang", "path", "sha256", "html")))
        failed = failed.select(F.lit(f"{run}-{number}").alias("run_id"), "lang", "path", "error")
        store.commit(tables, {"ingestion_errors": failed} if out["errors"] else {})
        store.unstage(stage)

    return pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def anchor_counts(pages: DataFrame, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Anchors of a stream of (text, arrived) per type and window, closed by the watermark."""
    found = pages.withWatermark("arrived", delay).select("arrived", F.explode(X.anchors(F.col("text"))).alias("a"))
    return found.groupBy(F.window("arrived", window), F.col("a.anchor_type").alias("anchor_type")).agg(F.count(F.lit(1)).alias("n"))


def review_state(events: DataFrame) -> DataFrame:
    """Latest status and version of concepts from a stream of review events with event_id."""
    return events.groupBy("concept_id").agg(F.count(F.lit(1)).alias("row_version"), F.max_by("new_status", "event_id").alias("status"))
