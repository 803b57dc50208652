"""The corpus build: pages and manifest to chunk rows, chunk rows to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.chunk import chunk_pages, number_chunks
from lectern.operators.clean import clean, largest_capture

# Columns of the chunk table, in their order.
CHUNK_COLUMNS = ("chunk_id", "source_id", "source_title", "source_url", "scope", "topic", "content_version", "change_frequency", "date_accessed", "char_count", "token_estimate_approx", "text")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per ``key``, the last by ``order``; rows without a key are left out."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.where(F.col(key).isNotNull()).withColumn("__nth", last).where("__nth = 1").drop("__nth")


def manifest_entries(manifest: DataFrame) -> DataFrame:
    """One row per ``file`` of a manifest that may repeat rows: the least of its rows, column by column in the order of the table."""
    rest = [c for c in manifest.columns if c != "file"]
    return manifest.where("file is not null").groupBy("file").agg(F.min(F.struct(*rest)).alias("m")).select("file", "m.*")


def nested_manifest(root: DataFrame) -> DataFrame:
    """The entries of a manifest document (``date_accessed``, array ``sources``) as rows, each with the document's date."""
    return root.select("date_accessed", F.explode("sources").alias("s")).select("s.*", "date_accessed")


def unlisted_pages(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """``file`` of pages that the manifest lacks."""
    return pages.select("file").where("file is not null").distinct().join(manifest.select("file").distinct(), "file", "left_anti")


def build_chunks(pages: DataFrame, manifest: DataFrame, cleaned: bool = False) -> DataFrame:
    """Chunk rows of all pages (``page_id``, ``file``, ``text``) that the manifest lists, with its metadata; columns ``CHUNK_COLUMNS``.

    The longest capture of a file stands for it and is then cleaned unless it is ``cleaned`` already. Chunks are numbered in the order of files.
    """
    meta = manifest_entries(manifest)
    page = largest_capture(pages.select("page_id", "file", "text")).join(meta.select("file"), "file", "left_semi")
    page = page if cleaned else clean(page, "text", "clean_text").select("file", F.col("clean_text").alias("text"))
    chunks = number_chunks(chunk_pages(page, "file"))
    named = meta.select("file", "source_id", F.col("title").alias("source_title"), F.col("url").alias("source_url"), "scope", "topic", "content_version", "change_frequency", "date_accessed")
    return chunks.join(named, "file").select(*CHUNK_COLUMNS)


def documents_of(chunks: DataFrame) -> DataFrame:
    """Chunk rows as documents of the retriever: three columns renamed, the metadata passed on."""
    return chunks.select(
        F.col("chunk_id").alias("id"),
        F.col("source_title").alias("title"),
        "source_url",
        "text",
        F.col("date_accessed").alias("retrieved"),
        "source_id", "scope", "topic", "content_version", "change_frequency",
    )


def build_summary(chunks: DataFrame) -> DataFrame:
    """``rows`` and ``sources`` of a chunk table, one row."""
    return chunks.agg(F.count("*").alias("rows"), F.countDistinct("source_id").alias("sources"))
