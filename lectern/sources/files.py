"""Readers and writers of the pipeline's files, with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import norm_url, unify_newlines
from lectern.operators.clean import parse_capture
from lectern.operators.corpus import CHUNK_COLUMNS, nested_manifest

_S = T.StringType()
DOCUMENT = T.StructType([T.StructField(f, _S) for f in ("id", "title", "source_url", "text", "retrieved")])
PASSED_ON = ("source_id", "scope", "topic", "content_version", "change_frequency")
CHUNK = T.StructType([T.StructField(c, T.IntegerType() if c in ("char_count", "token_estimate_approx") else _S) for c in CHUNK_COLUMNS])
MANIFEST_FIELDS = ("file", "source_id", "url", "title", "scope", "topic", "content_version", "change_frequency")
MANIFEST = T.StructType([T.StructField("date_accessed", _S), T.StructField("sources", T.ArrayType(T.StructType([T.StructField(f, _S) for f in MANIFEST_FIELDS])))])
REGISTRY = T.StructType([T.StructField(f, _S) for f in ("id", "page_title", "url", "topic", "scope", "date_accessed", "change_frequency", "content_version", "notes")])


def read_corpus(spark: SparkSession, path: str, passed_on: bool = False) -> DataFrame:
    """Documents of a JSON array, with their place as ``pos``; other keys are ignored, or five of them passed on.

    Spark's reader accepts a missing required field, so rows with a null in one raise here.
    """
    schema = T.StructType([*DOCUMENT, *[T.StructField(f, _S) for f in PASSED_ON if passed_on]])
    docs = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    required = [f for f in DOCUMENT.fieldNames() if f != "retrieved"]
    bad = docs.where(F.greatest(*[F.col(f).isNull() for f in required])).limit(1).count()
    if bad:
        raise ValueError(f"a document lacks one of {required}")
    return docs.withColumn("pos", F.monotonically_increasing_id())


def _csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    rows = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("lineSep", "\n").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return rows.fillna("")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of a CSV file with quoted commas, doubled quotes and line breaks in fields; blank cells are empty strings."""
    return _csv(spark, path, CHUNK)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The source registry of a CSV file."""
    return _csv(spark, path, REGISTRY)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's entries, each with the manifest's date."""
    return nested_manifest(spark.read.schema(MANIFEST).option("multiLine", True).json(path))


def manifest_index(manifest: DataFrame) -> DataFrame:
    """``key``, ``file``: manifest entries by normalized URL."""
    return manifest.select(norm_url(F.col("url")).alias("key"), "file")


def manifest_files(manifest: DataFrame) -> DataFrame:
    """The distinct ``file`` names of a manifest."""
    return manifest.select("file").where("file is not null").distinct()


def read_pages(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """``file``, ``text`` of the text files of a folder, each one row; line ends become LF."""
    rows = spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_name").alias("file"), unify_newlines(F.col("value")).alias("text"))


def read_captures(spark: SparkSession, roots: Sequence[str], folder: str = "tool-results", markdown: str | None = None) -> DataFrame:
    """``path``, ``text`` of captures: ``.json`` files in folders of one name anywhere below ``roots``, and ``.md`` files of ``markdown``.

    Files that aren't UTF-8 are left out. Spark doesn't enter hidden folders, but reads one that is named as a root.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(list(roots))
    found = found.where(F.element_at(F.split("path", "/"), -2) == folder)
    if markdown:
        found = found.unionByName(spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(markdown))
    blobs = found.where(F.is_valid_utf8(F.col("content"))).select("path", F.col("content").cast("string").alias("blob"))
    return blobs.select("path", unify_newlines(parse_capture(F.col("blob"))).alias("text"), F.length("blob").alias("blob_length"))


def write_pages(pages: DataFrame, folder: str) -> None:
    """``file``, ``text``: one folder per page file below ``folder``, each with the text and a line feed at its end."""
    pages.select("file", "text").write.mode("overwrite").partitionBy("file").text(folder)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """The chunk table as CSV with header, its columns in their order."""
    chunks.select(*CHUNK_COLUMNS).write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_corpus(documents: DataFrame, path: str) -> None:
    """Documents as JSON lines, nulls kept as missing keys."""
    documents.write.mode("overwrite").json(path)


def corpus_array(documents: DataFrame) -> str:
    """Documents as one JSON array; for corpora that fit the driver, such as one file that an application loads."""
    rows = documents.select(F.to_json(F.struct(*documents.columns), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()
    return "[" + ",\n".join(r.j for r in rows) + "]"
