"""Clean pages to chunks with overlap, and their ids and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.config import CHUNK_CAP, CHUNK_LEAST, CHUNK_OVERLAP, CHUNK_TARGET
from lectern.functions.text import SPACE, normalize, paragraphs, sentences, strip, token_estimate
from lectern.plans.staging import stage

_NONE = "array<string>"


def _append(done: Column, s: Column) -> Column:
    return F.when(s == "", done).otherwise(F.concat(done, F.array(s)))


def pack_sentences(parts: Column, target: int) -> Column:
    """Sentences joined by spaces, as many as stay within ``target``; a longer one stands alone, uncut."""

    def step(acc: Column, s: Column) -> Column:
        full = (acc.cur != "") & (F.length(acc.cur) + F.length(s) + 1 > target)
        cur = F.when(full | (acc.cur == ""), s).otherwise(F.concat(acc.cur, F.lit(" "), s))
        return F.struct(F.when(full, _append(acc.done, acc.cur)).otherwise(acc.done).alias("done"), cur.alias("cur"))

    zero = F.struct(F.array().cast(_NONE).alias("done"), F.lit("").alias("cur"))
    return F.aggregate(parts, zero, step, lambda acc: _append(acc.done, acc.cur))


def pack(c: Column, target: int = CHUNK_TARGET, cap: int = CHUNK_CAP) -> Column:
    """Paragraphs joined by blank lines, as many as stay within ``target``; one longer than ``cap`` is packed by its sentences."""

    def step(acc: Column, p: Column) -> Column:
        long = F.length(p) > cap
        full = (acc.buf != "") & (F.length(acc.buf) + F.length(p) + 2 > target)
        flushed = _append(acc.done, acc.buf)
        done = F.when(long, F.concat(flushed, pack_sentences(sentences(p), target))).otherwise(F.when(full, flushed).otherwise(acc.done))
        buf = F.when(long, F.lit("")).otherwise(F.when(full | (acc.buf == ""), p).otherwise(F.concat(acc.buf, F.lit("\n\n"), p)))
        return F.struct(done.alias("done"), buf.alias("buf"))

    zero = F.struct(F.array().cast(_NONE).alias("done"), F.lit("").alias("buf"))
    return F.aggregate(paragraphs(c), zero, step, lambda acc: _append(acc.done, acc.buf))


def overlap(chunks: Column, size: int = CHUNK_OVERLAP) -> Column:
    """Each chunk but the first with the end of the one before it in front: from a sentence's beginning if one lies within ``size``."""

    def join(c: Column, i: Column) -> Column:
        tail = F.right(F.get(chunks, i - 1), F.lit(size))
        begun = F.regexp_extract(tail, rf"(?d)[.!?]{SPACE}+(.*)$", 1)
        return F.when(i == 0, c).otherwise(strip(F.concat(F.when(begun == "", tail).otherwise(begun), F.lit(" "), c)))

    return F.transform(chunks, join)


def merge_short(chunks: Column, least: int = CHUNK_LEAST) -> Column:
    """Chunks shorter than ``least`` joined to the one before; a first one that is still short to the second."""

    def step(acc: Column, c: Column) -> Column:
        n = F.size(acc)
        into_last = F.concat(F.slice(acc, F.lit(1), n - 1), F.array(strip(F.concat(F.element_at(acc, -1), F.lit(" "), c))))
        return F.when((n > 0) & (F.length(c) < least), into_last).otherwise(F.concat(acc, F.array(c)))

    def first(acc: Column) -> Column:
        joined = F.concat(F.array(strip(F.concat(F.get(acc, F.lit(0)), F.lit(" "), F.get(acc, F.lit(1))))), F.slice(acc, F.lit(3), F.greatest(F.size(acc) - 2, F.lit(0))))
        return F.when((F.size(acc) > 1) & (F.length(F.get(acc, F.lit(0))) < least), joined).otherwise(acc)

    return F.aggregate(chunks, F.array().cast(_NONE), step, first)


def chunk_pages(pages: DataFrame, *keys: str) -> DataFrame:
    """``keys``, ``part`` from 1, ``text``, ``char_count``, ``token_estimate_approx``: the chunks of each page (``keys``, ``text``).

    Blank and null texts have none. Each step is a column of its own, so that no later step computes it again.
    """
    rows = pages.select(*keys, normalize(F.col("text")).alias("__text")).withColumn("__packed", pack(F.col("__text")))
    rows = rows.withColumn("__joined", overlap(F.col("__packed"))).withColumn("__chunks", merge_short(F.col("__joined")))
    # The outer form, since for the other one Spark infers a filter on the array and computes all of the above once more for it.
    parts = rows.select(*keys, F.posexplode_outer("__chunks").alias("at", "text")).where("text is not null")
    return parts.select(*keys, (F.col("at") + 1).alias("part"), "text", F.length("text").alias("char_count"), token_estimate(F.col("text")).alias("token_estimate_approx"))


def number_chunks(chunks: DataFrame, key: str = "file", part: str = "part") -> DataFrame:
    """``chunks`` with ``chunk_id``, ``c`` and a running number of three digits or more in the order of ``key`` and ``part``.

    The rows are staged, since finding ranges reads them twice, then spread by ranges of ``key`` and staged with their partition's
    number; each partition counts its own rows, and one row per partition tells how many come before. No step sees all rows.
    """
    parts = stage(stage(chunks, "unnumbered").repartitionByRange(key, part).withColumn("__p", F.spark_partition_id()), "numbered")
    counts = sorted((r["__p"], r["count"]) for r in parts.groupBy("__p").count().collect())
    before, rows = 0, []
    for p, n in counts:
        rows.append((p, before))
        before += n
    offsets = chunks.sparkSession.createDataFrame(rows, "__p int, __before long")
    nth = F.row_number().over(Window.partitionBy("__p").orderBy(key, part))
    numbered = parts.withColumn("__n", nth).join(F.broadcast(offsets), "__p").withColumn("chunk_id", F.format_string("c%03d", F.col("__n") + F.col("__before")))
    return numbered.select("chunk_id", *chunks.columns)
