"""Problem 2: lines repeated across one source's chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import strip
from lectern.plans.staging import broadcast_within, stage, within

#: Chunks of one source that must hold a line.
MIN_CHUNKS = 8
#: Rows of a source's summary, and counters in each: this many, or for a larger source one for every ``LOAD`` of its lines.
ROWS, WIDTH, LOAD = 2, 1 << 16, 2
#: Lines of a confirmed set that share a bucket, about.
BUCKET = 4
#: Most rows of a set that is broadcast, each two hashes, so some 50 MB as a hash table; larger sets are joined by shuffling.
BROADCAST_ROWS = 500_000


def line_key(c: Column) -> Column:
    """Hash of a line without letter case, white space and digits; null if it has no letter."""
    bare = F.regexp_replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), r"(?U)[\s\x1c-\x1f\p{Nd}]+", "")
    return F.when(bare.rlike(r"\p{L}"), F.xxhash64(bare))


def lines_of(chunks: DataFrame) -> DataFrame:
    """``chunk_id``, ``source``, ``text_id``, ``line_no``, ``line``: each line that has a letter, as 64-bit hashes of source, text and line."""
    rows = chunks.where("chunk_id is not null and source_id is not null and text is not null")
    each = rows.select("chunk_id", F.xxhash64(F.lower(strip(F.col("source_id")))).alias("source"), F.xxhash64("text").alias("text_id"), F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    return each.select("chunk_id", "source", "text_id", (F.col("at") + 1).alias("line_no"), line_key(F.col("raw")).alias("line")).where("line is not null")


def _slots(width: Column) -> list[Column]:
    """The counter of each row of a summary that a line is hashed into."""
    return [F.pmod(F.col("line") if i == 0 else F.xxhash64("line", F.lit(i)), width) for i in range(ROWS)]


def candidate_lines(lines: DataFrame, min_chunks: int = MIN_CHUNKS, width: int = WIDTH, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``lines`` whose every counter in their source's summary holds ``min_chunks`` or more.

    A summary has ``ROWS`` rows of counters into which lines are hashed. It is merged
    by adding, which Spark does before and after the shuffle; a counter never holds less than the
    count of any of its lines, so no line that can reach ``min_chunks`` is lost. The bound is a count and not a share, so a summary of fixed size would tell nothing of a source with more than
    ``min_chunks`` times its counters: the lines of a source are counted first and its counters grow with them.
    """
    large = lines.groupBy("source").count().where(F.col("count") > width * LOAD)
    large = broadcast_within(stage(large.select("source", F.pow(F.lit(2), F.ceil(F.log2(F.col("count") / LOAD))).cast("bigint").alias("wide")), "large-sources"), broadcast_rows)
    sized = lines.join(large, "source", "left").withColumn("wide", F.coalesce("wide", F.lit(width)))
    slots = F.array(*[F.struct(F.lit(i).alias("row"), s.alias("slot")) for i, s in enumerate(_slots(F.col("wide")))])
    counters = sized.select("source", F.explode(slots).alias("at")).groupBy("source", "at.row", "at.slot").count().where(F.col("count") >= min_chunks)
    heavy = stage(counters.select("source", "row", "slot"), "heavy-slots")
    out = sized
    for i, s in enumerate(_slots(F.col("wide"))):
        row = broadcast_within(heavy.where(F.col("row") == i).select("source", F.col("slot").alias(f"slot{i}")), broadcast_rows)
        out = out.withColumn(f"slot{i}", s).join(row, ["source", f"slot{i}"], "left_semi")
    return out.select(lines.columns)


def site_lines(lines: DataFrame, min_chunks: int = MIN_CHUNKS, width: int = WIDTH, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``source``, ``line``, ``chunks``: the lines that stand in at least ``min_chunks`` chunks of a source.

    First pass: ``candidate_lines`` by mergeable summaries. Second pass: the candidates are counted exactly by distinct chunk. Lines are told apart by 64 bits within a source.
    ``lines`` should be a staged table; it is read three times.
    """
    candidates = candidate_lines(lines, min_chunks, width, broadcast_rows)
    return (
        candidates.select("source", "line", "chunk_id").distinct().groupBy("source", "line").agg(F.count("*").alias("chunks")).where(F.col("chunks") >= min_chunks)
    )


def repeated_lines(chunks: DataFrame, min_chunks: int = MIN_CHUNKS, width: int = WIDTH, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Distinct (``chunk_id``, ``line_no``) of every line that stands in ``min_chunks`` chunks of its source or more.

    Lines are what stands between line feeds, numbered from 1; two are the same without letter case, white space and digits.
    Lines without a letter, chunks without id, source or text have no cases. Sources are the same apart from case and outer space.
    """
    lines = stage(lines_of(chunks), "lines")
    known = stage(site_lines(lines, min_chunks, width, broadcast_rows).select("source", "line"), "site-lines")
    known = broadcast_within(known, broadcast_rows)
    return lines.join(known, ["source", "line"], "left_semi").select("chunk_id", "line_no").distinct()


def site_line_report(chunks: DataFrame, min_chunks: int = MIN_CHUNKS) -> DataFrame:
    """``source``, ``line``, ``chunks``: each repeated line of a source by its least spelling, and in how many chunks it stands."""
    rows = chunks.where("chunk_id is not null and source_id is not null and text is not null")
    each = rows.select("chunk_id", F.lower(strip(F.col("source_id"))).alias("source"), F.explode(F.split("text", "\n")).alias("raw"))
    keyed = each.withColumn("key", line_key(F.col("raw"))).where("key is not null")
    known = site_lines(stage(lines_of(chunks), "lines"), min_chunks).select(F.col("source").alias("sh"), F.col("line").alias("key"), "chunks")
    hits = keyed.withColumn("sh", F.xxhash64("source")).join(known, ["sh", "key"])
    return hits.groupBy("source", "key").agg(F.min(strip(F.col("raw"))).alias("line"), F.first("chunks").alias("chunks")).drop("key")


def without_site_lines(chunks: DataFrame, min_chunks: int = MIN_CHUNKS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Every row of ``chunks`` with ``clean_text``, its text without the repeated lines, and ``lines_removed``.

    The confirmed lines of a source go to each of its rows as one broadcast set, in buckets by hash so that a line is looked up in a few. Where the sets
    together exceed ``broadcast_rows`` the lines to drop are found by a shuffle and joined on hashes of source and text.
    Null texts stay null; a chunk without source or id keeps its text.
    """
    if "clean_text" in chunks.columns or "lines_removed" in chunks.columns:
        chunks = chunks.drop("clean_text", "lines_removed")
    lines = stage(lines_of(chunks), "lines")
    known = stage(site_lines(lines, min_chunks).select("source", "line"), "site-lines")
    split = F.split("text", "\n")
    source = F.when(F.col("chunk_id").isNotNull() & F.col("source_id").isNotNull(), F.xxhash64(F.lower(strip(F.col("source_id")))))
    rows = chunks.withColumn("__source", source)
    if within(known, broadcast_rows):
        rows = rows.join(F.broadcast(_bucketed(known).withColumnRenamed("source", "__source")), "__source", "left")
        bucket = lambda key: F.get("__set", F.pmod(key, F.size("__set")).cast("int"))
        kept = F.filter(F.transform(split, lambda x: F.struct(x.alias("x"), line_key(x).alias("k"))), lambda p: ~F.coalesce(F.array_contains(bucket(p.k), p.k), F.lit(False)))
        kept = F.transform(kept, lambda p: p.x)
    else:
        rows = rows.withColumn("__text", F.xxhash64("text"))
        hits = lines.join(known, ["source", "line"], "left_semi")
        drop = hits.groupBy(F.col("source").alias("__source"), F.col("text_id").alias("__text")).agg(F.collect_set(F.col("line_no") - 1).alias("__set"))
        rows = rows.join(drop, ["__source", "__text"], "left")
        kept = F.filter(split, lambda x, i: ~F.coalesce(F.array_contains(F.col("__set"), i), F.lit(False)))
    out = rows.withColumn("__kept", F.when(F.col("__set").isNull(), split).otherwise(kept))
    return out.select(
        *[F.col(c) for c in chunks.columns],
        F.array_join("__kept", "\n").alias("clean_text"),
        (F.size(split) - F.size("__kept")).alias("lines_removed"),
    )


def _bucketed(known: DataFrame) -> DataFrame:
    """``source`` and ``__set``: its lines as an array of buckets, of which a line is in number ``line`` modulo their number."""
    sizes = known.groupBy("source").agg(F.ceil(F.count("*") / BUCKET).alias("n"))
    filled = known.join(sizes, "source").groupBy("source", F.pmod("line", F.col("n")).alias("b")).agg(F.collect_set("line").alias("lines"))
    every = sizes.select("source", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("b")).join(filled, ["source", "b"], "left")
    lines = F.sort_array(F.collect_list(F.struct("b", F.coalesce("lines", F.array().cast("array<bigint>")).alias("lines"))))
    return every.groupBy("source").agg(lines.alias("s")).select("source", F.transform("s", lambda x: x.lines).alias("__set"))
