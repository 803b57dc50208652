"""Problem 1: token budget per source, language and domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import SPACE, label, strip
from lectern.llm.tokens import TOKENIZERS, VOCABULARY, count_column
from lectern.plans.staging import stage, within


def source_key(c: Column) -> Column:
    """One spelling of a source id: outer white space cut, lower case."""
    return F.lower(strip(c))


def language_key(c: Column) -> Column:
    """The primary language of a tag: ``en-GB`` and ``EN`` are ``en``."""
    return F.lower(F.regexp_extract(c, f"^{SPACE}*([A-Za-z]+)", 1))


def content_hash(c: Column) -> list[Column]:
    """128 bits of a text as two columns ``h1`` and ``h2``."""
    return [F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(0x9E3779B9), c).alias("h2")]


#: Most hashes of repeated texts that are broadcast, some 100 MB as a hash table; of more, all texts are shuffled.
BROADCAST_ROWS = 1_000_000


def distinct_texts(rows: DataFrame) -> DataFrame:
    """One row per distinct text (``h1``, ``h2``, ``text``); copies collapse before the shuffle, so no text is hot."""
    return rows.groupBy("h1", "h2").agg(F.first("text").alias("text"))


def distinct_token_counts(texts: DataFrame, repeated: DataFrame, folder: str, vocabulary: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``h1``, ``h2``, ``tokens``: each distinct text tokenized once.

    ``texts`` has ``h1``, ``h2``, ``text``; ``repeated``, a staged table, the hashes that stand in several rows. A text that stands in one row is tokenized where it is read; only
    texts that are repeated are shuffled, to become one.
    """
    spark = texts.sparkSession
    if not within(repeated, broadcast_rows):
        return distinct_texts(texts).mapInArrow(count_column(spark, "text", "tokens", folder, vocabulary), "h1 long, h2 long, tokens long")
    marked = texts.join(F.broadcast(repeated.withColumn("later", F.lit(True))), ["h1", "h2"], "left").select("h1", "h2", "text", F.coalesce("later", F.lit(False)).alias("later"))
    done = stage(marked.mapInArrow(count_column(spark, "text", "tokens", folder, vocabulary, "later"), "h1 long, h2 long, tokens long, later string"), "tokens")
    rest = distinct_texts(done.where("tokens is null").select("h1", "h2", F.col("later").alias("text")))
    rest = rest.mapInArrow(count_column(spark, "text", "tokens", folder, vocabulary), "h1 long, h2 long, tokens long")
    return done.where("tokens is not null").select("h1", "h2", "tokens").unionByName(rest)


def _chunk_keys(chunks: DataFrame) -> DataFrame:
    """A row's ``id`` (its chunk's, or of its own for a null one), its keys and the hash of its text, staged; equal rows once, with their number ``rows``."""
    keys = ["source", "language", "domain", "h1", "h2"]
    rows = chunks.select(
        "chunk_id",
        source_key(F.col("source_id")).alias("source"),
        F.nullif(language_key(F.col("lang")), F.lit("")).alias("language"),
        label(F.col("scope")).alias("domain"),
        *content_hash(F.coalesce("text", F.lit(""))),
        (F.coalesce("text", F.lit("")) != "").alias("filled"),
    )
    name = F.coalesce("chunk_id", F.concat(F.lit("\0"), *[F.coalesce(F.col(k).cast("string"), F.lit("\1")) for k in keys]))
    return stage(rows.select(name.alias("id"), *keys, "filled").groupBy("id", *keys, "filled").agg(F.count("*").alias("rows")), "chunk-keys")


def _once(rows: DataFrame) -> DataFrame:
    """Each chunk once, under the least of its keys."""
    keys = ["source", "language", "domain", "h1", "h2"]
    return rows.groupBy("id").agg(F.min(F.struct(*keys)).alias("k")).select("id", "k.*")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """``level``, ``source``, ``language``, ``domain``, ``n_chunks`` of ``token_budget``, without tokens."""
    once = _once(_chunk_keys(chunks)).groupBy("source", "language", "domain").agg(F.count("*").alias("n_chunks"))
    return _by_level(once, "n_chunks")


def token_budget(chunks: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Token totals by source, language and domain, each distinct text tokenized once.

    Input: ``chunk_id``, ``source_id``, ``lang``, ``scope``, ``text``; further columns are ignored.
    Output: ``level`` (``all``, ``source``, ``language``, ``domain`` or ``slice``, the three together),
    ``source``, ``language``, ``domain``, ``n_chunks``, ``n_tokens``. Columns that a level doesn't group by
    are null. Whole texts are hashed and deduplicated; the counts are joined back on the hash and summed
    with the number of chunks that hold the text, which is exact.

    A chunk counts once however often its row is repeated; if such rows disagree, under the least of their
    keys. Rows without ``chunk_id`` count once per distinct text and keys. A null source, language or
    domain is a group of its own. Null and empty texts have no tokens but count as chunks. An empty table gives no rows.
    """
    rows = _chunk_keys(chunks)
    repeated = stage(rows.where("filled").groupBy("h1", "h2").agg(F.sum("rows").alias("n")).where("n > 1").select("h1", "h2"), "repeated-texts")
    texts = chunks.where("text <> ''").select(*content_hash(F.col("text")), "text")
    tokens = distinct_token_counts(texts, repeated, folder, vocabulary, broadcast_rows)
    held = _once(rows).groupBy("source", "language", "domain", "h1", "h2").agg(F.count("*").alias("n"))
    slices = (
        held.join(tokens, ["h1", "h2"], "left")
        .groupBy("source", "language", "domain")
        .agg(F.sum("n").alias("n_chunks"), F.sum(F.col("n") * F.coalesce("tokens", F.lit(0))).alias("n_tokens"))
    )
    return _by_level(slices, "n_chunks", "n_tokens")


def _by_level(slices: DataFrame, *sums: str) -> DataFrame:
    s, la, d = F.col("source"), F.col("language"), F.col("domain")
    no = F.lit(None).cast("string")
    levels = F.array(
        *[
            F.struct(F.lit(level).alias("level"), a.alias("source"), b.alias("language"), c.alias("domain"))
            for level, a, b, c in (("all", no, no, no), ("source", s, no, no), ("language", no, la, no), ("domain", no, no, d), ("slice", s, la, d))
        ]
    )
    return slices.select(F.explode(levels).alias("g"), *sums).groupBy("g.level", "g.source", "g.language", "g.domain").agg(*[F.sum(c).alias(c) for c in sums])
