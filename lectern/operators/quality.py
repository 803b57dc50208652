"""Gates over chunk tables and page files. They report and never fail a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.config import CHUNK_CAP, CHUNK_LEAST, CHUNK_TRACES, DANGLING, FILE_TRACES, REQUIRED_COLUMNS, SENTENCE_ENDS, SHORT_FILE
from lectern.functions.text import is_blank, label, strip


def size_stats(chunks: DataFrame) -> DataFrame:
    """One row: least, median, mean and largest ``char_count`` (the middle two cut to integers), how many are over the cap and how many thin.

    Null sizes are left out; an empty table has nulls and zeros.
    """
    c = F.col("char_count")
    return chunks.agg(
        F.min(c).alias("min_chars"),
        F.median(c).cast("int").alias("median_chars"),
        F.avg(c).cast("int").alias("mean_chars"),
        F.max(c).alias("max_chars"),
        F.count_if(c > CHUNK_CAP).alias("over_cap"),
        F.count_if(c < CHUNK_LEAST).alias("thin"),
    )


def empty_chunks(chunks: DataFrame) -> DataFrame:
    """``chunk_id`` of chunks with null or blank text."""
    return chunks.where(is_blank(F.col("text"))).select("chunk_id")


def duplicate_texts(chunks: DataFrame) -> DataFrame:
    """``text_hash``, ``copies``: stripped texts that stand in several rows, by MD5. Nulls are no texts."""
    rows = chunks.where("text is not null").select(F.md5(strip(F.col("text"))).alias("text_hash"))
    return rows.groupBy("text_hash").agg(F.count("*").alias("copies")).where("copies > 1")


def missing_cells(chunks: DataFrame) -> DataFrame:
    """``column``, ``missing``: null or blank cells of each required column that the table has."""
    cols = [c for c in REQUIRED_COLUMNS if c in chunks.columns]
    sums = chunks.agg(*[F.count_if(is_blank(F.col(c))).alias(c) for c in cols])
    return sums.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, cols)), F.array(*cols))).alias("column", "missing"))


def bad_urls(chunks: DataFrame) -> DataFrame:
    """``chunk_id``, ``source_url`` of chunks whose URL isn't an https one; null URLs too."""
    return chunks.where(~F.coalesce(F.col("source_url").startswith("https://"), F.lit(False))).select("chunk_id", "source_url")


def leak_counts(chunks: DataFrame, traces: tuple[str, ...] = CHUNK_TRACES) -> DataFrame:
    """``trace``, ``rows``: in how many texts each trace of furniture stands, those in none left out."""
    sums = chunks.agg(*[F.count_if(F.col("text").contains(t)).alias(f"t{i}") for i, t in enumerate(traces)])
    pairs = F.explode(F.map_from_arrays(F.array(*map(F.lit, traces)), F.array(*[f"t{i}" for i in range(len(traces))])))
    return sums.select(pairs.alias("trace", "rows")).where("rows > 0")


def dataset_gate(chunks: DataFrame, traces: tuple[str, ...] = CHUNK_TRACES) -> DataFrame:
    """``check``, ``value``: the chunk table's checks as one report; ``traces`` are of furniture."""
    cols = [c for c in REQUIRED_COLUMNS if c in chunks.columns]
    missing = sum((F.when(is_blank(F.col(c)), 1).otherwise(0) for c in cols), F.lit(0))
    one = chunks.agg(
        F.count("*").alias("rows"),
        F.count_if(is_blank(F.col("text"))).alias("empty"),
        F.coalesce(F.sum(missing), F.lit(0)).alias("missing_cells"),
        F.count_if(~F.coalesce(F.col("source_url").startswith("https://"), F.lit(False))).alias("bad_urls"),
        F.countDistinct("source_id").alias("sources"),
        F.count_if(F.col("char_count") > CHUNK_CAP).alias("over_cap"),
        F.count_if(F.col("char_count") < CHUNK_LEAST).alias("thin"),
        *[F.count_if(F.col("text").contains(t)).alias(f"leak {t}") for t in traces],
    )
    pairs = F.map_from_arrays(F.array(*map(F.lit, one.columns)), F.array(*[F.col(f"`{c}`").cast("bigint") for c in one.columns]))
    dup = duplicate_texts(chunks).agg(F.count("*").alias("value")).select(F.lit("duplicate_texts").alias("check"), "value")
    return one.select(F.explode(pairs).alias("check", "value")).unionByName(dup)


def text_issues(t: Column, traces: tuple[str, ...] = FILE_TRACES) -> Column:
    """What is wrong with a page's stripped text ``t``: furniture in it, too short, an odd end, a dangling last word."""
    found = F.filter(F.array(*map(F.lit, traces)), lambda x: F.contains(t, x))
    return F.array_compact(
        F.array(
            F.when(F.size(found) > 0, F.concat(F.lit("boilerplate: "), F.array_join(found, ", "))),
            F.when(F.length(t) < SHORT_FILE, F.lit("short")),
            F.when((t != "") & ~F.right(t, F.lit(1)).isin(*SENTENCE_ENDS), F.lit("ends oddly")),
            F.when(t.rlike(rf"(?U)\b(?:{'|'.join(DANGLING)})$"), F.lit("dangling word")),
        )
    )


def text_gate(pages: DataFrame, *keys: str, traces: tuple[str, ...] = FILE_TRACES) -> DataFrame:
    """``keys``, ``n_chars``, ``issues`` (joined by ``; ``), ``ok`` for each row. Null text counts as empty."""
    bare = pages.select(*keys, strip(F.coalesce("text", F.lit(""))).alias("__t"))
    rows = bare.select(*keys, F.length("__t").alias("n_chars"), text_issues(F.col("__t"), traces).alias("__i"))
    return rows.select(*keys, "n_chars", F.array_join("__i", "; ").alias("issues"), (F.size("__i") == 0).alias("ok"))


def gate_summary(gated: DataFrame) -> DataFrame:
    """``files``, ``flagged``, ``clean``, one row."""
    return gated.agg(F.count("*").alias("files"), F.count_if(~F.col("ok")).alias("flagged"), F.count_if("ok").alias("clean"))


def manifest_missing(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """``file`` of manifest entries without a page."""
    return manifest.select("file").where("file is not null").distinct().join(pages.select("file").distinct(), "file", "left_anti")


def manifest_orphans(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """``file`` of pages without a manifest entry."""
    return manifest_missing(pages, manifest)


def registry_differences(registry: DataFrame, manifest: DataFrame) -> DataFrame:
    """``source_id``, ``field``, ``registry``, ``manifest``: where the registry and the manifest disagree on a source, spelling of labels aside.

    Sources are compared by their least labels; a source that one side lacks has a null there under the field ``source_id``.
    """
    fields = ("scope", "change_frequency", "content_version")
    a = registry.where("id is not null").groupBy(F.expr("try_cast(id as bigint)").alias("n")).agg(*[F.min(label(F.col(f))).alias(f"a_{f}") for f in fields])
    b = manifest.where("source_id is not null").groupBy(F.expr("try_cast(regexp_extract(source_id, '([0-9]+)[^0-9]*$', 1) as bigint)").alias("n")).agg(*[F.min(label(F.col(f))).alias(f"b_{f}") for f in fields])
    both = a.withColumn("in_a", F.lit("yes")).join(b.withColumn("in_b", F.lit("yes")), "n", "full").where("n is not null")
    sides = F.array(
        F.when(F.col("in_a").isNull() | F.col("in_b").isNull(), F.struct(F.lit("source_id").alias("field"), F.col("in_a").alias("registry"), F.col("in_b").alias("manifest"))),
        *[
            F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("registry"), F.col(f"b_{f}").alias("manifest")))
            for f in fields
        ],
    )
    return both.select(F.format_string("src%06d", "n").alias("source_id"), F.explode(F.array_compact(sides)).alias("d")).select("source_id", "d.*")
