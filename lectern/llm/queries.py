"""The named queries of the subpackage over the test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import budget, cutoff, lines, lookalike, mainbody, mixing, packing, pieces
from lectern.plans.staging import spread

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def p1_token_budget(spark: SparkSession, d: str) -> DataFrame:
    return budget.token_budget(_table(spark, d, "chunks"))


def p1_chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    return budget.chunk_counts(_table(spark, d, "chunks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_lines(_table(spark, d, "chunks"))


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return lines.without_site_lines(_table(spark, d, "chunks").select("chunk_id", "source_id", "text"))


def p2_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.site_line_report(_table(spark, d, "chunks"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_oversized(_table(spark, d, "chunks"), *pieces.chunk_limit(_table(spark, d, "size_limits"))).distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    got = pieces.split_oversized(_table(spark, d, "chunks"), *pieces.chunk_limit(_table(spark, d, "size_limits")))
    return got.where("n_pieces > 1 and chunk_id is not null").select("chunk_id").distinct()


def p3_rejoined(spark: SparkSession, d: str) -> DataFrame:
    return pieces.rejoined(p3_pieces(spark, d).where("chunk_id is not null"), *pieces.chunk_limit(_table(spark, d, "size_limits")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.cut_captures(_table(spark, d, "raw_pages"), _table(spark, d, "source_manifest")).where("cut").select("page_id")


def p4_sources(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.source_shares(_table(spark, d, "raw_pages"), _table(spark, d, "source_manifest"))


def p4_limits(spark: SparkSession, d: str) -> DataFrame:
    seen = cutoff.inspected(_table(spark, d, "raw_pages"))
    return cutoff.field_limits(cutoff.captures(seen, _table(spark, d, "source_manifest")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return mainbody.not_main_body(_table(spark, d, "raw_pages"))


def p5_main_text(spark: SparkSession, d: str) -> DataFrame:
    return mainbody.main_bodies(_table(spark, d, "raw_pages")).distinct()


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(packing.sized_documents(_table(spark, d, "documents")), _table(spark, d, "size_limits"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_containers(spark, d), _table(spark, d, "size_limits"))


def p6_placed(spark: SparkSession, d: str) -> DataFrame:
    sized, limits = packing.sized_documents(_table(spark, d, "documents")), _table(spark, d, "size_limits")
    return packing.placed(packing.containers(sized, limits), sized, limits)


def p7_draws(spark: SparkSession, d: str) -> DataFrame:
    return mixing.draw(packing.sized_documents(_table(spark, d, "documents")), _table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.draw(packing.sized_documents(_table(spark, d, "documents")), _table(spark, d, "mix_targets"))[1]


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent_forms(_table(spark, d, "documents"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_classes(_table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_pairs(_table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("p") and k[1].isdigit()}
