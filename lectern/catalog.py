"""The named queries of the core over the test tables, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import catalog_sql
from lectern.config import ROUTING_RULES, SEARCH_STOPWORDS, Settings
from lectern.functions.text import first_url, norm_url, normalize, sentences, strip, token_estimate, tokens
from lectern.operators import answer as A
from lectern.operators import chunk as C
from lectern.operators import clean as L
from lectern.operators import corpus as B
from lectern.operators import evaluate as E
from lectern.operators import index as I
from lectern.operators import neardup as N
from lectern.operators import quality as Q
from lectern.operators import search as S
from lectern.plans.staging import spread, stage, staged_path
from lectern.sources import files as X

Query = Callable[[SparkSession, str], DataFrame]
SETTINGS = Settings(backend="extract")


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/{name}.parquet"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return I.corpus(_table(spark, d, "documents"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "questions").where("question_id is not null").groupBy(F.col("question_id").alias("qid")).agg(F.min("question").alias("question"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return B.latest(_table(spark, d, "chunks"), "chunk_id", "ingested_at")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return B.latest(_table(spark, d, "raw_pages"), "page_id", "loaded_at")


def _qid(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("qid", "question_id")


# Index


def tokens_of(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(tokens(I.serving_text(), SEARCH_STOPWORDS), " ").alias("tokens"))


def term_freq(spark, d):
    return I.term_frequencies(_docs(spark, d), I.serving_text(), SEARCH_STOPWORDS, "doc_id")


def doc_freq(spark, d):
    return I.document_frequencies(term_freq(spark, d))


def idf(spark, d):
    docs = _docs(spark, d)
    n = docs.count()
    return I.document_frequencies(term_freq(spark, d)).select("term", "df", F.round(F.log(F.lit(float(n)) / F.col("df")), 6).alias("idf"))


# Retrieval and answers


def search_topk(spark, d):
    return _qid(S.search(I.build_index(_docs(spark, d)), _questions(spark, d), SETTINGS.top_k))


def search_top1(spark, d):
    return _qid(S.search(I.build_index(_docs(spark, d)), _questions(spark, d), 1)).drop("rank")


def best_score(spark, d):
    return _qid(S.best_scores(S.search(I.build_index(_docs(spark, d)), _questions(spark, d), SETTINGS.top_k)))


def support_gate(spark, d):
    return _qid(S.support_gate(S.search(I.build_index(_docs(spark, d)), _questions(spark, d), SETTINGS.top_k), SETTINGS))


def route_rule_hits(spark, d):
    return _qid(_questions(spark, d).select("qid", *A.rule_hits(F.col("question"))))


def route_escalation(spark, d):
    return _qid(_questions(spark, d).select("qid", A.needs_person(F.col("question")).alias("escalate")))


def rejected_questions(spark, d):
    return _qid(A.valid_questions(_questions(spark, d))[1].select("qid"))


def answer_pipeline(spark, d):
    got = A.answer(I.build_index(_docs(spark, d)), _questions(spark, d), SETTINGS)
    return _qid(got.withColumn("sources", F.array_join(F.transform("sources", lambda s: F.concat_ws("|", s.title, s.url)), "\n")))


def citations(spark, d):
    return _qid(A.cited(A.passages_of(I.build_index(_docs(spark, d)), _questions(spark, d), SETTINGS)))


def prompt_context(spark, d):
    return _qid(A.contexts(A.passages_of(I.build_index(_docs(spark, d)), _questions(spark, d), SETTINGS)).select("qid", F.md5("context").alias("context_md5")))


def health(spark, d):
    return A.health(I.Index(_docs(spark, d), _docs(spark, d), 0), SETTINGS)


# Captures and cleaning


def norm_urls(spark, d):
    return _table(spark, d, "source_manifest").select("url", norm_url(F.col("url")).alias("key")).distinct()


def first_urls(spark, d):
    return _pages(spark, d).select("page_id", first_url(F.col("text")).alias("first_url"))


def capture_match(spark, d):
    return L.match_captures(_pages(spark, d), _table(spark, d, "source_manifest")).select("page_id", "file")


def capture_argmax(spark, d):
    return L.largest_capture(_pages(spark, d)).select("file", "page_id", F.length("text").alias("n_chars"))


def clean_page(spark, d):
    return L.clean(_pages(spark, d)).select("page_id", "clean_text")


# Chunks


def sentence_counts(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.posexplode(sentences(normalize(F.col("text")))).alias("at", "sentence"))


def chunk_documents(spark, d):
    return C.chunk_pages(_table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def chunk_sizes(spark, d):
    return _chunks(spark, d).select("chunk_id", F.length("text").alias("chars"), token_estimate(F.col("text")).alias("estimate"))


def build_chunks(spark, d):
    return B.build_chunks(_pages(spark, d), _table(spark, d, "source_manifest"))


def chunk_ids(spark, d):
    rows = _chunks(spark, d).select(F.col("chunk_id").alias("file"), F.lit(1).alias("part"))
    return C.number_chunks(rows).select(F.col("file").alias("old_id"), "chunk_id")


def chunk_file(spark, d):
    """The chunk table written as CSV into the shared folder and read again."""
    path = staged_path(spark, "chunk-file")
    X.write_chunks(_chunks(spark, d), path)
    return X.read_chunks(spark, path)


def corpus_projection(spark, d):
    return B.documents_of(_chunks(spark, d))


def build_summary(spark, d):
    return B.build_summary(_chunks(spark, d))


# Gates


def size_stats(spark, d):
    return Q.size_stats(_chunks(spark, d))


def empty_chunks(spark, d):
    return Q.empty_chunks(_chunks(spark, d))


def dup_texts(spark, d):
    return Q.duplicate_texts(_chunks(spark, d))


def missing_cells(spark, d):
    return Q.missing_cells(_chunks(spark, d))


def bad_urls(spark, d):
    return Q.bad_urls(_chunks(spark, d))


def leak_counts(spark, d):
    return Q.leak_counts(_chunks(spark, d))


def dataset_gate(spark, d):
    return Q.dataset_gate(_chunks(spark, d))


def text_gate(spark, d):
    return Q.text_gate(_pages(spark, d), "page_id")


def text_gate_summary(spark, d):
    return Q.gate_summary(text_gate(spark, d))


def manifest_missing(spark, d):
    return Q.manifest_missing(_table(spark, d, "source_manifest"), _table(spark, d, "raw_pages"))


def manifest_orphans(spark, d):
    return Q.manifest_orphans(_table(spark, d, "source_manifest"), _table(spark, d, "raw_pages"))


def registry_differences(spark, d):
    return Q.registry_differences(_table(spark, d, "approved_sources"), _table(spark, d, "source_manifest"))


# Evaluation and near-duplicates


def eval_idf(spark, d):
    texts = _chunks(spark, d).select(F.col("chunk_id").alias("doc_id"), "text")
    tf = I.term_frequencies(texts, F.col("text"), I.EVALUATION_STOPWORDS, "doc_id")
    n = texts.count()
    return I.document_frequencies(tf).select("term", "df", F.round(I.smoothed_idf(F.col("df"), n), 6).alias("idf"))


def _eval_hits(spark, d) -> DataFrame:
    chunks = stage(_chunks(spark, d).select(F.col("chunk_id").alias("doc_id"), F.col("chunk_id").alias("pos"), "text", F.lower(strip(F.col("source_id"))).alias("source_id")), "texts")
    cases = _table(spark, d, "eval_cases").select(F.col("case_id").alias("qid"), "question")
    return E.cosine_search(chunks, cases).join(chunks.select("doc_id", "source_id"), "doc_id")


def cosine_top1(spark, d):
    return _eval_hits(spark, d).select(F.col("qid").alias("case_id"), F.col("doc_id").alias("chunk_id"), "score")


def eval_verdicts(spark, d):
    return E.verdicts(_table(spark, d, "eval_cases"), _eval_hits(spark, d))


def eval_passed(spark, d):
    return E.pass_count(eval_verdicts(spark, d))


def near_duplicates(spark, d):
    return N.near_duplicates(_chunks(spark, d).select(F.col("chunk_id").alias("id"), "text"))[0]


def first_near_duplicates(spark, d):
    return N.first_pairs(near_duplicates(spark, d))


def near_duplicate_links(spark, d):
    return N.near_duplicate_links(_chunks(spark, d).select(F.col("chunk_id").alias("id"), "text"))


_ALL = (
    tokens_of, term_freq, doc_freq, idf, search_topk, search_top1, best_score, support_gate, route_rule_hits, route_escalation, rejected_questions,
    answer_pipeline, citations, prompt_context, health, norm_urls, first_urls, capture_match, capture_argmax, clean_page, sentence_counts,
    chunk_documents, chunk_sizes, build_chunks, chunk_ids, chunk_file, corpus_projection, build_summary, size_stats, empty_chunks, dup_texts, missing_cells, bad_urls,
    leak_counts, dataset_gate, text_gate, text_gate_summary, manifest_missing, manifest_orphans, registry_differences, eval_idf, cosine_top1, eval_verdicts,
    eval_passed, near_duplicates, first_near_duplicates, near_duplicate_links,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return catalog_sql.oracle_sql(SETTINGS, ROUTING_RULES)
