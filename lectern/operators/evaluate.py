"""The retrieval evaluation: cosine search over texts and its verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.config import ACCEPTED, EVALUATION_STOPWORDS
from lectern.operators.index import evaluation_postings, term_frequencies, unit_vectors
from lectern.operators.search import top_products
from lectern.plans.staging import stage


def cosine_search(texts: DataFrame, questions: DataFrame, k: int = 1) -> DataFrame:
    """``qid``, ``rank``, ``doc_id``, ``score``: the ``k`` texts most similar to each question, above 0.

    ``texts`` has ``doc_id``, ``pos``, ``text``; ``questions`` has ``qid``, ``question``. Terms that no text has count in the question's length.
    """
    tf = stage(term_frequencies(questions, F.col("question"), EVALUATION_STOPWORDS, "qid"), "question-terms")
    vectors, idf, n = evaluation_postings(texts.select("doc_id", "pos", "text"), tf.select("term").distinct(), "doc_id", "pos")
    asked = stage(unit_vectors(tf, idf.select("term", "idf"), n, "qid").select(F.col("qid").alias("q"), "term", F.col("w").alias("qw")), "asked")
    found = top_products(vectors, asked, k, n, questions.count())
    return found.withColumnRenamed("q", "qid").select("qid", "rank", "doc_id", "score")


def verdicts(cases: DataFrame, hits: DataFrame, accepted: float = ACCEPTED) -> DataFrame:
    """``case_id``, ``top_source``, ``score``, ``passed`` of each case (``case_id``, ``expected``, ``escalate``).

    ``hits`` has the best hit of each case (``qid``, ``source_id``, ``score``). A case passes if its best hit is of an expected source and scores ``accepted`` at least;
    one to be escalated if it scores less. No hit is a score of 0.
    """
    rows = cases.join(hits.select(F.col("qid").alias("case_id"), "source_id", "score"), "case_id", "left")
    score = F.coalesce("score", F.lit(0.0))
    good = F.coalesce(F.array_contains("expected", F.col("source_id")), F.lit(False)) & (score >= accepted)
    return rows.select("case_id", F.col("source_id").alias("top_source"), score.alias("score"), F.when(F.col("escalate"), score < accepted).otherwise(good).alias("passed"))


def pass_count(judged: DataFrame) -> DataFrame:
    """``passed``, ``cases``, one row."""
    return judged.agg(F.count_if("passed").alias("passed"), F.count("*").alias("cases"))


def parse_expected(expected: str, escalate: str = "ESCALATE") -> tuple[list[str], bool]:
    """Expected sources as a list, from ids joined by ``|`` or the mark of a case to be escalated."""
    return ([], True) if expected == escalate else (expected.split("|"), False)
