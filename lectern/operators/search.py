"""Top-k retrieval for batches of questions, the support gate and best scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.config import SEARCH_STOPWORDS, Settings
from lectern.functions.text import tokens
from lectern.operators.index import Index
from lectern.plans.staging import broadcast_within, stage

#: Documents and queries of one block; a task holds one block of each.
BLOCK_DOCS, BLOCK_QUERIES = 4096, 2048
#: Most distinct terms of queries that are broadcast.
BROADCAST_TERMS = 500_000


def top_products(postings: DataFrame, queries: DataFrame, k: int, n_docs: int, n_queries: int) -> DataFrame:
    """``q``, ``doc_id``, ``pos``, ``score``: for each query the ``k`` documents with the largest sum of products of weights, above 0.

    ``postings`` are (``term``, ``doc_id``, ``pos``, ``w``), ``queries`` (``q``, ``term``, ``qw``). Scores are rounded to 6 digits before they are ranked; ties keep
    the order of ``pos``. A join on terms would make a row of every shared term of every pair; instead the product is computed
    in blocks, all queries against all documents: each task sums one block's columns into dense rows and hands on ``k`` rows a query.
    Block counts follow the two sizes, so a task's memory doesn't grow with them and no term is a hot key.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    db, qb = max(1, -(-n_docs // BLOCK_DOCS)), max(1, -(-n_queries // BLOCK_QUERIES))

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))

    # Only terms that a query has are looked at, as numbers; what no query asks isn't shipped.
    terms = broadcast_within(stage(queries.select("term").distinct().withColumn("t", F.monotonically_increasing_id()), "asked-terms"), BROADCAST_TERMS)
    # Aliases tell the two sides' columns apart, which the cogroup needs.
    postings = postings.join(terms, "term").select("doc_id", "pos", "w", F.col("t").alias("t"))
    queries = queries.join(terms, "term").select("q", "qw", F.col("t").alias("t"))
    p = postings.withColumn("db", F.pmod(F.xxhash64("doc_id"), F.lit(db))).withColumn("qb", every(qb))
    q = queries.withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(qb))).withColumn("db", every(db))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_block(left, right, k), columns=["q", "doc_id", "pos", "score"])

    id_type, q_type, pos_type = dict(postings.dtypes)["doc_id"], dict(queries.dtypes)["q"], dict(postings.dtypes)["pos"]
    found = p.groupBy("db", "qb").cogroup(q.groupBy("db", "qb")).applyInPandas(run, f"q {q_type}, doc_id {id_type}, pos {pos_type}, score double")
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "pos", "doc_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k)


def _block(left: pd.DataFrame, right: pd.DataFrame, k: int) -> list[tuple]:
    if left.empty or right.empty or not k:
        return []
    docs = left[["doc_id", "pos"]].drop_duplicates().sort_values(["pos", "doc_id"], ignore_index=True)
    at = docs.set_index("doc_id").index.get_indexer(left["doc_id"])
    order = np.argsort(left["t"].to_numpy(), kind="stable")
    at, weights, sorted_terms = at[order], left["w"].to_numpy()[order], left["t"].to_numpy()[order]
    ids, pos = docs["doc_id"].tolist(), docs["pos"].tolist()
    codes, names = pd.factorize(right["q"], sort=False)
    by_query = np.argsort(codes, kind="stable")
    asked, qw = right["t"].to_numpy()[by_query], right["qw"].to_numpy()[by_query]
    starts, ends = np.searchsorted(sorted_terms, asked, "left"), np.searchsorted(sorted_terms, asked, "right")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(names)))])
    score = np.zeros(len(ids))
    out = []
    for i, q in enumerate(names.tolist() if hasattr(names, "tolist") else list(names)):
        score[:] = 0
        for j in range(bounds[i], bounds[i + 1]):
            a, b = starts[j], ends[j]
            if b > a:
                # A document has a term once, so no place repeats.
                score[at[a:b]] += weights[a:b] * qw[j]
        hit = np.flatnonzero(score)
        hit = hit[score[hit] > 0]
        s = np.round(score[hit], 6)
        if len(hit) > k:
            least = np.partition(s, len(s) - k)[len(s) - k]
            keep = s >= least
            hit, s = hit[keep], s[keep]
        for i in np.argsort(-s, kind="stable")[:k]:
            out.append((q, ids[hit[i]], pos[hit[i]], s[i]))
    return out


def question_terms(questions: DataFrame) -> DataFrame:
    """``qid`` and ``terms``: the distinct terms of a question, sorted, so that equal questions have equal terms."""
    return questions.select("qid", F.array_sort(F.array_distinct(tokens(F.col("question"), SEARCH_STOPWORDS))).alias("terms"))


def search(index: Index, questions: DataFrame, k: int) -> DataFrame:
    """``qid``, ``rank``, ``doc_id``, ``score``: the best ``k`` documents of each question (``qid``, ``question``).

    How often a question repeats a term doesn't matter. Questions that ask the same terms are searched once. A question without a hit has no rows.
    """
    asked = stage(question_terms(questions).where(F.size("terms") > 0), "asked")
    sets = stage(asked.select("terms").distinct().withColumn("q", F.monotonically_increasing_id()), "asked-sets")
    n = sets.count()
    found = top_products(index.postings, sets.select("q", F.explode("terms").alias("term"), F.lit(1.0).alias("qw")), k, index.n, n)
    return asked.join(sets, "terms").select("qid", "q").join(found, "q").select("qid", "rank", "doc_id", "score")


def best_scores(hits: DataFrame) -> DataFrame:
    """``qid``, ``best``: the best score of each question that has a hit."""
    return hits.groupBy("qid").agg(F.max("score").alias("best"))


def support_gate(hits: DataFrame, settings: Settings) -> DataFrame:
    """The hits that are at least the threshold and at least the ratio of the question's best, with ``best``; both bounds are inclusive."""
    best = F.max("score").over(Window.partitionBy("qid"))
    kept = hits.withColumn("best", best)
    return kept.where(F.col("score") >= F.greatest(F.lit(settings.support_threshold), F.col("best") * settings.support_ratio))
