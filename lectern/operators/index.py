"""The lexical index as DataFrames: postings, document frequencies and weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.config import EVALUATION_STOPWORDS, SEARCH_STOPWORDS
from lectern.functions.text import tokens
from lectern.plans.staging import stage, within


def corpus(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``title``, ``source_url``, ``text``, ``retrieved``, ``pos`` of a table that may lack the last two.

    ``pos`` is the order that breaks ties; a document's id where the table has none. Null titles and texts are empty.
    """
    has = set(documents.columns)
    return documents.select(
        "doc_id",
        F.coalesce("title", F.lit("")).alias("title"),
        "source_url",
        F.coalesce("text", F.lit("")).alias("text"),
        (F.col("retrieved") if "retrieved" in has else F.lit(None).cast("string")).alias("retrieved"),
        (F.col("pos") if "pos" in has else F.col("doc_id")).alias("pos"),
    )


def require_unique(docs: DataFrame, key: str = "doc_id") -> None:
    """Raises if an id is null or stands in two rows."""
    bad = docs.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).select(key).limit(5).collect()
    if bad:
        raise ValueError(f"{key} must be unique and not null: {[r[0] for r in bad]}")


def term_frequencies(docs: DataFrame, text: Column, stopwords: tuple[str, ...], *keys: str) -> DataFrame:
    """``keys``, ``term``, ``tf``: how often a document has each term."""
    return docs.select(*keys, F.explode(tokens(text, stopwords)).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    """``term``, ``df``: in how many documents a term stands."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def serving_text() -> Column:
    return F.concat_ws(" ", "title", "text")


@dataclass(frozen=True)
class Index:
    """A corpus of ``n`` documents with its postings (``term``, ``doc_id``, ``pos``, ``w``), staged and ready for any number of searches."""

    docs: DataFrame
    postings: DataFrame
    n: int


def build_index(docs: DataFrame) -> Index:
    """The index for answering: a posting weighs ln(N/df) x (1 + 0.1 (tf - 1)), over title and text.

    Ids that are null or repeated are an error. Postings of terms that all documents have weigh nothing and are left out, which changes no score.
    """
    require_unique(docs)
    n = docs.count()
    tf = stage(term_frequencies(docs, serving_text(), SEARCH_STOPWORDS, "doc_id", "pos"), "tf")
    idf = document_frequencies(tf).where(F.col("df") < n).select("term", F.log(F.lit(float(n)) / F.col("df")).alias("idf"))
    postings = tf.join(idf, "term").select("term", "doc_id", "pos", (F.col("idf") * (1 + 0.1 * (F.col("tf") - 1))).alias("w"))
    return Index(docs, stage(postings, "postings"), n)


def smoothed_idf(df: Column, n: int) -> Column:
    """ln((N + 1)/(df + 1)) + 1; a term that the corpus lacks has df 0."""
    return F.log(F.lit(float(n + 1)) / (df + 1)) + 1


def unit_vectors(tf: DataFrame, idf: DataFrame, n: int, *keys: str) -> DataFrame:
    """``keys``, ``term``, ``w``: (1 + ln tf) x idf over the vector's length. Terms that ``idf`` lacks weigh as unseen ones."""
    unseen = smoothed_idf(F.lit(0), n)
    raw = tf.join(idf, "term", "left").select(*keys, "term", ((1 + F.log("tf")) * F.coalesce("idf", unseen)).alias("raw"))
    norm = raw.groupBy(*keys).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, list(keys)).select(*keys, "term", (F.col("raw") / F.col("norm")).alias("w"))


def evaluation_postings(texts: DataFrame, asked: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame, int]:
    """The weights of the terms in ``asked`` (``term``, distinct) in the unit vectors of ``texts`` (``keys``, ``text``), the idf of all terms (staged), and how many texts there are.

    Lengths are of whole vectors; weights of terms that aren't asked are only summed.
    """
    n = texts.count()
    tf = stage(term_frequencies(texts, F.col("text"), EVALUATION_STOPWORDS, *keys), "tf")
    idf = stage(document_frequencies(tf).select("term", "df", smoothed_idf(F.col("df"), n).alias("idf")), "idf")
    raw = tf.join(idf, "term").select(*keys, "term", ((1 + F.log("tf")) * F.col("idf")).alias("raw"))
    marked = raw.join(F.broadcast(asked.withColumn("asked", F.lit(True))) if within(asked, 100_000) else asked.withColumn("asked", F.lit(True)), "term", "left")
    one = marked.groupBy(*keys).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"), F.collect_list(F.when(F.col("asked"), F.struct("term", "raw"))).alias("p"))
    return one.where(F.size("p") > 0).select(*keys, "norm", F.explode("p").alias("p")).select(*keys, "p.term", (F.col("p.raw") / F.col("norm")).alias("w")), idf, n
