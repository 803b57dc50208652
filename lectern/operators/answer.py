"""From questions to cited responses: route, retrieve, gate, generate, assemble."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.config import ROUTING_RULES, Settings
from lectern.functions.text import strip
from lectern.operators.index import Index
from lectern.operators.search import search, support_gate
from lectern.plans.staging import stage

#: Values of ``support_status``.
STATUSES = ("supported", "unsupported", "escalated")
SOURCES = "array<struct<title:string,url:string>>"
#: Takes (``qid``, ``question``, ``context``, ``top_text``), returns (``qid``, ``text``); a null text is a refusal.
Generator = Callable[[DataFrame], DataFrame]


def valid_questions(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions of at least one character before trimming, and the others: empty and null ones."""
    ok = F.coalesce(F.length("question") >= 1, F.lit(False))
    return questions.where(ok), questions.where(~ok)


def rule_hits(question: Column, rules: dict[str, str] | None = None) -> list[Column]:
    """A boolean column for each routing rule, named as the rule."""
    q = F.lower(strip(F.coalesce(question, F.lit(""))))
    return [q.rlike(p).alias(name) for name, p in (rules or ROUTING_RULES).items()]


def needs_person(question: Column, rules: dict[str, str] | None = None) -> Column:
    """Whether any routing rule matches."""
    out = F.lit(False)
    for hit in rule_hits(question, rules):
        out = out | hit
    return out


def cited(passages: DataFrame) -> DataFrame:
    """``qid``, ``rank``, ``title``, ``url``: the sources of a question's passages, each URL once, under its first title, in rank order from 1.

    ``passages`` has ``qid``, ``rank``, ``title``, ``source_url``. Null URLs are one URL.
    """
    first = passages.withColumn("nth", F.row_number().over(Window.partitionBy("qid", "source_url").orderBy("rank"))).where("nth = 1")
    order = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    return first.select("qid", order.alias("rank"), "title", F.col("source_url").alias("url"))


def contexts(passages: DataFrame) -> DataFrame:
    """``qid``, ``context``, ``top_text``: a question's passages as labelled blocks with blank lines between, and its best passage."""
    block = F.concat(F.lit("["), "title", F.lit(" — "), F.coalesce("source_url", F.lit("")), F.lit("]\n"), "text")
    rows = passages.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("block"), "text"))).alias("p"))
    return rows.select("qid", F.array_join(F.transform("p", lambda x: x.block), "\n\n").alias("context"), F.col("p")[0].text.alias("top_text"))


def extract_generator(settings: Settings) -> Generator:
    """Answers with the best passage itself."""
    return lambda asked: asked.select("qid", F.concat(F.lit(settings.messages.extract), strip(F.col("top_text"))).alias("text"))


#: Takes the rules and a prompt, returns an answer or, if the model declines, None.
Model = Callable[[str, str], "str | None"]
RULES = """Answer only from the passages given. If they don't hold the answer, say so and name whom to ask. Be brief and factual.
Don't predict decisions about a person, don't give legal advice, don't promise anything, and don't add facts, dates or figures."""


def hosted_generator(model: Callable[[], Model], rules: str = RULES) -> Generator:
    """Answers with a hosted model. ``model`` is called once per task and makes the client there, so that a client never travels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = model()
        for b in batches:
            said = [ask(rules, f"Passages:\n{c}\n\nQuestion: {q}") for c, q in zip(b["context"], b["question"], strict=True)]
            yield pd.DataFrame({"qid": b["qid"], "text": pd.Series([s.strip() if s is not None else None for s in said], dtype=object)})

    return lambda asked: asked.select("qid", "question", "context").mapInPandas(run, f"qid {dict(asked.dtypes)['qid']}, text string")


def passages_of(index: Index, questions: DataFrame, settings: Settings) -> DataFrame:
    """The supported passages of questions that no rule routes away: ``qid``, ``rank``, ``doc_id``, ``score``, ``best`` and the document's columns."""
    asked = questions.where(~needs_person(F.col("question"))).select("qid", strip(F.col("question")).alias("question"))
    kept = support_gate(search(index, asked, settings.top_k), settings)
    return kept.join(index.docs.select("doc_id", "title", "source_url", "text"), "doc_id")


def answer(index: Index, questions: DataFrame, settings: Settings | None = None, generator: Generator | None = None) -> DataFrame:
    """One response for each valid question (``qid``, ``question``; ``qid`` unique): ``answer``, ``sources``, ``support_status``, ``escalation``, ``model``.

    A question that a rule routes to a person is escalated and not searched. One without a passage that clears the gate is unsupported. The rest
    go to the generator; where it returns null the response is unsupported under the generator's name, without sources. Blank questions are unsupported.
    """
    settings = settings or Settings()
    if generator is None and settings.generator == "hosted":
        raise ValueError("the hosted backend needs a generator")
    say, name = settings.messages, settings.generator
    asked, _ = valid_questions(questions)
    asked = asked.withColumn("routed", needs_person(F.col("question")))
    passages = stage(passages_of(index, asked, settings), "passages")
    prompt = contexts(passages).join(asked.select("qid", strip(F.col("question")).alias("question")), "qid")
    texts = (generator or extract_generator(settings))(prompt)
    sources = cited(passages).groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "title", "url"))), lambda s: F.struct(s.title.alias("title"), s.url.alias("url"))).alias("cited"))
    rows = asked.join(texts.withColumn("generated", F.lit(True)), "qid", "left").join(sources, "qid", "left")
    done = F.col("text").isNotNull()
    none = F.array().cast(SOURCES)
    status = F.when(F.col("routed"), F.lit("escalated")).when(done, F.lit("supported")).otherwise(F.lit("unsupported"))
    text = F.when(F.col("routed"), F.lit(say.escalated)).when(done, F.col("text")).when(F.col("generated"), F.lit(say.declined)).otherwise(F.lit(say.unsupported))
    return rows.select(
        "qid",
        text.alias("answer"),
        F.when(done, F.coalesce("cited", none)).otherwise(none).alias("sources"),
        status.alias("support_status"),
        F.when(~done, F.lit(say.escalation)).alias("escalation"),
        F.when(F.col("generated"), F.lit(name)).otherwise(F.lit("policy")).alias("model"),
    )


def as_json(responses: DataFrame) -> DataFrame:
    """``qid``, ``json``: responses as JSON objects in which null fields are present."""
    return responses.select("qid", F.to_json(F.struct("answer", "sources", "support_status", "escalation", "model"), {"ignoreNullFields": "false"}).alias("json"))


def as_lines(responses: DataFrame) -> DataFrame:
    """``qid``, ``shown``: responses as a console would print them."""
    bullets = F.when(F.size("sources") > 0, F.concat(F.lit("\nSources:\n"), F.array_join(F.transform("sources", lambda s: F.concat(F.lit("  - "), s.title, F.lit(": "), F.coalesce(s.url, F.lit("")))), "\n")))
    state = F.concat(F.lit("\n[support: "), "support_status", F.lit(" | backend: "), "model", F.lit("]"))
    return responses.select("qid", F.concat_ws("\n", "answer", bullets, F.concat(F.lit("\n"), "escalation"), state).alias("shown"))


def health(index: Index, settings: Settings) -> DataFrame:
    """``documents`` and ``backend``, one row."""
    return index.docs.agg(F.count("*").alias("documents")).withColumn("backend", F.lit(settings.generator))
