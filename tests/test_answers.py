import math

import pytest
from pyspark.sql import functions as F

from lectern.config import Settings
from lectern.operators import answer as A
from lectern.operators.index import build_index, corpus, require_unique
from lectern.operators.search import best_scores, search, support_gate, top_products
from lectern.plans.shell import run
from lectern.streaming.answers import answer_stream

SETTINGS = Settings(backend="extract")
DOCS = [(1, "", "u1", "gre gre exam"), (2, "", "u2", "exam fee"), (3, None, "u1", "fee waiver")]


@pytest.fixture(scope="module")
def index(spark):
    return build_index(corpus(spark.createDataFrame(DOCS, "doc_id long, title string, source_url string, text string")))


def ask(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "qid long, question string")


def test_scores(spark, index):
    hits = search(index, ask(spark, "gre exam", "fee", "gre gre exam", "waiver fee", "zzz", "", None), 3).collect()
    got = {}
    for r in sorted(hits, key=lambda r: (r.qid, r["rank"])):
        got.setdefault(r.qid, []).append((r.doc_id, r.score))
    low, high = round(math.log(1.5), 6), round(math.log(3) * 1.1 + math.log(1.5), 6)
    assert got[0] == got[2] == [(1, high), (2, low)]
    assert got[1] == [(2, low), (3, low)]
    assert got[3] == [(3, round(math.log(3) + math.log(1.5), 6)), (2, low)]
    assert set(got) == {0, 1, 2, 3}


def test_k(spark, index):
    assert search(index, ask(spark, "fee"), 0).count() == 0
    assert [r.doc_id for r in search(index, ask(spark, "fee"), 1).collect()] == [2]
    with pytest.raises(ValueError):
        search(index, ask(spark, "fee"), -1)


def test_blocks_don_t_change_the_result(spark, monkeypatch):
    import lectern.operators.search as S

    rows = [(f"t{(i * j) % 23}", i, i, float((i * 7 + j) % 5) / 7) for i in range(60) for j in range(1, 6)]
    postings = spark.createDataFrame(sorted({(a, b): (a, b, c, d) for a, b, c, d in rows}.values()), "term string, doc_id long, pos long, w double")
    queries = spark.createDataFrame([(q, f"t{(q + j) % 23}", 1.0) for q in range(40) for j in range(3)], "q long, term string, qw double")
    whole = sorted(map(tuple, top_products(postings, queries, 5, 60, 40).select("q", "rank", "doc_id", "score").collect()))
    monkeypatch.setattr(S, "BLOCK_DOCS", 7)
    monkeypatch.setattr(S, "BLOCK_QUERIES", 9)
    assert sorted(map(tuple, top_products(postings, queries, 5, 60, 40).select("q", "rank", "doc_id", "score").collect())) == whole
    joined = postings.join(queries, "term").groupBy("q", "doc_id").agg(F.round(F.sum(F.col("w") * F.col("qw")), 6).alias("s")).where("s > 0").collect()
    best = {}
    for r in sorted(joined, key=lambda r: (r.q, -r.s, r.doc_id)):
        best.setdefault(r.q, []).append((r.doc_id, r.s))
    assert [(q, d, s) for q, _, d, s in whole] == [(q, d, s) for q in sorted(best) for d, s in best[q][:5]]


def test_gate(spark):
    hits = spark.createDataFrame([(1, 1, 1, 4.0), (1, 2, 2, 2.0), (1, 3, 3, 1.9), (2, 1, 1, 0.9)], "qid long, rank int, doc_id long, score double")
    assert {(r.qid, r.doc_id) for r in support_gate(hits, SETTINGS).collect()} == {(1, 1), (1, 2)}
    assert {(r.qid, r.best) for r in best_scores(hits).collect()} == {(1, 4.0), (2, 0.9)}


def test_routing(spark):
    yes = ["what are my chances", "will i be admitted", "odds of being accepted", "getting in", "visa rules", "Legal help", "please review my essay"]
    no = ["visas", "guaranteed aid", "is the gre required", "paralegal", "odds\nof being accepted", "", None]
    got = [r.e for r in ask(spark, *yes, *no).orderBy("qid").select(A.needs_person(F.col("question")).alias("e")).collect()]
    assert got == [True] * len(yes) + [False] * len(no)


def test_citations(spark):
    rows = [(1, 1, "T1", "u1"), (1, 2, "T2", "u1"), (1, 4, "T3", "u2"), (2, 1, "T4", None), (2, 2, "T5", None)]
    got = A.cited(spark.createDataFrame(rows, "qid long, rank int, title string, source_url string")).collect()
    assert {(r.qid, r["rank"], r.title, r.url) for r in got} == {(1, 1, "T1", "u1"), (1, 2, "T3", "u2"), (2, 1, "T4", None)}


def test_three_routes(spark, index):
    got = {r.qid: r for r in A.answer(index, ask(spark, "gre exam", "zzz", "my chances with gre", "  ", "", None), SETTINGS).collect()}
    assert [got[i].support_status for i in range(4)] == ["supported", "unsupported", "escalated", "unsupported"] and set(got) == {0, 1, 2, 3}
    assert got[0].answer.endswith("gre gre exam") and [s.url for s in got[0].sources] == ["u1"] and got[0].escalation is None and got[0].model == "extract"
    assert all(got[i].sources == [] and got[i].escalation and got[i].model == "policy" for i in (1, 2, 3))


def test_declining_generator(spark, index):
    def decline(asked):
        return asked.select("qid", F.lit(None).cast("string").alias("text"))

    r = A.answer(index, ask(spark, "gre exam"), Settings(backend="hosted"), decline).first()
    assert (r.support_status, r.sources, r.model) == ("unsupported", [], "hosted") and r.escalation
    with pytest.raises(ValueError):
        A.answer(index, ask(spark, "gre exam"), Settings(backend="hosted"))


def test_hosted_generator(spark, index):
    fake = A.hosted_generator(lambda: lambda rules, prompt: f" {prompt.count('[')} passages " if "gre" in prompt else None)
    got = {r.qid: r for r in A.answer(index, ask(spark, "gre exam", "waiver fee"), Settings(backend="hosted"), fake).collect()}
    assert got[0].answer == "1 passages" and got[1].support_status == "unsupported"


def test_shown_forms(spark, index):
    got = A.answer(index, ask(spark, "gre exam", "zzz"), SETTINGS)
    assert '"escalation":null' in A.as_json(got).where("qid = 0").first().json
    said = []
    run(spark, index, ["gre", "exam"], SETTINGS, say=said.append)
    run(spark, index, [], SETTINGS, lines=["", "zzz\n"], say=said.append)
    assert len(said) == 2 and "Sources:" in said[0] and "unsupported | backend: policy" in said[1]
    assert A.health(index, SETTINGS).first() == (3, "extract")


def test_small_and_empty_corpora(spark):
    one = build_index(corpus(spark.createDataFrame(DOCS[:1], "doc_id long, title string, source_url string, text string")))
    assert A.answer(one, ask(spark, "gre"), SETTINGS).first().support_status == "unsupported"
    none = build_index(corpus(spark.createDataFrame([], "doc_id long, title string, source_url string, text string, retrieved string, pos long, score double")))
    assert A.answer(none, ask(spark, "gre"), SETTINGS).first().support_status == "unsupported"
    with pytest.raises(ValueError):
        require_unique(spark.createDataFrame([(1,), (1,)], "doc_id long"))


def test_settings():
    s = Settings.from_env({"TOP_K": "5", "SUPPORT_RATIO": "0.25", "API_KEY": "k", "OTHER": "x"})
    assert (s.top_k, s.support_ratio, s.generator, Settings().generator) == (5, 0.25, "hosted", "extract")
    for bad in ({"top_k": -1}, {"backend": "else"}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_stream(spark, index, tmp_path):
    ask(spark, "gre exam", "zzz").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("qid long, question string").parquet(str(tmp_path / "in"))
    q = answer_stream(stream, index, str(tmp_path / "out"), str(tmp_path / "cp"), SETTINGS)
    q.awaitTermination(120)
    assert {r.support_status for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"supported", "unsupported"}
