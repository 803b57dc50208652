import itertools
import math
import random
import re
from collections import Counter

from lectern.config import EVALUATION_STOPWORDS
from lectern.operators import quality as Q
from lectern.operators.evaluate import cosine_search, parse_expected, pass_count, verdicts
from lectern.operators.neardup import near_duplicate_links, near_duplicates
from lectern.sources import files as S

CHUNK = "chunk_id string, source_id string, source_title string, source_url string, scope string, topic string, content_version string, change_frequency string, date_accessed string, char_count int, token_estimate_approx int, text string"


def chunk(i, text="Some text.", url="https://a", size=10, scope="g"):
    return (f"c{i}", "s1", "T", url, scope, "t", "v", "High", "2031", size, 2, text)


def test_dataset_gate(spark):
    rows = [chunk(1), chunk(2, " Some text. "), chunk(3, "", None), chunk(4, None, "http://x", 951, " "), chunk(5, "x ![ y", size=None)]
    df = spark.createDataFrame(rows, CHUNK)
    report = {r["check"]: r.value for r in Q.dataset_gate(df).collect()}
    assert (report["rows"], report["empty"], report["bad_urls"], report["missing_cells"], report["duplicate_texts"], report["over_cap"], report["leak !["]) == (5, 2, 2, 4, 1, 1, 1)
    assert {r["column"]: r.missing for r in Q.missing_cells(df).collect() if r.missing} == {"text": 2, "source_url": 1, "scope": 1}
    assert [(r.trace, r["rows"]) for r in Q.leak_counts(df).collect()] == [("![", 1)]
    assert {r.chunk_id for r in Q.empty_chunks(df).collect()} == {"c3", "c4"} and Q.bad_urls(df).count() == 2
    assert tuple(Q.size_stats(df).first()) == (10, 10, 245, 951, 1, 3)
    assert tuple(Q.size_stats(df.limit(0)).first()) == (None, None, None, None, 0, 0)
    assert Q.dataset_gate(df.limit(0)).count() == len(report)


def test_text_gate(spark):
    texts = ["Good text here. " * 12, "short.", "Text that ends in the", "![ x" + " y" * 100 + ".", "", None]
    got = [r.issues for r in Q.text_gate(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "i").orderBy("i").collect()]
    assert got == ["", "short", "short; ends oddly; dangling word", "boilerplate: ![", "short", "short"]


def test_manifest_against_pages_and_registry(spark):
    m = spark.createDataFrame([("a", "src000001", "General", "High", "v1"), ("b", "SRC000002", "x", "Low", "v1"), (None, None, None, None, None)], "file string, source_id string, scope string, change_frequency string, content_version string")
    p = spark.createDataFrame([("a",), ("c",), (None,)], "file string")
    assert [r.file for r in Q.manifest_missing(m, p).collect()] == ["b"] and [r.file for r in Q.manifest_orphans(m, p).collect()] == ["c"]
    reg = spark.createDataFrame([("1", "general ", "high", "v2"), ("3", "x", "Low", "v1"), ("bad", None, None, None)], "id string, scope string, change_frequency string, content_version string")
    got = {(r.source_id, r.field, r.registry, r.manifest) for r in Q.registry_differences(reg, m).collect()}
    assert got == {("src000001", "content_version", "v2", "v1"), ("src000002", "source_id", None, "yes"), ("src000003", "source_id", "yes", None)}


def vectors(texts, n):
    bags = [Counter(w for w in re.findall("[a-z0-9]+", (t or "").lower()) if w not in EVALUATION_STOPWORDS) for t in texts]
    df = Counter(w for b in bags for w in b)
    raw = [{w: (1 + math.log(f)) * (math.log((n + 1) / (df[w] + 1)) + 1) for w, f in b.items()} for b in bags]
    return [{w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()} for v in raw]


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(9)
    base = [[rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 9)) for _ in range(30)] for _ in range(6)]
    texts = []
    for _ in range(90):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(30)] = f"new{rng.randint(0, 40)}"
        texts.append(" ".join(words))
    texts += texts[:15] + ["", None, "the of", " "]
    rows = [(f"d{i:03d}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, text string")
    v = vectors(texts, len(texts))
    reps = {}
    for i, t in enumerate(texts):
        if t and t.strip():
            reps.setdefault(t.strip(), i)
    for threshold in (0.9, 0.6):
        want = {}
        for i, j in itertools.combinations(sorted(reps.values()), 2):
            s = round(sum(x * v[j].get(w, 0) for w, x in v[i].items()), 6)
            if s > threshold:
                want[f"d{i:03d}", f"d{j:03d}"] = s
        pairs, who = near_duplicates(df, threshold)
        got = {(r.a, r.b): r.score for r in pairs.collect()}
        assert want and set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)
        assert {(r.id, r.rep) for r in who.collect()} == {(f"d{i:03d}", f"d{reps[t.strip()]:03d}") for i, t in enumerate(texts) if t and t.strip()}
    links = {r.id: r.links for r in near_duplicate_links(df).collect()}
    assert links["d000"] == links["d090"]
    assert near_duplicates(df.limit(0))[0].count() == 0


def test_evaluation(spark):
    texts = spark.createDataFrame([("a", "a", "tower hall key"), ("b", "b", "garden gate key"), ("c", "c", None)], "doc_id string, pos string, text string")
    asked = spark.createDataFrame([(1, "the tower hall"), (2, "unknown words garden"), (3, "nothing"), (4, "what is my")], "qid int, question string")
    hits = {r.qid: (r.doc_id, r.score) for r in cosine_search(texts, asked).collect()}
    assert hits[1][0] == "a" and hits[2][0] == "b" and hits[2][1] < hits[1][1] and set(hits) == {1, 2}
    cases = spark.createDataFrame([(1, ["s1"], False), (2, ["s1"], False), (3, [], True), (4, ["s1"], False)], "case_id int, expected array<string>, escalate boolean")
    judged = verdicts(cases, spark.createDataFrame([(1, "s1", 0.12), (2, "s2", 0.9)], "qid int, source_id string, score double"))
    assert {r.case_id: r.passed for r in judged.collect()} == {1: True, 2: False, 3: True, 4: False}
    assert tuple(pass_count(judged).first()) == (2, 4)
    assert parse_expected("a|b") == (["a", "b"], False) and parse_expected("ESCALATE") == ([], True)


def test_files(spark, tmp_path):
    rows = [chunk(1, 'with "quotes", commas\nand lines'), chunk(2, "é")]
    df = spark.createDataFrame(rows, CHUNK)
    S.write_chunks(df, str(tmp_path / "csv"))
    assert sorted(map(tuple, S.read_chunks(spark, str(tmp_path / "csv")).collect())) == sorted(rows)
    (tmp_path / "c.json").write_text('[{"id": "a", "title": "T", "source_url": "u", "text": "x", "extra": 1, "scope": "g"}]')
    doc = S.read_corpus(spark, str(tmp_path / "c.json"), passed_on=True).first()
    assert (doc.id, doc.retrieved, doc.scope) == ("a", None, "g")
    assert '"retrieved":null' in S.corpus_array(S.read_corpus(spark, str(tmp_path / "c.json")))
    (tmp_path / "bad.json").write_text('[{"id": "a", "title": "T", "source_url": "u"}]')
    try:
        S.read_corpus(spark, str(tmp_path / "bad.json"))
        raise AssertionError
    except ValueError:
        pass
    (tmp_path / "m.json").write_text('{"date_accessed": "2031", "sources": [{"file": "f.txt", "source_id": "s", "url": "https://x.y/p/", "title": "t", "scope": "g", "topic": "t", "content_version": "v", "change_frequency": "h"}]}')
    manifest = S.read_manifest(spark, str(tmp_path / "m.json"))
    assert (manifest.first().date_accessed, S.manifest_index(manifest).first().key, S.manifest_files(manifest).count()) == ("2031", "x.y/p", 1)
    S.write_pages(spark.createDataFrame([("f.txt", "a\nb")], "file string, text string"), str(tmp_path / "pages"))
    assert next((tmp_path / "pages" / "file=f.txt").glob("*.txt")).read_text() == "a\nb\n"
    (tmp_path / "txt").mkdir()
    (tmp_path / "txt" / "p.txt").write_bytes(b"one\r\ntwo")
    assert [tuple(r) for r in S.read_pages(spark, str(tmp_path / "txt")).collect()] == [("p.txt", "one\ntwo")]
    for name, content in (("x/tool-results/a.json", b'{"text": "hello"}'), ("x/other/b.json", b"{}"), ("x/tool-results/bad.json", b"\xff\xfe")):
        path = tmp_path / "cap" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    assert [r.text for r in S.read_captures(spark, [str(tmp_path / "cap")]).collect()] == ["hello"]
    (tmp_path / "r.csv").write_text('id,page_title,url,topic,scope,date_accessed,change_frequency,content_version,notes\n1,"A ""b"", c",u,t,s,d,f,v,\n')
    assert S.read_registry(spark, str(tmp_path / "r.csv")).first().page_title == 'A "b", c'
    S.write_corpus(df.select("chunk_id", "text"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
