import random

from hypothesis import given
from hypothesis import strategies as st

from lectern.llm.budget import chunk_counts, token_budget
from lectern.llm.tokens import counter

CHUNK = "chunk_id string, source_id string, lang string, scope string, text string, n_tokens int"


@given(st.lists(st.sampled_from([*"ab9é!字 \n\t'", "'s", "\u00a0", "\r\n", "  "]), max_size=30))
def test_pieces_add_up_to_the_whole(parts):
    text, c = "".join(parts), counter()
    assert c.count(text) == len(c.encode(text))


def rows_by_level(df):
    return {(r.level, r.source, r.language, r.domain): (r.n_chunks, r.n_tokens) for r in df.collect()}


def test_budget_against_brute_force(spark):
    rng = random.Random(3)
    texts = ["One text.", "Another  text,\nlonger.", "", None, "字体 and letters", "One text."]
    rows = []
    for i in range(60):
        t = rng.choice(texts)
        row = (f"c{i}", rng.choice(["src1", " SRC1", "src2", None]), rng.choice(["en", "EN", "en-GB", None, "fr"]), rng.choice(["general", "General ", None]), t, 7)
        rows += [row] * rng.choice([1, 1, 3])
    df = spark.createDataFrame(rows, CHUNK)
    got = rows_by_level(token_budget(df))
    assert rows_by_level(token_budget(df, broadcast_rows=0)) == got
    assert {(r.level, r.source, r.language, r.domain, r.n_chunks) for r in chunk_counts(df).collect()} == {(*k, n) for k, (n, _) in got.items()}
    want, c = {}, counter()
    for _, s, la, d, t, _ in {r[0]: r for r in rows}.values():
        s, la, d = s and s.strip().lower(), la and la.lower()[:2], d and d.strip().lower()
        n = len(c.encode(t)) if t else 0
        for k in (("all", None, None, None), ("source", s, None, None), ("language", None, la, None), ("domain", None, None, d), ("slice", s, la, d)):
            a, b = want.get(k, (0, 0))
            want[k] = (a + 1, b + n)
    assert got == want


def test_empty_and_missing_ids(spark):
    assert token_budget(spark.createDataFrame([], CHUNK)).count() == 0
    rows = [(None, "s", "en", "g", "a b", 1), (None, "s", "en", "g", "a b", 1), (None, "s", "en", "g", "c", 1)]
    assert rows_by_level(token_budget(spark.createDataFrame(rows, CHUNK)))["all", None, None, None][0] == 2


def test_one_very_long_text(spark):
    text = "word and more words, " * 20_000
    got = rows_by_level(token_budget(spark.createDataFrame([("c", "s", "en", "g", text, 1)], CHUNK)))
    assert got["all", None, None, None] == (1, len(counter().encode(text)))
