import random

from hypothesis import given
from hypothesis import strategies as st

from lectern.llm import lookalike as L
from lectern.llm.lookalike import LOOK_ALIKE, Skeletons, consistent_forms, look_alike_classes, look_alike_pairs, public_table

skeleton = Skeletons(LOOK_ALIKE)
DOC = "doc_id long, text string, class_id string, t1 string"


def test_what_makes_no_difference():
    plain = "The office-x é 人 Scope fi"
    for other in ("Ｔｈｅ office-x é 人 Scope fi", "The oﬃce‑x é ⼈ Ѕсоре ﬁ", "The of​fice‐x é 人 Sco­pe fi"):
        assert skeleton(other) == skeleton(plain)


def test_what_does():
    for a, b in (("a", "A"), ("m2", "m²"), ("1", "l"), ("0", "O"), ("e", "é"), ("a.", "a…"), ("a b", "ab"), ("…", "..."), ("½", "1/2"), ("“a”", '"a"'), ("a–b", "a-b"), ("й", "и")):
        assert skeleton(a) != skeleton(b), (a, b)


@given(st.text(max_size=60))
def test_applied_twice_changes_nothing(text):
    assert skeleton(skeleton(text)) == skeleton(text)


def test_prototypes_are_their_own():
    assert not set(LOOK_ALIKE) & set(LOOK_ALIKE.values())


def test_public_table(spark):
    table = public_table(spark)
    whole = Skeletons(table)
    assert len(table) > 600 and not set(table) & set(table.values()) and not any(ch.isascii() for ch in table)
    for a, b in (("Ꭺ", "A"), ("Ⲟ", "O"), ("ᴏᴄʏ", "ocy"), ("𐐄", "O"), ("Ь", "b"), ("ѡ", "w"), ("к", "κ"), ("Ι", "I"), ("І", "I"), ("ѕсоре", "scope")):
        assert whole(a) == whole(b), (a, b)
    for a, b in (("I", "l"), ("1", "l"), ("0", "O"), ("æ", "ae"), ("ø", "o"), ("ß", "ss"), ("й", "и"), ("人", "入"), ("m", "rn"), ("ẞ", "ß")):
        assert whole(a) != whole(b), (a, b)
    for ch in map(chr, range(0x80, 0x3000)):
        assert whole(whole(ch)) == whole(ch)


def test_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "SALT_ROWS", 3)
    rng = random.Random(5)
    base = ["Scope of aid", "fee waiver", "Note é", "", "plain"]

    def vary(t):
        return "".join(rng.choice([c, c, {"o": "о", "e": "е", " ": " ", "é": "é"}.get(c, c)]) for c in t)

    rows = [(i, None if i % 17 == 0 else vary(rng.choice(base)), "x", "y") for i in range(70)] + [(1, None, "x", "y")]
    rows += rows[5:9]
    df = spark.createDataFrame(rows, DOC)
    skeleton = Skeletons(public_table(spark))
    docs = {(r[0], r[1]) for r in rows if r[1] is not None}
    want = {(a, b) for a, x in docs for b, y in docs if a < b and x != y and skeleton(x) == skeleton(y)}
    got = [(r.doc_id_a, r.doc_id_b) for r in look_alike_pairs(df).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want
    assert {r.doc_id for r in look_alike_classes(df).collect()} == {d for p in want for d in p}


def test_nulls_and_empty(spark):
    assert consistent_forms(spark.createDataFrame([(1, None, "", "")], DOC)).first().form is None
    assert look_alike_pairs(spark.createDataFrame([], DOC)).count() == 0
