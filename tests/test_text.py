import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X


def apply(spark, f, values):
    return [r.y for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_strip_and_lines_agree_with_python(spark):
    rng = random.Random(4)
    values = ["".join(rng.choice(list("ab \t\n\r\x0b\x0c\x1c\x1e\x85   　​")) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    assert apply(spark, X.strip, values) == [v.strip() for v in values]
    assert apply(spark, X.lines, values) == [v.splitlines() or [""] for v in values]
    assert apply(spark, X.is_blank, [*values, None]) == [not v.strip() for v in values] + [True]
    assert apply(spark, X.collapse, values) == [" ".join(v.split()) for v in values]


def test_norm_url(spark):
    urls = ["HTTPS://A.x/p/index.html", "http://a.x/p/", "a.x/reindex", "a.x/p?q=1", " https://a.x// ", None]
    assert apply(spark, X.norm_url, urls) == ["a.x/p", "a.x/p", "a.x/re", "a.x/p?q=1", "a.x", None]


def test_sentences(spark):
    assert [len(s) for s in apply(spark, X.sentences, ["One. Two (x). (Three) four", "a.b C", "e.g. lower", ""])] == [3, 1, 1, 0]


def test_token_estimate_rounds_half_to_even(spark):
    assert apply(spark, X.token_estimate, ["x" * n for n in (2, 6, 10, 14)] + [None]) == [0, 2, 2, 4, None]


def test_first_url(spark):
    texts = ["a\nsee (https://x.y/z) and http://later", "\n" * 6 + "https://too.late", "", None]
    assert apply(spark, X.first_url, texts) == ["https://x.y/z", "", "", ""]


def test_tokens_and_labels(spark):
    assert apply(spark, lambda c: X.tokens(c, ("the",)), ["The GRE-2 é score", None]) == [["gre", "2", "score"], []]
    assert apply(spark, X.label, [" Program_specific  (MFE)", "program-specific (mfe)", None]) == ["program specific (mfe)"] * 2 + [None]


@pytest.mark.parametrize("text", ["a\r\nb", "a\rb"])
def test_newlines(spark, text):
    assert apply(spark, X.unify_newlines, [text]) == ["a\nb"]
