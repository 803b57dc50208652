import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm.pieces import pieces_of, split_oversized, tree


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["word", "a", " ", "\n", "\n\n", ". ", "# H\n", "- item\n", "字。", "x" * 45, "é", " "]), max_size=120), st.integers(21, 60), st.integers(0, 10))
def test_round_trip(parts, limit, overlap):
    text = "".join(parts)
    got = pieces_of(text, limit, overlap)
    bare = text.strip()
    assert all(len(p) <= limit and p == bare[s:e] for s, e, p in got)
    if not bare:
        assert got == []
        return
    whole = got[0][2]
    for (s0, e0, _), (s, _, p) in zip(got, got[1:], strict=False):
        shared = e0 - s
        assert shared == min(overlap, e0 - s0)
        whole += p[shared:]
    assert whole == bare
    assert len(bare) > limit or len(got) == 1


def own(text, limit, overlap):
    """What the pieces hold beyond their overlap."""
    got, last = [], 0
    for _, e, _ in pieces_of(text, limit, overlap):
        got.append(text[last:e].strip())
        last = e
    return got


def test_natural_ends():
    text = "# One\n\n" + "A sentence here. " * 10 + "\n\n# Two\n\n" + "Another one there. " * 10
    assert {p[-1] for p in own(text, 100, 20)} == {"."}


def test_no_piece_crosses_an_opened_section():
    text = "# One\n\n" + "A sentence here. " * 8 + "\n\n# Two\n\n" + "Another one there. " * 8 + "\n\n# Three\n\nShort.\n\n# Four\n\nShort too."
    got = own(text, 100, 20)
    assert any(p.startswith("# Two") for p in got) and not any("# Two" in p[1:] for p in got)
    assert got[-1] == "# Three\n\nShort.\n\n# Four\n\nShort too."  # whole sections are merged


def test_headings_go_with_what_follows():
    for n in range(1, 40):
        text = "# Top\n\n" + "x" * n + ".\n\n## Under\n\n" + "Words of a sentence. " * 7 + "\n\n### Deep\n\n| a | b |\n| c | d |\n" + "| eee | fff |\n" * 9
        for p in own(text, 80, 10):
            assert not p.splitlines()[-1].startswith("#"), (n, p)


def test_lists_and_tables_are_cut_between_items():
    text = "- one\n" + "  - inner item of one\n" * 4 + "- two " + "w " * 12 + "\n- three\n\n" + "| row | cell |\n" * 8
    got = own(text, 80, 10)
    assert all(p.startswith(("-", "|", "- ")) for p in got)
    kinds = [n.kind for n in tree(text).children]
    assert kinds == ["list", "table"] and [n.kind for n in tree(text).children[0].children] == ["items", "item", "item"]
    html = "<h2>Head</h2><p>" + "Some words here. " * 4 + "</p>\n<h2>Next</h2>" + "More words there. " * 4
    assert [p[:4] for p in own(html, 100, 10)] == ["<h2>", "<h2>"]


def test_table_form(spark):
    schema = "chunk_id string, text string, char_count int, piece string"
    rows = [("a", "x y " * 100, 3, "p"), ("b", " " * 500 + "short" + " " * 500, 999, "p"), ("c", None, None, None), ("d", "", 0, None), (None, "z " * 100, 1, "")]
    got = split_oversized(spark.createDataFrame(rows, schema), 100, 20)
    assert {r.chunk_id for r in got.collect()} == {"a", None}
    assert all(len(r.piece) <= 100 and r.n_pieces > 1 for r in got.collect())
    assert split_oversized(spark.createDataFrame([], schema), 100, 20).count() == 0
    with pytest.raises(ValueError):
        split_oversized(spark.createDataFrame(rows, schema), 100, 50)
