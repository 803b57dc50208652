from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.config import CHUNK_LEAST, CHUNK_OVERLAP, CHUNK_TARGET
from lectern.operators import clean as L
from lectern.operators.chunk import chunk_pages, number_chunks
from lectern.operators.corpus import CHUNK_COLUMNS, build_chunks, build_summary, documents_of, latest, unlisted_pages


def chunked(spark, texts):
    rows = chunk_pages(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "k").collect()
    out = [[] for _ in texts]
    for r in sorted(rows, key=lambda r: (r.k, r.part)):
        assert r.char_count == len(r.text)
        out[r.k].append(r.text)
    return out


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["x", "Word. ", "Is it? (So) ", "é ", "\n", "\n\n", "\r\n\r\n", "\t"]), st.integers(1, 400)), max_size=14), min_size=30, max_size=60))
def test_properties_of_chunks(spark, texts):
    """Every chunk holds new text in order, begins with an end of the text before it, and isn't short unless it is alone."""
    texts = ["".join((p * n)[: n + 3] if not p.isspace() else p for p, n in parts) for parts in texts]
    for text, parts in zip(texts, chunked(spark, texts), strict=True):
        solid = "".join(text.split())
        assert bool(parts) == bool(solid)
        if len(parts) > 1:
            assert all(len(p) >= CHUNK_LEAST for p in parts)
        at = 0  # how much of the text's solid characters the chunks so far hold
        for i, part in enumerate(parts):
            own = "".join(part.split())
            # Short chunks are merged with the overlap that they had, so a chunk may hold an end of the text before it in several places.
            assert i == 0 or own[0] in solid
            reach = max((k for k in range(len(solid) + 1) if own.endswith(solid[max(0, k - 40) : k]) and k >= at), default=at)
            assert reach >= at
            at = reach
        assert at == len(solid)


def test_overlap_is_a_suffix(spark):
    text = "\n\n".join(f"Part {i} says a thing. " + f"{chr(97 + i)} " * 300 + "and ends so." for i in range(4))
    (parts,) = chunked(spark, [text])
    assert len(parts) == 4 and parts[0] == text.split("\n\n")[0].strip()
    for before, part, own in zip(parts, parts[1:], text.split("\n\n")[1:], strict=False):
        assert part.endswith(own)
        head = part[: -len(own)].rstrip()
        assert 0 < len(head) <= CHUNK_OVERLAP and before.endswith(head)


def test_short_chunks_are_merged(spark):
    """Sizes 119 and 300 make one chunk, 120 and 300 two, 300 and 119 one, each with the overlap that the second had."""
    for sizes, n in (((119, 590), 1), ((120, 590), 2), ((590, 119), 2)):
        (parts,) = chunked(spark, ["\n\n".join(chr(97 + i) * k for i, k in enumerate(sizes))])
        assert len(parts) == n, sizes


def test_long_paragraphs_are_packed_by_sentences(spark):
    sentence = "Words that make a sentence of some length, all told. "
    (parts,) = chunked(spark, [(sentence * 40).strip()])
    assert len(parts) > 2 and all(p.endswith(".") and len(p) <= CHUNK_TARGET + CHUNK_OVERLAP + 1 for p in parts)
    (parts,) = chunked(spark, ["x" * 2000])
    assert parts == ["x" * 2000]  # a sentence is never cut


def test_packing_cases(spark):
    para = lambda *n: "\n\n".join(chr(97 + i) * k for i, k in enumerate(n))
    got = chunked(spark, [para(400, 298), para(400, 299), para(710), para(951), para(119, 300), "", None])
    assert [len(g) for g in got] == [1, 2, 1, 1, 1, 0, 0]
    assert len(got[0][0]) == 700


def test_running_ids(spark):
    rows = [(f"f{i % 37:02d}", i // 37 + 1) for i in range(1500)]
    got = number_chunks(spark.createDataFrame(rows, "file string, part int")).collect()
    assert {(r.chunk_id, r.file, r.part) for r in got} == {(f"c{n:03d}", *r) for n, r in enumerate(sorted(rows), 1)}
    assert number_chunks(spark.createDataFrame([], "file string, part int")).count() == 0


def cleaned(spark, text):
    return L.clean(spark.createDataFrame([(text,)], "text string")).first().clean_text


def test_line_rules(spark):
    for gone in ("- [Home](u)", "3. [X](u)", "[Only](u)", "https://a.b/c", "![i](u)", "Search", "x Navigate to y", "[Jump to x](y)"):
        assert cleaned(spark, f"keep\n{gone}\nend") == "keep\nend", gone
    assert cleaned(spark, "## Title ##\n\n---\nSee [the page](u)  now `x`\n\n\n\nend") == "Title\n\nSee the page now x\n\nend"
    assert cleaned(spark, None) is None and cleaned(spark, "") == ""


def test_start_and_footer(spark):
    assert cleaned(spark, "junk\n# Head\nbody\n© 2031 someone\nrest") == "Head\nbody"
    assert cleaned(spark, "In This Section\nbody\ntiktok\nmore") == "In This Section\nbody"
    assert cleaned(spark, "© 2031 first line\nbody") == "© 2031 first line\nbody"


def test_captures(spark):
    schema = "page_id long, file string, url string, text string"
    rows = [(1, "a", "http://X.y/p/", "long text", ), (2, "a", "x.y/p", "longer text"), (3, "a", "x.y/p/index.html", "other  text"), (4, None, None, "no url"), (5, "b", None, "see https://x.y/q"), (6, "b", "x.y/zz", None)]
    df = spark.createDataFrame(rows, schema)
    manifest = spark.createDataFrame([("a1", "https://x.y/p"), ("a2", "http://x.y/p/index.php"), ("b1", "x.y/q"), (None, None)], "file string, url string")
    assert {(r.page_id, r.file) for r in L.match_captures(df, manifest).collect()} == {(1, "a2"), (2, "a2"), (3, "a2"), (5, "b1")}
    assert {r.page_id for r in L.match_captures(df, manifest, "B1").collect()} == {5}
    assert {(r.file, r.page_id) for r in L.largest_capture(df).collect()} == {("a", 2), ("b", 5)}


def test_parse_capture(spark):
    blobs = ['[{"text": "one"}]', '{"text": "two"}', '{"other": 1}', "plain # text", None]
    got = [r.t for r in spark.createDataFrame(list(enumerate(blobs)), "i int, b string").orderBy("i").select(L.parse_capture(F.col("b")).alias("t")).collect()]
    assert got == ["one", "two", '{"other": 1}', "plain # text", None]


def test_corpus_build(spark):
    pages = spark.createDataFrame([(1, "b.txt", "# B\n" + "Text here. " * 20, "x"), (2, "a.txt", "# A\n" + "More. " * 200, "x"), (3, "z.txt", "stray", "x"), (4, "a.txt", None, "x")], "page_id long, file string, text string, scope string")
    entry = lambda f: (f, "s" + f[0], "u", "T", "g", "t", "v", "High", "2031")
    manifest = spark.createDataFrame([entry("a.txt"), entry("b.txt"), entry("a.txt"), entry("c.txt")], "file string, source_id string, url string, title string, scope string, topic string, content_version string, change_frequency string, date_accessed string")
    chunks = build_chunks(pages, manifest)
    assert tuple(chunks.columns) == CHUNK_COLUMNS
    rows = sorted(chunks.collect(), key=lambda r: r.chunk_id)
    assert [r.chunk_id for r in rows] == [f"c{i:03d}" for i in range(1, len(rows) + 1)] and [r.source_id for r in rows] == ["sa"] * (len(rows) - 1) + ["sb"]
    assert [r.file for r in unlisted_pages(pages, manifest).collect()] == ["z.txt"]
    assert documents_of(chunks).columns[:5] == ["id", "title", "source_url", "text", "retrieved"]
    assert build_summary(chunks).first().sources == 2
    assert build_chunks(pages.limit(0), manifest).count() == 0
    assert [r.n for r in latest(spark.createDataFrame([("k", 1), ("k", 3), (None, 9)], "k string, n int"), "k", "n").collect()] == [3]
