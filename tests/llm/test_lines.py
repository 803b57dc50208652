import random
import re

from lectern.llm.lines import candidate_lines, lines_of, repeated_lines, site_line_report, without_site_lines
from lectern.plans.staging import stage

CHUNK = "chunk_id string, source_id string, text string, line string, source string"


def brute(rows, least=8):
    def key(line):
        k = re.sub(r"[\s\x1c-\x1f]|\d", "", line.lower())
        return k if any(ch.isalpha() for ch in k) else None

    held = {}
    for cid, sid, text, *_ in rows:
        if cid and sid and text is not None:
            for line in text.split("\n"):
                if key(line):
                    held.setdefault((sid.strip().lower(), key(line)), set()).add(cid)
    return {
        (cid, no)
        for cid, sid, text, *_ in rows
        if cid and sid and text is not None
        for no, line in enumerate(text.split("\n"), 1)
        if key(line) and len(held[sid.strip().lower(), key(line)]) >= least
    }


def sample():
    rng = random.Random(1)
    site = ["Page 1 of 2", "PAGE 7 OF 9", "page\t3 of 4 ", "© Site", "12-34", "", "　Share  this"]
    rows = []
    for i in range(40):
        lines = [f"own line {chr(97 + i % 26)}{chr(97 + i // 26)}", *rng.choices(site, k=3)]
        rng.shuffle(lines)
        row = (f"c{i}", rng.choice(["s1", " S1", "s1 ", "s2", None]), "\n".join(lines) if i % 13 else None, "x", "y")
        rows += [row] * rng.choice([1, 2])
    return rows


def test_against_brute_force(spark):
    rows = sample()
    df = spark.createDataFrame(rows, CHUNK)
    want = brute(rows)
    assert want
    for width, most in ((1 << 20, 1_000_000), (2, 0)):  # one summary that tells lines apart, one that can't and nothing broadcast
        got = [(r.chunk_id, r.line_no) for r in repeated_lines(df, width=width, broadcast_rows=most).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_clean_texts(spark):
    rows = sample()
    df = spark.createDataFrame(rows, CHUNK)
    gone = brute(rows)
    want = sorted(str((c, t, None if t is None else "\n".join(x for no, x in enumerate(t.split("\n"), 1) if (c, no) not in gone))) for c, _, t, *_ in rows)
    for most in (1_000_000, 0):
        out = without_site_lines(df, broadcast_rows=most)
        assert out.columns == [*df.columns, "clean_text", "lines_removed"]
        assert sorted(str((r.chunk_id, r.text, r.clean_text)) for r in out.collect()) == want


def test_report_and_empty(spark):
    assert all(r.chunks >= 8 for r in site_line_report(spark.createDataFrame(sample(), CHUNK)).collect())
    empty = spark.createDataFrame([], CHUNK)
    assert repeated_lines(empty).count() == 0 and without_site_lines(empty).count() == 0


def test_clean_texts_of_one_id_either_way(spark):
    rows = [*sample(), ("c1", "s1", "page 5\nnew\n© Site", "x", "y"), ("c1", "s2", "Page 1 of 2\nother", "x", "y"), ("c1", None, "Page 1 of 2\n© Site", "x", "y"), ("c2", "s9", "© Site\nkept", "x", "y"), (None, "s1", "© Site", "x", "y")]
    df = spark.createDataFrame(rows, CHUNK)
    one, two = (sorted(map(str, without_site_lines(df, broadcast_rows=most).collect())) for most in (1_000_000, 0))
    assert one == two and len(one) == len(rows)


def test_a_source_with_many_lines_has_few_candidates(spark):
    """One source with ten times as many lines as a summary has counters to begin with."""
    rows = [(f"c{i}", "s1", "\n".join([f"own {i}x{chr(97 + j % 26)}{chr(97 + j // 26)}{'abcdefghij'[i % 10]}{chr(97 + i // 10 % 26)}{chr(97 + i // 260)}" for j in range(50)] + ["Share this"]), "x", "y") for i in range(200)]
    lines = stage(lines_of(spark.createDataFrame(rows, CHUNK)), "lines")
    assert lines.count() == 200 * 51
    for width in (1 << 10, 1 << 16):
        assert 200 <= candidate_lines(lines, width=width).count() < 0.05 * 200 * 51
    assert repeated_lines(spark.createDataFrame(rows, CHUNK), width=1 << 10).count() == 200
