from lectern.llm.cutoff import MEASURES, captures, cut_captures, field_limits, inspected, lengths, opening_words, source_shares

PAGE = "page_id long, file string, url string, text string, source string, cut boolean"
MANIFEST = "file string, source_id string, title string"
BODY = ["The tower opens at nine and closes late. Visitors bring a ticket for each person.", "Please note that the garden differs for members. The rooms are small but warm.", "Under the rule of the house, dogs wait outside."]


def page(i, end):
    text = "Menu\nHome\n\n## Guide\n\n" + "\n\n".join(BODY) + "\n\n- Item one\n- Item two\n\n" + end
    return (i, f"f{i}", None, text, "zz", False)


CUT = ["Please note tha", "The tower opens at nine and clo", "Under the rule of…", "The tower opens at nine. Please note that the garden [...]", "Please note that the R&am", "Please note that the **ro"]
WHOLE = ["Please note that the garden is open.", "- Item two", "## Guide", "Home", "Menu", "› Home Other Pag… »", "Home Other Pa ...", "Under the rule of the house, dogs wait outside.\n\n\n"]


def test_endings(spark):
    rows = [page(i, e) for i, e in enumerate(CUT + WHOLE)]
    got = {r.page_id: r.cut for r in cut_captures(spark.createDataFrame(rows, PAGE), spark.createDataFrame([], MANIFEST)).collect()}
    assert {i for i, c in got.items() if c} == set(range(len(CUT)))


def test_limits_and_shares(spark):
    long = "The tower opens at nine and closes late. " * 60
    rows = [(i, f"f{i}", None, (f"{i} " + long)[:900], "", None) for i in range(12)]
    rows += [(100 + i, f"g{i}", None, (f"{i} " + long)[: 300 + 41 * (i + 1)].strip(), "", None) for i in range(3)]
    rows += [(200, "f0", None, None, "", None), (201, "f0", None, " \n", "", None), rows[0]]
    pages = spark.createDataFrame(rows, PAGE)
    manifest = spark.createDataFrame([(f"f{i}", " SRC1", "t") for i in range(12)] * 2 + [("none", "src9", "t"), (None, None, None)], MANIFEST)
    limits = field_limits(captures(inspected(pages), manifest)).collect()
    assert {(r.source, r["size"]) for r in limits if r.measure == "code_points"} == {("src1", 900)}
    got = {r.source: (r.n_captures, r.n_cut) for r in source_shares(pages, manifest).collect()}
    assert got["src9"] == (0, 0) and got["src1"][0] == 12 and got["src1"][1] >= 11 and got[None][0] == 3


def test_lengths():
    text = 'é<&"\n\r\n😀'
    got = dict(zip(MEASURES, lengths(text), strict=True))
    assert got["code_points"] == len(text) == 8
    assert got["utf8_bytes"] == len(text.encode())
    assert got["utf16_units"] == len(text.encode("utf-16-le")) // 2
    assert got["code_points_crlf"] == len(text.replace("\r\n", "\n").replace("\n", "\r\n"))
    assert got["code_points_lf"] == len(text.replace("\r\n", "\n"))


def test_limits_decide(spark):
    """A last line that opens as no other does shows nothing by itself; at a limit of its source the text is cut."""
    rows = [(i, f"f{i}", None, ("The tower opens at nine and closes late.\n\n" * 9 + f"Zyx{i} " + "ab" * 300)[:600], "", None) for i in range(9)]
    rows += [(50 + i, f"f{50 + i}", None, ("The tower opens at nine and closes late.\n\n" * 9 + f"Zyx{i} " + "ab" * 300)[: 400 + 17 * i], "", None) for i in range(3)]
    # At the limit by chance, and whole.
    rows += [(60, "f60", None, ("The tower opens at nine and closes late. " * 15)[:599] + ".", "", None)]
    pages = spark.createDataFrame(rows, PAGE)
    manifest = spark.createDataFrame([(f"f{i}", "src1", "t") for i in range(70)], MANIFEST)
    with_limits, without = ({r.page_id: r.path for r in cut_captures(pages, manifest, use).where("cut").collect()} for use in (True, False))
    assert with_limits == {i: "limit" for i in range(9)} and without == {}


def test_openings():
    assert opening_words("The Hall opens “Late in May 2031") == ["The", "A", "opens", "“A", "in"]
    assert opening_words("2031年 招生 open") == ["0年", "_", "招", "生", "_"]
    assert opening_words("a" * 500 + " b") == ["a" * 500, "b"]


def test_long_last_lines(spark):
    """An address of any length, and a line of any length, are looked at whole."""
    long = "The tower opens at nine. It closes late, see [the map](https://x.example/" + "p" * 2000 + "."
    rows = [(1, "a", None, long, "", None), (2, "b", None, "A word " * 5000 + "at the end.", "", None), (3, "c", None, "The tower is open. " * 3000 + "It clos", "", None)]
    got = {r.page_id: r.cut for r in cut_captures(spark.createDataFrame(rows, PAGE), spark.createDataFrame([], MANIFEST)).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_empty(spark):
    assert cut_captures(spark.createDataFrame([], PAGE), spark.createDataFrame([], MANIFEST)).count() == 0
