import itertools
import random

import numpy as np

from lectern.llm.mainbody import ALIKE, APART, ITEM, SECTION, Edges, Labeller, Model, features, fit, fit_on, furniture_lines, main_bodies, min_cut, not_main_body, one_digit, prepare

PAGE = "page_id long, file string, url string, text string, lines string, main_text string"


def test_min_cut_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(400):
        n = int(rng.integers(1, 9))
        cost = rng.normal(0, rng.choice([0.3, 1, 3]), n).round(2)
        pairs = [(a, b) for a in range(n) for b in range(a) if rng.random() < 0.5]
        edges = [(a, b, round(float(rng.random()), 2)) for a, b in pairs]
        u, v, w = (np.array([e[k] for e in edges], dtype=float if k == 2 else int) for k in range(3))
        got = min_cut(cost, u, v, w)

        def value(x, cost=cost, edges=edges):
            return sum(max(c, 0) if not f else max(-c, 0) for c, f in zip(cost, x, strict=True)) + sum(w for a, b, w in edges if x[a] != x[b])

        assert abs(value(got) - min(map(value, itertools.product([False, True], repeat=n)))) < 1e-9


def test_structure_edges():
    lines = ["# Title", "Words.", "## Part", "- a", "- b", "- c", "End."]
    edges = Edges()
    edges.page(lines, [1, 3, 5, 6, 7, 8, 10])
    got = {(a, b): w for a, b, w in zip(edges.u, edges.v, edges.w, strict=True)}
    assert set(got) == {*zip(range(6), range(1, 7), strict=True), (3, 5), (0, 2), (2, 6)}
    assert got[3, 4] == ALIKE and got[5, 6] == APART and got[3, 5] == ITEM and got[0, 2] == got[2, 6] == SECTION


def site_pages(n=60):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        subject = "".join(rng.choice(a) for a in ["bdfg", "aeio"] * 4).capitalize()
        site = f"site{'abc'[i % 3]}"
        first = f"Under the {subject} plan, the {rng.choice(['desk', 'hall', 'room'])} opens at {i}. Bring {rng.randint(1, 99)} forms and wait for the letter that follows."
        text = "\n".join(["Open search", "- [Fees](https://x/0)", "- [Programs](https://x/1)", "", f"## About the {subject} track", "", first, "", f"- {i} credits in {subject} electives", "", "In this section", f"› Programs Zel{i}dale", "", f"Contact for {subject}: room {i}", "", "Back to top", f"© 2031 {site.capitalize()} College. All rights reserved."])
        rows.append((i, f"f{i}", f"https://{site}.example/topic/{subject.lower()}", text, "", ""))
    return rows


FURNITURE = [1, 2, 3, 11, 12, 16, 17]


def test_fitted_on_its_own_pages(spark):
    rows = site_pages()
    df = spark.createDataFrame([*rows, rows[0], (900, "f", None, None, "", ""), (901, "f", None, " \n", "", "")], PAGE)
    got = {}
    for r in not_main_body(df).collect():
        got.setdefault(r.page_id, []).append(r.line_no)
    assert {i: sorted(x) for i, x in got.items()} == {i: FURNITURE for i in range(len(rows))}
    texts = {r.page_id: r.main_text for r in main_bodies(df).collect()}
    assert texts[900] is None and texts[901] == "" and texts[3].startswith("## About") and texts[3].endswith("room 3")


def test_empty_table_and_unfitted_model(spark):
    df = spark.createDataFrame([], PAGE)
    assert not_main_body(df).count() == 0 and furniture_lines(df, Model()).count() == 0
    assert fit([]).weights == {} and Labeller(Model()).furniture([None], ["a line\nanother"]) == [[]]


def test_counts_are_of_all_pages_whatever_the_sample(spark):
    rows = site_pages()
    # A trail and its label that only four files have, so hardly any sample holds them.
    rows = [(*r[:3], r[3] + ("\nHonours office\nHome > Honours office" if r[0] % 15 == 0 else ""), *r[4:]) for r in rows]
    df = spark.createDataFrame([*rows, *rows[:9]], PAGE)
    whole = fit([(r[1], r[2], r[3]) for r in rows])
    for sample in (1, 6, 1000):
        got = fit_on(df, sample)
        assert got.common == whole.common and "honours" in got.common
        assert got.labels and got.labels <= whole.labels
    assert set(got.weights) == set(whole.weights)


def test_shuffled_counts_give_the_same_lines(spark):
    df = spark.createDataFrame([(*r[:3], r[3] + "\nHome > Fees\nHome > Programs", *r[4:]) for r in site_pages()], PAGE)
    fixed, joined = (sorted((r.page_id, r.lines) for r in furniture_lines(df, known=k).collect()) for k in (1000, 0))
    assert fixed == joined and all(x[-2:] == [18, 19] for _, x in fixed)


def test_long_notice_on_every_page_is_furniture(spark):
    notice = " ".join(f"This website keeps {x} with the help of cookies and nobody reads them twice." for x in ("statistics", "visits", "choices", "languages", "sessions"))
    assert len(notice) > 260
    df = spark.createDataFrame([(*r[:3], r[3] + "\n\n" + notice, *r[4:]) for r in site_pages()], PAGE)
    assert all(r.lines == [*FURNITURE, 19] for r in furniture_lines(df).collect())


def test_features_have_the_words_of_the_whole_line():
    line = " ".join(f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr") + " 一二三"
    assert {f for f in features(line, frozenset()) if f.startswith("w ")} == {f"w {w}" for w in [*line.split()[:-1], *"一二三"]}


def test_a_hundredth_of_many_sites(spark):
    """What labels the sample is counted over all pages, so a sample with under one page a site does."""
    rng = random.Random(7)
    rows, want = [], {}
    for i in range(1500):
        subject = "".join(rng.choice(a) for a in ["bdfg", "aeio"] * 4).capitalize()
        site = f"campus{chr(97 + i % 25)}{chr(97 + i % 24)}"
        first = f"Under the {subject} plan, the {rng.choice(['desk', 'hall', 'room'])} opens at {i}. Bring {rng.randint(1, 99)} forms and wait for the letter."
        text = "\n".join(["Open search", "- [Fees](https://x/0)", "", f"## About the {subject} track", "", first, "", f"- {i} credits in {subject} electives", "", "In this section", f"Hall of {site}, street {i % 25}", "", f"© 2031 {site.capitalize()} College. All rights reserved."])
        rows.append((i, f"f{i}", f"https://{site}.example/topic/{subject.lower()}", text, "", ""))
        want |= {(i, no): True for no in (1, 2, 10, 11, 13)}
    df = spark.createDataFrame(rows, PAGE)
    got = {(r.page_id, r.line_no) for r in not_main_body(df, prepare(df, len(rows) // 100).model).collect()}
    assert len(got & set(want)) >= 0.99 * len(want) and len(got & set(want)) >= 0.99 * len(got)


def test_digits():
    assert one_digit("a12b٣٤5c1,000.００") == "a0b0c0,0.0"


def test_costs_are_sums_of_weights():
    pages = [(r[1], r[2], r[3]) for r in site_pages(30)]
    model = fit(pages)
    labeller = Labeller(model)
    for line in ["- [fees](https://x/0)", "## about the § track", "bring 0 forms. wait for § now! “sent.” 好。", "home > fees", "› programs zel0dale", "© 0 ¤ college. all rights reserved.", "the form and § …", "the the the form (of the form). x " * 9, "0"]:
        z = model.weights[""] + sum(model.weights.get(x, 0.0) for x in features(line, model.labels))
        assert abs(labeller.cost(line) - (min(max(z, -6.0), 6.0) if line != "0" else 0.0)) < 1e-9, line
