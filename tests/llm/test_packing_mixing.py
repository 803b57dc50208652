import random
from collections import Counter, defaultdict

import numpy as np

from lectern.llm.mixing import counts, draw, mean_count, mean_for
from lectern.llm.packing import containers, fill_report, sized_documents
from lectern.plans.staging import stage

SIZED = "doc_id long, source string, tokens long"
LIMITS = "limit_name string, applies_to string, unit string, max_size int, overlap int"


def sized(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["big", "big", "big", "mid", "mid", "small", None]), rng.choice([0, rng.randint(1, 100), rng.randint(1, 1500)])) for i in range(n)]
    return rows, stage(spark.createDataFrame(rows, SIZED), "t")


def test_packing_keeps_all_and_wastes_little(spark):
    rows, df = sized(spark)
    limits = spark.createDataFrame([("a_box", "d", "t", 512, 0), ("chunk_text", "c", "c", 9, 1)], LIMITS)
    for shard_docs in (10_000, 500):
        got = containers(df, limits, shard_docs).collect()
        used, parts = Counter(), defaultdict(list)
        for r in got:
            if r.container_id is not None:
                used[r.container_id] += r.tokens
            parts[r.doc_id].append(r)
        assert max(used.values()) <= 512 and sum(used.values()) == sum(t for *_, t in rows)
        assert sum(used.values()) / (512 * len(used)) > 0.97
        for i, s, t in rows:
            p = sorted(parts[i], key=lambda r: r.piece_no)
            assert all(r.source == s for r in p) and sum(r.tokens for r in p) == t
            assert len(p) == max(1, -(-t // 512)) and [r.first_token for r in p] == [512 * k for k in range(len(p))]
    report = fill_report(containers(df, limits), limits).first()
    assert report.least_containers <= report.n_containers and report.run_error < report.mix_error


def test_windows_keep_the_mix(spark):
    rows = [(i, "ab"[i % 4 == 0], 10 + i % 7) for i in range(4000)]
    df = stage(spark.createDataFrame(rows, SIZED), "t")
    limits = spark.createDataFrame([("a_box", "d", "t", 256, 0)], LIMITS)
    by = defaultdict(Counter)
    for r in containers(df, limits, 1000).collect():
        by[r.container_id][r.source] += r.tokens
    share = sum(t for _, s, t in rows if s == "b") / sum(t for *_, t in rows)
    off = [abs(c["b"] / sum(c.values()) - share) for c in by.values()]
    assert sorted(off)[int(0.9 * len(off))] < 0.12


def test_weights_and_null_sources(spark):
    rows = [(i, ("a", "b", "", None)[i % 4], 10 + i % 7) for i in range(4000)]
    df = stage(spark.createDataFrame(rows, SIZED), "t")
    limits = spark.createDataFrame([("a_box", "d", "t", 256, 0)], LIMITS)
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("absent", 9.0)], "source string, weight double")
    got = containers(df, limits, 1000, weights).collect()
    assert Counter(r.source for r in got) == Counter(s for _, s, _ in rows)
    first = defaultdict(Counter)
    for r in got:
        if r.container_id & ((1 << 40) - 1) < 5:
            first[r.container_id][r.source] += r.tokens
    # Later shards first make up for what those before them hold less of.
    assert all(abs(c["a"] / sum(c.values()) - 0.75) < 0.05 for at, c in first.items() if at < 5) and not any(c[None] + c[""] for c in first.values())


def test_carry_over_many_shards(spark, monkeypatch):
    import lectern.llm.packing as P

    monkeypatch.setattr(P, "BLOCK", 3)
    rows = [(i % 11, i // 11, (i * 7) % 5) for i in range(44)]
    got = P._before(spark.createDataFrame(rows, "shard int, k int, v long"), "v", "b", "k").collect()
    assert {(r.shard, r.k, r.b) for r in got} == {(s, k, sum(v for t, m, v in rows if m == k and t < s)) for s, k, _ in rows}


def test_empty_tables(spark):
    limits = spark.createDataFrame([("a_box", "d", "t", 256, 0)], LIMITS)
    docs = spark.createDataFrame([], "doc_id long, source string, text string, tokens int")
    assert containers(sized_documents(docs), limits).count() == 0
    draws, shares = draw(sized_documents(docs), spark.createDataFrame([("m", "s", 1.0, 2)], "mix_name string, source string, target_share double, max_repeats int"))
    assert draws.count() == 0 and shares.first().n_draws == 0


def test_sizes(spark):
    docs = spark.createDataFrame([(1, "s", "two words"), (2, "s", None), (3, None, ""), (1, "s", "two words")], "doc_id long, source string, text string")
    assert {(r.doc_id, r.source, r.tokens) for r in sized_documents(docs).collect()} == {(1, "s", 2), (2, "s", 0), (3, None, 0)}


def test_counts_invert_the_distribution():
    u = np.random.default_rng(0).random(20_000)
    for mean in (0.3, 2.0):
        n = counts(u, np.full(len(u), mean), np.full(len(u), 12))
        assert abs(n.mean() - mean) < 0.05 and abs(n.var() - mean) < 0.1
        assert abs(counts(u, np.full(len(u), mean), np.full(len(u), 2)).mean() - mean_count(np.array([mean]), 2)[0]) < 0.02
    for repeats, times in ((0.2, 1), (0.75, 1), (1.5, 2), (5.0, 8)):
        assert abs(mean_count(np.array([mean_for(repeats, times)]), times)[0] - repeats) < 1e-6


def test_size_that_is_asked_for(spark):
    rows, df = sized(spark, 3000, 4)
    there = {s: sum(t for _, x, t in rows if x == s) for s in ("big", "small")}
    mixes = spark.createDataFrame([("m", "big", 0.5, 2), ("m", "small", 0.5, 2)], "mix_name string, source string, target_share double, max_repeats int")
    got = {r.source: r for r in draw(df, mixes, size=there["small"])[1].collect()}
    assert all(abs(r.tokens_drawn / (there["small"] / 2) - 1) < 0.01 for r in got.values())
    # The scarce source of a mix that is too large is used up, and the share that it reaches is reported.
    got = {r.source: r for r in draw(df, mixes, size=6 * there["small"])[1].collect()}
    assert got["small"].tokens_drawn == 2 * there["small"] and got["small"].share_reached < 0.45
    assert abs(got["big"].tokens_drawn / (3 * there["small"]) - 1) < 0.01 or got["big"].tokens_drawn == 2 * there["big"]


def test_mix_reaches_targets(spark):
    rows, df = sized(spark, 4000, 2)
    mixes = [("m", "big", 0.5, 1), ("m", "mid", 0.3, 2), ("m", "small", 0.2, 3), ("n", "small", 0.9, 2), ("n", "absent", 0.1, 2), ("n", None, 0.1, 1)]
    draws, shares = draw(df, spark.createDataFrame(mixes, "mix_name string, source string, target_share double, max_repeats int"))
    got = draws.collect()
    size = {i: (s, t) for i, s, t in rows}
    times = Counter((r.mix_name, r.doc_id) for r in got)
    cap = {(m, s): c for m, s, _, c in mixes}
    assert all(n <= cap[m, size[d][0]] for (m, d), n in times.items()) and len({(r.mix_name, r.doc_id, r.copy_no) for r in got}) == len(got)
    total = Counter()
    for r in got:
        assert size[r.doc_id] == (r.source, r.n_tokens)
        total[r.mix_name, r.source] += r.n_tokens
    whole = sum(n for (m, _), n in total.items() if m == "m")
    for r in shares.collect():
        assert r.tokens_drawn == total[r.mix_name, r.source]
        if r.mix_name == "m":
            assert abs(r.share_reached - r.target_share) < 0.003 and abs(r.share_reached - r.tokens_drawn / whole) < 1e-5
    assert [r.share_reached for r in shares.where("source = 'absent'").collect()] == [0.0]
    assert sorted((r.mix_name, r.shuffle_key) for r in got) == [(r.mix_name, r.shuffle_key) for r in got]
