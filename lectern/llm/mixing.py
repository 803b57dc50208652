"""Problem 7: sources mixed to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.plans.staging import stage, within

#: Rounds in which a source's mean is adjusted, the means tried in each, and the factor by which it moves at most.
ROUNDS, TRIED, MOST = 3, 33, 4.0
SEED = 20_250_101
#: Sources of all mixes together; the targets are broadcast.
MAX_TARGETS = 100_000
#: Share of the largest size that a mix can have, which it has if no size is asked for. At 1 every document of the scarcest source would be used
#: as often as it may be, which no Poisson distribution gives.
REACH = 0.75
#: Mean above which every count is at its cap.
EVERY = 1e6


def mean_count(mean: np.ndarray, times: int) -> np.ndarray:
    """The mean of a Poisson distribution of ``mean`` whose counts are cut at ``times``: the sum of P(N >= k) for k up to it."""
    term = np.exp(-mean)
    below, out = term.copy(), np.zeros_like(mean)
    for k in range(1, times + 1):
        out += 1 - below
        term = term * mean / k
        below += term
    return out


def mean_for(repeats: float, times: int) -> float:
    """The mean at which documents are used ``repeats`` times on average if counts are cut at ``times``; ``EVERY`` if that can't be reached."""
    if repeats >= times * (1 - 1e-6):
        return EVERY
    low, high = 0.0, 80.0 + 4.0 * times
    for _ in range(80):
        mean = (low + high) / 2
        low, high = (mean, high) if mean_count(np.array([mean]), times)[0] < repeats else (low, mean)
    return high


def counts(u: np.ndarray, mean: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The inverse of the Poisson distribution of ``mean`` at ``u`` in (0, 1), cut at ``times``, all row by row."""
    term = np.exp(-mean)
    below, out = term.copy(), np.zeros(np.broadcast(u, mean).shape, dtype=np.int32)
    for k in range(1, int(times.max(initial=0)) + 1):
        out += (below < u) & (k <= times)
        term = term * mean / k
        below = below + term
    return np.where(mean >= EVERY, times, out)


def _means(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rows of ``TRIED`` means from ``low`` to ``high``, in proportion."""
    return low[:, None] * (high / low)[:, None] ** (np.arange(TRIED) / (TRIED - 1))


def _uniform(h: pa.Array) -> np.ndarray:
    return ((h.to_numpy().view(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each target of a batch and each mean that is tried: tokens of the batch's documents."""
    for b in batches:
        mix, source = b.column(0).to_pylist(), b.column(1).to_pylist()
        tokens, cap = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
        u = _uniform(b.column(4))
        n = counts(u[:, None], _means(*(b.column(i).to_numpy(zero_copy_only=False) for i in (5, 6))), cap[:, None])
        groups: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(mix, source, strict=True)):
            groups.setdefault(key, []).append(i)
        rows = [(*key, k, t) for key, at in groups.items() for k, t in enumerate((n[at] * tokens[at][:, None]).sum(0).tolist())]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["mix_name", "source", "k", "tokens"])


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document as often as its count says, with ``copy_no``."""
    for b in batches:
        n = counts(_uniform(b.column(5)), b.column(6).to_numpy(zero_copy_only=False), b.column(4).to_numpy(zero_copy_only=False).astype(np.int64))
        at = pa.array(np.repeat(np.arange(len(n)), n))
        no = np.concatenate([np.arange(1, k + 1) for k in n.tolist()] or [np.zeros(0)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(4)), pa.array(no)], names=["mix_name", "source", "doc_id", "n_tokens", "copy_no"])


def _targets(sized: DataFrame, mixes: DataFrame, size: int | None) -> DataFrame:
    """Per mix and source what is there, what to draw and the mean that draws it; sources of a mix without text leave their share to the others in proportion."""
    asked = mixes.where("mix_name is not null and source is not null").groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = sized.where("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("tokens_there"), F.count("*").alias("docs_there"))
    rows = asked.join(have, "source", "left").fillna(0, ["tokens_there", "docs_there"])
    can = (F.col("tokens_there") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    rows = rows.withColumn("share", F.when(can, F.col("target_share")))
    mix = rows.groupBy("mix_name").agg(F.sum("share").alias("known"), F.min(F.when(can, F.col("tokens_there") * F.col("max_repeats") / F.col("share"))).alias("reach"))
    # Shares are of what the known sources give together.
    whole = F.col("reach") * REACH if size is None else F.lit(float(size)) / F.col("known")
    rows = rows.join(mix, "mix_name").withColumn("goal", F.coalesce(F.col("share") * whole, F.lit(0.0))).drop("share", "known", "reach")

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.to_pydict()
            got = [mean_for(g / t, c) if g > 0 else 0.0 for g, t, c in zip(d["goal"], d["tokens_there"], d["max_repeats"], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], names=[*b.schema.names, "mean"])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(means, f"{kinds}, mean double")


def draw(sized: DataFrame, mixes: DataFrame, seed: int = SEED, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The draws and the shares they reach.

    ``sized`` is a staged table of ``doc_id``, ``source``, ``tokens``; ``size`` is how many tokens each mix is to have. Draws: ``mix_name``, ``doc_id``, ``source``, ``copy_no`` (1 to
    ``max_repeats`` at most), ``n_tokens``, ``shuffle_key``, in the order of that key within each mix. Shares: ``mix_name``, ``source``, ``target_share``,
    ``max_repeats``, ``docs_there``, ``tokens_there``, ``mean_repeats``, ``n_draws``, ``tokens_drawn``, ``share_reached``.

    A document's number of copies is an inverted Poisson distribution at a hash of the mix, the document and ``seed``, cut at ``max_repeats``. The
    mean of a source is the one that uses its documents as often as the goal asks on average, goal over tokens there; since few documents draw more or less than their expectation, it is
    then moved, by a factor of ``MOST`` at most, to where the tokens really drawn come closest to the goal (``mean_repeats``). Without ``size`` a mix is as
    large as ``REACH`` of what its scarcest source permits; where ``size`` asks for more than a source has, every document of it is used ``max_repeats`` times and
    the shares that are reached are reported. A source without text is reported with nothing drawn and its share goes to the others in proportion.
    """
    targets = stage(_targets(sized, mixes, size), "mix-goals")
    if not within(targets, MAX_TARGETS):
        raise ValueError(f"more than {MAX_TARGETS} targets")
    documents = sized.where("tokens > 0").select("doc_id", "source", "tokens")

    def meant(t: DataFrame, *more: str) -> DataFrame:
        rows = t.where("goal > 0").select("mix_name", "source", F.col("max_repeats").alias("cap"), *more)
        return documents.join(F.broadcast(rows), "source").withColumn("h", F.xxhash64(F.lit(seed), "mix_name", "doc_id"))

    keys = ["mix_name", "source"]
    here = targets.withColumns({"low": F.greatest("mean", F.lit(1e-9)) / MOST, "high": F.greatest("mean", F.lit(1e-9)) * MOST})
    for _ in range(ROUNDS):
        each = meant(here, "low", "high").select("mix_name", "source", "tokens", "cap", "h", "low", "high")
        sums = each.mapInArrow(_tried, "mix_name string, source string, k int, tokens long").groupBy(*keys, "k").agg(F.sum("tokens").alias("t"))
        best = sums.join(F.broadcast(here.select(*keys, "goal")), keys).groupBy(*keys).agg(F.min(F.struct(F.abs(F.col("t") - F.col("goal")).alias("off"), "k")).alias("best"))
        step = F.pow(F.col("high") / F.col("low"), F.lit(1 / (TRIED - 1)))
        mean = F.when(F.col("best").isNull() | (F.col("mean") >= EVERY), F.col("mean")).otherwise(F.col("low") * F.pow(step, F.col("best.k")))
        here = here.join(best, keys, "left").select(
            *[c for c in here.columns if c not in ("mean", "low", "high")],
            mean.alias("mean"),
            F.when(F.col("mean") >= EVERY, F.col("low")).otherwise(F.greatest(mean, F.lit(1e-9)) / step).alias("low"),
            F.when(F.col("mean") >= EVERY, F.col("high")).otherwise(F.greatest(mean, F.lit(1e-9)) * step).alias("high"),
        )
        here = stage(here, "mix-means")

    drawn = meant(here, "mean").select("mix_name", "source", "doc_id", "tokens", "cap", "h", "mean").mapInArrow(_copies, "mix_name string, source string, doc_id long, n_tokens long, copy_no int")
    key = F.xxhash64(F.lit(seed + 1), "mix_name", "doc_id", "copy_no")
    draws = drawn.select("mix_name", "doc_id", "source", "copy_no", "n_tokens", key.alias("shuffle_key"))
    shuffled = draws.repartitionByRange("mix_name", "shuffle_key").sortWithinPartitions("mix_name", "shuffle_key", "doc_id", "copy_no")
    sums = draws.groupBy(*keys).agg(F.count("*").alias("n_draws"), F.sum("n_tokens").alias("tokens_drawn"))
    rows = here.join(sums, keys, "left").fillna(0, ["n_draws", "tokens_drawn"])
    totals = rows.groupBy("mix_name").agg(F.sum("tokens_drawn").alias("all"))
    shares = rows.join(totals, "mix_name").select(
        "mix_name", "source", "target_share", "max_repeats", "docs_there", "tokens_there", F.round("mean", 6).alias("mean_repeats"), "n_draws", "tokens_drawn",
        F.coalesce(F.round(F.try_divide("tokens_drawn", "all"), 6), F.lit(0.0)).alias("share_reached"),
    )
    return shuffled, shares
