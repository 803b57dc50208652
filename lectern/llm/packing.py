"""Problem 6: documents packed into containers of fixed capacity, mixed by source."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.tokens import TOKENIZERS, VOCABULARY, count_column
from lectern.plans.staging import stage, within

#: Documents of one shard, about. A shard is packed by one task; its last containers are all that sharding wastes.
SHARD_DOCS = 4096
#: Shards whose sums one task adds up in order.
BLOCK = 1024
#: Containers in a row that ``fill_report`` takes together.
RUN = 64
#: Limits that one call packs for.
MAX_BOXES = 1000


def sized_documents(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Staged ``doc_id``, ``source``, ``tokens``, distinct; null texts have no tokens."""
    counted = documents.where("doc_id is not null").select("doc_id", "source", "text")
    counted = counted.mapInArrow(count_column(documents.sparkSession, "text", "tokens", folder, vocabulary), "doc_id long, source string, tokens long")
    return stage(counted.distinct(), "sized")


class Windows:
    """Fills one container after another from source queues by deficit round-robin.

    A source's turn comes when its tokens so far, less what it carries over from earlier shards, are
    least in proportion to its target share: that is the source with the largest deficit. It gives its largest item that fits. A source
    that has none that fits has none for the rest of the window, in which room only shrinks, and keeps its deficit for the windows to come. A window closes when no
    item of any source fits.
    """

    def __init__(self, items: Iterable[tuple[int, str, int]], shares: dict[str, float], carry: dict[str, float]):
        self.queues: dict[str, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.sizes: dict[str, int] = defaultdict(int)
        self.n: dict[int, int] = defaultdict(int)
        self.any = 0
        for item, source, size in items:
            self.queues[source][size].append(item)
            self.sizes[source] |= 1 << size
            self.n[size] += 1
            self.any |= 1 << size
        self.share = {s: shares.get(s, 0.0) for s in self.queues}
        # A source without a share comes after all others.
        self.turn = {s: -carry.get(s, 0.0) / self.share[s] if self.share[s] > 0 else math.inf for s in self.queues}
        self.order = sorted((t, s) for s, t in self.turn.items())

    def _take(self, source: str, size: int) -> int:
        queue = self.queues[source]
        item = queue[size].pop()
        if not queue[size]:
            del queue[size]
            self.sizes[source] ^= 1 << size
        self.n[size] -= 1
        if not self.n[size]:
            self.any ^= 1 << size
        if self.share[source] > 0:
            self.turn[source] += size / self.share[source]
        if self.sizes[source]:
            heapq.heappush(self.order, (self.turn[source], source))
        return item

    @staticmethod
    def _largest(sizes: int, room: int) -> int:
        return (sizes & ((1 << (room + 1)) - 1)).bit_length() - 1

    def fill(self, capacity: int) -> list[int]:
        """The items of the next window; empty when none are left."""
        room, out, passed = capacity, [], []
        while self.order and self._largest(self.any, room) >= 0:
            turn, source = heapq.heappop(self.order)
            if turn != self.turn[source] or not self.sizes[source]:
                continue
            size = self._largest(self.sizes[source], room)
            if size < 0:
                passed.append((turn, source))
            else:
                out.append(self._take(source, size))
                room -= size
        for entry in passed:
            heapq.heappush(self.order, entry)
        return out


def pack_shard(docs: list[tuple[int, str | None, int]], capacity: int, shares: dict[str, float], carry: dict[str, float]) -> list[tuple[int, int, int, int, int, int]]:
    """(index of document, piece_no, n_pieces, first token, tokens, container) for one shard; containers are numbered from 0.

    A document longer than the capacity fills containers of its own; its rest is an item like others.
    """
    rows, items, at = [], [], 0
    parts: dict[int, tuple[int, int]] = {}
    for i, (_, source, n) in enumerate(docs):
        full, rest = divmod(n, capacity)
        pieces = full + (rest > 0)
        for p in range(full):
            rows.append((i, p + 1, pieces, p * capacity, capacity, at))
            at += 1
        if rest:
            items.append((i, source, rest))
            parts[i] = (full, pieces)
    windows = Windows(items, shares, carry)
    while got := windows.fill(capacity):
        for i in got:
            full, pieces = parts[i]
            rows.append((i, full + 1, pieces, full * capacity, docs[i][2] - full * capacity, at))
        at += 1
    return rows


SCHEMA = "limit_name string, doc_id long, source string, piece_no int, n_pieces int, first_token long, tokens long, container_id long"


def _source_key(c: str = "source") -> Column:
    """A key that is never null: a null source is a source of its own, apart from an empty one."""
    return F.when(F.col(c).isNull(), F.lit("")).otherwise(F.concat(F.lit("."), c))


def _before(rows: DataFrame, value: str, out: str, *keys: str) -> DataFrame:
    """``rows`` (``shard``, ``value``, ``keys``) with ``out``: the sum of ``value`` over all earlier shards of the same keys.

    Summed by blocks of ``BLOCK`` shards side by side, then over the blocks' sums.
    """
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("block", F.floor(F.col("shard") / BLOCK))
    blocks = rows.groupBy(*keys, "block").agg(F.sum(value).alias("sum"))
    blocks = blocks.select(*keys, "block", F.coalesce(F.sum("sum").over(upto(Window.partitionBy(*keys, F.lit(0)).orderBy("block"))), F.lit(0)).alias("blocks"))
    inside = F.coalesce(F.sum(value).over(upto(Window.partitionBy(*keys, "block").orderBy("shard"))), F.lit(0))
    return rows.withColumn("inside", inside).join(blocks, [*keys, "block"]).withColumn(out, F.col("blocks") + F.col("inside")).drop("block", "inside", "blocks")


def containers(sized: DataFrame, limits: DataFrame, shard_docs: int = SHARD_DOCS, weights: DataFrame | None = None) -> DataFrame:
    """The container of each document, or of each piece of one that exceeds the capacity, for every ``..._box`` limit.

    ``sized`` is a staged table of ``doc_id``, ``source``, ``tokens``. Output: ``limit_name``, ``doc_id``, ``source``, ``piece_no`` from 1,
    ``n_pieces``, ``first_token``, ``tokens``, ``container_id`` (unique in its limit). A document without tokens has one row with ``n_pieces`` 0 and no container.

    Documents are spread over shards of even size by a hash of their ids, so no source is a hot group. The target
    proportions are those of ``weights`` (``source``, ``weight``; a source that it lacks comes last), by default the sources' shares of all tokens; what the shards before hold less of a source than its part of all tokens, which
    sums per shard and source tell beforehand, is carried into a shard as its deficit, so shards run side by side.
    A null source is a source of its own.
    """
    named = limits.where(F.col("limit_name").endswith("_box") & (F.col("max_size") > 0)).select("limit_name", "max_size").distinct()
    if not within(named, MAX_BOXES):
        raise ValueError(f"more than {MAX_BOXES} limits")
    boxes = [(r.limit_name, r.max_size) for r in named.collect()]
    n, total = sized.agg(F.count("*"), F.sum("tokens")).first()
    shards = max(1, -(-n // shard_docs))
    items = sized.select("doc_id", _source_key().alias("source"), "tokens", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))
    by = stage(items.groupBy("shard", "source").agg(F.sum("tokens").alias("have")), "shard-sources")
    own = by.groupBy("source").agg((F.sum("have") / F.lit(float(total or 1))).alias("own"))
    share = own.withColumn("share", F.col("own"))
    if weights is not None:
        given = weights.groupBy(_source_key().alias("source")).agg(F.sum("weight").cast("double").alias("w"))
        of = given.join(own, "source", "left_semi").agg(F.sum("w")).first()[0]
        share = own.join(given, "source", "left").select("source", "own", (F.coalesce("w", F.lit(0.0)) / F.lit(float(of or 1))).alias("share"))
    passed = _before(by.groupBy("shard").agg(F.sum("have").alias("size")), "size", "passed").select("shard", "passed")
    carry = _before(by, "have", "given", "source").join(share, "source").join(passed, "shard").select("shard", "source", "share", (F.col("own") * F.col("passed") - F.col("given")).alias("carry"))
    box = F.explode(F.array(*[F.struct(F.lit(name).alias("limit_name"), F.lit(size).alias("capacity")) for name, size in boxes]))
    work = items.join(carry, ["shard", "source"]).withColumn("box", box).select("doc_id", "source", "tokens", "shard", "share", "carry", "box.*")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name, capacity, shard = pdf.limit_name.iat[0], int(pdf.capacity.iat[0]), int(pdf["shard"].iat[0])
        pdf = pdf.sort_values(["tokens", "doc_id", "source"])
        docs = list(zip(pdf.doc_id.tolist(), pdf["source"].tolist(), pdf.tokens.tolist(), strict=True))
        rows = pack_shard(docs, capacity, dict(zip(pdf["source"], pdf["share"].fillna(0.0), strict=True)), dict(zip(pdf["source"], pdf["carry"].fillna(0.0), strict=True)))
        out = [(name, docs[i][0], docs[i][1], p, k, first, t, (shard << 40) | at) for i, p, k, first, t, at in rows]
        out += [(name, d, s, 1, 0, 0, 0, None) for d, s, t in docs if not t]
        frame = pd.DataFrame(out, columns=["limit_name", "doc_id", "source", "piece_no", "n_pieces", "first_token", "tokens", "container_id"])
        frame["source"] = frame["source"].where(frame["source"] != "", None).str[1:]
        return frame.astype({"container_id": "Int64"})

    return work.groupBy("limit_name", "capacity", "shard").applyInPandas(run, SCHEMA)


def fill_report(packed: DataFrame, limits: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """``limit_name``, ``capacity``, ``n_containers``, ``least_containers``, ``tokens``, ``filled`` (share of the room that is used), ``mix_error`` and ``run_error``.

    The last two are how far the sources' shares of tokens are from their targets (half the sum of differences), on average of the containers, and of
    ``RUN`` containers in a row: few documents fit one container, so deficits are only made up for in those that follow.
    """
    packed = stage(packed.where("container_id is not null").select("limit_name", "container_id", _source_key().alias("source"), "tokens"), "packed")
    boxes = limits.select("limit_name", F.col("max_size").cast("long").alias("capacity"))
    used = packed.groupBy("limit_name").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("tokens").alias("tokens"))
    want = packed.groupBy("limit_name", "source").agg(F.sum("tokens").alias("w"))
    if weights is not None:
        want = want.select("limit_name", "source").join(weights.groupBy(_source_key().alias("source")).agg(F.sum("weight").alias("w")), "source", "left").fillna(0, ["w"])
    want = want.join(want.groupBy("limit_name").agg(F.sum("w").alias("of")), "limit_name").select("limit_name", "source", (F.col("w") / F.col("of")).alias("target"))
    for name, shift in (("mix_error", 0), ("run_error", RUN.bit_length() - 1)):
        each = packed.groupBy("limit_name", F.shiftright("container_id", shift).alias("at"), "source").agg(F.sum("tokens").alias("t"))
        each = each.join(each.groupBy("limit_name", "at").agg(F.sum("t").alias("all")), ["limit_name", "at"]).join(want, ["limit_name", "source"])
        off = each.groupBy("limit_name", "at").agg((F.sum(F.abs(F.col("t") / F.col("all") - F.col("target")) - F.col("target")) / 2 + 0.5).alias("off"))
        used = used.join(off.groupBy("limit_name").agg(F.round(F.avg("off"), 4).alias(name)), "limit_name")
    return used.join(F.broadcast(boxes), "limit_name").select(
        "limit_name",
        "capacity",
        "n_containers",
        F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"),
        "tokens",
        F.round(F.col("tokens") / (F.col("n_containers") * F.col("capacity")), 6).alias("filled"),
        "mix_error",
        "run_error",
    )


def placed(packed: DataFrame, sized: DataFrame, limits: DataFrame) -> DataFrame:
    """``limit_name``, ``documents``, ``empty``, ``overfull``, ``wrong``, a check of ``containers``: documents that have rows, those without tokens, containers over their capacity,
    and documents whose pieces don't make up their tokens."""
    packed = stage(packed, "packed")
    boxes = limits.where(F.col("limit_name").endswith("_box")).select("limit_name", "max_size").distinct()
    by_doc = packed.groupBy("limit_name", "doc_id").agg(F.sum("tokens").alias("t"), F.max("n_pieces").alias("n"), F.count("*").alias("rows")).join(sized.groupBy("doc_id").agg(F.sum("tokens").alias("tokens")), "doc_id")
    docs = by_doc.groupBy("limit_name").agg(F.count("*").alias("documents"), F.count_if(F.col("n") == 0).alias("empty"), F.count_if((F.col("t") != F.col("tokens")) | (F.col("rows") != F.greatest("n", F.lit(1)))).alias("wrong"))
    full = packed.where("container_id is not null").groupBy("limit_name", "container_id").agg(F.sum("tokens").alias("t")).join(F.broadcast(boxes), "limit_name").groupBy("limit_name").agg(F.count_if(F.col("t") > F.col("max_size")).alias("overfull"))
    return docs.join(full, "limit_name", "left").select("limit_name", "documents", "empty", F.coalesce("overfull", F.lit(0)).alias("overfull"), "wrong")
