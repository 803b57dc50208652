"""Problem 4: texts cut off by field limits or in transfer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import is_blank
from lectern.llm.budget import source_key
from lectern.plans.staging import broadcast_within, stage

#: Least captures of a source at one length, and how far above chance, before the length counts as a limit.
MIN_AT_LIMIT, SIGMAS = 4, 6.0
#: Lines that must open alike before their share of closed ones is believed.
MIN_OPENINGS = 3
#: Words of a line that make its opening.
OPENING_WORDS = 4
#: Share of closed lines among those that open alike from which an open line is cut: at a limit of its source, and anywhere.
SHARE_AT_LIMIT, SHARE = 0.2, 0.6
#: Most limits that are broadcast; more are joined by shuffling.
BROADCAST_ROWS = 200_000
#: Openings and lines that a task remembers at once.
KNOWN = 200_000

#: The same text as other systems would have stored it: code points, UTF-16 units and UTF-8 bytes, the first and the last also with
#: line ends as CRLF and as LF; code points with HTML entities, with JSON escapes.
MEASURES = ("code_points", "utf16_units", "utf8_bytes", "code_points_crlf", "code_points_lf", "utf8_bytes_crlf", "utf8_bytes_lf", "entities", "json")

# What writers put where they cut a text.
_MARK = re.compile(
    r"(?:\s*(?:\[\s*(?:…|\.{3})\s*\]|\(\s*(?:…|\.{3})\s*\)|[\[(]\s*(?i:truncated|cut|cut off|continued|abridged|gekürzt|tronqué|truncado|cortado|обрезано|截断)\s*[\])]"
    r"|(?:…|\.{3,})\s*(?:(?:[^\W\d_]| ){2,30}\s*[»›>→]+)?))\s*$"
)
_ENDS, _CLOSERS = tuple(".!?。！？"), "\"'”’»)]）」』*_"
# A day number of a date closes no sentence.
_DAY = re.compile(r"(?<!\d)\d{1,2}\.$")
_NEXT_SENTENCE = re.compile(r"[.!?][\"”’»)]*\s+(\S)|[。！？][”」』）]*\S")
_OPENERS = "“«„¿¡"
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_HAN = "⺀-⿟々〇〡-〩〸-〻㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_HAS_HAN, _HAN_WORD = re.compile(f"[{_HAN}]"), re.compile(rf"\s+|[^\s{_HAN}]*[{_HAN}]|[^\s{_HAN}]+")
_LATIN = re.compile(r"[A-Za-z]+")
_CAPITAL = re.compile(r"(?:(?<=[«“„(])|^)[^\W\d_][^\W\d_’'\-]*(?:[’'\-][^\W\d_’'\-]*)*")
_LATER_CAPITAL = re.compile(_CAPITAL.pattern.replace("|^", ""))


def lengths(text: str) -> list[int]:
    """A text's length by each of ``MEASURES``."""
    cp, by = len(text), len(text.encode())
    lf, crlf, cr, quotes = text.count("\n"), text.count("\r\n"), text.count("\r"), text.count('"')
    wide = cp if text.isascii() else len(text.encode("utf-16-le")) // 2
    entities = cp + 4 * text.count("&") + 3 * (text.count("<") + text.count(">")) + 5 * quotes
    return [cp, wide, by, cp + lf - crlf, cp - crlf, by + lf - crlf, by - crlf, entities, cp + lf + cr + text.count("\t") + quotes + text.count("\\")]


def _capitals(m: re.Match) -> str:
    return "A" if m.group(0)[0].isupper() else m.group(0)


def opening_words(line: str) -> list[str]:
    """The first ``OPENING_WORDS`` words of a line and one more, without what varies: digits are 0, capitalized words after the first are A.

    In a line with Chinese characters these are words, and a space is one too.
    """
    most = OPENING_WORDS + 1
    if not line.isascii() and _HAS_HAN.search(line):
        found = (m.group(0) for m in islice(_HAN_WORD.finditer(line), most))
        return ["_" if w.isspace() else _NUMBER.sub("0", _LATIN.sub("A", w)) for w in found]
    return [(_CAPITAL if i else _LATER_CAPITAL).sub(_capitals, _NUMBER.sub("0", w)) for i, w in enumerate(line.split(None, most)[:most])]


def closed(line: str) -> bool:
    """Whether a line ends like a sentence, with closing marks after it or not; dots of omission don't count."""
    bare = line.rstrip(_CLOSERS)
    return bare.endswith(_ENDS) and bare[-3:-1] != ".."


def _in_address(line: str) -> bool:
    """Whether a line ends inside the address of a link."""
    at = line.rfind("](")
    return at >= 0 and not re.search(r"[)\s]", line[at + 2 :])


def ending(line: str) -> tuple[bool, bool, list[str]]:
    """Of a text's last line: whether it is open, whether another sentence starts inside of it, and the whole words that open it."""
    body = _MARK.sub("", line)
    inside = any(not m.group(1) or m.group(1).isupper() or m.group(1) in _OPENERS for m in _NEXT_SENTENCE.finditer(body))
    open_ = body != line or not closed(line) or bool(_DAY.search(line)) or _in_address(line)
    words = opening_words(body)
    # The last word may be cut, which changes it unless it stands for a name, a number or a character.
    whole = len(words) - (not words or not (words[-1] in ("A", "0", "_") or len(words[-1]) == 1 and bool(_HAS_HAN.match(words[-1]))))
    return open_, inside, words[: min(max(whole, 1), OPENING_WORDS)]


_ROWS = "page_id long, file string, sizes array<int>, open boolean, inside boolean, words array<string>, opening string, n long, closed long"
_TYPES = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.int64())


def _table(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=[x.split()[0] for x in _ROWS.split(", ")])


def _inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per capture, and for each opening of a whole line how many lines of the task's texts have it and how many of these are closed."""
    seen: dict[str, tuple[str, bool]] = {}
    count: dict[str, list[int]] = {}

    def openings() -> pa.RecordBatch:
        out = _table([(None, None, None, None, None, None, o, n, c) for o, (n, c) in count.items()])
        count.clear()
        return out

    for b in batches:
        rows = []
        for page_id, file, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            lines = text.strip().replace("\r\n", "\n").replace("\r", "\n").split("\n")
            for line in map(str.strip, lines[:-1]):
                if not line:
                    continue
                got = seen.get(line)
                if got is None:
                    got = " ".join(opening_words(line)[:OPENING_WORDS]), closed(line)
                    if len(line) < 120:
                        if len(seen) >= KNOWN:
                            seen.clear()
                        seen[line] = got
                here = count.get(got[0])
                if here is None:
                    here = count[got[0]] = [0, 0]
                here[0] += 1
                here[1] += got[1]
            # A byte limit can leave half a character, which readers turn into U+FFFD.
            bare = text.rstrip("�")
            if page_id is not None and bare.strip():
                last = bare.strip().replace("\r\n", "\n").replace("\r", "\n").rsplit("\n", 1)[-1].strip()
                rows.append((page_id, file, lengths(bare), *ending(last), None, None, None))
        yield _table(rows)
        if len(count) >= KNOWN:
            yield openings()
    yield openings()


def inspected(pages: DataFrame) -> DataFrame:
    """What all texts show, read once and staged: rows of captures (``page_id``, ``file``, ``sizes``, ``open``, ``inside``, ``words``) and of ``opening``s (``n``, ``closed``)."""
    return stage(pages.where(~is_blank(F.col("text"))).select("page_id", "file", "text").mapInArrow(_inspect, _ROWS), "inspected")


def captures(seen: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row per capture row with text: ``page_id``, ``source``, its ``sizes`` (measure to length), ``open``, ``inside`` and ``words``.

    A file that the manifest lists under several sources belongs to the least; one that it doesn't list has a null source.
    """
    owner = manifest.where("file is not null").groupBy("file").agg(F.min(source_key(F.col("source_id"))).alias("source"))
    rows = seen.where("page_id is not null").select("page_id", "file", F.map_from_arrays(F.array(*map(F.lit, MEASURES)), "sizes").alias("sizes"), "open", "inside", "words")
    return stage(rows.join(owner, "file", "left").drop("file"), "captures")


def field_limits(rows: DataFrame) -> DataFrame:
    """``source``, ``measure``, ``size``, ``n_at``, ``n_captures``: lengths that too many captures of a source share.

    The captures of a source are counted by each measure's length; a length is a limit if at least
    ``MIN_AT_LIMIT`` captures have it and more than ``SIGMAS`` deviations above an even spread of lengths
    up to it. Captures without source count as one source. Counting starts before the shuffle, so a large source is no hot key.
    """
    each = rows.select("source", F.explode("sizes").alias("measure", "size"))
    at = each.groupBy("source", "measure", "size").agg(F.count("*").alias("n_at"))
    total = rows.groupBy(F.col("source").alias("owner")).agg(F.count("*").alias("n_captures"))
    even = F.col("n_captures") / F.greatest(F.col("size"), F.lit(1)) * 2
    return (
        at.where(F.col("n_at") >= MIN_AT_LIMIT)
        .join(total, F.col("source").eqNullSafe(F.col("owner")))
        .where(F.col("n_at") > even + SIGMAS * F.sqrt(even))
        .select("source", "measure", "size", "n_at", "n_captures")
    )


def openings(seen: DataFrame) -> DataFrame:
    """``opening``, ``n``, ``closed``: how many whole lines open with these words, and how many of them end like a sentence.

    All lines of all texts but each text's last. Openings have one to ``OPENING_WORDS`` words.
    """
    longest = seen.where("opening is not null").groupBy("opening").agg(F.sum("n").alias("n"), F.sum("closed").alias("closed"))
    words = F.split("opening", " ")
    shorter = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))
    return longest.select(F.explode(shorter).alias("opening"), "n", "closed").groupBy("opening").agg(F.sum("n").alias("n"), F.sum("closed").alias("closed"))


def at_limits(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``page_id`` of the open captures whose length under some measure is a limit of their source."""
    limits = broadcast_within(stage(limits.select(F.col("source").alias("owner"), F.col("measure").alias("m"), F.col("size").alias("z")), "limits"), BROADCAST_ROWS)
    each = rows.where("open").select("page_id", "source", F.explode("sizes").alias("measure", "size"))
    found = each.join(limits, F.col("source").eqNullSafe(F.col("owner")) & (F.col("measure") == F.col("m")) & (F.col("size") == F.col("z")), "left_semi")
    return found.select("page_id").distinct()


def cut_captures(pages: DataFrame, manifest: DataFrame, use_limits: bool = True) -> DataFrame:
    """``page_id``, ``source``, ``cut``, ``path`` and ``at_limit``, one row per capture with text.

    First path, ``limit``: the text's length under some measure is a limit of its source (``at_limit``). Such a text was stopped by the limit, so its
    ending is only inspected for being whole after all: the last line ends like a sentence, or it opens as lines do of which fewer than ``SHARE_AT_LIMIT``
    end like a sentence anywhere in the corpus, that is as a heading, list item, table row or line of furniture does.

    Second path, ``transfer``: at no limit, the ending alone has to show the cut. The last line doesn't end like a sentence, or ends with a mark
    of omission, and at least ``SHARE`` of the lines that open alike do; where no lines do, another sentence starts inside of it.

    ``path`` is null where ``cut`` is false. Null and blank texts have no row. A repeated ``page_id`` has one row; it is cut if any of its rows is.
    ``use_limits`` set to false leaves the second path alone.
    """
    seen = inspected(pages)
    rows = captures(seen, manifest)
    prefixes = F.transform(F.sequence(F.lit(1), F.size("words")), lambda k: F.array_join(F.slice(F.col("words"), F.lit(1), k), " "))
    asked = rows.where("open and size(words) > 0").select("page_id", F.posexplode(prefixes).alias("k", "opening"))
    known = asked.join(openings(seen).where(F.col("n") >= MIN_OPENINGS), "opening")
    told = known.groupBy("page_id").agg(F.max(F.struct("k", (F.col("closed") / F.col("n")).alias("share"))).alias("best")).select("page_id", F.col("best.share").alias("share"))
    string, flag, number = (F.lit(None).cast(t) for t in ("string", "boolean", "double"))
    parts = [
        rows.select("page_id", "source", "open", (F.col("open") & F.col("inside")).alias("inside"), number.alias("share"), flag.alias("hit")),
        told.select("page_id", string.alias("source"), flag.alias("open"), flag.alias("inside"), "share", flag.alias("hit")),
    ]
    if use_limits:
        hits = at_limits(rows, field_limits(rows))
        parts.append(hits.select("page_id", string.alias("source"), flag.alias("open"), flag.alias("inside"), number.alias("share"), F.lit(True).alias("hit")))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    page = union.groupBy("page_id").agg(F.min("source").alias("source"), F.max("open").alias("open"), F.max("inside").alias("inside"), F.max("share").alias("share"), F.coalesce(F.max("hit"), F.lit(False)).alias("at_limit"))
    by_limit = F.col("at_limit") & (F.coalesce("share", F.lit(1.0)) >= SHARE_AT_LIMIT)
    by_ending = F.col("open") & (F.coalesce("share", F.col("inside").cast("double")) >= SHARE)
    path = F.when(by_limit, F.lit("limit")).when(by_ending, F.lit("transfer"))
    return page.select("page_id", "source", path.isNotNull().alias("cut"), path.alias("path"), "at_limit")


def source_shares(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """``source``, ``n_captures``, ``n_cut``, ``n_at_limit``, ``cut_share`` for every source of the manifest and for files it lacks (null).

    ``n_at_limit`` counts open endings at a limit. A source without captures has zero of each and a null share.
    """
    got = cut_captures(pages, manifest)
    counts = got.groupBy("source").agg(F.count("*").alias("n_captures"), F.count_if("cut").alias("n_cut"), F.count_if("at_limit").alias("n_at_limit"))
    known = manifest.select(source_key(F.col("source_id")).alias("source")).where("source is not null").distinct()
    rest = known.join(counts, "source", "left_anti").select("source", *[F.lit(0).cast("bigint").alias(c) for c in ("n_captures", "n_cut", "n_at_limit")])
    return counts.unionByName(rest).withColumn("cut_share", F.round(F.try_divide("n_cut", "n_captures"), 6))
