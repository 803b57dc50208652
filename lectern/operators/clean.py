"""Captured pages to clean text, and which capture stands for a page."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.config import FOOTER_MARKERS, JUMP_PHRASE, LINE_PATTERNS, LINK_LINE, NAVIGATION_PHRASE, SEARCH_LABELS, SHORT_LINE_PATTERNS, START_MARKERS
from lectern.functions.text import collapse, first_url, lines, norm_url, strip, unify_newlines


def content_of(df: DataFrame, text: str, out: str, starts: tuple[str, ...] = START_MARKERS, footers: tuple[str, ...] = FOOTER_MARKERS) -> DataFrame:
    """``df`` with ``out``: the text from the first of ``starts``, in their order, that it has, up to the nearest of ``footers`` after that place.

    Without a start it begins at the text's beginning, without a footer it reaches to the end.
    """
    c, start = F.col(text), F.col("__start")
    at = df.withColumn("__start", F.coalesce(*[F.nullif(F.instr(c, m), F.lit(0)) for m in starts], F.lit(1)))
    ends = [F.nullif(F.call_function("locate", F.lit(m), c, start + 1), F.lit(0)) for m in footers]
    end = F.least(*ends, F.length(c) + 1)
    return at.withColumn(out, F.call_function("substring", c, start, end - start)).drop("__start")


def is_furniture(s: Column, labels: tuple[str, ...] = SEARCH_LABELS) -> Column:
    """Whether a stripped line is navigation: menus, jump links, search ``labels``, images, link items, breadcrumbs, lone links and bare URLs."""
    short = F.length(s) < LINK_LINE
    return (
        s.contains(NAVIGATION_PHRASE)
        | (s.startswith("[") & s.contains(JUMP_PHRASE))
        | s.isin(*labels)
        | s.startswith("![")
        | (short & _any(s, SHORT_LINE_PATTERNS))
        | _any(s, LINE_PATTERNS)
    )


def _any(s: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(or_, [s.rlike(p) for p in patterns])


def plain_line(s: Column) -> Column:
    """A line without markup: links as their labels, no backticks, no ``#`` at its ends, rules of hyphens empty, single spaces."""
    flat = F.replace(F.regexp_replace(s, r"\[([^\]]+)\]\([^)]+\)", "$1"), F.lit("`"), F.lit(""))
    bare = strip(F.regexp_replace(flat, r"^#+|#+$", ""))
    return collapse(F.regexp_replace(bare, r"^-+$", ""))


_WAS_BLANK = "\x00"


def clean_lines(c: Column, labels: tuple[str, ...] = SEARCH_LABELS) -> Column:
    """The lines that stay, rewritten; blank lines stay blank, a line that only becomes empty is dropped."""
    bare = F.transform(lines(c), strip)
    kept = F.transform(bare, lambda s: F.when(s == "", F.lit(_WAS_BLANK)).when(~is_furniture(s, labels), plain_line(s)))
    return F.transform(F.filter(kept, lambda s: s != ""), lambda s: F.when(s == _WAS_BLANK, F.lit("")).otherwise(s))


def clean(df: DataFrame, text: str = "text", out: str = "clean_text", labels: tuple[str, ...] = SEARCH_LABELS) -> DataFrame:
    """``df`` with ``out``, the content of the captured page in ``text`` as plain text. Null stays null. ``labels``: lines that are the label of a search box."""
    rows = content_of(df.withColumn("__lf", unify_newlines(F.col(text))), "__lf", "__content")
    joined = F.array_join(clean_lines(F.col("__content"), labels), "\n")
    return rows.withColumn(out, strip(F.regexp_replace(joined, r"\n{3,}", "\n\n"))).drop("__lf", "__content")


def parse_capture(blob: Column) -> Column:
    """The text of a capture: the ``text`` of a JSON list's first element or of a JSON object, the whole blob where there is none."""
    v = F.try_parse_json(blob)
    return F.coalesce(F.try_variant_get(v, "$[0].text", "string"), F.try_variant_get(v, "$.text", "string"), blob)


def match_captures(captures: DataFrame, manifest: DataFrame, only: str = "") -> DataFrame:
    """Captures whose URL the manifest has, with its ``file``; joined on the normalized URL.

    A null URL is looked for in the capture's first lines; a capture without any is left out. Of manifest rows with
    the same normalized URL the one with the last ``file`` counts. ``only`` keeps files with that in their name, whatever the case.
    """
    last = manifest.where("file is not null").select(norm_url(F.col("url")).alias("key"), "file").where("key <> ''").groupBy("key").agg(F.max("file").alias("file"))
    last = last.where(F.lower("file").contains(only.lower())) if only else last
    url = F.coalesce("url", first_url(F.col("text")))
    return captures.drop("file").withColumn("key", norm_url(url)).where("key <> ''").join(last, "key").drop("key")


def largest_capture(captures: DataFrame, key: str = "file", order: str = "page_id") -> DataFrame:
    """The longest capture of each ``key``; of equally long ones the first by ``order``. Null keys and texts have none."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.length("text")), order))
    return captures.where(F.col(key).isNotNull() & F.col("text").isNotNull()).withColumn("__rank", rank).where("__rank = 1").drop("__rank")
