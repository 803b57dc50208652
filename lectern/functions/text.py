"""Text functions with defined Unicode behavior.

Spark's own ``trim`` removes U+0020 only and Java's ``\\s`` is ASCII unless told otherwise, so each
pattern below states its class. Null in, null out, unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str.isspace`` has it: Unicode separators and the ASCII control range.
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"


#: The same characters one by one, for functions that take a set of them.
SPACES = "".join(chr(i) for i in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def strip(c: Column) -> Column:
    """``c`` without white space of any kind at its two ends. Looks at the ends only."""
    return F.btrim(c, F.lit(SPACES))


def unify_newlines(c: Column) -> Column:
    """CRLF and lone CR become LF."""
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only values; never null."""
    return F.coalesce(~c.rlike(f"(?!{SPACE})(?s:.)"), F.lit(True))


def label(c: Column) -> Column:
    """One spelling of a short label: outer space cut, lower case, runs of space, ``_`` and ``-`` as one space."""
    return F.regexp_replace(F.lower(strip(c)), r"[\s_\-]+", " ")


def tokens(c: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Runs of ASCII letters and digits of the text in lower case, in order, without ``stopwords``; none for null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return F.filter(found, lambda t: ~t.isin(list(stopwords))) if stopwords else found


def normalize(c: Column) -> Column:
    """Line ends as LF, runs of space and tab as one space, at most one blank line in a row, ends stripped."""
    return strip(F.regexp_replace(F.regexp_replace(unify_newlines(c), r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def sentences(c: Column) -> Column:
    """Pieces cut at white space after ``. ! ?`` and before an ASCII capital or ``(``; blank ones left out."""
    parts = F.transform(F.split(c, rf"(?<=[.!?]){SPACE}+(?=[A-Z(])"), strip)
    return F.filter(parts, lambda s: s != "")


def paragraphs(c: Column) -> Column:
    """Stripped pieces between blank lines; blank ones left out."""
    return F.filter(F.transform(F.split(c, "\n\n"), strip), lambda s: s != "")


_BREAK = r"(?:\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029])"


def lines(c: Column) -> Column:
    """Lines at any Unicode line boundary; a boundary at the end opens no further line. Empty text is one empty line."""
    return F.split(F.regexp_replace(c, _BREAK + r"\z", ""), _BREAK)


def collapse(c: Column) -> Column:
    """Runs of white space as one space, ends stripped."""
    return strip(F.regexp_replace(c, f"{SPACE}+", " "))


def norm_url(c: Column) -> Column:
    """A URL to compare by: lower case, without scheme, without an ``index``, ``.php`` or ``.html`` ending and without slashes at its end."""
    bare = F.regexp_replace(F.lower(strip(c)), r"^https?://", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?:index)?(?:\.php|\.html)?/?$", ""), "/+$", "")


def first_url(c: Column, within: int = 6) -> Column:
    """The first URL in the first ``within`` lines, empty if there is none."""
    found = F.transform(F.slice(lines(c), 1, within), lambda x: F.regexp_extract(x, r"https?://[^\s)]+", 0))
    return F.coalesce(F.get(F.filter(found, lambda u: u != ""), F.lit(0)), F.lit(""))


def token_estimate(c: Column) -> Column:
    """A quarter of the code points, rounded half to even."""
    return F.bround(F.length(c) / 4).cast("int")
