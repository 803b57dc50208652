"""Problem 3: oversized texts cut at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import strip

_HEADING = re.compile(r"#{1,6}(?=[ \t])|<h[1-6]\b", re.I)
#: An item's mark, and the end of an element that stands alone.
_ITEM, _ROW = re.compile(r"([ \t]*)(?:[-*+•›»]|\d{1,9}[.)])[ \t]"), re.compile(r"[ \t]*\|")
_ELEMENT = re.compile(r"</(?:p|div|ul|ol|li|table|tr|section|article|h[1-6])>|<br ?/?>", re.I)
_SENTENCE = re.compile(r"(?:[.!?…]+[\"'”’»)\]]*(?=\s))|(?:[。！？]+[”’」』）]*)")
_WORD = re.compile(r"\S+\s*")
#: Characters that belong to the one before them.
_JOINED = re.compile(r"[̀-ͯ‌‍︀-️⃐-⃿\U0001f3fb-\U0001f3ff]")

#: Lists in lists that are told apart.
DEEPEST = 50
Span = tuple[int, int]


class Node:
    """A part of a text: its span and its kind. Children of a node lie side by side and fill its span; white space belongs to what it follows."""

    __slots__ = ("children", "end", "kind", "start")

    def __init__(self, kind: str, start: int, end: int, children: list[Node] | None = None):
        self.kind, self.start, self.end, self.children = kind, start, end, children

    def parts(self, text: str) -> list[Node]:
        """The children; those of blocks, lines and sentences are found when they are asked for."""
        if self.children is None:
            self.children = _opened(text, self)
        return self.children


def _cut(kind: str, s: int, e: int, marks: list[int]) -> list[Node]:
    at = [s, *[m for m in marks if s < m < e], e]
    return [Node(kind, a, b) for a, b in zip(at, at[1:], strict=False)]


def _opened(text: str, node: Node) -> list[Node]:
    s, e = node.start, node.end
    if node.kind in ("block", "item", "heading"):
        marks = [i + 1 for i in range(s, e) if text[i] == "\n"] + [m.end() for m in _ELEMENT.finditer(text, s, e)]
        return _cut("line", s, e, sorted(marks))
    if node.kind in ("line", "row"):
        # White space after a sentence belongs to it.
        return _cut("sentence", s, e, [_skip(text, m.end(), e) for m in _SENTENCE.finditer(text, s, e)])
    if node.kind == "sentence":
        return _cut("word", s, e, [m.start() for m in _WORD.finditer(text, s, e)])
    return []


def _skip(text: str, i: int, e: int) -> int:
    while i < e and text[i].isspace():
        i += 1
    return i


def _lists(text: str, lines: list[Span], level: int = 0) -> list[Node]:
    """Lines of a list as items, each with the deeper items below it as its children."""
    out: list[Node] = []
    i = 0
    while i < len(lines):
        s, e = lines[i]
        m = _ITEM.match(text, s, e)
        depth = len(m.group(1)) if m and level < DEEPEST else 1 << 30
        j = i + 1
        while j < len(lines):
            n = _ITEM.match(text, *lines[j])
            if n and len(n.group(1)) <= depth:
                break
            j += 1
        own = next((k for k in range(i + 1, j) if _ITEM.match(text, *lines[k])), j)
        head = Node("item", s, lines[own - 1][1])
        out.append(head if own == j else Node("items", s, lines[j - 1][1], [head, *_lists(text, lines[own:j], level + 1)]))
        i = j
    return out


def tree(text: str) -> Node:
    """The structure of a text without white space at its ends: sections by the depth of their headings, in these blocks between blank lines, lists by their indentation, tables by rows.

    Below those are lines, sentences and words.
    """
    lines: list[Span] = []
    s = 0
    for part in re.findall(r"[^\n]*\n|[^\n]+", text):
        lines.append((s, s + len(part)))
        s += len(part)
    blocks: list[tuple[int, Node]] = []  # depth of a heading or 0, node
    i = 0
    while i < len(lines):
        j = i + 1
        kind = _kind(text, lines[i])
        while j < len(lines) and (not text[lines[j][0] : lines[j][1]].strip() or kind != "heading" and text[lines[j - 1][0] : lines[j - 1][1]].strip() and _joins(kind, _kind(text, lines[j]))):
            j += 1
        s, e = lines[i][0], lines[j - 1][1]
        if kind == "heading":
            m = _HEADING.match(text, s, e)
            # A heading element may have its section on the same line.
            alone = text[s] == "#" or text[s:e].rstrip().find("</h") == len(text[s:e].rstrip()) - 5
            blocks.append((int(text[m.end() - 1]) if text[s] == "<" else m.end() - s, Node("heading" if alone else "block", s, e)))
        elif kind == "row":
            blocks.append((0, Node("table", s, e, [Node("row", *x) for x in _joined(text, lines[i:j])])))
        elif kind == "item":
            blocks.append((0, Node("list", s, e, _lists(text, _joined(text, lines[i:j])))))
        else:
            blocks.append((0, Node("block", s, e)))
        i = j
    return Node("section", 0, len(text), _sections(blocks))


def _joined(text: str, lines: list[Span]) -> list[Span]:
    """Lines with the blank ones after them."""
    out: list[Span] = []
    for s, e in lines:
        if out and not text[s:e].strip():
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def _kind(text: str, line: Span) -> str:
    if _HEADING.match(text, *line):
        return "heading"
    return "row" if _ROW.match(text, *line) else "item" if _ITEM.match(text, *line) else "block"


def _joins(kind: str, after: str) -> bool:
    """Whether a line goes on with the block before it; a line of text below an item belongs to it."""
    return after == kind or kind == "item" and after == "block"


def _sections(blocks: list[tuple[int, Node]]) -> list[Node]:
    """Blocks as sections: a heading and all up to the next one of its depth or less."""
    out: list[Node] = []
    i = 0
    while i < len(blocks):
        d, node = blocks[i]
        if not d:
            out.append(node)
            i += 1
            continue
        j = i + 1
        while j < len(blocks) and not 0 < blocks[j][0] <= d:
            j += 1
        inner = _sections(blocks[i + 1 : j])
        out.append(Node("section", node.start, inner[-1].end, [node, *inner]) if inner else node)
        i = j
    return out


def pack(text: str, limit: int, overlap: int) -> list[Span]:
    """Spans of the pieces' own text, in order; each begins where the one before ends. The first is at most ``limit`` long, the others leave room for the overlap.

    Subtrees are merged bottom-up: a node that fits is whole, and siblings next to each other are merged as far as the limit allows. Only a node that is too large is
    opened, and its parts are merged among themselves alone, so a piece crosses the border of a section or block only where it holds both whole. A heading
    goes with what follows it. A word longer than the room is cut between code points.
    """

    def room(start: int) -> int:
        return limit - overlap if start else limit

    def trim(e: int) -> int:
        while e and text[e - 1].isspace():
            e -= 1
        return e

    def sliced(s: int, e: int) -> list[Span]:
        out = []
        while e - s > room(s):
            cut = s + room(s)
            while cut > s + 1 and _JOINED.match(text, cut):
                cut -= 1
            out.append((s, cut))
            s = cut
        return [*out, (s, e)]

    def packed(node: Node, start: int) -> list[Span]:
        """The pieces from ``start``, where the piece before ends or a heading that goes with the node begins, to the node's end."""
        if trim(node.end) - start <= room(start):
            return [(start, trim(node.end))]
        parts = node.parts(text)
        if not parts:
            lead = trim(node.start)
            return [*([(start, lead)] if lead > start else []), *sliced(lead, trim(node.end))]
        out: list[Span] = []
        first = end = start  # of the open group of siblings
        tail: int | None = None  # where the headings at its end begin
        for part in parts:
            e = trim(part.end)
            if e - first > room(first):
                cut = end if tail is None else tail
                if cut > first:
                    out.append((first, cut))
                    first = cut
                if e - first > room(first):
                    out += packed(part, first)
                    first, tail = out[-1][1], None
                    end = first
                    continue
            tail = (end if tail is None else tail) if part.kind == "heading" else None
            end = e
        return [*out, (first, end)] if end > first else out

    return packed(tree(text), 0) if text else []


def pieces_of(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, piece) of the stripped text: every piece but the first starts with the last ``overlap`` code points of the one before."""
    text = text.strip()
    out: list[tuple[int, int, str]] = []
    last = 0
    for s, e in pack(text, limit, overlap):
        start = max(last - overlap, out[-1][0]) if out else s
        out.append((start, e, text[start:e]))
        last = e
    return out


SCHEMA = "chunk_id string, piece_no int, n_pieces int, start int, end int, piece string"


def split_oversized(chunks: DataFrame, limit: int, overlap: int) -> DataFrame:
    """The pieces of every text longer than ``limit`` code points without white space at its ends.

    Output: ``chunk_id``, ``piece_no`` from 1, ``n_pieces``, ``start`` and ``end`` (code points in the stripped
    text) and ``piece``, at most ``limit`` long. Pieces overlap by exactly ``overlap`` code points
    (all of a shorter previous piece), so the stripped text is the first piece and each later one without
    its overlap, joined. Declared sizes are not read. Null and blank texts have no pieces; repeated rows give repeated pieces.
    A ``limit`` not above twice the overlap is an error.
    """
    if overlap < 0 or limit <= 2 * overlap:
        raise ValueError("the limit must be more than twice the overlap")
    bare = chunks.select("chunk_id", strip(F.col("text")).alias("text")).where(F.length("text") > limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for cid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = pieces_of(text, limit, overlap)
                rows += [(cid, i, len(got), s, e, p) for i, (s, e, p) in enumerate(got, 1)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["chunk_id", "piece_no", "n_pieces", "start", "end", "piece"])

    return bare.mapInArrow(run, SCHEMA)


def rejoined(pieces: DataFrame, limit: int, overlap: int) -> DataFrame:
    """``chunk_id``, ``text_md5`` of the pieces without their overlaps joined, ``over_limit`` and ``odd_overlaps``: how many pieces are too long, or don't overlap as they should.

    A check of ``split_oversized``: the first equals the MD5 of the stripped text, the others are 0. ``pieces`` has no repeated rows.
    """
    rows = pieces.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("piece_no", "start", "end", "piece"))).alias("p"), F.count_if(F.length("piece") > limit).alias("over_limit"))
    before = lambda i: F.get("p", i - 1)
    own = F.transform("p", lambda x, i: F.when(i == 0, x.piece).otherwise(F.substring(x.piece, before(i).end - x.start + 1, F.length(x.piece))))
    odd = F.transform("p", lambda x, i: F.when((i > 0) & (before(i).end - x.start != F.least(F.lit(overlap), before(i).end - before(i).start)), 1).otherwise(0))
    return rows.select("chunk_id", F.md5(F.array_join(own, "")).alias("text_md5"), "over_limit", F.aggregate(odd, F.lit(0), lambda a, b: a + b).alias("odd_overlaps"))


def chunk_limit(limits: DataFrame, name: str = "chunk_text") -> tuple[int, int]:
    """``max_size`` and ``overlap`` of a limit, one row of a table of four."""
    row = limits.where(F.col("limit_name") == name).select("max_size", "overlap").first()
    if row is None:
        raise ValueError(f"no limit named {name}")
    return row.max_size, row.overlap or 0
