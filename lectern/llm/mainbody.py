"""Problem 5: the main body of a page apart from the furniture of its site.

Each page is a graph of its lines. A classifier's costs are the capacities between a line and the two terminals,
body and furniture. Smoothness edges join each line to the next, and lines that are near in the page's structure: the items of a list or rows of a table to
its first, the blocks of a section to its heading, a heading to the heading above it. A maximum flow gives the minimum cut, which labels the lines.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.plans.staging import stage, within

#: Pages whose lines the classifier's weights are fitted on, about; a bound whatever the size of the table. What labels these lines is counted over all pages.
SAMPLE_PAGES = 4000
#: Characters that these pages have together, about, and that one of them has at most; bounds the sample in bytes.
SAMPLE_CHARS, PAGE_CHARS = 32_000_000, 200_000
#: Most common words, and most labels that stand in breadcrumbs, that go to every worker; larger sets are joined to the pages by shuffling.
KNOWN = 300_000
#: Files of the table in which a line, or the shape of a line, stands before it is taken for furniture when fitting.
MIN_FILES, MIN_SHAPE_FILES = 4, 8
#: Features with a weight, at most.
MAX_FEATURES = 1 << 16
#: Bound of a line's cost, and the smoothness of lines in a row, of one kind in a row, and across a blank line.
MAX_COST, NEXT, ALIKE, APART = 6.0, 0.6, 1.2, 0.25
#: Smoothness of an item and its list's first one, and of a block, or a heading, and the heading that it stands under.
ITEM, SECTION = 0.3, 0.15
#: Letters of a word that may name a page's subject, and of an address's last part that may, at least.
SUBJECT_LETTERS, SLUG_LETTERS = 5, 4

_WORD = re.compile(r"[^\W\d_⺀-鿿가-\ud7af]+|[⺀-鿿가-\ud7af]")
#: Digits of other scripts, which Unicode has in runs of ten.
_OTHER_DIGITS = re.compile("[" + "".join(f"{chr(i)}-{chr(i + 9)}" for i in range(0x80, 0x110000) if unicodedata.decimal(chr(i), None) == 0) + "]")
#: Where those digits are, without Latin, Greek and Cyrillic letters and general punctuation: a class of few ranges is searched for first, being quick.
_OTHER_SCRIPTS = re.compile("[\u0660-\u1dff\u2c00-\U0010ffff]")
_LINK = re.compile(r"\]\([^)]*\)?")
_END = re.compile(r"[.!?]+[\"”’»)]*(?=\s|$)|[。！？]")
_ENDS, _CLOSERS = tuple(".!?。！？"), "\"'”’»)]）」』"
_KIND = re.compile(r"(!\[|#+|\d+[.)]\s|[-*+•›»«|>]|\[)?")
_CRUMB_MARKS = ">/»›→|·"
_CRUMB = re.compile(rf"\s[{_CRUMB_MARKS}]\s")
_HOST = re.compile(r"https?://([^/\s)\]]+)")
_INDEX = re.compile(r"^(index|default|home)?(\.\w+)?$", re.I)
_HEADING = re.compile(r"#{1,6}(?=[ \t])")


class _Known(dict):
    """What ``found`` gives for what stands between spaces, kept up to a bound: it repeats, and a lookup costs less than a search."""

    def __init__(self, found: Callable[[str], object]):
        super().__init__()
        self.found = found

    def __missing__(self, token: str):
        words = self.found(token)
        if len(token) <= 40:
            if len(self) >= 200_000:
                self.clear()
            self[token] = words
        return words


_known_words = _Known(lambda token: tuple(_WORD.findall(token)))
#: Ends of sentences stand where a token ends, or are Chinese marks, so those of a line's tokens add up to the line's.
_known_ends = _Known(lambda token: len(_END.findall(token)))


def words_of(text: str) -> list[str]:
    """Runs of letters, and Chinese characters one by one, in order."""
    return list(chain.from_iterable(map(_known_words.__getitem__, text.split())))


def word_set(text: str) -> set[str]:
    """The distinct words of a text."""
    return set(chain.from_iterable(map(_known_words.__getitem__, set(text.split()))))


@dataclass
class Model:
    """Weights by feature, the words that are common, and the short furniture lines that breadcrumbs are made of."""

    weights: dict[str, float] = field(default_factory=dict)
    common: frozenset[str] = frozenset()
    labels: frozenset[int] = frozenset()


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def site_of(url: str | None, text: str) -> str:
    """The first label of the page's host but for ``www``, or of the host that it links to most; empty if there is none."""
    if url:
        host = urlsplit(url).netloc
    else:
        got = Counter(_HOST.findall(text)).most_common(1)
        host = got[0][0] if got else ""
    labels = [x for x in host.lower().split(".") if x != "www"]
    return labels[0] if labels else ""


def subjects_of(url: str | None, text: str, site: str, common: frozenset[str]) -> tuple[str, ...]:
    """The words, in lower case, that name what the page is about: as its address has it and as its text does.

    The last part of the address's path; and if the text outside of links doesn't have it twice, the uncommon word that
    stands in the most lines, at least two, the first such. A word that one and the same word always follows is part of a name, such as the site's, and
    comes after all others. Each may be missing.
    """
    slug = ""
    if url:
        parts = [p for p in urlsplit(url).path.split("/") if p and not _INDEX.match(p)]
        if parts and len(parts[-1]) >= SLUG_LETTERS:
            slug = parts[-1].lower()
    bare = _LINK.sub("]", text.lower())
    if slug and bare.count(slug) >= 2:
        return (slug,)
    count: Counter[str] = Counter()
    after: dict[str, set[str]] = defaultdict(set)
    for line in bare.split("\n"):
        words = words_of(line)
        here = {w for w in words if len(w) >= SUBJECT_LETTERS and w not in common and w != site}
        count.update(here)
        for w, following in zip(words, words[1:] + [""], strict=False):
            if w in here:
                after[w].add(following)
    rank = {w: (len(after[w]) > 1 or "" in after[w], n) for w, n in count.items() if n >= 2}
    best = max(rank.values(), default=None)
    found = next((w for w, r in rank.items() if r == best), "")
    return tuple(w for w in (found, slug) if w)


def _closed(line: str) -> bool:
    """Whether a stripped line ends like a sentence."""
    return line.rstrip(_CLOSERS).endswith(_ENDS)


def _n_ends(line: str) -> int:
    """How many sentences end in a line; from 3 on it may be less than there are."""
    if not any(map(line.__contains__, _ENDS)):
        return 0
    n = line.count(". ")
    return n if n >= 3 else sum(map(_known_ends.__getitem__, line.split()))


def _has_crumbs(line: str) -> bool:
    return any(map(line.__contains__, _CRUMB_MARKS)) and bool(_CRUMB.search(line))


def _bare(line: str) -> str:
    """A line without the addresses of its links."""
    return _LINK.sub("]", line) if "](" in line else line


def one_digit(text: str) -> str:
    """Runs of digits as one 0. Replacing one character by another is much faster than a search for runs."""
    for d in "123456789":
        text = text.replace(d, "0")
    if not text.isascii():
        try:  # Latin letters and common marks, which are told fastest, have no other digits
            text.encode("cp1252")
        except UnicodeEncodeError:
            if _OTHER_SCRIPTS.search(text):
                text = _OTHER_DIGITS.sub("0", text)
    while "00" in text:
        text = text.replace("00", "0")
    return text


def mask(line: str, site: str, subjects: tuple[str, ...]) -> str:
    """A line in lower case with digits as 0, the site's name as ¤ and the page's subject as §."""
    m = one_digit(line.lower())
    for s in subjects:
        m = m.replace(s, "§")
    return m.replace(site, "¤") if site else m


def masked_lines(text: str, site: str, subjects: tuple[str, ...]) -> list[str]:
    """The stripped lines of a text, masked all at once; blank ones are empty."""
    return [m.strip() for m in mask(text, site, subjects).split("\n")]


def _label(s: str) -> int:
    """Hash of the words of a label; 0 if it has none."""
    words = words_of(_bare(s))
    return _hash(" ".join(words)) if words else 0


def _parts(masked: str) -> list[int]:
    """The labels between the marks of a trail; none if a line isn't one."""
    if masked[:1] == "|" or not _has_crumbs(masked):
        return []
    return [_label(p) for p in _CRUMB.split(masked)]


def is_crumb(masked: str, labels: frozenset[int]) -> bool:
    """Whether a line is a trail of known labels, whatever else stands in it."""
    return any(p in labels for p in _parts(masked))


def _may_be_label(masked: str) -> bool:
    return "§" not in masked and not _closed(masked) and not _has_crumbs(masked)


def _shape(masked: str, common: frozenset[str] | Rare) -> str:
    """A line with single spaces and with * for words that aren't common."""
    masked = " ".join(_bare(masked).split())
    return _WORD.sub(lambda w: w.group(0) if w.group(0) in common else "*", masked)


def _kind_of(masked: str) -> str:
    kind = (_KIND.match(masked).group(0) or "").strip()
    return "0" if kind[:1].isdigit() else kind[:2]


def _marks(masked: str, bare: str, crumb: bool) -> list[str]:
    """What a line has of subjects, sites, links and trails."""
    out = []
    if "§" in bare:
        out.append("subject in crumb" if crumb else "subject")
    elif "§" in masked:
        out.append("subject in link")
    elif "](" in masked:
        out.append("link elsewhere")
    if "¤" in bare:
        out.append("site")
    if crumb:
        out.append("crumb")
    if bare.rstrip(" »]").endswith(("…", "...")):
        out.append("shortened")
    return out


def features(masked: str, labels: frozenset[int]) -> list[str]:
    """What the classifier sees of a masked line."""
    bare = _bare(masked)
    words = words_of(bare)
    kind, crumb, n = _kind_of(masked), is_crumb(masked, labels), min(len(words), 8)
    out = [f"kind {kind}", f"kind {kind} words {n}", f"ends {min(_n_ends(masked), 3)}", f"length {min(len(masked) // 20, 12)}", "closed" if _closed(masked) else "open"]
    out += _marks(masked, bare, crumb)
    if words:
        out += [f"first {words[0]}", f"last {words[-1]}", f"first {' '.join(words[:2])}"]
        out += [f"w {w}" for w in words]
        if "§" in bare and not crumb:
            out += [f"subject first {words[0]}", f"subject last {words[-1]}", f"subject words {n}"]
    return out


def fit(pages: list[tuple[str | None, str | None, str]]) -> Model:
    """A logistic classifier fitted on labels that the pages give themselves, all counts taken from these pages.

    ``pages`` are (file, url, text).
    """
    files: dict[str, set] = defaultdict(set)
    for i, (file, _, text) in enumerate(pages):
        for w in word_set(text.lower()):
            files[w].add(file or i)
    common = frozenset(w for w, f in files.items() if len(f) >= MIN_FILES)
    seen: dict[str, list] = {}
    shapes: dict[str, set] = defaultdict(set)
    for i, (file, url, text) in enumerate(pages):
        site = site_of(url, text)
        for m in filter(None, masked_lines(text, site, subjects_of(url, text, site, common))):
            e = seen.get(m)
            if e is None:
                e = seen[m] = [set(), 0, _shape(m, common)]
            e[0].add(file or i)
            e[1] += 1
            shapes[e[2]].add(file or i)
    labels = frozenset(_label(m) for m, (f, _, _) in seen.items() if len(f) >= MIN_FILES and _may_be_label(m)) - {0}
    return fit_lines({m: (n, len(f), len(shapes[shape])) for m, (f, n, shape) in seen.items()}, common, labels)


def fit_lines(lines: dict[str, tuple[int, int, int]], common: frozenset[str], labels: frozenset[int]) -> Model:
    """Fits on masked lines with their number, the files that they stand in and the files that their shape stands in.

    Furniture are lines, or shapes of lines with uncommon words left out, that stand in several files without their subjects,
    and trails of such lines; body are lines with their page's subject, and prose that stands nowhere else. Other lines are not used.
    """
    rows: list[list[str]] = []
    ys: list[float] = []
    ns: list[float] = []
    for m, (n, files, shape_files) in lines.items():
        if not _WORD.search(_bare(m)):
            continue
        crumb = is_crumb(m, labels)
        if crumb:
            y = 1.0
        elif "§" in m:
            y = 0.0
        elif files >= MIN_FILES or shape_files >= MIN_SHAPE_FILES and not _closed(m):
            y = 1.0
        elif files == 1 and _n_ends(m) >= 2 and len(m) >= 80 and _closed(m):
            y = 0.0
        else:
            continue
        rows.append(features(m, labels))
        ys.append(y)
        ns.append(min(n, 400) ** 0.5)
    if not rows or min(ys) == max(ys):
        return Model({}, common, labels)
    count = Counter(x for r in rows for x in r)
    index = {x: i for i, (x, n) in enumerate(count.most_common(MAX_FEATURES)) if n >= 2}
    weights = _logistic([[index[x] for x in r if x in index] for r in rows], np.array(ys), np.array(ns), len(index))
    return Model({x: float(weights[i]) for x, i in index.items()} | {"": float(weights[-1])}, common, labels)


def _logistic(rows: list[list[int]], y: np.ndarray, n: np.ndarray, size: int, rounds: int = 80, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights and, last, the offset, by adaptive gradient steps; the two classes weigh the same."""
    flat = np.array([i for r in rows for i in r], dtype=np.int64)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n = n * np.where(y > 0, 1 / n[y > 0].sum(), 1 / n[y == 0].sum()) / 2
    w, g2 = np.zeros(size + 1), np.full(size + 1, 1e-8)
    for _ in range(rounds):
        z = np.bincount(at, w[flat], len(rows)) + w[-1]
        r = n * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.append(np.bincount(flat, r[at], size), r.sum()) + decay * w / len(rows)
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
    return w


def min_cut(cost: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """True where a node is furniture in the minimum cut of any graph; ties go to body.

    ``cost`` is what calling a node body costs more than calling it furniture: the capacity to the terminal of its sign. ``w`` are the capacities of the
    edges between nodes ``u`` and ``v``, both ways. Nodes whose terminal edge outweighs all their other edges are on its side of every minimum cut; they are
    labelled at once, for all pages together, and their edges become terminal capacities of their neighbors, until no more are found. A maximum flow
    decides the few that are left.
    """
    n, cost = len(cost), np.array(cost, dtype=float)
    label = np.full(n, -1, dtype=np.int8)
    while True:
        pull = np.bincount(u, w, n) + np.bincount(v, w, n)
        new = (label < 0) & ((cost > pull) | (cost <= -pull))
        if not new.any():
            break
        label[new] = cost[new] > 0
        at_u, at_v = label[u] >= 0, label[v] >= 0
        for here, there, one in ((u, v, at_u & ~at_v), (v, u, at_v & ~at_u)):
            cost += np.bincount(there[one], np.where(label[here[one]] == 1, w[one], -w[one]), n)
        keep = ~(at_u | at_v)
        u, v, w = u[keep], v[keep], w[keep]
    out = label == 1
    left = np.nonzero(label < 0)[0]
    if len(left):
        place = {node: i for i, node in enumerate(left.tolist())}
        edges = [(place[a], place[b], x) for a, b, x in zip(u.tolist(), v.tolist(), w.tolist(), strict=True)]
        out[left[_source_side(cost[left].tolist(), edges)]] = True
    return out


def _source_side(cost: list[float], edges: list[tuple[int, int, float]], least: float = 1e-12) -> list[int]:
    """The nodes on the furniture terminal's side of the minimum cut after a maximum flow in phases of shortest paths."""
    n = len(cost)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((there, back))

    for i, c in enumerate(cost):
        edge(*((s, i) if c > 0 else (i, t)), abs(c), 0.0)
    for a, b, w in edges:
        edge(a, b, w, w)
    while True:
        depth = [-1] * (n + 2)
        depth[s], queue = 0, [s]
        for a in queue:
            for e in out[a]:
                if cap[e] > least and depth[to[e]] < 0:
                    depth[to[e]] = depth[a] + 1
                    queue.append(to[e])
        if depth[t] < 0:
            return [i for i in range(n) if depth[i] >= 0]
        tried = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                full = next(i for i, e in enumerate(path) if cap[e] <= least)
                a = to[path[full] ^ 1]
                del path[full:]
                continue
            while tried[a] < len(out[a]):
                e = out[a][tried[a]]
                if cap[e] > least and depth[to[e]] == depth[a] + 1:
                    break
                tried[a] += 1
            else:
                if not path:
                    break
                a = to[path.pop() ^ 1]
                tried[a] += 1
                continue
            path.append(e)
            a = to[e]


class Edges:
    """Edges between the lines of many pages: ends ``u`` and ``v``, capacity ``w``."""

    def __init__(self) -> None:
        self.u: list[int] = []
        self.v: list[int] = []
        self.w: list[float] = []

    def page(self, lines: list[str], numbers: list[int], base: int = 0) -> None:
        """Adds those of a page's non-blank stripped lines, numbered from ``base``: between neighbors, and between lines near in its structure."""
        above: list[tuple[int, int]] = []  # headings that the line stands under: depth, place
        u, v, w = self.u.append, self.v.append, self.w.append
        kind, first, last = "", base, -2
        for i, (line, no) in enumerate(zip(lines, numbers, strict=True), base):
            c = line[0]
            k = c if c in "|-*•›" else line[:2] if c in "#![" else ""
            apart = no > last + 1
            if i > base:
                u(i - 1), v(i), w(APART if apart else ALIKE if k and k == kind else NEXT)
            if apart or k != kind:
                first = i
            elif k and c != "#" and i > first + 1:
                u(first), v(i), w(ITEM)
            head = _HEADING.match(line) if c == "#" else None
            if head:
                while above and above[-1][0] >= head.end():
                    above.pop()
            if above and above[-1][1] < i - 1 and (apart or head):
                u(above[-1][1]), v(i), w(SECTION)
            if head:
                above.append((head.end(), i))
            kind, last = k, no


class Labeller:
    """Labels pages with a model; keeps the costs of masked lines, up to a bound, since they repeat."""

    def __init__(self, model: Model, known: int = 300_000):
        self.model, self.known, self.costs = model, known, {}
        # Weights by what they are of, so that no feature's name is put together for a lookup.
        get = model.weights.get
        self.word, self.first, self.last = ({x[len(p) :]: w for x, w in model.weights.items() if x.startswith(p)} for p in ("w ", "first ", "last "))
        self.ends = [get(f"ends {i}", 0.0) for i in range(4)]
        self.length = [get(f"length {i}", 0.0) for i in range(13)]
        self.kinds: dict[str, list[float]] = {}
        self.tokens = _Known(lambda token: sum(self.word.get(w, 0.0) for w in _known_words[token]))

    def _kind(self, masked: str) -> list[float]:
        """Weights of a line's kind together with 0 to 8 words."""
        kind = _kind_of(masked)
        got = self.kinds.get(kind)
        if got is None:
            get = self.model.weights.get
            got = self.kinds[kind] = [get(f"kind {kind}", 0.0) + get(f"kind {kind} words {n}", 0.0) for n in range(9)]
        return got

    def cost(self, masked: str, labels: frozenset[int] | None = None) -> float:
        """The sum of the weights of a line's ``features``, within ``MAX_COST``; 0 for a line without words."""
        c = self.costs.get(masked)
        if c is not None:
            return c
        bare = _bare(masked)
        tokens = bare.split()
        words: list[str] = []
        for t in tokens:
            words += _known_words[t]
            if len(words) >= 8:
                break
        if not words:
            c = 0.0
        else:
            get = self.model.weights.get
            n = min(len(words), 8)
            last = next(w[-1] for w in map(_known_words.__getitem__, reversed(tokens)) if w)
            crumb = is_crumb(masked, self.model.labels if labels is None else labels)
            z = get("", 0.0) + self._kind(masked)[n] + self.ends[min(_n_ends(masked), 3)] + self.length[min(len(masked) // 20, 12)]
            z += get("closed" if _closed(masked) else "open", 0.0)
            z += sum(get(x, 0.0) for x in _marks(masked, bare, crumb)) + sum(map(self.tokens.__getitem__, tokens))
            z += self.first.get(words[0], 0.0) + self.first.get(" ".join(words[:2]), 0.0) + self.last.get(last, 0.0)
            if "§" in bare and not crumb:
                z += get(f"subject first {words[0]}", 0.0) + get(f"subject last {last}", 0.0) + get(f"subject words {n}", 0.0)
            c = min(max(z, -MAX_COST), MAX_COST)
        # With labels of the page's own the cost is the page's own too.
        if len(masked) < 200 and labels is None:
            if len(self.costs) >= self.known:
                self.costs.clear()
            self.costs[masked] = c
        return c

    def furniture(self, urls: list[str | None], texts: list[str], about: list[tuple] | None = None) -> list[list[int]]:
        """The numbers of each page's furniture lines; the pages go through the cut together.

        ``about``: the words that are common on each page and the labels it may have, if known.
        """
        costs: list[float] = []
        numbers: list[list[int]] = []
        edges = Edges()
        for url, text, (common, labels) in zip(urls, texts, about or [(self.model.common, None)] * len(urls), strict=True):
            site = site_of(url, text)
            masked = masked_lines(text, site, subjects_of(url, text, site, common))
            here = [no for no, m in enumerate(masked, 1) if m]
            edges.page([x for x in map(str.strip, text.split("\n")) if x], here, len(costs))
            known = self.costs.get
            costs += [self.cost(m, labels) if (c := known(m)) is None else c for m in masked if m]
            numbers.append(here)
        cut = iter(min_cut(np.array(costs), np.array(edges.u, dtype=np.int64), np.array(edges.v, dtype=np.int64), np.array(edges.w)).tolist())
        return [[no for no in here if next(cut)] for here in numbers]


class Rare:
    """The common words of one page, by its words that aren't common."""

    def __init__(self, words: list[str]):
        self.words = frozenset(words)

    def __contains__(self, word: str) -> bool:
        return word not in self.words


class Holders(dict):
    """For each thing the distinct files that hold it, up to ``most``: a summary that is merged by uniting, and exact up to ``most``."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def add(self, things: Iterable, file: int) -> None:
        get, most, one = self.get, self.most, (file,)
        for x in things:
            held = get(x)
            if held is None:
                self[x] = one
            elif len(held) < most and file not in held:
                self[x] = held + one


class Inspector:
    """What is counted of a page's lines; keeps it for masked lines, up to a bound, since they repeat."""

    def __init__(self, known: int = 300_000):
        self.known, self.lines = known, {}
        self.shapes: dict[str, str] = {}

    def shape(self, masked: str, common: frozenset[str] | Rare) -> str:
        """The shape of a line, put together from what stands between spaces, which repeats."""
        if isinstance(common, Rare):
            return _shape(masked, common)
        if len(self.shapes) >= self.known:
            self.shapes.clear()
        out = []
        for token in _bare(masked).split():
            got = self.shapes.get(token)
            if got is None:
                got = _shape(token, common)
                if len(token) <= 40:
                    self.shapes[token] = got
            out.append(got)
        return " ".join(out)

    def line(self, masked: str, common: frozenset[str] | Rare) -> tuple[int, int, int, list[int]] | None:
        """Hashes of the line, of its shape and of the label it may be (0 where it has none), and the labels of its trail. None without words."""
        if masked in self.lines:
            return self.lines[masked]
        got = None
        if _WORD.search(_bare(masked)):
            # What ends like a sentence has no shape and is no label, and most lines are no trails.
            shape = label = 0
            crumbs = _has_crumbs(masked)
            if not _closed(masked):
                shape = _hash(self.shape(masked, common))
                label = _label(masked) if not crumbs and "§" not in masked else 0
            got = _hash(masked), shape, label, _parts(masked) if crumbs else []
        # What is kept of a line depends on the common words, which with ``Rare`` are another set for each page.
        if len(masked) < 200 and not isinstance(common, Rare):
            if len(self.lines) >= self.known:
                self.lines.clear()
            self.lines[masked] = got
        return got

    def page(self, url: str | None, text: str, common: frozenset[str] | Rare) -> tuple[set[tuple[int, int, int]], set[int]]:
        """Distinct (line, shape, label) and distinct labels of trails."""
        site = site_of(url, text)
        found, parts, known = set(), set(), self.lines
        for m in set(masked_lines(text, site, subjects_of(url, text, site, common))):
            got = known[m] if m in known else self.line(m, common) if m else None
            if got:
                found.add(got[:3])
                if got[3]:
                    parts.update(got[3])
        return found, parts - {0}


def _batch(names: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, names.values(), strict=True)], names=list(names))


_LONGS = pa.list_(pa.int64())


def _page_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, w) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in word_set((t or "").lower())]
        yield _batch({"row": pa.int64(), "word": pa.string()}, rows)


def _word_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word``, ``files``: up to ``MIN_FILES`` of the files that hold a word, of each task's pages (``key``, ``text``).

    What stands between spaces is counted first and cut into words once: a word's files are those of all that it stands in.
    """
    held = Holders(MIN_FILES)

    def flush() -> pa.RecordBatch:
        words = Holders(MIN_FILES)
        for token, files in held.items():
            for file in files:
                words.add(_known_words[token], file)
        held.clear()
        return _batch({"word": pa.string(), "files": _LONGS}, list(words.items()))

    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held.add(set(text.lower().split()), key)
            if len(held) >= KNOWN:
                yield flush()
    yield flush()


def _attach(rows: DataFrame, pairs: DataFrame, known: DataFrame, name: str, how: str) -> DataFrame:
    """``rows`` with column ``name``: the values of ``pairs`` (``row``, value) of each row that are in ``known`` or, by ``left_anti``, aren't."""
    value = known.columns[0]
    found = pairs.join(known, value, how).groupBy("row").agg(F.collect_set(value).alias(name))
    return rows.join(found, "row", "left")


def _common_words(rows: DataFrame) -> DataFrame:
    """``word``: those that stand in ``MIN_FILES`` files of all pages. No text is shuffled, only each task's words with at most ``MIN_FILES`` files."""
    files = rows.where("key is not null").select("key", "text").mapInArrow(_word_files, "word string, files array<long>")
    n = files.select("word", F.explode("files").alias("file")).distinct().groupBy("word").agg(F.count("*").alias("n"))
    return stage(n.where(F.col("n") >= MIN_FILES).select("word"), "common-words")


def _commons(b: pa.RecordBatch, common: frozenset[str]) -> list:
    """The common words of each row of a batch: ``common``, or what its column ``rare`` leaves."""
    at = b.schema.get_field_index("rare")
    return [common] * b.num_rows if at < 0 else [Rare(x or []) for x in b.column(at).to_pylist()]


def _line_files(rows: DataFrame, common: Broadcast) -> DataFrame:
    """What all pages hold, a row per task and thing, staged: ``kind`` (line, shape, part or pages), its hash ``h``, for lines their ``shape`` and ``label``, and ``files``.

    Of the files that hold a line there are up to ``MIN_FILES``, of those with a shape up to ``MIN_SHAPE_FILES``; ``pages`` has the number of pages and their characters.
    """
    longs = {"h": pa.int64(), "shape": pa.int64(), "label": pa.int64(), "files": _LONGS}
    names = {"kind": pa.string(), **longs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inspector, lines, shapes, parts, pages, chars = Inspector(), Holders(MIN_FILES), Holders(MIN_SHAPE_FILES), set(), 0, 0

        def flush() -> pa.RecordBatch:
            out = [("line", *x, f) for x, f in lines.items()] + [("shape", x, 0, 0, f) for x, f in shapes.items()] + [("part", x, 0, 0, ()) for x in parts]
            lines.clear()
            shapes.clear()
            parts.clear()
            return _batch(names, out)

        for b in batches:
            for key, url, text, c in zip(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in ("key", "url", "text")), _commons(b, common.value), strict=True):
                found, trail = inspector.page(url, text or "", c)
                parts |= trail
                if key is not None:
                    lines.add(found, key)
                    shapes.add({s for _, s, _ in found if s}, key)
                    pages, chars = pages + 1, chars + len(text)
                if len(lines) + len(shapes) + len(parts) >= KNOWN:
                    yield flush()
        yield flush()
        yield _batch(names, [("pages", pages, chars, 0, ())])

    rows = rows.select("key", "url", "text", *["rare"] * ("rare" in rows.columns)).where("text is not null")
    return stage(rows.mapInArrow(run, "kind string, h long, shape long, label long, files array<long>"), "line-files")


def _sample_lines(rows: DataFrame, common: Broadcast) -> DataFrame:
    """``masked``, ``h``, ``shape``, ``parts``, ``n``: the masked lines of some pages and how often they have them."""
    names = {"masked": pa.string(), "h": pa.int64(), "shape": pa.int64(), "parts": _LONGS, "n": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inspector = Inspector()
        for b in batches:
            count: dict[tuple, int] = Counter()
            for url, text, c in zip(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in ("url", "text")), _commons(b, common.value), strict=True):
                site = site_of(url, text)
                for m in filter(None, masked_lines(text, site, subjects_of(url, text, site, c))):
                    if got := inspector.line(m, c):
                        count[m, got[0], got[1], tuple(got[3])] += 1
            yield _batch(names, [(*x, n) for x, n in count.items()])

    rows = rows.select("url", "text", *["rare"] * ("rare" in rows.columns))
    each = rows.mapInArrow(run, "masked string, h long, shape long, parts array<long>, n long")
    return stage(each.groupBy("masked", "h", "shape", "parts").agg(F.sum("n").alias("n")), "sample")


@dataclass
class Prepared:
    """Pages (``page_id``, ``url``, ``text``; ``rare`` and ``labels`` where they are joined) and what labels them."""

    pages: DataFrame
    model: Model
    shared: Broadcast


def prepare(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, known: int = KNOWN) -> Prepared:
    """The model of the pages.

    The files that words, lines and shapes of lines stand in are counted over all pages. The weights are fitted on the lines of about
    ``sample_pages`` captures (of about ``SAMPLE_CHARS`` characters together, none longer than ``PAGE_CHARS``), chosen by a hash of their ids, twice as many at most, with the labels that those counts give
    them. Of more than ``known`` common words or labels of trails each page gets its own by a join, in columns ``rare`` and ``labels``; the model then has none.
    """
    sc = pages.sparkSession.sparkContext
    file = F.when(F.col("file") != "", F.xxhash64("file")).otherwise(F.xxhash64("page_id", F.lit("")))
    rows = pages.select("page_id", "file", "url", "text").withColumn("key", F.when(F.col("page_id").isNotNull() & F.col("text").isNotNull(), file)).drop("file")
    words = _common_words(rows)
    if within(words, known):
        common = frozenset(r.word for r in words.collect())
    else:
        common = frozenset()
        rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "pages")
        rows = stage(_attach(rows, rows.select("row", "text").mapInArrow(_page_words, "row long, word string"), words, "rare", "left_anti"), "pages-words")
    shared = sc.broadcast(common)

    held = _line_files(rows, shared)
    each = held.select("kind", "h", "shape", "label", F.explode("files").alias("file"))
    lines = stage(each.where("kind = 'line'").drop("kind").distinct().groupBy("h", "shape", "label").agg(F.count("*").alias("files")), "lines")
    shapes = each.where("kind = 'shape'").select(F.col("h").alias("shape"), "file").distinct().groupBy("shape").agg(F.count("*").alias("shape_files"))
    in_trails = held.where("kind = 'part'").select(F.col("h").alias("label")).distinct()
    labels = stage(lines.where((F.col("files") >= MIN_FILES) & (F.col("label") != 0)).select("label").distinct().join(in_trails, "label", "left_semi"), "labels")
    if everywhere := within(labels, known):
        fixed = frozenset(r.label for r in labels.collect())
    else:
        fixed = frozenset()
        if "row" not in rows.columns:
            rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "pages")
        rows = stage(_attach(rows, _row_parts(rows, shared), labels, "labels", "left_semi"), "pages-labels")

    total, chars = held.where("kind = 'pages'").agg(F.sum("h"), F.sum("shape")).first()
    share = min(1.0, sample_pages / max(total or 0, 1), SAMPLE_CHARS / max(chars or 0, 1))
    few = F.pmod(F.xxhash64("page_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    picked = _sample_lines(rows.where(F.col("key").isNotNull() & few & (F.length("text") <= PAGE_CHARS)).limit(2 * sample_pages).repartition(sc.defaultParallelism), shared)
    mine = picked.join(lines.select("h", "files"), "h").join(shapes, "shape", "left").select("masked", "n", "files", F.coalesce("shape_files", F.lit(0)).alias("shape_files"))
    counts = {r.masked: (r.n, r.files, r.shape_files) for r in mine.collect()}
    if not everywhere:
        fitting = frozenset(r.label for r in labels.join(picked.select(F.explode("parts").alias("label")).distinct(), "label", "left_semi").collect())
    model = Model(fit_lines(counts, common, fixed if everywhere else fitting).weights, common, fixed)
    return Prepared(rows, model, sc.broadcast(model))


def _row_parts(rows: DataFrame, common: Broadcast) -> DataFrame:
    """``row``, ``label``: the labels of each row's trails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inspector = Inspector()
        for b in batches:
            got = []
            for row, url, text, c in zip(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in ("row", "url", "text")), _commons(b, common.value), strict=True):
                got += [(row, p) for p in inspector.page(url, text or "", c)[1]]
            yield _batch({"row": pa.int64(), "label": pa.int64()}, got)

    return rows.select("row", "url", "text", *["rare"] * ("rare" in rows.columns)).mapInArrow(run, "row long, label long")


def fit_on(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Model:
    """The model of ``prepare``."""
    return prepare(pages, sample_pages).model


def _labelled(pages: DataFrame, model: Model | None, known: int = KNOWN) -> tuple[DataFrame, Broadcast]:
    """The rows to label and the model, broadcast."""
    if model:
        return pages.select("page_id", "url", "text"), pages.sparkSession.sparkContext.broadcast(model)
    done = prepare(pages, known=known)
    return done.pages.select("page_id", "url", "text", *[c for c in ("rare", "labels") if c in done.pages.columns]), done.shared


def _about(b: pa.RecordBatch, model: Model) -> list[tuple] | None:
    if b.num_columns == 3:
        return None
    at = b.schema.get_field_index("labels")
    labels = [None] * b.num_rows if at < 0 else [frozenset(x or []) for x in b.column(at).to_pylist()]
    return list(zip(_commons(b, model.common), labels, strict=True))


def furniture_lines(pages: DataFrame, model: Model | None = None, known: int = KNOWN) -> DataFrame:
    """``page_id`` and ``lines``, the numbers of the non-blank lines that are not main body, for each row with id and text.

    Lines are what stands between line feeds, numbered from 1. Blank texts have no lines. Input: ``page_id``, ``file``, ``url``, ``text``.
    """
    rows, shared = _labelled(pages, model, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for b in batches:
            lines = labeller.furniture(b.column(1).to_pylist(), b.column(2).to_pylist(), _about(b, shared.value))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lines, pa.list_(pa.int32()))], names=["page_id", "lines"])

    return rows.where("page_id is not null and text is not null").mapInArrow(run, "page_id long, lines array<int>")


def main_bodies(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``page_id`` and ``main_text``, one row per row of ``pages``: its text without furniture, with at most one blank line in a row.

    Null texts stay null; a page of furniture alone has an empty main text.
    """
    rows, shared = _labelled(pages, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for b in batches:
            texts = b.column(2).to_pylist()
            drop = labeller.furniture(b.column(1).to_pylist(), [t or "" for t in texts], _about(b, shared.value))
            out = []
            for t, d in zip(texts, drop, strict=True):
                gone = set(d)
                kept = None if t is None else "\n".join("" if no in gone else x.rstrip("\r") for no, x in enumerate(t.split("\n"), 1))
                out.append(None if kept is None else re.sub(r"\n\s*\n\s*", "\n\n", kept).strip())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["page_id", "main_text"])

    return rows.mapInArrow(run, "page_id long, main_text string")


def not_main_body(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Distinct (``page_id``, ``line_no``) of the furniture lines."""
    return furniture_lines(pages, model).distinct().select("page_id", F.explode("lines").alias("line_no")).distinct()
