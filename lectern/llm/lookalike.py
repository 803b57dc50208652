"""Problem 8: texts that look the same and differ in their characters."""

from __future__ import annotations

import re
import unicodedata as U
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.staging import broadcast_within, stage

# Common letters of other scripts, and the Latin letters they look like. They go before the public table, in which I, l and 1 are one.
_OTHER = "АВЕЅІЈКМНОРСТУХҮԌԚԜ" "аеорсухѕіјһԁԛԝӏүѵ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϜϹ" "αγινορυϲϳ" "օոսցհՕՍՏ" "ꓐꓑꓓꓔꓖꓗꓙꓚꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴꓜ"
_LATIN = "ABESIJKMHOPCTYXYGQW" "aeopcyxsijhdqwlyv" "ABEZHIKMNOPTYXFC" "ayivopucj" "onughOUS" "BPDTGKJCFMNLSRVHWXYAEIOUZ"
LOOK_ALIKE = dict(zip(_OTHER, _LATIN, strict=True)) | {"ɑ": "a", "ɡ": "g", "ı": "i"}

# Hyphens, and invisible characters that Unicode doesn't class as format characters.
HYPHENS = "‐‑⁃−﹣－"
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d⠀\u3164\uffa0"
# Format characters that are drawn.
DRAWN = "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2"
#: Compatibility forms that read as another thing: raised and lowered, encircled, fractions.
KEPT_FORMS = ("<super>", "<sub>", "<circle>", "<fraction>")


#: Copies of a text that one task joins to the texts that look like it.
SALT_ROWS = 20_000
#: Most distinct texts of mixed classes that are broadcast.
BROADCAST_ROWS = 200_000

_NOT_ASCII = re.compile("[^\x00-\x7f]")
_IDEOGRAPHS = ("CJK", "HANGUL SYLLABLE", "TANGUT", "NUSHU", "EGYPTIAN", "ANATOLIAN", "CUNEIFORM")


def public_table(spark: SparkSession) -> dict[str, str]:
    """The single letters of Unicode's table of confusable characters, of all scripts but ideographs and syllable blocks, and what they look like.

    Read from the copy that comes with Spark, by asking for the prototype of every letter. Prototypes that aren't one other letter are left out, as are digits and
    punctuation, which make a difference here. The table takes I, l, 1 and | for one; here a capital letter that looks like them is an I.
    """
    known = _tables.get(spark.sparkContext.applicationId)
    if known is None:
        letters = [ch for ch in map(chr, range(0x80, 0x110000)) if U.category(ch) in ("Lu", "Ll", "Lt", "Lo", "Lm") and not U.decomposition(ch) and not U.name(ch, "CJK").startswith(_IDEOGRAPHS)]
        checker = getattr(spark.sparkContext._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
        found = dict(zip(letters, checker.getSkeleton("\n".join(letters)).split("\n"), strict=True))
        table = {a: "I" if b == "l" and U.category(a) == "Lu" else b for a, b in found.items() if a.lower() != b.lower() and len(b) == 1 and U.category(b)[0] == "L"} | LOOK_ALIKE
        for a in table:
            while table[a] in table:
                table[a] = table[table[a]]
        known = _tables[spark.sparkContext.applicationId] = table
    return known


_tables: dict[str, dict[str, str]] = {}


class Skeletons:
    """The consistent forms of texts by a table of look-alike letters."""

    def __init__(self, table: dict[str, str]):
        self.table = table
        self.known: dict[str, str] = {}

    def prototype(self, ch: str) -> str:
        """What a character is replaced by: its prototype, nothing if it is invisible, or itself."""
        got = self.known.get(ch)
        if got is None:
            got = self.known[ch] = self._prototype(ch)
        return got

    def _prototype(self, ch: str) -> str:
        if ch in "\n\r":
            return ch
        if ch in self.table:
            return self.table[ch]
        if ch in HYPHENS:
            return "-"
        cat = U.category(ch)
        if ch in INVISIBLE or "\ufe00" <= ch <= "\ufe0f" or "\U000e0100" <= ch <= "\U000e01ef" or cat == "Cf" and ch not in DRAWN:
            return ""
        if cat == "Zs" or ch == "\t":
            return " "
        if cat in ("Zl", "Zp") or ch == "\x85":
            return "\n"
        form = U.decomposition(ch)
        if form.startswith("<"):
            kind, *codes = form.split()
            to = "".join(chr(int(c, 16)) for c in codes)
            if kind in KEPT_FORMS or "." in to or to[0] == " " or any(U.category(c) == "Nd" for c in to) and kind == "<compat>":
                return ch
            return "".join(map(self.prototype, U.normalize("NFD", to)))
        return ch

    def __call__(self, text: str) -> str:
        """The consistent form of a text: decomposed, each character replaced by its prototype, decomposed again.

        Equal for texts that differ in width, composition, joined letter forms, invisible characters, kind of space or
        hyphen, or look-alike letters of other scripts. Case, digits, raised digits, punctuation, accents and words stay. Applied twice it changes nothing more.
        """
        if text.isascii() and "\t" not in text and "\r" not in text:
            return text
        out = U.normalize("NFD", text)
        for ch in {*_NOT_ASCII.findall(out), *("\t" if "\t" in out else "")}:
            to = self.prototype(ch)
            if to != ch:
                out = out.replace(ch, to)
        return U.normalize("NFD", out.replace("\r\n", "\n").replace("\r", "\n"))


def _hashes(texts: list[str | None], skeleton: Skeletons) -> list[pa.Array]:
    """Two halves of a 128-bit hash each of the text and of its skeleton."""
    cols: list[list[int | None]] = [[], [], [], []]
    for t in texts:
        got = [None] * 4 if t is None else [x for s in (t, skeleton(t)) for x in _halves(s)]
        for c, x in zip(cols, got, strict=True):
            c.append(x)
    return [pa.array(c, pa.int64()) for c in cols]


def _halves(s: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(s.encode("utf-8", "surrogatepass"))
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def _run(table: Broadcast, with_form: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skeleton = Skeletons(table.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            if with_form:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if t is None else skeleton(t) for t in texts], pa.string())], names=["doc_id", "form"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), *_hashes(texts, skeleton)], names=["doc_id", "t1", "t2", "s1", "s2"])

    return run


def _shared(documents: DataFrame, table: dict[str, str] | None) -> Broadcast:
    spark = documents.sparkSession
    return spark.sparkContext.broadcast(public_table(spark) if table is None else table)


def consistent_forms(documents: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    """``doc_id`` and ``form``, the consistent form of each text by a ``table`` of look-alike letters (``public_table``); null texts have a null form."""
    return documents.select("doc_id", "text").mapInArrow(_run(_shared(documents, table), True), "doc_id long, form string")


def fingerprints(documents: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    """``doc_id`` with 128-bit hashes of its text (``t1``, ``t2``) and of its skeleton (``s1``, ``s2``), staged; null texts are left out."""
    rows = documents.where("text is not null and doc_id is not null").select("doc_id", "text")
    return stage(rows.mapInArrow(_run(_shared(documents, table), False), "doc_id long, t1 long, t2 long, s1 long, s2 long"), "fingerprints")


def look_alike_classes(documents: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    """One row per document that looks like another with other characters: ``doc_id``, ``class_id`` (the least id of its class),
    ``text_id`` (the least id with equal text), ``n_texts`` and ``n_docs`` of the class. A repeated id whose rows disagree counts with one of them."""
    return _classes(fingerprints(documents, table).dropDuplicates(["doc_id"])).select("doc_id", "class_id", "text_id", "n_texts", "n_docs")


def _classes(prints: DataFrame) -> DataFrame:
    """Members of classes of several texts; ``n`` is how many have their text. Copies are counted before they are shuffled, so no text is hot."""
    texts = stage(prints.groupBy("s1", "s2", "t1", "t2").agg(F.min("doc_id").alias("text_id"), F.count("*").alias("n")), "texts")
    mixed = texts.groupBy("s1", "s2").agg(F.min("text_id").alias("class_id"), F.count("*").alias("n_texts"), F.sum("n").alias("n_docs")).where("n_texts > 1")
    named = broadcast_within(stage(texts.join(mixed, ["s1", "s2"]), "mixed-texts"), BROADCAST_ROWS)
    return prints.join(named, ["s1", "s2", "t1", "t2"])


def look_alike_pairs(documents: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    """Distinct (``doc_id_a``, ``doc_id_b``), a < b, of documents whose texts differ and have equal skeletons.

    Copies of one text are one member of a class, so equal texts form no pairs and only the texts of a class are joined to each other. Each pair of
    texts is then spread over its documents: copies of a text are cut into parts of ``SALT_ROWS``, and a task joins one part of each side, so no text is a hot key. The result has as
    many rows as there are pairs; ``look_alike_classes`` says the same in one row per document.
    """
    members = stage(_classes(fingerprints(documents, table).distinct()).select("doc_id", "class_id", "text_id", F.ceil(F.col("n") / SALT_ROWS).alias("parts")), "members")
    texts = members.select("class_id", "text_id", "parts").distinct()
    a, b = (texts.select("class_id", F.col("text_id").alias(f"t{x}"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias(f"p{x}")) for x in "ab")
    links = a.join(b, "class_id").where("ta < tb").drop("class_id")
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    left, right = (members.select(F.col("text_id").alias(f"t{x}"), part.alias(f"p{x}"), F.col("doc_id").alias(f"d{x}")) for x in "ab")
    both = links.join(left, ["ta", "pa"]).join(right, ["tb", "pb"]).where("da <> db")
    return both.select(F.least("da", "db").alias("doc_id_a"), F.greatest("da", "db").alias("doc_id_b")).distinct()
