"""Exact token counts under an existing byte-level BPE vocabulary, inside Python workers.

The split pattern of the vocabulary never joins a non-space character to a space after it, so a text
without two spaces in a row can be cut before every space and the pieces counted one by one; a
piece's count depends on the piece alone. Words repeat, so counts of short pieces are kept in a table of
bounded size and most of a text never reaches the encoder. The sum equals encoding the whole text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import SparkSession

#: Folder and file of the vocabulary; both are parameters of every operator that counts tokens.
TOKENIZERS = os.environ.get("LECTERN_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

# Fixed value: the split pattern that belongs to this family of public vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Longest piece and most pieces that the table of known counts holds.
KNOWN_LENGTH, KNOWN_PIECES = 32, 500_000


class Counter(dict):
    """Token counts of pieces; a missing piece is encoded and, if short, remembered."""

    def __init__(self, folder: str, vocabulary: str):
        super().__init__()
        import tiktoken

        shipped = SparkFiles.get(vocabulary) if SparkFiles._root_directory else ""
        with open(shipped if os.path.exists(shipped) else os.path.join(folder, vocabulary), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(" " + piece))
        if len(piece) <= KNOWN_LENGTH:
            if len(self) >= KNOWN_PIECES:
                self.clear()
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        if "  " in text:
            return len(self.encode(text))
        first, *rest = text.split(" ")
        if not rest:
            return len(self.encode(text))
        return len(self.encode(first)) + sum(map(self.__getitem__, rest))


_counters: dict[tuple[str, str], Counter] = {}


def counter(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Counter:
    """The worker's counter for a vocabulary, made on first use."""
    key = (folder, vocabulary)
    if key not in _counters:
        _counters[key] = Counter(folder, vocabulary)
    return _counters[key]


_shipped: set[tuple[str, str]] = set()


def ship_vocabulary(spark: SparkSession, folder: str, vocabulary: str) -> None:
    """Sends the vocabulary's file from the driver's ``folder`` to the workers of a session, once, so that no other machine needs the folder."""
    key = (spark.sparkContext.applicationId, vocabulary)
    if key not in _shipped:
        spark.sparkContext.addFile(os.path.join(folder, vocabulary))
        _shipped.add(key)


def count_column(spark: SparkSession, name: str, out: str, folder: str, vocabulary: str, skip: str | None = None):
    """A function for ``mapInArrow``: replaces string column ``name`` by its token count ``out`` (0 for null).

    With ``skip`` the count is null where that boolean column is true, and the column is replaced by the text where it is and by null elsewhere.
    """
    ship_vocabulary(spark, folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(folder, vocabulary).count
        for b in batches:
            at = b.schema.get_field_index(name)
            texts = b.column(at).to_pylist()
            later = b.column(b.schema.get_field_index(skip)).to_pylist() if skip else [False] * len(texts)
            made = {at: pa.array([None if s else count(t) if t else 0 for t, s in zip(texts, later, strict=True)], pa.int64())}
            if skip:
                made[b.schema.get_field_index(skip)] = pa.array([t if s else None for t, s in zip(texts, later, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([made.get(i, c) for i, c in enumerate(b.columns)], names=[out if i == at else f for i, f in enumerate(b.schema.names)])

    return run


__all__ = ["Counter", "count_column", "counter"]
