"""Single questions from an argument list or a prompt, answered by the batch pipeline."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession

from lectern.config import Settings
from lectern.operators.answer import Generator, answer, as_lines
from lectern.operators.index import Index


def ask(spark: SparkSession, index: Index, question: str, settings: Settings | None = None, generator: Generator | None = None) -> str:
    """The printed response to one question; an empty one is unsupported here as a blank one is."""
    rows = spark.createDataFrame([(0, question or " ")], "qid long, question string")
    return as_lines(answer(index, rows, settings, generator)).first().shown


def run(spark: SparkSession, index: Index, argv: list[str], settings: Settings | None = None, lines: Iterable[str] | None = None, say: Callable[[str], object] = print) -> None:
    """Answers the words of ``argv`` as one question, or each non-blank line of ``lines`` (standard input) until it ends or is interrupted."""
    if argv:
        say(ask(spark, index, " ".join(argv), settings))
        return
    try:
        for line in sys.stdin if lines is None else lines:
            if line.strip():
                say(ask(spark, index, line.strip(), settings))
    except KeyboardInterrupt:
        pass
