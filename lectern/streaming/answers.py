"""Questions that arrive as a stream, answered batch by batch. An extension of the batch pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lectern.config import Settings
from lectern.operators.answer import Generator, answer
from lectern.operators.index import Index
from lectern.plans.staging import released


def answer_stream(questions: DataFrame, index: Index, out: str, checkpoint: str, settings: Settings | None = None, generator: Generator | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that appends the responses to a stream of questions (``qid``, ``question``) to Parquet in ``out``.

    Each batch is written under its own number and overwrites what an attempt before a failure left, so a question is answered once.
    """

    def run(batch: DataFrame, number: int) -> None:
        with released():
            answer(index, batch, settings, generator).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return questions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
