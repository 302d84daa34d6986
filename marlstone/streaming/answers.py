"""Questions that come as a stream, answered block by block into a sink that loses and doubles none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from marlstone.sources.blocks import BlockSink


def answering(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], sink: BlockSink, checkpoint: str) -> StreamingQuery:
    """Starts answering what a stream holds by now, and ends. A micro-batch is a block with its number.

    Spark repeats a batch that isn't in the checkpoint with the same rows and number. If it died before its block was whole,
    nothing of it can be read and it is made anew; if it died after, the block stays as it is and the batch is passed by. A sink
    belongs to one checkpoint."""

    def block(rows: DataFrame, number: int) -> None:
        if number not in sink.blocks():
            sink.write(answer(rows), number)

    return questions.writeStream.foreachBatch(block).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
