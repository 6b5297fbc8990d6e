"""An extension: queries that arrive as a stream, matched against canonical records that stand still."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.blocking import block
from ..operators.decide import assign


def match_stream(arriving: DataFrame, s1: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, threshold: float = 0.5, k: int = 3) -> StreamingQuery:
    """Block, score and assign each micro-batch of normalised queries; results go to Parquet, one folder for each batch.

    A batch that is run again after a failure replaces its own folder.
    """

    def one(batch: DataFrame, number: int) -> None:
        assign(score(block(s1, batch, k)), threshold).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
