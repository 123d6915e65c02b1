"""A fitted preparation is a stateless projection, so it also runs on streams; nothing is ever fitted on one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cohortloom.operators.prepare import Preparation


def prepare_stream(preparation: Preparation, stream: DataFrame, to: str, checkpoint: str, keep: list[str] = []) -> StreamingQuery:  # noqa: B006
    """Transform a streaming frame and append it as Parquet, exactly once by the checkpoint."""
    out = preparation.transform(stream, keep)
    return out.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
