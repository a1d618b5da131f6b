"""Messages from a stream of chat activities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.chat import message_events
from ..sources.schemas import ACTIVITY


def message_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Messages of the activity files arriving in ``path``. Stateless, so lateness does not matter."""
    reader = spark.readStream.schema(ACTIVITY)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return message_events(reader.json(path))


def write_available(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Processes what has arrived and stops; a rerun on the same checkpoint takes up only new files."""
    return (stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start(out))
