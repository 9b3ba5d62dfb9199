"""An event log as a stream: numbering, a ring, and subscribers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RING = 256


def publish(events: DataFrame, path: str, checkpoint: str, trigger: str = "1 second") -> StreamingQuery:
    """Append a stream of events to a Parquet log, each micro-batch once."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()


def subscribe(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, kinds: list[str] | None = None) -> StreamingQuery:
    """Call ``handle`` with every micro-batch of the wished kinds; a handler that raises is noted and doesn't stop the stream."""
    wanted = events if kinds is None else events.filter(F.col("event").isin(*kinds))

    def guarded(batch: DataFrame, number: int) -> None:
        try:
            handle(batch, number)
        except Exception as e:  # noqa: BLE001 - a subscriber must not end the bus
            print(f"subscriber failed on batch {number}: {e}")

    return wanted.writeStream.foreachBatch(guarded).option("checkpointLocation", checkpoint).start()


def windowed(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events a kind and time window, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event").count()
