"""Current state kept up to date from a stream of events.

The state of a statement is a pair of maxima, so late, repeated and reordered
batches give the same result and no watermark is needed for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import _LIVE, marks
from ..sources.quads import latest, write_versioned


def merge(state: DataFrame | None, events: DataFrame, keys: list[str]) -> DataFrame:
    fresh = marks(events, keys)
    if state is None:
        return fresh
    return state.unionByName(fresh).groupBy(keys).agg(F.max("asserted").alias("asserted"), F.max("retracted").alias("retracted"))


def maintain(stream: DataFrame, root: str, checkpoint: str, keys: list[str]):
    """Starts a query that keeps (keys, asserted, retracted) below ``root``, a version for each batch."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        write_versioned(merge(latest(spark, root), batch, keys), root, f"{number:012d}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, root: str, keys: list[str]) -> DataFrame | None:
    state = latest(spark, root)
    return None if state is None else state.where(_LIVE).select(keys)


def activity(stream: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each type in tumbling windows; what comes later than ``late`` is dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
