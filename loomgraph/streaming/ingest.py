"""Structured Streaming extensions: triples without repetitions, windowed counts, and fusion per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_triples(stream: DataFrame, time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Each (s, p, o) once within the watermark, so state is bounded by the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["s", "p", "o"])


def windowed_counts(stream: DataFrame, time: str, key: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    w = stream.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), key, "n")


def fuse_stream(stream: DataFrame, read_graph: Callable[[], DataFrame], fuse: Callable[[DataFrame, DataFrame], DataFrame], write_graph: Callable[[DataFrame, int], None], checkpoint: str):
    """Every micro-batch fused into the current graph. `write_graph` gets the batch number, so that a repeated batch overwrites itself."""

    def step(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            write_graph(fuse(batch, read_graph()), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
