"""Incremental ingestion: micro-batches merged into snapshots, and live previews.

The ledger path uses no watermark: a late or revised record of any age is merged, none is dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import state
from ..plans.store import SnapshotStore


def merge_stream(rows: DataFrame, store: SnapshotStore, ledger: str, checkpoint: str, *, name: str, source: str | None = None, on_batch: Callable[[int, dict[str, int]], None] | None = None):
    """Start a query that merges each micro-batch under an audited run of its own.

    ``name`` stays with the stream across restarts.  The number of a batch is recorded in the commit that applies it, so a batch
    that is made again after a crash changes nothing, gets the counts it had, and replaces its own run.  Old versions go as the
    stream moves on.
    """

    def apply(batch: DataFrame, number: int) -> None:
        with state.Run(store, source or name, id=f"{name}-{number:08d}") as run:
            run.merge({ledger: batch}, batch=(name, number))
        if on_batch:
            on_batch(number, run.counts)

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_sessions(rows: DataFrame, keys: list[str], time: str, gap: str, lateness: str) -> DataFrame:
    """Session preview of a stream; rows later than ``lateness`` are left to the batch path."""
    return rows.withWatermark(time, lateness).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.min(time).alias("started_at"), F.max(time).alias("ended_at"), F.count(F.lit(1)).alias("reading_count")).drop("w")


def live_windows(rows: DataFrame, keys: list[str], time: str, length: str, slide: str | None, lateness: str, *aggregates) -> DataFrame:
    """Tumbling (or sliding) window preview of a stream."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return rows.withWatermark(time, lateness).groupBy(*keys, window.alias("w")).agg(*aggregates).withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end")}).drop("w")
