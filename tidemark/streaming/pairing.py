"""Pairs of two kinds of records in a stream, with the halves that found no partner.

Records of equal keys and of two kinds (such as the two values of a pressure) belong together: the first of one kind with the first
of the other, the second with the second, by their position.  State is kept for each key: its halves, and one timer.  Halves wait
until the timer of their key ends, however they came, and are then paired in the order of their positions, so the result is that
of the batch (``operators.pairing``) over the same records in any order of arrival.  What is left over is not lost: it comes out
as a reject with its reason.  There is no watermark, so a late half is never dropped; one that comes after its key was closed
waits anew, and is paired or rejected in its turn.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from ..operators.pairing import REASON

#: The state store that keyed state with timers needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Pairing(StatefulProcessor):
    def __init__(self, keys: list[str], kind: str, value: str, place: str, first: str, second: str, wait_ms: int, state: StructType):
        self.keys, self.kind, self.value, self.place = keys, kind, value, place
        self.kinds, self.wait_ms, self.schema = (first, second), wait_ms, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.halves = handle.getListState("halves", self.schema)
        self.closing = handle.getValueState("closing", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        for batch in rows:
            for half in batch[[self.kind, self.value, self.place]].itertuples(index=False):
                self.halves.appendValue(tuple(None if pd.isna(v) else v for v in half))
        if not self.closing.exists():
            at = timerValues.getCurrentProcessingTimeInMs() + self.wait_ms
            self.closing.update((at,))
            self.handle.registerTimer(at)
        yield pd.DataFrame({k: pd.Series(dtype=object) for k in [*self.keys, *self.kinds, self.place, "reason"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        of = {k: [] for k in self.kinds}
        for kind, value, place in self.halves.get():
            of[kind].append((place, value))
        self.halves.clear()
        self.closing.clear()
        a, b = (sorted(of[k], key=lambda h: (h[0] is not None, h[0])) for k in self.kinds)
        rows = []
        for i in range(max(len(a), len(b))):
            x, y = a[i] if i < len(a) else None, b[i] if i < len(b) else None
            rows.append((*key, x and x[1], y and y[1], max(h[0] for h in (x, y) if h), None if x and y else REASON))
        yield pd.DataFrame(rows, columns=[*self.keys, *self.kinds, self.place, "reason"])


def live_pairs(rows: DataFrame, keys: list[str], kind: str, value: str, place: str, first: str, second: str, *, wait_seconds: float) -> DataFrame:
    """(keys, first, second, place, reason): pairs with a null reason, and halves that no partner came to within ``wait_seconds``
    of the first of their key.  ``place`` is any column that orders the halves of a key; a pair has the later of its two."""
    spark = rows.sparkSession
    spark.conf.set(*PROVIDER)
    field = {f.name: f for f in rows.schema}
    state = StructType([StructField(n, field[n].dataType) for n in (kind, value, place)])
    out = StructType([*[StructField(k, field[k].dataType) for k in keys], StructField(first, field[value].dataType), StructField(second, field[value].dataType), StructField(place, field[place].dataType), *StructType.fromDDL("reason string").fields])
    processor = Pairing(keys, kind, value, place, first, second, int(wait_seconds * 1000), state)
    return rows.where(rows[kind].isin(first, second)).groupBy(*keys).transformWithStateInPandas(processor, out, "append", "processingTime")
