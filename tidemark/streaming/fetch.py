"""Syncs as streams: every micro-batch is a window of an API, fetched by tasks, merged once."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame

from ..plans import rebuild, state
from ..plans.store import SnapshotStore
from ..sources.paged_api import PagedApi


def sync_stream(store: SnapshotStore, raw_root: str, source: str, base_url: str, checkpoint: str, *, zone: str, headers: dict[str, str] | None = None, now: datetime | None = None, **options: str) -> list:
    """Runs queries for each collection of an API, and returns them; they end when the present window is merged.

    The window of a batch is in the checkpoint, and its number in the commit of the merge: after a crash the same window is
    fetched again, and what was merged is not merged twice.  A refused page fails the query, with its pages kept raw.
    """
    spark = store.spark
    spark.dataSource.register(PagedApi)
    state.ensure_source(store, source, "api")
    until = (now or datetime.now(UTC)).isoformat()
    started = []
    for e in rebuild.CONNECTORS[source]:
        asked = rebuild.fetch_options(e, source, base_url, raw_root, headers) | options | {"now": until}
        name = f"sync-{source}-{e.path.replace('/', '-')}"

        def apply(batch: DataFrame, number: int, e=e, name=name) -> None:
            fetched = batch.select("raw_path", "http_status").collect()  # a path a page
            with state.Run(store, source, id=f"{name}-{number:08d}") as run:
                rebuild.merge_fetched(run, raw_root, source, e.path, fetched, zone, (name, number))

        pages = spark.readStream.format("paged_api").options(**asked).load()
        while True:  # a window that was left unfinished is a batch by itself, and comes first
            query = pages.writeStream.foreachBatch(apply).option("checkpointLocation", f"{checkpoint.rstrip('/')}/{name}").trigger(availableNow=True).start()
            query.awaitTermination()  # one after the other: their runs share a table
            started.append(query)
            if not query.lastProgress or until in str(query.lastProgress["sources"][0]["endOffset"]):
                break
    return started
