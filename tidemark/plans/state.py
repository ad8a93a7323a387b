"""State around imports, kept in the store: sources, devices, runs, sync windows, duplicate links, priorities."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import scalar
from ..operators import merge
from . import duplicates
from .store import SnapshotStore

SOURCE_TYPES = ("api", "import", "manual")


def ensure_source(store: SnapshotStore, name: str, kind: str = "import") -> str:
    """The id of a source, which is entered if it is new."""
    if kind not in SOURCE_TYPES:
        raise ValueError(f"one of {SOURCE_TYPES}")
    given = store.spark.createDataFrame([(name, kind)], "name string, source_type string").withColumns({"source_id": scalar.identity(F.lit("source"), F.col("name")), "enabled": F.lit(True), "created_at": F.current_timestamp()})
    stored = store.read("sources")
    new = merge.insert_missing(stored, schemas.conform(given, schemas.SOURCES), ["name"])
    if not new.isEmpty():
        store.upsert("sources", new)
    return store.read("sources").where(F.col("name") == name).first()["source_id"]


def enable_source(store: SnapshotStore, name: str, enabled: bool) -> None:
    """A disabled source stays stored, and no view reads it."""
    ensure_source(store, name)
    store.replace("sources", store.read("sources").withColumn("enabled", F.when(F.col("name") == name, F.lit(enabled)).otherwise(F.col("enabled"))))


def ensure_devices(store: SnapshotStore, rows: DataFrame) -> None:
    """Enters the devices that ledger rows name and the store does not know, one for each source and vendor's id."""
    seen = rows.where("device_id is not null").select("source", F.col("device_id").alias("vendor_device_id")).distinct()
    named = seen.withColumns({"device_id": scalar.identity(F.lit("device"), F.col("source"), F.col("vendor_device_id")), "name": F.col("vendor_device_id")})
    stored = store.read("devices")
    new = merge.insert_missing(stored, schemas.conform(named, schemas.DEVICES), schemas.KEYS["devices"])
    if not new.isEmpty():
        store.upsert("devices", new)


#: Manifests of the run table and of the ledgers that are kept after a run, for readers that began before it.
KEPT_VERSIONS = 4


class Run:
    """The audit row of one import: stored as running, then as succeeded or failed with its counts.

    The end of a run that succeeded and the watermark of its window are one commit, so neither is seen without the other.
    ``id`` may be given, so that a run which is made again after a crash replaces its own row.
    """

    def __init__(self, store: SnapshotStore, source: str, start: datetime | None = None, end: datetime | None = None, *, id: str | None = None):
        self.store, self.source, self.start, self.end = store, source, start, end
        self.id, self.began, self.raw = id or uuid.uuid4().hex, datetime.now(UTC), 0
        self.counts = dict.fromkeys(("inserted", "updated", "duplicate", "rejected"), 0)
        self.ledgers: set[str] = set()
        self._save("running")

    def _row(self, status: str, error: str | None = None) -> DataFrame:
        c = self.counts
        done = c["inserted"] + c["updated"] + c["duplicate"]
        row = (self.id, self.source, status, self.start, self.end, self.began, None if status == "running" else datetime.now(UTC), self.raw, done, c["inserted"], c["updated"], c["duplicate"], c["rejected"], error)
        return self.store.spark.createDataFrame([row], schemas.INGESTION_RUNS)

    def _save(self, status: str, error: str | None = None) -> None:
        self.store.upsert("ingestion_runs", self._row(status, error))

    def merge(self, normalized: dict[str, DataFrame], raw: int = 1, batch: tuple[str, int] | None = None) -> None:
        """The counts are stored after every ledger, so a run that breaks off tells how far it came."""
        self.raw += raw
        for ledger, rows in normalized.items():
            for k, n in self.store.merge(ledger, rows, self.id, batch).items():
                self.counts[k] += n
            self.ledgers.add(ledger)
            self._save("running")
            if "device_id" in rows.columns:
                ensure_devices(self.store, rows)

    def __enter__(self) -> Run:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if error is not None:
            self._save("failed", f"{kind.__name__}: {error}"[:4000])
            return
        rows = {"ingestion_runs": self._row("succeeded")}
        if self.end is not None:  # only a run that succeeded moves the watermark
            rows["sync_state"] = self.store.spark.createDataFrame([(self.source, self.end, self.id)], schemas.SYNC_STATE)
        self.store.upsert_together(rows)
        for table in ("ingestion_runs", *self.ledgers):
            self.store.vacuum(table, KEPT_VERSIONS)


def instant(row, name: str) -> datetime | None:
    """A timestamp of a row that was collected with its microseconds, aware and in UTC whatever the driver's zone."""
    micros = row[f"{name}_us"]
    return None if micros is None else datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=micros)


def with_instants(df: DataFrame, *names: str) -> DataFrame:
    """Timestamps beside their microseconds: collected timestamps are naive in the zone of the driver's machine."""
    return df.withColumns({f"{n}_us": F.unix_micros(n) for n in names})


def last_end(store: SnapshotStore, source: str) -> datetime | None:
    row = with_instants(store.read("sync_state").where(F.col("source") == source), "last_successful_end").first()
    return instant(row, "last_successful_end") if row else None


def sync_window(last: datetime | None, now: datetime, *, first_days: int = 7, overlap_hours: int = 72) -> tuple[datetime, datetime]:
    """The next fetch window: it reaches back into what was seen, so late and revised records are read again."""
    return (now - timedelta(days=first_days) if last is None else last - timedelta(hours=overlap_hours)), now


def sync_status(store: SnapshotStore, source: str) -> dict:
    """The newest run of a source with the end of the last good window; ``never-synced`` without a run."""
    times = ("requested_start", "requested_end", "started_at", "finished_at")
    runs = with_instants(store.read("ingestion_runs").where(F.col("source") == source), *times).orderBy(F.desc("started_at"), F.desc("run_id")).limit(1).collect()
    if not runs:
        return {"source": source, "state": "never-synced", "ok": True}
    r = runs[0]
    counts = {k: r[k] for k in ("run_id", "raw_count", "normalized_count", "inserted_count", "updated_count", "duplicate_count", "rejected_count")}
    return {"source": source, "state": r["status"], "ok": r["status"] != "failed", "last_successful_end": last_end(store, source), "error": (r["error"] or "none").partition(":")[0], **{t: instant(r, t) for t in times}, **counts}


def set_priorities(store: SnapshotStore, rows: DataFrame) -> None:
    """All priorities anew, in one step."""
    store.replace("source_priorities", rows)


def refresh_links(store: SnapshotStore) -> dict[str, int]:
    """Finds links anew and stores them: how many were found, confirmed, left as candidates, and gone."""
    stored = store.read("duplicate_links")
    fresh = duplicates.refresh(store.ledgers(), stored)
    before = stored.select("link_id")
    named = fresh.withColumns({"link_id": F.coalesce("link_id", scalar.identity(*map(F.col, schemas.KEYS["duplicate_links"]))), "created_at": F.coalesce("created_at", F.current_timestamp())})
    store.replace("duplicate_links", named)
    now = store.read("duplicate_links")
    count = now.agg(F.count(F.lit(1)).alias("links"), *[F.count(F.when(F.col("resolution") == r, 1)).alias(r) for r in ("confirmed", "candidate", "rejected")]).first()
    return count.asDict() | {"stale": before.join(now, "link_id", "left_anti").count()}


def resolve(store: SnapshotStore, link_id: str, resolution: str) -> None:
    """A decision on one link; rejected links survive every refresh."""
    store.replace("duplicate_links", merge.resolve_link(store.read("duplicate_links"), F.col("link_id") == link_id, resolution))


def doctor(store: SnapshotStore, priorities: DataFrame | None = None) -> list[tuple[str, bool, str]]:
    """(check, passed, detail): tables readable with their schemas, priorities as configured, nights of a sane length."""
    from .views import canonical_sleep_daily

    checks = []
    for name in schemas.TABLES:
        try:
            checks.append((f"table {name}", True, f"{store.read(name).count()} rows, version {store.version(name)}"))
        except Exception as x:  # a check that fails is a result
            checks.append((f"table {name}", False, str(x).splitlines()[0]))
    if priorities is not None:
        same = store.read("source_priorities").exceptAll(priorities).unionAll(priorities.exceptAll(store.read("source_priorities"))).isEmpty()
        checks.append(("source priorities", same, "current" if same else "differ from the configuration"))
    night = canonical_sleep_daily(store.ledgers()).agg(F.count(F.when(F.col("total_sleep_minutes") > 1440, 1)).alias("a"), F.count(F.when(F.col("total_sleep_minutes") > 960, 1)).alias("b")).first()
    checks.append(("sleep rollups", night["a"] == 0, f"over_24h={night['a']}, review_over_16h={night['b']}"))
    return checks
