"""Routes of raw artifacts to normalizers, imports, syncs, and the full rebuild from the raw store."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..sources import apple_health, labs, manual, oura, raw_store, withings
from ..sources.paged_api import PagedApi
from . import state
from .store import SnapshotStore
from .state import sync_window

__all__ = ["ROUTES", "CONNECTORS", "enter", "ingest", "normalize", "rebuild", "sync", "sync_window"]

#: Fixed order of the routes in a rebuild.
ROUTES = ("apple_health", "withings_export", "withings_api", "oura", "labs", "manual")
#: Routes whose artifacts are documents of an endpoint, read all at once.
PAGED = ("withings_api", "oura", "manual")


def normalize(spark: SparkSession, route: str, path, *, zone: str, endpoint: str = "", biomarkers: dict[str, list[str]] | None = None, staging: str | None = None) -> dict[str, DataFrame]:
    """Ledger -> rows.  ``path``: one path or a list of them; for the routes in ``PAGED`` also a frame of pages (path, content)."""
    if route in PAGED:
        pages = path if isinstance(path, DataFrame) else raw_store.read_pages(spark, path)
        if route == "manual":
            return manual.normalize(pages, endpoint)
        return withings.normalize_api(pages) if route == "withings_api" else oura.normalize(pages, endpoint.rstrip("/").rsplit("/", 1)[-1], zone)
    if route == "withings_export":
        return withings.normalize_export(spark, path, zone, staging)
    if route == "apple_health":
        return apple_health.normalize(spark, path, staging)
    if route == "labs":
        return labs.normalize(spark, path, biomarkers or {}, zone)
    raise ValueError(f"no such route: {route}")


def ingest(store: SnapshotStore, normalized: dict[str, DataFrame], source: str, *, kind: str = "import", raw: int = 1) -> dict:
    """Merge every ledger under one audited run; the counts and the run's id."""
    state.ensure_source(store, source, kind)
    with state.Run(store, source) as run:
        run.merge(normalized, raw)
    return run.counts | {"run_id": run.id}


def enter(store: SnapshotStore, raw_root: str, endpoint: str, document: dict) -> dict:
    """A manual entry: its document is kept raw before it is merged, so that a rebuild has it too."""
    made = datetime.fromisoformat(document["created_at"])
    path = raw_store.save(raw_root, manual.SOURCE, endpoint, manual.written(document), retrieved_at=made, request_metadata={"entry_schema_version": manual.FORM})
    return ingest(store, normalize(store.spark, "manual", f"{raw_root.rstrip('/')}/{path}", zone="UTC", endpoint=endpoint), manual.SOURCE, kind="manual")


# ---------------------------------------------------------------- syncs


@dataclass(frozen=True)
class Endpoint:
    """One collection of an API: its path, and how its pages are asked for."""

    path: str
    options: dict


def _token(path: str, days: int = 3650, **more: str) -> Endpoint:
    return Endpoint(path, {"style": "token", "chunk_days": str(days), **more})


# The collections of the two APIs; heart rates are given for thirty days at most.
CONNECTORS = {
    "oura": [
        *[_token(f"usercollection/{n}") for n in ("sleep", "daily_activity", "daily_readiness", "daily_sleep", "daily_spo2", "daily_stress", "workout", "session") if n in oura.FIELDS],
        _token("usercollection/heartrate", 30, start_param="start_datetime", end_param="end_datetime", times="iso"),
    ],
    "withings": [Endpoint("measure", {"style": "offset", "method": "POST", "chunk_days": "3650", "start_param": "startdate", "end_param": "enddate", "times": "epoch", "param_action": "getmeas", "param_category": "1", "param_meastypes": ",".join(map(str, sorted({**withings.BODY, **withings.PRESSURE})))})],
}


def fetch_options(e: Endpoint, source: str, base_url: str, raw_root: str, headers: dict[str, str] | None) -> dict[str, str]:
    """Options of the paged data source for one collection; its tasks save the pages below ``raw_root``."""
    return e.options | {"url": f"{base_url.rstrip('/')}/{e.path}", "raw_root": raw_root, "raw_source": source, "raw_endpoint": e.path} | {f"header_{k}": v for k, v in (headers or {}).items()}


def route_of_source(source: str) -> str:
    return "oura" if source == "oura" else "withings_api"


def merge_fetched(run: state.Run, raw_root: str, source: str, endpoint: str, fetched: list, zone: str, batch: tuple[str, int] | None = None) -> None:
    """Merges the pages that tasks have saved (path and status of each); a refused one is an error, the others stay saved."""
    refused = [r for r in fetched if not 200 <= r["http_status"] < 300]
    if refused:
        raise OSError(f"{len(refused)} refused pages of {endpoint}")
    if fetched:
        pages = raw_store.read_pages(run.store.spark, [f"{raw_root.rstrip('/')}/{r['raw_path']}" for r in fetched])
        run.merge(normalize(run.store.spark, route_of_source(source), pages, zone=zone, endpoint=endpoint), len(fetched), batch)


def sync(store: SnapshotStore, raw_root: str, source: str, base_url: str, *, zone: str, headers: dict[str, str] | None = None, now: datetime | None = None) -> dict:
    """Fetch the next window of every collection, keep each page raw as it came, then normalize and merge it.

    Tasks fetch and save the pages; the driver gets the path and the status of each.  Only a run that succeeded as a whole moves
    the watermark, so a window that failed is fetched again.
    """
    spark = store.spark
    spark.dataSource.register(PagedApi)
    start, end = sync_window(state.last_end(store, source), now or datetime.now(UTC))
    state.ensure_source(store, source, "api")
    with state.Run(store, source, start, end) as run:
        for e in CONNECTORS[source]:
            options = fetch_options(e, source, base_url, raw_root, headers) | {"start": start.date().isoformat(), "end": end.date().isoformat()}
            fetched = spark.read.format("paged_api").options(**options).load().select("raw_path", "http_status").collect()  # a path a page
            merge_fetched(run, raw_root, source, e.path, fetched, zone)
    return run.counts | {"run_id": run.id}


# ---------------------------------------------------------------- rebuild


#: The route of archives whose members are artifacts of their own.
PARENT = "parent"


def route_of() -> Column:
    """The route of an artifact by its manifest; null if there is none."""
    source, kind = F.col("source"), F.lower(F.trim(F.substring_index(F.coalesce("content_type", F.lit("")), ";", 1)))
    withings_ = F.when(kind == "text/csv", "withings_export").when(kind == "application/json", "withings_api").when(F.col("endpoint") == "export/archive", PARENT)
    entry = F.when(F.col("endpoint").isin(*manual.FIELDS), "manual")
    return F.when(source == "withings", withings_).when(source == manual.SOURCE, entry).when(source.isin("oura", "apple_health", "labs"), source)


def rebuild(spark: SparkSession, raw_root: str, target: str, *, zone: str, biomarkers: dict[str, list[str]] | None = None, staging: str | None = None, priorities: DataFrame | None = None) -> SnapshotStore:
    """A fresh store from every verified artifact, in fixed order; ``target`` must not exist, and does not after an error.

    The pages of an endpoint are one read and one merge, in which the later page of a key wins, as when merged in turn; their
    bytes go from the verified read to the normalizer, and only the names of the endpoints come to the driver.  Imported files
    are verified before any of them is read, and then read one by one.  An altered artifact is an error, whatever it holds, and
    so are an artifact that no route takes and a raw store without any.  Refused pages and archives whose members are artifacts
    of their own are passed over.
    """
    store = SnapshotStore(spark, target)
    if store.files.exists():
        raise FileExistsError(target)
    good = F.col("http_status").between(200, 299)
    found = raw_store.listing(spark, raw_root).where(good).groupBy(route_of().alias("route"), "source", "endpoint").count().orderBy("source", "endpoint").collect()  # a row an endpoint
    if lost := [f"{g['source']} {g['endpoint']}" for g in found if g["route"] is None]:
        raise ValueError(f"no route for {', '.join(lost)}")
    if not any(g["route"] != PARENT for g in found):
        raise ValueError(f"no artifacts in {raw_root}")
    artifacts = raw_store.verified(spark, raw_root).where(good).withColumn("route", route_of())
    try:
        imported = set(ROUTES) - set(PAGED)
        files = [] if imported.isdisjoint(g["route"] for g in found) else artifacts.where(F.col("route").isin(*imported)).select("route", "source", "path").orderBy("path").collect()  # a path an imported file
        if priorities is not None:
            state.set_priorities(store, priorities)
        for r in ROUTES:
            for g in found:
                if g["route"] == r and r in PAGED:
                    pages = artifacts.where((F.col("route") == r) & (F.col("source") == g["source"]) & F.col("endpoint").eqNullSafe(g["endpoint"])).select("path", "content")
                    ingest(store, normalize(spark, r, pages, zone=zone, endpoint=g["endpoint"]), g["source"], kind="manual" if r == "manual" else "api", raw=g["count"])
            for f in files:
                if f["route"] == r:
                    ingest(store, normalize(spark, r, f["path"], zone=zone, biomarkers=biomarkers, staging=staging), f["source"])
    except Exception:
        if store.files.exists():
            store.files.delete("")  # it was not there before
        raise
    return store


def totals(store: SnapshotStore) -> dict[str, int]:
    """What the runs of a store have read and changed, all together."""
    names = ("raw_count", "normalized_count", "inserted_count", "updated_count", "duplicate_count", "rejected_count")
    row = store.read("ingestion_runs").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n.removesuffix("_count")) for n in names]).first()
    return row.asDict()
