"""The store: layered changes, batches applied once, commits of two tables, page order, verification, zones."""

import json
import os
import random
import subprocess
import sys
import time
from datetime import UTC, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.plans import rebuild, state
from tidemark.plans import store as st
from tidemark.plans.store import SnapshotStore
from tidemark.sources import raw_store

ROOT = Path(__file__).resolve().parent.parent


def rows(spark, given, positions=False):
    """(key, value[, file, element]) as observations of one metric."""
    df = spark.createDataFrame([("weight_kg", datetime(2025, 3, 1, 8), float(g[1]), "valid", "scale", g[0]) for g in given], "metric string, observed_at timestamp, value double, quality string, source string, source_record_id string")
    if positions:
        df = spark.createDataFrame([("weight_kg", datetime(2025, 3, 1, 8), float(v), "valid", "scale", k, (f, e, 0)) for k, v, f, e in given], f"metric string, observed_at timestamp, value double, quality string, source string, source_record_id string, {schemas.POSITION} {schemas.POSITION_TYPE}")
    return schemas.conform(df, schemas.OBSERVATION)


def held(store, table="observations"):
    return {r.source_record_id: r.value for r in store.read(table).collect()}


def written(store, table="observations"):
    return {tuple(f) for p in store.manifest(table)["parts"].values() for f in p}


def test_bytes_written_follow_the_batch(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path), buckets=4)
    store.merge("observations", rows(spark, [(f"r{i}", i) for i in range(4000)]))
    base = written(store)
    assert store.merge("observations", rows(spark, [("r7", 70), ("r8", 8), ("new", 1)])) == {"inserted": 1, "updated": 1, "duplicate": 1, "rejected": 0}
    fresh = written(store) - base
    assert base <= written(store) and sum(b for _, b in fresh) < 0.2 * sum(b for _, b in base)
    assert len(held(store)) == 4001 and held(store)["r7"] == 70
    before = store.version("observations")
    assert store.merge("observations", rows(spark, [("r8", 8)]))["duplicate"] == 1 and store.version("observations") == before  # nothing to write


def test_many_small_batches_equal_a_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "LAYERS", 3)
    store, truth, rng = SnapshotStore(spark, str(tmp_path), buckets=2), {}, random.Random(2)
    for n in range(11):
        given = [(f"k{rng.randrange(60 if n else 400)}", rng.randrange(5), f"f{n}", i) for i in range(300 if not n else 9)]
        order = given[:]
        rng.shuffle(order)
        counts = store.merge("observations", rows(spark, order, True).repartition(3))
        want = dict.fromkeys(("inserted", "updated", "duplicate", "rejected"), 0)
        for k, v, _, _ in given:
            want["inserted" if k not in truth else "updated" if truth[k] != v else "duplicate"] += 1
            truth[k] = v
        assert counts == want
    assert held(store) == truth
    layers = [len(p) for p in store.manifest("observations")["parts"].values()]
    assert max(layers) <= 1 + st.LAYERS + 1
    store.vacuum("observations", keep=1)
    assert held(store) == truth
    folders = {f.split("/")[0] for f, _ in written(store)}
    assert {n for n in store.files.names("observations") if n.startswith(("v", "staged"))} == folders


def test_a_batch_is_applied_once(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    first = store.merge("observations", rows(spark, [("a", 1)]), "run", ("feed", 0))
    assert store.merge("observations", rows(spark, [("b", 2)]), "run", ("feed", 1))["inserted"] == 1
    version = store.version("observations")
    assert store.merge("observations", rows(spark, [("b", 9)]), "run", ("feed", 1)) == {"inserted": 1, "updated": 0, "duplicate": 0, "rejected": 0}
    assert sum(store.merge("observations", rows(spark, [("a", 9)]), "run", ("feed", 0)).values()) == 0 and first["inserted"] == 1
    assert store.version("observations") == version and held(store) == {"a": 1, "b": 2}
    assert store.merge("observations", rows(spark, [("a", 1)]), "run", ("other", 0))["duplicate"] == 1


def test_rejected_rows_are_counted_in_the_same_pass(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    good = rows(spark, [("a", 1), ("b", 2), ("c", 3)])
    source = good.union(good.selectExpr(*[("CAST(NULL AS DOUBLE) AS value" if c == "value" else c) for c in good.columns]))
    assert store.merge("observations", source.mapInArrow(counted, source.schema)) == {"inserted": 3, "updated": 0, "duplicate": 0, "rejected": 3}
    assert reads.value == 6


def test_the_end_of_a_run_and_its_watermark_are_one_commit(spark, tmp_path, monkeypatch):
    store, end = SnapshotStore(spark, str(tmp_path)), datetime(2025, 3, 5, 12, 30, 0, 250_000, tzinfo=UTC)
    with state.Run(store, "scale", None, end) as run:
        run.merge({"observations": rows(spark, [("a", 1)])})
    assert state.last_end(store, "scale") == end and state.sync_status(store, "scale")["state"] == "succeeded"
    run = state.Run(store, "scale", end, datetime(2025, 3, 9, tzinfo=UTC))
    real = store._publish
    monkeypatch.setattr(store, "_publish", lambda home, *a, **k: (_ for _ in ()).throw(OSError("gone")) if home == "ingestion_runs" else real(home, *a, **k))
    with pytest.raises(OSError):
        run.__exit__(None, None, None)
    monkeypatch.undo()
    assert state.last_end(store, "scale") == end and state.sync_status(store, "scale")["state"] == "running"


def test_runs_do_not_pile_up_versions(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    for n in range(6):
        with state.Run(store, "scale") as run:
            run.merge({"observations": rows(spark, [(f"k{n}", n)])})
    assert store.read("ingestion_runs").count() == 6 and {r.status for r in store.read("ingestion_runs").collect()} == {"succeeded"}
    manifests = [n for n in store.files.names("ingestion_runs") if n.startswith("manifest")]
    assert len(manifests) <= state.KEPT_VERSIONS + 1 and held(store) == {f"k{n}": n for n in range(6)}


# ---------------------------------------------------------------- order, verification


def page(steps, padding=0, key="a"):
    return {"data": [{"id": key, "day": "2025-03-04", "timestamp": "2025-03-04T04:00:00-03:00", "steps": steps}], "next_token": "x" * padding or None}


def test_a_larger_later_page_wins(spark, tmp_path):
    raw = str(tmp_path / "raw")
    for steps, padding in ((5, 200_000), (6, 10), (7, 900_000), (9, 0)):
        raw_store.save(raw, "oura", "daily_activity", json.dumps(page(steps, padding)).encode())
        time.sleep(0.002)
    again = rebuild.rebuild(spark, raw, str(tmp_path / "s"), zone="UTC")
    r = again.read("observations").first()
    assert r.value == 9 and r.raw_file.startswith(raw) and again.read("ingestion_runs").first().updated_count == 3
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        assert rebuild.rebuild(spark, raw, str(tmp_path / "t"), zone="UTC").read("observations").first().value == 9
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_of_one_page_the_last_element_wins(spark, tmp_path):
    two = {"data": [page(1)["data"][0], page(2)["data"][0], page(3, key="b")["data"][0]]}
    raw_store.save(str(tmp_path / "raw"), "oura", "daily_activity", json.dumps(two).encode())
    got = rebuild.rebuild(spark, str(tmp_path / "raw"), str(tmp_path / "s"), zone="UTC").read("observations")
    assert sorted(r.value for r in got.collect()) == [2, 3]


@pytest.mark.parametrize("kind", ["page", "file", "missing"])
def test_a_rebuild_refuses_altered_artifacts(spark, tmp_path, kind):
    raw = tmp_path / "raw"
    if kind == "file":
        name = raw_store.save(str(raw), "withings", "export", b"Date,Weight (kg)\n2025-03-04 08:00:00,71\n", extension="csv", content_type="text/csv")
    else:
        name = raw_store.save(str(raw), "oura", "daily_activity", json.dumps(page(71)).encode())
    assert rebuild.rebuild(spark, str(raw), str(tmp_path / "fine"), zone="UTC").read("observations").first().value == 71
    if kind == "missing":
        (raw / name).unlink()
    else:
        (raw / name).write_bytes((raw / name).read_bytes().replace(b"71", b"99"))
    for sums in raw.rglob(".*.crc"):
        sums.unlink()
    with pytest.raises(Exception, match="altered artifact"):
        rebuild.rebuild(spark, str(raw), str(tmp_path / "s"), zone="UTC")
    with pytest.raises(Exception, match="altered artifact"):
        raw_store.verified(spark, str(raw)).select("path").collect()
    plan = raw_store.verified(spark, str(raw)).select("path")._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" in plan and "raise_error" in plan


def test_many_pages_are_few_files(spark, tmp_path):
    """Pages saved at once are rows of packs; beside single files the later of a key still wins, and a changed byte is found."""
    raw, at = tmp_path / "raw", datetime(2025, 3, 4, tzinfo=UTC)
    rows = [("daily_activity", at + timedelta(seconds=n), json.dumps(page(n, key=f"k{n % 200}")).encode()) for n in range(400)]
    pages = spark.createDataFrame(rows, "endpoint string, retrieved_at timestamp, content binary").repartition(2)
    raw_store.save_pages(pages, str(raw), "oura")
    assert len([p for p in raw.rglob("*.parquet")]) <= 2
    held = rebuild.rebuild(spark, str(raw), str(tmp_path / "packs"), zone="UTC").read("observations")
    assert sorted(r.value for r in held.collect()) == list(range(200, 400))
    raw_store.save(str(raw), "oura", "daily_activity", json.dumps(page(1000, key="k7")).encode(), retrieved_at=at + timedelta(days=1))
    raw_store.save(str(raw), "oura", "daily_activity", json.dumps(page(2000, key="k8")).encode(), retrieved_at=at - timedelta(days=1))
    for source in (None, "oura"):
        listed = raw_store.listing(spark, str(raw), source).collect()
        assert len(listed) == 402 == len({r.path for r in listed}) and [r.path for r in listed] == sorted(r.path for r in listed)
        assert raw_store.verified(spark, str(raw), source).where("length(content) = content_length").count() == 402
    values = [r.value for r in rebuild.rebuild(spark, str(raw), str(tmp_path / "both"), zone="UTC").read("observations").collect()]
    assert 1000 in values and 2000 not in values and len(values) == 200
    pack = raw_store.PACKS + "/oura/altered"
    spark.read.parquet(f"{raw}/{raw_store.PACKS}/oura/*").limit(1).withColumn("content", F.lit(b"{}")).write.parquet(f"{raw}/{pack}")
    with pytest.raises(Exception, match="altered artifact"):
        rebuild.rebuild(spark, str(raw), str(tmp_path / "s"), zone="UTC")
    assert not (tmp_path / "s").exists()


ZONED = """
import sys
from datetime import UTC, datetime, timedelta
sys.path.insert(0, sys.argv[2])
from tidemark.plans import state
from tidemark.plans.store import SnapshotStore
from tidemark.session import build_session
spark = build_session("zone", "local[2]", 2, **{"spark.ui.enabled": "false"})
store, end = SnapshotStore(spark, sys.argv[1]), datetime(2025, 3, 9, 3, 0, 0, 7, tzinfo=UTC)
with state.Run(store, "scale", end, end):
    pass
assert state.last_end(store, "scale") == end, state.last_end(store, "scale")
status = state.sync_status(store, "scale")
assert status["requested_start"] == end and status["last_successful_end"] == end
assert abs((datetime.now(UTC) - status["started_at"]).total_seconds()) < 600
print("zone ok")
"""


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo"])
def test_the_watermark_does_not_depend_on_the_drivers_zone(tmp_path, zone):
    env = {**os.environ, "TZ": zone, "PYTHONPATH": str(ROOT)}
    got = subprocess.run([sys.executable, "-c", ZONED, str(tmp_path / "s"), str(ROOT)], env=env, capture_output=True, text=True, timeout=300)
    assert "zone ok" in got.stdout, got.stderr[-2000:]


def test_a_staged_batch_is_a_file_a_task(spark, tmp_path):
    """Files do not grow with tasks times buckets; what a batch touches is told by its valid rows alone."""
    store = SnapshotStore(spark, str(tmp_path))
    given = spark.range(0, 4000, 1, 8).select(F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.concat(F.lit("k"), "id").alias("source_record_id"), F.lit("walk").alias("event_type"), F.when(F.col("id") % 4 > 0, F.timestamp_seconds("id")).alias("started_at"))
    given = given.withColumn("source", F.when(F.col("started_at").isNull(), "z").otherwise(F.col("source")))
    rejected, touched, first, last = store._stage("events", given, "r", 64, "staged-x")
    valid = given.where("started_at is not null").select(SnapshotStore._bucket("events", 64).alias("b")).distinct().collect()
    assert (rejected, first, last) == (1000, "s0", "s2") and touched == {str(r.b) for r in valid}
    assert len(list((tmp_path / "events/staged-x").glob("*.parquet"))) <= 8
    assert store._stage("events", given.where("started_at is null"), "r", 64, "staged-y") == (1000, set(), None, None)
    counts = [store.merge("events", given.where(F.col("source") == s)) for s in ("s0", "s1", "s0")]
    assert [c["inserted"] for c in counts] == [1000, 1000, 0] and counts[2]["duplicate"] == 1000 and store.read("events").count() == 2000
