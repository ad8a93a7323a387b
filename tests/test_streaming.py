import json
import random
import threading
import time
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import sessions
from tidemark.operators.pairing import pair_halves
from tidemark.plans import rebuild
from tidemark.plans.store import SnapshotStore
from tidemark.streaming import pairing
from tidemark.streaming.fetch import sync_stream
from tidemark.streaming.ledger import live_sessions, live_windows, merge_stream


def events(spark):
    return spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")


def test_stream_of_merges_equals_batch(spark, tmp_path):
    rows = schemas.conform(events(spark).select(F.lit("click").alias("event_type"), F.col("ts").alias("started_at"), F.lit("s").alias("source"), F.col("event_id").cast("string").alias("source_record_id")), schemas.EVENT)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    store, seen = SnapshotStore(spark, str(tmp_path / "store")), []
    stream = spark.readStream.schema(schemas.EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for run in range(2):  # the second reads everything again
        q = merge_stream(stream, store, "events", str(tmp_path / f"check{run}"), name=f"run{run}", on_batch=lambda n, c: seen.append(c))
        q.awaitTermination()
    n = rows.count()
    assert store.read("events").count() == n
    assert sum(c["inserted"] for c in seen) == n and sum(c["duplicate"] for c in seen) == n


def test_session_preview_equals_batch(spark, tmp_path):
    events(spark).repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id bigint, ts timestamp, user_id bigint").parquet(str(tmp_path / "in"))
    q = live_sessions(stream, ["user_id"], "ts", "4 hours", "60 days").writeStream.format("memory").queryName("live").outputMode("complete").start()
    try:
        q.processAllAvailable()
        got = sorted(map(tuple, spark.sql("SELECT user_id, started_at, ended_at, reading_count FROM live").collect()))
    finally:
        q.stop()
    readings = sessions.sessionize(events(spark), ["user_id"], "ts", 4 * 3600, tie="event_id")
    want = readings.groupBy("user_id", "session_number").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("n")).select("user_id", "a", "b", "n")
    assert got == sorted(map(tuple, want.collect()))


def run_stream(spark, df, mode):
    name = f"q{abs(hash(df.semanticHash()))}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
        return [tuple(r) for r in spark.sql(f"SELECT * FROM {name}").collect()]
    finally:
        q.stop()


def test_tumbling_and_sliding_windows_equal_batch(spark, tmp_path):
    events(spark).repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id bigint, ts timestamp, user_id bigint").parquet(str(tmp_path / "in"))
    for slide in (None, "6 hours"):
        got = run_stream(spark, live_windows(stream, ["user_id"], "ts", "1 day", slide, "60 days", F.count(F.lit(1)).alias("n")).select("user_id", "window_start", "window_end", "n"), "complete")
        window = F.window("ts", "1 day", slide) if slide else F.window("ts", "1 day")
        want = events(spark).groupBy("user_id", window.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", "w.start", "w.end", "n")
        assert sorted(got) == sorted(map(tuple, want.collect()))


def test_pairs_of_a_stream_equal_the_batch_in_any_order(spark, tmp_path):
    rng = random.Random(5)
    rows = [(who, "high" if h else "low", float(rng.randrange(100)), n * 2 + h) for who in "abcdefgh" for n in range(rng.randrange(1, 5)) for h in (0, 1) if rng.random() < 0.8] + [("x", "other", 1.0, 1)]
    schema = "who string, kind string, v double, place long"
    batch = pair_halves(spark.createDataFrame(rows, schema), ["who"], "kind", "place", "high", "low", {"high": ("high", F.col("v")), "low": ("low", F.col("v"))})
    want = sorted(map(str, map(tuple, batch.select("who", "high", "low", "place", "reason").collect())))
    assert any("without" in w for w in want) and any("None)" in w for w in want)
    rng.shuffle(rows)
    for k in range(4):
        spark.createDataFrame(rows[k::4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = pairing.live_pairs(stream, ["who"], "kind", "v", "place", "high", "low", wait_seconds=45)
    q = out.writeStream.format("memory").queryName("paired").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    took = lambda: sorted(map(str, map(tuple, spark.sql("SELECT * FROM paired").collect())))
    try:
        until = time.time() + 180
        while len(took()) < len(want) and time.time() < until:
            assert q.exception() is None
            time.sleep(1)
        assert took() == want
        spark.createDataFrame([("a", "low", 7.0, 999)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # long after
        until = time.time() + 120
        while len(took()) == len(want) and time.time() < until:
            time.sleep(1)
        assert sorted(set(took()) - set(want)) == ["('a', None, 7.0, 999, 'without its pair')"]
    finally:
        q.stop()


def test_a_batch_that_is_made_again_changes_nothing(spark, tmp_path):
    rows = schemas.conform(events(spark).select(F.lit("click").alias("event_type"), F.col("ts").alias("started_at"), F.lit("s").alias("source"), F.col("event_id").cast("string").alias("source_record_id")), schemas.EVENT)
    rows.limit(60).repartition(3).write.parquet(str(tmp_path / "in"))
    store = SnapshotStore(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(schemas.EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def killed(number, counts):
        if number == 1:
            raise RuntimeError("killed after the commit")

    with pytest.raises(Exception, match="killed"):
        merge_stream(stream, store, "events", str(tmp_path / "c"), name="feed", on_batch=killed).awaitTermination()
    held, version = store.read("events").count(), store.version("events")
    seen = []
    merge_stream(stream, store, "events", str(tmp_path / "c"), name="feed", on_batch=lambda n, c: seen.append((n, c["inserted"], c["duplicate"]))).awaitTermination()
    assert [n for n, _, _ in seen] == [1, 2] and all(d == 0 for _, _, d in seen)
    runs = {r.run_id: r for r in store.read("ingestion_runs").collect()}
    assert sorted(runs) == ["feed-00000000", "feed-00000001", "feed-00000002"]
    assert sum(r.inserted_count for r in runs.values()) == store.read("events").count() == 60
    assert {r.status for r in runs.values()} == {"succeeded"} and held < 60 and version < store.version("events")


class Windows(BaseHTTPRequestHandler):
    """Daily documents of the days that are asked for; remembers the windows."""

    asked: list = []
    failing = False

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        body, status = {"data": []}, 200
        if "daily_activity" in self.path:
            self.asked.append((q["start_date"], q["end_date"]))
            status = 403 if Windows.failing else 200
            body = {"data": [{"id": f"d-{q['start_date']}", "day": q["start_date"], "timestamp": f"{q['start_date']}T04:00:00+00:00", "steps": 12}]}
        self.send_response(status)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *args):
        pass


def test_a_sync_stream_asks_for_the_same_window_again(spark, tmp_path, monkeypatch):
    only = [e for e in rebuild.CONNECTORS["oura"] if e.path.endswith("daily_activity")]
    monkeypatch.setitem(rebuild.CONNECTORS, "oura", only)
    server = HTTPServer(("127.0.0.1", 0), Windows)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    store, raw = SnapshotStore(spark, str(tmp_path / "s")), str(tmp_path / "raw")
    go = lambda day: sync_stream(store, raw, "oura", f"http://127.0.0.1:{server.server_port}", str(tmp_path / "c"), zone="UTC", now=datetime(2025, 3, day, 12, tzinfo=UTC))
    try:
        go(10)
        assert set(Windows.asked) == {("2025-03-03", "2025-03-10")}
        Windows.asked.clear()
        Windows.failing = True
        with pytest.raises(Exception, match="refused"):
            go(12)
        Windows.failing = False
        go(20)  # first the window that failed, then the rest
        windows = list(dict.fromkeys(Windows.asked))
        assert windows == [("2025-03-07", "2025-03-12"), ("2025-03-09", "2025-03-20")]
    finally:
        server.shutdown()
    got = store.read("observations").collect()
    assert sorted(r.source_record_id for r in got) == [f"d-2025-03-{d:02d}" for d in (3, 7, 9)] and all(raw in r.raw_file for r in got)
    assert {(r.run_id, r.status) for r in store.read("ingestion_runs").collect()} == {(f"sync-oura-usercollection-daily_activity-{n:08d}", "succeeded") for n in range(3)}
    assert rebuild.rebuild(spark, raw, str(tmp_path / "again"), zone="UTC").read("observations").count() == 3
