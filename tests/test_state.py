import json
import threading
import urllib.request
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.__main__ import main
from tidemark.operators import merge
from tidemark.plans import rebuild, reports, serve, state
from tidemark.plans.export import SnapshotStore
from tidemark.sources import config


def rows(spark, *given):
    return schemas.conform(spark.createDataFrame([("weight_kg", datetime(2025, 3, d, 8), float(v), "valid", s, k, dev) for k, d, v, s, dev in given], "metric string, observed_at timestamp, value double, quality string, source string, source_record_id string, device_id string"), schemas.OBSERVATION)


def test_every_copy_of_a_batch_counts(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("z", 9)], "k string, v int")
    batch = spark.createDataFrame([("a", 1, 0), ("a", 3, 1), ("a", 1, 2), ("b", 5, 0), ("b", 5, 1), ("c", 7, 0), ("c", 7, 1), ("c", 8, 2), ("z", 9, 0)], "k string, v int, p int")
    got = {r.k: (r.v, r._inserted, r._updated, r._duplicate) for r in merge.merge_changes(old, batch, ["k"], ["v"], "p").collect()}
    assert got == {"a": (1, 0, 2, 1), "b": (5, 0, 1, 1), "c": (8, 1, 1, 1), "z": (9, 0, 0, 1)}


def test_a_merge_reads_and_writes_the_buckets_concerned(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s", buckets=8)
    many = [(f"r{i}", 1 + i % 20, i, "scale", None) for i in range(200)]
    assert store.merge("observations", rows(spark, *many))["inserted"] == 200
    before = store.manifest("observations")
    assert store.merge("observations", rows(spark, ("r7", 8, 1000, "scale", None), ("new", 1, 5, "scale", None), ("new", 1, 6, "scale", None))) == {"inserted": 1, "updated": 2, "duplicate": 0, "rejected": 0}
    after = store.manifest("observations")
    moved = [b for b in after["parts"] if after["parts"][b] != before["parts"].get(b)]
    assert 1 <= len(moved) <= 2 and after["version"] == 2
    plan = store.read("observations", [int(b) for b in moved]).inputFiles()
    assert all(any(f"_b={b}/" in f for b in moved) for f in plan)
    assert store.read("observations").count() == 201 and store.read("observations").where("source_record_id = 'r7'").first().value == 1000
    with pytest.raises(FileExistsError):
        store.files.create("observations/manifest-00000002.json", "{}")  # a second writer of the same version
    store.merge("observations", rows(spark, ("r7", 8, 1, "scale", None)))
    assert store.vacuum("observations", keep=1) and store.read("observations").count() == 201


def test_runs_sources_devices_and_status(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    assert state.sync_status(store, "scale")["state"] == "never-synced"
    got = rebuild.ingest(store, {"observations": rows(spark, ("a", 1, 70, "scale", "dev1"), ("b", 2, 71, "scale", "dev1"), ("a", 1, 70, "scale", None))}, "scale")
    assert (got["inserted"], got["updated"], got["duplicate"]) == (2, 1, 0)  # the later copy has another device
    rebuild.ingest(store, {"observations": rows(spark, ("b", 2, 71, "scale", "dev1"))}, "scale")
    assert [(r.name, r.source_type, r.enabled) for r in store.read("sources").collect()] == [("scale", "import", True)]
    assert [(r.source, r.vendor_device_id) for r in store.read("devices").collect()] == [("scale", "dev1")]
    s = state.sync_status(store, "scale")
    assert (s["state"], s["duplicate_count"], s["ok"]) == ("succeeded", 1, True)
    with pytest.raises(Exception, match="broken"):
        rebuild.ingest(store, {"observations": rows(spark, ("c", 1, 1, "scale", None)).withColumn("value", F.raise_error(F.lit("broken")).cast("double"))}, "scale")
    s = state.sync_status(store, "scale")
    assert s["state"] == "failed" and not s["ok"] and store.read("observations").count() == 2 and store.read("sync_state").count() == 0
    assert store.read("ingestion_runs").count() == 3
    d = reports.diagnostics(store.ledgers(), store.read("duplicate_links"), store.read("ingestion_runs")).first()
    assert (d.latest_failed_imports, d.source_import_count, d.status) == (1, 1, "attention")
    state.enable_source(store, "scale", False)
    assert store.ledgers().table("observations").count() == 0 and store.read("observations").count() == 2


def test_links_survive_a_refresh_as_decided(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    state.set_priorities(store, config.priorities(spark, {"weight_kg": ["one", "two"]}))
    store.merge("observations", rows(spark, ("a", 1, 70, "one", None), ("a", 1, 70, "two", None), ("b", 5, 80, "one", None), ("b", 5, 81, "two", None), ("c", 6, 80, "one", None), ("c", 6, 81, "two", None)))
    assert state.refresh_links(store) == {"links": 3, "confirmed": 1, "candidate": 2, "rejected": 0, "stale": 0}
    links = {r.canonical_id: r for r in store.read("duplicate_links").collect()}
    assert set(links) == {"one|a|weight_kg", "one|b|weight_kg", "one|c|weight_kg"} and json.loads(links["one|b|weight_kg"].facts)["seconds_apart"] == 0
    state.resolve(store, links["one|b|weight_kg"].link_id, "rejected")
    hand = schemas.conform(spark.createDataFrame([("h", "observation", "x", "y", "told", 1.0, "confirmed", "user")], "link_id string, record_type string, canonical_id string, duplicate_id string, match_method string, confidence double, resolution string, generated_by string"), schemas.DUPLICATE_LINK)
    store.replace("duplicate_links", store.read("duplicate_links").unionByName(hand))
    store.merge("observations", rows(spark, ("c", 6, 200, "two", None)))  # no longer alike
    assert state.refresh_links(store) == {"links": 3, "confirmed": 2, "candidate": 0, "rejected": 1, "stale": 1}
    again = {r.canonical_id: r for r in store.read("duplicate_links").collect()}
    assert again["one|b|weight_kg"].resolution == "rejected" and again["one|b|weight_kg"].link_id == links["one|b|weight_kg"].link_id and again["one|b|weight_kg"].created_at == links["one|b|weight_kg"].created_at
    with pytest.raises(KeyError):
        state.resolve(store, "none", "confirmed")


class Api(BaseHTTPRequestHandler):
    """Two pages of measure groups by POST, and daily documents by GET."""

    forms: list = []

    def do_POST(self):
        form = {k: v[0] for k, v in parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode()).items()}
        self.forms.append(form)
        last = "offset" in form
        group = {"grpid": 2 if last else 1, "date": 1741080600, "measures": [{"value": 7000 + last, "type": 1, "unit": -2}]}
        self.send({"status": 0, "body": {"timezone": "UTC", "more": 0 if last else 1, "offset": 1, "measuregrps": [group]}})

    def do_GET(self):
        docs = [{"id": "d", "day": "2025-03-04", "timestamp": "2025-03-04T04:00:00+00:00", "steps": 12}] if "daily_activity" in self.path else []
        self.send({"data": docs, "next_token": None}, 500 if self.server.failing and "session" in self.path else 200)

    def send(self, value, status=200):
        body = json.dumps(value).encode()
        self.send_response(status)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def api():
    server = HTTPServer(("127.0.0.1", 0), Api)
    server.failing = False
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()


def test_syncs_move_the_watermark_when_they_succeed(spark, tmp_path, api, monkeypatch):
    monkeypatch.setattr("tidemark.sources.paged_api.LONGEST_WAIT", 0.0)
    url, raw, now = f"http://127.0.0.1:{api.server_port}", str(tmp_path / "raw"), datetime(2025, 3, 5, 12, tzinfo=UTC)
    store = SnapshotStore(spark, str(tmp_path / "s"))
    got = rebuild.sync(store, raw, "withings", url, zone="UTC", now=now)
    assert got["inserted"] == 2 and state.last_end(store, "withings") == now
    assert rebuild.sync(store, raw, "withings", url, zone="UTC", now=now)["duplicate"] == 2
    run = state.sync_status(store, "withings")
    assert run["requested_start"] == datetime(2025, 3, 2, 12, tzinfo=UTC) and run["raw_count"] == 2
    assert rebuild.sync(store, raw, "oura", url, zone="UTC", now=now)["inserted"] == 1
    api.failing = True
    with pytest.raises(OSError, match="refused"):
        rebuild.sync(store, raw, "oura", url, zone="UTC", now=datetime(2025, 3, 9, tzinfo=UTC))
    assert state.last_end(store, "oura") == now and state.sync_status(store, "oura")["state"] == "failed"
    again = rebuild.rebuild(spark, raw, str(tmp_path / "again"), zone="UTC")
    assert again.read("observations").count() == 3 and again.read("ingestion_runs").count() >= 2


def test_dashboard_over_http(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    rebuild.ingest(store, {"observations": rows(spark, ("a", 1, 70, "scale", None))}, "scale")
    server = serve.server(store)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ask = lambda path: json.loads(urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}").read())
    try:
        whole = ask("/api/dashboard?days=30")
        assert set(whole) == {"summary", "daily", "weekly", "rolling", "labs", "days", "quality"}
        assert whole["summary"][0]["name"] == "weight" and round(whole["summary"][0]["value"], 3) == 154.324
        assert whole["quality"]["stale_metric_sources"] == 1 and whole["quality"]["source_runs"][0]["source"] == "scale"
        assert set(ask("/api/dashboard/summary")) == {"summary"}
        for path, status in (("/api/none", 404), ("/api/dashboard?days=8", 400)):
            with pytest.raises(urllib.error.HTTPError, match=str(status)):
                ask(path)
    finally:
        server.shutdown()


def test_command_line(spark, tmp_path, capsys):
    def run(*args):
        code = main(["--store", str(tmp_path / "s"), "--zone", "UTC", "--priorities", str(tmp_path / "p.yaml"), *args])
        return code, capsys.readouterr().out.strip().splitlines()

    (tmp_path / "p.yaml").write_text("workouts: [manual, apple_health]\n")
    assert run("init") == (0, ['{"tables": 12, "priorities": 2}'])
    assert json.loads(run("lift", "40", "--date", "2025-03-04", "--rpe", "7")[1][0])["inserted"] == 1
    assert json.loads(run("alcohol", "2", "--date", "2025-03-04")[1][0])["inserted"] == 1
    assert json.loads(run("event", "Travel", "--date", "2025-03-05", "--hours", "3")[1][0])["inserted"] == 1
    assert json.loads(run("workout", "rowing", "30", "--date", "2025-03-05", "--time", "07:30")[1][0])["inserted"] == 1
    code, lines = run("status", "manual")
    assert code == 0 and json.loads(lines[0])["state"] == "succeeded"
    code, lines = run("doctor")
    assert code == 0 and "PASS source priorities: current" in lines and any(x.startswith("PASS sleep rollups") for x in lines)
    assert json.loads(run("duplicates", "refresh")[1][0])["links"] == 0 and run("duplicates", "list") == (0, [])
    day = {json.loads(x)["local_date"]: json.loads(x) for x in run("view", "daily_health")[1]}
    assert day["2025-03-04"]["resistance_minutes"] == 40 and day["2025-03-04"]["alcohol_units"] == 2
    (tmp_path / "l.csv").write_text("Test,Result\nIron,12\n")
    (tmp_path / "b.yaml").write_text("biomarkers:\n  iron: [Fe]\n")
    assert json.loads(run("preview-labs", str(tmp_path / "l.csv"), "--biomarkers", str(tmp_path / "b.yaml"))[1][0]) == {"rows": 1, "recognized": 1, "unknown": []}
    assert json.loads(run("quality")[1][0])["status"] == "clear"
    assert json.loads(run("dashboard", "--days", "7")[1][0])["days"] == 7
