import json
from datetime import UTC, date, datetime, time

import pytest

from tidemark import schemas
from tidemark.__main__ import main
from tidemark.plans import rebuild
from tidemark.plans.export import SnapshotStore
from tidemark.sources import manual, raw_store

NOW = datetime(2026, 3, 10, 1, 30, 20, tzinfo=UTC)
ZONE = "America/Sao_Paulo"


def test_documents():
    ended = manual.workout_document("Mobility", 45, ZONE, focus="  ", notes=" quiet ", now=NOW)
    assert ended["started_at"] == "2026-03-09T21:45:00-03:00" and ended["ended_at"] == "2026-03-09T22:30:00-03:00"
    assert ended["local_date"] == "2026-03-09" and ended["focus"] is None and ended["notes"] == "quiet" and ended["workout_type"] == "mobility"
    begun = manual.workout_document("rucking", 45, ZONE, day=date(2026, 3, 1), now=NOW)
    assert begun["started_at"] == "2026-03-01T22:30:00-03:00" and begun["local_date"] == "2026-03-01"
    at = lambda **o: manual.event_document("diet change", ZONE, day=date(2026, 3, 1), at=time(7, 15), now=NOW, **o)
    assert at()["event_type"] == "diet_change" and at(hours=1.5)["ended_at"] == "2026-03-01T08:45:00-03:00"
    assert at()["source_record_id"] == {**at(), "created_at": None}["source_record_id"] != at(value=2.0)["source_record_id"]
    assert manual.event_document("alcohol", "UTC", value=2, now=NOW)["unit"] == "drinks"


@pytest.mark.parametrize(
    "wrong",
    [
        lambda: manual.workout_document("archery", 30, "UTC"),
        lambda: manual.workout_document("running", 0, "UTC"),
        lambda: manual.workout_document("running", 1441, "UTC"),
        lambda: manual.workout_document("running", 30, "UTC", rpe=10.5),
        lambda: manual.workout_document("running", 30, "UTC", now=datetime(2026, 1, 1)),
        lambda: manual.event_document("party", "UTC"),
        lambda: manual.event_document("alcohol", "UTC"),
        lambda: manual.event_document("alcohol", "UTC", value=-1),
        lambda: manual.event_document("travel", "UTC", hours=9000),
        lambda: manual.event_document("other", "UTC", value=float("nan")),
    ],
)
def test_wrong_entries(wrong):
    with pytest.raises(ValueError):
        wrong()


@pytest.mark.parametrize(
    ("endpoint", "change", "fault"),
    [
        (manual.WORKOUTS, {"more": 1}, "more"),
        (manual.WORKOUTS, {"schema_version": 2}, "schema_version"),
        (manual.WORKOUTS, {"duration_seconds": 60}, "duration_seconds"),
        (manual.WORKOUTS, {"started_at": "2026-03-09T22:00:00"}, "started_at"),
        (manual.WORKOUTS, {"focus": "x" * 201}, "focus"),
        (manual.WORKOUTS, {"source_record_id": ""}, "source_record_id"),
        (manual.EVENTS, {"event_type": "alcohol"}, "value"),
        (manual.EVENTS, {"ended_at": "2026-01-01T00:00:00Z"}, "ended_at"),
        (manual.EVENTS, {"local_date": "soon"}, "local_date"),
    ],
)
def test_documents_that_do_not_hold_to_their_form(spark, endpoint, change, fault):
    good = manual.workout_document("running", 30, ZONE, now=NOW) if endpoint == manual.WORKOUTS else manual.event_document("travel", ZONE, now=NOW)
    assert manual.rows_of(spark, endpoint, good).count() == 1
    with pytest.raises(Exception, match=f"not a manual [a-z]+: .*{fault}"):
        manual.rows_of(spark, endpoint, good | change).collect()


def test_entries_are_kept_raw_and_rebuilt(spark, tmp_path):
    store, raw = SnapshotStore(spark, str(tmp_path / "s")), str(tmp_path / "raw")
    run = manual.workout_document("rucking", 50, ZONE, focus="hills", rpe=6.5, now=NOW)
    assert rebuild.enter(store, raw, manual.WORKOUTS, run)["inserted"] == 1
    assert rebuild.enter(store, raw, manual.WORKOUTS, run)["duplicate"] == 1
    assert rebuild.enter(store, raw, manual.EVENTS, manual.event_document("travel", ZONE, hours=5, now=NOW))["inserted"] == 1
    again = rebuild.rebuild(spark, raw, str(tmp_path / "again"), zone="UTC", priorities=spark.createDataFrame([("workouts", "manual", 1)], schemas.SOURCE_PRIORITY))
    for ledger in ("workouts", "events"):
        a, b = ([r.asDict() | {"ingestion_run_id": None, "raw_file": None} for r in s.read(ledger).collect()] for s in (store, again))
        assert a == b and len(a) == 1
    w = again.read("workouts").first()
    assert (w.workout_type, w.duration_seconds, w.local_date, w.rpe, w.transform_version) == ("rucking", 3000, date(2026, 3, 9), 6.5, "manual-workout-v1")
    assert json.loads(w.metadata) == {"manual": {"entry_schema_version": 1, "focus": "hills"}}
    assert again.read("sources").first().source_type == "manual" and again.read("source_priorities").count() == 1
    assert {k: rebuild.totals(again)[k] for k in ("raw", "inserted", "duplicate", "rejected")} == {"raw": 3, "inserted": 2, "duplicate": 1, "rejected": 0}
    assert "hills" not in json.dumps([r.asDict() for r in raw_store.listing(spark, raw).collect()], default=str)


def test_a_rebuild_takes_all_or_nothing(spark, tmp_path):
    raw, target = str(tmp_path / "raw"), tmp_path / "s"
    raw_store.save(raw, "withings", "export/archive", b"PK", extension="zip", content_type="application/zip")
    with pytest.raises(ValueError, match="no artifacts"):
        rebuild.rebuild(spark, raw, str(target), zone="UTC")
    good = manual.event_document("travel", ZONE, now=NOW)
    raw_store.save(raw, "manual", manual.EVENTS, manual.written(good))
    assert rebuild.rebuild(spark, raw, str(tmp_path / "fine"), zone="UTC").read("events").count() == 1  # the archive is passed over
    with pytest.raises(FileExistsError):
        rebuild.rebuild(spark, raw, str(tmp_path / "fine"), zone="UTC")
    raw_store.save(raw, "manual", manual.WORKOUTS, manual.written(good))  # no workout, and found out after the events of an API
    page = {"data": [{"id": "a", "day": "2025-03-04", "timestamp": "2025-03-04T04:00:00-03:00", "steps": 5}], "next_token": None}
    raw_store.save(raw, "oura", "daily_activity", json.dumps(page).encode())
    with pytest.raises(Exception, match="not a manual workout"):
        rebuild.rebuild(spark, raw, str(target), zone="UTC")
    assert not target.exists()
    raw_store.save(raw, "manual", "manual/dream", b"{}")
    raw_store.save(raw, "stranger", "x", b"{}")
    with pytest.raises(ValueError, match="no route for manual manual/dream, stranger x"):
        rebuild.rebuild(spark, raw, str(target), zone="UTC")


def test_entries_from_the_command_line(spark, tmp_path, capsys):
    def run(*args):
        code = main(["--store", str(tmp_path / args[0]), "--zone", ZONE, *args[1:]])
        return code, [json.loads(x) for x in capsys.readouterr().out.strip().splitlines()]

    entry = ("s", "workout", "rucking", "30", "--date", "2026-03-01", "--time", "07:15", "--focus", "hills", "--raw", str(tmp_path / "raw"))
    assert run(*entry)[1][0]["inserted"] == 1 and run(*entry)[1][0]["duplicate"] == 1
    assert run("s", "alcohol", "2.5", "--date", "2026-03-01", "--raw", str(tmp_path / "raw"))[1][0]["inserted"] == 1
    code, said = run("again", "rebuild", str(tmp_path / "raw"))
    assert code == 0 and said[0]["raw"] == 3 and said[0]["rejected"] == 0
    day = run("again", "view", "daily_health")[1][0]
    assert day["local_date"] == "2026-03-01" and day["cardio_minutes"] == 30 and day["alcohol_units"] == 2.5


def test_bounds_of_the_ledgers(spark):
    def refused(ledger, schema, **change):
        fields = {"workouts": {"started_at": NOW, "ended_at": NOW, "workout_type": "rucking", "duration_seconds": 0}, "sleep_sessions": {"sleep_date": date(2026, 1, 1), "started_at": NOW, "ended_at": NOW}, "lab_results": {"original_name": "iron", "text_value": "low"}}[ledger]
        row = {"source": "s", "source_record_id": "1", **fields, **change}
        one = spark.createDataFrame([tuple(row.get(f.name) for f in schema)], schema)
        return schemas.judge(one, ledger).first().reasons

    sleep, work, lab = schemas.SLEEP_SESSION, schemas.WORKOUT, schemas.LAB_RESULT
    assert refused("workouts", work) == refused("sleep_sessions", sleep) == refused("lab_results", lab) == []
    assert refused("workouts", work, distance_m=-1.0, average_hr_bpm=0.0, energy_kcal=float("nan"), rpe=11.0) == ["rpe", "distance_m", "energy_kcal", "average_hr_bpm"]
    assert refused("workouts", work, workout_type="archery", duration_seconds=None) == ["workout_type", "duration_seconds"]
    assert refused("sleep_sessions", sleep, efficiency_pct=101.0, latency_seconds=-1, sleep_score=-1.0, respiratory_rate=0.0, ended_at=None) == ["ended_at", "latency_seconds", "efficiency_pct", "sleep_score", "respiratory_rate"]
    assert refused("lab_results", lab, text_value="", source="") == ["source", "value"]
    assert refused("lab_results", lab, reference_low=9.0, reference_high=1.0) == [] and refused("lab_results", lab, reference_low=float("inf")) == ["reference_low"]
