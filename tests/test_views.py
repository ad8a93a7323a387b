from datetime import UTC, date, datetime, timedelta

import pytest

from tidemark import schemas
from tidemark.operators import merge
from tidemark.plans import duplicates, reports, views
from tidemark.plans.views import Ledgers
from tidemark.sources import config


def at(text):
    return datetime.fromisoformat(text).replace(tzinfo=UTC)


def frame(spark, ledger, rows):
    names = list(dict.fromkeys(k for r in rows for k in r))
    schema = schemas.LEDGERS[ledger]
    kind = ", ".join(f"{n} {schema[n].dataType.simpleString()}" for n in names)
    return schemas.conform(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], kind), schema)


def obs(i, metric, source, when, value, quality="valid", day=None):
    return {"metric": metric, "observed_at": at(when), "value": float(value), "unit": "u", "quality": quality, "local_date": day or at(when).date(), "source": source, "source_record_id": f"o{i}"}


def bp(i, source, when, s, d, p):
    return {"measured_at": at(when), "local_date": at(when).date(), "systolic_mmhg": float(s), "diastolic_mmhg": float(d), "pulse_bpm": float(p), "quality": "valid", "source": source, "source_record_id": f"b{i}"}


def workout(i, source, start, kind, seconds):
    return {"started_at": at(start), "ended_at": at(start) + timedelta(seconds=seconds), "local_date": at(start).date(), "workout_type": kind, "duration_seconds": seconds, "source": source, "source_record_id": f"w{i}"}


@pytest.fixture(scope="module")
def golden(spark):
    order = {"weight_kg": ["withings", "apple_health"], "steps": ["oura", "apple_health"], "blood_pressure": ["withings", "apple_health"], "sleep": ["oura", "eight_sleep", "apple_health"], "workouts": ["manual", "oura", "apple_health"]}
    o = [
        obs(1, "weight_kg", "withings", "2026-09-10T12:00", 80), obs(2, "weight_kg", "withings", "2026-09-10T13:00", 79), obs(3, "weight_kg", "apple_health", "2026-09-10T14:00", 81), obs(4, "weight_kg", "disabled", "2026-09-10T15:00", 70),
        obs(5, "weight_kg", "withings", "2026-09-11T12:00", 78, "suspect"), obs(6, "weight_kg", "apple_health", "2026-09-11T12:00", 77),
        obs(7, "steps", "oura", "2026-09-10T10:00", 1000), obs(8, "steps", "oura", "2026-09-10T11:00", 2000), obs(9, "steps", "apple_health", "2026-09-10T11:00", 9000),
    ]
    b = [bp(1, "withings", "2026-09-10T12:00", 140, 90, 65), bp(2, "withings", "2026-09-10T12:05", 130, 80, 60), bp(3, "withings", "2026-09-10T12:20", 120, 75, 58), bp(4, "apple_health", "2026-09-10T12:03", 110, 70, 55)]
    night = {"sleep_date": date(2026, 9, 10), "started_at": at("2026-09-09T23:00"), "ended_at": at("2026-09-10T07:00")}
    s = [night | {"total_sleep_seconds": 25200, "resting_hr_bpm": 52.0, "average_hrv_rmssd_ms": 45.0, "source": "oura", "source_record_id": "s1"}, night | {"total_sleep_seconds": 27000, "source": "eight_sleep", "source_record_id": "s2"}]
    w = [workout(1, "manual", "2026-09-10T16:00", "resistance", 3300), workout(2, "oura", "2026-09-10T16:00", "resistance", 2700), workout(3, "oura", "2026-09-10T18:00", "running", 1800), workout(4, "apple_health", "2026-09-10T18:00", "running", 2100)]
    e = [{"event_type": "alcohol", "started_at": at("2026-09-10T20:00"), "local_date": date(2026, 9, 10), "value": 2.0, "source": "manual", "source_record_id": "e1"}]
    w[2]["source"] = "oura"
    tables = {k: frame(spark, k, v) for k, v in {"observations": o, "blood_pressure": b, "sleep_sessions": s, "workouts": w, "events": e}.items()}
    return Ledgers(spark, tables, config.priorities(spark, order), ("disabled",))


def test_source_selection_and_sessions(golden):
    got = sorted((str(r.canonical_date), r.source, r.value) for r in views.canonical_observations(golden).where("metric = 'weight_kg'").collect())
    assert got == [("2026-09-10", "withings", 79.0), ("2026-09-10", "withings", 80.0), ("2026-09-11", "apple_health", 77.0)]
    rows = sorted((r.session_number, r.reading_count, r.first_systolic_mmhg, r.subsequent_systolic_mmhg, r.preferred_systolic_mmhg) for r in views.blood_pressure_sessions(golden).collect())
    assert rows == [(1, 2, 140.0, 130.0, 130.0), (2, 1, 120.0, None, 120.0)]


def test_daily_row(golden):
    day = {str(r.local_date): r for r in views.daily_health(golden).collect()}["2026-09-10"]
    assert (day.weight_kg, day.steps, day.systolic_mmhg, day.diastolic_mmhg) == (79.0, 3000.0, 125.0, 77.5)
    assert (day.blood_pressure_session_count, day.blood_pressure_reading_count, day.total_sleep_minutes) == (2, 3, 420.0)
    assert (day.resting_hr_bpm, day.hrv_rmssd_ms, day.resistance_minutes) == (52.0, 45.0, 55.0)
    assert (day.alcohol_units, day.event_types, day.source_name) == (2.0, "alcohol", "oura")


def test_interval_merge(spark):
    def part(i, start, end, stage, column, day):
        a, b = at(f"2026-09-{start}"), at(f"2026-09-{end}")
        return {"sleep_date": day, "started_at": a, "ended_at": b, f"{column}_seconds": int((b - a).total_seconds()), "stage": stage, "source": "apple_health", "source_record_id": f"s{i}"} | ({"total_sleep_seconds": int((b - a).total_seconds())} if column in ("light", "deep", "rem") else {})

    late, early = date(2026, 9, 10), date(2026, 9, 9)
    rows = [
        part(1, "10T02:00", "10T10:30", "InBed", "time_in_bed", late), part(2, "10T02:30", "10T03:30", "AsleepCore", "light", early), part(3, "10T03:00", "10T05:30", "AsleepCore", "light", late),
        part(4, "10T05:30", "10T07:00", "AsleepDeep", "deep", late), part(5, "10T07:00", "10T10:00", "AsleepREM", "rem", late), part(6, "10T10:00", "10T10:30", "Awake", "awake", late),
    ]
    got = views.canonical_sleep_daily(Ledgers(spark, {"sleep_sessions": frame(spark, "sleep_sessions", rows)})).collect()
    assert len(got) == 1 and got[0].local_date == late
    assert [got[0][m] for m in ("total_sleep_minutes", "time_in_bed_minutes", "awake_minutes", "light_sleep_minutes", "deep_sleep_minutes", "rem_sleep_minutes")] == [450, 510, 30, 180, 90, 180]


@pytest.fixture(scope="module")
def rollup(spark):
    day = lambda d: f"2026-{d}T12:00"
    o = [obs(i, m, "x", day(d), v) for i, (m, d, v) in enumerate([("weight_kg", "08-31", 80), ("weight_kg", "09-06", 79), ("weight_kg", "09-10", 78), *[("steps", d, v) for d, v in (("08-31", 5000), ("09-01", 7000), ("09-06", 9000), ("09-07", 8000), ("09-10", 10000))], *[("hrv_rmssd_ms", d, v) for d, v in (("09-01", 42), ("09-07", 48), ("09-10", 50))], *[("resting_hr_bpm", d, v) for d, v in (("09-01", 54), ("09-07", 51), ("09-10", 50))]])]
    b = [bp(1, "x", day("09-01"), 120, 75, 60), bp(2, "x", day("09-10"), 116, 72, 60)]
    s = [{"sleep_date": date(2026, 9, d), "started_at": at(f"2026-09-{d:02}T00:00"), "ended_at": at(f"2026-09-{d:02}T08:00"), "total_sleep_seconds": v, "source": "x", "source_record_id": f"s{d}"} for d, v in ((1, 25200), (7, 27000), (10, 28800))]
    w = [workout(1, "x", day("08-31"), "resistance", 3600), workout(2, "x", day("09-08"), "resistance", 3300), workout(3, "x", day("09-10"), "running", 1800)]
    led = Ledgers(spark, {k: frame(spark, k, v) for k, v in {"observations": o, "blood_pressure": b, "sleep_sessions": s, "workouts": w}.items()})
    return views.health_calendar(views.daily_health(led)).persist()


def test_calendar_and_weeks(rollup):
    rows = rollup.collect()
    assert len(rows) == 11 and sum(r.weight_kg is not None for r in rows) == 3
    empty = next(r for r in rows if str(r.local_date) == "2026-09-04")
    assert all(empty[c] is None for c in rollup.columns if c not in ("local_date", "subject_id"))
    weeks = sorted((str(r.week_start), str(r.week_end), r.calendar_days, r.weight_kg_avg, r.steps_total, r.exercise_minutes_total, r.exercise_days) for r in views.weekly_health(rollup).collect())
    assert weeks == [("2026-08-31", "2026-09-06", 7, 79.5, 21000, 60, 1), ("2026-09-07", "2026-09-13", 4, 78.0, 18000, 85, 2)]


def test_rolling(rollup):
    full = {(str(r.anchor_date), r.window_days): r for r in views.rolling_health(rollup).collect()}
    latest = {r.window_days: r for r in views.rolling_health_latest(rollup).collect()}
    week = full["2026-09-10", 7]
    assert (week.calendar_days, week.weight_kg_avg, week.systolic_mmhg_avg, week.hrv_rmssd_ms_avg, week.resting_hr_bpm_avg, week.total_sleep_minutes_avg, week.steps_total, week.steps_daily_avg, week.exercise_minutes_total) == (7, 78.5, 116, 49, 50.5, 465, 27000, 9000, 85)
    assert str(full["2026-09-10", 30].window_start) == "2026-08-12" and [full["2026-09-10", n].calendar_days for n in (30, 90, 365)] == [11] * 3
    for n, r in latest.items():
        assert all(r[c] == full["2026-09-10", n][c] for c in r.asDict())


def test_relationships(spark):
    drinks, sleep, o, b, s, w, e = [0, 1, 3, 0, 2, 0], 480, [], [], [], [], []
    for i, units in enumerate(drinks):
        prev, day = drinks[i - 1] if i else 0, f"2026-09-0{i + 1}T12:00"
        o += [obs(f"a{i}", "weight_kg", "x", day, 80 + i), obs(f"b{i}", "resting_hr_bpm", "x", day, 50 + prev), obs(f"c{i}", "hrv_rmssd_ms", "x", day, 55 - 2 * prev)]
        b.append(bp(i, "x", day, 118 + i, 72 + i, 60))
        s.append({"sleep_date": at(day).date(), "started_at": at(day), "ended_at": at(day), "total_sleep_seconds": (sleep - 20 * prev) * 60, "source": "x", "source_record_id": f"s{i}"})
        w.append(workout(i, "x", day, "resistance", i * 600))
        e.append({"event_type": "alcohol", "started_at": at(day), "local_date": at(day).date(), "value": float(units), "source": "x", "source_record_id": f"e{i}"})
    led = Ledgers(spark, {k: frame(spark, k, v) for k, v in {"observations": o, "blood_pressure": b, "sleep_sessions": s, "workouts": w, "events": e}.items()})
    got = {r.relationship: r for r in reports.relationship_report(views.analysis_daily_lagged(views.health_calendar(views.daily_health(led)))).collect()}
    assert len(got) == 11 and all(r.n >= 3 for r in got.values())
    assert got["alcohol-sleep"].n == 5 and abs(got["alcohol-sleep"].r + 1) < 1e-9 and got["alcohol-sleep"].ci_low is not None
    assert got["weight-systolic"].n == 6 and got["exercise-hrv"].n == 5


def test_empty_ledger(spark):
    led = Ledgers(spark)
    cal = views.health_calendar(views.daily_health(led))
    assert cal.count() == 0 and views.rolling_health(cal).count() == 0
    none = spark.createDataFrame([], schemas.DUPLICATE_LINK)
    d = reports.diagnostics(led, none, spark.createDataFrame([], schemas.INGESTION_RUNS)).first()
    assert d.status == "empty" and d.suspect_records == 0 and d.sleep_over_24h == 0


def test_duplicate_links(spark):
    copy = obs(2, "weight_kg", "apple_health", "2026-09-10T12:00:30", 80.0) | {"metadata": '{"apple_health": {"source_name": "Withings"}}'}
    o = [obs(1, "weight_kg", "withings", "2026-09-10T12:00:00", 80.0), copy, obs(3, "weight_kg", "oura", "2026-09-10T12:02:00", 81.6)]
    w = [workout(1, "manual", "2026-09-10T16:00", "resistance", 3300), workout(2, "apple_health", "2026-09-10T16:02", "resistance", 52 * 60)]
    order = config.priorities(spark, {"weight_kg": ["withings", "apple_health", "oura"], "workouts": ["manual", "apple_health"]})
    led = Ledgers(spark, {"observations": frame(spark, "observations", o), "workouts": frame(spark, "workouts", w)}, order)
    none = spark.createDataFrame([], schemas.DUPLICATE_LINK)
    links = duplicates.refresh(led, none)
    got = {(r.match_method, r.canonical_id.split("|")[0]): r for r in links.collect()}
    assert got["apple_provenance", "withings"].resolution == "confirmed"
    assert got["workout_overlap", "manual"].resolution == "confirmed"
    assert [r.resolution for k, r in got.items() if k[0] == "heuristic"]
    rejected = merge.resolve_link(links, links["match_method"] == "apple_provenance", "rejected")
    again = {r.match_method: r.resolution for r in duplicates.refresh(led, rejected).where("match_method = 'apple_provenance'").collect()}
    assert again == {"apple_provenance": "rejected"}
