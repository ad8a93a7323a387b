import json
import zipfile
from datetime import UTC, date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.plans.export import SnapshotStore, export_datasets
from tidemark.plans.rebuild import ingest, normalize, rebuild, sync_window
from tidemark.sources import apple_health, labs, manual, raw_store, withings

XML = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE HealthData [<!ELEMENT HealthData ANY>]>
<HealthData locale="pt_BR">
 <Record type="HKQuantityTypeIdentifierBodyMass" sourceName="Bathroom" sourceVersion="7" device="scale two" unit="lb" creationDate="2025-03-04 07:11:00 -0300" startDate="2025-03-03 22:41:00 -0300" endDate="2025-03-03 22:41:00 -0300" value="140"><MetadataEntry key="shelf" value="left"/></Record>
 <Record type="HKQuantityTypeIdentifierRestingHeartRate" sourceName="Wrist" unit="count/min" creationDate="2025-03-04 07:11:00 -0300" startDate="2025-03-04 05:00:00 -0300" endDate="2025-03-04 05:00:00 -0300" value="47"/>
 <Record type="HKCategoryTypeIdentifierSleepAnalysis" sourceName="Wrist" creationDate="2025-03-04 07:11:00 -0300" startDate="2025-03-03 23:20:00 -0300" endDate="2025-03-04 05:05:00 -0300" value="HKCategoryValueSleepAnalysisAsleepDeep"/>
 <Record type="HKQuantityTypeIdentifierBloodPressureSystolic" sourceName="Band" unit="mmHg" creationDate="2025-03-04 07:11:00 -0300" startDate="2025-03-04 06:50:00 -0300" endDate="2025-03-04 06:50:00 -0300" value="131"/>
 <Record type="HKQuantityTypeIdentifierBloodPressureDiastolic" sourceName="Band" unit="mmHg" creationDate="2025-03-04 07:11:00 -0300" startDate="2025-03-04 06:50:00 -0300" endDate="2025-03-04 06:50:00 -0300" value="86"/>
 <Record type="HKQuantityTypeIdentifierDietaryCaffeine" sourceName="Diary" unit="mg" creationDate="2025-03-04 07:11:00 -0300" startDate="2025-03-04 06:55:00 -0300" endDate="2025-03-04 06:55:00 -0300" value="95"/>
 <Workout workoutActivityType="HKWorkoutActivityTypeRowing" duration="25" durationUnit="min" sourceName="Wrist" creationDate="2025-03-04 19:00:00 -0300" startDate="2025-03-04 18:10:00 -0300" endDate="2025-03-04 18:35:00 -0300" totalEnergyBurned="215" totalEnergyBurnedUnit="kcal"/>
</HealthData>
"""
ZONE = "America/Sao_Paulo"  # three hours behind UTC all year


def test_apple_xml(spark, tmp_path):
    archive = tmp_path / "e.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("apple_health_export/export.xml", XML)
    (path,) = apple_health.stage_zips(spark, [str(archive)], str(tmp_path / "staged"))
    got = normalize(spark, "apple_health", path, zone=ZONE)
    o = {r.metric: r for r in got["observations"].collect()}
    assert abs(o["weight_kg"].value - 140 * 0.45359237) < 1e-6 and o["weight_kg"].local_date == date(2025, 3, 3) and o["weight_kg"].timezone == "UTC-03:00"
    assert o["resting_hr_bpm"].value == 47 and len(o) == 2
    s = got["sleep_sessions"].first()
    assert (s.deep_seconds, s.total_sleep_seconds, s.sleep_date) == (20700, 20700, date(2025, 3, 4))
    b = got["blood_pressure"].first()
    assert (b.systolic_mmhg, b.diastolic_mmhg, b.quality) == (131, 86, "valid")
    w = got["workouts"].first()
    assert (w.workout_type, w.duration_seconds, w.energy_kcal) == ("rowing", 1500, 215)
    store = SnapshotStore(spark, str(tmp_path / "store"))
    first = ingest(store, got, "apple_health")
    assert {k: first[k] for k in ("inserted", "updated", "duplicate", "rejected")} == {"inserted": 5, "updated": 0, "duplicate": 0, "rejected": 0}
    assert ingest(store, normalize(spark, "apple_health", path, zone=ZONE), "apple_health")["duplicate"] == 5


def test_lonely_pressure_record_is_an_error(spark, tmp_path):
    lines = [x for x in XML.splitlines() if "Diastolic" not in x]
    (tmp_path / "x.xml").write_text("\n".join(lines))
    with pytest.raises(Exception, match="without its pair"):
        normalize(spark, "apple_health", str(tmp_path / "x.xml"), zone=ZONE)["blood_pressure"].collect()


BODY_CSV = "\ufeffDate;Weight (kg);Fat mass (lbs);Hydration;Body fat (%);Comments\n2025-03-04 06:30:00;63,5;20;35;14,5;before tea\n2025-03-04 06:30:00;;;34,5;;\n"
PRESSURE_CSV = "Date,Heart rate (bpm),Systolic,Diastolic,Comment\n2025-03-04 06:50:00,58,131,86,seated\n2025-03-04 07:30:00,66,,,\n"


def test_withings_csv(spark, tmp_path):
    (tmp_path / "w.csv").write_text(BODY_CSV)
    (tmp_path / "b.csv").write_text(PRESSURE_CSV)
    rows = normalize(spark, "withings_export", str(tmp_path / "w.csv"), zone=ZONE)["observations"].collect()
    by = {(r.metric, r.source_record_id[-2:] == ":2"): r for r in rows}
    assert {k: round(r.value, 6) for k, r in by.items()} == {("weight_kg", False): 63.5, ("body_fat_mass_kg", False): 9.071847, ("body_water_mass_kg", False): 35.0, ("body_fat_pct", False): 14.5, ("body_water_mass_kg", True): 34.5}
    first = by["weight_kg", False]
    assert first.observed_at == datetime(2025, 3, 4, 9, 30) and first.source_record_id == "export:weight:2025-03-04T09:30:00+00:00"
    b = normalize(spark, "withings_export", str(tmp_path / "b.csv"), zone=ZONE)["blood_pressure"].collect()
    assert [(r.systolic_mmhg, r.diastolic_mmhg, r.pulse_bpm, r.notes) for r in b] == [(131, 86, 58, "seated")]
    assert withings.head_of("Date\tWeight (kg)") == ("\t", ["Date", "Weight (kg)"])
    assert [withings.field_of(h) for h in ("Weight (stone)", " BONE  mass (lb)", "Fat ratio", "Systolic (mmHg)", "Shoe size")] == [(None, None), (88, "lb"), (6, "%"), ("systolic", None), (None, None)]


def test_withings_folder_and_archive(spark, tmp_path):
    folder = tmp_path / "export" / "deep"
    folder.mkdir(parents=True)
    for name, text in (("a.csv", BODY_CSV), ("b.CSV", PRESSURE_CSV), ("c.csv", "Date,Shoe size\n2025-03-04,40\n"), ("d.txt", "nothing")):
        (folder / name).write_text(text)
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        for f in folder.iterdir():
            z.write(f, f"../{f.name}")
    for got in (normalize(spark, "withings_export", str(tmp_path / "export"), zone=ZONE), normalize(spark, "withings_export", str(tmp_path / "e.zip"), zone=ZONE, staging=str(tmp_path / "staged"))):
        assert {k: v.count() for k, v in got.items()} == {"observations": 5, "blood_pressure": 1}


def test_withings_api(spark, tmp_path):
    group = {"grpid": 9, "date": 1741080600, "attrib": 2, "category": 1, "deviceid": "q", "measures": [{"value": 6350, "type": 1, "unit": -2}, {"value": 145, "type": 6, "unit": -1}]}
    pressure = {"grpid": 10, "date": 1741081800, "measures": [{"value": 131, "type": 10, "unit": 0}, {"value": 86, "type": 9, "unit": 0}, {"value": 58, "type": 11, "unit": 0}]}
    odd = {"date": 1741082000, "timezone": "Sea/Atlantis", "measures": [{"value": 7, "type": 1, "unit": 2}]}
    page = {"status": 0, "body": {"timezone": ZONE, "more": 0, "offset": 0, "measuregrps": [group, pressure, odd]}}
    (tmp_path / "p.json").write_text(json.dumps(page))
    got = normalize(spark, "withings_api", str(tmp_path / "p.json"), zone=ZONE)
    o = {r.source_record_id + r.metric: r for r in got["observations"].collect()}
    assert o["9weight_kg"].value == 63.5 and o["9body_fat_pct"].value == 14.5 and o["9weight_kg"].original_unit == "10^-2 kg"
    bad = next(r for k, r in o.items() if k.startswith("missing-grpid:1741082000:"))
    assert (bad.quality, bad.timezone, bad.value) == ("suspect", None, 700.0)
    assert [(r.systolic_mmhg, r.diastolic_mmhg, r.pulse_bpm, r.quality) for r in got["blood_pressure"].collect()] == [(131, 86, 58, "valid")]


def test_oura(spark, tmp_path):
    def page(name, docs):
        (tmp_path / f"{name}.json").write_text(json.dumps({"data": docs, "next_token": None}))
        return normalize(spark, "oura", str(tmp_path / f"{name}.json"), zone=ZONE, endpoint=f"/v2/usercollection/{name}")

    night = {"id": "z1", "bedtime_start": "2025-03-03T23:00:00-03:00", "bedtime_end": "2025-03-04T07:00:00-03:00", "day": "2025-03-04", "time_in_bed": 28800, "awake_time": 7200, "average_heart_rate": 0, "average_hrv": 51}
    s = page("sleep", [night])["sleep_sessions"].first()
    assert (s.total_sleep_seconds, s.efficiency_pct, s.resting_hr_bpm, s.average_hrv_rmssd_ms) == (21600, 75.0, None, 51.0)
    a = {r.metric: r.value for r in page("daily_activity", [{"id": "z2", "day": "2025-03-04", "timestamp": "2025-03-04T04:00:00-03:00", "steps": 4321, "active_calories": 222, "non_wear_time": 1800}])["observations"].collect()}
    assert a == {"steps": 4321.0, "active_energy_kcal": 222.0, "non_wear_minutes": 30.0}
    h = page("heartrate", [{"bpm": 73, "source": "rest", "timestamp": "2025-03-04T09:15:00+00:00"}])["observations"].first()
    assert h.source_record_id == "heart-rate:2025-03-04T09:15:00+00:00:rest"
    w = page("workout", [{"id": "z3", "activity": "Indoor_Cycling", "start_datetime": "2025-03-04T09:00:00Z", "end_datetime": "2025-03-04T09:20:00Z"}])["workouts"].first()
    assert (w.workout_type, w.duration_seconds) == ("cycling", 1200)
    e = page("session", [{"id": "z4", "type": "rest", "start_datetime": "2025-03-04T15:00:00Z", "end_datetime": "2025-03-04T15:05:00Z"}])["events"].first()
    assert e.event_type == "oura_session"


def test_labs(spark, tmp_path):
    (tmp_path / "l.csv").write_text('Marker,Result value,Units,Normal range,Collection date,Reported date,Status,Facility,Fasted\nFerritin,"2,050",ug/L,<300,2025-02-03,2025-02-05,H,North,yes\nVitamin-D (25 OH),61,nmol/L,50-125,2025-02-03,,,North,no\nSelenium,1.1,umol/L,,2025-02-03,,,,\nColour,straw,,,2025-02-03,,,,\n')
    results = normalize(spark, "labs", str(tmp_path / "l.csv"), zone=ZONE, biomarkers={"ferritin": [], "vitamin_d": ["Vitamin D 25-OH"]})["lab_results"]
    counts, unknown = labs.preview(results)
    assert counts == {"rows": 4, "recognized": 2} and unknown == ["Colour", "Selenium"]
    by = {r.original_name: r for r in results.collect()}
    assert (by["Ferritin"].numeric_value, by["Ferritin"].reference_high, by["Ferritin"].reference_low, by["Ferritin"].fasting) == (2050.0, 300.0, None, True)
    assert by["Colour"].text_value == "straw" and by["Vitamin-D (25 OH)"].collected_at == datetime(2025, 2, 3, 15, 0)
    assert labs.resolve_headers(spark, ["Test Name", "Name", "Result"]) == {"name": "Name", "value": "Result"}
    with pytest.raises(ValueError, match="several"):
        labs.vocabulary(spark, {"one": ["Same"], "two": ["same!"]})
    with pytest.raises(ValueError, match="value"):
        labs.resolve_headers(spark, ["Name"])


def test_store_rebuild_export(spark, tmp_path):
    raw, root = tmp_path / "raw", tmp_path / "live"
    page = {"data": [{"id": "a", "day": "2025-03-04", "timestamp": "2025-03-04T04:00:00-03:00", "steps": 5}], "next_token": None}
    raw_store.save(str(raw), "oura", "daily_activity", json.dumps(page).encode(), request_metadata={"access_token": "x", "page": 1})
    store = rebuild(spark, str(raw), str(root), zone=ZONE)
    assert store.read("observations").count() == 1
    page["data"][0]["steps"] = 7
    raw_store.save(str(raw), "oura", "daily_activity", json.dumps(page).encode())
    again = rebuild(spark, str(raw), str(tmp_path / "again"), zone=ZONE)
    assert [r.value for r in again.read("observations").collect()] == [7.0]
    assert "[redacted]" in raw_store.listing(spark, str(raw)).first().request_metadata
    one = manual.rows_of(spark, manual.WORKOUTS, manual.workout_document("resistance", 35, ZONE, now=datetime(2025, 3, 4, 16, tzinfo=UTC)))
    assert store.merge("workouts", one)["inserted"] == 1 and store.merge("workouts", one)["duplicate"] == 1
    drink = manual.rows_of(spark, manual.EVENTS, manual.event_document("Alcohol", "UTC", value=1.5, now=datetime(2025, 3, 4, 22, tzinfo=UTC)))
    assert store.merge("events", drink)["inserted"] == 1
    bad = schemas.conform(spark.createDataFrame([("m", "manual", "x")], "metric string, source string, source_record_id string"), schemas.OBSERVATION)
    assert store.merge("observations", bad)["rejected"] == 1
    for kind in ("parquet", "csv"):
        written = export_datasets(store.ledgers(), str(tmp_path / kind), kind=kind)
        assert len(written) == 9
        with pytest.raises(FileExistsError):
            export_datasets(store.ledgers(), str(tmp_path / kind), kind=kind, names=("daily",))
    assert spark.read.parquet(written["daily"].replace("/csv/", "/parquet/").replace(".csv", ".parquet")).count() == 1


def test_altered_artifact_is_an_error(spark, tmp_path):
    path = raw_store.save(str(tmp_path), "oura", "sleep", b"{}")
    (tmp_path / path).write_bytes(b"[]")
    for sums in tmp_path.rglob(".*.crc"):  # a local file system would tell by its own sums
        sums.unlink()
    with pytest.raises(Exception, match="altered artifact"):
        raw_store.verified(spark, str(tmp_path)).collect()


def test_windows():
    now = datetime(2025, 3, 9, tzinfo=UTC)
    assert (now - sync_window(None, now)[0]).days == 7
    assert sync_window(now, now)[0] == datetime(2025, 3, 6, tzinfo=UTC)


def test_many_archives_in_one_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(5):
        with zipfile.ZipFile(tmp_path / "in" / f"{k}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("apple_health_export/export.xml", XML.replace("140", str(140 + k)))
            z.writestr("apple_health_export/export_cda.xml", "<x/>")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    archives = [str(tmp_path / "in" / f"{k}.zip") for k in range(5)]
    paths = apple_health.stage_zips(spark, archives, f"file://{tmp_path}/staged")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - jobs <= 4 and len(set(paths)) == 5  # two queries, each of a shuffle and a result
    got = normalize(spark, "apple_health", archives, zone=ZONE, staging=str(tmp_path / "staged"))
    assert sorted(round(r.value / 0.45359237) for r in got["observations"].where("metric = 'weight_kg'").collect()) == [140, 141, 142, 143, 144]
    places = [r["_position"] for r in got["observations"].where("metric = 'weight_kg'").collect()]
    assert len({p.file for p in places}) == 5


def test_archive_guards(spark, tmp_path):
    from tidemark.sources.archives import unpack

    def archive(name, *members):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            for m in members:
                z.writestr(m, "a" * 5000)
        return str(tmp_path / name)

    two = archive("two.zip", "a/export.xml", "b/export.xml")
    go = lambda path, **more: unpack(spark, [path], str(tmp_path / "out"), "export", **({"most_entries": 10, "most_bytes": 1 << 20} | more))
    assert [r["size"] for r in go(two)] == [5000, 5000]
    for wrong in ({"exactly": 1}, {"most_bytes": 4000}, {"most_total": 9000}):
        with pytest.raises(ValueError):
            go(two, **wrong)
    with pytest.raises(Exception, match="more than 1 entries"):
        go(two, most_entries=1)
    raw = bytearray(Path(two).read_bytes())
    at = raw.rindex(b"PK\x01\x02")
    raw[at + 24 : at + 28] = (10).to_bytes(4, "little")  # the directory lies about the size
    (tmp_path / "lies.zip").write_bytes(raw)
    with pytest.raises(Exception):
        go(str(tmp_path / "lies.zip"))
    assert unpack(spark, [archive("none.zip", "x.txt")], str(tmp_path / "out"), "export", most_entries=9, most_bytes=9) == []


def test_exports_of_one_layout_are_one_read(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(12):
        (folder / f"w{k:02d}.csv").write_text(f"Date,Weight (kg)\n2025-03-04 06:30:00,{60 + k}\n2025-03-04 06:30:00,{70 + k}\n")
    got = normalize(spark, "withings_export", str(folder), zone=ZONE)["observations"]
    plan = got._jdf.queryExecution().analyzed().toString()
    assert plan.count("Relation [") == 1 and "Union" not in plan
    rows = got.collect()
    assert len(rows) == 24 and len({r.source_record_id for r in rows}) == 2  # the counter of a time starts anew in every file
    store = SnapshotStore(spark, str(tmp_path / "s"))
    counts = ingest(store, {"observations": got}, "withings")
    assert counts["inserted"] == 2 and counts["updated"] == 22
    assert sorted(r.value for r in store.read("observations").collect()) == [71.0, 81.0]  # the last file's


def test_quoted_cells_of_exports(spark, tmp_path):
    """Cells with doubled quotes, delimiters and line ends; why a row is suspect is kept beside it."""
    (tmp_path / "p.csv").write_text('Date,Systolic,Diastolic,Heart rate,Comments\n2024-01-01 08:00:00,120,80,,"said ""fine"", twice\nand left"\n2024-01-02 08:00:00,70,80,60,\n')
    rows = withings.normalize_export(spark, str(tmp_path / "p.csv"), "UTC")["blood_pressure"].orderBy("measured_at").collect()
    assert [r["notes"] for r in rows] == ['said "fine", twice\nand left', None]
    assert [json.loads(r["metadata"])["quality_reasons"] for r in rows] == [["missing_pulse_bpm"], ["systolic_not_above_diastolic"]]
    (tmp_path / "w.csv").write_text("Date,Weight (kg)\n2024-01-01 08:00:00,70\n2024-01-02 08:00:00,700\n")
    rows = withings.normalize_export(spark, str(tmp_path / "w.csv"), "UTC")["observations"].orderBy("observed_at").collect()
    assert [(r["quality"], json.loads(r["metadata"])["quality_reasons"]) for r in rows] == [("valid", []), ("suspect", ["implausible_value"])]
    (tmp_path / "l.csv").write_text('Test name,Result\n"so-called ""B12"", total",5\n')
    assert labs.normalize(spark, str(tmp_path / "l.csv"), {}, "UTC")["lab_results"].first()["original_name"] == 'so-called "B12", total'


def test_a_folder_of_exports_may_be_of_any_size(spark, tmp_path, monkeypatch):
    """The guards are those of an archive; a folder is read where it lies."""
    folder = tmp_path / "large"
    folder.mkdir()
    for k in range(4):
        (folder / f"w{k}.csv").write_text(f"Date,Weight (kg)\n2025-03-04 06:30:00,{60 + k}\n")
        with zipfile.ZipFile(folder / f"z{k}.zip", "w") as z:
            z.writestr("w.csv", f"Date,Weight (kg)\n2025-03-04 06:30:00,{80 + k}\n")
    monkeypatch.setattr(withings, "MAX_ENTRIES", 2, raising=False)
    monkeypatch.setattr(withings, "MAX_TOTAL_BYTES", 100, raising=False)
    got = withings.normalize_export(spark, str(folder), "UTC", str(tmp_path / "staged"))["observations"]
    assert sorted(r.value for r in got.collect()) == [60.0, 61.0, 62.0, 63.0, 80.0, 81.0, 82.0, 83.0]
    monkeypatch.setattr(withings, "MAX_TOTAL_BYTES", 20)
    with pytest.raises(ValueError, match="oversized"):
        withings.export_files(spark, str(folder), str(tmp_path / "again"))


def test_many_small_members_share_tasks(spark):
    """Tasks follow the cores and the bytes, not the number of members."""
    from tidemark.sources import archives

    cores = spark.sparkContext.defaultParallelism
    assert archives._tasks(spark, 54_000, 54_000 * 2_000) == max(archives.TASKS * cores, 2)  # 108 MB are two tasks by their bytes
    assert archives._tasks(spark, 2) == 2 and archives._tasks(spark, 0) == 1
    assert archives._tasks(spark, 500, 100 * archives.TASK_BYTES + 1) == max(archives.TASKS * cores, 101)


def test_lab_rows_go_through_each_pattern_once(spark):
    """Compiled code that repeats patterns grows beyond what the JIT takes, and every row is interpreted."""
    from tidemark.plans.catalog import QUERIES

    plan = QUERIES["lab_results_normalized"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sum(plan.count(f"{name}(") for name in ("regexp_replace", "regexp_extract", "rlike")) < 20


def test_odd_lab_texts(spark):
    from tidemark.functions import parse

    given = [("2024-01-02", "1 - 2,5"), (" 2024-01-02 ", "<=5"), ("2024-01-02 08:30:00 +0200", ">\t-3"), ("2024-01-02T08:30:00Z", "≤ 7"), ("2024-13-45", "1.2.3-5"), ("noon", "-1–-0.5"), (None, "≥"), ("2024-01-02 08:30", "5"), ("", None)]
    texts = spark.createDataFrame([(i, *g) for i, g in enumerate(given)], "i int, at string, range string")
    low, high = parse.reference_range(F.col("range"))
    seen = texts.select(F.unix_seconds(parse.lab_instant(F.col("at"), "Asia/Tokyo")).alias("at"), low.alias("low"), high.alias("high")).orderBy("i").collect()
    day = 1_704_153_600  # 2024-01-02
    assert [r["at"] for r in seen] == [day + 3 * 3600, day + 3 * 3600, day + 6 * 3600 + 1800, day + 8 * 3600 + 1800, None, None, None, day - 1800, None]
    assert [(r["low"], r["high"]) for r in seen] == [(None, None), (None, 5), (-3, None), (None, 7), (None, 5), (-1, -0.5), (None, None), (None, None), (None, None)]
    numbers = spark.createDataFrame([(i, t) for i, t in enumerate(["1,234.5", "1 234", " 2 5 ", "NaN", "-Infinity", "x", "", None])], "i int, t string")
    cells = numbers.select(parse.number(F.col("t"), thousands=True).alias("a"), parse.number(F.col("t")).alias("b")).orderBy("i").collect()
    assert [(r["a"], r["b"]) for r in cells] == [(1234.5, None), (1234, 1234), (25, 25)] + [(None, None)] * 5
