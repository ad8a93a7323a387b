"""Registered queries of the normalizers: records and documents of every kind, manual entries, archives, previews and rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..sources import apple_health, labs, manual, oura, withings, worker_files
from .queries_io import _plain
from .queries_state import _BIOMARKERS
from .queries_views import rounded
from .registry import load, query, workspace

#: Start of what an order stands for: its day, and a second of that day by its key.
_BEGAN = "CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 86400)"
_KEY = "CAST(o_orderkey AS VARCHAR)"


def _seconds() -> Column:
    return F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86_400


def _iso(seconds: Column, offset: str = "+00:00") -> Column:
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset))


def _filled(rows: DataFrame, given: dict[str, Column], fields: str) -> DataFrame:
    """The fields of a document (name and type), null where nothing is given."""
    return rows.select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in (f.split() for f in fields.split(", "))])


def _elements(rows: DataFrame, given: dict[str, Column], names: tuple[str, ...]) -> DataFrame:
    none = F.lit(None).cast("array<struct<_key: string, _value: string>>").alias("entries")
    return rows.select(*[given.get(n, F.lit(None)).cast("string").alias(n) for n in names], none)


def _named(out: DataFrame) -> Column:
    return F.get_json_object("metadata", "$.apple_health.source_name").alias("source_name")


# ---------------------------------------------------------------- XML

_STAGE_SQL = "list_value('InBed', 'Awake', 'Asleep', 'AsleepUnspecified', 'AsleepCore', 'AsleepDeep', 'AsleepREM')[o_orderkey % 7 + 1]"


@query(
    f"""WITH n AS (SELECT {_KEY} AS source_name, {_STAGE_SQL} AS stage, {_BEGAN} AS b, CAST(600 + o_orderkey % 5400 AS BIGINT) AS s FROM orders)
SELECT source_name, stage, b - INTERVAL 2 HOUR AS started_at, b - INTERVAL 2 HOUR + to_seconds(s) AS ended_at, CAST(b + to_seconds(s) AS DATE) AS sleep_date, CASE WHEN stage = 'InBed' THEN s END AS time_in_bed_seconds, CASE WHEN stage LIKE 'Asleep%' THEN s END AS total_sleep_seconds,
  CASE WHEN stage = 'Awake' THEN s END AS awake_seconds, CASE WHEN stage = 'AsleepCore' THEN s END AS light_seconds, CASE WHEN stage = 'AsleepDeep' THEN s END AS deep_seconds, CASE WHEN stage = 'AsleepREM' THEN s END AS rem_seconds FROM n"""
)
def source_xml_nights(spark, sf_dir):
    """Stages of sleep, each with the seconds of its own column; the date is that of the wall clock at the end."""
    o, key = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    stage = F.element_at(F.array(*map(F.lit, apple_health.STAGES)), (key % 7 + 1).cast("int"))
    end = _seconds() + 600 + key % 5_400
    text = lambda s: F.concat(F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd HH:mm:ss"), F.lit(" +0200"))
    given = {"type": F.lit("HKCategoryTypeIdentifierSleepAnalysis"), "value": F.concat(F.lit("HKCategoryValueSleepAnalysis"), stage), "sourceName": key, "creationDate": text(end), "startDate": text(_seconds()), "endDate": text(end)}
    out = apple_health.sleep_sessions(_elements(o, given, apple_health.RECORD_ATTRIBUTES))
    kept = [f"{k}_seconds" for k in ("time_in_bed", "total_sleep", "awake", "light", "deep", "rem")]
    return _plain(out.select(_named(out), "stage", "started_at", "ended_at", "sleep_date", *kept), "started_at", "ended_at")


_ACTIVITIES = ("TraditionalStrengthTraining", "Walking", "Running", "Swimming", "Yoga", "Rowing", "Archery")
_KINDS = ("resistance", "walking", "running", "swimming", "mobility", "rowing", "other")


@query(
    f"""SELECT {_KEY} AS source_name, list_value({", ".join(f"'{k}'" for k in _KINDS)})[o_orderkey % 7 + 1] AS workout_type, {_BEGAN} + INTERVAL 3 HOUR AS started_at, CAST({_BEGAN} AS DATE) AS local_date, CAST(900 + o_orderkey % 3600 AS BIGINT) AS duration_seconds,
  round(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey * 1609.344::DOUBLE ELSE o_custkey END + 1e-8, 4) AS distance_m, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey % 900 AS DOUBLE) END AS energy_kcal FROM orders"""
)
def source_xml_workouts(spark, sf_dir):
    """Workouts by the words of their activity; miles become metres."""
    o, key = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    text = lambda s: F.concat(F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd HH:mm:ss"), F.lit(" -0300"))
    activity = F.element_at(F.array(*map(F.lit, _ACTIVITIES)), (key % 7 + 1).cast("int"))
    given = {
        "workoutActivityType": F.concat(F.lit("HKWorkoutActivityType"), activity), "sourceName": key, "creationDate": text(_seconds()), "startDate": text(_seconds()), "endDate": text(_seconds() + 900 + key % 3_600),
        "totalDistance": F.col("o_custkey"), "totalDistanceUnit": F.when(key % 2 == 0, "mi").otherwise("m"), "totalEnergyBurned": F.when(key % 5 != 0, F.col("o_custkey") % 900), "totalEnergyBurnedUnit": F.lit("kcal"),
    }
    out = apple_health.workouts(_elements(o, given, apple_health.WORKOUT_ATTRIBUTES))
    return _plain(rounded(out.select(_named(out), "workout_type", "started_at", "local_date", "duration_seconds", "distance_m", "energy_kcal")), "started_at")


# ---------------------------------------------------------------- documents of an API


@query(
    """SELECT CASE WHEN event_id % 3 = 0 THEN 'heart-rate:' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00:' || event_type ELSE CAST(event_id AS VARCHAR) END AS source_record_id, date_trunc('second', ts) AS observed_at, CAST(floor(value) AS DOUBLE) AS value,
  CASE WHEN floor(value) BETWEEN 25 AND 250 THEN 'valid' ELSE 'suspect' END AS quality, CAST(ts + INTERVAL 9 HOUR AS DATE) AS local_date FROM events WHERE value IS NOT NULL"""
)
def source_heart_rates(spark, sf_dir):
    """Heart rates; one without an id is known by its time and origin, one without a rate is left out."""
    e, n = load(spark, sf_dir, "events"), F.col("event_id")
    given = {"id": F.when(n % 3 != 0, n), "bpm": F.floor("value"), "source": F.col("event_type"), "timestamp": _iso(F.unix_seconds(F.col("ts").cast("timestamp")))}
    out = oura.heart_rate(_filled(e, given, oura.FIELDS["heartrate"]), "Asia/Tokyo")
    return _plain(out.select("source_record_id", "observed_at", "value", "quality", "local_date"), "observed_at")


@query(
    f"""SELECT {_KEY} AS source_record_id, {_BEGAN} AS started_at, {_BEGAN} + to_seconds(o_custkey % 7000) AS ended_at, CAST({_BEGAN} + INTERVAL 9 HOUR AS DATE) AS local_date, CAST(o_custkey % 7000 AS BIGINT) AS duration_seconds,
  list_value('resistance', 'walking', 'mobility', 'sports', 'other', 'other')[o_orderkey % 6 + 1] AS workout_type, CAST(o_custkey AS DOUBLE) AS distance_m, 'label ' || o_orderpriority AS notes FROM orders"""
)
def source_workouts(spark, sf_dir):
    """Workouts of an API by their activity; an unknown or missing one is another kind."""
    o, key = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    activity = F.element_at(F.array(*map(F.lit, ("Weightlifting", " hiking ", "stretching", "tennis", "chess")), F.lit(None).cast("string")), (key % 6 + 1).cast("int"))
    given = {"id": key, "activity": activity, "distance": F.col("o_custkey"), "label": F.concat(F.lit("label "), "o_orderpriority"), "start_datetime": _iso(_seconds()), "end_datetime": _iso(_seconds() + F.col("o_custkey") % 7_000)}
    out = oura.workouts(_filled(o, given, oura.FIELDS["workout"]), "Asia/Tokyo")
    return _plain(out.select("source_record_id", "started_at", "ended_at", "local_date", "duration_seconds", "workout_type", "distance_m", "notes"), "started_at", "ended_at")


@query(f"SELECT {_KEY} AS source_record_id, 'oura_session' AS event_type, {_BEGAN} - INTERVAL 1 HOUR AS started_at, {_BEGAN} - INTERVAL 1 HOUR + to_seconds(o_custkey % 3000) AS ended_at, CAST({_BEGAN} - INTERVAL 1 HOUR AS DATE) AS local_date FROM orders")
def source_sessions(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    given = {"id": F.col("o_orderkey"), "type": F.lit("rest"), "start_datetime": _iso(_seconds(), "+01:00"), "end_datetime": _iso(_seconds() + F.col("o_custkey") % 3_000, "+01:00")}
    out = oura.sessions(_filled(o, given, oura.FIELDS["session"]), "UTC")
    return _plain(out.select("source_record_id", "event_type", "started_at", "ended_at", "local_date"), "started_at", "ended_at")


_READY = "(SELECT o_orderkey, o_orderdate, unnest(['readiness_score', 'temperature_deviation_c', 'temperature_trend_deviation_c']) AS metric, unnest([CAST(o_custkey % 120 AS DOUBLE), o_orderkey % 240 / 10.0::DOUBLE - 12, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 7 - 3.0::DOUBLE END]) AS value FROM orders)"


@query(f"SELECT 'k' || o_orderkey AS source_record_id, metric, round(value + 1e-8, 4) AS value, CAST(o_orderdate AS DATE) AS local_date, CASE WHEN value BETWEEN CASE metric WHEN 'readiness_score' THEN 0 ELSE -10 END AND CASE metric WHEN 'readiness_score' THEN 100 ELSE 10 END THEN 'valid' ELSE 'suspect' END AS quality FROM {_READY} WHERE value IS NOT NULL")
def source_readiness(spark, sf_dir):
    """A daily document gives an observation for each field it has; implausible ones are suspect."""
    o, key = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    given = {"id": F.concat(F.lit("k"), key), "day": F.to_date("o_orderdate"), "score": F.col("o_custkey") % 120, "temperature_deviation": key % 240 / F.lit(10.0) - 12, "temperature_trend_deviation": F.when(key % 3 > 0, F.col("o_custkey") % 7 - 3)}
    out = oura.daily(_filled(o, given, oura.FIELDS["daily_readiness"]), "daily_readiness", "UTC")
    return rounded(out.select("source_record_id", "metric", "value", "local_date", "quality"))


# ---------------------------------------------------------------- manual entries


def _written(rows: DataFrame, given: dict[str, Column], endpoint: str) -> DataFrame:
    """Documents as pages of the raw store have them; what is not given is not in the document."""
    text = F.to_json(F.struct("*"))
    return _filled(rows, {"schema_version": F.lit(manual.FORM), "created_at": F.lit("2026-01-02T03:04:05+00:00"), **given}, manual.FIELDS[endpoint]).select(F.lit(None).cast("string").alias("path"), F.encode(text, "utf-8").alias("content"))


@query(
    f"""SELECT 'manual-workout:' || o_orderkey AS source_record_id, {_BEGAN} + INTERVAL 3 HOUR AS started_at, {_BEGAN} + INTERVAL 3 HOUR + to_minutes(1 + o_custkey % 1440) AS ended_at, CAST({_BEGAN} AS DATE) AS local_date, list_value({", ".join(f"'{t}'" for t in schemas.WORKOUT_TYPES)})[o_orderkey % 11 + 1] AS workout_type,
  CAST(60 * (1 + o_custkey % 1440) AS BIGINT) AS duration_seconds, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 21 / 2.0::DOUBLE END AS rpe, o_orderstatus AS notes, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS focus FROM orders"""
)
def manual_workouts(spark, sf_dir):
    """A document for each order, as they are kept raw, through their form and their normalizer."""
    o, key = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    minutes = 1 + F.col("o_custkey") % 1_440
    kind = F.element_at(F.array(*map(F.lit, schemas.WORKOUT_TYPES)), (key % 11 + 1).cast("int"))
    given = {
        "source_record_id": F.concat(F.lit("manual-workout:"), key), "started_at": _iso(_seconds(), "-03:00"), "ended_at": _iso(_seconds() + 60 * minutes, "-03:00"), "local_date": F.to_date(F.timestamp_seconds(_seconds())), "workout_type": kind,
        "duration_seconds": 60 * minutes, "rpe": F.when(key % 3 > 0, key % 21 / F.lit(2.0)), "notes": F.col("o_orderstatus"), "focus": F.when(key % 4 > 0, F.col("o_orderpriority")),
    }
    out = manual.normalize(_written(o, given, manual.WORKOUTS), manual.WORKOUTS)["workouts"]
    return _plain(out.select("source_record_id", "started_at", "ended_at", "local_date", "workout_type", "duration_seconds", "rpe", "notes", F.get_json_object("metadata", "$.manual.focus").alias("focus")), "started_at", "ended_at")


@query(
    f"""SELECT 'manual-event:' || event_id AS source_record_id, list_value({", ".join(f"'{t}'" for t in schemas.EVENT_TYPES)})[event_id % 9 + 1] AS event_type, date_trunc('second', ts) AS started_at, CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) + to_hours(CAST(1 + event_id % 48 AS INTEGER)) END AS ended_at,
  CAST(ts AS DATE) AS local_date, CASE WHEN event_id % 9 = 0 THEN round(abs(coalesce(value, 0)) + 1 + 1e-8, 4) WHEN value IS NOT NULL THEN round(value + 1e-8, 4) END AS value, CASE WHEN event_id % 9 = 0 THEN 'drinks' END AS unit FROM events"""
)
def manual_events(spark, sf_dir):
    e, n = load(spark, sf_dir, "events"), F.col("event_id")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    given = {
        "source_record_id": F.concat(F.lit("manual-event:"), n), "event_type": F.element_at(F.array(*map(F.lit, schemas.EVENT_TYPES)), (n % 9 + 1).cast("int")), "started_at": _iso(at), "ended_at": F.when(n % 2 == 0, _iso(at + 3_600 * (1 + n % 48))),
        "local_date": F.to_date("ts"), "value": F.when(n % 9 == 0, F.abs(F.coalesce("value", F.lit(0.0))) + 1).otherwise(F.col("value")), "unit": F.when(n % 9 == 0, "drinks"),
    }
    out = manual.normalize(_written(e, given, manual.EVENTS), manual.EVENTS)["events"]
    return _plain(rounded(out.select("source_record_id", "event_type", "started_at", "ended_at", "local_date", "value", "unit")), "started_at", "ended_at")


# ---------------------------------------------------------------- archives, previews, rejects


@query("SELECT CAST(o_orderdate AS TIMESTAMP) AS observed_at, CAST(30 + o_custkey % 90 AS DOUBLE) AS value, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL")
def archived_exports(spark, sf_dir):
    """Archives of a thousand keys each, made and unpacked by tasks, and the CSV files in them read as one export."""
    root, o = workspace(spark), load(spark, sf_dir, "orders")
    folder = f"{root}/archives"

    def archive(rows):
        import io
        import uuid
        import zipfile

        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("export/weight.csv", "Date,Weight (kg)\n" + "".join(f"{a},{w}\n" for a, w in zip(rows["at"], rows["w"], strict=True)))
            z.writestr("export/readme.txt", "nothing")
        worker_files.write(f"{folder}/{uuid.uuid4().hex}.zip", held.getvalue())
        return rows[["n"]].head(1)

    made = o.select(F.floor(F.col("o_orderkey") / 1_000).cast("bigint").alias("n"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("at"), (30 + F.col("o_custkey") % 90).alias("w"))
    made.groupBy("n").applyInPandas(archive, "n bigint").write.format("noop").mode("overwrite").save()
    out = withings.normalize_export(spark, folder, "UTC", f"{root}/staging")["observations"]
    return _plain(out.groupBy("observed_at", "value").agg(F.count(F.lit(1)).alias("n")), "observed_at")


@query(
    """WITH t AS (SELECT DISTINCT 'Marker ' || l_partkey % 20 AS name FROM lineitem WHERE l_partkey % 20 NOT IN (3, 7, 11))
SELECT (SELECT count(*) FROM lineitem) AS rows, (SELECT count(*) FROM lineitem WHERE l_partkey % 20 IN (3, 7, 11)) AS recognized, (SELECT string_agg(name, ',' ORDER BY name) FROM t) AS unknown"""
)
def lab_file_preview(spark, sf_dir):
    """What an import of a lab file would take, and the names that its vocabulary does not have."""
    root, li = workspace(spark), load(spark, sf_dir, "lineitem")
    rows = li.select(F.concat(F.lit("Marker "), F.col("l_partkey") % 20).alias("Test"), F.col("l_quantity").alias("Result"))
    rows.write.option("header", True).csv(f"{root}/labs")
    counts, unknown = labs.preview(labs.normalize(spark, f"{root}/labs", _BIOMARKERS, "UTC")["lab_results"])
    return spark.range(1).select(*[F.lit(counts[k]).cast("bigint").alias(k) for k in ("rows", "recognized")], F.lit(",".join(sorted(unknown))).alias("unknown"))


_LENGTH = "o_custkey % 50 - 5"
_REJECTS = f"""WITH r AS (SELECT list_value(
  CASE WHEN o_orderkey % 11 = 0 THEN 'source_record_id' END, CASE WHEN o_orderkey % 7 = 0 THEN 'workout_type' END, CASE WHEN o_orderkey % 13 = 0 THEN 'duration_mismatch' END, CASE WHEN {_LENGTH} < 0 THEN 'ended_at' END, CASE WHEN {_LENGTH} + CASE WHEN o_orderkey % 13 = 0 THEN 60 ELSE 0 END < 0 THEN 'duration_seconds' END,
  CASE WHEN o_orderkey % 24 > 20 THEN 'rpe' END, CASE WHEN o_orderkey % 17 = 0 THEN 'distance_m' END, CASE WHEN o_orderkey % 19 = 0 THEN 'max_hr_bpm' END) AS reasons FROM orders)
"""


@query(_REJECTS + "SELECT 'valid' AS reason, count(*) AS n FROM r WHERE list_count(reasons) = 0 UNION ALL SELECT reason, count(*) FROM (SELECT unnest(reasons) AS reason FROM r) WHERE reason IS NOT NULL GROUP BY reason")
def ledger_rejects(spark, sf_dir):
    """Workouts, many of them out of bounds: how many are valid, and how many are refused for each reason."""
    o, key = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    length = F.col("o_custkey") % 50 - 5
    rows = o.select(
        F.timestamp_seconds(_seconds()).alias("started_at"), F.timestamp_seconds(_seconds() + length).alias("ended_at"), (length + F.when(key % 13 == 0, 60).otherwise(0)).alias("duration_seconds"), F.when(key % 7 == 0, "archery").otherwise("rucking").alias("workout_type"),
        (key % 24 / F.lit(2.0)).alias("rpe"), F.when(key % 17 == 0, float("inf")).alias("distance_m"), F.when(key % 19 == 0, 0.0).otherwise(150.0).alias("max_hr_bpm"), F.lit("feed").alias("source"), F.when(key % 11 == 0, "").otherwise(key.cast("string")).alias("source_record_id"),
    )
    judged = schemas.judge(schemas.conform(rows, schemas.WORKOUT), "workouts")
    reasons = F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("valid")))
    return judged.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
