"""Apple Health XML exports: Record and Workout elements to observations, sleep sessions, blood pressure and workouts."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parse, scalar
from ..operators.pairing import pair_halves
from ..schemas import BLOOD_PRESSURE, OBSERVATION, POSITION, SLEEP_SESSION, WORKOUT, conform, placed, position
from .archives import unpack

SOURCE, VERSION = "apple_health", "apple-health-v1"
MAX_BYTES, MAX_ENTRIES = 8 << 30, 10_000
_META = "MetadataEntry array<struct<_key: string, _value: string>>"
RECORD_ATTRIBUTES = ("creationDate", "device", "endDate", "sourceName", "sourceVersion", "startDate", "type", "unit", "value")
WORKOUT_ATTRIBUTES = ("creationDate", "device", "duration", "durationUnit", "endDate", "sourceName", "sourceVersion", "startDate", "totalDistance", "totalDistanceUnit", "totalEnergyBurned", "totalEnergyBurnedUnit", "workoutActivityType")
# Quantity type -> (metric, unit).
QUANTITIES = {
    "BodyMass": ("weight_kg", "kg"),
    "BodyFatPercentage": ("body_fat_pct", "%"),
    "LeanBodyMass": ("lean_mass_kg", "kg"),
    "HeartRate": ("heart_rate_bpm", "bpm"),
    "RestingHeartRate": ("resting_hr_bpm", "bpm"),
    "HeartRateVariabilitySDNN": ("hrv_sdnn_ms", "ms"),
    "StepCount": ("steps", "count"),
    "ActiveEnergyBurned": ("active_energy_kcal", "kcal"),
    "DistanceWalkingRunning": ("walking_running_distance_m", "m"),
    "AppleExerciseTime": ("exercise_minutes", "min"),
    "BodyTemperature": ("body_temperature_c", "degC"),
    "RespiratoryRate": ("respiratory_rate", "breaths/min"),
    "OxygenSaturation": ("oxygen_saturation_pct", "%"),
}
# Sleep stage -> column of its seconds.
STAGES = {"InBed": "time_in_bed", "Awake": "awake", "Asleep": "total_sleep", "AsleepUnspecified": "total_sleep", "AsleepCore": "light", "AsleepDeep": "deep", "AsleepREM": "rem"}
# Words in the name of an activity -> workout type.
ACTIVITIES = [("traditionalstrengthtraining", "resistance"), ("functionalstrengthtraining", "resistance"), ("walk", "walking"), ("run", "running"), ("cycling", "cycling"), ("row", "rowing"), ("swim", "swimming"), ("elliptical", "elliptical"), ("yoga", "mobility"), ("cooldown", "mobility")]
_PREFIX, _SLEEP, _BP = "HKQuantityTypeIdentifier", "HKCategoryTypeIdentifierSleepAnalysis", "HKQuantityTypeIdentifierBloodPressure"


def stage_zips(spark: SparkSession, archives: list[str], staging: str) -> list[str]:
    """The export.xml of each archive, unpacked by tasks into a folder that all executors share."""
    found = unpack(spark, archives, staging, "(^|/)export\\.xml$", most_entries=MAX_ENTRIES, most_bytes=MAX_BYTES, exactly=1)
    return [r["path"] for r in found]


def read_xml(spark: SparkSession, path: str | list[str], tag: str) -> DataFrame:
    """Elements of one tag with their position; the reader splits large files."""
    names = RECORD_ATTRIBUTES if tag == "Record" else WORKOUT_ATTRIBUTES
    schema = ", ".join(f"_{n} string" for n in names) + ", " + _META
    raw = spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "_").option("mode", "FAILFAST").schema(schema).load(path)
    # splits of a file come to tasks by size, not in order, so an element's place is its split and its number there
    place = F.col("_metadata.file_block_start") * F.lit(1 << 20) + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return raw.select(*[F.col(f"_{n}").alias(n) for n in names], F.col("MetadataEntry").alias("entries"), position(F.col("_metadata.file_path"), place))


def _identity(kind: str, names: tuple[str, ...]) -> Column:
    parts = [F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{n}="), F.col(n))) for n in sorted(names)]
    return F.concat(F.lit(f"apple:{kind}:"), F.sha2(F.concat_ws("\x1f", *parts), 256))


def _provenance() -> list[Column]:
    pairs = F.map_from_entries(F.coalesce("entries", F.array().cast("array<struct<_key: string, _value: string>>")))
    own = F.struct(F.col("sourceName").alias("source_name"), F.col("sourceVersion").alias("source_version"), "device", F.col("creationDate").alias("creation_date"), F.col("startDate").alias("start_date"), F.col("endDate").alias("end_date"), pairs.alias("metadata"))
    device = F.when(F.trim(F.coalesce("device", F.lit(""))) != "", F.sha2(F.trim("device"), 256))
    return [F.lit(SOURCE).alias("source"), device.alias("device_id"), F.lit(VERSION).alias("transform_version"), F.to_json(F.struct(own.alias("apple_health"))).alias("metadata")]


def _demand(value: Column, ok: Column, what: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(what)))


def observations(records: DataFrame) -> DataFrame:
    short = F.substring_index("type", _PREFIX, -1)
    metric = F.coalesce(*[F.when(short == k, m) for k, (m, _) in QUANTITIES.items()])
    unit = F.coalesce(*[F.when(short == k, u) for k, (_, u) in QUANTITIES.items()])
    rows = records.where(F.col("type").startswith(_PREFIX)).withColumns({"metric": metric, "canonical": unit}).where("metric is not null")
    rows = rows.withColumns({"original_unit": F.coalesce("unit", "canonical"), "original_value": parse.number(F.col("value"))})
    own = F.regexp_replace(F.lower("original_unit"), "°", "deg")
    mass, heat = F.col("canonical") == "kg", F.col("canonical") == "degC"
    mile = (F.col("metric") == "walking_running_distance_m") & (own == "mi")
    ok = F.when(mass, own.isin("kg", "lb", "lbs", "g")).when(heat, own.isin("degc", "c", "degf", "f")).otherwise(True) & F.col("original_value").isNotNull()
    converted = F.when(mass | mile, scalar.convert_unit(F.col("original_value"), own)).when(heat & own.isin("degf", "f"), scalar.convert_unit(F.col("original_value"), F.lit("degF"))).otherwise(F.col("original_value"))
    out = rows.select(
        "metric",
        parse.instant(F.col("startDate")).alias("observed_at"),
        parse.instant(F.col("endDate")).alias("observed_until"),
        _demand(converted, ok, "unsupported unit or number").alias("value"),
        F.col("canonical").alias("unit"),
        F.col("type").alias("original_metric"),
        "original_value",
        "original_unit",
        F.lit("valid").alias("quality"),
        F.concat(F.lit("UTC"), F.regexp_replace(F.regexp_extract("startDate", "([+-]\\d{2}:?\\d{2})$", 1), "^([+-]\\d{2})(\\d{2})$", "$1:$2")).alias("timezone"),
        parse.offset_date(F.col("startDate")).alias("local_date"),
        _identity("record", RECORD_ATTRIBUTES).alias("source_record_id"),
        *_provenance(),
        *placed(rows),
    )
    return conform(out, OBSERVATION)


def sleep_sessions(records: DataFrame) -> DataFrame:
    stage = F.regexp_replace("value", "^HKCategoryValueSleepAnalysis", "")
    rows = records.where(F.col("type") == _SLEEP).withColumn("stage", stage).where(F.col("stage").isin(*STAGES))
    rows = rows.withColumns({"started_at": parse.instant(F.col("startDate")), "ended_at": parse.instant(F.col("endDate"))})
    seconds = F.unix_seconds("ended_at") - F.unix_seconds("started_at")
    of = lambda *names: F.when(F.col("stage").isin(*names), seconds)
    asleep = [s for s in STAGES if s.startswith("Asleep")]
    out = rows.select(
        parse.offset_date(F.col("endDate")).alias("sleep_date"),
        "started_at",
        _demand(F.col("ended_at"), F.col("ended_at") >= F.col("started_at"), "sleep ends before it starts").alias("ended_at"),
        of("InBed").alias("time_in_bed_seconds"),
        of(*asleep).alias("total_sleep_seconds"),
        of("Awake").alias("awake_seconds"),
        of("AsleepCore").alias("light_seconds"),
        of("AsleepDeep").alias("deep_seconds"),
        of("AsleepREM").alias("rem_seconds"),
        "stage",
        _identity("sleep", RECORD_ATTRIBUTES).alias("source_record_id"),
        *_provenance(),
        *placed(rows),
    )
    return conform(out, SLEEP_SESSION)


def blood_pressure(records: DataFrame) -> DataFrame:
    """Systolic and diastolic records of one source, start and end are a pair; repeats pair in file order, leftovers are an error."""
    rows = records.where(F.col("type").isin(f"{_BP}Systolic", f"{_BP}Diastolic")).withColumns({"part": F.substring_index("type", _BP, -1)})
    if POSITION not in rows.columns:
        rows = rows.withColumn(POSITION, position(F.lit(None), F.monotonically_increasing_id()))
    rows = rows.withColumns({"identity": _identity("blood-pressure-correlation", RECORD_ATTRIBUTES), "number": parse.number(F.col("value"))})
    rows = rows.select("*", *[c.alias(n) for c, n in zip(_provenance(), ("p_source", "p_device", "p_version", "p_metadata"), strict=True)])
    taken = {"s": ("Systolic", F.col("number")), "d": ("Diastolic", F.col("number")), "id": ("Systolic", F.col("identity")), "device_id": ("Systolic", F.col("p_device")), "metadata": ("Systolic", F.col("p_metadata"))}
    pairs = pair_halves(rows, ["sourceName", "startDate", "endDate"], "part", POSITION, "Systolic", "Diastolic", taken)
    complete = F.col("reason").isNull() & F.col("s").isNotNull() & F.col("d").isNotNull()
    out = pairs.select(
        parse.instant(F.col("startDate")).alias("measured_at"),
        parse.offset_date(F.col("startDate")).alias("local_date"),
        _demand(F.col("s"), complete, "blood pressure without its pair").alias("systolic_mmhg"),
        F.col("d").alias("diastolic_mmhg"),
        F.col("id").alias("source_record_id"),
        F.col("id").alias("source_group_id"),
        F.when(F.col("s") > F.col("d"), "valid").otherwise("suspect").alias("quality"),
        F.lit(SOURCE).alias("source"),
        "device_id",
        F.lit(VERSION).alias("transform_version"),
        "metadata",
        POSITION,
    )
    return conform(out, BLOOD_PRESSURE)


def workouts(elements: DataFrame) -> DataFrame:
    rows = elements.withColumns({"started_at": parse.instant(F.col("startDate")), "ended_at": parse.instant(F.col("endDate")), "d": parse.number(F.col("totalDistance"))})
    kind = parse.first_contained(F.lower(F.regexp_replace(F.coalesce("workoutActivityType", F.lit("")), "^HKWorkoutActivityType", "")), ACTIVITIES, "other")
    seconds = F.unix_seconds("ended_at") - F.unix_seconds("started_at")
    out = rows.select(
        "started_at",
        "ended_at",
        parse.offset_date(F.col("startDate")).alias("local_date"),
        kind.alias("workout_type"),
        _demand(seconds, seconds >= 0, "workout ends before it starts").alias("duration_seconds"),
        F.when(F.lower("totalDistanceUnit") == "mi", F.col("d") * scalar.METERS_PER_MILE).otherwise(F.col("d")).alias("distance_m"),
        parse.number(F.col("totalEnergyBurned")).alias("energy_kcal"),
        _identity("workout", WORKOUT_ATTRIBUTES).alias("source_record_id"),
        *_provenance(),
        *placed(rows),
    )
    return conform(out, WORKOUT)


def normalize(spark: SparkSession, path: str | list[str], staging: str | None = None) -> dict[str, DataFrame]:
    """Ledger name -> rows, from one or more export.xml, or archives of one each (unpacked by tasks into ``staging``); records are
    parsed once and kept for the three ledgers made from them."""
    paths = [path] if isinstance(path, str) else path
    archives = [p for p in paths if p.lower().endswith(".zip")]
    if archives and not staging:
        raise ValueError("an archive needs a folder to unpack into")
    files = [p for p in paths if p not in archives] + (stage_zips(spark, archives, staging) if archives else [])
    records = read_xml(spark, files, "Record").persist(StorageLevel.DISK_ONLY)
    return {"observations": observations(records), "sleep_sessions": sleep_sessions(records), "blood_pressure": blood_pressure(records), "workouts": workouts(read_xml(spark, files, "Workout"))}
