"""Explicit schemas of the ledgers; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_COMMON = "source string, source_record_id string, device_id string, raw_file string, transform_version string, metadata string, ingestion_run_id string"


_TYPES = {"string": StringType, "boolean": BooleanType, "date": DateType, "double": DoubleType, "int": IntegerType, "bigint": LongType, "timestamp": TimestampType}


def _ddl(text: str) -> StructType:
    """A flat schema, parsed without a session."""
    return StructType([StructField(n, _TYPES[t]()) for n, t in (f.split() for f in text.split(", "))])


SOURCES = _ddl("source_id string, name string, source_type string, enabled boolean, created_at timestamp")
DEVICES = _ddl("device_id string, source string, manufacturer string, model string, name string, vendor_device_id string")
INGESTION_RUNS = _ddl("run_id string, source string, status string, requested_start timestamp, requested_end timestamp, started_at timestamp, finished_at timestamp, raw_count bigint, normalized_count bigint, inserted_count bigint, updated_count bigint, duplicate_count bigint, rejected_count bigint, error string")
OBSERVATION = _ddl(f"subject_id string, metric string, observed_at timestamp, observed_until timestamp, value double, unit string, original_metric string, original_value double, original_unit string, quality string, timezone string, local_date date, {_COMMON}")
BLOOD_PRESSURE = _ddl(f"subject_id string, measured_at timestamp, local_date date, systolic_mmhg double, diastolic_mmhg double, pulse_bpm double, measurement_number int, source_group_id string, context string, notes string, quality string, {_COMMON}")
SLEEP_SESSION = _ddl(
    f"subject_id string, sleep_date date, started_at timestamp, ended_at timestamp, time_in_bed_seconds bigint, total_sleep_seconds bigint, awake_seconds bigint, light_seconds bigint, deep_seconds bigint, rem_seconds bigint, latency_seconds bigint, efficiency_pct double, resting_hr_bpm double, lowest_hr_bpm double, average_hrv_rmssd_ms double, respiratory_rate double, sleep_score double, stage string, {_COMMON}"
)
WORKOUT = _ddl(f"subject_id string, started_at timestamp, ended_at timestamp, local_date date, workout_type string, duration_seconds bigint, intensity string, rpe double, distance_m double, energy_kcal double, average_hr_bpm double, max_hr_bpm double, notes string, {_COMMON}")
LAB_RESULT = _ddl(f"subject_id string, collected_at timestamp, resulted_at timestamp, canonical_name string, original_name string, numeric_value double, text_value string, unit string, reference_low double, reference_high double, reference_text string, abnormal_flag string, provider string, fasting boolean, {_COMMON}")
EVENT = _ddl(f"subject_id string, event_type string, started_at timestamp, ended_at timestamp, local_date date, value double, unit string, notes string, {_COMMON}")
DUPLICATE_LINK = _ddl("link_id string, record_type string, canonical_id string, duplicate_id string, match_method string, confidence double, resolution string, generated_by string, facts string, created_at timestamp")
SYNC_STATE = _ddl("source string, last_successful_end timestamp, run_id string")
SOURCE_PRIORITY = _ddl("data_type string, source string, priority int")

LEDGERS = {"observations": OBSERVATION, "blood_pressure": BLOOD_PRESSURE, "sleep_sessions": SLEEP_SESSION, "workouts": WORKOUT, "lab_results": LAB_RESULT, "events": EVENT}
KEYS = {"observations": ["source", "source_record_id", "metric"]} | {k: ["source", "source_record_id"] for k in ("blood_pressure", "sleep_sessions", "workouts", "lab_results", "events")}
STATE = {"sources": SOURCES, "devices": DEVICES, "ingestion_runs": INGESTION_RUNS, "sync_state": SYNC_STATE, "duplicate_links": DUPLICATE_LINK, "source_priorities": SOURCE_PRIORITY}
TABLES = LEDGERS | STATE
KEYS |= {"sources": ["name"], "devices": ["source", "vendor_device_id"], "ingestion_runs": ["run_id"], "sync_state": ["source"], "duplicate_links": ["record_type", "canonical_id", "duplicate_id", "match_method"], "source_priorities": ["data_type", "source"]}
#: Columns that do not decide whether a row has changed.
TECHNICAL = {"ingestion_run_id", "raw_file"}
# The closed vocabularies.
QUALITIES = ("valid", "suspect", "invalid")
WORKOUT_TYPES = ("resistance", "walking", "running", "cycling", "rowing", "swimming", "rucking", "elliptical", "mobility", "sports", "other")
EVENT_TYPES = ("alcohol", "illness", "travel", "injury", "supplement_change", "diet_change", "training_change", "medication_change", "other")


def semantic_columns(ledger: str) -> list[str]:
    return [c for c in LEDGERS[ledger].names if c not in KEYS[ledger] and c not in TECHNICAL]


#: Where a row stood in what was read: its file, its element in the file, its part of the element.  Later ones win in a merge.
POSITION = "_position"
POSITION_TYPE = "struct<file: string, element: bigint, part: int>"


def position(file: Column, element: Column, part: Column | int = 0) -> Column:
    return F.struct(file.cast("string").alias("file"), element.cast("bigint").alias("element"), (F.lit(part) if isinstance(part, int) else part).cast("int").alias("part")).alias(POSITION)


def placed(df: DataFrame, part: Column | None = None) -> list[Column]:
    """The position column of a frame that has one, to be selected beside others; ``part`` tells apart rows made of one element."""
    if POSITION not in df.columns:
        return []
    at = F.col(POSITION)
    return [at if part is None else position(at["file"], at["element"], part)]


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns in order, missing ones as typed nulls, and the position of the row if it has one."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema], *placed(df))


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    """No rows of a schema, as a plan that the optimizer folds away."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


#: Ledger -> (column, least, most, whether the least itself is allowed) of numbers that may be missing; they must be finite.
BOUNDS: dict[str, list[tuple[str, float | None, float | None, bool]]] = {
    "observations": [("original_value", None, None, True)],
    "blood_pressure": [("systolic_mmhg", 0, None, False), ("diastolic_mmhg", 0, None, False), ("pulse_bpm", 0, None, False), ("measurement_number", 1, None, True)],
    "sleep_sessions": [
        *[(f"{k}_seconds", 0, None, True) for k in ("time_in_bed", "total_sleep", "awake", "light", "deep", "rem", "latency")],
        *[(k, 0, 100, True) for k in ("efficiency_pct", "sleep_score")],
        *[(k, 0, None, False) for k in ("resting_hr_bpm", "lowest_hr_bpm", "respiratory_rate")],
        ("average_hrv_rmssd_ms", 0, None, True),
    ],
    "workouts": [("duration_seconds", 0, None, True), ("rpe", 0, 10, True), ("distance_m", 0, None, True), ("energy_kcal", 0, None, True), ("average_hr_bpm", 0, None, False), ("max_hr_bpm", 0, None, False)],
    "lab_results": [(k, None, None, True) for k in ("numeric_value", "reference_low", "reference_high")],
    "events": [("value", None, None, True)],
}


def _infinite(name: str) -> Column:
    v = F.col(name).cast("double")
    return F.isnan(v) | (F.abs(v) == float("inf"))


def _out_of_bounds(ledger: str) -> list[tuple[Column, str]]:
    out = []
    for name, least, most, closed in BOUNDS[ledger]:
        bad = _infinite(name)  # of nulls each of these is null, which is no reason
        if least is not None:
            bad = bad | (F.col(name) < least if closed else F.col(name) <= least)
        if most is not None:
            bad = bad | (F.col(name) > most)
        out.append((bad, name))
    return out


def _reasons(ledger: str) -> list[tuple[Column, str]]:
    c = F.col
    absent = lambda *names: [(c(n).isNull(), n) for n in names]
    if ledger == "observations":
        own = [(F.coalesce(c("metric") == "", F.lit(True)), "metric"), *absent("observed_at"), (c("value").isNull() | _infinite("value"), "value"), (~c("quality").isin(*QUALITIES), "quality"), (c("observed_until") < c("observed_at"), "observed_until")]
    elif ledger == "blood_pressure":
        own = [*absent("measured_at", "systolic_mmhg", "diastolic_mmhg"), (~c("quality").isin(*QUALITIES), "quality")]
    elif ledger == "sleep_sessions":
        own = [*absent("sleep_date", "started_at"), (c("ended_at").isNull() | (c("ended_at") < c("started_at")), "ended_at")]
    elif ledger == "workouts":
        elapsed = F.unix_seconds("ended_at") - F.unix_seconds("started_at")
        own = [(~c("workout_type").isin(*WORKOUT_TYPES) | c("workout_type").isNull(), "workout_type"), *absent("started_at", "duration_seconds"), (F.abs(elapsed - c("duration_seconds")) > 1, "duration_mismatch"), (c("ended_at").isNull() | (c("ended_at") < c("started_at")), "ended_at")]
    elif ledger == "lab_results":
        own = [(F.coalesce(c("original_name") == "", F.lit(True)), "name"), (c("numeric_value").isNull() & (F.coalesce(c("text_value"), F.lit("")) == ""), "value")]
    else:
        own = [(F.coalesce(c("event_type") == "", F.lit(True)), "event_type"), *absent("started_at"), (c("ended_at") < c("started_at"), "ended_at")]
    return own + _out_of_bounds(ledger)


def judge(df: DataFrame, ledger: str) -> DataFrame:
    """Rows with ``reasons``: what is wrong with each, empty if it is valid."""
    shared = [(F.coalesce(F.col(n) == "", F.lit(True)), n) for n in ("source", "source_record_id")]
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for bad, name in [*shared, *_reasons(ledger)]]))
    return df.withColumn("reasons", reasons)


def validate(df: DataFrame, ledger: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their reasons)."""
    judged = judge(df, ledger)
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)
