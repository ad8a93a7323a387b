"""Oura API collections (JSON) to observations, sleep sessions, workouts and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse, scalar
from ..schemas import EVENT, OBSERVATION, POSITION, SLEEP_SESSION, WORKOUT, conform, placed, position
from .raw_store import parsed

SOURCE, VERSION = "oura", "oura-v1"
# Fields of each endpoint, and (field, metric, unit, factor, least, most plausible) of daily documents.
FIELDS = {
    "sleep": "id string, bedtime_start string, bedtime_end string, day string, type string, time_in_bed double, total_sleep_duration double, awake_time double, light_sleep_duration double, deep_sleep_duration double, rem_sleep_duration double, latency double, efficiency double, average_heart_rate double, lowest_heart_rate double, average_hrv double, average_breath double",
    "daily_sleep": "id string, day string, timestamp string, score double",
    "daily_readiness": "id string, day string, timestamp string, score double, temperature_deviation double, temperature_trend_deviation double",
    "heartrate": "id string, bpm double, source string, timestamp string",
    "daily_activity": "id string, day string, timestamp string, score double, steps double, active_calories double, total_calories double, equivalent_walking_distance double, high_activity_time double, medium_activity_time double, low_activity_time double, sedentary_time double, non_wear_time double",
    "workout": "id string, activity string, calories double, distance double, start_datetime string, end_datetime string, intensity string, label string, source string",
    "session": "id string, type string, mood string, start_datetime string, end_datetime string",
}
DAILY = {
    "daily_sleep": [("score", "sleep_score", "score", 1.0, 0.0, 100.0)],
    "daily_readiness": [("score", "readiness_score", "score", 1.0, 0.0, 100.0), ("temperature_deviation", "temperature_deviation_c", "C", 1.0, -10.0, 10.0), ("temperature_trend_deviation", "temperature_trend_deviation_c", "C", 1.0, -10.0, 10.0)],
    "daily_activity": [
        ("score", "activity_score", "score", 1.0, 0.0, 100.0),
        ("steps", "steps", "count", 1.0, 0.0, 200_000.0),
        ("active_calories", "active_energy_kcal", "kcal", 1.0, 0.0, 20_000.0),
        ("total_calories", "total_energy_kcal", "kcal", 1.0, 0.0, 30_000.0),
        ("equivalent_walking_distance", "equivalent_walking_distance_m", "m", 1.0, 0.0, 500_000.0),
        ("high_activity_time", "high_activity_minutes", "min", 1 / 60, 0.0, 1440.0),
        ("medium_activity_time", "medium_activity_minutes", "min", 1 / 60, 0.0, 1440.0),
        ("low_activity_time", "low_activity_minutes", "min", 1 / 60, 0.0, 1440.0),
        ("sedentary_time", "sedentary_minutes", "min", 1 / 60, 0.0, 1440.0),
        ("non_wear_time", "non_wear_minutes", "min", 1 / 60, 0.0, 1440.0),
    ],
}
# Activity -> workout type.
WORKOUTS = {
    "strength_training": "resistance", "weightlifting": "resistance", "walking": "walking", "hiking": "walking", "running": "running", "jogging": "running", "cycling": "cycling", "indoor_cycling": "cycling", "rowing": "rowing", "swimming": "swimming",
    "elliptical": "elliptical", "yoga": "mobility", "stretching": "mobility", "mobility": "mobility", "basketball": "sports", "football": "sports", "soccer": "sports", "tennis": "sports", "volleyball": "sports",
}


def read_collection(pages: DataFrame, endpoint: str) -> DataFrame:
    """The documents of an endpoint's pages (path, content), in their order."""
    kind = ", ".join(f"`{n}`: {t}" for n, t in (f.split() for f in FIELDS[endpoint].split(", ")))
    read = parsed(pages, f"data array<struct<{kind}>>, next_token string")
    each = read.select(F.posexplode("_page.data").alias("_i", "d"), *placed(read))
    return each.select("d.*", position(F.col(POSITION)["file"], F.col("_i")))


def _record(df: DataFrame) -> Column:
    return F.struct(*[c for c in df.columns if c != POSITION])


def _id(df: DataFrame, kind: str) -> Column:
    digest = F.substring(F.sha2(F.to_json(_record(df)), 256), 1, 32)
    return F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit(f"missing-id:{kind}:"), digest))


def _common(df: DataFrame, kind: str) -> list[Column]:
    return [F.lit(SOURCE).alias("source"), _id(df, kind).alias("source_record_id"), F.lit(VERSION).alias("transform_version"), F.to_json(F.struct(F.struct(F.lit(kind).alias("endpoint"), _record(df).alias("record")).alias("oura"))).alias("metadata"), *placed(df)]


def sleep(docs: DataFrame) -> DataFrame:
    start, end = parse.instant(F.col("bedtime_start")), parse.instant(F.col("bedtime_end"))
    total, efficiency = scalar.derived_sleep(F.col("total_sleep_duration"), F.col("time_in_bed"), F.col("awake_time"), F.col("efficiency"))
    whole = lambda c: F.col(c).cast("bigint")
    out = docs.select(
        parse.offset_date(F.col("bedtime_end")).alias("sleep_date"),
        start.alias("started_at"),
        F.when(end >= start, end).otherwise(F.raise_error(F.lit("sleep ends before it starts"))).alias("ended_at"),
        whole("time_in_bed").alias("time_in_bed_seconds"),
        total.cast("bigint").alias("total_sleep_seconds"),
        whole("awake_time").alias("awake_seconds"),
        whole("light_sleep_duration").alias("light_seconds"),
        whole("deep_sleep_duration").alias("deep_seconds"),
        whole("rem_sleep_duration").alias("rem_seconds"),
        whole("latency").alias("latency_seconds"),
        efficiency.alias("efficiency_pct"),
        scalar.positive_or_null(F.col("average_heart_rate")).alias("resting_hr_bpm"),
        scalar.positive_or_null(F.col("lowest_heart_rate")).alias("lowest_hr_bpm"),
        F.col("average_hrv").alias("average_hrv_rmssd_ms"),
        scalar.positive_or_null(F.col("average_breath")).alias("respiratory_rate"),
        *_common(docs, "sleep"),
    )
    return conform(out, SLEEP_SESSION)


def daily(docs: DataFrame, endpoint: str, zone: str) -> DataFrame:
    """Daily documents: one observation for each field that is present."""
    day = F.col("day").try_cast("date")
    at = F.coalesce(parse.instant(F.col("timestamp"), zone), F.to_utc_timestamp(day.cast("timestamp"), zone))
    each = F.array(*[F.struct(F.lit(f).alias("original_metric"), F.lit(m).alias("metric"), F.lit(u).alias("unit"), F.lit(k).alias("factor"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.col(f).alias("original_value")) for f, m, u, k, lo, hi in DAILY[endpoint]])
    rows = docs.select(at.alias("observed_at"), day.alias("local_date"), *_common(docs, endpoint.replace("_", "-")), F.explode(each).alias("m")).select("*", "m.*").drop("m").where("original_value is not null")
    value = F.when(F.col("factor") == 1.0, F.col("original_value")).otherwise(F.col("original_value") / 60.0)
    out = rows.withColumns({"value": value, "timezone": F.lit(zone), "original_unit": F.when(F.col("original_metric").endswith("_time"), "s").otherwise(F.col("unit"))})
    return conform(out.withColumn("quality", F.when(F.col("value").between(F.col("lo"), F.col("hi")), "valid").otherwise("suspect")), OBSERVATION)


def heart_rate(docs: DataFrame, zone: str) -> DataFrame:
    at = parse.instant(F.col("timestamp"))
    iso = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    key = F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit("heart-rate:"), iso, F.lit(":"), F.coalesce("source", F.lit("None"))))
    rows = docs.where("bpm is not null")
    out = rows.select(F.lit("heart_rate_bpm").alias("metric"), at.alias("observed_at"), F.col("bpm").alias("value"), F.lit("bpm").alias("unit"), F.lit("bpm").alias("original_metric"), F.col("bpm").alias("original_value"), F.lit("bpm").alias("original_unit"), F.when(F.col("bpm").between(25, 250), "valid").otherwise("suspect").alias("quality"), F.lit(zone).alias("timezone"), scalar.local_date(at, zone).alias("local_date"), F.lit(SOURCE).alias("source"), key.alias("source_record_id"), F.lit(VERSION).alias("transform_version"), *placed(rows))
    return conform(out, OBSERVATION)


def _span() -> tuple[Column, Column]:
    start, end = parse.instant(F.col("start_datetime")), parse.instant(F.col("end_datetime"))
    return start, F.when(end >= start, end).otherwise(F.raise_error(F.lit("ends before it starts")))


def workouts(docs: DataFrame, zone: str) -> DataFrame:
    start, end = _span()
    activity = F.lower(F.trim(F.coalesce("activity", F.lit("unknown"))))
    kind = F.coalesce(*[F.when(activity == k, v) for k, v in WORKOUTS.items()], F.lit("other"))
    out = docs.select(start.alias("started_at"), end.alias("ended_at"), scalar.local_date(start, zone).alias("local_date"), kind.alias("workout_type"), (F.unix_seconds(end) - F.unix_seconds(start)).alias("duration_seconds"), "intensity", F.col("distance").alias("distance_m"), F.col("calories").alias("energy_kcal"), F.col("label").alias("notes"), *_common(docs, "workout"))
    return conform(out, WORKOUT)


def sessions(docs: DataFrame, zone: str) -> DataFrame:
    start, end = _span()
    out = docs.select(F.lit("oura_session").alias("event_type"), start.alias("started_at"), end.alias("ended_at"), scalar.local_date(start, zone).alias("local_date"), *_common(docs, "session"))
    return conform(out, EVENT)


def normalize(pages: DataFrame, endpoint: str, zone: str) -> dict[str, DataFrame]:
    """Ledger name -> rows of one endpoint's pages."""
    docs = read_collection(pages, endpoint)
    if endpoint == "sleep":
        return {"sleep_sessions": sleep(docs)}
    if endpoint in DAILY:
        return {"observations": daily(docs, endpoint, zone)}
    if endpoint == "heartrate":
        return {"observations": heart_rate(docs, zone)}
    if endpoint == "workout":
        return {"workouts": workouts(docs, zone)}
    if endpoint == "session":
        return {"events": sessions(docs, zone)}
    raise ValueError(f"unsupported endpoint: {endpoint}")
