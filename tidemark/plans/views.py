"""The composite views over the ledgers, as functions of a ``Ledgers`` object.

Every view carries ``subject_id`` as its leading key, so no window runs over the whole table in one task; a ledger of one
person simply has one value (or null) there.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import scalar
from ..operators import calendar, intervals, select, sessions

S = "subject_id"
EPISODIC_SOURCE = "apple_health"
# Sleep dimensions, last-of-day, averaged and summed metrics of the daily row.
DIMENSIONS = ("total_sleep", "time_in_bed", "awake", "light", "deep", "rem")
LAST = ("weight_kg", "body_fat_pct", "lean_mass_kg", "body_fat_mass_kg", "skeletal_muscle_mass_kg", "body_water_mass_kg", "bone_mass_kg")
CARDIO = ("walking", "running", "cycling", "rowing", "swimming", "rucking", "elliptical", "sports")
MINUTES = {"total_sleep": "total_sleep_minutes", "time_in_bed": "time_in_bed_minutes", "awake": "awake_minutes", "light": "light_sleep_minutes", "deep": "deep_sleep_minutes", "rem": "rem_sleep_minutes"}
# Fixed values: (name, predictor, outcome) of the relationship report.
RELATIONSHIPS = [
    ("alcohol-sleep", "alcohol_units", "next_day_total_sleep_minutes"),
    ("alcohol-hrv", "alcohol_units", "next_day_hrv_rmssd_ms"),
    ("alcohol-rhr", "alcohol_units", "next_day_resting_hr_bpm"),
    ("alcohol-bp", "alcohol_units", "next_day_systolic_mmhg"),
    ("sleep-systolic", "wake_date_sleep_minutes", "same_day_systolic_mmhg"),
    ("sleep-diastolic", "wake_date_sleep_minutes", "same_day_diastolic_mmhg"),
    ("weight-systolic", "weight_lb", "same_day_systolic_mmhg"),
    ("weight-diastolic", "weight_lb", "same_day_diastolic_mmhg"),
    ("exercise-sleep", "exercise_minutes", "next_day_total_sleep_minutes"),
    ("exercise-hrv", "exercise_minutes", "next_day_hrv_rmssd_ms"),
    ("exercise-rhr", "exercise_minutes", "next_day_resting_hr_bpm"),
]


@dataclass
class Ledgers:
    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    priorities: DataFrame | None = None
    disabled: tuple[str, ...] = ()
    #: Length of the pieces that the nights of a subject are cut into where one subject may have most of them.
    piece_seconds: float | None = None

    def table(self, name: str) -> DataFrame:
        """Rows of enabled sources (an absent ledger is empty)."""
        df = self.tables.get(name)
        df = schemas.empty(self.spark, schemas.LEDGERS[name]) if df is None else schemas.conform(df, schemas.LEDGERS[name])
        df = df.withColumn(S, F.coalesce(S, F.lit("")))
        return df.where(~F.col("source").isin(*self.disabled)) if self.disabled else df

    def ranked(self, df: DataFrame, data_type: str | Column) -> DataFrame:
        empty = schemas.empty(self.spark, schemas.SOURCE_PRIORITY)
        return select.with_priority(df, self.priorities if self.priorities is not None else empty, data_type=data_type)


def canonical_observations(led: Ledgers) -> DataFrame:
    o = led.table("observations").where("quality <> 'invalid'")
    o = o.withColumn("canonical_date", scalar.local_date_of(F.col("local_date"), F.col("observed_at"), F.col("timezone")))
    return select.select_by_priority(led.ranked(o, F.col("metric")), [S, "metric", "canonical_date"], [select.quality_rank("quality"), "priority", "source"])


def canonical_blood_pressure(led: Ledgers) -> DataFrame:
    b = led.table("blood_pressure").where("quality <> 'invalid'")
    return select.select_by_priority(led.ranked(b, "blood_pressure"), [S, "local_date"], [select.quality_rank("quality"), "priority", "source"])


def blood_pressure_session_readings(led: Ledgers) -> DataFrame:
    return sessions.sessionize(canonical_blood_pressure(led), [S, "local_date", "source"], "measured_at", 600, tie="source_record_id", ordinal="session_reading_number")


def blood_pressure_sessions(led: Ledgers) -> DataFrame:
    readings = blood_pressure_session_readings(led)
    stats = sessions.session_stats(readings, [S, "local_date", "source"], "measured_at", "source_record_id", ["systolic_mmhg", "diastolic_mmhg", "pulse_bpm"], ordinal="session_reading_number")
    names = {"started_at": "session_started_at", "ended_at": "session_ended_at"} | {f"mean_{v}": f"session_{v}" for v in ("systolic_mmhg", "diastolic_mmhg", "pulse_bpm")}
    stats = stats.withColumnsRenamed(names)
    key = F.concat("source", F.lit(":"), F.col("local_date").cast("string"), F.lit(":"), F.col("session_number").cast("string"))
    return stats.select(key.alias("session_id"), "*")


def canonical_sleep_sessions(led: Ledgers) -> DataFrame:
    return select.select_by_priority(led.ranked(led.table("sleep_sessions"), "sleep"), [S, "sleep_date"], ["priority", "source"])


def canonical_workouts(led: Ledgers) -> DataFrame:
    return select.select_by_priority(led.ranked(led.table("workouts"), "workouts"), [S, "local_date", "workout_type"], ["priority", "source"])


def canonical_sleep_daily(led: Ledgers) -> DataFrame:
    """Interval unions by stage for the episodic source, sums for the others, then the best source of each day."""
    nights = led.ranked(led.table("sleep_sessions"), "sleep")
    staged = nights.where(F.col("source") == EPISODIC_SOURCE).select(S, "started_at", "ended_at", "sleep_date", "source", "priority", *[f"{d}_seconds" for d in DIMENSIONS])
    wake = intervals.episodes(staged, [S], "started_at", "ended_at", "sleep_date", gap_seconds=4 * 3600, piece_seconds=led.piece_seconds)
    flags = wake.withColumns({d: F.when(F.col(f"{d}_seconds").isNotNull(), 1) for d in DIMENSIONS})
    long = flags.unpivot([S, "episode", "wake_date", "priority", "started_at", "ended_at"], list(DIMENSIONS), "dimension", "present").where("present is not null")
    merged = intervals.merge_islands(long, [S, "episode", "wake_date", "priority", "dimension"], "started_at", "ended_at")
    per = merged.groupBy(S, F.col("wake_date").alias("local_date"), F.col("priority")).pivot("dimension", list(DIMENSIONS)).agg(F.sum("seconds"))
    none = F.lit(None).cast("double")
    extra = ("sleep_efficiency_pct", "sleep_resting_hr_bpm", "sleep_hrv_rmssd_ms", "respiratory_rate", "sleep_score")
    episodic = per.select(S, "local_date", *[(F.col(d) / F.lit(60.0)).alias(m) for d, m in MINUTES.items()], *[none.alias(c) for c in extra], F.lit(EPISODIC_SOURCE).alias("source_name"), "priority")
    longest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.coalesce("total_sleep_seconds", F.lit(0)).alias("t"), F.col("source_record_id"))))
    summed = (
        nights.where(F.col("source") != EPISODIC_SOURCE)
        .groupBy(S, F.col("sleep_date").alias("local_date"), F.col("source").alias("source_name"), "priority")
        .agg(
            *[(F.sum(f"{d}_seconds") / F.lit(60.0)).alias(m) for d, m in MINUTES.items()],
            F.avg("efficiency_pct").alias("sleep_efficiency_pct"),
            longest("resting_hr_bpm").alias("sleep_resting_hr_bpm"),
            longest("average_hrv_rmssd_ms").alias("sleep_hrv_rmssd_ms"),
            longest("respiratory_rate").alias("respiratory_rate"),
            longest("sleep_score").alias("sleep_score"),
        )
    )
    return select.select_by_priority(episodic.unionByName(summed), [S, "local_date"], ["priority", "source_name"], rank="row")


def _winner(groups: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Of the aggregates of every source the best one of each key: by partial aggregation, so rows are read once and no group
    of rows is ever gathered."""
    values = [c for c in groups.columns if c not in keys]
    best = groups.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])).alias("_v"))
    return best.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])


def observation_facts(led: Ledgers) -> DataFrame:
    """What ``canonical_observations`` gives for a day: aggregates of each source first, then the best source of each metric."""
    o = led.table("observations").where("quality <> 'invalid'")
    o = o.withColumns({"local_date": scalar.local_date_of(F.col("local_date"), F.col("observed_at"), F.col("timezone")), "_q": select.quality_rank("quality")})
    valued = F.when(F.col("value").isNotNull(), F.struct("observed_at", "source_record_id"))
    groups = led.ranked(o, F.col("metric")).groupBy(S, "local_date", "metric", "_q", "priority", "source").agg(F.max_by("value", valued).alias("last"), F.avg("value").alias("avg"), F.sum("value").alias("sum"))
    order = F.struct("_q", "priority", "source")
    of = lambda column, m: F.min_by(column, F.when(F.col("metric") == m, order)).alias(m)
    averages = [of("avg", "resting_hr_bpm").alias("obs_resting_hr_bpm"), of("avg", "hrv_rmssd_ms").alias("obs_hrv_rmssd_ms")]
    return groups.groupBy(S, "local_date").agg(*[of("last", m) for m in LAST], *averages, of("sum", "steps"), of("sum", "active_energy_kcal"))


def pressure_facts(led: Ledgers) -> DataFrame:
    """Sessions of every source and quality of a day, then those of the best."""
    b = led.table("blood_pressure").where("quality <> 'invalid'").withColumn("_q", select.quality_rank("quality"))
    keys, values = [S, "local_date", "_q", "priority", "source"], ["systolic_mmhg", "diastolic_mmhg", "pulse_bpm"]
    readings = sessions.sessionize(led.ranked(b, "blood_pressure"), keys, "measured_at", 600, tie="source_record_id", ordinal="session_reading_number")
    stats = sessions.session_stats(readings, keys, "measured_at", "source_record_id", values, ordinal="session_reading_number")
    named = {"systolic_mmhg": "systolic_mmhg", "diastolic_mmhg": "diastolic_mmhg", "pulse_bpm": "blood_pressure_pulse_bpm"}
    groups = stats.groupBy(*keys).agg(*[F.avg(f"preferred_{v}").alias(n) for v, n in named.items()], F.count(F.lit(1)).alias("blood_pressure_session_count"), F.sum("reading_count").alias("blood_pressure_reading_count"))
    return _winner(groups, [S, "local_date"], ["_q", "priority", "source"]).drop("_q", "priority", "source")


def workout_facts(led: Ledgers) -> DataFrame:
    """Totals of every source, the best source of each type of workout, then the day."""
    groups = led.ranked(led.table("workouts"), "workouts").groupBy(S, "local_date", "workout_type", "priority", "source").agg(F.sum("duration_seconds").alias("seconds"), F.count(F.lit(1)).alias("n"))
    best = _winner(groups, [S, "local_date", "workout_type"], ["priority", "source"])
    minutes = lambda test: F.sum(F.when(test, F.col("seconds"))) / F.lit(60.0)
    return best.groupBy(S, "local_date").agg(minutes(F.col("workout_type") == "resistance").alias("resistance_minutes"), minutes(F.col("workout_type").isin(*CARDIO)).alias("cardio_minutes"), F.sum("n").alias("workout_count"))


def event_facts(led: Ledgers) -> DataFrame:
    drink = F.col("event_type") == "alcohol"
    return led.table("events").groupBy(S, "local_date").agg(F.sum(F.when(drink, F.col("value"))).alias("alcohol_units"), F.count(F.when(drink, 1)).alias("alcohol_event_count"), F.expr("listagg(DISTINCT event_type, ',') WITHIN GROUP (ORDER BY event_type)").alias("event_types"))


def daily_facts(led: Ledgers) -> dict[str, DataFrame]:
    return {"observations": observation_facts(led), "pressure": pressure_facts(led), "sleep": canonical_sleep_daily(led).drop("priority"), "workouts": workout_facts(led), "events": event_facts(led)}


def daily_health(led: Ledgers) -> DataFrame:
    """One row per subject and date with any fact: the facts of every ledger, gathered once.

    Each ledger is read once (nights twice, by two filters that share no row), and calendar, weeks, rolling and lagged views
    add windows to this plan without repeating it.  Persist it where several of them are wanted.
    """
    wide = calendar.gather_facts(list(daily_facts(led).values()), [S, "local_date"])
    wide = wide.withColumns({"resting_hr_bpm": F.coalesce("obs_resting_hr_bpm", "sleep_resting_hr_bpm"), "hrv_rmssd_ms": F.coalesce("obs_hrv_rmssd_ms", "sleep_hrv_rmssd_ms")})
    return wide.drop("obs_resting_hr_bpm", "obs_hrv_rmssd_ms", "sleep_resting_hr_bpm", "sleep_hrv_rmssd_ms")


def health_calendar(daily: DataFrame) -> DataFrame:
    return calendar.fill_calendar(daily, "local_date", [S])


def rollups() -> dict[str, calendar.Rolled]:
    """What weeks and rolling windows share."""
    exercised = F.col("resistance_minutes").isNotNull() | F.col("cardio_minutes").isNotNull()
    minutes = F.when(exercised, F.coalesce("resistance_minutes", F.lit(0.0)) + F.coalesce("cardio_minutes", F.lit(0.0)))
    of = calendar.Rolled
    return {
        "weight_kg_avg": of("avg", "weight_kg"),
        "weight_days": of("count", "weight_kg"),
        "systolic_mmhg_avg": of("avg", "systolic_mmhg"),
        "diastolic_mmhg_avg": of("avg", "diastolic_mmhg"),
        "blood_pressure_days": of("count", "systolic_mmhg"),
        "hrv_rmssd_ms_avg": of("avg", "hrv_rmssd_ms"),
        "hrv_days": of("count", "hrv_rmssd_ms"),
        "resting_hr_bpm_avg": of("avg", "resting_hr_bpm"),
        "resting_hr_days": of("count", "resting_hr_bpm"),
        "total_sleep_minutes_avg": of("avg", "total_sleep_minutes"),
        "sleep_days": of("count", "total_sleep_minutes"),
        "steps_total": of("sum", "steps"),
        "steps_daily_avg": of("avg", "steps"),
        "steps_days": of("count", "steps"),
        "resistance_minutes_total": of("sum", "resistance_minutes"),
        "cardio_minutes_total": of("sum", "cardio_minutes"),
        "exercise_minutes_total": of("sum", minutes),
        "workout_count": of("sum", "workout_count"),
        "exercise_days": of("count", minutes),
    }


def weekly_health(cal: DataFrame) -> DataFrame:
    return calendar.weekly(cal, "local_date", [r.aggregate.alias(n) for n, r in rollups().items()], [S])


def rolling_health(cal: DataFrame) -> DataFrame:
    return calendar.rolling(cal, "local_date", rollups(), keys=[S]).withColumn("window_end", F.col("anchor_date"))


def rolling_health_latest(cal: DataFrame) -> DataFrame:
    """Only the newest anchor of each subject: one aggregation over the days of the longest window."""
    return calendar.rolling_latest(cal, "local_date", rollups(), keys=[S]).withColumn("window_end", F.col("anchor_date"))


def analysis_daily_lagged(cal: DataFrame) -> DataFrame:
    outcomes = ("total_sleep_minutes", "hrv_rmssd_ms", "resting_hr_bpm", "systolic_mmhg", "diastolic_mmhg")
    lagged = calendar.lag_days(cal.withColumn("outcome_date", F.col("local_date")), "local_date", [*outcomes, "outcome_date"], keys=[S], prefix="next_day_")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return lagged.select(
        S,
        F.col("local_date").alias("predictor_date"),
        zero("alcohol_units").alias("alcohol_units"),
        (zero("resistance_minutes") + zero("cardio_minutes")).alias("exercise_minutes"),
        (F.col("weight_kg") * scalar.LB_PER_KG).alias("weight_lb"),
        F.col("total_sleep_minutes").alias("wake_date_sleep_minutes"),
        F.col("hrv_rmssd_ms").alias("wake_date_hrv_rmssd_ms"),
        F.col("resting_hr_bpm").alias("wake_date_resting_hr_bpm"),
        F.col("systolic_mmhg").alias("same_day_systolic_mmhg"),
        F.col("diastolic_mmhg").alias("same_day_diastolic_mmhg"),
        F.col("next_day_outcome_date").alias("outcome_date"),
        *[f"next_day_{o}" for o in outcomes],
    )


def view(led: Ledgers, name: str) -> DataFrame:
    """A view by its name."""
    direct = {f.__name__: f for f in (canonical_observations, canonical_blood_pressure, blood_pressure_session_readings, blood_pressure_sessions, canonical_sleep_sessions, canonical_workouts, canonical_sleep_daily, daily_health)}
    if name in direct:
        return direct[name](led)
    cal = health_calendar(daily_health(led))
    return {"health_calendar": lambda c: c, "weekly_health": weekly_health, "rolling_health": rolling_health, "rolling_health_latest": rolling_health_latest, "analysis_daily_lagged": analysis_daily_lagged}[name](cal)


VIEWS = ("canonical_observations", "canonical_blood_pressure", "blood_pressure_session_readings", "blood_pressure_sessions", "canonical_sleep_sessions", "canonical_workouts", "canonical_sleep_daily", "daily_health", "health_calendar", "weekly_health", "rolling_health", "rolling_health_latest", "analysis_daily_lagged")


def register(led: Ledgers) -> None:
    """Temp views under the views' names, for ``spark.sql``."""
    for name in VIEWS:
        view(led, name).createOrReplaceTempView(name)
    reduce(lambda _, n: led.table(n).createOrReplaceTempView(n), schemas.LEDGERS, None)
