"""Audit and dashboard read models over the ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators.numbering import every_nth
from ..sources.files import Files


def coverage(ledgers: DataFrame, today: Column, *, digits: int = 1) -> DataFrame:
    """Per (metric, source): first, last, records, days, span, missing, percent, cadence, freshness; d is the date."""
    g = ledgers.groupBy("metric", "source").agg(F.min("d").alias("first_date"), F.max("d").alias("last_date"), F.count(F.lit(1)).alias("records"), F.count_distinct("d").alias("observed_days"))
    span = F.datediff("last_date", "first_date").cast("bigint") + 1
    kind = scalar.cadence(F.col("metric"))
    percent = F.bround(F.col("observed_days") * F.lit(100.0) / span, digits)
    out = g.withColumns({"span_days": span, "missing_days": span - F.col("observed_days"), "coverage": percent, "cadence": kind})
    return out.withColumn("freshness", scalar.freshness(F.datediff(today, "last_date"), F.col("cadence")))


def ledger_dates(led) -> DataFrame:
    """(metric, source, d) of every record, invalid ones included."""
    from functools import reduce

    def of(name: str, metric: Column, day: Column) -> DataFrame:
        return led.table(name).select(metric.alias("metric"), "source", day.alias("d"))

    parts = [
        of("observations", F.col("metric"), F.coalesce("local_date", F.to_date("observed_at"))),
        of("blood_pressure", F.lit("blood_pressure"), F.col("local_date")),
        of("sleep_sessions", F.lit("sleep"), F.col("sleep_date")),
        of("workouts", F.concat_ws("", F.lit("workout:"), "workout_type"), F.col("local_date")),
        of("lab_results", F.concat_ws("", F.lit("lab:"), F.coalesce("canonical_name", "original_name")), F.to_date(F.coalesce("collected_at", "resulted_at"))),
        of("events", F.concat_ws("", F.lit("event:"), "event_type"), F.coalesce("local_date", F.to_date("started_at"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def latest_runs(runs: DataFrame, now: Column, *, status: str | None = "succeeded") -> DataFrame:
    """The newest run of each source with its duration, throughput and age."""
    rows = runs.where(F.col("status") == status) if status else runs
    last = rows.groupBy("source").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "source"]), F.struct("started_at", "run_id")).alias("r")).select("source", "r.*")
    seconds = (F.unix_millis("finished_at") - F.unix_millis("started_at")) / F.lit(1000.0)
    rate = F.when(seconds > 0, F.bround(F.col("normalized_count") / seconds, 1))
    age = F.greatest(F.floor((F.unix_seconds(now) - F.unix_seconds("finished_at")) / 86_400), F.lit(0))
    return last.withColumns({"duration_seconds": seconds, "throughput_per_second": rate, "age_days": age})


def diagnostics(led, links: DataFrame, runs: DataFrame, today: Column | None = None) -> DataFrame:
    """One row of counts and the overall status; each table is read once."""
    from .views import canonical_sleep_daily

    count = lambda cond: F.count(F.when(cond, 1))
    quality = led.table("observations").select("quality").unionByName(led.table("blood_pressure").select("quality"))
    parts = [
        quality.agg(count(F.col("quality") == "suspect").alias("suspect_records"), count(F.col("quality") == "invalid").alias("invalid_records")),
        links.agg(*[count(F.col("resolution") == r).alias(f"duplicate_{n}") for r, n in (("candidate", "candidates"), ("confirmed", "confirmed"), ("rejected", "rejected"))]),
        canonical_sleep_daily(led).agg(count(F.col("total_sleep_minutes") > 1440).alias("sleep_over_24h"), count(F.col("total_sleep_minutes") > 960).alias("sleep_over_16h")),
        latest_runs(runs, F.current_timestamp(), status=None).agg(count(F.col("status") == "failed").alias("latest_failed_imports"), count(F.col("status") == "running").alias("latest_running_imports")),
        latest_runs(runs, F.current_timestamp()).agg(F.count(F.lit(1)).alias("source_import_count")),
        coverage(ledger_dates(led), F.current_date() if today is None else today).agg(F.count(F.lit(1)).alias("metric_source_count"), count(F.col("freshness") == "stale").alias("stale_metric_sources")),
    ]
    one = parts[0].withColumn("_k", F.lit(1))
    for p in parts[1:]:
        one = one.join(p.withColumn("_k", F.lit(1)), "_k")  # one row on either side
    attention = F.col("invalid_records") + F.col("duplicate_candidates") + F.col("sleep_over_24h") + F.col("latest_failed_imports")
    review = F.col("suspect_records") + F.col("sleep_over_16h") + F.col("latest_running_imports")
    empty = (F.col("metric_source_count") == 0) & (F.col("source_import_count") == 0)
    status = F.when(empty, "empty").when(attention > 0, "attention").when(review > 0, "review").otherwise("clear")
    return one.drop("_k").withColumn("status", status)


def relationship_report(lagged: DataFrame) -> DataFrame:
    from ..operators.correlate import relationships
    from .views import RELATIONSHIPS

    return relationships(lagged, RELATIONSHIPS)


def summary(led, daily: DataFrame) -> DataFrame:
    """Latest value of each headline metric: subject, name, value, unit, date."""
    from .views import S, blood_pressure_sessions, canonical_observations, canonical_sleep_daily

    def newest(df: DataFrame, name: str, value: Column, unit: str, day: str, *tie: str) -> DataFrame:
        got = df.where(value.isNotNull()).groupBy(S).agg(F.max_by(F.struct(value.cast("double").alias("value"), F.col(day).alias("date")), F.struct(day, *tie)).alias("v"))
        return got.select(S, F.lit(name).alias("name"), "v.value", F.lit(unit).alias("unit"), "v.date")

    obs, bp = canonical_observations(led), blood_pressure_sessions(led)
    parts = [
        newest(obs.where("metric = 'weight_kg'"), "weight", F.col("value") * scalar.LB_PER_KG, "lb", "canonical_date", "observed_at", "source_record_id"),
        newest(obs.where("metric = 'resting_hr_bpm'"), "resting_hr", F.col("value"), "bpm", "canonical_date", "observed_at", "source_record_id"),
        newest(daily, "hrv", F.col("hrv_rmssd_ms"), "ms", "local_date"),
        newest(bp, "systolic", F.col("preferred_systolic_mmhg"), "mmHg", "local_date", "session_ended_at", "session_id"),
        newest(bp, "diastolic", F.col("preferred_diastolic_mmhg"), "mmHg", "local_date", "session_ended_at", "session_id"),
        newest(canonical_sleep_daily(led), "sleep", F.col("total_sleep_minutes"), "min", "local_date"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


RANGES = (7, 30, 90, 365)


def bounds(led) -> DataFrame:
    """(subject, _last): the newest date that any ledger but the labs holds, whether or not a view selects it."""
    from functools import reduce

    from .views import S

    days = {"observations": F.coalesce("local_date", F.to_date("observed_at")), "blood_pressure": F.col("local_date"), "sleep_sessions": F.col("sleep_date"), "workouts": F.col("local_date"), "events": F.col("local_date")}
    newest = [led.table(n).groupBy(S).agg(F.max(d).alias("_last")) for n, d in days.items()]  # a row a subject before they meet
    return reduce(DataFrame.unionByName, newest).groupBy(S).agg(F.max("_last").alias("_last")).where("_last is not null")


def trends(led, cal: DataFrame, days: int = 365) -> dict[str, DataFrame]:
    """daily, weekly, rolling and labs frames of the dashboard; ``cal`` is the (persisted) calendar."""
    from . import views

    if days not in RANGES:
        raise ValueError("the range is 7, 30, 90 or 365 days")
    newest = bounds(led)
    held = cal.join(newest, views.S)
    pounds = lambda df, *names: df.withColumns({n: F.col(n) * scalar.LB_PER_KG for n in names})
    daily = held.where(F.col("local_date") > F.date_sub("_last", days)).drop("_last")
    recent = held.where(F.col("local_date") > F.date_sub("_last", 371)).drop("_last")
    labs = led.table("lab_results").withColumns({"name": F.coalesce("canonical_name", "original_name"), "at": F.coalesce("collected_at", "resulted_at")})
    labs = labs.orderBy(F.desc_nulls_last("at"), "source_record_id").limit(50)
    return {"daily": pounds(daily, "weight_kg"), "weekly": pounds(views.weekly_health(recent), "weight_kg_avg"), "rolling": pounds(views.rolling_health_latest(cal), "weight_kg_avg"), "labs": labs}


def to_json_rows(df: DataFrame) -> list[str]:
    """Rows of a small frame as JSON texts (dates in ISO form)."""
    return [r[0] for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]


PARTS = ("summary", "trends", "quality")


def dashboard(led, links: DataFrame, runs: DataFrame, *, days: int = 365, parts: tuple[str, ...] = PARTS) -> dict:
    """The dashboard's model as JSON values: summary, trends of the last ``days`` and quality, or some of them."""
    import json

    from . import views

    rows = lambda df: [json.loads(x) for x in to_json_rows(df)]
    out: dict = {}
    if "summary" in parts or "trends" in parts:
        daily = views.daily_health(led).persist()  # the materialization point of all roll-ups
        try:
            if "trends" in parts:
                out |= {k: rows(v) for k, v in trends(led, views.health_calendar(daily), days).items()} | {"days": days}
            if "summary" in parts:
                out["summary"] = rows(summary(led, daily))
        finally:
            daily.unpersist()
    if "quality" in parts:
        audit = rows(diagnostics(led, links, runs))[0]
        audit["coverage"] = rows(coverage(ledger_dates(led), F.current_date()).orderBy("metric", "source"))
        audit["source_runs"] = rows(latest_runs(runs, F.current_timestamp()).orderBy("source"))
        out["quality"] = audit
    return out


def html_report(points: dict[str, DataFrame], stats: DataFrame, path: str, *, most: int = 500) -> None:
    """A static page with the table of relationships and a scatter plot of each; ``points``: name -> (x, y) frame.

    Each plot shows every n-th row, so that at most ``most`` points reach the driver; the file must not exist yet.
    """
    import html

    body = []
    for r in stats.collect():
        frame = points.get(r["relationship"])
        dots = ""
        if frame is not None and (n := frame.count()):
            stride = -(-n // most)
            rows = every_nth(frame, list(frame.columns), stride).collect()
            xs, ys = [float(p[0]) for p in rows], [float(p[1]) for p in rows]
            fit = lambda v, all_: 100 * (v - min(all_)) / ((max(all_) - min(all_)) or 1)
            dots = "".join(f'<circle cx="{fit(x, xs):.1f}" cy="{100 - fit(y, ys):.1f}" r="1"/>' for x, y in zip(xs, ys, strict=True))
        number = lambda v: "n/a" if v is None else f"{v:.3f}"
        body.append(f"<h2>{html.escape(r['relationship'])}</h2><p>n = {r['n']}, r = {number(r['r'])}, 95 % {number(r['ci_low'])} to {number(r['ci_high'])}</p><svg viewBox='0 0 100 100' width='300'>{dots}</svg>")
    folder, _, name = str(path).rpartition("/")
    Files(stats.sparkSession, folder or ".").create(name, f"<!doctype html><meta charset='utf-8'><title>Relationships</title>{''.join(body)}")
