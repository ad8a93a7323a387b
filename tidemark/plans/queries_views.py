"""Registered queries of the composite views, link rules, audits and sources, over ledgers made from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import scalar
from ..sources import apple_health, oura, withings
from . import duplicates, reports, views
from .registry import load, query

PRIORITIES = [("weight_kg", "withings", 1), ("weight_kg", "oura", 2), ("resting_hr_bpm", "oura", 1), ("blood_pressure", "apple_health", 1), ("blood_pressure", "withings", 2), ("sleep", "apple_health", 1), ("sleep", "oura", 2), ("workouts", "manual", 1)]
#: Clicks are the seven masses in turn.
_METRICS = {"view": "resting_hr_bpm", "purchase": "hrv_rmssd_ms", "signup": "steps", "error": "active_energy_kcal"}
_KINDS = {"1-URGENT": "resistance", "2-HIGH": "running", "3-MEDIUM": "walking", "4-NOT SPECIFIED": "cycling", "5-LOW": "mobility"}
_THREE = ("withings", "oura", "apple_health")
_NAMED = '{"apple_health": {"source_name": "Withings Body+"}}'


def _of(value: Column, names: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(value == k, v) for k, v in names.items()])


def _third(n: Column) -> Column:
    return F.when(n % 3 == 0, _THREE[0]).when(n % 3 == 1, _THREE[1]).otherwise(_THREE[2])


def _after(start: Column, seconds: Column) -> Column:
    return (start.cast("timestamp").cast("double") + seconds.cast("double")).cast("timestamp")


def ledgers(spark, sf_dir) -> views.Ledgers:
    """All six ledgers: observations and events from ``events``, pressures and workouts from ``orders``, nights and labs from
    ``lineitem``, every row of each."""
    e, o, li = (load(spark, sf_dir, t) for t in ("events", "orders", "lineitem"))
    n, key, night = F.col("event_id"), F.col("o_orderkey"), F.concat_ws("-", F.lit("n"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)"))
    quality = F.when(n % 7 == 0, "suspect").when(n % 11 == 0, "invalid").otherwise("valid")
    obs = e.select(
        F.concat(F.lit("p"), F.col("user_id") % 7).alias("subject_id"), F.when(F.col("event_type") == "click", F.element_at(F.array(*map(F.lit, views.LAST)), (F.floor(n / 7) % 7 + 1).cast("int"))).otherwise(_of(F.col("event_type"), _METRICS)).alias("metric"), F.col("ts").cast("timestamp").alias("observed_at"), "value", quality.alias("quality"),
        F.when(n % 3 == 0, "America/New_York").when(n % 3 == 1, "UTC").alias("timezone"), F.when(n % 4 != 0, F.to_date("ts")).alias("local_date"), _third(n).alias("source"), F.concat(F.lit("e"), n).alias("source_record_id"), F.when(n % 2 == 0, _NAMED).alias("metadata"),
    )
    at = _after(F.col("o_orderdate"), (key * 137) % 3600)
    bp = o.select(
        F.concat(F.lit("p"), F.col("o_custkey") % 3).alias("subject_id"), at.alias("measured_at"), F.to_date("o_orderdate").alias("local_date"), (100 + F.col("o_custkey") % 60).alias("systolic_mmhg"), (60 + key % 35).alias("diastolic_mmhg"),
        F.when(key % 4 != 0, 50 + key % 40).alias("pulse_bpm"), F.when(key % 13 == 0, "invalid").when(key % 5 == 0, "suspect").otherwise("valid").alias("quality"), _third(key).alias("source"), F.concat(F.lit("b"), key).alias("source_record_id"), F.when(key % 2 == 0, _NAMED).alias("metadata"),
    )
    begin, long = _after(F.col("l_shipdate"), (F.col("l_orderkey") * 41) % 1440 * 60), (F.col("l_quantity") * 600).cast("bigint")
    source = _third(F.col("l_linenumber"))
    apple = source == "apple_health"
    stage = lambda k, other=None: F.when(apple, F.when(F.col("l_partkey") % 6 == k, long)).otherwise(F.lit(None) if other is None else other)
    rest = lambda c: F.when(~apple, c)
    sleep = li.select(
        F.concat(F.lit("p"), F.col("l_suppkey") % 10).alias("subject_id"), F.to_date("l_shipdate").alias("sleep_date"), begin.alias("started_at"), _after(begin, long).alias("ended_at"),
        stage(0, (F.col("l_quantity") * 660).cast("bigint")).alias("time_in_bed_seconds"), stage(1, long).alias("total_sleep_seconds"), stage(2, (F.col("l_quantity") * 60).cast("bigint")).alias("awake_seconds"), stage(3).alias("light_seconds"), stage(4).alias("deep_seconds"), stage(5).alias("rem_seconds"),
        rest(80 + F.col("l_discount") * 100).alias("efficiency_pct"), rest(F.when(F.col("l_orderkey") % 2 == 0, 50.0 + F.col("l_linenumber"))).alias("resting_hr_bpm"), rest(60 + F.col("l_tax") * 100).alias("sleep_score"), rest(F.when(F.col("l_partkey") % 3 > 0, 30 + F.col("l_tax") * 100)).alias("average_hrv_rmssd_ms"), rest(F.when(F.col("l_partkey") % 4 > 0, 12 + F.col("l_discount") * 10)).alias("respiratory_rate"), source.alias("source"), night.alias("source_record_id"),
    )
    start, length = _after(F.col("o_orderdate"), (key * 53) % 86_400), 600 + key % 4800
    workouts = o.select(
        F.concat(F.lit("p"), F.col("o_custkey") % 3).alias("subject_id"), start.alias("started_at"), _after(start, length).alias("ended_at"), F.to_date("o_orderdate").alias("local_date"), _of(F.col("o_orderpriority"), _KINDS).alias("workout_type"), length.alias("duration_seconds"),
        F.when(key % 2 == 0, "manual").otherwise("apple_health").alias("source"), F.concat(F.lit("w"), key).alias("source_record_id"),
    )
    labs = li.select(F.concat(F.lit("p"), F.col("l_suppkey") % 10).alias("subject_id"), F.col("l_shipdate").cast("timestamp").alias("collected_at"), F.when(F.col("l_partkey") % 3 == 0, "ferritin").alias("canonical_name"), F.concat(F.lit("Marker "), F.col("l_partkey") % 20).alias("original_name"), F.col("l_quantity").alias("numeric_value"), F.lit("labs").alias("source"), night.alias("source_record_id"))
    kind = F.when(F.col("event_type") == "purchase", "alcohol").when(F.col("event_type") == "error", "illness").otherwise("travel")
    events = e.select(F.concat(F.lit("p"), F.col("user_id") % 7).alias("subject_id"), kind.alias("event_type"), F.col("ts").cast("timestamp").alias("started_at"), F.to_date("ts").alias("local_date"), (F.col("value") / 25).alias("value"), F.lit("manual").alias("source"), F.concat(F.lit("v"), n).alias("source_record_id"))
    tables = {"observations": obs, "blood_pressure": bp, "sleep_sessions": sleep, "workouts": workouts, "lab_results": labs, "events": events}
    return views.Ledgers(spark, tables, spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, PRIORITIES))} AS v(data_type, source, priority)"))


def _case(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


def _thirds(n: str) -> str:
    return f"CASE {n} % 3 WHEN 0 THEN 'withings' WHEN 1 THEN 'oura' ELSE 'apple_health' END"


def _longest(column: str) -> str:
    return f"first({column} ORDER BY coalesce(total_sleep, 0) DESC, source_record_id DESC) FILTER (WHERE {column} IS NOT NULL)"


_DIMS = views.DIMENSIONS
_NIGHT = "concat_ws('-', 'n', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(18,2)))"
_STAGES = {"time_in_bed": "l_quantity * 660", "total_sleep": "l_quantity * 600", "awake": "l_quantity * 60", "light": "NULL", "deep": "NULL", "rem": "NULL"}
LEDGER_SQL = f"""
WITH pr AS (SELECT * FROM (VALUES {", ".join(str(p) for p in PRIORITIES)}) AS v(data_type, psource, ppriority)),
obs AS (SELECT 'p' || user_id % 7 AS subject_id, CASE WHEN event_type = 'click' THEN list_extract({list(views.LAST)}, (event_id // 7) % 7 + 1) ELSE {_case("event_type", _METRICS)} END AS metric, ts AS observed_at, value, CASE WHEN event_id % 7 = 0 THEN 'suspect' WHEN event_id % 11 = 0 THEN 'invalid' ELSE 'valid' END AS quality,
  CASE event_id % 3 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'UTC' END AS timezone, CASE WHEN event_id % 4 <> 0 THEN CAST(ts AS DATE) END AS local_date, {_thirds("event_id")} AS source, 'e' || event_id AS source_record_id, event_id % 2 = 0 AS named FROM events),
bp AS (SELECT 'p' || o_custkey % 3 AS subject_id, o_orderdate + to_seconds((o_orderkey * 137) % 3600) AS measured_at, CAST(o_orderdate AS DATE) AS local_date, CAST(100 + o_custkey % 60 AS DOUBLE) AS systolic, CAST(60 + o_orderkey % 35 AS DOUBLE) AS diastolic,
  CASE WHEN o_orderkey % 4 <> 0 THEN CAST(50 + o_orderkey % 40 AS DOUBLE) END AS pulse, CASE WHEN o_orderkey % 13 = 0 THEN 'invalid' WHEN o_orderkey % 5 = 0 THEN 'suspect' ELSE 'valid' END AS quality, {_thirds("o_orderkey")} AS source, 'b' || o_orderkey AS source_record_id, o_orderkey % 2 = 0 AS named FROM orders),
sl0 AS (SELECT *, {_thirds("l_linenumber")} AS source, l_shipdate + to_seconds((l_orderkey * 41) % 1440 * 60) AS started_at FROM lineitem),
sl AS (SELECT 'p' || l_suppkey % 10 AS subject_id, CAST(l_shipdate AS DATE) AS sleep_date, started_at, started_at + to_seconds(CAST(l_quantity * 600 AS BIGINT)) AS ended_at, source, {_NIGHT} AS source_record_id,
  {", ".join(f"CASE WHEN source = 'apple_health' THEN CASE WHEN l_partkey % 6 = {k} THEN CAST(l_quantity * 600 AS BIGINT) END ELSE CAST({other} AS BIGINT) END AS {d}" for k, (d, other) in enumerate(_STAGES.items()))},
  CASE WHEN source <> 'apple_health' THEN 80 + l_discount * 100 END AS efficiency_pct, CASE WHEN source <> 'apple_health' AND l_orderkey % 2 = 0 THEN 50.0::DOUBLE + l_linenumber END AS resting, CASE WHEN source <> 'apple_health' THEN 60 + l_tax * 100 END AS score, CASE WHEN source <> 'apple_health' AND l_partkey % 3 > 0 THEN 30 + l_tax * 100 END AS nightly_hrv, CASE WHEN source <> 'apple_health' AND l_partkey % 4 > 0 THEN 12 + l_discount * 10 END AS breaths FROM sl0),
wk AS (SELECT 'p' || o_custkey % 3 AS subject_id, o_orderdate + to_seconds((o_orderkey * 53) % 86400) AS started_at, o_orderdate + to_seconds((o_orderkey * 53) % 86400 + 600 + o_orderkey % 4800) AS ended_at, CAST(o_orderdate AS DATE) AS local_date, {_case("o_orderpriority", _KINDS)} AS workout_type,
  600 + o_orderkey % 4800 AS duration_seconds, CASE WHEN o_orderkey % 2 = 0 THEN 'manual' ELSE 'apple_health' END AS source, 'w' || o_orderkey AS source_record_id FROM orders),
lab AS (SELECT CAST(l_shipdate AS DATE) AS d, coalesce(CASE WHEN l_partkey % 3 = 0 THEN 'ferritin' END, 'Marker ' || l_partkey % 20) AS name FROM lineitem),
ev AS (SELECT 'p' || user_id % 7 AS subject_id, CASE event_type WHEN 'purchase' THEN 'alcohol' WHEN 'error' THEN 'illness' ELSE 'travel' END AS event_type, CAST(ts AS DATE) AS local_date, value / 25 AS value FROM events),
co AS (SELECT * EXCLUDE (k) FROM (SELECT *, dense_rank() OVER (PARTITION BY subject_id, metric, canonical_date ORDER BY CASE quality WHEN 'valid' THEN 0 ELSE 1 END, priority, source) AS k FROM (SELECT obs.*, coalesce(local_date, CAST(timezone(coalesce(timezone, 'UTC'), timezone('UTC', observed_at)) AS DATE)) AS canonical_date, coalesce(ppriority, 10000) AS priority FROM obs LEFT JOIN pr ON data_type = metric AND psource = source WHERE quality <> 'invalid')) WHERE k = 1),
cb AS (SELECT * EXCLUDE (k) FROM (SELECT *, dense_rank() OVER (PARTITION BY subject_id, local_date ORDER BY CASE quality WHEN 'valid' THEN 0 ELSE 1 END, priority, source) AS k FROM (SELECT bp.*, coalesce(ppriority, 10000) AS priority FROM bp LEFT JOIN pr ON data_type = 'blood_pressure' AND psource = source WHERE quality <> 'invalid')) WHERE k = 1),
sr0 AS (SELECT *, sum(CASE WHEN b IS NULL OR epoch(measured_at) - epoch(b) > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id, local_date, source ORDER BY measured_at, source_record_id ROWS UNBOUNDED PRECEDING) AS session_number FROM (SELECT *, lag(measured_at) OVER (PARTITION BY subject_id, local_date, source ORDER BY measured_at, source_record_id) AS b FROM cb)),
sr AS (SELECT * EXCLUDE (session_number), CAST(session_number AS BIGINT) AS session_number, row_number() OVER (PARTITION BY subject_id, local_date, source, session_number ORDER BY measured_at, source_record_id) AS n FROM sr0),
bs AS (SELECT source || ':' || CAST(local_date AS VARCHAR) || ':' || session_number AS session_id, subject_id, local_date, source, session_number, min(measured_at) AS session_started_at, max(measured_at) AS session_ended_at, count(*) AS reading_count,
  {", ".join(f"first({v} ORDER BY measured_at, source_record_id) AS first_{v}, avg({v}) FILTER (WHERE n > 1) AS subsequent_{v}, avg({v}) AS session_{v}, coalesce(avg({v}) FILTER (WHERE n > 1), first({v} ORDER BY measured_at, source_record_id)) AS preferred_{v}" for v in ("systolic", "diastolic", "pulse"))} FROM sr GROUP BY subject_id, local_date, source, session_number),
sp AS (SELECT sl.*, coalesce(ppriority, 10000) AS priority FROM sl LEFT JOIN pr ON data_type = 'sleep' AND psource = source),
cs AS (SELECT * EXCLUDE (k) FROM (SELECT *, dense_rank() OVER (PARTITION BY subject_id, sleep_date ORDER BY priority, source) AS k FROM sp) WHERE k = 1),
cw AS (SELECT * EXCLUDE (k) FROM (SELECT *, dense_rank() OVER (PARTITION BY subject_id, local_date, workout_type ORDER BY priority, source) AS k FROM (SELECT wk.*, coalesce(ppriority, 10000) AS priority FROM wk LEFT JOIN pr ON data_type = 'workouts' AND psource = source)) WHERE k = 1),
a0 AS (SELECT *, max(ended_at) OVER (PARTITION BY subject_id ORDER BY started_at, ended_at, source_record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM sp WHERE source = 'apple_health'),
a1 AS (SELECT *, sum(CASE WHEN b IS NULL OR started_at > b + INTERVAL 4 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id ORDER BY started_at, ended_at, source_record_id ROWS UNBOUNDED PRECEDING) AS episode FROM a0),
a2 AS (SELECT *, max(sleep_date) OVER (PARTITION BY subject_id, episode) AS wake_date FROM a1),
a3 AS ({" UNION ALL ".join(f"SELECT subject_id, episode, wake_date, priority, started_at, ended_at, '{d}' AS dimension FROM a2 WHERE {d} IS NOT NULL" for d in _DIMS)}),
a4 AS (SELECT *, max(ended_at) OVER (PARTITION BY subject_id, episode, wake_date, priority, dimension ORDER BY started_at, ended_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM a3),
a5 AS (SELECT *, sum(CASE WHEN b IS NULL OR started_at > b THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id, episode, wake_date, priority, dimension ORDER BY started_at, ended_at ROWS UNBOUNDED PRECEDING) AS island FROM a4),
a6 AS (SELECT subject_id, wake_date, priority, dimension, date_diff('second', min(started_at), max(ended_at)) AS seconds FROM a5 GROUP BY subject_id, episode, wake_date, priority, dimension, island),
sd0 AS (SELECT subject_id, wake_date AS local_date, {", ".join(f"sum(seconds) FILTER (WHERE dimension = '{d}') / 60.0 AS {m}" for d, m in views.MINUTES.items())}, NULL AS sleep_efficiency_pct, NULL AS sleep_resting_hr_bpm, NULL AS sleep_score, NULL AS sleep_hrv_rmssd_ms, NULL AS respiratory_rate, 'apple_health' AS source_name, priority FROM a6 GROUP BY subject_id, wake_date, priority
  UNION ALL SELECT subject_id, sleep_date, {", ".join(f"sum({d}) / 60.0" for d in _DIMS)}, avg(efficiency_pct), {_longest('resting')}, {_longest('score')}, {_longest('nightly_hrv')}, {_longest('breaths')}, source, priority FROM sp WHERE source <> 'apple_health' GROUP BY subject_id, sleep_date, source, priority),
sd AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, local_date ORDER BY priority, source_name) AS k FROM sd0) WHERE k = 1),
f1 AS (SELECT subject_id, canonical_date AS local_date, {", ".join(f"first(value ORDER BY observed_at DESC, source_record_id DESC) FILTER (WHERE metric = '{m}' AND value IS NOT NULL) AS {m}" for m in views.LAST)}, avg(value) FILTER (WHERE metric = 'resting_hr_bpm') AS hr, avg(value) FILTER (WHERE metric = 'hrv_rmssd_ms') AS hrv, sum(value) FILTER (WHERE metric = 'steps') AS steps, sum(value) FILTER (WHERE metric = 'active_energy_kcal') AS active_energy_kcal FROM co GROUP BY ALL),
f2 AS (SELECT subject_id, local_date, avg(preferred_systolic) AS systolic_mmhg, avg(preferred_diastolic) AS diastolic_mmhg, avg(preferred_pulse) AS blood_pressure_pulse_bpm, count(*) AS blood_pressure_session_count, CAST(sum(reading_count) AS BIGINT) AS blood_pressure_reading_count FROM bs GROUP BY ALL),
f4 AS (SELECT subject_id, local_date, sum(duration_seconds) FILTER (WHERE workout_type = 'resistance') / 60.0 AS resistance_minutes, sum(duration_seconds) FILTER (WHERE workout_type IN {views.CARDIO}) / 60.0 AS cardio_minutes, count(*) AS workout_count FROM cw GROUP BY ALL),
f5 AS (SELECT subject_id, local_date, sum(value) FILTER (WHERE event_type = 'alcohol') AS alcohol_units, count(*) FILTER (WHERE event_type = 'alcohol') AS alcohol_event_count, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS event_types FROM ev GROUP BY ALL),
sn AS (SELECT subject_id, local_date FROM f1 UNION SELECT subject_id, local_date FROM f2 UNION SELECT subject_id, local_date FROM sd UNION SELECT subject_id, local_date FROM f4 UNION SELECT subject_id, local_date FROM f5),
daily AS (SELECT subject_id, local_date, {", ".join(views.LAST)}, steps, active_energy_kcal, systolic_mmhg, diastolic_mmhg, blood_pressure_pulse_bpm, blood_pressure_session_count, blood_pressure_reading_count, {", ".join(views.MINUTES.values())}, sleep_efficiency_pct, sleep_score, respiratory_rate, source_name,
  resistance_minutes, cardio_minutes, workout_count, alcohol_units, alcohol_event_count, event_types, coalesce(hr, sleep_resting_hr_bpm) AS resting_hr_bpm, coalesce(hrv, sleep_hrv_rmssd_ms) AS hrv_rmssd_ms
  FROM sn LEFT JOIN f1 USING (subject_id, local_date) LEFT JOIN f2 USING (subject_id, local_date) LEFT JOIN sd USING (subject_id, local_date) LEFT JOIN f4 USING (subject_id, local_date) LEFT JOIN f5 USING (subject_id, local_date)),
cal AS (SELECT * FROM (SELECT subject_id, CAST(unnest(generate_series(min(local_date), max(local_date), INTERVAL 1 DAY)) AS DATE) AS local_date FROM daily GROUP BY subject_id) LEFT JOIN daily USING (subject_id, local_date))
"""
_EXERCISED = "{x}resistance_minutes IS NOT NULL OR {x}cardio_minutes IS NOT NULL"
_ROLLUP = {
    "weight_kg_avg": "avg({x}weight_kg)", "weight_days": "count({x}weight_kg)", "systolic_mmhg_avg": "avg({x}systolic_mmhg)", "diastolic_mmhg_avg": "avg({x}diastolic_mmhg)", "blood_pressure_days": "count({x}systolic_mmhg)", "hrv_rmssd_ms_avg": "avg({x}hrv_rmssd_ms)", "hrv_days": "count({x}hrv_rmssd_ms)",
    "resting_hr_bpm_avg": "avg({x}resting_hr_bpm)", "resting_hr_days": "count({x}resting_hr_bpm)", "total_sleep_minutes_avg": "avg({x}total_sleep_minutes)", "sleep_days": "count({x}total_sleep_minutes)", "steps_total": "sum({x}steps)", "steps_daily_avg": "avg({x}steps)", "steps_days": "count({x}steps)",
    "resistance_minutes_total": "sum({x}resistance_minutes)", "cardio_minutes_total": "sum({x}cardio_minutes)", "exercise_minutes_total": f"sum(CASE WHEN {_EXERCISED} THEN coalesce({{x}}resistance_minutes, 0) + coalesce({{x}}cardio_minutes, 0) END)", "workout_count": "CAST(sum({x}workout_count) AS BIGINT)", "exercise_days": f"count(CASE WHEN {_EXERCISED} THEN 1 END)",
}
_REAL = [c for c in _ROLLUP if c.endswith(("_avg", "_total"))]
_DAILY_REAL = [*views.LAST, "respiratory_rate", "steps", "active_energy_kcal", "systolic_mmhg", "diastolic_mmhg", "blood_pressure_pulse_bpm", *views.MINUTES.values(), "sleep_efficiency_pct", "sleep_score", "resistance_minutes", "cardio_minutes", "alcohol_units", "resting_hr_bpm", "hrv_rmssd_ms"]
_BS_REAL = [f"{k}_{v}" for v in ("systolic", "diastolic", "pulse") for k in ("subsequent", "session", "preferred")]


def _rolled(x: str = "") -> str:
    return ", ".join(f"{f.format(x=x)} AS {c}" for c, f in _ROLLUP.items())


def _rounds(*columns: str) -> str:
    """Four digits; what lies half-way but for the order of a sum is pushed up on both sides."""
    return "REPLACE (" + ", ".join(f"round({c} + 1e-8, 4) AS {c}" for c in columns) + ")"


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(f.name) + 1e-8, 4).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema])


@query(LEDGER_SQL + "SELECT subject_id, metric, canonical_date, source, source_record_id, quality, CAST(priority AS INTEGER) AS priority, round(value + 1e-8, 4) AS value FROM co")
def canonical_observations(spark, sf_dir):
    return rounded(views.canonical_observations(ledgers(spark, sf_dir)).select("subject_id", "metric", "canonical_date", "source", "source_record_id", "quality", "priority", "value"))


@query(LEDGER_SQL + "SELECT subject_id, local_date, source, source_record_id, quality, CAST(priority AS INTEGER) AS priority, measured_at FROM cb")
def canonical_blood_pressure(spark, sf_dir):
    return views.canonical_blood_pressure(ledgers(spark, sf_dir)).select("subject_id", "local_date", "source", "source_record_id", "quality", "priority", F.col("measured_at").cast("timestamp_ntz").alias("measured_at"))


@query(LEDGER_SQL + "SELECT subject_id, local_date, source, source_record_id, session_number, n AS session_reading_number FROM sr")
def blood_pressure_session_readings(spark, sf_dir):
    return views.blood_pressure_session_readings(ledgers(spark, sf_dir)).select("subject_id", "local_date", "source", "source_record_id", "session_number", "session_reading_number")


@query(LEDGER_SQL + f"SELECT * {_rounds(*_BS_REAL)} FROM bs")
def blood_pressure_sessions(spark, sf_dir):
    s = views.blood_pressure_sessions(ledgers(spark, sf_dir))
    for c in ("session_started_at", "session_ended_at"):
        s = s.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return rounded(s.withColumnsRenamed({c: c.removesuffix("_mmhg").removesuffix("_bpm") for c in s.columns}))


@query(LEDGER_SQL + "SELECT subject_id, sleep_date, source, source_record_id, CAST(priority AS INTEGER) AS priority FROM cs")
def canonical_sleep_sessions(spark, sf_dir):
    return views.canonical_sleep_sessions(ledgers(spark, sf_dir)).select("subject_id", "sleep_date", "source", "source_record_id", "priority")


@query(LEDGER_SQL + "SELECT subject_id, local_date, workout_type, source, source_record_id, CAST(priority AS INTEGER) AS priority, duration_seconds FROM cw")
def canonical_workouts(spark, sf_dir):
    return views.canonical_workouts(ledgers(spark, sf_dir)).select("subject_id", "local_date", "workout_type", "source", "source_record_id", "priority", "duration_seconds")


@query(LEDGER_SQL + f"SELECT * EXCLUDE (priority) {_rounds(*views.MINUTES.values(), 'sleep_efficiency_pct', 'sleep_resting_hr_bpm', 'sleep_score', 'sleep_hrv_rmssd_ms', 'respiratory_rate')}, CAST(priority AS INTEGER) AS priority FROM sd")
def canonical_sleep_daily(spark, sf_dir):
    return rounded(views.canonical_sleep_daily(ledgers(spark, sf_dir)))


@query(LEDGER_SQL + f"SELECT * {_rounds(*_DAILY_REAL)} FROM daily")
def daily_health(spark, sf_dir):
    return rounded(views.daily_health(ledgers(spark, sf_dir)))


def _calendar(spark, sf_dir) -> DataFrame:
    return views.health_calendar(views.daily_health(ledgers(spark, sf_dir)))


@query(LEDGER_SQL + f"SELECT * {_rounds(*_DAILY_REAL)} FROM cal")
def health_calendar(spark, sf_dir):
    return rounded(_calendar(spark, sf_dir))


@query(LEDGER_SQL + f"SELECT * {_rounds(*_REAL)}, week_start + 6 AS week_end FROM (SELECT subject_id, CAST(date_trunc('week', local_date) AS DATE) AS week_start, count(*) AS calendar_days, {_rolled()} FROM cal GROUP BY 1, 2)")
def weekly_health(spark, sf_dir):
    return rounded(views.weekly_health(_calendar(spark, sf_dir)))


_WINDOWS = f"""SELECT a.subject_id, a.local_date AS anchor_date, CAST(w AS INTEGER) AS window_days, CAST(a.local_date - CAST(w - 1 AS INTEGER) AS DATE) AS window_start, a.local_date AS window_end, count(*) AS calendar_days, {_rolled("x.")}
FROM {{anchors}} a CROSS JOIN (SELECT unnest([7, 30, 90, 365]) AS w) JOIN cal x ON x.subject_id = a.subject_id AND x.local_date BETWEEN a.local_date - CAST(w - 1 AS INTEGER) AND a.local_date GROUP BY ALL"""


@query(LEDGER_SQL + f"SELECT * {_rounds(*_REAL)} FROM ({_WINDOWS.format(anchors='cal')})")
def rolling_health(spark, sf_dir):
    return rounded(views.rolling_health(_calendar(spark, sf_dir)))


@query(LEDGER_SQL + f"SELECT * {_rounds(*_REAL)} FROM ({_WINDOWS.format(anchors='(SELECT subject_id, max(local_date) AS local_date FROM cal GROUP BY subject_id)')})")
def rolling_health_latest(spark, sf_dir):
    return rounded(views.rolling_health_latest(_calendar(spark, sf_dir)))


_OUTCOMES = ("total_sleep_minutes", "hrv_rmssd_ms", "resting_hr_bpm", "systolic_mmhg", "diastolic_mmhg")
_LAGGED = f"""lagged AS (SELECT a.subject_id, a.local_date AS predictor_date, coalesce(a.alcohol_units, 0) AS alcohol_units, coalesce(a.resistance_minutes, 0) + coalesce(a.cardio_minutes, 0) AS exercise_minutes, a.weight_kg * {scalar.LB_PER_KG} AS weight_lb, a.total_sleep_minutes AS wake_date_sleep_minutes, a.hrv_rmssd_ms AS wake_date_hrv_rmssd_ms, a.resting_hr_bpm AS wake_date_resting_hr_bpm,
  a.systolic_mmhg AS same_day_systolic_mmhg, a.diastolic_mmhg AS same_day_diastolic_mmhg, lead(a.local_date) OVER w AS outcome_date, {", ".join(f"lead(a.{o}) OVER w AS next_day_{o}" for o in _OUTCOMES)} FROM cal a WINDOW w AS (PARTITION BY a.subject_id ORDER BY a.local_date))
"""
_LAGGED_REAL = ["alcohol_units", "exercise_minutes", "weight_lb", "wake_date_sleep_minutes", "wake_date_hrv_rmssd_ms", "wake_date_resting_hr_bpm", "same_day_systolic_mmhg", "same_day_diastolic_mmhg", *[f"next_day_{o}" for o in _OUTCOMES]]


@query(LEDGER_SQL + ", " + _LAGGED + f"SELECT * {_rounds(*_LAGGED_REAL)} FROM lagged")
def analysis_daily_lagged(spark, sf_dir):
    return rounded(views.analysis_daily_lagged(_calendar(spark, sf_dir)))


@query(
    LEDGER_SQL + ", " + _LAGGED + ", p AS (" + " UNION ALL ".join(f"SELECT '{n}' AS relationship, {x}::DOUBLE AS x, {y}::DOUBLE AS y FROM lagged WHERE {x} IS NOT NULL AND {y} IS NOT NULL" for n, x, y in views.RELATIONSHIPS) + f"""),
names AS (SELECT unnest({[n for n, _, _ in views.RELATIONSHIPS]}) AS relationship),
s AS (SELECT relationship, count(x) AS n, CASE WHEN count(x) >= 3 AND stddev_pop(x) * stddev_pop(y) > 0 THEN least(1, greatest(-1, covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)))) END AS r FROM names LEFT JOIN p USING (relationship) GROUP BY relationship)
SELECT relationship, n, round(r + 1e-8, 4) AS r, round(CASE WHEN n >= 4 AND r IS NOT NULL THEN tanh(atanh(least(0.999999, greatest(-0.999999, r))) - 1.96 / sqrt(n - 3)) END + 1e-8, 4) AS ci_low, round(CASE WHEN n >= 4 AND r IS NOT NULL THEN tanh(atanh(least(0.999999, greatest(-0.999999, r))) + 1.96 / sqrt(n - 3)) END + 1e-8, 4) AS ci_high FROM s"""
)
def relationship_report(spark, sf_dir):
    return rounded(reports.relationship_report(views.analysis_daily_lagged(_calendar(spark, sf_dir))))


_DATES = "dates AS (SELECT metric, source, coalesce(local_date, CAST(observed_at AS DATE)) AS d FROM obs UNION ALL SELECT 'blood_pressure', source, local_date FROM bp UNION ALL SELECT 'sleep', source, sleep_date FROM sl UNION ALL SELECT 'workout:' || workout_type, source, local_date FROM wk UNION ALL SELECT 'lab:' || name, 'labs', d FROM lab UNION ALL SELECT 'event:' || event_type, 'manual', local_date FROM ev)"
_COVERAGE = """coverage AS (SELECT metric, source, min(d) AS first_date, max(d) AS last_date, count(*) AS records, count(DISTINCT d) AS observed_days, date_diff('day', min(d), max(d)) + 1 AS span_days, date_diff('day', min(d), max(d)) + 1 - count(DISTINCT d) AS missing_days,
  round_even(count(DISTINCT d) * 100.0::DOUBLE / (date_diff('day', min(d), max(d)) + 1), 1) AS coverage, CASE WHEN metric LIKE 'event:%' OR metric LIKE 'workout:%' THEN 'episodic' WHEN metric LIKE 'lab:%' OR metric IN ('weight', 'body_fat', 'blood_pressure') THEN 'periodic' ELSE 'daily' END AS cadence,
  CASE WHEN metric LIKE 'event:%' OR metric LIKE 'workout:%' THEN 'episodic' WHEN date_diff('day', max(d), DATE '2024-02-01') <= CASE WHEN metric LIKE 'lab:%' OR metric IN ('weight', 'body_fat', 'blood_pressure') THEN 30 ELSE 3 END THEN 'current' ELSE 'stale' END AS freshness FROM dates GROUP BY metric, source)
"""


def _today() -> Column:
    return F.lit("2024-02-01").cast("date")


@query(LEDGER_SQL + ", " + _DATES + ", " + _COVERAGE + "SELECT * FROM coverage")
def coverage_of_ledgers(spark, sf_dir):
    return reports.coverage(reports.ledger_dates(ledgers(spark, sf_dir)), _today())


def _runs(spark, sf_dir) -> DataFrame:
    o, key = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "running").otherwise("succeeded")
    start = F.col("o_orderdate").cast("timestamp")
    return schemas.conform(o.select(F.format_string("r%012d", key).alias("run_id"), F.concat(F.lit("s"), F.col("o_custkey") % 9).alias("source"), status.alias("status"), start.alias("started_at"), _after(start, key % 50).alias("finished_at"), (F.col("o_custkey") * 3).alias("normalized_count")), schemas.INGESTION_RUNS)


_RUNS = "runs AS (SELECT printf('r%012d', o_orderkey) AS run_id, 's' || o_custkey % 9 AS source, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'running' ELSE 'succeeded' END AS status, o_orderdate AS started_at, o_orderkey % 50 AS seconds, o_custkey * 3 AS normalized_count FROM orders)"


@query(f"WITH {_RUNS} SELECT source, run_id, normalized_count, CAST(seconds AS DOUBLE) AS duration_seconds, CASE WHEN seconds > 0 THEN round_even(normalized_count / seconds::DOUBLE, 1) END AS throughput_per_second, CAST(greatest(floor((epoch(TIMESTAMP '2003-01-01') - epoch(started_at + to_seconds(seconds))) / 86400), 0) AS BIGINT) AS age_days FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, run_id DESC) AS k FROM runs WHERE status = 'succeeded') WHERE k = 1")
def latest_successful_runs(spark, sf_dir):
    now = F.lit("2003-01-01 00:00:00").cast("timestamp")
    return reports.latest_runs(_runs(spark, sf_dir), now).select("source", "run_id", "normalized_count", "duration_seconds", "throughput_per_second", "age_days")


def _links(spark, sf_dir) -> DataFrame:
    e = load(spark, sf_dir, "events")
    n = F.col("event_id") % 4
    return e.select(F.when(n == 0, "candidate").when(n == 1, "rejected").otherwise("confirmed").alias("resolution"))


@query(
    LEDGER_SQL + ", " + _DATES + ", " + _COVERAGE + ", " + _RUNS + """, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, run_id DESC) AS k FROM runs) WHERE k = 1),
c AS (SELECT (SELECT count(*) FROM (SELECT quality FROM obs UNION ALL SELECT quality FROM bp) WHERE quality = 'suspect') AS suspect_records, (SELECT count(*) FROM (SELECT quality FROM obs UNION ALL SELECT quality FROM bp) WHERE quality = 'invalid') AS invalid_records,
  (SELECT count(*) FROM events WHERE event_id % 4 = 0) AS duplicate_candidates, (SELECT count(*) FROM events WHERE event_id % 4 > 1) AS duplicate_confirmed, (SELECT count(*) FROM events WHERE event_id % 4 = 1) AS duplicate_rejected, (SELECT count(*) FROM sd WHERE total_sleep_minutes > 1440) AS sleep_over_24h, (SELECT count(*) FROM sd WHERE total_sleep_minutes > 960) AS sleep_over_16h,
  (SELECT count(*) FROM last WHERE status = 'failed') AS latest_failed_imports, (SELECT count(*) FROM last WHERE status = 'running') AS latest_running_imports, (SELECT count(DISTINCT source) FROM runs WHERE status = 'succeeded') AS source_import_count, (SELECT count(*) FROM coverage) AS metric_source_count, (SELECT count(*) FROM coverage WHERE freshness = 'stale') AS stale_metric_sources)
SELECT *, CASE WHEN invalid_records + duplicate_candidates + sleep_over_24h + latest_failed_imports > 0 THEN 'attention' WHEN suspect_records + sleep_over_16h + latest_running_imports > 0 THEN 'review' ELSE 'clear' END AS status FROM c"""
)
def diagnostics(spark, sf_dir):
    return reports.diagnostics(ledgers(spark, sf_dir), _links(spark, sf_dir), _runs(spark, sf_dir), _today())


def _newest(name: str, unit: str, value: str, table: str, day: str, tie: str = "") -> str:
    return f"SELECT subject_id, '{name}' AS name, round(first({value} ORDER BY {day} DESC{tie}) + 1e-8, 4) AS value, '{unit}' AS unit, max({day}) AS date FROM {table} WHERE {value} IS NOT NULL GROUP BY subject_id"


@query(
    LEDGER_SQL + " UNION ALL ".join([
        _newest("weight", "lb", f"value * {scalar.LB_PER_KG}", "(SELECT * FROM co WHERE metric = 'weight_kg')", "canonical_date", ", observed_at DESC, source_record_id DESC"),
        _newest("resting_hr", "bpm", "value", "(SELECT * FROM co WHERE metric = 'resting_hr_bpm')", "canonical_date", ", observed_at DESC, source_record_id DESC"),
        _newest("hrv", "ms", "hrv_rmssd_ms", "daily", "local_date"),
        _newest("systolic", "mmHg", "preferred_systolic", "bs", "local_date", ", session_ended_at DESC, session_id DESC"),
        _newest("diastolic", "mmHg", "preferred_diastolic", "bs", "local_date", ", session_ended_at DESC, session_id DESC"),
        _newest("sleep", "min", "total_sleep_minutes", "sd", "local_date"),
    ])
)
def dashboard_summary(spark, sf_dir):
    led = ledgers(spark, sf_dir)
    return rounded(reports.summary(led, views.daily_health(led)))


_BOUNDS = "last_day AS (SELECT subject_id, max(d) AS last FROM (SELECT subject_id, coalesce(local_date, CAST(observed_at AS DATE)) AS d FROM obs UNION ALL SELECT subject_id, local_date FROM bp UNION ALL SELECT subject_id, sleep_date FROM sl UNION ALL SELECT subject_id, local_date FROM wk UNION ALL SELECT subject_id, local_date FROM ev) GROUP BY subject_id)"


@query(LEDGER_SQL + f", {_BOUNDS} SELECT * REPLACE (round(weight_kg * {scalar.LB_PER_KG} + 1e-8, 4) AS weight_kg, {', '.join(f'round({c} + 1e-8, 4) AS {c}' for c in _DAILY_REAL if c != 'weight_kg')}) FROM (SELECT cal.* FROM cal JOIN last_day USING (subject_id) WHERE local_date > last - 90)")
def dashboard_trends_daily(spark, sf_dir):
    led = ledgers(spark, sf_dir)
    return rounded(reports.trends(led, views.health_calendar(views.daily_health(led)), 90)["daily"])


@query(LEDGER_SQL + f", {_BOUNDS} SELECT * REPLACE (round(weight_kg_avg * {scalar.LB_PER_KG} + 1e-8, 4) AS weight_kg_avg, {', '.join(f'round({c} + 1e-8, 4) AS {c}' for c in _REAL if c != 'weight_kg_avg')}), week_start + 6 AS week_end FROM (SELECT subject_id, CAST(date_trunc('week', local_date) AS DATE) AS week_start, count(*) AS calendar_days, {_rolled()} FROM (SELECT cal.* FROM cal JOIN last_day USING (subject_id) WHERE local_date > last - 371) GROUP BY 1, 2)")
def dashboard_trends_weekly(spark, sf_dir):
    led = ledgers(spark, sf_dir)
    return rounded(reports.trends(led, views.health_calendar(views.daily_health(led)), 365)["weekly"])


# ---------------------------------------------------------------- link rules

_VENDOR = "regexp_replace(lower({s}), '[^a-z0-9]+', '', 'g')"
_PROVENANCE = " OR ".join(f"(coalesce({x}.named, false) AND {x}.source = 'apple_health' AND (contains('withingsbody', {_VENDOR.format(s=f'{y}.source')}) OR contains({_VENDOR.format(s=f'{y}.source')}, 'withingsbody')))" for x, y in (("a", "b"), ("b", "a")))
_LINKED = "SELECT '{kind}' AS record_type, CASE WHEN (ap, asrc, aid) <= (bp_, bsrc, bid) THEN aid ELSE bid END AS canonical_id, CASE WHEN (ap, asrc, aid) <= (bp_, bsrc, bid) THEN bid ELSE aid END AS duplicate_id, match_method, round(confidence + 1e-8, 4) AS confidence, CASE WHEN confidence >= 0.9 THEN 'confirmed' ELSE 'candidate' END AS resolution FROM m WHERE match_method IS NOT NULL"
_SIDES = "coalesce(pa.ppriority, 10000) AS ap, a.source AS asrc, {a} AS aid, coalesce(pb.ppriority, 10000) AS bp_, b.source AS bsrc, {b} AS bid"


def _pair_sql(table: str, kind: str, data_type: str, on: str, facts: str, method: str, confidence: str, key: str = "{x}.source || '|' || {x}.source_record_id") -> str:
    a, b = key.format(x="a"), key.format(x="b")
    return LEDGER_SQL + f""", q AS (SELECT {_SIDES.format(a=a, b=b)}, ({_PROVENANCE}) AS prov, {facts}
  FROM {table} a JOIN {table} b ON a.subject_id = b.subject_id AND a.source <> b.source AND {a} < {b} AND {on} LEFT JOIN pr pa ON pa.data_type = {data_type.format(x='a')} AND pa.psource = a.source LEFT JOIN pr pb ON pb.data_type = {data_type.format(x='b')} AND pb.psource = b.source),
m AS (SELECT *, {method} AS match_method, {confidence} AS confidence FROM q)
""" + _LINKED.format(kind=kind)


def _shown(links: DataFrame) -> DataFrame:
    return links.select("record_type", "canonical_id", "duplicate_id", "match_method", scalar.rounded(F.col("confidence") + 1e-8, 4).alias("confidence"), "resolution")


@query(_pair_sql(
    "(SELECT * FROM obs WHERE quality <> 'invalid')", "observation", "{x}.metric", "a.metric = b.metric AND abs(epoch(a.observed_at) - epoch(b.observed_at)) <= 600",
    "abs(epoch(a.observed_at) - epoch(b.observed_at)) AS dt, abs(a.value - b.value) AS gap, abs(a.value - b.value) / greatest(abs(a.value), abs(b.value), 1) AS rel",
    "CASE WHEN prov AND dt <= 60 AND rel <= 0.01 THEN 'apple_provenance' WHEN dt <= 1 AND gap <= 1e-6 THEN 'exact' WHEN rel <= 0.05 THEN 'heuristic' END",
    "CASE WHEN prov AND dt <= 60 AND rel <= 0.01 THEN 0.99 WHEN dt <= 1 AND gap <= 1e-6 THEN 0.98 ELSE greatest(0.7, 0.9 - dt / 6000 - 2 * rel) END",
    "{x}.source || '|' || {x}.source_record_id || '|' || {x}.metric",
))
def links_of_observations(spark, sf_dir):
    return _shown(duplicates.observation_links(ledgers(spark, sf_dir)))


@query(_pair_sql(
    "(SELECT * FROM bp WHERE quality <> 'invalid')", "blood_pressure", "'blood_pressure'", "abs(epoch(a.measured_at) - epoch(b.measured_at)) <= 300",
    "abs(epoch(a.measured_at) - epoch(b.measured_at)) AS dt, greatest(abs(a.systolic - b.systolic), abs(a.diastolic - b.diastolic)) AS far",
    "CASE WHEN prov AND far <= 1 THEN 'apple_provenance' WHEN dt <= 1 AND far = 0 THEN 'exact' WHEN far <= 5 THEN 'heuristic' END", "CASE WHEN prov AND far <= 1 THEN 0.99 WHEN dt <= 1 AND far = 0 THEN 0.98 ELSE 0.82 END",
))
def links_of_blood_pressure(spark, sf_dir):
    return _shown(duplicates.blood_pressure_links(ledgers(spark, sf_dir)))


def _overlap_sql(table: str, kind: str, data_type: str, name: str, same: str) -> str:
    ends = "epoch(a.started_at) AS a0, epoch(a.ended_at) AS a1, epoch(b.started_at) AS b0, epoch(b.ended_at) AS b1"
    share = "(least(a1, b1) - greatest(a0, b0)) / least(greatest(a1 - a0, 1), greatest(b1 - b0, 1))"
    ratio = "least(greatest(a1 - a0, 1), greatest(b1 - b0, 1)) / greatest(greatest(a1 - a0, 1), greatest(b1 - b0, 1))"
    close = "abs(a0 - b0) <= 1 AND abs(a1 - b1) <= 1"
    return _pair_sql(f"(SELECT *, false AS named FROM {table})", kind, f"'{data_type}'", f"a.started_at < b.ended_at AND b.started_at < a.ended_at{same}", ends, f"CASE WHEN {close} THEN 'exact' WHEN {share} >= 0.5 THEN '{name}' END", f"CASE WHEN {close} THEN 0.98 ELSE least(0.94, 0.65 + 0.2 * {share} + 0.1 * {ratio}) END")


@query(_overlap_sql("sl", "sleep_session", "sleep", "interval_overlap", ""))
def links_of_sleep(spark, sf_dir):
    return _shown(duplicates.interval_links(ledgers(spark, sf_dir), "sleep_sessions", "sleep_session", "sleep", "interval_overlap"))


@query(_overlap_sql("wk", "workout", "workouts", "workout_overlap", " AND a.workout_type = b.workout_type"))
def links_of_workouts(spark, sf_dir):
    return _shown(duplicates.interval_links(ledgers(spark, sf_dir), "workouts", "workout", "workouts", "workout_overlap", "workout_type"))


# ---------------------------------------------------------------- sources


@query("SELECT CAST(o_orderkey AS VARCHAR) AS source_record_id, CASE o_custkey % 3 WHEN 0 THEN 'weight_kg' WHEN 1 THEN 'body_fat_pct' ELSE 'bone_mass_kg' END AS metric, round(CAST(o_custkey AS DOUBLE) / 10 + 1e-8, 4) AS value, CASE WHEN CAST(o_custkey AS DOUBLE) / 10 BETWEEN CASE o_custkey % 3 WHEN 0 THEN 20 WHEN 1 THEN 1 ELSE 0 END AND CASE o_custkey % 3 WHEN 0 THEN 500 WHEN 1 THEN 75 ELSE 30 END THEN 'valid' ELSE 'suspect' END AS quality, CAST(timezone('Asia/Tokyo', timezone('UTC', o_orderdate + INTERVAL 20 HOUR)) AS DATE) AS local_date FROM orders")
def source_api_groups(spark, sf_dir):
    """Envelopes of measure groups, one measure a group, through the normalizer of the API."""
    o = load(spark, sf_dir, "orders")
    kind = F.when(F.col("o_custkey") % 3 == 0, 1).when(F.col("o_custkey") % 3 == 1, 6).otherwise(88)
    measure = F.struct(F.col("o_custkey").alias("value"), kind.alias("type"), F.lit(-1).alias("unit"), F.lit(0).alias("position"))
    text = lambda name: F.lit(None).cast("string").alias(name)
    at = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + 20 * 3600
    group = F.struct(F.col("o_orderkey").alias("grpid"), F.lit(0).alias("attrib"), at.alias("date"), at.alias("created"), F.lit(1).alias("category"), text("deviceid"), text("model"), text("timezone"), F.array(measure).alias("measures"))
    envelope = o.select(F.lit(0).alias("status"), F.struct(F.lit("Asia/Tokyo").alias("timezone"), F.array(group).alias("measuregrps")).alias("body"))
    return rounded(withings.api_observations(withings.groups(envelope)).select("source_record_id", "metric", "value", "quality", "local_date"))


_SPLIT = "(SELECT event_id, unnest(['steps', 'active_energy_kcal', 'non_wear_minutes']) AS metric, unnest([value * 100, value, value * 60 / 60]) AS value, ts FROM events)"


@query(f"SELECT 'daily-activity:' || event_id AS source_record_id, metric, round(value + 1e-8, 4) AS value, CAST(ts AS DATE) AS local_date, CASE WHEN value BETWEEN 0 AND CASE metric WHEN 'steps' THEN 200000 WHEN 'active_energy_kcal' THEN 20000 ELSE 1440 END THEN 'valid' ELSE 'suspect' END AS quality FROM {_SPLIT} WHERE value IS NOT NULL")
def source_daily_documents(spark, sf_dir):
    """Daily documents of an API, one for each event, through their normalizer."""
    e = load(spark, sf_dir, "events")
    given = {"id": F.col("event_id").cast("string"), "day": F.to_date("ts").cast("string"), "timestamp": F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "steps": F.col("value") * 100, "active_calories": F.col("value"), "non_wear_time": F.col("value") * 60}
    fields = [f.split() for f in oura.FIELDS["daily_activity"].split(", ")]
    docs = e.select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields])
    out = oura.daily(docs, "daily_activity", "UTC").select(F.concat(F.lit("daily-activity:"), F.regexp_extract("source_record_id", "([0-9]+)$", 1)).alias("source_record_id"), "metric", "value", "local_date", "quality")
    return rounded(out)


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'weight_kg' WHEN 'view' THEN 'steps' ELSE 'body_temperature_c' END AS metric, round(CASE event_type WHEN 'click' THEN value * 0.45359237 WHEN 'view' THEN value ELSE (value - 32) * 5 / 9 END + 1e-8, 4) AS value, CAST(ts AS DATE) AS local_date FROM events")
def source_xml_records(spark, sf_dir):
    """Elements of an XML export, one for each event, through their normalizer."""
    e = load(spark, sf_dir, "events")
    at = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), F.lit(" +0200"))
    kind = F.concat(F.lit("HKQuantityTypeIdentifier"), F.when(F.col("event_type") == "click", "BodyMass").when(F.col("event_type") == "view", "StepCount").otherwise("BodyTemperature"))
    given = {"creationDate": at, "startDate": at, "endDate": at, "type": kind, "unit": F.when(F.col("event_type") == "click", "lb").when(F.col("event_type") == "view", "count").otherwise("degF"), "value": F.col("value").cast("string"), "sourceName": F.col("event_id").cast("string")}
    none = F.lit(None).cast("array<struct<_key: string, _value: string>>").alias("entries")
    records = e.select(*[given.get(n, F.lit(None)).cast("string").alias(n) for n in apple_health.RECORD_ATTRIBUTES], none)
    out = apple_health.observations(records).select(F.get_json_object("metadata", "$.apple_health.source_name").cast("bigint").alias("event_id"), "metric", "value", "local_date")
    return rounded(out)
