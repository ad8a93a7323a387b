"""Registered queries: selection, projections, sessions, intervals, pairs, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parse, scalar
from ..operators import intervals, merge, pairs, select, sessions
from ..operators.numbering import every_nth
from ..operators.pairing import pair_halves
from .registry import load, query

PRIORITIES = [("click", "s1", 1), ("click", "s0", 2), ("view", "s2", 1), ("signup", "s0", 1), ("purchase", "s1", 5), ("error", "s2", 1)]
_VALUES = ", ".join(f"('{a}', '{b}', {c})" for a, b, c in PRIORITIES)
PRIORITY_SQL = f"(SELECT * FROM (VALUES {_VALUES}) AS v(data_type, source, priority))"
LEDGER_SQL = "(SELECT event_id, ts, user_id, event_type AS metric, value, 's' || CAST(user_id % 3 AS VARCHAR) AS source, CAST(ts AS DATE) AS local_date, CASE WHEN event_id % 7 = 0 THEN 'suspect' WHEN event_id % 11 = 0 THEN 'invalid' ELSE 'valid' END AS quality FROM events)"


def priorities(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {_VALUES} AS v(data_type, source, priority)")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a measurement ledger: metric, source, local date, quality."""
    e = load(spark, sf_dir, "events")
    quality = F.when(F.col("event_id") % 7 == 0, "suspect").when(F.col("event_id") % 11 == 0, "invalid").otherwise("valid")
    return e.select("event_id", "ts", "user_id", F.col("event_type").alias("metric"), "value", F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("source"), F.to_date("ts").alias("local_date"), quality.alias("quality"))


def r6(c: str | Column, name: str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


@query("SELECT event_id, user_id, upper(event_type) AS kind, round(value * 2, 6) AS doubled FROM events WHERE event_type IN ('click', 'view') AND value BETWEEN 10 AND 60 AND value IS NOT NULL AND (user_id % 2 = 0 OR value > 50)")
def filter_project(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    keep = F.col("event_type").isin("click", "view") & F.col("value").between(10, 60) & F.col("value").isNotNull() & ((F.col("user_id") % 2 == 0) | (F.col("value") > 50))
    return e.where(keep).select("event_id", "user_id", F.upper("event_type").alias("kind"), r6(F.col("value") * 2, "doubled"))


@query("SELECT * EXCLUDE (props, value), CASE WHEN value IS DISTINCT FROM 0 THEN coalesce(value, -1) END AS v, CAST(NULL AS DOUBLE) AS missing FROM events")
def star_exclude_typed_null(spark, sf_dir):
    v = F.when(~F.col("value").eqNullSafe(F.lit(0.0)), F.coalesce("value", F.lit(-1.0)))
    return load(spark, sf_dir, "events").withColumns({"v": v, "missing": F.lit(None).cast("double")}).drop("props", "value")


@query("SELECT event_id, value FROM events WHERE event_type = 'purchase' AND value >= 25 AND ts >= TIMESTAMP '2024-01-10'")
def parameterized_filter(spark, sf_dir):
    sql = "SELECT event_id, value FROM {e} WHERE event_type = :kind AND value >= :low AND ts >= :since"
    return spark.sql(sql, args={"kind": "purchase", "low": 25.0, "since": __import__("datetime").datetime(2024, 1, 10)}, e=load(spark, sf_dir, "events"))


_RANKED = f"""
WITH c AS (SELECT l.*, coalesce(p.priority, 10000) AS priority FROM {LEDGER_SQL} l LEFT JOIN {PRIORITY_SQL} p ON p.data_type = l.metric AND p.source = l.source WHERE quality <> 'invalid'),
r AS (SELECT *, {{rank}}() OVER (PARTITION BY metric, local_date ORDER BY CASE WHEN quality = 'valid' THEN 0 ELSE 1 END, priority, source{{more}}) AS k FROM c)
SELECT event_id, metric, local_date, source, quality, CAST(priority AS INTEGER) AS priority, value FROM r WHERE k = 1
"""


def _candidates(spark, sf_dir):
    return select.with_priority(ledger(spark, sf_dir).where("quality <> 'invalid'"), priorities(spark), data_type=F.col("metric"))


@query(_RANKED.format(rank="dense_rank", more=""))
def priority_select_dense(spark, sf_dir):
    best = select.select_by_priority(_candidates(spark, sf_dir), ["metric", "local_date"], [select.quality_rank("quality"), "priority", "source"])
    return best.select("event_id", "metric", "local_date", "source", "quality", "priority", "value")


@query(_RANKED.format(rank="row_number", more=", ts, event_id"))
def priority_select_row(spark, sf_dir):
    best = select.select_by_priority(_candidates(spark, sf_dir), ["metric", "local_date"], [select.quality_rank("quality"), "priority", "source", "ts", "event_id"], rank="row")
    return best.select("event_id", "metric", "local_date", "source", "quality", "priority", "value")


@query(f"SELECT event_id, l.source, CAST(coalesce(p.priority, 10000) AS INTEGER) AS priority FROM {LEDGER_SQL} l LEFT JOIN {PRIORITY_SQL} p ON p.data_type = 'click' AND p.source = l.source")
def priority_left_default(spark, sf_dir):
    return select.with_priority(ledger(spark, sf_dir), priorities(spark), data_type="click").select("event_id", "source", "priority")


_READINGS = """
WITH g AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
s AS (SELECT *, CASE WHEN p IS NULL OR epoch(ts) - epoch(p) > 14400 THEN 1 ELSE 0 END AS f FROM g),
n AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_number FROM s),
o AS (SELECT user_id, event_id, ts, value, CAST(session_number AS BIGINT) AS session_number, row_number() OVER (PARTITION BY user_id, session_number ORDER BY ts, event_id) AS reading_number FROM n)
"""


def _readings(spark, sf_dir):
    return sessions.sessionize(load(spark, sf_dir, "events"), ["user_id"], "ts", 4 * 3600, tie="event_id")


@query(_READINGS + "SELECT user_id, event_id, session_number, reading_number FROM o")
def reading_sessions(spark, sf_dir):
    return _readings(spark, sf_dir).select("user_id", "event_id", "session_number", "reading_number")


@query(
    _READINGS
    + """SELECT user_id, session_number, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS reading_count, round(first(value ORDER BY ts, event_id), 6) AS first_value,
  round(avg(value) FILTER (WHERE reading_number > 1), 6) AS subsequent_value, round(avg(value), 6) AS mean_value,
  round(coalesce(avg(value) FILTER (WHERE reading_number > 1), first(value ORDER BY ts, event_id)), 6) AS preferred_value
FROM o GROUP BY user_id, session_number"""
)
def session_stats(spark, sf_dir):
    s = sessions.session_stats(_readings(spark, sf_dir), ["user_id"], "ts", "event_id", ["value"])
    return s.select("user_id", "session_number", "started_at", "ended_at", "reading_count", *[r6(f"{k}_value", f"{k}_value") for k in ("first", "subsequent", "mean", "preferred")])


@query(_READINGS + "SELECT user_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS reading_count FROM o GROUP BY user_id, session_number")
def session_window_native(spark, sf_dir):
    return sessions.native_sessions(load(spark, sf_dir, "events"), ["user_id"], "ts", "4 hours").select("user_id", "started_at", "ended_at", "reading_count")


_INTERVALS = "(SELECT event_id, user_id, event_type, ts AS started_at, ts + to_seconds(CAST(floor(value * 60) AS BIGINT)) AS ended_at FROM events)"


def _intervals(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", F.col("ts").alias("started_at"), F.expr("ts + make_dt_interval(0, 0, 0, floor(value * 60))").alias("ended_at"))


_ISLANDS = f"""
WITH a AS (SELECT *, max(ended_at) OVER (PARTITION BY user_id ORDER BY started_at, ended_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM {_INTERVALS}),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR started_at > p + to_seconds({{gap}}) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY started_at, ended_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM a)
"""


@query(_ISLANDS.format(gap=0) + "SELECT user_id, CAST(island AS BIGINT) AS island, min(started_at) AS started_at, max(ended_at) AS ended_at, count(*) AS intervals, date_diff('second', min(started_at), max(ended_at)) AS seconds FROM i GROUP BY user_id, island")
def interval_islands(spark, sf_dir):
    return intervals.merge_islands(_intervals(spark, sf_dir), ["user_id"], "started_at", "ended_at")


@query(_ISLANDS.format(gap=14400) + "SELECT event_id, user_id, CAST(island AS BIGINT) AS episode, max(CAST(ended_at AS DATE)) OVER (PARTITION BY user_id, island) AS wake_date FROM i")
def episode_wake_date(spark, sf_dir):
    rows = _intervals(spark, sf_dir).withColumn("day", F.to_date("ended_at"))
    numbered = intervals.islands(rows, ["user_id"], "started_at", "ended_at", gap_seconds=4 * 3600, tie=["event_id"], island="episode")
    return numbered.withColumn("wake_date", F.max("day").over(Window.partitionBy("user_id", "episode"))).select("event_id", "user_id", "episode", "wake_date")


_PAIRS = "FROM events a JOIN events b ON {on}a.event_id < b.event_id AND a.user_id <> b.user_id AND abs(epoch(a.ts) - epoch(b.ts)) <= {within}"


@query(
    "WITH p AS (SELECT a.event_id AS a_id, b.event_id AS b_id, abs(epoch(a.ts) - epoch(b.ts)) AS dt, abs(a.value - b.value) / greatest(abs(a.value), abs(b.value), 1) AS rel "
    + _PAIRS.format(on="a.event_type = b.event_type AND ", within=600)
    + ") SELECT a_id, b_id, CASE WHEN dt <= 1 AND rel <= 1e-6 THEN 'exact' ELSE 'heuristic' END AS match_method, round(CASE WHEN dt <= 1 AND rel <= 1e-6 THEN 0.98 ELSE greatest(0.7, 0.9 - dt / 6000 - 2 * rel) END, 6) AS confidence FROM p WHERE rel <= 0.05"
)
def near_duplicates(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    p = pairs.near_pairs(e, e, "ts", 600, equal=["event_type"], condition="a_event_id < b_event_id AND a_user_id <> b_user_id")
    dt = F.abs(pairs.seconds_of("a_ts") - pairs.seconds_of("b_ts"))
    rel = F.abs(F.col("a_value") - F.col("b_value")) / F.greatest(F.abs("a_value"), F.abs("b_value"), F.lit(1.0))
    p = p.withColumns({"dt": dt, "rel": rel}).where("rel <= 0.05")
    exact = (F.col("dt") <= 1) & (F.col("rel") <= 1e-6)
    confidence = F.when(exact, 0.98).otherwise(F.greatest(F.lit(0.7), F.lit(0.9) - F.col("dt") / 6000 - 2 * F.col("rel")))
    return p.select(F.col("a_event_id").alias("a_id"), F.col("b_event_id").alias("b_id"), F.when(exact, "exact").otherwise("heuristic").alias("match_method"), r6(confidence, "confidence"))


@query("SELECT a.event_id AS a_id, b.event_id AS b_id " + _PAIRS.format(on="", within=300))
def theta_pairs(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    p = pairs.near_couples(e, "ts", 300, "event_id", condition="a_user_id <> b_user_id")
    return p.select(F.least("a_event_id", "b_event_id").alias("a_id"), F.greatest("a_event_id", "b_event_id").alias("b_id"))


@query(
    f"""WITH i AS {_INTERVALS}, p AS (SELECT a.event_id AS a_id, b.event_id AS b_id, epoch(a.started_at) AS a0, epoch(a.ended_at) AS a1, epoch(b.started_at) AS b0, epoch(b.ended_at) AS b1
FROM i a JOIN i b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id < b.event_id AND a.started_at < b.ended_at AND b.started_at < a.ended_at),
s AS (SELECT a_id, b_id, (least(a1, b1) - greatest(a0, b0)) / least(greatest(a1 - a0, 1), greatest(b1 - b0, 1)) AS o, least(greatest(a1 - a0, 1), greatest(b1 - b0, 1)) / greatest(greatest(a1 - a0, 1), greatest(b1 - b0, 1)) AS d FROM p)
SELECT a_id, b_id, round(o, 6) AS overlap, round(least(0.94, 0.65 + 0.2 * o + 0.1 * d), 6) AS confidence FROM s WHERE o >= 0.5"""
)
def interval_overlap(spark, sf_dir):
    i = _intervals(spark, sf_dir)
    p = pairs.overlap_pairs(i, i, "started_at", "ended_at", equal=["user_id", "event_type"], condition="a_event_id < b_event_id")
    share, ratio = pairs.overlap_share(*[pairs.seconds_of(c) for c in ("a_started_at", "a_ended_at", "b_started_at", "b_ended_at")])
    p = p.select(F.col("a_event_id").alias("a_id"), F.col("b_event_id").alias("b_id"), share.alias("o"), ratio.alias("d")).where("o >= 0.5")
    return p.select("a_id", "b_id", r6("o", "overlap"), r6(F.least(F.lit(0.94), F.lit(0.65) + 0.2 * F.col("o") + 0.1 * F.col("d")), "confidence"))


@query(
    """WITH old AS (SELECT * FROM orders WHERE o_orderkey % 5 <> 0), new AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders)
SELECT n.o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'inserted' WHEN o.o_orderstatus IS DISTINCT FROM n.o_orderstatus OR o.o_totalprice IS DISTINCT FROM n.o_totalprice THEN 'updated' ELSE 'duplicate' END AS disposition, n.o_orderstatus
FROM new n LEFT JOIN old o USING (o_orderkey)"""
)
def merge_dispositions(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    new = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("o_orderstatus")))
    merged = merge.merge_changes(o.where("o_orderkey % 5 <> 0"), new, ["o_orderkey"], ["o_orderstatus", "o_totalprice"], "o_orderkey")
    return merged.select("o_orderkey", merge.disposition().alias("disposition"), "o_orderstatus")


@query("SELECT disposition, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'inserted' WHEN o_orderkey % 3 = 0 AND o_orderstatus <> 'X' THEN 'updated' ELSE 'duplicate' END AS disposition FROM orders) GROUP BY disposition")
def merge_counters(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    new = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("o_orderstatus")))
    merged = merge.merge_changes(o.where("o_orderkey % 5 <> 0"), new, ["o_orderkey"], ["o_orderstatus"], "o_orderkey")
    counts = merged.agg(*[F.sum(f"_{k}").alias(k) for k in (merge.INSERTED, merge.UPDATED, merge.DUPLICATE)])
    return counts.unpivot([], list(counts.columns), "disposition", "n").where("n > 0")


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
def anti_join_new_sources(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return merge.insert_missing(load(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), c, ["c_custkey"])


@query("WITH old AS (SELECT o_custkey AS source_id, max(o_orderdate) AS last_end FROM orders GROUP BY 1), new AS (SELECT o_custkey + CASE WHEN count(*) % 3 = 0 THEN 1000000 ELSE 0 END AS source_id, min(o_orderdate) AS last_end FROM orders GROUP BY o_custkey) SELECT source_id, last_end FROM new UNION ALL SELECT source_id, last_end FROM old WHERE source_id NOT IN (SELECT source_id FROM new)")
def watermark_upsert(spark, sf_dir):
    """Both sides read every order; a third of the incoming sources are new, and the stored ones of those stay."""
    o = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("hi"), F.min("o_orderdate").alias("lo"), F.count(F.lit(1)).alias("n"))
    old = o.select(F.col("o_custkey").alias("source_id"), F.col("hi").alias("last_end"))
    new = o.select((F.col("o_custkey") + F.when(F.col("n") % 3 == 0, 1_000_000).otherwise(0)).alias("source_id"), F.col("lo").alias("last_end"))
    return merge.upsert_latest(old, new, ["source_id"])


@query(
    """WITH old AS (SELECT event_id, event_id % 7 <> 0 AS generated, CASE WHEN event_id % 5 = 0 THEN 'rejected' WHEN event_id % 7 = 0 THEN 'confirmed' ELSE 'candidate' END AS was, 0.5 AS c FROM events WHERE coalesce(value, 0) < 70), new AS (SELECT event_id, CASE WHEN value > 50 THEN 'confirmed' ELSE 'candidate' END AS r, round(value / 100, 6) AS c FROM events WHERE coalesce(value, 0) >= 30)
SELECT coalesce(old.event_id, new.event_id) AS event_id, CAST(coalesce(new.c, old.c) AS DOUBLE) AS confidence, CASE WHEN was = 'rejected' THEN 'rejected' WHEN new.event_id IS NULL THEN was ELSE r END AS resolution, coalesce(generated, true) AND NOT coalesce(was = 'rejected', false) AS generated
FROM old FULL JOIN new ON old.event_id = new.event_id WHERE new.event_id IS NOT NULL OR was = 'rejected' OR NOT generated"""
)
def link_refresh(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    hand = F.col("event_id") % 7 == 0
    old = e.where("coalesce(value, 0) < 70").select("event_id", F.lit(0.5).alias("confidence"), F.when(F.col("event_id") % 5 == 0, "rejected").when(hand, "confirmed").otherwise("candidate").alias("resolution"), F.when((F.col("event_id") % 5 == 0) | hand, "user").otherwise("rules").alias("generated_by"))
    new = e.where("coalesce(value, 0) >= 30").select("event_id", F.round(F.col("value") / 100, 6).alias("confidence"), F.when(F.col("value") > 50, "confirmed").otherwise("candidate").alias("resolution"), F.lit("rules").alias("generated_by"))
    return merge.merge_links(old, new, ["event_id"]).select("event_id", "confidence", "resolution", (F.col("generated_by") == "rules").alias("generated"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS missing FROM events")
def json_extract(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.get_json_object("props", "$.none").alias("missing"))


@query("SELECT event_id, CAST(timezone(CASE WHEN user_id % 2 = 0 THEN 'America/New_York' ELSE 'Asia/Tokyo' END, timezone('UTC', ts)) AS DATE) AS local_date FROM events")
def timezone_local_date(spark, sf_dir):
    zone = F.when(F.col("user_id") % 2 == 0, "America/New_York").otherwise("Asia/Tokyo")
    return load(spark, sf_dir, "events").select("event_id", scalar.local_date(F.col("ts").cast("timestamp"), zone).alias("local_date"))


@query("SELECT event_id, date_diff('second', p, ts) AS seconds, date_diff('millisecond', p, ts) AS millis, date_diff('day', p, ts) AS days FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)")
def date_diff_boundaries(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("p", F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.select("event_id", *[scalar.date_diff(unit, F.col("p"), F.col("ts")).alias(name) for unit, name in (("second", "seconds"), ("millisecond", "millis"), ("day", "days"))])


@query("SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS normalized, CASE WHEN p_type LIKE '%BRASS%' THEN 'copper alloy' WHEN p_type LIKE '%STEEL%' THEN 'iron alloy' END AS canonical FROM part")
def alias_vocabulary(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", parse.normalize_name(F.col("p_type")).alias("normalized"))
    return p.withColumn("canonical", parse.first_contained(F.col("normalized"), [("brass", "copper alloy"), ("steel", "iron alloy")]))


_RANGE = "CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) || '-' || CAST(p_size + 5 AS VARCHAR) WHEN 1 THEN '<' || CAST(p_size AS VARCHAR) WHEN 2 THEN '> ' || CAST(p_size AS VARCHAR) ELSE 'none' END"


@query("SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 2 THEN p_size END AS DOUBLE) AS range_low, CAST(CASE p_partkey % 4 WHEN 0 THEN p_size + 5 WHEN 1 THEN p_size END AS DOUBLE) AS range_high FROM part")
def reference_range_parse(spark, sf_dir):
    text = F.expr(_RANGE.replace("VARCHAR", "STRING"))
    low, high = parse.reference_range(text)
    return load(spark, sf_dir, "part").select("p_partkey", low.alias("range_low"), high.alias("range_high"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, round(CASE CAST(l_linenumber % 4 AS INTEGER) WHEN 0 THEN l_quantity * 0.45359237 WHEN 1 THEN l_quantity / 1000 WHEN 2 THEN (l_quantity - 32) * 5 / 9 ELSE l_quantity END, 6) AS converted,
  CASE WHEN CASE CAST(l_linenumber % 4 AS INTEGER) WHEN 0 THEN l_quantity * 0.45359237 WHEN 1 THEN l_quantity / 1000 WHEN 2 THEN (l_quantity - 32) * 5 / 9 ELSE l_quantity END BETWEEN 0 AND 20 THEN 'valid' ELSE 'suspect' END AS quality FROM lineitem"""
)
def unit_convert_plausible(spark, sf_dir):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("lb", "g", "degF", "kg")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    value = scalar.convert_unit(F.col("l_quantity"), unit)
    quality, _ = scalar.plausibility(value, {"converted": (0.0, 20.0)}, "converted")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(value, "converted"), quality.alias("quality"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest, row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) AS occurrence FROM documents")
def occurrence_identity(spark, sf_dir):
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    d = load(spark, sf_dir, "documents").select("doc_id", digest.alias("digest"))
    return d.withColumn("occurrence", F.row_number().over(Window.partitionBy("digest").orderBy("doc_id")).cast("bigint"))


@query(
    """WITH n AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, value, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE), event_type ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('click', 'view'))
SELECT user_id, day, k, round(max(value) FILTER (WHERE event_type = 'click'), 6) AS click_value, round(max(value) FILTER (WHERE event_type = 'view'), 6) AS view_value, count(*) = 2 AS complete FROM n GROUP BY user_id, day, k"""
)
def pair_correlation(spark, sf_dir):
    e = load(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view")).withColumn("day", F.to_date("ts"))
    e = e.withColumn("place", F.struct("ts", "event_id"))
    pairs = pair_halves(e, ["user_id", "day"], "event_type", "place", "click", "view", {f"{t}_value": (t, F.col("value")) for t in ("click", "view")})
    rounded = [F.round(c, 6).alias(c) for c in ("click_value", "view_value")]
    return pairs.select("user_id", "day", F.col("pair_number").cast("bigint").alias("k"), *rounded, F.col("reason").isNull().alias("complete"))


@query("SELECT c_custkey, concat(c_name, '/', CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END) AS skipped, c_name || '/' || CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS propagated FROM customer")
def concat_null_rules(spark, sf_dir):
    segment = F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))
    return load(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("", "c_name", F.lit("/"), segment).alias("skipped"), F.concat("c_name", F.lit("/"), segment).alias("propagated"))


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders) ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50")
def top50_nulls_last(spark, sf_dir):
    price = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice"))
    o = load(spark, sf_dir, "orders").select("o_orderkey", price.alias("o_totalprice"), "o_orderdate")
    return o.orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(50)


_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (ORDER BY {_LINE}, l_quantity) AS k FROM lineitem) WHERE k % 7 = 3")
def stride_sample(spark, sf_dir):
    order = [*_LINE.split(", "), "l_quantity"]
    return every_nth(load(spark, sf_dir, "lineitem").select(*order), order, 7, 3).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT user_id FROM events WHERE event_type = 'purchase' EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 50")
def set_difference(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.where("event_type = 'purchase'").select("user_id").subtract(e.where("event_type = 'error' AND value > 50").select("user_id"))


@query("SELECT user_id, event_type FROM events WHERE value > 90 UNION SELECT user_id, 'any' FROM events UNION SELECT c_custkey, c_mktsegment FROM customer")
def union_distinct(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("event_type"))
    return e.where("value > 90").select("user_id", "event_type").union(e.select("user_id", F.lit("any"))).union(c).distinct()


@query("SELECT sum(value) / 60.0 AS minutes, CAST(sum(CAST(user_id AS BIGINT)) AS BIGINT) AS ids, count(value) AS n FROM events".replace("sum(value) / 60.0", "round(sum(value) / 60.0, 4)"))
def sum_minutes(spark, sf_dir):
    return load(spark, sf_dir, "events").agg(F.round(F.sum("value") / F.lit(60.0), 4).alias("minutes"), F.sum("user_id").alias("ids"), F.count("value").alias("n"))
