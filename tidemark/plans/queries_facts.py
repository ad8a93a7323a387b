"""Registered queries: aggregates, daily facts, calendars, roll-ups, correlation, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import calendar, correlate
from .queries_rows import r6
from .registry import load, query

TYPES = ("click", "error", "purchase", "signup", "view")


@query(
    """SELECT l_orderkey, l_partkey, l_linenumber, measure, round(v, 6) AS v FROM (
SELECT l_orderkey, l_partkey, l_linenumber, 'quantity' AS measure, l_quantity AS v FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, l_linenumber, 'discount', CASE WHEN l_linenumber = 2 THEN NULL ELSE l_discount END FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, l_linenumber, 'tax', l_tax FROM lineitem) WHERE v IS NOT NULL"""
)
def stage_unpivot(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.when(F.col("l_linenumber") != 2, F.col("l_discount")).alias("discount"), F.col("l_tax").alias("tax"))
    long = li.unpivot(["l_orderkey", "l_partkey", "l_linenumber"], ["quantity", "discount", "tax"], "measure", "v").where("v IS NOT NULL")
    return long.withColumn("v", F.round("v", 6))


@query(
    "SELECT user_id, "
    + ", ".join(f"round(max(value) FILTER (WHERE event_type = '{t}'), 6) AS {t}, CAST(count(*) FILTER (WHERE event_type = '{t}') AS BIGINT) AS {t}_n" for t in TYPES)
    + " FROM events GROUP BY user_id"
)
def stage_pivot(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    wide = e.groupBy("user_id").pivot("event_type", list(TYPES)).agg(F.round(F.max("value"), 6).alias("m"), F.count(F.lit(1)).alias("n"))
    return wide.select("user_id", *[c for t in TYPES for c in (F.col(f"{t}_m").alias(t), F.coalesce(f"{t}_n", F.lit(0)).alias(f"{t}_n"))])


@query("SELECT user_id, CAST(ts AS DATE) AS day, round(arg_max(value, struct_pack(t := ts, i := event_id)) FILTER (WHERE value > 20), 6) AS last_value FROM events GROUP BY 1, 2")
def argmax_filtered(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    key = F.when((F.col("value") > 20), F.struct("ts", "event_id"))
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.max_by("value", key), 6).alias("last_value"))


_DAILY = (
    "SELECT CAST(ts AS DATE) AS day, round(arg_max(value, struct_pack(t := ts, i := event_id)) FILTER (WHERE event_type = 'click'), 6) AS click_last, "
    + ", ".join(f"round(avg(value) FILTER (WHERE event_type = '{t}'), 6) AS {t}_avg" for t in TYPES)
    + ", round(sum(value) FILTER (WHERE event_type IN ('purchase', 'signup')) / 60.0, 6) AS exercise, count(DISTINCT user_id) AS users, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS event_types FROM events GROUP BY 1"
)


def daily(spark, sf_dir) -> DataFrame:
    """One wide row per day from one aggregation: latest, means, sums by type, types seen."""
    e = load(spark, sf_dir, "events")
    of = lambda t: F.when(F.col("event_type") == t, F.col("value"))
    return e.groupBy(F.to_date("ts").alias("day")).agg(
        F.round(F.max_by("value", F.when(F.col("event_type") == "click", F.struct("ts", "event_id"))), 6).alias("click_last"),
        *[r6(F.avg(of(t)), f"{t}_avg") for t in TYPES],
        r6(F.sum(F.when(F.col("event_type").isin("purchase", "signup"), F.col("value"))) / F.lit(60.0), "exercise"),
        F.count_distinct("user_id").alias("users"),
        F.nullif(F.array_join(F.array_sort(F.collect_set("event_type")), ","), F.lit("")).alias("event_types"),
    )


@query(_DAILY)
def daily_wide(spark, sf_dir):
    return daily(spark, sf_dir)


@query("SELECT user_id, CAST(ts AS DATE) AS day, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY 1, 2")
def string_agg_distinct(spark, sf_dir):
    types = F.expr("listagg(DISTINCT event_type, ',') WITHIN GROUP (ORDER BY event_type)")
    return load(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(types.alias("types"))


def _spine_facts(spark, sf_dir) -> list[DataFrame]:
    o = load(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    li = load(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count(F.lit(1)).alias("shipped"))
    e = load(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("events"))
    return [o, li, e]


_SPINE = """
WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1), l AS (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS shipped FROM lineitem GROUP BY 1), e AS (SELECT CAST(ts AS DATE) AS day, count(*) AS events FROM events GROUP BY 1)
SELECT * FROM (SELECT day FROM o UNION SELECT day FROM l UNION SELECT day FROM e) s LEFT JOIN o USING (day) LEFT JOIN l USING (day) LEFT JOIN e USING (day)
"""


@query(_SPINE)
def date_spine_facts(spark, sf_dir):
    facts = _spine_facts(spark, sf_dir)
    return calendar.join_facts(calendar.date_spine(facts, ["day"]), facts, ["day"])


_SUBJECTS = "(SELECT CAST(o_orderdate AS DATE) AS day, o_custkey % 50 AS subject, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1, 2)"


def _subjects(spark, sf_dir) -> DataFrame:
    """Daily orders of fifty groups of customers, which leave days without orders."""
    o = load(spark, sf_dir, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("day"), (F.col("o_custkey") % 50).alias("subject")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


_CALENDAR = f"""
WITH d AS {_SUBJECTS}, b AS (SELECT subject, min(day) AS lo, max(day) AS hi FROM d GROUP BY subject),
c AS (SELECT subject, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM b)
"""


@query(_CALENDAR + "SELECT subject, day, orders, revenue FROM c LEFT JOIN d USING (subject, day)")
def calendar_fill(spark, sf_dir):
    return calendar.fill_calendar(_subjects(spark, sf_dir), "day", ["subject"])


@query(
    """SELECT week_start, CAST(count(*) AS BIGINT) AS calendar_days, CAST(sum(orders) AS BIGINT) AS orders, round(avg(revenue), 2) AS mean_revenue, count(revenue) AS days_with_orders, week_start + 6 AS week_end
FROM (SELECT CAST(date_trunc('week', day) AS DATE) AS week_start, * FROM (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS orders, sum(o_totalprice) AS revenue FROM orders GROUP BY 1)) GROUP BY week_start"""
)
def weekly_rollup(spark, sf_dir):
    d = load(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("revenue"))
    return calendar.weekly(d, "day", [F.sum("orders").alias("orders"), F.round(F.avg("revenue"), 2).alias("mean_revenue"), F.count("revenue").alias("days_with_orders")])


_ROLLED = (
    _CALENDAR
    + """, f AS (SELECT subject, day, orders, revenue FROM c LEFT JOIN d USING (subject, day)), w AS (SELECT unnest([7, 30, 90, 365]) AS window_days),
r AS (SELECT a.subject, a.day AS anchor_date, CAST(window_days AS INTEGER) AS window_days, CAST(a.day - CAST(window_days - 1 AS INTEGER) AS DATE) AS window_start, count(*) AS calendar_days, CAST(sum(x.orders) AS BIGINT) AS orders, round(avg(x.revenue) + 1e-6, 2) AS mean_revenue
  FROM f a CROSS JOIN w JOIN f x ON x.subject = a.subject AND x.day BETWEEN a.day - CAST(window_days - 1 AS INTEGER) AND a.day GROUP BY ALL)
"""
)


def _rolled(spark, sf_dir) -> DataFrame:
    full = calendar.fill_calendar(_subjects(spark, sf_dir), "day", ["subject"])
    out = calendar.rolling(full, "day", {"orders": calendar.Rolled("sum", "orders"), "mean_revenue": calendar.Rolled("avg", "revenue")}, keys=["subject"])
    return out.withColumn("mean_revenue", F.round(F.col("mean_revenue") + 1e-6, 2))


@query(_ROLLED + "SELECT * FROM r")
def rolling_windows(spark, sf_dir):
    return _rolled(spark, sf_dir)


@query(_ROLLED + "SELECT r.* FROM r JOIN (SELECT subject, max(anchor_date) AS anchor_date FROM r GROUP BY subject) USING (subject, anchor_date)")
def rolling_latest(spark, sf_dir):
    full = calendar.fill_calendar(_subjects(spark, sf_dir), "day", ["subject"])
    out = calendar.rolling_latest(full, "day", {"orders": calendar.Rolled("sum", "orders"), "mean_revenue": calendar.Rolled("avg", "revenue")}, keys=["subject"])
    return out.withColumn("mean_revenue", F.round(F.col("mean_revenue") + 1e-6, 2))


@query(
    "WITH d AS ("
    + _DAILY
    + ") SELECT a.day, coalesce(a.exercise, 0) AS exercise, a.click_avg, b.view_avg AS next_view_avg, b.error_avg AS next_error_avg FROM d a LEFT JOIN d b ON b.day = a.day + 1"
)
def lagged_self_join(spark, sf_dir):
    lagged = calendar.lag_days(daily(spark, sf_dir), "day", ["view_avg", "error_avg"])
    return lagged.select("day", F.coalesce("exercise", F.lit(0.0)).alias("exercise"), "click_avg", "next_view_avg", "next_error_avg")


_SPECS = [(f"{a}-{b}", f"{a}_avg", f"{b}_avg") for a, b in (("click", "view"), ("click", "error"), ("purchase", "signup"), ("view", "purchase"))] + [("constant", "click_avg", "flat")]


@query(
    "WITH d AS (SELECT *, CAST(1.0 AS DOUBLE) AS flat FROM ("
    + _DAILY
    + ")), p AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS relationship, {x} AS x, {y} AS y FROM d WHERE {x} IS NOT NULL AND {y} IS NOT NULL" for n, x, y in _SPECS)
    + """), s AS (SELECT relationship, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(x) * stddev_pop(y) > 0 THEN least(1, greatest(-1, covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)))) END AS r FROM p GROUP BY relationship)
SELECT relationship, n, round(r, 6) AS r, round(CASE WHEN n >= 4 AND r IS NOT NULL THEN tanh(atanh(least(0.999999, greatest(-0.999999, r))) - 1.96 / sqrt(n - 3)) END, 6) AS ci_low, round(CASE WHEN n >= 4 AND r IS NOT NULL THEN tanh(atanh(least(0.999999, greatest(-0.999999, r))) + 1.96 / sqrt(n - 3)) END, 6) AS ci_high FROM s"""
)
def pearson_ci(spark, sf_dir):
    found = correlate.relationships(daily(spark, sf_dir).withColumn("flat", F.lit(1.0)), _SPECS)
    return found.select("relationship", "n", *[r6(c, c) for c in ("r", "ci_low", "ci_high")])


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE CAST(o_orderdate AS DATE) = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)")
def scalar_subquery_latest(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    newest = o.agg(F.max(F.to_date("o_orderdate")).alias("d"))
    return o.join(F.broadcast(newest), F.to_date("o_orderdate") == F.col("d")).drop("d")  # one row


_LEDGERS = "(SELECT event_type AS metric, 's' || CAST(user_id % 3 AS VARCHAR) AS source, CAST(ts AS DATE) AS d FROM events UNION ALL SELECT 'workout:' || o_orderpriority, o_orderstatus, CAST(o_orderdate AS DATE) FROM orders UNION ALL SELECT 'lab:ship', l_returnflag, CAST(l_shipdate AS DATE) FROM lineitem)"


@query(
    f"""SELECT metric, source, min(d) AS first_date, max(d) AS last_date, count(*) AS records, count(DISTINCT d) AS observed_days, date_diff('day', min(d), max(d)) + 1 AS span_days, date_diff('day', min(d), max(d)) + 1 - count(DISTINCT d) AS missing_days,
  round(count(DISTINCT d) * 100.0::DOUBLE / (date_diff('day', min(d), max(d)) + 1), 4) AS coverage, CASE WHEN metric LIKE 'workout:%' THEN 'episodic' WHEN metric LIKE 'lab:%' THEN 'periodic' ELSE 'daily' END AS cadence,
  CASE WHEN metric LIKE 'workout:%' THEN 'episodic' WHEN date_diff('day', max(d), DATE '2024-02-01') <= CASE WHEN metric LIKE 'lab:%' THEN 30 ELSE 3 END THEN 'current' ELSE 'stale' END AS freshness
FROM {_LEDGERS} GROUP BY metric, source"""
)
def coverage_freshness(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("source"), F.to_date("ts").alias("d"))
    o = load(spark, sf_dir, "orders").select(F.concat(F.lit("workout:"), "o_orderpriority").alias("metric"), F.col("o_orderstatus").alias("source"), F.to_date("o_orderdate").alias("d"))
    li = load(spark, sf_dir, "lineitem").select(F.lit("lab:ship").alias("metric"), F.col("l_returnflag").alias("source"), F.to_date("l_shipdate").alias("d"))
    from .reports import coverage

    return coverage(e.unionByName(o).unionByName(li), F.lit("2024-02-01").cast("date"), digits=4)


@query("SELECT user_id, CAST(ts AS DATE) AS day, round(sum(value) FILTER (WHERE event_type = 'click'), 4) AS measured, round(coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0), 4) AS zero_filled, count(value) FILTER (WHERE event_type = 'click') AS coverage FROM events GROUP BY 1, 2")
def wear_missing_null(spark, sf_dir):
    of = lambda t: F.when(F.col("event_type") == t, F.col("value"))
    return load(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.sum(of("click")), 4).alias("measured"), F.round(F.coalesce(F.sum(of("purchase")), F.lit(0.0)), 4).alias("zero_filled"), F.count(of("click")).alias("coverage"))


@query("SELECT c_custkey, c_mktsegment, n_name, r_name, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS spent FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def joined_dimensions(spark, sf_dir):
    c, n, r, o = (load(spark, sf_dir, t) for t in ("customer", "nation", "region", "orders"))
    per = o.groupBy("o_custkey").agg(F.count("o_orderkey").alias("orders"), F.sum("o_totalprice").alias("spent"))  # pre-aggregated below the join
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).join(per, c["c_custkey"] == per["o_custkey"], "left")
    return j.select("c_custkey", "c_mktsegment", "n_name", "r_name", F.coalesce("orders", F.lit(0)).alias("orders"), F.round(F.coalesce("spent", F.lit(0.0)), 2).alias("spent"))


@query("SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS BIGINT) AS k FROM events QUALIFY k <= 3")
def top_k_per_group(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).cast("bigint")
    return load(spark, sf_dir, "events").select("event_id", "user_id", k.alias("k")).where("k <= 3")


@query(f"SELECT event_type AS metric, CASE WHEN event_type IN ('click', 'view') THEN round(avg(value) * {scalar.LB_PER_KG}, 4) ELSE round(avg(value), 4) END AS shown FROM events GROUP BY 1")
def display_units(spark, sf_dir):
    mean = F.avg("value")
    return load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(F.round(F.when(F.col("metric").isin("click", "view"), mean * scalar.LB_PER_KG).otherwise(mean), 4).alias("shown"))
