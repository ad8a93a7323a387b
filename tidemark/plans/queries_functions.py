"""Registered queries: scalar functions on strings and numbers built from the tables, and composite views on a ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse, scalar
from ..operators import merge
from . import reports, views
from .queries_rows import PRIORITY_SQL, _candidates, ledger, r6
from .registry import load, query

_NUMBER = "CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) || ',5' WHEN 1 THEN ' ' || CAST(p_size AS VARCHAR) || '.25 ' WHEN 2 THEN 'n/a' WHEN 3 THEN 'NaN' ELSE CAST(p_size AS VARCHAR) END"


@query("SELECT p_partkey, CAST(CASE p_partkey % 5 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN p_size + 0.25 WHEN 4 THEN p_size END AS DOUBLE) AS n, CAST(CASE WHEN p_partkey % 5 = 0 THEN p_size * 10 + 5 WHEN p_partkey % 5 = 1 THEN p_size + 0.25 WHEN p_partkey % 5 = 4 THEN p_size END AS DOUBLE) AS thousands FROM part")
def number_parse(spark, sf_dir):
    text = F.expr(_NUMBER.replace("VARCHAR", "STRING"))
    return load(spark, sf_dir, "part").select("p_partkey", parse.number(text).alias("n"), parse.number(text, thousands=True).alias("thousands"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts WHEN 1 THEN ts - INTERVAL 5 HOUR - INTERVAL 30 MINUTE WHEN 2 THEN CAST(timezone('UTC', timezone('America/New_York', ts)) AS TIMESTAMP) END AS at, CAST(ts AS DATE) AS written FROM events")
def instant_parse(spark, sf_dir):
    """Texts with Z, with an offset, without one (local to a zone), and malformed."""
    e = load(spark, sf_dir, "events")
    body = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.when(F.col("event_id") % 4 == 0, F.concat(body, F.lit("Z"))).when(F.col("event_id") % 4 == 1, F.concat(F.replace(body, F.lit("T"), F.lit(" ")), F.lit(" +0530"))).when(F.col("event_id") % 4 == 2, body).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(" noon")))
    return e.select("event_id", parse.instant(text, "America/New_York").cast("timestamp_ntz").alias("at"), parse.offset_date(text).alias("written"))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS flag, c_custkey % 5 <> 4 AS known FROM customer")
def boolean_vocabulary(spark, sf_dir):
    words = F.element_at(F.array(*map(F.lit, (" Yes", "FALSE", "y", "", "perhaps"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return load(spark, sf_dir, "customer").select("c_custkey", parse.boolean(words).alias("flag"), parse.boolean_valid(words).alias("known"))


@query("SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%promo%' THEN 'promotion' WHEN lower(p_type) LIKE '%steel%' THEN 'metal' WHEN lower(p_type) LIKE '%brass%' THEN 'metal' ELSE 'other' END AS kind FROM part")
def type_mapping(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", parse.first_contained(F.lower("p_type"), [("promo", "promotion"), ("steel", "metal"), ("brass", "metal")], "other").alias("kind"))


@query(
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity * 600 AS BIGINT) AS in_bed, CAST(l_discount * 10000 AS BIGINT) AS awake, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity * 500 AS BIGINT) END AS total FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(total, greatest(in_bed - awake, 0)) AS total, round(CASE WHEN in_bed > 0 THEN coalesce(total, greatest(in_bed - awake, 0)) / in_bed::DOUBLE * 100 END, 6) AS efficiency, CASE WHEN awake > 0 THEN awake END AS positive FROM s"""
)
def derived_sleep(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    whole = lambda c: F.round(c).cast("bigint")
    in_bed, awake, total = whole(F.col("l_quantity") * 600), whole(F.col("l_discount") * 10000), F.when(F.col("l_linenumber") % 2 == 0, whole(F.col("l_quantity") * 500))
    t, e = scalar.derived_sleep(total, in_bed, awake, F.lit(None).cast("double"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", t.alias("total"), r6(e, "efficiency"), scalar.positive_or_null(awake).alias("positive"))


@query("SELECT o_orderkey, CAST(CAST(CAST(o_totalprice * 100 AS BIGINT) AS VARCHAR) || 'e-2' AS DOUBLE) AS scaled FROM orders")
def scaled_decimal(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", scalar.scaled(F.round(F.col("o_totalprice") * 100).cast("bigint"), F.lit(-2)).alias("scaled"))


@query("SELECT s_suppkey, sha256(concat(s_name, chr(31), CASE WHEN s_suppkey % 4 = 0 THEN chr(0) ELSE CAST(s_nationkey AS VARCHAR) END)) AS id64, substr(sha256(concat(s_name, chr(31), CASE WHEN s_suppkey % 4 = 0 THEN chr(0) ELSE CAST(s_nationkey AS VARCHAR) END)), 1, 24) AS id24 FROM supplier")
def sha_identity(spark, sf_dir):
    nation = F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey"))
    return load(spark, sf_dir, "supplier").select("s_suppkey", scalar.identity(F.col("s_name"), nation).alias("id64"), scalar.identity(F.col("s_name"), nation, length=24).alias("id24"))


@query("SELECT DISTINCT event_type AS metric, CASE WHEN event_type IN ('click', 'view') THEN 'daily' ELSE 'daily' END AS cadence FROM events UNION ALL SELECT DISTINCT 'workout:' || o_orderpriority, 'episodic' FROM orders UNION ALL SELECT DISTINCT 'lab:' || p_brand, 'periodic' FROM part")
def cadence_classes(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("metric")).distinct()
    o = load(spark, sf_dir, "orders").select(F.concat(F.lit("workout:"), "o_orderpriority").alias("metric")).distinct()
    p = load(spark, sf_dir, "part").select(F.concat(F.lit("lab:"), "p_brand").alias("metric")).distinct()
    names = e.unionByName(o).unionByName(p)
    return names.select("metric", scalar.cadence(F.col("metric")).alias("cadence"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS named FROM customer")
def vendor_containment(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("Withings Body+", "Health Mate", "Some App"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    return load(spark, sf_dir, "customer").select("c_custkey", scalar.vendor_matches(name, F.lit("withings")).alias("named"))


@query(
    f"""WITH c AS (SELECT l.*, coalesce(p.priority, 10000) AS priority FROM (SELECT event_id, ts, user_id, event_type AS metric, value, 's' || CAST(user_id % 3 AS VARCHAR) AS source, CAST(ts AS DATE) AS local_date, CASE WHEN event_id % 7 = 0 THEN 'suspect' WHEN event_id % 11 = 0 THEN 'invalid' ELSE 'valid' END AS quality FROM events) l LEFT JOIN {PRIORITY_SQL} p ON p.data_type = l.metric AND p.source = l.source WHERE quality <> 'invalid'),
r AS (SELECT *, dense_rank() OVER (PARTITION BY metric, local_date ORDER BY CASE WHEN quality = 'valid' THEN 0 ELSE 1 END, priority, source) AS k FROM c)
SELECT local_date, round(arg_max(value, struct_pack(t := ts, i := event_id)) FILTER (WHERE metric = 'click'), 6) AS click, round(avg(value) FILTER (WHERE metric = 'view'), 6) AS view, round(sum(value) FILTER (WHERE metric = 'purchase'), 6) AS purchase, count(*) AS records FROM r WHERE k = 1 GROUP BY local_date"""
)
def daily_source_selected(spark, sf_dir):
    """Selection by priority, then one wide row per date: the backbone of the daily view."""
    from ..operators import select

    best = select.select_by_priority(_candidates(spark, sf_dir), ["metric", "local_date"], [select.quality_rank("quality"), "priority", "source"])
    of = lambda m: F.when(F.col("metric") == m, F.col("value"))
    last = F.max_by("value", F.when((F.col("metric") == "click") & F.col("value").isNotNull(), F.struct("ts", "event_id")))
    return best.groupBy("local_date").agg(r6(last, "click"), r6(F.avg(of("view")), "view"), r6(F.sum(of("purchase")), "purchase"), F.count(F.lit(1)).alias("records"))


@query("SELECT event_type AS source, max_run.event_id AS run_id, max_run.ts AS started_at, status FROM (SELECT event_type, arg_max(struct_pack(event_id := event_id, ts := ts), struct_pack(t := ts, i := CAST(event_id AS VARCHAR))) AS max_run, 'succeeded' AS status FROM events GROUP BY event_type)")
def run_audit(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp")
    runs = e.select(F.col("event_type").alias("source"), F.col("event_id").cast("string").alias("run_id"), F.lit("succeeded").alias("status"), at.alias("started_at"), at.alias("finished_at"), F.lit(1).cast("bigint").alias("normalized_count"))
    last = reports.latest_runs(runs, F.lit("2024-03-01").cast("timestamp"))
    return last.select("source", F.col("run_id").cast("bigint").alias("run_id"), F.col("started_at").cast("timestamp_ntz").alias("started_at"), "status")


@query("SELECT o_orderkey, o_orderstatus, CAST(n - 1 AS BIGINT) AS earlier FROM (SELECT o_custkey % 500 AS o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey % 500 ORDER BY o_orderkey DESC) AS k, count(*) OVER (PARTITION BY o_custkey % 500) AS n FROM orders) WHERE k = 1")
def batch_last_wins(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 500).alias("key"), "o_orderkey", "o_orderstatus")
    last = merge.merge_changes(o.where("false"), o, ["key"], ["o_orderstatus"], "o_orderkey")
    return last.select(F.col("key").alias("o_orderkey"), "o_orderstatus", (F.col("_inserted") + F.col("_updated") + F.col("_duplicate") - 1).alias("earlier"))


@query("SELECT metric, source, min(local_date) AS first_date, count(DISTINCT local_date) AS days FROM (SELECT event_type AS metric, 's' || CAST(user_id % 3 AS VARCHAR) AS source, CAST(ts AS DATE) AS local_date FROM events) GROUP BY metric, source")
def view_coverage(spark, sf_dir):
    """Coverage through the ledger object, as the audit reads it."""
    o = ledger(spark, sf_dir).select("metric", "source", "local_date", F.col("ts").cast("timestamp").alias("observed_at"), "value", "quality", F.col("event_id").cast("string").alias("source_record_id"))
    dates = reports.ledger_dates(views.Ledgers(spark, {"observations": o}))
    return dates.groupBy("metric", "source").agg(F.min("d").alias("first_date"), F.count_distinct("d").alias("days"))
