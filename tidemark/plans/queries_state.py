"""Registered queries of the store, its state tables, link decisions, and the normalizers of labs, pressures and nights."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators import merge
from ..sources import apple_health, labs, oura, withings
from . import duplicates, state
from .queries_views import rounded
from .registry import load, query, workspace
from .store import SnapshotStore

# ---------------------------------------------------------------- merges into a store

_EVENTS = "e AS (SELECT event_id, event_type || '-' || user_id AS k, CAST(floor(value) AS BIGINT) % 3 AS v FROM events)"
_MERGED = f"""WITH {_EVENTS}, good AS (SELECT * FROM e WHERE v IS NOT NULL),
half AS (SELECT * FROM good WHERE event_id % 2 = 0), s1 AS (SELECT k, arg_max(v, event_id) AS v FROM half GROUP BY k), s2 AS (SELECT k, arg_max(v, event_id) AS v FROM good GROUP BY k),
b1 AS (SELECT v, lag(v) OVER (PARTITION BY k ORDER BY event_id) AS p FROM half),
b2 AS (SELECT g.v, coalesce(lag(g.v) OVER (PARTITION BY g.k ORDER BY event_id), s1.v) AS p FROM good g LEFT JOIN s1 ON s1.k = g.k),
b3 AS (SELECT g.v, coalesce(lag(g.v) OVER (PARTITION BY g.k ORDER BY event_id), s2.v) AS p FROM good g LEFT JOIN s2 ON s2.k = g.k)
"""
_COUNT = "SELECT '{n}' AS batch, CASE WHEN p IS NULL THEN 'inserted' WHEN p <> v THEN 'updated' ELSE 'duplicate' END AS disposition, count(*) AS n FROM {b} GROUP BY ALL"


def _batch(spark, sf_dir) -> DataFrame:
    """Observations of events, many of one key: the value of a key changes from event to event, or stays."""
    e = load(spark, sf_dir, "events")
    key = F.concat_ws("-", "event_type", F.col("user_id").cast("string"))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return e.select(F.lit("weight_kg").alias("metric"), at.alias("observed_at"), (F.floor("value").cast("bigint") % 3).cast("double").alias("value"), F.lit("valid").alias("quality"), F.lit("feed").alias("source"), key.alias("source_record_id"), "event_id", schemas.position(F.lit("events"), F.col("event_id")))


def _merged(spark, sf_dir) -> tuple[SnapshotStore, list[tuple[str, dict]]]:
    """Half of the events, all of them, then all of them again, through the store; and the second batch once more, by its number."""
    store, rows = SnapshotStore(spark, workspace(spark), buckets=8), _batch(spark, sf_dir)
    merges = [("1", rows.where("event_id % 2 = 0"), ("feed", 0)), ("2", rows, ("feed", 1)), ("3", rows, None), ("2 again", rows.where("event_id % 3 = 0"), ("feed", 1))]
    return store, [(name, store.merge("observations", given, f"run-{name}", batch)) for name, given, batch in merges]


@query(_MERGED + " UNION ALL ".join([_COUNT.format(n=n, b=b) for n, b in (("1", "b1"), ("2", "b2"), ("3", "b3"), ("2 again", "b2"))] + [f"SELECT '{n}', 'rejected', count(*) FROM e WHERE v IS NULL {more} HAVING count(*) > 0" for n, more in (("1", "AND event_id % 2 = 0"), ("2", ""), ("3", ""), ("2 again", ""))]))
def store_merge_counts(spark, sf_dir):
    _, counts = _merged(spark, sf_dir)
    rows = [F.struct(F.lit(name).alias("batch"), F.lit(d).alias("disposition"), F.lit(n).cast("bigint").alias("n")) for name, c in counts for d, n in c.items() if n]
    return spark.range(1).select(F.inline(F.array(*rows)))  # the counts of four merges


@query(_MERGED + "SELECT k AS source_record_id, CAST(v AS DOUBLE) AS value FROM s2")
def store_merge_rows(spark, sf_dir):
    store, _ = _merged(spark, sf_dir)
    return store.read("observations").select("source_record_id", "value")


@query("SELECT o_orderstatus AS source, max(o_orderdate) AS last_successful_end, 'succeeded' AS status FROM orders GROUP BY o_orderstatus")
def stored_watermarks(spark, sf_dir):
    """A run for each status of orders, whose window ends with its newest order: the watermark and the run of one commit."""
    store = SnapshotStore(spark, workspace(spark))
    ends = load(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.unix_micros(F.max("o_orderdate").cast("timestamp")).alias("us")).orderBy("o_orderstatus").collect()  # three rows
    for r in ends:
        with state.Run(store, r["o_orderstatus"], None, datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=r["us"])):
            pass
    runs = store.read("ingestion_runs").select("run_id", "status")
    return store.read("sync_state").join(runs, "run_id").select("source", F.col("last_successful_end").cast("timestamp_ntz").alias("last_successful_end"), "status")


@query("SELECT DISTINCT 's' || l_suppkey % 5 AS source, 'd' || l_partkey % 40 AS vendor_device_id FROM lineitem")
def stored_devices(spark, sf_dir):
    """Devices that ledger rows name: entered once each, whether they come in one batch or again in the next."""
    store, li = SnapshotStore(spark, workspace(spark)), load(spark, sf_dir, "lineitem")
    named = li.select(F.concat(F.lit("s"), F.col("l_suppkey") % 5).alias("source"), F.concat(F.lit("d"), F.col("l_partkey") % 40).alias("device_id"), "l_linenumber")
    for rows in (named.where("l_linenumber <= 3"), named):
        state.ensure_devices(store, rows)
    return store.read("devices").select("source", "vendor_device_id")


@query("SELECT DISTINCT p_brand AS data_type, p_type AS source, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_type) AS INTEGER) AS priority FROM part")
def stored_priorities(spark, sf_dir):
    """Priorities replaced as a whole: of the first set nothing is left."""
    from pyspark.sql import Window

    store, p = SnapshotStore(spark, workspace(spark)), load(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    rank = F.dense_rank().over(Window.partitionBy("p_brand").orderBy("p_type"))
    rows = p.select(F.col("p_brand").alias("data_type"), F.col("p_type").alias("source"), rank.alias("priority"))
    state.set_priorities(store, rows.withColumn("source", F.concat(F.lit("old "), "source")))
    state.set_priorities(store, rows)
    return store.read("source_priorities")


# ---------------------------------------------------------------- decisions on links

_LINKS = "links AS (SELECT printf('l%09d', event_id) AS link_id, CASE WHEN event_id % 3 = 0 THEN 'confirmed' ELSE 'candidate' END AS resolution, round(coalesce(value, 0) / 100, 4) AS confidence, event_type AS record_type, 'a' || event_id AS canonical_id, 'b' || event_id AS duplicate_id FROM events)"


def _links(spark, sf_dir) -> DataFrame:
    e, n = load(spark, sf_dir, "events"), F.col("event_id")
    rows = e.select(F.format_string("l%09d", n).alias("link_id"), F.col("event_type").alias("record_type"), F.concat(F.lit("a"), n).alias("canonical_id"), F.concat(F.lit("b"), n).alias("duplicate_id"), F.lit("heuristic").alias("match_method"), F.round(F.coalesce("value", F.lit(0.0)) / 100, 4).alias("confidence"), F.when(n % 3 == 0, "confirmed").otherwise("candidate").alias("resolution"))
    return schemas.conform(rows, schemas.DUPLICATE_LINK)


@query(f"WITH {_LINKS} SELECT link_id, record_type, confidence, CAST(row_number() OVER (ORDER BY confidence DESC, link_id) AS INTEGER) AS place FROM links WHERE resolution = 'candidate' ORDER BY place LIMIT 100")
def link_candidates(spark, sf_dir):
    """The first hundred undecided links, as the list shows them."""
    from pyspark.sql import Window

    first = duplicates.candidates(_links(spark, sf_dir)).limit(100)
    return first.select("link_id", "record_type", "confidence", F.row_number().over(Window.orderBy(F.desc("confidence"), "link_id")).alias("place"))  # a hundred rows


@query(f"WITH {_LINKS} SELECT link_id, CASE WHEN record_type = 'click' AND confidence >= 0.5 THEN 'rejected' ELSE resolution END AS resolution FROM links")
def link_decisions(spark, sf_dir):
    links = _links(spark, sf_dir)
    return merge.resolve_link(links, (F.col("record_type") == "click") & (F.col("confidence") >= 0.5), "rejected").select("link_id", "resolution")


# ---------------------------------------------------------------- normalizers

_BIOMARKERS = {"ferritin": ["Marker 3", "marker-7"], "vitamin d": ["MARKER 11!"]}
_LAB_RANGE = "CASE l_partkey % 3 WHEN 0 THEN CAST(l_linenumber AS VARCHAR) || ' - ' || CAST(l_linenumber + 5 AS VARCHAR) WHEN 1 THEN '<' || CAST(l_linenumber AS VARCHAR) ELSE 'n/a' END"


@query(f"""SELECT l_shipdate + INTERVAL 3 HOUR AS collected_at, CASE l_partkey % 20 WHEN 3 THEN 'ferritin' WHEN 7 THEN 'ferritin' WHEN 11 THEN 'vitamin d' END AS canonical_name, 'Marker ' || l_partkey % 20 AS original_name,
  CASE WHEN l_linenumber % 5 <> 0 THEN 1000 + l_quantity END AS numeric_value, CASE WHEN l_linenumber % 5 = 0 THEN 'positive' END AS text_value, CAST(CASE WHEN l_partkey % 3 = 0 THEN l_linenumber END AS DOUBLE) AS reference_low,
  CAST(CASE l_partkey % 3 WHEN 0 THEN l_linenumber + 5 WHEN 1 THEN l_linenumber END AS DOUBLE) AS reference_high, {_LAB_RANGE} AS reference_text, CASE l_linenumber % 3 WHEN 0 THEN true WHEN 1 THEN false END AS fasting FROM lineitem""")
def lab_results_normalized(spark, sf_dir):
    """Rows of a lab file, one for each line item, through header aliases, vocabulary, numbers, ranges and words."""
    li, n = load(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    whole = F.concat(F.lit("1,"), F.lpad(F.col("l_quantity").cast("bigint").cast("string"), 3, "0"))
    span = F.when(F.col("l_partkey") % 3 == 0, F.concat(n, F.lit(" - "), n + 5)).when(F.col("l_partkey") % 3 == 1, F.concat(F.lit("<"), n)).otherwise("n/a")
    raw = li.select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("Collection Date"), F.concat(F.lit("Marker "), F.col("l_partkey") % 20).alias("TEST name"), F.when(n % 5 == 0, "positive").otherwise(whole).alias("Result"), span.alias("Reference range"),
        F.when(n % 3 == 0, "Yes").when(n % 3 == 1, "not fasting").alias("Fasted"), F.monotonically_increasing_id().alias("_row"),
    )
    out = labs.results(raw.drop("_row"), schemas.position(F.lit(None), F.monotonically_increasing_id()), _BIOMARKERS, "Asia/Tokyo")
    return out.select(F.col("collected_at").cast("timestamp_ntz").alias("collected_at"), "canonical_name", "original_name", "numeric_value", "text_value", "reference_low", "reference_high", "reference_text", "fasting")


@query("""WITH s AS (SELECT o_custkey % 50 AS c, CAST(o_orderdate AS DATE) AS d, 100 + o_orderkey % 60 AS v, row_number() OVER (PARTITION BY o_custkey % 50, o_orderdate ORDER BY o_orderkey) AS k FROM orders),
l AS (SELECT o_custkey % 50 AS c, CAST(o_orderdate AS DATE) AS d, 60 + o_orderkey % 100 AS v, row_number() OVER (PARTITION BY o_custkey % 50, o_orderdate ORDER BY o_orderkey DESC) AS k FROM orders)
SELECT 'c' || c AS source_name, d AS local_date, CAST(s.v AS DOUBLE) AS systolic_mmhg, CAST(l.v AS DOUBLE) AS diastolic_mmhg, CASE WHEN s.v > l.v THEN 'valid' ELSE 'suspect' END AS quality FROM s JOIN l USING (c, d, k)""")
def source_xml_pressures(spark, sf_dir):
    """Two records for each order; those of one source and time are paired in the order of the file."""
    o, key = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    at = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(" +0000"))
    halves = F.array(*[F.struct(F.lit(f"HKQuantityTypeIdentifierBloodPressure{part}").alias("type"), v.cast("string").alias("value"), (place + F.lit(0)).cast("bigint").alias("place")) for part, v, place in (("Systolic", 100 + key % 60, key), ("Diastolic", 60 + key % 100, -key))])
    given = {"creationDate": at, "startDate": at, "endDate": at, "type": F.col("h.type"), "unit": F.lit("mmHg"), "value": F.col("h.value"), "sourceName": F.concat(F.lit("c"), F.col("o_custkey") % 50), "device": key.cast("string")}
    rows = o.select("*", F.explode(halves).alias("h"))
    none = F.lit(None).cast("array<struct<_key: string, _value: string>>").alias("entries")
    records = rows.select(*[given.get(n, F.lit(None)).cast("string").alias(n) for n in apple_health.RECORD_ATTRIBUTES], none, schemas.position(F.lit("export.xml"), F.col("h.place")))
    out = apple_health.blood_pressure(records)
    return out.select(F.get_json_object("metadata", "$.apple_health.source_name").alias("source_name"), "local_date", "systolic_mmhg", "diastolic_mmhg", "quality")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS source_record_id, CAST(90 + o_custkey % 60 AS DOUBLE) AS systolic_mmhg, CAST(60 + o_orderkey % 50 AS DOUBLE) AS diastolic_mmhg, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(20 + o_orderkey % 40 AS DOUBLE) END AS pulse_bpm,
  CASE WHEN o_orderkey % 4 = 0 OR 20 + o_orderkey % 40 < 25 OR 90 + o_custkey % 60 <= 60 + o_orderkey % 50 OR o_orderkey % 9 = 0 THEN 'suspect' ELSE 'valid' END AS quality FROM orders""")
def source_api_pressures(spark, sf_dir):
    """Envelopes of pressures: pulses that are missing or implausible, pairs upside down, a value sent twice."""
    o, key = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    measure = lambda v, t: F.struct(v.cast("bigint").alias("value"), F.lit(t).alias("type"), F.lit(0).alias("unit"), F.lit(0).alias("position"))
    systolic = measure(90 + F.col("o_custkey") % 60, 10)
    all_ = F.array(systolic, measure(60 + key % 50, 9), F.when(key % 4 != 0, measure(20 + key % 40, 11)), F.when(key % 9 == 0, systolic))
    text = lambda name: F.lit(None).cast("string").alias(name)
    at = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    group = F.struct(key.alias("grpid"), F.lit(0).alias("attrib"), at.alias("date"), at.alias("created"), F.lit(1).alias("category"), text("deviceid"), text("model"), text("timezone"), F.array_compact(all_).alias("measures"))
    envelope = o.select(F.lit(0).alias("status"), F.struct(F.lit("UTC").alias("timezone"), F.array(group).alias("measuregrps")).alias("body"))
    return withings.api_blood_pressure(withings.groups(envelope)).select("source_record_id", "systolic_mmhg", "diastolic_mmhg", "pulse_bpm", "quality")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS source_record_id, CAST(o_orderdate + to_seconds(o_orderkey % 86400 + 14400 + o_orderkey % 9000) AS DATE) AS sleep_date, CAST(14400 + o_orderkey % 9000 AS BIGINT) AS time_in_bed_seconds, CAST(14400 + o_orderkey % 9000 - o_custkey % 3000 AS BIGINT) AS total_sleep_seconds,
  round((14400 + o_orderkey % 9000 - o_custkey % 3000) * 100.0::DOUBLE / (14400 + o_orderkey % 9000) + 1e-8, 4) AS efficiency_pct, CASE WHEN o_orderkey % 7 > 0 THEN CAST(40 + o_orderkey % 7 AS DOUBLE) END AS resting_hr_bpm FROM orders""")
def source_nights(spark, sf_dir):
    """Nights of an API, one for each order: what is missing of a night is derived, heart rates of zero are none."""
    o, key = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    begin = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + key % 86_400
    bed = 14_400 + key % 9_000
    iso = lambda s: F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    given = {"id": key, "bedtime_start": iso(begin), "bedtime_end": iso(begin + bed), "time_in_bed": bed, "awake_time": F.col("o_custkey") % 3_000, "average_heart_rate": F.when(key % 7 > 0, 40 + key % 7).otherwise(0)}
    docs = o.select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in (f.split() for f in oura.FIELDS["sleep"].split(", "))])
    return rounded(oura.sleep(docs).select("source_record_id", "sleep_date", "time_in_bed_seconds", "total_sleep_seconds", "efficiency_pct", "resting_hr_bpm"))
