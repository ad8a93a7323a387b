"""Registered queries of what comes and goes: streams, raw artifacts and rebuilds, XML and CSV exports, exported datasets, runs."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import scalar
from ..sources import apple_health, raw_store, withings
from ..streaming import ledger as streams
from . import export, rebuild, reports, state, views
from .queries_views import _REAL, _WINDOWS, LEDGER_SQL, _calendar, _rounds, ledgers, rounded
from .registry import load, query, workspace
from .store import SnapshotStore

# ---------------------------------------------------------------- streams


def _fed(spark, sf_dir) -> SnapshotStore:
    """A stream of events into a store, stopped and started again: its second batch has revised events beside known ones."""
    root, e = workspace(spark), load(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp")
    rows = e.select(F.lower("event_type").alias("event_type"), at.alias("started_at"), F.to_date("ts").alias("local_date"), F.floor("value").cast("double").alias("value"), F.lit("feed").alias("source"), F.col("event_id").cast("string").alias("source_record_id"), "event_id")
    late = rows.where("event_id % 3 = 0").withColumn("value", F.col("value") + F.when(F.col("event_id") % 2 == 0, 1).otherwise(0))
    store = SnapshotStore(spark, f"{root}/store")
    for part in (rows, late):
        schemas.conform(part, schemas.EVENT).write.mode("append").parquet(f"{root}/in")
        arriving = spark.readStream.schema(schemas.EVENT).parquet(f"{root}/in")
        streams.merge_stream(arriving, store, "events", f"{root}/checkpoint", name="feed").awaitTermination()
    return store


@query("SELECT CAST(event_id AS VARCHAR) AS source_record_id, event_type, CAST(floor(value) + CASE WHEN event_id % 6 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS value FROM events")
def stream_merged_rows(spark, sf_dir):
    """Late and revised events are merged whatever their age; a known one is not entered twice."""
    return _fed(spark, sf_dir).read("events").select("source_record_id", "event_type", "value")


@query(
    """SELECT 'feed-00000000' AS run_id, 'succeeded' AS status, count(*) AS inserted_count, CAST(0 AS BIGINT) AS updated_count, CAST(0 AS BIGINT) AS duplicate_count FROM events
UNION ALL SELECT 'feed-00000001', 'succeeded', CAST(0 AS BIGINT), count(*) FILTER (WHERE event_id % 2 = 0 AND value IS NOT NULL), count(*) FILTER (WHERE event_id % 2 <> 0 OR value IS NULL) FROM events WHERE event_id % 3 = 0"""
)
def stream_merged_runs(spark, sf_dir):
    """The audit rows of the micro-batches, with what each of them changed."""
    return _fed(spark, sf_dir).read("ingestion_runs").select("run_id", "status", "inserted_count", "updated_count", "duplicate_count")


def _arriving(spark, sf_dir) -> DataFrame:
    """Events as a stream; the brackets make a pattern of the path, which may then be a file or a folder."""
    e = load(spark, sf_dir, "events")
    return spark.readStream.schema(e.schema).parquet(f"{sf_dir}/events.parque[t]").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))


def _settled(preview: DataFrame) -> DataFrame:
    """What a preview shows once all that is there has passed it."""
    spark, root, seen = preview.sparkSession, workspace(preview.sparkSession), []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/{number}")
        seen.append(number)

    preview.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/{max(seen)}")


def _plain(df: DataFrame, *times: str) -> DataFrame:
    return df.withColumns({t: F.col(t).cast("timestamp_ntz") for t in times})


@query("SELECT event_type, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling_windows(spark, sf_dir):
    live = streams.live_windows(_arriving(spark, sf_dir), ["event_type"], "ts", "1 day", None, "60 days", F.count(F.lit(1)).alias("n"))
    return _plain(_settled(live), "window_start", "window_end")


@query("SELECT event_type, s AS window_start, s + INTERVAL 24 HOUR AS window_end, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) - to_hours(CAST(unnest([0, 6, 12, 18]) AS INTEGER)) AS s FROM events) GROUP BY ALL")
def stream_sliding_windows(spark, sf_dir):
    live = streams.live_windows(_arriving(spark, sf_dir), ["event_type"], "ts", "24 hours", "6 hours", "60 days", F.count(F.lit(1)).alias("n"))
    return _plain(_settled(live), "window_start", "window_end")


@query(
    """WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, event_id FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 4 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM l)
SELECT user_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS reading_count FROM s GROUP BY user_id, k"""
)
def stream_sessions(spark, sf_dir):
    return _plain(_settled(streams.live_sessions(_arriving(spark, sf_dir), ["user_id"], "ts", "4 hours", "60 days")), "started_at", "ended_at")


# ---------------------------------------------------------------- raw artifacts

#: When the first artifact was retrieved, in seconds: 2024-01-01.
_FIRST = 1_704_067_200


def _save(pages: DataFrame, root: str, source: str, **more) -> None:
    """Each row (endpoint, at, text) becomes an artifact."""
    at = F.timestamp_seconds(F.lit(_FIRST) + F.col("at"))
    raw_store.save_pages(pages.select("endpoint", at.alias("retrieved_at"), F.col("text").cast("binary").alias("content")), root, source, **more)


@query("SELECT 'pages/' || page_id // 100 AS endpoint, 'text/html' AS content_type, CAST(strlen(string_agg(coalesce(html, ''), chr(10) ORDER BY page_id)) AS BIGINT) AS content_length, sha256(string_agg(coalesce(html, ''), chr(10) ORDER BY page_id)) AS sha256 FROM pages GROUP BY page_id // 100")
def raw_artifacts(spark, sf_dir):
    """A hundred pages an artifact: saved in packs, listed by their manifests, and read through their check."""
    root, p = workspace(spark), load(spark, sf_dir, "pages")
    number = F.floor(F.col("page_id") / 100).cast("bigint")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("page_id", F.coalesce("html", F.lit("")).alias("html")))), lambda x: x["html"])
    made = p.groupBy(number.alias("at")).agg(F.array_join(texts, "\n").alias("text"))
    _save(made.withColumn("endpoint", F.concat(F.lit("pages/"), F.col("at"))), root, "crawl", extension="html", content_type="text/html")
    held = raw_store.verified(spark, root, "crawl").where("length(content) = content_length")
    return held.select("endpoint", "content_type", "content_length", F.sha2("content", 256).alias("sha256")).distinct()


@query("SELECT CAST(o_orderkey AS VARCHAR) AS source_record_id, 'weight_kg' AS metric, CAST(50 + o_custkey % 60 + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS value, 'valid' AS quality FROM orders")
def rebuilt_from_raw(spark, sf_dir):
    """A store made anew from the raw pages of an API, of which later ones revise a third of the groups."""
    root, o, key = workspace(spark), load(spark, sf_dir, "orders"), F.col("o_orderkey")
    at = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))

    def pages(rows: DataFrame, value, first: int) -> DataFrame:
        measure = F.struct(value.cast("bigint").alias("value"), F.lit(1).alias("type"), F.lit(0).alias("unit"))
        group = F.struct(key.alias("grpid"), F.lit(0).alias("attrib"), at.alias("date"), at.alias("created"), F.lit(1).alias("category"), F.array(measure).alias("measures"))
        made = rows.groupBy(F.floor(key / 100).cast("bigint").alias("n")).agg(F.collect_list(group).alias("measuregrps"))  # a hundred keys at most
        envelope = F.struct(F.lit(0).alias("status"), F.struct(F.lit("UTC").alias("timezone"), "measuregrps").alias("body"))
        return made.select(F.lit("measure").alias("endpoint"), (F.lit(first) + F.col("n") % 86_400).alias("at"), F.to_json(envelope).alias("text"))

    value = 50 + F.col("o_custkey") % 60
    _save(pages(o, value, 0), f"{root}/raw", "withings")
    _save(pages(o.where("o_orderkey % 3 = 0"), value + 1, 86_400), f"{root}/raw", "withings")
    store = rebuild.rebuild(spark, f"{root}/raw", f"{root}/store", zone="UTC")
    return store.read("observations").select("source_record_id", "metric", "value", "quality")


# ---------------------------------------------------------------- files of exports


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'weight_kg' WHEN 'view' THEN 'steps' ELSE 'body_temperature_c' END AS metric, round(CASE event_type WHEN 'click' THEN value * 0.45359237 WHEN 'view' THEN value ELSE (value - 32) * 5 / 9 END + 1e-8, 4) AS value, ts AS observed_at FROM events".replace("ts AS observed_at", "date_trunc('second', ts) - INTERVAL 2 HOUR AS observed_at"))
def xml_file_records(spark, sf_dir):
    """The records of an export.xml, written with attributes as the vendor has them, split and parsed again."""
    root, e = workspace(spark), load(spark, sf_dir, "events")
    at = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), F.lit(" +0200"))
    kind = F.when(F.col("event_type") == "click", "BodyMass").when(F.col("event_type") == "view", "StepCount").otherwise("BodyTemperature")
    unit = F.when(F.col("event_type") == "click", "lb").when(F.col("event_type") == "view", "count").otherwise("degF")
    given = {"type": F.concat(F.lit("HKQuantityTypeIdentifier"), kind), "unit": unit, "value": F.col("value").cast("string"), "sourceName": F.concat(F.lit("a & b <"), F.col("event_id")), "creationDate": at, "startDate": at, "endDate": at}
    e.select(*[c.alias(f"_{n}") for n, c in given.items()]).write.format("xml").option("rootTag", "HealthData").option("rowTag", "Record").save(f"{root}/export")
    out = apple_health.observations(apple_health.read_xml(spark, f"{root}/export", "Record"))
    name = F.get_json_object("metadata", "$.apple_health.source_name")
    return _plain(rounded(out.select(F.substring_index(name, "<", -1).cast("bigint").alias("event_id"), "metric", "value", "observed_at")), "observed_at")


def _csv_export(spark, sf_dir) -> dict[str, DataFrame]:
    """A folder of two kinds of CSV files, of two layouts, and of one that is of no use."""
    root, o = workspace(spark), load(spark, sf_dir, "orders")
    at = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("Date")
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    weights = o.select(at, (customer % 300 + 30).alias("Weight (lb)"), F.when(key % 4 != 0, F.concat((key % 70).cast("string"), F.lit(",5"))).alias("Fat ratio (%)"), key.alias("Comments"))
    weights.write.option("header", True).option("sep", ";").csv(f"{root}/export/weights")
    pressures = o.select(at, (90 + customer % 60).alias("Systolic"), (60 + key % 50).alias("Diastolic"), F.when(key % 5 != 0, 50 + key % 40).alias("Heart rate"), F.concat(F.lit('said "'), key, F.lit('", twice')).alias("Comments"))
    pressures.write.option("header", True).option("escape", '"').csv(f"{root}/export/pressures")
    o.select(key.alias("steps"), at).write.option("header", True).csv(f"{root}/export/other")
    return withings.normalize_export(spark, f"{root}/export", "UTC")


@query(
    """SELECT CAST(o_orderdate AS TIMESTAMP) AS observed_at, 'weight_kg' AS metric, round((o_custkey % 300 + 30) * 0.45359237 + 1e-8, 4) AS value, 'lb' AS original_unit, CASE WHEN (o_custkey % 300 + 30) * 0.45359237 BETWEEN 20 AND 500 THEN 'valid' ELSE 'suspect' END AS quality FROM orders
UNION ALL SELECT CAST(o_orderdate AS TIMESTAMP), 'body_fat_pct', round(o_orderkey % 70 + 0.5 + 1e-8, 4), '%', CASE WHEN o_orderkey % 70 + 0.5 BETWEEN 1 AND 75 THEN 'valid' ELSE 'suspect' END FROM orders WHERE o_orderkey % 4 <> 0"""
)
def csv_export_weights(spark, sf_dir):
    """Masses in pounds and shares with decimal commas, found by their headers."""
    return _plain(rounded(_csv_export(spark, sf_dir)["observations"].select("observed_at", "metric", "value", "original_unit", "quality")), "observed_at")


@query(
    """SELECT CAST(o_orderdate AS TIMESTAMP) AS measured_at, CAST(90 + o_custkey % 60 AS DOUBLE) AS systolic_mmhg, CAST(60 + o_orderkey % 50 AS DOUBLE) AS diastolic_mmhg, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(50 + o_orderkey % 40 AS DOUBLE) END AS pulse_bpm, 'said "' || o_orderkey || '", twice' AS notes,
  CASE WHEN o_orderkey % 5 = 0 OR 90 + o_custkey % 60 <= 60 + o_orderkey % 50 THEN 'suspect' ELSE 'valid' END AS quality FROM orders"""
)
def csv_export_pressures(spark, sf_dir):
    """Pairs with notes that hold quotes and delimiters; one without a pulse, or upside down, is suspect."""
    found = _csv_export(spark, sf_dir)["blood_pressure"]
    return _plain(found.select("measured_at", "systolic_mmhg", "diastolic_mmhg", "pulse_bpm", "notes", "quality"), "measured_at")


# ---------------------------------------------------------------- datasets and dashboard


@query("SELECT kind, event_type, ts AS started_at, round(value, 6) AS value, CAST(event_id AS VARCHAR) AS source_record_id FROM events, (VALUES ('csv'), ('parquet')) k(kind)")
def exported_events(spark, sf_dir):
    """The dataset of events in both formats, read back."""
    e = load(spark, sf_dir, "events")
    rows = e.select("event_type", F.col("ts").cast("timestamp").alias("started_at"), "value", F.lit("feed").alias("source"), F.col("event_id").cast("string").alias("source_record_id"))
    led, root = views.Ledgers(spark, {"events": rows}), workspace(spark)
    paths = {kind: export.export_datasets(led, root, kind=kind, names=("events",))["events"] for kind in ("parquet", "csv")}
    schema = ", ".join(f"{c} {t}" for c, t in led.table("events").dtypes)
    read = {"parquet": spark.read.parquet(paths["parquet"]), "csv": spark.read.schema(schema).option("header", True).csv(paths["csv"])}
    parts = [df.select(F.lit(kind).alias("kind"), "event_type", "started_at", F.round("value", 6).alias("value"), "source_record_id") for kind, df in read.items()]
    return _plain(parts[0].unionByName(parts[1]), "started_at")


_NEWEST = "(SELECT subject_id, max(local_date) AS local_date FROM cal GROUP BY subject_id)"


@query(LEDGER_SQL + f"SELECT * REPLACE (round(weight_kg_avg * {scalar.LB_PER_KG} + 1e-8, 4) AS weight_kg_avg, {', '.join(f'round({c} + 1e-8, 4) AS {c}' for c in _REAL if c != 'weight_kg_avg')}) FROM ({_WINDOWS.format(anchors=_NEWEST)})")
def dashboard_trends_rolling(spark, sf_dir):
    return rounded(reports.trends(ledgers(spark, sf_dir), _calendar(spark, sf_dir), 90)["rolling"])


@query("SELECT CAST(l_shipdate AS TIMESTAMP) AS at, CASE WHEN l_partkey % 3 = 0 THEN 'known ' ELSE 'marker ' END || l_partkey % 20 AS name, CAST(l_quantity AS DOUBLE) AS numeric_value FROM (SELECT *, concat_ws('-', lpad(CAST(l_orderkey AS VARCHAR), 12, '0'), l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) ORDER BY CASE WHEN l_linenumber = 1 THEN NULL ELSE l_shipdate END DESC NULLS LAST, k LIMIT 50".replace("CAST(l_shipdate AS TIMESTAMP) AS at", "CASE WHEN l_linenumber <> 1 THEN CAST(l_shipdate AS TIMESTAMP) END AS at"))
def dashboard_trends_labs(spark, sf_dir):
    """The fifty newest results, by when they were taken or else came; those without a time are last."""
    li, n = load(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    key, number = F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), "l_linenumber", "l_partkey", "l_suppkey"), (F.col("l_partkey") % 20).cast("string")
    at = F.col("l_shipdate").cast("timestamp")
    rows = li.select(F.when((n != 1) & (n % 2 == 0), at).alias("collected_at"), F.when((n != 1) & (n % 2 != 0), at).alias("resulted_at"), F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("known "), number)).alias("canonical_name"), F.concat(F.lit("marker "), number).alias("original_name"), F.col("l_quantity").cast("double").alias("numeric_value"), F.lit("lab").alias("source"), key.alias("source_record_id"))
    labs = reports.trends(views.Ledgers(spark, {"lab_results": rows}), _calendar(spark, sf_dir), 90)["labs"]
    return _plain(labs.select("at", "name", "numeric_value"), "at")


@query(
    """SELECT o_orderstatus AS source, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'succeeded' END AS state, o_orderstatus <> 'P' AS ok, CASE WHEN o_orderstatus = 'P' THEN 'ValueError' ELSE 'none' END AS error, CASE WHEN o_orderstatus <> 'P' THEN max(CAST(o_orderdate AS TIMESTAMP)) END AS last_successful_end, count(*) AS inserted_count FROM orders GROUP BY o_orderstatus"""
)
def sync_states(spark, sf_dir):
    """An import for each status of orders, one of which fails after its merge: what was merged counts, and no watermark moves."""
    store, o = SnapshotStore(spark, workspace(spark)), load(spark, sf_dir, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    rows = schemas.conform(o.select(F.lit("order").alias("event_type"), at.alias("started_at"), F.col("o_orderstatus").alias("source"), F.col("o_orderkey").cast("string").alias("source_record_id")), schemas.EVENT)
    shown = []
    for r in o.groupBy("o_orderstatus").agg(F.unix_micros(F.max(at)).alias("us")).orderBy("o_orderstatus").collect():  # three rows
        source = r["o_orderstatus"]
        try:
            with state.Run(store, source, None, datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=r["us"])) as run:
                run.merge({"events": rows.where(F.col("source") == source)})
                if source == "P":
                    raise ValueError("the feed broke off")
        except ValueError:
            pass
        s = state.sync_status(store, source)
        end = s["last_successful_end"]
        shown.append(F.struct(*[F.lit(s[c]).alias(c) for c in ("source", "state", "ok", "error")], F.lit(end and end.replace(tzinfo=None).isoformat()).cast("timestamp_ntz").alias("last_successful_end"), F.lit(s["inserted_count"]).cast("bigint").alias("inserted_count")))
    return spark.range(1).select(F.inline(F.array(*shown)))
