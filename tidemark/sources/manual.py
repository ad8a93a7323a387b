"""Manually entered workouts and events: a JSON document each, kept raw, then normalized and merged as every other source.

A document is made once, on the driver, by ``workout_document`` or ``event_document``; what becomes of many of them is a plan over
the pages of the raw store.  Documents that do not hold to their form are an error that names what is wrong.
"""

from __future__ import annotations

import hashlib
import json
import math
from datetime import UTC, date, datetime, time, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from ..schemas import EVENT, EVENT_TYPES, WORKOUT, WORKOUT_TYPES, conform, placed
from .raw_store import parsed

SOURCE, FORM = "manual", 1
WORKOUTS, EVENTS = "manual/workout", "manual/event"
VERSIONS = {WORKOUTS: "manual-workout-v1", EVENTS: "manual-event-v1"}
# The fields of a document, and the most of what it may hold.
FIELDS = {
    WORKOUTS: "schema_version int, source_record_id string, created_at string, started_at string, ended_at string, local_date string, workout_type string, duration_seconds bigint, focus string, rpe double, notes string",
    EVENTS: "schema_version int, source_record_id string, created_at string, event_type string, started_at string, ended_at string, local_date string, value double, unit string, notes string",
}
MOST_SECONDS, MOST_HOURS = 86_400, 8_760
MOST_CHARACTERS = {"focus": 200, "unit": 100, "notes": 4_000}

# ---------------------------------------------------------------- one document


def _text(value: str | None) -> str | None:
    return (value or "").strip() or None


def _word(value: str) -> str:
    return value.strip().lower().replace("-", "_").replace(" ", "_")


def _start(zone: str, day: date | None, at: time | None, now: datetime) -> datetime:
    """The given local date and time; what is not given is that of ``now``, to the minute."""
    here = now.astimezone(ZoneInfo(zone))
    return datetime.combine(day or here.date(), at or here.time().replace(second=0, microsecond=0), ZoneInfo(zone))


def _document(kind: str, now: datetime, day: date, content: dict) -> dict:
    """The identity is that of the content, so that an entry made twice is one record."""
    digest = hashlib.sha256(json.dumps(content, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:32]
    return {"schema_version": FORM, "source_record_id": f"{kind.replace('/', '-')}:{digest}", "created_at": now.astimezone(UTC).isoformat(), "local_date": day.isoformat(), **content}


def _aware(now: datetime | None) -> datetime:
    now = now or datetime.now(UTC)
    if now.utcoffset() is None:
        raise ValueError("an instant with its offset is needed")
    return now


def workout_document(workout_type: str, minutes: int, zone: str, *, day: date | None = None, at: time | None = None, focus: str | None = None, rpe: float | None = None, notes: str | None = None, now: datetime | None = None) -> dict:
    """Without a date and a time the workout ends now."""
    now, kind = _aware(now), _word(workout_type)
    if kind not in WORKOUT_TYPES or int(minutes) != minutes or not 0 < minutes * 60 <= MOST_SECONDS or rpe is not None and not 0 <= rpe <= 10:
        raise ValueError(f"a workout has one of the types {', '.join(WORKOUT_TYPES)}, 1 to {MOST_SECONDS // 60} whole minutes and an effort of 0 to 10")
    length = timedelta(minutes=minutes)
    start = _start(zone, day, at, now) - (length if day is None and at is None else timedelta())
    content = {"started_at": start.isoformat(), "ended_at": (start + length).isoformat(), "workout_type": kind, "duration_seconds": int(minutes) * 60, "focus": _text(focus), "rpe": rpe, "notes": _text(notes)}
    return _document(WORKOUTS, now, start.date(), content)


def event_document(event_type: str, zone: str, *, day: date | None = None, at: time | None = None, hours: float | None = None, value: float | None = None, unit: str | None = None, notes: str | None = None, now: datetime | None = None) -> dict:
    now, kind = _aware(now), _word(event_type)
    if kind not in EVENT_TYPES or hours is not None and not 0 < hours <= MOST_HOURS or value is not None and not math.isfinite(value):
        raise ValueError(f"an event has one of the types {', '.join(EVENT_TYPES)}, more than 0 and at most {MOST_HOURS} hours if any, and a finite value")
    if kind == "alcohol" and not (value or 0) > 0:
        raise ValueError("drinks are counted by a number above 0")
    start = _start(zone, day, at, now)
    end = None if hours is None else (start + timedelta(hours=hours)).isoformat()
    content = {"event_type": kind, "started_at": start.isoformat(), "ended_at": end, "value": value, "unit": _text(unit) or ("drinks" if kind == "alcohol" else None), "notes": _text(notes)}
    return _document(EVENTS, now, start.date(), content)


def written(document: dict) -> bytes:
    return (json.dumps(document, sort_keys=True, separators=(",", ":")) + "\n").encode()


# ---------------------------------------------------------------- many documents


def _faults(endpoint: str) -> list[tuple[Column, str]]:
    """What can be wrong with a document, beside fields that the form does not have."""
    c = F.col
    names = [f.split()[0] for f in FIELDS[endpoint].split(", ")]
    start, end = parse.instant(c("started_at")), parse.instant(c("ended_at"))
    bare = lambda n: ~c(n).rlike("T.*(Z|[+-]\\d{2}:?\\d{2})$") | parse.instant(c(n)).isNull()
    faults = [
        (F.coalesce(c("schema_version"), F.lit(FORM)) != FORM, "schema_version"),
        (F.coalesce(c("source_record_id") == "", F.lit(True)), "source_record_id"),
        *[(F.coalesce(bare(n), F.lit(True)), n) for n in ("created_at", "started_at")],
        (c("ended_at").isNotNull() & bare("ended_at"), "ended_at"),
        (c("local_date").try_cast("date").isNull(), "local_date"),
        *[(F.length(n) > most, n) for n, most in MOST_CHARACTERS.items() if n in names],
    ]
    if endpoint == WORKOUTS:
        elapsed = F.unix_seconds(end) - F.unix_seconds(start)
        return [*faults, (F.coalesce(~c("workout_type").isin(*WORKOUT_TYPES), F.lit(True)), "workout_type"), (F.coalesce(~c("duration_seconds").between(1, MOST_SECONDS) | (elapsed != c("duration_seconds")), F.lit(True)), "duration_seconds"), (~c("rpe").between(0, 10), "rpe")]
    sober = (c("event_type") == "alcohol") & ~F.coalesce(c("value") > 0, F.lit(False))
    return [*faults, (F.coalesce(~c("event_type").isin(*EVENT_TYPES), F.lit(True)), "event_type"), (end < start, "ended_at"), (sober, "value")]


def normalize(pages: DataFrame, endpoint: str) -> dict[str, DataFrame]:
    """Ledger -> rows of documents (path, content) of one endpoint; the later path of an identity wins in the merge."""
    if endpoint not in FIELDS:
        raise ValueError(f"no such entry: {endpoint}")
    names = [f.split()[0] for f in FIELDS[endpoint].split(", ")]
    more = F.array_except(F.json_object_keys(F.decode("content", "utf-8")), F.array(*map(F.lit, names)))
    read = parsed(pages.withColumn("_more", more), FIELDS[endpoint], "_more")
    docs = read.select("_page.*", "_more", *placed(read))
    faults = F.array_union(F.coalesce("_more", F.array(F.lit("no object"))), F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(n)) for bad, n in _faults(endpoint)])))
    judged = docs.withColumn("_faults", faults)
    key = F.when(F.size("_faults") == 0, F.col("source_record_id")).otherwise(F.raise_error(F.concat(F.lit(f"not a {endpoint.replace('/', ' ')}: "), F.array_join("_faults", ", "))))
    own = F.struct(F.coalesce("schema_version", F.lit(FORM)).alias("entry_schema_version"), *([F.col("focus")] if endpoint == WORKOUTS else []))
    rows = judged.withColumns(
        {
            "source_record_id": key,
            "started_at": parse.instant(F.col("started_at")),
            "ended_at": parse.instant(F.col("ended_at")),
            "local_date": F.col("local_date").try_cast("date"),
            "source": F.lit(SOURCE),
            "transform_version": F.lit(VERSIONS[endpoint]),
            "metadata": F.to_json(F.struct(own.alias("manual"))),
        }
    )
    return {"workouts": conform(rows, WORKOUT)} if endpoint == WORKOUTS else {"events": conform(rows, EVENT)}


def rows_of(spark: SparkSession, endpoint: str, document: dict) -> DataFrame:
    """The ledger row of one document."""
    pages = spark.createDataFrame([(None, bytearray(written(document)))], "path string, content binary")
    return next(iter(normalize(pages, endpoint).values()))
