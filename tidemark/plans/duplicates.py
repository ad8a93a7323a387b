"""Cross-source duplicate links: rules, canonical side, refresh."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import merge, pairs
from .views import Ledgers, S

CONFIRM_AT = 0.9
KEYS = ["record_type", "canonical_id", "duplicate_id", "match_method"]


def _side(df: DataFrame, data_type: str | Column, led: Ledgers, *extra: str) -> DataFrame:
    """What a rule needs of a row; names are brought to their plain form here, once a row and not once a pair."""
    name = F.when(F.col("source") == "apple_health", scalar.vendor_text(F.get_json_object("metadata", "$.apple_health.source_name")))
    return led.ranked(df, data_type).select(F.concat_ws("|", "source", "source_record_id", *(["metric"] if "metric" in df.columns else [])).alias("id"), S, "source", "priority", name.alias("named"), scalar.plain_text(F.col("source")).alias("vendor"), *extra)


def _provenance() -> Column:
    """One side is an Apple copy whose own source names the other side's vendor."""
    return scalar.named_alike(F.col("a_named"), F.col("b_vendor")) | scalar.named_alike(F.col("b_named"), F.col("a_vendor"))


def _links(p: DataFrame, kind: str, method: Column, confidence: Column) -> DataFrame:
    (ap, asrc, aid), (bp, bsrc, bid) = ([F.col(f"{x}_{c}") for c in ("priority", "source", "id")] for x in "ab")
    first = (ap < bp) | ((ap == bp) & ((asrc < bsrc) | ((asrc == bsrc) & (aid <= bid))))
    out = p.withColumns({"match_method": method, "confidence": confidence}).where("match_method is not null")
    resolution = F.when(F.col("confidence") >= CONFIRM_AT, "confirmed").otherwise("candidate")
    facts = F.to_json(F.struct(*[F.col(c) for c in ("seconds_apart", "difference", "overlap") if c in out.columns]))
    return out.select(F.lit(kind).alias("record_type"), F.when(first, aid).otherwise(bid).alias("canonical_id"), F.when(first, bid).otherwise(aid).alias("duplicate_id"), "match_method", "confidence", resolution.alias("resolution"), F.lit(merge.GENERATED).alias("generated_by"), facts.alias("facts"))


def observation_links(led: Ledgers) -> DataFrame:
    o = _side(led.table("observations").where("quality <> 'invalid'"), F.col("metric"), led, "metric", "observed_at", "value")
    p = pairs.near_couples(o, "observed_at", 600, "id", equal=[S, "metric"], condition="a_source <> b_source")
    dt = F.abs(pairs.seconds_of("a_observed_at") - pairs.seconds_of("b_observed_at"))
    gap = F.abs(F.col("a_value") - F.col("b_value"))
    rel = gap / F.greatest(F.abs("a_value"), F.abs("b_value"), F.lit(1.0))
    named = _provenance() & (dt <= 60) & (rel <= 0.01)
    exact = (dt <= 1) & (gap <= 1e-6)
    method = F.when(named, "apple_provenance").when(exact, "exact").when(rel <= 0.05, "heuristic")
    confidence = F.when(named, 0.99).when(exact, 0.98).otherwise(F.greatest(F.lit(0.7), F.lit(0.9) - dt / 6000 - 2 * rel))
    return _links(p.withColumns({"seconds_apart": dt, "difference": rel}), "observation", method, confidence)


def blood_pressure_links(led: Ledgers) -> DataFrame:
    b = _side(led.table("blood_pressure").where("quality <> 'invalid'"), "blood_pressure", led, "measured_at", "systolic_mmhg", "diastolic_mmhg")
    p = pairs.near_couples(b, "measured_at", 300, "id", equal=[S], condition="a_source <> b_source")
    dt = F.abs(pairs.seconds_of("a_measured_at") - pairs.seconds_of("b_measured_at"))
    far = F.greatest(F.abs(F.col("a_systolic_mmhg") - F.col("b_systolic_mmhg")), F.abs(F.col("a_diastolic_mmhg") - F.col("b_diastolic_mmhg")))
    named = _provenance() & (far <= 1)
    exact = (dt <= 1) & (far == 0)
    method = F.when(named, "apple_provenance").when(exact, "exact").when(far <= 5, "heuristic")
    return _links(p.withColumns({"seconds_apart": dt, "difference": far}), "blood_pressure", method, F.when(named, 0.99).when(exact, 0.98).otherwise(0.82))


def interval_links(led: Ledgers, ledger: str, kind: str, data_type: str, heuristic: str, *same: str) -> DataFrame:
    i = _side(led.table(ledger).where("started_at is not null and ended_at is not null"), data_type, led, "started_at", "ended_at", *same)
    p = pairs.overlap_couples(i, "started_at", "ended_at", "id", equal=[S, *same], condition="a_source <> b_source")
    a0, a1, b0, b1 = (pairs.seconds_of(c) for c in ("a_started_at", "a_ended_at", "b_started_at", "b_ended_at"))
    share, ratio = pairs.overlap_share(a0, a1, b0, b1)
    named = _provenance() & (share >= 0.9)
    exact = (F.abs(a0 - b0) <= 1) & (F.abs(a1 - b1) <= 1)
    method = F.when(named, "apple_provenance").when(exact, "exact").when(share >= 0.5, heuristic)
    confidence = F.when(named, 0.99).when(exact, 0.98).otherwise(F.least(F.lit(0.94), F.lit(0.65) + 0.2 * share + 0.1 * ratio))
    return _links(p.withColumn("overlap", share), kind, method, confidence)


def find_links(led: Ledgers) -> DataFrame:
    found = [observation_links(led), blood_pressure_links(led), interval_links(led, "sleep_sessions", "sleep_session", "sleep", "interval_overlap"), interval_links(led, "workouts", "workout", "workouts", "workout_overlap", "workout_type")]
    return reduce(DataFrame.unionByName, found)


def refresh(led: Ledgers, stored: DataFrame) -> DataFrame:
    """The next link table; rejected decisions and links made by hand survive."""
    return merge.merge_links(stored, find_links(led), KEYS)


def candidates(links: DataFrame) -> DataFrame:
    return links.where("resolution = 'candidate'").orderBy(F.desc("confidence"), "created_at", "link_id", *KEYS)


