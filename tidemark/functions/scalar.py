"""Scalar column functions: zones, differences, units, plausibility, similarity, classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factors of unit conversions.
KG_PER_LB, LB_PER_KG, METERS_PER_MILE = 0.45359237, 2.2046226218487757, 1609.344


def local_date(at: Column, zone: Column | str | None) -> Column:
    """Date of an instant in a zone (UTC if there is none); the session zone must be UTC."""
    z = F.lit(zone) if isinstance(zone, str) else zone
    return F.to_date(F.from_utc_timestamp(at, F.coalesce(z, F.lit("UTC"))))


def local_date_of(stored: Column, at: Column, zone: Column) -> Column:
    return F.coalesce(stored, local_date(at, zone))


def date_diff(unit: str, a: Column, b: Column) -> Column:
    """Boundaries crossed between a and b, as integer seconds, milliseconds or days."""
    a, b = a.cast("timestamp"), b.cast("timestamp")
    if unit == "second":
        return F.unix_seconds(b) - F.unix_seconds(a)
    if unit == "millisecond":
        return F.unix_millis(b) - F.unix_millis(a)
    if unit == "day":
        return F.datediff(F.to_date(b), F.to_date(a)).cast("bigint")
    raise ValueError(unit)


def convert_unit(value: Column, unit: Column) -> Column:
    """To the canonical unit: lb and g to kg, degF to degC, mi to m, s to min; others stay."""
    u = F.lower(unit)
    return (
        F.when(u.isin("lb", "lbs"), value * KG_PER_LB)
        .when(u == "g", value / 1000.0)
        .when(u == "degf", (value - 32.0) * 5.0 / 9.0)
        .when(u == "mi", value * METERS_PER_MILE)
        .when(u == "s", value / 60.0)
        .otherwise(value)
    )


def canonical_unit(unit: Column) -> Column:
    u = F.lower(unit)
    return F.when(u.isin("lb", "lbs", "g"), "kg").when(u == "degf", "degC").when(u == "mi", "m").when(u == "s", "min").otherwise(unit)


def scaled(value: Column, exponent: Column) -> Column:
    """value * 10^exponent without binary error: through the decimal text."""
    return F.concat(value.cast("string"), F.lit("e"), exponent.cast("string")).cast("double")


def plausibility(value: Column, ranges: dict[str, tuple[float, float]], metric: str | Column) -> tuple[Column, Column]:
    """(quality, reasons): suspect outside the metric's range, with the list of reasons."""
    m = F.lit(metric) if isinstance(metric, str) else metric
    low = F.coalesce(*[F.when(m == k, F.lit(float(a))) for k, (a, _) in ranges.items()], F.lit(None).cast("double"))
    high = F.coalesce(*[F.when(m == k, F.lit(float(b))) for k, (_, b) in ranges.items()], F.lit(None).cast("double"))
    reasons = F.array_compact(F.array(F.when(value < low, "below_plausible_range"), F.when(value > high, "above_plausible_range")))
    return F.when(F.size(reasons) > 0, "suspect").otherwise("valid"), reasons


def rounded(value: Column, digits: int) -> Column:
    """round(value, digits) of a double, the same to the last bit: in decimals only next to a tie and where doubles are too coarse."""
    scale = float(10**digits)
    at = value * scale
    plain = (F.abs(at) < 1e9) & (F.abs(at - F.floor(at) - 0.5) > 1e-6)
    return F.when(plain, F.floor(at + 0.5) / scale).otherwise(F.round(value, digits))


def positive_or_null(value: Column) -> Column:
    """Vitals that can only be positive use zero for missing."""
    return F.when(value > 0, value)


def derived_sleep(total: Column, in_bed: Column, awake: Column, efficiency: Column) -> tuple[Column, Column]:
    """(total, efficiency) with the missing ones derived from time in bed."""
    t = F.coalesce(total, F.when(in_bed.isNotNull() & awake.isNotNull(), F.greatest(in_bed - awake, F.lit(0))))
    e = F.coalesce(efficiency.cast("double"), F.when(in_bed > 0, t / in_bed.cast("double") * 100.0))
    return t, e


def cadence(metric: Column) -> Column:
    """How often a metric is expected."""
    episodic = metric.startswith("event:") | metric.startswith("workout:")
    periodic = metric.startswith("lab:") | metric.isin("weight", "body_fat", "blood_pressure")
    return F.when(episodic, "episodic").when(periodic, "periodic").otherwise("daily")


def freshness(days: Column, kind: Column) -> Column:
    limit = F.when(kind == "daily", 3).when(kind == "periodic", 30)
    return F.when(kind == "episodic", "episodic").when(days <= limit, "current").otherwise("stale")


def vendor_matches(source_name: Column, vendor: Column) -> Column:
    """Whether a free-text provenance names the vendor (or is part of its name)."""
    return named_alike(vendor_text(source_name), plain_text(vendor))


def plain_text(name: Column) -> Column:
    """Letters and digits of a name; null if there are none."""
    return F.nullif(F.regexp_replace(F.lower(name), "[^a-z0-9]+", ""), F.lit(""))


def vendor_text(source_name: Column) -> Column:
    return F.replace(plain_text(source_name), F.lit("healthmate"), F.lit("withings"))


def named_alike(a: Column, b: Column) -> Column:
    """Whether one of two plain names is part of the other."""
    return F.coalesce(a.contains(b) | b.contains(a), F.lit(False))


def identity(*parts: Column, length: int = 64) -> Column:
    """Deterministic key: hex SHA-256 of the parts, nulls told apart from empty strings."""
    text = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])
    return F.substring(F.sha2(text, 256), 1, length)
