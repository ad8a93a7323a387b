"""Parsing column functions: numbers, instants, ranges, names, booleans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_name(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def first_contained(text: Column, vocabulary: list[tuple[str, str]], default: str | None = None) -> Column:
    """The value of the first listed word that the text contains."""
    out = F.lit(default).cast("string")
    for word, value in reversed(vocabulary):
        out = F.when(text.contains(word), value).otherwise(out)
    return out


def finite(value: Column) -> Column:
    return F.when(F.abs(value) < float("inf"), value)  # NaN is more than any number


def number(text: Column, *, thousands: bool = False) -> Column:
    """A finite double or null; a comma is a decimal comma, or with ``thousands`` a separator."""
    return finite(any_number(text, thousands=thousands))


def any_number(text: Column, *, thousands: bool = False) -> Column:
    """``number`` before it is known to be finite."""
    plain = F.trim(text)
    for space in ("\u00a0", "\u202f", " "):
        plain = F.replace(plain, F.lit(space), F.lit(""))
    plain = F.replace(plain, F.lit(","), F.lit("" if thousands else "."))
    return plain.try_cast("double")


def iso(text: Column) -> Column:
    """ISO 8601 of texts that have a space for the ``T``, one before the offset, or an offset without a colon."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text), "^(\\d{4}-\\d{2}-\\d{2}) ", "$1T"), " (?=[+-]\\d{2}:?\\d{2}$)", "")
    return F.regexp_replace(t, "([+-]\\d{2})(\\d{2})$", "$1:$2")


def instant(text: Column, zone: str = "UTC") -> Column:
    """ISO 8601, ``Z`` or an offset; a text without an offset is local to the zone."""
    return iso_instant(iso(text), zone)


def iso_instant(t: Column, zone: str) -> Column:
    aware = t.rlike("(Z|[+-]\\d{2}:\\d{2})$") & t.contains("T")
    return F.when(aware, t.try_cast("timestamp")).otherwise(F.to_utc_timestamp(t.try_cast("timestamp_ntz").cast("timestamp"), zone))


def lab_iso(text: Column) -> Column:
    """As ``iso``; a bare date gets the noon."""
    day = F.trim(text).rlike("^\\d{4}-\\d{2}-\\d{2}$")
    return F.when(day, F.concat(F.trim(text), F.lit("T12:00:00"))).otherwise(iso(text))


def lab_instant(text: Column, zone: str) -> Column:
    """As ``instant``; a bare date is noon of the zone."""
    return iso_instant(lab_iso(text), zone)


def offset_date(text: Column) -> Column:
    """The wall-clock date written in the text."""
    return F.substring(F.trim(text), 1, 10).try_cast("date")


def unspaced(text: Column) -> Column:
    """Without white space; of null an empty text."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\f\r", "")


def reference_range(text: Column) -> tuple[Column, Column]:
    """(low, high) of ``a-b``, ``<b`` or ``>a``; null otherwise."""
    return range_of(unspaced(text))


def range_of(t: Column) -> tuple[Column, Column]:
    """``reference_range`` of a text without white space.  A pattern is tried only where its sign stands."""
    both, one = "^(-?[0-9.]+)[-–](-?[0-9.]+)$", "^([<>]=?|≤|≥)(-?[0-9.]+)$"
    pick = lambda pattern, k: F.regexp_extract(t, pattern, k).try_cast("double")
    first, span = F.substring(t, 1, 1), t.contains("-") | t.contains("–")
    low = F.when(first.isin(">", "≥"), pick(one, 2)).when(span, pick(both, 1))
    high = F.when(first.isin("<", "≤"), pick(one, 2)).when(span, pick(both, 2))
    return low, high


# Words for yes and no.
YES, NO = ("1", "true", "yes", "y", "fasting"), ("0", "false", "no", "n", "non fasting", "not fasting")


def boolean(text: Column) -> Column:
    """True, false or null; ``boolean_valid`` tells an unknown word from an empty one."""
    return word_boolean(normalize_name(text))


def boolean_valid(text: Column) -> Column:
    return word_valid(normalize_name(F.coalesce(text, F.lit(""))))


def word_boolean(t: Column) -> Column:
    """``boolean`` of a word in normal form, an empty one for none."""
    return F.when(t.isin(*YES), True).when(t.isin(*NO), False)


def word_valid(t: Column) -> Column:
    return (t == "") | t.isin(*YES, *NO)
