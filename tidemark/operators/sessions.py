"""Gap sessions of repeated readings, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessionize(rows: DataFrame, keys: list[str], time: str, gap_seconds: float, *, tie: str, session: str = "session_number", ordinal: str = "reading_number") -> DataFrame:
    """Number the sessions of each group; a new one starts where the gap to the reading before is larger than the limit."""
    order = Window.partitionBy(*keys).orderBy(time, tie)
    seconds = F.col(time).cast("timestamp").cast("double")
    before = F.lag(seconds).over(order)
    starts = F.when(before.isNull() | (seconds - before > gap_seconds), 1).otherwise(0)
    numbered = rows.withColumn("_start", starts).withColumn(session, F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(*keys, session).orderBy(time, tie)
    return numbered.drop("_start").withColumn(ordinal, F.row_number().over(inner).cast("bigint"))


def session_stats(readings: DataFrame, keys: list[str], time: str, tie: str, values: list[str], *, session: str = "session_number", ordinal: str = "reading_number") -> DataFrame:
    """Per session: bounds, count, and for each value its first, the mean of the later ones, the mean, and the preferred one."""
    at = F.struct(time, tie)
    out: list[Column] = [F.min(time).alias("started_at"), F.max(time).alias("ended_at"), F.count(F.lit(1)).alias("reading_count")]
    for v in values:
        out += [F.min_by(v, at).alias(f"first_{v}"), F.avg(F.when(F.col(ordinal) > 1, F.col(v))).alias(f"subsequent_{v}"), F.avg(v).alias(f"mean_{v}")]
    stats = readings.groupBy(*keys, session).agg(*out)
    return stats.withColumns({f"preferred_{v}": F.coalesce(f"subsequent_{v}", F.col(f"first_{v}").cast("double")) for v in values})


def native_sessions(rows: DataFrame, keys: list[str], time: str, gap: str, *aggregates: Column) -> DataFrame:
    """The same sessions through Spark's session window (one aggregation, streaming capable)."""
    grouped = rows.groupBy(*keys, F.session_window(time, gap).alias("_w")).agg(F.min(time).alias("started_at"), F.max(time).alias("ended_at"), F.count(F.lit(1)).alias("reading_count"), *aggregates)
    return grouped.drop("_w")
