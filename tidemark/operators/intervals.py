"""Interval unions: gaps and islands over running ends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, keys: list[str], start: str, end: str, *, gap_seconds: float = 0.0, tie: list[str] | None = None, island: str = "island", piece_seconds: float | None = None) -> DataFrame:
    """Number the islands of each group: one starts where an interval begins later than every earlier end plus the gap.

    Touching intervals (and gaps of exactly the limit) stay together.  With ``piece_seconds`` a group is cut into pieces of time,
    so that even one group with all rows uses all tasks: each piece knows the latest end, and then the number of islands, of
    the pieces before it, from one row a piece; inside, both run on.  The rows are read once more for each of the two.
    """
    order = [start, end, *(tie or [])]
    seconds = lambda c: F.col(c).cast("timestamp").cast("double")
    pieces = [] if piece_seconds is None else ["_piece"]
    placed = rows if piece_seconds is None else rows.withColumn("_piece", F.floor(seconds(start) / piece_seconds))
    inside = Window.partitionBy(*keys, *pieces).orderBy(*order)
    before = F.max(seconds(end)).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    if pieces:
        placed = _carried(placed, keys, F.max(seconds(end)), F.max, "_reached")
        before = F.greatest(before, "_reached")
    begins = F.when(before.isNull() | (seconds(start) > before + gap_seconds), 1).otherwise(0).cast("bigint")
    flagged = placed.withColumn("_begin", begins)
    number = F.sum("_begin").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    if pieces:
        flagged = _carried(flagged, keys, F.sum("_begin"), F.sum, "_past")
        number = number + F.coalesce("_past", F.lit(0))
    return flagged.withColumn(island, number).drop("_begin", "_reached", "_past", *pieces)


def _carried(rows: DataFrame, keys: list[str], of_piece: Column, over_pieces, name: str) -> DataFrame:
    """Adds what the earlier pieces of a group come to: an aggregate of each piece, then a window over one row a piece."""
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    known = rows.groupBy(*keys, "_piece").agg(of_piece.alias("_v")).withColumn(name, over_pieces("_v").over(earlier))
    known = known.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_piece"])], name)
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, "_piece"])]
    return rows.join(known, reduce(lambda x, y: x & y, on), "left").drop(*[f"_k{i}" for i in range(len(on))])


def merge_islands(rows: DataFrame, keys: list[str], start: str, end: str, *, gap_seconds: float = 0.0, piece_seconds: float | None = None) -> DataFrame:
    """One row per island: keys, start, end, number of intervals, seconds covered."""
    numbered = islands(rows, keys, start, end, gap_seconds=gap_seconds, piece_seconds=piece_seconds)
    merged = numbered.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("intervals"))
    seconds = F.unix_seconds(F.col(end).cast("timestamp")) - F.unix_seconds(F.col(start).cast("timestamp"))
    return merged.withColumn("seconds", seconds)


def episodes(rows: DataFrame, keys: list[str], start: str, end: str, day: str, *, gap_seconds: float, episode: str = "episode", piece_seconds: float | None = None) -> DataFrame:
    """Islands with a gap, and for every row the latest day of its episode as ``wake_date``."""
    numbered = islands(rows, keys, start, end, gap_seconds=gap_seconds, island=episode, piece_seconds=piece_seconds)
    return numbered.withColumn("wake_date", F.max(day).over(Window.partitionBy(*keys, episode)))
