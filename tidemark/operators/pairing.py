"""Pairing of two kinds of records by equal keys, in the order of their positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REASON = "without its pair"


def pair_halves(rows: DataFrame, keys: list[str], kind: str, place: str, first: str, second: str, columns: dict[str, tuple[str, Column]]) -> DataFrame:
    """One row for each pair, and for each half without a partner: keys, ``pair_number``, ``columns``, place, ``reason`` (null for
    pairs).

    The n-th record of one kind belongs to the n-th of the other, by ``place``; a pair has the later of the two places.
    ``columns`` names what is taken: name -> (kind whose record it is of, column).
    """
    numbered = rows.where(F.col(kind).isin(first, second)).withColumn("pair_number", F.row_number().over(Window.partitionBy(*keys, kind).orderBy(place)))
    took = [F.max(F.when(F.col(kind) == k, c)).alias(n) for n, (k, c) in columns.items()]
    pairs = numbered.groupBy(*keys, "pair_number").agg(*took, F.max(place).alias(place), F.count(F.lit(1)).alias("_n"))
    return pairs.withColumn("reason", F.when(F.col("_n") < 2, REASON)).drop("_n")
