"""Source selection: keep the rows of the best source of every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_PRIORITY = 10_000


def with_priority(rows: DataFrame, priorities: DataFrame, *, source: str = "source", data_type: str | Column | None = None) -> DataFrame:
    """Left join to the priority table (data_type, source, priority); a source without an entry comes last.

    The table has one row per configured source and data type; Spark broadcasts it by its measured size.
    """
    wanted = priorities.select(F.col("data_type").alias("_dt"), F.col("source").alias("_src"), F.col("priority").alias("_pr"))
    kind = data_type if isinstance(data_type, Column) else F.lit(data_type)
    joined = rows.join(wanted, (F.col("_dt") == kind) & (F.col("_src") == F.col(source)), "left")
    return joined.withColumn("priority", F.coalesce("_pr", F.lit(DEFAULT_PRIORITY)).cast("int")).drop("_dt", "_src", "_pr")


def quality_rank(quality: str | Column) -> Column:
    return F.when((F.col(quality) if isinstance(quality, str) else quality) == "valid", 0).otherwise(1)


def select_by_priority(rows: DataFrame, keys: list[str], order: list[str | Column], *, rank: str = "dense") -> DataFrame:
    """Rows of rank 1 in each group of ``keys``: all rows that tie (dense) or exactly one (row); nulls come first.

    dense: the least value of ``order`` in each group is an aggregation that combines before the shuffle, and the rows that
    have it come from an equi-join with those winners, one for each group; no group is sorted or gathered, so a group of
    a third of all rows costs no more than its rows.  row: a window, whose rank filter becomes a group limit below the sort.
    """
    if rank == "row":
        window = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")
    value = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])
    ranked = rows.withColumn("_order", value)
    best = ranked.groupBy(*[F.col(k).alias(f"_w{i}") for i, k in enumerate(keys)]).agg(F.min("_order").alias("_best"))
    on = F.col("_order").eqNullSafe(F.col("_best"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_w{i}"))
    return ranked.join(best, on, "left_semi").drop("_order")
