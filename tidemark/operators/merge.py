"""Idempotent merges of snapshots: every incoming row is inserted, updated or a duplicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INSERTED, UPDATED, DUPLICATE = "inserted", "updated", "duplicate"


def merge_changes(existing: DataFrame, incoming: DataFrame, keys: list[str], semantic: list[str], position: str) -> DataFrame:
    """One row for every key of a batch: what the table holds for it afterwards, with the dispositions of its incoming rows.

    A batch may hold a key several times; its last row by ``position`` (any column that can be ordered) stays.  Every incoming
    row counts as if rows came one by one: the first of a key against the stored row, the others against the one before; only
    ``semantic`` columns tell an update from a duplicate.  The counts stand beside the row (``_inserted``, ``_updated``,
    ``_duplicate``); ``_changed`` says whether the table has to be written for it.  Of the stored rows only those whose keys
    come in are joined, so a small batch can travel to a large table.
    """
    columns = existing.columns
    own = F.struct(*semantic)
    before = F.lag(own).over(Window.partitionBy(*keys).orderBy(position))
    steps = incoming.select(*keys, F.col(position).alias("_p"), F.struct(*columns).alias("_new"), own.alias("_own"), (before.isNotNull() & ~own.eqNullSafe(before)).alias("_changed"))
    per_key = steps.groupBy(*keys).agg(F.max_by("_new", "_p").alias("_new"), F.min_by("_own", "_p").alias("_first"), F.count(F.lit(1)).alias("_n"), F.sum(F.col("_changed").cast("bigint")).alias("_steps"))
    old = existing.select(*keys, F.struct(*columns).alias("_old"), own.alias("_was")).join(per_key.select(*keys), keys, "left_semi")
    both = per_key.join(old, keys, "left")
    new = F.col("_old").isNull()
    inserted = F.when(new, 1).otherwise(0).cast("bigint")
    updated = F.col("_steps") + F.when(~new & ~F.col("_first").eqNullSafe(F.col("_was")), 1).otherwise(0)
    changed = new | ~F.struct(*[F.col(f"_new.{c}").alias(c) for c in semantic]).eqNullSafe(F.col("_was"))
    counted = both.select(F.when(changed, F.col("_new")).otherwise(F.col("_old")).alias("_row"), inserted.alias("_inserted"), updated.alias("_updated"), "_n", changed.alias("_changed"))
    return counted.select("_row.*", "_inserted", "_updated", (F.col("_n") - F.col("_inserted") - F.col("_updated")).alias("_duplicate"), "_changed")


def disposition() -> Column:
    """The last disposition of a row of ``merge_changes``, for batches that hold every key once."""
    return F.when(F.col("_inserted") > 0, INSERTED).when(F.col("_updated") > 0, UPDATED).otherwise(DUPLICATE)


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Get-or-create: the incoming keys that are not stored yet."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace stored rows of their key, whatever they hold (watermarks may move back)."""
    return existing.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming.select(*existing.columns))


GENERATED, BY_HAND = "rules", "user"


def merge_links(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Refreshed duplicate links, with the columns of ``stored``.

    A rejected link stays rejected, though what it says is taken from the fresh one; links that were generated and are found
    no more go, those made by hand (``generated_by``) stay; of a link that is found again, columns that ``fresh`` lacks (its
    id, when it was made) are those stored.
    """
    old = stored.select(*keys, F.struct(*stored.columns).alias("_old"))
    new = fresh.select(*keys, F.struct(*fresh.columns).alias("_new"))
    both = old.join(new, keys, "full_outer")
    was, found = F.col("_old.resolution"), F.col("_new").isNotNull()
    kept = both.where(found | (was == "rejected") | ~F.coalesce(F.col("_old.generated_by"), F.lit(GENERATED)).eqNullSafe(F.lit(GENERATED)))
    columns = {c: F.when(found, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")) if c in fresh.columns else F.col(f"_old.{c}") for c in stored.columns if c not in keys}
    columns["resolution"] = F.when(was == "rejected", was).otherwise(columns["resolution"])
    if "generated_by" in columns:
        columns["generated_by"] = F.coalesce("_old.generated_by", columns["generated_by"])
    return kept.select(*keys, *[c.alias(n) for n, c in columns.items()])


def resolve_link(links: DataFrame, match, resolution: str) -> DataFrame:
    """Set the resolution of the links that match; it is an error if there are none."""
    if resolution not in ("confirmed", "rejected"):
        raise ValueError("a link is confirmed or rejected")
    if links.where(match).limit(1).count() == 0:
        raise KeyError("no such link")
    return links.withColumn("resolution", F.when(match, F.lit(resolution)).otherwise(F.col("resolution")))
