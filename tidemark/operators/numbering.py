"""Exact global row numbers without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

#: Rows that one bucket should hold, buckets at most, and keys sampled for each of them.
BUCKET_ROWS, BUCKETS, SAMPLED = 500_000, 256, 100
_NESTED = (ArrayType, MapType, StructType, VariantType)


class _Ranges:
    """Ranges of a frame's total order: bounds that are fixed once, as literals, and the number of rows before each range.

    The order is that of the given columns, then of a hash of all others, then of those others that can be ordered, so rows
    that tie in all of it are equal rows.  Bounds are quantiles of a sample that is taken and collected one time (``SAMPLED``
    keys a range, ``BUCKETS`` ranges at most); everything after is a function of values, so a task that runs again, or another
    plan of the same frame, puts every row where it was.
    """

    def __init__(self, df: DataFrame, order: list[str], bucket_rows: int):
        if any(isinstance(df.schema[c].dataType, _NESTED) for c in order):
            raise ValueError("rows are numbered by plain columns")
        rest = [c for c in df.columns if c not in order]
        self.plain = df.select(*[F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(f"`{c}`").alias(f"_r{i}") for i, c in enumerate(rest)])
        self.back = [F.col(f"_o{order.index(c)}" if c in order else f"_r{rest.index(c)}").alias(c) for c in df.columns]
        hashed = [f"_r{i}" for i, c in enumerate(rest) if not isinstance(df.schema[c].dataType, (MapType, VariantType))]
        self.types = [df.schema[c].dataType for c in order]
        self.plain = self.plain.withColumn("_h", F.xxhash64(*hashed) if hashed else F.lit(0).cast("bigint"))
        self.sort = [*[f"_o{i}" for i in range(len(order))], "_h", *hashed]
        rows = self.plain.count()
        self.buckets = min(BUCKETS, -(-rows // bucket_rows))
        bounds = self._bounds(rows) if self.buckets > 1 else []
        #: A bound that stands twice is a row of so many copies that they fill a range.
        self.copies = len(set(map(str, bounds))) < len(bounds)
        self.bucket = self._search(bounds) if bounds else F.lit(0)
        counts = {r["_b"]: r["count"] for r in self.plain.groupBy(self.bucket.alias("_b")).count().collect()}  # a row a range
        sums = [0]
        for b in range(len(bounds)):
            sums.append(sums[-1] + counts.get(b, 0))
        self.before = F.element_at(F.array(*[F.lit(s).cast("bigint") for s in sums]), F.col("_b") + 1)

    def _key(self) -> Column:
        return F.struct(*[F.col(f"_o{i}").alias(f"k{i}") for i in range(len(self.types))], F.col("_h").alias("h"))

    def _literal(self, row) -> Column:
        return F.struct(*[F.lit(row[i]).cast(t).alias(f"k{i}") for i, t in enumerate(self.types)], F.lit(row[-1]).cast("bigint").alias("h"))

    def _search(self, bounds: list) -> Column:
        """How many bounds a row has reached: halving steps, so that a row is compared with some eight of them and not with all."""
        given = F.array(*map(self._literal, bounds))
        steps = F.array(*[F.lit(1 << n) for n in reversed(range(len(bounds).bit_length()))])
        reached = lambda n, s: F.coalesce(F.get(given, n + s - 1) <= self._key(), F.lit(False))  # noqa: E731 (beyond the last bound is null)
        return F.aggregate(steps, F.lit(0), lambda n, s: n + F.when(reached(n, s), s).otherwise(0))

    def _bounds(self, rows: int) -> list:
        share = min(1.0, 1.5 * SAMPLED * self.buckets / rows)
        keys = self.plain.sample(share, 11).select(*self.sort[: len(self.types) + 1]).orderBy(*self.sort[: len(self.types) + 1]).limit(4 * SAMPLED * self.buckets).collect()
        return [keys[len(keys) * k // self.buckets] for k in range(1, self.buckets)] if keys else []


def number_rows(df: DataFrame, order: list[str], name: str = "row_number", *, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds the number (from 1) of each row in the order of some columns; no task holds more than about a range of rows.

    Rows that tie are numbered by all other columns; equal rows share nothing but are numbered in any order.  Nulls come
    first.  An empty frame stays empty.
    """
    r = _Ranges(df, order, bucket_rows)
    placed = r.plain.withColumn("_b", r.bucket)
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(*r.sort))
    return placed.withColumn("_i", inside).select(*r.back, (r.before + F.col("_i")).alias(name))


def every_nth(df: DataFrame, order: list[str], stride: int, first: int = 1, *, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows number first, first + stride, ... in the order of some columns, ties by the other columns.

    Where equal rows are so many that they would fill ranges by themselves, they travel as one row with its count, and come out
    as often as the stride hits them.
    """
    r = _Ranges(df, order, bucket_rows)
    hits = lambda n: F.greatest(F.floor((n - first) / stride) + 1, F.lit(0))  # noqa: E731 (numbers up to n that the stride hits)
    if not r.copies:
        number = r.before + F.row_number().over(Window.partitionBy("_b").orderBy(*r.sort))
        return r.plain.withColumn("_b", r.bucket).withColumn("_n", number).where((F.col("_n") >= first) & ((F.col("_n") - first) % stride == 0)).select(*r.back)
    counted = r.plain.groupBy(*r.plain.columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", r.bucket)
    upto = r.before + F.sum("_n").over(Window.partitionBy("_b").orderBy(*r.sort).rowsBetween(Window.unboundedPreceding, 0))
    picked = counted.withColumn("_u", upto).withColumn("_times", (hits(F.col("_u")) - hits(F.col("_u") - F.col("_n"))).cast("int")).where("_times > 0")
    return picked.withColumn("_t", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*r.back)
