"""Pearson correlation with a Fisher-z interval, safe for small and constant samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pearson_columns(x: str, y: str) -> tuple[Column, Column]:
    """(n, r) aggregates over the rows where both are present; r is null under three pairs or without variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    n = F.count(a)
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return n, F.when((n >= 3) & r.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)))


def fisher_interval(r: Column, n: Column) -> tuple[Column, Column]:
    """95 % bounds; null under four pairs."""
    z = F.atanh(F.least(F.lit(0.999999), F.greatest(F.lit(-0.999999), r)))
    half = F.lit(1.96) / F.sqrt(n - 3)
    ok = (n >= 4) & r.isNotNull()
    return F.when(ok, F.tanh(z - half)), F.when(ok, F.tanh(z + half))


def relationships(rows: DataFrame, specs: list[tuple[str, str, str]]) -> DataFrame:
    """One row per (name, x, y): n, r, ci_low, ci_high, all from one aggregation over the rows."""
    sums = []
    for k, (_, x, y) in enumerate(specs):
        n, r = pearson_columns(x, y)
        sums += [n.alias(f"n{k}"), r.alias(f"r{k}")]
    wide = rows.agg(*sums)
    each = [F.struct(F.lit(name).alias("relationship"), F.col(f"n{k}").alias("n"), F.col(f"r{k}").alias("r")) for k, (name, _, _) in enumerate(specs)]
    long = wide.select(F.explode(F.array(*each)).alias("s")).select("s.*")
    low, high = fisher_interval(F.col("r"), F.when(F.col("n") >= 4, F.col("n")))
    return long.withColumns({"ci_low": low, "ci_high": high})
