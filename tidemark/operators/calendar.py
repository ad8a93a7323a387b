"""Facts by day, gap-free calendars, weekly and rolling roll-ups, day-lagged pairs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLLING_DAYS = (7, 30, 90, 365)


@dataclass(frozen=True)
class Rolled:
    """What a week or a window of days has of a column: its ``sum``, ``avg`` or ``count`` of values."""

    kind: str
    column: Column | str

    @property
    def value(self) -> Column:
        return F.col(self.column) if isinstance(self.column, str) else self.column

    @property
    def aggregate(self) -> Column:
        return {"sum": F.sum, "avg": F.avg, "count": F.count}[self.kind](self.value)


def date_spine(facts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The distinct keys of all facts."""
    return reduce(DataFrame.unionByName, [f.select(*keys) for f in facts]).distinct()


def join_facts(spine: DataFrame, facts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Left joins of every fact on the same keys, so one exchange of each side serves the whole chain."""
    return reduce(lambda a, b: a.join(b, keys, "left"), facts, spine)


def gather_facts(facts: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row for each key that any fact has, with the columns of all of them: a union, grouped once.

    Every fact has a key once at most, and columns of its own; each is planned one time, and their rows meet in one exchange.
    """
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facts)
    return together.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in together.columns if c not in keys])


def fill_calendar(daily: DataFrame, day: str, keys: list[str] | None = None) -> DataFrame:
    """One row for every day between the first and the last of each group; days without facts are null.

    Every row is followed by the days up to the next one of its group, so the input is planned once.  Rows without a day go; an
    empty input gives no rows.  Few bytes of facts become many days, and windows over them much work, so the groups are dealt
    over all partitions of the session: adaptive execution would gather them into one task by their bytes.
    """
    keys = keys or []
    facts = daily.where(F.col(day).isNotNull())
    if keys:
        facts = facts.repartition(int(daily.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    following = F.lead(day).over(Window.partitionBy(*keys).orderBy(day))
    gap = F.sequence(F.col(day), F.greatest(F.col(day), F.coalesce(F.date_sub(following, 1), F.col(day))), F.expr("interval 1 day"))
    spread = facts.withColumn("_gap", gap).select("*", F.posexplode("_gap").alias("_i", "_day"))
    return spread.select(*[F.col("_day").alias(c) if c == day else F.col(c) if c in keys else F.when(F.col("_i") == 0, F.col(c)).alias(c) for c in daily.columns])


def week_of(day: str | Column) -> Column:
    """Monday of the week."""
    return F.to_date(F.date_trunc("week", F.col(day) if isinstance(day, str) else day))


def weekly(calendar: DataFrame, day: str, aggregates: list[Column], keys: list[str] | None = None) -> DataFrame:
    out = calendar.groupBy(*(keys or []), week_of(day).alias("week_start")).agg(F.count(F.lit(1)).alias("calendar_days"), *aggregates)
    return out.withColumn("week_end", F.date_add("week_start", 6))


def rolling(calendar: DataFrame, day: str, rolled: dict[str, Rolled], windows: tuple[int, ...] = ROLLING_DAYS, keys: list[str] | None = None) -> DataFrame:
    """For every anchor day and window length: the aggregates over the days from anchor - (n - 1) to anchor.

    The calendar has every day of a group once (``fill_calendar``), and each aggregate costs the same for every row, however
    long the windows are.  Days are cut into blocks of n; a window of n days is the end of one block and the beginning of the
    next, and both are running sums within their block, so nothing is summed again and nothing is subtracted from a sum (sums of
    doubles keep their digits).  Counts are differences of running counts, which are exact.  All of it is partitioned by the keys
    alone, so one exchange serves every length.
    """
    keys = keys or []
    ordered, at = Window.partitionBy(*keys).orderBy(day), F.unix_date(day)
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    summed = {n: f"_s{i}" for i, n in enumerate(r for r, x in rolled.items() if x.kind != "count")}
    counted = {n: f"_c{i}" for i, n in enumerate(rolled)}
    base = calendar.select(*keys, F.col(day), *[rolled[n].value.alias(c) for n, c in summed.items()], *[F.when(rolled[n].value.isNotNull(), 1).otherwise(0).cast("bigint").alias(c) for n, c in counted.items()])
    base = base.withColumns({"_n": F.row_number().over(ordered), **{f"{c}_run": F.sum(c).over(upto) for c in (*counted.values(), *summed.values())}})
    wide = base
    for n in windows:
        block = [*keys, F.floor(at / n)]
        fore, back = (Window.partitionBy(*block).orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc(day), F.desc(day)))
        wide = wide.withColumns({f"{c}_fore_{n}": F.sum(c).over(fore) for c in summed.values()}).withColumns({f"{c}_back_{n}": F.sum(c).over(back) for c in summed.values()})
    ends = {f"{c}_end_{n}": F.lag(f"{c}_back_{n}", n - 1).over(ordered) for n in windows for c in summed.values()}
    past = {f"{c}_past_{n}": F.lag(f"{c}_run", n).over(ordered) for n in windows for c in counted.values()}
    wide = wide.withColumns(ends | past)

    def total(c: str, n: int) -> Column:
        head, tail = F.col(f"{c}_end_{n}"), F.col(f"{c}_fore_{n}")
        return F.when(F.col("_n") < n, F.col(f"{c}_run")).when(F.pmod(at, F.lit(n)) == n - 1, tail).otherwise(F.coalesce(head + tail, head, tail))

    def value(name: str, n: int) -> Column:
        count = F.col(f"{counted[name]}_run") - F.coalesce(f"{counted[name]}_past_{n}", F.lit(0))
        if rolled[name].kind == "count":
            return count
        of_all = F.when(count > 0, total(summed[name], n))
        return of_all if rolled[name].kind == "sum" else of_all / count

    structs = [F.struct(F.lit(n).alias("window_days"), F.date_sub(day, n - 1).alias("window_start"), F.least("_n", F.lit(n)).cast("bigint").alias("calendar_days"), *[value(name, n).alias(name) for name in rolled]) for n in windows]
    return wide.select(*keys, F.col(day).alias("anchor_date"), F.explode(F.array(*structs)).alias("_w")).select(*keys, "anchor_date", "_w.*")


def rolling_latest(calendar: DataFrame, day: str, rolled: dict[str, Rolled], windows: tuple[int, ...] = ROLLING_DAYS, keys: list[str] | None = None) -> DataFrame:
    """``rolling`` for the newest day of each group alone: only the days of the longest window are aggregated, once each."""
    keys = keys or []
    held = calendar.withColumn("anchor_date", F.max(day).over(Window.partitionBy(*keys)))
    recent = held.where(F.col(day) > F.date_sub("anchor_date", max(windows)))
    each = recent.withColumn("window_days", F.explode(F.array(*map(F.lit, windows)))).where(F.col(day) > F.date_sub("anchor_date", F.col("window_days")))
    out = each.groupBy(*keys, "anchor_date", "window_days").agg(F.count(F.lit(1)).alias("calendar_days"), *[r.aggregate.alias(n) for n, r in rolled.items()])
    return out.withColumn("window_start", F.date_sub("anchor_date", F.col("window_days") - 1))


def lag_days(daily: DataFrame, day: str, outcomes: list[str], *, days: int = 1, keys: list[str] | None = None, prefix: str = "next_") -> DataFrame:
    """Each day's row with the outcomes of ``days`` later (null where that day is missing), from a frame of that one day."""
    later = Window.partitionBy(*(keys or [])).orderBy(F.unix_date(day)).rangeBetween(days, days)
    return daily.withColumns({prefix + o: F.first(o).over(later) for o in outcomes})
