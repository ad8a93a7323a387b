"""Boundaries and laws of the operators."""

import random
from datetime import UTC, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import calendar, correlate, intervals, merge, pairs, select, sessions

T0 = datetime(2026, 1, 1, tzinfo=UTC)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_gap_of_exactly_the_limit_stays_in_the_session(spark):
    rows = [(1, at(0)), (2, at(600)), (3, at(1201)), (4, at(1201))]
    df = spark.createDataFrame(rows, "id int, t timestamp").withColumn("k", F.lit(1))
    got = {r.id: (r.session_number, r.reading_number) for r in sessions.sessionize(df, ["k"], "t", 600, tie="id").collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (2, 1), 4: (2, 2)}


def test_touching_and_nested_intervals_merge(spark):
    rows = [(at(0), at(100)), (at(10), at(20)), (at(100), at(150)), (at(151), at(160))]
    df = spark.createDataFrame(rows, "a timestamp, b timestamp").withColumn("k", F.lit(1))
    assert sorted((r.intervals, r.seconds) for r in intervals.merge_islands(df, ["k"], "a", "b").collect()) == [(1, 9), (3, 150)]
    assert intervals.merge_islands(df, ["k"], "a", "b", gap_seconds=1).count() == 1


def test_pairs_equal_the_nested_loop(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), at(rng.randint(0, 20_000)), None) for i in range(300)]
    rows = [(i, k, a, a + timedelta(seconds=rng.choice([0, 1, 500, 200_000]))) for i, k, a, _ in rows]
    df = spark.createDataFrame(rows, "i int, k string, a timestamp, b timestamp")
    near = {(r.a_i, r.b_i) for r in pairs.near_pairs(df, df, "a", 300, equal=["k"], condition="a_i < b_i").collect()}
    assert near == {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] == y[1] and abs((x[2] - y[2]).total_seconds()) <= 300}
    over = [(r.a_i, r.b_i) for r in pairs.overlap_pairs(df, df, "a", "b", bucket_seconds=1000, condition="a_i < b_i").collect()]
    assert len(over) == len(set(over))
    assert set(over) == {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[2] < y[3] and y[2] < x[3]}


def test_replay_is_all_duplicates_and_null_safe(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, None), (3, "d"), (4, None)], "k int, v string")
    first = merge.merge_changes(old, new, ["k"], ["v"], "k").withColumn("disposition", merge.disposition())
    assert {r.k: (r.disposition, r._changed) for r in first.collect()} == {1: ("duplicate", False), 2: ("duplicate", False), 3: ("updated", True), 4: ("inserted", True)}
    again = merge.merge_changes(first.select("k", "v"), new, ["k"], ["v"], "k").withColumn("disposition", merge.disposition())
    assert {(r.disposition, r._changed) for r in again.collect()} == {("duplicate", False)}


def test_rolling_of_one_day_is_the_calendar(spark):
    df = spark.createDataFrame([(T0.date() + timedelta(days=d), float(d)) for d in (0, 1, 5)], "d date, v double")
    full = calendar.fill_calendar(df, "d")
    one = calendar.rolling(full, "d", {"s": calendar.Rolled("sum", "v")}, windows=(1,))
    assert {(r.anchor_date, r.s) for r in one.collect()} == {(r.d, r.v) for r in full.collect()} and full.count() == 6
    assert calendar.fill_calendar(df.limit(0), "d").count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rolling_equals_plain_sums(spark, seed):
    rng = random.Random(seed)
    days = {k: sorted(rng.sample(range(400), 60 if k else 5)) for k in range(4)}
    rows = [(k, T0.date() + timedelta(days=d), rng.choice([None, rng.uniform(-1e6, 1e6)]), rng.choice([None, rng.randrange(9)])) for k, ds in days.items() for d in ds]
    full = calendar.fill_calendar(spark.createDataFrame(rows, "k int, d date, v double, n int"), "d", ["k"])
    held = full.collect()
    assert len(held) == sum(ds[-1] - ds[0] + 1 for ds in days.values())
    of = calendar.Rolled
    aggregates = {"s": of("sum", "v"), "a": of("avg", F.col("v") * 2), "c": of("count", "v"), "i": of("sum", "n")}
    windows = (1, 2, 7, 30, 365)
    got = {(r.k, r.anchor_date, r.window_days): r for r in calendar.rolling(full, "d", aggregates, windows, ["k"]).collect()}
    assert len(got) == len(held) * len(windows)
    for (k, d, n), r in got.items():
        inside = [x for x in held if x.k == k and d - timedelta(days=n - 1) <= x.d <= d]
        vs, ns = [x.v for x in inside if x.v is not None], [x.n for x in inside if x.n is not None]
        assert (r.calendar_days, r.c, r.i) == (len(inside), len(vs), sum(ns) if ns else None) and r.window_start == d - timedelta(days=n - 1)
        assert (r.s is None) == (not vs) and (not vs or abs(r.s - sum(vs)) < 1e-6 and abs(r.a - 2 * sum(vs) / len(vs)) < 1e-6)
    newest = {k: max(x.d for x in held if x.k == k) for k in days}
    for r in calendar.rolling_latest(full, "d", aggregates, windows, ["k"]).collect():
        full_row = got[r.k, newest[r.k], r.window_days]
        assert (r.anchor_date, r.c, r.i, r.calendar_days) == (newest[r.k], full_row.c, full_row.i, full_row.calendar_days)


def test_lag_reads_the_very_day(spark):
    df = spark.createDataFrame([(1, T0.date() + timedelta(days=d), d) for d in (0, 1, 2, 5, 7)], "k int, d date, v int")
    got = lambda days: [r.next_v for r in calendar.lag_days(df, "d", ["v"], days=days, keys=["k"]).orderBy("d").collect()]
    assert got(1) == [1, 2, None, None, None] and got(2) == [2, None, None, 7, None] and got(5) == [5, None, 7, None, None]


def test_correlation_guards(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 1.0, float(i) if i < 2 else None) for i in range(6)], "x double, y double, flat double, few double")
    got = {r.relationship: r for r in correlate.relationships(df, [("xy", "x", "y"), ("flat", "x", "flat"), ("few", "x", "few")]).collect()}
    assert abs(got["xy"].r - 1) < 1e-12 and got["xy"].ci_high <= 1
    assert got["flat"].r is None and got["flat"].ci_low is None
    assert got["few"].n == 2 and got["few"].r is None


def test_scaling_equals_decimal_arithmetic(spark):
    rng = random.Random(1)
    rows = [(rng.randint(-(10**9), 10**9), rng.randint(-9, 6)) for _ in range(500)]
    df = spark.createDataFrame(rows, "v bigint, e int").select("v", "e", scalar.scaled(F.col("v"), F.col("e")).alias("x"))
    assert all(r.x == float(Decimal(r.v).scaleb(r.e)) for r in df.collect())


@pytest.mark.parametrize("cell", [50.0, 1000.0, 86_400.0])
def test_intervals_of_any_length_meet_once(spark, cell):
    rng = random.Random(int(cell))
    day = lambda s: T0 + timedelta(seconds=s)
    rows = []
    for i in range(160):
        a = rng.choice([0, 999, 1000, 1001]) if i % 5 == 0 else rng.randrange(-400_000, 400_000)
        rows.append((i, i % 2, day(a), day(a + rng.choice([0, 1, 50, 1000, 5000, 90_000, 3_000_000, -700]))))
    rows += [(900, 0, day(-10 * 365 * 86_400), day(5_000)), (901, 1, day(10), datetime(9024, 1, 1, tzinfo=UTC)), (902, 0, None, day(1)), (903, 1, day(5), None)]
    df = spark.createDataFrame(rows, "i int, k int, a timestamp, b timestamp")
    for equal in (None, ["k"]):
        pairs_of = pairs.overlap_pairs(df, df, "a", "b", bucket_seconds=cell, equal=equal, condition="a_i < b_i")
        got = [(r.a_i, r.b_i) for r in pairs_of.collect()]
        whole = [r for r in rows if r[2] and r[3]]
        want = {(x[0], y[0]) for x in whole for y in whole if x[0] < y[0] and x[2] < y[3] and y[2] < x[3] and (not equal or x[1] == y[1])}
        assert len(got) == len(set(got)) and set(got) == want
    plan = pairs_of._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_long_interval_is_listed_in_few_cells(spark):
    df = spark.sql("SELECT CAST(-3 AS BIGINT) AS a, CAST(1000000 AS BIGINT) AS b")
    cells = df.select(pairs._cells(F.col("a"), F.col("b"), 20).alias("c")).first().c
    assert len(cells) < 80 and sum(1 << c.level for c in cells if c.whole) == 1_000_004


@pytest.mark.parametrize("gap", [0.0, 300.0])
def test_islands_in_pieces_equal_islands_in_one(spark, gap):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), i, T0 + timedelta(seconds=s), T0 + timedelta(seconds=s + rng.choice([0, 60, 600, 40_000]))) for i, s in enumerate(rng.choices(range(0, 900_000, 60), k=500))]
    df = spark.createDataFrame(rows, "k string, i int, s timestamp, e timestamp")
    one = intervals.islands(df, ["k"], "s", "e", gap_seconds=gap, tie=["i"]).orderBy("i").collect()
    for piece in (3_600.0, 100_000.0, 1e9):
        many = intervals.islands(df, ["k"], "s", "e", gap_seconds=gap, tie=["i"], piece_seconds=piece)
        assert many.columns == [*df.columns, "island"] and many.orderBy("i").collect() == one
    assert sorted(map(str, intervals.merge_islands(df, ["k"], "s", "e", gap_seconds=gap, piece_seconds=5_000.0).collect())) == sorted(map(str, intervals.merge_islands(df, ["k"], "s", "e", gap_seconds=gap).collect()))


def test_one_subject_uses_all_tasks(spark):
    df = spark.range(4000).selectExpr("'one' AS k", "id AS i", "timestamp_seconds(1700000000 + id * 3600) AS s", "timestamp_seconds(1700000000 + id * 3600 + id % 3 * 1800) AS e")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = intervals.islands(df, ["k"], "s", "e", tie=["i"], piece_seconds=86_400.0).withColumn("p", F.spark_partition_id())
        spread = [r["count"] for r in out.groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(spread) < 2200


def test_dense_selection_keeps_ties_and_null_keys(spark):
    df = spark.createDataFrame([("a", 1, "s", 1), ("a", 1, "s", 2), ("a", 2, "r", 3), (None, None, "x", 4), (None, 0, "a", 5), (None, None, "x", 6)], "k string, p int, s string, v int")
    assert sorted(r.v for r in select.select_by_priority(df, ["k"], ["p", "s"]).collect()) == [1, 2, 4, 6]
    plan = select.select_by_priority(df, ["k"], ["p", "s"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


@pytest.mark.parametrize("cell", [None, 50.0, 86_400.0])
def test_couples_meet_once_and_in_order(spark, cell):
    rng = random.Random(5)
    rows = []
    for i in range(200):
        a = rng.choice([0, 299, 300, 301, 600]) if i % 4 == 0 else rng.randrange(-9_000, 9_000)
        rows.append((i, i % 2, at(a), at(a + rng.choice([0, 1, 50, 1000, 9_000, -700]))))
    rows += [(900, 0, at(-10 * 365 * 86_400), at(5_000)), (901, 0, None, at(1)), (902, 1, at(5), None)]
    df = spark.createDataFrame(rows, "i int, k int, a timestamp, b timestamp")
    begun = [r for r in rows if r[2]]
    before = lambda x, y: x[1] == y[1] and (x[2], x[0]) < (y[2], y[0])
    near = [(r.a_i, r.b_i) for r in pairs.near_couples(df, "a", 300, "i", equal=["k"]).collect()]
    assert sorted(near) == sorted((x[0], y[0]) for x in begun for y in begun if before(x, y) and (y[2] - x[2]).total_seconds() <= 300)
    over = [(r.a_i, r.b_i) for r in pairs.overlap_couples(df, "a", "b", "i", cell_seconds=cell, equal=["k"]).collect()]
    whole = [r for r in begun if r[3]]
    assert sorted(over) == sorted((x[0], y[0]) for x in whole for y in whole if before(x, y) and x[2] < y[3] and y[2] < x[3])


def test_a_slice_of_too_many_rows_is_shared_by_tasks(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, i % 2, at(a := rng.choice([0, 1, 5, 290, 700])), at(a + rng.choice([0, 1, 50, 1000]))) for i in range(150)]
    df = spark.createDataFrame(rows, "i int, k int, a timestamp, b timestamp")
    found = {}
    for most in (16_384, 7):
        monkeypatch.setattr(pairs, "TASK_ROWS", most)
        near, over = pairs.near_couples(df, "a", 300, "i", equal=["k"]), pairs.overlap_couples(df, "a", "b", "i", equal=["k"])
        found[most] = [sorted((r.a_i, r.b_i) for r in x.collect()) for x in (near, over)]
    assert found[7] == found[16_384] and all(len(set(x)) == len(x) > 1000 for x in found[7])


def test_quick_rounding_is_that_of_decimals(spark):
    rng = random.Random(7)
    values = [0.0, -0.0, 0.00005, -0.00005, 0.83335, 0.83345, 2.5e-5, 1e300, -1e12, float("nan"), float("inf"), None]
    values += [k / 1e5 + e for k in range(-50, 50) for e in (0.0, 1e-8, -1e-15, 1e-17)] + [rng.random() for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    bad = df.where(~scalar.rounded(F.col("v"), 4).eqNullSafe(F.round("v", 4)))
    assert bad.count() == 0
