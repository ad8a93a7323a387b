"""Global numbers against SQL, on tables read from several files, with kept columns, ties, copies and odd values."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import numbering


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """300,000 rows in nine files, whose keys are spread at random, tie, and are null at times."""
    path = str(tmp_path_factory.mktemp("numbers") / "t")
    key = F.when(F.col("id") % 97 == 0, F.lit(None)).otherwise(F.xxhash64("id") % 40_000)
    at = F.timestamp_seconds(F.lit(1_600_000_000) + F.xxhash64("id") % 1000)
    spark.range(300_000).repartition(9).select(key.alias("k"), at.alias("at"), F.concat(F.lit("kept-"), "id").alias("text"), "id").write.parquet(path)
    return spark.read.parquet(path)


def expected(df, order, stride, first):
    return [r.id for r in df.orderBy(*order).select("id").collect()][first - 1 :: stride]


@pytest.mark.parametrize("bucket_rows", [7_000, 500_000])
def test_every_nth_equals_a_full_sort(table, bucket_rows):
    got = numbering.every_nth(table.select("text", "k", "id"), ["k", "id"], 7, 3, bucket_rows=bucket_rows)
    assert got.columns == ["text", "k", "id"]
    rows = got.collect()
    assert sorted(r.id for r in rows) == sorted(expected(table, ["k", "id"], 7, 3)) and all(r.text == f"kept-{r.id}" for r in rows)


def test_numbers_are_dense_and_ordered(table):
    out = numbering.number_rows(table, ["at", "k"], "n", bucket_rows=5_000)
    rows = sorted(out.select("n", "at", "k").collect())
    assert [r.n for r in rows] == list(range(1, 300_001))
    order = [(r.at, r.k is not None, r.k) for r in rows]
    assert all(a[:2] < b[:2] or (a[:2] == b[:2] and (a[2] is None or a[2] <= b[2])) for a, b in zip(order, order[1:]))


def test_numbers_do_not_change_when_a_plan_runs_again(table):
    ids = lambda: sorted(r.id for r in numbering.every_nth(table, ["at"], 11, 2, bucket_rows=5_000).select("id").collect())
    assert ids() == ids()
    out = numbering.every_nth(table, ["at"], 11, 2, bucket_rows=5_000)
    assert sorted(r.id for r in out.repartition(3).select("id").collect()) == sorted(r.id for r in out.coalesce(1).select("id").collect())


def test_no_range_holds_much_more_than_its_share(table):
    r = numbering._Ranges(table, ["k"], 10_000)
    most = r.plain.groupBy(r.bucket.alias("b")).count().agg(F.max("count")).first()[0]
    assert r.buckets == 30 and most < 20_000
    plan = numbering.number_rows(table, ["k"], bucket_rows=10_000)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "NestedLoop" not in plan


def test_copies_that_fill_ranges_travel_as_one_row(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, F.lit(5)).otherwise(F.col("id")).cast("long").alias("k"), F.lit("same").alias("x"))
    r = numbering._Ranges(df, ["k"], 4_000)
    assert r.copies
    every = sorted([5 if i % 3 else i for i in range(60_000)])
    for stride, first in ((7, 3), (50_000, 1), (1, 1), (13, 59_999), (3, 70_000)):
        got = sorted(x.k for x in numbering.every_nth(df, ["k"], stride, first, bucket_rows=4_000).collect())
        assert got == every[first - 1 :: stride]


def test_edges(spark):
    df = spark.createDataFrame([(float("nan"), "a"), (None, "b"), (-0.5, "c"), (float("inf"), "d")], "v double, s string")
    assert [r.s for r in numbering.number_rows(df, ["v"], "n").orderBy("n").collect()] == ["b", "c", "d", "a"]
    assert numbering.every_nth(df.limit(0), ["v"], 3).collect() == []
    odd = df.selectExpr("v AS _o0", "s AS _n", "map('a', 1) AS m")
    assert numbering.number_rows(odd, ["_n"], "i").orderBy("i").first()["_n"] == "a"
    with pytest.raises(ValueError):
        numbering.every_nth(odd, ["m"], 2)


def test_a_row_is_compared_with_few_bounds(table):
    """Steps that halve the bounds: 149 bounds take eight comparisons, and give the range that comparing with all of them gives."""
    r = numbering._Ranges(table.select("k", "at", "id"), ["k", "id"], 2_000)
    assert r.buckets == 150 and "filter(" not in str(r.bucket) and "aggregate(" in str(r.bucket)
    bounds = r._bounds(300_000)
    all_of_them = F.size(F.filter(F.array(*map(r._literal, bounds)), lambda b: b <= r._key()))
    assert r.plain.where(r.bucket != all_of_them).isEmpty()
