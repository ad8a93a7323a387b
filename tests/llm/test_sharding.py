from collections import Counter

import pytest

from tidemark.llm.sharding import assign, fill_table


def test_table_is_full_even_and_stable():
    names = [f"s{i}" for i in range(10)]
    a, b = fill_table(names, 4099), fill_table(names[:-1], 4099)
    counts = Counter(a)
    assert set(counts) == set(range(10)) and max(counts.values()) - min(counts.values()) <= 1
    moved = sum(x != y for x, y in zip(a, b, strict=True) if x != 9)
    assert moved < 0.1 * 4099
    with pytest.raises(ValueError):
        fill_table(names, 4096)


def test_assign(spark):
    rows = [(None, "a"), (1, "b"), (1, "c"), (2, None)] + [(i, "x") for i in range(3, 2000)]
    df = spark.createDataFrame(rows, "doc_id long, shard string").selectExpr("*", "7 as slot_2")
    got = assign(df, "doc_id", [f"s{i}" for i in range(5)], slots=1009).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert by.setdefault(r.doc_id, r.shard) == r.shard
    counts = Counter(by.values())
    assert len(counts) == 5 and max(counts.values()) < 1.3 * min(counts.values())
    assert assign(df.limit(0), "doc_id", ["a"], slots=2).count() == 0


def test_columns_of_any_name_keep_their_values(spark):
    df = spark.createDataFrame([(7, 1, 2, "a", 3, "b", 4)], "doc_id long, _slot int, slot int, shard string, _place int, _shard string, shard_in int")
    got = assign(df, "doc_id", ["x", "y"], slots=11).first().asDict()
    assert {k: got[k] for k in ("doc_id", "_slot", "slot_in", "_place", "_shard", "shard_in")} == {"doc_id": 7, "_slot": 1, "slot_in": 2, "_place": 3, "_shard": "b", "shard_in": 4}
    assert got["shard_in_in"] == "a" and got["shard"] in ("x", "y") and len(got) == 9
    long = assign(spark.createDataFrame([("k" * 1_000_000,), ("k" * 1_000_000,)], "key string"), "key", ["x", "y", "z"], slots=101).collect()
    assert long[0].shard == long[1].shard
