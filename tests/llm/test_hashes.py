import random

import numpy as np
import pytest

from tidemark.llm import common, suffix_dedup
from tidemark.llm.jaccard import near_duplicate_components
from tidemark.llm.substring_dedup import dedup_substrings

from .test_suffix_dedup import brute, corpus


def balanced(n, a="a", b="b"):
    """A Thue-Morse word and its complement: a polynomial modulo a power of two gives both the same hash."""
    flips = [bin(i).count("1") & 1 for i in range(n)]
    return "".join(b if x else a for x in flips), "".join(a if x else b for x in flips)


def test_range_hashes_name_contents():
    rng, names = random.Random(6), [{}, {}]
    raw = bytes(rng.choices(b"\x00\x01ab", k=4000))
    data = np.frombuffer(raw, np.uint8)
    starts = np.array([rng.randrange(4000) for _ in range(20_000)])
    ends = np.minimum(starts + np.array([rng.choice([0, 1, 2, 3, 7, 8, 9, 16, 30, 300]) for _ in range(20_000)]), 4000)
    for which in (0, 1):
        for a, b, h in zip(starts.tolist(), ends.tolist(), common.range_hashes(data, starts, ends, which).tolist(), strict=True):
            assert names[which].setdefault(raw[a:b], h) == h
        assert len(set(names[which].values())) == len(names[which])


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_cancel_in_a_polynomial(spark, n):
    x, y = balanced(n)
    fill = [f"w{i}" for i in range(200)]
    docs = [(1, " ".join([x] + fill[:60:2])), (2, " ".join([y] + fill[1:60:2])), (3, " ".join([x] * 40)), (4, " ".join([y] * 40))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicate_components(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    words = spark.createDataFrame([(2, " ".join(fill[:34] + [x])), (3, " ".join(fill[:34] + [y]))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in dedup_substrings(words).collect()} == {2: 0, 3: 0}
    found = {r.doc_id: r.n_removed for r in suffix_dedup.dedup_bytes(spark.createDataFrame([(1, "1" + x), (2, "2" + y)], "doc_id long, text string")).collect()}
    want = {d: removed for d, _, removed, _, _ in brute([(1, "1" + x), (2, "2" + y)])}
    assert found == want


def test_a_line_in_every_document(spark, monkeypatch):
    """Hot minimizers are counted and never meet in one task; the results stay those of brute force."""
    monkeypatch.setattr(suffix_dedup, "HOT", 5)
    met = []
    plain = suffix_dedup.first_occurrences
    monkeypatch.setattr(suffix_dedup, "first_occurrences", lambda df, length: met.append(df.groupBy("h").count().agg({"count": "max"}).first()[0]) or plain(df, length))
    rng = random.Random(2)
    line = "".join(rng.choices("abcdefgh ", k=150))
    rows = corpus(5) + [(1000 + d, "".join(rng.choices("abcdefgh ", k=rng.randint(0, 90))) + line + "".join(rng.choices("abcdefgh ", k=90))) for d in range(200)]
    got = suffix_dedup.digest(suffix_dedup.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))
    assert met and met[0] <= 5
