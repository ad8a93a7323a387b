import hashlib
import random
import re
from collections import Counter

import pytest

from tidemark.llm.substring_dedup import COVERS, dedup_substrings, digest, drop_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=35):
    words = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["É", "W1", "漢"]
    passages = [rng.choices(vocab, k=n) for n in (34, 35, 36, 50, 55, 56, 80, 200)]
    rows = [(1, None), (2, ""), (3, "\t"), (4, "a " * 34), (5, "a " * 35), (6, "b " * 36), (7, "x")]
    for d in range(10, 70):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choices(vocab, k=rng.randint(0, 60))
            if rng.random() < 0.5:
                p = rng.choice(passages)
                a = rng.randint(0, 10)
                w += p[a:] if rng.random() < 0.5 else p
        rows.append((d, rng.choice([" ", "\n\n", "\x0b "]).join(w)))
    return rows + [(80, rows[-1][1]), (80, rows[-1][1]), (None, "w1 " * 20)]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k", "2 as n_words", "3 as places").repartition(4)
    got = [tuple(r) for r in digest(dedup_substrings(df)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_covers_and_other_windows(spark):
    for v, d in COVERS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))
    rows = corpus(3)
    for window in (1, 2, 5, 12):
        got = [tuple(r) for r in digest(dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), window=window)).collect()]
        assert sorted(got, key=str) == brute(rows, window)


def test_drop_repeats_and_empty(spark):
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(1, "clean\n text", 11), (2, p, len(p)), (3, "before  this " + p, 1), (4, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = sorted(map(tuple, drop_repeats(df).collect()))
    assert got == [(1, "clean\n text", 11), (3, "before this", 11), (4, None, None)]
    assert dedup_substrings(df.limit(0)).count() == 0


def test_a_very_long_text(spark):
    words = [f"w{i % 99_991}" for i in range(1_000_000)]
    rows = [(1, " ".join(words[:99_000])), (2, " ".join(f"v{i}" for i in range(500_000))), (3, " ".join(words[50_000:50_040])), (4, "x " * 1_000_000)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (99_000, 40), 2: (500_000, 0), 3: (40, 40), 4: (1_000_000, 1_000_000)}
