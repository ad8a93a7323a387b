import random
import re

import pytest

from tidemark.llm import jaccard
from tidemark.llm.components import connected_components
from tidemark.llm.common import Scratch
from tidemark.llm.jaccard import keep_one, near_duplicate_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width, num, den):
    sets = {d: shingles(t, width) for d, t in rows}
    comp = {d: d for d in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def corpus(seed=2):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["É", "the", "The"]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (6, "one two"), (7, "ONE two"), (8, "one two three")]
    k = 10
    for _ in range(12):
        base = rng.choices(vocab, k=rng.choice([5, 12, 19, 20, 21, 40, 90, 300]))
        now = list(base)
        for _ in range(rng.choice([1, 3, 9])):  # chains: each copy differs a little from the one before
            rows.append((k, rng.choice([" ", "  ", "\n"]).join(now)))
            k += 1
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                now[rng.randrange(len(now))] = rng.choice(vocab)
    base = rng.choices(vocab, k=70)
    for _ in range(60):  # a star of near copies, some of which link and some not
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            copy[rng.randrange(len(copy))] = rng.choice(vocab)
        rows.append((k, " ".join(copy)))
        k += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "num", "block"), [(3, 90, 512), (5, 80, 512), (3, 90, 5), (5, 80, 3)])
def test_matches_brute_force(spark, width, num, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus(num)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as k1", "3 as rep", "4 as id").repartition(5)
    got = near_duplicate_components(df, width=width, threshold=(num, 100)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, width, num, 100)
    assert len(got) == len(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (9, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id) for r in near_duplicate_components(df).collect())
    assert got == [("3", 3), ("5", 3), ("5", 3), ("9", 9), ("None", None)]
    assert sorted(str(r.doc_id) for r in keep_one(df).collect()) == ["3", "9", "None"]
    assert near_duplicate_components(df.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark), "c").collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 50)}


def test_long_texts_and_an_id_with_two_texts(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(5000)]
    long = rng.choices(vocab, k=60_000)
    near, far = list(long), list(long)
    for i in range(0, 60_000, 100):
        near[i] = "x"
    for i in range(0, 60_000, 9):
        far[i] = "y"
    short = " ".join(vocab[:40])
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(far)), (4, short), (5, short), (5, " ".join(far[:59_990]))]
    got = {(r.doc_id, r.component_id) for r in near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3)}


def test_signatures_that_many_sets_share(spark, monkeypatch):
    """The rest of a hot signature is dealt wherever there is room; no link is lost."""
    monkeypatch.setattr(jaccard, "HOT", 2)
    rows = corpus(90)
    got = near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 90, 100)
