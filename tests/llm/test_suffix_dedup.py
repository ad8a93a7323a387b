import hashlib
import random

import numpy as np
import pytest

from tidemark.llm.suffix_dedup import common_prefixes, dedup_bytes, digest, suffix_array


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abc", bytes(range(256))])
def test_suffix_array_and_prefixes(alphabet):
    rng = random.Random(4)
    for n in (0, 1, 2, 3, 10, 50, 300):
        text = bytes(rng.choices(alphabet, k=n)) * 2
        data = np.frombuffer(text, np.uint8)
        order = suffix_array(data)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        got = common_prefixes(data, order, 1000)
        for i in range(1, len(order)):
            a, b = text[order[i - 1] :], text[order[i] :]
            want = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            assert got[i] == want


def test_suffix_array_by_depth():
    rng = random.Random(9)
    part = bytes(rng.choices(b"abcd", k=400))
    text = part + bytes(rng.choices(b"abcd", k=300)) + part + b"zzzz" * 80 + part[50:]
    order = suffix_array(np.frombuffer(text, np.uint8), 108).tolist()
    heads = [text[i : i + 108] for i in order]
    assert sorted(order) == list(range(len(text))) and heads == sorted(heads)


def brute(rows, length=100):
    seen, out = {}, []
    docs = sorted((("" if d is None else d), (t or "").encode()) for d, t in rows)
    for d, raw in docs:
        for i in range(len(raw) - length + 1):
            seen.setdefault(raw[i : i + length], (d, i))
    for d, raw in docs:
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] != (d, i):
                gone[i : i + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((d, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, alphabet="abcdef é\n"):
    rng = random.Random(seed)
    passages = ["".join(rng.choices(alphabet, k=n)) for n in (90, 99, 100, 101, 130, 180, 400, 1500)] + ["ab" * 200, "x" * 300]
    rows = [(1, None), (2, ""), (3, "short"), (4, "y" * 99), (5, "y" * 100), (6, "y" * 101), (7, "\x00" * 150)]
    for d in range(10, 80):
        t = ""
        for _ in range(rng.randint(0, 5)):
            t += "".join(rng.choices(alphabet, k=rng.randint(0, 200)))
            if rng.random() < 0.6:
                p = rng.choice(passages)
                t += p[rng.randint(0, 40) :] if rng.random() < 0.4 else p
        rows.append((d, t))
    rows += [(100 + i, rows[20][1]) for i in range(20)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed, monkeypatch):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k", "2 as h", "3 as places").repartition(4)
    got = sorted(tuple(r) for r in digest(dedup_bytes(df)).collect())
    assert got == brute(rows)


def test_long_text_scanned_in_pieces(spark):
    rng = random.Random(8)
    base = "".join(rng.choices("abcdefgh ", k=1_300_000))
    rows = [(1, base + base[600_000:600_150]), (2, base[524_200:524_400])]
    got = {r.doc_id: r for r in digest(dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert (got[1].n_removed, got[1].n_spans, got[2].n_removed) == (150, 1, 200)


def test_empty_and_null_id(spark):
    df = spark.createDataFrame([(None, "q" * 120), (1, "z")], "doc_id long, text string")
    assert sorted(r.n_removed for r in dedup_bytes(df).collect()) == [0, 119]
    assert dedup_bytes(df.limit(0)).count() == 0


def test_repeated_rows_and_an_id_with_two_texts(spark):
    rng = random.Random(3)
    shared, one, two = ("".join(rng.choices("abcdefgh ", k=300)) for _ in range(3))
    rows = [(1, shared), (1, shared), (5, one + shared), (7, two + "1" + two), (7, two + "2")]
    got = dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(r.n_removed for r in got if r.doc_id == 1) == [0, 0]  # rows of one document
    assert [r.n_removed for r in got if r.doc_id == 5] == [300]
    assert sum(r.n_removed for r in got if r.doc_id == 7) in (600, 601)  # two of three copies, whichever text comes first
