"""Whitening against numpy's eigenvectors of exact centred rows; product codes against SQL and against plain rounds."""

import sys
from pathlib import Path

import numpy as np
import pytest

from tidemark.llm import code_compression as cc
from tidemark.llm import whitening as wh
from tidemark.llm.common import Scratch

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SCHEMA = "vec_id long, embedding array<float>, label int"


def rows_of(n, d, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) * np.linspace(scale, scale / 50, d)
    return [(int(i), [float(v) for v in base[i]], int(i) % 3) for i in rng.permutation(n)]


ODD = [(900, None, 1), (901, [1.0, None, 2.0, 3.0] * 2, 1), (902, [float("nan")] * 8, 1), (903, [float("inf")] + [0.0] * 7, None)]


def plain_whitening(rows, k):
    ids = [r[0] for r in rows]
    x = np.array([[int(np.floor(np.float64(np.float32(v)) * 64)) + 1_000_000 for v in r[1]] for r in rows], object)
    n = len(x)
    s = x.sum(axis=0)
    dev = (n * x - s).astype(object)
    centred = dev.astype(float) / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    white = centred @ vectors[:, order] / np.sqrt(values[order])
    return ids, n, [int((d**2).sum()) for d in dev], white, values[order] / np.trace(cov)


def test_whitening_equals_eigenvectors(spark):
    rows = rows_of(300, 8, 1)
    df = spark.createDataFrame(rows + ODD, SCHEMA).repartition(7)
    got = {}
    for r in wh.digest(df, components=6).collect():
        got[r["vec_id"], r["component"]] = r
    ids, n, dev, white, explained = plain_whitening(rows, 6)
    assert len(got) == 300 * 6
    signs = [np.sign(got[ids[0], c + 1]["whitened"] * white[0, c]) for c in range(6)]
    for i, v in enumerate(ids):
        for c in range(6):
            r = got[v, c + 1]
            assert (r["n"], r["deviation"]) == (n, dev[i])
            assert abs(r["whitened"] - signs[c] * white[i, c]) < 1e-8
            assert abs(r["explained"] - explained[c]) < 1e-10
            assert r["identity_error"] < 1e-9


def test_tree_of_factors(spark, monkeypatch):
    monkeypatch.setattr(wh, "FAN", 2)
    rows = rows_of(120, 8, 2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(9)
    held, width = wh.integers(df, "embedding")
    n, sums = wh.totals(held, width)
    r = wh.tall_qr(held, width, n, sums, Scratch(spark))
    x = np.floor(np.array([r[1] for r in rows], np.float32).astype(float) * 64) + 1_000_000
    c = x - x.mean(axis=0)
    assert np.allclose(r.T @ r, c.T @ c, rtol=1e-10, atol=1e-6)


def test_whitening_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert wh.digest(empty).collect() == []
    assert wh.digest(spark.createDataFrame(ODD, SCHEMA)).collect() == []
    one = wh.digest(spark.createDataFrame([(1, [0.5] * 4, 1)], SCHEMA)).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 and r["n"] == 1 for r in one)
    flat = [(i, [float(i % 5), 2.0, float(i % 5)], 0) for i in range(40)] + [(None, [1.0, 2.0, 1.0], 0)]  # rank one, a null id
    got = wh.digest(spark.createDataFrame(flat, SCHEMA)).collect()
    assert len(got) == 41 * 3
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in got) and got[0]["identity_error"] < 1e-9
    with pytest.raises(ValueError):
        wh.digest(spark.createDataFrame([(1, [0.5] * 4, 1), (2, [0.5] * 3, 1)], SCHEMA))
    with pytest.raises(Exception, match="in size"):
        wh.digest(spark.createDataFrame([(1, [1e20, 0.0], 1)], SCHEMA)).collect()
    out, _ = wh.whiten(spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, [3.0, 1.0], "b")], "vec_id long, embedding array<double>, whitened string"))
    assert out.columns == ["vec_id", "whitened_in", "whitened", "deviation"]


def test_sums_beyond_long_stay_exact():
    x = np.array([[1 << 39, -(1 << 39)]], np.int64)
    d = wh.deviations(x, 1 << 25, np.array([5, 7]))
    assert d.tolist() == [[(1 << 64) - 5, -(1 << 64) - 7]]


# ---------------------------------------------------------------- codes


def plain_codes(rows, rounds=4):
    rows = [r for r in rows if r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1])]
    x = np.array([[int(np.floor(np.float64(np.float32(v)) * 1024)) for v in r[1]] for r in rows], np.int64)
    width = x.shape[1] // 4
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, x[i].tolist()))[:256]
    books = [x[order, p * width : (p + 1) * width].copy() for p in range(4)]

    def assigned():
        gaps = [((x[:, None, p * width : (p + 1) * width] - books[p][None]) ** 2).sum(axis=2) for p in range(4)]
        return [g.argmin(axis=1) for g in gaps], sum(g.min(axis=1) for g in gaps)

    for _ in range(rounds):
        codes, _ = assigned()
        for p in range(4):
            for e in range(len(books[p])):
                mine = x[codes[p] == e, p * width : (p + 1) * width]
                if len(mine):
                    books[p][e] = [int(s) // len(mine) for s in mine.sum(axis=0)]
    codes, error = assigned()
    per = {}
    for r, e in zip(rows, error, strict=True):
        per[r[2]] = per.get(r[2], 0) + int(e)
    return sorted(((r[0], "".join(f"{codes[p][i]:02x}" for p in range(4)), int(error[i]), per[r[2]]) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("n,scale", [(700, 1.0), (300, 40_000.0), (40, 0.3)])
def test_codes_equal_plain_rounds(spark, n, scale):
    rows = rows_of(n, 16, n, scale)
    rows += rows[:20] + [(None, rows[0][1], None), (None, rows[1][1], None)]  # repeated rows, null ids and labels
    odd = [(i, v and v * 2, label) for i, v, label in ODD]
    got = cc.digest(spark.createDataFrame(rows + odd, SCHEMA).repartition(5)).collect()
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=str) == plain_codes(rows)


def test_only_changed_parts_travel(spark):
    rows = rows_of(400, 8, 5)
    held, _, = cc.train(*_integers(spark, rows), Scratch(spark), rounds=3)
    still = held.where("prev = code").count()
    assert 0 < still
    assert cc.contributions(held.where("prev IS NULL OR prev <> code").where("false"), 256, 8).collect() == []
    moved = held.where("prev <> code")
    sums = {}
    for r in cc.contributions(moved, 256, 8).collect():
        sums[r["slot"]] = sums.get(r["slot"], 0) + r["v"]
    assert sum(v for s, v in sums.items() if s % 3 == 2) == 0  # what one entry gains another loses


def _integers(spark, rows):
    x = [(r[0], [int(np.floor(np.float32(v) * 1024)) for v in r[1]]) for r in rows]
    df = spark.createDataFrame([(i, i, v) for i, v in x], "_id long, _k0 long, _x array<bigint>")
    return df, ["_k0"], 8


def test_code_edges(spark):
    assert cc.digest(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        cc.digest(spark.createDataFrame([(1, [1.0] * 6, 1)], SCHEMA))
    with pytest.raises(Exception, match="in size"):
        cc.digest(spark.createDataFrame([(1, [1e30] * 4, 1)], SCHEMA)).collect()
    one = cc.digest(spark.createDataFrame([(7, [1.0, -1.0, 0.25, 3.0], None)], SCHEMA)).collect()
    assert [(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in one] == [(7, "00000000", 0, 0)]
    out, _ = cc.compress(spark.createDataFrame([(1, [1.0] * 4, "a")], "vec_id long, embedding array<double>, code string"))
    assert out.columns == ["vec_id", "code_in", "code", "error"]


def test_codes_equal_sql(spark):
    from oracle import compare

    from tidemark.llm.queries import QUERIES

    assert compare(spark, "op13", QUERIES["op13_code_compression"], cc.oracle(), "/root/testdata/sf0.001") is None
