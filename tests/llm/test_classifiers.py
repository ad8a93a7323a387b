import random
import zlib

import numpy as np

from tidemark.llm import language_id as L
from tidemark.llm import quality_classifier as Q

WORDS = {"xx": "the of and tion ing with that".split(), "yy": "der und ich ung keit schön die".split()}


def corpus(n=160, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["xx", "yy"])
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randint(8, 120))), lang))
    return rows


def test_gru_gradients_match_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in L._init(rng, 3, 2).items()}
    seq = rng.integers(0, 256, (5, 4)).astype(np.uint8)
    mask = np.ones((5, 4))
    mask[3:, 1] = 0
    label = np.array([0, 1, 1, 0])
    _, g = L.gradients(p, seq, label, mask)
    for name in p:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in p[name].shape)
            if name[0] == "x":
                at = (int(seq[rng.integers(0, 5), 0]), at[1])
            loss = []
            for step in (1e-3, -1e-3):
                q = {k: v.copy() for k, v in p.items()}
                q[name][at] += step
                loss.append(L.gradients(q, seq, label, mask)[0])
            assert abs((loss[0] - loss[1]) / 2e-3 - g[name][at]) < 2e-4, name


def test_every_byte_lies_in_one_window():
    sizes = [0, 1, 47, 48, 49, 200, 0]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.arange(1, offsets[-1] + 1).astype(np.uint8)
    begin, length, row = L.window_bounds(offsets)
    seq = L.window_bytes(data, begin, length)
    got = [np.concatenate([seq[: length[k], k] for k in np.flatnonzero(row == d)] or [np.zeros(0)]).tolist() for d in range(len(sizes))]
    assert got == [L.LOWER[data[a:b]].tolist() for a, b in zip(offsets[:-1], offsets[1:])]


def test_pooled_equals_the_plain_forward_pass():
    rng = np.random.default_rng(2)
    p = L._init(rng, 5, 3) | {"classes": list("abc")}
    sizes = [0, 1, 47, 48, 49, 300]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = rng.integers(0, 256, offsets[-1]).astype(np.uint8)
    begin, length, row = L.window_bounds(offsets)
    prob = L.forward(p, L.window_bytes(data, begin, length))
    want = np.array([sum((prob[: length[k], k].sum(0) for k in np.flatnonzero(row == d)), np.zeros(3)) / max(n, 1) for d, n in enumerate(sizes)])
    assert np.allclose(L.pooled(p, data, offsets, chunk=2), want, atol=1e-5)


def test_language_accuracy_and_edges(spark):
    rows = corpus() + [(900, None, "xx"), (901, "", "yy"), (902, " 12 .!", "xx"), (903, "und die ich keit schön " * 4000, None), (None, "the of and that", "xx"), (904, "漢", "xx")]
    rows += [rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'q' as lang_pred", "1 as score")
    got = L.identify(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[d].lang_pred == "und" and by[d].score == 0 for d in (900, 901, 902))
    assert by[903].lang_pred == "yy" and by[904].lang_pred in ("xx", "yy") and not by[None].held_out
    held = [r for r in rows[:160] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(by[d].held_out for d, _, _ in held)
    assert np.mean([by[d].lang_pred == lang for d, _, lang in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    kept = L.accept(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()}.isdisjoint({900, 901, 902})
    assert L.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in L.identify(df.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def test_attention_gradients_match_differences():
    rng = np.random.default_rng(1)
    x = rng.random((7, Q._FEATURES)).astype(np.float32)
    row, y = np.array([0, 0, 1, 2, 2, 2, 2]), np.array([0.0, 1.0, 1.0])
    shapes = {"w": (Q._FEATURES, 4), "wb": (4,), "v": (4, 3), "vb": (3,), "u": (4, 3), "ub": (3,), "a": (3,), "o": (4,), "ob": ()}
    p = {k: rng.normal(0, 0.5, s) for k, s in shapes.items()}
    _, g = Q.gradients(p, x, row, y)
    for name in p:
        at = tuple(rng.integers(0, s) for s in p[name].shape)
        loss = []
        for step in (1e-4, -1e-4):
            q = {k: np.array(v) for k, v in p.items()}
            q[name][at] += step
            loss.append(Q.gradients(q, x, row, y)[0])
        assert abs((loss[0] - loss[1]) / 2e-4 - g[name][at]) < 1e-3, name


def test_quality_accuracy_and_edges(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        text = " ".join(rng.choices(WORDS["xx"], k=rng.randint(60, 300)))
        rows.append((i, text if good else text.upper().replace(" ", "!! ")))
        labels.append((i, int(good)))
    rows += [(900, None), (901, ""), (902, "x" * 200_000), (5, rows[5][1])]
    labels += [(900, None), (5, 1), (950, 1), (7, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 as quality", "'z' as score")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = Q.classify(docs, lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.95
    assert Q.classify(docs.limit(0), lab).count() == 0
    assert {r.score for r in Q.classify(docs, lab.limit(0)).collect()} == {0.5}


def test_scores_equal_a_pass_bag_by_bag():
    rng = np.random.default_rng(5)
    shapes = {"w": (Q._FEATURES, Q.CODE), "wb": (Q.CODE,), "v": (Q.CODE, Q.ATTENTION), "vb": (Q.ATTENTION,), "u": (Q.CODE, Q.ATTENTION), "ub": (Q.ATTENTION,), "a": (Q.ATTENTION,), "o": (Q.CODE,), "ob": ()}
    p = {k: rng.normal(0, 0.4, s).astype(np.float32) for k, s in shapes.items()}

    def slow(raw):
        cut = [raw[i : i + Q.PASSAGE] for i in range(0, len(raw), Q.PASSAGE)] or [b""]
        codes, weights = [], []
        for part in cut:
            x = np.zeros(Q._FEATURES)
            for b in part:
                x[b] += 1
            for b, c in zip(part, part[1:]):
                x[256 + (b * 31 + c * 197) % Q.PAIRS] += 1
            x = np.sqrt(x / max(len(part), 1))
            x[-4:] = len(part) / Q.PASSAGE, np.log1p(len(cut)) / 4, not part, np.log1p(len(part)) / 6
            h = np.tanh(x @ p["w"] + p["wb"])
            codes.append(h)
            weights.append((np.tanh(h @ p["v"] + p["vb"]) / (1 + np.exp(-(h @ p["u"] + p["ub"])))) @ p["a"])
        e = np.exp(np.array(weights) - max(weights))
        return 1 / (1 + np.exp(-((e / e.sum()) @ np.array(codes) @ p["o"] + p["ob"])))

    texts = [b"", b"a", bytes(rng.integers(0, 256, 383, dtype=np.uint8)), bytes(rng.integers(0, 256, 384, dtype=np.uint8)), bytes(rng.integers(0, 256, 385, dtype=np.uint8)), bytes(rng.integers(97, 110, 9000, dtype=np.uint8))]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    want = [slow(t) for t in texts]
    assert np.allclose(Q.bag_scores(p, np.frombuffer(b"".join(texts), np.uint8), offsets), want, atol=1e-5)
    for t, w in zip(texts, want, strict=True):  # a text alone, a few passages at a time
        assert np.allclose(Q.bag_scores(p, np.frombuffer(t, np.uint8), np.array([0, len(t)]), limit=3), [w], atol=1e-5)


def test_letters_of_every_script_and_the_fold(spark):
    rows = [(i, w, "xx" if i % 2 else "yy") for i, w in enumerate(["the of and", "der und ich", "漢字", "Ω", "ب", "ß", "12 ½ ٣", "— … !", "👩‍👩‍👧", "\u0301", "ªº"] * 6)]
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    import regex

    for i, text, _ in rows:
        assert (got[i].lang_pred == "und") == (regex.search(r"\p{L}", text) is None), text
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_one_row_of_a_repeated_id_is_learned_from(spark):
    rows = [(1, f"the {i}", "xx") for i in range(300)] + [(i, "the of and", "xx") for i in range(2, 400)] + [(1000 + i, "der und", f"l{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = L.training_rows(df, id_col="doc_id", text_col="text", lang_col="lang", per_language=20, max_languages=3)
    counts = {x: sum(lang == x for lang, _ in got) for x in {lang for lang, _ in got}}
    assert counts["xx"] == 20 and len(counts) <= 3 and sum(t.startswith("the ") and t != "the of and" for _, t in got) <= 1
    labels = spark.createDataFrame([(1, 1)] * 200 + [(i, i % 2) for i in range(2, 400)], "doc_id long, quality int")
    drawn = Q.sample(df, labels, id_col="doc_id", text_col="text", label_col="quality", max_documents=50)
    assert len(drawn) == 50 == len({k for k, _, _ in drawn})


def test_a_very_long_text_in_bounded_memory():
    import resource
    import subprocess
    import sys

    code = """
import resource, numpy as np
from tidemark.llm import language_id as L, quality_classifier as Q
p = L._init(np.random.default_rng(1), 4, 2) | {"classes": ["a", "b"]}
rng = np.random.default_rng(0)
shapes = {"w": (Q._FEATURES, 4), "wb": (4,), "v": (4, 3), "vb": (3,), "u": (4, 3), "ub": (3,), "a": (3,), "o": (4,), "ob": ()}
q = {k: rng.normal(0, .5, s).astype(np.float32) for k, s in shapes.items()}
data = rng.integers(97, 123, 50_000_000, dtype=np.uint8)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
L.pooled(p, data, np.array([0, len(data)]))
Q.bag_scores(q, data, np.array([0, len(data)]))
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    assert resource and int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 250_000


def test_held_out_rows_of_the_test_data(spark):
    from tidemark.llm import queries

    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    seen = queries.op4_language_id(spark, sf).where("held_out").join(docs, "doc_id").where("lang is not null and lang_pred <> 'und'").selectExpr("avg(cast(lang = lang_pred as double)) a", "count(*) n").first()
    assert seen.n > 2000 and seen.a > 0.97
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null").select("doc_id", "quality")
    scored = queries.op5_quality_classifier(spark, sf).where("held_out").join(labels, "doc_id").toPandas()
    rank, good = scored.score.rank(), scored.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert len(scored) > 500 and auc > 0.97 and (scored.predicted == scored.quality).mean() > 0.9
