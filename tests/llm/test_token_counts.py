"""Counts against the library, on odd texts and on texts made of the vocabulary's own pieces."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import token_counts as tc

P = pytest.importorskip("public_tokenizers")
MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def counter():
    with open(MODEL, "rb") as f:
        return tc.Counter(f.read())


def texts(library):
    rng = random.Random(11)
    out = ["", None, " ", "  ", " a", "a ", "a  b   c", "▁x ▁ y▁▁z", "\n\n\t", "\x00", "<s>hello</s><0x0A><unk>", "😀😀 naïve ﬁ é", "日本語のテキスト" * 30]
    out += ["aaaa" * 50, "a" * 5000, " " * 4000 + "x" + " " * 777, "ab" * 3000, "ing" * 400, "".join(rng.choice("abcxyzABC0123+/") for _ in range(6000))]
    out += ["".join(rng.choice("ab ▁étheing\n日x😀1.") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    out += ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(100, 400))) for _ in range(60)]
    out += ["".join(chr(rng.randint(32, 0x2FFF)) for _ in range(rng.randint(0, 200))) for _ in range(100)]
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.get_piece_size())]
    return out + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 150))).replace(" ", rng.choice([" ", ""])) for _ in range(400)]


def test_counts_equal_the_library(counter, library):
    rows = texts(library)
    for _ in range(2):  # the second time from what is kept
        size, got = tc._batch(counter, pa.array(rows, pa.string()))
        assert got.tolist() == [len(library.encode(t or "")) for t in rows]
        assert size.tolist() == [len((t or "").encode()) for t in rows]


def test_long_sequences_take_the_same_order(counter, library, monkeypatch):
    rows = [t for t in texts(library) if t and len(t) < 2000]
    monkeypatch.setattr(tc, "LONG", 1)
    fresh = tc.Counter.__new__(tc.Counter)
    fresh.merges = counter.merges
    fresh._clear()
    assert tc._batch(fresh, pa.array(rows))[1].tolist() == [len(library.encode(t)) for t in rows]


def test_names_that_collide_are_told_apart(counter, library, monkeypatch):
    whole = tc.range_hashes
    monkeypatch.setattr(tc, "range_hashes", lambda d, s, e, which=0: whole(d, s, e, which) % np.uint64(7) if which == 0 else whole(d, s, e, which))
    rows = ["the quick brown fox jumps over the lazy dog internationalization", "quick dog internationalization"] * 3
    fresh = tc.Counter.__new__(tc.Counter)
    fresh.merges = counter.merges
    fresh._clear()
    for _ in range(2):
        assert tc._batch(fresh, pa.array(rows))[1].tolist() == [len(library.encode(t)) for t in rows]


def test_what_is_kept_is_bounded(counter, library, monkeypatch):
    monkeypatch.setattr(tc, "CACHE", 50)
    fresh = tc.Counter.__new__(tc.Counter)
    fresh.merges = counter.merges
    fresh._clear()
    for k in range(20):
        rows = [f"word{k} {i} {'x' * i}" for i in range(40)]
        assert tc._batch(fresh, pa.array(rows))[1].tolist() == [len(library.encode(t)) for t in rows]
        assert len(fresh.names) <= 50


def test_digest(spark, library):
    rows = [(1, "one two", "x"), (2, None, "y"), (3, "", "z"), (None, "null id", "q"), (1, "one two", "x"), (5, "w " * 5000, "long"), (6, "v" * 300_000, "one run")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, tc.digest(df, MODEL).collect()), key=str)
    want = sorted([(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t, _ in rows], key=str)
    assert got == want
    assert tc.digest(df.limit(0), MODEL).collect() == []
    kept = tc.count_tokens(df, MODEL)
    assert kept.columns == ["doc_id", "text", "n_bytes", "n_tokens"] and dict(kept.dtypes)["n_tokens"] == "bigint"


def test_other_models_are_refused(tmp_path):
    with pytest.raises(ValueError):
        tc.Merges(b"")
