import hashlib
import random

import public_tokenizers as P
import regex
import tiktoken

from tidemark.llm.byte_bpe import SPACED, ByteBPE, Pieces, digest, read_ranks

PATH = P.path("byte_bpe_50k.tiktoken")
PIECES = read_ranks(open(PATH, "rb"))
REAL = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={p: k for k, p in enumerate(PIECES)}, special_tokens={})


def samples():
    rng = random.Random(3)
    odd = ["", "\x1c\x1d\x1e\x1f \x85\xa0 ᠎​ 　﻿", "'s'T'll <|endoftext|> don't", " " * 5000, "a" * 3000, "été Ünder 漢字かな 👩‍👩‍👧", "1234567890 ½ Ⅷ ٣", "\n\n \t\r\n x", "\x00\x01\x7f"]
    alphabet = [chr(c) for c in [*range(0x20, 0x7F), 0x09, 0x0A, 0x1C, 0x1F, 0x85, 0xA0, 0xE9, 0x301, 0x2003, 0x4E00, 0x1F600, 0x10FFFF, 0xAD, 0x661, 0x2167]]
    odd += ["".join(rng.choices(alphabet, k=rng.randint(1, 400))) for _ in range(300)]
    odd += ["".join(chr(c) + "a " for c in range(a, a + 4096) if not 0xD800 <= c < 0xE000) for a in range(0, 0x11000, 4096)]
    return odd


def test_equals_the_library():
    bpe = ByteBPE(PIECES, P.PATTERN)
    texts = samples()
    ids, offsets = bpe.encode_batch(texts)
    for k, text in enumerate(texts):
        own = ids[offsets[k] : offsets[k + 1]].tolist()
        assert own == REAL.encode_ordinary(text), (k, text[:60])
    data, ends = Pieces(PIECES).decode(ids, offsets)
    assert [data[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])] == [t.encode() for t in texts]


def test_runs_between_spaces_equal_pre_tokens():
    assert SPACED == P.PATTERN
    rng, alphabet = random.Random(8), [" ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "a", "'s", "9", "!", "é", "漢", "\u0301", "_"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(20_000)]
    by_runs, plain = ByteBPE(PIECES, P.PATTERN), ByteBPE(PIECES, "(?:" + P.PATTERN + ")")
    assert by_runs.spaced and not plain.spaced
    (a, x), (b, y) = by_runs.encode_batch(texts), plain.encode_batch(texts)
    assert a.tolist() == b.tolist() and x.tolist() == y.tolist()


def test_pattern_leaves_nothing_out():
    assert all("".join(regex.findall(P.PATTERN, t)) == t for t in samples())


def test_digest(spark):
    texts = samples() + [None, "same", "same"]
    rows = digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "0 as ids", "1 as decoded"), PATH, P.PATTERN).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = REAL.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert digest(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).count() == 0


def test_kept_columns_long_tokens_and_null_ids(spark):
    from tidemark.llm.byte_bpe import decode, encode

    texts = ["a" * 20_000, None, " " * 9000 + "x", "same", "same", "same"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'old' as ids", "'kept' as note")
    coded = encode(df, PATH, P.PATTERN)
    assert coded.columns == ["doc_id", "text", "note", "ids"]
    rows = {r.doc_id: r for r in decode(coded, PATH).collect()}
    assert all(rows[i].ids == REAL.encode_ordinary(t or "") and bytes(rows[i].decoded).decode() == (t or "") and rows[i].note == "kept" for i, t in enumerate(texts))
    nulls = spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "k int, ids array<int>")
    assert [None if r.decoded is None else bytes(r.decoded) for r in decode(nulls, PATH).orderBy("k").collect()] == [None, b"", PIECES[0] + PIECES[1]]


def test_what_a_worker_keeps_is_bounded_by_bytes(monkeypatch):
    import tracemalloc

    from tidemark.llm import byte_bpe

    monkeypatch.setattr(byte_bpe, "CACHE", 1 << 20)
    bpe, rng = ByteBPE(PIECES, P.PATTERN), random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    bpe.encode_batch(["warm up"])
    tracemalloc.start()
    held = []
    for k in range(12):
        texts = [" ".join("".join(rng.choices(letters, k=n)) for n in [20_000, *rng.choices(range(3, 90), k=2000)]) for _ in range(4)]
        ids, offsets = bpe.encode_batch(texts)
        if k % 6 == 0:
            assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [REAL.encode_ordinary(t) for t in texts]
        assert max(map(len, bpe.ids)) <= byte_bpe.KEPT and bpe.held <= byte_bpe.CACHE
        del ids, offsets, texts
        held.append(tracemalloc.get_traced_memory()[0])
    tracemalloc.stop()
    assert max(held) < 3 << 20  # two generations


def test_two_vocabularies_of_one_file_name(spark, tmp_path):
    from tidemark.llm.byte_bpe import encode

    import base64

    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    singles = [bytes([b]) for b in range(256)]
    for folder, pieces in (("a", singles), ("b", [*singles, b"ab"])):
        (tmp_path / folder / "v.tiktoken").write_bytes(b"\n".join(base64.b64encode(p) + b" %d" % k for k, p in enumerate(pieces)))
    df = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    got = [encode(df, str(tmp_path / f / "v.tiktoken"), P.PATTERN).first().ids for f in "ab"]
    assert got == [[97, 98], [256]]
