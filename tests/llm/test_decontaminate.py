import hashlib
import random
import re

import pytest

from tidemark.llm.decontaminate import WuManber, decontaminate, digest, find_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=13):
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, itext in items:
            iw = words(itext)
            if item is None or not iw:
                continue
            for k in range(max(1, len(iw) - width + 1)):
                win = iw[k : k + width]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        found.add(str(item))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def cases():
    rng = random.Random(5)
    vocab = ["a", "be", "été", "x9", "the", "of", "Ünder", "long", "s"]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 12, 13, 14, 30])))) for k in range(2, 14)] + [(99, ""), (98, None), (None, "the of"), (97, "lone-word")]
    docs = []
    for d in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(" ".join(rng.choices(vocab, k=rng.randint(0, 20))))
            if rng.random() < 0.6:
                parts.append(rng.choice(items)[1] or "")
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(parts).upper() if d % 3 else "-".join(parts)))
    return docs + [(1000, None), (1001, ""), (1002, "..."), (1003, "lone word"), (1004, "lone word " * 30000), (1005, "alone word")], items


def test_wu_manber_finds_all_occurrences():
    import numpy as np

    data = np.frombuffer(b"abcabcabcabxabcabc" * 40, np.uint8)
    patterns = [b"abc", b"abcabcabcabx", b"c", b"zzz"]
    want = sorted((i, k) for k, p in enumerate(patterns) for i in range(len(data)) if data.tobytes().startswith(p, i))
    assert sorted(WuManber(patterns).find(data)) == want


@pytest.mark.parametrize("pattern_bytes", [1 << 24, 2000])
def test_matches_brute_force(spark, pattern_bytes):
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_words", "'x' as items")
    b = spark.createDataFrame(items, "item_id int, text string")
    rows = digest(find_contamination(d, b, pattern_bytes=pattern_bytes)).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows}
    assert got == brute(docs, items)


def test_empty_tables(spark):
    docs, items = cases()
    none = spark.createDataFrame([], "doc_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    nothing = spark.createDataFrame([], "item_id int, text string")
    assert find_contamination(none, spark.createDataFrame(items, "item_id int, text string")).count() == 0
    assert decontaminate(d, nothing).count() == len(docs)


def test_repeated_rows_items_of_two_texts_and_clashing_names(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = [(1, item), (1, item), (1, "other words"), (2, "q " * 3 + item), (3, None)]
    items = [(5, item), (5, item), (5, "other"), (6, "q q")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "5 as n_words", "'z' as items", "true as contaminated", "0 as hit_spans")
    b = spark.createDataFrame(items, "item_id int, text string")
    got = sorted((r.doc_id, r.n_hit, list(r["items"])) for r in digest(find_contamination(d.select("doc_id", "text"), b)).collect())
    assert got == [(1, 1, ["5"]), (1, 20, ["5"]), (1, 20, ["5"]), (2, 23, ["5", "6"]), (3, 0, [])]
    kept = decontaminate(d, b)
    assert kept.columns == d.columns and [tuple(r) for r in kept.collect()] == [(3, None, 5, "z", True, 0)]


def test_a_benchmark_in_pieces_of_one_window(spark):
    docs, items = cases()
    d, b = spark.createDataFrame(docs[:12], "doc_id long, text string"), spark.createDataFrame(items[:3], "item_id int, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in digest(find_contamination(d, b, pattern_bytes=1)).collect()}
    assert got == brute(docs[:12], items[:3])
