import random

from tests.llm.test_byte_bpe import REAL
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_jaccard import brute as components
from tests.llm.test_jaccard import corpus
from tests.llm.test_substring_dedup import WORD, Counter


def repeats_removed(rows, window=35):
    words = {d: WORD.findall(t or "") for d, t in rows}
    count = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = []
    for d, t in rows:
        w, gone = words[d], set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        if gone and len(gone) == len(w):
            continue
        out.append((d, " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t))
    return out


def test_stages_match_brute_force(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "ngram_jaccard", "substring_dedup", "decontaminate", "byte_bpe"]
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        rows = out.collect()
        steps[name] = (docs.collect(), rows)
        assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(rows, out.schema).repartition(3)

    pairs = lambda rows: [(r.doc_id, r.text) for r in rows]
    before, after = steps["language_id"]
    assert len(after) >= 0.97 * len([r for r in before if r.text])
    before, after = steps["ngram_jaccard"]
    assert sorted(r.doc_id for r in after) == sorted(d for d, (_, c) in components(pairs(before), 5, 80, 100).items() if d == c)
    before, after = steps["substring_dedup"]
    assert sorted(pairs(after)) == sorted(repeats_removed(pairs(before)))
    before, after = steps["decontaminate"]
    bad = contaminated(pairs(before), items)
    assert sorted(pairs(after)) == sorted((d, t) for d, t in pairs(before) if not bad[d][4])
    before, after = steps["byte_bpe"]
    assert all(r.ids == REAL.encode_ordinary(r.text) and r.n_tokens == len(r.ids) and r.round_trip for r in after) and len(after) == len(before)


def test_run_equals_the_stages_in_turn(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        docs = spark.createDataFrame(out.collect(), out.schema).repartition(5)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, docs.collect())) and rows
    assert all(r.round_trip for r in rows)


def test_edges_of_every_stage(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    rng = random.Random(6)
    words = [w for r in spark.read.parquet(f"{sf}/documents.parquet").limit(20).collect() if r.text for w in r.text.split()]
    long = " ".join(rng.choices(words, k=30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (4, long), (None, "plain words of a page"), (5, "x" * 200_000), (6, "plain words of a page")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "cast(null as string) lang", "'s' source", "cast(length(text) as bigint) n_chars", "7 as ids", "'a' as n_tokens", "false as round_trip", "3 as n_words", "'i' as items", "9 as n", "8 as k", "'v' as lang_pred", "0.5D as score", "1 as g", "2 as rep")
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        got = out.collect()
        assert [out.schema[c].dataType for c in ("doc_id", "text")] == [docs.schema[c].dataType for c in ("doc_id", "text")]
        if name != "byte_bpe":
            assert out.columns == docs.columns and all((r.ids, r.n_tokens, r.n_words, r.items, r.score) == (7, "a", 3, "i", 0.5) for r in got)
        else:
            assert {"ids_in", "n_tokens_in", "round_trip_in"} <= set(out.columns) and len(got) == len(rows) and all(r.round_trip and r.ids_in == 7 for r in got)
            assert [r.n_tokens for r in got if r.doc_id in (1, 2)] == [0, 0]
        if name == "language_id":
            assert got == []  # no language is known, so none is learned
        if name == "ngram_jaccard":
            assert sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "4", "4", "5", "6", "None"]
        if name == "substring_dedup":
            assert sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "5", "6", "None"]
        if name == "decontaminate":
            assert len(got) == len(rows)
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_near_duplicates_link_at_five_words_and_four_fifths(spark):
    import corpus_pipeline

    rng = random.Random(5)
    long, short = ([f"v{rng.randrange(9000)}" for _ in range(n)] for n in (300, 200))
    longer, edited = long + [f"a{i}" for i in range(40)], [f"e{i}" if i in (30, 80, 130, 180) else w for i, w in enumerate(short)]
    rows = corpus() + [(9001 + i, " ".join(w)) for i, w in enumerate((long, longer, short, edited))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == sorted(d for d, (_, c) in components(rows, 5, 80, 100).items() if d == c)
    assert {9001, 9003} <= set(got) and not {9002, 9004} & set(got)
