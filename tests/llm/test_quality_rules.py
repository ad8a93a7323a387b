import random
import re

from pyspark.sql import functions as F

from tidemark.llm.quality_rules import _repeat_words, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    rep = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            rep.update((i, i + 1, i + 2))
    failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep), failed


def test_matches_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "  lead\x0btail\x0c ", "x\n\nx\n \nx", "é £ 漢 #$|\x1f\x85 <a&b>", "a a a a a", "w " * 3000]
    texts += [rng.choice([" ", "\n"]).join(rng.choices("ab cd été #x y\n z a b".split(" "), k=rng.randint(0, 150))) for _ in range(150)]
    rows = [(k, t, None if k % 7 == 0 else f"h{k % 3}") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, source string").selectExpr("*", "1 as n_words", "2 as host", "3 as kept")
    got = quality_rules(df).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id]), texts[r.doc_id]
        assert not (r.kept and r.base_failed)


def test_bad_host_is_refused_and_small_host_is_shrunk(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "short", "bad") for i in range(99)] + [(99, good, "bad")] + [(100 + i, good, f"ok{i % 10}") for i in range(1000)] + [(2000, good, "tiny"), (2001, "short", "tiny")]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[99].kept and not got[99].base_failed and got[100].kept and got[2000].kept
    assert got[2001].short_rate < 0.5 < got[99].short_rate and (got[99].host_short, got[2001].host_short) == (99, 1)


def test_windows_that_share_the_upper_bits_of_a_hash_hide_no_repeat(spark):
    a = 5 << 24
    df = spark.createDataFrame([([a, a + 1, a],), ([a, a + 1, a + 2],), ([-1, a, -1, -2],)], "h array<bigint>")
    assert [r.n for r in df.select(_repeat_words(F.col("h"), F.col("h")).alias("n")).collect()] == [5, 0, 5]


def test_sql_agrees_on_refused_hosts(spark, tmp_path):
    import duckdb

    from tidemark.llm.queries import op2_quality_rules
    from tidemark.llm.quality_rules import ORACLE

    good, noisy, again = " ".join(f"w{i}" for i in range(60)), " ".join(["#", "w"] * 40), "a b c " * 30
    rows = [(h * 1000 + i, [good, "short", noisy, again][(0 if i % 10 else 1) if h < 12 else (h - 11) if i % 4 else 0], f"h{h}") for h in range(15) for i in range(40)] + [(99_999, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op2_quality_rules(spark, str(tmp_path))
    want = duckdb.connect()
    want.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = want.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == expected
    assert {r.host for r in got.where("host_refused").select("host").distinct().collect()} == {"h12", "h13", "h14"}
    assert got.where("not base_failed and not kept").count() > 0


def test_hosts_that_fail_alike_are_kept(spark):
    rows = [(i, "short" if i % 20 == 0 else " ".join(f"w{j}" for j in range(60)), f"h{(i * 7919) % 13}") for i in range(2600)]
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert got.where("host_refused").count() == 0


def test_empty(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
