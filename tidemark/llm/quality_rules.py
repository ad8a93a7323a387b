"""Quality rules with host-level verdicts, in DataFrame functions only.

Document rules count over the whole text: words, symbols, repeated lines, words in repeated three-word windows.  Host
rules aggregate the documents' failures by host, one count for each of ``RULES``; for each rule a beta prior is fitted to the
hosts' failure rates by moments (less the noise of counting), each host's rate is shrunk towards its mean, and the host is
refused if its posterior exceeds ``lift`` times that mean by two standard deviations.  So a cut is relative to the other hosts:
hosts that fail alike, as in a corpus whose hosts are dealt at random, are all kept, and a small host needs more evidence.  The
verdict is joined back: documents of a refused host are not kept.

A null text counts as empty: no words, so it fails.  Null hosts are one host of their own.  Every row is judged, repeated
ids too, and counts for its host.  Texts may be very long: positions have 64 bits, windows are compared by whole 64-bit hashes,
memory is some tens of bytes a word.  Ties (equal windows, equal lines) all count but for the first line.  An empty table gives
an empty result.  Columns of the input other than id, text and host are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SPACE = " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A host is refused if its failures of a rule exceed so many times the mean of the prior.
LIFT = 2.0
#: Rules that hosts are held to, over the counts of a document.
RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > n_words",
}
#: Bounds of the strength of the prior, in documents.
STRENGTH = (1.0, 1e6)


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def _repeat_words(words: Column, h: Column) -> Column:
    """Words inside three-word windows that occur twice or more; h: the hash of the window at each position."""
    keyed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("bigint").alias("p"))))
    # neighbours in the sorted order whose whole hashes are equal
    same = lambda s: F.zip_with(F.slice(s, 1, F.size(h) - 1), F.slice(s, 2, F.size(h) - 1), lambda x, y: F.when(x["h"] == y["h"], F.array(x["p"], y["p"])))
    pairs = F.flatten(F.filter(same(keyed), lambda x: x.isNotNull()))
    places = F.sort_array(F.array_distinct(pairs))
    state = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("past"))
    return F.aggregate(places, state, lambda s, p: F.struct((s["n"] + p + 3 - F.greatest(p, s["past"])).alias("n"), (p + 3).alias("past")), lambda s: s["n"])


def base_stats(docs: DataFrame, *, text_col: str = "text", keep: list[str]) -> DataFrame:
    """``keep`` columns plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    own = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    held = [f"_k{i}" for i in range(len(keep))]
    text = docs.select(*own, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    cut = text.select(
        *held,
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.filter(F.split("_t", "\n"), lambda x: _strip(x) != "").alias("_lines"),
        F.when(_strip(F.col("_t")) == "", F.array().cast("array<string>")).otherwise(F.split(_strip(F.col("_t")), r"[ \t\n\x0B\f\r]+")).alias("_w"),
    )
    hashed = cut.select(
        *held,
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        F.when(F.size("_w") >= 3, F.transform(F.slice("_w", 1, F.size("_w") - 2), lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)))).otherwise(F.array().cast("array<bigint>")).alias("_h"),
    )
    counted = hashed.select(
        *held,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.when(F.size(F.array_distinct("_h")) == F.size("_h"), F.lit(0).cast("bigint")).otherwise(_repeat_words(F.col("_h"), F.col("_h"))).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.select(*[F.col(h).alias(c) for h, c in zip(held, keep, strict=True)], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def host_rates(stats: DataFrame, host_col: str, *, lift: float = LIFT) -> DataFrame:
    """One row per host: host, host_docs, and for each rule its failures and shrunk rate; host_refused."""
    failures = [F.sum(F.expr(rule).cast("bigint")).alias(f"host_{name}") for name, rule in RULES.items()]
    hosts = stats.groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("host_docs"), *failures)
    moments = []
    for name in RULES:
        rate = F.col(f"host_{name}").cast("double") / F.col("host_docs")
        moments += [F.avg(rate).alias(f"m_{name}"), F.var_pop(rate).alias(f"v_{name}")]
    row = hosts.agg(*moments, F.avg(1 / F.col("host_docs").cast("double")).alias("noise")).first()  # one row: the moments of the priors
    refused = F.lit(False)
    for name in RULES:
        mean, noise = row[f"m_{name}"] or 0.0, row["noise"] or 0.0
        var = (row[f"v_{name}"] or 0.0) - mean * (1 - mean) * noise
        strength = min(max(mean * (1 - mean) / var - 1, STRENGTH[0]), STRENGTH[1]) if var > 0 else STRENGTH[1]
        shrunk = (F.col(f"host_{name}") + F.lit(mean * strength)) / (F.col("host_docs") + F.lit(strength))
        hosts = hosts.withColumn(f"{name}_rate", shrunk)
        spread = F.sqrt(F.col(f"{name}_rate") * (1 - F.col(f"{name}_rate")) / (F.col("host_docs") + F.lit(strength + 1)))
        refused = refused | (F.col(f"{name}_rate") - 2 * spread > F.lit(lift * mean))
    return hosts.withColumn("host_refused", refused)


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", lift: float = LIFT) -> DataFrame:
    """Per document row: id, the counts, base_failed, the columns of its host, kept.

    The counts are written once to the shared folder, so the texts are read once for both the host table and the join.
    """
    scratch = Scratch(docs.sparkSession)
    named = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_text"), F.col(host_col).alias("host"))
    stats = scratch.write(base_stats(named, text_col="_text", keep=[id_col, "host"]), "stats")
    hosts = scratch.write(host_rates(stats, "host", lift=lift), "hosts")
    joined = stats.join(hosts.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_refused"))


def _prior(name: str) -> str:
    return f"""SELECT m, n0, CASE WHEN v > m * (1 - m) * n0 THEN least(greatest(m * (1 - m) / (v - m * (1 - m) * n0) - 1, {STRENGTH[0]}), {STRENGTH[1]}) ELSE {STRENGTH[1]} END AS s
  FROM (SELECT avg({name}::DOUBLE / n) AS m, var_pop({name}::DOUBLE / n) AS v, avg(1.0::DOUBLE / n) AS n0 FROM h)"""


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
ln AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM ln WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
tri AS (SELECT r, p, array_to_string(w[p:p + 2], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM w)),
rep AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 3)) AS q FROM rep) GROUP BY r),
s AS (SELECT d.r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN lines USING (r) LEFT JOIN cov USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s),
h AS (SELECT source, count(*) AS n, {", ".join(f"count(*) FILTER (WHERE {rule}) AS {name}" for name, rule in RULES.items())} FROM f GROUP BY source),
{"".join(f"b_{name} AS ({_prior(name)})," for name in RULES)}
q AS (SELECT source, n, {", ".join(f"{name}, ({name} + b_{name}.m * b_{name}.s) / (n + b_{name}.s) AS {name}_rate, b_{name}.m AS {name}_m, b_{name}.s AS {name}_s" for name in RULES)} FROM h, {", ".join(f"b_{name}" for name in RULES)}),
hr AS (SELECT *, {" OR ".join(f"{name}_rate - 2 * sqrt({name}_rate * (1 - {name}_rate) / (n + {name}_s + 1)) > {LIFT} * {name}_m" for name in RULES)} AS refused FROM q)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT refused AS kept,
  f.source AS host, CAST(hr.n AS BIGINT) AS host_docs, {", ".join(f"CAST({name} AS BIGINT) AS host_{name}, round({name}_rate, 6) AS {name}_rate" for name in RULES)}, refused AS host_refused
FROM f JOIN hr ON f.source IS NOT DISTINCT FROM hr.source
"""
