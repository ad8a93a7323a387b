"""Language identification by a bidirectional gated recurrent network over bytes, written and trained in numpy.

A text's bytes (A-Z lower-cased) are read in windows of ``STEPS``; in each window one gated recurrent layer runs forwards and
one backwards, every position is labelled from both states, and a document's probabilities are the mean over all its
positions.  All windows of all texts of a block advance together, one byte a step.

Training is by backpropagation through time with Adam, from text and language of documents whose CRC-32 of the id is not 2
modulo 4 and whose language is known.  It uses at most ``per_language`` documents of each of the ``max_languages`` most frequent
languages (those of least hash of the id, one row of each id); that bounds the rows the driver learns from.  Their texts are
whole: a training window is drawn from all windows of a document that is drawn from all of its language.  Predictions read
whole texts and nothing but the text.

A text that is null or has no letter is ``und`` with score 0, as is every text if no language was learned.  Ties of
probability go to the first language by name.  Repeated rows get equal results; an empty table gives an empty result.  Very
long texts cost their own size and some bytes for each window, since windows are gathered a chunk at a time.  Columns other
than id and text are not read for a prediction; ``accept`` returns all columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, map_rows, text_blocks

STEPS, HIDDEN = 48, 12
PER_LANGUAGE, MAX_LANGUAGES = 150, 1000
ROUNDS, BATCH = 320, 256
#: A document with a lower score is rejected by ``accept``.
MIN_SCORE = 0.4


def fold(id_col: str, modulus: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def _init(rng, hidden: int, classes: int) -> dict[str, np.ndarray]:
    p = {}
    for d in "fb":
        p[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))  # byte embedding and input weights in one: a row per byte
        p[f"u{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
        p[f"c{d}"] = np.zeros(3 * hidden)
    p["o"] = rng.normal(0, 0.3, (2 * hidden, classes))
    p["ob"] = np.zeros(classes)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _run(x: np.ndarray, u: np.ndarray, seq: np.ndarray, tape: list | None = None) -> np.ndarray:
    """States (steps, windows, hidden) of one direction.  Gates z and r are logistic, written with tanh of half the input."""
    hidden = u.shape[0]
    steps, n = seq.shape
    out = np.empty((steps, n, hidden), np.float32)
    h = np.zeros((n, hidden), np.float32)
    for t in range(steps):
        g = x[seq[t]]
        w = h @ u
        zr = g[:, : 2 * hidden] + w[:, : 2 * hidden]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        z, r = zr[:, :hidden], zr[:, hidden:]
        wn = w[:, 2 * hidden :]
        c = g[:, 2 * hidden :] + r * wn
        np.tanh(c, out=c)
        if tape is not None:
            tape.append((h, z, r, wn, c))
        h = np.add(c, z * (h - c), out=out[t])
    return out


def _softmax(a: np.ndarray) -> np.ndarray:
    a = a - a.max(axis=-1, keepdims=True)
    np.exp(a, out=a)
    a /= a.sum(axis=-1, keepdims=True)
    return a


def forward(p: dict, seq: np.ndarray) -> np.ndarray:
    """Probabilities (steps, windows, classes)."""
    f = _run(p["xf"] + p["cf"], p["uf"], seq)
    b = _run(p["xb"] + p["cb"], p["ub"], seq[::-1])[::-1]
    hidden = f.shape[-1]
    return _softmax(f @ p["o"][:hidden] + b @ p["o"][hidden:] + p["ob"])


def gradients(p: dict, seq: np.ndarray, label: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy over unmasked positions, and its gradients by backpropagation through time."""
    tapes: dict[str, list] = {"f": [], "b": []}
    f = _run(p["xf"] + p["cf"], p["uf"], seq, tapes["f"])
    b = _run(p["xb"] + p["cb"], p["ub"], seq[::-1], tapes["b"])[::-1]
    both = np.concatenate([f, b], axis=2)
    prob = _softmax(both @ p["o"] + p["ob"])
    steps, n, hidden = f.shape
    total = max(mask.sum(), 1)
    loss = -float((np.log(prob[:, np.arange(n), label] + 1e-9) * mask).sum() / total)
    d = prob.copy()
    d[:, np.arange(n), label] -= 1
    d *= (mask / total)[:, :, None]
    g = {"o": both.reshape(-1, 2 * hidden).T @ d.reshape(-1, d.shape[2]), "ob": d.sum((0, 1))}
    back = d @ p["o"].T
    for way, dh_all, s in (("f", back[:, :, :hidden], seq), ("b", back[::-1, :, hidden:], seq[::-1])):
        u = p[f"u{way}"]
        gu, gx = np.zeros_like(u), np.zeros_like(p[f"x{way}"])
        dh = np.zeros((n, hidden), np.float32)
        for t in range(steps - 1, -1, -1):
            h, z, r, wn, c = tapes[way][t]
            dh = dh + dh_all[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * wn * r * (1 - r)
            pre = np.concatenate([dz, dr, dc], axis=1)
            np.add.at(gx, s[t], pre)
            pre_u = np.concatenate([dz, dr, dc * r], axis=1)
            gu += h.T @ pre_u
            dh = dh * z + pre_u @ u.T
        g[f"u{way}"], g[f"x{way}"], g[f"c{way}"] = gu, gx, gx.sum(0)
    return loss, g


def window_bounds(offsets: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, number of bytes, row) of each window; every byte of every row lies in one."""
    sizes = np.diff(offsets)
    count = -(-sizes // steps)
    row = np.repeat(np.arange(len(sizes)), count)
    begin = offsets[row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * steps
    return begin, np.minimum(steps, offsets[row + 1] - begin), row


def window_bytes(data: np.ndarray, begin: np.ndarray, length: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Lower-cased bytes (steps, windows) of some windows, zeros past their ends."""
    if not len(begin):
        return np.zeros((steps, 0), np.uint8)
    place = np.arange(steps)[:, None]
    out = LOWER[data[np.minimum(begin[None, :] + place, len(data) - 1)]]
    out[place >= length[None, :]] = 0
    return out


def train(texts: list[str], labels: list[str], *, seed: int = 7, rounds: int = ROUNDS, batch: int = BATCH, hidden: int = HIDDEN, steps: int = STEPS) -> dict:
    """The parameters, with the class names under ``classes``."""
    classes = sorted(set(labels))
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    begin, length, row = window_bounds(offsets, steps)
    if not len(row) or not classes:
        return {"classes": []}
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    own = np.diff(first)
    label = np.array([classes.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    p = _init(rng, hidden, len(classes))
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    by_class = [np.flatnonzero((label == c) & (own > 0)) for c in range(len(classes))]
    for k in range(1, rounds + 1):
        doc = np.concatenate([rng.choice(have, -(-batch // len(classes))) for have in by_class if len(have)])
        pick = first[doc] + (rng.random(len(doc)) * own[doc]).astype(np.int64)
        mask = (np.arange(steps)[:, None] < length[pick][None, :]).astype(np.float32)
        _, g = gradients(p, window_bytes(data, begin[pick], length[pick], steps), label[doc], mask)
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = 0.02 * min(1, 2 * (1 - (k - 1) / rounds))
        for name, x in g.items():
            x = x * min(1, 5 / (norm + 1e-9))
            m[name] += 0.1 * (x - m[name])
            v[name] += 0.01 * (x * x - v[name])
            p[name] = (p[name] - rate * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.99**k)) + 1e-6)).astype(np.float32)
    return p | {"classes": classes}


def _logits(x: np.ndarray, u: np.ndarray, o: np.ndarray, seq: np.ndarray, order, out: np.ndarray) -> None:
    """Adds one direction's share of the logits to ``out`` (steps, classes, windows).

    The same recurrence as ``_run`` with the windows along the rows, so that every operation runs over contiguous memory.
    """
    hidden, n = u.shape[0], seq.shape[1]
    gate = 2 * hidden
    xt, ut, ot = np.ascontiguousarray(x.T), np.ascontiguousarray(u.T), np.ascontiguousarray(o.T)
    xt[:gate] *= 0.5
    ut[:gate] *= 0.5
    h, g, w, tmp = (np.zeros((k, n), np.float32) for k in (hidden, 3 * hidden, 3 * hidden, hidden))
    share = np.empty(out.shape[1:], np.float32)
    for t in order:
        np.take(xt, seq[t], axis=1, out=g, mode="clip")
        np.matmul(ut, h, out=w)
        zr, c = g[:gate], g[gate:]
        zr += w[:gate]
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        np.multiply(zr[hidden:], w[gate:], out=tmp)
        c += tmp
        np.tanh(c, out=c)
        h -= c
        h *= zr[:hidden]
        h += c
        np.matmul(ot, h, out=share)
        out[t] += share


def pooled(p: dict, data: np.ndarray, offsets: np.ndarray, chunk: int = 1024) -> np.ndarray:
    """Mean over the positions of each row of the labels' probabilities."""
    steps, classes, hidden = STEPS, len(p["classes"]), p["uf"].shape[0]
    begin, length, row = window_bounds(offsets, steps)
    out = np.zeros((len(offsets) - 1, classes))
    for a in range(0, len(row), chunk):
        own = length[a : a + chunk]
        part = window_bytes(data, begin[a : a + chunk], own, steps)
        prob = np.empty((steps, classes, part.shape[1]), np.float32)
        prob[:] = p["ob"][:, None]
        _logits(p["xf"] + p["cf"], p["uf"], p["o"][:hidden], part, range(steps), prob)
        _logits(p["xb"] + p["cb"], p["ub"], p["o"][hidden:], part, range(steps - 1, -1, -1), prob)
        prob -= prob.max(axis=1, keepdims=True)
        np.exp(prob, out=prob)
        prob /= prob.sum(axis=1, keepdims=True)
        prob *= (np.arange(steps)[:, None] < own[None, :])[:, None, :]
        np.add.at(out, row[a : a + chunk], prob.sum(axis=0).T)
    return out / np.maximum(np.diff(offsets), 1)[:, None]


def training_rows(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, per_language: int, max_languages: int) -> list:
    """At most ``per_language`` (language, text) of each language, the same for every run over the same rows."""
    key = F.xxhash64(F.col(id_col).cast("string"))
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col, 4) != 2)).select(F.col(lang_col).cast("string").alias("lang"), key.alias("key"), F.col(text_col).alias("text"))
    counts = known.groupBy("lang").agg(F.approx_count_distinct("key").alias("n"), F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "lang").limit(max_languages).collect()
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, (2 * per_language + 20) / max(r["n"], 1)))])
    picked = known.where((F.col("key").cast("double") / 2.0**64 + 0.5) <= share[F.col("lang")])
    one = picked.groupBy("lang", "key").agg(F.min("text").alias("text"))  # rows of one id count once
    rows = one.select("*", F.row_number().over(Window.partitionBy("lang").orderBy("key")).alias("nth")).where(F.col("nth") <= per_language).collect()
    return [(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["lang"], r["nth"]))]


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> dict:
    rows = training_rows(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, per_language=per_language, max_languages=max_languages)
    return train([t for _, t in rows], [x for x, _ in rows])


def predict(docs: DataFrame, model: dict, *, text_col: str = "text", keep: list[str]) -> DataFrame:
    """Adds lang_pred and score to the ``keep`` columns."""
    import re

    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred kB, whatever the data
    ascii_letter = re.compile(rb"[A-Za-z]")

    def fn(batch):
        import regex

        p = shared.value
        names, scores = [], []
        for _, _, data, offsets in text_blocks(batch, text_col):
            prob = pooled(p, data, offsets) if p["classes"] else None
            raw = data.tobytes()
            for d in range(len(offsets) - 1):
                own = raw[offsets[d] : offsets[d + 1]]
                letter = ascii_letter.search(own) or regex.search(r"\p{L}", own.decode("utf-8", "replace"))
                best = int(prob[d].argmax()) if letter and prob is not None else -1
                names.append(p["classes"][best] if best >= 0 else "und")
                scores.append(float(min(1.0, prob[d, best])) if best >= 0 else 0.0)
        return [pa.array(names), pa.array(scores)]

    return map_rows(docs.select(*dict.fromkeys([*keep, text_col])), fn, "lang_pred string, score double", keep)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fits on the documents themselves and returns id, held_out, lang_pred, score."""
    model = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    named = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_text"))
    held = F.coalesce(fold(id_col, 4) == 2, F.lit(False))
    return predict(named, model, text_col="_text", keep=[id_col]).select(id_col, held.alias("held_out"), "lang_pred", "score")


def accept(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = MIN_SCORE) -> DataFrame:
    """Documents in a learned language with a score of at least ``min_score``, with all columns unchanged."""
    model = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    names = [f"_in_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    judged = predict(plain, model, text_col=names[docs.columns.index(text_col)], keep=names)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
