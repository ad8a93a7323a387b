"""Document quality by attention-based multiple-instance learning, written and trained in numpy.

A document is a bag of passages of ``PASSAGE`` bytes.  Each passage is encoded (byte and byte-pair frequencies, how full it
is, how many there are; then a tanh layer), gated attention weighs the passages of a document, and the weighted sum of the
encodings is scored by a logistic unit.  Labels belong to documents alone; the attention learns which passages matter.

Training uses labelled documents whose CRC-32 of the id is not 0 modulo 5, at most ``max_documents`` of them (those of least
hash of the id); that bounds the rows the driver learns from.  Training and scores read every passage of whole texts, and
nothing but the text; features of training passages are made a batch at a time.

Null and empty texts are a bag of one empty passage and get a score too.  Labels other than 0 and 1 are left out; equal labels
of one id count once, an id with both labels is learned with both, rows of one id with different texts count once in training
(the least text).  Repeated rows get equal scores; there are no ties to break.  If one class alone is labelled, the score is its
share; without labels it is one half.  Very long texts are scored whole, a piece of their passages at a time.  An empty table
gives an empty result.  Input columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_blocks
from .language_id import fold

PASSAGE, PAIRS, EXTRA = 384, 256, 4
CODE, ATTENTION = 24, 16
MAX_DOCUMENTS = 3000
EPOCHS, BATCH = 24, 64
THRESHOLD = 0.3
_FEATURES = 256 + PAIRS + EXTRA


def passages(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, past byte) of every passage; an empty row has an empty one."""
    sizes = np.diff(offsets)
    count = np.maximum(-(-sizes // PASSAGE), 1)
    row = np.repeat(np.arange(len(sizes)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = offsets[row] + k * PASSAGE
    return row, begin, np.minimum(begin + PASSAGE, offsets[row + 1])


def encode(data: np.ndarray, begin: np.ndarray, end: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Features of passages that follow one another without gaps; ``count``: passages in the document of each."""
    n = len(begin)
    out = np.zeros((n, _FEATURES), np.float32)
    sizes = end - begin
    if len(data):
        owner = np.repeat(np.arange(n), sizes)
        out[:, :256] = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256)
        pair = (data[:-1].astype(np.uint32) * 31 + data[1:].astype(np.uint32) * 197) % PAIRS
        inside = owner[1:] == owner[:-1]
        out[:, 256 : 256 + PAIRS] = np.bincount((owner[:-1] * PAIRS + pair)[inside], minlength=n * PAIRS).reshape(n, PAIRS)
    out[:, : 256 + PAIRS] = np.sqrt(out[:, : 256 + PAIRS] / np.maximum(sizes, 1)[:, None])
    out[:, -4] = sizes / PASSAGE
    out[:, -3] = np.log1p(count) / 4
    out[:, -2] = sizes == 0
    out[:, -1] = np.log1p(sizes) / 6
    return out


def _segments(row: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)


def attend(p: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, logits of the gated attention) of passages."""
    h = np.tanh(x @ p["w"] + p["wb"])
    u = 0.5 + 0.5 * np.tanh(0.5 * (h @ p["u"] + p["ub"]))
    return h, (np.tanh(h @ p["v"] + p["vb"]) * u) @ p["a"]


def forward(p: dict, x: np.ndarray, row: np.ndarray, tape: bool = False):
    """Scores of the documents whose passages are runs of equal ``row``."""
    h = np.tanh(x @ p["w"] + p["wb"])
    v = np.tanh(h @ p["v"] + p["vb"])
    u = 0.5 + 0.5 * np.tanh(0.5 * (h @ p["u"] + p["ub"]))
    e = (v * u) @ p["a"]
    cut = _segments(row)
    bag = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(row))))
    e = np.exp(e - np.maximum.reduceat(e, cut)[bag])
    weight = e / np.add.reduceat(e, cut)[bag]
    z = np.add.reduceat(weight[:, None] * h, cut)
    score = 0.5 + 0.5 * np.tanh(0.5 * (z @ p["o"] + p["ob"]))
    return (score, h, v, u, weight, z, bag, cut) if tape else score


def gradients(p: dict, x: np.ndarray, row: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    score, h, v, u, weight, z, bag, cut = forward(p, x, row, True)
    loss = -float(np.mean(y * np.log(score + 1e-7) + (1 - y) * np.log(1 - score + 1e-7)))
    d = (score - y) / len(y)
    dz = d[:, None] * p["o"]
    dw = (dz[bag] * h).sum(1)
    de = weight * (dw - np.add.reduceat(weight * dw, cut)[bag])
    dv = de[:, None] * p["a"] * u * (1 - v * v)
    du = de[:, None] * p["a"] * v * u * (1 - u)
    dh = (weight[:, None] * dz[bag] + dv @ p["v"].T + du @ p["u"].T) * (1 - h * h)
    g = {"o": z.T @ d, "ob": d.sum(), "a": (v * u).T @ de, "v": h.T @ dv, "vb": dv.sum(0), "u": h.T @ du, "ub": du.sum(0), "w": x.T @ dh, "wb": dh.sum(0)}
    return loss, {k: np.asarray(t, np.float32) for k, t in g.items()}


def train(data: np.ndarray, offsets: np.ndarray, y: np.ndarray, *, seed: int = 5, epochs: int = EPOCHS, batch: int = BATCH) -> dict:
    """data, offsets: the texts of the documents; y: one label for each."""
    if not len(y) or len(set(y.tolist())) < 2:
        return {"share": float(np.mean(y)) if len(y) else 0.5}
    rng = np.random.default_rng(seed)
    shapes = {"w": (_FEATURES, CODE), "wb": (CODE,), "v": (CODE, ATTENTION), "vb": (ATTENTION,), "u": (CODE, ATTENTION), "ub": (ATTENTION,), "a": (ATTENTION,), "o": (CODE,), "ob": ()}
    p = {k: np.asarray(rng.normal(0, 1 / np.sqrt(s[0]), s) if k in "wvuao" else np.zeros(s), np.float32) for k, s in shapes.items()}
    m, s2 = {k: np.zeros_like(t) for k, t in p.items()}, {k: np.zeros_like(t) for k, t in p.items()}
    step, steps = 0, epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), batch):
            own = order[a : a + batch]
            x, row = features(np.concatenate([data[offsets[d] : offsets[d + 1]] for d in own]), np.concatenate([[0], np.cumsum(np.diff(offsets)[own])]))
            _, g = gradients(p, x, row, y[own])
            step += 1
            rate = 0.01 * (1 - 0.95 * step / steps)
            for k, t in g.items():
                t = t + 1e-5 * p[k]
                m[k] = m[k] + 0.1 * (t - m[k])
                s2[k] = s2[k] + 0.001 * (t * t - s2[k])
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s2[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return p


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, row) of all passages of some texts."""
    row, begin, end = passages(offsets)
    return encode(data, begin, end, np.bincount(row)[row]), row


def sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, max_documents: int) -> list:
    """At most ``max_documents`` (key, label, text), one for each id and label."""
    key = F.xxhash64(F.col(id_col).cast("string"))
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(id_col, 5) != 0)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y"), key.alias("key"))
    share = min(1.0, (2 * max_documents + 100) / max(usable.agg(F.approx_count_distinct("key")).first()[0] or 0, 1))
    likely = usable.where(F.col("key").cast("double") / 2.0**64 + 0.5 <= share).distinct()
    picked = likely.orderBy("key", "y").limit(max_documents)  # bounded: a top-k by hash
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(picked), "_id")  # at most max_documents rows
    rows = joined.groupBy("key", "y").agg(F.min("text").alias("text")).collect()
    return sorted((r["key"], r["y"], r["text"]) for r in rows)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_documents: int = MAX_DOCUMENTS) -> dict:
    rows = sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, max_documents=max_documents)
    raw = [t.encode() for _, _, t in rows]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return train(np.frombuffer(b"".join(raw), np.uint8), offsets, np.array([y for _, y, _ in rows], np.float32))


def bag_scores(p: dict, data: np.ndarray, offsets: np.ndarray, limit: int = 4096) -> np.ndarray:
    """Scores of whole texts.  A text of more than ``limit`` passages is read in pieces: the attention's running sums are kept
    and rescaled, so its result is that of all passages at once."""
    row, begin, end = passages(offsets)
    count = np.bincount(row, minlength=len(offsets) - 1)
    if len(row) <= limit or len(offsets) > 2:
        return forward(p, encode(data, begin, end, count[row]), row).astype(np.float64)
    top, total, z = -np.inf, 0.0, 0.0
    for a in range(0, len(row), limit):
        b, e = begin[a : a + limit], end[a : a + limit]
        h, weight = attend(p, encode(data[b[0] : e[-1]], b - b[0], e - b[0], count[row[a : a + limit]]))
        peak = max(top, float(weight.max()))
        now, before = np.exp(weight - peak), np.exp(top - peak)
        total, z, top = total * before + now.sum(), z * before + now @ h, peak
    return np.array([0.5 + 0.5 * np.tanh(0.5 * (z / total @ p["o"] + p["ob"]))], np.float64)


def score(docs: DataFrame, model: dict, *, text_col: str = "text", keep: list[str]) -> DataFrame:
    """Adds score (double) to the ``keep`` columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 60 kB

    def fn(batch):
        p, out = shared.value, []
        for _, _, data, offsets in text_blocks(batch, text_col):
            out.append(np.full(len(offsets) - 1, p["share"]) if "share" in p else bag_scores(p, data, offsets))
        return [pa.array(np.concatenate(out))]

    return map_rows(docs.select(*dict.fromkeys([*keep, text_col])), fn, "score double", keep)


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Fits and scores: id, held_out, score, predicted."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    named = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_text"))
    held = F.coalesce(fold(id_col, 5) == 0, F.lit(False)).alias("held_out")
    return score(named, model, text_col="_text", keep=[id_col]).select(id_col, held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
