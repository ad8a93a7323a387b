"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts become their words joined by single spaces, with a space at either end and a zero byte between texts; a benchmark
window is the same kind of string, so an occurrence is an occurrence of whole words.  Block shift tables over the first m
bytes of all patterns (m: the shortest) skip positions that no pattern can start at; where the shift is zero, the hash of
the block selects the patterns that end their first m bytes with it, and a comparison of bytes confirms.  Many lanes of a
block of text advance together, so that each step of the scan is one numpy operation.

The windows of the benchmark are built and made distinct on the executors.  They reach the driver one piece of at most
``pattern_bytes`` at a time (a single longer window is a piece of its own), go out as a broadcast of that size, and each piece
is one scan of the rows; a worker keeps the tables of the last pieces it used.

Nulls and empty texts have no words, no hits and no items.  Very long texts are read whole, in memory a few times the text.
Repeated document rows are judged one by one; repeated items count once, rows of one item id with different texts are one item
with the windows of all of them; items with a null id are left out.  There are no ties: every occurrence counts.  An empty
table of documents gives an empty result, an empty benchmark hits nothing.  Input columns other than id and text are not read;
``find_contamination`` returns those named in ``keep``, where its own columns replace any of their names, ``decontaminate``
returns every column of its input unchanged, whatever its name.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import OrderedDict, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, byte_class, caches, map_rows, text_blocks

WIDTH = 13
#: Bytes of words: digits, letters, and all that is not ASCII.
WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Bytes of window strings that one scan holds; a larger benchmark is searched in several scans of the same rows.
PATTERN_BYTES = 16 << 20
_NORMAL = np.where(WORD, LOWER, 32).astype(np.uint8)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, start of each text) with every text as ``" w1 w2 "`` and a zero byte after it."""
    n = len(offsets) - 1
    at = offsets + 2 * np.arange(n + 1)
    out = np.full(len(data) + 2 * n, 32, np.uint8)
    body = np.ones(len(out), bool)
    body[at[:-1]] = False
    body[at[1:] - 1] = False
    out[body] = _NORMAL[data]
    out[at[1:] - 1] = 0
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    starts = np.cumsum(keep)[at[:-1]] - 1 if n else at[:-1]
    out = out[keep]
    tail = np.flatnonzero(out == 0)  # a text that ends in a word has no space before its end yet
    bare = tail[out[tail - 1] != 32] if len(tail) else tail
    if len(bare):
        starts = starts + np.searchsorted(bare, starts)
        out = np.insert(out, bare, 32)
    return out, starts


def words_of(text: str | None) -> list[bytes]:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return _NORMAL[raw].tobytes().split()


class WuManber:
    """Positions of all occurrences of byte patterns in a byte array."""

    LANE = 256

    def __init__(self, patterns: list[bytes]):
        self.groups = []
        by_class = defaultdict(list)
        for k, p in enumerate(patterns):  # one short pattern would make every shift short
            by_class[min(len(p), 48) // 16].append(k)
        for ids in by_class.values():
            m = min(len(patterns[k]) for k in ids)
            block = max(1, min(8, m // 2))
            bits = 20
            heads = np.frombuffer(b"".join(patterns[k][:m] for k in ids), np.uint8).reshape(len(ids), m)
            shift = np.full(1 << bits, m - block + 1, np.int64)
            for end in range(block, m + 1):
                np.minimum.at(shift, self._hash(self._load(heads[:, end - block : end]), bits), m - end)
            last = self._hash(self._load(heads[:, m - block :]), bits)
            order = np.argsort(last, kind="stable")
            self.groups.append((m, block, bits, shift, last[order], np.array(ids)[order]))
        self.patterns = patterns

    @staticmethod
    def _hash(blocks: np.ndarray, bits: int) -> np.ndarray:
        return ((blocks * _MULT) >> np.uint64(64 - bits)).astype(np.int64)

    @staticmethod
    def _load(columns: np.ndarray) -> np.ndarray:
        out = np.zeros(columns.shape[0], np.uint64)
        for k in range(columns.shape[1]):
            out |= columns[:, k].astype(np.uint64) << np.uint64(8 * k)
        return out

    def find(self, data: np.ndarray) -> list[tuple[int, int]]:
        found: list[tuple[int, int]] = []
        size = len(data)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        words = np.ndarray((size + 1,), "<u8", padded.data, strides=(1,))  # eight bytes from every position
        raw = data.tobytes()
        for m, block, bits, shift, last, ids in self.groups:
            if size < m:
                continue
            mask = np.uint64((1 << 8 * block) - 1)
            pos = np.arange(0, size - m + 1, self.LANE)
            end = np.minimum(pos + self.LANE, size - m + 1)
            hits = []
            while len(pos):
                h = self._hash(words[pos + (m - block)] & mask, bits)
                step = shift[h]
                zero = step == 0
                if zero.any():
                    hits.append(np.stack([pos[zero], h[zero]]))
                    step[zero] = 1
                pos = pos + step
                live = pos < end
                pos, end = pos[live], end[live]
            if not hits:
                continue
            at, h = np.concatenate(hits, axis=1)
            lo, hi = np.searchsorted(last, h, "left"), np.searchsorted(last, h, "right")
            count = hi - lo
            where = np.repeat(at, count)
            which = ids[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())]
            for p, k in zip(where.tolist(), which.tolist(), strict=True):
                if raw.startswith(self.patterns[k], p):
                    found.append((p, k))
        return found


def window_rows(benchmark: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """(w, item): the distinct window strings of every item, built where the rows are."""

    def run(batches):
        for batch in batches:
            out: list[tuple[bytes, str]] = []
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                for i in range(max(1, len(words) - width + 1) if words else 0):
                    out.append((b" " + b" ".join(words[i : i + width]) + b" ", item))
                    if len(out) >= 20_000:
                        yield _window_batch(out)
                        out = []
            yield _window_batch(out)

    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return items.mapInArrow(run, "w binary, item string").distinct()


def _window_batch(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), pa.array([i for _, i in rows], pa.string())], names=["w", "item"])


def pieces_of(rows, limit: int) -> Iterator[dict[bytes, set[str]]]:
    """Window -> items, in pieces of about ``limit`` bytes; at least one piece, if an empty one."""
    piece: dict[bytes, set[str]] = {}
    size, some = 0, False
    for w, item in rows:
        cost = len(w) + len(item) + 64
        if piece and size + cost > limit:
            yield piece
            piece, size, some = {}, 0, True
        piece.setdefault(bytes(w), set()).add(item)
        size += cost
    if piece or not some:
        yield piece


#: Tables of the pieces that this worker used last.
_FINDERS: OrderedDict[str, tuple] = OrderedDict()
FINDERS = 2
caches(__name__, _FINDERS.clear)


def _finder(token: str, shared) -> tuple:
    """(finder, words of each pattern, items of each pattern), built once in a worker."""
    if token not in _FINDERS:
        patterns, names = shared.value
        _FINDERS[token] = WuManber(patterns), np.array([p.count(b" ") - 1 for p in patterns], np.int64), names
        while len(_FINDERS) > FINDERS:
            _FINDERS.popitem(last=False)
    return _FINDERS[token]


def _union(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


FIELDS = "n_words bigint, hit_spans array<struct<first: int, past: int>>, items array<string>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, keep: list[str] | None = None, pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """Per document row: ``n_words``, ``hit_spans`` (maximal runs of hit words) and ``items`` (sorted ids of occurring items).

    Nothing of the documents is shuffled; each piece of the benchmark is one more scan, chained to the others.
    """
    spark = docs.sparkSession
    keep = keep or [id_col]
    out, first = docs, True
    pieces = pieces_of(window_rows(benchmark, item_col, item_text_col, width).toLocalIterator(), pattern_bytes)
    piece = next(pieces)
    while piece is not None:
        following = next(pieces, None)
        patterns = sorted(piece)
        shared = spark.sparkContext.broadcast((patterns, [sorted(piece[p]) for p in patterns]))  # at most pattern_bytes of windows

        def scan(batch, shared=shared, token=uuid.uuid4().hex, later=not first):
            finder, lengths, names = _finder(token, shared)
            n_words, hits, items = [], [], []
            for i, j, data, offsets in text_blocks(batch, text_col):
                norm, at = normalise(data, offsets)
                starts = np.flatnonzero((norm[:-1] == 32) & (norm[1:] > 32)) if len(norm) else np.zeros(0, np.int64)
                first = np.searchsorted(starts, np.append(at, len(norm)))
                n_words.append(np.diff(first))
                spans_of, items_of = defaultdict(list), defaultdict(set)
                for p, pattern in finder.find(norm):
                    doc = int(np.searchsorted(at, p, "right")) - 1
                    word = int(np.searchsorted(starts, p)) - int(first[doc])
                    spans_of[doc].append((word, word + int(lengths[pattern])))
                    items_of[doc].update(names[pattern])
                hits += [spans_of.get(d, []) for d in range(j - i)]
                items += [items_of.get(d, set()) for d in range(j - i)]
            if later:
                before = batch.to_pydict()
                hits = [[*h, *((x["first"], x["past"]) for x in b)] for h, b in zip(hits, before["hit_spans"], strict=True)]
                items = [x | set(b) for x, b in zip(items, before["items"], strict=True)]
            spans_out = [[{"first": a, "past": b} for a, b in _union(h)] for h in hits]
            return [pa.array(np.concatenate(n_words)), pa.array(spans_out, pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]

        columns = keep if following is None else list(dict.fromkeys([*keep, id_col, text_col]))
        needed = list(dict.fromkeys([*columns, text_col, *([] if first else ["hit_spans", "items"])]))
        out = map_rows(out.select(*needed), scan, FIELDS, columns)
        piece, first = following, False
    return out


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract from those of ``find_contamination``."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda s, x: s + x["past"] - x["first"])
    return found.withColumn("n_hit", n_hit).select(
        "*",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that are not contaminated, with all their columns."""
    names = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(c).alias(n) for c, n in names.items()])
    found = digest(find_contamination(plain, benchmark, id_col=names[id_col], text_col=names[text_col], keep=list(names.values())))
    return found.where(~F.col("contaminated")).select(*[F.col(n).alias(c) for c, n in names.items()])


def sha256_of_items(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
