"""Token counts by a sentencepiece BPE model, with all pre-tokens of a block merged at once in ragged numpy arrays.

A text becomes what the model's own normaliser makes of it (identity: a space in front, spaces written as U+2581).  It is cut into
pre-tokens before each space that follows something else, which is exact as long as no piece holds such a place (checked when
the model is read; otherwise a text is one pre-token), and further between any two characters that stand side by side in no
piece.  All pre-tokens are then held end to end, one symbol a character.  In every round each sequence applies its pair of best
score, all its occurrences at once from the left, and this goes on until no sequence has a pair in the vocabulary; what counts is
the number of symbols left, and a character without a piece counts its UTF-8 bytes.  An occurrence that brings forth a pair of
the same or a better score ends the round of its sequence, since the library would take that pair next; so the result is that of
merging one pair at a time.  Sequences of more than ``LONG`` symbols, of which rounds would be many, go through the same order
one pair at a time, in memory that grows with the sequence (some 40 bytes a symbol).

Nothing is trained.  A worker keeps the counts of pre-tokens by their 128-bit names, ``CACHE`` of them at most (20 bytes each,
however long the pre-tokens are).

Null and empty texts have no tokens and no bytes; whole texts are counted, whatever their length.  Strings of control symbols in
a text are ordinary characters.  Repeated rows count alike, a null id stays null, an empty table gives an empty result.  Of equal
scores the leftmost pair comes first, as in the library.  An input column named like an added one is replaced by ``count_tokens``.
"""

from __future__ import annotations

import heapq
import struct
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shipped, blocks, caches, map_rows, range_hashes, ship, text_buffers

CACHE = 1_000_000
LONG = 128
#: Bytes of text that are cut and named at a time.
BLOCK = 1 << 20
NONE = np.int32(1 << 30)
# Fixed values of the sentencepiece model format (field numbers and enumerations).
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, TYPE, NORMAL = 1, 2, 3, 1
MODEL_TYPE, SUFFIX, BYTE_FALLBACK, BPE = 3, 24, 35, 2
CHARSMAP, DUMMY_PREFIX, EXTRA_WHITESPACE, ESCAPE_WHITESPACE = 2, 3, 4, 5
USER_DEFINED, UNUSED = 4, 5
SPACE = "▁"


def fields(raw: bytes):
    """(field number, value) of a protobuf message: int, float or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = out = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return out

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, raw[at : at + size]
            at += size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield key >> 3, struct.unpack("<d" if kind == 1 else "<f", raw[at : at + size])[0]
            at += size
        else:
            raise ValueError("not a sentencepiece model")


class Table:
    """Numbers by keys that are not negative: open places, sixteen for each key at least, probed in turn."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, default: int):
        self.bits = max(4, 4 + len(keys).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, default, np.int32)
        for at, key, value in zip(self._place(keys).tolist(), keys.tolist(), values.tolist(), strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) & (len(self.keys) - 1)
            self.keys[at], self.values[at] = key, value

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys)
        found = self.keys[at]
        out = self.values[at]
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            found = self.keys[at[todo]]
            out[todo] = self.values[at[todo]]
            todo = todo[(found != keys[todo]) & (found >= 0)]
        return out


class Merges:
    """The tables of a model: which pairs of symbols merge into what, and what every symbol left over counts."""

    def __init__(self, model: bytes):
        pieces, trainer, normalizer = [], {}, {}
        for number, value in fields(model):
            if number == PIECES:
                pieces.append(dict(fields(value)))
            elif number == TRAINER:
                trainer = dict(fields(value))
            elif number == NORMALIZER:
                normalizer = dict(fields(value))
        if trainer.get(MODEL_TYPE) != BPE or trainer.get(SUFFIX, 0) or not trainer.get(BYTE_FALLBACK, 0):
            raise ValueError("a BPE model with byte fallback and white space as prefix is needed")
        if normalizer.get(CHARSMAP) or normalizer.get(EXTRA_WHITESPACE, 1) or not normalizer.get(ESCAPE_WHITESPACE, 1):
            raise ValueError("a model whose normaliser is the identity is needed")
        if any(p.get(TYPE, NORMAL) in (USER_DEFINED, UNUSED) for p in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = bool(normalizer.get(DUMMY_PREFIX, 1))
        score = {p[PIECE].decode(): p.get(SCORE, 0.0) for p in pieces if p.get(TYPE, NORMAL) == NORMAL}
        symbols = list(score) + [c for c in dict.fromkeys("".join(score)) if c not in score]
        number = {s: k for k, s in enumerate(symbols)}
        self.unknown = len(symbols)
        place = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        #: Rank of each symbol as the result of a merge: the place of its score, the best first.
        self.rank = np.array([place[score[s]] if s in score else NONE for s in symbols] + [NONE], np.int32)
        self.weight = np.array([1 if s in score else len(s.encode()) for s in symbols] + [0], np.int64)
        self.of_char = np.full(0x110000, self.unknown, np.int32)
        for c in {c for s in symbols for c in s}:
            self.of_char[ord(c)] = number[c]
        pairs = {(number[s[:k]], number[s[k:]]): number[s] for s in score for k in range(1, len(s)) if s[:k] in number and s[k:] in number}
        self.pairs = Table(np.array([a * (self.unknown + 1) + b for a, b in pairs], np.int64), np.fromiter(pairs.values(), np.int32, len(pairs)), self.unknown)
        beside = {(s[k], s[k + 1]) for s in score for k in range(len(s) - 1)}
        self.beside = Table(np.array([number[a] * (self.unknown + 1) + number[b] for a, b in beside], np.int64), np.ones(len(beside), np.int32), 0)
        #: Whether a space always begins a pre-token.
        self.spaced = not any(b == SPACE and a != SPACE for a, b in beside)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The symbol that each pair merges into; ``unknown``, of rank NONE, where it merges into nothing."""
        return self.pairs[a.astype(np.int64) * (self.unknown + 1) + b]

    # ------------------------------------------------------------ merging

    def surviving(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """What the symbols that are left of every sequence count; ``starts`` of all sequences, none of them empty."""
        out = np.zeros(len(starts), np.int64)
        sizes = np.diff(starts, append=len(symbols))
        for k in np.flatnonzero(sizes > LONG):
            out[k] = self._one(symbols[starts[k] : starts[k] + sizes[k]])
        fit = sizes <= LONG
        own = np.flatnonzero(fit)
        sym = symbols[np.repeat(fit, sizes)]
        sizes = sizes[own]
        while len(own):
            seq = np.repeat(np.arange(len(own)), sizes)
            inside = np.append(seq[1:] == seq[:-1], False)
            made = np.full(len(sym), self.unknown, np.int32)
            made[:-1][inside[:-1]] = self.join(sym[:-1][inside[:-1]], sym[1:][inside[:-1]])
            sym, made, seq, sizes, own = self._finish(sym, made, seq, sizes, own, out)
            if len(own):
                sym, sizes = self._round(sym, made, seq, sizes)
        return out

    def _finish(self, sym, made, seq, sizes, own, out):
        """Counts the sequences that have no pair left, and leaves the others."""
        live = np.zeros(len(own), bool)
        live[seq[self.rank[made] != NONE]] = True
        if live.all():
            return sym, made, seq, sizes, own
        over = ~live[seq]
        counts = np.bincount(seq[over], weights=self.weight[sym[over]], minlength=len(own))
        out[own[~live]] = counts[~live].astype(np.int64)
        keep = ~over
        fresh = np.cumsum(live) - 1
        return sym[keep], made[keep], fresh[seq[keep]], sizes[live], own[live]

    def _round(self, sym, made, seq, sizes):
        """Every sequence applies its pair of best rank."""
        rank, n = self.rank[made], len(sym)
        starts = np.cumsum(sizes) - sizes
        best = np.minimum.reduceat(rank, starts)
        hit = rank == best[seq]
        at = np.arange(n)
        first = hit & ~np.append(False, hit[:-1] & (seq[1:] == seq[:-1]))
        take = np.flatnonzero(hit & ((at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0))
        # what a merge brings forth: with the symbol before it, as it is by then, and with the symbol after it, as it still is
        now = sym.copy()
        now[np.minimum(take + 1, n - 1)] = made[take]  # the second place of a pair stands for the merged symbol
        bounds = np.append(starts, n)
        left, right = take > bounds[seq[take]], take + 2 < bounds[seq[take] + 1]
        worse = np.full(len(take), NONE, np.int32)
        worse[left] = self.rank[self.join(now[take[left] - 1], made[take[left]])]
        worse[right] = np.minimum(worse[right], self.rank[self.join(made[take[right]], sym[take[right] + 2])])
        stop = worse <= best[seq[take]]
        if stop.any():
            last = np.full(len(sizes), n)
            np.minimum.at(last, seq[take[stop]], take[stop])
            take = take[take <= last[seq[take]]]
        sym = sym.copy()
        sym[take] = made[take]
        gone = np.zeros(n, bool)
        gone[take + 1] = True
        return sym[~gone], sizes - np.bincount(seq[take], minlength=len(sizes))

    def _one(self, symbols: np.ndarray) -> int:
        """A long sequence: its pairs by rank and place, one at a time."""
        n = len(symbols)
        made = np.append(self.join(symbols[:-1], symbols[1:]), self.unknown)
        ranks = self.rank[made].astype(np.int64)
        known = np.flatnonzero(ranks != NONE)
        first = iter(known[np.argsort(ranks[known], kind="stable")].tolist())
        sym, after, before = array("i", symbols.astype(np.int32).tobytes()), array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        end, base, rank, table = n, self.unknown + 1, self.rank, self._table()
        heap: list[tuple[int, int, int]] = []
        place = next(first, None)
        head = None if place is None else (int(ranks[place]), place, int(made[place]))
        while head is not None or heap:
            if head is None or (heap and heap[0] < head):
                _, i, new = heapq.heappop(heap)
            else:
                _, i, new = head
                place = next(first, None)
                head = None if place is None else (int(ranks[place]), place, int(made[place]))
            j = after[i]
            if sym[i] < 0 or j >= end or table.get(sym[i] * base + sym[j]) != new:
                continue
            sym[i], sym[j] = new, -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if (more := table.get(new * base + sym[k])) is not None:
                    heapq.heappush(heap, (int(rank[more]), i, more))
            h = before[i]
            if h >= 0 and (more := table.get(sym[h] * base + new)) is not None:
                heapq.heappush(heap, (int(rank[more]), h, more))
        left = np.frombuffer(sym, np.int32)
        return int(self.weight[left[left >= 0]].sum())

    @lru_cache(maxsize=1)  # noqa: B019 (one model a worker)
    def _table(self) -> dict[int, int]:
        held = self.pairs.keys >= 0
        return dict(zip(self.pairs.keys[held].tolist(), self.pairs.values[held].tolist(), strict=True))

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Token counts of pre-tokens, given by their UTF-8 bytes with spaces for U+2581."""
        sizes = ends - starts
        past = np.concatenate([[0], np.cumsum(sizes)])
        raw = data[np.repeat(starts - past[:-1], sizes) + np.arange(past[-1])]
        heads = np.flatnonzero((raw & 0xC0) != 0x80)
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")
        points = np.where(points == 0x20, np.uint32(ord(SPACE)), points)
        symbols = self.of_char[points]
        own = np.searchsorted(past, heads, side="right") - 1
        key = symbols[:-1].astype(np.int64) * (self.unknown + 1) + symbols[1:]
        near = self.beside[key] > 0
        cut = np.flatnonzero(np.append(True, ~near | (own[1:] != own[:-1])))
        counts = self.surviving(symbols, cut)
        out = np.bincount(own[cut], weights=counts, minlength=len(starts))
        lost = symbols == self.unknown
        out += np.bincount(own[lost], weights=np.diff(heads, append=len(raw))[lost], minlength=len(starts))
        return out.astype(np.int64)


class Counter:
    """Counts of texts, with the counts of pre-tokens that were met before."""

    def __init__(self, model: bytes):
        self.merges = Merges(model)
        self._clear()

    def _clear(self) -> None:
        self.names, self.check, self.known = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def _lookup(self, names: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.names):
            return np.zeros(len(names), bool), np.zeros(len(names), np.int64)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return (self.names[at] == names) & (self.check[at] == check), self.known[at].astype(np.int64)

    def _keep(self, names: np.ndarray, check: np.ndarray, counts: np.ndarray) -> None:
        if len(self.names) + len(names) > CACHE:
            self._clear()
        if len(names) <= CACHE:
            at = np.searchsorted(self.names, names)
            if len(self.names):
                fresh = self.names[np.minimum(at, len(self.names) - 1)] != names
                at, names, check, counts = at[fresh], names[fresh], check[fresh], counts[fresh]
            self.names, self.check, self.known = np.insert(self.names, at, names), np.insert(self.check, at, check), np.insert(self.known, at, counts.astype(np.int32))

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Token counts of the texts between offsets; U+2581 is written as a space already."""
        sizes = np.diff(offsets)
        if self.merges.prefix:
            some = sizes > 0
            data = np.insert(data, offsets[:-1][some], 0x20)
            offsets = np.concatenate([[0], np.cumsum(sizes + some)])
        if not len(data):
            return np.zeros(len(sizes), np.int64)
        begin = np.zeros(len(data), bool)
        begin[offsets[:-1][np.diff(offsets) > 0]] = True
        if self.merges.spaced:
            space = data == 0x20
            begin[1:] |= space[1:] & ~space[:-1]
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(data))
        names, check = range_hashes(data, starts, ends, 0), range_hashes(data, starts, ends, 1)
        unique, index, inverse = np.unique(names, return_index=True, return_inverse=True)
        have, counts = self._lookup(unique, check[index])
        new = np.flatnonzero(~have)
        if len(new):
            counts[new] = self.merges.count(data, starts[index[new]], ends[index[new]])
            self._keep(unique[new], check[index[new]], counts[new])
        per = counts[inverse]
        odd = np.flatnonzero(check != check[index][inverse])  # two pre-tokens of one 64-bit name
        if len(odd):
            per[odd] = self.merges.count(data, starts[odd], ends[odd])
        sums = np.concatenate([[0], np.cumsum(per)])
        return np.diff(sums[np.searchsorted(starts, offsets)])


@lru_cache(maxsize=2)
def _counter(file: Shipped) -> Counter:
    return Counter(file.value)


caches(__name__, _counter.cache_clear)


def _batch(counter: Counter, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, tokens) of each text."""
    _, offsets = text_buffers(column)
    size = np.diff(offsets)
    data, offsets = text_buffers(pc.replace_substring(column, SPACE, " ")) if pc.any(pc.match_substring(column, SPACE)).as_py() else text_buffers(column)
    parts = [counter.texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in blocks(offsets, BLOCK)]
    return size, np.concatenate([np.zeros(0, np.int64), *parts])


def count_tokens(docs: DataFrame, model: str, *, text_col: str = "text", keep: list[str] | None = None, bytes_col: str = "n_bytes", tokens_col: str = "n_tokens") -> DataFrame:
    """Adds the UTF-8 bytes and the tokens of each text, by the sentencepiece model in the file ``model``."""
    file = ship(docs.sparkSession, model)
    keep = keep if keep is not None else docs.columns

    def fn(batch):
        size, tokens = _batch(_counter(file), batch.column(batch.schema.get_field_index(text_col)))
        return [pa.array(size, pa.int64()), pa.array(tokens, pa.int64())]

    return map_rows(docs.select(*dict.fromkeys([*keep, text_col])), fn, f"{bytes_col} bigint, {tokens_col} bigint", keep)


def digest(docs: DataFrame, model: str, *, limit: int = 4096, id_col: str = "doc_id") -> DataFrame:
    """The columns of the contract; ``over_limit``: more than ``limit`` tokens."""
    counted = count_tokens(docs.select(F.col(id_col).alias("_id"), F.col("text").alias("_text")), model, text_col="_text", keep=["_id"])
    return counted.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
