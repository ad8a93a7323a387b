"""Exact byte-substring dedup with suffix arrays sorted in two stages.

A string of ``length`` bytes that also starts earlier is removed where it starts again; earlier means a smaller document id,
or the same document and an earlier start.  Equal strings have equal minimizers (the leftmost gram of least hash among
their grams), so the strings of a document fall into segments that share one place of a minimizer:

1. minimizers are counted; a segment whose minimizer occurs once holds no repeated string;
2. equal segments are reduced to their first occurrence by an aggregation that combines before the shuffle, so copies never
   meet in one task; every later occurrence is repeated as a whole;
3. first occurrences meet by minimizer, as long as it is not hot (more than ``HOT`` segments in all); blocks of them get a suffix array: suffixes smaller than their successors are
   sorted directly, the rest is induced by scanning the buckets from left to right, and adjacent common prefixes of at least
   ``length`` bytes give the classes of equal strings, of which all but the first are repeated.

4. the strings of segments with a hot minimizer never meet in one task: they are counted by hash, again by an aggregation
   that combines before the shuffle, and each string has one first occurrence.

What returns to a document is its unique segments and, for segments that occur first in it, the strings that are repeated (or,
with a hot minimizer, those that are first).  Segments and counted strings are named by 128 bits, documents by 95.

Whole texts are read as UTF-8, very long ones too (in memory a few times the text); null counts as empty; matches never cross
rows.  Repeated rows of one id and one text are one document, of which no row is an earlier copy of the other; rows of one id
with different texts are ordered by a hash; a null id comes first.  Ties of minimizers go to the leftmost gram, in every copy
alike.  An empty table gives an empty result.  Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, eights, few_enough, map_rows, mix, range_hashes, signed, text_blocks, text_buffers, to_numpy, worker_of
from .substring_dedup import _lists, counted, name_of

LENGTH, GRAM = 100, 32
#: Bytes of segments that share one suffix array, and of text that one scan for minimizers covers (20-bit places).
SORT_BYTES, SCAN_BYTES = 2 << 20, 1 << 19
#: Segments of one minimizer, copies included, that may meet in one task.
HOT = 20_000
_LOW = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[bool, np.ndarray] = {}


def _powers(inverse: bool, n: int) -> np.ndarray:
    have = _POWERS.get(inverse)
    if have is None or len(have) < n:
        steps = np.full(1 << max(12, int(n - 1).bit_length()), pow(_BASE, -1, 1 << 64) if inverse else _BASE, np.uint64)
        steps[0] = 1
        have = _POWERS[inverse] = np.multiply.accumulate(steps)  # of at most 2 * SCAN_BYTES
    return have[:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A rolling hash of every gram; it chooses minimizers and nominates, and never decides that strings are equal."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * _powers(False, n), out=sums[1:])
    return mix((sums[gram:] - sums[:-gram]) * _powers(True, n + 1)[: n - gram + 1])


# ---------------------------------------------------------------- suffix array


def sort_directly(data: np.ndarray, which: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes ``which`` by their first ``depth`` bytes, eight at a time within the ties that are left."""
    words = eights(data, True)
    key = words[which].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    which, key = which[order], key[order]
    new = np.ones(len(which), bool)
    new[1:] = key[1:] != key[:-1]
    for at in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        group = np.cumsum(new)[where]
        sub = which[where]
        key = words[np.minimum(sub + at, len(data))].astype(np.uint64)
        order = np.lexsort((key, group))
        which[where], key = sub[order], key[order]
        change = np.ones(len(where), bool)
        change[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        new[where] = change
    return which


def suffix_array(data: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes (default: whole), sorted in two stages."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    depth = depth or n
    run_end = np.append(np.flatnonzero(data[1:] != data[:-1]) + 1, n)  # where each run of equal bytes ends
    follow = np.concatenate([data, [0]])[run_end].astype(np.int16)
    follow[-1] = -1  # the end is smaller than any byte
    lengths = np.diff(np.concatenate([[0], run_end]))
    smaller = np.repeat(follow, lengths) > data  # smaller than its successor
    direct = sort_directly(data, np.flatnonzero(smaller), depth)
    cuts = np.searchsorted(data[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[data[n - 1]].append(np.array([n - 1], np.int64))
    out = []
    for c in range(256):
        own = direct[cuts[c] : cuts[c + 1]]
        parts = waiting[c]
        if not parts and not len(own):
            continue
        wave = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        waves = []
        while len(wave):  # predecessors with the same byte follow in this bucket
            waves.append(wave)
            wave = wave[wave > 0] - 1
            wave = wave[data[wave] == c]
        bucket = np.concatenate([*waves, own])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        ahead = data[before]
        pick = ahead > c
        before, ahead = before[pick], ahead[pick]
        if len(before):
            order = np.argsort(ahead, kind="stable")
            before, ahead = before[order], ahead[order]
            edges = np.flatnonzero(np.concatenate([[True], ahead[1:] != ahead[:-1], [True]]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                waiting[ahead[a]].append(before[a:b])
    return np.concatenate(out)


def common_prefixes(data: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Bytes that each suffix of ``order`` shares with the one before it, at most ``cap``; the first has 0."""
    words = eights(data)
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for at in range(0, cap, 8):
        if not len(live):
            break
        differ = words[np.minimum(order[live] + at, len(data))] ^ words[np.minimum(order[live - 1] + at, len(data))]
        low = differ & (~differ + np.uint64(1))
        same = differ == 0
        out[live] += np.where(same, 8, np.log2(np.where(same, 1, low).astype(np.float64)).astype(np.int64) // 8)
        live = live[same]
    room = len(data) - np.maximum(order[1:], order[:-1])
    out[1:] = np.minimum(np.minimum(out[1:], cap), room)
    return out


# ---------------------------------------------------------------- segments


def _scan(data: np.ndarray, valid: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first string, number of strings, hash of the minimizer) of each segment; ``valid`` marks starts of strings."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = gram_hashes(data, gram)
    key = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    width, have = length - gram + 1, 1
    least = key
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    valid = valid[: n - length + 1]
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    starts = np.flatnonzero(new)
    ends = valid.copy()
    ends[:-1] &= (least[1:] != least[:-1]) | ~valid[1:]
    return starts, np.flatnonzero(ends) + 1 - starts, grams[(least[starts] & _LOW).astype(np.int64)]


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first string as a place in the row, number of strings, hash of the minimizer) of the segments of a block."""
    parts = []
    valid = np.zeros(len(data) + 1, bool)
    sizes = np.diff(offsets)
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, offsets[:-1][sizes >= length], 1)
    np.add.at(edge, (offsets[1:] - length + 1)[sizes >= length], -1)
    valid = np.cumsum(edge[:-1]) > 0
    for a in range(0, max(len(data) - length + 1, 0), SCAN_BYTES if len(data) > 2 * SCAN_BYTES else len(data)):
        b = a + (SCAN_BYTES if len(data) > 2 * SCAN_BYTES else len(data))
        s, c, h = _scan(data[a : b + length - 1], valid[a : b + length - 1], length, gram)
        parts.append((s + a, c, h))
    if not parts:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    starts, counts, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    rows = np.searchsorted(offsets, starts, "right") - 1
    return rows, starts - offsets[rows], counts, hashes


def minimizer_rows(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        worker_of(__name__)
        for batch in batches:
            keys, more = to_numpy(batch, "k"), to_numpy(batch, "kk").astype(np.int64) << 32
            for i, _, data, offsets in text_blocks(batch):
                rows, places, _, hashes = segments(data, offsets, length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(signed(hashes)), pa.array(keys[rows + i]), pa.array(more[rows + i] | places)], names=["h", "k", "q"])

    return keyed.select("k", "kk", "text").mapInArrow(run, "h bigint, k bigint, q bigint")


def judged_minimizers(rows: DataFrame) -> DataFrame:
    """(hot, k, kk, places): the places of minimizers that occur once, for each document; and a row for each hot one (in k)."""
    many = F.col("c") > HOT
    kept = counted(rows, ["h"]).where((F.col("c") == 1) | many)
    parts = kept.select(many.alias("hot"), F.when(many, F.col("h")).otherwise(F.col("k")).alias("k"), F.when(many, 0).otherwise(F.shiftright("q", 32)).cast("int").alias("kk"), F.col("q").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("p"))
    return parts.groupBy("hot", "k", "kk").agg(F.collect_list("p").alias("places"))


def shared_segments(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """Adds to each row the segments whose minimizer is not alone: starts, counts, hashes."""

    def fn(batch):
        values, bounds = _lists(batch, "places")
        sizes, out = [], [[], [], []]
        for i, j, data, offsets in text_blocks(batch):
            rows, places, counts, hashes = segments(data, offsets, length, gram)
            lone = np.zeros(len(data) + 1, bool)
            own = values[bounds[i] : bounds[j]]
            lone[own + np.repeat(offsets[:-1], np.diff(bounds[i : j + 1]))] = True
            keep = ~lone[places + offsets[rows]]
            sizes.append(np.bincount(rows[keep], minlength=j - i))
            for x, y in zip(out, (places.astype(np.int32), counts.astype(np.int32), signed(hashes)), strict=True):
                x.append(y[keep])
        ends = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32))
        return [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in out]

    return map_rows(keyed, fn, "starts array<int>, counts array<int>, hashes array<bigint>", [c for c in keyed.columns if c != "places"])


def segment_rows(found: DataFrame, length: int) -> DataFrame:
    """One row per shared segment: h, c1 and c2 (name of its bytes), id, k, kk, p, body."""
    from pyspark.sql.types import StructType

    kind = found.schema["id"]

    def run(batches):
        worker_of(__name__)
        for batch in batches:
            starts, bounds = _lists(batch, "starts")
            counts, _ = _lists(batch, "counts")
            hashes, _ = _lists(batch, "hashes")
            if not len(starts):
                continue
            data, offsets = text_buffers(batch.column(batch.schema.get_field_index("text")))
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            a = starts + offsets[row]
            b = a + counts + length - 1
            c1, c2 = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
            for lo in range(0, len(a), 20_000):  # a few MB of text at a time
                hi = min(lo + 20_000, len(a))
                x, y = a[lo], b[lo:hi].max()
                part = data[x:y]
                c1[lo:hi] = range_hashes(part, a[lo:hi] - x, b[lo:hi] - x)
                c2[lo:hi] = range_hashes(part, a[lo:hi] - x, b[lo:hi] - x, 1)
            raw = data.tobytes()
            body = pa.array([raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())
            ids = batch.column(batch.schema.get_field_index("id")).take(pa.array(row))
            keys, more = (batch.column(batch.schema.get_field_index(c)).take(pa.array(row)) for c in ("k", "kk"))
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(signed(c1)), pa.array(signed(c2)), ids, keys, more, pa.array(starts.astype(np.int32)), body], names=["h", "c1", "c2", "id", "k", "kk", "p", "body"])

    schema = StructType([*StructType.fromDDL("h bigint, c1 bigint, c2 bigint"), kind, *StructType.fromDDL("k bigint, kk int, p int, body binary")])
    return found.select("id", "k", "kk", "text", "starts", "counts", "hashes").mapInArrow(run, schema)


def repeated_in_block(bodies: list[bytes], docs: np.ndarray, places: np.ndarray, length: int) -> list[np.ndarray]:
    """For each segment the offsets of its strings that start earlier too: in another segment of the block."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.array([len(b) for b in bodies], np.int64)
    begin = np.cumsum(sizes) - sizes
    order = suffix_array(data, length + 8)
    owner = np.repeat(np.arange(len(bodies)), sizes)
    inside = order - begin[owner[order]] + length <= sizes[owner[order]]  # whole strings of one segment
    order = order[inside]
    new = common_prefixes(data, order, length) < length
    groups = np.flatnonzero(new)
    when = (docs[owner[order]].astype(np.int64) << 32) + places[owner[order]] + order - begin[owner[order]]
    first = np.repeat(np.minimum.reduceat(when, groups), np.diff(np.append(groups, len(order)))) if len(order) else when
    again = np.sort(order[when != first])
    cuts = np.searchsorted(again, np.append(begin, len(data)))
    return [again[a:b] - s for a, b, s in zip(cuts[:-1], cuts[1:], begin, strict=True)]


def first_occurrences(distinct: DataFrame, length: int) -> DataFrame:
    """(k, kk, p, strings): the repeated strings of each segment that is the first of its bytes."""
    names = ("h", "id", "k", "kk", "p", "body")

    def solve(rows):
        own = list(zip(rows["id"], rows["k"], rows["kk"], strict=True))
        rank = {t: n for n, t in enumerate(sorted(set(own), key=lambda t: (t[0] is not None, t[0] if t[0] is not None else 0, t[1], t[2])))}
        docs = np.array([rank[t] for t in own], np.int64)
        _, group, size = np.unique(np.array(rows["h"], np.int64), return_inverse=True, return_counts=True)
        met = np.flatnonzero(size[group] > 1)  # strings of one segment differ, so a segment alone needs no sorting
        again = [np.zeros(0, np.int64)] * len(docs)
        if len(met):
            found = repeated_in_block([rows["body"][i] for i in met], docs[met], np.array(rows["p"], np.int64)[met], length)
            for i, x in zip(met.tolist(), found, strict=True):
                again[i] = x
        ends = np.concatenate([[0], np.cumsum([len(x) for x in again])]).astype(np.int32)
        values = np.concatenate(again).astype(np.int32) if again else np.zeros(0, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(rows["k"], pa.int64()), pa.array(rows["kk"], pa.int32()), pa.array(rows["p"], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["k", "kk", "p", "strings"])

    def run(batches):
        worker_of(__name__)
        held, size = {n: [] for n in names}, 0
        for batch in batches:
            for row in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True):
                if size >= SORT_BYTES and row[0] != held["h"][-1]:  # a minimizer's segments stay together
                    yield solve(held)
                    held, size = {n: [] for n in names}, 0
                for n, x in zip(names, row, strict=True):
                    held[n].append(x)
                size += len(row[-1])
        if size:
            yield solve(held)

    return distinct.select(*names).mapInArrow(run, "k bigint, kk int, p int, strings array<int>")


def counted_strings(distinct: DataFrame, length: int) -> DataFrame:
    """(k, kk, p, strings): the strings of each segment that occur first in it, found by counting; for hot minimizers."""
    from pyspark.sql.types import StructType

    schema = StructType([*StructType.fromDDL("s1 bigint, s2 bigint"), distinct.schema["id"], *StructType.fromDDL("k bigint, kk int, p int, o int")])

    def run(batches):
        worker_of(__name__)
        for batch in batches:
            data, offsets = text_buffers(batch.column(batch.schema.get_field_index("body")))
            count = np.diff(offsets) - length + 1
            row = np.repeat(np.arange(batch.num_rows), count)
            o = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            for lo in range(0, len(row), 50_000):
                r, at = row[lo : lo + 50_000], o[lo : lo + 50_000]
                a = offsets[r] + at
                s = [pa.array(signed(range_hashes(data[a[0] : a[-1] + length], a - a[0], a - a[0] + length, which))) for which in (0, 1)]
                own = [batch.column(batch.schema.get_field_index(c)).take(pa.array(r)) for c in ("id", "k", "kk", "p")]
                yield pa.RecordBatch.from_arrays([*s, *own, pa.array(at.astype(np.int32))], names=schema.names)

    strings = distinct.select("id", "k", "kk", "p", "body").mapInArrow(run, schema)
    place = F.struct("id", "k", "kk", (F.col("p") + F.col("o")).alias("at"), "p", "o")
    first = strings.groupBy("s1", "s2").agg(F.min(place).alias("f")).select("f.k", "f.kk", "f.p", "f.o")
    return first.groupBy("k", "kk", "p").agg(F.collect_list("o").alias("strings"))


def remove(marked: DataFrame, length: int, keep: list[str]) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans and kept (the bytes that stay)."""

    def fn(batch):
        starts, bounds = _lists(batch, "starts")
        counts, _ = _lists(batch, "counts")
        first = batch.column(batch.schema.get_field_index("firsts")).to_pylist()
        data, offsets = text_buffers(batch.column(batch.schema.get_field_index("text")))
        sizes, removed, spans, kept = np.diff(offsets), [], [], []
        for d in range(batch.num_rows):
            own = data[offsets[d] : offsets[d + 1]]
            s, c = starts[bounds[d] : bounds[d + 1]], counts[bounds[d] : bounds[d + 1]]
            edge = np.zeros(len(own) + 1, np.int32)
            if first[d]:
                here = np.isin(s, [x["p"] for x in first[d]])
                strings = dict(zip(s.tolist(), c.tolist(), strict=True))
                again = np.array([x["p"] + y for x in first[d] for y in (sorted(set(range(strings[x["p"]])) - set(x["strings"])) if x["hot"] else x["strings"])], np.int64)
                np.add.at(edge, again, 1)
                np.add.at(edge, again + length, -1)
                s, c = s[~here], c[~here]
            if not len(s) and not first[d]:
                removed.append(0)
                spans.append(0)
                kept.append(own.tobytes())
                continue
            np.add.at(edge, s, 1)
            np.add.at(edge, s + c + length - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            removed.append(int(gone.sum()))
            spans.append(int((gone[1:] & ~gone[:-1]).sum() + (len(gone) > 0 and gone[0])))
            kept.append(own[~gone].tobytes())
        return [pa.array(sizes), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())]

    return map_rows(marked, fn, "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary", keep)


def dedup_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept (binary)."""
    scratch = Scratch(docs.sparkSession)
    keyed = docs.select(F.col(id_col).alias("id"), *name_of(id_col, text_col), F.col(text_col).alias("text"))
    judged = scratch.write(judged_minimizers(minimizer_rows(keyed, length, gram)), "judged")
    alone, hot = judged.where("not hot").drop("hot"), judged.where("hot").select(F.col("k").alias("h"))
    found = scratch.write(shared_segments(keyed.join(alone, ["k", "kk"], "left"), length, gram), "found")
    at = F.min(F.struct("id", "k", "kk", "p")).alias("at")
    distinct = segment_rows(found, length).groupBy("h", "c1", "c2").agg(at, F.first("body").alias("body")).select("h", "at.*", "body")
    cold = distinct = scratch.write(distinct, "distinct")
    some = not hot.isEmpty()
    if some:
        named = few_enough(hot)
        cold = distinct.join(named, "h", "left_anti")
    solved = first_occurrences(cold.repartition(F.col("h")).sortWithinPartitions("h"), length).withColumn("hot", F.lit(False))
    if some:
        solved = solved.unionByName(counted_strings(distinct.join(named, "h", "left_semi"), length).withColumn("hot", F.lit(True)))
    firsts = scratch.write(solved.groupBy("k", "kk").agg(F.collect_list(F.struct("p", "strings", "hot")).alias("firsts")), "firsts")
    scratch.drop("judged")
    scratch.drop("distinct")
    touched = found.where("size(starts) > 0").join(firsts, ["k", "kk"], "left").select("id", "text", "starts", "counts", "firsts")
    clean = found.where("size(starts) = 0").select("id", "text", "starts", "counts", F.lit(None).cast(firsts.schema["firsts"].dataType).alias("firsts"))
    out = remove(touched.unionByName(clean), length, ["id"])
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
