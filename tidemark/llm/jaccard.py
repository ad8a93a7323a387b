"""N-gram Jaccard join with PartEnum signatures.

A document's set holds its distinct shingles of ``width`` words.  Sizes fall into bands so narrow that two sets that link
lie in one band or in adjacent ones.  For a band with largest size r, linked sets differ in at most
k = 2r (den - num) / (den + num) elements.  The domain is hashed into n1 groups of n2 partitions with n1 (k2 + 1) > k, so in
some group at most k2 = 1 partitions differ: every way of leaving out one partition of a group gives a signature (a hash of
the elements of the others), and two sets that link share one of them.  Each set is signed for its own band and the next.

Equal sets are one class from the start.  The signatures of a task travel in compact blocks, dealt by the signature: those
that occur once are dropped where they arrive, and groups of the same sets are reduced to one group there.  What is left is a
set of candidates.  A group is never expanded into its pairs: each member is first compared with one centre, links are
contracted to components, and once more with another centre.  What lies apart by then is compared exhaustively, so no link is
lost that would join two components: groups of at most ``SMALL`` sets by a join, larger ones in square blocks of at most
``BLOCK`` by ``BLOCK`` sets.  Every candidate pair meets two exact bounds before a text is read: the sizes, and sketches of
one bit for each of p partitions (whether it holds an odd number of elements), of which at most as many differ as elements
do.  The pairs that pass are verified on their whole texts.

A signature that very many sets share costs at most ``HOT`` rows of a block of sets in the shuffle; its other members are
known to be repeated and go wherever there is room.

Shingles are 64-bit hashes of the words' bytes, sets have 128-bit names.  A null text, or one without words, has an empty set
and links with nothing.  Fewer words than ``width`` are one shingle.  Very long texts are read whole, in bounded pieces of
the rows of a batch (one text is one piece).  Equal rows form one component; rows of one id are one document, which links
where any of its texts with words does.  Ties need no rule: the component is the smallest id.  A null id takes part in no component (its
component is null).  An empty table gives an empty result.  Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, Scratch, few_enough, files_for, map_rows, mix, release, signed, spans, text_blocks, text_buffers, tune, window_hashes, word_hashes, worker_of
from .components import connected_components

WIDTH, THRESHOLD = 3, (90, 100)
#: Partitions of a group and how many of them may differ.
N2, K2 = 3, 1
#: Rounds against centres; then groups of up to SMALL sets are joined, and larger ones compared in blocks.
STARS, SMALL, BLOCK = 2, 8, 512
#: Text behind one bucket of signatures, signatures of a task that are dealt at once, and how many of one signature are dealt.
BUCKET_BYTES, CHUNK, HOT = 64 << 20, 1 << 20, 16
_LOW = np.uint64((1 << 40) - 1)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Bands:
    """Size bands and their number of groups, made as far as sizes go."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.low = num, den, [1]

    def _reach(self, size: int) -> None:
        while self.low[-1] <= size:
            self.low.append(self.low[-1] * self.den // self.num + 1)

    def band(self, sizes: np.ndarray) -> np.ndarray:
        self._reach(int(sizes.max(initial=1)))
        return np.searchsorted(self.low, sizes, "right") - 1

    def groups(self, bands: np.ndarray) -> np.ndarray:
        """n1 of each band; 0 where only equal sets can link."""
        top = int(bands.max(initial=0)) + 1
        while len(self.low) <= top + 1:
            self._reach(self.low[-1])
        most = np.array(self.low[1:]) - 1
        k = 2 * most * (self.den - self.num) // (self.den + self.num)
        return np.where(k > 0, k // (K2 + 1) + 1, 0)[bands]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted distinct shingles of each text."""
    starts, ends, first = spans(data, offsets, NOT_SPACE)
    words = word_hashes(data, starts, ends, lower=True)
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    past = np.cumsum(count)
    at = np.repeat(first[:-1] - past + count, count) + np.arange(past[-1] if len(past) else 0)
    size = np.repeat(np.minimum(n, width), count)
    h = np.zeros(len(at), np.uint64)
    full = size == width
    h[full] = window_hashes(words, width, at[full])
    for short in range(1, width):
        part = size == short
        if part.any():
            h[part] = window_hashes(words, short, at[part])
    bounds = np.concatenate([[0], past])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[bounds[:-1][count > 0]] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def signatures(h: np.ndarray, bounds: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, bounds) of each set."""
    sizes = np.diff(bounds)
    own = bands.band(np.maximum(sizes, 1))
    parts, counts = [], []
    for step in (0, 1):
        band = own + step
        n1 = np.where(sizes > 0, bands.groups(band), 0)
        base = np.concatenate([[0], np.cumsum(n1)])
        doc = np.repeat(np.arange(len(sizes)), np.where(n1 > 0, sizes, 0))
        mine = h if len(doc) == len(h) else h[np.repeat(n1 > 0, sizes)]
        place = (mix(mine + _B) % np.maximum(n1 * N2, 1).astype(np.uint64)[doc]).astype(np.int64) + base[doc] * N2
        v = mix(mine ^ _C)
        total = int(base[-1]) * N2
        low = np.bincount(place, (v & np.uint64(0xFFFFFFFF)).astype(np.float64), total).astype(np.uint64)
        high = np.bincount(place, (v >> np.uint64(32)).astype(np.float64), total).astype(np.uint64)
        sums = (low + (high << np.uint64(32))).reshape(-1, N2)
        group = (np.arange(int(base[-1])) - np.repeat(base[:-1], n1)).astype(np.uint64)
        salt = mix(group * _A + np.repeat(band, n1).astype(np.uint64))
        left_out = [mix(mix(sums[:, (j + 1) % N2] + salt) + sums[:, (j + 2) % N2] * _B + np.uint64(j)) for j in range(N2)]
        parts.append(np.stack(left_out, axis=1).ravel())
        counts.append(n1 * N2)
    # interleave the two bands' signatures document by document
    ends = np.concatenate([[0], np.cumsum(counts[0] + counts[1])])
    out = np.empty(int(ends[-1]), np.uint64)
    for k in (0, 1):
        c = counts[k]
        offset = ends[:-1] + (counts[0] if k else 0)
        past = np.cumsum(c)
        out[np.repeat(offset - past + c, c) + np.arange(len(parts[k]))] = parts[k]
    return out, ends


def _reduce(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def odd_sketches(h: np.ndarray, bounds: np.ndarray, threshold: tuple[int, int]) -> list[bytes]:
    """One bit for each of p partitions: whether a set has an odd number of elements there.  p is a power of two, at least eight
    for each element that linked sets of this size may differ in, so that few differences cancel."""
    num, den = threshold
    n = np.diff(bounds)
    k = 2 * n * (den - num) // (den + num)
    p = np.array([1 << max(9, (8 * x - 1).bit_length()) for x in k.tolist()], np.int64)
    base = np.concatenate([[0], np.cumsum(p)])
    at = (mix(h + _C) & np.repeat(p - 1, n).astype(np.uint64)).astype(np.int64) + np.repeat(base[:-1], n)
    bits = np.packbits((np.bincount(at, minlength=int(base[-1])) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [bits[a // 8 : b // 8] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def _fold(raw: bytes, size: int) -> np.ndarray:
    """The sketch of fewer partitions (``size`` bytes)."""
    return np.bitwise_xor.reduce(np.frombuffer(raw, np.uint8).reshape(-1, size), axis=0)


def set_names(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(bounds).astype(np.uint64)
    return mix(_reduce(mix(h + _A), bounds) + n), mix(_reduce(mix(h ^ _B), bounds) + n)


def describe(docs: DataFrame, *, id_col: str, text_col: str, width: int, threshold: tuple[int, int]) -> DataFrame:
    """Per row: id, n (size of the set), k1 and k2 (its 128-bit name), its sketch."""

    def fn(batch):
        sizes, k1, k2, out = [], [], [], []
        for _, _, data, offsets in text_blocks(batch, text_col):
            h, bounds = shingle_sets(data, offsets, width)
            a, b = set_names(h, bounds)
            sizes.append(np.diff(bounds))
            k1.append(a)
            k2.append(b)
            out += odd_sketches(h, bounds, threshold)
        return [pa.array(np.concatenate(sizes)), pa.array(signed(np.concatenate(k1))), pa.array(signed(np.concatenate(k2))), pa.array(out, pa.binary())]

    return map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), fn, "n bigint, k1 bigint, k2 bigint, sketch binary", ["id"])


# Kinds of entries: one of few with its signature, one of the HOT first of many, one of the rest of many.
_FEW, _MANY, _REST = 0, 1, 2


def _pack(a: np.ndarray) -> bytes:
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _deal(sigs: np.ndarray, refs: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Blocks (p, kind, sigs, refs) of a chunk of signatures; 40 bits of a signature and its bucket name it."""
    order = np.argsort(sigs)
    sigs, refs = sigs[order], refs[order]
    new = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]])) if len(sigs) else np.zeros(0, np.int64)
    size = np.diff(np.append(new, len(sigs)))
    nth = np.arange(len(sigs)) - np.repeat(new, size)
    kind = np.where(np.repeat(size, size) <= HOT, _FEW, np.where(nth < HOT, _MANY, _REST))
    home = (sigs >> np.uint64(40)).astype(np.int64) % buckets
    p = np.where(kind == _REST, (mix(refs) >> np.uint64(40)).astype(np.int64) % buckets, home)
    low = np.where(kind == _REST, sigs, sigs & _LOW)
    order = np.lexsort((kind, p))
    p, kind, low, refs, home = p[order], kind[order], low[order], refs[order], home[order]
    cut = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (kind[1:] != kind[:-1])])) if len(p) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(p))
    first = [_pack(low[a:b] & _LOW) + (home[a:b].astype("<i4").tobytes() if kind[a] == _REST else b"") for a, b in zip(cut.tolist(), ends.tolist(), strict=True)]
    second = [_pack(refs[a:b]) for a, b in zip(cut.tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(p[cut].astype(np.int32)), pa.array(kind[cut].astype(np.int32)), pa.array(first, pa.binary()), pa.array(second, pa.binary())], names=["p", "kind", "sigs", "refs"])


def dealt_signatures(docs: DataFrame, *, text_col: str, width: int, threshold: tuple[int, int], buckets: int) -> DataFrame:
    """The signatures of all rows in blocks; a set that a task has met is signed once there."""
    chunk = min(CHUNK, 2000 * buckets)

    def run(batches):
        worker_of(__name__)
        bands, met, sigs, refs, held = Bands(*threshold), set(), [], [], 0
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch):
                h, bounds = shingle_sets(data, offsets, width)
                n = np.diff(bounds)
                k1, k2 = set_names(h, bounds)
                if len(met) > 500_000:
                    met.clear()
                new = np.zeros(len(n), bool)
                for i, x in enumerate(zip(k1.tolist(), k2.tolist(), strict=True)):
                    if x not in met:
                        met.add(x)
                        new[i] = True
                s, ends = signatures(h[np.repeat(new, n)], np.concatenate([[0], np.cumsum(np.where(new, n, 0))]), bands)
                sigs.append(s)
                refs.append(np.repeat(k1 & _LOW, np.diff(ends)))
                held += len(s)
                if held >= chunk:
                    yield _deal(np.concatenate(sigs), np.concatenate(refs), buckets)
                    sigs, refs, held = [], [], 0
        if held:
            yield _deal(np.concatenate(sigs), np.concatenate(refs), buckets)
        del sigs, refs, met
        release()

    tune(docs.sparkSession)
    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "p int, kind int, sigs binary, refs binary")


def _shared(p: int, kinds: list[int], sigs: list[bytes], refs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(group, ref) of the signatures of a bucket that two sets or more have; groups of the same sets come once."""
    out_g, out_r = [], []
    s, r, many = [], [], []
    for kind, a, b in zip(kinds, sigs, refs, strict=True):
        ref = _unpack(b)
        if kind == _REST:
            n = len(ref)
            home = np.frombuffer(a[5 * n :], "<i4").astype(np.uint64)
            out_g.append(mix(_unpack(a[: 5 * n]) | home << np.uint64(40)))
            out_r.append(ref)
        else:
            s.append(_unpack(a))
            r.append(ref)
            many.append(np.full(len(ref), kind == _MANY))
    if s:
        s, r, many = np.concatenate(s), np.concatenate(r), np.concatenate(many)
        order = np.argsort(s)
        s, r, many = s[order], r[order], many[order]
        again = s[1:] == s[:-1]
        keep = many.copy()
        keep[1:] |= again
        keep[:-1] |= again
        s, r, many = s[keep], r[keep], many[keep]
        order = np.lexsort((r, s))
        s, r, many = s[order], r[order], many[order]
        start = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
        fresh = start.copy()
        fresh[1:] |= r[1:] != r[:-1]
        first = np.flatnonzero(start)
        hot = np.logical_or.reduceat(many, first) if len(first) else many
        s, r, start = s[fresh], r[fresh], start[fresh]  # one copy of a set
        first = np.flatnonzero(start)
        size = np.diff(np.append(first, len(s)))
        name = np.add.reduceat(mix(r + _A), first) if len(first) else s
        name = np.where(hot, mix(s[first] | np.uint64(p) << np.uint64(40)), mix(name + size.astype(np.uint64)))
        one = np.zeros(len(first), bool)
        one[np.unique(name, return_index=True)[1]] = True
        take = np.repeat(one & (hot | (size > 1)), size)
        out_g.append(np.repeat(name, size)[take])
        out_r.append(r[take])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(out_g), np.concatenate(out_r)) if out_g else (none, none)


def shared_signatures(dealt: DataFrame, parts: int) -> DataFrame:
    """(g, ref): groups of sets that share a signature; ``ref`` is 40 bits of the name of a set."""

    def run(batches):
        worker_of(__name__)
        now, held = None, ([], [], [])
        for batch in batches:
            p = batch.column(0).to_numpy()
            columns = [c.to_pylist() for c in batch.columns[1:]]
            for i in range(batch.num_rows):
                if held[0] and p[i] != now:
                    yield answer(now, held)
                    held = ([], [], [])
                now = p[i]
                for x, c in zip(held, columns, strict=True):
                    x.append(c[i])
        if held[0]:
            yield answer(now, held)
        held = None
        release()

    def answer(p, held):
        g, r = _shared(int(p), *held)
        return pa.RecordBatch.from_arrays([pa.array(signed(g)), pa.array(signed(r))], names=["g", "ref"])

    return dealt.repartition(parts, "p").sortWithinPartitions("p").mapInArrow(run, "g bigint, ref bigint")


def verify(pairs: DataFrame, texts: DataFrame, *, width: int, threshold: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of ids with ``linked``: whether their whole sets reach the threshold."""
    num, den = threshold

    def fn(batch):
        da, oa = text_buffers(batch.column(batch.schema.get_field_index("ta")))
        db, ob = text_buffers(batch.column(batch.schema.get_field_index("tb")))
        out = np.zeros(batch.num_rows, bool)
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(oa + ob, oa[i] + ob[i] + (1 << 20), "right")) - 1)
            j = min(j, batch.num_rows)
            ha, ba = shingle_sets(da[oa[i] : oa[j]], oa[i : j + 1] - oa[i], width)
            hb, bb = shingle_sets(db[ob[i] : ob[j]], ob[i : j + 1] - ob[i], width)
            for k in range(j - i):
                x, y = ha[ba[k] : ba[k + 1]], hb[bb[k] : bb[k + 1]]
                both = np.concatenate([x, y])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                out[i + k] = den * common >= num * (len(both) - common) and common > 0
            i = j
        return [pa.array(out)]

    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = texts.join(few_enough(ids), "id", "left_semi").distinct()
    joined = pairs.join(wanted.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(wanted.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return map_rows(joined, fn, "linked boolean", ["a", "b"])


def close_pairs(n: np.ndarray, comp: np.ndarray, side: np.ndarray, raw: list[bytes], threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of pairs of other components, of both sides where there are two, that sketches do not rule out."""
    num, den = threshold
    p = min(map(len, raw))
    table = np.stack([_fold(r, p) for r in raw]).view(np.uint64)
    left, right = [], []
    largest = np.bincount(comp).argmax()  # its sets need no comparing with one another, and meet the others from their side
    place = np.arange(len(n))
    for i in np.flatnonzero(comp != largest).tolist():
        may = (comp != comp[i]) & ((side != side[i]) | (side[i] < 0)) & ((comp == largest) | (place > i))
        may &= np.minimum(n, n[i]) * den >= np.maximum(n, n[i]) * num
        j = np.flatnonzero(may)
        if len(j):
            differ = np.bitwise_count(table[j] ^ table[i]).sum(axis=1, dtype=np.int64)
            j = j[differ * (den + num) <= (n[j] + n[i]) * (den - num)]
            left.append(np.full(len(j), i))
            right.append(j)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def block_pairs(large: DataFrame, sketched: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(a, b) from groups of more than SMALL sets (g, rep, comp, m), compared block against block."""
    parts = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("rep"), parts).cast("int")
    spread = large.withColumns({"parts": parts, "own": own}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    units = spread.select("g", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.when(F.col("own") == F.col("other"), -1).otherwise(F.when(F.col("own") < F.col("other"), 0).otherwise(1)).alias("side"), "rep", "comp")
    rows = units.join(sketched, "rep").select("g", "x", "y", "side", "rep", "comp", "n", "sketch")
    rows = rows.repartition(F.col("g"), F.col("x"), F.col("y")).sortWithinPartitions("g", "x", "y")
    kind = large.schema["rep"].dataType.simpleString()

    def run(batches):
        from itertools import groupby

        worker_of(__name__)

        def solve(group):
            _, _, _, side, rep, comp, n, sketch = zip(*group, strict=True)
            order = {c: k for k, c in enumerate(dict.fromkeys(comp))}
            i, j = close_pairs(np.array(n), np.array([order[c] for c in comp]), np.array(side), list(sketch), threshold)
            found = [(rep[x], rep[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
            return [(max(p), min(p)) for p in found]

        known: set = set()  # a pair comes once for each group it shares; a task passes it on once, as far as it remembers
        stream = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, group in groupby(stream, key=lambda r: r[:3]):  # one unit: at most two blocks
            if pairs := [p for p in dict.fromkeys(solve(group)) if p not in known]:
                if len(known) > 100_000:
                    known.clear()
                known.update(pairs)
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs])], names=["a", "b"])

    return rows.mapInArrow(run, f"a {kind}, b {kind}")


def likely(pairs: DataFrame, nodes: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that neither sizes nor sketches rule out."""
    num, den = threshold

    def run(batches):
        for batch in batches:
            na, sa, nb, sb = (batch.column(k).to_pylist() for k in range(2, 6))
            keep = []
            for x, y, u, v in zip(na, nb, sa, sb, strict=True):
                p = min(len(u), len(v))
                differ = (int.from_bytes(_fold(u, p).tobytes(), "little") ^ int.from_bytes(_fold(v, p).tobytes(), "little")).bit_count()
                keep.append(differ * (den + num) <= (x + y) * (den - num))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = nodes.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = nodes.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    sized = pairs.join(nodes.select(F.col("rep").alias("b"), F.col("n").alias("nb")), "b").join(left, "a").where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    joined = sized.join(right, ["b", "nb"]).select("a", "b", "na", "sa", "nb", "sb")
    kind = nodes.schema["rep"].dataType.simpleString()
    return joined.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def near_duplicate_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.write(describe(docs, id_col=id_col, text_col=text_col, width=width, threshold=threshold), "rows")
    classes = rows.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("id").alias("rep")).where("rep is not null")
    classes = scratch.write(classes, "classes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = files_for(classes.count(), parts)  # a count of the footers
    size = docs.agg(F.sum(F.octet_length(text_col).cast("bigint"))).first()[0] or 0  # one number
    buckets = min(max(2 * parts, size // BUCKET_BYTES), 1 << 24)
    dealt = dealt_signatures(docs.where(F.col(id_col).isNotNull()), text_col=text_col, width=width, threshold=threshold, buckets=buckets)
    groups = shared_signatures(dealt, max(parts, min(buckets, 8192))).distinct()
    named = classes.withColumn("ref", F.col("k1").bitwiseAND(F.lit(int(_LOW))))
    groups = scratch.write(groups.join(named, "ref").select("g", "rep").distinct(), "groups")
    some = files_for(groups.count(), parts)
    wanted = groups.select("rep").distinct().join(classes, "rep")
    nodes = rows.join(wanted, (F.col("id") == F.col("rep")) & (rows["k1"] == wanted["k1"]) & (rows["k2"] == wanted["k2"])).select("rep", rows["n"], "sketch").distinct()
    nodes = scratch.write(nodes, "nodes", min(parts, 2 * few))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")

    torn = rows.where("n > 0").groupBy("id").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("k1", "k2") for f in (F.min, F.max)]).where("min_k1 <> max_k1 or min_k2 <> max_k2").select("id")
    bridges = rows.join(torn, "id").join(classes, ["n", "k1", "k2"]).where("rep <> id").select(F.greatest("rep", "id").alias("a"), F.least("rep", "id").alias("b"))
    bridges = scratch.write(bridges.distinct(), "bridges", few)  # an id with several texts joins their classes
    labels, edges, tested = None, None, None
    if not bridges.isEmpty():
        edges, labels = bridges, connected_components(bridges, scratch, "components-of-ids", few)
    for turn in range(STARS + 1):
        now = groups.withColumn("comp", F.col("rep")) if labels is None else groups.join(labels, F.col("rep") == F.col("node"), "left").select("g", "rep", F.coalesce("component", "rep").alias("comp"))
        order = F.struct((F.lit(0) if turn == 0 else F.xxhash64("rep", F.lit(turn))).alias("o"), "rep", "comp")
        per_group = now.groupBy("g").agg(F.min(order).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi")
        apart = scratch.write(now.join(per_group.select("g", F.col("c.rep").alias("centre"), F.col("c.comp").alias("home"), "m"), "g"), f"open-{turn}", some)
        if apart.isEmpty():
            break
        if turn < STARS:  # every set that lies apart from a centre, against one centre
            one = apart.where("comp <> home").groupBy("rep").agg(F.min_by("centre", F.struct((F.lit(0) if turn == 0 else F.xxhash64("centre", F.lit(turn))).alias("o"), "centre")).alias("centre"))
            pairs = one.select(F.greatest("rep", "centre").alias("a"), F.least("rep", "centre").alias("b"))
        else:  # all pairs that share a signature and lie apart
            small = apart.where(F.col("m") <= SMALL)
            x, y = small.select("g", F.col("rep").alias("a"), F.col("comp").alias("ca")), small.select("g", F.col("rep").alias("b"), F.col("comp").alias("cb"))
            pairs = x.join(y, "g").where("ca <> cb and a > b").select("a", "b")
            pairs = pairs.unionAll(block_pairs(apart.where(F.col("m") > SMALL).select("g", "rep", "comp", "m"), nodes, threshold))
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        near = scratch.write(likely(pairs, nodes, threshold), f"near-{turn}", few)
        done = scratch.write(verify(near, own, width=width, threshold=threshold), f"verified-{turn}", few)
        tested = done.select("a", "b") if tested is None else tested.unionAll(done.select("a", "b"))
        links = done.groupBy("a", "b").agg(F.max("linked").alias("linked")).where("linked").select("a", "b")
        edges = links if edges is None else edges.unionAll(links)
        labels = connected_components(edges, scratch, f"components-{turn}", few)
        scratch.drop(f"open-{turn}")

    found = classes if labels is None else classes.join(labels, F.col("rep") == F.col("node"), "left").select("n", "k1", "k2", F.coalesce("component", "rep").alias("rep"))
    out = rows.select("id", "n", "k1", "k2").join(found.withColumnRenamed("rep", "found"), ["n", "k1", "k2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("found", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """The documents whose id is the smallest of their component, with all columns; a null id stays, repeated rows of a kept id
    stay too."""
    found = near_duplicate_components(docs, id_col=id_col, text_col=text_col, width=width, threshold=threshold)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
