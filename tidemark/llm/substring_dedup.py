"""Substring dedup over words with difference-cover anchors.

Windows of ``window`` words that occur twice or more are removed wherever they are.  D is a difference cover modulo v: any
two positions have a shift below v that takes both into D.  Hashes of v - 1 words fewer than a window (anchors) are taken
at positions of D alone; two equal windows then hold an equal anchor at one shift.  The method runs in two counts:

1. anchors: a window all of whose anchors occur once is ruled out;
2. extension: the windows left, those around a repeated anchor, are hashed whole and counted.

Counting is an aggregation that combines before the shuffle, so a passage that a third of all rows share costs one row per
task.  A key counted once carries its only place with it, so what returns to a document are its unique anchors and its
unique windows, never the occurrences of a frequent one, and no group is ever gathered.

The extension works on hashes of the words of whole windows, never on pairs of occurrences: a passage that m rows share would
have m squared of them.  Window hashes have 128 bits, anchors 64 (an anchor only nominates).  Documents are named by 95 bits
of hashes of id and text.

Whole texts are read, very long ones too (in memory a few times the text); null texts and texts without words lose nothing.
Repeated rows are each other's copies, so both lose what they share.  Ties need no rule: every copy goes.  An empty table gives
an empty result.  Of the input, columns that carry the names of added ones are replaced by ``dedup_substrings``;
``drop_repeats`` returns all columns of its input, whatever they are called.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, Scratch, map_rows, signed, spans, text_blocks, text_buffers, to_numpy, window_hashes, word_hashes, worker_of

WINDOW = 35
# Perfect difference sets by modulus.
COVERS = {3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27), 57: (0, 1, 6, 15, 22, 26, 45, 55)}


def cover_for(window: int) -> tuple[int, np.ndarray]:
    """(v, membership modulo v): the largest modulus that leaves anchors of at least two fifths of a window."""
    v = max((v for v in COVERS if window - v + 1 >= max(1, 2 * window // 5)), default=1)
    member = np.zeros(v, bool)
    member[list(COVERS.get(v, (0,)))] = True
    return v, member


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple:
    """(starts, ends, first word of each row, word's place in its row, words from it to the row's end)."""
    starts, ends, first = spans(data, offsets, NOT_SPACE)
    n = np.diff(first)
    place = np.arange(len(starts)) - np.repeat(first[:-1], n)
    return starts, ends, first, place, np.repeat(n, n) - place


def anchor_rows(keyed: DataFrame, window: int) -> DataFrame:
    """(h, k, q): hash, document and place of every anchor; q has the second part of the document's name above 32 bits."""
    v, member = cover_for(window)
    width = window - v + 1

    def run(batches):
        worker_of(__name__)
        for batch in batches:
            keys, more = to_numpy(batch, "k"), to_numpy(batch, "kk").astype(np.int64) << 32
            for i, _, data, offsets in text_blocks(batch):
                starts, ends, first, place, left = _words(data, offsets)
                at = np.flatnonzero(member[place % v] & (left >= width) & (left + place >= window))
                h = window_hashes(word_hashes(data, starts, ends), width, at)
                doc = np.searchsorted(first, at, "right") - 1 + i
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(keys[doc]), pa.array(more[doc] | place[at])], names=["h", "k", "q"])

    return keyed.select("k", "kk", "text").mapInArrow(run, "h bigint, k bigint, q bigint")


def name_of(id_col: str, text_col: str) -> tuple:
    """Columns k (64 bits) and kk (31 bits) that name a document by its id and text."""
    second = F.shiftrightunsigned(F.xxhash64(F.lit("second"), id_col, text_col), 33).cast("int")
    return F.xxhash64(id_col, text_col).alias("k"), second.alias("kk")


def counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each key with the number c of its occurrences and, if it has one alone, its document and place."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.min("k").alias("k"), F.min("q").alias("q"))


def lonely(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(k, kk, places): for each document the places whose key occurs nowhere else."""
    alone = counted(rows, keys).where("c = 1").select("k", F.shiftright("q", 32).cast("int").alias("kk"), F.col("q").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("p"))
    return alone.groupBy("k", "kk").agg(F.collect_list("p").alias("places"))


def _candidates(place: np.ndarray, left: np.ndarray, first: np.ndarray, lone: np.ndarray, member: np.ndarray, v: int, window: int) -> np.ndarray:
    """Words that start a window with a repeated anchor; ``lone`` marks the words where a lonely one starts."""
    bad = np.concatenate([[0], np.cumsum(lone)])
    at = np.flatnonzero(left >= window)
    return at[bad[at + v] - bad[at] < member.sum()]


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(batch.schema.get_field_index(name))
    sizes = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


def _marked(n: int, first: np.ndarray, values: np.ndarray, bounds: np.ndarray, i: int, j: int) -> np.ndarray:
    out = np.zeros(n, bool)
    own = values[bounds[i] : bounds[j]]
    out[own + np.repeat(first[:-1], np.diff(bounds[i : j + 1]))] = True
    return out


def candidates(keyed: DataFrame, window: int) -> DataFrame:
    """Adds n_words, and for documents with candidate windows: starts (places) and the two parts of their hashes."""
    v, member = cover_for(window)

    def fn(batch):
        values, bounds = _lists(batch, "places")
        n_words, sizes, starts_out, w1, w2 = [], [], [], [], []
        for i, j, data, offsets in text_blocks(batch):
            starts, ends, first, place, left = _words(data, offsets)
            lone = _marked(len(starts), first, values, bounds, i, j)
            at = _candidates(place, left, first, lone, member, v, window)
            n_words.append(np.diff(first))
            sizes.append(np.diff(np.searchsorted(at, first)))
            starts_out.append(place[at].astype(np.int32))
            w1.append(signed(window_hashes(word_hashes(data, starts, ends), window, at)))
            w2.append(signed(window_hashes(word_hashes(data, starts, ends, 1), window, at, 1)))
        ends_out = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends_out, pa.array(np.concatenate(x))) for x in (starts_out, w1, w2)]
        return [pa.array(np.concatenate(n_words)), *lists]

    keep = [c for c in keyed.columns if c != "places"]
    return map_rows(keyed, fn, "n_words bigint, starts array<int>, w1 array<bigint>, w2 array<bigint>", keep)


def remove(marked: DataFrame, window: int, keep: list[str]) -> DataFrame:
    """Adds n_removed, kept_text (kept words joined by a space) and removed (maximal runs of removed words)."""

    def fn(batch):
        starts, bounds = _lists(batch, "starts")
        lone, lone_bounds = _lists(batch, "places")
        data, offsets = text_buffers(batch.column(batch.schema.get_field_index("text")))
        raw = data.tobytes()
        n_removed, kept, runs = [], [], []
        for d in range(batch.num_rows):
            words = raw[offsets[d] : offsets[d + 1]].split()  # bytes.split() parts at \x20 and \x09-\x0D alone
            own = starts[bounds[d] : bounds[d + 1]]
            gone = lone[lone_bounds[d] : lone_bounds[d + 1]]
            own = own[~np.isin(own, gone)] if len(gone) else own
            if not len(own):
                n_removed.append(0)
                kept.append(b" ".join(words).decode())
                runs.append([])
                continue
            edge = np.zeros(len(words) + 1, np.int32)
            np.add.at(edge, own, 1)
            np.add.at(edge, own + window, -1)
            out = np.cumsum(edge[:-1]) > 0
            n_removed.append(int(out.sum()))
            kept.append(b" ".join(compress(words, (~out).tolist())).decode())
            change = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))
            runs.append([{"first": int(a), "past": int(b)} for a, b in zip(change[::2], change[1::2], strict=True)])
        return [pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(runs, pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())])))]

    return map_rows(marked, fn, "n_removed bigint, kept_text string, removed array<struct<first: int, past: int>>", keep)


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """Per row: the ``keep`` columns (default: the id), n_words, n_removed, kept_text, removed.

    Columns of the input that carry the names of added ones are replaced.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    keep = keep or [id_col]
    carried = F.struct(F.lit(0).alias("none"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep) if c != text_col]).alias("carried")
    keyed = docs.select(carried, *name_of(id_col, text_col), F.col(text_col).alias("text"))
    anchors = scratch.write(lonely(anchor_rows(keyed, window), ["h"]), "anchors")
    found = scratch.write(candidates(keyed.join(anchors, ["k", "kk"], "left"), window), "candidates")
    scratch.drop("anchors")
    windows = found.where("size(starts) > 0").select("k", "kk", F.explode(F.arrays_zip("w1", "w2", "starts")).alias("e"))
    place = F.shiftleft(F.col("kk").cast("bigint"), 32).bitwiseOR(F.col("e.starts").cast("bigint"))
    unique = scratch.write(lonely(windows.select("k", place.alias("q"), "e.w1", "e.w2"), ["w1", "w2"]), "unique")
    has = found.where("size(starts) > 0").join(unique, ["k", "kk"], "left").select("carried", "text", "n_words", "starts", "places")
    none = found.where("size(starts) = 0").select("carried", "text", "n_words", "starts", F.lit(None).cast("array<int>").alias("places"))
    out = remove(has.unionByName(none), window, ["carried", "n_words", *(["text"] if text_col in keep else [])])
    added = ["n_words", "n_removed", "kept_text", "removed"]
    return out.select(*[F.col("text" if c == text_col else f"carried.c{i}").alias(c) for i, c in enumerate(keep) if c not in added], *added)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Documents with their repeated passages removed, all columns; a text that loses nothing stays byte for byte, and a
    document that loses every word goes.  A column ``n_chars`` follows the new text."""
    names = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(c).alias(n) for c, n in names.items()])
    found = dedup_substrings(plain, id_col=names[id_col], text_col=names[text_col], window=window, keep=list(names.values()))
    found = found.where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(names[text_col]))
    columns = {c: F.col(n) for c, n in names.items()} | {text_col: text}
    if "n_chars" in names:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(names["n_chars"]))
    return found.select(*[columns[c].alias(c) for c in docs.columns])
