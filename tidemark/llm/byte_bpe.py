"""Byte-level BPE through sentencepiece: the vocabulary itself becomes a sentencepiece BPE model.

A vocabulary file in rank order gives the pieces: each byte is written as one printable character, the score of a piece
is its negative rank, so that the merge of highest score is the merge of lowest rank, and ids equal ranks.  Normalisation
is the identity: no dummy prefix, no white-space folding or escaping.  A text is cut into pre-tokens by the pattern of
the tokenizer, each pre-token is encoded by itself, and ids are decoded by the inverse mapping of pieces to bytes.

Nothing is trained.  The same run of pre-tokens has the same ids everywhere, so each worker keeps the runs it has met: those of at
most ``KEPT`` characters, in two generations of at most ``CACHE`` bytes each; longer runs are encoded each time.  By the pattern ``SPACED`` a space before a character that is not white space always begins a pre-token, and
what is left of it and right of it splits alike alone and together; so with that pattern the runs are what lies between such
spaces, and only runs that are new pass the pattern and the model.  With any other pattern a run is one pre-token.

Null and empty texts have no ids; whole texts are encoded, very long ones and very long pre-tokens too; equal rows give equal
results, and there are no ties to break (ranks differ).  An empty table gives an empty result.  An input column with the name
of an added one (``ids``, ``decoded``) is replaced by ``encode`` and ``decode``; ``digest`` and ``round_trip`` read the id, the
columns to keep and the text alone.
"""

from __future__ import annotations

import base64
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shipped, caches, map_rows, ship

#: Bytes of a generation of kept runs with their ids, and characters of a run that may be kept.
CACHE, KEPT = 40 << 20, 64
#: What a kept run takes besides its characters and ids: two objects and a place in a dictionary.
ENTRY = 220
# Fixed value: the pattern of the tokenizers whose spaces are known to part pre-tokens.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PARTING, _OTHER = re.compile(r" (?=\S)"), re.compile(r" (?:\s|\Z)")


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where it is printable Latin-1, else the next from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def read_ranks(lines) -> list[bytes]:
    """Pieces in rank order from lines of base64 piece and rank; ranks must be 0, 1, 2, ..."""
    pairs = sorted((int(rank), base64.b64decode(piece)) for piece, rank in (x.split() for x in lines if x.strip()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must count from 0 without gaps")
    return [p for _, p in pairs]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, (bytes, str)):
        raw = value.encode() if isinstance(value, str) else value
        return _varint(number << 3 | 2) + _varint(len(raw)) + raw
    return _varint(number << 3) + _varint(int(value))


# Fixed values of the sentencepiece model format (field numbers and enumerations).
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, TYPE, NORMAL, UNKNOWN = 1, 2, 3, 1, 2
MODEL_TYPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID, BPE = 3, 4, 40, 41, 42, 43, 2
NAME, CHARSMAP, DUMMY_PREFIX, EXTRA_WHITESPACE, ESCAPE_WHITESPACE = 1, 2, 3, 4, 5


def serialise(pieces: list[bytes]) -> bytes:
    """The model file of a vocabulary; one more id, after the last, stands for what is unknown and is never produced."""
    chars = byte_characters()
    out = [_field(PIECES, _field(PIECE, "".join(chars[b] for b in p)) + _field(SCORE, -float(rank)) + _field(TYPE, NORMAL)) for rank, p in enumerate(pieces)]
    out.append(_field(PIECES, _field(PIECE, "<unk>") + _field(SCORE, 0.0) + _field(TYPE, UNKNOWN)))
    out.append(_field(TRAINER, _field(MODEL_TYPE, BPE) + _field(VOCAB_SIZE, len(pieces) + 1) + _field(UNK_ID, len(pieces)) + _field(BOS_ID, -1) + _field(EOS_ID, -1) + _field(PAD_ID, -1)))
    out.append(_field(NORMALIZER, _field(NAME, "identity") + _field(CHARSMAP, b"") + _field(DUMMY_PREFIX, 0) + _field(EXTRA_WHITESPACE, 0) + _field(ESCAPE_WHITESPACE, 0)))
    return b"".join(out)


class ByteBPE:
    def __init__(self, pieces: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.split = regex.compile(pattern).findall
        self.spaced = pattern == SPACED
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(pieces))
        self.map = byte_characters()
        self.ids: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.held = 0  # bytes of ids

    def _runs(self, text: str) -> list[str]:
        """Runs of pre-tokens; with ``spaced``, the space before a run is left out of all but the first."""
        if not self.spaced:
            return self.split(text)
        return _PARTING.split(text) if _OTHER.search(text) else text.split(" ")

    def _learn(self, runs: set[str]) -> dict[str, bytes]:
        """The ids of all ``runs``; short runs met since the last turnover but one need no encoding."""
        out, new = {}, []
        for t in runs:
            have = self.ids.get(t)
            if have is None and (have := self.before.get(t)) is not None:
                self._keep(t, have)
            if have is None:
                new.append(t)
            else:
                out[t] = have
        for t, ids in zip(new, self._encode([" " + t for t in new] if self.spaced else new), strict=True):
            out[t] = ids
            if len(t) <= KEPT:
                self._keep(t, ids)
        return out

    def _keep(self, run: str, ids: bytes) -> None:
        size = ENTRY + 4 * len(run) + len(ids)  # at most four bytes a character
        if self.held + size > CACHE:
            self.ids, self.before, self.held = {}, self.ids, 0
        self.ids[run] = ids
        self.held += size

    def _encode(self, runs: list[str]) -> list[bytes]:
        parts = [self.split(t) for t in runs]
        tokens = list(set().union(*parts))
        latin = [t.encode().decode("latin-1").translate(self.map) for t in tokens]
        known = {t: struct.pack(f"<{len(ids)}i", *ids) for t, ids in zip(tokens, self.model.encode(latin, out_type=int, num_threads=1), strict=True)}
        return [known[p[0]] if len(p) == 1 else b"".join(map(known.__getitem__, p)) for p in parts]

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets of the texts)."""
        out, offsets, pending, todo = [], [0], [], 0

        def flush():
            heads = self._encode([p[0] for p in pending]) if self.spaced else None  # no space before the first run
            rest = [p[1:] for p in pending] if self.spaced else pending
            get = self._learn(set().union(*rest)).__getitem__
            for k, parts in enumerate(rest):
                raw = b"".join(map(get, parts))
                if heads is not None:
                    raw = heads[k] + raw
                out.append(raw)
                offsets.append(offsets[-1] + len(raw) // 4)
            pending.clear()

        for text in texts:
            pending.append(self._runs(text or ""))
            todo += len(text or "")
            if todo > 400_000:
                flush()
                todo = 0
        if pending:
            flush()
        return np.frombuffer(b"".join(out), "<i4"), np.array(offsets, np.int64)


class Pieces:
    """The bytes of every id, end to end."""

    def __init__(self, pieces: list[bytes]):
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.ends = np.cumsum([len(p) for p in pieces])
        self.sizes = np.diff(self.ends, prepend=0)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of lists of ids; an id outside the vocabulary is an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.ends)):
            raise ValueError("id outside the vocabulary")
        sizes = self.sizes[ids]
        past = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(int(past[-1]), np.uint8)
        for a in range(0, len(ids), 1 << 18):  # bounded temporaries
            b = min(a + (1 << 18), len(ids))
            own = sizes[a:b]
            shift = self.ends[ids[a:b]] - own - past[a:b]
            out[past[a] : past[b]] = self.data[np.repeat(shift, own) + np.arange(past[a], past[b])]
        return out, past[offsets]


@lru_cache(maxsize=4)
def _pieces(file: Shipped) -> list[bytes]:
    return read_ranks(file.value.splitlines())


@lru_cache(maxsize=4)
def _decoder(file: Shipped) -> Pieces:
    return Pieces(_pieces(file))


@lru_cache(maxsize=4)
def _worker(file: Shipped, pattern: str) -> ByteBPE:
    return ByteBPE(_pieces(file), pattern)


def _clear() -> None:
    for kept in (_worker, _decoder, _pieces):
        kept.cache_clear()


caches(__name__, _clear)


def encode(docs: DataFrame, path: str, pattern: str, *, text_col: str = "text", keep: list[str] | None = None, ids_col: str = "ids") -> DataFrame:
    """Adds ``ids`` (array<int>) to each row."""
    file = ship(docs.sparkSession, path)
    keep = keep if keep is not None else docs.columns

    def fn(batch):
        ids, offsets = _worker(file, pattern).encode_batch(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
        return [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))]

    return map_rows(docs.select(*dict.fromkeys([*keep, text_col])), fn, f"{ids_col} array<int>", keep)


def binary(data: np.ndarray, offsets: np.ndarray, like: pa.Array) -> pa.Array:
    """A binary column of the bytes between offsets, null where ``like`` is."""
    out = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    return pc.if_else(like.is_valid(), out, None).cast(pa.binary()) if like.null_count else out.cast(pa.binary())


def decode(tokens: DataFrame, path: str, *, ids_col: str = "ids", bytes_col: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Adds the decoded bytes (binary) to each row; null ids give null, an id outside the vocabulary is an error."""
    file = ship(tokens.sparkSession, path)
    keep = keep if keep is not None else tokens.columns

    def fn(batch):
        lists = batch.column(batch.schema.get_field_index(ids_col))
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        data, offsets = _decoder(file).decode(lists.flatten().to_numpy(zero_copy_only=False), ends)
        return [binary(data, offsets, lists)]

    return map_rows(tokens.select(*dict.fromkeys([*keep, ids_col])), fn, f"{bytes_col} binary", keep)


def round_trip(docs: DataFrame, path: str, pattern: str, *, text_col: str = "text", keep: list[str], ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Adds the ids and the bytes they decode to, in one pass of one worker: ``encode`` and ``decode`` of a batch in turn."""
    file = ship(docs.sparkSession, path)

    def fn(batch):
        ids, offsets = _worker(file, pattern).encode_batch(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
        return [lists, binary(*_decoder(file).decode(ids, offsets), lists)]

    return map_rows(docs.select(*dict.fromkeys([*keep, text_col])), fn, f"{ids_col} array<int>, {bytes_col} binary", keep)


def digest(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id") -> DataFrame:
    """Encode, decode and reduce to the columns of the contract."""
    coded = round_trip(docs.select(F.col(id_col).alias("_id"), F.col("text").alias("_text")), path, pattern, text_col="_text", keep=["_id"])
    return coded.select(
        F.col("_id").alias(id_col),
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
