"""Shared pieces: shared-folder tables, Arrow text blocks, and vectorised tokenising and hashing of UTF-8 bytes.

All text kernels work on whole texts.  A block is a run of rows of about ``BLOCK_BYTES`` of text, so that the
temporaries of numpy stay bounded whatever the Arrow batch holds; a single longer text is a block of its own.
"""

from __future__ import annotations

import gc
import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
#: Rows of an Arrow batch.  Texts may be long, so batches hold fewer rows than Spark's default of 10,000.
BATCH_ROWS = 256


def tune(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch by ``BATCH_ROWS`` unless the session already has a smaller bound."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's own removal of the shuffle files of a finished query.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Lists that gather the scratch folders made while they are open.
_GATHERING: list[list[Scratch]] = []


@contextmanager
def gathered() -> Iterator[list[Scratch]]:
    """The scratch folders that are made inside, so that a caller who has written what it read from them can close them."""
    made: list[Scratch] = []
    _GATHERING.append(made)
    try:
        yield made
    finally:
        _GATHERING.remove(made)


class Scratch:
    """Intermediate tables in the folder that driver and executors share (``spark.checkpoint.dir``).

    A table written here cuts lineage: a lost executor costs at most the tasks of the stage that runs.  Tables that a result is
    read from stay until ``close`` or until the driver ends, which deletes the folder.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            context = spark.sparkContext
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="tidemark-")  # one machine only, as in tests
            context._jsc.sc().conf().set("spark.checkpoint.dir", base)
        self.root = f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"
        files, path = self._files("")
        files.mkdirs(path)
        files.deleteOnExit(path)
        for made in _GATHERING:
            made.append(self)

    def write(self, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
        """Writes and rereads a table; the shuffle files behind it go as soon as it is whole.

        ``files``: into how many a table of few rows is gathered (by an exchange of its own, so that what computes it keeps
        its tasks); a file for each task of a small table costs more than its rows.
        """
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            (df.repartition(files) if files else df).write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.parquet(path)

    def _files(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def drop(self, name: str) -> None:
        files, path = self._files(name)
        files.delete(path, True)

    def close(self) -> None:
        """Deletes every table; results that were read from them are of no more use."""
        self.drop("")


# ---------------------------------------------------------------- files

#: Bytes of a vocabulary or model file that may be sent to every executor.
SHIPPED_BYTES = 64 << 20


class Shipped:
    """The bytes of a small file, as a broadcast that a lost executor fetches again; told apart by digest, not by name."""

    def __init__(self, spark: SparkSession, raw: bytes):
        self.digest = hashlib.sha256(raw).hexdigest()
        self._raw = spark.sparkContext.broadcast(raw)

    @property
    def value(self) -> bytes:
        return self._raw.value

    def __hash__(self) -> int:
        return hash(self.digest)

    def __eq__(self, other) -> bool:
        return isinstance(other, Shipped) and self.digest == other.digest


def ship(spark: SparkSession, path: str) -> Shipped:
    """Send a vocabulary or model file of the driver to every executor; a file above ``SHIPPED_BYTES`` is an error."""
    if os.path.getsize(path) > SHIPPED_BYTES:
        raise ValueError(f"{path} has more than {SHIPPED_BYTES} bytes")
    with open(path, "rb") as f:
        return Shipped(spark, f.read())


# ---------------------------------------------------------------- workers

#: What clears a module's caches in a Python worker, by module; and the module whose tasks the worker ran last.
_CACHES: dict[str, Callable[[], None]] = {}
_OWNER = ""


def caches(module: str, clear: Callable[[], None]) -> None:
    """Registers how a module's worker-wide caches are cleared; they live as long as the worker runs that module's tasks."""
    _CACHES[module] = clear


def worker_of(module: str) -> None:
    """Start of a task: a reused worker lets go of what tasks of other operators kept."""
    global _OWNER
    if module != _OWNER:
        for name, clear in _CACHES.items():
            if name != module:
                clear()
        _OWNER = module
        gc.collect()


def release() -> None:
    """End of a task: Arrow gives its free memory back; the worker may live on, idle."""
    pa.default_memory_pool().release_unused()


# ---------------------------------------------------------------- Arrow text


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    elif pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows of at most ``limit`` bytes, or one longer row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def text_blocks(batch: pa.RecordBatch, text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each block of a batch."""
    data, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
    for i, j in blocks(offsets, limit):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def beside(columns: list[str], added: list[str]) -> list[str]:
    """Names of input columns beside added ones: a name that is taken gets ``_in`` after it, as often as it takes."""
    out: list[str] = []
    for c in columns:
        taken = {*added, *out, *(x for x in columns if x != c)}
        while c in added or (c in taken and c.endswith("_in")):
            c += "_in"
        out.append(c)
    return out


def to_numpy(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


# ---------------------------------------------------------------- words


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Bytes of words that white space [\x20\x09-\x0D] ends.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of member bytes within rows, and for each row the first word (rows + 1 entries)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = member[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    cur, prev = inside[1:-1], inside[:-2]
    starts = np.flatnonzero(cur & (~prev | first[:-1]))
    ends = np.flatnonzero(cur & (~inside[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


# ---------------------------------------------------------------- hashes

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)
#: Odd multipliers of the two families of hashes.
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> _S)
    h *= _M1
    h ^= h >> _S
    h *= _M2
    h ^= h >> _S
    return h


def eights(data: np.ndarray, big: bool = False) -> np.ndarray:
    """Eight bytes from every position (zeros after the end)."""
    padded = np.concatenate([data, np.zeros(256, np.uint8)])
    return np.ndarray((len(data) + 248,), ">u8" if big else "<u8", padded.data, strides=(1,))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of each data[start:end], a function of its bytes alone; ``which`` picks one of two independent hashes.

    Eight bytes at a time are keyed by their place in the range and mixed before they are summed, so there is no
    polynomial whose terms could cancel.
    """
    seed = _SEEDS[which]
    sizes = (ends - starts).astype(np.int64)
    lanes = (sizes + 7) >> 3
    total = int(lanes.sum())
    past = np.cumsum(lanes)
    words = eights(data)
    if total == len(starts) and (lanes == 1).all():
        lane, at, left = np.zeros(1, np.uint64), starts, sizes
    else:
        row = np.repeat(np.arange(len(starts)), lanes)
        place = np.arange(total) - (past - lanes)[row]
        lane, at, left = place.astype(np.uint64), starts[row] + 8 * place, sizes[row] - 8 * place
    value = words[at].astype(np.uint64)
    short = np.maximum(8 - left, 0).astype(np.uint64) * np.uint64(8)
    value = (value << short) >> short
    value = mix(value ^ mix(lane * _M2 + seed))
    if total != len(starts):
        sums = np.zeros(total + 1, np.uint64)
        np.cumsum(value, out=sums[1:])
        value = sums[past] - sums[past - lanes]
    return mix(value + sizes.astype(np.uint64) * seed)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0, lower: bool = False) -> np.ndarray:
    return range_hashes(LOWER[data] if lower else data, starts, ends, which)


def window_hashes(words: np.ndarray, width: int, starts: np.ndarray | None = None, which: int = 0) -> np.ndarray:
    """Hash of the window of ``width`` words at each start (default: at every word that has one).

    Windows of 1, 2, 4, ... words are built from halves, and the powers of two in ``width`` are joined in turn; every step
    mixes, so equal hashes mean equal sequences of word hashes but for chance.
    """
    seed = _SEEDS[which]

    def join(x, y):
        return mix((x * seed) ^ (y + _M2))

    count = max(0, len(words) - width + 1)
    if starts is None:
        starts = np.arange(count)
    level, size, done, out = words, 1, 0, None
    while done < width:
        if width & size:
            part = level[done : done + count]
            out = part if out is None else join(out, part)
            done += size
        if done < width:
            level = join(level[:-size], level[size:])
            size *= 2
    return mix(out[starts] + np.uint64(width)) if count else np.zeros(len(starts), np.uint64)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur on two rows or more.  Counts combine before the shuffle, so that a hot key costs a row per task."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")


#: Rows of ids and numbers in a file of an intermediate table.
FILE_ROWS = 500_000


def files_for(rows: int, most: int) -> int:
    """Files for a table of about so many narrow rows: four for a small table, the session's parallelism for a large one."""
    return max(min(4, most), min(most, -(-rows // FILE_ROWS)))


#: Rows of ids that a broadcast may hold.
BROADCAST_ROWS = 100_000


def few_enough(ids: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, with a broadcast hint if it is counted to have at most ``limit`` rows; else the join shuffles."""
    return F.broadcast(ids) if ids.count() <= limit else ids


# ---------------------------------------------------------------- row-wise Arrow operators


def map_rows(df: DataFrame, fn, added: str, keep: list[str]) -> DataFrame:
    """Add columns to each row with ``fn(batch) -> list of Arrow arrays`` (one per field of the DDL ``added``).

    ``keep`` names the input columns that are returned too; an added column replaces a kept one of its name.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(added)
    kept = [c for c in keep if c not in new.names]
    schema = StructType([*[df.schema[c] for c in kept], *new.fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        worker_of(fn.__module__)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept] + list(fn(batch))
            yield pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(columns, arrow, strict=True)], schema=arrow)
        release()

    tune(df.sparkSession)
    return df.mapInArrow(run, schema)
