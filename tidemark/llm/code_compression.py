"""Product codes of vectors by Lloyd's rounds that move only what changed.

Every entry c becomes the integer floor(1024 c); a vector is cut into four equal parts, and each part position has a codebook of up to
256 entries, at first those parts of the rows of smallest ids.  A round assigns every part to its nearest entry and replaces each
entry by the rounded-down mean of its parts.  The rows are kept, with the assignment before and the new one, as a table in the
shared folder, and the running integer sums and counts of every entry as another.  A round shuffles only contributions of parts
whose assignment changed: minus to the entry left, plus to the entry joined, added up in each task before they travel (at most
4 x 256 x (entries of a part + 1) sums a task).  Sums are exact integers, so nothing drifts and lost tasks can be run again.
The codebooks themselves (bounded by a vector's length) are broadcast.

Distances are exact: by a product of doubles while every term stays below 2^53, else by differences of longs; entries too large
even for those are an error.  Ties go to the lower index; an entry that no part is nearest to stays as it is.

Rows whose vector is null or holds a null or a number that is not finite are left out.  Vectors of different lengths, or of a
length that four does not divide, are an error.  Repeated rows count each time; rows of one id are taken by their vectors, null
ids last; fewer than 256 rows give smaller codebooks.  An empty table gives an empty result.  ``compress`` returns the columns of
``keep``, whatever their names; one named like an added column gets ``_in`` after its name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, beside, few_enough, map_rows, release, worker_of
from .vectors import floors, is_null, lists, matrix, one_length, whole_rows

SCALE, PARTS, ENTRIES, ROUNDS = 1024.0, 4, 256, 4
#: Rows whose distances to a codebook are held at a time.
ROWS = 1024


def limit(width: int) -> float:
    """Entries below this have squared distances that a long holds."""
    return float(int((2**61 / max(width, 1)) ** 0.5))


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each row, exactly."""
    most = int(max(np.abs(part).max(initial=0), np.abs(book).max(initial=0)))
    index, error = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
    exact = 4 * part.shape[1] * most * most < 1 << 53
    centre = book.astype(np.float64)
    norms = (centre**2).sum(axis=1)
    step = ROWS if exact else max(1, (1 << 18) // max(book.size, 1))
    for a in range(0, len(part), step):
        x = part[a : a + step]
        if exact:
            value = x.astype(np.float64)
            gap = norms - 2.0 * (value @ centre.T)
            own = gap.argmin(axis=1)
            least = gap[np.arange(len(x)), own] + (value**2).sum(axis=1)
        else:
            gap = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
            own = gap.argmin(axis=1)
            least = gap[np.arange(len(x)), own]
        index[a : a + step], error[a : a + step] = own, least
    return index, error


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes: rows x parts, error of each row) under books (parts x entries x width)."""
    width = books.shape[2]
    codes, error = np.empty((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
    for p in range(PARTS):
        codes[:, p], e = nearest(x[:, p * width : (p + 1) * width], books[p])
        error += e
    return codes, error


def _code_column(codes: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(PARTS), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(v or b"\0" * PARTS for v in column.to_pylist()), np.uint8).reshape(-1, PARTS)


def _field(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def step(rows: DataFrame, books: np.ndarray, keep: list[str], length: int) -> DataFrame:
    """The rows with the assignment so far as ``prev`` and the nearest entries of ``books`` as ``code``."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def fn(batch):
        codes, _ = assign(matrix(_field(batch, "_x"), length, np.int64), shared.value)
        return [_field(batch, "code"), _code_column(codes)]

    return map_rows(rows, fn, "prev binary, code binary", [*keep, "_x"])


def contributions(rows: DataFrame, entries: int, length: int) -> DataFrame:
    """(slot, v): what the entries gain and lose by parts whose assignment changed, a task's rows added up.

    Slot (part * entries + entry) * (width + 1) + place; the last place of an entry counts its parts.
    """
    width = length // PARTS

    def fn(batches):
        worker_of(__name__)
        sums = np.zeros((PARTS * entries, width + 1), np.int64)
        for batch in batches:
            x, prev, code = _field(batch, "_x"), _field(batch, "prev"), _codes(_field(batch, "code"))
            x, fresh, prev = matrix(x, length, np.int64), is_null(prev), _codes(prev)
            for p in range(PARTS):
                moved = fresh | (prev[:, p] != code[:, p])
                part = np.column_stack([x[moved, p * width : (p + 1) * width], np.ones(moved.sum(), np.int64)])
                np.add.at(sums, p * entries + code[moved, p].astype(np.int64), part)
                left = moved & ~fresh
                np.subtract.at(sums, p * entries + prev[left, p].astype(np.int64), part[left[moved]])
        flat = sums.reshape(-1)
        some = np.flatnonzero(flat)
        if len(some):
            yield pa.RecordBatch.from_pydict({"slot": pa.array(some.astype(np.int32)), "v": pa.array(flat[some])})
        release()

    return rows.select("_x", "prev", "code").mapInArrow(fn, "slot int, v bigint")


def renewed(books: np.ndarray, sums: dict[int, int]) -> np.ndarray:
    """Books whose entries are the rounded-down means of their parts; entries without parts stay."""
    out, (parts, entries, width) = books.copy(), books.shape
    for p in range(parts):
        for e in range(entries):
            at = (p * entries + e) * (width + 1)
            if n := sums.get(at + width, 0):
                out[p, e] = [sums.get(at + i, 0) // n for i in range(width)]
    return out


def train(rows: DataFrame, keep: list[str], length: int, scratch: Scratch, *, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(rows as of the last round, books after it) of rows with integers ``_x`` and order ``_id``."""
    width = length // PARTS
    first = rows.orderBy(F.asc_nulls_last("_id"), "_x").select("_x").limit(ENTRIES).collect()  # the first codebook
    books = np.array([r["_x"] for r in first], np.int64).reshape(len(first), PARTS, width).transpose(1, 0, 2).copy()
    held = rows.select(*keep, "_x", F.lit(None).cast("binary").alias("code"))
    running = None
    for k in range(rounds if len(first) else 0):
        held = scratch.write(step(held, books, keep, length), f"rows-{k}")
        delta = contributions(held.where("prev IS NULL OR prev <> code"), len(first), length)
        total = (delta if running is None else running.unionByName(delta)).groupBy("slot").agg(F.sum("v").alias("v"))
        running = scratch.write(total, f"sums-{k}", files=1)
        books = renewed(books, {r["slot"]: r["v"] for r in running.collect()})  # a number for each entry of the codebooks
        for name in (f"rows-{k - 1}", f"sums-{k - 1}") if k else ():
            scratch.drop(name)
    return held, books


def compress(df: DataFrame, *, vector: str = "embedding", id_col: str = "vec_id", keep: list[str] | None = None, rounds: int = ROUNDS, scratch: Scratch | None = None) -> tuple[DataFrame, np.ndarray]:
    """Rows with ``code`` (binary, an entry's index for each part) and ``error`` (bigint) beside the columns of ``keep``, and the
    books (parts x entries x width, integers)."""
    scratch = scratch or Scratch(df.sparkSession)
    names = keep if keep is not None else [c for c in df.columns if c != vector]
    inner = {c: f"_k{i}" for i, c in enumerate(names)}
    rows = whole_rows(df.select(F.col(vector).alias("_v"), F.col(id_col).alias("_id"), *[F.col(c).alias(n) for c, n in inner.items()]), "_v")
    length = one_length(rows, "_v")
    if length % PARTS:
        raise ValueError(f"vectors of {length} entries do not have {PARTS} equal parts")

    def whole_numbers(batch):
        return [lists(floors(matrix(_field(batch, "_v"), length), SCALE, limit(length)), pa.int64())]

    integers = map_rows(rows, whole_numbers, "_x array<bigint>", ["_id", *inner.values()])
    held, books = train(integers, list(inner.values()), length, scratch, rounds=rounds)
    shared = df.sparkSession.sparkContext.broadcast(books)

    def fn(batch):
        codes, error = assign(matrix(_field(batch, "_x"), length, np.int64), shared.value)
        return [_code_column(codes), pa.array(error)]

    out = map_rows(held.drop("code", "prev"), fn, "code binary, error bigint", list(inner.values()))
    return out.select(*[F.col(n).alias(c) for n, c in zip(inner.values(), beside(names, ["code", "error"]), strict=True)], "code", "error"), books


def digest(df: DataFrame) -> DataFrame:
    """The columns of the contract."""
    scratch = Scratch(df.sparkSession)
    coded, books = compress(df.select("vec_id", "embedding", "label"), keep=["vec_id", "label"], scratch=scratch)
    coded = scratch.write(coded, "coded")
    per_label = few_enough(coded.groupBy(F.col("label").alias("_l")).agg(F.sum("error").alias("label_error")))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return coded.join(per_label, F.col("label").eqNullSafe(F.col("_l")), "left").select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle(rounds: int = ROUNDS) -> str:
    """The same in SQL: every round as a relation of parts and one of entries."""
    finite = "embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"
    sql = f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r, list_transform(embedding, lambda c: floor({SCALE} * CAST(c AS DOUBLE))) AS x FROM embeddings WHERE {finite}),
parts AS MATERIALIZED (SELECT r, p, list_slice(x, 1 + p * (len(x) // {PARTS}), (p + 1) * (len(x) // {PARTS})) AS v FROM kept, range({PARTS}) t(p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM parts WHERE r <= {ENTRIES})"""
    for k in range(rounds + 1):
        sql += f""",
near{k} AS MATERIALIZED (
  SELECT a.r, a.p, min(CAST(list_dot_product(a.v, a.v) - 2 * list_dot_product(a.v, b.v) + list_dot_product(b.v, b.v) AS BIGINT) * {ENTRIES} + b.e) AS best
  FROM parts a JOIN book{k} b ON a.p = b.p GROUP BY a.r, a.p)"""
        if k < rounds:
            sql += f""",
mean{k} AS MATERIALIZED (
  SELECT p, e, list(m ORDER BY i) AS v FROM (
    SELECT p, best % {ENTRIES} AS e, i, floor(sum(x) / count(*)) AS m FROM (
      SELECT n.p, n.best, unnest(a.v) AS x, generate_subscripts(a.v, 1) AS i FROM near{k} n JOIN parts a ON a.r = n.r AND a.p = n.p) GROUP BY p, best % {ENTRIES}, i)
  GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m ON m.p = b.p AND m.e = b.e)"""
    return sql + f""",
coded AS (SELECT r, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY p) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM near{rounds} GROUP BY r),
named AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM book{rounds}))
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, named.codebooks_sha256
FROM kept k JOIN coded c ON c.r = k.r CROSS JOIN named"""
