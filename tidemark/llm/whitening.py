"""Whitening of embeddings by TSQR: no covariance matrix is ever formed from the vectors.

Every entry c becomes the integer x = floor(64 c) + 1,000,000.  One aggregation gives the number n of vectors and the exact sum S of
each dimension; rows are centred as (n x - S) / n, whose numerator is an exact integer.  Every partition of centred rows is
reduced to the R factor of its QR decomposition, block by block; R factors meet in groups of ``FAN`` and are reduced again until
one is left (a tree of shuffles of d x d matrices, never of rows).  The singular values s and right vectors W of the last R are
those of all centred rows, so that the covariance has the eigenvalues s^2 / n and the eigenvectors W, found without squaring the
condition number.  A row is whitened by projecting it on W and dividing by s / sqrt(n).

The error of the result is measured on the whitened rows themselves: sums of products of every pair of components, one small
matrix a partition.  The model (d x k numbers) is a broadcast; d is a vector's length and bounds it.

Rows whose vector is null or holds a null or a number that is not finite are left out.  Vectors of different lengths, and
entries of 2^40 or more in size once they are integers, are an error.  Repeated rows count each time and get equal rows.  A
component without variance (fewer distinct vectors than dimensions, equal vectors, one vector) has ``whitened`` null; ``explained``
is null if no component has variance, and ``identity_error`` (over the components that have some) is then null.  Tied eigenvalues
take the order of the decomposition.  Signs: the largest entry of a component is positive.  An empty table, and vectors of no
entries, give an empty result.  Null ids stay.  Extra columns pass through ``whiten``, whatever their names, if ``keep`` names them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, beside, map_rows, release, tune, worker_of
from .vectors import floors, lists, matrix, one_length, whole_rows

SCALE, SHIFT, LIMIT = 64.0, 1_000_000, float(1 << 40)
#: R factors that one task reduces to one, and rows of a block.
FAN, ROWS = 16, 4096


@dataclass
class Whitening:
    """n, S of each dimension, right vectors (d x k), singular values (k), all eigenvalues' sum, error of the whitened rows."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    singular: np.ndarray
    trace: float
    error: float | None = None

    @property
    def eigenvalues(self) -> np.ndarray:
        return self.singular**2 / max(self.n, 1)

    @property
    def varying(self) -> np.ndarray:
        """Components with more variance than rounding leaves behind."""
        tiny = np.finfo(float).eps * 16 * max(self.n**0.5, len(self.sums)) * (self.singular[0] if len(self.singular) else 0.0)
        return self.singular > tiny

    def centred(self, x: np.ndarray) -> np.ndarray:
        return deviations(x, self.n, self.sums).astype(np.float64) / self.n

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows (rows x k), NaN for components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (self.centred(x) @ self.vectors) * (np.sqrt(self.n) / self.singular)
        out[:, ~self.varying] = np.nan
        return out


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exactly: as long where it fits, else as Python's integers."""
    most = n * (int(np.abs(x).max()) if x.size else 0) + (max(map(abs, sums.tolist())) if len(sums) else 0)
    if most < 1 << 62 and sums.dtype != object:
        return x * np.int64(n) - sums
    return x.astype(object) * n - sums.astype(object)


def integers(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """Whole rows with a column ``_x`` of integers beside the others, and the length of the vectors."""
    rows = whole_rows(df, vector)
    width = one_length(rows, vector)

    def fn(batch):
        values = matrix(batch.column(batch.schema.get_field_index(vector)), width)
        return [lists(floors(values, SCALE, LIMIT) + SHIFT, pa.int64())]

    return map_rows(rows, fn, "_x array<bigint>", [c for c in rows.columns if c != vector]), width


def _ints(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return matrix(batch.column(batch.schema.get_field_index("_x")), width, np.int64)


def totals(rows: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """Number of rows and exact sum of each dimension (Python integers beyond long)."""

    def partial(batches):
        worker_of(__name__)
        n, sums = 0, [0] * width
        for batch in batches:
            x = _ints(batch, width)
            n += len(x)
            sums = [a + b for a, b in zip(sums, x.sum(axis=0).tolist(), strict=True)]  # a batch's sum fits: 2^40 a row at most
        if n:
            yield pa.RecordBatch.from_pydict({"d": pa.array(range(width + 1), pa.int32()), "v": pa.array([str(s) for s in [*sums, n]])})
        release()

    got = rows.select("_x").mapInArrow(partial, "d int, v string").groupBy("d").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # a row a dimension
    found = {r["d"]: int(r["v"]) for r in got}
    sums = [found.get(d, 0) for d in range(width)]
    return found.get(width, 0), np.array(sums, np.int64 if all(abs(s) < 1 << 62 for s in sums) else object)


def triangle(blocks) -> np.ndarray | None:
    """R of the rows of all blocks, one block after the other."""
    r = None
    for block in blocks:
        if len(block):
            r = np.linalg.qr(block if r is None else np.vstack([r, block]), mode="r")
    return r


def _r_row(batches, width: int, blocks):
    r = triangle(blocks(batches))
    if r is not None:
        full = np.zeros((width, width))
        full[: len(r)] = r
        yield pa.RecordBatch.from_pydict({"r": pa.array([full.tobytes()], pa.binary())})
    release()


def tall_qr(rows: DataFrame, width: int, n: int, sums: np.ndarray, scratch: Scratch) -> np.ndarray:
    """R of all centred rows: of each partition, then of groups of ``FAN`` until one is left."""
    model = Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0)

    def leaves(batches):
        worker_of(__name__)
        yield from _r_row(batches, width, lambda bs: (model.centred(x[i : i + ROWS]) for x in (_ints(b, width) for b in bs) for i in range(0, len(x), ROWS)))

    def branch(batches):
        yield from _r_row(batches, width, lambda bs: (np.frombuffer(raw.as_py()).reshape(width, width) for b in bs for raw in b.column(0)))

    level, step = scratch.write(rows.select("_x").mapInArrow(leaves, "r binary"), "r-0"), 0
    while (count := level.count()) > 1:
        step += 1
        groups = -(-count // FAN)
        level = scratch.write(level.repartition(groups).mapInArrow(branch, "r binary"), f"r-{step}")
        scratch.drop(f"r-{step - 1}")
    found = level.collect()  # one matrix of d x d
    return np.frombuffer(found[0]["r"]).reshape(width, width) if found else np.zeros((width, width))


def fit(rows: DataFrame, width: int, components: int, scratch: Scratch) -> Whitening:
    """The whitening of rows with integers ``_x``, with its measured error."""
    n, sums = totals(rows, width)
    if not n or not width:
        return Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0)
    _, singular, right = np.linalg.svd(tall_qr(rows, width, n, sums, scratch))
    largest = np.argmax(np.abs(right), axis=1)
    right *= np.where(right[np.arange(width), largest] < 0, -1.0, 1.0)[:, None]
    k = min(components, width)
    out = Whitening(n, sums, np.ascontiguousarray(right[:k].T), singular[:k], float((singular**2).sum() / n))
    out.error = error_of(rows, width, out)
    return out


def error_of(rows: DataFrame, width: int, model: Whitening) -> float | None:
    """Largest entry of the whitened rows' covariance less the identity, over components with variance.

    A partition gives its count, means and sums of products about its own means; they are joined about the mean of all.
    """
    some = np.flatnonzero(model.varying)
    if not len(some):
        return None
    k = len(some)

    def partial(batches):
        worker_of(__name__)
        n, mean, products = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            x = _ints(batch, width)
            for i in range(0, len(x), ROWS):
                w = model.apply(x[i : i + ROWS])[:, some]
                own, m = w.mean(axis=0), len(w)
                gap = own - mean
                w = w - own
                products += w.T @ w + np.outer(gap, gap) * (n * m / (n + m))
                mean += gap * (m / (n + m))
                n += m
        if n:
            i, j = np.triu_indices(k)
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(np.concatenate([i, np.arange(k), [-1]]), pa.int32()),
                "j": pa.array(np.concatenate([j, np.full(k, -1), [-1]]), pa.int32()),
                "v": pa.array(np.concatenate([(products + n * np.outer(mean, mean))[i, j], n * mean, [n]])),
            })
        release()

    # means of whitened rows are 0 but for rounding, so moving to the mean of all costs no digits
    got = {(r["i"], r["j"]): r["v"] for r in rows.select("_x").mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}  # k * k / 2 rows
    n = got[-1, -1]
    mean = np.array([got[i, -1] for i in range(k)]) / n
    return max(abs(v / n - mean[i] * mean[j] - (i == j)) for (i, j), v in got.items() if j >= 0)


def whiten(df: DataFrame, *, vector: str = "embedding", components: int = 32, keep: list[str] | None = None, scratch: Scratch | None = None) -> tuple[DataFrame, Whitening]:
    """Rows with ``whitened`` (array<double>, NaN without variance) and ``deviation`` (decimal: the sum over dimensions of
    (n x - S)^2, exact) beside the columns of ``keep``, and the model."""
    added = ["whitened", "deviation"]
    names = keep if keep is not None else [c for c in df.columns if c != vector]
    inner = {c: f"_k{i}" for i, c in enumerate(names)}
    scratch = scratch or Scratch(df.sparkSession)
    rows, width = integers(df.select(F.col(vector).alias("_v"), *[F.col(c).alias(n) for c, n in inner.items()]), "_v")
    model = fit(rows, width, components, scratch)

    def fn(batch):
        x = _ints(batch, width)
        d = deviations(x, model.n, model.sums)
        limit = int(np.abs(d).max()) if d.size else 0
        squares = (d * d).sum(axis=1) if d.dtype != object and width * limit * limit < 1 << 62 else (d.astype(object) ** 2).sum(axis=1)
        return [lists(model.apply(x), pa.float64()), pa.array([str(int(v)) for v in squares])]

    out = map_rows(rows, fn, "whitened array<double>, _d string", list(inner.values()))
    own = [F.col(n).alias(c) for n, c in zip(inner.values(), beside(names, added), strict=True)]
    return out.select(*own, "whitened", F.col("_d").cast("decimal(38,0)").alias("deviation")), model


def digest(df: DataFrame, *, components: int = 32) -> DataFrame:
    """The columns of the contract, a row for each vector and component; ``deviation`` beyond long is an error."""
    out, model = whiten(df.select("vec_id", "embedding"), components=components, keep=["vec_id"])
    share = [float(e / model.trace) if model.trace else None for e in model.eigenvalues]
    each = out.select("vec_id", F.col("deviation").cast("bigint").alias("deviation"), F.posexplode("whitened").alias("_at", "_w"))
    explained = F.get(F.array(*[F.lit(s).cast("double") for s in share]), F.col("_at")) if share else F.lit(None).cast("double")
    return each.select(
        "vec_id",
        (F.col("_at") + 1).alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        F.when(~F.isnan("_w"), F.col("_w")).alias("whitened"),
        explained.alias("explained"),
        F.lit(model.error).cast("double").alias("identity_error"),
    )
