"""Embedding whitening: leading principal components by Chebyshev-filtered subspace iteration.

Vectors are kept once as packed whole numbers x = floor(1024 c) + 100000. The
covariance matrix V is never formed: a pass over the vectors multiplies it into
a block Q, as the sum of (x - m)(x - m)'Q over all rows. A task sends one small
matrix, and Spark adds them up row by row.

A few Lanczos steps bound the spectrum from below. Each round then applies a
Chebyshev polynomial in V to the block, one pass a degree; it is small on the
unwanted part of the spectrum and grows steeply beyond it. QR and Rayleigh-Ritz
follow. The components are certified by their residuals |Vq - eq|, measured by
a pass of their own. A block that makes no headway is doubled, up to the whole
space, where Rayleigh-Ritz is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetcraft.llm.common import store

#: Scale and offset of an entry (fixed values).
SCALE, OFFSET = 1024, 100_000
#: Beyond this a number is no exact double any more.
EXACT = 2.0 ** 52
#: Bytes of one stored block of vectors, and blocks that a task multiplies at a time.
BLOCK, TOGETHER = 2 ** 16, 32
#: Vectors besides twice the wanted number in the first block.
GUARD = 8
#: Largest residual of a certified component, in units of the largest eigenvalue.
CERTIFIED = 1e-12
#: Residual at which a further round would only add rounding.
FLOOR = 2e-15
#: Largest ratio by which one filter may stretch a block's columns apart.
STRETCH = 1e10
LANCZOS, DEGREE, ROUNDS = 8, 16, 60
#: Eigenvalues under this share of the trace are rounding: no component.
NOTHING = 1e-13


def pack(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Blocks of the vectors without null or non-finite entries: ``ids``, ``width``, and ``x``, row after row of
    little-endian 64-bit numbers."""
    source = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    schema = T.StructType([T.StructField("ids", T.ArrayType(source.schema["vec_id"].dataType)),
                           T.StructField("width", T.IntegerType()), T.StructField("x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            lists = batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])
            values = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE) + OFFSET
            for width in np.unique(lengths[lengths >= 0]).tolist():
                rows = np.flatnonzero(lengths == width)
                x = values[starts[rows][:, None] + np.arange(width)]
                good = (np.abs(x) < EXACT).all(axis=1)
                rows, x = rows[good], x[good].astype("<i8")
                cuts = np.append(np.arange(0, len(rows), max(1, BLOCK // (8 * max(1, width)))), len(rows))
                ids = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), batch.column(0).take(pa.array(rows)))
                blocks = [x[i:j].tobytes() for i, j in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([ids.cast(arrow.field(0).type), pa.array([width] * len(blocks), pa.int32()),
                                                  pa.array(blocks, pa.binary())], schema=arrow)

    return source.mapInArrow(run, schema)


def unpack(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Packed blocks as matrices of whole numbers, a few blocks at a time."""
    for start in range(0, len(column), TOGETHER):
        yield np.frombuffer(b"".join(column.slice(start, TOGETHER).to_pylist()), "<i8").reshape(-1, width)


def _whole(x: np.ndarray) -> np.ndarray:
    """Numbers whose sums and squares cannot overflow: 64-bit where that is certain, else Python's."""
    return x if x.size == 0 or math.log2(1 + float(np.abs(x).max())) * 2 + math.log2(1 + x.size) < 62 else x.astype(object)


@dataclass
class Vectors:
    """The stored vectors, their number and the exact sums that centre them."""

    stored: DataFrame
    n: int
    sums: list[int]
    trace: float

    @property
    def width(self) -> int:
        return len(self.sums)

    @classmethod
    def of(cls, vectors: DataFrame, id_col: str, vector_col: str) -> Vectors | None:
        packed = store(pack(vectors, id_col, vector_col), "vectors")
        common = (packed.groupBy("width").agg(F.sum(F.size("ids")).alias("n"))
                  .orderBy(F.desc("n"), F.desc("width")).first())
        if common is None or common["width"] == 0:
            return None
        width, stored = common["width"], packed.where(F.col("width") == common["width"]).select("ids", "x")
        whole = T.DecimalType(38, 0)
        schema = T.StructType([T.StructField("j", T.IntegerType()), T.StructField("s", whole), T.StructField("q", whole)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s, q = [0] * width, [0] * width
            for x in (_whole(x) for batch in batches for x in unpack(batch.column(0), width)):
                s = [a + int(b) for a, b in zip(s, x.sum(axis=0))]
                q = [a + int(b) for a, b in zip(q, (x * x).sum(axis=0))]
            from decimal import Decimal
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(map(Decimal, s), pa.decimal128(38, 0)),
                                              pa.array(map(Decimal, q), pa.decimal128(38, 0))], schema=to_arrow_schema(schema))

        total = stored.select("x").mapInArrow(run, schema).groupBy("j").agg(F.sum("s").alias("s"), F.sum("q").alias("q"))
        by = {r["j"]: (int(r["s"]), int(r["q"])) for r in total.collect()}
        n = common["n"]
        sums = [by[j][0] for j in range(width)]
        trace = sum(Fraction(by[j][1]) - Fraction(by[j][0] ** 2, n) for j in range(width)) / n
        return cls(stored, n, sums, float(trace))

    def centred(self):
        """A function from whole-number rows to x - m, exact up to one rounding where n x fits 64 bits."""
        n, sums, mean = self.n, self.sums, np.array([s / self.n for s in self.sums])
        top = max(abs(s) for s in sums)

        def of(x: np.ndarray) -> np.ndarray:
            if x.size and n * int(np.abs(x).max()) + top < 2 ** 62:
                return (x * n - np.array(sums, np.int64)) / n
            return x.astype(np.float64) - mean
        return of

    def added(self, make, rows: int, columns: int) -> np.ndarray:
        """The sum of a matrix over all blocks; ``make`` maps a block of centred rows to it."""
        names = [f"c{i}" for i in range(columns)]
        schema = T.StructType([T.StructField("j", T.IntegerType())] + [T.StructField(c, T.DoubleType()) for c in names])
        centre, width = self.centred(), self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((rows, columns))
            for batch in batches:
                for x in unpack(batch.column(0), width):
                    total += make(centre(x))
            yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), *[pa.array(total[:, i]) for i in range(columns)]],
                                             schema=to_arrow_schema(schema))

        parts = self.stored.select("x").mapInArrow(run, schema)
        out = np.zeros((rows, columns))
        for r in parts.groupBy("j").agg(*[F.sum(c).alias(c) for c in names]).collect():
            out[r["j"]] = r[1:]
        return out

    def times(self, block: np.ndarray) -> np.ndarray:
        """V times a block: one pass."""
        return self.added(lambda d: d.T @ (d @ block), self.width, block.shape[1]) / self.n


def _least_eigenvalue(times, width: int, rng: np.random.Generator) -> float:
    """A lower bound of the spectrum from a few Lanczos steps: least Ritz value less the last residual, 0 at least."""
    basis, alpha, beta = [], [], []
    q = rng.normal(size=width)
    q /= np.linalg.norm(q)
    for _ in range(min(LANCZOS, width)):
        basis.append(q)
        w = times(q[:, None])[:, 0]
        alpha.append(float(q @ w))
        for _ in range(2):
            for b in basis:
                w = w - (b @ w) * b
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-12 * max(alpha):
            break
        q = w / beta[-1]
    ritz = np.linalg.eigvalsh(np.diag(alpha) + np.diag(beta[:-1], 1) + np.diag(beta[:-1], -1))
    return max(0.0, float(ritz[0]) - beta[-1])


def _filter(times, block: np.ndarray, low: float, cut: float, top: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of that degree on [low, cut], scaled to one at ``top``, times the block."""
    half, middle = (cut - low) / 2, (cut + low) / 2
    sigma = half / (top - middle)
    scale = 2 / sigma
    before, now = block, (times(block) - middle * block) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (scale - sigma)
        before, now = now, (times(now) - middle * now) * (2 * after / half) - sigma * after * before
        sigma = after
    return now


def components_of(times, width: int, wanted: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues, unit eigenvectors and residuals of the leading components of a positive semidefinite matrix
    that is known by its products with blocks. Raises where the residuals cannot be certified."""
    rng = np.random.default_rng(seed)
    size, wanted = min(width, 2 * wanted + GUARD), min(width, wanted)
    block = np.linalg.qr(rng.normal(size=(width, size)))[0]
    low = _least_eigenvalue(times, width, rng) if size < width else 0.0
    last = math.inf
    for _ in range(ROUNDS):
        product = times(block)
        small = block.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, product = block @ turn, product @ turn
        residuals = np.linalg.norm(product - block * values, axis=0)[:wanted]
        top = max(float(values[0]), 0.0)
        error = float(residuals.max()) / top if top > 0 else 0.0
        if error <= FLOOR * math.sqrt(width) or error <= CERTIFIED and error > last / 4:
            return values[:wanted], block[:, :wanted], residuals
        cut = float(values[-1])
        if size == width or cut <= 1e-12 * top:
            block = np.linalg.qr(product if cut <= 1e-12 * top else block)[0]
        else:
            if error > last / 10 and size < width:
                more = min(width, 2 * size) - size
                block, size = np.hstack([block, rng.normal(size=(width, more))]), size + more
                block = np.linalg.qr(block)[0]
                last = math.inf
                continue
            floor = low if cut - low > 0.01 * cut else 0.0
            half, middle = (cut - floor) / 2, (cut + floor) / 2
            grows = [math.acosh(max(1.0, (float(v) - middle) / half)) for v in values[:wanted]]
            need = math.log(error / FLOOR) / max(grows[-1], 1e-3)
            apart = math.log(STRETCH) / max(grows[0] - grows[-1], 1e-9)
            degree = max(2, math.ceil(min(need, apart, DEGREE)))
            block = np.linalg.qr(_filter(times, block, floor, cut, top, degree))[0]
        last = error
    raise ArithmeticError(f"components not certified: residuals {residuals.tolist()} of {values[0]}")


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per vector and component (from 1, by falling eigenvalue): ``vec_id``, ``component``, ``n``, ``deviation``,
    ``whitened``, ``explained``, ``identity_error``, and ``deviation_decimal``, ``eigenvalue``, ``residual``.

    A vector that is null or holds a null or non-finite entry, or one whose
    scaled entry is no exact double (2^52 and more), is dropped; so are vectors
    of another width than the commonest (of equals the wider). ``n`` and the
    covariance count repeated rows as often as they occur, and rows that share
    an id or lack one are whitened each for itself. ``deviation`` is the exact
    sum over dimensions of (n x - S)^2, null where that exceeds 64 bits;
    ``deviation_decimal`` has it then too. A component's entry of largest size is
    positive. Components without variance are left
    out, so a table of equal vectors, or of one, gives no rows; there are at
    most as many components as dimensions. An empty table gives an empty table.
    Other columns are not carried.
    """
    spark = vectors.sparkSession
    id_field = T.StructField("vec_id", vectors.schema[id_col].dataType)
    schema = T.StructType([id_field, T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
                           T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
                           T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
                           T.StructField("deviation_decimal", T.DecimalType(38, 0)),
                           T.StructField("eigenvalue", T.DoubleType()), T.StructField("residual", T.DoubleType())])
    data = Vectors.of(vectors, id_col, vector_col)
    if data is None or data.trace <= 0:
        return spark.createDataFrame([], schema)
    values, axes, residuals = components_of(data.times, data.width, components)
    real = values > NOTHING * data.trace
    values, axes, residuals = values[real], axes[:, real], residuals[real]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    m = len(values)
    turn = axes / np.sqrt(values)

    def moments(d: np.ndarray) -> np.ndarray:
        w = d @ turn
        return np.vstack([w.sum(axis=0), w.T @ w])

    total = data.added(moments, m + 1, m) / data.n
    identity_error = float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(m)).max())
    n, sums, width, trace, centre = data.n, data.sums, data.width, data.trace, data.centred()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal
        arrow = to_arrow_schema(schema)
        for batch in batches:
            at = 0
            ids = batch.column(0).flatten()
            for x in unpack(batch.column(1), width):
                size = len(x)
                each = lambda a: np.tile(a, size)
                fits = n * int(np.abs(x).max(initial=0)) < 2 ** 62
                apart = _whole(x * n - np.array(sums, np.int64) if fits else n * x.astype(object) - np.array(sums, object))
                exact = [int(v) for v in (apart * apart).sum(axis=1)]
                row = pa.array(np.repeat(np.arange(size), m))
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, size).take(row).cast(arrow.field(0).type), pa.array(each(np.arange(1, m + 1)), pa.int32()),
                    pa.array(np.full(size * m, n), pa.int64()),
                    pa.array([v if v < 2 ** 63 else None for v in exact], pa.int64()).take(row),
                    pa.array((centre(x) @ turn).reshape(-1)), pa.array(each(values / trace)),
                    pa.array(np.full(size * m, identity_error)),
                    pa.array([Decimal(v) for v in exact], pa.decimal128(38, 0)).take(row),
                    pa.array(each(values)), pa.array(each(residuals))], schema=arrow)
                at += size

    return data.stored.mapInArrow(run, schema)
