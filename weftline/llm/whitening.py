"""Embedding whitening from a covariance in double-double arithmetic."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

Pair = tuple[np.ndarray, np.ndarray]  # high and low parts; the number is their sum

#: Rows whose outer products are in memory at a time.
ROWS = 64
#: Parts of a sum that one task merges; what is left is merged again, until one part is.
FAN = 256


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b rounded, and what the rounding lost, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _halves(a: np.ndarray) -> Pair:
    t = 134217729.0 * a  # 2 ** 27 + 1
    high = t - (t - a)
    return high, a - high


def two_product(a: np.ndarray, b: np.ndarray) -> Pair:
    """a * b rounded, and what the rounding lost, exactly."""
    p = a * b
    (ah, al), (bh, bl) = _halves(a), _halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def plus(x: Pair, y: Pair) -> Pair:
    """The sum of two double-doubles."""
    s, e = two_sum(x[0], y[0])
    t, f = two_sum(x[1], y[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def times(x: Pair, y: Pair) -> Pair:
    """The product of two double-doubles."""
    p, e = two_product(x[0], y[0])
    return two_sum(p, e + (x[0] * y[1] + x[1] * y[0]))


def total(x: Pair) -> Pair:
    """The sum over the first axis, by halves."""
    high, low = x
    while len(high) > 1:
        half = len(high) // 2
        rest = slice(2 * half, None)
        s = plus((high[:half], low[:half]), (high[half : 2 * half], low[half : 2 * half]))
        high, low = np.concatenate([s[0], high[rest]]), np.concatenate([s[1], low[rest]])
    return high[0], low[0]


@dataclass
class Centre:
    """The mean s / n of n whole vectors as a whole part and a remainder, so that x - s / n loses nothing
    in the subtraction of large equal parts."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        high = [(s % self.n) / self.n for s in self.sums]
        self.high = np.array(high)
        #: What the remainder's division lost: exact over integers, as high is a fraction of a power of two.
        self.low = np.array([float((s % self.n) * d - self.n * m) / (self.n * d) for s, (m, d) in zip(self.sums, (h.as_integer_ratio() for h in high), strict=True)])

    def apart(self, x: np.ndarray) -> Pair:
        """x - s / n as double-doubles; x: rows of long."""
        whole = x - self.whole
        high = whole.astype(np.float64)
        low = (whole - high.astype(np.int64)).astype(np.float64)
        return plus((high, low), (-self.high, -self.low))

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n * x - s) ** 2, exactly: in 64 bits where the largest fits, else in
        integers of any size."""
        most = max((max(abs(self.n * int(hi) - s), abs(self.n * int(lo) - s)) for lo, hi, s in zip(x.min(0), x.max(0), self.sums, strict=True)), default=0)
        kind = np.int64 if most**2 * x.shape[1] < 1 << 63 and max(map(abs, self.sums), default=0) < 1 << 62 else object
        d = x.astype(kind) * self.n - np.array(self.sums, kind)
        return (d * d).sum(1).tolist()


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def merged(parts: DataFrame) -> DataFrame:
    """A double-double sum for each i, from rows (i, part, high, low): FAN parts in one task, then again over what
    those give. Parts are numbered by task, so sums come out the same in every run."""

    def add(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("part")
        n = len(table["high"][0])
        high, low = total(tuple(table[c].combine_chunks().flatten().to_numpy().reshape(-1, n) for c in ("high", "low")))
        return pa.table([table["i"][:1], pa.array([table["part"][0].as_py() // FAN], pa.int32()), pa.array([high.tolist()]), pa.array([low.tolist()])], ["i", "part", "high", "low"])

    kind = "i int, part int, high array<double>, low array<double>"
    left = parts.agg(F.max("part")).first()[0] or 0
    while True:
        parts = parts.groupBy("i", (F.col("part") / FAN).cast("int").alias("block")).applyInArrow(add, kind)
        left //= FAN
        if not left:
            return parts


def fit(distinct: DataFrame, width: int) -> tuple[Centre | None, np.ndarray, np.ndarray]:
    """(centre, eigenvalues by falling size, eigenvectors as columns) of the vectors x of `distinct`. What comes to
    the driver is by dimension: sums, and the rows of the covariance."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, upper, lower = 0, [0] * width, [0] * width
        for batch in batches:
            x = _matrix(batch.column(0), width)
            n += len(x)
            upper = [a + int(b) for a, b in zip(upper, (x >> 32).sum(0), strict=True)]
            lower = [a + int(b) for a, b in zip(lower, (x & 0xFFFFFFFF).sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array(upper, pa.int64()), pa.array(lower, pa.int64())], ["i", "n", "upper", "lower"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(28,0)")).alias(c)
    got = distinct.select("x").mapInArrow(common.lean(sums), "i int, n long, upper long, lower long").groupBy("i").agg(F.sum("n").alias("n"), wide("upper"), wide("lower")).orderBy("i").collect()
    if not got or not got[0]["n"]:
        return None, np.zeros(0), np.zeros((width, 0))
    centre = Centre(got[0]["n"], [(int(r["upper"]) << 32) + int(r["lower"]) for r in got])
    one, other = np.triu_indices(width)
    begin = np.searchsorted(one, np.arange(width + 1))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, acc = TaskContext.get().partitionId(), (np.zeros(len(one)), np.zeros(len(one)))
        for batch in batches:
            high, low = centre.apart(_matrix(batch.column(0), width))
            s = total(times((high[:, one], low[:, one]), (high[:, other], low[:, other])))
            acc = plus(acc, s)
        rows = [range(width), [part] * width, *[[a[u:v].tolist() for u, v in zip(begin[:-1], begin[1:], strict=True)] for a in acc]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)], ["i", "part", "high", "low"])

    parts = common.store(distinct.select("x").mapInArrow(common.lean(products, ROWS), "i int, part int, high array<double>, low array<double>"), "products")
    cov = np.zeros((width, width))
    for r in merged(parts).collect():
        cov[r["i"], r["i"] :] = cov[r["i"] :, r["i"]] = (np.array(r["high"]) + np.array(r["low"])) / centre.n
    # LAPACK's syevd: reduction to a tridiagonal matrix, then divide and conquer.
    values, vectors = np.linalg.eigh(cov)
    return centre, values[::-1], vectors[:, ::-1]


def whitened(vectors: DataFrame, components: int = 4, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, component, n, deviation, whitened, explained, identity_error: a row for each usable row of vectors
    and each component.

    Entries c become x = floor(scale * c); each distinct x counts once for the mean s / n and the covariance. Outer
    products of centred vectors are double-doubles from error-free sums and products, added up in tasks and then
    over tasks, high and low parts together. Components are unit eigenvectors by falling eigenvalue, the
    largest entry of each positive; whitened is the centred vector on the component over the eigenvalue's root,
    explained the eigenvalue's share of all. deviation, the sum of (n * x - s) ** 2, is exact and a decimal(38,0).
    identity_error, one value, is how far the covariance of the whitened numbers of distinct vectors is
    from the identity.

    Vectors that are null or hold null or non-finite entries take no part, nor do those of another length than
    most (of equally many, the shorter), empty ones among them if none is longer. Rows repeated under one id or
    vector have their own results; null ids stay. Vectors of fewer dimensions have fewer components. Where an eigenvalue is zero but
    for rounding, there is nothing to divide by: whitened is null, and such components don't count for
    identity_error, which is null if all are such (as with a single vector). x beyond 2 ** 62 is an error. An empty
    table gives no rows; other columns are ignored.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)))
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double"
    most = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    spark = vectors.sparkSession
    if most is None or not most["width"]:
        return spark.createDataFrame([], schema + ", identity_error double").withColumnRenamed("id", id_col)
    width = most["width"]
    x = F.transform("v", lambda c: F.floor(F.when(F.abs(c * scale) <= float(1 << 62), c * scale).otherwise(F.raise_error(F.lit("an entry is too large for a whole number of 64 bits")).cast("double"))))
    rows = rows.filter(F.size("v") == width).select("id", x.alias("x"))
    distinct = common.store(rows.groupBy("x").agg(F.count("*").alias("times")), "distinct")
    centre, values, ways = fit(distinct, width)
    if centre is None:
        return spark.createDataFrame([], schema + ", identity_error double").withColumnRenamed("id", id_col)
    k = min(components, width)
    trace = float(values.sum())
    real = values[:k] > max(0.0, values[0]) * width * np.finfo(float).eps
    ways = ways[:, :k] * np.where(ways[np.abs(ways[:, :k]).argmax(0), range(k)] < 0, -1.0, 1.0)
    roots = np.sqrt(np.where(real, values[:k], 1.0))
    explained = [float(e) / trace if trace > 0 else None for e in np.maximum(0.0, values[:k])]

    def project(x: np.ndarray) -> np.ndarray:
        high, low = centre.apart(x)
        return (high @ ways + low @ ways) / roots

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = project(_matrix(batch.column(0), width))
            yield pa.RecordBatch.from_arrays([pa.array(y[:, j]) for j in range(k)], [f"w{j}" for j in range(k)])

    used = [j for j in range(k) if real[j]]
    error = None
    if used:
        y = distinct.select("x").mapInArrow(common.lean(fitted), ", ".join(f"w{j} double" for j in range(k)))
        cells = y.agg(*[F.abs(F.covar_pop(f"w{i}", f"w{j}") - float(i == j)).alias(f"c{i}_{j}") for i in used for j in used if i <= j])
        error = max(cells.first())

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), width)
            y, m = project(x), len(x)
            every = pa.array(np.repeat(np.arange(m), k))
            j = np.tile(np.arange(k), m)
            cols = [batch.column(0).take(every), pa.array(j + 1, pa.int32()), pa.array(np.full(m * k, centre.n), pa.int64())]
            cols += [pa.array(centre.deviations(x), pa.decimal128(38, 0)).take(every), pa.array(y.ravel(), mask=~real[j]), pa.array([explained[c] for c in j.tolist()], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "component", "n", "deviation", "whitened", "explained"])

    return rows.mapInArrow(common.lean(results), schema).withColumn("identity_error", F.lit(error).cast("double")).withColumnRenamed("id", id_col)
