"""Whitening of embeddings by exact integer covariances.

Components become integers, and each dimension is shifted by its minimum, so that it takes as few bits as its range
needs. A block of rows is turned on its side: bit a of dimension i of all rows makes up one plane, packed into 64-bit
words. The number of rows where plane a of i and plane b of j both have a one is the popcount of their AND; weighted by
2^(a+b) and added up, these counts are the exact cross-product of i and j. Tasks return counts for each pair and each
a + b, Spark adds them, and the driver, which holds a number of them that depends on the width only, centres them as
integers before it takes eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import finite_vectors, list_matrix, materialize, table

#: Rows whose planes are held at once.
ROWS = 16_384
#: Eigenvalues below so many of the largest are rounding.
ROUNDING = 1e-12


def integers(column: pa.Array, width: int, scale: int, offset: int) -> np.ndarray:
    """floor(scale * c) + offset of the components; missing ones of short vectors are zeros."""
    with np.errstate(over="ignore"):
        x = np.floor(scale * list_matrix(column, width))
    if np.abs(x).max(initial=0) >= 2.0**62:
        raise ValueError("a scaled component doesn't fit in 64 bits")
    return x.astype(np.int64) + offset


def extents(vectors: DataFrame, scale: int, offset: int) -> tuple[int, list[int], list[int]]:
    """The number of vectors (v), and the least and the largest integer of each dimension."""
    x = F.floor(F.lit(scale) * F.col("x"))
    seen = vectors.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
    n = vectors.count()
    per = sorted(seen.collect())  # a row for each dimension
    fill = lambda r, f, c: f(r[c], 0) if r["n"] < n else r[c]
    return n, [fill(r, min, "low") + offset for r in per], [fill(r, max, "high") + offset for r in per]


def planes(y: np.ndarray, dims: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Rows of 64-bit words: bit bits[p] of dimension dims[p] of all rows of y."""
    ones = np.packbits(((y[:, dims] >> bits) & 1).astype(np.uint8), axis=0)
    out = np.zeros((len(dims), -(-len(ones) // 8) * 8), np.uint8)
    out[:, : len(ones)] = ones.T
    return out.view(np.uint64)


def scatter(vectors: DataFrame, low: list[int], high: list[int], scale: int, offset: int) -> DataFrame:
    """(i, j, s, n): of dimensions i <= j, how often bits a of i and b of j, a + b = s, are both one; with j = -1, how
    often bit s of i is one. Integers are counted from the least of their dimension."""
    width, least = len(low), np.array(low, np.int64)
    sizes = [int(h - m).bit_length() for m, h in zip(low, high, strict=True)]
    dims, bits = np.repeat(np.arange(width), sizes), np.concatenate([np.arange(b) for b in sizes] + [np.zeros(0, int)])
    first = np.cumsum([0, *sizes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((width, width, 2 * max(sizes, default=1)), np.int64)
        alone = np.zeros(len(dims), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                held = planes(integers(batch.column(0).slice(lo, ROWS), width, scale, offset) - least, dims, bits)
                alone += np.bitwise_count(held).sum(1, dtype=np.int64)
                for p, plane in enumerate(held):
                    q = first[dims[p]]
                    counts[dims[p], dims[q:], bits[p] + bits[q:]] += np.bitwise_count(held[q:] & plane).sum(1, dtype=np.int64)
        i, j, s = np.nonzero(counts)
        parts = [(i, j, s, counts[i, j, s]), (dims, np.full(len(dims), -1), bits, alone)]
        for part in parts:
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in part[:3]], pa.array(part[3], pa.int64())], names=["i", "j", "s", "n"])

    return vectors.select("v").mapInArrow(run, "i int, j int, s int, n long").groupBy("i", "j", "s").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Whitening:
    """n vectors, the sums of their integers counted from low, the eigenvalues of the covariance by size with the unit
    eigenvectors as columns, and its trace."""

    n: int
    low: list[int]
    sums: list[int]
    spread: int
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def fit(vectors: DataFrame, components: int, scale: int, offset: int) -> Whitening | None:
    """The whitening of vectors(v); None where there are none."""
    n, low, high = extents(vectors, scale, offset)
    if not n or not low:
        return None
    width = len(low)
    sums, products = [0] * width, [[0] * width for _ in low]
    for r in scatter(vectors, low, high, scale, offset).toArrow().to_pylist():  # so many for each pair of dimensions, whatever the number of rows
        i, j, weighted = r["i"], r["j"], r["n"] << r["s"]
        if j < 0:
            sums[i] += weighted
        else:
            products[i][j] += weighted
    # Python's integers are exact, and so is the division of two of them but for its last bit.
    v = np.zeros((width, width))
    total = 0
    for i in range(width):
        for j in range(i, width):
            centred = n * products[i][j] - sums[i] * sums[j]
            v[i, j] = v[j, i] = centred / (n * n)
            total += centred if i == j else 0
    values, turned = np.linalg.eigh(v)
    values, turned = values[::-1][:components], turned[:, ::-1][:, :components]
    turned = turned * np.where(turned[np.abs(turned).argmax(0), np.arange(turned.shape[1])] < 0, -1.0, 1.0)
    return Whitening(n, low, sums, max(h - m for m, h in zip(low, high, strict=True)), values, turned, total / (n * n))


def projected(vectors: DataFrame, made: Whitening, scale: int, offset: int) -> DataFrame:
    """vectors(id, v) as (id, deviation, w): the exact sum of (n x - S)^2, and the whitened components. A component
    without variance is null."""
    width, least = len(made.low), np.array(made.low, np.int64)
    some = made.values > ROUNDING * max(float(made.values[0]), 0.0)
    onto = made.vectors / np.where(some, np.sqrt(np.where(some, made.values, 1)), np.inf)
    # |n x - S| is at most n times the spread of x.
    most = made.n * made.spread
    held, kind = (np.array(made.sums, np.int64), np.int64) if most < 2**62 else (np.array(made.sums, object), object)
    narrow = width * most * most < 2**63

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                d = made.n * (integers(part.column(1), width, scale, offset) - least).astype(kind) - held
                w = ((d / made.n).astype(float) @ onto).astype(object)
                w[:, ~some] = None
                square = ((d * d) if narrow else (d.astype(object) ** 2)).sum(1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([int(x) for x in square], pa.decimal128(38, 0)), pa.array(w.tolist(), pa.list_(pa.float64()))], names=["id", "deviation", "w"])

    return vectors.select("id", "v").mapInArrow(run, vectors.select("id").schema.add("deviation", T.DecimalType(38, 0)).add("w", T.ArrayType(T.DoubleType())))


def identity_error(done: DataFrame, made: Whitening) -> float | None:
    """The largest entry of the covariance of w minus the identity, as measured: means first, then centred products."""
    some = [k for k in range(len(made.values)) if made.values[k] > ROUNDING * max(float(made.values[0]), 0.0)]
    if not some:
        return None
    w = lambda k: F.get("w", F.lit(k))
    means = done.agg(*[F.avg(w(k)) for k in some]).first()
    centred = {k: w(k) - F.lit(m) for k, m in zip(some, means, strict=True)}
    pairs = [(a, b) for a in some for b in some if a <= b]
    found = done.agg(*[F.sum(centred[a] * centred[b]) for a, b in pairs]).first()
    return max(abs(x / made.n - (a == b)) for x, (a, b) in zip(found, pairs, strict=True))


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """A row for each vector and component, by falling variance: the id, component (from 1), n, deviation, whitened,
    explained, identity_error.

    Components c of vectors become integers x = floor(scale * c) + offset. All vectors are fitted, without those that
    are null or hold null or non-finite components. deviation is exact, a decimal of 38 digits: the sum over dimensions
    of (n x - S)^2. Null ids and repeated rows are vectors like others. Short vectors are filled up with zeros; vectors
    with fewer dimensions than components have as many components as dimensions. A component in which vectors don't
    differ has a null in whitened, and an explained of 0; explained is null where no component differs. An integer that
    doesn't fit in 64 bits is an error. Other columns, of whatever name, play no part. No vectors, or empty ones only:
    no rows.
    """
    rows = finite_vectors(vectors, vector_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    made = fit(rows, components, scale, offset)
    schema = rows.select(F.col("id").alias(id_col)).schema.add("component", "integer").add("n", "long").add("deviation", T.DecimalType(38, 0)).add("whitened", "double").add("explained", "double").add("identity_error", "double")
    if made is None:
        return vectors.sparkSession.createDataFrame([], schema)
    done = materialize(projected(rows, made, scale, offset), "whitening")
    shares = [max(float(v), 0.0) / made.trace if made.trace > 0 else None for v in made.values]
    error = F.lit(identity_error(done, made)).cast("double")
    per = F.posexplode("w").alias("k", "whitened")
    share = F.get(F.array(*[F.lit(x).cast("double") for x in shares]), F.col("k"))
    return done.select("id", "deviation", per).select(F.col("id").alias(id_col), (F.col("k") + 1).alias("component"), F.lit(made.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), error.alias("identity_error"))


def query(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
