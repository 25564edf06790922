"""Centroid clustering whose nearest centroids are exact, with bounds from an n-simplex projection.

Some vectors serve as pivots, and the distances of each vector to them are computed once and kept. The pivots are the
vertices of a simplex; a vector's distances to them fix the place of an apex above it, with a coordinate for each pivot,
the last one its height over the pivots' span. Of two apexes the distance is a lower bound of that of their vectors, and
the distance with one height turned round an upper bound. In each round a vector therefore only meets the centroids
whose lower bound doesn't exceed its least upper bound, and these are compared as integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import finite_vectors, list_matrix, materialize, table

#: Pivots at most; vectors of which they are chosen; vectors that are assigned at once.
PIVOTS, SAMPLE, ROWS = 16, 2048, 4096
#: Rounding of coordinates, as a share of squared distances over the lowest height of the pivots.
SLACK = 1e-6


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact squared distances of the rows of a and b, which are paired."""
    top = max(int(np.abs(x).max(initial=0)) for x in (a, b))
    if a.shape[1] * (2 * top) ** 2 >= 2**63:
        d = a.astype(object) - b.astype(object)
        return (d * d).sum(1)
    d = a - b
    return np.einsum("ij,ij->i", d, d)


class Simplex:
    """Pivots among points such that each lies well above the span of those before it, and the apexes over them."""

    def __init__(self, points: np.ndarray, most: int = PIVOTS):
        x = points.astype(float)
        left = x - x[0]  # what the span of the pivots so far doesn't reach
        chosen, axes = [0], []
        size = float((left * left).sum(1).max(initial=0))
        while len(chosen) < min(most, len(x)):
            height = (left * left).sum(1)
            far = int(height.argmax())
            if height[far] <= 1e-9 * size or not size:
                break
            chosen.append(far)
            axes.append(left[far] / np.sqrt(height[far]))
            left = left - np.outer(left @ axes[-1], axes[-1])
        self.pivots = points[chosen]
        base = x[chosen] - x[0]
        self.base = base @ np.array(axes).T if axes else np.zeros((1, 0))  # a lower triangle under a row of zeros
        self.least = float(np.abs(np.diagonal(self.base[1:])).min(initial=np.inf))

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to the pivots."""
        return np.stack([squares(x, np.broadcast_to(p, x.shape)).astype(float) for p in self.pivots], 1)

    def apexes(self, squared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Coordinates in the span, the height over it, and the rounding of a bound that these take part in."""
        first = squared[:, :1]
        right = (first - squared[:, 1:] + (self.base[1:] ** 2).sum(1)) / 2
        flat = np.linalg.solve(self.base[1:], right.T).T if len(self.base) > 1 else np.zeros((len(squared), 0))
        height = np.sqrt(np.maximum(first[:, 0] - (flat * flat).sum(1), 0))
        far = np.sqrt(squared.max(1, initial=0))
        return flat, height, SLACK * far * (1 + far / self.least)


def nearest(x: np.ndarray, squared: np.ndarray, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row of x the nearest centroid (the first of equals), the exact squared distance, and how many pairs were
    compared. squared: the rows' squared distances to the pivots."""
    flat, height, slack = simplex.apexes(squared)
    flat_c, height_c, slack_c = simplex.apexes(simplex.distances(centroids))
    span = np.maximum((flat * flat).sum(1)[:, None] + (flat_c * flat_c).sum(1) - 2 * flat @ flat_c.T, 0)
    room = slack[:, None] + slack_c
    lower = np.sqrt(span + (height[:, None] - height_c) ** 2) - room
    upper = np.sqrt(span + (height[:, None] + height_c) ** 2) + room
    # Rounding of the products in span: of the size of the squared coordinates times that of the floats.
    lower -= np.sqrt(1e-13 * ((flat * flat).sum(1)[:, None] + (flat_c * flat_c).sum(1)))
    upper += np.sqrt(1e-13 * ((flat * flat).sum(1)[:, None] + (flat_c * flat_c).sum(1)))
    row, c = np.nonzero(lower <= upper.min(1)[:, None])
    step = 1 << 20
    exact = np.concatenate([squares(x[row[i : i + step]], centroids[c[i : i + step]]) for i in range(0, len(row), step)]) if len(row) else np.zeros(0, np.int64)
    order = np.lexsort((c, exact, row)) if exact.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], exact[i], c[i])), int)
    best = order[np.r_[True, row[order][1:] != row[order][:-1]]] if len(order) else order
    return c[best], exact[best], len(row)


def scaled(vectors: DataFrame, dims: int, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): the vectors that count, as integers floor(scale * x)."""
    fine = finite_vectors(vectors, vector_col).filter(F.size(f"`{vector_col}`") == dims)
    v = F.transform(F.col(f"`{vector_col}`").cast("array<double>"), lambda x: F.lit(scale) * x)
    whole = F.when(F.forall(v, lambda x: F.abs(x) < F.lit(2.0**62)), v).otherwise(F.raise_error(F.lit("a scaled component doesn't fit in 64 bits")).cast("array<double>"))
    return fine.select(F.col(f"`{id_col}`").alias("id"), F.transform(whole, lambda x: F.floor(x)).alias("v"))


def with_distances(rows: DataFrame, simplex: Simplex) -> DataFrame:
    """rows(id, v) with their squared distances to the pivots."""
    dims = simplex.pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = simplex.distances(list_matrix(batch.column(1), dims, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(d), pa.list_(pa.float64()))], names=["id", "v", "d"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("d", T.ArrayType(T.DoubleType()))]))


def assigned(data: DataFrame, centroids: np.ndarray, simplex: Simplex) -> DataFrame:
    """(id, cluster, distance, compared) of data(id, v, d); compared: with how many centroids a block's rows were
    compared, on its first row."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                c, d, pairs = nearest(list_matrix(part.column(1), dims, np.int64), list_matrix(part.column(2), len(simplex.pivots)), centroids, simplex)
                tried = np.zeros(len(c), np.int64)
                tried[:1] = pairs
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(c, pa.int32()), pa.array([int(x) for x in d] if d.dtype == object else d, pa.int64()), pa.array(tried)], names=["id", "cluster", "distance", "compared"])

    return data.mapInArrow(run, data.select("id").schema.add("cluster", "integer").add("distance", "long").add("compared", "long"))


def moved(data: DataFrame, centroids: np.ndarray, simplex: Simplex) -> np.ndarray:
    """The centroids after a round: exact floor(sum / count) of each component; those without vectors stay."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(centroids.shape, object), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                x = list_matrix(part.column(1), dims, np.int64)
                c = nearest(x, list_matrix(part.column(2), len(simplex.pivots)), centroids, simplex)[0]
                own, at, count = np.unique(c, return_inverse=True, return_counts=True)
                if len(x) * int(np.abs(x).max(initial=0)) < 2**63:
                    added = np.zeros((len(own), dims), np.int64)
                    np.add.at(added, at, x)
                else:
                    added = np.zeros((len(own), dims), object)
                    np.add.at(added, at, x.astype(object))
                sums[own] += added
                n[own] += count
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(own, dims), pa.int32()), pa.array(np.tile(np.arange(dims), len(own)), pa.int32()), pa.array([int(x) for x in sums[own].ravel()], pa.decimal128(38, 0)), pa.array(np.repeat(n[own], dims)),
        ], names=["cluster", "dim", "s", "n"])

    found = data.select("id", "v", "d").mapInArrow(run, "cluster int, dim int, s decimal(38,0), n long").groupBy("cluster", "dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in found.collect():  # a row for each component of a centroid
        out[r["cluster"], r["dim"]] = int(r["s"]) // r["n"]
    return out


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, salt: str = "2:", pivots: int = PIVOTS, report: dict | None = None) -> DataFrame:
    """A row for each vector: the id, cluster, distance (squared, to the final centroid), cluster_inertia, inertia, and
    centroid_sha256, the digest of the final centroid's components, joined by commas.

    Vectors with exactly dims components count, none of them null or non-finite; other rows have no row. Components
    become integers floor(scale * x). Centroids start as the k vectors whose SHA-256 of salt and id is smallest; of rows
    with one id the smaller vector comes first, null ids come last, and fewer vectors make fewer centroids. Repeated
    rows count as often as they come. Ties go to the smaller number. Other columns, of whatever name, play no part. No
    vectors: no rows. Components, distances or inertias that don't fit in 64 bits are an error; sums are exact.

    report, if given, receives the numbers of vectors, centroids and pivots, and the share of pairs of a vector and a
    centroid that the bounds left to compare at the end.
    """
    spark = vectors.sparkSession
    rows = scaled(vectors, dims, id_col, vector_col, scale)
    schema = rows.select(F.col("id").alias(id_col)).schema.add("cluster", "integer").add("distance", "long").add("cluster_inertia", "long").add("inertia", "long").add("centroid_sha256", "string")
    start = rows.withColumn("h", F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()  # k vectors
    if not start:
        return spark.createDataFrame([], schema)
    centroids = np.array([r["v"] for r in start], np.int64).reshape(len(start), dims)
    sample = rows.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()  # at most SAMPLE vectors
    simplex = Simplex(np.array([r["v"] for r in sample], np.int64).reshape(len(sample), dims), pivots)
    data = materialize(with_distances(rows, simplex), "simplex-distances")
    for _ in range(rounds):
        centroids = moved(data, centroids, simplex)
    done = materialize(assigned(data, centroids, simplex), "simplex-clusters")
    per = done.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"), F.sum("compared").alias("compared"), F.count(F.lit(1)).alias("n")).collect()  # a row for each centroid
    total = sum(r["cluster_inertia"] for r in per)
    if report is not None:
        n = sum(r["n"] for r in per)
        report.update(vectors=n, centroids=len(centroids), pivots=len(simplex.pivots), compared=sum(r["compared"] for r in per) / (n * len(centroids)))
    text = {i: ",".join(map(str, c)) for i, c in enumerate(centroids.tolist())}
    about = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], text[r["cluster"]]) for r in per], "cluster int, cluster_inertia long, _text string")
    joined = done.join(F.broadcast(about), "cluster")  # a row for each centroid
    return joined.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), F.sha2("_text", 256).alias("centroid_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def sql(k: int = 40, rounds: int = 5) -> str:
    """The same by all distances: a relation of vectors, then the assignment and the new centroids of each round."""
    parts = [
        "v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        "x as materialized (select r, unnest(v) as x, unnest(range(64)) as dim from v)",
        f"s as (select r, row_number() over (order by sha256('2:' || vec_id::varchar), v) - 1 as cluster from v qualify cluster < {k})",
        "c0 as materialized (select cluster, dim, x as c from s join x using (r))",
    ]
    for i in range(rounds + 1):
        parts.append(f"d{i} as (select r, cluster, sum((x - c) * (x - c))::bigint as distance from x join c{i} using (dim) group by r, cluster)")
        parts.append(f"a{i} as materialized (select r, cluster, distance from d{i} qualify row_number() over (partition by r order by distance, cluster) = 1)")
        if i < rounds:
            parts.append(f"m{i} as (select cluster, dim, floor(sum(x)::double / count(*))::bigint as c from a{i} join x using (r) group by cluster, dim)")
            parts.append(f"c{i + 1} as materialized (select c{i}.cluster, c{i}.dim, coalesce(m{i}.c, c{i}.c) as c from c{i} left join m{i} on c{i}.cluster = m{i}.cluster and c{i}.dim = m{i}.dim)")
    return "with " + ",\n".join(parts) + f""",
t as (select cluster, sha256(string_agg(c::varchar, ',' order by dim)) as centroid_sha256 from c{rounds} group by cluster)
select vec_id, cluster::integer as cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia, centroid_sha256
from a{rounds} join v using (r) join t using (cluster)"""


SQL = sql()
