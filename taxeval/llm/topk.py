"""Exact top-k search by a Voronoi join.

Vectors of a sample serve as pivots; their number grows with the square root of the data. Each vector goes to the cell
of its nearest pivot, and of each cell the count and the radius are known. Neighbouring cells form groups, such that a
group holds about CHUNK queries; queries are grouped by their own cell's group, and a group with more is parted.

A query is first solved in its own cell, which gives it a lower bound, its k-th score there. A vector x of a cell with
pivot p is at most q.p + |q| |x - p| for a query q, so of each cell a group only needs the vectors that lie at least
(bound - q.p) / |q| from p for some query q of it: one distance for each group and cell, and cells whose radius is
below it aren't needed at all. Only these vectors are sent to the group, in blocks of bounded size; blocks are solved
on their own and their best k merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import finite_vectors, list_matrix, materialize, table

#: Pivots at most (they are broadcast); vectors in a block; queries in a group; scores held at once in a task.
PIVOTS, BLOCK, CHUNK, SCORES = 8192, 8192, 4096, 2_000_000
#: The score that stands for no bound, and for scores below the range of 64 bits.
LOWEST = -(2**63)


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of each component, a whole number as double; without rows whose id or vector is null,
    or that hold a null or non-finite component."""
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.lit(scale) * x)
    fits = F.forall(v, lambda x: F.abs(x) < F.lit(float("inf")))
    # Doubles from 2^53 on are whole, and floor() is for those that fit in a long.
    v = F.transform(v, lambda x: F.when(F.abs(x) < F.lit(2.0**53), F.floor(x).cast("double")).otherwise(x))
    v = F.when(fits, v).otherwise(F.raise_error(F.lit("a scaled component isn't finite")).cast("array<double>"))
    return finite_vectors(vectors, vector_col).filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def different(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A place of each pair of an id and a vector, in order of the ids."""
    order = np.argsort(ids, kind="stable")
    if (ids[order][1:] != ids[order][:-1]).all():
        return order
    order = np.lexsort((*x.T[::-1], ids))
    new = np.ones(len(order), bool)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (x[order][1:] != x[order][:-1]).any(1)
    return order[new]


def assign(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, v, cell, dist) with the nearest pivot (the first of equals) and the distance to it."""
    held = vectors.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOTS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        step = max(16, SCORES // len(p))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                x = list_matrix(part.column(1), p.shape[1])
                some = np.sort(different(part.column(0).to_numpy(), x))  # of repeated rows one goes on
                part, x = part.take(pa.array(some)), x[some]
                with np.errstate(over="ignore", invalid="ignore"):  # any cell will do for what is too far for floats
                    cell = ((p * p).sum(1) - 2 * x @ p.T).argmin(1)
                    dist = np.sqrt(((x - p[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell, pa.int32()), pa.array(dist)], names=["id", "v", "cell", "dist"])

    return vectors.mapInArrow(run, "id long, v array<double>, cell int, dist double")


def grouped_cells(pivots: np.ndarray, asking: np.ndarray, most: int) -> np.ndarray:
    """A group for each cell: cells are parted along the direction in which their pivots differ most, until the
    queries of a group (asking: of each cell) are at most `most`, or it is one cell."""
    out = np.zeros(len(pivots), np.int64)
    todo, groups = [np.arange(len(pivots))], 0
    while todo:
        cells = todo.pop()
        if len(cells) == 1 or asking[cells].sum() <= most:
            out[cells] = groups
            groups += 1
            continue
        x = pivots[cells].astype(float)
        x -= x.mean(0)
        way = x[np.argmax((x * x).sum(1))]
        for _ in range(3):  # about the direction of the largest variance
            way = x.T @ (x @ way)
            way /= max(float(np.abs(way).max()), 1e-300)
        order = cells[np.argsort(x @ way, kind="stable")]
        half = int(np.searchsorted(np.cumsum(asking[order]), asking[order].sum() / 2)) + 1
        half = min(max(half, 1), len(order) - 1)
        todo += [order[:half], order[half:]]
    return out


def solve(asked: DataFrame, sent: DataFrame, sizes: DataFrame, k: int, width: int) -> DataFrame:
    """(query_id, vec_id, score): of each query of a group and each block of what is sent to the group the best k.

    asked: (grp, query_id, q, bound); sent: (grp, id, v); sizes: (grp, n), at most so many are sent to each group.
    """
    blocks = sizes.select("grp", F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int").alias("blocks"))
    # A row for each group of about CHUNK queries: Spark's own size check decides if these are broadcast.
    left = asked.join(blocks, "grp").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = sent.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int"))

    def local(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, x = right.column("id").to_numpy(), list_matrix(right.column("v"), width)
        queries, q = left.column("query_id").to_numpy(), list_matrix(left.column("q"), width)
        bound = left.column("bound").to_numpy(zero_copy_only=False)
        order = different(ids, x)  # repeated rows count once
        ids, x = ids[order], x[order]
        out: list[list[np.ndarray]] = [[], [], []]
        step = max(1, SCORES // max(1, len(ids)))
        small = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * width < 2**53  # exact in floats
        for lo in range(0, len(queries) if len(ids) else 0, step):
            part = q[lo : lo + step]
            scores = (part @ x.T).astype(np.int64) if small else None
            about, off = (None, None) if small else rounded(part, x)
            for i in range(len(part)):
                others = ids != queries[lo + i]
                if small:
                    fine = np.flatnonzero((scores[i] >= bound[lo + i]) & others)
                    mine = scores[i][fine]
                else:
                    fine, mine = exact(part[i], x, about[i], off[i], np.flatnonzero(others), int(bound[lo + i]), k)
                if len(fine) > k:
                    cut = np.partition(mine, len(fine) - k)[len(fine) - k]
                    fine, mine = fine[mine >= cut], mine[mine >= cut]
                    top = np.lexsort((ids[fine], np.invert(mine)))[:k]  # ties go to smaller ids
                    fine, mine = fine[top], mine[top]
                out[0].append(np.full(len(fine), queries[lo + i]))
                out[1].append(ids[fine])
                out[2].append(mine)
        return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    keys = ["grp", "block"]
    left, right = left.select(*keys, "query_id", "q", "bound").groupBy(*keys), right.select(*keys, "id", "v").groupBy(*keys)
    return left.cogroup(right).applyInArrow(local, "query_id long, vec_id long, score long")


def rounded(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores in floats, and how far off they may be; what floats can't hold is off without limit."""
    with np.errstate(over="ignore", invalid="ignore"):
        about = q @ x.T
        off = 4 * q.shape[1] * np.finfo(float).eps * (np.abs(q) @ np.abs(x).T)
    lost = ~np.isfinite(about) | ~np.isfinite(off)
    return np.where(lost, 0, about), np.where(lost, np.inf, off)


def exact(q: np.ndarray, x: np.ndarray, about: np.ndarray, off: np.ndarray, among: np.ndarray, bound: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The places among which the k best scores are, and these, as whole numbers of 64 bits: of what floats leave
    possible. Scores over their range are an error, those below count as LOWEST."""
    low, high = (about - off)[among], (about + off)[among]
    least = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
    fine = among[high >= max(least, bound - 1e-15 * abs(bound) if bound > LOWEST else -np.inf)]
    factors = [int(c) for c in q]
    scores = [sum(a * int(b) for a, b in zip(factors, x[i], strict=True)) for i in fine]
    if max(scores, default=0) >= 2**63:
        raise OverflowError("a score doesn't fit in 64 bits")
    whole = np.array([max(s, LOWEST) for s in scores], np.int64)
    return fine[whole >= bound], whole[whole >= bound]


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query. A query has at most k rows of each block that it met."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).filter(F.col("rank") <= k)


def needs(asked: DataFrame, cells: np.ndarray, centre: np.ndarray, radius: np.ndarray, ids: np.ndarray, k: int, width: int) -> DataFrame:
    """(grp, cell, least): the cells that a group needs besides a query's own, and how far from the pivot the vectors
    lie that it needs of them, for some query of the group. asked: (grp, query_id, q, cell, bound).

    A query whose own cell held fewer than k others takes its bound from the summaries: a vector of a cell is at least
    q.p - |q| radius, and the best cells that hold k others (ids: different ids in each cell) tell a k-th score.
    """
    held = asked.sparkSession.sparkContext.broadcast((cells, centre, radius, ids))  # a row for each pivot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, p, r, n = held.value
        sizes = np.sqrt((p**2).sum(1))
        step = max(16, SCORES // len(own))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                grp, home = part.column(0).to_numpy(), part.column(3).to_numpy()
                q = list_matrix(part.column(2), width)
                low = part.column(4).to_numpy(zero_copy_only=False).astype(float)
                with np.errstate(over="ignore", invalid="ignore"):
                    size = np.sqrt((q * q).sum(1))[:, None]
                    slack = 1e-9 * size * (sizes + r) + 1e-6  # rounding
                    at_pivot = q @ p.T
                    worst = at_pivot - size * r - slack
                worst[~np.isfinite(worst)] = -np.inf
                for i in np.flatnonzero(low == float(LOWEST)):
                    surely = worst[i]
                    order = np.argsort(-surely)
                    enough = np.searchsorted(np.cumsum(n[order]), k + 1)  # one of them may be the query itself
                    low[i] = surely[order[enough]] if enough < len(order) else -np.inf
                with np.errstate(over="ignore", invalid="ignore"):
                    short = low[:, None] - at_pivot - slack
                    least = np.where(size > 0, short / np.where(size > 0, size, 1), np.where(short <= 0, -np.inf, np.inf))
                least[~np.isfinite(worst)] = -np.inf  # what is beyond floats rules nothing out
                least[own == home[:, None]] = np.inf
                order = np.argsort(grp, kind="stable")
                first = np.flatnonzero(np.r_[True, grp[order][1:] != grp[order][:-1]])
                least = np.minimum.reduceat(least[order], first, axis=0)
                i, j = np.nonzero(least <= r)
                yield pa.RecordBatch.from_arrays([pa.array(grp[order][first][i], pa.int64()), pa.array(own[j], pa.int32()), pa.array(least[i, j] * (1 - 1e-9) - 1e-6)], names=["grp", "cell", "least"])

    return asked.select("grp", "query_id", "q", "cell", "bound").mapInArrow(run, "grp long, cell int, least double").groupBy("grp", "cell").agg(F.min("least").alias("least"))


def top_k(vectors: DataFrame, queries: "F.Column", k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, pivots: int = PIVOTS, report: dict | None = None) -> DataFrame:
    """The k rows with the highest integer inner product for each query: query_id, rank from 1, vec_id, score.

    `queries` is a condition on the id that says which rows ask. A row doesn't find rows with its own id; ties go to
    the smaller id; all rows come where there are fewer. Rows with a null id, a null vector, or a null or non-finite
    component take no part; all others do, however long they are. Scores are exact; one of a result that doesn't fit in
    64 bits is an error. Shorter vectors are filled up with zeros. Rows equal in id and vector count once; of different
    vectors with a query's id the largest asks. Other columns, of whatever name, play no part. No rows: no rows.

    report, if given, receives the numbers of vectors, queries, pivots and groups, and `sent`, the vectors sent to
    groups beside the ones of the queries' own cells.
    """
    spark = vectors.sparkSession
    rows = scaled(vectors, id_col, vector_col, scale)
    schema = "query_id long, rank int, vec_id long, score long"
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], schema)
    width = max(1, width)
    some = min(pivots, max(16, math.ceil(4 * math.sqrt(n))))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(some).collect()  # at most `pivots` vectors
    p = np.zeros((len(sample), width))
    for i, r in enumerate(sample):
        p[i, : len(r["v"])] = r["v"]
    p = np.unique(p, axis=0)
    data = materialize(assign(rows, p), "voronoi")
    asks = data.filter(queries(F.col("id"))).groupBy("id").agg(F.max(F.struct("v", "cell")).alias("m")).select(F.col("id").alias("query_id"), F.col("m.v").alias("q"), F.col("m.cell").alias("cell"))
    asks = materialize(asks, "voronoi-queries")
    per_cell = data.groupBy("cell").agg(F.max("dist").alias("r"), F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))
    summary = sorted(per_cell.collect(), key=lambda r: r["cell"])  # a row for each pivot
    asking = np.zeros(len(p), np.int64)
    for r in asks.groupBy("cell").count().collect():  # a row for each pivot
        asking[r["cell"]] = r["count"]
    group = grouped_cells(p, asking, CHUNK)
    # A group that is one cell with more queries is parted by their hashes; grp: group * most + part.
    load = np.zeros(group.max() + 1, np.int64)
    np.add.at(load, group, asking)
    parts = np.maximum(1, -(-load // CHUNK))
    most = int(parts.max())
    cells = spark.createDataFrame(pa.table([pa.array(np.arange(len(p)), pa.int32()), pa.array(group), pa.array(parts[group])], names=["cell", "_group", "_parts"]))
    counts = spark.createDataFrame(pa.table([pa.array([r["cell"] for r in summary], pa.int32()), pa.array([r["n"] for r in summary])], names=["cell", "n"]))
    asked = asks.join(F.broadcast(cells), "cell").withColumn("grp", F.col("_group") * most + F.pmod(F.xxhash64("query_id"), F.col("_parts")))
    # Home: each query in its own cell; a group of queries for each cell and part.
    at_home = asked.withColumn("grp", F.col("cell").cast("long") * most + F.pmod(F.xxhash64("query_id"), F.col("_parts"))).select("grp", "cell", "query_id", "q", F.lit(LOWEST).cast("long").alias("bound"))
    homes = at_home.select("cell", (F.col("grp") + 0).alias("grp")).distinct()
    home = solve(at_home.drop("cell"), data.join(homes, "cell").select("grp", "id", "v"), homes.join(F.broadcast(counts), "cell").select("grp", "n"), k, width)
    home = materialize(best(home, k), "voronoi-home")
    bounds = home.filter(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    asked = materialize(asked.join(bounds, "query_id", "left").select("grp", "query_id", "q", "cell", F.coalesce("bound", F.lit(LOWEST).cast("long")).alias("bound")), "voronoi-asked")
    own, radius, ids = (np.array([r[c] for r in summary]) for c in ("cell", "r", "ids"))
    need = materialize(needs(asked, own, p[own], radius, ids, k, width), "voronoi-needs")
    sent = data.join(need, "cell").filter(F.col("dist") >= F.col("least")).select("grp", "id", "v")
    received = data.select("cell", "dist").join(need, "cell").filter(F.col("dist") >= F.col("least")).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    far = solve(asked.select("grp", "query_id", "q", "bound"), sent, received, k, width)
    if report is not None:
        report.update(vectors=n, queries=int(asking.sum()), pivots=len(p), groups=int(parts.sum()), sent=sent.count())
    fits = F.when(F.col("score") > LOWEST, F.col("score")).otherwise(F.raise_error(F.lit("a score doesn't fit in 64 bits")).cast("long"))
    return best(home.select("query_id", "vec_id", "score").unionByName(far), k).select("query_id", "rank", "vec_id", fits.alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
