"""Whitening and clustering against plain versions, and on odd rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxeval.llm import clustering, topk, whitening

NAN, INF = float("nan"), float("inf")
CLASHES = ("id", "v", "n", "w", "k", "whitened", "deviation", "component", "cluster", "distance", "d", "h")


def clashing(df):
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df


def whitened_plainly(vectors, components):
    """With Python's integers, row by row."""
    width = max(len(v) for v in vectors)
    x = [[math.floor(1024 * c) + 100_000 for c in [*v, *[0.0] * (width - len(v))]] for v in vectors]
    n, sums = len(x), [sum(r[d] for r in x) for d in range(width)]
    centred = [[n * r[d] - sums[d] for d in range(width)] for r in x]
    cov = np.array([[sum(r[i] * r[j] for r in centred) / n**3 for j in range(width)] for i in range(width)])
    values, turned = np.linalg.eigh(cov)
    values, turned = values[::-1][:components], turned[:, ::-1][:, :components]
    return [sum(c * c for c in r) for r in centred], np.array(centred, float) / n @ turned / np.sqrt(values), values / np.trace(cov)


def test_whitening_against_plain_integers(spark):
    rng = np.random.default_rng(2)
    data = (rng.normal(size=(211, 5)) * [3, 1, 0.5, 0.2, 90] + [0, -200, 5, 0, 7]).tolist()
    df = spark.createDataFrame(list(enumerate(data)), "vec_id long, embedding array<double>").repartition(3)
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(df, components=4).collect()}
    deviations, want, shares = whitened_plainly(data, 4)
    assert len(got) == 211 * 4
    for k in range(4):
        mine = np.array([got[i, k + 1]["whitened"] for i in range(211)])
        assert min(np.abs(mine - want[:, k]).max(), np.abs(mine + want[:, k]).max()) < 1e-9
        assert all(abs(got[i, k + 1]["explained"] - shares[k]) < 1e-9 * shares[k] for i in range(211))
    assert all(int(got[i, 1]["deviation"]) == deviations[i] and got[i, 1]["n"] == 211 and got[i, 1]["identity_error"] < 1e-9 for i in range(211))


def test_planes_give_exact_products(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 50)
    rng = np.random.default_rng(3)
    x = np.c_[rng.integers(-(2**40), 2**40, 333), rng.integers(0, 2, 333), np.full(333, 7), rng.integers(-5, 900, 333)]
    df = spark.createDataFrame([(r.tolist(),) for r in x.astype(float)], "v array<double>").repartition(2)
    n, low, high = whitening.extents(df, 1, 0)
    assert (n, low, high) == (333, x.min(0).tolist(), x.max(0).tolist())
    y = (x - x.min(0)).astype(object)
    found = {}
    for r in whitening.scatter(df, low, high, 1, 0).collect():
        found[r["i"], r["j"]] = found.get((r["i"], r["j"]), 0) + (r["n"] << r["s"])
    for i in range(4):
        assert found.get((i, -1), 0) == y[:, i].sum()
        for j in range(i, 4):
            assert found.get((i, j), 0) == (y[:, i] * y[:, j]).sum()


def test_whitening_query_is_white(spark, sf_dir, duck):
    got = whitening.query(spark, sf_dir).toPandas()
    vectors = [r[0] for r in duck.execute("select embedding from embeddings").fetchall()]
    assert len(got) == 8 * len(vectors)
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.cov(wide.T, bias=True) - np.eye(8)).max() < 1e-9
    assert sorted(got[got.component == 1].deviation) == sorted(whitened_plainly(vectors, 8)[0])


def test_whitening_on_odd_rows(spark):
    rows = [(0, [1.0, 0.0, 5.0]), (0, [1.0, 0.0, 5.0]), (None, [0.25, 2.0, 5.0]), (1, [0.5, 1.0, 5.0]), (2, None), (3, [NAN, 1.0, 1.0]), (4, [None, 1.0, 1.0]), (5, [1.0, INF, 0.0])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = whitening.whiten(df).collect()
    assert len(got) == 4 * 3 and {r["n"] for r in got} == {4} and sum(r["vec_id"] is None for r in got) == 3
    assert all((r["whitened"] is None) == (r["component"] == 3) and r["identity_error"] < 1e-9 for r in got if r["component"] != 2)  # one dimension is constant
    # Short vectors are filled up, large components stay exact, equal vectors have no variance.
    big = whitening.whiten(spark.createDataFrame([(0, [2.0**45]), (1, [-(2.0**45), 1.0]), (2, [])], "vec_id long, embedding array<double>"))
    x = [[2**55, 0], [-(2**55), 1024], [0, 0]]
    s = [sum(c) for c in zip(*x, strict=True)]
    assert {r["vec_id"]: int(r["deviation"]) for r in big.collect()} == {i: sum((3 * c - t) ** 2 for c, t in zip(v, s, strict=True)) for i, v in enumerate(x)}
    same = whitening.whiten(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert len(same) == 4 and {(r["whitened"], r["explained"], r["identity_error"], int(r["deviation"])) for r in same} == {(None, None, None, 0)}
    for none in (df.limit(0), df.filter("vec_id = 2"), spark.createDataFrame([(0, [])], "vec_id long, embedding array<double>")):
        assert whitening.whiten(none).collect() == []
    with pytest.raises(Exception, match="64 bits"):
        whitening.whiten(spark.createDataFrame([(0, [1e300]), (1, [0.0])], "vec_id long, embedding array<double>")).collect()


def clustered_plainly(rows, k, rounds, dims):
    """rows: (id, vector); (id, cluster, distance) of each, and the centroids, by all distances of Python's integers."""
    data = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(data, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    for turn in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in data]
        if turn < rounds:
            for j in range(len(centroids)):
                mine = [v for (_, v), (_, c) in zip(data, found, strict=True) if c == j]
                if mine:
                    centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return sorted((-1 if i is None else i, c, d) for (i, _), (d, c) in zip(data, found, strict=True)), centroids


def checked(df, rows, **how):
    report = {}
    got = clustering.clusters(df, report=report, **how).collect()
    want, centroids = clustered_plainly(rows, how["k"], how["rounds"], how["dims"])
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"]) for r in got) == want
    total = sum(d for _, _, d in want)
    for r in got:
        assert r["inertia"] == total and r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()
    return report


def test_clusters_against_all_distances(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6)) * 3
    x = np.repeat(centres, 30, 0) + rng.normal(size=(360, 6)) * 0.1
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for pivots in (1, 3, 16):
        report = checked(df, rows, k=12, rounds=4, dims=6, pivots=pivots)
        assert report["pivots"] == min(pivots, 7)
    assert report["compared"] < 0.3  # bounds leave few centroids of clustered vectors


def test_bounds_hold(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(-300, 300, (200, 8))
    simplex = clustering.Simplex(x[:60], 5)
    flat, height, slack = simplex.apexes(simplex.distances(x))
    for i in range(200):
        true = np.sqrt(((x - x[i]) ** 2).sum(1))
        span = ((flat - flat[i]) ** 2).sum(1)
        assert (np.sqrt(span + (height - height[i]) ** 2) <= true + slack + slack[i]).all()
        assert (np.sqrt(span + (height + height[i]) ** 2) >= true - slack - slack[i]).all()


def test_clusters_on_odd_rows(spark):
    same = [0.5, 0.25]
    rows = [(i, same) for i in range(6)] + [(7, [9.0, -9.0]), (7, [9.0, -9.0]), (None, [9.0, -8.0]), (8, None), (9, [1.0]), (10, [NAN, 1.0]), (11, [None, 1.0]), (12, [INF, 0.0]), (13, []), (14, [1.0, 2.0, 3.0]), (7, [8.0, -9.0])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    for k in (1, 3, 40):
        checked(df, rows, k=k, rounds=2, dims=2)
    far = [(0, [3e9, 1.0]), (1, [3e9, 2.0]), (2, [-3e9, 1.0]), (3, [-3e9, 1.5]), (4, [0.0, 0.0])]
    checked(spark.createDataFrame(far, "vec_id long, embedding array<double>"), far, k=5, rounds=2, dims=2)  # beyond 64 bits when compared
    assert clustering.clusters(df.limit(0)).collect() == [] == clustering.clusters(df).collect()
    with pytest.raises(Exception, match="64 bits"):
        clustering.clusters(spark.createDataFrame([(0, [1e300])], "vec_id long, embedding array<double>"), dims=1).collect()


def plain_top(rows, asks, k):
    x = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows]
    out = {}
    for i, v in x:
        if asks(i):
            scores = {(-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in x if j != i}
            out[i] = [(j, -s) for s, j in sorted(scores)[:k]]
    return out


def top(spark, rows, k):
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2), lambda i: i % 100 == 0, k=k).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_long_vectors_take_part_in_searches(spark):
    rows = [(0, [1.0, 0.0]), (100, [4e6, 0.0]), (1, [1.0, 1.0])]
    assert top(spark, rows, 10) == {0: [(100, 4_194_304_000_000), (1, 1024**2)], 100: [(0, 4_194_304_000_000), (1, 4_194_304_000_000)]}
    rng = np.random.default_rng(8)
    some = (rng.normal(size=(300, 3)) * 10.0 ** rng.integers(-2, 5, (300, 1))).tolist()
    rows = [(i, v) for i, v in enumerate(some)]
    assert top(spark, rows, 7) == plain_top(rows, lambda i: i % 100 == 0, 7)
    # Differences far beyond the precision of floats decide, and what floats can't hold is exact too.
    near = [(0, [2.0**20, 1.0, 0.0]), (1, [2.0**22, 0.0, 0.0]), (2, [2.0**22, 1.0 / 1024, 0.0]), (3, [2.0**22, -1.0 / 1024, 0.0]), (4, [0.0, 0.0, 1e200]), (100, [0.0, 5.0, 0.0])]
    assert top(spark, near, 5) == plain_top(near, lambda i: i % 100 == 0, 5)


def test_scores_beyond_64_bits_are_errors(spark):
    for far in (4e12, -4e12, 1e300, 1e308):
        with pytest.raises(Exception, match="64 bits|finite"):
            top(spark, [(0, [4e12, 1.0]), (1, [far, 0.0])], 3)
    # One that isn't among the best doesn't matter.
    assert top(spark, [(0, [4e12, 1.0]), (1, [-4e12, 0.0]), (2, [1.0, 0.0])], 1) == {0: [(2, math.floor(4e12 * 1024) * 1024)]}


def test_repeated_rows_of_one_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    rows = [(7, [float(i % 40), 1.0]) for i in range(400)] + [(100, [1.0, 0.5])] * 3 + [(200, [0.5, 0.25])]
    want = plain_top(list(dict.fromkeys((i, tuple(v)) for i, v in rows)), lambda i: i % 100 == 0, 5)
    assert top(spark, rows, 5) == want
