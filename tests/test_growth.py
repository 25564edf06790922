"""What is moved to score reads: taxa share their paths, reads are moved once, aggregations need no sort before a shuffle."""

import random

from pyspark.sql import functions as F

from taxeval.operators import reads, taxonomy
from taxeval.plans.bindings import READS, Bound


def sorts_before_shuffles(df):
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [b for a, b in zip(lines, lines[1:]) if "Exchange hashpartitioning" in a and "SortAggregate" in b]


def test_taxa_share_their_paths(spark, monkeypatch):
    tree = [(1, 1, "root"), (2, 1, "genus"), (3, 1, "genus")] + [(i, 2 + i % 2, "species") for i in range(10, 210)]
    nodes = spark.createDataFrame(tree, "taxid long, parent long, rank string")
    seen = []
    put = taxonomy.written
    monkeypatch.setattr(taxonomy, "written", lambda df, name: seen.append((name, put(df, name))) or seen[-1][1])
    up = taxonomy.paths(nodes, nodes.filter("rank = 'species'").select("taxid"))
    assert up.count() == 200 and up.filter("size(path) = 3 and ranks[2] = 'root' and known and not cycle").count() == 200
    assert [df.count() for name, df in seen if name == "parents"] == [2, 1, 0]  # only distinct parents go on


def test_paths_of_any_graph(spark):
    rng = random.Random(5)
    parent = {i: rng.choice([i // 3, i // 3, i // 3, rng.randrange(400), 10**6 + i]) for i in range(1, 300)} | {200: 201, 201: 202, 202: 200, 7: 21, 21: 7, 61: 61}
    nodes = spark.createDataFrame([(i, p, f"r{i % 4}") for i, p in parent.items()], "taxid long, parent long, rank string")
    want = {}
    for s in range(310):
        path = [s]
        while (p := parent.get(path[-1], path[-1])) != path[-1] and p not in path:
            path.append(p)
        want[s] = (path, path[-1] in parent, parent.get(path[-1], path[-1]) != path[-1])
    up = taxonomy.paths(nodes, spark.range(310).select("id", (F.col("id") % 2 == 0).alias("even")))
    got = {r["seed"]: (r["path"], r["known"], r["cycle"]) for r in up.collect()}
    assert got == want and any(c for *_, c in want.values())
    assert up.filter("even <> (seed % 2 = 0)").count() == 0
    assert up.filter("not forall(sequence(1, size(path)), i -> path[i - 1] not between 1 and 299 or ranks[i - 1] = 'r' || path[i - 1] % 4)").count() == 0


def test_lookup_needs_no_sort(spark):
    truth = spark.createDataFrame([("k", "a/1", 5)], "k string, read_id string, taxid long")
    assert not sorts_before_shuffles(reads.lookup_predictions(truth, truth, ["k"]))


def test_reads_are_moved_unsorted_and_nulls_have_no_part_in_ids(spark, tmp_path, sf_dir):
    import duckdb

    d = str(tmp_path)
    c = duckdb.connect()
    for t in ("orders", "customer", "nation", "supplier", "lineitem"):
        odd = f"(select * from '{sf_dir}/{t}.parquet' union all by name select * from '{sf_dir}/{t}.parquet' where l_orderkey < 50)" if t == "lineitem" else f"'{sf_dir}/{t}.parquet'"
        if t == "lineitem":
            null = lambda c, n: f"case when hash(l_orderkey, l_linenumber, l_tax, {n}) % 4 = 0 then null when l_orderkey < 40 then {n} else {c} end as {c}"
            odd += " union all by name select * replace (" + ", ".join(null(k, n) for n, k in enumerate(("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax", "l_quantity", "l_returnflag", "l_linestatus"), 1) if k not in ("l_linestatus", "l_returnflag")) + f", case when l_linenumber = 2 then null else l_returnflag end as l_returnflag) from '{sf_dir}/lineitem.parquet'"
        c.execute(f"copy (select * from {odd}) to '{d}/{t}.parquet' (format parquet)")
        c.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    df = Bound(spark, d).reads()
    order = ["read_id", "tool", "taxid", "pred", "weight"]
    got = sorted(map(str, (tuple(r) for r in df.select(*order).collect())))
    want = sorted(map(str, c.execute(f"with {READS} select {', '.join(order)} from facts").fetchall()))
    assert got == want
    assert not sorts_before_shuffles(df)
