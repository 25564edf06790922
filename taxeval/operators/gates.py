"""Consistency gates: each returns rows that tell what is wrong, none if all is right."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import small

#: Tools that a cohort is checked for, at most.
MOST_TOOLS = 1000


def assert_empty(violations: DataFrame, what: str) -> None:
    found = violations.limit(5).collect()
    if found:
        raise ValueError(f"{what}: {[r.asDict() for r in found]}")


def matrix(rows: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, problem): missing from the grid, outside it, or there more than once."""
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    g = grid.select(*keys).distinct()
    missing = g.join(n, keys, "left_anti").withColumn("problem", F.lit("missing"))
    extra = n.select(*keys).join(g, keys, "left_anti").withColumn("problem", F.lit("extra"))
    return missing.unionByName(extra).unionByName(n.filter("n > 1").select(*keys, F.lit("duplicate").alias("problem")))


def tool_coverage(rows: DataFrame, tools: DataFrame, samples: DataFrame) -> DataFrame:
    """matrix() over every expected sample of every expected tool; unexpected tools as such."""
    known = rows.join(tools, "tool", "left_semi")
    # Every tool needs every sample: a grid over the list of tools, whose length is checked.
    grid = samples.select("sample").distinct().crossJoin(small(tools.select("tool").distinct(), MOST_TOOLS, "tools"))
    odd = rows.join(tools, "tool", "left_anti").select(F.lit(None).cast("string").alias("sample"), "tool").distinct().withColumn("problem", F.lit("unexpected tool"))
    return matrix(known, grid, ["sample", "tool"]).unionByName(odd)


def same_samples(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of those that only one side has."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.exceptAll(y).withColumn("side", F.lit("left")).union(y.exceptAll(x).withColumn("side", F.lit("right")))


def sample_count(observed: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    return observed.join(expected, key, "full_outer").filter(~F.col("observed").eqNullSafe(F.col("expected")))


def audit_closure(rows: DataFrame) -> DataFrame:
    """Rows of an audit whose parts don't add up."""
    c = F.col
    right = (c("strict") + c("tied") == c("supported")) & (c("strict") + c("tied") + c("non_target") + c("unmapped") == c("candidate")) & (c("missing") == 0)
    return rows.filter(~F.coalesce(right, F.lit(False)))


def one_match(pairs: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """(id, problem): left rows without exactly one match, right rows matched twice or left over."""
    n = left.select(a).join(pairs.groupBy(a).agg(F.count(F.lit(1)).alias("n")), a, "left").fillna(0, ["n"])
    m = right.select(b).join(pairs.groupBy(b).agg(F.count(F.lit(1)).alias("n")), b, "left").fillna(0, ["n"])
    row = lambda df, c, cond, what: df.filter(cond).select(F.col(c).cast("string").alias("id"), F.lit(what).alias("problem"))
    return row(n, a, "n <> 1", "not one match").union(row(m, b, "n > 1", "matched twice")).union(row(m, b, "n = 0", "left over"))


def tolerance(rows: DataFrame, pairs: list[tuple[str, str]], texts: list[tuple[str, str]] = (), eps: float = 1e-9) -> DataFrame:
    """Rows in which two numbers differ by more than eps, or two texts but for case."""
    bad = F.lit(False)
    for a, b in pairs:
        bad = bad | (F.abs(F.col(a) - F.col(b)) > eps)
    for a, b in texts:
        bad = bad | (F.lower(a) != F.lower(b))
    return rows.filter(bad)


def paired_files(files: DataFrame) -> DataFrame:
    """(sample, files) of samples(sample, path) that don't have exactly two files."""
    return files.groupBy("sample").agg(F.count(F.lit(1)).alias("files")).filter("files <> 2")


def required_columns(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c not in df.columns]


def unknown_values(df: DataFrame, column: str, known: DataFrame) -> DataFrame:
    return df.select(column).distinct().join(known.select(column), column, "left_anti")
