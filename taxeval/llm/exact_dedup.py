"""Exact deduplication by skew-safe combining, with DataFrame functions only.

1. Local: rows with equal (digest, text, salt) are combined inside each map task (partial aggregation).
2. Salted: what is left meets by (digest, text, salt), so that a hot text is dealt out over `salts` tasks.
3. Global: the winners of the salts, a few rows a text, meet by (digest, text).

The full text is a grouping key at each stage, so that a digest never decides alone that two texts are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import looked_up, materialize, table

SALTS = 16
#: Repeated rows that one task writes out together.
RUN = 10_000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def winners(docs: DataFrame, id_col: str, text_col: str, salts: int = SALTS, digest=sha256) -> DataFrame:
    """A row for each distinct text (null counts as empty): _digest, _text, _keep (largest id, null if all ids are
    null) and _size (rows with this text)."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.select("_id", "_text", digest(F.col("_text")).alias("_digest"), F.pmod(F.xxhash64("_id"), F.lit(salts)).alias("_salt"))
    salted = rows.groupBy("_digest", "_text", "_salt").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    return salted.groupBy("_digest", "_text").agg(F.max("_keep").alias("_keep"), F.sum("_size").alias("_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=sha256) -> DataFrame:
    """A row for each row of docs: the id, keep_id, group_size, kept and text_sha256 (lowercase hex).

    Null texts count as empty. Of equal texts the row with the largest id stays; null ids lose, and where all ids
    of a text are null, keep_id is null and one of the rows stays. Of repeated rows (same id and text) one is kept.
    No rows in: no rows out. Whole texts count, of whatever length. Other columns, of whatever name, play no part.
    `digest` may be any function of the text: if it isn't
    injective, rows of texts that share a digest find their text by its whole content.
    """
    groups = winners(docs, id_col, text_col, salts, digest)
    by_digest = Window.partitionBy("_digest")
    # A row for each distinct text, without it; texts that share a digest are counted.
    few = materialize(groups.groupBy("_digest").agg(F.max("_keep").alias("_keep"), F.max("_size").alias("_size"), F.count(F.lit(1)).alias("_texts")), "dedup-groups")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.select("_id", "_text", digest(F.col("_text")).alias("_digest"))
    own = [] if digest is sha256 else [F.sha2("_text", 256).alias("_sha")]
    # Repeated rows are one row with their number from here on.
    slim = materialize(rows.groupBy("_digest", "_id", *own).agg(F.count(F.lit(1)).alias("_rows")), "dedup-rows")
    found = looked_up(slim, few.filter("_texts = 1"), ["_digest"], "_size", "_id")
    found = found.withColumn("_sha", F.lower(F.hex("_digest")) if digest is sha256 else F.col("_sha"))
    clashing = few.filter("_texts > 1")
    if not clashing.isEmpty():  # a digest that isn't injective: only its rows are matched by whole texts
        shared = rows.join(clashing.select("_digest"), "_digest", "left_semi").groupBy("_digest", "_text", "_id").agg(F.count(F.lit(1)).alias("_rows"))
        same = groups.withColumn("_n", F.count(F.lit(1)).over(by_digest)).filter("_n > 1").drop("_n")
        more = shared.join(same, ["_digest", "_text"]).withColumn("_sha", F.sha2("_text", 256))
        cols = ["_id", "_sha", "_rows", "_keep", "_size"]
        found = found.select(*cols).unionByName(more.select(*cols))
    return written_out(found, slim).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_copy") == 1)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def written_out(found: DataFrame, slim: DataFrame) -> DataFrame:
    """found with a row, numbered by _copy, for each of its _rows. slim has these numbers too: if one is large, rows are
    dealt out in runs before they are written out."""
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_rows - 1) div {RUN}")))
    runs = found.withColumn("_run", first)
    if not slim.filter(F.col("_rows") > RUN).isEmpty():
        runs = runs.repartition("_id", "_run")
    return runs.withColumn("_copy", F.explode(F.sequence(F.col("_run") * RUN + 1, F.least(F.col("_rows"), (F.col("_run") + 1) * RUN))))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows that stay, with all columns of docs, of whatever name and type: a row for each distinct text, the one
    with the largest id; null ids lose.

    The same stages as winners(), with the whole row as what is combined; ties of the id are broken by the other
    columns as text, in order. A null text counts as empty, and is returned as it was in the row that stays. Of
    repeated rows one stays. No rows: no rows.
    """
    quoted = lambda c: F.col(f"`{c}`")
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    text = F.coalesce(quoted(text_col), F.lit(""))
    order = F.struct(quoted(id_col), quoted(text_col).isNotNull(), *[quoted(c).cast("string") for c in rest])
    row = F.struct(quoted(id_col).alias("_0"), quoted(text_col).isNotNull().alias("_1"), *[quoted(c).alias(f"_{i + 2}") for i, c in enumerate(rest)])
    rows = docs.select(sha256(text).alias("_digest"), text.alias("_text"), F.pmod(F.xxhash64(id_col), F.lit(salts)).alias("_salt"), F.struct(order.alias("order"), row.alias("row")).alias("_row"))
    best = F.max_by("_row", F.col("_row.order")).alias("_row")
    last = rows.groupBy("_digest", "_text", "_salt").agg(best).groupBy("_digest", "_text").agg(best).select("_text", F.col("_row.row").alias("_row"))
    back = {id_col: F.col("_row._0"), text_col: F.when(F.col("_row._1"), F.col("_text"))} | {c: F.col(f"_row._{i + 2}") for i, c in enumerate(rest)}
    return last.select(*[back[c].alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
with d as (select doc_id, coalesce(text, '') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.t) as text_sha256
from d join g on d.t = g.t
"""
