"""Per-read scoring over facts(keys, taxid, pred): reads are counted first, and only the counts meet the taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_long, f1, ratio, stripped
from .durable import written
from .taxonomy import nearest, on_path, paths


def pair_counts(facts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, taxid, pred, n, and weight, if facts have weights): how many reads have this truth and prediction. Counted
    where the reads are, so that a hot taxon or the unclassified reads travel as one row a task; all scores follow from
    it."""
    weight = [F.sum("weight").alias("weight")] if "weight" in facts.columns else []
    return written(facts.groupBy(*keys, "taxid", "pred").agg(F.count(F.lit(1)).alias("n"), *weight), "pairs")


def lifted_pairs(pairs: DataFrame, nodes: DataFrame, ranks: list[str], covered: DataFrame | None = None, up: DataFrame | None = None) -> DataFrame:
    """pairs with, for each rank, t_ and p_ (the lifted truth and prediction), and the prediction's path (on which a
    truth of the rank may be further up, where a rank is nested on a lineage).

    Only distinct taxa go up the tree (or `up`, their paths() with a column `is_pred`). `covered`(rank, taxid): nodes of a rank outside it
    aren't mapped.
    """
    if up is None:
        up = paths(nodes, taxa(pairs))
    wide = nearest(up, ranks, covered)
    t = wide.select(F.col("seed").alias("taxid"), *[F.col(r).alias(f"t_{r}") for r in ranks])
    preds = up.filter("is_pred")
    p = nearest(preds, ranks, covered).join(on_path(preds), "seed").select(F.col("seed").alias("_seed"), *[F.col(r).alias(f"p_{r}") for r in ranks], "path")
    # Unclassified pairs are dealt by their truth and find nothing: a null prediction is never a key.
    dealt = pairs.join(t, "taxid", "left").withColumn("_p", F.coalesce("pred", "taxid"))
    return dealt.join(p, (F.col("_p") == F.col("_seed")) & F.col("pred").isNotNull(), "left").drop("_p", "_seed")


def taxa(pairs: DataFrame) -> DataFrame:
    """(seed, is_pred): truths and predictions, the latter marked."""
    both = F.array(*[F.struct(F.col(c).alias("seed"), F.lit(c == "pred").alias("is_pred")) for c in ("taxid", "pred")])
    return pairs.select(F.explode(both).alias("_s")).select("_s.*")


def counts(lifted: DataFrame, keys: list[str], ranks: list[str]) -> DataFrame:
    """(keys, rank, reads, classified, truth_mapped, pred_mapped, tp, fp, fn, and exact_* of the last four) of
    lifted pairs with their counts n.

    pred_mapped counts classified reads among those whose truth is mapped; exact_pred_mapped counts predictions that
    lift to the rank among all reads. A prediction elsewhere is both a false positive and a false negative.
    """
    n = F.col("n")
    some = lambda c: F.sum(F.when(c, n).otherwise(0))
    sums: list[Column] = [F.sum(n).alias("reads"), some(F.col("pred").isNotNull()).alias("classified")]
    for r in ranks:
        t, p = F.col(f"t_{r}"), F.col(f"p_{r}")
        mapped, has = t.isNotNull(), F.col("pred").isNotNull()
        same = F.coalesce(t == p, F.lit(False))
        under = F.coalesce(F.array_contains("path", t), F.lit(False))
        for name, c in (
            ("truth_mapped", mapped), ("pred_mapped", mapped & has), ("tp", mapped & under), ("fp", mapped & has & ~under), ("fn", mapped & ~under),
            ("exact_pred_mapped", p.isNotNull()), ("exact_tp", mapped & same), ("exact_fp", mapped & has & ~same), ("exact_fn", mapped & ~same),
        ):
            sums.append(some(c).alias(f"{name}__{r}"))
    wide = lifted.groupBy(*keys).agg(*sums)
    names = ("truth_mapped", "pred_mapped", "tp", "fp", "fn", "exact_pred_mapped", "exact_tp", "exact_fp", "exact_fn")
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), *[F.col(f"{n}__{r}").alias(n) for n in names]) for r in ranks]))
    return wide.select(*keys, "reads", "classified", rows.alias("_r")).select(*keys, "reads", "classified", "_r.*")


def scores(facts: DataFrame, nodes: DataFrame, keys: list[str], ranks: list[str], covered: DataFrame | None = None) -> DataFrame:
    """counts() of reads."""
    return counts(lifted_pairs(pair_counts(facts, keys), nodes, ranks, covered), keys, ranks)


def prf(df: DataFrame, prefix: str = "") -> DataFrame:
    """df with precision, recall and F1 from tp, fp and fn; null where no truth is mapped."""
    tp, fp, fn = (F.col(prefix + c) for c in ("tp", "fp", "fn"))
    some = F.col("truth_mapped") > 0
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return df.withColumns({f"{prefix}precision": F.when(some, p), f"{prefix}recall": F.when(some, r), f"{prefix}f1": F.when(some, f1(p, r))})


def rated(counted: DataFrame) -> DataFrame:
    """Both kinds of precision, recall and F1 from counts(), and the mapped rates over all truth reads."""
    made = prf(prf(counted), "exact_")
    n = F.col("reads")
    return made.withColumns({"truth_mapped_rate": ratio(F.col("truth_mapped"), n), "pred_mapped_rate": ratio(F.col("pred_mapped"), n), "exact_pred_mapped_rate": ratio(F.col("exact_pred_mapped"), n), "classified_rate": ratio(F.col("classified"), n)})


def combined(facts: DataFrame, nodes: DataFrame, keys: list[str], ranks: list[str], covered: DataFrame | None = None) -> DataFrame:
    """rated() scores for each key and rank."""
    return rated(scores(facts, nodes, keys, ranks, covered))


def run_summary(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Of lines(keys, cells), without comments: total, unclassified, classified and distinct taxa.

    A line's taxon is its first later cell that isn't empty, up to a colon or bar; none, 0, -, NA, unclassified and what
    isn't a whole number are unclassified. Lines of one cell count in the total, and as neither; what isn't unclassified
    is classified.
    """
    cell = F.get(F.filter(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(1))), lambda x: x != ""), F.lit(0))
    name = stripped(F.split(F.split(cell, ":")[0], r"\|")[0])
    taxid = F.when(~name.isin("unclassified", "-", "0", "NA"), as_long(name))
    short = F.size("cells") < 2
    made = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.sum((~short & taxid.isNull()).cast("long")).alias("unclassified"), F.count_distinct(F.when(~short, taxid)).alias("taxa"))
    return made.select(*keys, "total", "unclassified", (F.col("total") - F.col("unclassified")).alias("classified"), "taxa")


def tre_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows(keys, line_no, rank, taxid, count): the last unclassified and root counts, whole numbers, their sum, and
    the different other taxa that are counted; no row where neither is there."""
    whole = F.floor("count").cast("long")
    at = lambda r: F.max_by(F.when(F.col("rank") == r, whole), F.when(F.col("rank") == r, F.col("line_no")))
    other = ~F.col("rank").isin("unclassified", "root") & ~F.col("taxid").isin("", "-", "0") & (whole > 0)
    made = rows.groupBy(*keys).agg(at("unclassified").alias("u"), at("root").alias("c"), F.count_distinct(F.when(other, F.col("taxid"))).alias("taxa")).filter("u is not null or c is not null")
    zero = F.lit(0).cast("long")
    return made.select(*keys, F.coalesce("u", zero).alias("unclassified"), F.coalesce("c", zero).alias("classified"), (F.coalesce("u", zero) + F.coalesce("c", zero)).alias("total"), "taxa")
