"""Scoring of runs: per-read scores, truth coverage, profile distances and tree distances, for all runs in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import perread, profiles
from .durable import written
from .taxonomy import paths

# The version of the metrics; sources as in profiles.chosen_source.
VERSION = "per-read-descendant-aware-v1+profile-opal-v2"
#: Sources whose profiles are of several ranks.
RANKED = ("abundance_tre", "reads_tre", "cami")


def long(df: DataFrame, keys: Sequence[str], columns: dict[str, str], by_rank: bool) -> DataFrame:
    """(keys, metric, value) of columns, under their names (with the rank); nulls go."""
    name = lambda m: F.concat(F.lit(f"{m}_"), F.col("rank")) if by_rank else F.lit(m)
    rows = F.explode(F.array(*[F.struct(name(m).alias("metric"), F.col(c).cast("double").alias("value")) for c, m in columns.items()]))
    return df.select(*keys, rows.alias("_m")).select(*keys, "_m.*").filter("value is not null")


def read_metrics(counted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, value) of perread.counts()."""
    rated = perread.rated(counted)
    per_rank = {c: f"per_read_{c}" for c in ("truth_mapped_rate", "pred_mapped_rate", "precision", "recall", "f1")}
    per_rank |= {"exact_pred_mapped_rate": "exact_per_read_pred_mapped_rate"} | {f"exact_{c}": f"exact_per_read_{c}" for c in ("precision", "recall", "f1")}
    at_rank = long(rated.withColumn("exact_truth_mapped_rate", F.col("truth_mapped_rate")), keys, per_rank | {"exact_truth_mapped_rate": "exact_per_read_truth_mapped_rate"}, True)
    runs = rated.select(*keys, "classified_rate", (1 - F.col("classified_rate")).alias("unclassified_rate")).distinct()
    rates = [long(runs, keys, {f"{c}_rate": f"{kind}per_read_{c}_rate" for c in ("classified", "unclassified")}, False) for kind in ("", "exact_")]
    return at_rank.unionByName(rates[0]).unionByName(rates[1])


def coverage_metrics(resolved: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, value) of profiles.truth_coverage()."""
    names = ("species_total", "species_mapped", "species_unmapped", "species_unmapped_rate", "mass_total", "mass_mapped", "mass_unmapped", "mass_mapped_rate")
    return long(profiles.truth_coverage(resolved, keys), keys, {c: f"truth_profile_{c}" for c in names}, False)


def evaluate(
    nodes: DataFrame, keys: list[str], ranks: list[str], reads: DataFrame | None = None, truth: DataFrame | None = None, named_truth: DataFrame | None = None, sources: DataFrame | None = None,
    predicted: DataFrame | None = None, covered: DataFrame | None = None, files: DataFrame | None = None, labels: DataFrame | None = None,
) -> DataFrame:
    """(keys, metric, value, text) of all runs: numbers in value; metric_version, of runs with any metric, and
    profile_metric_version, of runs whose profile was scored, in text.

    reads(keys, taxid, pred, weight): truth and prediction of each read. named_truth(keys, name, value, taxid): truth
    profiles with resolved names, or truth(keys, taxid, value); runs with neither take the weighted counts of their
    reads. predicted(keys, source, rank, taxid, value): profiles of any sources; of sources(keys, source, configured,
    exists) the one that takes precedence counts, trees and CAMI profiles at their most specific rank, profiles of other
    sources whole. A source that is there but empty scores zeros; runs without one have no profile metrics, nor have runs
    whose truth has no mass at any rank. files(keys, output, exists): configured outputs, of which missing ones that a
    run needs are told (missing_metrics). labels(keys, rows, unmapped_rows, unmapped_names): of truth by species labels.

    Reads are counted before anything else, weights too; one table of the paths of taxa in use serves all parts, and truth and
    predictions are lifted together, once.
    """
    out, pairs, seeds = [], None, []
    if reads is not None:
        pairs = perread.pair_counts(reads, keys)
        seeds.append(perread.taxa(pairs))
    profile = None
    if named_truth is not None:
        profile = profiles.named_to_taxids(named_truth, keys)[0]
        out.append(coverage_metrics(named_truth, keys))
    if truth is not None:
        profile = truth.select(*keys, "taxid", "value") if profile is None else profile.unionByName(truth.select(*keys, "taxid", "value"))
    both = None
    if predicted is not None and (profile is not None or pairs is not None):
        if pairs is not None and "weight" in pairs.columns:
            own = profiles.from_reads(pairs, keys)
            for df in (truth, named_truth):
                if df is not None:
                    own = own.join(df.select(*keys).distinct(), keys, "left_anti")
            profile = own if profile is None else profile.unionByName(own)
        if profile is not None:
            runs, chosen = chosen_profiles(sources, predicted, keys)
            sides = profile.groupBy(*keys, "taxid").agg(F.sum("value").alias("value")).withColumn("side", F.lit("t")).unionByName(chosen.withColumn("side", F.lit("p")))
            both = written(sides, "profiles")
            runs = written(runs.distinct(), "profile-runs")
            seeds.append(both.select(F.col("taxid").alias("seed"), F.lit(False).alias("is_pred")))
    if not seeds:
        raise ValueError("nothing to evaluate: neither reads nor profiles")
    in_use = seeds[0]
    for more in seeds[1:]:
        in_use = in_use.union(more)
    up = paths(nodes, in_use)
    scored = None
    if pairs is not None:
        out.append(read_metrics(perread.counts(perread.lifted_pairs(pairs, nodes, ranks, covered, up), keys, ranks), keys))
    if both is not None:
        made, scored = profile_metrics(both, runs, nodes, keys, ranks, covered, up)
        out.append(made)
    if files is not None:
        out.append(missing_metrics(files, sources, pairs, keys))
    if labels is not None:
        names = {"mapped_rows": "truth_map_species_label_mapped_rows", "unmapped_rows": "truth_map_species_label_unmapped_rows", "unmapped_names": "truth_map_species_label_unmapped_names"}
        out.append(long(labels.withColumn("mapped_rows", F.col("rows") - F.col("unmapped_rows")), keys, names, False))
    made = out[0]
    for m in out[1:]:
        made = made.unionByName(m)
    made = made.withColumn("text", F.lit(None).cast("string"))
    tag = lambda df, name: df.select(*keys, F.lit(name).alias("metric"), F.lit(None).cast("double").alias("value"), F.lit(VERSION).alias("text"))
    # Which runs have a metric follows from what there is of them, without the metrics.
    known = [df.select(*keys) for df in (pairs, named_truth, labels, scored) if df is not None]
    if files is not None:
        known.append(out[-1 if labels is None else -2].select(*keys))
    have = known[0]
    for more in known[1:]:
        have = have.union(more)
    made = made.unionByName(tag(have.distinct(), "metric_version"))
    return made if scored is None else made.unionByName(tag(scored, "profile_metric_version"))


def chosen_profiles(sources: DataFrame | None, predicted: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Runs that have a source, and (keys, taxid, value) of the one that counts."""
    if sources is None:
        runs, chosen = predicted.select(*keys), predicted
    else:
        source = profiles.chosen_source(sources, keys).filter("source is not null")
        runs, chosen = source.select(*keys), predicted.join(source, [*keys, "source"], "left_semi")
    if "rank" in chosen.columns:
        if "source" in chosen.columns:  # ranks of other sources play no part
            chosen = chosen.withColumn("rank", F.when(F.col("source").isin(*RANKED), F.col("rank")))
        chosen = profiles.most_specific(chosen, keys)
    return runs, chosen.groupBy(*keys, "taxid").agg(F.sum("value").alias("value"))


def profile_metrics(both: DataFrame, runs: DataFrame, nodes: DataFrame, keys: list[str], ranks: list[str], covered: DataFrame | None, up: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys, metric, value) of L1 norm, purity, completeness at each rank, and weighted UniFrac; and the runs that were
    scored. both(keys, side, taxid, value): truth (t) and predictions (p); runs(keys): those with a prediction.

    Truth counts where it is mapped, predictions in full; a rank that neither side has is left out.
    """
    by = [*keys, "rank", "side"]
    lifted = profiles.to_ranks(both, nodes, [*keys, "side"], ranks, covered, up)
    value = F.when(F.col("side") == "t", F.col("mapped")).otherwise(F.col("full"))
    lifted = written(lifted.select(*by, "taxid", value.alias("value")).filter("value is not null"), "profiles-at-ranks")
    scored = written(runs.join(lifted.filter("side = 't'").select(*keys).distinct(), keys, "left_semi"), "profiles-scored")
    mine = lifted.join(scored, keys, "left_semi")
    zero = {c: 0.0 for c in ("l1_norm", "purity", "completeness")}
    sides = [mine.filter(F.col("side") == s).drop("side") for s in "tp"]
    at_ranks = mine.select(*keys, "rank").distinct().join(profiles.opal(*sides, keys), [*keys, "rank"], "left").fillna(zero)
    truth, pred = (both.filter(F.col("side") == s).drop("side").join(scored, keys, "left_semi") for s in "tp")
    tree = scored.join(profiles.unifrac(truth, pred, nodes, keys, up), keys, "left").fillna(0.0, ["weighted_unifrac"])
    return long(at_ranks, keys, {c: c for c in zero}, True).unionByName(long(tree, keys, {"weighted_unifrac": "weighted_unifrac"}, False)), scored


def missing_metrics(files: DataFrame, sources: DataFrame | None, pairs: DataFrame | None, keys: list[str]) -> DataFrame:
    """(keys, metric, value): 1 for each configured output of a run that it needs and that is missing.

    files(keys, output, exists), with the outputs classify_tsv, classify_one, truth_profile and named_profile. Of runs
    with truth reads, predictions are needed: the first of the two that is configured. A named profile is needed where
    no source before it was taken: no tree is there, no native and no CAMI profile is configured.
    """
    has = lambda name: F.bool_or(F.col("output") == name)
    lost = lambda name: F.bool_or((F.col("output") == name) & ~F.col("exists"))
    per = files.groupBy(*keys).agg(has("classify_tsv").alias("_tsv"), *[lost(n).alias(n) for n in ("classify_tsv", "classify_one", "truth_profile", "named_profile")])
    read = pairs.select(*keys, F.lit(True).alias("_read")).distinct() if pairs is not None else None
    per = per.join(read, keys, "left") if read is not None else per.withColumn("_read", F.lit(None).cast("boolean"))
    if sources is not None:
        tree = F.bool_or(F.col("source").isin("abundance_tre", "reads_tre") & F.col("configured") & F.col("exists"))
        hidden = F.bool_or((F.col("source") == "abundance_tre") & F.col("configured") & ~F.col("exists"))
        reads = F.bool_or((F.col("source") == "reads_tre") & F.col("configured") & F.col("exists"))
        abundance = F.bool_or((F.col("source") == "abundance_tre") & F.col("configured") & F.col("exists"))
        other = F.bool_or(F.col("source").isin("native", "cami") & F.col("configured"))
        taken = sources.groupBy(*keys).agg((tree & (abundance | (reads & ~hidden)) | other).alias("_taken"))
        per = per.join(taken, keys, "left")
    else:
        per = per.withColumn("_taken", F.lit(False))
    needed = {
        "classify_tsv_missing": F.col("_read") & F.col("classify_tsv"), "classify_one_missing": F.col("_read") & ~F.col("_tsv") & F.col("classify_one"),
        "truth_profile_missing": F.col("truth_profile"), "named_profile_missing": ~F.coalesce("_taken", F.lit(False)) & F.col("named_profile"),
    }
    return long(per.withColumns({m: F.when(c, 1.0) for m, c in needed.items()}), keys, {m: m for m in needed}, False)
