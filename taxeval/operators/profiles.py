"""Abundance profiles: profile(keys, rank, taxid, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ratio
from .taxonomy import by_rank, closure, depths, known_path, nearest, path_depths, paths, tree_mass

# Ranks from the most specific on.
PRIORITY = ("strain", "species", "genus", "family", "order", "class", "phylum", "superkingdom")


def normalised(profile: DataFrame, keys: list[str]) -> DataFrame:
    """profile with `share`: positive values over their total for the keys; other rows go. Totals are aggregated and
    joined, so that no task needs a whole profile."""
    rows = profile.filter("value > 0")
    return rows.join(rows.groupBy(*keys).agg(F.sum("value").alias("_total")), keys).withColumn("share", F.col("value") / F.col("_total")).drop("_total")


def autoscaled(value: Column, total: Column) -> Column:
    """Percentages become fractions: values of a profile that adds up to more than 1.5 are divided by 100."""
    return F.when(total > 1.5, value / 100).otherwise(value)


def most_specific(profile: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The rows of each profile's most specific rank; other ranks than the known ones come last, of these the one seen
    first by the column `order` (by name, if there is none). Profiles without ranks stay whole."""
    at = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("rank"))
    seen = F.min(order) if order else F.min("rank")
    place = F.when(at > 0, at).when(F.col("rank").isNotNull(), len(PRIORITY) + 1).otherwise(len(PRIORITY) + 2)
    ranks = profile.groupBy(*keys, "rank").agg(seen.alias("_seen")).withColumn("_at", place)
    best = ranks.groupBy(*keys).agg(F.min_by(F.struct("rank"), F.struct("_at", "_seen")).alias("_best"))
    same = [profile[k].eqNullSafe(best[k]) for k in keys] + [profile["rank"].eqNullSafe(best["_best.rank"])]
    return profile.join(best, same, "left_semi")


def to_ranks(profile: DataFrame, nodes: DataFrame, keys: list[str], ranks: list[str], covered: DataFrame | None = None, up: DataFrame | None = None) -> DataFrame:
    """(keys, rank, taxid, mapped, full): values by lifted taxon. mapped: of what lifts to the rank (and is covered);
    full: also what doesn't, under its own taxon. up: the paths of the taxa, if they are there already."""
    wide = nearest(paths(nodes, profile.select("taxid")) if up is None else up, ranks, covered).withColumnRenamed("seed", "taxid")
    joined = by_rank(profile.drop("rank").join(wide, "taxid", "left"), ranks)
    return joined.groupBy(*keys, "rank", F.coalesce("lifted", "taxid").alias("taxid")).agg(F.sum(F.when(F.col("lifted").isNotNull(), F.col("value"))).alias("mapped"), F.sum("value").alias("full"))


def named_to_taxids(resolved: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """profile(keys, taxid, value) and unmapped(keys, unmapped, unmapped_mass) of a named profile whose names are
    resolved: (keys, name, value, taxid)."""
    none = F.col("taxid").isNull()
    lost = resolved.groupBy(*keys).agg(F.sum(none.cast("long")).alias("unmapped"), F.sum(F.when(none, F.col("value")).otherwise(0.0)).alias("unmapped_mass"))
    return resolved.filter(~none).groupBy(*keys, "taxid").agg(F.sum("value").alias("value")), lost


def named_to_ranks(resolved: DataFrame, nodes: DataFrame, keys: list[str], ranks: list[str], covered: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(keys, rank, taxid, name, mapped, full) and unmapped() of a named profile whose names are resolved, as (keys,
    name, value, taxid): names without a taxon stay in `full` at each rank under their name (the column `scientific`,
    if there is one, else `name`), without a taxid."""
    profile, lost = named_to_taxids(resolved, keys)
    known = to_ranks(profile, nodes, keys, ranks, covered).select(*keys, "rank", "taxid", F.lit(None).cast("string").alias("name"), "mapped", "full")
    called = F.col("scientific") if "scientific" in resolved.columns else F.col("name")
    other = resolved.filter("taxid is null").withColumn("rank", F.explode(F.array(*map(F.lit, ranks)))).groupBy(*keys, "rank", called.alias("name")).agg(F.sum("value").alias("full"))
    none = other.select(*keys, "rank", F.lit(None).cast("long").alias("taxid"), "name", F.lit(None).cast("double").alias("mapped"), "full")
    return known.unionByName(none), lost


def opal(truth: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """L1 norm, purity and completeness of (keys, rank): keys without positive values on either side have no row.
    truth and pred have (keys, rank, taxid, value); where pred has further keys than truth, pass truth with them."""
    by = [*keys, "rank"]
    t = normalised(truth, by).select(*by, "taxid", F.col("share").alias("t"))
    p = normalised(pred, by).select(*by, "taxid", F.col("share").alias("p"))
    both = t.join(p, [*by, "taxid"], "full_outer")
    one = lambda c: F.sum(c.cast("long"))
    made = both.groupBy(*by).agg(
        F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("t", F.lit(0.0)))).alias("l1_norm"),
        one(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("tp"), one(F.col("t").isNull()).alias("fp"), one(F.col("p").isNull()).alias("fn"),
    )
    return made.withColumn("purity", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("completeness", ratio(F.col("tp"), F.col("tp") + F.col("fn")))


def distances(truth: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """opal() with presence precision, recall and F1, total variation and Bray-Curtis (equal for normalised vectors)."""
    made = opal(truth, pred, keys)
    p, r = F.col("purity"), F.col("completeness")
    return made.withColumns({"presence_f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)), "total_variation": F.col("l1_norm") / 2, "bray_curtis": F.col("l1_norm") / 2})


def unifrac(truth: DataFrame, pred: DataFrame, nodes: DataFrame, keys: list[str], up: DataFrame | None = None) -> DataFrame:
    """(keys, weighted_unifrac): branches of length 1 / depth, the root left out, mass outside the tree dropped after
    normalising; 0 where both are empty. up: the paths of all taxa, if they are there already."""
    if up is None:
        up = paths(nodes, truth.select("taxid").union(pred.select("taxid")))
    mass = lambda df, name: tree_mass(normalised(df, keys), up, keys).withColumnRenamed("mass", name)
    both = mass(truth, "t").join(mass(pred, "p"), [*keys, "taxid"], "full_outer")
    depth = shared_depths(up, nodes)
    part = F.when(F.col("depth") > 0, F.abs(F.coalesce("t", F.lit(0.0)) - F.coalesce("p", F.lit(0.0))) / F.col("depth")).otherwise(F.lit(0.0))
    scored = both.join(depth, "taxid", "left").groupBy(*keys).agg(F.sum(part).alias("weighted_unifrac"))
    known = truth.select(*keys).union(pred.select(*keys)).distinct()
    return known.join(scored, keys, "left").withColumn("weighted_unifrac", F.coalesce("weighted_unifrac", F.lit(0.0)))


def inner_depths(closed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(taxid, depth) of all ancestors in a closure: what is left of any path from there to the top, as all lead on in
    the same way; only where a cycle closes, depths are taken from the ancestors' own paths."""
    known = nodes.select(F.col("taxid").alias("anc"))
    top = closed.join(known, "anc", "left_semi").groupBy("seed").agg(F.max("dist").alias("_top"))
    on = nodes.filter("parent <> taxid").select(F.col("taxid").alias("last"))
    around = closed.groupBy("seed").agg(F.max_by("anc", "dist").alias("last")).join(on, "last", "left_semi").select("seed")
    depth = closed.join(top, "seed").groupBy(F.col("anc").alias("taxid")).agg(F.max(F.col("_top") - F.col("dist")).alias("depth")).filter("depth >= 0")
    if around.isEmpty():
        return depth
    inside = closed.join(around, "seed", "left_semi").select("anc").distinct()
    own = depths(closure(nodes, inside), nodes).withColumnRenamed("seed", "taxid")
    return depth.join(own, "taxid", "left_anti").unionByName(own)


def shared_depths(up: DataFrame, nodes: DataFrame) -> DataFrame:
    """inner_depths() of paths()."""
    own = up.select(F.posexplode(known_path()).alias("at", "taxid"), F.size(known_path()).alias("n"))
    depth = own.groupBy("taxid").agg(F.max(F.col("n") - 1 - F.col("at")).alias("depth"))
    inside = up.filter("cycle")
    if inside.isEmpty():
        return depth
    around = path_depths(paths(nodes, inside.select(F.explode("path").alias("seed")))).withColumnRenamed("seed", "taxid")
    return depth.join(around, "taxid", "left_anti").unionByName(around)


def truth_coverage(resolved: DataFrame, keys: list[str]) -> DataFrame:
    """Of resolved(keys, name, value, taxid): species and mass in all, mapped, unmapped, the rate of unmapped species
    and the rate of mapped mass; a rate is null where its total is not positive."""
    has = F.col("taxid").isNotNull()
    made = resolved.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("species_total"), F.sum(has.cast("long")).alias("species_mapped"), F.sum((~has).cast("long")).alias("species_unmapped"),
        F.sum("value").alias("mass_total"), F.sum(F.when(has, F.col("value")).otherwise(0.0)).alias("mass_mapped"), F.sum(F.when(~has, F.col("value")).otherwise(0.0)).alias("mass_unmapped"),
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return made.withColumn("species_unmapped_rate", rate("species_unmapped", "species_total")).withColumn("mass_mapped_rate", rate("mass_mapped", "mass_total"))


def from_reads(truth: DataFrame, keys: list[str]) -> DataFrame:
    """A profile of weighted read counts, where there is no truth profile."""
    return truth.groupBy(*keys, "taxid").agg(F.sum("weight").cast("double").alias("value"))


def chosen_source(sources: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source): the prediction source that counts, of sources(keys, source, configured, exists).

    abundance_tre, then reads_tre, native, cami, named. A configured abundance tre hides the reads tre even if its file
    is missing; a missing tre falls through to the native profile; from there on the first configured one ends the
    search, and gives nothing if it is missing.
    """
    # The order of the sources.
    order = {"abundance_tre": 0, "reads_tre": 1, "native": 2, "cami": 3, "named": 4}
    at = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("source")]
    rows = sources.withColumn("_at", at).filter("configured")
    fine = (F.col("_at") >= 2) | F.col("exists")
    first = lambda of: F.min_by(F.when(of, F.when(F.col("exists"), F.col("source"))), F.when(of, F.col("_at")))
    hides = F.bool_or(F.col("source") == "abundance_tre")
    made = rows.groupBy(*keys).agg(hides.alias("_hides"), first(fine).alias("_all"), first(fine & (F.col("source") != "reads_tre")).alias("_rest"), F.bool_or(fine).alias("_some"), F.bool_or(fine & (F.col("source") != "reads_tre")).alias("_other"))
    return made.filter(F.when(F.col("_hides"), F.col("_other")).otherwise(F.col("_some"))).select(*keys, F.when(F.col("_hides"), F.col("_rest")).otherwise(F.col("_all")).alias("source"))
