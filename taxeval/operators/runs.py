"""Roll-ups of run records: runs with keys and `metrics`, a map of values (functions/metrics.py) or of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import KIND, number, of, present, text, whole_or_double, with_values

# Metrics that are added up, and the one whose maximum counts.
SUMMED = ["run_elapsed_seconds", "total_reads", "classified_reads", "unclassified_reads"]
LARGEST = "resource_max_rss_gb"


def blank_to_null(c: str) -> Column:
    return F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))


def prefer_later(runs: DataFrame) -> DataFrame:
    """Of runs with equal (collection, else display, else dataset; sample, else dataset, if in a collection; tool;
    db_name, blank counting as a name) the one of the latest source, then order; runs without tool or data set stay."""
    group = F.coalesce(blank_to_null("collection"), blank_to_null("display"), blank_to_null("dataset"))
    sample = F.when(blank_to_null("collection").isNotNull(), F.coalesce(blank_to_null("sample"), blank_to_null("dataset")))
    whole = group.isNotNull() & blank_to_null("tool").isNotNull()
    keyed = runs.withColumn("_k", F.struct(group.alias("g"), sample.alias("s"), "tool", F.coalesce("db_name", F.lit("")).alias("db")))
    last = keyed.filter(whole).groupBy("_k").agg(F.max_by(F.struct(*runs.columns), F.struct("source", "ord")).alias("r")).select("r.*")
    return keyed.filter(~whole).drop("_k").unionByName(last)


def metric_aliases(metrics: Column, names: list[str]) -> Column:
    """The metrics (a map of values) with the exact_ value, where there is one, under each of the names."""
    better = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), present(of(metrics, f"exact_{n}")).alias("value")) for n in names]), lambda e: e["value"].isNotNull())
    better = F.map_from_entries(better)
    return F.map_concat(F.map_filter(metrics, lambda k, v: ~F.map_contains_key(better, k)), better)


def entries(*pairs: tuple[str, Column]) -> Column:
    """A map of values of those that aren't null."""
    return F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("variant").alias("value")) for k, v in pairs]), lambda e: e["value"].isNotNull()))


def over(metrics: Column, better: Column) -> Column:
    """metrics with the entries of better, which replace those of the same name."""
    return F.map_concat(F.map_filter(metrics, lambda k, v: ~F.map_contains_key(better, k)), better)


def path_name(path: Column) -> Column:
    """The last part of a path, whatever slashes end it."""
    return F.nullif(F.regexp_extract(F.regexp_replace(path, r"(/\.?)+$", ""), "[^/]*$", 0), F.lit(""))


def run_fields(runs: DataFrame, tools: dict[str, str]) -> DataFrame:
    """elapsed and memory in GB (where not zero) as metrics where absent, the database's name from its path, the tool's
    display name."""
    runs = with_values(runs)
    extra = entries(("run_elapsed_seconds", F.col("elapsed")), (LARGEST, F.when(F.col("max_rss_kb") != 0, F.col("max_rss_kb") / 1048576)))
    shown = F.coalesce(F.create_map(*[F.lit(x) for kv in tools.items() for x in kv])[F.col("tool")], F.col("tool"))
    return runs.withColumn("metrics", over(extra, F.col("metrics"))).withColumn("db_name", F.coalesce(blank_to_null("db_name"), path_name(F.col("db")))).withColumn("tool_name", shown)


def collection_aggregate(runs: DataFrame) -> DataFrame:
    """(dataset, collection, display_dataset, tool, db_name, sample_count, sample_ids, metrics): a row for each
    collection, tool and database name, and each run outside collections as it is, under its own data set.

    A metric of a collection is the sum, the maximum, or the plain mean of its runs, of what are numbers; sums without a
    fraction are whole numbers. sample_ids: the different samples
    (data sets where a run has no sample); sample_count: their number, or that of the runs where none has either.
    display_dataset: the first that is given, else the collection. Runs of collections without a tool don't count; a
    missing database name is blank.
    """
    keys = ["collection", "tool", "db_name"]
    runs = with_values(runs)
    inside = runs.filter(blank_to_null("collection").isNotNull() & blank_to_null("tool").isNotNull()).withColumn("db_name", F.coalesce("db_name", F.lit("")))
    shown = blank_to_null("display")
    groups = inside.groupBy(*keys).agg(
        F.sort_array(F.collect_set(F.coalesce(blank_to_null("sample"), blank_to_null("dataset")))).alias("sample_ids"), F.count(F.lit(1)).alias("n"),
        F.min_by(shown, F.when(shown.isNotNull(), F.struct("source", "ord"))).alias("shown"),
    )
    long = inside.select(*keys, F.explode("metrics").alias("metric", "_v")).select(*keys, "metric", number(F.col("_v")).alias("v")).filter("v is not null and not isnan(v)")
    value = F.when(F.col("metric").isin(*SUMMED), whole_or_double(F.sum("v"))).when(F.col("metric") == LARGEST, F.max("v").cast("variant")).otherwise(F.avg("v").cast("variant"))
    made = long.groupBy(*keys, "metric").agg(value.alias("value")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"))
    size = F.size("sample_ids").cast("long")
    rolled = groups.join(made, keys, "left").select(
        F.col("collection").alias("dataset"), "collection", F.coalesce("shown", "collection").alias("display_dataset"), "tool", "db_name", F.when(size > 0, size).otherwise(F.col("n")).alias("sample_count"), "sample_ids",
        F.coalesce("metrics", F.create_map().cast(KIND)).alias("metrics"),
    )
    none = F.lit(None)
    return rolled.unionByName(single_runs(runs).select(
        "dataset", none.cast("string").alias("collection"), F.col("display").alias("display_dataset"), "tool", "db_name", none.cast("long").alias("sample_count"), none.cast("array<string>").alias("sample_ids"), "metrics"))


def single_runs(runs: DataFrame) -> DataFrame:
    """Runs outside collections, which pass through a roll-up under their own data set."""
    return runs.filter(blank_to_null("collection").isNull()).withColumn("display", F.col("dataset"))


def result_tables(rows: DataFrame) -> DataFrame:
    """Rolled-up rows in the order of their tables, by data set, with `place` within it, by tool, database and order. A
    data set has a row for each tool and database, so a window holds few."""
    place = F.row_number().over(Window.partitionBy("dataset").orderBy("tool", "db", "ord")).cast("long")
    return rows.withColumn("place", place).orderBy("dataset", "place")


def sample_table(runs: DataFrame, collection: str) -> DataFrame:
    """The runs of one collection, each under its sample (data set, if it has none)."""
    return runs.filter(F.col("collection") == collection).withColumn("sample", F.coalesce(blank_to_null("sample"), "dataset"))


def build_summary(builds: DataFrame, tools: list[str], db_name: str) -> DataFrame:
    """Builds of some tools for one database, with memory in GB instead of KB."""
    rows = builds.filter(F.col("tool").isin(*tools) & (F.col("db_name") == db_name))
    return rows.withColumn("max_rss_gb", F.col("max_rss_kb") / 1048576).drop("max_rss_kb")


def display_dataset() -> Column:
    return F.coalesce(blank_to_null("display"), blank_to_null("collection"), blank_to_null("dataset"))


def metric_family(runs: DataFrame, version: str) -> DataFrame:
    """has_reads, has_profile and current: which metrics a run has, and if those of profiles are of the given version,
    which is a text."""
    runs = with_values(runs)
    keys = F.map_keys("metrics")
    profile = F.exists(keys, lambda k: k.rlike("^(completeness_|purity_|l1_norm_)") | (k == "weighted_unifrac"))
    return runs.withColumns({
        "has_reads": F.exists(keys, lambda k: F.startswith(k, F.lit("per_read_"))),
        "has_profile": profile,
        "current": profile & F.coalesce(text(of(F.col("metrics"), "profile_metric_version")) == version, F.lit(False)),
    })


def step_resources(runs: DataFrame, key: str) -> DataFrame:
    """The largest memory and the summed times of a run's steps; null where no step tells."""
    s = runs.select(key, F.explode_outer("steps").alias("s"))
    return s.groupBy(key).agg(F.max("s.max_rss_kb").alias("max_rss_kb"), F.sum("s.user_seconds").alias("user_seconds"), F.sum("s.system_seconds").alias("system_seconds"))


def metric_wide(runs: DataFrame, keys: list[str], metrics: list[str] | None = None, most: int = 10_000) -> DataFrame:
    """A row for each run, with its keys and a column for each metric, in order: of the given names, or of all that any
    run has, which may be `most`. Values are as they are; those that a run doesn't have are null. Runs with equal keys
    keep their own rows."""
    runs = with_values(runs)
    if metrics is None:
        found = runs.select(F.explode(F.map_keys("metrics")).alias("k")).distinct().limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"more than {most} names of metrics")
        metrics = [r["k"] for r in found]
    return runs.select(*keys, *[of(F.col("metrics"), m).alias(m) for m in sorted(metrics)])


def summary_records(runs: DataFrame, exp: str) -> DataFrame:
    """One experiment's successful runs, with elapsed time and all values of `resource` (a map), as resource_*, over the
    metrics of those names."""
    good = with_values(with_values(runs), "resource").filter((F.col("exp") == exp) & (F.coalesce("return_code", F.lit(0)) == 0))
    used = F.transform_keys(F.coalesce("resource", F.create_map().cast(KIND)), lambda k, v: F.concat(F.lit("resource_"), k))
    return good.withColumn("metrics", over(over(F.col("metrics"), entries(("run_elapsed_seconds", F.col("elapsed")))), used))


def row_merge(old: DataFrame, new: DataFrame, values: list[str]) -> DataFrame:
    """New rows replace old ones by (dataset, tool, db); a new row without db takes the db of the tool's only row."""
    only = old.groupBy("dataset", "tool").agg(F.count(F.lit(1)).alias("n"), F.max("db").alias("one")).filter("n = 1").drop("n")
    n = new.join(only, ["dataset", "tool"], "left").withColumn("db", F.coalesce(blank_to_null("db"), "one", F.lit(""))).drop("one")
    keys = ["dataset", "tool", "db"]
    both = old.select(*keys, F.struct(*values).alias("o")).join(n.select(*keys, F.struct(*values).alias("n")), keys, "full_outer")
    return both.select(*keys, F.coalesce("n", "o").alias("r")).select(*keys, "r.*")


def build_table(builds: DataFrame, excluded: str) -> DataFrame:
    """The newest build of each (tool, db) that returned exactly 0, without one tool: its elapsed time, memory, start and
    end, and the largest of the sizes."""
    good = builds.filter((F.col("return_code") == 0) & (F.col("tool") != excluded))
    newest = F.max_by(F.struct("elapsed", "max_rss_kb", "started_at", "finished_at"), "started_at").alias("r")
    return good.groupBy("tool", "db").agg(newest, F.max("size").alias("size")).select("tool", "db", "r.*", "size")


def formal_table(rolled: DataFrame, grid: DataFrame, order: list[str] | None, versions: dict[str, str], scope: str) -> DataFrame:
    """Rows of the grid(dataset, tool, samples), with status, scope and their tool's version, in a custom or alphabetical
    order of data sets, then by tool. A collection with a wrong sample count is an error, and a tool without a version."""
    rows = rolled.join(grid, ["dataset", "tool"])
    bad = F.raise_error(F.concat_ws(" ", F.lit("sample count of"), "dataset", "tool")).cast("long")
    wrong = blank_to_null("collection").isNotNull() & ~F.col("sample_count").eqNullSafe(F.col("samples"))
    rows = rows.withColumn("samples", F.when(wrong, bad).otherwise(F.col("samples")))
    version = F.create_map(*[F.lit(x) for kv in versions.items() for x in kv])[F.col("tool")]
    rows = rows.withColumn("status", F.lit("complete")).withColumn("paper_scope", F.lit(scope)).withColumn("tool_version", F.coalesce(version, F.raise_error(F.concat(F.lit("no version of "), F.col("tool"))).cast("string")))
    at = F.array_position(F.array(*map(F.lit, order)), F.col("dataset")) if order else F.lit(0)
    return rows.orderBy(at, "dataset", "tool")


def sample_counts(catalog: DataFrame, reads_group: str) -> DataFrame:
    """(dataset, samples): the catalog's count, else the size of its samples or sample ids, where it has such a list,
    even an empty one; of one group the size of its list of read files; else 1."""
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("long")
    reads = F.when(F.col("group") == reads_group, size("reads"))
    return catalog.select("dataset", F.coalesce("samples", size("sample_list"), size("sample_ids"), reads, F.lit(1).cast("long")).alias("samples"))


def manifest(tables: list[DataFrame], policy: str, exceptions: dict[str, str]) -> DataFrame:
    """The union of task tables, each with its parameter policy; some tools have their own."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    own = F.create_map(*[F.lit(x) for kv in exceptions.items() for x in kv])[F.col("tool")]
    return out.withColumn("parameter_policy", F.coalesce(own, F.lit(policy)))
