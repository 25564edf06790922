"""Statistics of sequences and the catalogs made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import without_fasta_suffix


def n50(records: DataFrame, keys: list[str], length: str = "length") -> DataFrame:
    """(keys, n50): the length at which the longest sequences make up half of the bases; 0 for none. A histogram by
    length goes into the running sum, so a group's window holds lengths, not sequences."""
    hist = records.groupBy(*keys, length).agg((F.count(F.lit(1)) * F.col(length)).alias("b"))
    w = Window.partitionBy(*keys)
    run = hist.withColumn("cum", F.sum("b").over(w.orderBy(F.desc(length)))).withColumn("total", F.sum("b").over(w))
    return run.groupBy(*keys).agg(F.coalesce(F.max(F.when((F.col("cum") * 2 >= F.col("total")) & (F.col("total") > 0), F.col(length))), F.lit(0)).cast("long").alias("n50"))


def seq_stats(records: DataFrame, keys: list[str], seq: str = "seq", qual: str | None = None, files: DataFrame | None = None) -> DataFrame:
    """Records, bases, min, mean and max length, N50, GC percent and the percentage of Q30 bases over all bases where
    any record has a quality (null where none has); 0 where there are no bases. files(keys, bytes): their size, too,
    and rows of zeros for files without records."""
    size = F.length(seq).cast("long")
    gc = F.length(F.regexp_replace(seq, "[^GCgc]", "")).cast("long")
    q30 = F.length(F.regexp_replace(qual, "[^?-~]", "")).cast("long") if qual else F.lit(None).cast("long")
    return length_stats(records.select(*keys, size.alias("length"), gc.alias("gc"), q30.alias("q30")), keys, files)


def length_states(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, length, n, gc, q30): what is needed of rows(keys, length, gc, q30), a row for each length. States of
    different files add up by their union, so that only new files have to be scanned."""
    return rows.groupBy(*keys, "length").agg(F.count(F.lit(1)).alias("n"), F.sum("gc").alias("gc"), F.sum("q30").alias("q30"))


def stats_of_states(states: DataFrame, keys: list[str], files: DataFrame | None = None) -> DataFrame:
    """seq_stats() of length_states(), of one or more scans."""
    size = F.col("length").cast("long")
    hist = states.groupBy(*keys, "length").agg(F.sum("n").alias("n"), F.sum("gc").alias("gc"), F.sum("q30").alias("q30")).withColumn("b", F.col("n") * size)
    w = Window.partitionBy(*keys)
    run = hist.withColumn("cum", F.sum("b").over(w.orderBy(F.desc("length")))).withColumn("total", F.sum("b").over(w))
    half = F.max(F.when((F.col("cum") * 2 >= F.col("total")) & (F.col("total") > 0), size))
    made = run.groupBy(*keys).agg(F.sum("n").alias("records"), F.sum("b").alias("bases"), F.min(size).alias("min_length"), F.max(size).alias("max_length"), F.sum("gc").alias("gc"), F.sum("q30").alias("q30"), F.coalesce(half, F.lit(0)).cast("long").alias("n50"))
    some = F.col("bases") > 0
    made = made.withColumn("mean_length", F.col("bases") / F.col("records")).withColumn("gc_percent", F.when(some, 100 * F.col("gc") / F.col("bases")).otherwise(0.0)).withColumn("q30_percent", F.when(F.col("q30").isNotNull(), F.when(some, 100 * F.col("q30") / F.col("bases")).otherwise(0.0)))
    made = made.select(*keys, "records", "bases", "min_length", "max_length", "mean_length", "gc_percent", "q30_percent", "n50")
    if files is None:
        return made
    sizes = files.groupBy(*keys).agg(F.sum("bytes").alias("bytes"))
    return sizes.join(made, keys, "left").fillna(0, [c for c in made.columns if c not in (*keys, "q30_percent")])


def length_stats(rows: DataFrame, keys: list[str], files: DataFrame | None = None) -> DataFrame:
    """seq_stats() of rows(keys, length, gc, q30), which need no sequences: what is known of long ones, or of many."""
    return stats_of_states(length_states(rows, keys), keys, files)


def not_scanned(files: DataFrame, scanned: DataFrame) -> DataFrame:
    """files(file, bytes, modified) that stored states have not seen, or in another version: those to scan."""
    return files.join(scanned, ["file", "bytes", "modified"], "left_anti")


def exact_copies(records: DataFrame, clade: str, seq: str) -> DataFrame:
    """Input, retained and duplicate records and bases of each clade; equal sequences of different clades are kept."""
    size = F.length(seq).cast("long")
    per = records.groupBy(clade, F.sha2(seq, 256).alias("_d")).agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("size"))
    made = per.groupBy(clade).agg(F.sum("n").alias("input_records"), F.count(F.lit(1)).alias("retained_records"), F.sum(F.col("n") * F.col("size")).alias("input_bases"), F.sum("size").alias("retained_bases"))
    return made.withColumn("duplicate_records", F.col("input_records") - F.col("retained_records")).withColumn("duplicate_bases", F.col("input_bases") - F.col("retained_bases"))


def dataset_catalog(scanned: DataFrame, metadata: DataFrame, order: list[str]) -> DataFrame:
    """scanned(dataset, records, bases, mean_length) with what metadata(dataset, public, records, label, input) says
    instead; public ones only; position: the listed ones first, in their order, then by name. Means are rounded half
    to even."""
    m = metadata.select("dataset", "public", F.col("records").alias("_records"), "label", "input")
    listed = F.array_position(F.array(*map(F.lit, order)), F.col("dataset"))
    rows = scanned.join(m, "dataset", "left").filter(F.coalesce("public", F.lit(True)))
    key = F.struct(F.when(listed > 0, listed).otherwise(len(order) + 1), "dataset")
    return rows.select("dataset", F.coalesce("_records", "records").alias("records"), "bases", F.bround("mean_length").cast("long").alias("mean_length"), F.coalesce("label", "dataset").alias("label"), F.coalesce("input", F.lit("single FASTQ")).alias("input_type"), key.alias("position")).orderBy("position").drop("position")


def described_datasets(datasets: DataFrame, formats: DataFrame) -> DataFrame:
    """datasets with samples, input_type and truth by rule.

    datasets(dataset, input_type, truth_label, truth_dir, truth_profile, truth_map, paired, kind, samples
    array<struct<paired boolean, reads array<string>>>, sample_ids array<string>, reads array<string>); formats(path,
    format): fastq or fasta. samples: of a list, 1 if paired, the sample ids of collections of that kind, else the
    read files. input_type: what is given; paired FASTQ if (all samples are) paired; single FASTQ or contig FASTA if
    all files are one of these; else mixed. truth: what is given, else by the files that are there.
    """
    # Fixed values (below): input types, truth labels, and the kind of collection that counts by its sample ids.
    listed = F.size("samples") > 0
    files = F.when(listed, F.flatten(F.transform("samples", lambda x: F.coalesce(x["reads"], F.array().cast("array<string>"))))).otherwise(F.coalesce("reads", F.array().cast("array<string>")))
    kinds = datasets.select("dataset", F.explode_outer(files).alias("path")).join(formats, "path", "left").groupBy("dataset").agg(F.collect_set("format").alias("_formats"))
    one = lambda f: (F.size("_formats") == 1) & (F.col("_formats")[0] == f)
    by_format = F.when(one("fastq"), "single FASTQ").when(one("fasta"), "contig FASTA").otherwise("mixed FASTA/FASTQ")
    all_of = lambda test: F.forall("samples", lambda x: F.coalesce(test(x), F.lit(False)))
    of_samples = F.when(all_of(lambda x: x["paired"]), "paired FASTQ").when(all_of(lambda x: F.size(x["reads"]) > 0), by_format).otherwise("mixed FASTA/FASTQ")
    given = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    size = lambda c: F.coalesce(F.when(F.size(c) >= 0, F.size(c)), F.lit(0)).cast("long")
    paired = F.coalesce("paired", F.lit(False))
    truth = F.coalesce(given("truth_label"), F.when(given("truth_dir").isNotNull(), "per-read mapping + profile").when(given("truth_profile").isNotNull(), "profile only").when(given("truth_map").isNotNull(), "per-read mapping only").otherwise("unknown"))
    n = F.when(listed, size("samples")).when(paired, F.lit(1).cast("long")).when(F.col("kind") == "strain_madness", size("sample_ids")).otherwise(size("reads"))
    made = datasets.join(kinds, "dataset", "left").withColumn("input", F.coalesce(given("input_type"), F.when(listed, of_samples).when(paired, "paired FASTQ").otherwise(by_format)))
    return made.select("dataset", n.alias("samples"), F.col("input").alias("input_type"), truth.alias("truth"))


def db_catalog(builds: DataFrame, targets: DataFrame, assembly: DataFrame) -> DataFrame:
    """Per database: contigs, bases, assemblies, species. builds(ord, path, list): the first build with a list counts;
    targets(list, accession, bytes); names lose their index suffix. A target without assembly is an error."""
    # Suffixes of indexes.
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.(imcf|syldb|hixf)$", "")
    first = builds.filter("list is not null").groupBy(name.alias("db")).agg(F.min_by("list", "ord").alias("list"))
    rows = first.join(targets, "list").join(assembly.withColumn("_there", F.lit(True)), "accession", "left")
    lost = F.raise_error(F.concat(F.lit("no assembly for "), F.col("accession"))).cast("long")
    size = F.when(F.col("_there"), F.col("genome_size")).otherwise(lost)
    return rows.groupBy("db").agg(F.sum("bytes").alias("file_bytes"), F.sum("contig_count").alias("contigs"), F.sum(size).alias("bases"), F.count(F.lit(1)).alias("assemblies"), F.count_distinct("species_taxid").alias("species"))


def reference_manifest(files: DataFrame, stats: DataFrame, clades: DataFrame) -> DataFrame:
    """(reference_name, accession, source_kind, records, bases, sha256, ...) of files(path, content) with the digest of
    their bytes, statistics(path, records, bases) and clades(reference_name, clade): a reference without an accession in
    its name is an aggregate."""
    name = without_fasta_suffix(F.substring_index("path", "/", -1))
    acc = F.regexp_extract(name, r"(GC[AF]_\d+\.\d+)", 1)
    # The two kinds of sources.
    kind = F.when(acc != "", "RefSeq").otherwise("paper_aggregate")
    digest = files.select("path", name.alias("reference_name"), acc.alias("accession"), kind.alias("source_kind"), F.sha2("content", 256).alias("sha256"))
    return digest.join(stats, "path").join(clades, "reference_name", "left")
