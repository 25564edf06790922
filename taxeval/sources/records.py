"""Run records: meta.json and metrics.json of run folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import parsed

META = "exp string, tool string, dataset string, dataset_collection string, display_dataset string, sample_id string, sample_ids array<string>, db string, db_name string, return_code int, elapsed_seconds double, resource map<string,variant>, steps array<struct<name: string, return_code: int, elapsed_seconds: double, resource: struct<max_rss_kb: long, user_time_seconds: double, system_time_seconds: double>>>, started_at string, finished_at string"


def parse_meta(files: DataFrame, schema: str = META) -> DataFrame:
    """files(dir, value) with the fields of their JSON; broken JSON gives no row."""
    made = files.withColumn("_j", F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return made.filter("_j is not null and _j._corrupt is null").select("dir", "_j.*").drop("_corrupt")


def keep_good(runs: DataFrame) -> DataFrame:
    """Without runs that failed; a missing return code counts as success."""
    return runs.filter(F.coalesce("return_code", F.lit(0)) == 0)


def read_runs(spark: SparkSession, roots: str | list[str]) -> DataFrame:
    """Good runs below folders, with `metrics`, a map of the values in metrics.json as they are (numbers, texts,
    booleans); without any where that file is missing or broken. source: the place of the folder in the list, as later
    ones take precedence; ord: of a folder, the order of the runs' paths as text. A path below two of the folders
    belongs to the longer one."""
    roots = [r.rstrip("/") for r in ([roots] if isinstance(roots, str) else roots)]

    def files(name: str) -> DataFrame:
        raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(roots, wholetext=True)
        return raw.select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("dir"), "value").distinct()

    bare = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")
    inside = [F.when(F.startswith(F.concat(bare(F.col("dir")), F.lit("/")), F.concat(bare(F.lit(r)), F.lit("/"))), F.struct(F.length(F.lit(r)).alias("n"), F.lit(i).alias("source"))) for i, r in enumerate(roots)]
    metrics = files("metrics.json").select("dir", parsed(F.col("value")).alias("metrics"))
    good = keep_good(parse_meta(files("meta.json"))).join(metrics, "dir", "left").withColumn("metrics", F.coalesce("metrics", parsed(F.lit(None).cast("string"))))
    return good.withColumn("source", F.coalesce(F.array_max(F.array_compact(F.array(*inside)))["source"], F.lit(0))).withColumn("ord", F.col("dir"))
