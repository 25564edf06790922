"""Writers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.durable import written


def write_tsv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The columns in this order, with a header, tab-separated; nulls are blank."""
    df.select(*columns).write.csv(path, sep="\t", header=True, nullValue="", emptyValue="")


def write_cami(profile: DataFrame, path: str) -> None:
    """A CAMI profile of (taxid, rank, value): its header line and a line for each row."""
    columns = [F.col("taxid").alias("@@TAXID"), F.col("rank").alias("RANK"), F.lit("-").alias("TAXPATH"), F.lit("-").alias("TAXPATHSN"), F.col("value").alias("PERCENTAGE")]
    profile.select(*columns).write.csv(path, sep="\t", header=True, quote="")


def append_keyed(spark: SparkSession, store: str, new: DataFrame, keys: list[str], keep: Callable[[DataFrame], DataFrame], buckets: int = 64) -> int:
    """Adds rows to a table of rows that replace each other within keys, and says how many buckets were written again.

    keep(rows): of all rows of a key those that stay; it must give the same for rows of which some were dropped before
    (the latest, say). The table is parted by a hash of the keys, and only the buckets that new rows fall into are read
    and replaced. New buckets are written to the shared folder before any old one goes.
    """
    bucket = F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), F.lit(buckets)).cast("int")
    rows = written(new.withColumn("bucket", bucket), "appended")
    touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most `buckets`
    if not touched:
        return 0
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        old = spark.read.schema(rows.schema).parquet(store).filter(F.col("bucket").isin(*touched))
        rows = old.unionByName(rows)
    merged = written(keep(rows).select(*rows.columns), "merged")
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(store)
    return len(touched)
