"""Text as relations of lines: lines(file, line_no, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.durable import written

#: Rows that say where splits or files begin, up to which they are broadcast; with more, Spark joins as it likes.
SPLITS = 200_000


def scanned(spark: SparkSession, paths: list[str] | str, sep: str | None = None) -> DataFrame:
    """(value, file, _split, _id): text between separators, the byte at which its split begins, and a number that grows
    by one from row to row of a split."""
    reader = spark.read if sep is None else spark.read.option("lineSep", sep)
    return reader.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id"))


def placed(raw: DataFrame) -> DataFrame:
    """scanned() with line_no, the place in the file from 0, and _from and _to, the first line of the split and the one
    after its last.

    A first scan counts the lines of splits, and only these counts are moved: a line finds its number by adding to
    what it has, in the second scan.
    """
    per = raw.groupBy("file", "_split").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    places = written(per.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0))), "splits")
    held = F.broadcast(places) if places.count() <= SPLITS else places
    at = F.col("_id") - F.col("_first")
    same = F.when((at >= 0) & (at < F.col("_n")), F.col("_from") + at).otherwise(F.raise_error(F.concat(F.lit("splits changed between scans of "), F.col("file"))).cast("long"))
    return raw.join(held, ["file", "_split"]).select("file", same.alias("line_no"), "value", "_from", (F.col("_from") + F.col("_n")).alias("_to"))


def read_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Lines of text files with their numbers from 0, in however many splits the files are read; no text is moved."""
    return placed(scanned(spark, paths)).select("file", "line_no", "value")


def lines_of(df: DataFrame, file: Column, order: Column, value: Column) -> DataFrame:
    """Lines from any columns; order is a number that tells lines of a file apart."""
    return df.select(file.alias("file"), order.cast("long").alias("line_no"), value.alias("value"))


def read_tsv(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Header TSVs, united by column name, in the order in which names come up (files in the order of their paths);
    missing and empty cells are null, cells beyond the header are left out, blank lines don't count.

    All files are one scan; their headers are a relation that is joined by file. Of repeated names in a header the first
    counts.
    """
    lines = placed(scanned(spark, paths)).select("file", "line_no", F.regexp_replace("value", "\r$", "").alias("value"))
    cell = lambda text, n: F.from_csv(text, ", ".join(f"c{i} string" for i in range(n)), {"sep": "\t"})
    first = written(lines.filter("line_no = 0").select("file", F.regexp_replace("value", "^﻿", "").alias("header")), "headers")
    widest = first.agg(F.max(F.size(F.split("header", "\t", -1)))).first()[0]
    if widest is None:
        return spark.createDataFrame([], "struct<>")
    as_array = lambda text: F.array(*[cell(text, widest)[f"c{i}"] for i in range(widest)])
    heads = first.select("file", as_array(F.col("header")).alias("names"))
    named = heads.select("file", F.posexplode("names").alias("at", "name")).filter("coalesce(name, '') <> ''")
    columns = [r["name"] for r in named.groupBy("name").agg(F.min(F.struct("file", "at")).alias("first")).orderBy("first").collect()]  # names of columns
    held = F.broadcast(heads) if heads.count() <= SPLITS else heads
    rows = lines.filter("line_no > 0 and value <> ''").join(held, "file").select(as_array(F.col("value")).alias("cells"), "names")
    return rows.select(*[F.get("cells", F.nullif(F.array_position("names", F.lit(c)), F.lit(0)).cast("int") - 1).alias(c) for c in columns])
