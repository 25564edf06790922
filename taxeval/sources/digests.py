"""Digests of files' bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.durable import written

#: Endings of files that Spark unpacks.
PACKED = ("gz", "bz2", "deflate", "lz4", "snappy", "zst", "zstd", "xz")
#: A split that no file is larger than, for reading each file in one task.
WHOLE = str(1 << 60)


@contextmanager
def whole_files(spark: SparkSession) -> Iterator[None]:
    """While it lasts, each file of a scan is a split and a partition of its own."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = [spark.conf.get(n) for n in names]
    try:
        for n in names:
            spark.conf.set(n, WHOLE)
        yield
    finally:
        for n, v in zip(names, old, strict=True):
            spark.conf.set(n, v)


def file_digests(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, bytes, sha256) of plain files of any size, empty ones included, from any store that Spark reads.

    A digest needs all bytes of a file in order: each file streams through one task, line by line, and nothing is moved
    or held. What a file ends with follows from its size. Compressed files, which Spark unpacks, are taken whole instead
    (those over 2 GB are an error).
    """
    listed = spark.read.format("binaryFile").load(paths).select(F.col("path"), F.col("length").alias("bytes"))
    packed = F.col("path").rlike("[.](" + "|".join(PACKED) + ")$")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h, seen = None, None, 0

        def told() -> pa.RecordBatch:
            if seen + 1 == key[1]:
                h.update(b"\n")
            elif seen != key[1]:
                raise ValueError(f"{key[0]} changed while it was read")
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([h.hexdigest()])], names=["path", "bytes", "sha256"])

        for batch in batches:
            for path in dict.fromkeys(batch.column(0).to_pylist()):
                rows = batch.filter(pc.equal(batch.column(0), path))
                text = b"\n".join(rows.column(2).to_pylist())
                if key is None or key[0] != path:
                    if key is not None:
                        yield told()
                    key, h, seen = (path, rows.column(1)[0].as_py()), hashlib.sha256(text), len(text)
                else:
                    h.update(b"\n" + text)
                    seen += 1 + len(text)
        if key is not None:
            yield told()

    with whole_files(spark):
        lines = spark.read.option("lineSep", "\n").text([r["path"] for r in listed.filter(~packed & (F.col("bytes") > 0)).select("path").collect()] or paths)
        lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))
        plain = written(lines.filter(~packed).mapInArrow(digest, "path string, bytes long, sha256 string"), "digests")
    packs = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(PACKED) + "}").load(paths)  # no other file is read whole
    whole = packs.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    # Scans leave empty files out, the list of files does not.
    named = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    every = spark.createDataFrame([(f,) for f in listed.inputFiles()], "path string")
    seen = listed.filter("bytes > 0").select(named(F.col("path")).alias("_path"))
    empty = every.join(seen, named(F.col("path")) == F.col("_path"), "left_anti").select("path", F.lit(0).cast("long").alias("bytes"), F.sha2(F.lit(""), 256).alias("sha256"))
    return plain.unionByName(whole).unionByName(empty)
