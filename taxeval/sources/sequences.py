"""FASTQ and FASTA files as records; statistics over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import mate_marked
from .lines import placed, scanned


def faulty(header: Column, seq: Column, plus: Column, qual: Column) -> Column:
    """What is wrong with a FASTQ record; null if nothing is. One with an empty sequence or quality is truncated."""
    return (
        F.when((F.coalesce(seq, F.lit("")) == "") | plus.isNull() | (F.coalesce(qual, F.lit("")) == ""), "truncated").when(~F.startswith(header, F.lit("@")), "no @").when(~F.startswith(plus, F.lit("+")), "no +")
        .when(F.length(seq) != F.length(qual), "lengths differ")
    )


def fastq_records(lines: DataFrame) -> DataFrame:
    """(file, rec, header, seq, qual, fault) of four lines each, of lines in any order; fault is null where a record is
    right."""
    part = lambda i: F.max(F.when(F.col("line_no") % 4 == i, F.regexp_replace("value", "\r$", "")))
    made = lines.groupBy("file", F.floor(F.col("line_no") / 4).alias("rec")).agg(part(0).alias("header"), part(1).alias("seq"), part(2).alias("plus"), part(3).alias("qual"))
    return made.withColumn("fault", faulty(*(F.col(c) for c in ("header", "seq", "plus", "qual")))).drop("plus")


def read_units(spark: SparkSession, paths: list[str] | str, size: int) -> DataFrame:
    """(file, unit, lines): each `size` lines of text files, from the first one on; at a file's end they may be fewer.

    Lines follow each other in a split, so units that lie in one are put together where they are read. Only the lines
    at the edges of splits, fewer than 2 * size of each, are moved.
    """
    lines = placed(scanned(spark, paths))
    unit = F.expr(f"line_no div {size}")
    inside = (unit * size >= F.col("_from")) & ((unit + 1) * size <= F.col("_to"))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            n = rows.num_rows // size * size
            file, at, value = (c.chunk(0) if c.num_chunks else c.combine_chunks() for c in rows.columns)
            number = at.to_numpy()[:n].reshape(-1, size)
            if (number != number[:, :1] // size * size + np.arange(size)).any():
                raise ValueError("lines of a split aren't in order")
            first = pa.array(np.arange(0, n, size))
            yield pa.RecordBatch.from_arrays([file.take(first), pa.array(number[:, 0] // size), pa.ListArray.from_arrays(pa.array(np.arange(0, n + 1, size), pa.int32()), value.slice(0, n))], names=["file", "unit", "lines"])
            held = pa.RecordBatch.from_arrays([file.slice(n), at.slice(n), value.slice(n)], names=batch.schema.names) if n < rows.num_rows else None
        if held is not None:
            raise ValueError("lines of a split aren't whole")

    whole = lines.filter(inside).select("file", "line_no", "value").mapInArrow(together, "file string, unit long, lines array<string>")
    parts = lines.filter(~inside).groupBy("file", unit.alias("unit")).agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]).alias("lines"))
    cut = F.transform("lines", lambda x: F.regexp_replace(x, "\r$", ""))
    return whole.unionByName(parts).withColumn("lines", cut)


def read_fastq(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """fastq_records() of files."""
    line = lambda i: F.get("lines", F.lit(i))
    return read_units(spark, paths, 4).select("file", F.col("unit").alias("rec"), line(0).alias("header"), line(1).alias("seq"), line(3).alias("qual"), faulty(*map(line, range(4))).alias("fault"))


def read_pairs(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(file, pair, r1, r2) of interleaved FASTQ files: records 2k and 2k + 1, each with header, seq, qual and fault; r2 is
    null if a file ends before it."""
    line = lambda i: F.get("lines", F.lit(i))
    record = lambda i: F.struct(line(i).alias("header"), line(i + 1).alias("seq"), line(i + 3).alias("qual"), faulty(*(line(i + j) for j in range(4))).alias("fault"))
    return read_units(spark, paths, 8).select("file", F.col("unit").alias("pair"), record(0).alias("r1"), F.when(F.size("lines") > 4, record(4)).alias("r2"))


def fasta_records(blocks: DataFrame) -> DataFrame:
    """(file, header, seq, fault) of blocks(file, value), each the text from one > to the next. Lines lose white space at
    their ends only, and blank ones don't count; a sequence before a header is an error."""
    v = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    cut = F.split(v, "\n", 2)
    had = F.col("value").startswith(">") | F.col("marked")
    rows = blocks.select("file", had.alias("_had"), F.when(had, cut[0]).alias("header"), F.regexp_replace(F.when(had, F.coalesce(F.get(cut, F.lit(1)), F.lit(""))).otherwise(v), r"(?U)^\s+|\s*\n\s*|\s+$", "").alias("seq"))
    return rows.filter("_had or seq <> ''").select("file", "header", "seq", F.when(~F.col("_had"), "sequence before a header").alias("fault"))


def read_fasta(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """FASTA files split at each > that begins a line; only a file's first block may lack it. A row holds a sequence:
    fasta_lengths() is for those that are too long."""
    return fasta_records(placed(scanned(spark, paths, "\n>")).select("file", "value", (F.col("line_no") > 0).alias("marked")))


def fasta_pieces(lines: DataFrame) -> DataFrame:
    """Of scanned lines, what each split knows of its records: (file, _split, at, header, length, gc, open). header is null
    for what comes before a split's first one; open: the split ends with it, and the next may go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "_split", "at", "header", "length", "gc", "open"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        held: list | None = None
        for batch in batches:
            file, split, value = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2)
            text = pc.utf8_trim_whitespace(value)
            head = pc.starts_with(value, ">").to_numpy(zero_copy_only=False)
            size = np.where(head, 0, pc.utf8_length(text).to_numpy(zero_copy_only=False))
            gc = np.where(head, 0, pc.count_substring_regex(text, "[GCgc]").to_numpy(zero_copy_only=False))
            fresh = np.r_[True, (split[1:] != split[:-1]) | np.array([a != b for a, b in zip(file[1:], file[:-1], strict=True)], bool)]
            starts = np.flatnonzero(head | fresh)
            out: list[list] = []
            for i, n, g in zip(starts.tolist(), np.add.reduceat(size, starts).tolist(), np.add.reduceat(gc, starts).tolist(), strict=True):
                same = held is not None and held[:2] == [file[i], int(split[i])]
                if same and not head[i]:  # the last batch's record goes on
                    held[4] += n
                    held[5] += g
                    continue
                if held is not None:
                    out.append([*held, not same])
                name = value[i].as_py()[1:].removesuffix("\r") if head[i] else None
                held = [file[i], int(split[i]), held[2] + 1 if same else 0, name, n, g]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names=names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([*held, True], kinds, strict=True)], names=names)

    return lines.select("file", "_split", "value").mapInArrow(run, "file string, _split long, at long, header string, length long, gc long, open boolean")


def fasta_lengths(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(file, header, length, gc, fault) of the records of FASTA files, of whatever length: no row holds a sequence.

    Splits add up what they read; only what is open at their ends is put together, a few rows of each split.
    """
    pieces = fasta_pieces(scanned(spark, paths))
    inner = F.col("header").isNotNull() & ~F.col("open")
    order = Window.partitionBy("file").orderBy("_split", "at").rowsBetween(Window.unboundedPreceding, 0)  # two rows of a split at most
    edges = pieces.filter(~inner).withColumn("rec", F.sum(F.col("header").isNotNull().cast("long")).over(order))
    joined = edges.groupBy("file", "rec").agg(F.max("header").alias("header"), F.sum("length").alias("length"), F.sum("gc").alias("gc")).filter("rec > 0 or length > 0")
    fault = F.when(F.col("header").isNull(), "sequence before a header")
    return pieces.filter(inner).select("file", "header", "length", "gc").unionByName(joined.drop("rec")).withColumn("fault", fault)


def mark_records(records: DataFrame, mate: int) -> DataFrame:
    """FASTQ records under the ids of a mate: the header is the marked id alone."""
    return records.withColumn("header", F.concat(F.lit("@"), mate_marked(F.col("header"), F.lit(mate))))


def record_totals(records: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, records, bases) of records."""
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(F.length("seq").cast("long")), F.lit(0)).alias("bases"))


def tag_records(records: DataFrame, targets: DataFrame) -> DataFrame:
    """FASTA records(file, header, seq) with the taxid of their file's target(path, taxid) in the first word of the
    header, unless one is there; and seq_id, that word: (seq_id, taxid) is the map of sequences. Records of files that
    aren't targets, and those without a header, stay out."""
    rows = records.join(targets.select(F.col("path").alias("file"), "taxid"), "file").filter("coalesce(header, '') <> ''")
    word, rest = F.regexp_extract("header", r"^\s*(\S*)", 1), F.regexp_extract("header", r"^\s*\S+\s+(.*)$", 1)
    mark = "|kraken:taxid|"  # a fixed value of the format
    own = F.when(F.contains(word, F.lit(mark)), word).otherwise(F.concat(word, F.lit(mark), F.col("taxid").cast("string")))
    return rows.withColumn("seq_id", own).withColumn("header", F.when(rest != "", F.concat_ws(" ", own, rest)).otherwise(own))


def head_records(records: DataFrame, n: int) -> DataFrame:
    """The first n records of each file."""
    return records.filter(F.col("rec") < n)
