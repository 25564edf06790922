"""What the operators of this subpackage share: table access, Arrow passes, durable intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.durable import written as materialize  # noqa: F401

#: Texts handled together inside a task: about so many characters, so that memory doesn't depend on the batch size.
BLOCK_CHARS = 2_000_000
#: Keys that are broadcast since each has over a 1/HOT of all rows: at most so many.
HOT = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def looked_up(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str, spread: str) -> DataFrame:
    """rows with the columns of table, which has a row for each key; rows without one go.

    weight: of the table, how many rows have this key. Keys of which each has over a 1/HOT of all rows are at most HOT:
    they are broadcast, and their rows are dealt by `spread` in the join with the others, so that no key is a hot one.
    """
    made = [c for c in table.columns if c not in keys]
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = table.filter(F.col(weight) * HOT > total).select(*keys, F.struct(*made).alias("_hot"))
    met = rows.join(F.broadcast(hot), list(keys), "left").withColumn("_deal", F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 30))))
    rest = table.select(*keys, F.struct(*made).alias("_rest"), F.lit(0).cast("long").alias("_deal"))
    joined = met.join(rest, [*keys, "_deal"], "left").withColumn("_found", F.coalesce("_hot", "_rest")).filter("_found is not null")
    return joined.select(*rows.columns, *[F.col(f"_found.{c}").alias(c) for c in made])


def arrow_map(
    df: DataFrame,
    keep: Sequence[str],
    inputs: Sequence[str],
    fields: Sequence[T.StructField],
    fn: Callable[..., list],
) -> DataFrame:
    """Columns `keep` unchanged, then `fields` that fn(*input arrays) makes as lists or arrays, a value for each row.

    A kept column with the name of a new field, in any case of its letters, gives way to the new one.
    """
    made = {f.name.lower() for f in fields}
    keep = [c for c in keep if c.lower() not in made]
    quoted = lambda c: F.col(f"`{c}`")
    src = df.select(*[quoted(c) for c in keep], *[quoted(c).alias(f"__in{i}") for i, c in enumerate(inputs)])
    schema = T.StructType(src.schema.fields[: len(keep)] + list(fields))
    kinds, n, names = [to_arrow_type(f.dataType) for f in fields], len(keep), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                new = fn(*batch.columns[n:])
                new = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(new, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *new], names=names)

    return src.mapInArrow(run, schema)


def finite_vectors(df: DataFrame, vector_col: str) -> DataFrame:
    """The rows whose vector isn't null and holds no null and no non-finite component."""
    fine = F.forall(F.col(f"`{vector_col}`"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.filter(F.coalesce(fine, F.lit(False)))


def list_matrix(column: pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    """Lists of numbers as rows, shorter ones filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if (sizes == width).all():
        return flat.reshape(-1, width).astype(kind)
    out = np.zeros((len(sizes), width), kind)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def blocks(texts: Iterable[str | None], most: int = BLOCK_CHARS) -> Iterator[list[str]]:
    """Runs of texts (null: empty) with about `most` characters; a longer text is a block of its own."""
    block: list[str] = []
    held = 0
    for t in texts:
        t = t or ""
        if block and held + len(t) > most:
            yield block
            block, held = [], 0
        block.append(t)
        held += len(t)
    if block:
        yield block
