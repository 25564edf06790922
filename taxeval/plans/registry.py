"""All queries over the driver's tables: name -> (DataFrame query, SQL that must give the same rows, or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bindings import Bound

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers make(bound) -> DataFrame under a name."""

    def add(make: Callable[[Bound], DataFrame]) -> Callable[[Bound], DataFrame]:
        _FOUND[name] = (lambda spark, sf_dir: make(Bound(spark, sf_dir)), sql)
        return make

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded: sums depend on the order of their terms."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def registered() -> dict[str, tuple[Query, str | None]]:
    from . import cohorts, parsing, rollups, scoring  # noqa: F401

    return dict(_FOUND)
