"""Metrics of runs: maps of JSON values (VARIANT), so that numbers, texts, booleans and nulls stay apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KIND = "map<string,variant>"
#: How the types of whole and other numbers begin.
NUMBERS = "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"


def parsed(json: Column) -> Column:
    """The entries of a JSON object; none where the text is missing, broken or anything else."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(json), "$", KIND), F.create_map().cast(KIND))


def number(v: Column) -> Column:
    """The number that a value is; null for all others: booleans and texts are no numbers, whatever they hold."""
    return F.when(F.schema_of_variant(v).rlike(NUMBERS), F.try_variant_get(v, "$", "double"))


def text(v: Column) -> Column:
    """The text that a value is; null for all others."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def present(v: Column) -> Column:
    """v, or null where it is a JSON null."""
    return F.when(~F.is_variant_null(v), v)


def whole_or_double(x: Column) -> Column:
    """A double as a value: a whole number where it has no fraction."""
    return F.when((x == F.floor(x)) & (F.abs(x) < F.lit(2.0**63)), F.floor(x).cast("variant")).otherwise(x.cast("variant"))


def of(metrics: Column, name: str) -> Column:
    return F.try_element_at(metrics, F.lit(name))


def with_values(df: DataFrame, column: str = "metrics") -> DataFrame:
    """df with the column as a map of values, also where it is a map of numbers or texts."""
    kind = df.schema[column].dataType
    if kind.simpleString() == KIND:
        return df
    return df.withColumn(column, F.transform_values(column, lambda k, v: v.cast("variant")))


def numbers(metrics: Column) -> Column:
    """The entries that are numbers, as doubles."""
    return F.map_filter(F.transform_values(metrics, lambda k, v: number(v)), lambda k, v: v.isNotNull())
