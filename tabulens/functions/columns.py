"""Column classes, NaN handling and small-result helpers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)

_ARROW = {
    "string": pa.string(),
    "double": pa.float64(),
    "bigint": pa.int64(),
    "int": pa.int32(),
    "boolean": pa.bool_(),
    "array<double>": pa.list_(pa.float64()),
}


class AnalysisError(ValueError):
    """A request that the given table cannot answer."""


def numeric_columns(df: DataFrame) -> list[str]:
    """Numbers of any width; booleans are not numbers."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def category_columns(df: DataFrame) -> list[str]:
    """Everything that is not a number and can be grouped: text, booleans, dates."""
    return [f.name for f in df.schema if not isinstance(f.dataType, (T.NumericType, *NESTED))]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def model_category_columns(df: DataFrame) -> list[str]:
    """Text and booleans: the categories a model can use."""
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def time_columns(df: DataFrame) -> list[str]:
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
    ]


def plain_columns(df: DataFrame) -> list[str]:
    """Columns with equality, in schema order."""
    return [f.name for f in df.schema if not isinstance(f.dataType, NESTED)]


def require_columns(df: DataFrame, names: Iterable[str], error: type[Exception] = AnalysisError) -> None:
    for name in names:
        if name not in df.columns:
            raise error(f"Column '{name}' not found in DataFrame.")


def quoted(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is one thing: NaN becomes NULL in floating-point columns."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(
        *(
            F.when(~F.isnan(quoted(c)), quoted(c)).alias(c) if c in floats else quoted(c)
            for c in df.columns
        )
    )


def as_double(name: str) -> Column:
    return quoted(name).cast("double")


def finite(value: Column) -> Column:
    """NULL in place of NaN and the infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def as_text(name: str) -> Column:
    return quoted(name).cast("string")


def rows_from_struct(df: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """Turn a one-row aggregate into one row per given struct."""
    return df.select(F.inline(F.array(*structs)))


def melted(df: DataFrame, entries: Sequence[Column], keep: str, *carry: Column) -> DataFrame:
    """One row per entry whose field ``keep`` is not NULL, with the ``carry`` columns beside it.

    The filter comes after the expansion: dropping entries inside the array
    would need a lambda, which runs outside generated code.
    """
    return df.select(*carry, F.inline(F.array(*entries))).where(quoted(keep).isNotNull())


def small_frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A DataFrame from a few summary rows; goes over Arrow as a local relation."""
    fields = [part.strip().split(" ", 1) for part in schema.split(", ")]
    arrays = [
        pa.array([row[i] for row in rows], type=_ARROW[kind.strip()])
        for i, (_, kind) in enumerate(fields)
    ]
    return spark.createDataFrame(pa.table(arrays, names=[name for name, _ in fields]))
