"""Profiling: what the table and each of its columns look like."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    as_double,
    as_text,
    category_columns,
    finite,
    melted,
    nan_to_null,
    numeric_columns,
    plain_columns,
    quoted,
    require_columns,
    rows_from_struct,
    small_frame,
)
from ..functions.correlation import full_matrix, pearson_pairs, spearman_pairs
from ..functions.quantiles import QUARTILES, exact_quantiles

CORRELATION_SCHEMA = "col_a string, col_b string, r double"
STATS_SCHEMA = (
    "column string, count bigint, mean double, median double, std double, min double, "
    "max double, q1 double, q3 double, iqr double, skewness double, kurtosis double"
)

FIXED_WIDTH = {
    T.BooleanType: 1,
    T.ByteType: 1,
    T.ShortType: 2,
    T.IntegerType: 4,
    T.LongType: 8,
    T.FloatType: 4,
    T.DoubleType: 8,
    T.DateType: 4,
    T.TimestampType: 8,
    T.TimestampNTZType: 8,
    T.DecimalType: 16,
}


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).select("rows", F.lit(len(df.columns)).cast("bigint").alias("columns"))


def size_in_bytes(df: DataFrame) -> DataFrame:
    """Logical bytes: fixed widths of the non-null cells plus the bytes of text."""
    parts = []
    for f in df.schema:
        c = quoted(f.name)
        width = FIXED_WIDTH.get(type(f.dataType))
        if width is not None:
            parts.append(F.count(c) * width)
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.sum(F.octet_length(c)), F.lit(0)))
        else:
            parts.append(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(c)))), F.lit(0)))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return df.agg(total.cast("bigint").alias("size_bytes"))


def column_types(df: DataFrame) -> DataFrame:
    numbers, groups = set(numeric_columns(df)), set(category_columns(df))
    kinds = {c: "numeric" if c in numbers else "categorical" if c in groups else "other" for c in df.columns}
    return small_frame(
        df.sparkSession,
        [(name, kind, kinds[name]) for name, kind in df.dtypes],
        "column string, type string, kind string",
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls and their percentage per column, from one scan."""
    df = nan_to_null(df)
    row = df.agg(
        F.count("*").alias("rows"), *(F.count(quoted(c)).alias(f"c{i}") for i, c in enumerate(df.columns))
    )
    return rows_from_struct(
        row,
        [
            F.struct(
                F.lit(c).alias("column"),
                (F.col("rows") - F.col(f"c{i}")).alias("null_count"),
                F.try_divide((F.col("rows") - F.col(f"c{i}")) * 100.0, F.col("rows")).alias("null_pct"),
            )
            for i, c in enumerate(df.columns)
        ],
    )


def null_summary(df: DataFrame) -> DataFrame:
    return null_profile(df).where("null_count > 0")


def cardinality(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column."""
    df = nan_to_null(df)
    columns = list(columns) if columns is not None else plain_columns(df)
    require_columns(df, columns)
    count = F.approx_count_distinct if approximate else F.count_distinct
    row = df.agg(*(count(quoted(c)).alias(f"c{i}") for i, c in enumerate(columns)))
    return rows_from_struct(
        row,
        [
            F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("cardinality"))
            for i, c in enumerate(columns)
        ],
    )


def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, quartiles, spread and shape of every numeric column.

    All moments of all columns come from one scan; the quartiles are exact.
    """
    df = nan_to_null(df)
    columns = list(columns) if columns is not None else numeric_columns(df)
    require_columns(df, columns)
    if not columns:
        return small_frame(df.sparkSession, [], STATS_SCHEMA)
    extra = []
    for i, c in enumerate(columns):
        x = as_double(c)
        extra += [
            finite(F.avg(x)).alias(f"mean{i}"),
            finite(F.when(F.count(x) == 1, 0.0).otherwise(F.stddev_samp(x))).alias(f"std{i}"),
            finite(F.min(x)).alias(f"min{i}"),
            finite(F.max(x)).alias(f"max{i}"),
            finite(F.skewness(x)).alias(f"skew{i}"),
            finite(F.kurtosis(x)).alias(f"kurt{i}"),
        ]
    found = exact_quantiles(df, columns, QUARTILES, extra)
    rows = []
    for i, c in enumerate(columns):
        # like the moments, quartiles are NULL where they are not finite
        q1, median, q3 = (q if q is not None and math.isfinite(q) else None for q in (found.values[(c, p)] for p in QUARTILES))
        mean, std, low, high, skew, kurt = (
            found.extra[f"{s}{i}"] for s in ("mean", "std", "min", "max", "skew", "kurt")
        )
        iqr = None if q1 is None or q3 is None else q3 - q1
        rows.append((c, found.counts[c], mean, median, std, low, high, q1, q3, iqr, skew, kurt))
    return small_frame(df.sparkSession, rows, STATS_SCHEMA)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n)`` of all non-null values of the given columns, values as text.

    One scan and one grouping for all columns; equal values are combined
    before the shuffle, so a dominant value is no hot spot.
    """
    entries = [F.struct(F.lit(c).alias("column"), as_text(c).alias("value")) for c in columns]
    return melted(nan_to_null(df), entries, "value").groupBy("column", "value").agg(F.count("*").alias("n"))


def top_values(df: DataFrame, columns: Sequence[str] | None = None, top_n: int = 10) -> DataFrame:
    """The most frequent values per column; ties by value. ``(column, rank, value, n)``."""
    columns = list(columns) if columns is not None else category_columns(df)
    require_columns(df, columns)
    if not columns:
        return small_frame(df.sparkSession, [], "column string, rank int, value string, n bigint")
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return (
        value_counts(df, columns)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_n)
        .select("column", "rank", "value", "n")
    )


def categorical_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, nulls, cardinality and mode of every non-numeric column."""
    columns = list(columns) if columns is not None else category_columns(df)
    require_columns(df, columns)
    schema = "column string, count bigint, null_count bigint, cardinality bigint, mode string"
    if not columns:
        return small_frame(df.sparkSession, [], schema)
    per_column = value_counts(df, columns).groupBy("column").agg(
        F.sum("n").alias("count"),
        F.count("*").alias("cardinality"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"),
    )
    nulls = null_profile(df.select(*map(quoted, columns))).select("column", "null_count")
    return nulls.join(per_column, "column", "left").select(
        "column",
        F.coalesce("count", F.lit(0)).alias("count"),
        "null_count",
        F.coalesce("cardinality", F.lit(0)).alias("cardinality"),
        "mode",
    )


def correlation_pairs(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson"
) -> DataFrame:
    """One row per unordered pair of numeric columns."""
    df = nan_to_null(df)
    columns = list(columns) if columns is not None else numeric_columns(df)
    require_columns(df, columns)
    if len(columns) < 2:
        return small_frame(df.sparkSession, [], CORRELATION_SCHEMA)
    return (pearson_pairs if method == "pearson" else spearman_pairs)(df, columns)


def correlation_matrix(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson"
) -> DataFrame:
    """The whole matrix in long form; empty with fewer than two numeric columns."""
    df = nan_to_null(df)
    columns = list(columns) if columns is not None else numeric_columns(df)
    pairs = correlation_pairs(df, columns, method)
    return pairs if len(columns) < 2 else full_matrix(pairs, df, columns)


def column_info(df: DataFrame, order_by: str) -> DataFrame:
    """Type, counts, distinct values and the first non-null value by ``order_by``."""
    df = nan_to_null(df)
    require_columns(df, [order_by])
    columns = plain_columns(df)
    key = quoted(order_by)
    row = df.agg(
        *(F.min_by(as_text(c), F.when(quoted(c).isNotNull(), key)).alias(f"s{i}") for i, c in enumerate(columns))
    )
    samples = rows_from_struct(
        row,
        [F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("sample")) for i, c in enumerate(columns)],
    )
    counts = rows_from_struct(
        df.agg(F.count("*").alias("rows"), *(F.count(quoted(c)).alias(f"c{i}") for i, c in enumerate(columns))),
        [
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"c{i}").alias("non_null"),
                (F.col("rows") - F.col(f"c{i}")).alias("null_count"),
            )
            for i, c in enumerate(columns)
        ],
    )
    return (
        column_types(df)
        .select("column", "type")
        .join(counts, "column")
        .join(cardinality(df, columns), "column")
        .join(samples, "column")
        .select("column", "type", "non_null", "null_count", F.col("cardinality").alias("unique"), "sample")
    )


def overview(df: DataFrame) -> DataFrame:
    """Rows, column classes, missing cells and duplicate rows from one grouping of the whole rows."""
    df = nan_to_null(df)
    plain = plain_columns(df)
    grouped = df.groupBy(*map(quoted, plain)).agg(F.count("*").alias("__n"))
    missing = F.lit(0)
    for c in plain:
        missing = missing + F.when(quoted(c).isNull(), F.col("__n")).otherwise(0)
    rows, cells = F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.sum(missing), F.lit(0))
    n_numeric = len(numeric_columns(df))
    return grouped.agg(
        rows.alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.lit(n_numeric).cast("bigint").alias("numeric_columns"),
        F.lit(len(df.columns) - n_numeric).cast("bigint").alias("categorical_columns"),
        cells.alias("missing_cells"),
        (cells * 100.0 / F.greatest(rows * len(df.columns), F.lit(1))).alias("missing_pct"),
        (rows - F.count("*")).alias("duplicate_rows"),
    )


def skewed_columns(stats: DataFrame, threshold: float = 1.0, top_n: int = 10) -> DataFrame:
    """Columns of a ``numeric_stats`` result with strong skew, strongest first."""
    return (
        stats.where(F.abs("skewness") > threshold)
        .orderBy(F.abs("skewness").desc(), F.asc("column"))
        .limit(top_n)
        .select("column", "skewness")
    )


def top_correlations(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson", top_n: int = 10
) -> DataFrame:
    """The strongest pairs by absolute correlation."""
    return (
        correlation_pairs(df, columns, method)
        .where("r is not null")
        .orderBy(F.abs("r").desc(), "col_a", "col_b")
        .limit(top_n)
    )
