"""Exploration: histograms, group summaries, scatter pairs and the target column."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    AnalysisError,
    as_double,
    as_text,
    category_columns,
    melted,
    nan_to_null,
    numeric_columns,
    quoted,
    require_columns,
    small_frame,
)
from ..functions.quantiles import exact_group_quantiles
from .profile import cardinality, categorical_stats, null_profile, numeric_stats, top_values, value_counts

HISTOGRAM_SCHEMA = "column string, bin int, lo double, hi double"
SCATTER_SCHEMA = "pair string, x double, y double"
MAX_GROUPS = 50
CLASS_LIMIT = 20


def numeric_univariate(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numeric statistics with the null count of each column."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    stats = numeric_stats(df, columns)
    if not columns:
        return stats.withColumn("null_count", F.lit(0).cast("bigint"))
    nulls = null_profile(df.select(*map(quoted, columns))).select("column", "null_count")
    return stats.join(F.broadcast(nulls), "column")


def categorical_univariate(
    df: DataFrame, columns: Sequence[str] | None = None, top_n: int = 15
) -> tuple[DataFrame, DataFrame]:
    """Per-column summary, and the top values with their share of the non-null rows."""
    columns = list(columns) if columns is not None else category_columns(df)
    return categorical_stats(df, columns), top_value_shares(df, columns, top_n)


def top_value_shares(df: DataFrame, columns: Sequence[str] | None = None, top_n: int = 15) -> DataFrame:
    columns = list(columns) if columns is not None else category_columns(df)
    top = top_values(df, columns, top_n)
    if not columns:
        return top.withColumn("pct", F.lit(None).cast("double"))
    totals = value_counts(df, columns).groupBy("column").agg(F.sum("n").alias("count"))
    return top.join(totals, "column").select(
        "column", "rank", "value", "n", (F.col("n") / F.col("count") * 100).alias("pct")
    )


def _ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Minimum and maximum of each column that has values."""
    row = df.agg(
        *(f(as_double(c)).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max)))
    ).first()
    found = {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns) if row[f"lo{i}"] is not None}
    for c, ends in found.items():
        if not all(map(math.isfinite, ends)):
            raise AnalysisError(f"Column '{c}' holds infinite values; it has no finite bins.")
    return found


def _edge_frame(df: DataFrame, edges: dict[str, np.ndarray], name: str = "column") -> DataFrame:
    rows = [
        (c, b, float(e[b]), float(e[b + 1])) for c, e in edges.items() for b in range(len(e) - 1)
    ]
    return small_frame(df.sparkSession, rows, HISTOGRAM_SCHEMA.replace("column", name, 1))


def _binned(df: DataFrame, edges: dict[str, np.ndarray], name: str, right_closed: bool, *carry: str) -> DataFrame:
    """``(name, bin, carry...)`` for every non-null value of every binned column.

    The bin comes from arithmetic, then moves one step where the exact edges
    say so.  Columns are unpivoted first, so that one expression serves all.
    """
    columns, n = list(edges), len(next(iter(edges.values()))) - 1

    def literal(values) -> Column:
        return F.array(*(F.lit(v) for v in values))

    slot, x, guess = F.col("__slot"), F.col("__x"), F.col("__guess")
    lo = F.get(literal(float(edges[c][0]) for c in columns), slot)
    span = F.get(literal(float(edges[c][-1] - edges[c][0]) for c in columns), slot)
    bounds = literal(float(e) for c in columns for e in edges[c])
    low, high = (F.get(bounds, slot * (n + 1) + guess + step) for step in (0, 1))
    if right_closed:
        left, right = (x <= low) & (guess > 0), x > high
    else:
        left, right = x < low, (x >= high) & (guess < n - 1)
    entries = [F.struct(F.lit(i).alias("__slot"), as_double(c).alias("__x")) for i, c in enumerate(columns)]
    placed = F.least(F.greatest(F.floor((x - lo) / span * n), F.lit(0)), F.lit(n - 1)).cast("int")
    return (
        melted(df, entries, "__x", *map(quoted, carry))
        .withColumn("__guess", placed)
        .withColumn("bin", F.when(left, guess - 1).when(right, guess + 1).otherwise(guess).cast("int"))
        .select(*map(quoted, carry), F.get(literal(columns), slot).alias(name), "bin")
    )


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    """Equal-width bins per numeric column, right edge closed, empty bins included."""
    df = nan_to_null(df)
    columns = list(columns) if columns is not None else numeric_columns(df)
    require_columns(df, columns)
    ranges = _ranges(df, columns) if columns else {}
    if not ranges:
        return small_frame(df.sparkSession, [], HISTOGRAM_SCHEMA + ", count bigint")
    edges = {
        c: np.linspace(lo, hi, bins + 1) if lo < hi else np.linspace(lo - 0.5, hi + 0.5, bins + 1)
        for c, (lo, hi) in ranges.items()
    }
    counts = _binned(df, edges, "column", False).groupBy("column", "bin").agg(F.count("*").alias("count"))
    return (
        _edge_frame(df, edges)
        .join(counts, ["column", "bin"], "left")
        .withColumn("count", F.coalesce("count", F.lit(0)))
    )


def scatter_pairs(
    df: DataFrame, order_by: str, columns: Sequence[str] | None = None, sample_size: int = 500
) -> DataFrame:
    """The first rows by ``order_by`` without nulls, for each pair of numeric columns.

    Pairs of columns that have no nulls share their first rows, so they share
    one scan; each other set of nullable columns needs a scan of its own.
    Every scan keeps at most ``sample_size`` rows per task.
    """
    df = nan_to_null(df)
    columns = list(columns) if columns is not None else numeric_columns(df)
    require_columns(df, [*columns, order_by])
    pairs = list(combinations(columns, 2))
    if not pairs:
        return small_frame(df.sparkSession, [], SCATTER_SCHEMA)
    counts = df.agg(F.count("*").alias("rows"), *(F.count(quoted(c)).alias(f"c{i}") for i, c in enumerate(columns))).first()
    nullable = {c for i, c in enumerate(columns) if counts[f"c{i}"] < counts["rows"]}
    by_filter: dict[tuple[str, ...], list[tuple[str, str]]] = {}
    for a, b in pairs:
        by_filter.setdefault(tuple(c for c in (a, b) if c in nullable), []).append((a, b))
    parts = []
    for filtered, members in by_filter.items():
        used = [c for c in columns if any(c in m for m in members)]
        rows = df
        for c in filtered:
            rows = rows.where(quoted(c).isNotNull())
        first = rows.orderBy(quoted(order_by)).limit(sample_size).select(*(as_double(c).alias(c) for c in used))
        parts.append(
            first.select(
                F.inline(
                    F.array(
                        *(
                            F.struct(
                                F.lit(f"{a}_vs_{b}").alias("pair"), quoted(a).alias("x"), quoted(b).alias("y")
                            )
                            for a, b in members
                        )
                    )
                )
            )
        )
    return reduce(DataFrame.unionAll, parts)


def group_summary(
    df: DataFrame,
    keys: Sequence[str] | None = None,
    measures: Sequence[str] | None = None,
    max_groups: int = MAX_GROUPS,
) -> DataFrame:
    """Mean, sum, count and median of each measure per category.

    Keys with no value or more than ``max_groups`` values are skipped.
    """
    df = nan_to_null(df)
    keys = list(keys) if keys is not None else category_columns(df)
    measures = list(measures) if measures is not None else numeric_columns(df)
    require_columns(df, [*keys, *measures])
    schema = (
        "cat_col string, category string, num_col string, mean double, sum double, count bigint, median double"
    )
    rows: list[tuple] = []
    if keys and measures:
        sizes = {r.column: r.cardinality for r in cardinality(df, keys).collect()}
        for key in keys:
            if 0 < sizes[key] <= max_groups:
                rows += _one_group_summary(df, key, measures)
    return small_frame(df.sparkSession, rows, schema)


def _one_group_summary(df: DataFrame, key: str, measures: Sequence[str]) -> list[tuple]:
    slim = df.where(quoted(key).isNotNull()).select(
        as_text(key).alias("__key"), *(as_double(m).alias(f"m{i}") for i, m in enumerate(measures))
    )
    columns = [f"m{i}" for i in range(len(measures))]
    extra = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("avg", F.avg), ("sum", F.sum))]
    found = exact_group_quantiles(slim, "__key", columns, [0.5], extra, max_groups=None)
    return [
        (key, g.key, m, g.extra[f"avg_{c}"], g.extra[f"sum_{c}"], g.counts[c], g.values[(c, 0.5)])
        for g in found
        for c, m in zip(columns, measures)
        if g.counts[c]
    ]


def infer_target_task(df: DataFrame, target: str) -> DataFrame:
    """Classification for non-numbers and for fewer than 20 distinct numbers."""
    df = nan_to_null(df)
    require_columns(df, [target])
    distinct = F.count_distinct(quoted(target))
    few = F.lit(target not in numeric_columns(df)) | (distinct < CLASS_LIMIT)
    return df.agg(
        F.lit(target).alias("target"),
        F.when(few, "classification").otherwise("regression").alias("task"),
        distinct.alias("n_unique"),
        F.count_if(quoted(target).isNull()).alias("null_count"),
    )


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Rows and percentage per class, nulls left out."""
    df = nan_to_null(df).where(quoted(target).isNotNull())
    total = df.agg(F.count("*").alias("total"))
    counts = df.groupBy(as_text(target).alias("class")).agg(F.count("*").alias("n"))
    return counts.select("class", "n", (F.col("n") * 100.0 / total.scalar()).alias("pct"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Class count, most and least common class and their ratio, in one row."""
    df = nan_to_null(df)
    require_columns(df, [target])
    counts = df.groupBy(as_text(target).alias("class")).agg(F.count("*").alias("n"))
    known = F.col("class").isNotNull()
    rank = F.when(known, F.struct(-F.col("n"), F.col("class")))
    n = F.when(known, F.col("n"))
    return counts.agg(
        F.count("class").alias("n_classes"),
        F.min_by("class", rank).alias("most_common_class"),
        F.max_by("class", rank).alias("least_common_class"),
        F.when(F.count("class") >= 2, F.max(n) / F.min(n)).alias("imbalance_ratio"),
        F.coalesce(F.max(F.when(~known, F.col("n"))), F.lit(0)).alias("null_count"),
    )


def target_distribution(df: DataFrame, target: str, bins: int = 10) -> tuple[DataFrame, DataFrame]:
    """Statistics and histogram of a numeric target."""
    require_columns(df, [target])
    if target not in numeric_columns(df):
        raise AnalysisError(f"Regression analysis needs a numeric target; '{target}' is not numeric.")
    return numeric_univariate(df, [target]), histogram(df, [target], bins)


def target_mean_by_bin(
    df: DataFrame, target: str, features: Sequence[str] | None = None, bins: int = 10
) -> DataFrame:
    """Mean target per equal-width bin ``(lo, hi]`` of each numeric feature; empty bins left out."""
    df = nan_to_null(df)
    if target not in numeric_columns(df):
        raise AnalysisError(f"Regression analysis needs a numeric target; '{target}' is not numeric.")
    features = list(features) if features is not None else [c for c in numeric_columns(df) if c != target]
    require_columns(df, features)
    known = df.where(quoted(target).isNotNull())
    ranges = _ranges(known, features) if features else {}
    if not ranges:
        return small_frame(
            df.sparkSession, [], "feature string, bin int, lo double, hi double, count bigint, mean_target double"
        )
    edges = {}
    for c, (lo, hi) in ranges.items():
        if lo == hi:
            pad = 0.001 * abs(lo) if lo else 0.001
            edges[c] = np.linspace(lo - pad, hi + pad, bins + 1)
        else:
            edges[c] = np.linspace(lo, hi, bins + 1)
            edges[c][0] -= (hi - lo) * 0.001
    means = (
        _binned(known.withColumn("__y", as_double(target)), edges, "feature", True, "__y")
        .groupBy("feature", "bin")
        .agg(F.count("*").alias("count"), F.avg("__y").alias("mean_target"))
    )
    return means.join(F.broadcast(_edge_frame(df, edges, "feature")), ["feature", "bin"]).select(
        "feature", "bin", "lo", "hi", "count", "mean_target"
    )
