"""Whole profiles and explorations: named sets of result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import category_columns, numeric_columns, small_frame
from ..operators import clean, explore, profile

CELL_SCHEMA = "column string, measure string, number double, text string"


def profile_dataframe(df: DataFrame, top_n: int = 10) -> dict[str, DataFrame]:
    """Every profiling result by name."""
    return {
        "shape": profile.shape(df),
        "size": profile.size_in_bytes(df),
        "types": profile.column_types(df),
        "nulls": profile.null_profile(df),
        "cardinality": profile.cardinality(df),
        "numeric_stats": profile.numeric_stats(df),
        "categorical_stats": profile.categorical_stats(df),
        "top_values": profile.top_values(df, top_n=top_n),
        "pearson": profile.correlation_matrix(df),
        "spearman": profile.correlation_matrix(df, method="spearman"),
    }


def run_eda(
    df: DataFrame,
    order_by: str,
    target: str | None = None,
    task: str | None = None,
    top_n_categories: int = 15,
    scatter_sample_size: int = 500,
    n_bins: int = 10,
) -> dict[str, DataFrame]:
    """Every exploration result by name; target tables only with a target."""
    out = {
        "numeric": explore.numeric_univariate(df),
        "histogram": explore.histogram(df, bins=n_bins),
        "categorical": profile.categorical_stats(df),
        "top_values": explore.top_value_shares(df, top_n=top_n_categories),
        "pearson": profile.correlation_matrix(df),
        "spearman": profile.correlation_matrix(df, method="spearman"),
        "scatter": explore.scatter_pairs(df, order_by, sample_size=scatter_sample_size),
        "groups": explore.group_summary(df),
    }
    if target is not None and target in df.columns:
        inferred = explore.infer_target_task(df, target)
        out["target"] = inferred if task is None else inferred.withColumn("task", F.lit(task))
        if (task or inferred.first().task) == "classification":
            out["class_distribution"] = explore.class_distribution(df, target)
            out["class_balance"] = explore.class_balance(df, target)
        else:
            stats, bars = explore.target_distribution(df, target, n_bins)
            out.update(target_stats=stats, target_histogram=bars)
            out["target_mean_by_bin"] = explore.target_mean_by_bin(df, target, bins=n_bins)
    return out


def dataset_summary(df: DataFrame, top_n: int = 3) -> DataFrame:
    """The table in a few rows: overview, numeric summaries and top categories."""
    whole = profile.overview(df)
    names = whole.columns
    head = whole.select(
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.lit(None).cast("string").alias("column"),
                        F.lit(n).alias("measure"),
                        F.col(n).cast("double").alias("number"),
                        F.lit(None).cast("string").alias("text"),
                    )
                    for n in names
                )
            )
        )
    )
    stats = profile.numeric_stats(df)
    numbers = stats.select(
        F.inline(
            F.array(
                *(
                    F.struct(
                        "column", F.lit(n).alias("measure"), F.col(n).alias("number"), F.lit(None).cast("string").alias("text")
                    )
                    for n in ("mean", "std", "min", "max")
                )
            )
        )
    )
    tops = profile.top_values(df, category_columns(df), top_n).select(
        "column",
        F.concat(F.lit("top_"), F.col("rank").cast("string")).alias("measure"),
        F.col("n").cast("double").alias("number"),
        F.col("value").alias("text"),
    )
    return head.unionByName(numbers).unionByName(tops)


def insight_tables(df: DataFrame, outlier_method: str = "iqr") -> dict[str, DataFrame]:
    """Summary, strongest correlations, skewed columns and outliers."""
    numbers = numeric_columns(df)
    empty = small_frame(df.sparkSession, [], "column string, lower double, upper double, outliers bigint, outlier_rows bigint, outlier_pct double")
    bounds = clean.fit_outlier_bounds(df, outlier_method) if numbers else None
    return {
        "summary": dataset_summary(df),
        "top_correlations": profile.top_correlations(df),
        "skewed": profile.skewed_columns(profile.numeric_stats(df)),
        "outliers": clean.outlier_summary(df, bounds) if bounds else empty,
    }
