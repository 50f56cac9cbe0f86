"""The aggregate behind each chart. A missing column or an empty table gives an empty result."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    as_double,
    as_text,
    nan_to_null,
    numeric_columns,
    quoted,
    small_frame,
)
from ..functions.ordered import lookup_join, stable
from ..functions.quantiles import exact_quantiles, group_quantile_frame
from . import explore, metrics
from .clean import day_first_columns, parsed_time
from .profile import correlation_matrix, top_values

ONE_GROUP = "all"
#: Moments that a box of values keeps for densities, and how many bandwidths a kernel reaches.
MOMENTS, REACH = 13, 9.0


def has_columns(df: DataFrame, *names: str | None) -> bool:
    return all(n in df.columns for n in names if n is not None)


def _empty(df: DataFrame, schema: str) -> DataFrame:
    return small_frame(df.sparkSession, [], schema)


def histogram_bars(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Bins with count and density."""
    schema = "bin int, lo double, hi double, count bigint, density double"
    if column not in numeric_columns(df):
        return _empty(df, schema)
    bars = explore.histogram(df, [column], bins)
    total = bars.agg(F.sum("count").alias("total")).scalar()
    density = F.try_divide(F.col("count"), total * (F.col("hi") - F.col("lo")))
    return bars.select("bin", "lo", "hi", "count", density.alias("density"))


def kernel_density(df: DataFrame, column: str, x_col: str | None = None, points: int = 200) -> DataFrame:
    """Gaussian density on evenly spaced points from minimum to maximum, per category if asked.

    The bandwidth is the sample deviation times n^(-1/5).  Values fall into
    boxes of half a bandwidth, which keep the first MOMENTS moments around
    their middles: that is a Hermite series of the box's kernels, whose rest is
    below 1e-12 of a kernel's height.  A point reads the boxes within REACH
    bandwidths, beyond which a kernel is below 1e-17.
    """
    schema = "category string, point int, x double, density double"
    if column not in numeric_columns(df) or not has_columns(df, x_col):
        return _empty(df, schema)
    rows = _grouped_values(df, column, x_col)
    measures = (
        F.count("*").alias("n"),
        F.min("y").alias("lo"),
        F.max("y").alias("hi"),
        (F.stddev_samp("y") * F.pow(F.count("*").cast("double"), F.lit(-0.2))).alias("width"),
    )
    groups = rows.groupBy("category").agg(*measures).where("width > 0")
    if x_col is None:
        row = groups.first()
        if row is None:
            return _empty(df, schema)
        groups = small_frame(df.sparkSession, [tuple(row)], "category string, n bigint, lo double, hi double, width double")
        spread = rows.select("category", "y", *(F.lit(row[c]).alias(c) for c in ("lo", "width")))
    else:
        groups = stable(groups)
        spread = lookup_join(rows, groups.select("category", "lo", "width", F.col("n").alias("size")), "category", "size")

    box = F.floor((F.col("y") - F.col("lo")) / F.col("width") * 2)
    placed = spread.select("category", box.alias("box"), ((F.col("y") - F.col("lo")) / F.col("width") - (box + 0.5) / 2).alias("u"))
    powers = [reduce(lambda a, _: a * F.col("u"), range(j), F.lit(1.0)) / math.factorial(j) for j in range(MOMENTS)]
    boxes = placed.groupBy("category", "box").agg(*(F.sum(p).alias(f"m{j}") for j, p in enumerate(powers)))

    step = (F.col("hi") - F.col("lo")) / F.col("width") / F.lit(points - 1)  # between points, in bandwidths
    middle = (F.col("box") + 0.5) / 2
    first = F.greatest(F.ceil((middle - REACH) / F.col("step")), F.lit(0))
    last = F.least(F.floor((middle + REACH) / F.col("step")), F.lit(points - 1))
    if x_col is None:  # a join of two single categories would be a cross join
        near = boxes.withColumn("step", F.lit((row.hi - row.lo) / row.width / (points - 1)))
    else:
        near = boxes.join(groups.select("category", step.alias("step")), "category")
    near = near.withColumn("point", F.explode(F.sequence(first, last)))
    near = near.withColumn("t", F.col("point") * F.col("step") - middle)
    series = sum((F.col(f"m{j}") * _hermite(j, F.col("t")) for j in range(1, MOMENTS)), F.col("m0"))
    sums = near.select("category", F.col("point").cast("int").alias("point"), (series * F.exp(-F.col("t") * F.col("t") / 2)).alias("part"))
    sums = sums.groupBy("category", "point").agg(F.sum("part").alias("weight"))
    every = groups.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    joined = every.join(sums, ["category", "point"], "left") if x_col else every.join(sums.drop("category"), "point", "left")
    return joined.select(
        "category",
        "point",
        (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / F.lit(points - 1)).alias("x"),
        (F.coalesce("weight", F.lit(0.0)) / (F.col("n") * F.col("width") * F.sqrt(F.lit(2.0) * F.pi()))).alias("density"),
    )


def _hermite(order: int, t: Column) -> Column:
    """The Hermite polynomial that belongs to exp(-t^2 / 2)."""
    factors = [math.factorial(order) // (math.factorial(k) * math.factorial(order - 2 * k) * 2**k) * (-1) ** k for k in range(order // 2 + 1)]
    square = t * t
    value = reduce(lambda a, c: a * square + c, (float(c) for c in factors[1:]), F.lit(float(factors[0])))
    return value * t if order % 2 else value


def _grouped_values(df: DataFrame, y_col: str, x_col: str | None) -> DataFrame:
    """``(category, y)`` without nulls."""
    rows = nan_to_null(df).where(quoted(y_col).isNotNull())
    if x_col is None:
        return rows.select(F.lit(ONE_GROUP).alias("category"), as_double(y_col).alias("y"))
    rows = rows.where(quoted(x_col).isNotNull())
    return rows.select(as_text(x_col).alias("category"), as_double(y_col).alias("y"))


def frequency_bars(df: DataFrame, column: str, top_n: int = 20) -> DataFrame:
    if not has_columns(df, column):
        return _empty(df, "value string, n bigint")
    return top_values(df, [column], top_n).select("value", "n")


def value_bars(
    df: DataFrame, x_col: str, y_col: str, order_by: str, color_col: str | None = None, top_n: int = 20
) -> DataFrame:
    """The first rows by ``order_by``."""
    if not has_columns(df, x_col, y_col, order_by):
        return _empty(df, "x string, y double, color string")
    return (
        nan_to_null(df)
        .orderBy(quoted(order_by))
        .limit(top_n)
        .select(as_text(x_col).alias("x"), as_double(y_col).alias("y"), _optional(df, color_col, "color"))
    )


def _optional(df: DataFrame, column: str | None, alias: str) -> Column:
    present = column is not None and column in df.columns
    return (as_text(column) if present else F.lit(None).cast("string")).alias(alias)


def pie_shares(df: DataFrame, column: str, top_n: int = 10) -> DataFrame:
    """Top values and their share of what is shown."""
    if not has_columns(df, column):
        return _empty(df, "value string, n bigint, pct double")
    top = top_values(df, [column], top_n)
    shown = top.agg(F.sum("n").alias("shown")).scalar()
    return top.select("value", "n", (F.col("n") * 100.0 / shown).alias("pct"))


def correlation_heatmap(df: DataFrame, method: str = "pearson") -> DataFrame:
    matrix = correlation_matrix(df, method=method)
    return matrix.select("col_a", "col_b", F.round("r", 2).alias("r"))


def scatter_points(
    df: DataFrame, x_col: str, y_col: str, color_col: str | None = None, size_col: str | None = None
) -> DataFrame:
    """All points; null coordinates are not drawn."""
    if not has_columns(df, x_col, y_col):
        return _empty(df, "x double, y double, color string, size double")
    size = as_double(size_col) if size_col is not None and size_col in df.columns else F.lit(None).cast("double")
    return (
        nan_to_null(df)
        .where(quoted(x_col).isNotNull() & quoted(y_col).isNotNull())
        .select(as_double(x_col).alias("x"), as_double(y_col).alias("y"), _optional(df, color_col, "color"), size.alias("size"))
    )


def trend_line(df: DataFrame, x_col: str, y_col: str) -> DataFrame:
    """Least-squares slope and intercept; NULL when x is constant."""
    if not has_columns(df, x_col, y_col):
        return _empty(df, "n bigint, slope double, intercept double, r2 double")
    points = scatter_points(df, x_col, y_col)
    x, y = F.col("x"), F.col("y")
    slope = F.try_divide(F.covar_pop(x, y), F.var_pop(x))
    explained = F.try_divide(F.covar_pop(x, y) * F.covar_pop(x, y), F.var_pop(x) * F.var_pop(y))
    return points.agg(
        F.count("*").alias("n"),
        slope.alias("slope"),
        (F.avg(y) - slope * F.avg(x)).alias("intercept"),
        explained.alias("r2"),
    )


def pair_plot(df: DataFrame, order_by: str, columns: Sequence[str] | None = None, sample_size: int = 500) -> DataFrame:
    chosen = [c for c in (numeric_columns(df) if columns is None else columns) if c in df.columns]
    if len(chosen) < 2 or not has_columns(df, order_by):
        return _empty(df, explore.SCATTER_SCHEMA)
    return explore.scatter_pairs(df, order_by, chosen, sample_size)


BOX_SCHEMA = (
    "category string, n bigint, q1 double, median double, q3 double, "
    "lower_whisker double, upper_whisker double, outliers bigint"
)


def _with_fences(df: DataFrame, y_col: str, x_col: str | None) -> DataFrame:
    rows = _grouped_values(df, y_col, x_col)
    if x_col is None:
        found = exact_quantiles(rows, ["y"])
        values = [found.counts["y"], *found.values.values()]
        fenced = rows.select("*", *(F.lit(v).alias(n) for n, v in zip(("rows", "q1", "median", "q3"), values)))
        if not found.counts["y"]:
            return _empty(df, "category string, y double, rows bigint, q1 double, median double, q3 double, inside boolean")
    else:
        quartiles = group_quantile_frame(rows, "category", "y").select(
            "category", "n", F.col("n").alias("rows"), F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3")
        )
        fenced = lookup_join(rows, quartiles, "category", "n")
    reach = (F.col("q3") - F.col("q1")) * 1.5
    return fenced.withColumn("inside", F.col("y").between(F.col("q1") - reach, F.col("q3") + reach))


def box_plot(df: DataFrame, y_col: str, x_col: str | None = None) -> DataFrame:
    """Quartiles, whiskers at the outermost values inside the fences, and how many lie outside."""
    if y_col not in numeric_columns(df) or not has_columns(df, x_col):
        return _empty(df, BOX_SCHEMA)
    return (
        _with_fences(df, y_col, x_col)
        .groupBy("category", F.col("rows").cast("bigint").alias("n"), "q1", "median", "q3")
        .agg(
            F.min(F.when(F.col("inside"), F.col("y"))).alias("lower_whisker"),
            F.max(F.when(F.col("inside"), F.col("y"))).alias("upper_whisker"),
            F.count_if(~F.col("inside")).alias("outliers"),
        )
    )


def box_outliers(df: DataFrame, y_col: str, x_col: str | None = None) -> DataFrame:
    """Every point outside the fences."""
    if y_col not in numeric_columns(df) or not has_columns(df, x_col):
        return _empty(df, "category string, y double")
    return _with_fences(df, y_col, x_col).where(~F.col("inside")).select("category", "y")


def violin(df: DataFrame, y_col: str, x_col: str | None = None, points: int = 200) -> tuple[DataFrame, DataFrame]:
    """The density outline and the box inside it."""
    return kernel_density(df, y_col, x_col, points), box_plot(df, y_col, x_col)


def roc_curve(df: DataFrame, label: str, score: str, positive: object = 1) -> DataFrame:
    if not has_columns(df, label, score):
        return _empty(df, "threshold double, fpr double, tpr double")
    return metrics.roc_points(df, label, score, positive)


def confusion_cells(df: DataFrame, label: str, prediction: str, labels: Sequence[str] | None = None) -> DataFrame:
    """Matrix cells as text, with display names for classes 0, 1, ... if given."""
    if not has_columns(df, label, prediction):
        return _empty(df, "actual string, predicted string, n bigint")
    cells = metrics.confusion_matrix(df, label, prediction)
    names = F.array(*map(F.lit, labels)) if labels else None

    def shown(c: str) -> Column:
        text = F.col(c).cast("string")
        return F.coalesce(F.get(names, F.col(c).cast("int")), text) if labels else text

    return cells.select(shown("label").alias("actual"), shown("prediction").alias("predicted"), "n")


def importance_bars(importance: DataFrame, top_n: int = 20) -> DataFrame:
    return importance.orderBy(F.desc("importance"), F.desc("feature")).limit(top_n).select("feature", "importance")


def cluster_scatter(
    df: DataFrame, cluster_col: str, x_col: str | None = None, y_col: str | None = None
) -> DataFrame:
    """Two chosen columns, else the first two principal components, with the cluster of each row."""
    schema = "x double, y double, cluster string"
    features = [c for c in numeric_columns(df) if c != cluster_col]
    if not has_columns(df, cluster_col) or not features:
        return _empty(df, schema)
    df = nan_to_null(df)
    cluster = as_text(cluster_col).alias("cluster")
    if x_col and y_col and has_columns(df, x_col, y_col):
        chosen = df.dropna(subset=list({x_col, y_col, cluster_col}))
        return chosen.select(as_double(x_col).alias("x"), as_double(y_col).alias("y"), cluster)
    full = df.dropna(subset=features).select(*(as_double(c).alias(c) for c in features), quoted(cluster_col))
    if full.limit(2).count() < 2:
        return _empty(df, schema)
    axes = principal_axes(full, features, min(2, len(features)))
    row = full.agg(*(F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(features))).first()

    def projected(axis: Sequence[float]) -> Column:
        out = F.lit(0.0)
        for i, c in enumerate(features):
            out = out + (quoted(c) - F.lit(row[f"m{i}"])) * F.lit(float(axis[i]))
        return out

    return full.select(projected(axes[0]).alias("x"), projected(axes[-1]).alias("y"), cluster)


def principal_axes(df: DataFrame, features: Sequence[str], k: int) -> list[list[float]]:
    """Unit axes of largest variance; the largest loading of each is positive."""
    vectors = VectorAssembler(inputCols=list(features), outputCol="__v").transform(df)
    loadings = PCA(k=k, inputCol="__v", outputCol="__pc").fit(vectors).pc.toArray().T
    return [[float(v) for v in axis * (1 if axis[abs(axis).argmax()] >= 0 else -1)] for axis in loadings]


def time_series(df: DataFrame, time_col: str, value_cols: Sequence[str]) -> DataFrame:
    """``(time, series, value)`` in time order; text times are parsed.

    The value is part of the order so that one crowded moment can be split over tasks.
    """
    chosen = [c for c in value_cols if c in df.columns]
    if not has_columns(df, time_col) or not chosen:
        return df.sparkSession.createDataFrame([], "time timestamp, series string, value double")
    df = nan_to_null(df)
    entries = F.array(*(F.struct(F.lit(c).alias("series"), as_double(c).alias("value")) for c in chosen))
    time = parsed_time(df, time_col, day_first_columns(df, [time_col]))
    return (
        df.select(time.alias("time"), F.inline(entries))
        .where(F.col("time").isNotNull())
        .orderBy("time", "series", "value")
    )
