"""Pearson and Spearman correlation of column pairs, pairwise complete."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import as_double, melted, rows_from_struct
from .ordered import lookup_join, ordered_totals, stable

PAIRS_PER_SCAN = 150


def pearson(a: Column, b: Column) -> Column:
    """NULL where a side is constant; ``corr`` would divide by zero there."""
    spread = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    return _clamped(F.try_divide(F.covar_pop(a, b), spread))


def _clamped(r: Column) -> Column:
    return F.when(r.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)))


def _centers(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Means of the columns that have no nulls and more than one value."""
    measures = (("n", F.count), ("m", F.avg), ("lo", F.min), ("hi", F.max))
    row = df.agg(
        F.count("*").alias("rows"),
        *(f(as_double(c)).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in measures),
    ).first()
    return {
        c: row[f"m{i}"]
        for i, c in enumerate(columns)
        if row[f"n{i}"] == row["rows"] and row[f"lo{i}"] != row[f"hi{i}"]
    }


def pearson_pairs(
    df: DataFrame, columns: Sequence[str], centers: Mapping[str, float] | None = None
) -> DataFrame:
    """``(col_a, col_b, r)`` for every unordered pair, in column order.

    Two null-free columns need only sums of products around their means, and
    the sums of one column serve all its pairs.  Pairs with nulls need spreads
    of their own.  ``centers`` gives the means of null-free columns if known.
    """
    means = _centers(df, columns) if centers is None else centers
    pairs = list(combinations(columns, 2))
    scans = []
    for start in range(0, len(pairs), PAIRS_PER_SCAN):
        part = pairs[start : start + PAIRS_PER_SCAN]
        row = df.agg(*(_pair_correlation(a, b, means).alias(f"r{i}") for i, (a, b) in enumerate(part)))
        scans.append(
            rows_from_struct(
                row,
                [
                    F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"r{i}").alias("r"))
                    for i, (a, b) in enumerate(part)
                ],
            )
        )
    return reduce(DataFrame.unionAll, scans)


def _pair_correlation(a: str, b: str, means: Mapping[str, float]) -> Column:
    if a not in means or b not in means:
        return pearson(as_double(a), as_double(b))
    x, y = as_double(a) - F.lit(means[a]), as_double(b) - F.lit(means[b])
    return _clamped(F.try_divide(F.sum(x * y), F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))))


def spearman_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(col_a, col_b, r)`` by average ranks among the rows that have both values.

    The ranks of a column against a partner without nulls are those among all
    its values; each partner with nulls gives ranks of its own.  All of them
    come from one ordered pass over the value counts of all columns, where a
    value counts the rows in which each partner is known.  The rows then look
    up their values' ranks, all columns at once, and the pairs are sums of
    products.  So the number of jobs depends on neither columns nor nulls.
    """
    values = [as_double(c) + 0.0 for c in columns]
    counts = df.agg(F.count("*").alias("rows"), *(F.count(v).alias(f"c{i}") for i, v in enumerate(values))).first()
    gaps = [i for i in range(len(columns)) if counts[f"c{i}"] != counts["rows"]]
    slot = {b: gaps.index(b) + 1 if b in gaps else 0 for b in range(len(columns))}  # of a column's ranks, those against b
    known = [F.lit(1), *(values[b].isNotNull().cast("int") for b in gaps)]

    entry = [F.struct(F.lit(i).alias("column"), v.alias("value"), *(k.alias(f"n{s}") for s, k in enumerate(known))) for i, v in enumerate(values)]
    sizes = [f"n{s}" for s in range(len(known))]
    per_value = melted(df, entry, "value").groupBy("column", "value").agg(*(F.sum(n).cast("bigint").alias(n) for n in sizes))
    placed = ordered_totals(per_value, ["column", "value"], sizes, within=["column"])
    centred = [F.col(f"before_{n}") + (F.col(n) - F.col(f"total_{n}")) / 2 for n in sizes]
    ranks = placed.select("column", "value", F.array(*centred).alias("ranks"), *sizes)
    ranks = stable(ranks)
    spreads = ranks.groupBy("column").agg(
        *(F.sum(F.col(n) * F.pow(F.get("ranks", F.lit(s)), F.lit(2))).alias(f"s{s}") for s, n in enumerate(sizes))
    )
    spread = {(r["column"], s): r[f"s{s}"] for r in spreads.collect() for s in range(len(sizes))}  # a row per column

    rows = df.select(F.monotonically_increasing_id().alias("row"), *(v.alias(f"v{i}") for i, v in enumerate(values)))
    each = [F.struct(F.struct(F.lit(i).alias("column"), F.col(f"v{i}").alias("value")).alias("key"), F.col(f"v{i}").alias("v")) for i in range(len(columns))]
    long = melted(rows, each, "v", F.col("row")).drop("v")
    table = ranks.select(F.struct("column", "value").alias("key"), "ranks", F.col("n0").alias("weight"))
    found = lookup_join(long, table, "key", "weight")
    wide = found.groupBy("row").agg(*(F.first(F.when(F.col("key.column") == i, F.col("ranks")), ignorenulls=True).alias(f"r{i}") for i in range(len(columns))))
    pairs = list(combinations(range(len(columns)), 2))
    if len(pairs) > PAIRS_PER_SCAN:
        wide = stable(wide)
    scans = []
    for start in range(0, len(pairs), PAIRS_PER_SCAN):
        part = pairs[start : start + PAIRS_PER_SCAN]
        sums, told = [], []
        for j, (a, b) in enumerate(part):
            sums.append(F.sum(F.get(f"r{a}", F.lit(slot[b])) * F.get(f"r{b}", F.lit(slot[a]))).alias(f"p{j}"))
            width = (spread.get((a, slot[b])) or 0.0) ** 0.5 * (spread.get((b, slot[a])) or 0.0) ** 0.5
            r = _clamped(F.try_divide(F.col(f"p{j}"), F.lit(float(width))))
            told.append(F.struct(F.lit(columns[a]).alias("col_a"), F.lit(columns[b]).alias("col_b"), r.alias("r")))
        scans.append(rows_from_struct(wide.agg(*sums), told))
    return reduce(DataFrame.unionAll, scans)


def full_matrix(pairs: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both directions of every pair, plus the diagonal (NULL for constant columns)."""
    diagonal = rows_from_struct(
        df.agg(*(F.when(F.stddev_pop(as_double(c)) > 0, 1.0).alias(f"d{i}") for i, c in enumerate(columns))),
        [
            F.struct(F.lit(c).alias("col_a"), F.lit(c).alias("col_b"), F.col(f"d{i}").alias("r"))
            for i, c in enumerate(columns)
        ],
    )
    return (
        pairs.select(
            F.inline(
                F.array(
                    F.struct("col_a", "col_b", "r"),
                    F.struct(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "r"),
                )
            )
        )
        .unionByName(diagonal)
    )
