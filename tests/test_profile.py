import math

import numpy as np
import pandas as pd
import pytest
from conftest import by
from pyspark.sql import functions as F

from tabulens.functions import ordered
from tabulens.operators import profile as P
from tabulens.plans.report import dataset_summary, profile_dataframe


@pytest.fixture
def mixed(frame):
    return frame(
        "score double, grade string, level bigint",
        (90.0, "A", 1), (85.0, "B", 2), (None, "A", 3), (70.0, None, 1), (88.0, "A", 2),
    )


def test_shape_types_and_size(mixed):
    assert P.shape(mixed).first().asDict() == {"rows": 5, "columns": 3}
    assert by(P.column_types(mixed), "column")["grade"] == {"column": "grade", "type": "string", "kind": "categorical"}
    assert P.size_in_bytes(mixed).first().size_bytes == 4 * 8 + 4 + 5 * 8


def test_nulls_and_nan_are_the_same(frame):
    df = frame("x double, s string", (1.0, "a"), (math.nan, None), (None, "b"), (3.0, "a"))
    nulls = by(P.null_profile(df), "column")
    assert (nulls["x"]["null_count"], nulls["x"]["null_pct"]) == (2, 50.0)
    assert nulls["s"]["null_count"] == 1
    stats = P.numeric_stats(df).first()
    assert (stats["count"], stats.mean, stats.max) == (2, 2.0, 3.0)
    assert by(P.cardinality(df), "column")["x"]["cardinality"] == 2


def test_numeric_stats_by_hand(frame):
    df = frame("a double, b double", *[(v, v * 10) for v in (1.0, 2.0, 3.0, 4.0, 10.0)])
    row = by(P.numeric_stats(df), "column")["a"]
    values = np.array([1, 2, 3, 4, 10.0])
    centred = values - values.mean()
    assert (row["count"], row["mean"], row["median"]) == (5, 4.0, 3.0)
    assert row["std"] == pytest.approx(values.std(ddof=1))
    assert (row["q1"], row["q3"], row["iqr"]) == (2.0, 4.0, 2.0)
    assert row["skewness"] == pytest.approx((centred**3).mean() / (centred**2).mean() ** 1.5)
    assert row["kurtosis"] == pytest.approx((centred**4).mean() / (centred**2).mean() ** 2 - 3)


def test_degenerate_numeric_columns(frame):
    df = frame("one double, none double, same int", (None, None, 7), (5.0, None, 7))
    stats = by(P.numeric_stats(df), "column")
    assert stats["one"]["std"] == 0.0 and stats["one"]["count"] == 1
    assert stats["none"]["count"] == 0
    assert all(stats["none"][k] is None for k in ("mean", "median", "std", "min", "max", "q1", "iqr", "skewness"))
    assert stats["same"]["std"] == 0.0 and stats["same"]["skewness"] is None and stats["same"]["kurtosis"] is None


def test_no_numeric_columns_give_an_empty_result(frame):
    df = frame("s string", ("a",))
    assert P.numeric_stats(df).count() == 0
    assert P.correlation_matrix(df).count() == 0


def test_categorical_stats_and_ties(frame):
    df = frame("c string, e string", ("x", None), ("y", None), ("y", None), ("x", None), ("z", None), (None, None))
    stats = by(P.categorical_stats(df), "column")
    assert stats["c"] == {"column": "c", "count": 5, "null_count": 1, "cardinality": 3, "mode": "x"}
    assert stats["e"] == {"column": "e", "count": 0, "null_count": 6, "cardinality": 0, "mode": None}
    top = P.top_values(df, ["c"], 2).orderBy("rank").collect()
    assert [(r.rank, r.value, r.n) for r in top] == [(1, "x", 2), (2, "y", 2)]


def test_top_values_are_limited_before_the_shuffle(mixed):
    plan = P.top_values(mixed)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2  # partial and final


def test_booleans_and_dates_are_categories(spark):
    df = spark.sql("select true as b, date'2024-01-01' as d, 1 as n")
    assert set(by(P.categorical_stats(df), "column")) == {"b", "d"}
    assert [r.column for r in P.numeric_stats(df).collect()] == ["n"]


def test_pearson_perfect_constant_and_pairwise_nulls(frame):
    df = frame(
        "a double, b double, c double, d double, k double",
        *[(float(i), 2.0 * i, -float(i), None if i == 2 else float(i * i), 0.1) for i in range(6)],
    )
    m = by(P.correlation_matrix(df), ["col_a", "col_b"])
    assert m[("a", "b")]["r"] == pytest.approx(1.0)
    assert m[("c", "a")]["r"] == pytest.approx(-1.0)
    assert m[("a", "k")]["r"] is None and m[("k", "k")]["r"] is None
    assert m[("d", "d")]["r"] == 1.0
    keep = [0, 1, 3, 4, 5]
    assert m[("a", "d")]["r"] == pytest.approx(np.corrcoef(keep, np.square(keep))[0, 1])


@pytest.mark.parametrize("large", [False, True])
def test_spearman_agrees_with_pandas(spark, monkeypatch, large):
    if large:
        monkeypatch.setattr(ordered, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(ordered, "HOT_SHARE", 4)
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.integers(0, 5, 200).astype(float), "b": rng.normal(size=200), "c": rng.normal(size=200)})
    pdf["b"] += pdf["a"]
    pdf.loc[pdf.index % 9 == 0, "c"] = np.nan
    got = by(P.correlation_matrix(spark.createDataFrame(pdf), method="spearman"), ["col_a", "col_b"])
    want = pdf.rank().corr() if not pdf.isna().any().any() else None
    for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
        both = pdf[[x, y]].dropna().rank()
        assert got[(x, y)]["r"] == pytest.approx(both[x].corr(both[y]))
    assert want is None


def test_overview_counts_duplicates_with_nulls(frame):
    df = frame("x int, y string", (1, None), (1, None), (2, "a"), (None, None))
    row = P.overview(df).first()
    assert (row["rows"], row.missing_cells, row.duplicate_rows) == (4, 4, 1)
    assert row.missing_pct == pytest.approx(50.0)


def test_column_info_takes_the_first_value_in_order(frame):
    info = by(P.column_info(frame("id int, v string", (3, "c"), (1, None), (2, "b")), "id"), "column")
    assert info["v"] == {"column": "v", "type": "string", "non_null": 2, "null_count": 1, "unique": 2, "sample": "b"}


def test_top_correlations_have_no_self_pairs_and_skip_nulls(frame):
    df = frame("a double, b double, k double", *[(float(i), float(i % 3), 1.0) for i in range(9)])
    rows = P.top_correlations(df).collect()
    assert [(r.col_a, r.col_b) for r in rows] == [("a", "b")]


def test_skewed_columns(frame):
    df = frame("flat double, tail double", *[(float(i), 2.0**i) for i in range(12)])
    assert [r.column for r in P.skewed_columns(P.numeric_stats(df)).collect()] == ["tail"]


def test_columns_with_dots_and_missing_columns(frame):
    df = frame("`a.b` double, c string", (1.0, "x"), (2.0, "y"))
    assert P.numeric_stats(df).first().mean == 1.5
    assert P.overview(df).first().duplicate_rows == 0
    with pytest.raises(ValueError):
        P.numeric_stats(df, ["nope"])


def test_scan_reads_only_the_columns_it_needs(spark, tmp_path):
    spark.range(10).select("id", F.lit("x").alias("wide"), F.lit(1.0).alias("v")).write.parquet(str(tmp_path / "t"))
    plan = P.cardinality(spark.read.parquet(str(tmp_path / "t")), ["v"])._jdf.queryExecution().toString()
    assert "ReadSchema: struct<v:double>" in plan


def test_whole_profile_and_summary(mixed):
    tables = profile_dataframe(mixed)
    assert set(tables) == {
        "shape", "size", "types", "nulls", "cardinality", "numeric_stats", "categorical_stats",
        "top_values", "pearson", "spearman",
    }
    cells = by(dataset_summary(mixed), ["column", "measure"])
    assert cells[(None, "rows")]["number"] == 5.0
    assert cells[("grade", "top_1")]["text"] == "A"
