import numpy as np
import pandas as pd
import pytest
from conftest import by
from pyspark.sql import functions as F

from tabulens.functions.columns import AnalysisError
from tabulens.operators import explore as E
from tabulens.plans.report import insight_tables, run_eda


@pytest.fixture
def mixed(frame):
    return frame(
        "age double, income double, city string, gender string",
        (25.0, 50.0, "NY", "M"), (35.0, 60.0, "LA", "F"), (45.0, 80.0, "NY", "F"),
        (30.0, 55.0, "SF", "M"), (40.0, 70.0, "NY", "M"), (28.0, 52.0, "LA", "F"),
    )


@pytest.mark.parametrize("bins", [3, 10])
def test_histogram_equals_numpy(spark, bins):
    rng = np.random.default_rng(5)
    data = {"n": rng.normal(size=400), "grid": rng.integers(0, 11, 400) / 10, "big": rng.integers(0, 10**9, 400) * 1.0}
    got = E.histogram(spark.createDataFrame(pd.DataFrame(data)), bins=bins).collect()
    for name, values in data.items():
        counts, edges = np.histogram(values, bins=bins)
        mine = sorted((r for r in got if r.column == name), key=lambda r: r.bin)
        assert [r["count"] for r in mine] == list(counts)
        assert [r.lo for r in mine] + [mine[-1].hi] == pytest.approx(list(edges))


def test_histogram_of_constant_null_and_infinite_columns(frame):
    rows = E.histogram(frame("k double, e double", (5.0, None), (5.0, None)), bins=2).collect()
    assert [(r.column, r.lo, r.hi, r["count"]) for r in sorted(rows, key=lambda r: r.bin)] == [
        ("k", 4.5, 5.0, 0), ("k", 5.0, 5.5, 2),
    ]
    with pytest.raises(AnalysisError):
        E.histogram(frame("x double", (float("inf"),), (1.0,)))


def test_group_summary(mixed):
    rows = by(E.group_summary(mixed), ["cat_col", "category", "num_col"])
    ny = rows[("city", "NY", "age")]
    assert ny["mean"] == pytest.approx(110 / 3) and ny["sum"] == 110 and ny["count"] == 3 and ny["median"] == 40
    assert len(rows) == (3 + 2) * 2


def test_group_summary_skips_wide_keys_and_nulls(frame):
    df = frame("x double, k string, wide string", *[(float(i), "a" if i else None, str(i)) for i in range(60)], (None, "b", "b"))
    rows = E.group_summary(df).collect()
    assert [(r.cat_col, r.category, r["count"]) for r in rows] == [("k", "a", 59)]


def test_scatter_pairs_take_the_first_rows_without_nulls(frame):
    df = frame("id int, a double, b double", *[(i, float(i), None if i % 2 else float(-i)) for i in range(10)])
    rows = E.scatter_pairs(df, "id", ["a", "b"], sample_size=3).collect()
    assert sorted((r.pair, r.x, r.y) for r in rows) == [("a_vs_b", 0.0, 0.0), ("a_vs_b", 2.0, -2.0), ("a_vs_b", 4.0, -4.0)]
    assert E.scatter_pairs(df, "id", ["a"]).count() == 0


def test_categorical_shares(mixed):
    rows = by(E.top_value_shares(mixed, ["city"]), "value")
    assert rows["NY"]["pct"] == pytest.approx(50.0) and rows["NY"]["rank"] == 1


@pytest.mark.parametrize("distinct,task", [(19, "classification"), (20, "regression")])
def test_target_task_changes_at_twenty_values(frame, distinct, task):
    df = frame("y int", *[(i % distinct,) for i in range(60)])
    assert E.infer_target_task(df, "y").first().task == task


def test_class_balance_and_distribution(frame):
    df = frame("c string", *[("a",)] * 3, *[("b",)], *[("d",)], (None,))
    row = E.class_balance(df, "c").first()
    assert (row.n_classes, row.most_common_class, row.least_common_class, row.imbalance_ratio, row.null_count) == (3, "a", "d", 3.0, 1)
    assert by(E.class_distribution(df, "c"), "class")["a"]["pct"] == pytest.approx(60.0)
    alone = E.class_balance(frame("c string", ("a",)), "c").first()
    assert alone.n_classes == 1 and alone.imbalance_ratio is None


def test_target_mean_by_bin_equals_pandas_cut(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"f": rng.integers(0, 21, 200) / 2, "y": rng.normal(size=200)})
    pdf.loc[::17, "y"] = np.nan
    rows = E.target_mean_by_bin(spark.createDataFrame(pdf), "y", bins=10).orderBy("bin").collect()
    known = pdf.dropna()
    want = known.groupby(pd.cut(known["f"], bins=10), observed=True)["y"].mean()
    assert [r.mean_target for r in rows] == pytest.approx(list(want))


def test_target_mean_by_bin_of_a_constant_feature(frame):
    rows = E.target_mean_by_bin(frame("f double, y double", (2.0, 1.0), (2.0, 3.0)), "y", bins=4).collect()
    assert [(r["count"], r.mean_target) for r in rows] == [(2, 2.0)]


def test_text_target_is_no_regression_target(mixed):
    with pytest.raises(AnalysisError):
        E.target_distribution(mixed, "city")
    with pytest.raises(AnalysisError):
        E.target_mean_by_bin(mixed, "city")


def test_whole_exploration(mixed):
    df = mixed.withColumn("id", F.monotonically_increasing_id())
    tables = run_eda(df, "id", target="gender")
    assert {"numeric", "histogram", "scatter", "groups", "class_distribution", "class_balance"} <= set(tables)
    assert "target_stats" in run_eda(df, "id", target="age", task="regression")
    assert "target" not in run_eda(df, "id")
    assert set(insight_tables(df)) == {"summary", "top_correlations", "skewed", "outliers"}
