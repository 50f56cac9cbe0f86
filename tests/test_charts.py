import math

import numpy as np
import pandas as pd
import pytest
from conftest import by

from tabulens.operators import charts as G


@pytest.fixture
def table(spark):
    rng = np.random.default_rng(9)
    return spark.createDataFrame(
        pd.DataFrame({"id": range(40), "value": rng.normal(size=40), "score": rng.uniform(size=40), "category": list("ab") * 20})
    )


def test_histogram_density_sums_to_one(table):
    rows = G.histogram_bars(table, "value").collect()
    assert len(rows) == 30 and sum(r.density * (r.hi - r.lo) for r in rows) == pytest.approx(1.0)


def test_kernel_density_by_hand(table):
    values = np.array([r.value for r in table.collect()])
    width = values.std(ddof=1) * len(values) ** -0.2
    rows = G.kernel_density(table, "value", points=50).orderBy("point").collect()
    grid = np.linspace(values.min(), values.max(), 50)
    want = np.exp(-(((grid[:, None] - values) / width) ** 2) / 2).sum(axis=1) / (40 * width * math.sqrt(2 * math.pi))
    assert [r.x for r in rows] == pytest.approx(list(grid)) and [r.density for r in rows] == pytest.approx(list(want))
    assert {r.category for r in G.kernel_density(table, "value", "category", 5).collect()} == {"a", "b"}


def test_bars_and_pie(frame):
    df = frame("id int, c string, v double", (1, "x", 1.0), (2, "y", 2.0), (3, "x", 3.0), (4, None, 4.0))
    assert [tuple(r) for r in G.frequency_bars(df, "c").collect()] == [("x", 2), ("y", 1)]
    assert by(G.pie_shares(df, "c"), "value")["y"]["pct"] == pytest.approx(100 / 3)
    assert [tuple(r) for r in G.value_bars(df, "c", "v", "id", top_n=2).collect()] == [("x", 1.0, None), ("y", 2.0, None)]


def test_trend_line(frame):
    row = G.trend_line(frame("x double, y double", *[(float(i), 2.0 * i + 1) for i in range(5)], (None, 9.0)), "x", "y").first()
    assert (row.n, row.slope, row.intercept, row.r2) == (5, pytest.approx(2.0), pytest.approx(1.0), pytest.approx(1.0))
    flat = G.trend_line(frame("x double, y double", (1.0, 1.0), (1.0, 2.0)), "x", "y").first()
    assert flat.slope is None


def test_box_plot(frame):
    df = frame("g string, v double", *[("a", float(v)) for v in (1, 2, 3, 4, 100)], ("b", 7.0), (None, 1.0), ("a", None))
    rows = by(G.box_plot(df, "v", "g"), "category")
    a = rows["a"]
    assert (a["n"], a["q1"], a["median"], a["q3"], a["lower_whisker"], a["upper_whisker"], a["outliers"]) == (5, 2, 3, 4, 1, 4, 1)
    assert rows["b"]["n"] == 1 and set(rows) == {"a", "b"}
    assert [tuple(r) for r in G.box_outliers(df, "v", "g").collect()] == [("a", 100.0)]
    assert G.box_plot(df, "v").first().n == 7


def test_cluster_scatter(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=60)
    pdf = pd.DataFrame({"x": x * 5 + 3, "y": x + rng.normal(0, 0.2, 60), "z": rng.normal(0, 0.1, 60), "cluster": x > 0})
    df = spark.createDataFrame(pdf)
    rows = G.cluster_scatter(df, "cluster").collect()
    data = pdf[["x", "y", "z"]].to_numpy() - pdf[["x", "y", "z"]].to_numpy().mean(axis=0)
    axes = np.linalg.svd(data, full_matrices=False)[2][:2]
    axes = [a * np.sign(a[np.abs(a).argmax()]) for a in axes]
    assert [r.x for r in rows] == pytest.approx(list(data @ axes[0])) and [r.y for r in rows] == pytest.approx(list(data @ axes[1]))
    assert [r.x for r in G.cluster_scatter(df, "cluster", "x", "z").collect()] == pytest.approx(list(pdf["x"]))
    one = G.cluster_scatter(df.select("x", "cluster"), "cluster").collect()
    assert all(r.x == r.y for r in one)


def test_time_series_parses_text(frame):
    df = frame("ts string, val double, more int", ("2023-01-02", 2.0, 5), ("2023-01-01", 1.0, 4), ("bad", 9.0, 9))
    rows = G.time_series(df, "ts", ["val", "more", "missing"]).collect()
    assert [(r.time.day, r.series, r.value) for r in rows] == [(1, "more", 4.0), (1, "val", 1.0), (2, "more", 5.0), (2, "val", 2.0)]


def test_confusion_cells_and_importance_bars(frame):
    cells = by(G.confusion_cells(frame("l int, p int", (0, 1), (1, 1)), "l", "p", ["no", "yes"]), ["actual", "predicted"])
    assert cells[("no", "yes")]["n"] == 1 and cells[("no", "no")]["n"] == 0
    top = G.importance_bars(frame("feature string, importance double, std double", ("a", 0.1, 0.0), ("b", 0.9, 0.0)), 1)
    assert [r.feature for r in top.collect()] == ["b"]


def test_missing_columns_and_empty_tables_give_empty_results(table):
    empty = table.limit(0)
    for df, column in ((table, "nope"), (empty, "value")):
        assert G.histogram_bars(df, column).count() == 0
        assert G.kernel_density(df, column).count() == 0
        assert G.frequency_bars(df, column).count() == 0
        assert G.pie_shares(df, column).count() == 0
        assert G.box_plot(df, column).count() == 0
        assert G.scatter_points(df, column, "score").count() == 0
        assert G.time_series(df, "id", [column]).count() == 0
    assert G.cluster_scatter(table, "nope").count() == 0
    assert G.trend_line(table, "nope", "value").count() == 0
    assert G.correlation_heatmap(table.select("value")).count() == 0
    assert G.pair_plot(table, "id", ["value"]).count() == 0
    assert G.confusion_cells(table, "nope", "value").count() == 0
