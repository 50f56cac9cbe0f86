"""Exact quantiles, running totals and lookups against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulens.functions import ordered
from tabulens.functions.quantiles import exact_group_quantiles, exact_quantiles, many_group_quantiles

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


def columns_of(spark, **arrays):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame(arrays)).repartition(3)


WIDE = {}
TIGHT = {"sketch_k": 200, "whole_rows": 10, "residual_rows": 30}
ROUGH = {"sketch_k": 128, "whole_rows": 0, "residual_rows": 1}


@pytest.mark.parametrize("effort", [WIDE, TIGHT, ROUGH])
def test_quantiles_equal_numpy_however_tight_the_brackets(spark, effort):
    rng = np.random.default_rng(7)
    data = {
        "continuous": rng.normal(size=3000),
        "few": rng.integers(0, 4, 3000).astype(float),
        "third": np.where(np.arange(3000) % 3 == 0, 5.0, rng.uniform(0, 10, 3000)),
        "two_heavy": np.where(np.arange(3000) < 1500, 1.0, 2.0),
        "constant": np.full(3000, 0.1),
        "tails": np.concatenate([np.full(1490, -1e9), rng.uniform(size=20), np.full(1490, 1e9)]),
    }
    found = exact_quantiles(columns_of(spark, **data), list(data), PROBS, **effort)
    for name, values in data.items():
        for p in PROBS:
            assert found.values[(name, p)] == pytest.approx(np.quantile(values, p), rel=1e-12), (name, p)


def test_nulls_are_left_out_and_empty_columns_give_none(frame):
    df = frame("a double, b double", (1.0, None), (None, None), (4.0, None))
    found = exact_quantiles(df, ["a", "b"], [0.5], [F.sum("a").alias("s")])
    assert found.values == {("a", 0.5): 2.5, ("b", 0.5): None}
    assert found.counts == {"a": 2, "b": 0}
    assert found.extra["s"] == 5.0


@pytest.mark.parametrize("effort", [WIDE, TIGHT, ROUGH])
def test_group_quantiles_with_a_hot_group(spark, effort):
    rng = np.random.default_rng(3)
    keys = np.where(np.arange(2400) % 2 == 0, "hot", np.char.add("k", (np.arange(2400) % 7).astype(str)))
    values = np.where(np.arange(2400) % 5 == 0, 3.0, rng.exponential(size=2400))
    df = columns_of(spark, k=keys, v=values)
    rows = exact_group_quantiles(df, "k", ["v"], (0.25, 0.5), **effort)
    many = {r.k: r for r in many_group_quantiles(df, "k", "v", (0.25, 0.5)).collect()}
    assert len(rows) == len(many) == 8
    for row in rows:
        mine = values[keys == row.key]
        assert row.counts["v"] == len(mine) == many[row.key].n
        for i, p in enumerate((0.25, 0.5)):
            assert row.values[("v", p)] == pytest.approx(np.quantile(mine, p))
            assert many[row.key][f"q{i}"] == pytest.approx(np.quantile(mine, p))


def test_too_many_groups_are_left_to_the_ordered_way(frame):
    df = frame("k string, v double", *[(str(i), float(i)) for i in range(10)])
    assert exact_group_quantiles(df, "k", ["v"], [0.5], max_groups=5) is None


def test_ordered_totals_over_many_slices(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("x"), (F.col("id") % 5 + 1).alias("w"))
    rows = sorted(ordered.ordered_totals(df, ["x"], ["w"]).collect(), key=lambda r: r.x)
    total = 0
    for row in rows:
        assert row.before_w == total
        total += row.w
    assert {r.total_w for r in rows} == {total}


def test_ordered_totals_restart_within_groups(spark):
    df = spark.range(300).select((F.col("id") % 3 == 0).cast("string").alias("g"), "id", F.lit(1).alias("one"))
    rows = ordered.ordered_totals(df, ["g", "id"], ["one"], within=["g"]).collect()
    for g, size in (("true", 100), ("false", 200)):
        mine = sorted((r for r in rows if r.g == g), key=lambda r: r.id)
        assert [r.before_one for r in mine] == list(range(size))
        assert {r.total_one for r in mine} == {size}


@pytest.mark.parametrize("how,expected", [("inner", 90), ("left", 100)])
@pytest.mark.parametrize("small", [True, False])
def test_lookup_join_keeps_every_row_with_hot_keys(spark, monkeypatch, how, expected, small):
    if not small:
        monkeypatch.setattr(ordered, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(ordered, "HOT_SHARE", 5)
    rows = spark.range(100).select(F.when(F.col("id") < 50, 0).otherwise(F.col("id")).alias("k"), "id")
    table = spark.range(90).select(F.col("id").alias("k"), (F.col("id") * 10).alias("payload"))
    table = table.join(rows.groupBy("k").agg(F.count("*").alias("n")), "k")
    joined = ordered.lookup_join(rows, table, "k", "n", how).collect()
    assert len(joined) == expected
    assert all(r.payload == r.k * 10 for r in joined if r.k < 90)
    assert all(r.payload is None for r in joined if r.k >= 90)


def test_checkpoint_folder_comes_from_the_session(spark):
    ordered.stable(spark.range(3))
    assert spark.conf.get("spark.checkpoint.dir") in spark.sparkContext.getCheckpointDir()
