"""Forests and boosting: the same trees however they are grown, and gains against brute force."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabulens.operators import modelling as L
from tabulens.operators import trees as T


def prepared(df, columns, label):
    vector = array_to_vector(F.array(*(F.col(c).cast("double") for c in columns)))
    return df.select(vector.alias("features"), F.col(label).cast("double").alias("label"), F.xxhash64("id").alias("key"))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    n = 3000
    a, b = rng.normal(size=n), rng.integers(0, 40, n)
    rows = [
        (i, float(a[i]) if i % 9 else float("nan"), float(b[i]), float(i % 3 == 0), float(np.sin(4 * a[i]) * 10 + b[i] % 5), int((b[i] * 7 + (a[i] > 0)) % 3))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, k int").persist()


def shapes(model):
    return [tuple(map(tuple, (t.code, t.missing_left, t.left, t.sums.ravel()))) for t in model.trees]


def test_trees_do_not_depend_on_partitions_or_on_where_nodes_are_finished(table, monkeypatch):
    columns = ["a", "b", "c"]
    made = {
        "forest of classes": lambda rows: T.Forest(3, 3, 1).fit(rows("k"), 3, 3),
        "forest of numbers": lambda rows: T.Forest(3, None, 1).fit(rows("y"), 3, 3),
        "boosting of numbers": lambda rows: T.Boosting(3, None).fit(rows("y"), 3, 3),
        "boosting of classes": lambda rows: T.Boosting(2, 3).fit(rows("k"), 3, 3),
    }
    for name, fit in made.items():
        first = fit(lambda label: prepared(table.repartition(2), columns, label))
        again = fit(lambda label: prepared(table.repartition(7, "b"), columns, label))
        assert shapes(first) == shapes(again), name
        with monkeypatch.context() as m:
            m.setattr(T, "SMALL_ROWS", 400)  # upper levels on the cluster, the rest in tasks
            spread = fit(lambda label: prepared(table.repartition(3), columns, label))
        told = [x.transform(prepared(table, columns, "y")).select("key", F.round("prediction", 9).alias("p")) for x in (first, spread)]
        assert told[0].exceptAll(told[1]).count() == 0, name
        assert sorted(tuple(t.sums[0]) for t in first.trees) == sorted(tuple(t.sums[0]) for t in spread.trees)


def test_a_model_too_large_to_send_predicts_the_same(table, monkeypatch):
    rows = prepared(table, ["a", "b", "c"], "k")
    small = T.Forest(4, 3, 2).fit(rows, 3, 3)
    monkeypatch.setattr(T, "MODEL_BYTES", 0)
    monkeypatch.setattr(T, "SMALL_ROWS", 500)
    large = T.Forest(4, 3, 2).fit(rows, 3, 3)
    assert large.trees is None and not hasattr(large, "featureImportances")
    a, b = (m.transform(rows).select("key", "prediction", "probability") for m in (small, large))
    assert b.columns == ["key", "prediction", "probability"] and a.exceptAll(b).count() == 0 and b.count() == 3000


def test_first_split_has_the_best_gain_of_all(table):
    model = T.Boosting(1, None, depth=1).fit(prepared(table, ["a", "b", "c"], "y"), 3, 3)
    pdf = table.toPandas()
    g = (pdf.y.mean() - pdf.y).to_numpy()
    best = (0, None)
    for f, c in enumerate(["a", "b", "c"]):
        x = pdf[c].to_numpy()
        for edge in model.bins.edges[f]:
            for missing_left in (False, True):
                left = (x <= edge) | (np.isnan(x) & missing_left)
                gain = sum(g[s].sum() ** 2 / (s.sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (len(g) + 1)
                best = max(best, (gain, f), key=lambda p: p[0])
        left = ~np.isnan(x)
        if not left.all():
            gain = sum(g[s].sum() ** 2 / (s.sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (len(g) + 1)
            best = max(best, (gain, f), key=lambda p: p[0])
    tree = model.trees[0]
    assert tree.gain[0] == pytest.approx(best[0], rel=1e-6) and model.bins.feature(tree.code[:1])[0] == best[1]
    assert len(tree.code) == 3


def test_missing_numbers_go_where_they_help(spark):
    df = spark.range(400).selectExpr("id", "IF(id % 2 = 0, double('NaN'), id) AS x", "IF(id % 2 = 0, 100.0, IF(id < 200, 100.0, 0.0)) AS y")
    model = T.Boosting(30, None, depth=1).fit(prepared(df, ["x"], "y"), 1, 1)
    rows = model.transform(prepared(df, ["x"], "y"))
    assert model.trees[0].missing_left[0]
    assert rows.where("abs(prediction - label) > 1").count() == 0


def test_a_target_of_depth_twelve_is_learnt(spark):
    df = spark.range(8192).selectExpr("id", "CAST(id % 4096 AS DOUBLE) AS x", "CAST(bit_count(id % 4096) % 2 AS INT) AS k")
    few = df.selectExpr("id", *(f"CAST(CAST(x AS INT) >> {i} & 1 AS DOUBLE) AS b{i}" for i in range(12)), "k")
    columns = [f"b{i}" for i in range(12)]
    model = T.Forest(25, 2, 3).fit(prepared(few, columns, "k"), 12, 12)
    depth = 0
    tree, nodes = model.trees[0], {0: 0}
    for i in range(len(tree.code)):
        if tree.code[i] >= 0:
            nodes[tree.left[i]] = nodes[tree.left[i] + 1] = nodes[i] + 1
            depth = max(depth, nodes[i] + 1)
    assert depth >= 10
    right = model.transform(prepared(few, columns, "k")).where("prediction = label").count()
    assert right > 0.97 * 8192


def test_jobs_of_a_round_do_not_grow_with_classes(spark, monkeypatch):
    monkeypatch.setattr(T, "SMALL_ROWS", 300)
    jobs = []
    for k in (3, 9):
        df = spark.range(1500).selectExpr("id", "CAST(id % 90 AS DOUBLE) AS x", f"CAST(id % {k} AS INT) AS k")
        spark.sparkContext.setJobGroup(f"boost-{k}", "")
        T.Boosting(2, k, depth=3).fit(prepared(df, ["x"], "k"), 1, 1)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"boost-{k}")))
    spark.sparkContext.setJobGroup("", "")
    assert abs(jobs[0] - jobs[1]) <= 4


def test_poisson_draws_have_the_right_shares():
    draws = T.poisson_one(np.arange(200_000), 5)
    assert abs(draws.mean() - 1) < 0.01 and abs((draws == 0).mean() - np.exp(-1)) < 0.005
    assert (draws == T.poisson_one(np.arange(200_000), 5)).all() and (draws != T.poisson_one(np.arange(200_000), 6)).any()


def test_three_hundred_thousand_categories_train(spark):
    df = spark.range(330_000).selectExpr("CONCAT('name ', id % 300000) AS name", "CAST(id % 7 AS DOUBLE) AS x", "IF(id % 7 < 3, 'low', 'high') AS y")
    result = L.train_models(df, "y", L.CLASSIFICATION, folds=0, rounds=2, models=["Gradient Boosting"])[0]
    assert result.model.stages[0].size > 200_000 and result.model.stages[0].table is not None
    assert L.evaluate_model(result).first().accuracy == 1.0
    wide = L.InputPreparation(["name"]).fit(df)
    wide.wide = {"name"}  # as if its bytes were too many to broadcast
    assert wide.transform(df.limit(1000)).where("features IS NOT NULL").count() == 1000


def test_many_classes_are_coded_by_a_table(spark):
    df = spark.range(3000).selectExpr("CONCAT('c', id % 500) AS y", "id AS x")
    coded, codes = L.encode_target(df, "y")
    assert codes.count() == 500 and coded.count() == 3000
    rows = {r.value: r.label for r in codes.collect()}
    assert rows == {v: float(i) for i, v in enumerate(sorted(rows))}


def test_a_failing_model_keeps_the_scores_of_the_others(spark, monkeypatch):
    def fail(*_):
        raise ValueError("no")

    df = spark.range(60).selectExpr("id % 2 AS k", "id % 2 * 10.0 + rand(1) AS x", "CAST(id % 2 AS INT) AS y")
    monkeypatch.setattr(T.Boosting, "fit", fail)
    train = L.split_rows(df.withColumn("label", F.col("y").cast("double")), stratify="label", numbered=True)[0]
    estimators = {k: v for k, v in L.classifiers(48, 2, 3, 2).items() if k != "Random Forest"}
    with pytest.warns(UserWarning, match="Gradient Boosting"):
        scores = L.cross_validate(train, ["x"], L.CLASSIFICATION, estimators, 2)
    assert scores == {"Logistic Regression": [1.0, 1.0], "Gradient Boosting": []}


def test_rows_of_the_same_bins_are_grown_as_one(spark):
    df = spark.range(6000).selectExpr("id", "CAST(id % 5 AS DOUBLE) AS x", "CAST(id DIV 5 % 4 AS DOUBLE) AS z", "CAST(id % 3 AS INT) AS k")
    rows = T.coded(prepared(df.repartition(3), ["x", "z"], "k"), T.Bins([np.arange(4.0), np.arange(3.0)], 2))
    draw = lambda keys, t: T.poisson_one(keys, t)
    made = T.bagged(rows, draw, 7)
    assert made.count() == 60
    table, keys = made.toArrow().combine_chunks(), rows.select("key").toArrow()["key"].to_numpy()
    for t, times in T.bags(table, draw, 7):
        assert times.sum() == draw(keys, t).sum()


def test_a_model_that_stays_a_table_has_the_same_importances(table, monkeypatch):
    rows = prepared(table, ["a", "b", "c"], "y")
    small = T.Forest(3, None, 2).fit(rows, 3, 3)
    monkeypatch.setattr(T, "MODEL_BYTES", 0)
    monkeypatch.setattr(T, "SMALL_ROWS", 500)
    large = T.Forest(3, None, 2).fit(rows, 3, 3)
    assert large.trees is None and large.importances() == pytest.approx(small.importances(), rel=1e-9)
    assert small.importances() == pytest.approx(small.featureImportances.toArray(), rel=1e-12)


@pytest.mark.parametrize("classes", [None, 3])
def test_boosting_with_few_sums_sends_no_rows(table, monkeypatch, classes):
    """Levels whose sums are few are all grown by aggregates; the trees are those of rows sent to their nodes."""
    rows = prepared(table, ["a", "b", "c"], "y" if classes is None else "k")
    monkeypatch.setattr(T, "SMALL_ROWS", 300)
    finished, sent = T.finished, []
    monkeypatch.setattr(T, "finished", lambda *x: sent.append(1) or finished(*x))
    few = T.Boosting(2, classes, depth=4).fit(rows, 3, 3)
    assert not sent
    monkeypatch.setattr(T, "DENSE_BYTES", 0)
    many = T.Boosting(2, classes, depth=4).fit(rows, 3, 3)
    assert len(sent) == 2
    told = [x.transform(rows).select("key", F.round("prediction", 9).alias("p")) for x in (few, many)]
    assert told[0].exceptAll(told[1]).count() == 0
    assert [sorted(map(tuple, t.sums)) for t in few.trees] == [sorted(map(tuple, t.sums)) for t in many.trees]


def test_plans_of_boosting_rounds_do_not_grow(table, monkeypatch):
    """The driver keeps the plan of every level; a round's must not hold those of all rounds before."""
    rows = prepared(table, ["a", "b", "c"], "k")
    whole = T.Boosting(12, 3, depth=3).fit(rows, 3, 3)
    monkeypatch.setattr(T, "SMALL_ROWS", 300)
    upper_levels, plans = T.upper_levels, []

    def watched(df, *more):
        plans.append(len(df._jdf.queryExecution().toString()))
        return upper_levels(df, *more)

    monkeypatch.setattr(T, "upper_levels", watched)
    by_rounds = T.Boosting(12, 3, depth=3).fit(rows, 3, 3)
    assert len(plans) == 12 and max(plans) < 2 * max(plans[:2])
    told = [x.transform(rows).select("key", F.round("prediction", 9).alias("p")) for x in (whole, by_rounds)]
    assert told[0].exceptAll(told[1]).count() == 0
    assert [sorted(map(tuple, t.sums)) for t in whole.trees] == [sorted(map(tuple, t.sums)) for t in by_rounds.trees]
