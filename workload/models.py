"""Modelling queries. Fitted scores have no SQL form; task detection and the metrics do."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.functions.columns import small_frame
from tabulens.operators import charts as G
from tabulens.operators import metrics as M
from tabulens.operators import modelling as L
from tabulens.operators.clusters import fit_many
from tabulens.operators.trees import Boosting, Forest

from .registry import Tables, query, union


def task_sql(column: str, text: bool, override: str | None = None) -> str:
    """The rules written out: an override, then few rows, then text, then few values."""
    distinct = f"count(DISTINCT {column})"
    few = f"{distinct} <= 20 OR {distinct} <= 0.05 * count({column})"
    task = f"CASE WHEN {override is not None} THEN '{override}' WHEN count(*) < 10 THEN 'clustering' WHEN {text} OR {few} THEN 'classification' ELSE 'regression' END"
    return f"""SELECT '{column}' AS target, task, n_rows, n_unique, CASE WHEN is_override OR task = 'classification' THEN n_unique END AS n_classes, is_override
  FROM (SELECT {task} AS task, count(*) AS n_rows, {distinct} AS n_unique, {override is not None} AS is_override FROM lineitem)"""


@query(
    "detect_task",
    union(
        [
            task_sql("l_returnflag", True),
            task_sql("l_quantity", False),
            task_sql("l_extendedprice", False),
            task_sql("l_tax", False, "regression"),
            "SELECT NULL, 'clustering', NULL, NULL, NULL, false",
        ]
    ),
)
def detect_task(t: Tables):
    parts = [
        L.detect_task(t.lineitem, c, override).withColumn("target", F.lit(c).cast("string"))
        for c, override in [
            ("l_returnflag", None),
            ("l_quantity", None),
            ("l_extendedprice", None),
            ("l_tax", "regression"),
            (None, None),
        ]
    ]
    return reduce(DataFrame.unionByName, parts)


def graded_documents(t: Tables) -> DataFrame:
    return t.labels.join(t.documents, "doc_id").select("quality", "n_chars", "lang", "source", "toxic")


def priced_parts(t: Tables) -> DataFrame:
    return t.part.select("p_retailprice", "p_partkey", "p_size", "p_brand", "p_type")


def accounts(t: Tables) -> DataFrame:
    return t.customer.select("c_acctbal", "c_nationkey", "c_mktsegment")


@query(
    "split_rows",
    """WITH c AS (SELECT o_orderstatus, count(*) AS n, CAST(floor(0.2 * (count(*) - 1)) AS BIGINT) + 1 AS held FROM orders GROUP BY 1)
SELECT 'test' AS side, o_orderstatus, held AS n FROM c UNION ALL SELECT 'train', o_orderstatus, n - held FROM c""",
)
def split_rows(t: Tables):
    train, test = L.split_rows(t.orders, stratify="o_orderstatus")
    sides = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return sides.groupBy("side", "o_orderstatus").agg(F.count("*").alias("n"))


@query(
    "split_rows_repeated",
    """WITH c AS (SELECT l_returnflag, count(*) AS n, CAST(floor(0.2 * (count(*) - 1)) AS BIGINT) + 1 AS held FROM lineitem GROUP BY 1)
SELECT 'test' AS side, l_returnflag, held AS n FROM c UNION ALL SELECT 'train', l_returnflag, n - held FROM c""",
)
def split_rows_repeated(t: Tables):
    """Rows that repeat thousands of times."""
    train, test = L.split_rows(t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber"), stratify="l_returnflag")
    sides = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return sides.groupBy("side", "l_returnflag").agg(F.count("*").alias("n"))


@query(
    "fold_rows",
    """SELECT l_returnflag, CAST(f AS INTEGER) AS fold, (n - f + 4) // 5 AS n
FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1), range(5) AS r(f)""",
)
def fold_rows(t: Tables):
    rows = L.fold_rows(t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber"), 5, "l_returnflag")
    return rows.groupBy("l_returnflag", F.col("__fold").alias("fold")).agg(F.count("*").alias("n"))


@query("train_classification")
def train_classification(t: Tables):
    results = L.train_models(graded_documents(t), "quality", L.CLASSIFICATION, folds=0)
    return L.compare_models(results)


@query("train_classification_many")
def train_classification_many(t: Tables):
    flags = t.orders.select("o_orderstatus", "o_totalprice", "o_custkey", "o_orderpriority")
    results = L.train_models(flags, "o_orderstatus", L.CLASSIFICATION, folds=0, rounds=20)
    return L.compare_models(results)


@query("train_regression")
def train_regression(t: Tables):
    results = L.train_models(priced_parts(t), "p_retailprice", L.REGRESSION, folds=0)
    return L.best_model(L.compare_models(results))


@query("cross_validation")
def cross_validation(t: Tables):
    results = L.train_models(priced_parts(t), "p_retailprice", L.REGRESSION, models=["Linear Regression"])
    return L.compare_models(results)


@query("train_clusters")
def train_clusters(t: Tables):
    return L.compare_models(L.train_models(accounts(t), None, L.CLUSTERING, n_clusters=4))


@query("elbow")
def elbow(t: Tables):
    found = L.train_models(accounts(t), None, L.CLUSTERING)[0]
    rows = [(k, cost, k == found.n_clusters) for k, cost in found.elbow.items()]
    return small_frame(t.spark, rows, "k int, inertia double, chosen boolean")


@query("cluster_assignments")
def cluster_assignments(t: Tables):
    return L.cluster_assignments(L.train_models(accounts(t), None, L.CLUSTERING, n_clusters=3)[0])


@query("tree_importance")
def tree_importance(t: Tables):
    forest = L.train_models(priced_parts(t), "p_retailprice", L.REGRESSION, folds=0, models=["Random Forest Regressor"])[0]
    return G.importance_bars(L.feature_importance(forest))


@query("permutation_importance")
def permutation_importance(t: Tables):
    line = L.train_models(priced_parts(t), "p_retailprice", L.REGRESSION, folds=0, models=["Linear Regression"])[0]
    return L.feature_importance(line)


@query(
    "cluster_importance",
    """SELECT unnest(['c_acctbal', 'c_nationkey', 'c_mktsegment']) AS feature, CAST(1 AS DOUBLE) / 3 AS importance, CAST(0 AS DOUBLE) AS std""",
)
def cluster_importance(t: Tables):
    return L.feature_importance(L.train_models(accounts(t), None, L.CLUSTERING, n_clusters=3)[0])


@query("model_confusion")
def model_confusion(t: Tables):
    flags = t.orders.select("o_orderstatus", "o_totalprice", "o_custkey", "o_orderpriority")
    model = L.train_models(flags, "o_orderstatus", L.CLASSIFICATION, folds=0, models=["Logistic Regression"])[0]
    return L.confusion_matrix(model)


# Data with a known best answer: what the fitted models say about them has SQL.

HELD = "CAST(floor(0.2 * (n - 1)) AS BIGINT) + 1"


@query(
    "regression_known_line",
    """SELECT count(*) AS n_rows, count(*) AS n_exact, CAST(1 AS DOUBLE) AS r2, 5 AS folds, CAST(1 AS DOUBLE) AS cv_mean FROM part""",
)
def regression_known_line(t: Tables):
    """A target without noise: every row must be predicted, on the test rows and in each fold."""
    rows = t.part.selectExpr("p_size", "p_partkey % 97 AS part", "CAST(3 * p_size - 2 * (p_partkey % 97) + 7 AS DOUBLE) AS y")
    line = L.train_models(rows, "y", L.REGRESSION, models=["Linear Regression"])[0]
    told = line.model.transform(rows).agg(
        F.count("*").alias("n_rows"), F.count_if(F.abs(F.col("prediction") - F.col("y")) < 1e-6).alias("n_exact")
    )
    r2 = round(L.evaluate_model(line).first().r2, 6)
    return told.select("*", F.lit(r2).alias("r2"), F.lit(len(line.cv_scores)).alias("folds"), F.lit(round(line.cv_mean, 6)).alias("cv_mean"))


SEGMENTS = "CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'left' WHEN c_mktsegment = 'FURNITURE' THEN 'middle' ELSE 'right' END"


@query(
    "classifiers_on_separable_classes",
    f"""WITH c AS (SELECT count(*) AS n FROM customer GROUP BY {SEGMENTS})
SELECT model_name, (SELECT CAST(sum({HELD}) AS BIGINT) FROM c) AS test_rows, CAST(1 AS DOUBLE) AS accuracy, CAST(1 AS DOUBLE) AS f1, 3 AS folds, CAST(1 AS DOUBLE) AS cv_mean
FROM (VALUES ('Logistic Regression'), ('Random Forest'), ('Gradient Boosting')) AS m(model_name)""",
)
def classifiers_on_separable_classes(t: Tables):
    """Three classes that one text column decides: all three models, boosting one against the rest, and stratified folds."""
    rows = t.customer.selectExpr("c_mktsegment", "c_acctbal", f"{SEGMENTS} AS side")
    results = L.train_models(rows, "side", L.CLASSIFICATION, folds=3, trees=20, rounds=3)
    told = []
    for r in results:
        m = M.classification_metrics(r.model.transform(r.test)).first()
        told.append((r.model_name, m.rows, round(m.accuracy, 6), round(m.f1_weighted, 6), len(r.cv_scores), round(r.cv_mean, 6)))
    return small_frame(t.spark, told, "model_name string, test_rows bigint, accuracy double, f1 double, folds int, cv_mean double")


@query(
    "confusion_of_separable_classes",
    f"""WITH c AS (SELECT {SEGMENTS} AS side, count(*) AS n FROM customer GROUP BY 1)
SELECT a.side AS label, b.side AS prediction, CASE WHEN a.side = b.side THEN CAST(floor(0.2 * (a.n - 1)) AS BIGINT) + 1 ELSE 0 END AS n FROM c a CROSS JOIN c b""",
)
def confusion_of_separable_classes(t: Tables):
    rows = t.customer.selectExpr("c_mktsegment", "c_nationkey", f"{SEGMENTS} AS side")
    return L.confusion_matrix(L.train_models(rows, "side", L.CLASSIFICATION, folds=0, models=["Logistic Regression"])[0])


@query(
    "clusters_far_apart",
    "SELECT CAST(c_nationkey // 5 AS BIGINT) AS district, count(*) AS n, CAST(1 AS BIGINT) AS clusters, CAST(5 AS BIGINT) AS all_clusters FROM customer GROUP BY 1",
)
def clusters_far_apart(t: Tables):
    """Groups far from each other must be the clusters."""
    rows = t.customer.selectExpr("c_nationkey DIV 5 AS district", "CAST((c_nationkey DIV 5) * 1000 + c_custkey % 7 AS DOUBLE) AS x", "CAST(pow(c_nationkey DIV 5 - 2, 2) * 900 + c_custkey % 5 AS DOUBLE) AS y")
    found = L.train_models(rows.select("x", "y"), None, L.CLUSTERING, n_clusters=5)[0]
    told = L.cluster_assignments(found, rows)
    per = told.groupBy("district").agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("clusters"))
    return per.crossJoin(F.broadcast(told.agg(F.count_distinct("cluster").alias("all_clusters"))))  # one row


@query(
    "importance_of_the_only_cause",
    "SELECT * FROM (VALUES ('trees', 'p_size'), ('permutation', 'p_size')) AS v(method, feature)",
)
def importance_of_the_only_cause(t: Tables):
    """A target made from one feature must put that feature first."""
    rows = t.part.selectExpr("p_size", "p_partkey % 31 AS other", "p_brand", "CAST(10 * p_size AS DOUBLE) AS y")
    line, forest = L.train_models(rows, "y", L.REGRESSION, folds=0, models=["Linear Regression", "Random Forest Regressor"], trees=20)
    told = []
    for method, model in (("trees", forest), ("permutation", line)):
        first = L.feature_importance(model).orderBy(F.desc("importance")).first()
        told.append((method, first.feature.removeprefix("num__")))
    return small_frame(t.spark, told, "method string, feature string")


# Trees against SQL on the same bins.


def raw_inputs(rows: DataFrame, columns: list[str], label: str, key: str) -> DataFrame:
    vector = array_to_vector(F.array(*(F.col(c).cast("double") for c in columns)))
    return rows.select(vector.alias("features"), F.col(label).cast("double").alias("label"), F.xxhash64(key).alias("key"))


SPLIT_INPUTS = ["l_quantity", "l_discount", "l_linenumber"]


def split_sql(node: str, rows: str) -> str:
    """The best first split of some rows by second-order gain with a smoothing of 1."""
    return f"""{node}_s AS (SELECT sum(g) AS g, count(*) AS h FROM {rows}),
{node}_p AS (SELECT f, v, sum(sum(g)) OVER w AS g, sum(count(*)) OVER w AS h
  FROM (SELECT unnest(['l_quantity', 'l_discount', 'l_linenumber']) AS f, unnest([CAST(l_quantity AS DOUBLE), CAST(l_discount AS DOUBLE), CAST(l_linenumber AS DOUBLE)]) AS v, g FROM {rows})
  GROUP BY f, v WINDOW w AS (PARTITION BY f ORDER BY v)),
{node} AS (SELECT f, v, p.g * p.g / (p.h + 1) + (s.g - p.g) * (s.g - p.g) / (s.h - p.h + 1) - s.g * s.g / (s.h + 1) AS gain, p.h AS n_left, s.h - p.h AS n_right
  FROM {node}_p p, {node}_s s WHERE p.h < s.h ORDER BY gain DESC LIMIT 1)"""


def side_sql(name: str, rows: str, node: str, sign: str) -> str:
    value = f"CASE {node}.f WHEN 'l_quantity' THEN CAST(l_quantity AS DOUBLE) WHEN 'l_discount' THEN CAST(l_discount AS DOUBLE) ELSE CAST(l_linenumber AS DOUBLE) END"
    return f"{name} AS (SELECT {rows}.* FROM {rows}, {node} WHERE {value} {sign} {node}.v)"


@query(
    "boosted_splits",
    f"""WITH r AS (SELECT l_quantity, l_discount, l_linenumber, (SELECT avg(CAST(l_extendedprice AS DOUBLE)) FROM lineitem) - CAST(l_extendedprice AS DOUBLE) AS g FROM lineitem),
{split_sql('root', 'r')}, {side_sql('low', 'r', 'root', '<=')}, {side_sql('high', 'r', 'root', '>')}, {split_sql('l', 'low')}, {split_sql('h', 'high')}
"""
    + union(
        [
            f"SELECT '{label}' AS node, f AS feature, round(v, 6) + 0.0 AS upto, round(gain / 1e9, 3) + 0.0 AS gain, CAST(n_left AS BIGINT) AS n_left, CAST(n_right AS BIGINT) AS n_right FROM {node}"
            for label, node in (("root", "root"), ("left", "l"), ("right", "h"))
        ]
    ),
)
def boosted_splits(t: Tables):
    """The first boosted tree, two levels deep: its splits, their gains and the rows on both sides."""
    rows = t.lineitem.withColumn("row", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    model = Boosting(1, None, depth=2).fit(raw_inputs(rows, SPLIT_INPUTS, "l_extendedprice", "row"), 3, 3)
    tree, told = model.trees[0], []
    for name, at in (("root", 0), ("left", tree.left[0]), ("right", tree.left[0] + 1)):
        f = int(model.bins.feature(tree.code[at : at + 1])[0])
        edge = model.bins.edges[f][tree.code[at] - model.bins.starts[f]]
        sides = [int(tree.sums[tree.left[at] + i][0]) for i in (0, 1)]
        told.append((name, SPLIT_INPUTS[f], round(float(edge), 6), round(float(tree.gain[at]) / 1e9, 3), *sides))
    return small_frame(t.spark, told, "node string, feature string, upto double, gain double, n_left bigint, n_right bigint")


@query(
    "forest_of_full_depth",
    "SELECT CAST((l_quantity * 7 + l_linenumber * 3) % 5 AS INTEGER) AS label, count(*) AS n_rows, count(*) AS n_right FROM lineitem GROUP BY 1",
)
def forest_of_full_depth(t: Tables):
    """Classes that change with every step of two numbers: only nodes split to the end tell them all."""
    rows = t.lineitem.selectExpr(
        "CONCAT_WS('-', l_orderkey, l_linenumber) AS row", "l_quantity", "l_linenumber", "CAST((l_quantity * 7 + l_linenumber * 3) % 5 AS INT) AS k"
    )
    told = raw_inputs(rows, ["l_quantity", "l_linenumber"], "k", "row")
    told = Forest(20, 5, L.SEED).fit(told, 2, 2).transform(told)
    return told.groupBy(F.col("label").cast("int").alias("label")).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("prediction") == F.col("label")).alias("n_right")
    )


@query(
    "category_codes",
    union(
        [
            f"SELECT '{c}' AS \"column\", {c} AS value, CAST(row_number() OVER (ORDER BY {c}) - 1 AS BIGINT) AS code, count(*) AS n FROM customer GROUP BY {c}"
            for c in ("c_name", "c_mktsegment")
        ]
    ),
)
def category_codes(t: Tables):
    """The table of categories that a model's inputs are coded by, one of them with a value of its own in every row."""
    return L.category_codes(t.customer, ["c_name", "c_mktsegment"])


@query(
    "target_codes",
    "SELECT p_type AS value, CAST(row_number() OVER (ORDER BY p_type) - 1 AS DOUBLE) AS label, count(*) AS n FROM part GROUP BY 1",
)
def target_codes(t: Tables):
    return L.target_codes(t.part, "p_type")


@query(
    "permuted_values",
    "SELECT CAST(r AS INTEGER) AS repeat, c_custkey AS bearer, CAST(c_nationkey AS BIGINT) AS nation, CAST(1 AS BIGINT) AS n FROM customer, range(2) AS t(r)",
)
def permuted_values(t: Tables):
    """Permuting the customers' numbers: followed back to their bearers, every one occurs once in each repeat."""
    rows = t.customer.select("c_custkey", "c_nationkey")
    turned = L.permuted_rows(rows, ["c_custkey", "c_nationkey"], 2).where("__feature = 'c_custkey'")
    owners = rows.select(F.col("c_custkey").alias("bearer"), F.col("c_nationkey").cast("bigint").alias("nation"))
    found = turned.select(F.col("__repeat").alias("repeat"), F.col("c_custkey").alias("bearer")).join(owners, "bearer")
    return found.groupBy("repeat", "bearer", "nation").agg(F.count("*").alias("n"))


def spread_sql(k: int, groups: str) -> str:
    squares = "count(*) * var_pop(x) + count(*) * var_pop(y)"
    return f"SELECT {k} AS k, round(sum(s) / 1000, 3) + 0.0 AS cost FROM (SELECT {squares} AS s FROM far GROUP BY {groups})"


@query(
    "shared_kmeans_costs",
    """WITH far AS (SELECT c_nationkey // 5 AS district, CAST((c_nationkey // 5) * 1000 + c_custkey % 7 AS DOUBLE) AS x,
  CAST(pow(c_nationkey // 5 - 2, 2) * 900 + c_custkey % 5 AS DOUBLE) AS y FROM customer) """
    + union([spread_sql(1, "1 = 1"), spread_sql(5, "district")]),
)
def shared_kmeans_costs(t: Tables):
    """Groups far from each other, fitted for one and for five clusters in the same steps: the costs are the spreads."""
    far = t.customer.selectExpr("CAST((c_nationkey DIV 5) * 1000 + c_custkey % 7 AS DOUBLE) AS x", "CAST(pow(c_nationkey DIV 5 - 2, 2) * 900 + c_custkey % 5 AS DOUBLE) AS y")
    found = fit_many(far.select(array_to_vector(F.array("x", "y")).alias("features")), [1, 5], L.SEED)
    return small_frame(t.spark, [(k, round(cost / 1000, 3)) for k, (_, cost) in found.items()], "k int, cost double")
