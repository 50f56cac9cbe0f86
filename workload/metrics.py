"""Metric queries on rule-made predictions, so that SQL can compute the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulens.operators import metrics as M

from .registry import JUDGED, Tables, query, r, rounded, union

LEVELS = """levels AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS label,
  CAST(1 + floor(o_totalprice / 7000) % 5 AS INTEGER) AS prediction FROM orders)"""


def levels(t: Tables):
    return t.orders.selectExpr(
        "CAST(substr(o_orderpriority, 1, 1) AS INT) AS label",
        "CAST(1 + floor(o_totalprice / 7000) % 5 AS INT) AS prediction",
    )


def matrix_sql(table: str, before: str) -> str:
    return f"""WITH {before}, c AS (SELECT label AS c FROM {table} UNION SELECT prediction FROM {table})
SELECT a.c AS label, b.c AS prediction, (SELECT count(*) FROM {table} t WHERE t.label = a.c AND t.prediction = b.c) AS n
FROM c a, c b"""


@query("confusion_matrix", matrix_sql("judged", JUDGED))
def confusion_matrix(t: Tables):
    return M.confusion_matrix(t.judged)


@query("confusion_matrix_many", matrix_sql("levels", LEVELS))
def confusion_matrix_many(t: Tables):
    return M.confusion_matrix(levels(t))


def metrics_sql(table: str, before: str, average: str) -> str:
    return f"""WITH {before}, c AS (SELECT label AS c FROM {table} UNION SELECT prediction FROM {table}),
s AS (SELECT c, (SELECT count(*) FROM {table} WHERE label = c AND prediction = c) AS tp,
  (SELECT count(*) FROM {table} WHERE label = c) AS truth, (SELECT count(*) FROM {table} WHERE prediction = c) AS guess FROM c),
f AS (SELECT *, CASE WHEN guess > 0 THEN tp / guess ELSE 0 END AS p, CASE WHEN truth > 0 THEN tp / truth ELSE 0 END AS q,
  CASE WHEN guess + truth > 0 THEN 2 * tp / (guess + truth) ELSE 0 END AS f1 FROM s)
SELECT (SELECT count(DISTINCT label) FROM {table}) AS n_classes, (SELECT count(*) FROM {table}) AS rows,
  {r('sum(tp) / sum(truth)')} AS accuracy, {r(average.format(x='p'))} AS precision, {r(average.format(x='q'))} AS recall,
  {r('sum(f1 * truth) / sum(truth)')} AS f1_weighted, {r('avg(f1)')} AS f1_macro FROM f"""


@query("classification_metrics", metrics_sql("judged", JUDGED, "max({x}) FILTER (c = 1)"))
def classification_metrics(t: Tables):
    return rounded(M.classification_metrics(t.judged))


@query("classification_metrics_many", metrics_sql("levels", LEVELS, "sum({x} * truth) / sum(truth)"))
def classification_metrics_many(t: Tables):
    return rounded(M.classification_metrics(levels(t)))


def auc_sql(table: str, positive: str, score: str) -> str:
    return f"""SELECT (sum(rk) FILTER (hit) - count(*) FILTER (hit) * (count(*) FILTER (hit) + 1) / 2.0)
  / (count(*) FILTER (hit) * count(*) FILTER (NOT hit)) AS auc, count(*) FILTER (hit) AS size
FROM (SELECT {positive} AS hit, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0 AS rk FROM {table})"""


@query("roc_auc", f"WITH {JUDGED} SELECT {r('auc')} AS roc_auc FROM ({auc_sql('judged', 'label = 1', 'score')})")
def roc_auc(t: Tables):
    return rounded(M.roc_auc(t.judged))


@query("roc_auc_orders", f"""SELECT {r('auc')} AS roc_auc FROM ({auc_sql('orders', "o_orderstatus = 'F'", 'o_totalprice')})""")
def roc_auc_orders(t: Tables):
    return rounded(M.roc_auc(t.orders, "o_orderstatus", "o_totalprice", "F"))


SCORES = {"F": "o_totalprice", "O": "o_custkey", "P": "o_orderkey % 1000"}


@query(
    "multiclass_roc_auc",
    f"SELECT {r('sum(auc * size) / sum(size)')} AS roc_auc FROM ("
    + union([f"""({auc_sql('orders', f"o_orderstatus = '{k}'", s)})""" for k, s in SCORES.items()])
    + ")",
)
def multiclass_roc_auc(t: Tables):
    scored = t.orders.selectExpr(
        "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label",
        f"array({', '.join(f'CAST({s} AS DOUBLE)' for s in SCORES.values())}) AS scores",
    )
    return rounded(M.multiclass_roc_auc(scored, "label", "scores", [0, 1, 2]))


def roc_sql(table: str, positive: str, score: str) -> str:
    return f"""SELECT s AS threshold, {r('(sum(n - p) OVER w) / (sum(n - p) OVER ())')} AS fpr, {r('(sum(p) OVER w) / (sum(p) OVER ())')} AS tpr
FROM (SELECT {score} AS s, count(*) AS n, count(*) FILTER ({positive}) AS p FROM {table} GROUP BY 1)
WINDOW w AS (ORDER BY s DESC) UNION ALL SELECT NULL, 0, 0"""


@query("roc_points", f"WITH {JUDGED} {roc_sql('judged', 'label = 1', 'score')}")
def roc_points(t: Tables):
    return rounded(M.roc_points(t.judged))


@query("roc_points_orders", roc_sql("orders", "o_orderstatus = 'F'", "o_totalprice"))
def roc_points_orders(t: Tables):
    return rounded(M.roc_points(t.orders, "o_orderstatus", "o_totalprice", "F"))


@query(
    "regression_metrics",
    f"""WITH e AS (SELECT l_extendedprice AS y, l_extendedprice - l_quantity * 2100 AS e FROM lineitem),
m AS (SELECT count(*) AS n, avg(abs(e)) AS mae, avg(e * e) AS mse, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2 FROM e)
SELECT n AS rows, {r('mae', 3)} AS mae, {r('mse', 0)} AS mse, {r('sqrt(mse)', 3)} AS rmse, {r('r2')} AS r2,
  {r('1 - (1 - r2) * (n - 1) / (n - 4 - 1)')} AS adj_r2 FROM m""",
)
def regression_metrics(t: Tables):
    made = t.lineitem.selectExpr("l_extendedprice AS label", "l_quantity * 2100 AS prediction")
    return rounded(M.regression_metrics(made, n_features=4), mae=3, mse=0, rmse=3)


CENTERS = """v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
c AS (SELECT label, d, avg(x) AS m FROM v GROUP BY 1, 2),
dist AS (SELECT v.vec_id, v.label, sum((x - m) * (x - m)) AS d2 FROM v JOIN c ON v.label = c.label AND v.d = c.d GROUP BY 1, 2)"""


@query("inertia", f"WITH {CENTERS} SELECT {r('sum(d2)')} AS inertia FROM dist")
def inertia(t: Tables):
    return rounded(M.inertia(t.embeddings, "embedding", "label"))


@query(
    "davies_bouldin",
    f"""WITH {CENTERS}, s AS (SELECT label, avg(sqrt(d2)) AS s FROM dist GROUP BY 1),
apart AS (SELECT a.label AS la, b.label AS lb, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS g
  FROM c a JOIN c b ON a.d = b.d AND a.label <> b.label GROUP BY 1, 2)
SELECT {r('avg(w)')} AS davies_bouldin FROM (SELECT la, max((x.s + y.s) / g) AS w
  FROM apart JOIN s x ON la = x.label JOIN s y ON lb = y.label GROUP BY 1)""",
)
def davies_bouldin(t: Tables):
    return rounded(M.davies_bouldin(t.embeddings, "embedding", "label"))


@query(
    "silhouette_sq",
    f"""WITH p AS (SELECT a.vec_id, a.label AS la, b.label AS lb, list_sum(list_transform(list_zip(a.embedding, b.embedding),
  lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)) AS d FROM embeddings a, embeddings b),
m AS (SELECT vec_id, la, lb, CASE WHEN la = lb THEN sum(d) / (count(*) - 1) ELSE avg(d) END AS d FROM p GROUP BY 1, 2, 3),
s AS (SELECT vec_id, max(d) FILTER (la = lb) AS a, min(d) FILTER (la <> lb) AS b FROM m GROUP BY 1)
SELECT {r('avg((b - a) / greatest(a, b))', 5)} AS silhouette_sq FROM s""",
)
def silhouette_sq(t: Tables):
    rows = t.embeddings.select(F.array_compact(F.transform("embedding", lambda x: x.cast("double"))).alias("v"), "label")
    return rounded(M.silhouette_frame(rows, "v", "label"), 5)
