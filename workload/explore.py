"""Exploration queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tabulens.operators import explore as E

from .profile import stats_sql, top_sql
from .registry import GAPS, MEASURES, Tables, query, r, rounded, union


@query(
    "numeric_univariate",
    stats_sql("gaps", ["user_id", "value"], f"WITH {GAPS} ", ", count(*) - count({c}) AS null_count"),
)
def numeric_univariate(t: Tables):
    return rounded(E.numeric_univariate(t.gaps, ["user_id", "value"]), mean=7)


def shares_sql(table: str, columns: list[str], n: int, before: str = "") -> str:
    totals = union([f"""SELECT '{c}' AS "column", count({c}) AS total FROM {table}""" for c in columns])
    return f"""{before}SELECT top."column", rank, value, n, {r('n * 100.0 / total')} AS pct
FROM ({top_sql(table, columns, n)}) top JOIN ({totals}) totals ON top."column" = totals."column" """


@query("categorical_univariate", shares_sql("gaps", ["event_type"], 15, f"WITH {GAPS} "))
def categorical_univariate(t: Tables):
    return rounded(E.categorical_univariate(t.gaps)[1])


def histogram_sql(table: str, columns: list[str], bins: int, before: str = "") -> str:
    return before + union(
        [
            f"""SELECT '{c}' AS "column", CAST(i AS INTEGER) AS bin, {r('a')} AS lo, {r('b')} AS hi,
  (SELECT count(*) FROM {table} t WHERE t.{c} >= a AND (t.{c} < b OR (i = {bins - 1} AND t.{c} <= b))) AS count
FROM (SELECT i, lo + i * ((hi - lo) / {bins}) AS a, CASE WHEN i = {bins - 1} THEN hi ELSE lo + (i + 1) * ((hi - lo) / {bins}) END AS b
  FROM (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM {table}), range({bins}) AS g(i))"""
            for c in columns
        ]
    )


@query("histogram", histogram_sql("lineitem", MEASURES, 10))
def histogram(t: Tables):
    return rounded(E.histogram(t.lineitem, MEASURES))


@query("histogram_nulls", histogram_sql("gaps", ["user_id", "value"], 7, f"WITH {GAPS} "))
def histogram_nulls(t: Tables):
    return rounded(E.histogram(t.gaps, ["user_id", "value"], 7))


@query(
    "histogram_constant",
    """SELECT 'five' AS "column", CAST(i AS INTEGER) AS bin, (round(4.5 + i * 0.1, 6) + 0.0)::DOUBLE AS lo,
  (round(4.5 + (i + 1) * 0.1, 6) + 0.0)::DOUBLE AS hi, CASE WHEN i = 5 THEN (SELECT count(*) FROM orders) ELSE 0 END AS count
FROM range(10) AS g(i)""",
)
def histogram_constant(t: Tables):
    return rounded(E.histogram(t.orders.select(F.lit(5.0).alias("five"))))


def scatter_sql(table: str, columns: list[str], key: str, n: int) -> str:
    return union(
        [
            f"""SELECT * FROM (SELECT '{a}_vs_{b}' AS pair, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM {table}
  WHERE {a} IS NOT NULL AND {b} IS NOT NULL ORDER BY {key} LIMIT {n})"""
            for a, b in combinations(columns, 2)
        ]
    )


@query("scatter_pairs", scatter_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"], "o_orderkey", 500))
def scatter_pairs(t: Tables):
    return E.scatter_pairs(t.orders, "o_orderkey")


@query(
    "scatter_pairs_null",
    f"WITH {GAPS} " + scatter_sql("gaps", ["event_id", "user_id", "value"], "event_id", 500),
)
def scatter_pairs_null(t: Tables):
    return E.scatter_pairs(t.gaps, "event_id")


def groups_sql(table: str, keys: list[str], measures: list[str], before: str = "") -> str:
    return before + union(
        [
            f"""SELECT '{k}' AS cat_col, CAST({k} AS VARCHAR) AS category, '{m}' AS num_col, {r(f'avg({m})')} AS mean,
  {r(f'sum(CAST({m} AS DECIMAL(18,2)))', 2)} AS sum, count({m}) AS count, {r(f'median(CAST({m} AS DOUBLE))')} AS median
FROM {table} WHERE {k} IS NOT NULL GROUP BY {k} HAVING count({m}) > 0"""
            for k in keys
            for m in measures
        ]
    )


@query("group_summary", groups_sql("lineitem", ["l_returnflag", "l_linestatus"], MEASURES))
def group_summary(t: Tables):
    # l_shipdate has more than 50 values and is skipped by the operator itself.
    return rounded(E.group_summary(t.lineitem, measures=MEASURES), sum=2)


@query("group_summary_nulls", groups_sql("gaps", ["event_type"], ["event_id", "user_id", "value"], f"WITH {GAPS} "))
def group_summary_nulls(t: Tables):
    return rounded(E.group_summary(t.gaps), sum=2)


@query(
    "infer_target_task",
    union(
        [
            f"""SELECT '{c}' AS target, '{task}' AS task, count(DISTINCT {c}) AS n_unique, count(*) - count({c}) AS null_count
FROM lineitem"""
            for c, task in [
                ("l_returnflag", "classification"),
                ("l_linenumber", "classification"),
                ("l_quantity", "regression"),
            ]
        ]
    ),
)
def infer_target_task(t: Tables):
    parts = [E.infer_target_task(t.lineitem, c) for c in ("l_returnflag", "l_linenumber", "l_quantity")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "class_distribution",
    f"""WITH {GAPS} SELECT event_type AS class, count(*) AS n,
  {r('count(*) * 100.0 / (SELECT count(event_type) FROM gaps)')} AS pct
FROM gaps WHERE event_type IS NOT NULL GROUP BY event_type""",
)
def class_distribution(t: Tables):
    return rounded(E.class_distribution(t.gaps, "event_type"))


@query(
    "class_balance",
    f"""WITH {GAPS}, c AS (SELECT event_type AS k, count(*) AS n FROM gaps WHERE event_type IS NOT NULL GROUP BY 1)
SELECT count(*) AS n_classes, (SELECT k FROM c ORDER BY n DESC, k LIMIT 1) AS most_common_class,
  (SELECT k FROM c ORDER BY n, k DESC LIMIT 1) AS least_common_class,
  {r('max(n) / min(n)')} AS imbalance_ratio, (SELECT count(*) - count(event_type) FROM gaps) AS null_count FROM c""",
)
def class_balance(t: Tables):
    return rounded(E.class_balance(t.gaps, "event_type"))


@query(
    "target_distribution",
    stats_sql("part", ["p_retailprice"], extra=", count(*) - count({c}) AS null_count"),
)
def target_distribution(t: Tables):
    return rounded(E.target_distribution(t.part, "p_retailprice")[0], mean=7)


@query("target_histogram", histogram_sql("part", ["p_retailprice"], 10))
def target_histogram(t: Tables):
    return rounded(E.target_distribution(t.part, "p_retailprice")[1])


@query(
    "target_mean_by_bin",
    f"WITH {GAPS}, known AS (SELECT event_id, user_id, value FROM gaps WHERE value IS NOT NULL) "
    + union(
        [
            f"""SELECT '{c}' AS feature, CAST(i AS INTEGER) AS bin, {r('a')} AS lo, {r('b')} AS hi,
  count(*) AS count, {r('avg(value)')} AS mean_target
FROM (SELECT i, lo + i * ((hi - lo) / 10) - CASE WHEN i = 0 THEN (hi - lo) * 0.001 ELSE 0 END AS a,
    CASE WHEN i = 9 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 10) END AS b
  FROM (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM known), range(10) AS g(i))
JOIN known ON known.{c} > a AND known.{c} <= b GROUP BY i, a, b"""
            for c in ("event_id", "user_id")
        ]
    ),
)
def target_mean_by_bin(t: Tables):
    return rounded(E.target_mean_by_bin(t.gaps, "value"))
