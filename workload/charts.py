"""Chart-data queries."""

from __future__ import annotations

from tabulens.operators import charts as G
from tabulens.sources import tables as S

from .explore import histogram_sql, scatter_sql
from .metrics import roc_sql
from .profile import pearson_sql
from .registry import GAPS, JUDGED, SPIKES, Tables, quartile, query, r, rounded, union


@query(
    "histogram_bars",
    # The width comes from the column itself: the edges of the inner query are already rounded.
    f"""SELECT bin, lo, hi, count,
  {r('count / ((SELECT count(*) * (max(p_retailprice) - min(p_retailprice)) / 30 FROM part))', 8)} AS density
FROM ({histogram_sql('part', ['p_retailprice'], 30)})""",
)
def histogram_bars(t: Tables):
    return rounded(G.histogram_bars(t.part, "p_retailprice"), density=8)


def density_sql(table: str, y: str, category: str, group: str) -> str:
    return f"""WITH g AS (SELECT {category} AS category, count({y}) AS n, CAST(min({y}) AS DOUBLE) AS lo, CAST(max({y}) AS DOUBLE) AS hi,
  stddev_samp({y}) * power(count({y}), -0.2) AS w FROM {table} GROUP BY {group}),
grid AS (SELECT *, lo + (hi - lo) * i / 199 AS gx FROM g, range(200) AS r(i))
SELECT grid.category, CAST(i AS INTEGER) AS point, {r("gx")} AS x,
  {r(f'sum(exp(-power((gx - {y}) / w, 2) / 2)) / (n * w * sqrt(2 * pi()))', 8)} AS density
FROM grid JOIN {table} ON {category} = grid.category GROUP BY grid.category, i, gx, n, w"""


@query("kernel_density", density_sql("customer", "c_acctbal", "'all'", "1"))
def kernel_density(t: Tables):
    return rounded(G.kernel_density(t.customer, "c_acctbal"), density=8)


@query("violin_density", density_sql("customer", "c_acctbal", "c_mktsegment", "c_mktsegment"))
def violin_density(t: Tables):
    return rounded(G.violin(t.customer, "c_acctbal", "c_mktsegment")[0], density=8)


@query(
    "frequency_bars",
    "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
)
def frequency_bars(t: Tables):
    return G.frequency_bars(t.part, "p_brand")


@query(
    "value_bars",
    """SELECT c_name AS x, c_acctbal AS y, c_mktsegment AS color FROM customer ORDER BY c_custkey LIMIT 20""",
)
def value_bars(t: Tables):
    return G.value_bars(t.customer, "c_name", "c_acctbal", "c_custkey", "c_mktsegment")


@query(
    "pie_shares",
    f"""WITH top AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT value, n, {r('n * 100.0 / (SELECT sum(n) FROM top)')} AS pct FROM top""",
)
def pie_shares(t: Tables):
    return rounded(G.pie_shares(t.part, "p_brand"))


@query("correlation_heatmap", pearson_sql("part", ["p_partkey", "p_size", "p_retailprice"], 2))
def correlation_heatmap(t: Tables):
    return G.correlation_heatmap(t.part)


@query(
    "scatter_points",
    f"""WITH {GAPS} SELECT CAST(user_id AS DOUBLE) AS x, value AS y, event_type AS color, CAST(event_id AS DOUBLE) AS size
FROM gaps WHERE value IS NOT NULL""",
)
def scatter_points(t: Tables):
    return G.scatter_points(t.gaps, "user_id", "value", "event_type", "event_id")


@query(
    "trend_line",
    f"""SELECT count(*) AS n, {r('regr_slope(l_extendedprice, l_quantity)', 5)} AS slope,
  {r('regr_intercept(l_extendedprice, l_quantity)', 4)} AS intercept, {r('regr_r2(l_extendedprice, l_quantity)', 8)} AS r2 FROM lineitem""",
)
def trend_line(t: Tables):
    return rounded(G.trend_line(t.lineitem, "l_quantity", "l_extendedprice"), slope=5, intercept=4, r2=8)


@query("pair_plot", scatter_sql("part", ["p_partkey", "p_size", "p_retailprice"], "p_partkey", 500))
def pair_plot(t: Tables):
    return G.pair_plot(t.part, "p_partkey")


def fences(table: str, y: str, category: str) -> str:
    return f"""q AS (SELECT category, n, q1, m, q3, q1 - (q3 - q1) * 1.5 AS lo, q3 + (q3 - q1) * 1.5 AS hi FROM
  (SELECT {category} AS category, count({y}) AS n, {quartile(y, 0.25)} AS q1, {quartile(y, 0.5)} AS m, {quartile(y, 0.75)} AS q3
   FROM {table} WHERE {category} IS NOT NULL AND {y} IS NOT NULL GROUP BY {category})),
f AS (SELECT q.*, {y} AS y, {y} BETWEEN lo AND hi AS inside FROM {table} JOIN q ON {category} = category WHERE {y} IS NOT NULL)"""


def box_sql(before: str) -> str:
    return f"""WITH {before} SELECT category, n, {r('q1')} AS q1, {r('m')} AS median, {r('q3')} AS q3,
  min(y) FILTER (inside) AS lower_whisker, max(y) FILTER (inside) AS upper_whisker, count(*) FILTER (NOT inside) AS outliers
FROM f GROUP BY category, n, q1, m, q3"""


@query("box_plot", box_sql(fences("lineitem", "l_extendedprice", "l_returnflag")))
def box_plot(t: Tables):
    return rounded(G.box_plot(t.lineitem, "l_extendedprice", "l_returnflag"))


@query("box_plot_many", box_sql(fences("lineitem", "l_extendedprice", "CAST(l_partkey AS VARCHAR)")))
def box_plot_many(t: Tables):
    return rounded(G.box_plot(t.lineitem, "l_extendedprice", "l_partkey"))


@query("box_outliers", f"""WITH {SPIKES}, {fences('spikes', 'value', "'all'")} SELECT category, y FROM f WHERE NOT inside""")
def box_outliers(t: Tables):
    return G.box_outliers(t.spikes, "value")


@query("roc_curve", f"WITH {JUDGED} {roc_sql('judged', 'label = 1', 'score')}")
def roc_curve(t: Tables):
    return rounded(G.roc_curve(t.judged, "label", "score"))


@query(
    "confusion_cells",
    f"""WITH {JUDGED}, c AS (SELECT 0 AS c, 'bad' AS k UNION ALL SELECT 1, 'good')
SELECT a.k AS actual, b.k AS predicted, (SELECT count(*) FROM judged j WHERE j.label = a.c AND j.prediction = b.c) AS n FROM c a, c b""",
)
def confusion_cells(t: Tables):
    return G.confusion_cells(t.judged, "label", "prediction", ["bad", "good"])


@query(
    "cluster_scatter",
    "SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, p_brand AS cluster FROM part",
)
def cluster_scatter(t: Tables):
    return G.cluster_scatter(t.part, "p_brand", "p_size", "p_retailprice")


@query(
    "cluster_scatter_components",
    f"""WITH s AS (SELECT o_custkey - (SELECT avg(o_custkey) FROM orders) AS a, o_totalprice - (SELECT avg(o_totalprice) FROM orders) AS b,
  o_orderstatus FROM orders),
m AS (SELECT var_samp(a) AS p, covar_samp(a, b) AS q, var_samp(b) AS r FROM s),
e AS (SELECT q, (p + r) / 2 + sqrt(((p - r) / 2) ** 2 + q * q) AS l, p FROM m),
v AS (SELECT q / sqrt(q * q + (l - p) ** 2) AS vx, (l - p) / sqrt(q * q + (l - p) ** 2) AS vy FROM e)
SELECT {r('a * vx + b * vy', 2)} AS x, {r('a * vy - b * vx', 2)} AS y, o_orderstatus AS cluster FROM s, v""",
)
def cluster_scatter_components(t: Tables):
    slim = t.orders.select("o_custkey", "o_totalprice", "o_orderstatus")
    return rounded(G.cluster_scatter(slim, "o_orderstatus"), 2)


@query(
    "time_series",
    union(
        [
            f"SELECT o_orderdate AS time, '{c}' AS series, CAST({c} AS DOUBLE) AS value FROM orders"
            for c in ("o_totalprice", "o_custkey")
        ]
    ),
)
def time_series(t: Tables):
    return G.time_series(t.orders, "o_orderdate", ["o_totalprice", "o_custkey", "no_such_column"])


# --- sources ----------------------------------------------------------------

RAW = """CAST(o_orderkey AS STRING) AS whole,
  CASE WHEN o_orderkey % 3 = 0 THEN 'N/A' ELSE CAST(o_totalprice AS STRING) END AS fraction,
  CASE WHEN o_custkey % 2 = 0 THEN 'True' WHEN o_custkey % 5 = 0 THEN 'null' ELSE 'false' END AS truth,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS words"""


@query(
    "infer_types",
    """SELECT o_orderkey AS whole, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS fraction,
  CASE WHEN o_custkey % 2 = 0 THEN true WHEN o_custkey % 5 = 0 THEN NULL ELSE false END AS truth,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS words FROM orders""",
)
def infer_types(t: Tables):
    return S.infer_types(S.missing_to_null(t.orders.selectExpr(*RAW.split(",\n"))))


@query("load_table", "SELECT * FROM customer")
def load_table(t: Tables):
    return S.load_table(t.spark, f"{t.folder}/customer.parquet")


@query(
    "normalise_columns",
    """SELECT o_orderkey AS order_key, o_custkey AS order_key_2, o_totalprice AS total_price_usd FROM orders""",
)
def normalise_columns(t: Tables):
    raw = t.orders.select("o_orderkey", "o_custkey", "o_totalprice").toDF(" Order Key", "order-key!", "Total Price ($USD)")
    return S.normalise_columns(raw)


@query("preview", "SELECT * FROM part ORDER BY p_partkey LIMIT 100")
def preview(t: Tables):
    return S.preview(t.part, "p_partkey")


