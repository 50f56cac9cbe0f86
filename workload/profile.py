"""Profiling queries."""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import functions as F

from tabulens.functions.ordered import shared_folder
from tabulens.operators import profile as P
from tabulens.plans.report import dataset_summary
from tabulens.sources.tables import load_table

from .registry import GAPS, MEASURES, Tables, quartile, query, r, rounded, union

LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
GAP_COLUMNS = ["event_id", "user_id", "event_type", "value"]


def stats_sql(table: str, columns: list[str], before: str = "", extra: str = "") -> str:
    def one(c: str) -> str:
        return f"""SELECT '{c}' AS "column", count({c}) AS count, {r(f'avg({c})', 7)} AS mean,
  {r(quartile(c, 0.5))} AS median, {r(f'CASE WHEN count({c}) = 1 THEN 0 ELSE stddev_samp({c}) END')} AS std,
  CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
  {r(quartile(c, 0.25))} AS q1, {r(quartile(c, 0.75))} AS q3,
  {r(quartile(c, 0.75) + ' - ' + quartile(c, 0.25))} AS iqr,
  {r(f'avg(power({c} - m, 3)) / power(stddev_pop({c}), 3)')} AS skewness,
  {r(f'kurtosis_pop({c})')} AS kurtosis{extra.format(c=c)}
FROM {table}, (SELECT avg({c}) AS m FROM {table})"""

    return before + union([one(c) for c in columns])


@query("shape", "SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns FROM lineitem")
def shape(t: Tables):
    return P.shape(t.lineitem)


@query(
    "size_in_bytes",
    """SELECT CAST(sum(8 * 8 + 4 + strlen(l_returnflag) + strlen(l_linestatus)) AS BIGINT) AS size_bytes
FROM lineitem""",
)
def size_in_bytes(t: Tables):
    return P.size_in_bytes(t.lineitem)


@query(
    "column_types",
    union(
        [
            f"""SELECT '{c}' AS "column", '{k}' AS type, '{g}' AS kind"""
            for c, k, g in [
                ("l_orderkey", "bigint", "numeric"),
                ("l_partkey", "bigint", "numeric"),
                ("l_suppkey", "bigint", "numeric"),
                ("l_linenumber", "int", "numeric"),
                ("l_quantity", "double", "numeric"),
                ("l_extendedprice", "double", "numeric"),
                ("l_discount", "double", "numeric"),
                ("l_tax", "double", "numeric"),
                ("l_returnflag", "string", "categorical"),
                ("l_linestatus", "string", "categorical"),
                ("l_shipdate", "timestamp_ntz", "categorical"),
            ]
        ]
    ),
)
def column_types(t: Tables):
    return P.column_types(t.lineitem)


def nulls_sql(where: str = "") -> str:
    parts = [
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS null_count,
  {r(f'(count(*) - count({c})) * 100.0 / count(*)')} AS null_pct FROM gaps"""
        for c in GAP_COLUMNS
    ]
    return f"WITH {GAPS} SELECT * FROM ({union(parts)}) {where}"


@query("null_profile", nulls_sql())
def null_profile(t: Tables):
    return rounded(P.null_profile(t.gaps))


@query("null_summary", nulls_sql("WHERE null_count > 0"))
def null_summary(t: Tables):
    return rounded(P.null_summary(t.gaps))


@query(
    "cardinality",
    union([f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS cardinality FROM lineitem""" for c in LINEITEM]),
)
def cardinality(t: Tables):
    return P.cardinality(t.lineitem)


@query("numeric_stats", stats_sql("lineitem", MEASURES))
def numeric_stats(t: Tables):
    return rounded(P.numeric_stats(t.lineitem, MEASURES), mean=7)


@query("numeric_stats_nulls", stats_sql("gaps", ["event_id", "user_id", "value"], f"WITH {GAPS} "))
def numeric_stats_nulls(t: Tables):
    return rounded(P.numeric_stats(t.gaps), mean=7)


def mode_sql(c: str, table: str) -> str:
    return f"(SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query(
    "categorical_stats",
    f"""WITH {GAPS}, wide AS (SELECT g.event_type, e.props FROM gaps g JOIN events e ON g.event_id = e.event_id)
"""
    + union(
        [
            f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS null_count,
  count(DISTINCT {c}) AS cardinality, {mode_sql(c, 'wide')} AS mode FROM wide"""
            for c in ("event_type", "props")
        ]
    ),
)
def categorical_stats(t: Tables):
    typed = F.expr("CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END").alias("event_type")
    return P.categorical_stats(t.events.select(typed, "props"))


def top_sql(table: str, columns: list[str], n: int) -> str:
    return union(
        [
            f"""SELECT * FROM (SELECT '{c}' AS "column",
  CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS rank, {c} AS value, count(*) AS n
  FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= {n}"""
            for c in columns
        ]
    )


@query("top_values", top_sql("orders", ["o_orderstatus", "o_orderpriority"], 10))
def top_values(t: Tables):
    return P.top_values(t.orders.drop("o_orderdate"))


@query("top_values_many", top_sql("customer", ["c_name", "c_mktsegment"], 10))
def top_values_many(t: Tables):
    return P.top_values(t.customer)


def pearson_sql(table: str, columns: list[str], places: int = 6) -> str:
    pairs = [
        f"SELECT '{x}' AS col_a, '{y}' AS col_b, {r(f'corr({a}, {b})', places)} AS r FROM {table}"
        for a, b in combinations(columns, 2)
        for x, y in ((a, b), (b, a))
    ]
    diagonal = [f"SELECT '{c}' AS col_a, '{c}' AS col_b, CAST(1 AS DOUBLE) AS r" for c in columns]
    return union(pairs + diagonal)


@query("pearson_matrix", pearson_sql("lineitem", MEASURES))
def pearson_matrix(t: Tables):
    return rounded(P.correlation_matrix(t.lineitem, MEASURES))


@query("pearson_pairwise_null", f"WITH {GAPS} " + pearson_sql("gaps", ["event_id", "user_id", "value"]))
def pearson_pairwise_null(t: Tables):
    return rounded(P.correlation_matrix(t.gaps))


@query(
    "pearson_constant",
    """SELECT 'l_quantity' AS col_a, 'five' AS col_b, CAST(NULL AS DOUBLE) AS r
UNION ALL SELECT 'five', 'l_quantity', NULL UNION ALL SELECT 'five', 'five', NULL
UNION ALL SELECT 'l_quantity', 'l_quantity', 1""",
)
def pearson_constant(t: Tables):
    return P.correlation_matrix(t.lineitem.select("l_quantity", F.lit(5.0).alias("five")))


def spearman_sql(table: str, pairs: list[tuple[str, str]]) -> str:
    def ranks(c: str) -> str:
        return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"

    return union(
        [
            f"""SELECT '{a}' AS col_a, '{b}' AS col_b, {r('corr(ra, rb)')} AS r FROM
  (SELECT {ranks(a)} AS ra, {ranks(b)} AS rb FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
            for a, b in pairs
        ]
    )


@query("spearman", spearman_sql("part", list(combinations(["p_partkey", "p_size", "p_retailprice"], 2))))
def spearman(t: Tables):
    return rounded(P.correlation_pairs(t.part, method="spearman"))


@query("spearman_lineitem", spearman_sql("lineitem", list(combinations(["l_quantity", "l_extendedprice", "l_discount"], 2))))
def spearman_lineitem(t: Tables):
    return rounded(P.correlation_pairs(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"], "spearman"))


@query(
    "spearman_pairwise_null",
    f"WITH {GAPS} " + spearman_sql("gaps", list(combinations(["event_id", "user_id", "value"], 2))),
)
def spearman_pairwise_null(t: Tables):
    return rounded(P.correlation_pairs(t.gaps, method="spearman"))


@query(
    "spearman_four_with_nulls",
    f"WITH {GAPS}, wide AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id * 7) % 13 END AS beat FROM gaps) "
    + spearman_sql("wide", list(combinations(["event_id", "user_id", "value", "beat"], 2))),
)
def spearman_four_with_nulls(t: Tables):
    """Two of four columns have nulls, in different rows."""
    wide = t.gaps.withColumn("beat", F.expr("CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id * 7) % 13 END"))
    return rounded(P.correlation_pairs(wide, method="spearman"))


@query(
    "column_info",
    f"WITH {GAPS} "
    + union(
        [
            f"""SELECT '{c}' AS "column", '{k}' AS type, count({c}) AS non_null, count(*) - count({c}) AS null_count,
  count(DISTINCT {c}) AS "unique", CAST(arg_min({c}, event_id) FILTER ({c} IS NOT NULL) AS VARCHAR) AS sample FROM gaps"""
            for c, k in [("event_id", "bigint"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double")]
        ]
    ),
)
def column_info(t: Tables):
    return P.column_info(t.gaps, "event_id")


def overview_sql(relation: str, columns: list[str], numeric: int) -> str:
    missing = " + ".join(f"count(*) - count({c})" for c in columns)
    w = len(columns)
    return f"""SELECT count(*) AS rows, CAST({w} AS BIGINT) AS columns, CAST({numeric} AS BIGINT) AS numeric_columns,
  CAST({w - numeric} AS BIGINT) AS categorical_columns, CAST({missing} AS BIGINT) AS missing_cells,
  {r(f'({missing}) * 100.0 / (count(*) * {w})')} AS missing_pct,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {relation})) AS duplicate_rows
FROM {relation}"""


@query(
    "overview",
    f"WITH {GAPS}, slim AS (SELECT user_id, event_type, value FROM gaps) "
    + overview_sql("slim", ["user_id", "event_type", "value"], 2),
)
def overview(t: Tables):
    return rounded(P.overview(t.gaps.drop("event_id")))


@query("overview_lineitem", overview_sql("lineitem", LINEITEM, 8))
def overview_lineitem(t: Tables):
    return rounded(P.overview(t.lineitem))


def top_pairs_sql(relation: str, columns: list[str], places: int) -> str:
    pairs = union(
        [
            f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS c FROM {relation}"
            for a, b in combinations(columns, 2)
        ]
    )
    return f"SELECT a AS col_a, b AS col_b, {r('c', places)} AS r FROM ({pairs}) ORDER BY abs(c) DESC, a, b LIMIT 10"


NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", *MEASURES]


@query("top_correlations", top_pairs_sql("lineitem", NUMBERS, 6))
def top_correlations(t: Tables):
    return rounded(P.top_correlations(t.lineitem))


@query(
    "skewed_columns",
    """WITH cubes AS (SELECT l_quantity, power(l_extendedprice / 10000, 6) AS high, l_discount * l_discount AS mid,
  -power(l_tax * 100, 4) AS low FROM lineitem), stats AS ("""
    + union(
        [
            f"""SELECT '{c}' AS "column", avg(power({c} - m, 3)) / power(stddev_pop({c}), 3) AS s
FROM cubes, (SELECT avg({c}) AS m FROM cubes)"""
            for c in ("l_quantity", "high", "mid", "low")
        ]
    )
    + f""") SELECT "column", {r('s')} AS skewness FROM stats WHERE abs(s) > 1 ORDER BY abs(s) DESC LIMIT 10""",
)
def skewed_columns(t: Tables):
    cubes = t.lineitem.selectExpr(
        "l_quantity",
        "power(l_extendedprice / 10000, 6) AS high",
        "l_discount * l_discount AS mid",
        "-power(l_tax * 100, 4) AS low",
    )
    return rounded(P.skewed_columns(P.numeric_stats(cubes)))


def _cell(column: str, measure: str, number: str, text: str, tail: str) -> str:
    return f"""SELECT {column} AS "column", {measure} AS measure, {r(number)} AS number, {text} AS text {tail}"""


@query(
    "dataset_summary",
    f"WITH {GAPS}, slim AS (SELECT user_id, event_type, value FROM gaps), whole AS ("
    + overview_sql("slim", ["user_id", "event_type", "value"], 2)
    + "), tops AS ("
    + top_sql("slim", ["event_type"], 3)
    + ") "
    + union(
        [
            _cell("CAST(NULL AS VARCHAR)", f"'{m}'", m, "CAST(NULL AS VARCHAR)", "FROM whole")
            for m in (
                "rows", "columns", "numeric_columns", "categorical_columns", "missing_cells", "missing_pct", "duplicate_rows",
            )
        ]
        + [
            _cell(f"'{c}'", f"'{m}'", f"{f}({c})", "NULL", "FROM slim")
            for c in ("user_id", "value")
            for m, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))
        ]
        + [_cell('"column"', "'top_' || rank", "n", "value", "FROM tops")]
    ),
)
def summary(t: Tables):
    return rounded(dataset_summary(t.gaps.drop("event_id")))


@query(
    "csv_quoted_breaks",
    """SELECT doc_id, n_chars, CAST(length(text) AS INTEGER) AS length, md5(text) AS digest, source
FROM (SELECT doc_id, n_chars, source, CASE WHEN text NOT IN ('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null') THEN text END AS text FROM documents)""",
)
def csv_quoted_breaks(t: Tables):
    """Texts full of line breaks, written as delimited files and read again by byte ranges."""
    path = f"{shared_folder(t.spark)}/documents-{uuid.uuid4().hex}.csv"
    texts = t.documents.select("doc_id", "text", "n_chars", "source")
    texts.write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    rows = load_table(t.spark, path, multiline=True)
    return rows.select("doc_id", "n_chars", F.length("text").alias("length"), F.md5("text").alias("digest"), "source")
