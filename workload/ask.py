"""Question queries. The questions are written from the part table, one per part."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulens.operators import questions as Q

from .profile import overview_sql, top_sql
from .registry import MEASURES, Tables, quartile, query, r, rounded, union

QUESTION = """CASE p_partkey % 13
  WHEN 0 THEN 'How many rows mention ' || p_brand || '?'
  WHEN 1 THEN 'What is the average l_quantity of ' || p_brand || '?'
  WHEN 2 THEN 'Show the TOTAL l_linenumber for ' || p_brand
  WHEN 3 THEN 'Which l_returnflag has the highest L_LINENUMBER, ' || p_brand || '?'
  WHEN 4 THEN 'What l_linestatus is seen most often with ' || p_brand || '?'
  WHEN 5 THEN 'What is the distribution of l_quantity in ' || p_brand || '?'
  WHEN 6 THEN 'Give me the breakdown of l_returnflag for ' || p_brand
  WHEN 7 THEN 'Are there columns related to each other? ' || p_brand
  WHEN 8 THEN 'Please summarise ' || p_brand
  WHEN 9 THEN 'Predict next year for ' || p_brand
  WHEN 10 THEN '   '
  WHEN 11 THEN 'What is the largest l_extendedprice of ' || p_brand || '?'
  ELSE 'Which thing is the best, ' || p_brand || '?' END"""

# The words that mark each class, written out here and not taken from the operator, so that a wrong word there shows.
PATTERN_CASES = r"""
  WHEN regexp_matches(question, '\b(how many|count|number of|total number|total count|n rows|num rows|row count|record count|size of|how large)\b', 'i') THEN 'COUNT'
  WHEN regexp_matches(question, '\b(average|avg|mean|typical|median)\b', 'i') THEN 'AVERAGE'
  WHEN regexp_matches(question, '\b(total|sum|aggregate|cumulative|combined)\b', 'i') THEN 'SUM'
  WHEN regexp_matches(question, '\b(correlations?|correlate[sd]?|relationship between|related to|strongest relationship|most related|most correlated|strongest correlations?)\b', 'i') THEN 'CORRELATION'
  WHEN regexp_matches(question, '\b(which|what).{0,40}(highest|most|largest|maximum|top|biggest|best|peak|greatest)\b', 'i') THEN 'MAX_CATEGORY'
  WHEN regexp_matches(question, '\b(highest|most|largest|maximum|top|biggest|best|peak|greatest).{0,40}(category|group|value|item|entry|class|label)\b', 'i') THEN 'MAX_CATEGORY'
  WHEN regexp_matches(question, '\b(distribution|spread|breakdown|frequency|histogram|value counts|how is .{1,30} distributed)\b', 'i') THEN 'DISTRIBUTION'
  WHEN regexp_matches(question, '\b(summarise|summarize|summary|describe|overview|tell me about|what does|about this dataset|what is in)\b', 'i') THEN 'SUMMARY'"""


# Means of these never lie halfway between two 6-decimal numbers, which engines may round apart.
MEANS = ["l_linenumber", "l_quantity", "l_extendedprice"]


def part_questions(t: Tables):
    return t.part.select(F.col("p_partkey").alias("question_id"), F.expr(QUESTION).alias("question"))


@query(
    "classify_questions",
    f"""WITH q AS (SELECT 'part' AS source, p_partkey AS question_id, {QUESTION} AS question FROM part
  UNION ALL SELECT 'part name', p_partkey, 'what is the ' || p_type || ' value of the most ' || p_name || ' group' FROM part
  UNION ALL SELECT 'conversation', conv_id * 1000 + turn, text FROM conversations
  UNION ALL SELECT 'document', doc_id, text FROM documents)
SELECT source, question_id, CASE {PATTERN_CASES} ELSE 'UNSUPPORTED' END AS intent FROM q""",
)
def classify_questions(t: Tables):
    named = t.part.selectExpr(
        "'part name' AS source",
        "p_partkey AS question_id",
        "'what is the ' || p_type || ' value of the most ' || p_name || ' group' AS question",
    )
    talk = t.conversations.selectExpr("'conversation' AS source", "conv_id * 1000 + turn AS question_id", "text AS question")
    texts = t.documents.selectExpr("'document' AS source", "doc_id AS question_id", "text AS question")
    every = part_questions(t).withColumn("source", F.lit("part")).unionByName(named).unionByName(talk).unionByName(texts)
    return Q.classify_questions(every).select("source", "question_id", "intent")


MENTIONS = "\n".join(
    f"  WHEN regexp_matches(lower(question), '\\b{c}\\b') THEN '{c}'"
    for c in ("l_extendedprice", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax")
)


@query(
    "column_mentions",
    f"""WITH q AS (SELECT p_partkey AS question_id, {QUESTION} AS question FROM part)
SELECT question_id, CASE {MENTIONS} ELSE NULL END AS mentioned FROM q""",
)
def column_mentions(t: Tables):
    columns = [*MEASURES, "l_returnflag", "l_linestatus"]
    return Q.column_mentions(part_questions(t), columns).select("question_id", "mentioned")


@query("row_count", "SELECT count(*) AS row_count FROM lineitem")
def row_count(t: Tables):
    return Q.row_count(t.lineitem)


@query("column_means", union([f"""SELECT '{c}' AS "column", {r(f'avg({c})')} AS mean FROM lineitem""" for c in MEANS]))
def column_means(t: Tables):
    return Q.column_means(t.lineitem, MEANS)


@query(
    "column_sums",
    union(
        [
            f"""SELECT '{c}' AS "column", {r(f'sum(CAST({c} AS DECIMAL(18,2)))', 2)} AS total FROM lineitem"""
            for c in MEASURES
        ]
        + ["""SELECT 'nothing' AS "column", CAST(0 AS DOUBLE) AS total"""]
    ),
)
def column_sums(t: Tables):
    empty = t.lineitem.withColumn("nothing", F.lit(None).cast("double"))
    return rounded(Q.column_sums(empty, [*MEASURES, "nothing"]), 2)


@query(
    "column_maxima",
    union([f"""SELECT '{c}' AS "column", {r(f'max({c})')} AS maximum FROM lineitem""" for c in MEASURES]),
)
def column_maxima(t: Tables):
    return Q.column_maxima(t.lineitem, MEASURES)


@query(
    "max_category_sum",
    f"""SELECT CAST(l_suppkey AS VARCHAR) AS top_category, {r('sum(CAST(l_extendedprice AS DECIMAL(18,2)))', 2)} AS top_value
FROM lineitem GROUP BY l_suppkey ORDER BY sum(CAST(l_extendedprice AS DECIMAL(18,2))) DESC, 1 LIMIT 1""",
)
def max_category_sum(t: Tables):
    return rounded(Q.max_category_sum(t.lineitem, "l_suppkey", "l_extendedprice"), 2)


@query(
    "most_frequent",
    """SELECT c_mktsegment AS top_category, count(*) AS count FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""",
)
def most_frequent(t: Tables):
    return Q.most_frequent(t.customer, "c_mktsegment")


@query(
    "column_with_highest_mean",
    f"""SELECT c AS column_with_highest_mean, {r('m')} AS mean_value FROM (SELECT 'p_partkey' AS c, avg(p_partkey) AS m FROM part
UNION ALL SELECT 'p_size', avg(p_size) FROM part UNION ALL SELECT 'p_retailprice', avg(p_retailprice) FROM part)
ORDER BY m DESC LIMIT 1""",
)
def column_with_highest_mean(t: Tables):
    return Q.column_with_highest_mean(t.part)


def distribution_sql(columns: list[str]) -> str:
    return union(
        [
            f"""SELECT '{c}' AS "column", {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, {r(f'min({c})')} AS min,
  {r(quartile(c, 0.25))} AS p25, {r(quartile(c, 0.5))} AS median, {r(quartile(c, 0.75))} AS p75, {r(f'max({c})')} AS max FROM orders"""
            for c in columns
        ]
    )


@query("numeric_distribution", distribution_sql(["o_totalprice", "o_custkey"]))
def numeric_distribution(t: Tables):
    return Q.numeric_distribution(t.orders, ["o_totalprice", "o_custkey"])


@query("category_distribution", top_sql("part", ["p_brand", "p_type"], 10))
def category_distribution(t: Tables):
    return Q.category_distribution(t.part, ["p_brand", "p_type"])


@query(
    "strongest_correlations",
    f"""SELECT a AS feature_a, b AS feature_b, {r('c', 4)} AS correlation FROM (
SELECT 'o_orderkey' AS a, 'o_custkey' AS b, corr(o_orderkey, o_custkey) AS c FROM orders
UNION ALL SELECT 'o_orderkey', 'o_totalprice', corr(o_orderkey, o_totalprice) FROM orders
UNION ALL SELECT 'o_custkey', 'o_totalprice', corr(o_custkey, o_totalprice) FROM orders) ORDER BY abs(c) DESC LIMIT 10""",
)
def strongest_correlations(t: Tables):
    return Q.strongest_correlations(t.orders)


ASKED = ["l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_linenumber"]


def answer(kind: int, intent: str, cells: list[tuple], source: str = "slim", error: str = "NULL") -> str:
    return union(
        [
            f"""SELECT {kind} AS kind, '{intent}' AS intent, {position} AS position, {key} AS key,
  CAST({text} AS VARCHAR) AS text, CAST({number} AS DOUBLE) AS number, CAST({error} AS VARCHAR) AS error{'' if plain else f' FROM {source}'}"""
            for position, (key, text, number, plain) in enumerate(cells)
        ]
    )


ANSWERS = union(
    [
        answer(0, "COUNT", [("'row_count'", "NULL", "count(*)", False)]),
        answer(1, "AVERAGE", [("'l_quantity'", "NULL", r("avg(l_quantity)"), False)]),
        answer(2, "SUM", [("'l_linenumber'", "NULL", r("sum(l_linenumber)"), False)]),
        answer(
            3,
            "MAX_CATEGORY",
            [
                ("'category_column'", "'l_returnflag'", "NULL", True),
                ("'value_column'", "'l_linenumber'", "NULL", True),
                ("'top_category'", "k", "NULL", False),
                ("'top_value'", "NULL", r("s"), False),
            ],
            "(SELECT l_returnflag AS k, sum(l_linenumber) AS s FROM slim GROUP BY 1 ORDER BY 2 DESC LIMIT 1)",
        ),
        answer(
            4,
            "MAX_CATEGORY",
            [
                ("'category_column'", "'l_linestatus'", "NULL", True),
                ("'top_category'", "k", "NULL", False),
                ("'count'", "NULL", "n", False),
            ],
            "(SELECT l_linestatus AS k, count(*) AS n FROM slim GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)",
        ),
        answer(
            5,
            "DISTRIBUTION",
            [
                ("'column'", "'l_quantity'", "NULL", True),
                ("'mean'", "NULL", r("avg(l_quantity)"), False),
                ("'std'", "NULL", r("stddev_samp(l_quantity)"), False),
                ("'min'", "NULL", "min(l_quantity)", False),
                ("'p25'", "NULL", quartile("l_quantity", 0.25), False),
                ("'median'", "NULL", quartile("l_quantity", 0.5), False),
                ("'p75'", "NULL", quartile("l_quantity", 0.75), False),
                ("'max'", "NULL", "max(l_quantity)", False),
            ],
        ),
        answer(6, "DISTRIBUTION", [("'column'", "'l_returnflag'", "NULL", True)]),
        """SELECT 6, 'DISTRIBUTION', row_number() OVER (ORDER BY count(*) DESC, l_returnflag), l_returnflag, NULL, count(*), NULL
FROM slim GROUP BY l_returnflag""",
        f"""SELECT 7, 'CORRELATION', row_number() OVER (ORDER BY abs(c) DESC) - 1, k, NULL, {r('c', 4)}, NULL FROM (
  SELECT 'l_quantity / l_extendedprice' AS k, corr(l_quantity, l_extendedprice) AS c FROM slim
  UNION ALL SELECT 'l_quantity / l_linenumber', corr(l_quantity, l_linenumber) FROM slim
  UNION ALL SELECT 'l_extendedprice / l_linenumber', corr(l_extendedprice, l_linenumber) FROM slim)""",
        answer(
            8,
            "SUMMARY",
            [
                ("'n_rows'", "NULL", "rows", False),
                ("'n_cols'", "NULL", "5", True),
                ("'n_numeric'", "NULL", "3", True),
                ("'n_categorical'", "NULL", "2", True),
                ("'missing_cells'", "NULL", "0", True),
                ("'missing_pct'", "NULL", "0", True),
                ("'duplicate_rows'", "NULL", "duplicate_rows", False),
                *(
                    (f"'mean of {c}'", "NULL", f"(SELECT {r(f'avg({c})')} FROM slim)", True)
                    for c in ("l_quantity", "l_extendedprice", "l_linenumber")
                ),
            ],
            f"({overview_sql('slim', ASKED, 3)})",
        ),
        answer(9, "UNSUPPORTED", [("NULL", "NULL", "NULL", True)]),
        answer(10, "UNSUPPORTED", [("NULL", "NULL", "NULL", True)], error="'Empty question.'"),
        answer(
            11,
            "MAX_CATEGORY",
            [
                ("'value_column'", "'l_extendedprice'", "NULL", True),
                ("'max_value'", "NULL", "max(l_extendedprice)", False),
            ],
        ),
        answer(
            12,
            "MAX_CATEGORY",
            [
                ("'category_column'", "'l_returnflag'", "NULL", True),
                ("'top_category'", "k", "NULL", False),
                ("'count'", "NULL", "n", False),
            ],
            "(SELECT l_returnflag AS k, count(*) AS n FROM slim GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)",
        ),
    ]
)


@query(
    "answer_questions",
    f"""WITH slim AS (SELECT {', '.join(ASKED)} FROM lineitem), answers AS ({ANSWERS})
SELECT p_partkey AS question_id, intent, CAST(position AS INTEGER) AS position, key, text, number, error
FROM part JOIN answers ON p_partkey % 13 = kind""",
)
def answer_questions(t: Tables):
    return Q.answer_questions(t.lineitem.select(*ASKED), part_questions(t))
