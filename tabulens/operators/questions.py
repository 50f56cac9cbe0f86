"""Answering plain-language questions about a table.

Questions come as a DataFrame. Their class and the columns they mention are
found by expressions, the distinct (class, columns) combinations, at most a few
per column pair, are answered once each, and the answers are joined back.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    AnalysisError,
    as_double,
    as_text,
    nan_to_null,
    numeric_columns,
    quoted,
    require_columns,
    small_frame,
    text_columns,
)
from ..functions.ordered import lookup_join
from ..functions.quantiles import exact_quantiles
from .profile import overview, top_correlations, top_values

COUNT, AVERAGE, SUM = "COUNT", "AVERAGE", "SUM"
CORRELATION, MAX_CATEGORY = "CORRELATION", "MAX_CATEGORY"
DISTRIBUTION, SUMMARY, UNSUPPORTED = "DISTRIBUTION", "SUMMARY", "UNSUPPORTED"

# The words that mark each class of question, in the order they are tried.
COUNT_WORDS = (
    "how many|count|number of|total number|total count|n rows|num rows|row count|record count|size of|how large"
)
AVERAGE_WORDS = "average|avg|mean|typical|median"
SUM_WORDS = "total|sum|aggregate|cumulative|combined"
CORRELATION_WORDS = (
    "correlations?|correlate[sd]?|relationship between|related to|strongest relationship|"
    "most related|most correlated|strongest correlations?"
)
ASKING_WORDS = "which|what"
EXTREME_WORDS = "highest|most|largest|maximum|top|biggest|best|peak|greatest"
MEMBER_WORDS = "category|group|value|item|entry|class|label"
DISTRIBUTION_WORDS = (
    "distribution|spread|breakdown|frequency|histogram|value counts|how is .{1,30} distributed"
)
SUMMARY_WORDS = (
    "summarise|summarize|summary|describe|overview|tell me about|what does|about this dataset|what is in"
)


def _whole_words(words: str) -> str:
    return rf"\b({words})\b"


# A word of each class holds one of these, and looking for them is far cheaper than the patterns.
STEMS = {
    COUNT: ("how many", "count", "number", " rows", "size of", "how large"),
    AVERAGE: ("average", "avg", "mean", "typical", "median"),
    SUM: ("total", "sum", "aggregate", "cumulative", "combined"),
    CORRELATION: ("relat",),
    MAX_CATEGORY: ("highest", "most", "largest", "maximum", "top", "biggest", "best", "peak", "greatest"),
    DISTRIBUTION: ("distribut", "spread", "breakdown", "frequency", "histogram", "value counts"),
    SUMMARY: ("summar", "describe", "overview", "tell me about", "what does", "about this dataset", "what is in"),
}

INTENT_PATTERNS = (
    (COUNT, _whole_words(COUNT_WORDS)),
    (AVERAGE, _whole_words(AVERAGE_WORDS)),
    (SUM, _whole_words(SUM_WORDS)),
    (CORRELATION, _whole_words(CORRELATION_WORDS)),
    (
        MAX_CATEGORY,
        rf"\b({ASKING_WORDS}).{{0,40}}({EXTREME_WORDS})\b|\b({EXTREME_WORDS}).{{0,40}}({MEMBER_WORDS})\b",
    ),
    (DISTRIBUTION, _whole_words(DISTRIBUTION_WORDS)),
    (SUMMARY, _whole_words(SUMMARY_WORDS)),
)

# Unicode word edges, and only \n ends a line.
JAVA_FLAGS = "(?Ud)"

# The letters outside ASCII that a case-blind match takes for ASCII ones.
LOOKALIKES, PLAIN = "\u0130\u0131\u017f\u212a", "iisk"

ANSWER_SCHEMA = "intent string, cat_col string, num_col string, any_col string, position int, key string, text string, number double, error string"


def folded(question: Column) -> Column:
    """The text in lower case, for ``question_intent``."""
    return F.lower(F.translate(question, LOOKALIKES, PLAIN))


def question_intent(text: Column) -> Column:
    """The first class whose words appear in a folded text, else UNSUPPORTED."""
    out = None
    for intent, pattern in INTENT_PATTERNS:
        stem = reduce(lambda a, s: a | text.contains(s), STEMS[intent], F.lit(False))
        hit = stem & text.rlike(JAVA_FLAGS + pattern)
        out = F.when(hit, intent) if out is None else out.when(hit, intent)
    return out.otherwise(UNSUPPORTED)


WORD_EDGED = re.compile(r"\w(.*\w)?", re.S)


def _odd_mention(lowered: Column, columns: Sequence[str]) -> Column:
    """The longest of some names that begin or end with no word character, by a pattern each."""
    out = F.lit(None).cast("string")
    for name in reversed(sorted(columns, key=len, reverse=True)):
        pattern = r"(?U)\b" + re.sub(r"(\W)", r"\\\1", name.lower()) + r"\b"
        out = F.when(lowered.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def with_mentions(questions: DataFrame, question: str, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """``questions`` with, for each entry of ``wanted``, the longest of its column names that appears as whole words, or NULL.

    Each different text is cut into runs of words as long as the longest name,
    which are looked up in a table of the names, so the plan is the same for
    any number of columns.  Names of equal length go by their order.
    """
    spark, outs = questions.sparkSession, list(wanted)
    places: dict[str, dict[str, int]] = {}
    odd: dict[str, list[str]] = {o: [] for o in outs}
    for o in outs:
        for i, name in enumerate(wanted[o]):
            if WORD_EDGED.fullmatch(name.lower()):
                places.setdefault(name.lower(), {}).setdefault(o, i)
            else:
                odd[o].append(name)
    rows = [(gram, *(at.get(o) for o in outs), *(wanted[o][at[o]] if o in at else None for o in outs)) for gram, at in places.items()]
    fields = [f"at{k} bigint" for k in range(len(outs))] + [f"name{k} string" for k in range(len(outs))]
    names = small_frame(spark, rows, ", ".join(["gram string", *fields]))
    most = max((len(re.findall(r"\w+", gram)) for gram in places), default=1)

    lowered = F.lower(F.col("text"))
    texts = questions.select(quoted(question).alias("text")).where("text IS NOT NULL").groupBy("text").agg(F.count("*").alias("times"))
    parts = F.regexp_extract_all(lowered, F.lit(r"(?U)(\w+\W*)"), F.lit(1))
    texts = texts.withColumn("parts", parts)
    runs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.lit(most)),
            lambda n: F.when(
                F.size("parts") >= n,
                F.transform(F.sequence(F.lit(1), F.size("parts") - n + 1), lambda i: F.array_join(F.slice("parts", i, n), "")),
            ).otherwise(F.array().cast("array<string>")),
        )
    )
    cut = texts.select("text", F.explode(F.array_distinct(runs)).alias("run"))
    cut = cut.withColumn("gram", F.regexp_replace("run", r"(?U)\W+\z", ""))
    met = cut.join(F.broadcast(names), "gram")  # as many names as the table has columns
    longest = [
        F.max(F.when(F.col(f"at{k}").isNotNull(), F.struct(F.length("gram").alias("n"), (-F.col(f"at{k}")).alias("at"), F.col(f"name{k}").alias("name")))).alias(f"m{k}")
        for k in range(len(outs))
    ]
    found = texts.select("text", "times").join(met.groupBy("text").agg(*longest), "text", "left")
    told = []
    for k, o in enumerate(outs):
        plain = F.col(f"m{k}.name")
        if odd[o]:
            other = _odd_mention(lowered, odd[o])
            plain = F.when(plain.isNull() | (F.length(other) > F.length(plain)), other).otherwise(plain)
        told.append(plain.alias(o))
    found = found.select(F.col("text").alias("__text"), "times", *told)
    marked = questions.withColumn("__text", quoted(question))
    return lookup_join(marked, found, "__text", "times", "left").drop("__text")


def classify_questions(questions: DataFrame, question: str = "question") -> DataFrame:
    require_columns(questions, [question])
    return (
        questions.withColumn("__folded", folded(quoted(question)))
        .withColumn("intent", question_intent(F.col("__folded")))
        .drop("__folded")
    )


def column_mentions(questions: DataFrame, columns: Sequence[str], question: str = "question") -> DataFrame:
    require_columns(questions, [question])
    return with_mentions(questions, question, {"mentioned": list(columns)})


def parse_questions(questions: DataFrame, df: DataFrame, question: str = "question") -> DataFrame:
    """Add the class and only the columns that this class looks at."""
    text = quoted(question)
    empty = text.isNull() | (F.trim(F.regexp_replace(text, r"\s", " ")) == "")
    numbers = numeric_columns(df)
    first = df.columns[0] if df.columns else None
    parsed = (
        questions.select("*", empty.alias("__empty"), folded(text).alias("__folded"))
        .withColumn("intent", F.when(F.col("__empty"), UNSUPPORTED).otherwise(question_intent(F.col("__folded"))))
        .drop("__folded")
    )
    intent = F.col("intent")
    kept = parsed.columns
    named = with_mentions(parsed, question, {"__cat": text_columns(df), "__num": numbers, "__any": df.columns})
    return named.select(
        *map(quoted, kept),
        F.when(intent == MAX_CATEGORY, F.col("__cat")).alias("cat_col"),
        F.when(intent.isin(AVERAGE, SUM, MAX_CATEGORY), F.col("__num")).alias("num_col"),
        F.when(intent == DISTRIBUTION, F.coalesce("__any", F.lit(first))).alias("any_col"),
    )


# --- single answers, each a small DataFrame ---------------------------------


def _rounded(value: Column, places: int = 6) -> Column:
    return F.round(value, places)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"))


def column_means(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, mean)`` to 6 decimals."""
    df = nan_to_null(df)
    columns = list(columns) if columns is not None else numeric_columns(df)
    return _per_column(df, columns, "mean", lambda x: _rounded(F.avg(x)))


def column_sums(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, total)`` to 6 decimals; 0 where there is nothing to add."""
    df = nan_to_null(df)
    columns = list(columns) if columns is not None else numeric_columns(df)
    return _per_column(df, columns, "total", lambda x: _rounded(F.coalesce(F.sum(x), F.lit(0.0))))


def column_maxima(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _per_column(nan_to_null(df), columns, "maximum", lambda x: _rounded(F.max(x)))


def _per_column(df: DataFrame, columns: Sequence[str], name: str, aggregate) -> DataFrame:
    require_columns(df, columns)
    if not columns:
        return small_frame(df.sparkSession, [], f"column string, {name} double")
    row = df.agg(*(aggregate(as_double(c)).alias(f"v{i}") for i, c in enumerate(columns)))
    return row.select(
        F.inline(
            F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"v{i}").alias(name)) for i, c in enumerate(columns)))
        )
    )


def max_category_sum(df: DataFrame, category: str, measure: str) -> DataFrame:
    """The category with the largest sum; ties go to the smallest key."""
    df = nan_to_null(df)
    require_columns(df, [category, measure])
    return (
        df.where(quoted(category).isNotNull())
        .groupBy(as_text(category).alias("top_category"))
        .agg(F.coalesce(F.sum(as_double(measure)), F.lit(0.0)).alias("__sum"))
        .orderBy(F.desc("__sum"), F.asc("top_category"))
        .limit(1)
        .select("top_category", _rounded(F.col("__sum")).alias("top_value"))
    )


def most_frequent(df: DataFrame, category: str) -> DataFrame:
    require_columns(df, [category])
    return (
        nan_to_null(df)
        .where(quoted(category).isNotNull())
        .groupBy(as_text(category).alias("top_category"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), F.asc("top_category"))
        .limit(1)
    )


def column_with_highest_mean(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Ties go to the first column."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    position = F.array_position(F.array(*map(F.lit, columns)), F.col("column"))
    return (
        column_means(df, columns)
        .where("mean is not null")
        .orderBy(F.desc("mean"), position)
        .limit(1)
        .select(F.col("column").alias("column_with_highest_mean"), F.col("mean").alias("mean_value"))
    )


def numeric_distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, extremes and quartiles to 6 decimals; no deviation for one value."""
    df = nan_to_null(df)
    require_columns(df, columns)
    extra = [
        f(as_double(c)).alias(f"{n}{i}")
        for i, c in enumerate(columns)
        for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
    ]
    found = exact_quantiles(df, columns, extra=extra)
    rows = [
        (
            c,
            *(found.extra[f"{n}{i}"] for n in ("mean", "std", "min")),
            *(found.values[(c, p)] for p in (0.25, 0.5, 0.75)),
            found.extra[f"max{i}"],
        )
        for i, c in enumerate(columns)
    ]
    names = ("mean", "std", "min", "p25", "median", "p75", "max")
    frame = small_frame(df.sparkSession, rows, "column string, " + ", ".join(f"{n} double" for n in names))
    return frame.select("column", *(_rounded(F.col(n)).alias(n) for n in names))


def category_distribution(df: DataFrame, columns: Sequence[str], top_n: int = 10) -> DataFrame:
    return top_values(df, columns, top_n)


def strongest_correlations(df: DataFrame, top_n: int = 10) -> DataFrame:
    """Pearson pairs to 4 decimals."""
    return top_correlations(df, top_n=top_n).select(
        F.col("col_a").alias("feature_a"), F.col("col_b").alias("feature_b"), _rounded(F.col("r"), 4).alias("correlation")
    )


# --- all questions at once --------------------------------------------------


class _Answers:
    """Rows of ``ANSWER_SCHEMA`` for the combinations that were asked."""

    def __init__(self, df: DataFrame, asked: Sequence[tuple]):
        self.df = nan_to_null(df)
        self.numbers, self.texts = numeric_columns(df), text_columns(df)
        self.asked = asked
        self.rows: list[tuple] = []

    def add(self, combo, cells=(), error=None) -> None:
        cells = list(cells) or [(None, None, None)]
        for position, (key, text, number) in enumerate(cells):
            self.rows.append((*combo, position, key, text, number, error))

    def guarded(self, combos, answer) -> None:
        """A failing answer becomes an error row; the others of its kind are answered one by one."""
        try:
            done = answer(combos)
        except Exception as failure:  # noqa: BLE001
            if len(combos) > 1:
                for combo in combos:
                    self.guarded([combo], answer)
            else:
                self.add(combos[0], error=f"Query execution failed: {failure}")
        else:
            for combo, cells in done:
                self.add(combo, cells)

    def run(self) -> list[tuple]:
        handlers = {
            COUNT: self.count,
            AVERAGE: lambda combos: self.simple(combos, column_means),
            SUM: lambda combos: self.simple(combos, column_sums),
            MAX_CATEGORY: self.maximum,
            DISTRIBUTION: self.distribution,
            CORRELATION: self.correlation,
            SUMMARY: self.summary,
            UNSUPPORTED: lambda combos: [(c, ()) for c in combos],
        }
        for intent, handler in handlers.items():
            combos = [c for c in self.asked if c[0] == intent]
            if combos:
                self.guarded(combos, handler)
        return self.rows

    @staticmethod
    def one(result: DataFrame, column: str):
        row = result.first()
        if row is None:
            raise AnalysisError(f"column {column!r} holds no values")
        return row

    def count(self, combos):
        n = row_count(self.df).first().row_count
        return [(c, [("row_count", None, float(n))]) for c in combos]

    def simple(self, combos, measure):
        wanted = self.numbers if any(c[2] is None for c in combos) else sorted({c[2] for c in combos})
        values = {r[0]: r[1] for r in measure(self.df, wanted).collect()}
        return [(c, [(n, None, values[n]) for n in ([c[2]] if c[2] else self.numbers)]) for c in combos]

    def maximum(self, combos):
        out = []
        for combo in combos:
            _, cat, num, _ = combo
            if cat is None and num is None and self.texts:
                cat = self.texts[0]
            if cat and num:
                top = self.one(max_category_sum(self.df, cat, num), cat)
                cells = [
                    ("category_column", cat, None),
                    ("value_column", num, None),
                    ("top_category", top.top_category, None),
                    ("top_value", None, top.top_value),
                ]
            elif cat:
                top = self.one(most_frequent(self.df, cat), cat)
                cells = [
                    ("category_column", cat, None),
                    ("top_category", top.top_category, None),
                    ("count", None, float(top["count"])),
                ]
            elif num:
                value = column_maxima(self.df, [num]).first().maximum
                cells = [("value_column", num, None), ("max_value", None, value)]
            elif self.numbers:
                top = column_with_highest_mean(self.df, self.numbers).first()
                cells = [
                    ("column_with_highest_mean", top.column_with_highest_mean, None),
                    ("mean_value", None, top.mean_value),
                ]
            else:
                cells = []
            out.append((combo, cells))
        return out

    def distribution(self, combos):
        wanted = {c[3] for c in combos if c[3]}
        numbers = [c for c in self.df.columns if c in wanted and c in self.numbers]
        others = [c for c in self.df.columns if c in wanted and c not in self.numbers]
        cells: dict[str, list] = {c: [("column", c, None)] for c in wanted}
        for row in numeric_distribution(self.df, numbers).collect() if numbers else ():
            cells[row.column] += [(k, None, v) for k, v in row.asDict().items() if k != "column"]
        for row in category_distribution(self.df, others).orderBy("column", "rank").collect() if others else ():
            cells[row.column].append((row.value, None, float(row.n)))
        return [(c, cells.get(c[3], ())) for c in combos]

    def correlation(self, combos):
        pairs = strongest_correlations(self.df).collect() if len(self.numbers) >= 2 else []
        return [(c, [(f"{p.feature_a} / {p.feature_b}", None, p.correlation) for p in pairs]) for c in combos]

    def summary(self, combos):
        row = overview(self.df).first()
        cells = [
            ("n_rows", None, float(row["rows"])),
            ("n_cols", None, float(row["columns"])),
            ("n_numeric", None, float(len(self.numbers))),
            ("n_categorical", None, float(len(self.texts))),
            ("missing_cells", None, float(row.missing_cells)),
            ("missing_pct", None, round(row.missing_pct, 4)),
            ("duplicate_rows", None, float(row.duplicate_rows)),
        ]
        cells += [(f"mean of {r.column}", None, r.mean) for r in column_means(self.df, self.numbers).collect()]
        return [(c, cells) for c in combos]


def answer_questions(
    df: DataFrame, questions: DataFrame, question_id: str = "question_id", question: str = "question"
) -> DataFrame:
    """``(question_id, intent, position, key, text, number, error)``; never fails on a question."""
    require_columns(questions, [question_id, question])
    parsed = parse_questions(questions, df, question)
    combination = ["intent", "cat_col", "num_col", "any_col"]
    asked = [tuple(r) for r in parsed.select(*combination).distinct().collect()]
    answers = small_frame(df.sparkSession, _Answers(df, asked).run(), ANSWER_SCHEMA)
    same = [parsed[c].eqNullSafe(answers[c]) for c in combination]
    joined = parsed.join(F.broadcast(answers), same, "left")
    return joined.select(
        parsed[question_id].alias("question_id"),
        parsed["intent"],
        "position",
        "key",
        "text",
        "number",
        F.when(parsed["__empty"], F.lit("Empty question.")).otherwise(answers["error"]).alias("error"),
    )
