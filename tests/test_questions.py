import pytest

from tabulens.operators import questions as Q

EXAMPLES = {
    "COUNT": [
        "how many parcels went out", "give me a count", "NUMBER OF open tickets?", "row count, please", "how large is it",
        "the size of this table", "number of mean people",
    ],
    "AVERAGE": ["average height per tree", "the avg wait", "which mean is it", "a typical order", "MEDIAN of the weights", "mean and total"],
    "SUM": ["add up the total weight", "sum over all shops", "aggregate rainfall", "cumulative distance", "combined load of the lorries"],
    "CORRELATION": ["do any columns correlate", "is rain related to sales", "relationship between wind and waves", "most correlated pair"],
    "MAX_CATEGORY": [
        "which port ships the most", "what shop is best", "top value", "the biggest group here", "which tree is the greatest of all",
        "what is the peak hour",
    ],
    "DISTRIBUTION": ["histogram of heights", "show the spread", "value counts for port", "how is rain in spring distributed", "frequency by hour"],
    "SUMMARY": ["an overview", "describe it", "what does it hold", "what is in there", "summarize the tickets"],
    # near misses: parts of words, words too far apart, words of a class without its partner
    "UNSUPPORTED": [
        "counting sheep", "meaningful answers", "a summit to climb", "spreadsheets", "the most of them", "correlative thinking", "top of the hill",
        "which " + "x" * 60 + " most", "untypically short", "",
    ],
}


@pytest.fixture
def staff(frame):
    return frame(
        "age bigint, salary bigint, total_sales bigint, department string, region string",
        (25, 100, 10, "IT", "N"), (35, 200, 20, "HR", "S"), (45, 300, 30, "IT", "N"), (55, 400, 90, "HR", "E"),
        (30, 150, None, "IT", None),
    )


def ask(staff, *questions):
    asked = staff.sparkSession.createDataFrame(list(enumerate(questions)), "question_id int, question string")
    out = {}
    for r in Q.answer_questions(staff, asked).orderBy("question_id", "position").collect():
        out.setdefault(r.question_id, []).append(r)
    return out


def test_classification_by_example(frame):
    pairs = [(q, intent) for intent, qs in EXAMPLES.items() for q in qs]
    got = Q.classify_questions(frame("question string, want string", *pairs)).collect()
    assert {r.question: r.intent for r in got} == dict(pairs)


def test_column_mentions(frame):
    asked = frame(
        "question string",
        ("What is the AVERAGE of total_sales?",), ("average please",), ("sales by Region",), ("unit price (eur) now",), (None,),
    )
    columns = ["age", "sales", "total_sales", "region", "price (eur)"]
    got = [r.mentioned for r in Q.column_mentions(asked, columns).collect()]
    assert got == ["total_sales", None, "region", None, None]


def test_column_mentions_in_a_wide_table(spark, frame):
    columns = [f"measure {i} of_{i % 7}" for i in range(5000)] + ["Alpha", "alpha", "x.y", "été", "end)"]
    asked = frame(
        "question string",
        ("sum of MEASURE 4321 of_2 now",), ("measure 4321 of_22",), ("alpha?",), ("x.y or xAy",), ("x+y",), ("un été.",), ("the end)s",), ("",), (None,),
    )
    rows = Q.column_mentions(asked, columns)
    assert [r.mentioned for r in rows.collect()] == ["measure 4321 of_2", None, "Alpha", "x.y", None, "été", "end)", None, None]
    size = lambda n: len(Q.column_mentions(asked, columns[:n])._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(10) - size(4000)) < 200


def test_every_answer(staff):
    a = ask(
        staff,
        "How many rows?",
        "average salary",
        "What is the total of total_sales?",
        "Which department has the highest salary?",
        "What region is the most common value",
        "What is the largest salary?",
        "distribution of salary",
        "breakdown of region",
        "strongest correlations?",
        "summary",
        "do something",
        "  ",
        "mean of everything",
    )

    def cells(i):
        return {r.key: r.number if r.text is None else r.text for r in a[i]}

    assert cells(0) == {"row_count": 5}
    assert cells(1) == {"salary": 230}
    assert cells(2) == {"total_sales": 150}
    assert cells(3) == {
        "category_column": "department", "value_column": "salary", "top_category": "HR", "top_value": 600,
    }
    assert cells(4) == {"category_column": "region", "top_category": "N", "count": 2}
    assert cells(5) == {"value_column": "salary", "max_value": 400}
    assert cells(6)["median"] == 200 and cells(6)["p25"] == 150 and cells(6)["column"] == "salary"
    assert cells(7) == {"column": "region", "N": 2, "E": 1, "S": 1}
    assert len(a[8]) == 3 and a[8][0].key == "age / salary"
    assert cells(9)["n_rows"] == 5 and cells(9)["missing_cells"] == 2 and cells(9)["mean of age"] == 38
    assert a[10][0].intent == "UNSUPPORTED" and a[10][0].error is None and a[10][0].key is None
    assert a[11][0].error == "Empty question."
    assert cells(12) == {"age": 38, "salary": 230, "total_sales": 37.5}


def test_ties_go_to_the_smallest_key_and_the_first_column(frame):
    df = frame("k string, a int, b int", ("y", 1, 1), ("x", 1, 1))
    assert Q.max_category_sum(df, "k", "a").first().top_category == "x"
    assert Q.most_frequent(df, "k").first().top_category == "x"
    assert Q.column_with_highest_mean(df).first().column_with_highest_mean == "a"


def test_sum_of_nothing_is_zero_and_spread_of_one_value_is_missing(frame):
    df = frame("e double, o double", (None, 5.0))
    assert {r.column: r.total for r in Q.column_sums(df).collect()} == {"e": 0.0, "o": 5.0}
    assert Q.numeric_distribution(df, ["o"]).first().std is None


def test_a_failing_answer_is_reported_not_raised(frame):
    empty = frame("k string", (None,))
    answer = ask(empty, "which k is the most frequent value")[0][0]
    assert answer.intent == "MAX_CATEGORY" and answer.error.startswith("Query execution failed")


def test_one_failing_answer_leaves_the_others_of_its_class(frame):
    df = frame("k string, shop string, n double", (None, "a", 1.0), (None, "b", 5.0))
    got = ask(df, "which k is the most frequent value", "which shop has the highest n", "what shop is the most frequent value")
    assert got[0][0].error.startswith("Query execution failed") and "'k'" in got[0][0].error
    assert {r.key: r.text for r in got[1]}["top_category"] == "b" and all(r.error is None for r in got[1] + got[2])


def test_every_word_of_a_class_holds_one_of_its_stems():
    words = {
        Q.COUNT: Q.COUNT_WORDS, Q.AVERAGE: Q.AVERAGE_WORDS, Q.SUM: Q.SUM_WORDS, Q.CORRELATION: Q.CORRELATION_WORDS,
        Q.MAX_CATEGORY: Q.EXTREME_WORDS, Q.DISTRIBUTION: Q.DISTRIBUTION_WORDS, Q.SUMMARY: Q.SUMMARY_WORDS,
    }
    assert set(words) == set(Q.STEMS)
    for intent, listed in words.items():
        for word in listed.split("|"):
            assert any(stem in word for stem in Q.STEMS[intent]), word
