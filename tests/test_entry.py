import duckdb
import pytest

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["numeric_stats", "spearman_pairwise_null", "clean_table", "answer_questions", "roc_auc", "box_plot", "dedupe_none"]


def test_every_sql_belongs_to_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert len(driver.queries()) > 100


def test_entry_runs(spark):
    assert driver.entry(spark).count() == 5


@pytest.mark.parametrize("name", SAMPLE)
def test_spark_and_sql_agree(spark, name):
    df = driver.queries()[name](spark, FOLDER)
    con = duckdb.connect()
    for table in ("orders", "lineitem", "events", "documents", "labels", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    cursor = con.execute(driver.oracle_sql()[name])
    names = [d[0] for d in cursor.description]

    def ordered(columns, rows):
        places = [columns.index(c) for c in sorted(columns)]
        return sorted(([row[i] for i in places] for row in rows), key=repr)

    assert sorted(names) == sorted(df.columns)
    assert ordered(df.columns, [tuple(r) for r in df.collect()]) == ordered(names, cursor.fetchall())


def test_no_query_plans_a_cross_join(spark):
    names = "top_values iqr_cap scale_robust confusion_matrix davies_bouldin kernel_density histogram onehot_sparse split_rows"
    names += " group_summary box_plot_many spearman_matrix" if "spearman_matrix" in driver.queries() else ""
    for name in names.split():
        plan = driver.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
