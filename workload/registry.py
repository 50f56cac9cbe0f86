"""Registration of queries, and the inputs and SQL fragments they share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder, and inputs derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def gaps(self) -> DataFrame:
        """Events with missing values in a number and in a text."""
        return self.events.select(
            "event_id",
            "user_id",
            F.expr("CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END").alias("event_type"),
            F.expr("CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END").alias("value"),
        )

    @property
    def spikes(self) -> DataFrame:
        """Events with missing values and clear outliers."""
        return self.events.select(
            "event_id",
            F.expr(
                "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 997 = 0 THEN value * 1000 + 1000 ELSE value END"
            ).alias("value"),
            F.col("user_id").cast("double").alias("user"),
        )

    @property
    def judged(self) -> DataFrame:
        """Documents with a quality label, a length rule as the prediction and the length as its score."""
        return self.labels.join(self.documents, "doc_id").select(
            "doc_id",
            F.col("quality").alias("label"),
            F.expr("CASE WHEN n_chars > 500 THEN 1 ELSE 0 END").alias("prediction"),
            F.col("n_chars").cast("double").alias("score"),
        )


GAPS = """gaps AS (SELECT event_id, user_id,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events)"""

SPIKES = """spikes AS (SELECT event_id,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 997 = 0 THEN value * 1000 + 1000 ELSE value END AS value,
  CAST(user_id AS DOUBLE) AS "user" FROM events)"""

JUDGED = """judged AS (SELECT l.doc_id, l.quality AS label,
  CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END AS prediction, CAST(d.n_chars AS DOUBLE) AS score
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

MEASURES = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(name: str, sql: str | None = None):
    def register(function: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: function(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def rounded(df: DataFrame, places: int = 6, **special: int) -> DataFrame:
    """Round every double, so that the order of additions cannot show."""
    return df.select(
        *(
            F.round(f.name, special.get(f.name, places)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`")
            for f in df.schema
        )
    )


def r(expression: str, places: int = 6) -> str:
    """The same in SQL, without a negative zero."""
    return f"(round(CAST({expression} AS DOUBLE), {places}) + 0.0)"


def union(parts: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def quartile(column: str, p: float) -> str:
    return f"quantile_cont(CAST({column} AS DOUBLE), {p})"
