"""Running totals over a global order, and lookups that survive hot keys."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 << 20
ROW_OVERHEAD = 24
HOT_SHARE = 1_000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share; a temporary one only in local mode without that setting."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
            folder = tempfile.mkdtemp(prefix="tabulens-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def stable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so a lost executor cannot change it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def ordered_totals(
    df: DataFrame, order: Sequence[str], totals: Sequence[str], within: Sequence[str] = ()
) -> DataFrame:
    """Add ``before_<t>`` (sum of t over earlier rows) and ``total_<t>`` for each t.

    ``within`` restarts the sums per group; it must be a prefix of ``order``.
    A window without partitions would put the whole table in one task, and one
    partitioned by ``within`` a hot group.  Rows are range-partitioned instead,
    summed inside each slice, and shifted by the sums of the earlier slices.
    """
    within = list(within)
    placed = stable(df.repartitionByRange(*order).withColumn("__slice", F.spark_partition_id()))
    before = Window.partitionBy(*within, F.lit(0)).orderBy("__slice")
    whole = Window.partitionBy(*within, F.lit(0))
    per_slice = placed.groupBy("__slice", *within).agg(*(F.sum(t).alias(f"__{t}") for t in totals))
    starts = per_slice.select(
        "__slice",
        *within,
        *(
            F.coalesce(
                F.sum(f"__{t}").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias(f"__start_{t}")
            for t in totals
        ),
        *(F.sum(f"__{t}").over(whole).alias(f"total_{t}") for t in totals),
    )
    if not within:
        starts = F.broadcast(starts)  # one row per partition
    running = Window.partitionBy("__slice", *within).orderBy(*order)
    earlier = running.rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.select(
        "*", *(F.coalesce(F.sum(t).over(earlier), F.lit(0)).alias(f"__run_{t}") for t in totals)
    )
    return inside.join(starts, ["__slice", *within]).select(
        *df.columns,
        *((F.col(f"__run_{t}") + F.col(f"__start_{t}")).alias(f"before_{t}") for t in totals),
        *(f"total_{t}" for t in totals),
    )


def row_bytes(df: DataFrame) -> Column:
    """What a row takes in a broadcast table, text and arrays by their actual length."""
    total = F.lit(ROW_OVERHEAD)
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            width = F.octet_length(c)
        elif isinstance(f.dataType, T.ArrayType):
            width = F.size(c) * 8
        else:
            width = F.lit(8)
        total = total + F.coalesce(width, F.lit(0))
    return total.cast("bigint")


def lookup_join(
    rows: DataFrame, table: DataFrame, key: str, weight: str, how: str = "inner"
) -> DataFrame:
    """Join ``rows`` (inner or left) with a table that has one row per ``key``.

    ``weight`` is how many rows carry the key.  A small table is broadcast after
    adding up its bytes.  Otherwise only the hot keys (at most ``HOT_SHARE``) are
    broadcast, and the remaining rows, which have no hot key, are shuffled.
    """
    size, total = table.agg(F.sum(row_bytes(table)), F.sum(weight)).first()
    if (size or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table.drop(weight)), key, how)
    table = stable(table)
    is_hot = F.col(weight) > F.lit(total / HOT_SHARE)
    hot, rest = table.where(is_hot), table.where(~is_hot)
    in_hot = rows.join(F.broadcast(hot.drop(weight)), key)
    in_rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest.drop(weight), key, how)
    return in_hot.unionByName(in_rest)
