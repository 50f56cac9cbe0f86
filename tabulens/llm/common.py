"""Helpers the operators share: stored intermediates and Arrow batches of bounded size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of input that a Python task turns into one output batch.
CHUNK_BYTES = 4 << 20
#: A table is broadcast only after its bytes were added up against this bound, and its rows against the other one.
BROADCAST_BYTES = 32 << 20
BROADCAST_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only in local mode without that setting."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
        folder = tempfile.mkdtemp(prefix="tabulens-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored as Parquet in the shared folder and read back, so its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_bytes(df: DataFrame) -> Column:
    """What a row takes in a broadcast table: texts, binaries and arrays by their length."""

    def width(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 8
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
                each = F.transform(c, lambda x: width(x, kind.elementType))
                return F.coalesce(F.aggregate(each, F.lit(0), lambda a, b: a + b), F.lit(0)) + 16
            return F.coalesce(F.size(c), F.lit(0)) * 8 + 16
        if isinstance(kind, T.StructType):
            return sum((width(c[f.name], f.dataType) for f in kind), F.lit(8))
        return F.lit(8)

    return sum((width(df[f"`{f.name}`"], f.dataType) for f in df.schema), F.lit(24)).cast("bigint")


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if its rows and their bytes, added up first, stay within the bounds; else as it is.

    ``rows`` is given where the rows are known and of fixed width.
    """
    if rows is not None:
        return F.broadcast(df) if rows <= BROADCAST_ROWS else df
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(table: pa.Table | pa.RecordBatch, columns: Sequence[str], most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch in order, each of at most ``most`` bytes in the text columns or of one row."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.zeros(table.num_rows, np.int64)
    for c in columns:
        size += pc.fill_null(pc.cast(pc.binary_length(table.column(c)), pa.int64()), 0).to_numpy(zero_copy_only=False)
    ends, start, total = np.cumsum(size), 0, 0
    while start < table.num_rows:
        stop = max(int(np.searchsorted(ends, total + most, "right")), start + 1)
        stop = min(stop, start + 4096)
        yield table.slice(start, stop - start)
        total, start = int(ends[stop - 1]), stop


def give_back() -> None:
    """Memory that Arrow holds for later goes back to the system: Python workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()


def in_pieces(
    batches: Iterable[pa.RecordBatch],
    work: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]],
    text_columns: Sequence[str],
    most: int = CHUNK_BYTES,
) -> Iterator[pa.RecordBatch]:
    """What ``work`` gives for each slice of each batch; nothing of a batch is kept after it."""
    for batch in batches:
        for piece in pieces(batch, text_columns, most):
            made = work(piece)
            if isinstance(made, pa.RecordBatch):
                yield made
            else:
                yield from made
        batch = piece = made = None
        give_back()
    give_back()  # the reader held the last batch until here


def arrow_map(
    df: DataFrame,
    work: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]],
    schema: str,
    text_columns: Sequence[str],
    most: int = CHUNK_BYTES,
) -> DataFrame:
    """``mapInArrow`` over slices of bounded size; ``work`` gives one batch or several for each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_pieces(batches, work, text_columns, most)

    return df.mapInArrow(run, schema)
