"""Reading files into clean tables, and writing result tables."""

from __future__ import annotations

import csv
import io
import os
import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import AnalysisError, nan_to_null, quoted, require_columns

# What a reader takes for a missing value.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# The delimiters that are looked for, and the sample they are looked for in.
DELIMITERS = ",;\t|"
SAMPLE_BYTES = 4096

TEXT_FORMATS = {".csv": None, ".tsv": "\t"}
TYPED_FORMATS = {".parquet": "parquet", ".json": "json", ".orc": "orc"}

WHOLE_NUMBER = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$|^\s*[+-]?(?i:inf|infinity)\s*$"
TRUTH = ("True", "TRUE", "true", "False", "FALSE", "false")


class DataLoadError(AnalysisError):
    """A file that cannot be read as a table."""


def _outside_quotes(line: str) -> str:
    """The line without what stands between double quotes."""
    return "".join(line.split('"')[::2])


def detect_delimiter(sample: str) -> str:
    """The delimiter that occurs equally often, and most often, on the lines of a sample; a comma if none does."""
    lines = [_outside_quotes(line) for line in sample.splitlines() if line.strip()]
    best, most = ",", 0
    for mark in DELIMITERS:
        counts = {line.count(mark) for line in lines}
        if len(counts) == 1 and (n := counts.pop()) > most:
            best, most = mark, n
    return best


def normalise_names(names: Sequence[str | None]) -> list[str]:
    """Lower case with single underscores; clashes get a number, empty names a position."""
    out: list[str] = []
    for i, name in enumerate(names):
        raw = name if name and name.strip() else f"unnamed_{i}"
        clean = re.sub(r"[^a-z0-9]+", "_", raw.strip().lower()).strip("_") or f"column_{i}"
        unique, n = clean, 2
        while unique in out:
            unique, n = f"{clean}_{n}", n + 1
        out.append(unique)
    return out


def normalise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*normalise_names(df.columns))


def missing_to_null(df: DataFrame) -> DataFrame:
    """Missing-value tokens in text columns become NULL."""
    texts = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.select(
        *(
            F.when(~quoted(c).isin(*MISSING_TOKENS), quoted(c)).alias(c) if c in texts else quoted(c)
            for c in df.columns
        )
    )


def _as_number(c: Column) -> Column:
    """Text as a double; only plain numerals and infinities count."""
    return F.when(c.rlike(NUMBER), F.trim(c)).try_cast("double")


def infer_types(df: DataFrame) -> DataFrame:
    """Give each text column the narrowest type that holds all its values: one scan.

    Whole numbers, then decimals, then booleans; anything else, dates included, stays text.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    checks = []
    for i, name in enumerate(texts):
        c = quoted(name)
        whole = F.when(c.rlike(WHOLE_NUMBER), F.trim(c)).try_cast("bigint")
        checks += [
            F.count(c).alias(f"n{i}"),
            F.count(whole).alias(f"i{i}"),
            F.count(_as_number(c)).alias(f"d{i}"),
            F.count_if(c.isin(*TRUTH)).alias(f"b{i}"),
        ]
    row = df.agg(*checks).first()
    casts: dict[str, Column] = {}
    for i, name in enumerate(texts):
        n, c = row[f"n{i}"], quoted(name)
        if row[f"i{i}"] == n and n:
            casts[name] = F.trim(c).cast("bigint")
        elif row[f"d{i}"] == n:  # a column without values is a number column without values
            casts[name] = _as_number(c)
        elif row[f"b{i}"] == n:
            casts[name] = F.lower(c) == "true"
    return df.select(*(casts.get(c, quoted(c)).alias(c) for c in df.columns))


def _extension(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lower()


CORRUPT = "__unparsed"


def _whole_lines(lines: DataFrame) -> DataFrame:
    """The lines that are not blank; raises if one has an unclosed quote."""
    bad = lines.where(_quotes(F.col("value")) % 2 == 1).count()
    if bad:
        raise DataLoadError(f"{bad} lines have an unclosed quote; if quoted fields hold line breaks, read with multiline=True.")
    return lines.where(F.trim("value") != "")


def parse_lines(lines: DataFrame, sep: str | None = None, headers: int = 1) -> DataFrame:
    """A table from delimited lines (column ``value``), the first of which is the header.

    The header occurs ``headers`` times, once for each file; more lines equal to
    it are data.  Lines with more or fewer fields than the header raise with
    their number, none is cut or filled up.
    """
    first = [r.value for r in lines.limit(100).collect()]
    if not first:
        raise DataLoadError("There is no line to read.")
    sep = sep or detect_delimiter("\n".join(first)[:SAMPLE_BYTES])
    header = first[0]
    names = normalise_names(next(csv.reader([header.lstrip("\ufeff")], delimiter=sep)))
    more = lines.where(F.col("value") == F.lit(header)).count() - headers
    if more < 0:
        raise DataLoadError(f"{-more} of {headers} files do not start with the header {header[:80]!r}.")
    rows = _whole_lines(lines.select("value").where(F.col("value") != F.lit(header)))
    if more:
        rows = rows.unionByName(lines.sparkSession.range(more).select(F.lit(header).alias("value")))
    schema = ", ".join(f"`{n}` STRING" for n in [*names, CORRUPT])
    parsed = rows.select(F.from_csv("value", schema, _csv_options(sep)).alias("r")).select("r.*")
    return infer_types(missing_to_null(_complete(parsed)))


def _csv_options(sep: str) -> dict[str, str]:
    return {"sep": sep, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}


def _complete(parsed: DataFrame) -> DataFrame:
    """The rows without ``CORRUPT``; raises if some could not be parsed whole."""
    bad = parsed.where(F.col(CORRUPT).isNotNull())
    n, shown = bad.agg(F.count("*"), F.min(CORRUPT)).first()
    if n:
        raise DataLoadError(f"{n} lines do not have as many fields as the header, for example {shown[:80]!r}.")
    return parsed.drop(CORRUPT)


def _quotes(value: Column) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit('"')))


RECORD_SCHEMA = "file string, start bigint, place int, ends boolean, first boolean, value string"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(value, first): the records of delimited files, line breaks inside quotes kept; ``first`` marks each file's first one.

    Files are read in byte ranges by many tasks.  Every range counts its quotes,
    and a running sum over the ranges of a file says which ranges start inside
    quotes.  With that known each range cuts its own records; what crosses a
    border comes as one piece from either side, and the pieces are put together.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    counted = lines.groupBy("file", "start").agg(F.sum(_quotes(F.col("value")).cast("bigint")).alias("quotes"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # a row per byte range, of which the driver plans the tasks anyway
    ranges = counted.select("file", "start", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)).alias("before"))
    inside = {(r.file, r.start) for r in ranges.where("before % 2 = 1").select("file", "start").collect()}
    begins = {(r.file, r.start) for r in ranges.groupBy("file").agg(F.min("start").alias("start")).collect()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of records: a place above 0 and ``ends`` are whole; place 0 came from before, the last may go on."""
        at, open_lines, is_open, place = None, [], False, 0
        out: list[tuple] = []

        def leave() -> None:
            if at is not None and open_lines:
                out.append((*at, place, False, at in begins and place == 1, "\n".join(open_lines)))

        for batch in batches:
            for value, file, start in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "start"))):
                if (file, start) != at:
                    leave()
                    at, open_lines = (file, start), []
                    is_open = at in inside
                    place = 0 if is_open else 1
                open_lines.append(value)
                is_open ^= value.count('"') % 2 == 1
                if not is_open:
                    out.append((*at, place, True, at in begins and place == 1, "\n".join(open_lines)))
                    open_lines = []
                    place += 1
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=kinds)
            out.clear()
        leave()
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=kinds)

    kinds = pa.schema(
        [("file", pa.string()), ("start", pa.int64()), ("place", pa.int32()), ("ends", pa.bool_()), ("first", pa.bool_()), ("value", pa.string())]
    )
    names = kinds.names
    pieces = lines.mapInArrow(cut, RECORD_SCHEMA)
    whole = pieces.where("place > 0 AND ends").select("value", "first")
    # at most two pieces a range: one that came from before, one that goes on
    broken = pieces.where("place = 0 OR NOT ends")
    order = Window.partitionBy("file").orderBy("start", "place")
    broken = broken.withColumn("record", F.sum((F.col("place") > 0).cast("int")).over(order))
    joined = broken.groupBy("file", "record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "place", "value"))), lambda x: x["value"]), "\n").alias("value"),
        F.max("first").alias("first"),
    )
    return whole.unionByName(joined.select("value", "first")).withColumn("value", F.regexp_replace("value", r"\r\z", ""))


def _read_records(spark: SparkSession, path: str, sep: str | None) -> DataFrame:
    records = read_records(spark, path)
    heads = records.where("first").groupBy("value").agg(F.count("*").alias("n")).orderBy("value").limit(2).collect()
    if not heads:
        raise DataLoadError(f"{path} holds no line.")
    header = heads[0].value
    if len(heads) > 1:
        raise DataLoadError(f"The files of {path} start with different headers, for example {header[:80]!r} and {heads[1].value[:80]!r}.")
    sample = "\n".join([header, *(r.value for r in records.where("NOT first").limit(100).collect())])[:SAMPLE_BYTES]
    sep = sep or detect_delimiter(re.sub(r'"[^"]*"', "", sample))
    names = normalise_names(next(csv.reader(io.StringIO(header.lstrip("\ufeff"), newline=""), delimiter=sep)))
    schema = ", ".join(f"`{n}` STRING" for n in [*names, CORRUPT])
    rows = _whole_lines(records.where("NOT first").select("value"))
    parsed = rows.select(F.from_csv("value", schema, _csv_options(sep)).alias("r")).select("r.*")
    return infer_types(missing_to_null(_complete(parsed)))


def read_csv(spark: SparkSession, path: str, sep: str | None = None, multiline: bool = False) -> DataFrame:
    """A delimited file, or a folder of them, each with a header line.

    Only the first lines are looked at for the delimiter and the names.
    ``multiline`` allows line breaks inside quotes; large files are still read
    by many tasks.  Rows that do not fit the header raise; no field is lost.
    """
    if multiline:
        return _read_records(spark, path, sep)
    lines = spark.read.text(path)
    files = lines.select(F.input_file_name().alias("f")).distinct().count()
    return parse_lines(lines, sep, files)


def load_table(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Read by extension, with tidy column names, NULLs for missing values and inferred types."""
    ext = _extension(path)
    if ext in TEXT_FORMATS:
        df = read_csv(spark, path, TEXT_FORMATS[ext], multiline)
    elif ext in TYPED_FORMATS:
        df = nan_to_null(normalise_columns(spark.read.format(TYPED_FORMATS[ext]).load(path)))
    else:
        known = ", ".join(sorted([*TEXT_FORMATS, *TYPED_FORMATS]))
        raise DataLoadError(f"{path} ends in {ext!r}, which no reader takes (they take {known}).")
    return validate(df, path)


def validate(df: DataFrame, name: str = "table") -> DataFrame:
    if not df.columns:
        raise DataLoadError(f"No column was found in {name}.")
    if df.isEmpty():
        raise DataLoadError(f"{name} holds no rows.")
    return df


def preview(df: DataFrame, order_by: str, rows: int = 100) -> DataFrame:
    """The first rows by ``order_by``."""
    require_columns(df, [order_by])
    return df.orderBy(quoted(order_by)).limit(rows)


def write_results(
    tables: Mapping[str, DataFrame],
    folder: str,
    sections: Sequence[str] | None = None,
    fmt: str = "parquet",
    mode: str = "overwrite",
) -> list[str]:
    """Write each result table (or the chosen sections) to its own folder; returns the paths."""
    chosen = list(tables) if sections is None else list(sections)
    unknown = [s for s in chosen if s not in tables]
    if unknown:
        raise AnalysisError(f"No result named {', '.join(unknown)}.")
    paths = []
    for name in chosen:
        path = f"{folder.rstrip('/')}/{name}"
        tables[name].write.mode(mode).format(fmt).save(path)
        paths.append(path)
    return paths
