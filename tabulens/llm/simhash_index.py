"""Near-duplicate groups by SimHash fingerprints and multi-index hashing.

A fingerprint has two segments of 32 bits, and each segment has a table keyed
by its value.  Fingerprints that differ in at most two bits are equal in one
segment, or differ in one bit of each.  So a fingerprint fetches, from the table
of the first segment, what lies in the Hamming ball of radius one around its own
value, and from the table of the second one what is equal there; the complete
distance of every match is verified.

A table entry with more than BUCKET fingerprints, such as a large group of near
copies, is split by the other segment: there too the ball of radius one is
enumerated, of which at most 33 distinct fingerprints meet in one key.  So no
key is hot, no cap is needed, and no pair is lost.

Groups are the connected components of the links.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import lookup_join
from .common import arrow_map, small, unused, written

SHINGLE = 3
SEED = 42
#: Fingerprints link at this many differing bits or fewer; the enumeration above is for two.
BITS = 2
#: A table entry with more distinct fingerprints is split by the other segment.
BUCKET = 64
BLOCK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text as a signed number; 0 without words."""
    words = (text or b"").lower().split()  # on bytes: A-Z only, and white space of ASCII only
    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    digest = xxhash.xxh64_intdigest
    groups = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    hashes = np.fromiter((digest(b" ".join(g), SEED) for g in groups), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        block = hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    value = sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())
    return value - (1 << 64) if value >> 63 else value


def fingerprints(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the id, ``content`` (a hash of the text) and ``fp``.

    Null and empty texts, and texts of white space only, have fingerprint 0.
    Other columns are left out.
    """
    rows = df.select(df[id_column].alias("id"), F.xxhash64(df[text]).alias("content"), df[text].cast("binary").alias("x"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = pa.array([fingerprint(x) for x in batch.column("x").to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("content"), fps], ["id", "content", "fp"])

    kind = df.schema[id_column].dataType.simpleString()
    return arrow_map(rows, work, f"id {kind}, content bigint, fp bigint", ["x"])


def segment(fp: Column, which: int) -> Column:
    """The high (0) or the low (1) 32 bits as a number."""
    return F.shiftrightunsigned(fp, 32) if which == 0 else fp.bitwiseAND(F.lit((1 << 32) - 1))


def ball(value: Column) -> Column:
    """A segment's value, and it with one bit turned."""
    return F.array(value, *(value.bitwiseXOR(F.lit(1 << i)) for i in range(32)))


def near(pairs: DataFrame) -> DataFrame:
    """The matches (u, v) whose complete distance is small enough, the larger one first."""
    return pairs.where((F.col("u") > F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= BITS))


def close_pairs(distinct: DataFrame) -> DataFrame:
    """Links (u > v) of distinct fingerprints, enough of them to connect all that lie within BITS of each other."""
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = distinct.select("fp").repartition(parts, "fp")  # each becomes 34 look-ups
    fp = F.col("fp")
    entries = [F.struct(F.lit(s).alias("segment"), segment(fp, s).alias("value"), segment(fp, 1 - s).alias("other")) for s in (0, 1)]
    table = spread.select("fp", F.inline(F.array(*entries)))
    sizes = written(table.groupBy("segment", "value").agg(F.count("*").alias("n")).where(F.col("n") > 1), "bucket-sizes")
    crowded = written(sizes.where(F.col("n") > BUCKET).select("segment", "value", F.lit(True).alias("crowded")), "crowded")
    marked = table.join(small(crowded), ["segment", "value"], "left")

    # look-ups: the ball in the first segment, the value itself in the second
    around = F.when(F.col("segment") == 0, ball(F.col("value"))).otherwise(F.array("value"))
    probes = table.select(F.col("fp").alias("u"), "segment", F.col("value").alias("own"), "other", F.explode(around).alias("value"))
    probes = probes.join(small(crowded), ["segment", "value"], "left")
    plain = marked.where("crowded IS NULL").select("segment", "value", F.col("fp").alias("v"))
    found = near(probes.where("crowded IS NULL").select("segment", "value", "u").join(plain, ["segment", "value"]))

    # a crowded entry, from inside: what shares its value meets at a value of the other segment one bit from both
    inside = marked.where("crowded").select("segment", "value", "fp", F.explode(ball(F.col("other"))).alias("key"))
    groups = inside.groupBy("segment", "value", "key").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = near(groups.select(F.array_min("fps").alias("v"), F.explode("fps").alias("u")))
    # and from outside, one bit turned: the other segment may differ in one bit, so the whole fingerprint is known
    outside = probes.where("crowded AND value <> own").select("u", "value", F.explode(ball(F.col("other"))).alias("low"))
    outside = outside.select("u", F.shiftleft("value", 32).bitwiseOR(F.col("low")).alias("v")).where("u > v")
    whole = near(outside.join(distinct.select(F.col("fp").alias("v")), "v", "left_semi"))
    return found.select("u", "v").unionByName(stars.select("u", "v")).unionByName(whole.select("u", "v")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(u, v) with v the smallest node that u reaches, for every node but the smallest ones.

    Large stars and small stars in turn until nothing changes; each round ends
    in a stored table.  A hub's smallest neighbour comes from an aggregation
    that combines before the shuffle.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = written(edges, "links")
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        edges = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        edges = written(edges, "large-stars")
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        edges = joined.select("u", F.col("m").alias("v")).unionByName(
            joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        edges = written(edges.distinct(), "small-stars")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges


def groups(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``id``, ``content``, ``fp``, ``root`` (a fingerprint) and ``component_id``.

    ``component_id`` is the smallest id among all rows that a row reaches over
    links, itself included; null ids do not count, and a group of null ids only
    has none.  Repeated rows each stay.  An empty table gives an empty result.
    """
    rows = written(fingerprints(df, id_column, text), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("id").alias("least_id"), F.count("*").alias("n"))
    distinct = written(distinct, "distinct")
    stars = connected(close_pairs(distinct.select("fp"))).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = distinct.join(stars, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = written(rooted.select("fp", "root", "n").join(ids, "root"), "named")
    return lookup_join(rows, named, "fp", "n").select("id", "content", "fp", "root", "component_id")


def keep_one(df: DataFrame, id_column: str = "doc_id", text: str = "text", grouping: Callable[..., DataFrame] = groups) -> DataFrame:
    """The rows of ``df``, all columns, of which one of each group stays: that of the smallest id.

    ``grouping`` gives ``id``, ``content`` and ``root`` of every row.
    A null id comes after all others; equal ids are told apart by their text,
    and of rows that repeat one of them stays.
    """
    rows = written(grouping(df, id_column, text).select("id", "content", "root"), "groups")
    chosen = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "content")).alias("r"))
    one, same = unused(df, "chosen_id"), unused(df, "chosen_content")
    chosen = written(chosen.select(F.col("r.id").alias(one), F.col("r.content").alias(same)), "chosen")
    is_chosen = df[id_column].eqNullSafe(chosen[one]) & (F.xxhash64(df[text]) == chosen[same])
    kept = df.join(small(chosen), is_chosen, "left_semi")
    repeated = rows.groupBy("id", "content").count().where("count > 1").limit(1).count()
    if repeated:
        mark = unused(df, "row_content")
        kept = kept.withColumn(mark, F.xxhash64(df[text])).dropDuplicates([id_column, mark]).drop(mark)
    return kept
