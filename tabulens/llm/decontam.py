"""Benchmark decontamination by winnowing, in DataFrame functions only.

Items and documents are cut into words.  The GRAM-word hashes of every SPAN of
words compete, and the smallest one is the fingerprint of that span; a shared
span of SPAN words therefore shares a fingerprint, wherever it lies.  Document
fingerprints that also occur among those of the items are extended to all
windows of SPAN words around them, and a window counts if its words are those
of a window of an item.  Items of fewer words than SPAN are one window each,
looked up by the hashes of all word groups of that length.

Texts are known by their digest, so copies are extended once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import lookup_join
from .common import ascii_lower, small, unused, written

SPAN = 10
GRAM = 6
#: The low bits of a packed fingerprint hold its place, the high bits its hash.
PLACE_BITS = 28
PLACE = (1 << PLACE_BITS) - 1
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def word_rows(df: DataFrame, *columns: Column, text: str) -> DataFrame:
    """The columns, ``w`` (the words of the text) and ``n`` (how many)."""
    return df.select(*columns, words(df[text]).alias("w")).withColumn("n", F.size("w"))


def group_hash(i: Column, size: int) -> Column:
    return F.xxhash64(*(F.get(F.col("w"), i + j) for j in range(size)))


def all_groups(size: int) -> Column:
    return F.transform(places(F.col("n") - size), lambda i: group_hash(i, size))


def window_text(i: Column, size: int) -> Column:
    return F.concat_ws(" ", *(F.get(F.col("w"), i + j) for j in range(size)))


def places(last: Column) -> Column:
    """0 to ``last``, or none if that is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def winnowed(rows: DataFrame, span: int, gram: int) -> DataFrame:
    """The rows with ``f``: the packed fingerprints (hash, place) of all spans."""
    packed = lambda i: group_hash(i, gram).bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("bigint"))
    rows = rows.withColumn("g", F.transform(places(F.col("n") - gram), packed))
    across = span - gram + 1
    smallest = lambda j: F.least(*(F.get(F.col("g"), j + i) for i in range(across)))
    return rows.withColumn("f", F.array_distinct(F.transform(places(F.col("n") - span), smallest))).drop("g")


def item_windows(items: DataFrame, id_column: str, text: str, span: int) -> DataFrame:
    """Distinct (item, size, win): the windows of all items."""
    rows = word_rows(items, items[id_column].cast("string").alias("item"), text=text).where("n > 0")
    size = F.least(F.col("n"), F.lit(span))
    long = F.transform(places(F.col("n") - span), lambda i: window_text(i, span))
    whole = F.array(F.array_join("w", " "))
    wins = F.explode_outer(F.when(F.col("n") >= span, long).otherwise(whole))
    return rows.select("item", size.alias("size"), wins.alias("win")).where("win IS NOT NULL").distinct()


def hit_places(docs: DataFrame, items: DataFrame, text: str, item_text: str, span: int, gram: int) -> DataFrame:
    """(key, size, place): where a fingerprint or a short word group of a document occurs among the items."""
    item_rows = word_rows(items, text=item_text).where("n > 0")
    doc_rows = word_rows(docs.select(document_key(docs[text]).alias("key"), docs[text].alias("t")), F.col("key"), text="t")
    hash_part = F.col("p").bitwiseAND(F.lit(~PLACE))
    # explode_outer: for the inner form Spark would add a filter that computes all of the array a second time
    known = winnowed(item_rows, span, gram).select(F.explode_outer("f").alias("p")).where("p IS NOT NULL")
    known = known.select(hash_part.alias("h")).distinct()
    found = winnowed(doc_rows, span, gram).select("key", F.explode_outer("f").alias("p")).where("p IS NOT NULL")
    found = found.select("key", F.col("p").bitwiseAND(F.lit(PLACE)).cast("int").alias("place"), hash_part.alias("h"))
    hits = found.join(small(written(known, "fingerprints")), "h", "left_semi").select("key", F.lit(span).alias("size"), "place")
    for size in sorted(r.n for r in item_rows.where(F.col("n") < span).select("n").distinct().collect()):  # fewer than SPAN
        short = item_rows.where(F.col("n") == size).select(group_hash(F.lit(0), size).alias("h")).distinct()
        found = doc_rows.select("key", F.posexplode_outer(all_groups(size)).alias("place", "h"))
        found = found.join(small(written(short, "short")), "h", "left_semi")
        hits = hits.unionByName(found.select("key", F.lit(size).alias("size"), "place"))
    return hits.distinct()


def document_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    span: int = SPAN,
    gram: int = GRAM,
) -> DataFrame:
    """One row per document row: ``id``, ``key``, ``n_words``, ``n_hit`` and ``items`` (sorted item ids as strings).

    Null and empty texts have no words and no hits; items without words, or an
    empty item table, hit nothing.  An item without an id hits words but is not
    listed.  Repeated document rows each get their row; a repeated item id is
    listed once.  Documents of any length are taken whole.
    """
    hits = written(hit_places(docs, items, text, item_text, span, gram), "hits")
    by_text = hits.groupBy("key").agg(F.collect_list(F.struct("size", "place")).alias("at"))
    sized = small(by_text, hits.count())
    texts = docs.select(document_key(docs[text]).alias("key"), F.coalesce(docs[text], F.lit("")).alias("t"))
    hit_texts = texts.join(sized, "key").groupBy("key").agg(F.first("t").alias("t"), F.first("at").alias("at"))
    rows = word_rows(hit_texts, F.col("key"), F.col("at"), text="t")
    # every window that covers a fingerprint, and the short groups themselves
    starts = F.array_distinct(
        F.flatten(
            F.transform(
                "at",
                lambda x: F.when(x["size"] < span, F.array(x)).otherwise(
                    F.transform(
                        F.sequence(
                            F.greatest(x["place"] - (span - gram), F.lit(0)), F.least(x["place"], F.col("n") - span)
                        ),
                        lambda s: F.struct(x["size"].alias("size"), s.alias("place")),
                    )
                ),
            )
        )
    )
    rows = rows.withColumn("s", F.explode_outer(starts)).where("s IS NOT NULL").select("key", "w", "s.size", F.col("s.place").alias("start"))
    # the words of a window, none beyond its size
    parts = [F.when(F.col("size") > j, F.get(F.col("w"), F.col("start") + j)) for j in range(span)]
    windows = rows.select("key", "size", "start", F.concat_ws(" ", *parts).alias("win"))

    listed = written(item_windows(items, item_id, item_text, span), "windows")
    named = listed.select("size", "win").distinct().withColumn("wid", F.xxhash64("size", "win"))
    matched = written(windows.join(small(named), ["size", "win"]).select("key", "size", "start", "wid", "win"), "matched")
    inside = F.flatten(F.transform(F.collect_set(F.struct("start", "size")), lambda x: F.sequence(x["start"], x["start"] + x["size"] - 1)))
    covered = matched.groupBy("key").agg(F.size(F.array_distinct(inside)).cast("bigint").alias("n_hit"))
    pairs = matched.select("key", "size", "win").distinct().join(small(listed), ["size", "win"])
    ids = pairs.groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = covered.join(ids, "key")

    base = word_rows(
        docs.select(docs[id_column].alias("id"), docs[text].alias("t")), F.col("id"), document_key(F.col("t")).alias("key"), text="t"
    ).select("id", "key", F.col("n").cast("bigint").alias("n_words"))
    copies = texts.join(small(written(found, "found")).select("key"), "key").groupBy("key").agg(F.count("*").alias("copies"))
    weighed = written(found.join(copies, "key"), "weighed")
    return lookup_join(base, weighed, "key", "copies", "left").select(
        "id",
        "key",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def clean_rows(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has no hit word."""
    key = unused(docs, "contaminated_key")
    hit = contamination(docs, items, id_column, text).where("n_hit > 0").select(F.col("key").alias(key)).distinct()
    hit = written(hit, "contaminated")
    return docs.join(small(hit), document_key(docs[text]) == hit[key], "left_anti")
