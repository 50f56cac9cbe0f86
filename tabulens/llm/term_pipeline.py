"""Ranked lexical search by pipelined term partitioning.

The terms of the items are dealt to OWNERS owners by how many documents hold
them: the first owner has the rarest, the last the most frequent ones.  The
documents are cut into blocks of bounded size, and each owner keeps, block by
block, the postings of its terms.  For every block a bundle per item sets out:
it carries the item's terms with their weights and sparse accumulators
(document, score), and passes the owners one after another.  At each owner
``cogroup`` brings the block's bundles and the owner's postings together, and
the owner adds its whole-number contributions.  After the last owner each
bundle gives up its best documents, and a rank over them ends the search.

An accumulator is left behind only if its document cannot reach the block's
best TOP any more, by bounds on what the later owners can add, so the result is
exact.  A frequent term is spread over all blocks, and an owner's task holds
one block and at most ITEMS_TOGETHER bundles.

Which terms can be asked for is told to the scan by a bitmap of fixed size;
what slips through is dropped when postings meet the items' terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import lookup_join
from .common import pieces, small, written

TOP = 20
OWNERS = 4
#: Each owner's terms are this many times as frequent as those of the one before.
STEP = 8
#: A block ends at so many bytes of text (or 4,096 documents); a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
ITEMS_TOGETHER = 1_000
#: Places of the bitmap.
PLACES = 1 << 22
# Fixed values of the score: its scale, and how strongly length counts.
SCALE, FLAT, SLOPE = 1_000_000_000, 75, 25

LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))

BLOCK_SCHEMA = "block bigint, term string, docs array<int>, tfs array<int>, ids array<bigint>, ns array<bigint>"


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text: runs of ASCII letters, digits and all other characters, A-Z in lower case."""
    return (text or b"").translate(LETTERS).split()


def place(term: bytes) -> int:
    return xxhash.xxh32_intdigest(term) % PLACES


def numbered(items: DataFrame, id_column: str, text: str) -> DataFrame:
    """(item, item_id, term, times): the terms of each item; rows with one id are one item, null included."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, ["x"]):
                counts = [Counter(terms_of(x)) for x in piece.column("x").to_pylist()]
                sizes = np.array([len(c) for c in counts], np.int64)
                ids = piece.column("item_id").take(pa.array(np.repeat(np.arange(len(counts)), sizes)))
                terms = pa.array([t.decode() for c in counts for t in c], pa.string())
                times = pa.array([n for c in counts for n in c.values()], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, terms, times], ["item_id", "term", "times"])

    kind = items.schema[id_column].dataType.simpleString()
    rows = items.select(items[id_column].alias("item_id"), items[text].cast("binary").alias("x"))
    found = rows.mapInArrow(work, f"item_id {kind}, term string, times bigint")
    return written(found.groupBy("item_id", "term").agg(F.sum("times").alias("times")), "item-terms")


def bitmap(terms: DataFrame) -> bytes:
    """Bits of the places of all terms: PLACES / 8 bytes, however many terms there are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.unique([place(t.encode()) for t in batch.column("term").to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32())], ["place"])

    bits = np.zeros(PLACES, bool)
    bits[terms.select("term").mapInArrow(work, "place int").distinct().toArrow()["place"].to_numpy()] = True
    return np.packbits(bits).tobytes()


def blocks(docs: DataFrame, known: bytes, id_column: str, text: str) -> DataFrame:
    """Per block one row per term with its postings, and one with a null term that has the documents' ids and lengths.

    Documents are numbered inside their block; null ids stay null.
    """
    rows = docs.select(docs[id_column].cast("bigint").alias("id"), docs[text].cast("binary").alias("x"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(known, np.uint8)).astype(bool)
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            for piece in pieces(batch, ["x"], BLOCK_BYTES):
                postings: dict[bytes, tuple[list[int], list[int]]] = {}
                asked: dict[bytes, bool] = {}
                lengths = []
                for d, x in enumerate(piece.column("x").to_pylist()):
                    words = terms_of(x)
                    lengths.append(len(words))
                    for t, n in Counter(words).items():
                        wanted = asked.get(t)
                        if wanted is None:
                            wanted = asked[t] = bool(bits[place(t)])
                        if wanted:
                            docs_of, tfs = postings.setdefault(t, ([], []))
                            docs_of.append(d)
                            tfs.append(n)
                names = [None, *(t.decode() for t in postings)]
                lists = [*postings.values()]
                columns = [
                    pa.array([at] * len(names), pa.int64()),
                    pa.array(names, pa.string()),
                    pa.array([None, *(x[0] for x in lists)], pa.list_(pa.int32())),
                    pa.array([None, *(x[1] for x in lists)], pa.list_(pa.int32())),
                    pa.array([piece.column("id").to_pylist(), *[None] * len(lists)], pa.list_(pa.int64())),
                    pa.array([lengths, *[None] * len(lists)], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["block", "term", "docs", "tfs", "ids", "ns"])
                at += 1

    return written(rows.mapInArrow(work, BLOCK_SCHEMA), "blocks")


def weight(n: Column, df: Column) -> Column:
    return F.floor(1000 * F.log((2 * n + 2).cast("double") / (2 * df + 1).cast("double"))).cast("bigint")


def owner_of(n: Column, df: Column) -> Column:
    """0 for the rarest terms up to OWNERS - 1 for the most frequent ones."""
    steps = F.lit(0)
    for i in range(1, OWNERS):
        steps = steps + (df * STEP**i >= n).cast("int")
    return steps


def starts_of(column: pa.ChunkedArray) -> np.ndarray:
    """Where each list of a list column starts among its flattened values, and the end; null lists are empty."""
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())]).astype(np.int64)


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    return pc.list_flatten(column).to_numpy()


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    sizes = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), kind))


def owner_stage(owner: int, n_docs: int, n_terms: int, top: int):
    """What one owner does with the bundles of a block; the last one puts document ids for their numbers."""
    is_last = owner == OWNERS - 1

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        head = left.filter(pc.is_null(left["term"]))
        m = FLAT + (SLOPE * numbers(head["ns"]) * n_docs) // max(n_terms, 1)
        held = left.filter(pc.is_valid(left["term"]))
        docs, at = numbers(held["docs"]), starts_of(held["docs"])
        tfs = numbers(held["tfs"]).astype(np.int64)
        gains = SCALE * tfs // (1000 * tfs + 12 * m[docs])
        where = {t: slice(at[i], at[i + 1]) for i, t in enumerate(held["term"].to_pylist())}
        ids = pc.list_flatten(head["ids"])
        by_id = pc.fill_null(ids, np.iinfo(np.int64).max).to_numpy(), pc.is_null(ids).to_numpy()

        terms, t_at = pc.list_flatten(right["terms"]).to_pylist(), starts_of(right["terms"])
        weights, owners, most = (numbers(right[c]) for c in ("weights", "owners", "most"))
        old_docs, old_scores, d_at = numbers(right["docs"]), numbers(right["scores"]), starts_of(right["docs"])
        out_docs, out_scores = [], []
        for i in range(right.num_rows):
            total = np.zeros(len(m), np.int64)
            total[old_docs[d_at[i] : d_at[i + 1]]] = old_scores[d_at[i] : d_at[i + 1]]
            span = np.arange(t_at[i], t_at[i + 1])
            for t in span[owners[span] == owner].tolist():
                found = where.get(terms[t])
                if found is not None:
                    total[docs[found]] += weights[t] * gains[found]
            # a document stays if the later owners could still lift it to the block's best
            later = span[owners[span] > owner]
            least = 1
            if np.count_nonzero(total) > top:
                least = max(int(np.partition(total, -top)[-top]) - int((weights[later] * most[later]).sum()), 1)
            kept = np.flatnonzero(total >= least)
            if is_last:
                kept = kept[np.lexsort((by_id[0][kept], by_id[1][kept], -total[kept]))[:top]]
            out_docs.append(kept)
            out_scores.append(total[kept])
        if is_last:
            chosen = list_array(out_docs, pa.int32())
            chosen = pa.ListArray.from_arrays(chosen.offsets, ids.combine_chunks().take(chosen.values))
            return pa.table({"item_id": right["item_id"], "ids": chosen, "scores": list_array(out_scores, pa.int64())})
        made = {"docs": list_array(out_docs, pa.int32()), "scores": list_array(out_scores, pa.int64())}
        return pa.table([made.get(c, right[c]) for c in right.column_names], names=right.column_names)

    return add


def search(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    top: int = TOP,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0.

    Ties go to the smaller doc_id, a null one last.  Document ids are integers.
    Rows of ``items`` that share an id (null included) are one item with all
    their terms; an item without terms, or without documents that hold one, has
    no rows.  Null and empty texts have no terms.  Repeated document rows each
    take their rank.  Other columns are left out, and empty tables give an
    empty result.
    """
    asked = numbered(items, item_id, item_text)
    stored = blocks(docs, bitmap(asked), id_column, text)
    lengths = stored.where("term IS NULL").select(F.explode("ns").alias("n"))
    n_docs, n_terms = lengths.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()

    # of each term: its weight and owner, and the most that a document can gain by it
    held = stored.where("term IS NOT NULL").groupBy("term").agg(
        F.sum(F.size("docs")).alias("df"), F.max(F.array_max("tfs")).alias("tf"), F.count("*").alias("rows")
    )
    holders = asked.groupBy("term").agg(F.count("*").alias("items"))
    table = held.join(holders, "term").select(
        "term",
        weight(F.lit(n_docs), F.col("df")).alias("weight"),
        owner_of(F.lit(n_docs), F.col("df")).alias("owner"),
        F.expr(f"{SCALE}L * tf div (1000L * tf + {12 * FLAT}L)").alias("most"),
        "rows",
        "items",
    )
    table = written(table, "terms")

    of_item = lookup_join(asked, table.drop("rows"), "term", "items").groupBy("item_id").agg(
        F.collect_list(
            F.struct("term", (F.col("weight") * F.col("times")).alias("weight"), "owner", "most")
        ).alias("t")
    )
    listed = of_item.select(
        "item_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"), F.col("t.owner").alias("owners"), F.col("t.most").alias("most")
    )
    listed = written(listed, "bundles")
    parts = max(-(-listed.count() // ITEMS_TOGETHER), 1)
    listed = listed.withColumn("part", F.pmod(F.hash("item_id"), F.lit(parts)))
    every_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    empty = {"docs": F.array().cast("array<int>"), "scores": F.array().cast("array<bigint>")}
    bundles = stored.where("term IS NULL").select("block", every_part).join(small(listed), "part").withColumns(empty)

    kind = items.schema[item_id].dataType.simpleString()
    ends = f"item_id {kind}, ids array<bigint>, scores array<bigint>"
    for owner in range(OWNERS):
        own = table.where(F.col("owner") == owner).select("term", "rows")
        left = lookup_join(stored.where("term IS NOT NULL"), own, "term", "rows").select(*stored.columns)
        left = left.unionByName(stored.where("term IS NULL")).select("*", every_part)
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in bundles.schema)
        left = left.toDF(*left.columns)  # columns of its own beside those of the bundles
        both = left.groupBy("block", "part").cogroup(bundles.groupBy("block", "part"))
        bundles = both.applyInArrow(owner_stage(owner, n_docs, n_terms, top), ends if owner == OWNERS - 1 else fields)
    found = bundles.select("item_id", F.explode(F.arrays_zip(F.col("ids").alias("doc_id"), F.col("scores").alias("score"))).alias("r"))
    best = Window.partitionBy("item_id").orderBy(F.desc("r.score"), F.asc_nulls_last("r.doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "r.doc_id", "r.score")
