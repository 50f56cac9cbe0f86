"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

The ring has CELLS places.  Every shard owns some of them by hash (its virtual
nodes), a row lies at the place its key hashes to, and it belongs to the first
virtual node clockwise.  No shard takes more rows than its bound: rows beyond
it continue clockwise to the next node whose shard has room.

Which shard takes how many rows of which place depends on the counts per place
only, at most CELLS numbers however many rows there are.  They are settled on
the driver, and each row finds its shard and slot by its rank inside its place.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_BITS = 16
CELLS = 1 << CELL_BITS
VIRTUAL_NODES = 128


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes, by place; of several at one place the smallest shard stays."""
    nodes: dict[int, int] = {}
    for shard in range(shards):
        for v in range(virtual_nodes):
            digest = hashlib.sha256(f"shard {shard} node {v}".encode()).digest()
            place = int.from_bytes(digest[:8], "big") % CELLS
            nodes[place] = min(shard, nodes.get(place, shard))
    return sorted(nodes.items())


def bounds(total: int, shards: int, slack: float) -> list[int]:
    """The most rows of each shard; without slack the sizes are equal, or one apart."""
    if slack > 0:
        most = -(-int(total * (1 + slack)) // shards)
        return [max(most, -(-total // shards))] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def settled(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, slot of the first) that cover every row once."""
    room, used = list(room), [0] * len(room)
    places = [p for p, _ in nodes]
    out: list[tuple[int, int, int, int, int]] = []
    waiting: dict[int, list[tuple[int, int, int]]] = {}

    def take(shard: int, cell: int, first: int, end: int) -> int:
        n = min(room[shard], end - first)
        if n:
            out.append((cell, first, first + n, shard, used[shard]))
            room[shard] -= n
            used[shard] += n
        return first + n

    # a shard serves the rows of its own arcs first, in ring order
    for cell in sorted(counts):
        node = bisect.bisect_left(places, cell) % len(nodes)
        first = take(nodes[node][1], cell, 0, counts[cell])
        if first < counts[cell]:
            waiting.setdefault(node, []).append((cell, first, counts[cell]))
    # the rest goes on clockwise; one round passes every shard
    carried: list[tuple[int, int, int]] = []
    for step in range(2 * len(nodes)):
        node = step % len(nodes)
        left = []
        for cell, first, end in carried:
            first = take(nodes[node][1], cell, first, end)
            if first < end:
                left.append((cell, first, end))
        carried = left + (waiting.pop(node, []) if step < len(nodes) else [])
    if carried:
        raise ValueError("the bounds leave no room for all rows")
    return out


def sharded(df: DataFrame, key: list[Column], shards: int, virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (bigint, gapless from 0 in each shard),
    which replace input columns of those names.

    Without ``slack`` shard sizes differ by one row at most; with it, no shard
    holds more than (1 + slack) times the mean, and fewer rows leave the node
    they hash to.  Null keys hash as such.  Rows with equal keys lie at one
    place and are dealt from there; ranks among rows equal in every column are
    arbitrary, and such rows are interchangeable.  An empty table gives none.
    """
    spark = df.sparkSession
    # whole rows in one column, so that no helper name can clash; places and ranks come from one hash:
    # the low bits say where, the rest in which order
    rows = df.select(F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("row"), F.xxhash64(*key).alias("h"))
    rows = rows.withColumn("cell", F.col("h").bitwiseAND(F.lit(CELLS - 1)).cast("int"))
    counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}  # at most CELLS rows
    room = bounds(sum(counts.values()), shards, slack)
    plan = settled(counts, ring(shards, virtual_nodes), room)
    by_cell: dict[int, list] = {}
    for cell, first, end, shard, slot in plan:
        by_cell.setdefault(cell, []).append((first, end, shard, slot))
    schema = "cell int, takes array<struct<first:bigint,end:bigint,shard:int,slot:bigint>>"
    takes = spark.createDataFrame(sorted(by_cell.items()), schema)
    order = Window.partitionBy("cell").orderBy("h", *(F.col(f"row.`{c}`") for c, kind in df.dtypes if "map" not in kind))
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1).join(F.broadcast(takes), "cell")
    rank = F.col("rank")
    mine = F.get(F.filter("takes", lambda t: (t["first"] <= rank) & (rank < t["end"])), F.lit(0))
    return ranked.withColumn("take", mine).select(
        *(F.col(f"row.`{c}`") for c in df.columns if c.lower() not in ("shard", "slot")),
        F.col("take.shard").alias("shard"),
        (F.col("take.slot") + rank - F.col("take.first")).cast("bigint").alias("slot"),
    )
