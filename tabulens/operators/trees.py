"""Tree ensembles grown by Spark: forests of any depth and second-order boosting.

Features are cut into bins once, and a row becomes the list of the bins it falls
into (a missing number, or a category that is not the row's, has none).  A split
is found from sums per (node, bin): prefix sums over the bins of a feature give
every left side, and the rows without a bin of that feature are tried on both.

The upper levels of all trees, and of all classes, are grown together: one
aggregate per level over (tree, node, bin).  Once a node has SMALL_ROWS rows or
fewer it is finished whole inside one task.  Sums are whole numbers on a grid
(the gradients are rounded to it once), so they do not depend on the order of
rows or on who adds them up, and the same rows give the same trees whatever the
partitions.  How often a row is in a tree's bag is a Poisson draw from a hash of
the row's key and the tree.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import stable

#: Bins of a number, and rows whose values the edges come from (all of them if there are fewer; cells of the sample in all).
BINS, EDGE_ROWS, EDGE_CELLS = 256, 100_000, 4_000_000
#: A node with at most so many rows is finished in one task.
SMALL_ROWS = 100_000
#: A model of at most so many bytes is broadcast for predictions.
MODEL_BYTES = 128 << 20
#: Boosting rounds between stored margins.
STORE_EVERY = 10
GRID_BITS = 34

U64 = np.uint64


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of numbers, evenly spread."""
    with np.errstate(over="ignore"):
        x = np.asarray(x).astype(U64) + U64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def poisson_one(keys: np.ndarray, salt: int) -> np.ndarray:
    """Draws from a Poisson law of mean 1, by hash."""
    shares = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(shares, mixed(keys, salt) / 2.0**64, "right").astype(np.int64)


# --- bins -------------------------------------------------------------------


@dataclass
class Bins:
    """Edges of the first features, which are numbers; every other feature is one bin, where it is not zero."""

    edges: list[np.ndarray]
    size: int  # features in all

    def __post_init__(self):
        self.starts = np.cumsum([0, *(len(e) + 1 for e in self.edges)])
        self.total = int(self.starts[-1]) + self.size - len(self.edges)

    def feature(self, codes: np.ndarray) -> np.ndarray:
        first = self.starts[-1]
        return np.where(codes >= first, len(self.edges) + codes - first, np.searchsorted(self.starts, codes, "right") - 1)

    def span(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first bin of the feature of each bin, and the first one behind it."""
        at = np.minimum(np.searchsorted(self.starts, codes, "right") - 1, len(self.edges))
        other = at >= len(self.edges)
        return np.where(other, codes, self.starts[at]), np.where(other, codes + 1, self.starts[np.minimum(at + 1, len(self.edges))])

    def numbers(self, vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers as a matrix, and (row, feature) of the other features that are not zero."""
        n, wide = len(vectors), len(self.edges)
        values = vectors.field("values")
        sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy()
        flat = pc.list_flatten(values).to_numpy()
        row = np.repeat(np.arange(n), sizes)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        sparse = (vectors.field("type").to_numpy() == 0)[row]
        at[sparse] = pc.list_flatten(vectors.field("indices")).to_numpy()
        matrix = np.zeros((n, wide))
        numeric = at < wide
        matrix[row[numeric], at[numeric]] = flat[numeric]
        others = ~numeric & (flat != 0)
        return matrix, row[others], at[others]

    def codes(self, vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        """The bins of the rows one after another, and where each row starts."""
        matrix, row, at = self.numbers(vectors)
        n, wide = matrix.shape
        rows, codes = [row], [at - wide + self.starts[-1]]
        for f, edges in enumerate(self.edges):
            known = np.flatnonzero(~np.isnan(matrix[:, f]))
            rows.append(known)
            codes.append(self.starts[f] + np.searchsorted(edges, matrix[known, f], "left"))
        row, code = np.concatenate(rows), np.concatenate(codes).astype(np.int64)
        order = np.lexsort((code, row))
        return code[order], np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])


def vector_parts(features: str) -> Column:
    """A vector as type, indices and values; a null list of indices is slow to hand to Python, an empty one is not."""
    v = F.unwrap_udt(features)
    indices = F.coalesce(v["indices"], F.array().cast("array<int>"))
    return F.struct(v["type"].alias("type"), indices.alias("indices"), v["values"].alias("values")).alias(features)


def struct_of(column: pa.Array | pa.ChunkedArray) -> pa.StructArray:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def learnt_bins(prepared: DataFrame, numbers: int, size: int, rows: int) -> Bins:
    """Edges at equal shares of the values of up to EDGE_ROWS rows, those of the smallest hash of their key."""
    if not numbers:
        return Bins([], size)
    most = max(min(EDGE_ROWS, EDGE_CELLS // numbers), 1)
    chosen = prepared.select("features", "key")
    if rows > most:
        share = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
        chosen = chosen.withColumn("u", share).where(F.col("u") <= 2 * most / rows).orderBy("u", "key").limit(most)
    plain = Bins([np.zeros(0)] * numbers, size)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = plain.numbers(batch.column("features"))[0]
            yield pa.RecordBatch.from_arrays([pa.array(list(matrix), pa.list_(pa.float64()))], ["x"])

    found = chosen.select(vector_parts("features")).mapInArrow(values, "x array<double>").toArrow()["x"]
    matrix = pc.list_flatten(found).to_numpy().reshape(-1, numbers)
    edges = []
    for f in range(numbers):
        column = np.sort(matrix[~np.isnan(matrix[:, f]), f])
        distinct = np.unique(column)
        if len(distinct) > BINS:
            distinct = np.unique(column[(np.arange(1, BINS) * len(column)) // BINS])
            edges.append(distinct)
        else:
            edges.append(distinct[:-1])
    return Bins(edges, size)


# --- trees ------------------------------------------------------------------


@dataclass(frozen=True)
class Rules:
    """How nodes split. Sums are [weight, gradient, ...] in grid units."""

    units: tuple[float, ...]
    smooth: float = 0.0  # added to the weight in gains and leaf values
    min_weight: float = 0.0
    min_gain: float = 0.0
    depth: int | None = None
    some: int | None = None  # features drawn for each node
    counts: bool = False  # gradients are class counts: impure nodes split also without gain

    def score(self, sums: np.ndarray) -> np.ndarray:
        units = np.array(self.units)
        weight = sums[..., 0] * units[0] + self.smooth
        with np.errstate(divide="ignore", invalid="ignore"):
            value = ((sums[..., 1:] * units[1:]) ** 2).sum(axis=-1) / weight
        return np.where(weight > 0, value, 0.0)


@dataclass
class Tree:
    """Nodes in order of growth: ``code`` is the last bin of the left side (-1 at leaves), children lie side by side."""

    code: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    sums: np.ndarray
    gain: np.ndarray

    FIELDS = ("code", "missing_left", "left", "sums", "gain")

    @classmethod
    def empty(cls, width: int) -> "Tree":
        return cls(np.array([-1]), np.array([False]), np.array([-1]), np.zeros((1, width), np.int64), np.zeros(1))


#: A packed tree: numbers of nodes and leaves, the splits in order of growth, the sums of the leaves column by column.
TREE_FIELDS = "nodes int, code binary, missing_left binary, sums binary, feature array<int>, gain array<double>, splits array<bigint>"


def shortest(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as hold them all, after one byte that says how many those are."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1)
    size = next(k for k in (1, 2, 4, 8) if most < 1 << (8 * k - 1))
    return bytes([size]) + x.astype(f"<i{size}").tobytes()


def numbers_in(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64)


def packed(tree: Tree, keys: dict[str, int], bins: Bins) -> dict:
    """A tree in a row: what children, inner sums and gains follow from, and the gains and splits of each feature."""
    inner = tree.code >= 0
    feature, at = np.unique(bins.feature(tree.code[inner]), return_inverse=True)
    leaves = [shortest(c) for c in tree.sums[~inner].T]
    sizes = np.array([len(x) for x in leaves], "<i8")
    return keys | {
        "nodes": len(tree.code), "code": shortest(tree.code), "missing_left": np.packbits(tree.missing_left[inner]).tobytes(),
        "sums": sizes.tobytes() + b"".join(leaves), "feature": feature.tolist(),
        "gain": np.bincount(at, tree.gain[inner], len(feature)).tolist(), "splits": np.bincount(at, minlength=len(feature)).tolist(),
    }


def packed_table(rows: list[dict], keys: list[str]) -> pa.Table:
    kinds = dict.fromkeys(keys, pa.int32()) | {
        "nodes": pa.int32(), "code": pa.binary(), "missing_left": pa.binary(), "sums": pa.binary(),
        "feature": pa.list_(pa.int32()), "gain": pa.list_(pa.float64()), "splits": pa.list_(pa.int64()),
    }
    return pa.table({k: pa.array([r[k] for r in rows], kind) for k, kind in kinds.items()})


def tree_of(row: dict, width: int, rules: Rules) -> Tree:
    """The tree in a row: the children of the k-th split are nodes 2 k + 1 and 2 k + 2."""
    code = numbers_in(row["code"])
    inner = np.flatnonzero(code >= 0)
    left, missing, gain = np.full(len(code), -1), np.zeros(len(code), bool), np.zeros(len(code))
    left[inner] = 1 + 2 * np.arange(len(inner))
    missing[inner] = np.unpackbits(np.frombuffer(row["missing_left"], np.uint8), count=len(inner)).astype(bool)
    sums, at = np.zeros((len(code), width), np.int64), 8 * width
    for c, size in enumerate(np.frombuffer(row["sums"], "<i8", count=width)):
        sums[code < 0, c] = numbers_in(row["sums"][at : at + size])
        at += size
    begins = [0, 1]  # of the levels
    while begins[-1] < len(code):
        begins.append(begins[-1] + 2 * int((code[begins[-2] : begins[-1]] >= 0).sum()))
        if begins[-1] == begins[-2]:
            break
    for low, high in reversed(list(zip(begins, begins[1:]))):
        own = inner[np.searchsorted(inner, low) : np.searchsorted(inner, high)]
        sums[own] = sums[left[own]] + sums[left[own] + 1]
    gain[inner] = rules.score(sums[left[inner]]) + rules.score(sums[left[inner] + 1]) - rules.score(sums[inner])
    return Tree(code, missing, left, sums, gain)


def best_splits(
    slot: np.ndarray, code: np.ndarray, sums: np.ndarray, totals: np.ndarray, salts: np.ndarray, rules: Rules, bins: Bins
) -> dict[str, np.ndarray]:
    """The best split of each slot from its sums per bin, sorted by (slot, code): code, missing_left, gain, left sums.

    ``code`` is -1 where no split helps.  Equal gains go to the smaller bin.
    """
    n = len(totals)
    out = {"code": np.full(n, -1, np.int64), "missing_left": np.zeros(n, bool), "gain": np.zeros(n), "left": np.zeros_like(totals)}
    if not len(slot):
        return out
    feature = bins.feature(code)
    new = np.ones(len(slot), bool)
    new[1:] = (slot[1:] != slot[:-1]) | (feature[1:] != feature[:-1])
    part = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    run = np.cumsum(sums, axis=0)
    left = run - (run[first] - sums[first])[part]
    missing = totals[slot] - np.add.reduceat(sums, first, axis=0)[part]
    # rows without a bin may go left too, unless nothing is left on the right then: a feature of one bin
    either = np.flatnonzero((missing[:, 0] > 0) & (sums[:, 0] < totals[slot, 0] - missing[:, 0]))
    half = len(slot)
    source = np.concatenate([np.arange(half), either])
    sides = np.concatenate([left, left[either] + missing[either]])
    where = slot[source]
    rest = totals[where] - sides
    least = max(rules.min_weight, rules.units[0] * 0.5)
    fits = (sides[:, 0] * rules.units[0] >= least) & (rest[:, 0] * rules.units[0] >= least)
    whole = rules.score(totals)
    gain = np.where(fits, rules.score(sides) + rules.score(rest) - whole[where], -np.inf)
    if rules.some is not None:  # the first features, in the node's own order, that can split it
        able = np.zeros(len(first), bool)
        able[part[source[fits]]] = True
        rank_key = mixed(feature[first].astype(U64) ^ salts[slot[first]], 7)
        order = np.lexsort((rank_key, ~able, slot[first]))
        ordered_slot = slot[first][order]
        begin = np.searchsorted(ordered_slot, ordered_slot, "left")
        drawn = np.zeros(len(first), bool)
        drawn[order] = np.arange(len(first)) - begin < rules.some
        gain = np.where(drawn[part[source]], gain, -np.inf)
    side_at = np.arange(half)  # the better of both sides
    better = gain[half:] > gain[either]
    side_at[either[better]] = half + np.flatnonzero(better)
    gain = gain[side_at]
    begins = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    most = np.full(n, -np.inf)
    most[slot[begins]] = np.maximum.reduceat(gain, begins)
    at = np.flatnonzero(gain == most[slot])
    at = at[np.concatenate([[True], slot[at][1:] != slot[at][:-1]])]  # the smallest bin of each slot
    top = np.zeros(n, np.int64)
    top[slot[at]] = at
    gain = most
    floor = -1e-9 * np.abs(whole) if rules.counts else rules.min_gain + 1e-12 * np.abs(whole)
    good = np.isfinite(gain) & (gain > floor)
    if rules.counts:
        good &= totals[:, 1:].max(axis=1) < totals[:, 0]  # a pure node is done
    chosen = top[good]
    out["code"][good] = code[chosen]
    out["missing_left"][good] = side_at[chosen] >= half
    out["gain"][good] = gain[good]
    out["left"][good] = sides[side_at[chosen]]
    return out


def sums_per_bin(key: np.ndarray, stats: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their rows of ``stats``."""
    if size <= 4 * len(key) + 100_000 and float(np.abs(stats).max(initial=0)) * max(len(key), 1) < 2**52:
        held = np.flatnonzero(np.bincount(key, minlength=size))
        sums = np.stack([np.bincount(key, stats[:, s], size)[held] for s in range(stats.shape[1])], axis=1)
        return held, sums.astype(np.int64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(stats[order], first, axis=0) if len(key) else stats[:0]


def child_salts(salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return mixed(salts, 1), mixed(salts, 2)


def grown(codes: np.ndarray, starts: np.ndarray, stats: np.ndarray, rules: Rules, bins: Bins, salt: int, depth: int = 0) -> tuple[Tree, np.ndarray]:
    """A whole tree over rows in memory, level by level; also the leaf of every row.

    The entries (row, bin) are sorted by bin once and dealt stably to the nodes
    of each level, so they stay in the order that the sums need.
    """
    n = len(stats)
    order = np.argsort(codes, kind="stable")
    row, code = np.repeat(np.arange(n, dtype=np.int32), np.diff(starts))[order], codes[order].astype(np.int32)
    columns = np.ascontiguousarray(stats.T)
    node = np.zeros(n, np.int64)
    parts = [{"code": np.array([-1]), "missing_left": np.array([False]), "left": np.array([-1]), "gain": np.zeros(1)}]
    sums = [stats.sum(axis=0, keepdims=True)]
    live, salts, count = np.zeros(1, np.int64), np.array([salt % (1 << 64)], U64), 1
    totals, current, slot = sums[0], parts[0], np.zeros(n, np.int32)  # the place of a row's node in live, -1 once it is done
    while len(live) and (rules.depth is None or depth < rules.depth):
        own = slot[row]
        new = np.ones(len(row), bool)
        new[1:] = (own[1:] != own[:-1]) | (code[1:] != code[:-1])
        first = np.flatnonzero(new)
        held = np.stack([np.add.reduceat(c[row], first) for c in columns], axis=1) if len(first) else stats[:0]
        found = best_splits(own[first], code[first], held, totals, salts, rules, bins)
        splits = np.flatnonzero(found["code"] >= 0)
        at = live[splits] - (count - len(current["code"]))  # every live node is in the last part
        current["code"][at], current["missing_left"][at], current["gain"][at] = (found[x][splits] for x in ("code", "missing_left", "gain"))
        current["left"][at] = count + 2 * np.arange(len(splits))
        if not len(splits):
            break
        child = np.full(len(live), -1, np.int64)
        child[splits] = 2 * np.arange(len(splits))
        rows = np.flatnonzero(slot >= 0)
        goes_left = found["missing_left"][slot]  # of rows that are done: any value
        lowest, last = bins.span(np.maximum(found["code"], 0))
        decides = (code >= lowest[own]) & (code < last[own]) & (child[own] >= 0)
        goes_left[row[decides]] = code[decides] <= found["code"][own[decides]]
        to = child[slot[rows]]
        to = np.where(to < 0, -1, to + ~goes_left[rows])
        node[rows[to >= 0]] = count + to[to >= 0]
        low, high = found["left"][splits], totals[splits] - found["left"][splits]
        totals = np.stack([low, high], axis=1).reshape(-1, stats.shape[1])
        salts = np.stack(child_salts(salts[splits]), axis=1).ravel()
        parts.append({"code": np.full(len(totals), -1), "missing_left": np.zeros(len(totals), bool), "left": np.full(len(totals), -1), "gain": np.zeros(len(totals))})
        current = parts[-1]
        sums.append(totals)
        # a node of one row, or of one class, is done
        open_ = np.bincount(to[to >= 0], minlength=len(totals)) > 1
        if rules.counts:
            open_ &= totals[:, 1:].max(axis=1) < totals[:, 0]
        slot[rows] = np.where((to >= 0) & open_[to], to, -1)
        row, code = dealt(row, code, slot[row], len(totals))
        place = np.append(np.cumsum(open_) - 1, -1)
        slot[rows] = place[slot[rows]]
        live, totals, salts = count + np.flatnonzero(open_), totals[open_], salts[open_]
        count += len(open_)
        depth += 1
    joined = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    return Tree(sums=np.concatenate(sums), **joined), node


def dealt(row: np.ndarray, code: np.ndarray, to: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries in the order of the parents' slots, to that of their children (2 k and 2 k + 1); -1 are left out."""
    size = np.bincount(to[to >= 0], minlength=slots)
    start = np.cumsum(size) - size
    order = np.empty(int(size.sum()), np.int64)
    for side in (0, 1):
        chosen = np.flatnonzero((to >= 0) & (to & 1 == side))
        own, inside = to[chosen], size[side::2]
        order[start[own] + np.arange(len(chosen)) - (np.cumsum(inside) - inside)[own >> 1]] = chosen
    return row[order], code[order]


#: Cells of the table that finds a row's bin of a feature at once.
TABLE_CELLS = 30_000_000


def lookup(codes: np.ndarray, starts: np.ndarray, bins: Bins) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of (rows, features) that gives the bin of each, -1 where there is none."""
    n = len(starts) - 1
    row, feature = np.repeat(np.arange(n), np.diff(starts)), bins.feature(codes)
    if n * bins.size <= TABLE_CELLS:
        table = np.full((n, bins.size), -1, np.int32)
        table[row, feature] = codes
        return lambda rows, features: table[rows, features]
    key = row * bins.size + feature  # rises, as bins rise inside a row

    def found(rows: np.ndarray, features: np.ndarray) -> np.ndarray:
        wanted = rows * bins.size + features
        at = np.searchsorted(key, wanted).clip(max=max(len(key) - 1, 0))
        return np.where(key[at] == wanted, codes[at], -1) if len(key) else np.full(len(wanted), -1)

    return found


def leaves_of(tree: Tree, rows: np.ndarray, bins: Bins, bin_at: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The node of a tree in which each of ``rows`` ends."""
    node = np.zeros(len(rows), np.int64)
    split_feature = bins.feature(np.maximum(tree.code, 0))
    left_at = np.arange(len(rows)) if tree.code[0] >= 0 else np.zeros(0, np.int64)
    while len(left_at):
        at = node[left_at]
        found = bin_at(rows[left_at], split_feature[at])
        left = np.where(found < 0, tree.missing_left[at], found <= tree.code[at])
        node[left_at] = tree.left[at] + ~left
        left_at = left_at[tree.code[node[left_at]] >= 0]
    return node


# --- growth on the cluster ----------------------------------------------------

#: The rows of a batch that each tree takes, and their sums: (tree, rows, stats).
Stats = Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray, np.ndarray]]]


def coded(prepared: DataFrame, bins: Bins, *more: str) -> DataFrame:
    """key, label, ``more`` and the bins of the rows."""
    kept = ["key", "label", *more]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, starts = bins.codes(batch.column("features"))
            made = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(codes, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), made], [*kept, "codes"])

    fields = ", ".join(f"{c} {prepared.schema[c].dataType.simpleString()}" for c in kept)
    return prepared.select(vector_parts("features"), *kept).mapInArrow(work, f"{fields}, codes array<int>")


def codes_of(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("codes")
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    return pc.list_flatten(column).to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def picked(codes: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bins of some rows."""
    sizes = starts[rows + 1] - starts[rows]
    ends = np.cumsum(sizes)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[rows] - (ends - sizes), sizes)
    return codes[at], np.concatenate([[0], ends])


def list_column(flat: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat, kind))


@dataclass
class Top:
    """The upper part of a tree while it grows: ``open`` nodes are still to split, by the number of their rows."""

    tree: Tree
    salts: dict[int, int]
    depth: dict[int, int]
    open: dict[int, int] = field(default_factory=dict)


#: Bytes of sums that a task adds up over its batches before it hands them on.
DENSE_BYTES = 64 << 20
#: Rows that are stored as one block, at most.
BLOCK_ROWS = 10_000
#: Rows that a task of a boosting round takes, at most.
TASK_ROWS = 200_000


def in_tasks(df: DataFrame, rows: int) -> DataFrame:
    """Rows that are read again and again in a task for each core, and in more where a task would get more than TASK_ROWS.

    Else each of many steps would cost a task for every shuffle partition, however few rows those hold.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS)))
#: Bins whose sums are merged in one group before a node's split is chosen.
SLICE = 1 << 16


def upper_levels(
    rows: DataFrame, stats_of: Stats, trees: int, width: int, n: int, rules: Rules, bins: Bins, salt: Callable[[int], int],
    least: int | None = None, opened: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter,
) -> list[Top]:
    """Grow all trees together, a level an aggregate, until every open node has ``least`` rows (SMALL_ROWS) or fewer.

    ``opened`` gives the batches of rows where ``rows`` holds them in another form.
    """
    least = SMALL_ROWS if least is None else least
    tops = [Top(Tree.empty(width), {0: salt(t)}, {0: 0}, {0: n}) for t in range(trees)]
    while True:
        wide = [np.array([x for x, size in top.open.items() if size > least], np.int64) for top in tops]
        if not any(len(w) for w in wide):
            return tops
        shapes = [top.tree for top in tops]
        dense = sum(map(len, wide)) * (bins.total + 1) * (width + 1) * 8 <= DENSE_BYTES

        def count(batches: Iterator[pa.RecordBatch], shapes=shapes, wide=wide, dense=dense) -> Iterator[pa.RecordBatch]:
            cells = bins.total + 1  # of a node; the first one is the whole node
            added = {t: np.zeros((len(w) * cells, width + 1), np.int64) for t, w in enumerate(wide) if len(w)} if dense else {}

            def told(t: int, key: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
                """A row for each node and slice of its bins, from keys in order."""
                code = key % cells - 1
                group = key // cells * (bins.total // SLICE + 1) + np.maximum(code, 0) // SLICE
                first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                starts = np.append(first, len(key))
                columns = [pa.array(np.full(len(first), t), pa.int32()), pa.array(wide[t][key[first] // cells], pa.int32())]
                columns += [pa.array(np.maximum(code[first], 0) // SLICE, pa.int32())]
                columns += [list_column(code, starts, pa.int32()), list_column(sums.ravel(), starts * (width + 1), pa.int64())]
                return pa.RecordBatch.from_arrays(columns, ["tree", "node", "slice", "codes", "sums"])

            for batch in opened(batches):
                codes, starts = codes_of(batch)
                bin_at = lookup(codes, starts, bins)
                for t, at, stats in stats_of(batch):
                    if not len(wide[t]):
                        continue
                    leaf = leaves_of(shapes[t], at, bins, bin_at)
                    slots = np.full(len(shapes[t].code), -1)
                    slots[wide[t]] = np.arange(len(wide[t]))
                    kept = slots[leaf] >= 0
                    if not kept.any():
                        continue
                    at, slot = at[kept], slots[leaf[kept]]
                    stats = np.column_stack([stats[kept], np.ones(len(at), np.int64)])
                    own, own_starts = picked(codes, starts, at)
                    row = np.repeat(np.arange(len(at)), np.diff(own_starts))
                    key = np.concatenate([slot * cells, slot[row] * cells + own + 1])
                    held, sums = sums_per_bin(key, stats[np.concatenate([np.arange(len(at)), row])], len(wide[t]) * cells)
                    if dense:
                        added[t][held] += sums
                    else:
                        yield told(t, held, sums)
            for t, sums in added.items():
                held = np.flatnonzero(sums[:, -1])
                if len(held):
                    yield told(t, held, sums[held])

        def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            code = pc.list_flatten(table["codes"]).to_numpy().astype(np.int64)
            sums = pc.list_flatten(table["sums"]).to_numpy().reshape(-1, width + 1)
            key, sums = sums_per_bin(code + 1, sums, bins.total + 1)
            return key - 1, sums

        def merge(table: pa.Table) -> pa.Table:
            code, sums = merged(table)
            lists = [list_column(code, np.array([0, len(code)]), pa.int32()), list_column(sums.ravel(), np.array([0, sums.size]), pa.int64())]
            return pa.table([*(table[c].slice(0, 1) for c in ("tree", "node", "slice")), *lists], ["tree", "node", "slice", "codes", "sums"])

        kind = "tree int, node int, slice int, codes array<int>, sums array<bigint>"
        held = rows.mapInArrow(count, kind)
        if bins.total > SLICE:
            held = held.groupBy("tree", "node", "slice").applyInArrow(merge, kind)
        salts = [{x: top.salts[x] for x in wide[t].tolist()} for t, top in enumerate(tops)]

        def choose(table: pa.Table) -> pa.Table:
            t, x = table["tree"][0].as_py(), table["node"][0].as_py()
            code, sums = merged(table)
            code, sums, total, n_rows = code[1:], sums[1:], sums[:1, :-1], int(sums[0, -1])  # the first row is the whole node's
            found = best_splits(np.zeros(len(code), np.int64), code, sums[:, :-1], total, np.array([salts[t][x]], U64), rules, bins)
            low, high = bins.span(np.maximum(found["code"], 0))
            known = (code >= low[0]) & (code < high[0])
            n_left = int(sums[known & (code <= found["code"][0]), -1].sum())
            if found["missing_left"][0]:
                n_left += n_rows - int(sums[known, -1].sum())
            return pa.table({
                "tree": pa.array([t], pa.int32()), "node": pa.array([x], pa.int32()), "code": pa.array(found["code"], pa.int32()),
                "missing_left": pa.array(found["missing_left"]), "gain": pa.array(found["gain"]),
                "left": pa.array([found["left"][0].tolist()], pa.list_(pa.int64())), "total": pa.array([total[0].tolist()], pa.list_(pa.int64())),
                "n_rows": pa.array([n_rows], pa.int64()), "n_left": pa.array([n_left], pa.int64()),
            })

        schema = "tree int, node int, code int, missing_left boolean, gain double, left array<bigint>, total array<bigint>, n_rows bigint, n_left bigint"
        found = held.groupBy("tree", "node").applyInArrow(choose, schema).collect()  # a row per node of the upper levels
        for w, top in zip(wide, tops):  # a node that no row is in any more
            for x in set(w.tolist()) - {r.node for r in found if tops[r.tree] is top}:
                top.open.pop(x)
        for r in sorted(found, key=lambda r: (r.tree, r.node)):
            top = tops[r.tree]
            x = r.node
            top.open.pop(x)
            tree = top.tree
            tree.sums[x] = r.total
            depth = top.depth[x]
            if r.code < 0 or (rules.depth is not None and depth >= rules.depth):
                continue
            if r.n_rows <= least:  # a tree's bag may leave rows out
                top.open[x] = r.n_rows
                continue
            at = len(tree.code)
            tree.code[x], tree.missing_left[x], tree.left[x], tree.gain[x] = r.code, r.missing_left, at, r.gain
            low = np.array(r.left, np.int64)
            top.tree = Tree(
                np.append(tree.code, [-1, -1]), np.append(tree.missing_left, [False, False]), np.append(tree.left, [-1, -1]),
                np.concatenate([tree.sums, [low, np.array(r.total) - low]]), np.append(tree.gain, [0.0, 0.0]),
            )
            for i, s in enumerate(child_salts(np.array([top.salts[x]], U64))):
                top.salts[at + i], top.depth[at + i] = int(s[0]), depth + 1
                top.open[at + i] = r.n_rows - r.n_left if i else r.n_left
        for t, top in enumerate(tops):  # nodes that reached the depth
            for x in [x for x, d in top.depth.items() if x in top.open and rules.depth is not None and d >= rules.depth]:
                top.open.pop(x)


#: Tasks that finish nodes, at most.
GROW_TASKS = 400
#: Rows that a task gathers before it hands them to the nodes that they fall into.
SEND_ROWS = 200_000


def bundles(node: np.ndarray, codes: np.ndarray, starts: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes, bytes, list[bytes]]]:
    """For each node its rows in few bytes: sizes and bins of the rows, and the columns."""
    order = np.argsort(node, kind="stable")
    codes, starts = picked(codes, starts, order)
    sizes, node = np.diff(starts), node[order]
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else []
    for a, b in zip(first, [*first[1:], len(node)]):
        yield int(node[a]), shortest(sizes[a:b]), shortest(codes[starts[a] : starts[b]]), [shortest(c[order[a:b]]) for c in columns]


def unbundled(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The bins of the rows in bundles, and where each row starts."""
    sizes = np.concatenate([numbers_in(x) for x in table["sizes"].to_pylist()])
    return np.concatenate([numbers_in(x) for x in table["codes"].to_pylist()]), np.concatenate([[0], np.cumsum(sizes)])


def distinct_rows(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The first of the rows of each list of bins, and which of these every row equals; None for rows of several sizes."""
    n = len(starts) - 1
    sizes = np.diff(starts)
    if not n or not sizes[0] or (sizes != sizes[0]).any():
        return None
    matrix = codes.reshape(n, -1)
    order = np.lexsort(matrix.T[::-1])
    new = np.ones(n, bool)
    new[1:] = (matrix[order[1:]] != matrix[order[:-1]]).any(axis=1)
    same = np.empty(n, np.int64)
    same[order] = np.cumsum(new) - 1
    return order[new], same


def finished(
    rows: DataFrame, stats_of: Stats, tops: list[Top], width: int, rules: Rules, bins: Bins,
    opened: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter,
) -> DataFrame:
    """(tree, node, subtree): every open node grown to its end inside one task."""
    shapes = [(top.tree, np.isin(np.arange(len(top.tree.code)), list(top.open))) for top in tops]
    kind = "tree int, node int, sizes binary, codes binary, stats array<binary>"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(gathered: dict[int, list]) -> pa.RecordBatch:
            out = []
            for t, parts in gathered.items():
                leaf, codes, sizes, stats = (np.concatenate(x) for x in zip(*parts))
                starts = np.concatenate([[0], np.cumsum(sizes)])
                out += [(t, *x) for x in bundles(leaf, codes, starts, list(stats.T))]
            columns = list(zip(*out))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["tree", "node", "sizes", "codes", "stats"])

        gathered: dict[int, list] = {}
        held = 0
        for batch in opened(batches):
            codes, starts = codes_of(batch)
            bin_at = lookup(codes, starts, bins)
            for t, at, stats in stats_of(batch):
                shape, is_open = shapes[t]
                leaf = leaves_of(shape, at, bins, bin_at)
                kept = np.flatnonzero(is_open[leaf])
                if not len(kept):
                    continue
                own, own_starts = picked(codes, starts, at[kept])
                gathered.setdefault(t, []).append((leaf[kept], own.astype(np.int32), np.diff(own_starts), stats[kept]))
                held += len(kept) + len(own) // 8
                if held >= SEND_ROWS:
                    yield sent(gathered)
                    gathered, held = {}, 0
        if gathered:
            yield sent(gathered)

    salts = [{x: (top.salts[x], top.depth[x]) for x in top.open} for top in tops]

    def grow(table: pa.Table) -> pa.Table:
        t, x = table["tree"][0].as_py(), table["node"][0].as_py()
        codes, starts = unbundled(table)
        parts = table["stats"].to_pylist()
        stats = np.column_stack([np.concatenate([numbers_in(p[c]) for p in parts]) for c in range(width)])
        found = distinct_rows(codes, starts)
        if found is not None:  # rows of the same bins stay together
            first, same = found
            codes, starts = picked(codes, starts, first)
            order = np.argsort(same, kind="stable")
            stats = np.add.reduceat(stats[order], np.searchsorted(same[order], np.arange(len(first))), axis=0)
        salt, depth = salts[t][x]
        tree, _ = grown(codes, starts, stats, rules, bins, salt, depth)
        return packed_table([packed(tree, {"tree": t, "node": x}, bins)], ["tree", "node"])

    # few bytes are much work here: without a number of its own, Spark would put all of it in a few tasks
    parts = max(1, min(sum(len(top.open) for top in tops), GROW_TASKS))
    sent = rows.mapInArrow(send, kind).repartition(parts, "tree", "node")
    return sent.groupBy("tree", "node").applyInArrow(grow, f"tree int, node int, {TREE_FIELDS}")


def grafted(top: Tree, below: dict[int, Tree]) -> Tree:
    """One tree from its upper part and the subtrees of its open nodes."""
    parts, at = [top], len(top.code)
    code, missing, left, sums, gain = (getattr(top, f).copy() for f in Tree.FIELDS)
    for x, sub in sorted(below.items()):
        shift = at - 1  # the subtree's root takes the place of the open node
        code[x], missing[x], sums[x], gain[x] = sub.code[0], sub.missing_left[0], sub.sums[0], sub.gain[0]
        left[x] = sub.left[0] + shift if sub.code[0] >= 0 else -1
        moved = np.where(sub.left >= 0, sub.left + shift, -1)
        parts.append(Tree(sub.code[1:], sub.missing_left[1:], moved[1:], sub.sums[1:], sub.gain[1:]))
        at += len(sub.code) - 1
    parts[0] = Tree(code, missing, left, sums, gain)
    return Tree(*(np.concatenate([getattr(p, f) for p in parts]) for f in Tree.FIELDS))


def grid(rows: int, bits: int = GRID_BITS) -> int:
    """Bits of the grid on which sums over ``rows`` rows stay exact in doubles as well."""
    return max(min(bits, 48 - max(rows, 2).bit_length()), 8)


# --- models -------------------------------------------------------------------


class TreeEnsemble(Model):
    """Adds ``prediction``, and ``probability`` for classes.

    A model of up to MODEL_BYTES is sent to the tasks.  A larger one stays a
    table of subtrees: each row is sent to the subtree of every tree that it
    falls into, and what comes back is added up per row.
    """

    def __init__(self, bins: Bins, classes: int | None, boosted: bool, start: np.ndarray, scale: Callable[[np.ndarray], np.ndarray]):
        super().__init__()
        self.bins, self.classes, self.boosted, self.start, self.scale = bins, classes, boosted, start, scale
        self.trees: list[Tree] | None = None
        self.tops: list[Top] = []
        self.table: DataFrame | None = None
        self.width = 0
        self.rules: Rules | None = None

    @property
    def margins(self) -> int:
        return len(self.start)

    def keep(self, tops: list[Top], subtrees: DataFrame, width: int, rules: Rules) -> "TreeEnsemble":
        """Take the grown trees, in memory if they are small enough."""
        self.tops, self.width, self.rules = tops, width, rules
        self.table = stable(subtrees)
        nodes = self.table.agg(F.coalesce(F.sum("nodes"), F.lit(0))).first()[0]
        if nodes * (9 + 8 * (width + 1)) <= MODEL_BYTES:
            below: list[dict[int, Tree]] = [{} for _ in tops]
            for r in self.table.toArrow().to_pylist():
                below[r["tree"]][r["node"]] = tree_of(r, width, rules)
            self.trees = [grafted(top.tree, subs) for top, subs in zip(tops, below)]
        return self

    def _parts(self, trees: list[tuple[int, Tree]], codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """What the trees add for each row, per margin."""
        out = np.zeros((len(starts) - 1, self.margins))
        bin_at = lookup(codes, starts, self.bins)
        rows = np.arange(len(out))
        for t, tree in trees:
            value = self.scale(tree.sums)[leaves_of(tree, rows, self.bins, bin_at)]
            if self.boosted:
                out[:, t % self.margins] += value[:, 0]
            else:
                out += value
        return out

    def _finish(self, total: np.ndarray, trees: int) -> np.ndarray:
        """Margins or votes to the prediction, followed by the probability of each class."""
        total = self.start + (total if self.boosted else total / max(trees, 1))
        if self.classes is None:
            return total
        if self.boosted and self.margins == 1:
            p = 1 / (1 + np.exp(-total))
            total = np.hstack([1 - p, p])
        elif self.boosted:
            total = np.exp(total - total.max(axis=1, keepdims=True))
        total = total / total.sum(axis=1, keepdims=True)
        return np.hstack([total.argmax(axis=1)[:, None], total])

    def _transform(self, df: DataFrame) -> DataFrame:
        told = self._told(df) if self.trees is not None else self._told_by_table(df)
        out = told.withColumn("prediction", F.get("__told", F.lit(0)))
        if self.classes is not None:
            out = out.withColumn("probability", array_to_vector(F.slice("__told", 2, self.classes)))
        return out.drop("__told")

    def _light(self) -> "TreeEnsemble":
        """A copy without tables, to send to tasks."""
        light = TreeEnsemble(self.bins, self.classes, self.boosted, self.start, self.scale)
        light.width, light.rules = self.width, self.rules
        return light

    def _told(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self._light(), self.trees))

        @F.arrow_udf("array<double>")
        def told(features: pa.Array) -> pa.Array:
            model, trees = shared.value
            codes, starts = model.bins.codes(struct_of(features))
            found = distinct_rows(codes, starts)  # rows of the same bins are told once
            if found is not None:
                codes, starts = picked(codes, starts, found[0])
            made = model._finish(model._parts(list(enumerate(trees)), codes, starts), len(trees))
            made = made[found[1]] if found is not None else made
            return list_column(made.ravel(), np.arange(len(made) + 1) * made.shape[1], pa.float64())

        return df.withColumn("__told", told(vector_parts("features")))

    def _told_by_table(self, df: DataFrame) -> DataFrame:
        df = stable(df.withColumn("__row", F.monotonically_increasing_id()))
        rows = coded(df.select("features", F.col("__row").alias("key"), F.lit(0.0).alias("label")), self.bins)
        shapes, light, width, trees = [top.tree for top in self.tops], self._light(), self.width, len(self.tops)
        names = ["block", "tree", "node", "n", "sizes", "codes", "at", "part"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        kind = "block bigint, tree int, node int, n bigint, sizes binary, codes binary, at binary, part binary"

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A block is the rows of a batch: its keys (tree -1), and for every subtree the rows that fall into it."""
            for i, batch in enumerate(batches):
                block = (TaskContext.get().partitionId() << 32) + i
                codes, starts = codes_of(batch)
                bin_at = lookup(codes, starts, light.bins)
                every = np.arange(batch.num_rows)
                out = [(block, -1, block % (1 << 31), len(every), None, None, None, batch.column("key").to_numpy().astype("<i8").tobytes())]
                for t, shape in enumerate(shapes):
                    leaf = leaves_of(shape, every, light.bins, bin_at)
                    for x, sizes, own, (at,) in bundles(leaf, codes, starts, [every]):
                        out.append((block, t, x, len(numbers_in(at)), sizes, own, at, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        def answer(left: pa.Table, right: pa.Table) -> pa.Table:
            left = left.select(names)
            if not left.num_rows or left["tree"][0].as_py() < 0:
                return left
            t, x = left["tree"][0].as_py(), left["node"][0].as_py()
            codes, starts = unbundled(left)
            if right.num_rows:
                part = light._parts([(t, tree_of(right.to_pylist()[0], width, light.rules))], codes, starts)
            else:  # the upper part ends here
                part = np.zeros((len(starts) - 1, light.margins))
                value = light.scale(shapes[t].sums[x : x + 1])[0]
                part[:, slice(t % light.margins, t % light.margins + 1) if light.boosted else slice(None)] = value
            ends = np.cumsum(left["n"].to_numpy())
            parts = [p.astype("<f8").tobytes() for p in np.split(part, ends[:-1])]
            none = pa.nulls(left.num_rows, pa.binary())
            return pa.table([*(left[c] for c in names[:4]), none, none, left["at"], pa.array(parts, pa.binary())], names)

        def add(table: pa.Table) -> pa.Table:
            table = table.sort_by([("tree", "ascending"), ("node", "ascending")])
            keys, *parts = zip(table["at"].to_pylist(), table["part"].to_pylist())
            key = np.frombuffer(keys[1], "<i8")
            total = np.zeros((len(key), light.margins))
            for at, part in parts:
                total[numbers_in(at)] += np.frombuffer(part, "<f8").reshape(-1, light.margins)
            made = light._finish(total, trees)
            told = list_column(made.ravel(), np.arange(len(made) + 1) * made.shape[1], pa.float64())
            return pa.table({"__row": pa.array(key, pa.int64()), "__told": told})

        sent = rows.mapInArrow(send, kind)
        # where many rows fall into one subtree they are dealt out, and the subtree goes to each share
        sent = sent.persist(StorageLevel.DISK_ONLY)
        hot = sent.where("tree >= 0").groupBy("tree", "node").agg(F.sum("n").alias("n")).where(F.col("n") > SMALL_ROWS)
        hot = stable(hot.select("tree", "node", F.ceil(F.col("n") / SMALL_ROWS).alias("shares")))
        shares = F.coalesce("shares", F.lit(1).cast("bigint"))
        blocks = sent.join(F.broadcast(hot), ["tree", "node"], "left").withColumn("share", F.pmod(F.xxhash64("block"), shares))
        subtrees = self.table.join(F.broadcast(hot), ["tree", "node"], "left")
        subtrees = subtrees.withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), shares - 1))).drop("shares")
        by = ("tree", "node", "share")
        parts = blocks.select(*names, "share").groupBy(*by).cogroup(subtrees.groupBy(*by)).applyInArrow(answer, kind)
        fields = "__row bigint, __told array<double>"
        told = stable(parts.groupBy("block").applyInArrow(add, fields))
        sent.unpersist()
        return df.join(told, "__row").drop("__row")

    def importances(self) -> np.ndarray:
        """The share of each feature in the gains, also of a model that is too large for the driver."""
        if self.trees is not None:
            return self._gain_per_feature()
        spark = self.table.sparkSession
        top = []
        for t, x in enumerate(self.tops):
            inner = x.tree.code >= 0
            top += zip([t] * int(inner.sum()), self.bins.feature(x.tree.code[inner]).tolist(), x.tree.gain[inner].tolist())
        each = self.table.select("tree", F.inline(F.arrays_zip("feature", "gain")))
        if top:
            each = each.unionByName(spark.createDataFrame(top, "tree int, feature int, gain double"))
        each = each.groupBy("tree", "feature").agg(F.sum("gain").alias("gain"))
        whole = each.groupBy("tree").agg(F.sum("gain").alias("whole"))
        each = each.join(whole, "tree").groupBy("feature").agg(F.sum(F.col("gain") / F.greatest("whole", F.lit(1e-300))).alias("gain"))
        gains = np.zeros(self.bins.size)
        for r in each.collect():  # a row per feature
            gains[r.feature] = r.gain
        return gains / gains.sum() if gains.sum() > 0 else gains

    def _gain_per_feature(self) -> np.ndarray:
        """Forests: each tree's gains as shares, averaged. Boosting: the mean gain of a feature's splits."""
        gains, splits = np.zeros(self.bins.size), np.zeros(self.bins.size)
        for tree in self.trees or []:
            inner = tree.code >= 0
            feature = self.bins.feature(tree.code[inner])
            own = np.bincount(feature, tree.gain[inner], self.bins.size)
            splits += np.bincount(feature, minlength=self.bins.size)
            gains += own if self.boosted else own / max(own.sum(), 1e-300)
        if self.boosted:
            gains = gains / np.maximum(splits, 1)
        return gains / gains.sum() if gains.sum() > 0 else gains

    @property
    def featureImportances(self):
        if self.margins > 1 and self.boosted:
            raise AttributeError("a boosted model of several classes has none of its own")
        if self.trees is None:
            raise AttributeError("the trees are too large for the driver")
        return Vectors.dense(self._gain_per_feature())


class ClassShares:
    """Shares of the classes among the rows of a node."""

    def __call__(self, sums: np.ndarray) -> np.ndarray:
        return sums[:, 1:] / np.maximum(sums[:, :1], 1)


@dataclass
class MeanValue:
    unit: float

    def __call__(self, sums: np.ndarray) -> np.ndarray:
        return sums[:, 1:] * self.unit / np.maximum(sums[:, :1], 1)


@dataclass
class NewtonStep:
    units: tuple[float, ...]
    smooth: float
    step: float

    def __call__(self, sums: np.ndarray) -> np.ndarray:
        return -self.step * sums[:, 1:] * self.units[1] / (sums[:, :1] * self.units[0] + self.smooth)


#: Rows that a task gathers before it puts those of the same bins and label together.
GATHER_ROWS = 200_000


def bags(batch: pa.RecordBatch | pa.Table, draw: Callable[[np.ndarray, int], np.ndarray], trees: int) -> Iterator[tuple[int, np.ndarray]]:
    """How often the rows behind each row of ``bagged`` are in the bag of each tree."""
    sizes = pc.list_value_length(batch.column("keys")).to_numpy(zero_copy_only=False)
    keys, row = pc.list_flatten(batch.column("keys")).to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
    summed = np.flatnonzero(pc.list_value_length(batch.column("draws")).to_numpy(zero_copy_only=False))
    draws = pc.list_flatten(batch.column("draws")).to_numpy().reshape(-1, trees)
    for t in range(trees):
        times = np.bincount(row, draw(keys, t), len(sizes)).astype(np.int64)
        times[summed] += draws[:, t]
        yield t, times


def bagged(rows: DataFrame, draw: Callable[[np.ndarray, int], np.ndarray], trees: int, n: int | None = None) -> DataFrame:
    """One row for all of the ``n`` rows of the same bins and label, with what the bags need of them.

    That is the ``keys`` of few rows, and of more than ``trees`` / 2 of them
    ``draws``, how often all of them together are in the bag of each tree.
    """
    most = max(trees // 2, 1)

    def shorter(table: pa.Table) -> pa.RecordBatch:
        """Rows with many keys turned to draws."""
        sizes = pc.list_value_length(table["keys"]).to_numpy()
        long = np.flatnonzero((sizes > most) | (pc.list_value_length(table["draws"]).to_numpy() > 0))
        draws = np.zeros((len(long), trees), np.int64)
        for t, times in bags(table.take(long), draw, trees):
            draws[:, t] = times
        is_long = np.zeros(len(sizes), bool)
        is_long[long] = True
        keys = pc.list_flatten(table["keys"]).to_numpy()[~np.repeat(is_long, sizes)]
        key_starts, draw_starts = (np.concatenate([[0], np.cumsum(x)]) for x in (np.where(is_long, 0, sizes), np.where(is_long, trees, 0)))
        columns = [struct_of(table["codes"]), struct_of(table["label"])]
        columns += [list_column(keys, key_starts, pa.int64()), list_column(draws.ravel(), draw_starts, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["codes", "label", "keys", "draws"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def together(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            codes, starts = codes_of(table)
            label = np.unique(table["label"].to_numpy(), return_inverse=True)[1]
            # the label as one more bin at the end of each row
            found = distinct_rows(np.insert(codes, starts[1:], label), starts + np.arange(len(starts)))
            first, same = found if found is not None else (np.arange(len(label)),) * 2
            order = np.argsort(same, kind="stable")
            key_starts = np.append(np.searchsorted(same[order], np.arange(len(first))), len(order))
            keys = list_column(table["key"].to_numpy()[order], key_starts, pa.int64())
            none = list_column(np.zeros(0, np.int64), np.zeros(len(first) + 1), pa.int64())
            one = table.take(first)
            return shorter(pa.table({"codes": one["codes"], "label": one["label"], "keys": keys, "draws": none}))

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows + len(pc.list_flatten(batch.column("codes"))) // 8
            if size >= GATHER_ROWS:
                yield together(held)
                held, size = [], 0
        if held:
            yield together(held)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("parts")  # per row the draws of each task
            sums = np.zeros((batch.num_rows, trees), np.int64)
            inner = pc.list_flatten(lists)
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())
            np.add.at(sums, row, pc.list_flatten(inner).to_numpy().reshape(-1, trees))
            sizes = np.where(np.bincount(row, minlength=len(sums)) > 0, trees, 0)
            draws = list_column(sums[sizes > 0].ravel(), np.concatenate([[0], np.cumsum(sizes)]), pa.int64())
            yield shorter(pa.table({"codes": batch.column("codes"), "label": batch.column("label"), "keys": batch.column("keys"), "draws": draws}))

    kind = "codes array<int>, label double, keys array<bigint>, draws array<bigint>"
    parts = rows.mapInArrow(gather, kind).groupBy("codes", "label").agg(
        F.flatten(F.collect_list("keys")).alias("keys"), F.collect_list(F.when(F.size("draws") > 0, F.col("draws"))).alias("parts")
    )
    return (parts if n is None else in_tasks(parts, n)).mapInArrow(added, kind)


def label_range(rows: DataFrame) -> tuple[int, float, float]:
    """How many rows, the middle of the labels, and half their range (1 if they are all equal)."""
    n, low, high = rows.agg(F.count("*"), F.min("label"), F.max("label")).first()
    return n, ((low or 0.0) + (high or 0.0)) / 2, ((high or 0.0) - (low or 0.0)) / 2 or 1.0


@dataclass
class Forest:
    """Random forest: Poisson bags, nodes split until they are pure or no split helps."""

    trees: int
    classes: int | None  # None: a number is predicted
    seed: int

    def fit(self, prepared: DataFrame, numbers: int, size: int) -> TreeEnsemble:
        """Fit on ``features``, ``label`` and ``key`` (told apart rows); the first ``numbers`` of ``size`` features are numbers."""
        n, middle, half = label_range(prepared)
        bins = learnt_bins(prepared, numbers, size, n)
        trees, classes, seed = self.trees, self.classes, self.seed
        draw = lambda keys, t: poisson_one(keys, seed * 1_000_003 + t)
        rows = bagged(coded(prepared, bins), draw, trees, n).persist(StorageLevel.MEMORY_AND_DISK)
        if classes is not None:
            width, rules = classes + 1, Rules((1.0,) * (classes + 1), some=max(int(math.sqrt(size)), 1), counts=True)
            model = TreeEnsemble(bins, classes, False, np.zeros(classes), ClassShares())
        else:
            bits = grid(n)
            unit = half / (1 << bits)
            width, rules = 2, Rules((1.0, unit))
            model = TreeEnsemble(bins, None, False, np.array([middle]), MeanValue(unit))

        def stats_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            label = batch.column("label").to_numpy()
            if classes is not None:
                base = np.zeros((len(label), width), np.int64)
                base[np.arange(len(label)), 1 + label.astype(np.int64)] = 1
            else:
                base = np.zeros((len(label), 2), np.int64)
                base[:, 1] = np.round((label - middle) / unit)
            base[:, 0] = 1
            for t, times in bags(batch, draw, trees):
                at = np.flatnonzero(times)
                yield t, at, base[at] * times[at, None]

        salt = lambda t: int(mixed(np.array([t]), seed)[0])
        try:
            tops = upper_levels(rows, stats_of, trees, width, rows.count(), rules, bins, salt)
            return model.keep(tops, finished(rows, stats_of, tops, width, rules, bins), width, rules)
        finally:
            rows.unpersist()


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as one binary value: what is read once a level is handed to Python without a look at its rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, batch.schema) as stream:
                stream.write_batch(batch.slice(at, BLOCK_ROWS))
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["block"])


def rows_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch.column("block"):
            yield from pa.ipc.open_stream(block.as_buffer())


def slopes(margins: np.ndarray, label: np.ndarray, classes: int | None) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by each margin."""
    if classes is None:
        return margins - label[:, None], np.ones_like(margins)
    if margins.shape[1] == 1:
        p = 1 / (1 + np.exp(-margins))
        return p - label[:, None], np.maximum(p * (1 - p), 1e-16)
    p = np.exp(margins - margins.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return p - (label[:, None] == np.arange(margins.shape[1])), np.maximum(2 * p * (1 - p), 1e-16)


@dataclass
class Boosting:
    """Second-order boosting; the trees of all classes of a round grow together."""

    rounds: int
    classes: int | None
    depth: int = 6
    step: float = 0.3
    smooth: float = 1.0
    min_weight: float = 1.0

    def fit(self, prepared: DataFrame, numbers: int, size: int) -> TreeEnsemble:
        n, middle, half = label_range(prepared)
        bins = learnt_bins(prepared, numbers, size, n)
        # rows of the same bins and label go the same way: one row, counted
        rows = coded(prepared, bins).groupBy("codes", "label").agg(F.count("*").alias("n"))
        rows = in_tasks(rows, n).persist(StorageLevel.MEMORY_AND_DISK)
        margins = 1 if self.classes is None or self.classes == 2 else self.classes
        bits = grid(n)
        unit = (2 * half if self.classes is None else 1.0) / (1 << bits)
        units = (1.0 / (1 << bits) if self.classes is not None else 1.0, unit)
        rules = Rules(units, self.smooth, self.min_weight, 1e-6, self.depth)
        try:
            start = np.zeros(margins)
            if margins == 1:
                whole = F.sum(F.round((F.col("label") - middle) / unit).cast("bigint") * F.col("n"))
                mean = middle + (rows.agg(whole).first()[0] or 0) * unit / max(n, 1)
                mean = min(max(mean, 1e-6), 1 - 1e-6) if self.classes is not None else mean
                start[0] = mean if self.classes is None else math.log(mean / (1 - mean))
            model = TreeEnsemble(bins, self.classes, True, start, NewtonStep(units, self.smooth, self.step))
            model.width, model.rules = 2, rules
            distinct = rows.count()
            grow = self._whole if distinct * margins <= SMALL_ROWS else self._by_rounds
            model.trees = grow(rows, model, rules, distinct)
            return model
        finally:
            rows.unpersist()

    def _stats(self, margins: np.ndarray, label: np.ndarray, times: np.ndarray, units: tuple[float, ...]) -> np.ndarray:
        """(row, margin, [weight, gradient]) in grid units, of rows that occur so many times."""
        first, second = slopes(margins, label, self.classes)
        return np.round(np.stack([second / units[0], first / units[1]], axis=2)).astype(np.int64) * times[:, None, None]

    def _whole(self, rows: DataFrame, model: TreeEnsemble, rules: Rules, n: int) -> list[Tree]:
        """A table that is a small node itself: all rounds inside one task."""
        me, light = self, model._light()

        def boost(table: pa.Table) -> pa.Table:
            codes, starts = codes_of(table.combine_chunks())
            label, times = table["label"].to_numpy(), table["n"].to_numpy()
            margins = np.tile(light.start, (len(label), 1))
            trees = []
            for r in range(me.rounds):
                stats = me._stats(margins, label, times, rules.units)
                for c in range(light.margins):
                    tree, leaf = grown(codes, starts, np.ascontiguousarray(stats[:, c]), rules, light.bins, r)
                    margins[:, c] += light.scale(tree.sums)[leaf, 0]
                    trees.append(packed(tree, {"tree": len(trees)}, light.bins))
            return packed_table(trees, ["tree"])

        found = rows.groupBy(F.lit(0).alias("all")).applyInArrow(boost, f"tree int, {TREE_FIELDS}").toArrow().to_pylist()
        return [tree_of(r, 2, rules) for r in sorted(found, key=lambda r: r["tree"])]

    def _by_rounds(self, rows: DataFrame, model: TreeEnsemble, rules: Rules, n: int) -> list[Tree]:
        """A round: one aggregate per level for all classes; where the sums of a deep level are too many, one job for the rest of the trees."""
        me, light, trees = self, model._light(), []
        first = F.array(*(F.lit(float(x)) for x in model.start))
        # each round's rows are made from those of the last stored round: a table cached from a cached one doubles the plan
        rows = in_tasks(rows.withColumn("margins", first).mapInArrow(blocks, "block binary"), n).persist(StorageLevel.MEMORY_AND_DISK)
        stored, since = rows, []
        cells = light.margins * 2 ** max(self.depth - 1, 0) * (light.bins.total + 1)
        by_levels = n > SMALL_ROWS and cells * 3 * 8 <= DENSE_BYTES  # a node of one row is a leaf
        least = 1 if by_levels else SMALL_ROWS

        def stats_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            margins = pc.list_flatten(batch.column("margins")).to_numpy().reshape(-1, light.margins)
            stats = me._stats(margins, batch.column("label").to_numpy(), batch.column("n").to_numpy(), rules.units)
            for c in range(light.margins):
                yield c, np.arange(batch.num_rows), np.ascontiguousarray(stats[:, c])

        for r in range(self.rounds):
            tops = upper_levels(rows, stats_of, light.margins, 2, n, rules, light.bins, lambda t, r=r: r, least, rows_in)
            below: list[dict[int, Tree]] = [{} for _ in tops]
            if not by_levels:
                for x in finished(rows, stats_of, tops, 2, rules, light.bins, rows_in).toArrow().to_pylist():  # at most 2 ** depth nodes each
                    below[x["tree"]][x["node"]] = tree_of(x, 2, rules)
            if rows is not stored:
                rows.unpersist()
            fresh = [grafted(top.tree, subs) for top, subs in zip(tops, below)]
            trees += fresh
            if r == self.rounds - 1:
                break
            since.append(fresh)

            def add(batches: Iterator[pa.RecordBatch], since=tuple(since)) -> Iterator[pa.RecordBatch]:
                for batch in rows_in(batches):
                    codes, starts = codes_of(batch)
                    bin_at, every = lookup(codes, starts, light.bins), np.arange(batch.num_rows)
                    margins = pc.list_flatten(batch.column("margins")).to_numpy().reshape(-1, light.margins).copy()
                    for c, tree in ((c, tree) for round_ in since for c, tree in enumerate(round_)):
                        margins[:, c] += light.scale(tree.sums)[leaves_of(tree, every, light.bins, bin_at), 0]
                    made = list_column(margins.ravel(), np.arange(len(margins) + 1) * light.margins, pa.float64())
                    yield from blocks([batch.set_column(batch.schema.get_field_index("margins"), "margins", made)])

            rows = stored.mapInArrow(add, stored.schema)
            if len(since) < STORE_EVERY:
                rows = rows.persist(StorageLevel.MEMORY_AND_DISK)  # held from the first aggregate of the next round on
                continue
            rows = stable(rows).persist(StorageLevel.MEMORY_AND_DISK)
            stored.unpersist()
            stored, since = rows, []
        stored.unpersist()
        return trees
