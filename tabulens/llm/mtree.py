"""Exact top-k search by inner product with an M-tree, searched best-first.

With M the largest length of a vector, x becomes x' = (x, sqrt(M^2 - |x|^2)) and
a query q becomes q' = (q, 0).  Then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the
highest inner products are the nearest neighbours of a true metric.

The top level are routing vectors from a bounded sample; every vector belongs to
the nearest one.  Below each lie subtrees of bounded size (a crowded region gets
several), one row each, and each subtree is cut into pages around routing
vectors.  A page holds its covering radius, and of each entry the distance to
the page's routing vector (its parent distance).

Queries are searched in blocks.  A block first searches one subtree of its home
region, which gives each query a score to beat.  Then it goes to every region
whose bound still reaches that score, visits pages by falling bound until no
bound reaches it, and skips entries whose parent distance rules them out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Routing vectors of the top level, at most; vectors of a subtree, about; entries of a page; queries of a block.
REGIONS = 1_024
SUBTREE = 2_048
PAGE = 64
BLOCK = 128
NO_ID = np.iinfo(np.int64).max
SLACK = 1e-9


def whole_numbers(vector: Column) -> Column:
    """floor(256 * x) of each component, as double times 256."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("bigint"))


def complete(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    limit = F.lit(float("inf"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)
    return vector.isNotNull() & F.coalesce(F.forall(vector, fine), F.lit(False))


def packed(a: np.ndarray) -> bytes:
    kind = next(t for t in ("<i2", "<i4", "<i8") if a.size == 0 or (a.min() >= np.iinfo(t).min and a.max() <= np.iinfo(t).max))
    return kind.encode() + a.astype(kind).tobytes()


def unpacked(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data[3:], data[:3].decode()).reshape(-1, max(dim, 1)).astype(np.int64)


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros."""
    out = np.zeros((len(column), max(dim, 1)), np.int64)
    for i, v in enumerate(column.to_pylist()):
        out[i, : len(v)] = v
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with those of b."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object)
    bounds = np.iinfo(np.int64)
    return np.array([[min(max(int(x), bounds.min), bounds.max) for x in row] for row in exact], np.int64).reshape(exact.shape)


def squares(a: np.ndarray) -> np.ndarray:
    return (a.astype(np.float64) ** 2).sum(axis=1)


def lift(a: np.ndarray, most: float) -> np.ndarray:
    """The added component of data vectors."""
    return np.sqrt(np.maximum(most - squares(a), 0.0))


def apart(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Distances between data vectors."""
    dots = a.astype(np.float64) @ b.T.astype(np.float64) + np.outer(lift(a, most), lift(b, most))
    return np.sqrt(np.maximum(2 * most - 2 * dots, 0.0))


def from_queries(q: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Distances from queries to data vectors."""
    dots = q.astype(np.float64) @ b.T.astype(np.float64)
    return np.sqrt(np.maximum(squares(q)[:, None] + most - 2 * dots, 0.0))


def highest(distance: np.ndarray, radius: np.ndarray, norm: np.ndarray, most: float) -> np.ndarray:
    """The most that an inner product can be inside a ball, with room for rounding."""
    scale = norm + most + 1.0
    near = np.maximum(distance - radius - 1e-7 * np.sqrt(scale), 0.0)
    return (norm + most - near**2) / 2 + SLACK * scale


def build(ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, most: float) -> dict:
    """One subtree: entries in page order, and of each page its routing vector, radius and start."""
    order, pages, parents = [], [], np.zeros(len(ids))
    stack = [np.arange(len(ids))]
    while stack:
        part = stack.pop()
        if len(part) <= PAGE:
            # the routing vector is the entry with the smallest covering radius
            d = apart(vectors[part], vectors[part], most)
            c = int(d.max(axis=1).argmin())
            parents[part] = d[c]
            pages.append((part[c], float(d[c].max()), len(order)))
            order.extend(part.tolist())
            continue
        ways = min(8, -(-len(part) // PAGE))
        seeds = part[np.linspace(0, len(part) - 1, ways).astype(int)]
        nearest = apart(vectors[part], vectors[seeds], most).argmin(axis=1)
        split = [part[nearest == w] for w in range(ways)]
        if max(map(len, split)) == len(part):  # all alike: cut by number
            split = np.array_split(part, ways)
        stack.extend(s for s in split if len(s))
    order = np.array(order, np.int64)
    return {
        "ids": ids[order],
        "rows": rows[order],
        "vectors": vectors[order],
        "parents": parents[order],
        "centers": vectors[[p[0] for p in pages]],
        "radii": np.array([p[1] for p in pages]),
        "starts": np.array([p[2] for p in pages] + [len(order)], np.int64),
    }


def search(tree: dict, queries: np.ndarray, rows: np.ndarray, most: float, k: int, beat: np.ndarray) -> list[list]:
    """Best-first search of one subtree for a block of queries: of each, the best (-score, id, row), at most k, that reach ``beat``.

    Pages go by falling bound of the block.  On each page only the queries whose
    bound reaches their score to beat are looked at, and only the entries that
    their parent distance does not rule out for all of these.
    """
    beat = beat.copy()
    norm, to_centers = squares(queries), from_queries(queries, tree["centers"], most)
    bound = highest(to_centers, tree["radii"][None, :], norm[:, None], most)
    best: list[list[tuple[int, int, int]]] = [[] for _ in queries]
    for p in np.argsort(-bound.max(axis=0), kind="stable"):
        asked = np.flatnonzero(bound[:, p] >= beat)
        if not len(asked):
            continue
        a, b = tree["starts"][p], tree["starts"][p + 1]
        gap = np.abs(to_centers[asked, p][:, None] - tree["parents"][None, a:b])
        able = highest(gap, 0.0, norm[asked][:, None], most) >= beat[asked][:, None]
        at = a + np.flatnonzero(able.any(axis=0))
        if not len(at):
            continue
        scores = inner(queries[asked], tree["vectors"][at])
        good = (scores >= beat[asked][:, None]) & (tree["rows"][at][None, :] != rows[asked][:, None])
        if len(at) > k + 1:  # of one page k entries at most are of use, and ties of the last one; one may be the query itself
            good &= scores >= np.partition(scores, -(k + 1), axis=1)[:, -(k + 1)][:, None]
        hit, entry = np.nonzero(good)
        for j, e, score in zip(hit.tolist(), entry.tolist(), scores[hit, entry].tolist()):
            best[asked[j]].append((-score, int(tree["ids"][at[e]]), int(tree["rows"][at[e]])))
        for j in asked[np.unique(hit)].tolist():
            best[j].sort()
            del best[j][k:]
            if len(best[j]) == k:
                beat[j] = max(beat[j], -best[j][-1][0])
    return best


TREE_SCHEMA = "region int, salt int, ids binary, rows binary, vectors binary, parents binary, centers binary, radii binary, starts binary"
FOUND_SCHEMA = "qrow bigint, query_id bigint, row bigint, vec_id bigint, score bigint"


def tree_of(r: dict, dim: int) -> dict:
    tree = {c: np.frombuffer(r[c], np.int64) for c in ("ids", "rows", "starts")}
    tree |= {c: np.frombuffer(r[c], np.float64) for c in ("parents", "radii")}
    return tree | {c: unpacked(r[c], dim) for c in ("vectors", "centers")}


def top_k(df: DataFrame, k: int = 5, every: int = 50, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (int from 1), vec_id and score of the k best candidates of each query, exactly.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows but the query's own.  Vectors that are null, or hold null or non-finite
    components, take no part.  Shorter vectors count as filled up with zeros.  Ties go to the
    smaller id, null ids last.  Repeated rows are rows of their own, as queries
    and as candidates.  Scores beyond 64 bits are cut to that range.  An empty
    table gives an empty result.
    """
    spark = df.sparkSession
    rows = df.select(df[id_column].cast("bigint").alias("vec_id"), df[vector].alias("x")).where(complete(F.col("x")))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", whole_numbers(F.col("x")).alias("v"))
    rows = written(rows, "vectors")
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, dim, most = rows.agg(F.count("*"), F.max(F.size("v")), F.max(length)).first()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    most = most * (1 + 1e-12) + 1.0
    wanted = min(REGIONS, -(-n // SUBTREE))
    sample = rows.select(F.xxhash64("row").alias("h"), "v").orderBy("h").limit(wanted).collect()
    pivots = np.zeros((len(sample), max(dim, 1)), np.int64)
    for i, r in enumerate(sample):
        pivots[i, : len(r.v)] = r.v

    def nearest(batches):
        for b in batches:
            d = apart(matrix(b.column("v"), dim), pivots, most)
            region = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("row", "vec_id", "v")), pa.array(region, pa.int32()), pa.array(d.min(axis=1), pa.float64())],
                ["row", "vec_id", "v", "region", "far"],
            )

    placed = written(rows.mapInArrow(nearest, "row bigint, vec_id bigint, v array<bigint>, region int, far double"), "placed")
    is_query = F.col("vec_id") % every == 0
    sizes = placed.groupBy("region").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.count_if(is_query).alias("q")).collect()
    radius, salts, qsalts = np.zeros(len(pivots)), np.ones(len(pivots), np.int64), np.ones(len(pivots), np.int64)
    for r in sizes:  # one row per region
        radius[r.region], salts[r.region], qsalts[r.region] = r.radius, -(-r.n // SUBTREE), max(1, -(-r.q // BLOCK))

    def spread(counts: np.ndarray) -> Column:
        parts = F.get(F.array(*(F.lit(int(c)) for c in counts)), F.col("region"))
        return F.pmod(F.xxhash64("row"), parts).cast("int")

    def subtree(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").fill_null(NO_ID).to_numpy()
        tree = build(ids, table.column("row").to_numpy(), matrix(table.column("v"), dim), most)
        row = {c: np.ascontiguousarray(tree[c]).tobytes() for c in ("ids", "rows", "starts", "parents", "radii")}
        row |= {c: packed(tree[c]) for c in ("vectors", "centers")}
        row |= {c: table.column(c)[0].as_py() for c in ("region", "salt")}
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 7
        names = [c.split()[0] for c in TREE_SCHEMA.split(", ")]
        return pa.table([pa.array([row[c]], t) for c, t in zip(names, kinds)], names=names)

    trees = written(placed.withColumn("salt", spread(salts)).groupBy("region", "salt").applyInArrow(subtree, TREE_SCHEMA), "subtrees")

    def block(table: pa.Table) -> pa.Table:
        q = matrix(table.column("v"), dim)
        columns = [table.column("region")[:1].combine_chunks(), table.column("part")[:1].combine_chunks()]
        columns += [pa.array([table.column(c).to_numpy().tobytes()], pa.binary()) for c in ("row", "vec_id")]
        return pa.table(columns + [pa.array([packed(q)], pa.binary())], names=["home", "part", "qrows", "qids", "q"])

    asked = placed.where(is_query).withColumn("part", spread(qsalts))
    blocks = asked.groupBy("region", "part").applyInArrow(block, "home int, part int, qrows binary, qids binary, q binary")
    blocks = written(blocks, "blocks")

    def searched(batches, beats: bool):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                tree, q = tree_of(r, dim), unpacked(r["q"], dim)
                qrows, qids = np.frombuffer(r["qrows"], np.int64), np.frombuffer(r["qids"], np.int64)
                beat = np.frombuffer(r["beat"], np.int64) if beats else np.full(len(q), np.iinfo(np.int64).min)
                out = []
                for j, best in enumerate(search(tree, q, qrows, most, k, beat)):
                    out.extend((qrows[j], qids[j], row, None if i == NO_ID else i, -score) for score, i, row in best)
                columns = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], ["qrow", "query_id", "row", "vec_id", "score"]
                )

    # first round: one subtree of the home region
    first = blocks.withColumn("region", F.col("home")).withColumn("salt", F.pmod(F.col("part"), F.get(F.array(*(F.lit(int(c)) for c in salts)), F.col("home"))).cast("int"))
    firsts = first.join(trees, ["region", "salt"])
    found = written(firsts.mapInArrow(lambda b: searched(b, False), FOUND_SCHEMA), "first-round")
    kth = found.groupBy("qrow").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))  # at most k each
    kth = kth.select("qrow", F.coalesce(F.get("s", F.lit(k - 1)), F.lit(np.iinfo(np.int64).min)).alias("beat"))

    # second round: every other subtree whose region can still reach the score to beat
    scores = placed.where(is_query).select("row", "region", spread(qsalts).alias("part")).join(kth, F.col("row") == F.col("qrow"), "left")
    known = scores.groupBy("region", "part").agg(
        F.collect_list(F.struct("row", F.coalesce("beat", F.lit(np.iinfo(np.int64).min)).alias("beat"))).alias("beats")
    )  # a block each
    armed = first.drop("region").withColumnRenamed("salt", "seen").join(known.withColumnRenamed("region", "home"), ["home", "part"])

    def reachable(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                q, qrows = unpacked(r["q"], dim), np.frombuffer(r["qrows"], np.int64)
                by_row = {x["row"]: x["beat"] for x in r["beats"]}
                beat = np.array([by_row[x] for x in qrows.tolist()], np.int64)
                norm = squares(q)
                reach = highest(from_queries(q, pivots, most), radius[None, :], norm[:, None], most)
                regions = np.flatnonzero((reach >= beat[:, None]).any(axis=0))
                targets = [(int(p), s) for p in regions for s in range(int(salts[p])) if (p, s) != (r["home"], r["seen"])]
                m = len(targets)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p for p, _ in targets], pa.int32()),
                        pa.array([s for _, s in targets], pa.int32()),
                        *(pa.array([r[c]] * m, pa.binary()) for c in ("qrows", "qids", "q")),
                        pa.array([beat.tobytes()] * m, pa.binary()),
                    ],
                    ["region", "salt", "qrows", "qids", "q", "beat"],
                )

    pairs = armed.mapInArrow(reachable, "region int, salt int, qrows binary, qids binary, q binary, beat binary")
    rest = pairs.join(trees, ["region", "salt"]).mapInArrow(lambda b: searched(b, True), FOUND_SCHEMA)
    best = Window.partitionBy("qrow").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    ranked = found.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
