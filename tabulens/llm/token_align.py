"""Alignment of two tokenizers over the same text.

A is a byte-level BPE of the tokenizers library, B a sentencepiece model with
byte fallback.  Both read the same bytes: a space and the text.  For each batch
of documents, ``pandas.merge_asof`` finds the B token that covers each A
token's start, and the A token that covers each B token's start; the key is the
place in the document counted on from the document's own base, so no match
leaves its document.
The union of both directions are the overlaps; overlaps whose ends are equal
are the links, and those ends cut both sequences into groups.

Neither tokenizer merges anything over the border between a character that is
no white space and a space, so texts are cut there and each distinct chunk is
encoded once; a worker remembers at most REMEMBERED chunks.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import lookup_join
from .common import arrow_map, written
from .id_store import LONG_RUN, PLAIN, ByteEncoder

#: Bytes of text that are aligned at a time (a longer text alone): tokens take about a hundred times as much while they are.
PIECE_BYTES = 1 << 20
#: Chunks whose tokens a worker keeps; the store starts anew when it is full.
REMEMBERED = 250_000
CUT = re.compile(r"(?<=\S)(?= )")
SPACE = "▁"
#: An id pair is one number: the id of A times this, plus the id of B.
SIDE = 1 << 24


class Side:
    """One tokenizer: ``encode`` (chunks that start with a space to ids) and the bytes of every id."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], entries: list[bytes]):
        self.encode = encode
        self.entries = entries
        self.widths = np.array([len(x) for x in entries], np.int64)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join([self.entries[i] for i in ids])


def byte_level(path: str) -> Side:
    tools = ByteEncoder(path)
    tools.library.encode_special_tokens = True  # their strings in a text are plain text

    def encode(chunks: list[str]) -> list[list[int]]:
        """Plain chunks through the faster library, which gives the same ids for them."""
        plain = [bool(PLAIN.fullmatch(c)) and not LONG_RUN.search(c) for c in chunks]
        quick = map(tools.fast.encode_ordinary, (c for c, p in zip(chunks, plain) if p))
        others = iter(tools.library.encode_batch_fast([c for c, p in zip(chunks, plain) if not p], add_special_tokens=False))
        return [next(quick) if p else next(others).ids for p in plain]

    def entry(i: int) -> bytes:
        try:
            return tools.fast.decode_single_token_bytes(i)
        except KeyError:  # a special token, or a gap between ids
            return b""

    return Side(encode, [entry(i) for i in range(max(tools.library.get_vocab().values(), default=-1) + 1)])


def sentence_pieces(path: str) -> Side:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    hexes = re.compile(r"<0x([0-9A-F]{2})>")
    lone = model.piece_to_id(SPACE)

    def entry(i: int) -> bytes:
        piece = model.id_to_piece(i)
        found = hexes.fullmatch(piece) if model.is_byte(i) else None
        return bytes([int(found[1], 16)]) if found else piece.replace(SPACE, " ").encode()

    def encode(texts: list[str]) -> list[list[int]]:
        # the model adds the first space itself, but not to an empty text
        ids = model.encode([t[1:] for t in texts], num_threads=1)
        return [[lone] if t == " " else x for t, x in zip(texts, ids)]

    return Side(encode, [entry(i) for i in range(model.get_piece_size())])


class Encoded:
    """The tokens of the chunks seen so far, as one flat array of ids."""

    def __init__(self, side: Side):
        self.side = side
        self.ids, self.starts, self.faithful = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, bool)

    def add(self, chunks: list[str]) -> None:
        made = self.side.encode(chunks)
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        flat = np.fromiter(itertools.chain.from_iterable(made), np.int64, int(sizes.sum()))
        same = [self.side.joined(x) == c.encode() for c, x in zip(chunks, made)]
        self.ids = np.concatenate([self.ids, flat])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.faithful = np.concatenate([self.faithful, np.array(same, bool)])

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks at ``places`` in order, and how many each has."""
        first = self.starts[places]
        sizes = self.starts[places + 1] - first
        shift = np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
        return self.ids[np.arange(len(shift)) + shift], sizes


class Places(dict):
    """Chunk to its place; a chunk not seen before gets the next one."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = place = len(self)
        return place


class Aligner:
    """Aligns batches of texts; keeps the chunks it has encoded."""

    def __init__(self, a: Side, b: Side):
        self.sides = (a, b)
        self.reset()

    def reset(self) -> None:
        self.places = Places()
        self.stores = [Encoded(s) for s in self.sides]

    def tokens(self, texts: list[str | None]) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Per side the tokens of all usable texts: doc (place in ``texts``), id, start and end.

        Starts and ends are byte places in all the texts put one after another.
        """
        if len(self.places) > REMEMBERED:
            self.reset()
        known = len(self.places)
        cut = [CUT.split(" " + t) if t else [] for t in texts]
        flat = list(map(self.places.__getitem__, itertools.chain.from_iterable(cut)))
        new = list(itertools.islice(self.places, known, None))
        for store in self.stores:
            store.add(new)
        chunk_doc = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
        places = np.array(flat, np.int64)
        sizes = [len(t.encode()) + 1 if t else 0 for t in texts]
        base = np.cumsum([0, *sizes])
        usable = np.array([bool(t) for t in texts], bool)
        found = []
        for store in self.stores:
            ids, counts = store.of(places)
            doc = np.repeat(chunk_doc, counts)
            for d in np.unique(chunk_doc[~store.faithful[places]]).tolist():  # rare: compare the whole text
                usable[d] &= store.side.joined(ids[doc == d].tolist()) == (" " + texts[d]).encode()
            found.append((ids, doc, store.side.widths[ids]))
        out = []
        for ids, doc, width in found:
            if not usable.all():
                keep = usable[doc]
                ids, doc, width = ids[keep], doc[keep], width[keep]
            ends = np.cumsum(width)
            # texts that are left out leave a gap, so both sides have the same places
            per_doc = np.where(usable, sizes, 0)
            ends += (base[:-1] - (np.cumsum(per_doc) - per_doc))[doc]
            out.append(pd.DataFrame({"doc": doc, "id": ids, "start": ends - width, "end": ends}))
        return out[0], out[1]

    @staticmethod
    def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """All pairs (a, b) of tokens that share bytes, as places in the two tables."""
        a = pd.DataFrame({"a_start": a["start"], "a": np.arange(len(a))})
        b = pd.DataFrame({"b_start": b["start"], "b": np.arange(len(b))})
        covering_b = pd.merge_asof(a, b, left_on="a_start", right_on="b_start")
        covering_a = pd.merge_asof(b, a, left_on="b_start", right_on="a_start")
        covering_a = covering_a[covering_a["a_start"] != covering_a["b_start"]]  # both directions find these
        return pd.concat([covering_b[["a", "b"]], covering_a[["a", "b"]]], ignore_index=True)

    @classmethod
    def links(cls, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """The overlaps whose byte ranges end together, in text order."""
        both = cls.overlaps(a, b)
        same = a["end"].to_numpy()[both["a"]] == b["end"].to_numpy()[both["b"]]
        both = both[same].sort_values("a")
        return both.assign(doc=a["doc"].to_numpy()[both["a"]])


class Writer:
    """Writes groups as text: ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, a: Side, b: Side):
        self.last_b = 2 * len(a.entries)
        pieces = [f"{i}{sign}" for side, signs in ((a, ",|"), (b, ",;")) for sign in signs for i in range(len(side.entries))]
        self.pieces = np.array(pieces, object)
        self.sizes = (len(a.entries), len(b.entries))

    def of(self, a: pd.DataFrame, b: pd.DataFrame, links: pd.DataFrame, docs: int) -> list[str]:
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[links["a"]], last_b[links["b"]] = True, True
        group_a = np.cumsum(last_a) - last_a
        group_b = np.cumsum(last_b) - last_b
        ends_a = np.append(np.flatnonzero(last_a) + 1, len(a))  # A tokens up to each group's end
        ends_b = np.concatenate([[0], np.flatnonzero(last_b) + 1, [len(b)]])  # B tokens before each group
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + ends_b[group_a]] = a["id"].to_numpy() + last_a * self.sizes[0]
        order[np.arange(len(b)) + ends_a[group_b]] = b["id"].to_numpy() + self.last_b + last_b * self.sizes[1]
        both = np.bincount(a["doc"], minlength=docs) + np.bincount(b["doc"], minlength=docs)
        bounds = np.cumsum([0, *both]).tolist()
        texts = self.pieces[order].tolist()
        return ["".join(texts[s:e]).removesuffix(";") for s, e in zip(bounds, bounds[1:])]


def aligned(df: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, n_a, n_b, n_groups, ``groups_sha256`` and ``pairs`` (the linked id pairs in order).

    ``pairs`` holds ``a * SIDE + b``.  Null and empty texts, and texts of which
    a tokenizer loses bytes, have no tokens: zeros, no pairs and an empty
    ``groups_sha256``.  Repeated rows each stay; other columns are left out.
    """
    rows = df.select(df[id_column].alias("id"), df[text].alias("x"))
    kept: dict[str, tuple] = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not kept:
            a, b = byte_level(path_a), sentence_pieces(path_b)
            kept["tools"] = (Aligner(a, b), Writer(a, b))
        aligner, writer = kept["tools"]
        n = batch.num_rows
        a, b = aligner.tokens(batch.column("x").to_pylist())
        found = aligner.links(a, b)
        n_a, n_b, groups = (np.bincount(x["doc"], minlength=n) for x in (a, b, found))
        codes = a["id"].to_numpy()[found["a"]] * SIDE + b["id"].to_numpy()[found["b"]]
        offsets = np.concatenate([[0], np.cumsum(groups)]).astype(np.int32)
        digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in writer.of(a, b, found, n)]
        made = [pa.array(x, pa.int64()) for x in (n_a, n_b, groups)]
        pairs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes, pa.int64()))
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), *made, pa.array(digests, pa.string()), pairs], ["id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs"]
        )

    kind = df.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, pairs array<bigint>"
    return arrow_map(rows, work, schema, ["x"], PIECE_BYTES)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, times, best): how many links of the corpus hold each id pair, and whether no other A id has more with its B id."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("times"))
    counts = written(counts.withColumn("b", F.col("pair") % SIDE), "pair-counts")
    most = counts.groupBy("b").agg(F.max("times").alias("most"))
    return written(counts.join(most, "b").select("pair", "times", (F.col("times") == F.col("most")).alias("best")), "pairs")


def alignments(df: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    ``count_sum`` adds up the corpus-wide counts of the row's links, ``n_best``
    counts the links whose id pair is the most frequent one of its B id, ties
    included.  Rows without tokens have zeros.  An empty table gives an empty result.
    """
    rows = written(aligned(df, path_a, path_b, id_column, text).withColumn("row", F.monotonically_increasing_id()), "aligned")
    links = rows.select("row", F.explode("pairs").alias("pair"))
    known = pair_counts(rows).withColumn("links", F.col("times"))
    scored = lookup_join(links, known, "pair", "links")
    sums = scored.groupBy("row").agg(F.sum(F.col("best").cast("bigint")).alias("n_best"), F.sum("times").alias("count_sum"))
    zero = F.lit(0).cast("bigint")
    rows = rows.withColumn("n_links", F.size("pairs").cast("bigint")).drop("pairs")
    return rows.join(sums, "row", "left").select(
        "id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"),
        "groups_sha256",
    )
