"""Token ids in packs of separately compressed documents with one shared zstandard dictionary.

Format, as Parquet so that any store Spark writes to will do: each row of
``<path>/packs`` is one pack of consecutive documents.

| column | content |
| --- | --- |
| part, seq | place of the pack: parts in order, packs in order inside a part |
| dict_hash | SHA-256 of the dictionary the frames were made with |
| width | bytes of an id in a frame, little-endian: 2 or 4 |
| first_id, last_id | smallest and largest document id, for pruning |
| doc_ids, n_tokens | of each document |
| part_start | ids of the earlier documents of the part, per document |
| offsets | where each frame starts in ``frames``, and where the last one ends |
| frames | the frames one after the other |

``<path>/dictionary`` has one row: dict_hash, dictionary.  To read one document,
prune packs by id, cut its frame out by two offsets and decompress it alone.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces

#: The dictionary: its size, and the sample it is trained on (documents by smallest hash, first ids of each).
DICT_BYTES = 64 << 10
SAMPLE_DOCS = 2_000
SAMPLE_IDS = 2_048
#: A pack ends at so many documents or so many bytes of frames.
PACK_DOCS = 2_048
PACK_BYTES = 4 << 20
LEVEL = 3
#: Characters that both tokenizer libraries split alike, whatever their Unicode version; other texts take the first.
PLAIN = re.compile("[\t-\r\x20-\x7e\xa1-ɏ‐-‧]*")
LONG_RUN = re.compile(r"\S{2000}")
# Fixed value: the splitting pattern of the byte-level kind.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteEncoder:
    """Ids as the tokenizers library gives them.

    Plain texts go through tiktoken with the ranks of the same file, several
    times as fast; others, and texts with very long runs, through tokenizers.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        from .bpe_automaton import byte_letters

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        letters = {c: b for b, c in byte_letters().items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(letters.__getitem__, s)): i for s, i in spec["model"]["vocab"].items() if s not in added}
        self.special = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.fast = tiktoken.Encoding("ids", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if PLAIN.fullmatch(text) and not self.special.search(text) and not LONG_RUN.search(text):
            return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def width_for(tokenizer: str, end_id: int) -> int:
    """The bytes that hold every id of a tokenizer file, and the end id."""
    import json

    with open(tokenizer, encoding="utf-8") as file:
        spec = json.load(file)
    ids = [*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"]), end_id]
    return 2 if max(ids) < 1 << 16 else 4


def serialized(ids: np.ndarray, width: int) -> bytes:
    if len(ids) and int(ids.max()) >= 1 << 8 * width:
        raise ValueError(f"Id {int(ids.max())} does not fit {width} bytes.")
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def ids_of(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if width == 2 else "<u4").astype("<u4")


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> bytes:
    """A dictionary from a bounded sample: at most SAMPLE_DOCS documents, SAMPLE_IDS ids of each."""

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for x in batch.column("x").to_pylist():
                ids = np.append(encoder(tokenizer).encode((x or "")[: 8 * SAMPLE_IDS]), np.uint32(end_id))
                made.append(serialized(ids[:SAMPLE_IDS], width))
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["s"])

    # hashes are spread evenly: few rows beyond the sample pass the bound, so few reach the task that orders them
    share = F.col("h") / float(1 << 64) + 0.5
    few = docs.select("x", F.xxhash64("id", "x").alias("h")).where(share <= (2 * SAMPLE_DOCS + 64) / max(docs.count(), 1))
    chosen = few.orderBy("h").limit(SAMPLE_DOCS).select("x")
    samples = [bytes(r.s) for r in chosen.mapInArrow(starts, "s binary").collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little to train on: raw content serves as a dictionary
        return b"".join(samples)[:DICT_BYTES] or b"\0" * 8


PACK_SCHEMA = (
    "part int, seq int, dict_hash string, width int, first_id bigint, last_id bigint, doc_ids array<bigint>, "
    "n_tokens array<int>, part_start array<bigint>, offsets array<bigint>, frames binary"
)


def write_packs(
    df: DataFrame, path: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text: str = "text", width: int | None = None
) -> None:
    """Encode every text, append ``end_id``, and write packs in ascending id order below ``path``.

    Null ids come first; equal ids are ordered by a hash of their text.  A null
    or empty text has the end id alone.  An empty table gives no packs.
    Without ``width`` it follows the tokenizer's largest id; an id that does not
    fit a given one raises.
    """
    spark = df.sparkSession
    width = width or width_for(tokenizer, end_id)
    docs = df.select(df[id_column].cast("bigint").alias("id"), df[text].alias("x"))
    dictionary = train_dictionary(docs, tokenizer, end_id, width)
    dict_hash = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(dict_hash, bytearray(dictionary))], "dict_hash string, dictionary binary").write.parquet(
        f"{path}/dictionary"
    )
    ordered = docs.withColumn("h", F.xxhash64("x"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(parts, "id", "h").sortWithinPartitions("id", "h").select("id", "x")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        encode = encoder(tokenizer).encode
        ids, counts, starts, frames, held, seq, total = [], [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            known = [i for i in ids if i is not None]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()
            row = [part, seq, dict_hash, width, min(known, default=None), max(known, default=None)]
            row += [list(ids), list(counts), list(starts), offsets, b"".join(frames)]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            kinds += [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = [c.split()[0] for c in PACK_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            for piece in pieces(batch, ["x"]):
                for i, x in zip(piece.column("id").to_pylist(), piece.column("x").to_pylist()):
                    tokens = np.append(encode(x or ""), np.uint32(end_id))
                    frame = compressor.compress(serialized(tokens, width))
                    ids.append(i)
                    counts.append(len(tokens))
                    starts.append(total)
                    frames.append(frame)
                    held += len(frame)
                    total += len(tokens)
                    if len(ids) >= PACK_DOCS or held >= PACK_BYTES:
                        yield flush()
                        ids, counts, starts, frames, held, seq = [], [], [], [], 0, seq + 1
        if ids:
            yield flush()

    ordered.mapInArrow(pack, PACK_SCHEMA).write.parquet(f"{path}/packs")


def load_dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(row.dictionary)
    if hashlib.sha256(data).hexdigest() != row.dict_hash:
        raise ValueError("the dictionary is damaged")
    return row.dict_hash, data


def part_offsets(packs: DataFrame) -> DataFrame:
    """(part, before): ids in all earlier parts; as many rows as partitions were written."""
    sums = packs.groupBy("part").agg(F.sum(F.expr("aggregate(n_tokens, 0L, (s, n) -> s + n)")).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def read_packs(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens and the ids (as little-endian 32-bit ``data``) of all documents below ``path``.

    ``where`` filters packs, for example ``first_id <= 7 AND last_id >= 7``.
    """
    dict_hash, dictionary = load_dictionary(spark, path)
    packs = spark.read.parquet(f"{path}/packs")
    placed = packs.join(F.broadcast(part_offsets(packs)), "part")
    if where:
        placed = placed.where(where)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        for batch in batches:
            for pack in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if pack["dict_hash"] != dict_hash:
                    raise ValueError("a pack was made with another dictionary")
                at, frames = pack["offsets"], pack["frames"]
                data = [ids_of(plain.decompress(frames[a:b]), pack["width"]).tobytes() for a, b in zip(at, at[1:])]
                if [len(d) // 4 for d in data] != pack["n_tokens"]:
                    raise ValueError("a pack does not hold the ids that its index names")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(pack["doc_ids"], pa.int64()),
                        pa.array([s + pack["before"] for s in pack["part_start"]], pa.int64()),
                        pa.array(pack["n_tokens"], pa.int64()),
                        pa.array(data, pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "data"],
                )

    return placed.mapInArrow(unpack, "doc_id bigint, start bigint, n_tokens bigint, data binary")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents with one id, from its packs alone, decompressing nothing else."""
    dict_hash, dictionary = load_dictionary(spark, path)
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    packs = spark.read.parquet(f"{path}/packs").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    at = F.explode(F.filter(F.sequence(F.lit(0), F.size("doc_ids") - 1), lambda i: F.get("doc_ids", i) == doc_id))
    cut = packs.select("dict_hash", "width", "frames", "offsets", at.alias("i")).select(
        "dict_hash",
        "width",
        F.substring("frames", F.get("offsets", F.col("i")) + 1, F.get("offsets", F.col("i") + 1) - F.get("offsets", F.col("i"))).alias("frame"),
    )
    rows = cut.collect()  # the frames of one document id
    if any(r.dict_hash != dict_hash for r in rows):
        raise ValueError("a pack was made with another dictionary")
    return [ids_of(plain.decompress(bytes(r.frame)), r.width) for r in rows]


def crc32(data: bytes) -> int:
    return zlib.crc32(data)
