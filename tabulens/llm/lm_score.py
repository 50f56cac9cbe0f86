"""Language-model scores: a log-bilinear model over word classes, trained with noise-contrastive estimation.

The text's tokens are its words and one end.  P(word | context) is
P(class | two classes before) * P(word | class).  The most frequent words are
classes of their own, all others fall into classes by their last two bytes, so
unseen words have one as well.  Inside a class a word has (c + 1) of C + V + 1,
with one share for the unseen words of the class.

The log-bilinear part predicts the vector of the next class as a sum of the
context classes' vectors, each through the matrix of its place.  It is trained
in numpy by telling counted (class, class, class) triples from classes drawn
from their frequencies.  The triples are counted over all training texts; there
are at most CLASSES^3 of them.  Batched matrix products and a softmax then give
the normalised log-probabilities of all contexts at once.

Word counts have no bound and are never broadcast: the HEAD most frequent words
are looked up in each task, and rarer words meet their counts in a join.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, written

#: Words with a class of their own (the end is class 0), and classes of all other words.
OWN, SHARED = 63, 32
CLASSES = 1 + OWN + SHARED
HEAD = 1 << 16
WIDTH = 16
STEPS, BATCH, NOISE, RATE, SEED = 600, 4_096, 32, 0.15, 11
#: The end of a text as a token; words are never empty.
END = ""


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A-Z in lower case, and the number of the text of each."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    values, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    there = pc.not_equal(values, "")
    return values.filter(there), parents.filter(there).to_numpy(zero_copy_only=False).astype(np.int64)


def shared_class(words: pa.Array) -> np.ndarray:
    """The class of words that have none of their own."""
    tails = pc.binary_slice(pc.cast(words, pa.binary()), -2).dictionary_encode()
    of_tail = np.array([1 + OWN + zlib.crc32(t) % SHARED for t in tails.dictionary.to_pylist()], np.int64)
    return of_tail[tails.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)


def trained_on(id_column: Column, modulus: int = 7, rest: int = 2) -> Column:
    """Whether a row may be learned from; rows without an id may not."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % modulus != rest, F.lit(False))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all rows of ``x``, the end included."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, _ = tokens(batch.column("x"))
        found = pc.value_counts(words)
        names = pa.concat_arrays([found.field("values"), pa.array([END], pa.string())])
        return pa.RecordBatch.from_arrays([names, pa.array(np.append(found.field("counts").to_numpy(), batch.num_rows))], ["word", "c"])

    return arrow_map(texts.select("x"), count, "word string, c bigint", ["x"]).groupBy("word").agg(F.sum("c").alias("c"))


class Head:
    """The most frequent words with counts and classes; the rest goes by spelling."""

    def __init__(self, words: list[str], counts: list[int], ends: int):
        self.words = pa.array(words, pa.string())
        self.log_counts = np.log10(np.array(counts, np.float64) + 1)
        ranked = [i for i, w in enumerate(words) if w != END][:OWN]
        self.classes = shared_class(self.words)
        for c, i in enumerate(ranked, 1):
            self.classes[i] = c
        self.end_log_count = float(np.log10(ends + 1))  # the end may be rarer than all words here

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: its class, whether it is in the head, and log10(c + 1) if so, else 0."""
        place = pc.index_in(words, value_set=self.words)
        known = pc.is_valid(place).to_numpy(zero_copy_only=False)
        at = pc.fill_null(place, 0).to_numpy(zero_copy_only=False)
        if not len(self.words):
            return shared_class(words), known, np.zeros(len(words))
        classes = self.classes[at].copy()
        classes[~known] = shared_class(words.filter(pa.array(~known)))
        return classes, known, np.where(known, self.log_counts[at], 0.0)


def sequences(classes: np.ndarray, parents: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all tokens with ends, the two classes before each (ends before a text's start), and its text."""
    lengths = np.bincount(parents, minlength=texts) + 1
    ends = np.cumsum(lengths) - 1
    seq = np.zeros(int(lengths.sum()), np.int64)
    seq[np.arange(len(classes)) + parents] = classes  # one end before for each earlier text
    owner = np.repeat(np.arange(texts), lengths)
    one, two = np.zeros_like(seq), np.zeros_like(seq)
    one[1:], two[2:] = seq[:-1], seq[:-2]
    starts = ends - lengths + 1
    one[starts], two[starts] = 0, 0
    second = starts[lengths > 1] + 1
    two[second] = 0
    return seq, one, two, owner


def triple_counts(texts: DataFrame, head) -> np.ndarray:
    """How often each (class before last, class before, class) occurs in all rows of ``x``."""

    def count(batches):
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            words, parents = tokens(batch.column("x"))
            classes, _, _ = head.value.look_up(words)
            seq, one, two, _ = sequences(classes, parents, batch.num_rows)
            total += np.bincount((two * CLASSES + one) * CLASSES + seq, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["t", "n"])

    summed = texts.select("x").mapInArrow(count, "t bigint, n bigint").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES**3, np.int64)
    out[summed.column("t").to_numpy()] = summed.column("n").to_numpy()
    return out.reshape(CLASSES, CLASSES, CLASSES)


def log_bilinear(counts: np.ndarray) -> np.ndarray:
    """log10 P(class | two before, one before) for all contexts, from counted triples."""
    rng = np.random.default_rng(SEED)
    size = counts.shape[0]
    flat = counts.reshape(-1).astype(np.float64)
    single = counts.sum(axis=(0, 1)) + 1.0
    noise = single / single.sum()
    context, target = rng.normal(0, 0.1, (size, WIDTH)), rng.normal(0, 0.1, (size, WIDTH))
    near, far, bias = np.eye(WIDTH), np.eye(WIDTH) * 0.5, np.log(noise)
    params = [context, target, near, far, bias]
    sums = [np.full_like(p, 1e-6) for p in params]
    places = np.flatnonzero(flat)
    share = np.cumsum(flat[places] / flat.sum()) if len(places) else None
    log_noise = np.log(NOISE * noise)
    for _ in range(STEPS if share is not None else 0):
        drawn = places[np.minimum(np.searchsorted(share, rng.random(BATCH)), len(places) - 1)]
        two, one, c = drawn // size**2, drawn // size % size, drawn % size
        other = rng.choice(size, NOISE, p=noise)
        a, b = context[one], context[two]
        h = a @ near + b @ far
        true = 1 / (1 + np.exp(-((h * target[c]).sum(axis=1) + bias[c] - log_noise[c])))
        false = 1 / (1 + np.exp(-(h @ target[other].T + bias[other] - log_noise[other])))
        up = (true - 1) / BATCH
        down = false / BATCH
        grads = [np.zeros_like(p) for p in params]
        dh = up[:, None] * target[c] + down @ target[other]
        np.add.at(grads[0], one, dh @ near.T)
        np.add.at(grads[0], two, dh @ far.T)
        np.add.at(grads[1], c, up[:, None] * h)
        np.add.at(grads[1], other, down.T @ h)
        grads[2], grads[3] = a.T @ dh, b.T @ dh
        np.add.at(grads[4], c, up)
        np.add.at(grads[4], other, down.sum(axis=0))
        for p, s, g in zip(params, sums, grads):
            s += g * g
            p -= RATE * g / np.sqrt(s)
    table = np.empty((size, size, size))
    for two in range(size):
        scores = (context @ near + context[two] @ far) @ target.T + bias
        scores -= scores.max(axis=1, keepdims=True)
        table[two] = (scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))) / np.log(10)
    return table


@dataclass
class Model:
    head: Head
    table: np.ndarray
    log_share: np.ndarray  # by class: log10(C + V + 1), and 0 for classes of one word


def score(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row, its whole text.

    Null and empty texts have the end as their only token.  A row without an id
    is held out.  Without training rows every token is unseen.  Repeated rows
    each get their row; other columns are left out.
    """
    spark = df.sparkSession
    docs = df.select(df[id_column].alias("doc_id"), df[text].alias("x"), trained_on(df[id_column]).alias("learn"))
    learned = docs.where("learn").select("x")
    counts = written(word_counts(learned), "word-counts")
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
    ends = counts.where(F.col("word") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    head = Head(top.column("word").to_pylist(), top.column("c").to_pylist(), ends)
    shared_head = spark.sparkContext.broadcast(head)

    def class_sizes(batch: pa.RecordBatch) -> pa.RecordBatch:
        classes, _, _ = shared_head.value.look_up(batch.column("word"))
        c = batch.column("c").to_numpy()
        sums = [np.bincount(classes, w, CLASSES).astype(np.int64) for w in (c, np.ones(len(c)))]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), *map(pa.array, sums)], ["k", "c", "v"])

    by_class = arrow_map(counts.where(F.col("word") != END), class_sizes, "k bigint, c bigint, v bigint", ["word"])
    sizes = np.zeros(CLASSES)
    for r in by_class.groupBy("k").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect():  # one row per class
        sizes[r.k] = r.c + r.v
    log_share = np.where(np.arange(CLASSES) > OWN, np.log10(sizes + 1), 0.0)
    table = log_bilinear(triple_counts(learned, shared_head))
    shared = spark.sparkContext.broadcast(Model(head, table, log_share))

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, n = shared.value, batch.num_rows
        words, parents = tokens(batch.column("x"))
        classes, known, logs = m.head.look_up(words)
        seq, one, two, owner = sequences(classes, parents, n)
        per_class = np.bincount(owner, m.table[two, one, seq], n)
        in_class = np.bincount(parents, np.where(classes > OWN, logs, 0.0) - m.log_share[classes], n)
        rare = words.filter(pa.array(~known))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(parents[~known], minlength=n))]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("rid"),
                batch.column("doc_id"),
                batch.column("learn"),
                pa.array(np.bincount(owner, minlength=n).astype(np.int64)),
                pa.array(np.bincount(parents[known], minlength=n).astype(np.int64)),
                pa.array(np.bincount(parents, logs, n) + m.head.end_log_count),
                pa.array(per_class + in_class),
                pa.ListArray.from_arrays(offsets, rare),
            ],
            ["rid", "doc_id", "learn", "n_tokens", "known", "logs", "score", "rare"],
        )

    kind = df.schema[id_column].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "learn", "x")
    schema = f"rid bigint, doc_id {kind}, learn boolean, n_tokens bigint, known bigint, logs double, score double, rare array<string>"
    rows = written(arrow_map(rows, scored, schema, ["x"]), "scored")  # numbers the rows for good
    # a word outside the head is at most as frequent as the last one in it
    rare_words = rows.select("rid", F.explode("rare").alias("word"))
    last = int(top.column("c")[-1].as_py()) if top.num_rows else 0
    met = rare_words.join(counts.where(F.col("c") <= last), "word")
    more = met.groupBy("rid").agg(F.sum(F.log10(F.col("c") + 1)).alias("more"), F.count("*").alias("n"))
    end_known = 1 if total else 0
    out = rows.drop("rare").join(more, "rid", "left").withColumn("more", F.coalesce("more", F.lit(0.0)))
    every = float(np.log10(total + kinds + 1))
    return out.select(
        "doc_id",
        (~F.col("learn")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("n", F.lit(0)) + end_known).alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.col("more") - F.col("n_tokens") * every).alias("base_score"),
        (F.col("score") + F.col("more")).alias("score"),
    )
