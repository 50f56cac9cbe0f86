"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts in lower case, with runs of other characters than letters as one space,
give hashed 1-, 2- and 3-grams.  A document's value of an n-gram is its share of
the document's n-grams times the n-gram's inverse document frequency, which is
counted over all training documents.  Weights come from follow-the-regularised-
leader with elastic-net penalties on a bounded sample (PER_LANG documents of each
language, by smallest hash); a part of the sample is set aside to choose the
temperature that divides the scores.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, give_back, in_pieces

UNKNOWN = "und"
#: Bits of the hashed n-grams, n = 1, 2, 3, and where each n starts in the feature space.
BITS = (12, 14, 16)
STARTS = (0, 1 << 12, (1 << 12) + (1 << 14))
FEATURES = sum(1 << b for b in BITS)
#: The sample: so many documents of each language; with many languages fewer, so that all have about TOTAL.
PER_LANG, LEAST_PER_LANG, TOTAL = 500, 20, 4_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1e-4, 1e-4
#: Every so many-th sampled document chooses the temperature.
ASIDE = 5
OTHER = re.compile(r"[\W\d_]+")
LETTER = re.compile(r"[^\W\d_]")


def features(text: str | None) -> np.ndarray:
    """The hashed n-grams of a text, repeats included; none without a letter."""
    if not text or not LETTER.search(text):
        return np.zeros(0, np.int64)
    c = np.frombuffer(f" {OTHER.sub(' ', text.lower()).strip()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    parts = []
    for n, (bits, start) in enumerate(zip(BITS, STARTS), 1):
        h = c[: len(c) - n + 1].copy()
        for i in range(1, n):
            h = h * np.uint64(0x100000001B3) ^ c[i : len(c) - n + 1 + i]
        h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
        parts.append(h.astype(np.int64) + start)
    return np.concatenate(parts)


def trained_on(id_column: Column, modulus: int = 4, rest: int = 2) -> Column:
    """Whether a row may be learned from; rows without an id may not."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % modulus != rest, F.lit(False))


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES, 0)))  # times idf
    temperature: float = 1.0

    def scores(self, grams: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.langs))
        for at in range(0, len(grams), 1 << 16):
            total += self.weights[grams[at : at + (1 << 16)]].sum(axis=0)
        return total / max(len(grams), 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = features(text)
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0
        p = softmax(self.scores(grams) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def train(sample: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray) -> Model:
    """FTRL over (lang, n-grams, counts), in the order given, and the temperature from every ASIDE-th row."""
    langs = sorted({lang for lang, _, _ in sample})
    if not langs:
        return Model()
    place = {lang: i for i, lang in enumerate(langs)}
    rows = [(place[lang], g, c / c.sum() * idf[g]) for lang, g, c in sample if len(g)]
    if not rows:
        return Model()
    aside = rows[::ASIDE] if len(rows) >= 2 * ASIDE else rows
    learned = [r for i, r in enumerate(rows) if i % ASIDE] if len(rows) >= 2 * ASIDE else rows
    z, n = np.zeros((FEATURES, len(langs))), np.zeros((FEATURES, len(langs)))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= L1, 0.0, (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for y, g, x in learned:
            zs, ns = z[g], n[g]
            w = weights(zs, ns)
            p = softmax(x @ w)
            p[y] -= 1
            grad = np.outer(x, p)
            squared = grad * grad
            z[g] = zs + grad - (np.sqrt(ns + squared) - np.sqrt(ns)) / ALPHA * w
            n[g] = ns + squared
    w = weights(z, n)
    logits = np.array([x @ w[g] for _, g, x in aside])
    truth = np.array([y for y, _, _ in aside])
    best, temperature = None, 1.0
    for t in np.geomspace(0.02, 20, 121):
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        loss = float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(truth)), truth]).mean()) + 1e-3 / t
        if best is None or loss < best:
            best, temperature = loss, float(t)
    return Model(langs, w * idf[:, None], temperature)


def fit(df: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model from the rows that ``trained_on`` allows and that have a language."""
    rows = df.select(
        df[id_column].cast("string").alias("id"), df[text].alias("x"), df[lang].alias("lang"), trained_on(df[id_column]).alias("ok")
    ).where("ok AND lang IS NOT NULL")

    def frequencies(batches):
        seen, counts, n = np.zeros(FEATURES, bool), np.zeros(FEATURES, np.int64), 0

        def count(piece: pa.RecordBatch) -> list[pa.RecordBatch]:
            nonlocal n
            for x in piece.column("x").to_pylist():
                g = features(x)
                n += bool(len(g))
                seen[g] = True
                np.add(counts, seen, out=counts)
                seen[g] = False
            return []

        yield from in_pieces(batches, count, ["x"])
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], n))], ["g", "n"])

    # at most FEATURES + 1 rows
    frequency = dict(rows.select("x").mapInArrow(frequencies, "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n")).collect())
    documents = frequency.pop(-1, 0)
    counts = np.zeros(FEATURES)
    counts[list(frequency)] = list(frequency.values())
    idf = np.log((1 + documents) / (1 + counts)) + 1

    marked = rows.select("lang", F.xxhash64("id").alias("h"), "x")
    sizes = {r["lang"]: r["count"] for r in marked.groupBy("lang").count().collect()}  # one row per language
    quota = min(PER_LANG, max(LEAST_PER_LANG, TOTAL // max(len(sizes), 1)))
    # hashes are spread evenly: the smallest ones up to a bound hold about twice the quota
    limit = F.create_map(*(x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 2 * quota / v + 64 / v))))) if sizes else None
    if limit is None:
        return Model()
    share = (F.col("h") / float(1 << 64)) + 0.5
    few = marked.where(share <= limit[F.col("lang")])

    def sampled(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [np.unique(features(x), return_counts=True) for x in batch.column("x").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("lang"),
                batch.column("h"),
                pa.array([g.astype(np.int32).tobytes() for g, _ in made], pa.binary()),
                pa.array([c.astype(np.int32).tobytes() for _, c in made], pa.binary()),
            ],
            ["lang", "h", "g", "c"],
        )

    taken = arrow_map(few, sampled, "lang string, h bigint, g binary, c binary", ["x"]).collect()  # the bounded sample
    by_lang: dict[str, list] = {}
    for r in sorted(taken, key=lambda r: (r.h, r.lang, bytes(r.g))):
        if len(by_lang.setdefault(r.lang, [])) < quota:
            by_lang[r.lang].append(r)
    ordered = sorted((r for rs in by_lang.values() for r in rs), key=lambda r: (r.h, r.lang, bytes(r.g)))
    return train([(r.lang, np.frombuffer(r.g, np.int32), np.frombuffer(r.c, np.int32)) for r in ordered], idf)


def predictions(
    df: DataFrame,
    model: Model,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    names_out: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """``keep`` columns, the predicted language and its probability for every row, from the text alone.

    Texts that are null or have no letter, and all texts if nothing was learned,
    get ``und`` with score 0.  Repeated rows each get their row; columns not
    kept are left out.
    """
    names = [f"k{i}" for i in range(len(keep))]
    kinds = [df.schema[k].dataType.simpleString() for k in keep]
    rows = df.select(*(df[k].alias(n) for k, n in zip(keep, names)), df[text].alias("x"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        made = [m.predict(x) for x in batch.column("x").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array([p for p, _ in made], pa.string()), pa.array([s for _, s in made], pa.float64())],
            [*names, "lang_pred", "score"],
        )

    out = arrow_map(rows, work, ", ".join([*(f"{n} {k}" for n, k in zip(names, kinds)), "lang_pred string", "score double"]), ["x"])
    return out.select(
        *(out[n].alias(k) for k, n in zip(keep, names)), out["lang_pred"].alias(names_out[0]), out["score"].alias(names_out[1])
    )


def accepts(spark: SparkSession, model: Model, least: float):
    """A function of a text column: whether its language is known and at least so probable; only the text goes to Python."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def accepted(texts: pa.Array) -> pa.Array:
        made = (shared.value.predict(x.as_py()) for x in texts)
        told = pa.array([lang != UNKNOWN and score >= least for lang, score in made], pa.bool_())
        give_back()
        return told

    return accepted
