"""The trained operators: counts against brute force, normalisation, held-out accuracy."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tabulens.llm import lang_id, lm_score

SYLLABLES = {"en": "th ing er on at es", "fr": "eux ez oi qu é tion", "de": "ung sch ich ei ß ver", "es": "ción os la ñ dor mente"}


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(9)
    rows = []
    for i in range(400):
        lang = rng.choice(list(SYLLABLES))
        parts = SYLLABLES[lang].split()
        words = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 80))]
        rows.append((i, " ".join(words).capitalize(), lang))
    return rows + [(400, None, "en"), (401, "", None), (402, " \t", "de"), (403, "!!! 123 ...", "fr"), (403, "!!! 123 ...", "fr"), (None, "the thing", "en"), (404, "unseen", None)]


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in low.translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ") if w] + [""]


def test_base_scores_and_counts_equal_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAD", 200)  # so that rare words take the join
    df = spark.createDataFrame([(i, t, 0.5) for i, t, _ in docs], "doc_id long, text string, score double")
    counts = Counter()
    learns = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
    for i, t, _ in docs:
        if learns(i):
            counts.update(split(t))
    n, v = sum(counts.values()), len(counts)
    assert v > 400
    got = lm_score.score(df).collect()
    assert len(got) == len(docs)
    want = []
    for i, t, _ in docs:
        w = split(t)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        want.append((str(i), not learns(i), len(w), sum(counts[x] > 0 for x in w), n, round(base, 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in got)


def test_an_end_rarer_than_the_head_counts(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAD", 2)
    learns = [i for i in range(20) if zlib.crc32(str(i).encode()) % 7 != 2][:2]
    df = spark.createDataFrame([(i, "a b a b c") for i in learns], "doc_id long, text string")
    for r in lm_score.score(df).collect():  # a and b 4 times each, c and the end 2 times
        want = 4 * math.log10(5 / 17) + 2 * math.log10(3 / 17)
        assert (r.n_tokens, r.n_known, round(r.base_score, 6)) == (6, 6, round(want, 6))


def test_probabilities_are_normalised():
    counts = np.random.default_rng(0).integers(0, 50, (lm_score.CLASSES,) * 3)
    table = lm_score.log_bilinear(counts)
    assert np.allclose((10**table).sum(axis=2), 1)
    learned = lm_score.log_bilinear(np.zeros((lm_score.CLASSES,) * 3, int))
    assert np.allclose((10**learned).sum(axis=2), 1)


def test_the_model_learns_what_follows_what():
    counts = np.zeros((8, 8, 8), int)
    for a in range(8):
        for b in range(8):
            counts[a, b, (b + 1) % 8] = 100
    table = lm_score.log_bilinear(counts)
    assert (table.argmax(axis=2) == (np.arange(8) + 1) % 8).all()


def test_contexts_do_not_cross_texts():
    words, parents = lm_score.tokens(pa.array(["A b", None, "c", " \n d  e f"]))
    assert words.to_pylist() == ["a", "b", "c", "d", "e", "f"] and parents.tolist() == [0, 0, 2, 3, 3, 3]
    seq, one, two, owner = lm_score.sequences(np.array([1, 2, 3, 4, 5, 6]), parents, 4)
    assert seq.tolist() == [1, 2, 0, 0, 3, 0, 4, 5, 6, 0]
    assert one.tolist() == [0, 1, 2, 0, 0, 3, 0, 4, 5, 6]
    assert two.tolist() == [0, 0, 1, 0, 0, 0, 0, 0, 4, 5]
    assert owner.tolist() == [0, 0, 0, 1, 2, 2, 3, 3, 3, 3]


def test_scores_without_training_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score.score(none).collect() == []
    unlearned = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = lm_score.score(spark.createDataFrame([(unlearned, "a b")], "doc_id long, text string")).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0)


def test_languages_of_held_out_texts(spark, docs):
    df = spark.createDataFrame([(i, t, g, "s") for i, t, g in docs], "doc_id long, text string, lang string, score string")
    model = lang_id.fit(df)
    assert model.langs == sorted(SYLLABLES)
    rows = {(r.doc_id, r.lang_pred, r.score) for r in lang_id.predictions(df, model).collect()}
    held = [(i, g) for i, _, g in docs if i is not None and i < 400 and zlib.crc32(str(i).encode()) % 4 == 2]
    pred = {i: p for i, p, _ in rows}
    assert sum(pred[i] == g for i, g in held) >= 0.97 * len(held)
    assert {i for i, p, _ in rows if p == "und"} == {400, 401, 402, 403}
    assert all(0 <= s <= 1 for _, _, s in rows)
    assert (abs(model.weights) > 0).mean() < 0.5  # sparse
    # language and id are no inputs
    moved = df.withColumn("lang", df.source if "source" in df.columns else df.score).withColumn("doc_id", df.doc_id + 1000)
    assert {(i - 1000 if i else i, p, s) for i, p, s in map(tuple, lang_id.predictions(moved, model).collect())} == rows


def test_languages_without_labels(spark):
    df = spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id long, text string, lang string")
    for rows in (df, df.limit(0)):
        assert all(r.lang_pred == "und" and r.score == 0 for r in lang_id.predictions(rows, lang_id.fit(rows)).collect())
