"""The tokenizing operators against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tabulens.llm import bpe_automaton, id_store
from tokenizers import Tokenizer

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
NASTY = [
    None, "", " ", "\n\n", "aaaaaaaaaaa", "The quick brown fox's 12,345.67!", "<|endoftext|>", "a<|startoftext|>B <|endoftext|>",
    "é é İıſß ΣΑΣ", "日本語 テキスト 𝔘𝔫𝔦", "\x00\x1c\x85​　x", "x" * 5000, "don't  DON'T\t'll", "ñ" * 300, "…“”€–—",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    alphabet = "abcdefghij etaoin ETAOIN .,'-019éñß\n\t"
    return NASTY + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(150)]


def rows(texts):
    return [(i, t, "x") for i, t in enumerate(texts)]


def test_automaton_encodes_and_decodes_as_the_library(spark, texts):
    library = Tokenizer.from_file(WORDS)
    df = spark.createDataFrame(rows(texts + [texts[5]]), "doc_id long, text string, ids string")  # a clashing name, a repeated text
    got = {r.doc_id: r for r in bpe_automaton.encode(df, WORDS).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == want, t
        assert got[i].decoded == library.decode(want, skip_special_tokens=False)


def test_automaton_equals_merging_by_rank_on_small_alphabets():
    rng = random.Random(3)
    for _ in range(60):
        vocab = {c: i for i, c in enumerate("abc")}
        merges = []
        while len(merges) < 12:
            a, b = rng.choice(list(vocab)), rng.choice(list(vocab))
            if a + b not in vocab and len(a + b) < 9:
                vocab[a + b] = len(vocab)
                merges.append((a, b))
        automaton = bpe_automaton.MergeAutomaton(vocab, merges)
        assert automaton.states <= len(merges) + 1
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))
            parts = list(word)
            for a, b in merges:
                i = 0
                while i < len(parts) - 1:
                    if parts[i] == a and parts[i + 1] == b:
                        parts[i : i + 2] = [a + b]
                    i += 1
            assert automaton.path(word) == tuple(vocab[p] for p in parts), (word, merges)


def test_automaton_on_an_empty_table(spark):
    assert bpe_automaton.encode(spark.createDataFrame([], "doc_id long, text string"), WORDS).collect() == []


def test_id_store_gives_back_what_the_library_encodes(spark, texts, tmp_path):
    library = Tokenizer.from_file(BYTES)
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    df = spark.createDataFrame([(i * 3 - 20, texts[i]) for i in order] + [(None, "no id")], "doc_id long, text string")
    id_store.write_packs(df, str(tmp_path / "ids"), BYTES, end_id=0)
    got = {r.doc_id: r for r in id_store.read_packs(spark, str(tmp_path / "ids")).collect()}
    start = len(library.encode("no id").ids) + 1  # a null id comes first
    assert got[None].start == 0
    for i, t in enumerate(texts):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        r = got[i * 3 - 20]
        assert (r.start, r.n_tokens, bytes(r.data)) == (start, len(ids), ids.tobytes()), t
        assert zlib.crc32(bytes(r.data)) == zlib.crc32(ids.tobytes())
        start += len(ids)
    one = id_store.read_document(spark, str(tmp_path / "ids"), 5 * 3 - 20)
    assert [x.tolist() for x in one] == [library.encode(texts[5]).ids + [0]]
    name, data = id_store.load_dictionary(spark, str(tmp_path / "ids"))
    assert hashlib.sha256(data).hexdigest() == name


def test_id_store_of_an_empty_table_and_of_repeated_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    id_store.write_packs(empty, str(tmp_path / "none"), BYTES, end_id=0)
    assert id_store.read_packs(spark, str(tmp_path / "none")).collect() == []
    twice = spark.createDataFrame([(1, "one two"), (1, "one two"), (0, None)], "doc_id long, text string")
    id_store.write_packs(twice, str(tmp_path / "twice"), BYTES, end_id=0)
    got = sorted((r.doc_id, r.start, r.n_tokens) for r in id_store.read_packs(spark, str(tmp_path / "twice")).collect())
    assert got == [(0, 0, 1), (1, 1, 3), (1, 4, 3)]


def test_ids_never_wrap(spark, tmp_path):
    df = spark.createDataFrame([(1, "two words")], "doc_id long, text string")
    path = str(tmp_path / "large")
    id_store.write_packs(df, path, BYTES, end_id=70_000)
    (r,) = id_store.read_packs(spark, path).collect()
    assert np.frombuffer(r.data, "<u4")[-1] == 70_000
    assert id_store.width_for(BYTES, 0) == 2
    with pytest.raises(ValueError):
        id_store.serialized(np.array([65_536], np.uint32), 2)
