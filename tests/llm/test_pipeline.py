"""The pipeline's stages on a small corpus with planted cases."""

import random

import corpus_pipeline
import pytest
from tabulens.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(12)
    words = {"en": "the thing and or with from then ering tion".split(), "de": "der die und ich ung schen ein ber keit".split()}
    line = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice(words[lang]) for _ in range(n))
    docs = [(i, line("en" if i % 2 else "de", 60), "en" if i % 2 else "de", "s", 0) for i in range(60)]
    item = line("en", 25)
    docs += [(100, docs[3][1], "en", "s", 0), (101, docs[3][1] + " x", None, None, None), (102, "%% 12 34", None, "s", 0), (103, None, "de", "s", 0)]
    docs += [(104, line("en", 20) + " " + item + " " + line("en", 20), "en", "s", 0), (105, docs[7][1], "en", "s", 0), (105, docs[7][1], "en", "s", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int")
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_keep_clean_documents_and_drop_planted_ones(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.columns, stage(spark, docs, folder).persist()
        assert docs.columns == before
        left.append(sorted(r.doc_id for r in docs.collect()))
    everything = [*range(60), 100, 101, 104, 105, 105]
    assert left[0] == everything
    assert left[1] == [*range(60), 104]
    assert left[2] == [*range(60)]


def test_the_run_ends_with_token_ids(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == [*range(60)]
    assert all(r.n_tokens == len(r.ids) > 0 for r in rows)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 14))
