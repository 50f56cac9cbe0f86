"""Term pipeline, token alignment and URL rules against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tabulens.llm import term_pipeline, token_align, url_rules
from tabulens.llm.queries import URL_RULES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- term pipeline ------------------------------------------------------------


def brute_search(docs, items, top):
    bags = [Counter(TERM.findall(lower(t))) for _, t in docs]
    sizes = [sum(b.values()) for b in bags]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for b in bags for t in b)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(TERM.findall(lower(text)))
    out = []
    for item, terms in asked.items():
        scores = []
        for (doc, _), bag, size in zip(docs, bags, sizes):
            m = 75 + (25 * size * n) // max(total, 1)
            s = 0
            for t, q in terms.items():
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    s += q * w * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m))
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        scores.sort()
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(scores[:top])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def library():
    rng = random.Random(5)
    rare = [f"w{i}é" for i in range(300)]
    often = ["the", "Of", "and", "ß", "x1"]

    def line(n):
        return " ".join(rng.choice(often) if rng.random() < 0.6 else rng.choice(rare) for _ in range(n))

    docs = [(i, line(rng.randrange(1, 60))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)]  # copies: ties beyond the top
    docs += [(2000, None), (2001, ""), (2002, " ,.\x00"), (None, docs[3][1]), (7, docs[7][1]), (7, docs[7][1])]
    docs += [(2003, "The-THE_the " * 3000), (-5, docs[9][1].upper())]
    items = [(i, docs[rng.randrange(300)][1] + " " + line(5)) for i in range(12)]
    items += [(20, docs[7][1]), (21, "the"), (22, None), (23, ""), (24, "never seen"), (None, docs[3][1]), (25, "and and AND of"), (25, "w1é")]
    return docs, items


@pytest.mark.parametrize("block, together", [(term_pipeline.BLOCK_BYTES, 1000), (700, 4)])
def test_search_equals_brute_force(spark, library, monkeypatch, block, together):
    docs, items = library
    monkeypatch.setattr(term_pipeline, "BLOCK_BYTES", block)
    monkeypatch.setattr(term_pipeline, "ITEMS_TOGETHER", together)
    d = spark.createDataFrame([(*r, "a", 1) for r in docs], "doc_id long, text string, term string, score int")
    q = spark.createDataFrame([(*r, 9) for r in items], "item_id long, text string, block int")
    got = sorted((tuple(r) for r in term_pipeline.search(d, q).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert got == brute_search(docs, items, 20)


def test_search_of_empty_tables(spark, library):
    docs = spark.createDataFrame(library[0][:20], "doc_id long, text string")
    items = spark.createDataFrame(library[1], "item_id long, text string")
    assert term_pipeline.search(docs.limit(0), items).count() == 0
    assert term_pipeline.search(docs, items.limit(0)).count() == 0
    silent = spark.createDataFrame([(1, None), (2, "..")], "doc_id long, text string")
    assert term_pipeline.search(silent, items).count() == 0


def test_search_shuffles_no_documents_and_plans_no_cross_join(spark, library):
    docs = spark.createDataFrame(library[0], "doc_id long, text string")
    items = spark.createDataFrame(library[1], "item_id long, text string")
    plan = term_pipeline.search(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == term_pipeline.OWNERS
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_owners_are_told_apart_by_frequency(spark):
    rows = spark.createDataFrame([(1,), (10,), (20,), (130,)], "df long")
    got = [r.o for r in rows.select(term_pipeline.owner_of(F.lit(1000), rows.df).alias("o")).collect()]
    assert got == [0, 1, 2, 3]


# --- token alignment ------------------------------------------------------------

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "a ", "  a", " ", "   ", "a\n  x", "a \tb", "\t", "a▁b", "</s> <s>[INST] <|endoftext|>x", "é ﬁ 　 x", "𝔘ni 🤖🤖", "\x00a", "a  b   c  ",
    "don't 's 'S", None, "", "\x1c  b", "tab\t  x \n\n y", "9 99  999", "<0x0A>", "a� b", "The cat sat on the mat. " * 40, "x" * 5000, "ж" * 3000 + " ü",
]


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    left, right = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    left.encode_special_tokens = True
    letters = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(letters.values()))}

    def piece(i):
        p = right.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if right.is_byte(i) else p.replace("▁", " ").encode()

    out, links = [], Counter()
    for t in texts:
        a = left.encode(" " + t, add_special_tokens=False).ids if t else []
        b = right.encode(t) if t else []
        a_bytes = [bytes(letters[c] for c in left.id_to_token(i)) for i in a]
        b_bytes = [piece(i) for i in b]
        if not t or b"".join(a_bytes) != (" " + t).encode() or b"".join(b_bytes) != (" " + t).encode():
            out.append((0, 0, [], ""))
            continue
        ends_a, ends_b = {}, {}
        for ends, parts in ((ends_a, a_bytes), (ends_b, b_bytes)):
            at = 0
            for i, x in enumerate(parts):
                at += len(x)
                ends[at] = i
        groups, pairs, pa, pb = [], [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            groups.append(",".join(map(str, a[pa : ends_a[e] + 1])) + "|" + ",".join(map(str, b[pb : ends_b[e] + 1])))
            pa, pb = ends_a[e] + 1, ends_b[e] + 1
            pairs.append((a[pa - 1], b[pb - 1]))
        links.update(pairs)
        out.append((len(a), len(b), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = {}
    for (_, b), n in links.items():
        most[b] = max(most.get(b, 0), n)
    return [
        (na, nb, len(p), len(p), sum(links[x] == most[x[1]] for x in p), sum(links[x] for x in p), digest) for na, nb, p, digest in out
    ]


def test_alignment_equals_brute_force(spark):
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    texts = ODD + real + real[:3]
    rows = [(i if i % 7 else None, t, "x", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pair string, row long")
    got = token_align.alignments(df, A, B)
    assert got.columns == ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(rows[i][0], *x) for i, x in enumerate(brute_alignment(texts))]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_alignment_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_align.alignments(none, A, B).count() == 0
    hollow = token_align.alignments(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), A, B)
    assert {tuple(r) for r in hollow.collect()} == {(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")}


def test_overlaps_are_all_pairs_that_share_bytes():
    aligner = token_align.Aligner(token_align.byte_level(A), token_align.sentence_pieces(B))
    a, b = aligner.tokens(["Ein übergroßes Beispiel.", None, "deux phrases, déjà vu", "x▁y", " "])
    got = set(aligner.overlaps(a, b)[["a", "b"]].itertuples(index=False, name=None))
    want = {
        (i, j)
        for i, x in enumerate(a.itertuples())
        for j, y in enumerate(b.itertuples())
        if x.doc == y.doc and x.start < y.end and y.start < x.end
    }
    assert got == want


def test_a_full_store_starts_anew(monkeypatch):
    monkeypatch.setattr(token_align, "REMEMBERED", 2)
    tools = [token_align.Aligner(token_align.byte_level(A), token_align.sentence_pieces(B)) for _ in range(2)]
    first = [tools[0].tokens([t])[0]["id"].tolist() for t in ("one two three", "two four", "one two three")]
    assert first[0] == first[2] == tools[1].tokens(["one two three"])[0]["id"].tolist()


# --- URL rules --------------------------------------------------------------------


def page(head="", body="x"):
    return f"<html><head>{head}</head><body>{body}</body></html>"


PAGES = [
    (1, "https://www.example.com/en/1", page(), "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    (2, "http://Blog.Example.COM/en/x?q=/de#f", page(), "blog.example.com", "/en/x", "example.com/en/", "block"),
    (3, "https://example.com/de/1", page(), "example.com", "/de/1", "com/", "allow"),
    (4, "https://notexample.com/en/1", page(), "notexample.com", "/en/1", "com/", "allow"),
    (5, "https://a.net/es/1", page(), "a.net", "/es/1", "net/es/", "block"),
    (6, "https://a.net/es", page(), "a.net", "/es", None, "allow"),
    (7, "https://a.net", page(), "a.net", "", None, "allow"),
    (8, None, page(), "", "", None, "allow"),
    (9, "no scheme", page(), "", "", None, "allow"),
    (10, "https://com?x", None, "com", "", None, "allow"),
    # an alias of a blocked page by its canonical link, and an alias of that alias by a refresh, in mixed spelling
    (11, "https://mirror.org/1", page('<link rel="canonical" href="https://a.net/es/1">'), "mirror.org", "/1", None, "block"),
    (12, "https://far.org/a/2?k=1&l=2#top", page("<META content='0; URL=https://mirror.org/1#z' HTTP-EQUIV=Refresh>"), "far.org", "/a/2", None, "block"),
    (13, "https://far.org/a/3", page('<link href="2?k=1&amp;l=2" rel="alternate canonical"/>'), "far.org", "/a/3", None, "block"),
    # an allow by rule in the component goes before its block
    (14, "https://both.org/1", page('<link rel=canonical href="//b.net/fr/9">'), "both.org", "/1", None, "allow"),
    (15, "https://b.net/fr/9", page('<link rel=canonical href=https://good.com/9>'), "b.net", "/fr/9", "net/fr/", "block"),
    # no edges: comments, scripts, other relations, links to itself, other schemes
    (16, "https://c.org/1", page('<!-- <link rel="canonical" href="https://a.net/es/1"> -->'), "c.org", "/1", None, "allow"),
    (17, "https://c.org/2", page('<link rel="stylesheet" href="https://a.net/es/1"><script>"<link rel=canonical href=https://a.net/es/1>"</script>'), "c.org", "/2", None, "allow"),
    (18, "https://c.org/3", page('<link rel="canonical" href="#top"><link rel="canonical" href="mailto:x@a.net">'), "c.org", "/3", None, "allow"),
    (11, "https://mirror.org/1", page(), "mirror.org", "/1", None, "block"),
    (None, "HTTPS://Mirror.org/1#part", None, "mirror.org", "/1", None, "block"),
    # a redirect from the given table
    (19, "https://old.org/1", page(), "old.org", "/1", None, "block"),
]


def test_rules_spread_over_aliases(spark):
    df = spark.createDataFrame(
        [(p, u, h, 5, "k", "v") for p, u, h, *_ in PAGES], "page_id long, url string, html string, host int, page string, spread string"
    )
    moved = spark.createDataFrame([("https://old.org/1", "https://a.net/es/1"), (None, "x"), ("y", None)], "from_url string, to_url string")
    rows = url_rules.verdicts(df, URL_RULES, moved)
    assert rows.columns == ["page_id", "url", "html", "page", "spread", "host", "path", "rule", "verdict"]
    got = rows.select("page_id", "url", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((p, u, *rest) for p, u, _, *rest in PAGES), key=repr)


def test_a_hub_and_a_chain_of_redirects(spark):
    edges = [(f"https://h.org/{i}", "https://hub.org/") for i in range(3000)]
    edges += [(f"https://chain.org/{i}", f"https://chain.org/{i + 1}") for i in range(40)] + [("https://chain.org/40", "https://x.net/fr/1")]
    pages = spark.createDataFrame(
        [(i, f"https://h.org/{i}") for i in range(3000)] + [(9000 + i, f"https://chain.org/{i}") for i in range(41)], "page_id long, url string"
    )
    moved = spark.createDataFrame(edges, "from_url string, to_url string")
    rows = url_rules.verdicts(pages, URL_RULES, moved, html=None)
    got = {(r.page_id >= 9000, r.verdict): r["count"] for r in rows.groupBy((rows.page_id >= 9000).alias("c"), "verdict", "page_id").count()
           .groupBy("c", "verdict").count().selectExpr("c", "verdict", "`count`", "IF(c, 9000, 0) AS page_id").collect()}
    assert got == {(False, "allow"): 3000, (True, "block"): 41}


def test_rules_of_an_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_rules.verdicts(none, URL_RULES).count() == 0
    only = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert url_rules.verdicts(only, [], html=None).first().verdict == "allow"


def test_rules_use_no_python_workers(spark):
    df = spark.createDataFrame([r[:3] for r in PAGES], "page_id long, url string, html string")
    plan = url_rules.verdicts(df, URL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
