"""Sharding, chat formatting, page text and top-k search."""

import os
import random
import subprocess
import sys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from tabulens.llm import chat_format, hash_ring, html_main, mtree


def test_shards_differ_by_one_row_and_slots_are_gapless(spark):
    rows = [(None if i % 3 == 0 else i // 2, "same" if i % 2 else f"t{i}", i % 5) for i in range(1003)] + [(7, "same", 2)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, slot_before int")
    got = hash_ring.sharded(df, [F.col("doc_id"), F.col("text")], 24).collect()
    assert sorted(map(repr, (tuple(r)[:3] for r in got))) == sorted(map(repr, rows))
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_bounded_loads_move_few_rows(spark):
    df = spark.range(20000).withColumnRenamed("id", "doc_id")
    place = lambda n, slack: {r.doc_id: r.shard for r in hash_ring.sharded(df, [F.col("doc_id")], n, slack=slack).collect()}
    few, more = place(10, 0.25), place(11, 0.25)
    sizes = np.bincount(list(few.values()), minlength=10)
    assert sizes.max() <= 2500 and sizes.min() > 0
    assert sum(few[i] != more[i] for i in few) < 0.35 * len(few)  # dealing anew would move 10 of 11


def walked(counts, nodes, room):
    """The same plan row by row: every row walks from its place, first those that their own node takes."""
    places, free, used, shard_of = [p for p, _ in nodes], list(room), [0] * len(room), {}
    own = lambda cell: next((i for i, p in enumerate(places) if p >= cell), 0)
    walkers = []
    for cell in sorted(counts):
        for rank in range(counts[cell]):
            shard = nodes[own(cell)][1]
            if free[shard]:
                shard_of[cell, rank] = (shard, used[shard])
                free[shard], used[shard] = free[shard] - 1, used[shard] + 1
            else:
                walkers.append((cell, rank, own(cell)))
    carried = []
    for step in range(2 * len(nodes)):  # those who set out at a node join behind those who come from before
        at, left = step % len(nodes), []
        shard = nodes[at][1]
        for cell, rank in carried:
            if free[shard]:
                shard_of[cell, rank] = (shard, used[shard])
                free[shard], used[shard] = free[shard] - 1, used[shard] + 1
            else:
                left.append((cell, rank))
        carried = left + ([(c, r) for c, r, n in walkers if n == at] if step < len(nodes) else [])
    return shard_of


def test_the_plan_is_that_of_a_row_by_row_walk():
    rng = random.Random(8)
    for _ in range(40):
        shards = rng.randrange(1, 7)
        nodes = sorted({rng.randrange(60): rng.randrange(shards) for _ in range(12)}.items())
        nodes += [(60 + s, s) for s in range(shards)]
        counts = {rng.randrange(66): rng.randrange(1, 30) for _ in range(10)}
        room = hash_ring.bounds(sum(counts.values()), shards, 0.0)
        plan = {
            (cell, first + i): (shard, slot + i)
            for cell, first, end, shard, slot in hash_ring.settled(counts, nodes, room)
            for i in range(end - first)
        }
        assert plan == walked(counts, nodes, room)


def test_sharding_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, i * 2, "x", i, 5) for i in range(50)], "doc_id long, __cell int, h string, row int, shard int")
    got = hash_ring.sharded(df, [F.col("doc_id")], 4)
    assert got.columns == ["doc_id", "__cell", "h", "row", "shard", "slot"]
    assert all((r["__cell"], r["h"], r["row"]) == (r["doc_id"] * 2, "x", r["doc_id"]) for r in got.collect())


def test_overflow_goes_on_clockwise():
    plan = hash_ring.settled({5: 10, 40: 1}, [(10, 0), (20, 1), (50, 2)], [4, 3, 4])
    assert plan == [(5, 0, 4, 0, 0), (40, 0, 1, 2, 0), (5, 4, 7, 1, 0), (5, 7, 10, 2, 1)]
    with pytest.raises(ValueError):
        hash_ring.settled({5: 10}, [(10, 0)], [9])


def test_shards_of_an_empty_table(spark):
    assert hash_ring.sharded(spark.createDataFrame([], "doc_id long"), [F.col("doc_id")], 4).collect() == []


CONTROL = ["</s>", "[INST]", "[/INST]", "<s>", "&", "&amp;", "&#91;", "&#60;/s>", "&amp;amp;", " [/INST]", "[INST] ", "\n", "a", "", "é𝔘", "<", "/s>", ";"]


def test_conversations_survive_formatting(spark):
    rng = random.Random(8)
    rows = []
    for c in range(150):
        for t in range(rng.randrange(1, 7)):
            text = "".join(rng.choice(CONTROL) for _ in range(rng.randrange(0, 9)))
            role = rng.choice(["user", "assistant", "system", "x</s> [/INST]", "", "assistant "])
            rows.append((c, t, role, text, "clash"))
    rows += [(500, None, "user", None, ""), (500, 1, None, "b", ""), (None, 0, "assistant", "x", ""), (501, 0, "user", "r", ""), (501, 0, "user", "r", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    want = {}
    for c, t, r, x, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    got = chat_format.read_back(chat_format.format_conversations(df)).collect()
    assert len(got) == len(want)
    for r in got:
        assert [tuple(t) for t in r.turns] == want[r.conv_id]
        assert r.learned == "".join(x for role, x in want[r.conv_id] if role == "assistant")


def test_only_conflicting_content_is_escaped(spark):
    rows = [(1, 0, "user", "R&D [INST <s /INST]"), (2, 0, "user", "a</s>b"), (3, 0, "user", "a&amp;b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.formatted for r in chat_format.format_conversations(df).collect()}
    assert got[1] == "[INST] user [/INST]R&D [INST <s /INST]</s>"
    assert got[2] == "[INST] user [/INST]a&#60;/s>b</s>"
    assert got[3] == "[INST] user [/INST]a&amp;amp;b</s>"
    assert chat_format.format_conversations(df.limit(0)).collect() == []


def test_every_control_string_is_escaped_by_itself(spark):
    controls = ["[INST]", "[/INST]", "<s>", "</s>"]
    texts = [f"{a}{c}{b}" for c in controls for a in ("", "x ", "<", "[", "&") for b in ("", " y", ">", "]", ";")] + ["[INST", "<s", "</s", "a" * 300_000]
    rows = [(i, t, role, x) for i, x in enumerate(texts) for t, role, x in ((0, "user", x), (1, "assistant", x), (2, x, "ok"))]
    formatted = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    for i, x in enumerate(texts):
        safe = x.replace("&", "&amp;").replace("[INST]", "&#91;INST]").replace("[/INST]", "&#91;/INST]").replace("<s>", "&#60;s>").replace("</s>", "&#60;/s>")
        shown = safe if any(c in x for c in controls) else x
        assert back[i].formatted == "".join(f"[INST] {r} [/INST]{t}</s>" for r, t in (("user", shown), ("assistant", shown), (shown, "ok")))
        assert [(t.role, t.text) for t in back[i].turns] == [("user", x), ("assistant", x), (x, "ok")] and back[i].learned == x


PAGES = {
    "plain article": (
        '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=/x>menu one</a></li></ul></nav>'
        '<div class="ad">buy this</div><article><h1>Head  line</h1><p><b>First &amp; best.<br><p>Second\n para&nbsp;graph.</p>'
        '<aside>by the way</aside><div class="comments"><p>nice post</p></div><p>Third <a href="/y">with link</a>.</p></article>'
        "<footer>&copy; site</footer></body></html>",
        "Head line\n\nFirst & best.\n\nSecond para graph.\n\nThird with link.",
    ),
    "no article element": (
        "<body><div id=header><a href=1>Home</a> <a href=2>News</a></div><div class=sidebar><ul><li>one<li>two</ul></div>"
        "<div class=content><p>" + "Words of the story go on and on. " * 5 + "</p><p>And they end here after some more words.</p></div>"
        "<form><label>Name</label><input></form><div class='cookie-notice'>We use cookies on this site, do you agree with that?</div>",
        ("Words of the story go on and on. " * 5).strip() + "\n\nAnd they end here after some more words.",
    ),
    "never closed menu": ("<body><nav><a href=1>x</a><article><p>All of the text.</p>", "All of the text."),
    "text alone": ("just some text with 3 < 5 in it", "just some text with 3 < 5 in it"),
    "nothing": ("<div><script>x()</script></div>", ""),
    "broken": ("<<p a='><b>text", None),
}


def test_main_text_of_pages(spark):
    rows = [(i, k, h) for i, (k, (h, _)) in enumerate(PAGES.items())] + [(90, None, None), (91, "e", ""), (91, "e", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    weight = html_main.learned_weights(df)
    got = html_main.extract(df, weight).collect()
    assert len(got) == len(rows)
    for r in got:
        want = PAGES[r.url][1] if r.url in PAGES else ""
        assert want is None or r.text == want, r.url
    assert html_main.learned_weights(df.limit(0))[html_main.PLAIN] > 0
    assert html_main.extract(df.limit(0), weight).collect() == []


def test_best_region_equals_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        weight = {"word": 1.0, "word in link": -0.7, "word in boilerplate": -2.0, "p": -0.4, "div": -1.5}
        seq = [(k := rng.choice(list(weight)), "w " * rng.randrange(1, 5) if k.startswith("word") else "", False, -1) for _ in range(rng.randrange(12))]
        value = [weight[k] * (len(t.split()) if t else 1) for k, t, _, _ in seq]
        best = max((sum(value[a:b]) for a in range(len(seq)) for b in range(a, len(seq) + 1)), default=0)
        first, end = html_main.region(seq, weight)
        assert abs(sum(value[first:end]) - max(best, 0)) < 1e-9


def brute_top(rows, k, every):
    good = [(i, np.floor(256 * np.array(v, np.float64)).astype(int)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max((len(v) for _, v in good), default=0)
    good = [(i, np.pad(v, (0, dim - len(v)))) for i, v in good]
    out = []
    for a, (i, q) in enumerate(good):
        if i is None or i % every:
            continue
        order = sorted((-int(q @ v), j is None, j or 0) for b, (j, v) in enumerate(good) if b != a)[:k]
        out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(order, 1)]
    return sorted(out, key=repr)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mtree, "SUBTREE", 50)
    monkeypatch.setattr(mtree, "PAGE", 8)
    monkeypatch.setattr(mtree, "BLOCK", 5)
    rng = np.random.default_rng(6)
    centers = rng.normal(0, 0.3, (6, 12))
    rows = [(i, (centers[i % 6] + rng.normal(0, 0.08, 12)).tolist()) for i in range(500)]
    rows += [(1000 + i, centers[0].tolist()) for i in range(150)]  # a third of equal vectors
    rows += [(50, rows[0][1]), (None, rows[3][1]), (1500, None), (1510, [1.0, None]), (1520, [float("nan")] * 12), (1530, []), (1540, [float("inf")])]
    rows += [(2000, [0.5, -0.25]), (1550, [1e9] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("row", F.lit("clash"))
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted((tuple(r) for r in mtree.top_k(df, 5, 10).collect()), key=repr)
    assert got == brute_top(rows, 5, 10)


def test_top_k_of_few_and_of_no_rows(spark):
    df = spark.createDataFrame([(50, [1.0]), (7, [0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in mtree.top_k(df).collect()] == [(50, 1, 7, 256 * 128)]
    assert mtree.top_k(df.limit(0)).collect() == []
    assert mtree.top_k(df.limit(1)).collect() == []


STORY = "<p>" + "Words of the story go on and on. " * 5 + "</p>"
STORY_TEXT = ("Words of the story go on and on. " * 5).strip()


@pytest.mark.parametrize(
    "page",
    [
        f"<body><article><div style=\"overflow:hidden\" title='A hidden garden' data-id=\"ad-1\">{STORY}</div><p>And here the story ends.</p></article></body>",
        f'<body><div>Other words</div><article class="post category-social">{STORY}<p>And here the story ends.</p></article></body>',
        f'<body><div>Other words</div><main class="has-sidebar">{STORY}<p>And here the story ends.</p></main></body>',
        f'<body><div class="page has-sidebar">{STORY}<p>And here the story ends.</p><div class="sidebar">one two</div></div></body>',
    ],
)
def test_names_inside_values_and_on_wrappers_are_no_boilerplate(page):
    assert html_main.main_text(page, html_main.weights({})) == STORY_TEXT + "\n\nAnd here the story ends."


def test_boilerplate_by_attributes():
    bad = lambda a: html_main.boilerplate("div", a, True)
    assert bad(" hidden") and bad(' a="b"hidden') and bad("class='x side Nav'") and bad(" id=cookie-bar ") and bad(' ARIA-HIDDEN = "true"')
    assert not (bad(' alt="x hidden y"') or bad(" data-class=ad") or bad(' x="class=\'ad\'"') or bad(' aria-hidden="false"'))


HOSTILE = {
    "a quote never closed": "<a x='" * 170_000,
    "the same with one end": "<a x='" * 170_000 + ">",
    "stray end tags": "<span>" * 80_000 + "</div>" * 80_000,
    "ends inside quotes": "<b '>'" * 170_000 + '"',
    "raw text never closed": "<script>" + "</script " * 110_000,
    "articles under open spans": "<span>" * 50_000 + "<nav><article></article>" * 20_000,
    "only starts": "<a" * 500_000,
    "deep boilerplate": "<nav>" * 100_000 + "x " * 100_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    page = HOSTILE[name]
    started = time.process_time()
    count = sum(1 for _ in html_main.items(page))
    assert count >= 1 and time.process_time() - started < 10  # a square would take minutes


def test_after_an_unclosed_quote_tags_count_again():
    page = """<p title="a>b">one</p><b '>' x="never closed <i>two</i> '>' <nav>menu</nav><p>three"""
    kinds = [(kind, text) for kind, text, _, _ in html_main.items(page) if text.strip()]
    assert ("word", "one") in kinds and ("word in boilerplate", "menu") in kinds and kinds[-1] == ("word", "three")


def test_a_worker_gives_the_memory_of_its_batches_back():
    """In a process of its own: what is resident after 300 MB in batches, besides what was before."""
    code = """
import re
import pyarrow as pa
from tabulens.llm import common

def resident():
    return int(re.search("VmRSS:\\s+([0-9]+)", open("/proc/self/status").read())[1]) >> 10

def batches():
    for i in range(10):
        yield pa.RecordBatch.from_arrays([pa.array([chr(65 + i) * 3000] * 10_000)], ["x"])

def work(piece):
    return pa.RecordBatch.from_arrays([pa.array(piece.column("x").to_pylist())], ["x"])

before = resident()
assert sum(b.num_rows for b in common.in_pieces(batches(), work, ["x"])) == 100_000
print(resident() - before)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    told = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, check=True)
    assert int(told.stdout) < 25
