"""Decontamination and near-duplicates against brute force."""

import random
import re

import corpus_pipeline
import pytest
import xxhash
from tabulens.llm import decontam, simhash_index
from tabulens.llm import near_copies as near_copies_module

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_hits(docs, items):
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[tuple(w[i : i + size])]
        out.append((doc, len(w), len(hit), sorted(str(f) for f in found if f is not None)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(2)
    words = ["ab", "cd", "ef", "é", "gh1", "The", "of"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, line(rng.choice([12, 20, 30]))) for i in range(8)]
    items += [(8, "short one here"), (9, "tiny"), (10, None), (11, " ,. "), (12, items[0][1]), (None, items[1][1]), (8, line(15))]
    docs = [(i, line(rng.randrange(0, 60))) for i in range(40)]
    for i in range(40, 70):
        item = rng.choice(items[:8])[1].split()
        a = rng.randrange(len(item) - 9)
        cut = item[a : a + rng.randrange(9, len(item))]
        docs.append((i, line(rng.randrange(20)) + " -- " + ",\n".join(cut).upper() + ". " + line(rng.randrange(20))))
    docs += [(70, None), (71, ""), (72, "a Short, ONE here!"), (72, "a Short, ONE here!"), (None, items[2][1]), (73, "tiny " * 300)]
    return docs, items


def test_decontamination_equals_brute_force(spark, passages):
    docs, items = passages
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in docs], "doc_id long, text string, n int, key string")
    rows = decontam.contamination(df, spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(((r.id, r.n_words, r.n_hit, r.items) for r in rows.collect()), key=repr)
    assert got == brute_hits(docs, items)
    assert sum(r[2] > 0 for r in got) > 10
    kept = decontam.clean_rows(df, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == df.columns
    assert kept.count() == sum(r[2] == 0 for r in got)


def test_decontamination_of_empty_tables(spark, passages):
    none_docs = spark.createDataFrame([], "doc_id long, text string")
    none_items = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame(passages[0], "doc_id long, text string")
    assert decontam.contamination(none_docs, spark.createDataFrame(passages[1], "item_id long, text string")).count() == 0
    assert decontam.contamination(docs, none_items).where("n_hit > 0 OR size(items) > 0").count() == 0


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    value = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return value - (1 << 64) if value >> 63 else value


def brute_components(rows):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    fps = [brute_fingerprint(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, fps[i], least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.fixture(scope="module")
def near_copies():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = [(None, "no id at all"), (None, "no id at all"), (900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two")]
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([40, 120, 400]))]
        for c in range(rng.randrange(1, 9)):
            text = list(base)
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((g * 20 + c, " ".join(text)))
    rows.append(rows[-1])
    rng.shuffle(rows)
    return rows


def test_groups_equal_brute_force(spark, near_copies):
    df = spark.createDataFrame([(d, t, 0) for d, t in near_copies], "doc_id long, text string, fp int")
    got = sorted(((r.id, r.fp, r.component_id) for r in simhash_index.groups(df).collect()), key=repr)
    assert got == brute_components(near_copies)
    assert len({r[2] for r in got}) < len(near_copies) - 5


def test_one_of_each_group_stays(spark, near_copies):
    df = spark.createDataFrame([(d, t, "x") for d, t in near_copies], "doc_id long, text string, root string")
    kept = simhash_index.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    want = {r[2] for r in brute_components(near_copies)}
    assert sorted(ids, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("bucket", [64, 3])
def test_links_connect_all_close_fingerprints(spark, monkeypatch, bucket):
    """5,000 distinct fingerprints in one entry of a segment's table, and scattered ones, against brute force."""
    monkeypatch.setattr(simhash_index, "BUCKET", bucket)
    rng = random.Random(6)
    fps = {(0xABCD1234 << 32 | rng.getrandbits(13) << 4) for _ in range(9000)}
    fps = set(list(fps)[:5000])
    for _ in range(1500):
        base = rng.getrandbits(64)
        fps |= {base, base ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64), base ^ 1 << rng.randrange(64), rng.getrandbits(64)}
    fps |= {f ^ 1 << 32 + rng.randrange(32) ^ 1 << rng.randrange(32) for f in rng.sample(sorted(fps), 300)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    distinct = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = simhash_index.close_pairs(distinct)
    assert links.where("bit_count(u ^ v) > 2 OR u <= v").count() == 0
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    known = set(signed)
    flips = [1 << i for i in range(63)] + [-(1 << 63)]
    masks = flips + [a ^ b for i, a in enumerate(flips) for b in flips[:i]]
    for f in signed:
        for m in masks:
            if f ^ m in known:
                root[find(f)] = find(f ^ m)
    want = {}
    for f in signed:
        want.setdefault(find(f), set()).add(f)
    got = {}
    joined = {r.u: r.v for r in simhash_index.connected(links).collect()}
    for f in signed:
        got.setdefault(joined.get(f, f), set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert max(map(len, want.values())) > 1000


def test_groups_of_an_empty_table(spark):
    assert simhash_index.groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_chains_become_one_component(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)], "u long, v long")
    assert {(r.u, r.v) for r in simhash_index.connected(edges).collect()} == {(i, 0) for i in range(1, 201)}


def brute_similar_groups(rows):
    """Components of rows whose sets of 5-word shingles have a Jaccard similarity of at least 0.8."""
    sets = []
    for _, text in rows:
        w = lower(text).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if root[i] != root[j] and (sets[i] == sets[j] or 5 * common >= 4 * len(sets[i] | sets[j])):
                root = [root[j] if r == root[i] else r for r in root]
    return root


def test_word_edited_copies_are_found_by_exact_similarity(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, " "), (2, "one"), (3, "ONE"), (4, "one two")]
    for g in range(15):
        base = [rng.choice(words) for _ in range(rng.choice([60, 150, 500]))]
        for c in range(8):
            text = list(base)
            for _ in range(rng.randrange(1 + len(base) // 40)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((100 + g * 20 + c, " ".join(text)))
    rng.shuffle(rows)
    root = brute_similar_groups(rows)
    want = sorted(min(d for d, _ in (rows[j] for j in range(len(rows)) if root[j] == r)) for r in set(root))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == want
    assert len(want) < simhash_index.keep_one(df).count() - 20
    assert corpus_pipeline.near_dedup(spark, df.limit(0), "").collect() == []


def template_pages(n):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    shared = [rng.choice(words) for _ in range(150)]
    return [(i, " ".join(shared + [rng.choice(words) for _ in range(46)])) for i in range(n)]


def test_pages_of_one_template_meet_in_few_pairs(spark, monkeypatch):
    """A similarity of 0.6: no links, and the candidates grow with the pages, not with their square."""
    counted = []
    real = near_copies_module.verified

    def verified(pairs, sets):
        counted.append(pairs.count())
        return real(pairs, sets)

    monkeypatch.setattr(near_copies_module, "verified", verified)
    pages = template_pages(2000)
    rows = pages + [(5000, pages[5][1].replace(" ", "  ")), (5001, pages[9][1] + " tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash_index.keep_one(df, grouping=near_copies_module.groups)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(2000))
    assert sum(counted) < 2000 * 100


def test_edited_copies_meet_their_original_and_not_each_other(spark, monkeypatch):
    """Texts with one to four words changed: up to three changes link with the original, four with few others."""
    counted = []
    real = near_copies_module.verified

    def verified(pairs, sets):
        counted.append(pairs.count())
        return real(pairs, sets)

    monkeypatch.setattr(near_copies_module, "verified", verified)
    rng = random.Random(4)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 600):
        text = list(base)
        for _ in range(1 if i % 10 == 0 else rng.choice([3, 4])):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    root = {r.id: r.root for r in near_copies_module.groups(df).collect()}
    want = brute_similar_groups(rows)
    assert len(set(zip(root.values(), (want[i] for i in root)))) == len(set(root.values())) == len(set(want))
    assert counted[-1] <= 600 and sum(counted) <= 600 * 16


def test_no_pair_is_lost_after_the_stars(spark, monkeypatch):
    """Without star rounds, the prefixes alone find every pair of the brute force."""
    monkeypatch.setattr(near_copies_module, "STAR_ROUNDS", 0)
    rng = random.Random(19)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([7, 20, 60, 150]))]
        for c in range(6):
            text = list(base)
            for _ in range(rng.randrange(1 + len(base) // 25)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((g * 10 + c, " ".join(text)))
    root = brute_similar_groups(rows)
    want = sorted(min(rows[j][0] for j in range(len(rows)) if root[j] == r) for r in set(root))
    sets = spark.createDataFrame([(i, near_copies_module.shingles(t.encode()).view("int64").tolist()) for i, t in rows], "node long, s array<bigint>")
    pairs = near_copies_module.prefix_pairs(sets.selectExpr("node", "node AS root"), sets)
    stars = simhash_index.connected(near_copies_module.verified(pairs, sets))
    joined = {r.u for r in stars.collect()}
    assert sorted(i for i, _ in rows if i not in joined) == want


def test_internal_names_do_not_clash_with_columns(spark):
    df = spark.createDataFrame(
        [(1, "a b c", 5, 6, 7, 8), (2, "a b c", 1, 2, 3, 4)], "doc_id long, text string, __c int, __i int, chosen_id int, chosen_content int"
    )
    kept = simhash_index.keep_one(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, "a b c", 5, 6, 7, 8)]


def test_sets_that_can_not_be_similar_do_not_meet_by_prefix(spark):
    held = [(1, list(range(1, 6))), (2, list(range(1, 51))), (3, list(range(6, 51)))]
    sets = spark.createDataFrame(held, "node long, s array<bigint>")
    pairs = near_copies_module.prefix_pairs(sets.selectExpr("node", "node AS root"), sets)
    assert [tuple(r) for r in pairs.collect()] == [(3, 2)]


def test_a_similar_pair_without_a_common_key_is_found(spark):
    """9 shingles each, 8 in common, and no band of minima alike (one such pair in 786,000 tried)."""
    words = [f"w{(643043076 * 31 + k * 7919) % 1000003}" for k in range(14)]
    texts = [" ".join(words[:13]), " ".join(words[:12] + words[13:])]
    sets = [near_copies_module.shingles(t.encode()) for t in texts]
    assert len(set(sets[0].tolist()) & set(sets[1].tolist())) == 8 and list(map(len, sets)) == [9, 9]
    assert not set(near_copies_module.band_keys(sets[0])) & set(near_copies_module.band_keys(sets[1]))
    rows = [(1, texts[0]), (2, texts[1]), (3, texts[1]), (4, "another text of some words that is like none of them"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == [1, 4, 5]


@pytest.mark.parametrize("common", [1, 3, 10**9])
def test_prefixes_alone_find_every_pair(spark, monkeypatch, common):
    """Without any key, and whatever shingles count as common."""
    monkeypatch.setattr(near_copies_module, "COMMON", common)
    rng = random.Random(23)
    words = [f"w{i}" for i in range(60)]
    rows = [(1000, None), (1001, "one two"), (1002, "One  two")]
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([7, 20, 60, 150]))]
        for c in range(6):
            text = list(base)
            for _ in range(rng.randrange(1 + len(base) // 25)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((g * 10 + c, " ".join(text)))
    root = brute_similar_groups(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    signed = near_copies_module.written(near_copies_module.signatures(df, "doc_id", "text"), "signatures")
    none = spark.createDataFrame([], "u long, v long")
    pairs = near_copies_module.written(near_copies_module.unmet_pairs(signed, none), "pairs")
    likely = near_copies_module.plausible(df, "text", signed, pairs)
    assert likely.count() < pairs.count()
    pairs, sets = likely, near_copies_module.needed_sets(df, "text", signed, signed.select("node").distinct())
    stars = {r.u: r.v for r in simhash_index.connected(near_copies_module.verified(pairs, sets)).collect()}
    got = {r.id: stars.get(r.node, r.node) for r in signed.collect()}
    assert len(set(zip(got.values(), (dict(zip((d for d, _ in rows), root))[i] for i in got)))) == len(set(got.values())) == len(set(root))
