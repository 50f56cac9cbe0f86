"""Main text of web pages as the maximum-scoring subsequence of words and tags.

A page is a sequence of tags and words.  Every kind of item has a weight, the
log-odds of lying inside the content of a labelled page (one whose markup has
exactly one article or main element) rather than outside.  Words are told apart
by where they stand: plain, in a link, in a container of known boilerplate, or in
one that only a part of its class name or id marks, whose weight is learnt by part.
One linear scan finds the contiguous region with the highest sum.  The region is
widened to the article or main element that it lies in, boilerplate containers
inside it are left out, and the rest is cut into blocks.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

ITEM = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>",
    re.S,
)
#: What still counts once no ">" follows, and a tag that ends at the next one whatever its quotes say.
UNENDED = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)(?P<close>)(?P<name>)(?P<attributes>)", re.S)
BLUNT = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>[^>]*+)>",
    re.S,
)
QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+", re.S)
#: One attribute with its whole value, so that nothing inside a value counts as a name; an unclosed quote goes to the end.
ATTRIBUTE = re.compile(r"([^\s/=\"'>][^\s/=>]*+)(?:\s*+=\s*+(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*+)))?|\"[^\"]*+\"?|'[^']*+'?", re.S)
NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("aside button dialog footer form head menu nav object select svg".split())
BOILERPLATE_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Parts of class names and ids that mark boilerplate.
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo "
    "promoted recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe teaser "
    "toolbar widget".split()
)
CONTENT = frozenset(["article", "main"])
PLAIN, LINK, BOILER = "word", "word in link", "word in boilerplate"
#: Start of the kinds of words in containers that only a part of a class name or id marks; the part follows.
NAMED = "word in container named "
#: An element with a boilerplate name that holds this share of the page's text is a wrapper, not boilerplate.
WRAPPER = 0.75
#: Counts added before the log-odds are taken, as if seen inside and outside the content.
PRIOR_WORDS = {PLAIN: (90.0, 10.0), LINK: (10.0, 90.0), BOILER: (1.0, 99.0)}
PRIOR_TAG = (1.0, 3.0)
#: No tag weighs more than this, and no word more than half of it, so that a few words outside cannot outweigh tags.
MOST = 4.0


def boilerplate(name: str, attributes: str, inside_content: bool) -> str:
    """The word kind that an element gives its words; empty if it is no boilerplate."""
    if name in BOILERPLATE or name == "header" and not inside_content:
        return BOILER
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes) if attributes.strip() else ():
        if m[1]:
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return BOILER
    if found.get("role", "").lower() in BOILERPLATE_ROLES:
        return BOILER
    if name not in CONTENT and name not in ("html", "body"):
        for key in ("class", "id"):
            for part in NAME_PART.findall(found.get(key, "")):
                if part.lower() in BOILERPLATE_WORDS:
                    return NAMED + part.lower()
    return ""


def items(page: str, wrappers: frozenset[int] = frozenset(), named: list[tuple[int, int]] | None = None) -> Iterator[tuple[str, str, bool, int]]:
    """(kind, text, block, element) of every tag and text run, in order.

    Elements that start at a place in ``wrappers`` are no boilerplate by name;
    ``named`` takes the start and the characters of text of those that are.
    ``kind`` is a tag name or a word kind; ``block`` says whether
    a tag ends a block; ``element`` is the number of the innermost article or
    main element, or -1.
    """
    # open elements: name, boilerplate kind, number and name of the content element around them, start, characters before
    stack: list[tuple[str, str, int, str, int, int]] = []
    hidden: list[tuple[str, int]] = []  # kind and depth
    names: Counter = Counter()  # open elements by name, so that a stray end tag looks for none
    links = opened = seen = boilers = 0
    element, around = -1, ""
    at, n = 0, len(page)
    last, blunt_to = page.rfind(">"), 0

    def leave(depth: int) -> None:
        nonlocal links, element, around, boilers
        while len(stack) > depth:
            name, bad, element, around, start, before = stack.pop()
            names[name] -= 1
            if bad:
                hidden.pop()
                boilers -= bad == BOILER
                if named is not None and bad != BOILER:
                    named.append((start, seen - before))
            links -= name == "a"

    def run(text: str) -> tuple[str, str, bool, int]:
        nonlocal seen
        seen += len(text.strip())
        kind = (BOILER if boilers else hidden[-1][0]) if hidden else LINK if links else PLAIN
        return (kind, text, False, element)

    while at < n:
        m = (UNENDED if at > last else BLUNT if at < blunt_to else ITEM).search(page, at)
        if m is not None and m.start() > last and m.re is not UNENDED:
            m = UNENDED.search(page, at)
        if m is None:
            yield run(page[at:])
            break
        if m.start() > at:
            yield run(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            yield run(m["cdata"])
        if not m["name"]:
            continue
        if m.re is ITEM and (quoted := QUOTED.match(page, m.start("attributes")).end()) >= at:
            # a quote that is never closed: tags up to it end at their next ">", so that none looks for it again
            blunt_to = quoted
        name, closing = m["name"].lower(), bool(m["close"])
        if name in RAW and not closing:
            end = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at) if at <= last else None
            after = page.find(">", end.end()) if end else -1
            at = after + 1 if after >= 0 else n
            yield (name, "", True, element)
            continue
        block = name in BLOCKS
        if closing:
            if names[name]:
                leave(next(depth for depth in range(len(stack) - 1, -1, -1) if stack[depth][0] == name))
            yield (name, "", block, element)
            continue
        if block and stack and stack[-1][0] == "p":
            leave(len(stack) - 1)
        if name in CONTENT and hidden and element < 0:  # a container that was never closed ends here
            leave(hidden[0][1])
        if name == "li" and stack and stack[-1][0] == "li":
            leave(len(stack) - 1)
        bad = boilerplate(name, m["attributes"] or "", element >= 0)
        if bad and bad != BOILER and m.start() in wrappers:
            bad = ""
        if name in VOID or (m["attributes"] or "").rstrip().endswith("/") and name not in BLOCKS:
            yield (name, "", block, element)
            continue
        stack.append((name, bad, element, around, m.start(), seen))
        names[name] += 1
        if bad:
            hidden.append((bad, len(stack) - 1))
            boilers += bad == BOILER
        links += name == "a"
        if name in CONTENT and not hidden and (element < 0 or around == "main"):
            element, around, opened = opened, name, opened + 1
        yield (name, "", block, element)
    leave(0)


def sequence(page: str) -> list[tuple[str, str, bool, int]]:
    """The items of a page, where wrappers of most of its text are no boilerplate by name."""
    named: list[tuple[int, int]] = []
    seq = list(items(page, named=named))
    total = sum(len(text.strip()) for _, text, _, _ in seq)
    wrappers = frozenset(start for start, n in named if n and n >= WRAPPER * total)
    return list(items(page, wrappers)) if wrappers else seq


def label_counts(page: str) -> Counter:
    """(kind, inside the content) to how often, for a labelled page; nothing for others."""
    seq = sequence(page)
    if {e for _, _, _, e in seq} - {-1} != {0}:
        return Counter()
    out: Counter = Counter()
    for kind, text, _, element in seq:
        out[kind, element == 0] += len(text.split()) if kind.startswith("word") else 1
    return out


def weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log-odds by kind; words in boilerplate never score, and tags never do more than a little."""
    out = {}
    for kind in {k for k, _ in counts} | set(PRIOR_WORDS):
        inside, outside = PRIOR_WORDS.get(BOILER if kind.startswith(NAMED) else kind, PRIOR_TAG)
        score = math.log((counts.get((kind, True), 0) + inside) / (counts.get((kind, False), 0) + outside))
        score = min(max(score, -MOST), MOST)
        if kind == PLAIN:
            score = min(max(score, 0.1), MOST / 2)
        elif kind == BOILER:
            score = min(score, -0.5)
        elif kind.startswith(NAMED):
            score = min(score, 0.0)
        elif kind != LINK:
            score = min(score, 0.0) - 0.1
        out[kind] = score
    return out


def region(seq: list[tuple[str, str, bool, int]], weight: dict[str, float]) -> tuple[int, int]:
    """First and end place of the contiguous items with the highest sum; the earlier and shorter one of ties."""
    unknown = min(0.0, math.log(PRIOR_TAG[0] / PRIOR_TAG[1])) - 0.1
    best, first, end, total, start = 0.0, 0, 0, 0.0, 0
    for i, (kind, text, _, _) in enumerate(seq):
        total += (weight[kind] if kind in weight else weight[BOILER]) * len(text.split()) if kind.startswith("word") else weight.get(kind, unknown)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, first, end = total, start, i + 1
    return first, end


def main_text(page: str | None, weight: dict[str, float]) -> str:
    """Blocks of the main text, joined by two line breaks; empty if the page has no text that scores."""
    seq = sequence(page or "")
    first, end = region(seq, weight)
    if first == end:
        return ""
    words: Counter = Counter()
    for kind, text, _, element in seq[first:end]:
        if kind == PLAIN:
            words[element] += len(text.split())
    element = max(words, key=lambda e: (words[e], e), default=-1)
    if element >= 0:  # the whole article that most of the region lies in
        inside = [i for i, x in enumerate(seq) if x[3] == element]
        first, end = inside[0], inside[-1] + 1
    else:  # whole blocks only
        while first and not seq[first - 1][2]:
            first -= 1
        while end < len(seq) and not seq[end][2]:
            end += 1
    blocks, parts = [], []
    for kind, text, block, _ in seq[first:end]:
        if block:
            blocks.append("".join(parts))
            parts = []
        elif kind == "br":
            parts.append(" ")
        elif kind in (PLAIN, LINK):
            parts.append(text)
    blocks.append("".join(parts))
    clean = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in clean if b)


def learned_weights(pages: DataFrame, column: str = "html") -> dict[str, float]:
    """Weights from all labelled pages; names of unknown tags count as one kind, so there are few sums."""
    known = BLOCKS | VOID | RAW | frozenset("a abbr b cite code em i img label mark q s small span strong sub sup time u".split())

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        total: Counter = Counter()
        for x in batch.column("x").to_pylist():
            for (kind, inside), n in label_counts(x or "").items():
                total[kind if kind in known or kind.startswith("word") else "other", inside] += n
        keys = list(total)
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())],
            ["kind", "inside", "n"],
        )

    sums = arrow_map(pages.select(pages[column].alias("x")), count, "kind string, inside boolean, n bigint", ["x"])
    rows = sums.groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()  # two per kind
    return weights({(r.kind, r.inside): r.n for r in rows})


def extract(pages: DataFrame, weight: dict[str, float], column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns and ``text`` of every page, from the whole html.

    A null or empty page, and one without text, gives an empty text.  Repeated
    rows each get their row; columns not kept are left out.
    """
    names = [f"k{i}" for i in range(len(keep))]
    kinds = [pages.schema[k].dataType.simpleString() for k in keep]
    rows = pages.select(*(pages[k].alias(n) for k, n in zip(keep, names)), pages[column].alias("x"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x, weight) for x in batch.column("x").to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], [*names, "text"])

    out = arrow_map(rows, work, ", ".join([*(f"{n} {k}" for n, k in zip(names, kinds)), "text string"]), ["x"])
    return out.select(*(out[n].alias(k) for k, n in zip(keep, names)), "text")
