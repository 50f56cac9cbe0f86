"""Allow and block rules for URLs, spread over redirect and canonical-link edges.

A rule is a host and a path: it fits its host and all subdomains, for paths
that start with the rule's.  The longest rule that fits judges a URL by itself.
URLs that redirect to one another, or name one another as canonical, are the
same page: they form the connected components of those edges.  A URL without a
rule is blocked if a rule blocks some alias of it, and allowed if a rule allows
one, which takes precedence.  A URL with a rule of its own keeps that verdict.

DataFrame functions only.  Components are found by large and small stars over
stored tables; nothing but sizes reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import lookup_join
from .common import ascii_lower, written
from .simhash_index import connected

ALLOW, BLOCK = "allow", "block"
#: An HTML attribute's value: quoted either way, or up to white space or the tag's end.
VALUE = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def host_of(url: Column) -> Column:
    """Lower-cased host: after the first "://" up to "/", "?", "#" or the end; empty if there is none."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, ascii_lower(F.regexp_extract(rest, r"\A[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end; empty without a host part."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)).otherwise("")


def page_key(url: Column) -> Column:
    """The URL as a node: scheme and host in lower case, no fragment, "/" for an empty path; null without a host part."""
    scheme = ascii_lower(F.substring_index(url, "://", 1))
    tail = F.regexp_extract(F.substring(url, F.locate("://", url) + 3, F.length(url)), r"\A[^/?#]*([^#]*)", 1)
    tail = F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))
    return F.when(F.locate("://", url) > 0, F.concat(scheme, F.lit("://"), host_of(url), tail))


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute without its quotes and outer blanks, character references of URLs decoded."""
    found = F.btrim(F.regexp_extract(tag, rf"(?i)[\s\"']{name}{VALUE}", 1), F.lit("\"' \t\r\n"))
    for entity, plain in (("&#38;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        found = F.replace(found, F.lit(entity), F.lit(plain))
    return found


def absolute(link: Column, base: Column) -> Column:
    """A link as a URL seen from the page ``base``; null for other schemes, empty links and pages without a host part."""
    scheme = F.substring_index(base, "://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_extract(path_of(base), r"\A.*/", 0)
    folder = F.when(folder == "", "/").otherwise(folder)
    seen = (
        F.when(link.rlike(r"\A(?i)https?://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(root, path_of(base), link))
        .when((link != "") & ~link.startswith("#") & ~link.rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*:"), F.concat(root, folder, link))
    )
    return F.when(F.locate("://", base) > 0, seen)


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Distinct (a, b): a page and the page that its canonical link or its refresh redirect names."""
    plain = F.regexp_replace(pages[html], r"(?s)<!--.*?-->|(?i)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    holds = pages[html].rlike(r"(?i)canonical|http-equiv")  # most pages have neither: they are not cut into tags
    tags = F.regexp_extract_all(plain, F.lit(r"(?i)(<(?:link|meta)\b[^>]*>)"), F.lit(1))
    rows = pages.where(holds & pages[url].isNotNull()).select(pages[url].alias("base"), F.explode(tags).alias("tag"))
    named = rows.select("base", *(attribute(F.col("tag"), n).alias(n.replace("-", "_")) for n in ("rel", "href", "http-equiv", "content")))
    named = written(named, "link-tags")  # few rows; what follows uses each value many times
    target = F.regexp_extract("content", r"(?is)\A[\s\d.]*[;,]?\s*url\s*=\s*['\"]?([^'\"]*)", 1)
    link = F.when(F.lower("rel").rlike(r"(\A|\s)canonical(\s|\z)"), F.col("href")).when(F.lower("http_equiv") == "refresh", F.trim(target))
    linked = written(named.select("base", link.alias("link")).where("link <> ''"), "page-links")
    full = written(linked.select("base", absolute(F.col("link"), F.col("base")).alias("to")), "full-links")
    ends = written(full.select(page_key(F.col("base")).alias("a"), page_key(F.col("to")).alias("b")), "link-ends")
    return ends.where("a <> b").distinct()


def own_rule(rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule of (verdict, host, path) as a struct, or null; of equally long ones the longer host, then block.

    The rules are a parameter of the job, tested one by one in generated code.
    Rows need the columns ``host`` and ``path``.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != BLOCK))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in reversed(ordered):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        found = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def component_verdicts(edges: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(page, spread): for every page of a component with a ruled URL, allow if a rule allows one of its URLs, else block."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nodes = written(both.select(F.col("a").alias("page")).distinct(), "linked-pages")
    stars = connected(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    roots = nodes.join(stars.select(F.col("u").alias("page"), F.col("v").alias("root")), "page", "left")
    roots = roots.withColumn("root", F.coalesce("root", "page"))
    judged = roots.select("page", "root", host_of(F.col("page")).alias("host"), path_of(F.col("page")).alias("path"))
    judged = written(judged.select("page", "root", own_rule(rules)["verdict"].alias("own")), "judged-pages")
    known = judged.where("own IS NOT NULL").groupBy("root").agg(F.min("own").alias("spread"))  # "allow" sorts first
    sizes = judged.groupBy("root").agg(F.count("*").alias("n"))
    known = known.join(sizes, "root")
    return lookup_join(judged.select("page", "root"), known, "root", "n").select("page", "spread")


def verdicts(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    edges: DataFrame | None = None,
    url: str = "url",
    html: str | None = "html",
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``, which replace input columns of those names.

    ``rules`` are (verdict, host, path).  Edges come from canonical links and
    refresh redirects in ``html`` (None: not read) and from ``edges``, a table
    of URLs (from_url, to_url) such as a crawl's redirects; null ends and URLs
    without "://" link nothing.  A null URL has an empty host and path, no rule
    and is allowed.  Repeated rows each stay, and an empty table stays empty.
    """
    rows = pages
    found = []
    if html is not None:
        found.append(page_edges(pages, url, html))
    if edges is not None:
        given = edges.select(page_key(edges["from_url"]).alias("a"), page_key(edges["to_url"]).alias("b"))
        found.append(given.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())
    address = F.coalesce(pages[url], F.lit(""))
    names = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    kept = F.struct(*(pages[f"`{c}`"] for c in names)).alias("kept")  # whole rows, so that no helper name can clash
    rows = pages.select(kept, host_of(address).alias("host"), path_of(address).alias("path"), page_key(address).alias("page"))
    rows = rows.withColumn("own", own_rule(rules))
    spread = None
    if found:
        linked = written(reduce(DataFrame.unionByName, found).distinct(), "edges")
        if not linked.isEmpty():
            spread = written(component_verdicts(linked, rules), "spread")
    if spread is None:
        rows = rows.withColumn("spread", F.lit(None).cast("string"))
    else:
        times = rows.groupBy("page").agg(F.count("*").alias("n"))
        known = spread.join(times, "page")
        rows = lookup_join(rows, known, "page", "n", "left")
    return rows.select(
        "kept.*",
        "host",
        "path",
        F.col("own.rule").alias("rule"),
        F.coalesce(F.col("own.verdict"), F.col("spread"), F.lit(ALLOW)).alias("verdict"),
    )
