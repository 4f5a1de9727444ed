"""URL filters: rules by host and path, carried over redirects and canonical links."""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator, Sequence
from html.entities import html5
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.graph import components
from pairwright.llm.tables import column, cut, map_arrow

_FULL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://")
_REFERENCE = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9A-Fa-f]+);?|[A-Za-z][A-Za-z0-9]*(?:;|(?![=A-Za-z0-9;])))")

#: (verdict, host, path) of the production rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host_of(url):
    """What stands after the first :// up to a slash, question mark, hash or the end, A-Z in lower case; else empty."""
    lower = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), lower.upper(), lower)


def path_of(url):
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host, path, rules: Sequence[tuple[str, str, str]] = RULES):
    """The struct (rule, verdict) of the longest rule that fits, or null. Of equally long ones a block wins."""
    out = None
    for verdict, of, under in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block")):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(under)
        one = F.struct(F.lit(of + under).alias("rule"), F.lit(verdict).alias("verdict"))
        out = [*(out or []), F.when(fits, one)]
    return F.coalesce(*out) if out else F.lit(None).cast("struct<rule: string, verdict: string>")


def node_of(url):
    """A URL as a node of the link graph: scheme and host in lower case, without fragment; an empty path is a slash."""
    head = F.lower(F.regexp_extract(url, r"(?s)^([^:/?#]*)://", 1))
    path = path_of(url)
    query = F.regexp_extract(url, r"(?s)^[^#?]*(\?[^#]*)", 1)
    made = F.concat(head, F.lit("://"), host_of(url), F.when(path == "", F.lit("/")).otherwise(path), query)
    return F.when(host_of(url) != "", made)


def decoded(value: str) -> str:
    """An attribute's value with its character references decoded; names without a semicolon before = or letters aren't any."""
    named = lambda m: html_module.unescape(m[0]) if m[0][1] == "#" else html5.get(m[0][1:], m[0])
    return _REFERENCE.sub(named, value)


def resolved(url: str | None, base: str | None, href: str | None) -> str | None:
    """The full URL that `href` stands for on the page `url`, whose <base> is at `base`; null if there is none."""
    href = decoded(href or "").strip()
    if not href:
        return None
    try:
        full = href if _FULL.match(href) else urljoin(urljoin(url or "", decoded(base or "").strip()), href)
        parts = urlsplit(full)
        if "/." in parts.path and not parts.path.startswith("//"):
            full = urljoin(full, parts.path) + ("?" + parts.query if parts.query else "")
    except ValueError:
        return None
    return full if _FULL.match(full) else None


def links(pages: DataFrame) -> DataFrame:
    """(source, target) of the canonical links and immediate redirects that stand in the html of (url, html).

    Targets may be relative, to the page or to its <base>; character references in them are decoded and dot
    segments removed. Pages without either are not shuffled or parsed further.
    """
    html = F.col("html")
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<(?:link|meta)\b[^>]*\b(?:rel\s*=\s*[\"']?canonical\b|http-equiv\s*=\s*[\"']?refresh\b)[^>]*>)"), F.lit(1))
    base = F.regexp_extract(html, r"(?is)<base\b[^>]*\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    found = pages.where(html.rlike(r"(?i)canonical|http-equiv")).select("url", base.alias("base"), F.explode(tags).alias("tag"))
    href = F.regexp_extract("tag", r"(?is)\b(?:href\s*=|content\s*=\s*[\"']?[\s\d.]*[;,]\s*url\s*=)\s*[\"']?\s*([^\"'\s>]+)", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            targets = [resolved(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("url", "base", "href")))]
            yield pa.RecordBatch.from_arrays([batch.column("url"), pa.array(targets, pa.string())], names=["url", "target"])

    full = map_arrow(found.select("url", "base", href.alias("href")), run, "url string, target string")
    return full.select(node_of(F.col("url")).alias("source"), node_of(F.col("target")).alias("target")).where(
        F.col("source").isNotNull() & F.col("target").isNotNull()
    )


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None
) -> DataFrame:
    """(page_id, host, path, rule, verdict, aliases_decide) per row of (page_id, url, html).

    A page under a rule gets the rule's verdict. Others follow their aliases, the URLs that canonical links,
    redirects in pages, and rows of `redirects` (source, target) connect them to: allowed if a rule allows one
    of them, else blocked if a rule blocks one, else allowed. Null and relative URLs have neither host nor
    path, no rule and no alias, and are allowed. Repeated rows are judged alike; an empty table gives none.
    """
    own = pages.select(column(pages, "page_id", "bigint"), column(pages, "url", "string"), column(pages, "html", "string"))
    edges = links(own)
    if redirects is not None:
        given = redirects.select(node_of(column(redirects, "source", "string")), node_of(column(redirects, "target", "string")))
        edges = edges.union(given)
    edges = cut(edges.toDF("a", "b").where("a is not null and b is not null").distinct())
    ruled = own.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = ruled.withColumn("by_rule", rule_of(F.col("host"), F.col("path"), rules))
    alias = cut(components(edges))
    said = alias.withColumn("v", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"])
    allows, blocks = F.max(F.col("v") == "allow"), F.max(F.col("v") == "block")
    decided = said.groupBy("component").agg(F.when(allows, F.lit("allow")).when(blocks, F.lit("block")).alias("by_alias"))
    decided = cut(alias.join(cut(decided.where("by_alias is not null")), "component").select(F.col("node").alias("_node"), "by_alias"))
    judged = ruled.join(decided, node_of(F.col("url")) == F.col("_node"), "left")
    return judged.select(
        "page_id", "host", "path", F.col("by_rule.rule").alias("rule"),
        F.coalesce("by_rule.verdict", "by_alias", F.lit("allow")).alias("verdict"),
        (F.col("by_rule").isNull() & F.col("by_alias").isNotNull()).alias("aliases_decide"),
    )
