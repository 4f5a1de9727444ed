"""HTML extraction: page templates from equivalence classes of tokens, and the text in their slots."""

from __future__ import annotations

import hashlib
import html as html_module
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.batches import slices
from pairwright.llm.tables import column, cut, map_arrow, small
from pairwright.llm.urls import host_of

#: Elements whose nesting makes a token's path.
CONTAINERS = frozenset(
    "html body main article section div nav header footer aside form ul ol dl table figure blockquote details dialog "
    "fieldset menu hgroup center".split()
)
#: Elements that begin and end a block but are often left open, so they are no part of a path.
LEAVES = frozenset(
    "p li dt dd tr td th thead tbody tfoot caption figcaption h1 h2 h3 h4 h5 h6 pre address hr summary legend option "
    "optgroup head title".split()
)
#: Elements without text for readers; their contents are skipped as they stand.
RAW = frozenset("script style noscript template iframe svg textarea title select button object head".split())
#: Elements that are never the article's.
OUTSIDE = frozenset("nav footer aside form dialog menu".split())
#: Words that, as the whole of a name in the class, id or role, tell that an element isn't the article's.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent "
    "gdpr notice notices popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu "
    "menubar breadcrumb breadcrumbs footer sidebar aside widget share sharing social related recommended recommendations "
    "comment comments respond replies disqus pagination pager toolbar masthead copyright skip contentinfo complementary".split()
)
#: Further ones outside an article.
WORDS_OUTSIDE = WORDS | {"header", "topbar", "search", "discussion"}
#: Words that may stand beside one of those in a name, as in related-posts, but not alone; related-work is no such name.
LAYOUT = frozenset(
    "area article articles bar block body bottom box button buttons col column container content form global group head holder icon "
    "icons inner item items label left link links list main outer page panel post posts primary reader region right row secondary "
    "section site slot stories story text title top unit user wrap wrapper zone header".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)(?:>|\Z)", re.DOTALL
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    """An open element: its path as a hash, whether it lies in an article, and whether in boilerplate around or in it."""

    __slots__ = ("name", "path", "inside", "around", "within")

    def __init__(self, name: str, path: int, inside: bool, around: bool, within: bool) -> None:
        self.name, self.path, self.inside, self.around, self.within = name, path, inside, around, within

    @property
    def dropped(self) -> bool:
        return self.around or self.within


_ROOT = Node("", 0, False, False, False)


def _path(parent: int, name: str, label: str) -> int:
    value = hashlib.blake2b(f"{parent}/{name}.{label}".encode("utf-8", "replace"), digest_size=8).digest()
    return int.from_bytes(value, "little", signed=True)


def _named(attributes: str) -> tuple[str, list[set[str]], bool]:
    """The class, id and role as one label without digits, the words of each name in them, and whether the role is main."""
    if "=" not in attributes:
        return "", [], False
    found = [(kind.lower(), a or b or c) for kind, a, b, c in _ATTRIBUTE.findall(attributes)]
    label = re.sub(r"\d+", "#", " ".join(value for _, value in found))
    return label, [{w.lower() for w in _PART.findall(name)} for name in label.split()], ("role", "main") in found


def _is_marked(names: list[set[str]], words: frozenset[str]) -> bool:
    """Whether one name consists of marking words, beside which words of layout may stand."""
    return any(name & words and name <= words | LAYOUT for name in names)


def blocks(html: str) -> Iterator[tuple[Node, tuple[Node, ...], str]]:
    """(element, open elements, text) of each block of text in page order, references decoded, white space joined.

    Elements close with their parents; an end tag without a beginning is skipped, and so is what has no end.
    """
    stack: list[Node] = []
    parts: list[str] = []
    at = 0
    leaf_dropped = False
    size = len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        begin = m.start() if m else size
        if begin > at:
            parts.append(html[at:begin])
        if not m:
            break
        at = m.end()
        if at == begin:
            at += 1
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name in RAW and not m[1]:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(html, at)
            at = close.end() if close else (at if name == "head" else size)
        is_container, is_leaf = name in CONTAINERS, name in LEAVES or name in RAW
        if name == "br":
            parts.append(" ")
        if not (is_container or is_leaf):
            continue
        if parts:
            text = " ".join(html_module.unescape("".join(parts)).split())
            parts = []
            if text and not leaf_dropped:
                yield stack[-1] if stack else _ROOT, tuple(stack), text
        leaf_dropped = False
        if m[1]:
            if is_container:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name == name:
                        del stack[i:]
                        break
            continue
        above = stack[-1] if stack else _ROOT
        label, names, is_main = _named(m[3])
        starts = name in ("article", "main") or is_main
        drop = _is_marked(names, WORDS if above.inside or starts else WORDS_OUTSIDE)
        if is_container:
            drop = drop or name in OUTSIDE or (name == "header" and not above.inside)
            if not m[3].rstrip().endswith("/"):
                # The body's class tells about pages, not about parts of them.
                drop = drop and name not in ("html", "body")
                inside = above.inside or starts
                stack.append(Node(name, _path(above.path, name, label), inside, above.around or drop and not inside, above.within or drop and inside))
        else:
            leaf_dropped = drop
    text = " ".join(html_module.unescape("".join(parts)).split())
    if text and not leaf_dropped:
        yield stack[-1] if stack else _ROOT, tuple(stack), text


def said_by(found: list[tuple[Node, tuple[Node, ...], str]]) -> dict[Node, int]:
    """For each element that is not the article's: a hash of its path and all text that stands directly in it."""
    own: dict[Node, list[str]] = {}
    for node, _, text in found:
        if not node.dropped and not node.inside:
            own.setdefault(node, []).append(text)
    return {node: _path(node.path, "text", " ".join(texts)) for node, texts in own.items()}


#: The page itself is a token, so that pages without elements count for the support too.
PAGE = 0
TOKENS = (
    "host string, path bigint, text bigint, article boolean, dropped boolean, pages bigint, low bigint, high bigint, chars bigint"
)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def tokens(pages: DataFrame) -> DataFrame:
    """The tokens of (host, page_id, html) by host, with the pages that have them and fingerprints of their occurrence vectors.

    A token is the path of an element or, outside of articles, a path with all the text directly in such an
    element. The vector of a token has its number of occurrences on each page of the host. Its fingerprint is
    two sums of parts of a hash of page and number, so it is gathered in parts, tokens with equal vectors have
    equal ones, and repeated pages don't cancel each other. `chars` counts the text of a text token and, for
    the token of the page, all text in articles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found: dict[tuple, list[int]] = {}
            for host, page, html in zip(*(batch.column(c).to_pylist() for c in ("host", "page_id", "html"))):
                of_page = list(blocks(html or ""))
                own: dict[tuple, list[int]] = {}
                if of_page:
                    own[PAGE, None, False, False] = [1, sum(len(text) for node, _, text in of_page if node.inside and not node.dropped)]
                for node in dict.fromkeys(n for _, stack, _ in of_page for n in stack):
                    own.setdefault((node.path, None, node.name in ("article", "main"), node.dropped), [0, 0])[0] += 1
                size: dict[Node, int] = {}
                for node, _, text in of_page:
                    size[node] = size.get(node, 0) + len(text)
                for node, text in said_by(of_page).items():
                    total = own.setdefault((node.path, text, False, False), [0, 0])
                    total[0] += 1
                    total[1] += size[node]
                for token, (n, chars) in own.items():
                    vector = _path(page if page is not None else -1, str(n), host)
                    total = found.setdefault((host, *token), [0, 0, 0, 0])
                    total[0] += 1
                    total[1] += vector & 0x7FFFFFFF
                    total[2] += (vector >> 32) & 0x7FFFFFFF
                    total[3] += chars
            if found:
                yield _batch([(*key, *value) for key, value in found.items()], TOKENS)

    found = map_arrow(pages.select("host", "page_id", "html"), run, TOKENS)
    sums = [F.sum(c).alias(c) for c in ("pages", "low", "high", "chars")]
    return found.groupBy("host", "path", "text", "article", "dropped").agg(*sums)


def light(df: DataFrame, rows: int, items: int, *arrays: str) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows and `items` entries in all of its arrays."""
    if df.limit(rows + 1).count() > rows:
        return df
    held = df.agg(F.sum(sum((F.size(a) for a in arrays), F.lit(0)).cast("bigint"))).first()[0]
    return F.broadcast(df) if (held or 0) <= items else df


def equivalence_classes(found: DataFrame, support: float = 0.8, least: int = 3) -> DataFrame:
    """(host, class, token, is_text, article): tokens with one occurrence vector on at least `support` of a host's pages.

    Text takes part from `least` pages on. A token is the hash of a path or, as is_text says, of a path and a text.
    """
    of_host = found.where("text is null").groupBy("host").agg(F.max("pages").alias("host_pages"))
    # Text of single pages goes before it is joined, so a large host has no more rows than its template and common texts.
    common = found.where((F.col("text").isNull() | (F.col("pages") >= least)) & ~F.col("dropped"))
    valid = common.join(small(of_host, 200_000), "host").where(F.col("pages") >= support * F.col("host_pages"))
    return valid.select(
        "host", F.xxhash64("low", "high").alias("class"), F.coalesce("text", "path").alias("token"), F.col("text").isNotNull().alias("is_text"), "article"
    )


def occurrences(of_page: list[tuple[Node, tuple[Node, ...], str]]) -> list[tuple[int, int]]:
    """(token, number of the last token in it) of each token of the page, in page order; the page itself comes first."""
    out = [[PAGE, 0]]
    at: dict[Node, int] = {}
    said = said_by(of_page)
    for node, stack, _ in of_page:
        for n in stack:
            if n not in at:
                at[n] = len(out)
                out.append([n.path, 0])
        if (text := said.pop(node, None)) is not None:
            out.append([text, len(out)])
        for n in stack:
            out[at[n]][1] = len(out) - 1
    out[0][1] = len(out) - 1
    return [tuple(x) for x in out]


CROSSED = -1
PLACES = "host string, token bigint, low_before bigint, high_before bigint, low_place bigint, high_place bigint"


def places(of_page: list[tuple[Node, tuple[Node, ...], str]], of: dict[int, int], sizes: dict[int, int]) -> Iterator[tuple[int, int, int]]:
    """(token, the token of its class before it, its place) for each occurrence of a token that has a class.

    `of` has the classes of tokens and `sizes` their numbers of tokens. An occurrence of a class begins with a
    token that the one before it has already. Its place is the innermost other class that is open there, with
    the token of it that came last: the gap which it is nested in. A class is CROSSED, and so has no place, if
    another one that began before it goes on while it is open, or if it begins again without all its tokens.
    """
    open_ones: list[list] = []  # class, tokens seen, last token, place, end of the span
    crossed: set[int] = set()
    for number, (token, end) in enumerate(occurrences(of_page)):
        own = of.get(token)
        if own is None:
            continue
        open_ones = [x for x in open_ones if len(x[1]) < sizes[x[0]] or x[4] >= number]
        at = next((i for i in range(len(open_ones) - 1, -1, -1) if open_ones[i][0] == own), None)
        if at is not None and token in open_ones[at][1]:
            if len(open_ones[at][1]) < sizes[own]:
                crossed.add(own)
                del open_ones[at]
            at = None
        if at is None:
            place = _path(open_ones[-1][0], "gap", str(open_ones[-1][2])) if open_ones else 0
            open_ones.append([own, {token}, token, place, end])
            yield token, 0, place
            continue
        crossed.update(x[0] for x in open_ones[at + 1 :])
        top = open_ones[at]
        yield token, top[2], top[3]
        top[1].add(token)
        top[2], top[4] = token, max(top[4], end)
    yield from ((token, 0, CROSSED) for token, own in of.items() if own in crossed)


def nested(pages: DataFrame, classes: DataFrame, least: int = 3) -> DataFrame:
    """(host, token) of `classes` that are ordered and nested on (host, html): the template.

    On all pages such a token follows the same token of its class and its class stands in the same gap of
    the same other class. Tokens that are alone in a class have no order and are no template.
    """
    of_host = classes.groupBy("host", "class").agg(F.collect_list("token").alias("of"), F.max("is_text").alias("t")).where(F.size("of") > 1)
    one = F.struct("class", "of")
    of_host = of_host.groupBy("host").agg(F.collect_list(one).alias("classes"), F.max("t").alias("t"), F.sum(F.size("of")).alias("n")).where("t")
    of_host = cut(of_host.select(F.col("host").alias("_host"), "classes", "n"))
    held = of_host.agg(F.count("*"), F.sum("n")).first()
    hinted = F.broadcast(of_host) if held[0] <= 50_000 and (held[1] or 0) <= 1_000_000 else of_host
    placed = pages.join(hinted, F.col("host") == F.col("_host")).select("host", "html", "classes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            seen: dict[tuple[str, int], list[int]] = {}
            known: dict[str, tuple[dict, dict]] = {}
            for i, (host, html) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist())):
                if host not in known:
                    given = batch.column("classes")[i].as_py()
                    known[host] = {t: c["class"] for c in given for t in c["of"]}, {c["class"]: len(c["of"]) for c in given}
                for token, before, place in places(list(blocks(html)), *known[host]):
                    total = seen.setdefault((host, token), [before, before, place, place])
                    total[:] = min(total[0], before), max(total[1], before), min(total[2], place), max(total[3], place)
            if seen:
                yield _batch([(*key, *value) for key, value in seen.items()], PLACES)

    seen = map_arrow(placed, run, PLACES)
    sides = [(F.min, "low_before"), (F.max, "high_before"), (F.min, "low_place"), (F.max, "high_place")]
    seen = seen.groupBy("host", "token").agg(*(f(c).alias(c) for f, c in sides))
    return seen.where((F.col("low_before") == F.col("high_before")) & (F.col("low_place") == F.col("high_place")) & (F.col("low_place") != CROSSED)).select("host", "token")


def content_slots(pages: DataFrame, support: float = 0.8, least: int = 3) -> DataFrame:
    """(host, slots, template, teasers) of (host, page_id, html): paths marked as an article, hashes of template text, and what articles are.

    Tokens of a host with one occurrence vector form a class; valid classes (see `equivalence_classes`) are
    ordered and nested into the template (see `nested`). Text belongs to it only in a class with another
    token, as its element or the page's frame: then all text that an element holds is the same wherever it
    stands. What else stands in elements are the slots. Articles of a host are teasers if they hold less than
    half as much as the text outside of them that is on under `least` pages.
    """
    found = cut(tokens(pages))
    classes = cut(equivalence_classes(found, support, least))
    marked = classes.where("article and not is_text").groupBy("host").agg(F.collect_set("token").alias("slots"))
    texts = nested(pages, classes, least).join(classes.where("is_text").select("host", "token"), ["host", "token"])
    template = texts.groupBy("host").agg(F.collect_set("token").alias("template"))
    inside = F.sum(F.when(F.col("text").isNull() & (F.col("path") == PAGE), F.col("chars")))
    outside = F.sum(F.when(F.col("text").isNotNull() & (F.col("pages") < least), F.col("chars")))
    teasers = found.groupBy("host").agg((2 * F.coalesce(inside, F.lit(0)) < F.coalesce(outside, F.lit(0))).alias("teasers"))
    return teasers.join(marked, "host", "left").join(template, "host", "left").select("host", "slots", "template", "teasers")


def main_text(html: str, slots: list[int] | None = None, template: list[int] | None = None, teasers: bool | None = None) -> str:
    """The blocks in the host's article slots; on a page without them, in its own article, else in all slots of the template.

    Where articles are teasers, they are left out; without a host to tell, the page's own lengths do. An article
    in boilerplate is read if it holds more than what stands elsewhere. A page of which all is template, as on a
    host of copies, keeps what isn't marked as boilerplate.
    """
    wanted, known = set(slots or ()), set(template or ())
    every = list(blocks(html))
    found = [block for block in every if not block[0].dropped]
    said = said_by(found)
    inner = [text for node, _, text in found if node.inside]
    outer = [text for node, _, text in found if not node.inside and said[node] not in known]
    if teasers is None:
        teasers = 2 * sum(map(len, inner)) < sum(map(len, outer))
    if inner and not (teasers and outer):
        return " ".join([text for _, stack, text in found if any(n.path in wanted for n in stack)] or inner)
    covered = [text for node, _, text in every if node.inside and node.around and not node.within]
    if sum(map(len, covered)) > sum(map(len, outer)):
        return " ".join(covered)
    return " ".join(outer or [text for _, _, text in found])


EXTRACTED = "page_id bigint, url string, text string, n_chars bigint"


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of (page_id, url, html): the article, without what stands around it.

    Templates are deduced over all pages of a host, from sums, minima and maxima that are gathered before the
    shuffle, so a host may have any number of pages. Hosts with one page have what their page says. Null html
    has an empty text; null and relative URLs share the empty host. Repeated rows give repeated results. Of an
    article nothing is dropped for being repeated; outside of articles an element is whose whole text is the
    template's. What is known of hosts goes to all tasks if it is little, else it is joined.
    """
    own = pages.select(column(pages, "page_id", "bigint"), column(pages, "url", "string"), F.coalesce(column(pages, "html", "string"), F.lit("")).alias("html"))
    own = own.withColumn("host", host_of(F.col("url")))
    slots = cut(content_slots(own).withColumnRenamed("host", "_host"))
    hinted = light(slots, 50_000, 1_000_000, "slots", "template")
    placed = own.join(hinted, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "slots", "template", "teasers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("html", "slots", "template", "teasers")))]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in EXTRACTED.split(", ")])

    return map_arrow(placed, run, EXTRACTED)
