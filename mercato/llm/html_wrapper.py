"""Main text of web pages, with wrappers induced from pages of the same host.

Pages of a host share templates.  A text node that stands at the same place (the
names of the elements around it) of most of a host's pages that have that place
belongs to the template: this is counted over all pages, each different page
once.  Pages of one layout (the outer containers of a page) are also aligned by
simple tree matching, whole trees of a few pages of every layout; a text that
stands on matching nodes of most of them belongs to that layout's template, and
what varies fills its slots.

A page's main text is what varies, wherever it stands: all lines but those made
of template texts only.  Tags break ties alone: elements that are by their tag,
role or class menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles or comments of readers are no main text though they vary, nor
are ``article`` elements of a place whose slots hold less than half as much as
those of the host's main one (teasers).  Inside ``article`` or ``main``, names
that content may bear as well (a header, a label, a class ``legal`` or ``tags``)
count only if links make up more than half of the element's text, and a class
has to be such a name as a whole, not in part.  A page of a host with fewer than
``least_pages`` different pages has no wrapper and is read by its ``article``
or else ``main`` element, else its body.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator, Set
from dataclasses import dataclass, field
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import likely_among, stored


@dataclass(frozen=True)
class Params:
    #: This many different pages of a layout are aligned, chosen by a hash; template texts are counted over all pages as well.
    pages_per_layout: int = 6
    least_pages: int = 3      # pages that have to agree on a template text
    seed: int = 3
    salts: int = 16           # parts of a layout while its pages are drawn


# Elements by their role on a page.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "xmp"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir",
         "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
         "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table",
         "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
APART = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "input", "label",
         "fieldset", "object", "embed", "audio", "video", "canvas", "head"} | RAW
APART_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu",
               "menubar", "toolbar", "alertdialog"}
APART_NAMES = re.compile(
    r"^(ads?|advert\w*|adverti[sz]ement|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side-?bar|"
    r"aside|footer|foot|header|masthead|topbar|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|"
    r"subscribe|signup|login|comments?|commentlist|replies|reply|discussion|disqus|related|recommended|share|sharing|"
    r"social|widget|pagination|pager|search|toolbar|copyright|legal|tags)$")
#: Inside an article these may hold its content: they go only where links dominate.
CONTENT_TAGS = {"header", "label", "fieldset"}
CONTENT_NAMES = re.compile(r"^(banner|header|masthead|topbar|notices?|alerts?|search|toolbar|copyright|legal|tags|discussion|login|signup)$")
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
             "th": {"td", "th", "tr"}, "option": {"option"}}
CONTAINERS = {"article", "main", "section", "div", "table"}
MOST_PAIRS = 1 << 16              # of children that are matched with each other at once
NO_PARAGRAPH = BLOCK - {"br", "body", "html"}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


@dataclass
class Node:
    tag: str                                      # "" for a text
    name: str = ""                                # tag with class and id, for matching
    apart: bool = False
    text: str = ""
    children: list["Node"] = field(default_factory=list)


def _is_apart(tag: str, attributes: str, inside: bool) -> tuple[bool | None, str]:
    """Whether an element is set apart (None: if links dominate it), and its name; ``inside`` an article or main."""
    maybe = inside and tag in CONTENT_TAGS
    if tag in APART and not maybe:
        return True, tag
    if not attributes or attributes.isspace():
        return (None if maybe else False), tag
    classes, own, apart = "", "", bool(_HIDDEN.search(attributes))
    for m in _ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind == "class":
            classes = f".{'.'.join(sorted(value.split()))}"
        if kind == "id":                           # numbers tell pages apart, not places
            own = f"#{re.sub('[0-9]+', '0', value.strip())}"
        if kind == "role":
            apart |= value.strip() in APART_ROLES
        elif tag not in ("article", "main", "body", "html"):
            for word in value.split():
                for x in (word,) if inside else (word, *re.split(r"[-_]+", word)):
                    if APART_NAMES.match(x):
                        doubtful = inside and CONTENT_NAMES.match(x)
                        maybe, apart = maybe or bool(doubtful), apart or not doubtful
    return (apart or (None if maybe else False)), tag + classes + own


def _links_dominate(node: Node) -> bool:
    """Whether more than half of an element's text stands in links."""
    linked = total = 0
    work = [(node, False)]
    while work:
        item, link = work.pop()
        if item.tag:
            work.extend((c, link or item.tag == "a") for c in item.children)
        else:
            size = len("".join(item.text.split()))
            linked, total = linked + size * link, total + size
    return 2 * linked > total


def parse(page: str | None) -> Node:
    """Tree of a page; end tags that are left out or belong to nothing are coped with as browsers do, by and large."""
    root = Node("html", "html")
    stack, at, page = [root], 0, page or ""
    doubtful: list[Node] = []

    def text(value: str) -> None:
        if value and (value.strip() or stack[-1].children):
            stack[-1].children.append(Node("", text=entities.unescape(value)))

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            if m.group().startswith("<![CDATA["):
                text(entities.escape(m.group()[9:].removesuffix("]]>")))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in ("body", "html"):
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if stack[depth].tag in ("article", "main", "section", "div", "td", "table") and tag not in NO_PARAGRAPH:
                    break
            continue
        if tag in ("html", "body"):
            continue
        if tag in NO_PARAGRAPH:                    # a block ends an open paragraph, also one with open inline elements
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    del stack[depth:]
                    break
                if stack[depth].tag in BLOCK:
                    break
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in CLOSED_BY.get(tag, ()):
                del stack[depth:]
                break
            if stack[depth].tag in ("ul", "ol", "dl", "table", "select", "menu"):
                break
        apart, name = _is_apart(tag, m[3], any(x.tag in ("article", "main") for x in stack))
        node = Node(tag, name, bool(apart))
        if apart is None:
            doubtful.append(node)
        stack[-1].children.append(node)
        if tag in RAW:                             # its content is no markup
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = len(page) if end is None else page.find(">", end.start()) + 1 or len(page)
        elif tag not in VOID and not m[3].endswith("/") or tag == "p":
            stack.append(node)
    for node in doubtful:
        node.apart = _links_dominate(node)
    return root


def key_of(place: str, text: str) -> int:
    """Number of a text at a place."""
    return int.from_bytes(blake2b(f"{place}\t{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def lines_of(node: Node, skip: Set[int] = frozenset(), whole: bool = False) -> list[list[tuple[str, str]]]:
    """Lines of a tree in page order, each the (place, text) of its text nodes.

    Elements set apart are left out unless ``whole``, and so are articles whose
    place ``skip`` holds.
    """
    out: list[list[tuple[str, str]]] = []
    line: list[tuple[str, str]] = []

    def flush() -> None:
        if any(t.strip() for _, t in line):
            out.append(line.copy())
        line.clear()

    work: list = [(node, "", False)]
    while work:
        item, where, leave = work.pop()
        if leave:
            flush()
            continue
        if not item.tag:
            line.append((where, item.text))
            continue
        here = f"{where}/{item.name}"
        if (item.apart and not whole) or (skip and item.tag == "article" and key_of(here, "") in skip):
            if item.tag in BLOCK:
                flush()
            continue
        if item.tag in BLOCK:
            flush()
            work.append((item, where, True))
        work.extend((c, here, False) for c in reversed(item.children))
    flush()
    return out


def joined(line: list[tuple[str, str]]) -> str:
    return " ".join("".join(t for _, t in line).split())


def find(node: Node, tags: tuple[str, ...]) -> list[Node]:
    """Outermost elements with one of the tags, in page order, not inside elements set apart."""
    out, work = [], [node]
    while work:
        item = work.pop()
        if item.tag in tags:
            out.append(item)
        elif not item.apart or item is node:
            work.extend(reversed(item.children))
    return out


def layout_of(node: Node) -> int:
    """Number of a page's layout: the set of its outer containers, without those set apart and those within articles."""
    found, work = set(), [(node, "", 0)]
    while work:
        item, where, depth = work.pop()
        here = f"{where}/{item.name}"
        if depth:
            found.add(here)
        if depth < 3 and item.tag not in ("article", "main"):
            work.extend((c, here, depth + 1) for c in item.children if c.tag in CONTAINERS and not c.apart)
    return key_of("\n".join(sorted(found)), "")


def _flat(node: Node) -> Node:
    """A copy of a whole tree for matching: texts as leaves.  Only what lies deeper than 200 elements is left out."""

    def copy(n: Node, depth: int) -> Node | None:
        if (not n.tag and not n.text.strip()) or n.tag in RAW:
            return None
        made = Node(n.tag, n.name, n.apart, " ".join(n.text.split()))
        if depth < 200:
            made.children = [c for x in n.children if (c := copy(x, depth + 1)) is not None]
        return made

    return copy(node, 0) or Node("html", "html")


def _align(xs: list[Node], ys: list[Node]) -> tuple[int, list[tuple[Node, Node]]]:
    n, m = len(xs), len(ys)
    if not n or not m:
        return 0, []
    if n * m > MOST_PAIRS and min(n, m) > 1:       # long lists of children are aligned half by half
        left, right = _align(xs[:n // 2], ys[:m // 2]), _align(xs[n // 2:], ys[m // 2:])
        return left[0] + right[0], left[1] + right[1]
    score = [[0] * (m + 1) for _ in range(n + 1)]
    found: dict[tuple[int, int], tuple[int, list]] = {}
    for i in range(n):
        for j in range(m):
            got = tree_match(xs[i], ys[j])
            if got[0]:
                found[i, j] = got
            score[i + 1][j + 1] = max(score[i][j + 1], score[i + 1][j], score[i][j] + got[0])
    pairs, i, j = [], n, m
    while i and j:
        if score[i][j] == score[i - 1][j]:
            i -= 1
        elif score[i][j] == score[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs += found[i, j][1]
    return score[n][m], pairs


def tree_match(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: size of the largest top-down, order-keeping matching, and its pairs."""
    if a.tag != b.tag or a.tag and a.name != b.name:
        return 0, []
    size, pairs = _align(a.children, b.children)
    return 1 + size, [(a, b), *pairs]


def induce(pages: list[str], p: Params) -> set[int]:
    """Numbers of the template texts, and of the places of teasers, of different pages of one layout."""
    trees = [_flat(parse(page)) for page in pages]
    if len(trees) < p.least_pages:
        return set()
    first, constant, slots = trees[0], Counter(), Counter()
    places: dict[int, str] = {}
    articles: Counter = Counter()                  # how many a place has on the first page
    inside: dict[int, str] = {}                    # the innermost article around a text
    work = [(first, "", "")]
    while work:
        node, place, article = work.pop()
        places[id(node)], inside[id(node)] = place, article
        here = f"{place}/{node.name}"
        if node.tag == "article":
            article = here
            articles[here] += 1
        work.extend((c, here, article) for c in node.children)
    for other in trees[1:]:
        same = set()
        for a, b in tree_match(first, other)[1]:
            if not a.tag:
                if a.text == b.text:
                    same.add(key_of(places[id(a)], a.text))
                elif inside[id(a)]:
                    slots[inside[id(a)]] += min(len(a.text), len(b.text))
        constant.update(same)
    need = max(p.least_pages - 1, -(-2 * (len(trees) - 1) // 3))
    template = {k for k, n in constant.items() if n >= need}
    held = {place: slots[place] / n for place, n in articles.items()}
    # Teasers: articles whose slots hold less than half as much as the main one's; those around the main one stay.
    main = max(held, key=lambda x: (held[x], x), default="")
    return template | {key_of(x, "") for x in held if 2 * held[x] < held[main] and not main.startswith(f"{x}/")}


def main_text(page: str | None, template: set[int] | None) -> str:
    """Text of a page's main part, a line for each block; without a wrapper (None) by the elements alone."""
    tree = parse(page)
    if template is None:
        for part in find(tree, ("article",)), find(tree, ("main",)), [tree]:
            lines = [joined(line) for x in part for line in lines_of(x)]
            if lines:
                return "\n".join(lines)
        return ""
    lines = [(joined(line), all(key_of(place, " ".join(t.split())) in template for place, t in line if t.strip()))
             for line in lines_of(tree, template)]
    kept, standing = [t for t, stands in lines if not stands], [t for t, stands in lines if stands]
    # A page nearly all of whose text recurs is a near copy of others, no template: it stays whole.
    if len(standing) > 3 and sum(map(len, standing)) > 3 * sum(map(len, kept)):
        kept = [t for t, _ in lines]
    return "\n".join(kept)


def host_of(url: str) -> Column:
    """Host of a URL in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            out: str = "text", p: Params = Params()) -> DataFrame:
    """Add the main text to every row; other columns stay.

    A null or empty page gives an empty text.  Pages without a host are taken
    as one host.  Hosts with too few differing pages have no wrapper; their
    pages are read by the elements alone.
    """
    columns = [c for c in pages.columns if c != out]
    own = next(n for n in ("_" * k + "host" for k in range(1, 99)) if n not in {c.lower() for c in columns})
    hosted = pages.select(*columns, host_of(url_col).alias(own))
    source = hosted.where(F.col(html_col).isNotNull()).select(
        F.col(own).alias("_host"), F.xxhash64(html_col).alias("raw"), F.col(html_col).alias("html"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page in batch.column(2):
                tree = parse(page.as_py())
                digest = key_of("", "\n".join(joined(line) for line in lines_of(tree)))
                nodes = sorted({(key_of(place, ""), key_of(place, " ".join(t.split())))
                                for line in lines_of(tree) for place, t in line if t.strip()})
                rows.append((digest, layout_of(tree), [x for x, _ in nodes], [k for _, k in nodes]))
            digest, layout, places, keys = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digest, pa.int64()), pa.array(layout, pa.int64()),
                 pa.array(places, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                names=["_host", "raw", "digest", "layout", "places", "keys"])

    # One row for each different page; a page with more than one copy counts once.
    seen = stored(source.mapInArrow(scan, "_host string, raw long, digest long, layout long, places array<long>, keys array<long>")
                  .groupBy("_host", "digest").agg(F.min(F.struct("raw", "layout", "places", "keys")).alias("p"))
                  .select("_host", "p.*"), "seen")
    node = seen.select("_host", F.explode(F.arrays_zip("places", "keys")).alias("k")).select(
        "_host", F.col("k.places").alias("place"), F.col("k.keys").alias("key"))
    stands = node.groupBy("_host", "place", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= p.least_pages)
    having = (seen.select("_host", F.explode(F.array_distinct("places")).alias("place")).groupBy("_host", "place")
              .agg(F.count(F.lit(1)).alias("of")).where(F.col("of") >= p.least_pages))
    counted = stands.join(having, ["_host", "place"]).where(3 * F.col("n") >= 2 * F.col("of")).select("_host", "key")

    # A layout's sample is chosen on narrow rows, the layout's size being held once for each salt, so neither pages nor a large
    # host come to one task; only chosen pages are moved.
    group = ["_host", "layout"]
    sizes = seen.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    differing = sizes.groupBy("_host").agg(F.sum("_n").alias("_n")).where(F.col("_n") >= p.least_pages).select("_host", F.lit(0).cast("long").alias("key"))
    sizes = sizes.where(F.col("_n") >= p.least_pages).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))))
    draw = F.pmod(F.xxhash64(F.lit(p.seed), "raw"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    salt = F.pmod(F.xxhash64(F.lit(p.seed + 1), "raw"), F.lit(p.salts)).cast("int")
    # About four times as many as are aligned: that fewer than least_pages are drawn of a larger layout has a chance below 1e-7.
    chosen = stored(seen.select(*group, "raw", draw.alias("draw"), salt.alias("_salt")).join(sizes, [*group, "_salt"])
                    .where(F.col("draw") * F.col("_n") < 4 * p.pages_per_layout).select(*group, "raw", "draw"), "chosen")
    key = ["_host", "raw"]
    sample = (likely_among(source, key, chosen, key).join(chosen, key)
              .groupBy(*group, "raw", "draw").agg(F.min("html").alias("html")))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pages = pdf.sort_values(["draw", "raw"])["html"].tolist()[:p.pages_per_layout]
        found = sorted(induce(pages, p))
        return pd.DataFrame({"_host": pd.Series([pdf["_host"].iloc[0]] * len(found), dtype=object),
                             "key": pd.Series(found, dtype="int64")})

    aligned = sample.groupBy(*group).applyInPandas(learn, "_host string, key long")
    wrappers = stored(counted.union(aligned).union(differing).groupBy("_host").agg(F.collect_set("key").alias("_template")), "wrappers")
    wrappers = wrappers.select(F.col("_host").alias(f"{own}_of"), F.col("_template").alias(f"{own}_template"))
    with_wrapper = (hosted.join(wrappers, F.col(own) == F.col(f"{own}_of"), "left")
                    .select(*columns, own, f"{own}_template"))
    at = with_wrapper.columns.index(html_col)
    schema = pages.select(*columns).schema.add(out, "string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, known = None, None
        for batch in batches:
            texts = []
            n = batch.num_columns
            for page, host, keys in zip(batch.column(at), batch.column(n - 2), batch.column(n - 1)):
                if known != host.as_py():
                    known, template = host.as_py(), set(keys.as_py()) if keys.is_valid else None
                texts.append(main_text(page.as_py(), template))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n - 2], pa.array(texts, pa.string())],
                                             names=[f.name for f in schema])

    return with_wrapper.mapInArrow(read, schema)
