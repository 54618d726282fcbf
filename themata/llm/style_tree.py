"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of elements. An element is known by the chain of tags and
classes that leads to it; for each element the tree counts the pages that have it, the presentations
(sequences of child elements) and the contents (texts of the whole branch) they show there. Entropy over
the pages, divided by its largest value, says how much an element varies; the importance of a branch
weighs the entropy of its contents with that of its presentations. Menus, notices and footers repeat, so
their importance is low, and branches under ``MIN_IMPORTANCE`` leave each page.

A host with few pages says little, and some branches vary on every page without being main text. So
elements that name their own role (``ROLE_TAGS``, ``ROLE_WORDS``) leave as well, also articles that are
comments or advertisements. Of the others, branches that hold an article, and running text inside one, stay
whatever their classes say: wrappers are named after their layout, and copies of an article on one host
repeat too. Text outside articles is main text if it is the larger part of what is left.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themata.llm.common import column, slices
from themata.storage import materialise

MIN_PAGES = 4
MIN_IMPORTANCE = 0.3
CONTENT_WEIGHT = 0.8

# HTML elements by how they are treated.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style title textarea xmp noembed noframes".split())
ROLE_TAGS = frozenset(
    "head script style noscript template iframe svg math canvas object form button select textarea input "
    "nav aside footer menu dialog audio video map datalist xmp noembed noframes title".split()
)
INLINE_TAGS = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr img".split()
)
TEXT_TAGS = frozenset(
    "p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table thead tbody tfoot tr td th caption figure "
    "figcaption hgroup".split()
)
#: Text that inside an article is running text whatever it is called.
PROSE_TAGS = frozenset(
    "p h1 h2 h3 h4 h5 h6 blockquote pre table caption thead tbody tfoot tr td th figure figcaption hgroup".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: Elements that an element of the same group ends, up to the nearest of the containers.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")),
}
ARTICLE_TAGS = frozenset(("article", "main"))
ROLE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar toolbar footer "
    "bottombar colophon comment comments disqus replies respond discussion share sharing social related "
    "recommended recommendations widget widgets pagination pager copyright legal disclaimer skip search form "
    "hidden contentinfo complementary search dialog".split()
)
#: Role words that inside an article also name parts of its text.
PART_WORDS = frozenset(
    "discussion notice notices alert consent legal disclaimer copyright recommendations header".split()
)
#: Role words that in compound names of an article tell its layout.
LAYOUT_WORDS = frozenset(
    "sidebar side rail menu nav navbar navigation header masthead topbar toolbar footer search form skip".split()
)
#: Words of a name behind its role word that say where or how large it is, not what.
NEUTRAL = frozenset(
    "box boxes wrapper wrap container inner outer area block blocks slot unit section panel left right top bottom "
    "bar row list item items link links button buttons icon icons posts content main primary secondary global "
    "site page fixed sticky small large desktop mobile".split()
)
#: A name that begins so tells what a wrapper has, not what it is.
HAVING = frozenset("with without has no".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*))")
WORD = re.compile(r"[a-z]+")

COUNTS = "host string, path long, kind int, feature long, n long"
PATHS = "page long, host string, path long"


def roles_of(tag: str, names: list[str]) -> frozenset[str]:
    """The role words by which an element says what it is.

    Names of articles often tell topics or the layout, so only the first word of each counts. Of other
    compound names, the last word counts (``post-comments``; but ``side-effects`` is about effects), or the
    first one if the others only say where it stands (``ad-box``).
    """
    roles: set[str] = set()
    for words in filter(None, map(WORD.findall, names)):
        if tag == "article":
            if len(words) == 1 or words[0] not in LAYOUT_WORDS:
                roles.add(words[0])
        elif tag != "main" and words[0] not in HAVING:
            rest = [w for w in words[1:] if len(w) > 1 and w not in NEUTRAL]
            roles.add(words[-1] if rest else words[0])
            roles.add(words[-1])
    return frozenset(roles & ROLE_WORDS - (PART_WORDS if tag == "article" else frozenset()))


class Element:
    __slots__ = ("tag", "label", "roles", "hidden", "parent", "children")

    def __init__(self, tag: str, attributes: str, parent: Element | None) -> None:
        self.tag, self.parent = tag, parent
        self.children: list[Element | str] = []
        self.label, self.roles, self.hidden = tag, frozenset(), False
        if "=" in attributes or "hidden" in attributes:
            found = {a.lower(): (x or y or z) for a, x, y, z in ATTRIBUTE.findall(attributes)}
            classes = " ".join(sorted(found.get("class", "").lower().split()))
            if classes:
                self.label = f"{tag}.{classes}"
            named = " ".join(found.get(a, "") for a in ("class", "id", "role")).lower()
            if not ROLE_WORDS.isdisjoint(WORD.findall(named)):
                self.roles = roles_of(tag, named.split())
            style = found.get("style", "").replace(" ", "").lower()
            bare = ATTRIBUTE.sub(" ", attributes).lower().split()
            self.hidden = "display:none" in style or "visibility:hidden" in style or "hidden" in bare


def parse(page: str) -> Element:
    """The page's elements as a tree; broken markup is mended like browsers do in the common cases."""
    root = Element("html", "", None)
    here, at, size = root, 0, len(page)
    # Open elements by tag: what is not open is not looked for.
    opened: Counter[str] = Counter()

    def leave(to: Element) -> Element:
        node = here
        while node is not to:
            opened[node.tag] -= 1
            node = node.parent
        return to

    def end(tags: tuple[str, ...], within: tuple[str, ...] = ()) -> Element:
        node = here if any(opened[t] for t in tags) else root
        while node is not root and node.tag not in within:
            if node.tag in tags:
                return leave(node.parent)
            node = node.parent
        return here

    while at < size:
        found = TOKEN.search(page, at)
        text = page[at : found.start() if found else size]
        if text:
            here.children.append(html.unescape(text))
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if tag and not found[0].endswith(">"):
            break  # a tag that the page breaks off in
        if not tag:
            if found[0].startswith("<![CDATA["):
                here.children.append(found[0][9:].removesuffix("]]>"))
            continue
        if found[1]:
            if tag == "br":
                here.children.append(Element("br", "", here))
            elif tag not in ("html", "body"):
                # A closing tag that opens nothing is left out; an inline one does not end blocks.
                node = here if opened[tag] else root
                while node is not root and node.tag != tag:
                    if tag in INLINE_TAGS and node.tag not in INLINE_TAGS:
                        node = root
                        break
                    node = node.parent
                if node is not root:
                    here = leave(node.parent)
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P:
            here = end(("p",), ("td", "th", "li", "article", "section", "div", "table", "button"))
        if tag in SIBLINGS:
            here = end(*SIBLINGS[tag])
        child = Element(tag, found[3], here)
        here.children.append(child)
        if tag in VOID_TAGS or found[3].endswith("/") and tag not in INLINE_TAGS and tag in ("path", "rect", "circle"):
            continue
        if tag in RAW_TAGS:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            child.children.append(page[at : close.start() if close else size])
            at = close.end() if close else size
            continue
        here = child
        opened[tag] += 1
    return root


def never_text(node: Element, holds: bool) -> bool:
    """Whether a branch leaves by its tag or style; a form around an article is a wrapper."""
    return node.hidden or node.tag in ROLE_TAGS and not (node.tag == "form" and holds)


def is_apart(node: Element, in_article: bool, found: dict[int, bool]) -> bool:
    """Whether an element says itself that it is not main text."""
    if never_text(node, found[id(node)]):
        return True
    if found[id(node)] or in_article and node.tag in PROSE_TAGS:
        return False
    if in_article and node.tag not in ARTICLE_TAGS:
        return not node.roles <= PART_WORDS
    return bool(node.roles) or node.tag == "header"


def articles(root: Element) -> dict[int, bool]:
    """Whether a branch is or holds an article that names no other role; by element."""
    found: dict[int, bool] = {}
    stack = [(root, False)]
    while stack:
        at, ready = stack.pop()
        if ready:
            holds = at.tag in ARTICLE_TAGS and not at.roles or any(
                found[id(c)] for c in at.children if isinstance(c, Element)
            )
            found[id(at)] = holds and not never_text(at, holds)
        else:
            stack.append((at, True))
            stack.extend((c, False) for c in at.children if isinstance(c, Element))
    return found


def text_blocks(node: Element, skip: set[int]) -> list[str]:
    """Texts of the blocks below a node in page order, without the branches to skip."""
    blocks, line = [], []

    def flush() -> None:
        if text := " ".join("".join(line).split()):
            blocks.append(text)
        line.clear()

    stack: list[Element | str | None] = [node]
    while stack:
        at = stack.pop()
        if at is None:
            flush()
        elif isinstance(at, str):
            line.append(at)
        elif at.tag == "br":
            line.append(" ")
        else:
            # A branch that is skipped still parts what stands before and behind it.
            if at.tag not in INLINE_TAGS:
                flush()
                stack.append(None)
            if id(at) not in skip:
                stack.extend(reversed(at.children))
    flush()
    return blocks


def hash64(text: str) -> int:
    from xxhash import xxh3_64_intdigest

    value = xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def branches(root: Element, found: dict[int, bool]) -> Iterator[tuple[int, Element, bool]]:
    """Elements that may leave by their importance, with the hash of their chain of labels.

    Those are elements outside articles that hold none, down to running text; and, inside articles,
    elements that are not running text. Elements that name their role are included, as the tree
    counts them, but not what lies in them.
    """
    stack = [(c, 0, False) for c in root.children if isinstance(c, Element)]
    while stack:
        node, above, inside = stack.pop()
        if node.tag in INLINE_TAGS or node.tag == "br" or node.tag in RAW_TAGS or node.tag == "head":
            continue
        path = hash64(f"{above}>{node.label}")
        inside |= node.tag in ARTICLE_TAGS
        running = node.tag in TEXT_TAGS
        if not found[id(node)] and not (inside and running):
            yield path, node, inside
        if not is_apart(node, inside, found) and not running:
            stack.extend((c, path, inside) for c in node.children if isinstance(c, Element))


def content_hashes(root: Element) -> dict[int, int]:
    """Hashes of the texts of all branches, each made of those of its children."""
    out: dict[int, int] = {}
    stack: list[tuple[Element, bool]] = [(root, False)]
    while stack:
        node, ready = stack.pop()
        inner = [c for c in node.children if isinstance(c, Element)]
        if not ready and inner:
            stack.append((node, True))
            stack.extend((c, False) for c in inner)
            continue
        parts = (out[id(c)] if isinstance(c, Element) else " ".join(c.split()) for c in node.children)
        out[id(node)] = hash64("\x1f".join(str(p) for p in parts if p))
    return out


def features(page: str) -> dict[int, tuple[int, int]]:
    """By path: hashes of the presentation and of the content of all the page's elements there."""
    styles: dict[int, list[str]] = {}
    contents: dict[int, list[str]] = {}
    root = parse(page)
    texts = content_hashes(root)
    for path, node, _ in branches(root, articles(root)):
        labels = [c.label for c in node.children if isinstance(c, Element)]
        runs = [x for i, x in enumerate(labels) if not i or labels[i - 1] != x]
        styles.setdefault(path, []).append(",".join(runs))
        contents.setdefault(path, []).append(str(texts[id(node)]))
    return {p: (hash64("\x1d".join(styles[p])), hash64("\x1d".join(contents[p]))) for p in styles}


def main_text(page: str, unimportant: set[int]) -> str:
    """The text of a page without branches that name their role or have an unimportant path."""
    root = parse(page)
    found = articles(root)
    low = {id(node) for path, node, _ in branches(root, found) if path in unimportant}
    skip, hidden = set(low), set()
    stack = [(c, False) for c in root.children if isinstance(c, Element)]
    while stack:
        node, inside = stack.pop()
        inside |= node.tag in ARTICLE_TAGS
        if is_apart(node, inside, found):
            skip.add(id(node))
            if never_text(node, found[id(node)]) or node.tag == "header":
                hidden.add(id(node))
                continue
        stack.extend((c, inside) for c in node.children if isinstance(c, Element))
    tops, stack = [], [root] if found[id(root)] else []
    while stack:
        node = stack.pop()
        if id(node) in skip:
            continue
        if node.tag in ARTICLE_TAGS:
            tops.append(node)
        else:
            stack.extend(c for c in reversed(node.children) if isinstance(c, Element))
    if tops:
        # Beside a main element, or articles that are most of what is left, other text is not main text.
        inner = " ".join(b for top in tops for b in text_blocks(top, skip))
        if any(top.tag == "main" for top in tops):
            return inner
        outer = " ".join(text_blocks(root, skip | {id(top) for top in tops}))
        if len(outer) <= len(inner):
            return inner
    # A page whose whole text stands in a wrapper with the name of a role has that text.
    return " ".join(text_blocks(root, skip)) or " ".join(text_blocks(root, low | hidden))


def unimportant_paths(pages: DataFrame, min_pages: int = MIN_PAGES, least: float = MIN_IMPORTANCE) -> DataFrame:
    """(host, path) of the branches of ``pages`` (host, html) whose importance is too low."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            seen: Counter[tuple] = Counter()
            for host, page in zip(column(batch, "host"), column(batch, "html"), strict=True):
                for path, pair in features(page).items():
                    for kind, feature in enumerate(pair):
                        seen[host, path, kind, feature] += 1
            columns = zip(*((*key, n) for key, n in seen.items()), strict=True) if seen else [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                names=["host", "path", "kind", "feature", "n"],
            )

    counts = pages.where("host is not null").mapInArrow(count, COUNTS)
    shown = counts.groupBy("host", "path", "kind", "feature").agg(F.sum("n").alias("n"))
    n = F.col("n").cast("double")
    by_kind = shown.groupBy("host", "path", "kind").agg(F.sum("n").alias("m"), F.sum(n * F.log(n)).alias("s"))
    # The entropy of the shares n / m is log m - s / m, at most log m.
    varies = F.when(F.col("m") > 1, 1 - F.col("s") / (F.col("m") * F.log(F.col("m").cast("double")))).otherwise(1.0)
    weight = F.when(F.col("kind") == 1, CONTENT_WEIGHT).otherwise(1 - CONTENT_WEIGHT)
    merged = by_kind.groupBy("host", "path").agg(F.max("m").alias("m"), F.sum(varies * weight).alias("importance"))
    return merged.where((F.col("m") >= min_pages) & (F.col("importance") < least)).select("host", "path")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, least: float = MIN_IMPORTANCE) -> DataFrame:
    """``pages`` (page_id, url, html) to (page_id, url, text, n_chars).

    Null html is the empty page, whose text is empty. Pages without a readable host belong to no
    site; only their elements' roles count. Repeated rows are pages of their own in the tree and are
    all kept. Other columns are ignored. An empty table gives no rows.
    """
    rows = pages.select(
        "page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumn("page", F.xxhash64("page_id", "url", "html"))
    host = F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    hosted = rows.select("page", "html", F.when(host != "", host).alias("host"))
    low = materialise(unimportant_paths(hosted, min_pages, least), "unimportant-branches")

    def list_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [
                (page, host, path)
                for page, host, text in zip(*(column(batch, n) for n in ("page", "host", "html")), strict=True)
                for root in (parse(text),)
                for path in {p for p, _, _ in branches(root, articles(root))}
            ]
            columns = zip(*found, strict=True) if found else [[]] * 3
            kinds = (pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["page", "host", "path"]
            )

    has = hosted.where("host is not null").mapInArrow(list_paths, PATHS)
    gone = has.join(low, ["host", "path"]).groupBy("page").agg(F.collect_set("path").alias("gone"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for pages, paths in batches:
            yield pd.Series(
                [main_text(p, set() if g is None else {int(x) for x in g}) for p, g in zip(pages, paths, strict=True)]
            )

    text = F.pandas_udf(cut, "string")
    return (
        rows.join(gone, "page", "left")
        .select("page_id", "url", text("html", "gone").alias("text"))
        .withColumn("n_chars", F.length("text").cast("long"))
    )
