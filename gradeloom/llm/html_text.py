"""HTML extraction by a tree-structured graphical model.

A page is parsed into a tree of block elements. Each has a state, content or not, with a unary potential from its tag, the
words of its class, id and role, and the text and links below it; each parent and child share a pairwise potential. Sum-product
message passing, once upward and once downward, gives every element's exact marginal, and text is kept where the block that
holds it is content with probability 1/2 or more. Unary weights (a ridge logistic regression) and pairwise tables (label
counts) are learned from labelled pages: generated ones of many layouts, and at most `max_pages` different pages, each of at most
`max_page_bytes`, of the table at hand that mark their article with a landmark element (those of the least hashes).

Text of a kept block: character references decoded, each run of white space one space, trimmed, empty blocks left out; blocks
are joined in page order by one newline.

Defined cases: a null or empty page gives "" and 0; very long and very deeply nested pages are parsed whole; a probability of
exactly 1/2 (a tie) keeps the block; unclosed, misnested and cut-off markup is repaired as browsers do for the
elements that matter here; text outside all markup counts as of the page's root; repeated rows are each extracted; an empty table
gives none; result columns replace input columns of the same name.

Scale: two scans for what is learned from (hashes first, so only chosen pages are moved), and one without a shuffle to extract;
the model is a few kilobytes. A page costs time in proportion to its length, whatever its nesting.
"""

from __future__ import annotations

import html
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm import _common as C

MAX_PAGES = 300
MAX_PAGE_BYTES = 1 << 18
N_GENERATED = 400
MADE = ["text", "n_chars"]

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Set in a line with the text around them; what is inside is markup.
SET_IN_LINE = frozenset("math object canvas audio video".split())
#: MathML's own elements; those in BREAKS_WORDS stand apart.
MATH = frozenset("maction maligngroup malignmark menclose merror mfenced mfrac mglyph mi mlabeledtr mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
BREAKS_WORDS = SET_IN_LINE | {"mtd", "mspace", "br"}
INLINE |= SET_IN_LINE | MATH
#: Elements whose inside is no markup, or is never shown as text of the page.
RAW = frozenset("script style noscript template iframe noembed noframes xmp textarea title svg select annotation annotation-xml".split())
BREAKS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
#: An element that begins ends the open ones of these kinds, up to an element of the second kind.
ENDS = {"li": ("li", "ul ol menu"), "dd": ("dd dt", "dl"), "dt": ("dd dt", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("thead tbody tr td th", "table"), "tfoot": ("tbody tr td th", "table"), "option": ("option", "select"), "body": ("head", "html")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
#: An open paragraph is not looked for beyond these.
HOLDS_P = ("table", "td", "th", "button", "article", "section", "div", "li", "aside", "blockquote")
HOLDS_ANY = ("table", "td", "th", "button")
TOKEN = re.compile(r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+[^>]*)(?:>|\Z)", re.S)
#: Styles that hide an element.
HIDES = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:!\s*important\s*)?(?:;|$)", re.I)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("children", "own", "words", "links", "marks", "name", "parent", "parts", "k")

    def __init__(self, name: str, parent: Node | None, parts: frozenset, k: int):
        self.name, self.parent, self.parts, self.k = name, parent, parts, k
        self.own = self.words = self.links = self.marks = self.children = 0


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements, parents first, and the text of blocks in page order with the number of its element."""
    nodes = [Node("#root", None, frozenset(), 0)]
    blocks: list[tuple[int, str]] = []
    stack: list[tuple[str, Node]] = [("#root", nodes[0])]
    depths: dict[str, list[int]] = {}  # of the open elements of each name
    endless: set[str] = set()
    text: list[str] = []
    in_link = 0

    def flush():
        if text:
            words = " ".join("".join(text).split())
            text.clear()
            if words:
                blocks.append((stack[-1][1].k, words))

    def say(raw: str):
        raw = html.unescape(raw) if "&" in raw else raw
        text.append(raw)
        n = len(raw.split())
        if n:
            node = stack[-1][1]
            node.own += len(raw)
            node.words += n
            node.marks += raw.count(".") + raw.count(",") + raw.count("?") + raw.count("!")
            if in_link:
                node.links += len(raw)

    def pop_to(depth: int):
        nonlocal in_link
        gone = [n for n, _ in stack[depth:]]
        if any(n not in INLINE for n in gone):
            flush()
        in_link -= gone.count("a")
        for n in gone:
            depths[n].pop()
        del stack[depth:]

    def push(name: str, node: Node):
        depths.setdefault(name, []).append(len(stack))
        stack.append((name, node))

    def innermost(names) -> int:
        return max((d[-1] for n in names if (d := depths.get(n))), default=0)

    def ended(kinds, until):
        border = innermost(until)
        while (d := innermost(kinds)) > border:
            pop_to(d)
            if len(kinds) == 1:
                return

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m[1]:
            name = m[1].lower()
            if name in SET_IN_LINE:
                text.append(" ")
            if depths.get(name):
                pop_to(depths[name][-1])
        elif m[2]:
            name = m[2].lower()
            if name in RAW:
                in_math = name.startswith("annotation")
                if not m[3].rstrip().endswith("/") or not (name == "svg" or in_math):
                    end = None if name in endless else re.compile(rf"</{re.escape(name)}(?![^\s/>])[^>]*(?:>|\Z)" + r"|(?=</math(?![^\s/>]))" * in_math, re.I).search(page, at)
                    if not end:
                        endless.add(name)
                    at = end.end() if end else at if in_math else len(page)
                text.append(" ")
                continue
            if name in VOID:
                if name not in INLINE:
                    flush()
                elif name in BREAKS_WORDS:
                    text.append(" ")
                continue
            if name in INLINE:
                if name in BREAKS_WORDS:
                    text.append(" ")
                if name in MATH and m[3].rstrip().endswith("/"):
                    continue
                if name == "a":
                    if in_link:
                        ended(("a",), BREAKS_P)
                    in_link += 1
                push(name, stack[-1][1])
                continue
            if name in ("html", "body") and depths.get(name):
                continue
            if name in ENDS:
                ended(*ENDS[name])
            if name in BREAKS_P:
                ended(("p",), HOLDS_P if name == "p" else HOLDS_ANY)
            flush()
            marks = [(a.lower(), b or c or d) for a, b, c, d in ATTRIBUTE.findall(m[3])] if m[3] else []
            parts = frozenset(p.lower() for a, v in marks if a in ("class", "id", "role", "itemprop", "aria-label", "data-role") for p in NAME_PART.findall(v)) | frozenset("hidden" for a, v in marks if a == "hidden" or a == "style" and HIDES.search(v))
            node = Node(name, stack[-1][1], parts, len(nodes))
            node.parent.children += 1
            nodes.append(node)
            push(name, node)
    flush()
    return nodes, blocks


PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
NUMBERS = ["bias", "link_share", "log_words", "own_words", "mark_rate", "page_share", "place", "children", "depth", "no_text", "few_words", "linked", "paragraphs"]


def numbers(nodes: list[Node]) -> np.ndarray:
    """One row of NUMBERS for each element, of what it holds with all below it."""
    n = len(nodes)
    parent = np.array([x.parent.k if x.parent else -1 for x in nodes])
    sums = np.array([(x.own, x.words, x.links, x.marks) for x in nodes], np.float64)
    own = sums[:, 1].copy()
    depth, direct = np.zeros(n), [0.0] * n
    rows = sums.tolist()
    for k in range(n - 1, 0, -1):
        p, r = rows[parent[k]], rows[k]
        for j in range(4):
            p[j] += r[j]
        if nodes[k].name in PARAGRAPHS:
            direct[parent[k]] += r[1]
    for k in range(1, n):
        depth[k] = depth[parent[k]] + 1
    chars, words, links, marks = np.array(rows).T
    share = links / np.maximum(chars, 1)
    return np.stack([np.ones(n), share, np.log1p(words) / 3, np.log1p(own) / 3, np.minimum(marks / np.maximum(words, 1), 1), words / max(words[0], 1), np.arange(n) / n, np.log1p([x.children for x in nodes]) / 2, np.minimum(depth, 12) / 6, words == 0, words < 5, share > 0.6, np.array(direct) / np.maximum(words, 1)], axis=1)


class TreeModel:
    """weights: of NUMBERS, of tags and of name parts; pair[a, b]: log potential of a parent in state a with a child in state b."""

    def __init__(self, numeric: np.ndarray, named: dict[str, float], pair: np.ndarray):
        self.numeric, self.named, self.pair = numeric, named, pair

    def unary(self, nodes: list[Node]) -> list[float]:
        """Log odds of content, from an element's own features."""
        get = self.named.get
        odds = numbers(nodes) @ self.numeric
        return [o + get("<" + x.name, 0.0) + sum(get(p, 0.0) for p in x.parts) for o, x in zip(odds.tolist(), nodes, strict=True)]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each element, exact on the tree. Messages are log odds, as states are two."""
        (a, b), (c, d) = self.pair.tolist()
        unary = self.unary(nodes)
        up = [0.0] * len(nodes)
        total = unary[:]
        for k in range(len(nodes) - 1, 0, -1):
            x = max(-60.0, min(60.0, total[k]))
            e = math.exp(x)
            up[k] = math.log((math.exp(c) + math.exp(d) * e) / (math.exp(a) + math.exp(b) * e))
            total[nodes[k].parent.k] += up[k]
        for k in range(1, len(nodes)):
            x = max(-60.0, min(60.0, total[nodes[k].parent.k] - up[k]))
            e = math.exp(x)
            total[k] += math.log((math.exp(b) + math.exp(d) * e) / (math.exp(a) + math.exp(c) * e))
        return [1 / (1 + math.exp(-max(-60.0, min(60.0, x)))) for x in total]

    def blocks(self, page: str | None) -> list[tuple[str, float]]:
        """Each block's text with its marginal."""
        nodes, found = parse(page or "")
        if not found:
            return []
        p = self.marginals(nodes)
        return [(t, p[k]) for k, t in found]

    def text(self, page: str | None) -> str:
        return "\n".join(t for t, p in self.blocks(page) if p >= 0.5)


def fit(pages: list[tuple[list[Node], list[int]]], ridge: float = 1.0, least: int = 3) -> TreeModel:
    """Learns from pages of which each element is labelled 1 (content) or 0."""
    counts: dict[str, int] = {}
    for nodes, _ in pages:
        for x in nodes:
            for name in ("<" + x.name, *x.parts):
                counts[name] = counts.get(name, 0) + 1
    names = {n: k for k, n in enumerate(sorted(n for n, c in counts.items() if c >= least))}
    rows, y, pair = [], [], np.ones((2, 2))
    for nodes, labels in pages:
        named = np.zeros((len(nodes), len(names)))
        for k, x in enumerate(nodes):
            for name in ("<" + x.name, *x.parts):
                if name in names:
                    named[k, names[name]] = 1
            if x.parent:
                pair[labels[x.parent.k], labels[k]] += 1
        rows.append(np.hstack([numbers(nodes), named]))
        y += labels
    x, y = np.vstack(rows), np.array(y, np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(12):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
    given = pair / pair.sum(axis=1, keepdims=True)
    return TreeModel(w[: len(NUMBERS)], {n: float(w[len(NUMBERS) + k]) for n, k in names.items()}, np.log(given / (pair.sum(axis=0) / pair.sum())))


# --- labelled pages

#: Names that page authors give to the parts of a page.
CONTENT_NAMES = ["article", "post", "entry-content", "story-body", "main-content", "article-body", "post-content", "content", "text", "page-content", "entry", "articleText", "body-copy", "rich-text"]
OTHER_NAMES = {
    "nav": ["nav", "menu", "navbar", "main-menu", "navigation", "breadcrumb", "breadcrumbs", "topnav", "menu-bar", "pagination", "tabs"],
    "header": ["header", "site-header", "masthead", "top-bar", "page-header", "branding", "logo"],
    "footer": ["footer", "site-footer", "page-footer", "bottom", "copyright", "colophon", "legal"],
    "aside": ["sidebar", "side", "widget", "aside", "related", "related-posts", "trending", "recommended", "popular", "rail", "more-stories"],
    "ad": ["ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "promotion", "ad-slot", "adbox"],
    "notice": ["cookie", "cookie-notice", "notice", "consent", "gdpr", "alert", "banner-notice", "popup", "modal", "overlay", "newsletter", "subscribe", "paywall", "disclaimer"],
    "form": ["form", "search", "search-form", "login", "signup", "contact-form", "newsletter-form"],
    "comments": ["comments", "comment", "comment-list", "discussion", "replies", "respond", "reader-comments", "comment-body"],
    "share": ["share", "social", "share-buttons", "tags", "meta", "byline-links", "tools", "toolbar"],
}
PLAIN_TAG = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "notice": "dialog", "comments": "section", "ad": "aside", "share": "ul"}


def generated(seed: int) -> tuple[str, list[int]]:
    """A page of a random layout, and the label of each of its elements in the order of parse()."""
    rng = random.Random(seed)
    out, labels = [], [0]
    syllables = ["".join(rng.choice("bcdfghlmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(300)]

    def words(n: int) -> str:
        found = [rng.choice(syllables) for _ in range(n)]
        return " ".join(w + (rng.choice(".,") if rng.random() < 0.12 else "") for w in found).capitalize() + rng.choice([".", ".", ".", "", "!"])

    def el(tag: str, label: int, inside, names: list[str] | None = None):
        mark = f' {rng.choice(["class", "class", "class", "id"])}="{" ".join(rng.sample(names, min(len(names), rng.choice([1, 1, 2]))))}"' if names else ""
        labels.append(label)
        out.append(f"<{tag}{mark}>")
        inside() if callable(inside) else out.append(inside)
        out.append(f"</{tag}>")

    def link(n: int = 2) -> str:
        return f'<a href="/{rng.randint(1, 999)}">{words(rng.randint(1, n))}</a>'

    def links(n: int, label: int = 0, long: int = 3):
        el(rng.choice(["ul", "ul", "ol"]), label, lambda: [el("li", label, link(long)) for _ in range(n)])

    def paragraph(label: int, longest: int = 90):
        body = words(rng.choice([1, 2, 3, 6, 12, 25, 40, longest]))
        if rng.random() < 0.25:
            body = f"{body} {link()} {words(rng.randint(1, 20))}"
        if rng.random() < 0.2:
            body = f"<b>{body}</b>"
        el("p" if rng.random() < 0.93 else "div", label, body)

    def other(kind: str):
        plain = rng.random() < 0.45
        tag = PLAIN_TAG[kind] if plain else "div"
        names = rng.sample(OTHER_NAMES[kind], min(3, len(OTHER_NAMES[kind]))) if not plain or rng.random() < 0.4 else None
        if kind == "ad" and tag == "aside" and not names:
            names = OTHER_NAMES["ad"]

        def inside():
            if kind in ("nav", "share"):
                [el("li", 0, link(2)) for _ in range(rng.randint(2, 9))] if tag == "ul" else rng.choice([lambda: links(rng.randint(2, 9)), lambda: out.append(" | ".join(link(2) for _ in range(rng.randint(2, 8))))])()
            elif kind == "header":
                rng.choice([lambda: el("h1", 0, link(3)), lambda: el("div", 0, words(3)), lambda: out.append(link(2)), lambda: el("p", 0, words(6))])()
                if rng.random() < 0.5:
                    links(rng.randint(2, 6))
            elif kind == "footer":
                rng.choice([lambda: out.append("&copy; " + words(rng.randint(3, 20))), lambda: el("p", 0, "&copy; " + words(rng.randint(3, 20))), lambda: links(rng.randint(2, 8)), lambda: paragraph(0, 30)])()
            elif kind == "aside":
                el(rng.choice(["h2", "h3", "h4", "div"]), 0, words(2))
                rng.choice([lambda: links(rng.randint(2, 8), 0, 9), lambda: paragraph(0, 40), lambda: el("div", 0, link(8))])()
            elif kind in ("ad", "notice"):
                rng.choice([lambda: out.append(words(rng.randint(2, 30))), lambda: el("p", 0, words(rng.randint(3, 40))), lambda: el("p", 0, words(8) + link(3))])()
                if kind == "notice" and rng.random() < 0.5:
                    el("button", 0, words(1))
            elif kind == "form":
                el("p", 0, words(3))
                out.append('<input type="text">')
                el("button", 0, words(1))
            else:
                el(rng.choice(["h2", "h3"]), 0, words(2))
                for _ in range(rng.randint(1, 6)):
                    el(rng.choice(["div", "article", "li"]), 0, lambda: (el("p", 0, link(2)), paragraph(0, 60)), rng.choice([None, ["comment"], ["reply"], ["comment-body"]]))

        el(tag, 0, inside, names)

    def content():
        if rng.random() < 0.7:
            el("h1", 1, words(rng.randint(2, 12)))
        for _ in range(rng.randint(1, 14)):
            r = rng.random()
            if r < 0.74:
                paragraph(1)
            elif r < 0.82:
                el(rng.choice(["h2", "h3", "h4"]), 1, words(rng.randint(1, 8)))
            elif r < 0.87:
                el(rng.choice(["ul", "ol"]), 1, lambda: [el("li", 1, words(rng.randint(1, 25))) for _ in range(rng.randint(2, 6))])
            elif r < 0.90:
                el("blockquote", 1, lambda: paragraph(1))
            elif r < 0.92:
                el("pre", 1, words(20))
            elif r < 0.95:
                el("table", 1, lambda: [el("tr", 1, lambda: [el("td", 1, words(3)) for _ in range(3)]) for _ in range(rng.randint(1, 4))])
            elif r < 0.97:
                el("figure", 1, lambda: el("figcaption", 1, words(8)))
            elif inner:
                other(rng.choice(["ad", "aside", "share", "notice", "form", "nav"]))

    inner = rng.random() < 0.5
    layout = rng.random()

    def main():
        if layout < 0.35:
            el("article", 1, content, rng.choice([None, None, CONTENT_NAMES]))
        elif layout < 0.5:
            el("main", 1, content, rng.choice([None, CONTENT_NAMES]))
        elif layout < 0.85:
            el(rng.choice(["div", "div", "section"]), 1, content, rng.sample(CONTENT_NAMES, 4))
        else:
            content()

    def body():
        for kind in rng.sample(["nav", "header", "ad", "notice", "form", "share"], rng.randint(1, 4)):
            other(kind)
        if rng.random() < 0.35 and layout < 0.85:
            el("div", 0, lambda: (main(), other("aside")), rng.choice([None, ["wrapper", "container"], ["page", "layout"], ["row", "columns"]]))
        else:
            main()
        for kind in rng.sample(["aside", "comments", "ad", "footer", "nav", "form", "share", "notice"], rng.randint(1, 4)):
            other(kind)

    el("html", 0, lambda: (el("head", 0, f"<title>{words(4)}</title><style>p{{}}</style>"), el("body", int(layout >= 0.85), body)))
    return "".join(out), labels


def by_landmark(page: str | None) -> tuple[list[Node], list[int]] | None:
    """Labels from one article (or else main) element: content is what is in it, but for parts that name themselves as other."""
    nodes, blocks = parse(page or "")
    marks = [x for x in nodes if x.name == "article"] or [x for x in nodes if x.name == "main"]
    if len(marks) != 1 or not blocks:
        return None
    foreign = {"nav", "aside", "footer", "form", "dialog"}
    names = {p.lower() for group in OTHER_NAMES.values() for n in group for p in NAME_PART.findall(n)}
    labels = [0] * len(nodes)
    for x in nodes[1:]:
        inside = x is marks[0] or labels[x.parent.k]
        labels[x.k] = int(bool(inside) and x.name not in foreign and (x is marks[0] or not (x.parts & names)))
    return nodes, labels


def train(pages: DataFrame | None = None, *, page: str = "html", max_pages: int = MAX_PAGES, max_page_bytes: int = MAX_PAGE_BYTES, n_generated: int = N_GENERATED) -> TreeModel:
    """Learns from generated pages and from at most max_pages of the table (the least by a hash, the same in every run); max_pages x max_page_bytes reach the driver at most."""
    labelled = []
    for seed in range(n_generated):
        made, labels = generated(seed)
        nodes, _ = parse(made)
        if len(nodes) == len(labels):
            labelled.append((nodes, labels))
    if pages is not None:
        body = F.col(f"`{page}`")
        own = pages.select(body.alias("page")).filter((F.octet_length("page") <= max_page_bytes) & F.col("page").rlike("(?i)<(article|main)[ >]")).withColumn("h", F.xxhash64("page"))
        few = C.least(own.select("h"), max_pages)
        # One of equal pages; the last order is that of hashes, as few as they are now.
        chosen = own.join(F.broadcast(few), "h", "left_semi").groupBy("h").agg(F.min("page").alias("page")).orderBy("h")
        labelled += [x for r in chosen.toLocalIterator() if (x := by_landmark(r["page"]))]
    return fit(labelled)


def extract(pages: DataFrame, model: TreeModel, *, page: str = "html", keep: list[str] | None = None) -> DataFrame:
    """pages' columns (or those of `keep`) with text and n_chars."""
    keep = C.others(pages, MADE) if keep is None else keep
    source = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{page}`").alias("page"))
    source = source.toDF(*[f"c{k}" for k in range(len(keep))], "page")
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    held = pages.sparkSession.sparkContext.broadcast(model)

    def step(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = [held.value.text(p) for p in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return source.mapInArrow(step, schema).toDF(*keep, *MADE)


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, train(pages), keep=["page_id", "url"])


QUERIES = {"op5_html_extraction": op5_html_extraction}
ORACLES: dict[str, str] = {}
