"""The main text of web pages by boosted trees over the nodes of their DOM.

A page is parsed into its block elements. Each gets features: tag and attribute
tokens of its own and of what is around it, text, link and markup density of its
subtree, depth, and statistics of its siblings. Boosted trees give the log odds that
a node holds main text. Decoding is hierarchical: a node can be kept only if its parent
is, and of all such choices the one with the greatest sum of log odds is taken, from
the leaves up. So no kept node stands in a dropped one.

The trees are fitted on at most ``sample_pages`` pages, those with the least hashes.
In them the text in ``article`` or ``main`` is main text. To teach what those pages
lack, each is used again with menus, notices, adverts, forms, sidebars and comments
put into and around it, filled with paragraphs of other pages, and with its
article renamed, so that neither text nor one tag decides alone.

* Null and empty pages give the empty text, as do pages without main text.
* Text in the body that stands in no block is a node of its own, scored like any other.
  A head without end tag ends at the first text or element that can't stand in one.
* White space in a block becomes one space; blocks are joined by line feeds in page
  order; character references are decoded. Pages of any length are read whole.
* Repeated rows are extracted each; extra columns pass through.
"""

from __future__ import annotations

import html as html_module
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.boosting import BoostedTrees
from rosterlake.llm.columns import unused

SAMPLE_PAGES = 200
#: Nodes that are scored at once.
CHUNK_NODES = 20_000

# fixed values of HTML: elements by their role in parsing
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes xmp title textarea".split())
#: Anything else, and text, ends an open head.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
UNSEEN = frozenset("head button select datalist object svg math audio video canvas map".split())
CLOSED_BY = {
    "p": BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"},
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
}
SCOPES = frozenset("html body table td th article aside main nav header footer section div form ul ol dl blockquote".split())

#: Words in tags, classes, ids and roles, by what they tell.
TOKENS = {
    "main": "article main content post entry story body text page blog paragraph prose",
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs toc pagination pager tabs skip toolbar sitemap",
    "frame": "header footer masthead banner foot head top bottom copyright legal colophon contentinfo topbar site",
    "side": "aside sidebar side widget related complementary recommended recommend popular trending more rail teaser tags also",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted affiliate dfp commercial",
    "notice": "notice cookie cookies consent gdpr alert modal popup overlay dialog message warning privacy disclaimer toast",
    "reader": "comment comments reply replies respond discussion disqus reaction reactions feedback responses reader readers review reviews",
    "form": "form login signup subscribe subscription newsletter search contact register field input password signin",
    "share": "share sharing social follow twitter facebook button buttons print email bookmark like",
}
TOKEN_CLASS = {w: i for i, words in enumerate(TOKENS.values()) for w in words.split()}
TAG_CLASS = {t: i for i, t in enumerate("p h1 h2 h3 h4 div section article main ul ol li table td nav header footer aside form blockquote pre body figure".split())}

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>"
    r"|<[!?/][^>]*+>",
    re.DOTALL,
)
NAMES = re.compile(r"""\b(class|id|role|itemprop|aria-label|data-[\w-]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Page:
    tag: list[str] = field(default_factory=list)
    attrs: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    links: list[int] = field(default_factory=list)  # characters in links
    inline: list[int] = field(default_factory=list)  # inline elements
    own: list[int] = field(default_factory=list)  # characters
    marks: list[int] = field(default_factory=list)  # sentence marks
    blocks: list[tuple[int, str]] = field(default_factory=list)

    def add(self, tag: str, attrs: str, parent: int) -> int:
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        for counts in (self.links, self.inline, self.own, self.marks):
            counts.append(0)
        return len(self.tag) - 1


_ends: dict[str, re.Pattern] = {}


def _end_of(tag: str) -> re.Pattern:
    if tag not in _ends:
        _ends[tag] = re.compile(rf"</{tag}[^>]*>", re.IGNORECASE)
    return _ends[tag]


def parse(source: str | None) -> Page:
    """Block elements and blocks of text; unclosed and stray tags as browsers take them."""
    page = Page()
    root = page.add("html", "", -1)
    stack: list[tuple[str, int]] = [("html", root)]  # open elements; the node that text in them belongs to
    pieces: list[str] = []
    in_links = unseen = 0

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                node = stack[-1][1]
                if node == root:
                    # text in no block is a node of its own, with the links and inline elements in it
                    node = page.add("#text", "", root)
                    for counts in (page.links, page.inline):
                        counts[node], counts[root] = counts[root], 0
                page.blocks.append((node, text))
                page.own[node] += len(text)
                page.marks[node] += text.count(".") + text.count(",") + text.count(";")

    def close(place: int) -> None:
        nonlocal in_links, unseen
        if any(t in BLOCKS for t, _ in stack[place:]):
            flush()
        for t, _ in stack[place:]:
            in_links -= t == "a"
            unseen -= t in UNSEEN
        del stack[place:]

    text = source or ""
    at, size = 0, len(text)
    while at < size:
        found = MARKUP.search(text, at)
        stop = found.start() if found else size
        if stack[-1][0] == "head" and text[at:stop].strip():
            close(len(stack) - 1)
        if stop > at and not unseen:
            piece = html_module.unescape(text[at:stop])
            pieces.append(piece)
            if in_links > 0:
                page.links[stack[-1][1]] += len(piece.strip())
        if not found:
            break
        at = found.end()
        tag = found["tag"] or found["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if found["end"] or found["end2"]:
            for place in range(len(stack) - 1, 0, -1):
                if stack[place][0] == tag:
                    close(place)
                    break
                if tag not in BLOCKS and tag not in UNSEEN and stack[place][0] in SCOPES:
                    break
            continue
        attrs = found["attrs"] or found["attrs2"] or ""
        if stack[-1][0] == "head" and tag not in IN_HEAD:
            close(len(stack) - 1)
        if tag in RAW:
            end = _end_of(tag).search(text, at)
            at = end.end() if end else size
            continue
        if tag in ("html", "body"):
            if tag == "body":
                page.attrs[root] += attrs
            continue
        block = tag in BLOCKS
        if block:
            for place in range(len(stack) - 1, 0, -1):
                own = stack[place][0]
                if own in CLOSED_BY and tag in CLOSED_BY[own]:
                    close(place)
                    if own not in ("td", "th"):
                        break
                elif own in SCOPES and not (own in ("td", "th") and tag in CLOSED_BY[own]):
                    break
            flush()
        if tag in VOID:
            if tag in ("br", "hr", "wbr"):
                pieces.append(" " if tag != "wbr" else "")
            continue
        node = stack[-1][1]
        if block:
            node = page.add(tag, attrs, node)
        else:
            page.inline[node] += 1
            in_links += tag == "a"
            unseen += tag in UNSEEN
        if not attrs.rstrip().endswith("/") or block:
            stack.append((tag, node))
        else:
            in_links -= tag == "a"
            unseen -= tag in UNSEEN
    close(1)
    flush()
    return page


_known_tokens: dict[tuple[str, str], np.ndarray] = {}


def _token_flags(tag: str, attrs: str) -> np.ndarray:
    key = (tag, attrs)
    if key not in _known_tokens:
        if len(_known_tokens) > 50_000:
            _known_tokens.clear()
        flags = np.zeros(len(TOKENS))
        words = [tag]
        for _, value in NAMES.findall(attrs):
            words += [w.lower() for w in WORD.findall(value)]
        for w in words:
            if w in TOKEN_CLASS:
                flags[TOKEN_CLASS[w]] = 1
        _known_tokens[key] = flags
    return _known_tokens[key]


def features(page: Page) -> np.ndarray:
    """A row for each node of a page."""
    n, k = len(page.tag), len(TOKENS)
    parent = np.array(page.parent)
    own = np.stack([_token_flags(t, a) for t, a in zip(page.tag, page.attrs, strict=True)])
    counts = np.stack([page.own, page.links, page.inline, page.marks, np.ones(n)], axis=1).astype(float)
    subtree, around, inside = counts.copy(), own.copy(), own.copy()
    for i in range(n - 1, 0, -1):  # children come after their parents
        subtree[parent[i]] += subtree[i]
        inside[parent[i]] = np.maximum(inside[parent[i]], inside[i])
    around[0] = 0
    for i in range(1, n):
        around[i] = np.maximum(around[parent[i]], own[parent[i]])
    children = np.bincount(parent[1:], minlength=n) if n > 1 else np.zeros(n)
    siblings = np.where(parent >= 0, children[parent], 1)
    rank, seen, texts = np.zeros(n), np.zeros(n), np.zeros((n, 2))
    last: dict[int, int] = {}
    same: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        p = parent[i]
        rank[i] = seen[p]
        seen[p] += 1
        if p in last:
            texts[i, 0] = subtree[last[p], 0]
            texts[last[p], 1] = subtree[i, 0]
        last[p] = i
        same[p, page.tag[i]] = same.get((p, page.tag[i]), 0) + 1
    alike = np.array([same.get((p, t), 1) for p, t in zip(page.parent, page.tag, strict=True)]) / siblings
    size = subtree[:, 0]
    whole = max(size[0], 1)
    tag = np.array([TAG_CLASS.get(t, -1) for t in page.tag])
    columns = [
        np.log1p(size),
        size / whole,
        subtree[:, 1] / np.maximum(size, 1),  # link density
        subtree[:, 2] / np.maximum(size, 1),  # inline markup density
        subtree[:, 3] / np.maximum(size, 1),  # sentence marks
        size / subtree[:, 4],  # text for each node below
        np.log1p(subtree[:, 4]),
        np.log1p(counts[:, 0]),
        np.array(page.depth),
        siblings,
        rank / np.maximum(siblings, 1),
        alike,
        np.log1p(texts[:, 0]),
        np.log1p(texts[:, 1]),
        np.where(parent >= 0, size / np.maximum(size[parent], 1), 1),
        tag,
        np.where(parent >= 0, tag[parent], -1),
    ]
    return np.column_stack([*columns, own, around, inside])


def keep_nodes(page: Page, log_odds: np.ndarray) -> np.ndarray:
    """The kept nodes: the best set in which every kept node's parent is kept."""
    n = len(page.tag)
    gain = log_odds.copy()
    gain[0] = 0
    for i in range(n - 1, 0, -1):
        if gain[i] > 0:
            gain[page.parent[i]] += gain[i]
    kept = np.zeros(n, bool)
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[page.parent[i]] and gain[i] > 0
    return kept


# ---- training ---------------------------------------------------------------

#: Boilerplate that is put into training pages; {t} is text of other pages, {s} a few words of it.
INSERTS = (
    '<nav class="menu"><ul><li><a href="/a">{s}</a></li><li><a href="/b">{s}</a></li></ul></nav>',
    '<div id="breadcrumbs"><a href="/">{s}</a> <a href="/x">{s}</a></div>',
    '<ul class="navigation"><li><a href="/a">{s}</a><li><a href="/b">{s}</a></ul>',
    '<header><h2>{s}</h2><p>{s}</p></header>',
    '<div class="site-header"><a href="/">{s}</a></div>',
    '<header class="page-header"><h1>{s}</h1></header>',
    '<footer><p>{s}</p></footer>',
    '<div id="footer"><p>{t}</p><a href="/legal">{s}</a></div>',
    '<aside><h3>{s}</h3><p>{t}</p></aside>',
    '<div class="sidebar"><h3>{s}</h3><ul><li><a href="/a">{s}</a></li></ul><p>{t}</p></div>',
    '<section class="related-posts"><h4>{s}</h4><p>{t}</p></section>',
    '<div class="widget"><p>{t}</p></div>',
    '<div class="notice">{t}</div>',
    '<div class="cookie-banner"><p>{t}</p><button>{s}</button></div>',
    '<div role="alert"><p>{s}</p></div>',
    '<div id="consent" class="modal"><p>{t}</p></div>',
    '<div class="ad">{s}</div>',
    '<div class="advert"><p>{t}</p></div>',
    '<p class="sponsored">{t}</p>',
    '<div class="promo-box"><h3>{s}</h3><p>{t}</p></div>',
    '<form action="/q"><label>{s}</label><input name="q"><button>{s}</button></form>',
    '<form class="newsletter"><p>{t}</p><input type="email"></form>',
    '<div class="login"><p>{s}</p><form><input></form></div>',
    '<section id="comments"><h3>{s}</h3><div class="comment"><p>{t}</p></div><div class="comment"><p>{t}</p></div></section>',
    '<div class="comments"><article class="comment"><p>{t}</p></article><ol><li>{t}</li></ol></div>',
    '<ol class="comment-list"><li class="reply"><p>{t}</p></li><li><p>{t}</p></li></ol>',
    '<div class="reader-comments"><p>{t}</p><p>{t}</p></div>',
    "<footer>{s}</footer>",
    "<footer>&copy; {t}</footer>",
    "<header>{s}</header>",
    "<nav>{s}</nav>",
    "<aside>{t}</aside>",
    '<div class="footer">{t}</div>',
    '<section class="comments">{t}</section>',
    '<div class="sidebar">{t}</div>',
    '<div class="share-buttons"><a href="#">{s}</a><a href="#">{s}</a></div>',
)
#: The same as text in no block.
BARE_INSERTS = (
    '<hr><a href="/a">{s}</a> | <a href="/b">{s}</a> | <a href="/c">{s}</a><hr>',
    '<hr><a href="/a">{s}</a> <a href="/b">{s}</a><hr>',
    "<hr>&copy; {s}<hr>",
)
#: What holds the article in training pages.
HOLDERS = ("article", "main", 'div class="content"', 'div id="main-text"', 'section class="post-body"', "div", 'div class="entry"', 'article class="story"')
#: Stands around the numbers of main blocks in training pages: a private character.
MARK = chr(0xE000)
FILLER = "the text of page that says one thing after another and then some more of it all day long in many other words".split()
#: Articles made of filler words that training sees besides those of pages.
MADE_BODIES = 40


def training_page(body: list[str], others: list[str], rng: random.Random, plain: bool) -> tuple[str, set[str]]:
    """A page and the marks of its main blocks; each block of it starts with a mark."""

    def text(most: int) -> str:
        words = rng.choice(others).split() if others else FILLER
        return html_module.escape(" ".join(words[: rng.randint(1, most)]))

    def insert() -> str:
        return re.sub(r"\{([ts])\}", lambda m: text(120 if m[1] == "t" else 5), rng.choice(INSERTS))

    marks, blocks = set(), []
    for i, own in enumerate(body):
        mark = f"{MARK}{i}{MARK}"
        marks.add(mark)
        tag = "h1" if i == 0 else rng.choice(["p"] * 8 + ["h2", "li", "blockquote"])
        own = html_module.escape(own)
        blocks.append(f"<{tag}>{mark}{own}</{tag}>" if tag != "li" else f"<ul><li>{mark}{own}</li></ul>")
        if not plain and rng.random() < 0.12:
            blocks.append(insert())
    holder = "article" if plain else rng.choice(HOLDERS)
    main = f"<{holder}>{''.join(blocks)}</{holder.split()[0]}>"
    if not plain and rng.random() < 0.4:
        main = f"<div class='{rng.choice(['wrap', 'container', 'row', 'page', 'layout'])}'>{main}{insert()}</div>"
    before = [insert() for _ in range(rng.randint(1, 4))]
    after = [insert() for _ in range(rng.randint(1, 4))]
    return f"<html><body>{''.join(before)}{main}{''.join(after)}</body></html>", marks


def bare_page(body: list[str], others: list[str], rng: random.Random) -> str:
    """A page with its main blocks straight in the body, mostly as text in no block."""

    def text(most: int) -> str:
        return html_module.escape(" ".join(rng.choice(others).split()[: rng.randint(1, most)]))

    def insert() -> str:
        return re.sub(r"\{([ts])\}", lambda m: text(120 if m[1] == "t" else 5), rng.choice([*INSERTS, *BARE_INSERTS]))

    blocks = []
    for i, own in enumerate(body):
        own = f"{MARK}{i}{MARK}{html_module.escape(own)}"
        if rng.random() < 0.3:
            own = f"<b>{own}</b>"
        blocks.append(f"<p>{own}</p>" if rng.random() < 0.3 else f"{own}{rng.choice(['<br>', '<br><br>', '<hr>'])}")
    before = [insert() for _ in range(rng.randint(0, 2))]
    after = [insert() for _ in range(rng.randint(0, 2))]
    return f"<html><body>{''.join(before)}{''.join(blocks)}{''.join(after)}</body></html>"


def _made_body(rng: random.Random) -> list[str]:
    """A headline and paragraphs of a few to a hundred words, in sentences."""

    def sentence(n: int) -> str:
        words = rng.choices(FILLER, k=n)
        marks = [w + ("," if rng.random() < 0.1 else "") for w in words[:-1]]
        return " ".join([*marks, words[-1]]).capitalize() + "."

    blocks = [sentence(rng.randint(2, 9)).rstrip(".")]
    for _ in range(rng.randint(1, 10)):
        blocks.append(" ".join(sentence(rng.randint(3, 20)) for _ in range(rng.randint(1, 6))))
    return blocks


def train(pages: list[str], seed: int = 0, copies: int = 4) -> BoostedTrees:
    """Fit on pages with an ``article`` or ``main``, and on changed copies of them."""
    rng = random.Random(seed)
    bodies, rows, labels = [], [], []

    def learn(page: Page, main: set[int]) -> None:
        holds = np.zeros(len(page.tag))
        for i in main:
            while i >= 0 and not holds[i]:
                holds[i] = 1
                i = page.parent[i]
        rows.append(features(page)[1:])
        labels.append(holds[1:])

    for source in pages:
        page = parse(source)
        inside = [False] * len(page.tag)
        for i in range(1, len(page.tag)):
            own = _token_flags(page.tag[i], page.attrs[i])
            named = own[0] and page.tag[i] in ("article", "main")
            # a holder of another kind inside an article isn't main text
            inside[i] = (inside[page.parent[i]] or bool(named)) and (bool(named) or not own[1:].any())
        main = {node for node, _ in page.blocks if inside[node]}
        if main:
            learn(page, main)
            bodies.append([t for node, t in page.blocks if node in main])
    bodies += [_made_body(rng) for _ in range(MADE_BODIES)]
    for k in range(copies * len(bodies)):
        body = bodies[k % len(bodies)]
        others = [t for _ in range(4) for t in rng.choice(bodies)]
        source, _ = training_page(body, others, rng, plain=k % copies == 0)
        page = parse(source)
        learn(page, {node for node, t in page.blocks if MARK in t})
    for body in bodies:
        page = parse(bare_page(body, [t for _ in range(4) for t in rng.choice(bodies)], rng))
        learn(page, {node for node, t in page.blocks if MARK in t})
    return BoostedTrees().fit(np.concatenate(rows), np.concatenate(labels))


def sample(pages: DataFrame, html: str = "html", key: str = "url", most: int = SAMPLE_PAGES) -> list[str]:
    """At most ``most`` pages: those with the least hashes of their key."""
    pages = pages.where(F.col(html).isNotNull())
    # a few times the sample passes the hash, so few pages are sent anywhere
    share = 2 * most / max(1, pages.count()) + 1e-6
    rows = pages.select(F.xxhash64(key, html).alias("h"), F.col(html).alias("p"))
    some = rows.where(F.col("h") / F.lit(2.0**64) + 0.5 <= share)
    return [r["p"] for r in some.orderBy("h").limit(most).collect()]


def _text(page: Page, log_odds: np.ndarray) -> str:
    kept = keep_nodes(page, log_odds)
    return "\n".join(t for node, t in page.blocks if kept[node])


def extract(pages: DataFrame, model: BoostedTrees, html: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text of column ``html`` as column ``name``."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trees: BoostedTrees = shared.value
        for batch in batches:
            out: list[str] = []
            held: list[Page] = []
            nodes = 0

            def decide() -> None:
                if held:
                    odds = trees.log_odds(np.concatenate([features(p) for p in held]))
                    at = 0
                    for p in held:
                        out.append(_text(p, odds[at : at + len(p.tag)]))
                        at += len(p.tag)
                    held.clear()

            for source in batch:
                held.append(parse(source if isinstance(source, str) else ""))
                nodes += len(held[-1].tag)
                if nodes > CHUNK_NODES:
                    decide()
                    nodes = 0
            decide()
            yield pd.Series(out, dtype=object)

    target = name if name != html else unused(pages, "_main_text")
    done = pages.withColumn(target, extracted(F.col(html)))
    return done if target == name else done.drop(html).withColumnRenamed(target, name)
