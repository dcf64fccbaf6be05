"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of its block elements. Trees boosted on labelled nodes give each node the
probability that it holds or belongs to the article, from its own tag and attribute tokens, those
of its ancestors, text and link density of its subtree, depth and sibling statistics. Decoding is
hierarchical: of all labellings in which nothing below a dropped node is kept, it takes the most
probable, so that an ancestor and a descendant never contradict each other.

The model is trained here, on pages that a seeded generator writes with their labels; training
takes seconds, and the same pages give the same trees.

Text: character references decoded, white space inside a block turned into single spaces, blocks
in page order joined by single spaces. Scripts, styles, comments and the head are never text.

Odd cases: null and empty pages and those without an article give empty text; unclosed, crossed
and unfinished tags are repaired as browsers do in the common cases; equal rows give equal rows;
an empty table gives none; pages of any length are read whole; further columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import html as entities
import math
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import common

# Elements that stand inside a line, that hold nothing, and that hold no text of the page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style head noscript template svg math iframe object canvas textarea select button title audio video map".split())
RAW = frozenset("script style textarea title iframe noscript".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = frozenset("ul ol dl table article section div body html main aside nav footer header form blockquote".split())

def _tokens(attributes: str) -> re.Pattern:
    return re.compile(rf"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)({attributes})>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)|[^<]+|<""", re.S)


#: From the first tag on whose quotes would swallow all the rest, quotes end at < and > as well.
_TOKEN = _tokens(r"""(?:[^>"']|"[^"]*"|'[^']*')*+""")
_BROKEN = _tokens(r"""(?:[^<>"']|"[^"<>]*"|'[^'<>]*')*+""")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_LABEL = re.compile(r'data-keep="([01])"')
_PART = re.compile(r"[a-z]+|\d+")
_END = {t: re.compile(rf"</{t}\s*>|\Z", re.I) for t in RAW}

# What attribute tokens tell.
HINTS = (
    frozenset("article content main post body entry story text prose page blog news copy read".split()),
    frozenset("ad ads advert advertisement adverts adsense banner sponsor sponsored promo promoted promotion commercial dfp".split()),
    frozenset("nav navbar navigation menu menus breadcrumb breadcrumbs tabs toolbar pager pagination toc skip".split()),
    frozenset("header masthead topbar top site brand logo head branding".split()),
    frozenset("footer foot bottom copyright legal colophon imprint credits".split()),
    frozenset("sidebar side aside related widget widgets recommended recommendations more trending popular rail also teaser teasers".split()),
    frozenset("comment comments reply replies respond discussion disqus feedback responses commentlist".split()),
    frozenset("notice cookie cookies consent alert popup modal overlay gdpr privacy warning message disclaimer paywall".split()),
    frozenset("form search login signup signin subscribe subscription newsletter share sharing social follow contact register button buttons tags".split()),
)
TAGS = ("article main", "section", "div", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "nav", "header", "footer", "aside", "form fieldset", "table thead tbody tr td th", "blockquote pre", "figure figcaption")
_TAG = {t: i for i, names in enumerate(TAGS) for t in names.split()}
_KINDS = len(TAGS) + len(HINTS)
_ABOVE = [_TAG[t] for t in ("article", "nav", "header", "footer", "aside", "form", "li")]


class Node:
    __slots__ = ("tag", "parent", "depth", "kinds", "above", "keep", "kids", "order", "chars", "links", "words", "stops", "tags", "caps", "digits", "begin", "signs")

    def __init__(self, tag, parent, kinds, keep, begin):
        self.tag, self.parent, self.kinds, self.keep, self.begin = tag, parent, kinds, keep, begin
        self.depth = parent.depth + 1 if parent else 0
        self.above = parent.above | parent.kinds if parent else 0
        self.kids, self.order = [], len(parent.kids) if parent else 0
        self.chars = self.links = self.words = self.stops = self.caps = self.digits = self.signs = 0
        self.tags = 1
        if parent:
            parent.kids.append(self)


@functools.lru_cache(maxsize=50_000)
def _kinds(tag: str, attributes: str) -> int:
    """Bits for the tag and the hints of its attributes."""
    bits = 1 << _TAG[tag] if tag in _TAG else 0
    if "=" in attributes:
        for values in _NAMES.findall(attributes):
            value = next((v for v in values if v), "")
            for part in _PART.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()):
                for k, hints in enumerate(HINTS):
                    if part in hints:
                        bits |= 1 << len(TAGS) + k
    return bits


class Open:
    """The open elements, the root first, and where on the stack those of each tag are."""

    def __init__(self, root: Node):
        self.stack, self.at, self.scopes = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(node)

    def cut(self, n: int) -> list[Node]:
        """Take the elements from n on off the stack."""
        gone = self.stack[n:]
        del self.stack[n:]
        for node in gone:
            self.at[node.tag].pop()
            if node.tag in SCOPE:
                self.scopes.pop()
        return gone

    def last(self, tag: str) -> int:
        """Where the innermost element of a tag is; 0 for none."""
        own = self.at.get(tag)
        return own[-1] if own else 0

    def within(self, tags) -> int:
        """Where the outermost element of these tags inside the innermost scope is; 0 for none."""
        scope, first = self.scopes[-1], 0
        for tag in tags:
            own = self.at.get(tag)
            if own and own[-1] > scope:
                here = own[bisect.bisect(own, scope)]
                first = min(first or here, here)
        return first


def parse(page: str, labelled: bool = False) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes in page order, the root first, and the blocks of text with their nodes' numbers.
    Nodes carry labels only where the page is one that Pages wrote."""
    root = Node("html", None, 0, None, 0)
    nodes, numbers, opened = [root], {id(root): 0}, Open(root)
    stack = opened.stack
    blocks: list[tuple[int, str]] = []
    held: list[str] = []
    at, size, silent, link, total, token = 0, len(page), 0, False, 0, _TOKEN

    def flush():
        nonlocal held
        if held:
            text = " ".join("".join(held).split())
            held = []
            if text:
                blocks.append((numbers[id(stack[-1])], text))

    def close(n):
        nonlocal silent, link
        flush()
        link = False
        for node in opened.cut(n):
            silent -= node.tag in SILENT

    while at < size:
        m = token.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if m[5]:
            token = _BROKEN
        if tag is None:
            piece = m[0]
            if piece[0] == "<" and len(piece) > 1:
                continue
            if silent:
                continue
            text = entities.unescape(piece) if "&" in piece else piece
            held.append(text)
            bare = text.strip()
            if bare:
                node, n = stack[-1], len(bare)
                node.chars += n
                total += n
                node.words += bare.count(" ") + 1
                node.stops += bare.count(".") + bare.count(",")
                node.caps += bare[0].isupper()
                node.digits += any(map(bare.__contains__, "0123456789"))
                node.signs += "©" in bare or "|" in bare
                if link:
                    node.links += n
            continue
        tag, ends = tag.lower(), m[1] or m[4]
        if ends:
            if tag == "a":
                link = False
            if tag not in INLINE:
                n = opened.last(tag)
                if n:
                    close(n)
                elif tag == "br":
                    held.append(" ")
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in INLINE:
            stack[-1].tags += 1
            link = link or tag == "a"
            if tag == "a":
                link = True
            continue
        if tag in CLOSES_P and opened.last("p") > opened.scopes[-1]:
            close(opened.last("p"))
        if tag in CLOSES and (n := opened.within(CLOSES[tag])):
            close(n)
        if tag == "body" and silent:  # a head that nobody closed
            close(next(k for k in range(len(stack)) if stack[k].tag in SILENT))
        flush()
        if tag in VOID:
            stack[-1].tags += 1
            continue
        attributes = m[3] if m[2] else m[6]
        if tag in RAW:
            at = _END[tag].search(page, at).end()
            continue
        if tag in SILENT and attributes.endswith("/"):
            continue
        label = _LABEL.search(attributes) if labelled else None
        node = Node(tag, stack[-1], _kinds(tag, attributes), int(label[1]) if label else None, total)
        numbers[id(node)] = len(nodes)
        nodes.append(node)
        opened.push(node)
        silent += tag in SILENT
    flush()
    return nodes, blocks


N_FEATURES = _KINDS + len(HINTS) + len(_ABOVE) + 17


def features(nodes: list[Node]) -> np.ndarray:
    """One row for each node; sums over subtrees are made here, from the leaves up."""
    own = [(n.chars, n.words) for n in nodes]
    for n in reversed(nodes):
        p = n.parent
        if p is not None:
            p.chars += n.chars
            p.links += n.links
            p.words += n.words
            p.stops += n.stops
            p.tags += n.tags
            p.caps += n.caps
            p.digits += n.digits
            p.signs += n.signs
    total = max(nodes[0].chars, 1)
    bits, above, numbers = [], [], []
    for n, (chars, words) in zip(nodes, own):
        p = n.parent
        siblings = p.kids if p else (n,)
        before = siblings[n.order - 1] if n.order else None
        after = siblings[n.order + 1] if n.order + 1 < len(siblings) else None
        bits.append(n.kinds)
        above.append(n.above)
        numbers.append((
            n.depth, len(siblings), n.order / len(siblings), len(n.kids), n.chars, chars, n.links / (n.chars + 1), n.chars / n.tags,
            n.stops / (n.words + 1), n.chars / total, n.begin / total, n.chars / (n.words + 1), n.signs,
            before.chars if before else -1, after.chars if after else -1, (n.parent.links / (n.parent.chars + 1)) if p else 0, n.caps / (n.tags + 1)))
    b, a = np.array(bits, np.int64)[:, None], np.array(above, np.int64)[:, None]
    return np.hstack([
        b >> np.arange(_KINDS) & 1, a >> (len(TAGS) + np.arange(len(HINTS))) & 1, a >> np.array(_ABOVE) & 1, np.array(numbers, np.float64)]).astype(np.float32)


class Boosted:
    """Gradient-boosted trees for a yes-or-no label, over binned features."""

    BINS = 32

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 70, depth: int = 5, rate: float = 0.2, least: int = 8, ridge: float = 1.0):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.BINS + 1)[1:-1])) for c in x.T.astype(np.float64)]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T.astype(np.float64))], 1)
        share = y.mean()
        self.start = math.log(share / (1 - share))
        self.depth, self.feature, self.cut, self.value = depth, [], [], []
        score = np.full(len(y), self.start)
        columns = np.arange(x.shape[1]) * self.BINS
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
            for level in range(depth):
                n, first = 1 << level, (1 << level) - 1
                at = ((node - first)[:, None] * x.shape[1] * self.BINS + columns + binned).ravel()
                shape = (n, x.shape[1], self.BINS)
                width = n * x.shape[1] * self.BINS
                left_g, left_h, left_n = (np.bincount(at, None if v is None else np.repeat(v, x.shape[1]), width).reshape(shape).cumsum(2) for v in (g, h, None))
                all_g, all_h, all_n = left_g[:, :1, -1:], left_h[:, :1, -1:], left_n[:, :1, -1:]
                gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
                gain[(left_n < least) | (all_n - left_n < least)] = 0
                best = gain.reshape(n, -1).argmax(1)
                for k, b in enumerate(best):
                    f, c = divmod(int(b), self.BINS)
                    if gain[k, f, c] > 1e-6 and c < len(self.cuts[f]):
                        feature[first + k], cut[first + k] = f, self.cuts[f][c]
                right = x[np.arange(len(x)), feature[node]] > cut[node]
                node = 2 * node + 1 + right
            leaf = node - ((1 << depth) - 1)
            value = rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + ridge)
            score += value[leaf]
            self.feature.append(feature)
            self.cut.append(cut.astype(np.float32))
            self.value.append(value)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            score += value[node - ((1 << self.depth) - 1)]
        return score


class Pages:
    """Writes pages with the label of every node in data-keep."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        r = self.r
        return "".join(r.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "io", "é", "ou", "le", "ch", "ü", "ar", "la", "de", "st", "ung", "ción", "que")) for _ in range(r.choice((1, 1, 2, 2, 3, 4))))

    def words(self, lo: int, hi: int) -> str:
        junk = self.r.random() < 0.05
        w = [self.word() + (self.r.choice(("***", "###", "$$$", "&amp;&amp;&amp;", "%%%")) if junk else "") for _ in range(self.r.randint(lo, hi))]
        return " ".join(w)

    def sentences(self, lo: int, hi: int) -> str:
        return " ".join(self.words(2, 18).capitalize().replace(" ", ", ", self.r.random() < 0.3) + self.r.choice((".", ".", ".", "!", "?")) for _ in range(self.r.randint(lo, hi)))

    def tag(self, name: str, inner: str, keep: int, names: str = "", close: bool = True) -> str:
        r = self.r
        style = ""
        if names:
            hint = r.choice(names.split())
            if r.random() < 0.4:
                hint += r.choice(("-", "_")) + r.choice(("box", "wrap", "inner", "area", "block", "1", "container", "list"))
            style = f' {r.choice(("class", "class", "id"))}="{hint}"'
        return f'<{name}{style} data-keep="{keep}">{inner}' + (f"</{name}>" if close else "")

    def links(self, lo: int, hi: int, item: str = "li") -> str:
        return "".join(self.tag(item, f'<a href="/{i}">{self.words(1, 3)}</a>', 0) if item else f'<a href="/{i}">{self.words(1, 2)}</a> ' for i in range(self.r.randint(lo, hi)))

    def named(self, plain: str, hints: str, inner: str) -> str:
        """A dropped part, by a telling element, a div with a telling name, or both."""
        k = self.r.random()
        if plain and k < 0.4:
            return self.tag(plain, inner, 0)
        if plain and k < 0.6:
            return self.tag(plain, inner, 0, hints)
        return self.tag(self.r.choice(("div", "div", "section")), inner, 0, hints)

    def rubbish(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            inner = self.tag(r.choice(("ul", "ol")), self.links(2, 9), 0) if r.random() < 0.7 else self.links(2, 9, "")
            return self.named("nav", "nav navbar menu breadcrumb navigation", inner)
        if kind == "header":
            inner = self.tag(r.choice(("div", "p", "h1", "h2")), self.words(1, 5), 0) + (self.rubbish("nav") if r.random() < 0.4 else "")
            return self.named("header", "header masthead topbar branding", inner)
        if kind == "footer":
            inner = r.choice(("&copy; ", "Copyright ", "")) + self.words(1, 4) + r.choice((" &middot; ", " | ", ". ")) + self.sentences(0, 2)
            if r.random() < 0.5:
                inner = self.tag("p", inner, 0)
            if r.random() < 0.3:
                inner += self.tag("ul", self.links(2, 5), 0)
            return self.named("footer", "footer copyright legal bottom", inner)
        if kind == "ad":
            inner = self.sentences(1, 3)
            inner = self.tag("p", inner, 0) if r.random() < 0.5 else inner
            return self.named("", "ad ads advert banner sponsored promo advertisement", inner)
        if kind == "notice":
            inner = self.sentences(1, 3)
            inner = self.tag("p", inner, 0) if r.random() < 0.6 else inner
            return self.named("", "cookie notice consent alert popup gdpr disclaimer", inner)
        if kind == "side":
            inner = self.tag(r.choice(("h2", "h3", "h4")), self.words(1, 4), 0) + (self.tag("ul", self.links(2, 7), 0) if r.random() < 0.6 else "".join(self.tag("p", self.sentences(1, 3), 0) for _ in range(r.randint(1, 4))))
            return self.named("aside", "sidebar related widget recommended rail trending", inner)
        if kind == "form":
            inner = self.tag("p", self.words(2, 9), 0) + '<input type="text"><button>Ok</button>' if r.random() < 0.7 else f"<label>{self.words(1, 6)}</label><input>"
            return self.named("form", "search subscribe newsletter login signup", inner)
        if kind == "share":
            return self.named("", "share social tags follow", self.links(2, 6, r.choice(("", "li"))))
        one = lambda: self.tag(r.choice(("div", "li", "article")), self.tag("p", self.sentences(1, 4), 0) if r.random() < 0.7 else self.sentences(1, 3), 0, "comment reply")
        inner = (self.tag("h3", self.words(1, 3), 0) if r.random() < 0.6 else "") + "".join(one() for _ in range(r.randint(1, 7)))
        return self.named("", "comments discussion responses replies", inner)

    def article(self) -> str:
        r, parts = self.r, []
        if r.random() < 0.1:  # a very short one
            return self.tag(r.choice(("article", "main")), self.tag("p", self.words(1, 8), 1), 1, r.choice(("", "article content post")))
        loose = r.random() < 0.25
        if r.random() < 0.85:
            title = self.tag(r.choice(("h1", "h1", "h2")), self.words(2, 12), 1)
            parts.append(self.tag("header", title, 1) if r.random() < 0.1 else title)
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14))):
            k = r.random()
            if k < 0.72:
                text = self.sentences(1, r.choice((1, 3, 7, 15)))
                if r.random() < 0.15:
                    text = f"<b>{text}<br>"
                if r.random() < 0.2:
                    text += f' <a href="/x">{self.words(1, 4)}</a> {self.words(1, 6)}.'
                parts.append(self.tag("p", text, 1, close=not loose and not text.endswith("<br>")))
            elif k < 0.8:
                parts.append(self.tag(r.choice(("h2", "h3")), self.words(1, 7), 1))
            elif k < 0.86:
                parts.append(self.tag(r.choice(("ul", "ol")), "".join(self.tag("li", self.sentences(1, 2) if r.random() < 0.7 else self.words(1, 5), 1) for _ in range(r.randint(2, 6))), 1))
            elif k < 0.9:
                parts.append(self.tag("blockquote", self.tag("p", self.sentences(1, 3), 1), 1))
            elif k < 0.93:
                parts.append(self.tag("table", "".join(self.tag("tr", "".join(self.tag("td", self.words(1, 3), 1) for _ in range(3)), 1) for _ in range(r.randint(1, 5))), 1))
            elif k < 0.96:
                parts.append(self.tag("div", self.sentences(1, 6), 1))
            else:
                parts.append(self.rubbish(r.choice(("ad", "share", "side", "form", "notice"))))
        inner = "".join(parts)
        for _ in range(r.choice((0, 0, 0, 1, 2))):
            inner = self.tag(r.choice(("div", "section")), inner, 1, r.choice(("", "content body text post entry story")))
        k = r.random()
        if k < 0.5:
            return self.tag("article", inner, 1, r.choice(("", "", "article post entry")))
        if k < 0.65:
            return self.tag("main", inner, 1, r.choice(("", "main content")))
        return self.tag(r.choice(("div", "div", "section")), inner, 1, r.choice(("article content main post story entry", "content body text", "")))

    def page(self) -> str:
        r = self.r
        if r.random() < 0.04:  # nothing but an article
            return f'<body data-keep="1">{self.article()}</body>'
        before = [self.rubbish(k) for k in ("header", "nav", "ad", "notice", "side", "form") if r.random() < {"header": 0.5, "nav": 0.8, "ad": 0.45}.get(k, 0.2)]
        after = [self.rubbish(k) for k in ("share", "comments", "side", "ad", "form", "nav", "notice", "footer") if r.random() < {"footer": 0.85, "comments": 0.4, "side": 0.35}.get(k, 0.2)]
        if r.random() < 0.3:
            r.shuffle(before)
        main = self.article()
        if r.random() < 0.35:
            main = self.tag("div", (self.rubbish("side") if r.random() < 0.4 else "") + main + (after.pop(0) if after and r.random() < 0.5 else ""), 1, r.choice(("", "container wrapper page row")))
        if r.random() < 0.03:
            main = ""
        return f'<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{}}</style></head><body data-keep="1">{"".join(before)}{main}{"".join(after)}</body></html>'


@functools.lru_cache(maxsize=2)
def trained(pages: int = 900, seed: int = 5) -> Boosted:
    """The model, from as many generated pages."""
    writer, x, y = Pages(seed), [], []
    for _ in range(pages):
        nodes, _ = parse(writer.page(), True)
        rows = features(nodes)
        known = [i for i, n in enumerate(nodes) if n.keep is not None and n.chars]
        x.append(rows[known])
        y.append(np.array([nodes[i].keep for i in known], np.float64))
    return Boosted(np.vstack(x), np.concatenate(y))


def decode(nodes: list[Node], odds: list[float]) -> list[bool]:
    """Which nodes are kept: the most probable labelling that keeps nothing below a dropped node."""
    n = len(nodes)
    keep, drop, gain = [0.0] * n, [0.0] * n, [0.0] * n
    number = {id(x): i for i, x in enumerate(nodes)}
    for i in range(n - 1, -1, -1):
        node, z = nodes[i], odds[i]
        if node.chars:
            keep[i] -= math.log1p(math.exp(-z)) if z > -30 else -z
            drop[i] -= math.log1p(math.exp(z)) if z < 30 else z
        keep[i] += gain[i]
        if node.parent is not None:
            p = number[id(node.parent)]
            gain[p] += max(keep[i], drop[i])
            drop[p] += drop[i]
    kept = [True] * n
    for i in range(1, n):
        node = nodes[i]
        kept[i] = kept[number[id(node.parent)]] and (keep[i] >= drop[i] or node.tag in ("html", "body"))
    return kept


def extract(pages: list[str | None], model: Boosted) -> list[str]:
    """Main texts of pages."""
    parsed = [parse(p or "") for p in pages]
    if not parsed:
        return []
    rows = [features(nodes) for nodes, _ in parsed]
    odds = model.log_odds(np.vstack(rows)).tolist()
    out, at = [], 0
    for (nodes, blocks), own in zip(parsed, rows):
        kept = decode(nodes, odds[at : at + len(own)])
        at += len(own)
        out.append(" ".join(text for i, text in blocks if kept[i]))
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text of each row of pages."""
    common.small_batches(pages.sparkSession)
    model = trained()

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 200):
                part = pdf.iloc[at : at + 200]
                yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": extract(part["html"].tolist(), model)})

    found = common.id_text(pages, "page_id", "url", "html").mapInPandas(run, "page_id string, url string, text string")
    return common.id_back(found, pages, "page_id")
