"""Main text of web pages by a tree-structured graphical model over their DOM nodes."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from dataclasses import dataclass
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import bounded_batches, chunked, utf8_rows

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg iframe object textarea select title head math canvas audio video".split())
RAW = frozenset("script style textarea title noscript iframe".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr button".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
# What a start tag ends: open elements of the first set, unless one of the second is nearer.
_LIST, _TABLE = frozenset({"ul", "ol", "menu"}), frozenset({"table"})
ENDS = {
    "li": (frozenset({"li"}), _LIST), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})), "tr": (frozenset({"tr", "td", "th"}), _TABLE),
    "td": (frozenset({"td", "th"}), _TABLE | {"tr"}), "th": (frozenset({"td", "th"}), _TABLE | {"tr"}), "option": (frozenset({"option"}), frozenset({"select"})),
} | {tag: (frozenset({"p"}), (CLOSES_P - {"p"}) | {"td", "th", "table", "button"}) for tag in CLOSES_P}
# Elements that end an unclosed one: drawings and choices hold no blocks.
BLOCKLESS = ("svg", "math", "select")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)|[^<]+|<", re.S)
_MARK = re.compile("[\"'>]")
#: Quoted values of a tag; one with more, or with a quote that isn't closed, ends at its first ">".
MOST_QUOTED = 400
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[a-z]+|[^a-z\W]+")


def signature(tag: str, attributes: str) -> tuple[str, ...]:
    """The features of an element alone: its name, the words of its class, id and role, and the three-letter parts of
    these, which words that no labelled page has may share."""
    found = [f"tag={tag}"]
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        name = name.lower()
        if name == "style":
            found += ["hidden"] if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) else []
        elif name in ("hidden", "aria-hidden"):
            found += ["hidden"] if "false" not in value else []
        else:
            words = _NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower())
            found += [f"name={w}" for w in words] + [f"part={w[i : i + 3]}" for w in words for i in range(len(w) - 2) if len(w) > 3]
    return tuple(dict.fromkeys(found))


class TagEnds:
    """Where the tags of a page end: at the first ">" outside quotes. Quotes and ends are listed once, each with the next of its kind, so that a
    tag costs as many steps as it has quoted values, MOST_QUOTED at most."""

    def __init__(self, page: str):
        self.at: list[int] = []
        self.kind: list[str] = []
        for m in _MARK.finditer(page):
            self.at.append(m.start())
            self.kind.append(m[0])
        self.same = [-1] * len(self.at)  # the next mark of the same kind
        self.end = [-1] * len(self.at)  # the first end from here
        seen = {'"': -1, "'": -1, ">": -1}
        for i in range(len(self.at) - 1, -1, -1):
            kind = self.kind[i]
            self.same[i], seen[kind] = seen[kind], i
            self.end[i] = seen[">"]

    def after(self, place: int) -> int:
        """The place of the ">" that ends a tag whose name ends at this place, -1 if there is none."""
        first = i = bisect_left(self.at, place)
        for _ in range(MOST_QUOTED):
            if not 0 <= i < len(self.at):
                break
            if self.kind[i] == ">":
                return self.at[i]
            i = self.same[i] + 1 if self.same[i] >= 0 else -1
        return self.at[self.end[first]] if first < len(self.at) and self.end[first] >= 0 else -1


@dataclass
class Dom:
    """Nodes in page order, so that what is inside a node are those from it to `last`. A text node has its text and the
    number of its words; block is the number of the block a text stands in."""

    parent: list[int]
    depth: list[int]
    features: list[tuple[str, ...]]
    text: list[str | None]
    linked: list[bool]
    block: list[int]
    last: list[int]
    words: list[int]

    @classmethod
    def empty(cls) -> Dom:
        return cls([-1], [0], [("tag=#root",)], [None], [False], [0], [0], [0])

    def add(self, parent: int, depth: int, features: tuple[str, ...], text: str | None, linked: bool, block: int) -> int:
        node = len(self.parent)
        self.parent.append(parent)
        self.depth.append(depth)
        self.features.append(features)
        self.text.append(text)
        self.linked.append(linked)
        self.block.append(block)
        self.last.append(node)
        self.words.append(len(text.split()) if text else 0)
        return node


def parse(page: str, signatures: dict | None = None) -> Dom:
    """A forgiving parse in linear time: missing end tags are implied (of a head by what stands in no head, of a drawing or a
    choice by a block), stray ones ignored, cut tags and comments end with the page."""
    known = {} if signatures is None else signatures
    dom = Dom.empty()
    stack: list[tuple[str, int]] = [("#root", 0)]
    opened: dict[str, list[int]] = {}  # where in the stack the elements of a name are
    silent, links, block, at = 0, 0, 0, 0

    def close(depth: int) -> None:
        """End the elements from this place of the stack up."""
        nonlocal silent, links
        while len(stack) > depth:
            name, node = stack.pop()
            opened[name].pop()
            dom.last[node] = len(dom.parent) - 1
            silent -= name in SILENT
            links -= name == "a"

    def nearest(names) -> int:
        return max((opened[n][-1] for n in names if opened.get(n)), default=-1)

    ends = TagEnds(page)
    while m := _TOKEN.match(page, at):
        at = m.end()
        token = m[0]
        tag = m[2]
        if tag is None:
            if token[0] == "<" and len(token) > 1:
                continue
            if silent and stack[-1][0] == "head" and not token.isspace():
                close(len(stack) - 1)
            if not silent:
                dom.add(stack[-1][1], len(stack), ("tag=#text",), entities.unescape(token) if "&" in token else token, links > 0, block)
            continue
        begin, end = at, ends.after(at)
        if end < 0:
            break  # a tag cut at the end of the page
        at = end + 1
        tag = tag.lower()
        if tag not in INLINE:
            block += 1
        if m[1]:
            if opened.get(tag):
                close(opened[tag][-1])
            continue
        attributes = page[begin:end]
        if silent:
            if stack[-1][0] == "head" and tag not in IN_HEAD:
                close(len(stack) - 1)
            elif tag in CLOSES_P or tag == "body":
                inside = nearest(BLOCKLESS)
                if inside >= 0 and not opened.get("foreignobject"):
                    close(inside)
        if tag in ENDS:
            ended, fence = ENDS[tag]
            while (i := nearest(ended)) >= 0 and i > nearest(fence):
                close(i)
        if tag in VOID or attributes.endswith("/") and tag in SILENT:
            continue
        key = (tag, attributes)
        features = known.get(key)
        if features is None:
            known[key] = features = signature(tag, attributes)
        node = dom.add(stack[-1][1], len(stack), features, None, False, block)
        opened.setdefault(tag, []).append(len(stack))
        stack.append((tag, node))
        silent += tag in SILENT
        links += tag == "a"
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else len(page)
    close(1)
    dom.last[0] = len(dom.parent) - 1
    return dom


# What notices, forms, adverts and comments say, in the languages of the pages.
CUES = (
    "cookie", "privacy|datenschutz|confidentialité|privacidad", "subscri|newsletter|sign up|abonn|suscr", "advert|sponsor|promoted|anzeige|werbung|publicité|publicidad|patrocin",
    "©|copyright|all rights reserved|impressum|mentions légales|aviso legal", "log in|login|sign in|anmelden|connexion|iniciar sesión|password|your name|your email", "share|tweet|facebook|twitter|whatsapp|teilen|partager|compartir",
    "comment|repl(?:y|ies)|kommentar|antworten|répondre|comentario|responder", "read more|related|recommended|trending|most read|also like|weiterlesen|mehr lesen|lire aussi|leer más",
)
_CUES = re.compile("|".join(f"({c})" for c in CUES))
_SIZES, _SHARES = np.array([1, 4, 10, 25, 60, 150, 500]), np.array([0.02, 0.2, 0.5, 0.8])
_SENTENCE_ENDS = tuple(".!?…\"”»")
#: Families of features that say what is inside a node, and how many values each has.
STRUCTURE = {"words": 8, "of_page": 5, "linked": 5, "long": 5, "blocks": 4, "heading": 2, **{f"cue{i}": 2 for i in range(len(CUES))}}


def structure(dom: Dom) -> np.ndarray:
    """[node][family]: the number of words inside, their share of the page's, the shares of words in links and of texts of
    ten words or more, the number of paragraphs and items, a heading, and which cues few words hold."""
    n = len(dom.parent)
    own = np.zeros((6 + len(CUES), n), dtype=np.int64)
    own[0] = dom.words
    own[1] = own[0] * np.array(dom.linked)
    own[2], own[3] = own[0] > 0, own[0] >= 10
    own[4] = [f[0] in ("tag=p", "tag=li") for f in dom.features]
    own[5] = [f[0] in ("tag=h1", "tag=h2") for f in dom.features]
    for i in np.flatnonzero((own[0] > 0) & (own[0] <= 40)).tolist():
        for m in _CUES.finditer(dom.text[i].lower()):
            own[5 + m.lastindex, i] = 1
    upto = np.zeros((len(own), n + 1), dtype=np.int64)
    np.cumsum(own, axis=1, out=upto[:, 1:])
    inside = upto[:, np.array(dom.last) + 1] - upto[:, :n]
    words = np.maximum(inside[0], 1)
    families = [
        np.searchsorted(_SIZES, inside[0], side="right"), np.searchsorted(_SHARES, inside[0] / words[0], side="right"), np.searchsorted(_SHARES, inside[1] / words, side="right"),
        np.searchsorted(_SHARES, inside[3] / np.maximum(inside[2], 1), side="right"), np.minimum(inside[4], 3), np.minimum(inside[5], 1), *((inside[6:] > 0) & (inside[0] <= 80)),
    ]
    return np.stack(families, axis=1).astype(np.int64)


def _evidence(text: str, linked: bool, n: int) -> int:
    """Which of a few kinds of text a node holds: by number of words, end of a sentence and link."""
    size = 0 if n == 0 else 1 if n <= 2 else 2 if n <= 6 else 3 if n <= 15 else 4
    return size * 4 + 2 * (text.rstrip()[-1:] in _SENTENCE_ENDS) + linked if n else 0


NEUTRAL, CONTENT, BOILERPLATE = 0, 1, 2


@dataclass
class Model:
    """Log potentials: of a child's label given its parent's by the child's features, and of a text by its kind."""

    index: dict[str, int]
    weights: np.ndarray  # [parent's label][own label][feature], the last one the bias
    kinds: np.ndarray  # [label][kind]
    root: np.ndarray  # [label]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def potentials(model: Model, features: list[tuple[str, ...]], inside: np.ndarray) -> np.ndarray:
    """[node][parent's label][own label]: log probability of a child's label. A text is never neutral."""
    known: dict[tuple[str, ...], int] = {}
    which = np.array([known.setdefault(f, len(known)) for f in features])
    z = np.stack([model.weights[:, :, [model.index[f] for f in fs if f in model.index]].sum(axis=2) + model.weights[:, :, -1] for fs in known])[which]
    for k, (family, values) in enumerate(STRUCTURE.items()):
        at = [model.index.get(f"{family}={v}", -2) for v in range(values)]
        each = np.stack([model.weights[:, :, i] if i >= 0 else np.zeros((3, 3)) for i in at])
        z += each[inside[:, k]]
    z[np.array([fs == ("tag=#text",) for fs in known])[which], :, NEUTRAL] -= 20
    return z - _log_sum(z, 2)[:, :, None]


def marginals(model: Model, parent: np.ndarray, depth: np.ndarray, pair: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """[node][label]: probabilities by sum-product messages up to the roots and down again.

    Many pages may be given at once: a root has parent -1. pair: [node][parent's label][own label]; kind: -1 without text.
    """
    up = np.where(kind[:, None] >= 0, model.kinds[:, np.maximum(kind, 0)].T, 0.0)
    message = np.zeros_like(up)
    order = np.argsort(depth, kind="stable")
    steps = np.searchsorted(depth[order], np.arange(depth.max() + 2))
    levels = [order[a:b] for a, b in zip(steps, steps[1:], strict=False)]
    for level in reversed(levels[1:]):
        message[level] = _log_sum(pair[level] + up[level, None, :], 2)
        np.add.at(up, parent[level], message[level])
    down = np.zeros_like(up)
    down[levels[0]] = np.log(model.root)
    for level in levels[1:]:
        above = down[parent[level]] + up[parent[level]] - message[level]
        above -= above.max(axis=1, keepdims=True)
        down[level] = _log_sum(above[:, :, None] + pair[level], 1)
    both = down + up
    return np.exp(both - _log_sum(both, 1)[:, None])


def extract(model: Model, pages: list[str], threshold: float = 0.5) -> list[str]:
    """The main text of each page."""
    signatures: dict = {}
    doms = [parse(p, signatures) for p in pages]
    sizes = [len(d.parent) for d in doms]
    base = np.repeat(np.cumsum(sizes) - sizes, sizes)
    parent = np.concatenate([d.parent for d in doms])
    parent = np.where(parent >= 0, parent + base, -1)
    pair = potentials(model, [f for d in doms for f in d.features], np.concatenate([structure(d) for d in doms]))
    kind = np.array([-1 if t is None else _evidence(t, k, n) for d in doms for t, k, n in zip(d.text, d.linked, d.words, strict=True)])
    keep = (marginals(model, parent, np.concatenate([d.depth for d in doms]), pair, kind)[:, CONTENT] >= threshold).tolist()
    out, at = [], 0
    for dom, size in zip(doms, sizes, strict=True):
        parts, last = [], None
        for text, block, kept in zip(dom.text, dom.block, keep[at : at + size], strict=True):
            if text is not None and kept:
                if block != last:
                    parts.append(" ")
                parts.append(text)
                last = block
        out.append(" ".join("".join(parts).split()))
        at += size
    return out


# What the labelled pages are put together from. Each part has its opening and closing tags and whether
# the text between is content.
CONTAINERS = ("article", "main", 'div class="content"', 'div id="main-content"', 'div class="post-content"', 'div class="entry"', 'section class="story"', 'div class="article-body"', 'div class="story-text"', 'div itemprop="articleBody"', 'div role="main"', 'div class="post"', "div", "div", "div", "section")
BOILER_PARTS = (
    "nav", "header", "footer", "aside", "form", 'div class="menu"', 'ul class="nav-menu"', 'div class="navbar"', 'div class="breadcrumb"', 'div id="header"', 'div class="site-header"',
    'div class="masthead"', 'div id="footer"', 'div class="site-footer"', 'div class="copyright"', 'div class="sidebar"', 'div id="side"', 'div class="widget"', 'section class="sidebar"',
    'div class="notice"', 'div class="cookie-notice"', 'div id="cookie-consent"', 'div class="cookie-banner"', 'div class="banner"', 'div class="popup"', 'div class="modal"', 'div class="alert"',
    'div class="newsletter"', 'div class="subscribe"', 'div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'aside class="ad"', 'div id="ad-slot"',
    'div class="sponsored"', 'div class="promo"', 'p class="ad"', 'section class="ad"', 'p class="notice"', 'div class="share"', 'div class="social"', 'div class="related"', 'div class="recommended"', 'div class="comments"',
    'section id="comments"', 'section class="comments"', 'div class="comment"', 'article class="comment"', 'ol class="comment-list"', 'li class="comment"', 'div class="reply"', 'div class="respond"', 'div class="search"', 'div class="login"',
    'div class="pagination"', 'div class="tags"', 'div class="legal"', 'div role="navigation"', 'div role="banner"', 'div role="contentinfo"', 'div role="complementary"', "div hidden", 'div class="gdpr"',
    'div class="disclaimer"', 'div class="toolbar"', 'div class="skip"', "button", "dialog", 'div role="dialog"', 'div role="alert"', 'div role="search"', 'ul class="menu"', 'ul class="breadcrumbs"', "menu", "fieldset", 'div class="top-bar"', 'div id="disqus-thread"', 'div class="user-reviews"', 'div class="author-bio"', 'div class="caption-ad"',
)
SEMANTIC_PARTS = ("nav", "header", "footer", "aside", "form", "button", "label")
CONTENT_PARTS = ("p", "p", "p", "p", "h1", "h2", "h3", "blockquote", "ul", "ol", "table", "pre", "figure", "div", "section")
INLINE_PARTS = ("b", "i", "em", "strong", "a", "span", "code")
CUE_TEXTS = (
    "We use cookies to improve", "Accept all cookies", "Privacy policy", "Subscribe to our newsletter", "Sign up for", "Advertisement", "Sponsored content", "Copyright 2020", "© 2021 All rights reserved", "Log in", "Sign in to", "Your name",
    "Share this", "Tweet", "Leave a comment", "Reply", "3 comments", "Posted a reply", "Read more", "Related articles", "Recommended for you", "You may also like", "Datenschutz", "Impressum", "Anzeige", "Werbung", "Kommentare", "Weiterlesen",
    "Mentions légales", "Abonnez-vous", "Publicité", "Commentaires", "Lire aussi", "Aviso legal", "Suscríbete", "Publicidad", "Comentarios", "Leer más",
)


def labelled_pages(n: int, seed: int = 11, containers: tuple[str, ...] = CONTAINERS, boiler_parts: tuple[str, ...] = BOILER_PARTS, unnamed: float = 0.35, prose: float = 0.4) -> list[tuple[Dom, list[int]]]:
    """Pages with a label for every node, put together from the parts above. What holds both content and boilerplate is
    neutral. A share `unnamed` of the parts has invented names, so that the model learns to do without them; a share `prose`
    of the boilerplate reads like an article and has its own name, which alone gives it away."""
    rng, out = Random(seed), []

    def invented(low: int, high: int) -> str:
        return "".join(rng.choice("aeiourstlnmdcp") for _ in range(rng.randint(low, high)))

    def words(low: int, high: int) -> str:
        return " ".join(invented(2, 8) for _ in range(rng.randint(low, high)))

    def part(opening: str, label: int, always: bool = False) -> list:
        tag, _, attributes = opening.partition(" ")
        if not always and rng.random() < unnamed and (attributes or tag in ("div", "section")):
            opening = rng.choice((tag if tag in ("div", "section", "ul", "ol") else "div", f'div class="{invented(3, 9)}"', f'div id="{invented(2, 6)}-{invented(2, 6)}"', f'{tag} class="{invented(2, 5)}-{rng.randint(1, 9)}"'))
        return [opening, label]

    def line(label: int, low: int, high: int) -> list:
        """The texts of one block."""
        found: list = [(words(low, high) + rng.choice(("", ".", ".", ".")), label)]
        if rng.random() < 0.3:
            found += [[rng.choice(INLINE_PARTS), label, (words(1, 5), label)], (words(low, high) + ".", label)]
        return found

    def boiler() -> list:
        told = rng.random() < prose
        node = part(rng.choice(SEMANTIC_PARTS if rng.random() < 0.2 else boiler_parts), BOILERPLATE, told)
        kind = rng.random()
        if told:
            said = [[rng.choice(("h2", "h3", "h4")), BOILERPLATE, (words(1, 5), BOILERPLATE)]] if rng.random() < 0.4 else []
            said += [[rng.choice(("p", "p", "p", "div", "li")), BOILERPLATE, *line(BOILERPLATE, 3, rng.choice((12, 30, 60)))] for _ in range(rng.randint(1, 4))]
            node += said if rng.random() < 0.75 else line(BOILERPLATE, 3, 40)
        elif kind < 0.35:  # links
            items = [[rng.choice(("li", "li", "p", "span", "div")), BOILERPLATE, ["a", BOILERPLATE, (words(1, 3), BOILERPLATE)]] for _ in range(rng.randint(1, 9))]
            node += [[rng.choice(("ul", "ol", "div")), BOILERPLATE, *items]] if rng.random() < 0.8 else items
        elif kind < 0.5:  # reader comments
            node += [[rng.choice(("h2", "h3", "p")), BOILERPLATE, (rng.choice(("Comments", "2 comments", "Leave a comment", "Kommentare", "Commentaires", "Comentarios")), BOILERPLATE)]] if rng.random() < 0.7 else []
            for _ in range(rng.randint(1, 4)):
                said = [["p", BOILERPLATE, *line(BOILERPLATE, 3, 25)]]
                said += [["a", BOILERPLATE, (rng.choice(("Reply", "Antworten", "Répondre", "Responder", words(1, 2))), BOILERPLATE)]] if rng.random() < 0.6 else []
                node.append([*part(rng.choice(("div", 'div class="comment"', "li", "article")), BOILERPLATE), *said])
        else:
            for _ in range(rng.randint(1, 3)):
                said = [(rng.choice(CUE_TEXTS) + rng.choice(("", ".", " " + words(1, 12), " " + words(2, 9) + ".")), BOILERPLATE)] if rng.random() < 0.5 else line(BOILERPLATE, 1, rng.choice((4, 10, 12, 25)))
                node += [[rng.choice(("p", "p", "div", "span", "h3", "blockquote", "label", "button")), BOILERPLATE, *said]] if rng.random() < 0.7 else said
        return node

    def content(longest: int) -> list:
        tag = rng.choice(CONTENT_PARTS) if rng.random() < 0.8 else "p"
        if tag in ("ul", "ol", "table", "figure", "div", "section"):
            inner = {"table": "tr", "figure": "figcaption", "div": "p", "section": "p"}.get(tag, "li")
            return [*part(tag, CONTENT), *([inner, CONTENT, *line(CONTENT, 2, 30)] for _ in range(rng.randint(1, 4)))]
        most = 9 if tag[0] == "h" else min(longest, rng.choice((5, 20, 60, longest)))
        return [tag, CONTENT, *line(CONTENT, 1 if tag[0] == "h" or most < 5 else rng.choice((1, 4, 4)), most)]

    def flatten(node, parent: int, depth: int, dom: Dom, labels: list[int], linked: bool) -> None:
        if isinstance(node, tuple):
            dom.add(parent, depth, ("tag=#text",), node[0], linked, 0)
            labels.append(node[1])
            return
        tag, _, attributes = node[0].partition(" ")
        at = dom.add(parent, depth, signature(tag, attributes), None, False, 0)
        labels.append(node[1])
        for kid in node[2:]:
            flatten(kid, at, depth + 1, dom, labels, linked or tag == "a")
        dom.last[at] = len(dom.parent) - 1

    for _ in range(n):
        inside = part(rng.choice(containers), CONTENT)
        headline = ["h1", CONTENT, (words(2, 9), CONTENT)]
        above = []
        if rng.random() < 0.6:
            where = rng.random()
            if where < 0.3:
                inside.append([*part(rng.choice(("header", 'header class="article-header"', 'div class="headline"', 'div class="title"')), CONTENT), headline])
            elif where < 0.8:
                inside.append(headline)
            else:
                above.append(headline)
        longest = rng.choice((3, 12, 60, 60, 60, 250))  # short remarks only, up to whole chapters
        for _ in range(rng.randint(2, rng.choice((9, 9, 60)))):
            inside.append(boiler() if rng.random() < 0.12 else content(longest))
        body = ["body", NEUTRAL, *(boiler() for _ in range(rng.randint(1, 4)))]
        bare = rng.random() < 0.08  # no element holds the content alone
        main = [*above, *(inside[2:] if bare else [inside]), *(boiler() for _ in range(rng.randint(0, 3)))]
        if rng.random() < 0.5:
            main = [[rng.choice(('div class="wrapper"', 'div id="page"', "div", 'div class="container"', f'div class="{invented(3, 8)}"')), NEUTRAL, *(boiler() for _ in range(rng.randint(0, 2))), *main]]
        dom, labels = Dom.empty(), [NEUTRAL]
        flatten(["html", NEUTRAL, [*body, *main, *(boiler() for _ in range(rng.randint(0, 3)))]], 0, 1, dom, labels, False)
        dom.last[0] = len(dom.parent) - 1
        out.append((dom, labels))
    return out


def train(pages: list[tuple[Dom, list[int]]], ridge: float = 0.3, rounds: int = 120) -> Model:
    """Potentials from labelled pages: for each label of the parent a ridge logistic regression of the child's label on its
    features, in accelerated steps under a fixed bound of the curvature; for texts the smoothed frequencies of their kinds
    by label. Features seen fewer than three times are left out."""
    kinds = np.ones((3, 20))
    examples: dict[tuple[int, tuple[str, ...]], list[int]] = {}
    seen: dict[str, int] = {}
    for dom, labels in pages:
        inside = structure(dom)
        for node in range(1, len(labels)):
            features = (*dom.features[node], *(f"{family}={v}" for family, v in zip(STRUCTURE, inside[node].tolist(), strict=True)))
            examples.setdefault((labels[dom.parent[node]], features), [0, 0, 0])[labels[node]] += 1
            for f in features:
                seen[f] = seen.get(f, 0) + 1
            if dom.text[node] is not None:
                kinds[labels[node], _evidence(dom.text[node], dom.linked[node], dom.words[node])] += 1
    index = {f: i for i, f in enumerate(sorted(f for f, times in seen.items() if times > 2))}
    weights = np.zeros((3, 3, len(index) + 1))
    m = len(index) + 1
    for label in range(3):
        rows = [([*(index[f] for f in fs if f in index), m - 1], n) for (above, fs), n in examples.items() if above == label]
        if not rows:
            continue
        n = np.array([c for _, c in rows], dtype=float)
        width, at = np.array([len(r) for r, _ in rows]), np.concatenate([r for r, _ in rows])
        row, heads = np.repeat(np.arange(len(rows)), width), np.cumsum(width) - width
        gram = ridge * np.eye(m)
        for i in range(0, len(rows), 4096):
            x = np.zeros((min(4096, len(rows) - i), m), dtype=np.float32)
            here = (row >= i) & (row < i + 4096)
            x[row[here] - i, at[here]] = 1
            gram += (x * n[i : i + 4096].sum(axis=1, keepdims=True).astype(np.float32)).T @ x / 2
        step = np.linalg.inv(gram)
        w = w_last = np.zeros((3, m))
        for t in range(rounds):
            v = w + t / (t + 3) * (w - w_last)
            z = np.add.reduceat(v.T[at], heads)
            off = n - np.exp(z - _log_sum(z, 1)[:, None]) * n.sum(axis=1, keepdims=True)
            ascent = np.stack([np.bincount(at, off[row, k], m) for k in range(3)]) - ridge * v
            w_last, w = w, v + ascent @ step
        weights[label] = w
    kinds[:, 0] = kinds[:, 0].sum()  # white space tells nothing
    return Model(index, weights, np.log(kinds / kinds.sum(axis=1, keepdims=True)), np.array([0.998, 1e-3, 1e-3]))


def main_text(pages: DataFrame, labelled: list[tuple[Dom, list[int]]] | None = None, threshold: float = 0.5) -> DataFrame:
    """pages(page_id, url, html, ...) plus text and n_chars, the page's main text and its code points.

    labelled: pages that the potentials are trained from, by default 600 of labelled_pages. A null or empty page, and
    one whose nodes are all less likely content than `threshold`, has the empty text. Pages are read whole; repeated
    rows give repeated results. Other columns pass through (own columns text and n_chars are replaced).
    """
    bounded_batches(pages.sparkSession)
    model = pages.sparkSession.sparkContext.broadcast(train(labelled or labelled_pages(600)))

    def run(html: pa.Array) -> pa.Array:
        texts = utf8_rows(html)
        out = [t for i, j in chunked(texts) for t in extract(model.value, [p.decode() for p in texts[i:j]], threshold)]
        return pa.array(out, pa.string())

    found = pages.withColumn("text", F.arrow_udf(run, "string")(F.col("html").cast("string")))
    return found.withColumn("n_chars", F.length("text").cast("long"))
