"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements.  Each has an unknown label, content or not, with a unary
potential from its own features (tag, words in class, id and role, length and link share of its text)
and a potential with its parent's label, by kind of element.  Sum-product messages go up the tree and
down again and give each block's marginal probability of being content, exactly, as the graph is a
tree.  The weights are trained by maximum likelihood on labelled pages (``labelled_pages``), with the
same messages giving the expected counts.

The text of a page: the blocks with a marginal of at least one half, in page order.  Character references
are decoded, white space inside a block (line breaks and tags of breaks too) becomes one space, ends
are trimmed, blocks are joined by one space.  Scripts, styles, templates, form controls, frames, drawings
and media, comments in the markup, and the head are no text at all.  Nothing else is dropped or capped:
``math`` and the fallback text in ``object`` and ``noscript`` are text.

A null or empty page, or one without content, has an empty text.  Unclosed, misnested and truncated
markup is read as far as it goes; a head that is not closed ends with the first element or text that
can't stand in one.  A quote inside an unquoted value or a name is an ordinary character.  A block whose
marginal is exactly one half is content.  An empty table gives an empty one.  Rows that repeat give the
same text.  Other columns are kept, whatever their names.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, slices

# Fixed values of HTML: which elements are blocks, which have no content, which close which.
_BLOCK = set("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption nav header footer aside form fieldset figure figcaption blockquote pre address details summary hgroup center".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title xmp noembed noframes".split())
_SILENT = set("head template iframe select button svg canvas audio video datalist".split())
_HEAD = set("html head base basefont bgsound link meta title style script noscript noframes template".split())
_BREAK = set("br hr img".split())
_CLOSES_P = _BLOCK - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPES = set("ul ol dl table body html div article section main nav aside header footer form blockquote".split())
#: Attributes as HTML reads them: a quote means something only where a value begins.
_ATTRIBUTES = r"""(?:[\s/]|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"?|'[^']*+'?|[^\s>"'][^\s>]*+)?)?)*+"""
_TOKEN = re.compile(rf"<(?:!--(?:-?>|.*?--!?>|.*)|![^>]*>?|\?[^>]*>?|(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})>?)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")

_TAGS = ("html", "body", "main", "article", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "dl", "table", "tr", "td", "nav", "header", "footer", "aside", "form", "figure", "figcaption", "blockquote", "pre", "details", "other")
_GROUPS = (
    ("content", "article post entry main story body text articlebody copy prose paragraph maincontent"),
    ("menu", "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toc topbar skip"),
    ("head", "header masthead banner hero logo branding top"),
    ("foot", "footer foot bottom copyright legal colophon contentinfo"),
    ("side", "sidebar side aside rail widget widgets complementary secondary"),
    ("ad", "ad ads adv advert advertisement advertising sponsor sponsored promo promotion promoted outbrain taboola dfp"),
    ("notice", "notice cookie cookies consent gdpr alert popup modal overlay dialog toast warning announcement disclaimer paywall"),
    ("comments", "comment comments commentlist respond replies reply disqus discussion reaction reactions feedback reader readers"),
    ("share", "share sharing social follow tweet like tools"),
    ("related", "related recommended recommendation recommendations more popular trending readmore latest teaser teasers"),
    ("form", "form subscribe newsletter login signin signup search register contact"),
    ("meta", "meta byline author date tags tag category categories credit caption"),
)
_FEATURES = len(_TAGS) + len(_GROUPS) + 14
#: Kinds of element that share a potential with their parent.
_KINDS = {"p": 0, "h1": 1, "h2": 1, "h3": 1, "li": 2, "ul": 2, "ol": 2, "div": 3, "section": 3, "article": 4, "main": 4, "nav": 5, "aside": 5, "header": 5, "footer": 5, "form": 5}
_N_KINDS = 7
#: Label mark of training pages: only ``labelled_pages`` writes it, and it is no feature.
_MARK = re.compile(r"\bdata-label=\"?([01])")


class Page:
    """The block tree of one page: parents, features, and the text runs with their block."""

    __slots__ = ("parent", "tag", "tokens", "hidden", "label", "runs", "chars", "linked", "stops")

    def __init__(self, source: str):
        self.parent, self.tag, self.tokens, self.hidden, self.label = [-1], ["html"], [()], [False], [-1]
        self.runs: list[tuple[int, str]] = []
        self.chars, self.linked, self.stops = [0], [0], [0]
        self._read(source)

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]  # open elements and their block
        inline: list[str] = []
        links = silent = 0
        at, end = 0, len(source)

        def flush() -> None:
            if inline:
                text = " ".join("".join(inline).split())
                if text:
                    self.runs.append((stack[-1][1], text))
                inline.clear()

        def close(k: int) -> None:
            """Close the open elements from place ``k`` on."""
            nonlocal links, silent
            for name, _ in stack[k:]:
                links -= name == "a"
                silent -= name in _SILENT
            if any(name in _BLOCK for name, _ in stack[k:]):
                flush()
            del stack[k:]

        def leave_head() -> None:
            """Close an open head; what a template in it holds doesn't."""
            k = next((k for k, (name, _) in enumerate(stack) if name == "head"), 0)
            if k and all(name != "template" for name, _ in stack[k:]):
                close(k)

        while at < end:
            m = _TOKEN.search(source, at)
            text = source[at : m.start() if m else end]
            if silent and stack[-1][0] == "head" and text.strip():
                leave_head()
            if text and not silent:
                text = html.unescape(text)
                inline.append(text)
                block, size = stack[-1][1], len(text.strip())
                self.chars[block] += size
                self.stops[block] += text.count(". ") + text.count(", ") + text.rstrip().endswith(".")
                if links > 0:
                    self.linked[block] += size
            if not m:
                break
            at = m.end()
            name = m[2].lower() if m[2] else ""
            if not name:
                continue
            if m[1]:
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
                if k and not (name not in _BLOCK and any(x in _SCOPES for x, _ in stack[k:])):
                    close(k)
                continue
            if silent and name not in _HEAD:
                leave_head()
            if name in _VOID:
                if name in _BREAK and not silent:
                    inline.append(" ")
                continue
            if name in _RAW:
                done = re.compile(rf"</{name}\b[^>]*>?", re.I).search(source, at)
                at = done.end() if done else end
                continue
            if name in _CLOSES_P:
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == "p" or stack[k][0] in _SCOPES), 0)
                if k and stack[k][0] == "p":
                    close(k)
            if name in _SIBLINGS:
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] in _SIBLINGS[name] or stack[k][0] in _SCOPES), 0)
                if k and stack[k][0] in _SIBLINGS[name]:
                    close(k)
            if name in ("html", "body") and any(x == name for x, _ in stack):
                continue
            if m[3].rstrip().endswith("/") and name not in _BLOCK:
                continue
            if name not in _BLOCK:
                links += name == "a"
                silent += name in _SILENT
                stack.append((name, stack[-1][1]))
                continue
            if silent:
                stack.append((name, stack[-1][1]))
                continue
            flush()
            tokens, hidden = self._attributes(m[3])
            label = _MARK.search(m[3])
            self.parent.append(stack[-1][1]), self.tag.append(name), self.tokens.append(tokens)
            self.hidden.append(hidden), self.label.append(int(label[1]) if label else -1)
            self.chars.append(0), self.linked.append(0), self.stops.append(0)
            stack.append((name, len(self.parent) - 1))
        flush()

    @staticmethod
    def _attributes(source: str) -> tuple[tuple[str, ...], bool]:
        tokens: list[str] = []
        hidden = False
        for a in _ATTRIBUTE.finditer(source) if source else ():
            name, value = a[1].lower(), (a[2] or a[3] or a[4] or "")
            if name in ("class", "id", "role", "itemprop"):
                tokens += _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                hidden = True
        return tuple(tokens), hidden

    def features(self) -> np.ndarray:
        n = len(self.parent)
        parent = np.array(self.parent)
        own, linked = np.array(self.chars, float), np.array(self.linked, float)
        chars, links, stops, below = own.copy(), linked.copy(), np.array(self.stops, float), np.zeros(n)
        for i in range(n - 1, 0, -1):  # children come after their parents
            p = parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            stops[p] += stops[i]
            below[p] += 1 + below[i]
        x = np.zeros((n, _FEATURES), np.float32)
        for i in range(n):
            x[i, _TAG_AT.get(self.tag[i], len(_TAGS) - 1)] = 1
            for t in self.tokens[i]:
                g = _GROUP_AT.get(t)
                if g is not None:
                    x[i, len(_TAGS) + g] = 1
        share = links / np.maximum(chars, 1)
        rest = np.stack([np.ones(n), self.hidden, chars == 0, (chars > 0) & (chars < 30), (chars >= 30) & (chars < 100), (chars >= 100) & (chars < 400), chars >= 400, share > 0.2, share > 0.5, share > 0.8, own > 80, stops / np.maximum(chars, 20) * 40 > 1, below == 0, chars > 0.5 * max(chars[0], 1)], 1)
        x[:, len(_TAGS) + len(_GROUPS) :] = rest
        return x


_TAG_AT = {t: i for i, t in enumerate(_TAGS)} | {"h4": 9, "h5": 9, "h6": 9, "th": 16, "tbody": 14, "thead": 14, "tfoot": 14, "caption": 14, "dt": 13, "dd": 13}
_GROUP_AT = {w: i for i, (_, words) in enumerate(_GROUPS) for w in words.split()}


class Forest:
    """The block trees of many pages in one set of arrays, by depth, so that messages are array steps."""

    def __init__(self, pages: list[Page]):
        size = np.array([len(p.parent) for p in pages], np.int64)
        self.first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        self.parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + f) for p, f in zip(pages, self.first, strict=False)]) if pages else np.zeros(0, np.int64)
        self.x = np.concatenate([p.features() for p in pages]) if pages else np.zeros((0, _FEATURES), np.float32)
        self.kind = np.array([_KINDS.get(t, _N_KINDS - 1) for p in pages for t in p.tag], np.int64)
        depth = np.zeros(len(self.parent), np.int64)
        for i, p in enumerate(self.parent.tolist()):
            if p >= 0:
                depth[i] = depth[p] + 1
        self.levels = [np.flatnonzero(depth == d) for d in range(1, int(depth.max()) + 1)] if len(depth) else []

    def beliefs(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Marginals of each block, joint marginals with its parent, and the log partition sum.

        ``unary`` is (n, 2) and ``pair`` (kinds, parent's label, own label), both in logs.
        """
        n = len(self.parent)
        inward = unary.copy()  # evidence of a block and all below it
        message = np.zeros((n, 2))  # what a block tells its parent
        for at in reversed(self.levels):
            message[at] = np.logaddexp.reduce(pair[self.kind[at]] + inward[at][:, None, :], axis=2)
            np.add.at(inward, self.parent[at], message[at])
        roots = np.flatnonzero(self.parent < 0)
        outward = np.zeros((n, 2))
        joint = np.zeros((n, 2, 2))
        total = np.logaddexp.reduce(inward[roots], axis=1)
        log_z = np.zeros(n)
        log_z[roots] = total
        for at in self.levels:
            p = self.parent[at]
            above = outward[p] + inward[p] - message[at]  # the parent without this child
            both = pair[self.kind[at]] + above[:, :, None] + inward[at][:, None, :]
            log_z[at] = log_z[p]
            joint[at] = np.exp(both - log_z[at][:, None, None])
            outward[at] = np.logaddexp.reduce(pair[self.kind[at]] + above[:, :, None], axis=1)
        return np.exp(inward + outward - log_z[:, None]), joint, float(total.sum())


class ContentModel:
    """Weights of the unary and parent-child potentials."""

    def __init__(self):
        self.weight = np.zeros(_FEATURES)
        self.pair = np.zeros((_N_KINDS, 2, 2))

    def marginals(self, forest: Forest) -> np.ndarray:
        score = forest.x @ self.weight
        return forest.beliefs(np.stack([np.zeros_like(score), score], 1), self.pair)[0][:, 1]

    def fit(self, pages: list[Page], labels: np.ndarray, steps: int = 250, rate: float = 0.1, ridge: float = 0.01) -> None:
        """Maximum likelihood: observed less expected counts, with adaptive steps."""
        forest = Forest(pages)
        x, y = forest.x.astype(float), labels.astype(float)
        child = np.flatnonzero(forest.parent >= 0)
        seen_pair = np.zeros_like(self.pair)
        np.add.at(seen_pair, (forest.kind[child], labels[forest.parent[child]], labels[child]), 1)
        first = [np.zeros_like(self.weight), np.zeros_like(self.pair)]
        second = [np.zeros_like(self.weight), np.zeros_like(self.pair)]
        for t in range(1, steps + 1):
            score = x @ self.weight
            marginal, joint, _ = forest.beliefs(np.stack([np.zeros_like(score), score], 1), self.pair)
            expected = np.zeros_like(self.pair)
            np.add.at(expected, forest.kind[child], joint[child])
            grads = [(x.T @ (y - marginal[:, 1])) / len(pages) - ridge * self.weight, (seen_pair - expected) / len(pages) - ridge * self.pair]
            for k, (param, g) in enumerate(zip((self.weight, self.pair), grads, strict=True)):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                param += rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-6)


def labelled_pages(n: int = 400, seed: int = 11) -> list[str]:
    """Training pages: usual layouts of articles and what surrounds them, each block marked with its label.

    Words are drawn by rule and carry no meaning, so the model can learn from structure only.
    """
    rng = random.Random(seed)

    def word() -> str:
        return "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rng.randint(a, b)))

    def prose(a: int, b: int) -> str:
        out = []
        for _ in range(rng.randint(a, b)):
            s = words(5, 18)
            s = s.replace(" ", ", ", 1) if rng.random() < 0.4 else s
            out.append(s.capitalize() + ".")
        text = " ".join(out)
        if rng.random() < 0.15:
            text = f"<a href='/{word()}'>{words(1, 4)}</a> " + text
        return f"<b>{text}" if rng.random() < 0.1 else text

    def el(tag: str, label: int, inner: str, names: str = "") -> str:
        attribute = f' {rng.choice(("class", "class", "id"))}="{names}"' if names else ""
        return f'<{tag}{attribute} data-label="{label}">{inner}</{tag}>'

    def either(*tags: str) -> str:
        return rng.choice(tags)

    def link_list(label: int) -> str:
        inner = "".join(el("li", label, f"<a href='/{word()}'>{words(1, 3)}</a>") for _ in range(rng.randint(2, 8)))
        return el(either("ul", "ul", "ol"), label, inner)

    def named(*names: str) -> str:
        return rng.choice(names) + (f" {word()}" if rng.random() < 0.3 else "")

    def menu() -> str:
        return el("nav", 0, link_list(0), rng.choice(("", "", named("nav")))) if rng.random() < 0.6 else el("div", 0, link_list(0), named("menu", "navbar", "main-nav", "breadcrumbs"))

    def head() -> str:
        inner = el(either("div", "p", "h1", "h2"), 0, f"<a href='/'>{words(1, 3)}</a>", rng.choice(("", "logo", "branding"))) + rng.choice(("", menu()))
        return el("header", 0, inner, rng.choice(("", named("header")))) if rng.random() < 0.6 else el("div", 0, inner, named("header", "masthead", "top-banner"))

    def foot() -> str:
        inner = rng.choice((f"&copy; {words(1, 3)} &middot; {words(2, 10)}.", el("p", 0, f"&copy; {words(2, 6)}. {prose(1, 2)}"), link_list(0) + el("p", 0, words(2, 5))))
        return el("footer", 0, inner, rng.choice(("", named("footer")))) if rng.random() < 0.65 else el("div", 0, inner, named("footer", "copyright", "site-footer"))

    def block(names: tuple[str, ...], tags: tuple[str, ...] = ("div", "div", "section")) -> str:
        inner = rng.choice((prose(1, 2), el("p", 0, prose(1, 3)), el("h3", 0, words(1, 4)) + el("p", 0, prose(1, 2)), words(2, 8)))
        return el(rng.choice(tags), 0, inner, named(*names))

    def advert() -> str:
        return block(("ad", "ads", "advert", "advertisement", "sponsored", "promo"), ("div", "div", "aside"))

    def notice() -> str:
        return block(("cookie-notice", "consent", "notice", "alert", "popup", "gdpr-banner", "paywall"))

    def aside() -> str:
        inner = el("h3", 0, words(1, 3)) + rng.choice((link_list(0), el("p", 0, prose(1, 3)), link_list(0) + el("p", 0, prose(1, 2))))
        return el("aside", 0, inner, rng.choice(("", "sidebar"))) if rng.random() < 0.6 else el("div", 0, inner, named("sidebar", "widget", "related", "more-stories", "popular"))

    def comments() -> str:
        one = lambda: el(either("div", "li", "article"), 0, rng.choice((el("p", 0, prose(1, 4)), el("p", 0, words(1, 2)) + el("p", 0, prose(1, 3)), prose(1, 3))), named("comment", "reply"))
        return el(either("section", "div", "ul"), 0, el("h3", 0, words(1, 2)) + "".join(one() for _ in range(rng.randint(1, 5))), named("comments", "comment-list", "reader-comments", "discussion", "respond"))

    def form() -> str:
        inner = f"<label>{words(1, 3)}</label><input name=a><button>{word()}</button>" + rng.choice(("", el("p", 0, words(3, 10))))
        return el("form", 0, inner, rng.choice(("", "newsletter", "search", "login"))) if rng.random() < 0.7 else el("div", 0, el("p", 0, words(4, 12)) + el("form", 0, inner), named("subscribe", "newsletter-signup"))

    def share() -> str:
        return el(either("div", "ul"), 0, "".join(f"<a href='/{word()}'>{word()}</a> " for _ in range(3)), named("share", "social"))

    def linked_list() -> str:
        """A list of links that is content: it has no name and lies in the article itself."""
        return el(either("ul", "ol"), 1, "".join(el("li", 1, f"<a href='/{word()}'>{words(2, 8)}</a>" + rng.choice(("", "", f" {words(1, 6)}"))) for _ in range(rng.randint(2, 8))))

    def body_block() -> str:
        r = rng.random()
        if r < 0.68:
            return el("p", 1, rng.choice((prose(1, 6), prose(1, 6), prose(1, 6), words(1, 5) + ".")))
        if r < 0.76:
            return el(either("h2", "h3"), 1, words(1, 7))
        if r < 0.86:
            return linked_list()
        if r < 0.86:
            return el(either("ul", "ol"), 1, "".join(el("li", 1, rng.choice((words(2, 8), prose(1, 2)))) for _ in range(rng.randint(2, 5))))
        if r < 0.89:
            return el("blockquote", 1, rng.choice((prose(1, 3), el("p", 1, prose(1, 3)))))
        if r < 0.915:
            return el("pre", 1, words(3, 20))
        if r < 0.94:
            return el("table", 1, "".join(el("tr", 1, el("td", 1, words(1, 3)) + el("td", 1, words(1, 3))) for _ in range(rng.randint(2, 4))))
        if r < 0.97:
            return el("figure", 1, "<img src=a>" + el("figcaption", 1, words(3, 10)))
        return el(either("div", "section"), 1, el("p", 1, prose(1, 4)) + el("p", 1, prose(1, 3)))

    def page() -> str:
        inner = [el(either("h1", "h1", "h2"), 1, words(3, 12))] + [body_block() for _ in range(rng.choice((1, 2, 4, 8, 14)))]
        if rng.random() < 0.2:  # an article that is a list of links
            inner = inner[:1] + rng.choice(([], [el("p", 1, prose(1, 2))])) + [linked_list() for _ in range(rng.randint(1, 2))]
        elif rng.random() < 0.1:  # many short lines, or words without an end
            inner += rng.choice(([el("p", 1, words(1, 3) + rng.choice((".", ""))) for _ in range(rng.randint(8, 40))], [el("p", 1, words(40, 160))]))
        for extra in (advert, share, aside, comments, form, notice, menu):
            if rng.random() < 0.12:
                inner.insert(rng.randint(1, len(inner)), extra())
        r = rng.random()
        if r < 0.45:
            main = el("article", 1, "".join(inner), rng.choice(("", "post")))
        elif r < 0.6:
            main = el("main", 1, "".join(inner))
        elif r < 0.85:
            main = el(either("div", "section"), 1, "".join(inner), named("content", "article-body", "post", "entry-content", "story", "main"))
        else:
            main = el("div", 1, "".join(inner), word() if rng.random() < 0.5 else "")
        if rng.random() < 0.3:
            main = el(either("div", "main", "section"), 1, main, rng.choice(("", "content", "main", "wrapper", "container")))
        before = [f() for f in (menu, head, notice, advert, form) if rng.random() < 0.4]
        after = [f() for f in (foot, foot, aside, comments, advert, form, share, notice) if rng.random() < 0.4]
        middle = "".join(before) + main + "".join(after)
        if rng.random() < 0.3:
            middle = el("div", 1, middle, rng.choice(("page", "wrapper", "container", "site")))
        return f'<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{margin:0}}</style></head><body data-label="1">{middle}</body></html>'

    return [page() for _ in range(n)]


@cache
def trained_model() -> ContentModel:
    """The model of the labelled pages; a block without a mark has its parent's label."""
    pages = [Page(p) for p in labelled_pages()]
    labels = []
    for p in pages:
        own = list(p.label)
        own[0] = 1
        for i in range(1, len(own)):
            if own[i] < 0:
                own[i] = own[p.parent[i]]
        labels += own
    model = ContentModel()
    model.fit(pages, np.array(labels))
    return model


def main_texts(sources: list[str | None], model: ContentModel) -> list[str]:
    """The main text of each page."""
    pages = [Page(s or "") for s in sources]
    forest = Forest(pages)
    kept = model.marginals(forest) >= 0.5
    return [" ".join(text for block, text in p.runs if kept[f + block]) for p, f in zip(pages, forest.first, strict=False)]


def extracted(pages: DataFrame, model: ContentModel, column: str = "text") -> DataFrame:
    """``pages`` without html, with a column of the main text (an existing column of that name is replaced)."""
    pages = pages.withColumn("html", F.col("html").cast("string"))
    schema = T.StructType([f for f in pages.schema.fields if f.name not in (column, "html")] + [T.StructField(column, T.StringType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                text = pa.array(main_texts(part["html"].to_pylist(), model), pa.string())
                for name in ("html", column):
                    at = part.schema.get_field_index(name)
                    if at >= 0:
                        part = part.remove_column(at)
                yield from part.append_column(column, text).combine_chunks().to_batches()

    return arrow_map(pages, step, schema)
