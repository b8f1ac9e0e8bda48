"""Main text of web pages by gradient-boosted trees over DOM nodes.

Each page is read in one forward pass into a tree of block elements; text beside blocks, and all text outside any element, becomes
a block of its own. Every block is described by its tag, depth, siblings, the density of text and links of its subtree, and the
hashed tokens of its attributes and its ancestors'. Boosted trees, trained in numpy on generated pages
of many layouts whose blocks are known, give each block the odds of holding main text, and a tree
recursion picks the most likely consistent choice: below a dropped block nothing is kept.

Text rules: character references are decoded, white space inside a block becomes one space, `br` counts as white
space, blocks are joined in page order by two newlines. Script, style, form controls and
comments never carry text.

Defined cases: null or empty html, and pages without a kept block, give an empty text; unclosed and crossed tags
are closed as their parent closes; a script, style, title or comment that never ends takes the rest of the page, other elements
without text that never end take nothing, and a tag that never ends is no text; very long pages are read whole, in time
proportional to their length; repeated rows are read each; extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracelake.llm.common import chunks, table

PAGES = 1000
TREES = 80
DEPTH = 4
BINS = 32
RATE = 0.2
SEED = 11
#: Buckets of attribute tokens; a block has these bits of its own and of its ancestors.
TOKEN_BITS = 256

#: Elements without text; those whose content is read as characters up to their end tag, and others.
RAW = frozenset("script style title textarea iframe".split())
SKIPPED = RAW | frozenset("noscript template select button svg object".split())
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_INSIDE = re.compile(r">|=\s*([\"'])")
_ENDS = re.compile(rf"</({'|'.join(sorted(SKIPPED))})(?=[\s/>])", re.I)
_ATTRIBUTE = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")

#: Element kinds of HTML.
BLOCKS = frozenset(
    "html body main article section div nav header footer aside form fieldset table thead tbody tfoot tr td th ul ol li dl dt dd "
    "p pre blockquote h1 h2 h3 h4 h5 h6 figure figcaption address details summary dialog center hr menu".split()
)
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: Open elements that a start tag closes first.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "thead": ("tr",), "tbody": ("thead", "tr"), "tfoot": ("tbody", "tr"),
}
TAG_GROUPS = (
    ("p", "pre", "blockquote"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("li", "dd", "dt"), ("ul", "ol", "dl", "menu"), ("div", "section", "center"),
    ("article", "main"), ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset", "dialog"),
    ("table", "thead", "tbody", "tfoot", "tr", "td", "th"), ("html", "body"), ("figure", "figcaption"),
)
_GROUP = {t: k for k, tags in enumerate(TAG_GROUPS) for t in tags}
_GROUP[""] = len(TAG_GROUPS)


class Block:
    """An element, or with the tag "" a run of text beside elements."""

    __slots__ = ("children", "depth", "end", "index", "inherited", "linked", "links", "parent", "parts", "same", "size", "tag", "texts", "tokens", "words")

    def __init__(self, tag: str, parent: Block | None, tokens: int):
        self.tag, self.parent, self.tokens = tag, parent, tokens
        self.depth = parent.depth + 1 if parent else 0
        self.inherited = parent.inherited | parent.tokens if parent else 0
        self.index = len(parent.children) if parent else 0
        self.children: list[Block] = []
        self.parts: list[str] = []  # of the text run that is open
        self.linked = 0  # characters of it inside links
        self.texts: list[tuple[int, str]] = []  # (place on the page, text) of finished runs
        self.links = self.size = self.words = self.end = self.same = 0


def _tokens(attributes: str) -> int:
    """Bits of the words in class, id, role and label."""
    found = 0
    for m in _ATTRIBUTE.finditer(attributes):
        for w in _SPLIT.split(m[1] or m[2] or m[3] or ""):
            if w:
                found |= 1 << zlib.crc32(w.lower().encode()) % TOKEN_BITS
    return found


def _tag_end(page: str, at: int) -> int:
    """Place of the > that ends a tag, or -1; quoted values may hold one."""
    while m := _INSIDE.search(page, at):
        if not m[1]:
            return m.start()
        close = page.find(m[1], m.end())
        if close < 0:
            return page.find(">", m.end())
        at = close + 1
    return -1


def scan(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text, tag, whether it is an end tag, attributes) of a page in order; texts have no tag."""
    ends: dict[str, list[int]] = {}
    for m in _ENDS.finditer(page):
        ends.setdefault(m[1].lower(), []).append(m.start())
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield page[at:], "", False, ""
            return
        if lt > at:
            yield page[at:lt], "", False, ""
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            if close < 0:
                return
            at = close + 3
            continue
        m = _NAME.match(page, lt)
        if m is None:
            if page[lt + 1 : lt + 2] not in ("!", "?", "/"):
                yield "<", "", False, ""
                at = lt + 1
                continue
            close = page.find(">", lt)
        else:
            close = _tag_end(page, m.end())
        if close < 0:
            return
        at = close + 1
        if m is None:
            continue
        tag, attributes = m[1].lower(), page[m.end() : close]
        if tag in SKIPPED and page[lt + 1] != "/" and not (tag == "svg" and attributes.endswith("/")):
            own = ends.get(tag, ())
            k = bisect_left(own, at)
            if k < len(own):
                close = page.find(">", own[k])
                at = close + 1 if close >= 0 else n
            elif tag in RAW:
                return
            yield " ", "", False, ""
        else:
            yield "", tag, page[lt + 1] == "/", attributes


def parse(page: str | None) -> list[Block]:
    """Blocks of a page in document order; the first is the root, which has no text of its own."""
    root = Block("html", None, 0)
    blocks, top, runs = [root], root, 0
    inside = False  # of a link
    opened: dict[str, int] = {}

    def child(parent: Block, tag: str, tokens: int = 0) -> Block:
        if parent.texts:  # what came before the first child is a block too
            texts, parent.texts, links, parent.links = parent.texts, [], parent.links, 0
            first = child(parent, "")
            first.texts, first.links = texts, links
        node = Block(tag, parent, tokens)
        parent.children.append(node)
        blocks.append(node)
        return node

    def flush(block: Block) -> None:
        nonlocal runs
        if block.parts:
            text, links = " ".join(_html.unescape("".join(block.parts)).split()), block.linked
            block.parts, block.linked = [], 0
            if text:
                owner = child(block, "") if block is root or block.children else block
                owner.texts.append((runs, text))
                owner.links += links
                runs += 1

    def leave(block: Block) -> Block:
        if block.parent is None:
            return block
        opened[block.tag] -= 1
        return block.parent

    for text, tag, is_end, attributes in scan(page or ""):
        if not tag:
            top.linked += len(text) if inside else 0
            top.parts.append(text)
        elif tag not in BLOCKS:
            if tag == "br":
                top.parts.append(" ")
            elif tag == "a":
                inside = not is_end
        else:
            flush(top)
            inside = False
            if is_end:
                if opened.get(tag):
                    while top.tag != tag:
                        top = leave(top)
                    top = leave(top)
            elif tag in ("html", "body") and top is root:
                root.tokens |= _tokens(attributes)
            else:
                while top is not root and (top.tag in CLOSES.get(tag, ()) or top.tag == "p" or (top.tag[0] == "h" and len(top.tag) == 2)):
                    top = leave(top)
                if tag != "hr":
                    top = child(top, tag, _tokens(attributes) if attributes else 0)
                    opened[tag] = opened.get(tag, 0) + 1
    flush(top)
    for k in range(len(blocks) - 1, -1, -1):
        b = blocks[k]
        b.size += sum(len(t) for _, t in b.texts)
        b.words += sum(t.count(" ") + 1 for _, t in b.texts)
        b.end = max(b.end, k + 1)
        if b.parent is not None:
            b.parent.size += b.size
            b.parent.words += b.words
            b.parent.links += b.links
            b.parent.end = max(b.parent.end, b.end)
        tags: dict[str, int] = {}
        for c in b.children:
            tags[c.tag] = tags.get(c.tag, 0) + 1
        for c in b.children:
            c.same = tags[c.tag]
    return blocks


def features(blocks: list[Block], bits: list[int] = ()) -> list[tuple]:
    """One row of numbers for each block, with the given token bits (from TOKEN_BITS on: of its ancestors) last."""
    total = max(1, blocks[0].size)
    count = len(blocks)
    rows = []
    for k, b in enumerate(blocks):
        p = b.parent
        own = sum(len(t) for _, t in b.texts)
        marks = sum(t.count(".") + t.count(",") + t.count("!") + t.count("?") for _, t in b.texts)
        below = b.end - k
        mask = masks_of(b) if bits else 0
        rows.append((
            _GROUP.get(b.tag, -1), _GROUP.get(p.tag, -1) if p else -1, b.depth, b.index, len(p.children) - b.index - 1 if p else 0, len(b.children), b.same,
            below, math.log1p(own), math.log1p(b.size), b.size / total, b.links / max(1, b.size), b.size / below, marks / max(1, own),
            b.size / max(1, b.words), k / count, math.log1p(p.size) if p else 0, p.links / max(1, p.size) if p else 0, b.tag == "h1",
            *((mask >> j) & 1 for j in bits),
        ))
    return rows


def masks_of(b: Block) -> int:
    return b.tokens | b.inherited << TOKEN_BITS


def token_matrix(masks: list[int]) -> np.ndarray:
    """Rows of 2 * TOKEN_BITS zeros and ones."""
    raw = b"".join(m.to_bytes(TOKEN_BITS // 4, "little") for m in masks)
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(masks), -1), axis=1, bitorder="little")


class BoostedTrees:
    """Logistic gradient boosting on binned numbers and on token bits; complete binary trees in arrays."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE):
        self.n, self.depth, self.bins, self.rate = trees, depth, bins, rate

    def fit(self, x: np.ndarray, tokens: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """x: numbers, tokens: zeros and ones; `bits` names the token columns that the trees ask for, which follow x."""
        width = x.shape[1]
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(width)]
        b = np.stack([np.searchsorted(self.cuts[j], x[:, j], side="left") for j in range(width)], 1)
        some = np.flatnonzero((tokens.sum(0) >= 5) & (tokens.sum(0) <= len(y) - 5))
        bits = tokens[:, some].astype(np.float32)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        z = np.full(len(y), self.base)
        inner, leaves = (1 << self.depth) - 1, 1 << self.depth
        self.feature, self.cut, self.value = np.zeros((self.n, inner), np.int64), np.full((self.n, inner), np.inf), np.zeros((self.n, leaves))
        for t in range(self.n):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, wide = (1 << level) - 1, 1 << level
                best, choice = np.full(wide, 1e-9), [None] * wide
                slot = node - first
                for j in range(width):
                    m = len(self.cuts[j]) + 1
                    if m == 1:
                        continue
                    key = slot * m + b[:, j]
                    sg = np.bincount(key, g, wide * m).reshape(wide, m).cumsum(1)
                    sh = np.bincount(key, h, wide * m).reshape(wide, m).cumsum(1)
                    gain = _gain(sg[:, :-1], sh[:, :-1], sg[:, -1:], sh[:, -1:])
                    top = gain.argmax(1)
                    for s in range(wide):
                        if gain[s, top[s]] > best[s]:
                            best[s], choice[s] = gain[s, top[s]], (j, int(top[s]))
                if len(some):
                    at = np.zeros((wide, len(y)), np.float32)
                    at[slot, np.arange(len(y))] = 1
                    ga, ha = np.bincount(slot, g, wide)[:, None], np.bincount(slot, h, wide)[:, None]
                    gain = _gain(ga - (at * g.astype(np.float32)) @ bits, ha - (at * h.astype(np.float32)) @ bits, ga, ha)
                    top = gain.argmax(1)
                    for s in range(wide):
                        if gain[s, top[s]] > best[s] + 1e-3:
                            best[s], choice[s] = gain[s, top[s]], (width + int(some[top[s]]), 0)
                right = np.zeros(len(y), bool)
                for s, c in enumerate(choice):
                    if c is not None:
                        is_number = c[0] < width
                        self.feature[t, first + s], self.cut[t, first + s] = c[0], self.cuts[c[0]][c[1]] if is_number else 0.5
                        right |= (slot == s) & (b[:, c[0]] > c[1] if is_number else tokens[:, c[0] - width] == 1)
                node = 2 * node + 1 + right
            leaf = node - inner
            self.value[t] = self.rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + 1)
            z += self.value[t][leaf]
        self.bits = sorted(set((self.feature[self.feature >= width] - width).tolist()))
        for k, j in enumerate(self.bits):
            self.feature[self.feature == width + j] = -1 - k
        self.feature = np.where(self.feature < 0, width - 1 - self.feature, self.feature)
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.base), np.arange(len(x))
        for t in range(self.n):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t][node]] > self.cut[t][node])
            z += self.value[t][node - self.feature.shape[1]]
        return z


def _gain(gl: np.ndarray, hl: np.ndarray, ga: np.ndarray, ha: np.ndarray) -> np.ndarray:
    """What a split gains, from gradients and curvatures on its left and in all."""
    return gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)


def decode(blocks: list[Block], odds: np.ndarray) -> list[bool]:
    """The likeliest choice in which no block is kept below a dropped one (the root, which has no text, is always kept)."""
    drop = -np.logaddexp(0, odds)
    gain = [0.0] * len(blocks)  # of keeping, against dropping, the block and the best below it
    kept_at = -np.logaddexp(0, -odds)
    place = {id(b): k for k, b in enumerate(blocks)}
    for k in range(len(blocks) - 1, -1, -1):
        gain[k] += float(kept_at[k] - drop[k])
        p = blocks[k].parent
        if p is not None and gain[k] > 0:
            gain[place[id(p)]] += gain[k]
    keep = [False] * len(blocks)
    for k, b in enumerate(blocks):
        keep[k] = b.parent is None or (keep[place[id(b.parent)]] and gain[k] > 0)
    return keep


def main_text(blocks: list[Block], keep: list[bool]) -> str:
    return "\n\n".join(t for _, t in sorted(x for b, ok in zip(blocks, keep, strict=True) if ok for x in b.texts))


def generated_page(rng: random.Random) -> tuple[str, set[str]]:
    """A page of a random layout, and its main blocks."""
    made = [0]

    def words(n: int) -> str:
        out = []
        for _ in range(n):
            made[0] += 1
            out.append("".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))))
        return " ".join(out)

    def sentence(lo: int = 4, hi: int = 20) -> str:
        return words(rng.randint(lo, hi)).capitalize() + rng.choice(["."] * 8 + ["", "!", "?"])

    def prose(lo: int, hi: int) -> str:
        return " ".join(sentence() for _ in range(rng.randint(lo, hi)))

    main: set[str] = set()

    def keep(text: str) -> str:
        main.add(" ".join(text.split()))
        return text

    def links(n: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{words(1)}">{words(rng.randint(1, 3))}</a></{tag}>' for _ in range(n))

    def attr(*names: str) -> str:
        if rng.random() < 0.25:
            return f' class="{words(1)}"' if rng.random() < 0.4 else ""
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}{rng.choice(["", "-box", " wide", "-" + str(rng.randint(1, 99))])}"'

    def side_note() -> str:
        kind = rng.randrange(7)
        if kind == 0:
            return f'<div class="{rng.choice(["ad", "ads", "advert", "sponsored", "promo"])}">{prose(1, 3)}</div>'
        if kind == 1:
            return f'<div{attr("cookie-notice", "consent", "gdpr notice", "alert")}><p>{prose(1, 2)}</p><button>{words(1)}</button></div>'
        if kind == 2:
            return f'<form action="/s"{attr("search", "newsletter", "subscribe")}><p>{sentence()}</p><label>{words(2)}</label><input name="q"></form>'
        if kind == 3:
            return f'<div class="{rng.choice(["share", "social", "share-links"])}">{links(rng.randint(2, 5), "span")}</div>'
        if kind == 4:
            return f'<aside{attr("sidebar", "related", "widget")}><h3>{words(2)}</h3><ul>{links(rng.randint(2, 8))}</ul></aside>'
        if kind == 5:
            return f'<div class="{rng.choice(["related", "sidebar widget", "trending"])}"><h3>{words(2)}</h3>' + "".join(f"<p>{sentence()}</p>" for _ in range(rng.randint(1, 4))) + "</div>"
        return f'<div class="breadcrumbs">{links(3, "span")}</div>'

    def body() -> str:
        head = words(rng.randint(3, 10)).capitalize()
        out = [f"<h1>{keep(head)}</h1>"] if rng.random() < 0.8 else []
        if rng.random() < 0.25:  # an article of one word or sentence
            short = keep(words(1).capitalize() + "." if rng.random() < 0.4 else prose(1, 2))
            return "".join(out) + rng.choice(("<p><b>{}<br>", "<p>{}</p>", "<p>{}<br></p>")).format(short)
        if rng.random() < 0.08:  # text beside elements
            return "".join(out) + "<hr>".join(keep(prose(1, 8)) for _ in range(rng.randint(1, 3)))
        for _ in range(rng.randint(1, 14)):
            kind = rng.random()
            if kind < 0.7:
                text = prose(1, rng.choice((1, 2, 5, 12)))
                if rng.random() < 0.1:
                    text = words(1).capitalize() + "."
                keep(text)
                if rng.random() < 0.2:
                    first, _, rest = text.partition(" ")
                    text = f'<a href="/x">{first}</a> {rest}'
                out.append(rng.choice((f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}<br>", f"<p><b>{text}<br>", f"<div>{text}</div>" if rng.random() < 0.5 else f"<p>{text}")))
            elif kind < 0.78:
                out.append(f"<h2>{keep(words(rng.randint(1, 6)).capitalize())}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{keep(sentence())}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote><p>{keep(prose(1, 3))}</p></blockquote>")
            elif kind < 0.94:
                out.append("<table>" + "".join(f"<tr><td>{keep(words(2))}</td><td>{keep(words(3))}</td></tr>" for _ in range(rng.randint(2, 4))) + "</table>")
            else:
                out.append(side_note())
        return "".join(out)

    def comments() -> str:
        one = lambda: f'<{item}{attr("comment", "reply", "comment-body")}><p>{prose(1, 4)}</p></{item}>'
        item = rng.choice(("li", "div"))
        inner = "".join(one() for _ in range(rng.randint(1, 6)))
        return f'<{rng.choice(("section", "div"))} class="{rng.choice(("comments", "comment-list", "discussion", "respond"))}"><h3>{words(2)}</h3>{"<ol>" + inner + "</ol>" if item == "li" else inner}</{"section"}>'

    nav = rng.choice((
        lambda: f'<nav><ul>{links(rng.randint(3, 9))}</ul></nav>', lambda: f'<div{attr("menu", "nav", "navbar")}><ul>{links(rng.randint(3, 9))}</ul></div>',
        lambda: rng.choice((" | ", " &middot; ", " ")).join(rng.choice((words(1).capitalize(), f'<a href="/{words(1)}">{words(1)}</a>')) for _ in range(rng.randint(2, 7))),
        lambda: f'<div class="{rng.choice(("menu", "nav", "navbar", "topbar"))}">{words(rng.randint(2, 6))}</div>',
        lambda: f'<header{attr("masthead", "site-header")}><p>{words(3)}</p><nav>{links(5, "span")}</nav></header>', lambda: f'<div class="header"><div>{words(3)}</div><ul>{links(5)}</ul></div>',
    ))()
    wrap = rng.choice((
        ("<article>", "</article>"), ("<main><article>", "</article></main>"), ('<div id="content">', "</div>"), ('<div class="post-body">', "</div>"),
        ("<section><div>", "</div></section>"), ('<div class="wrap"><div class="entry">', "</div></div>"), ("<main>", "</main>"), ("<div>", "</div>"),
    ))
    foot = rng.choice((
        lambda: f"<footer>&copy; {words(2)} &middot; {sentence()}</footer>", lambda: f'<footer><p>{sentence()}</p><ul>{links(4)}</ul></footer>', lambda: f'<div class="footer">{prose(1, 2)}</div>',
        lambda: f"&copy; {words(2)} {rng.randint(1990, 2030)}", lambda: "",
    ))()
    before, after = [side_note() for _ in range(rng.choice((0, 1, 1, 2)))], [side_note() for _ in range(rng.choice((0, 0, 1, 2)))]
    if rng.random() < 0.45:
        after.append(comments())
    shape = rng.random()
    if shape < 0.08:  # no element at all, or paragraphs alone
        return keep(prose(1, 12)) if shape < 0.05 else "".join(f"<p>{keep(prose(1, 5))}</p>" for _ in range(rng.randint(1, 5))), main
    if shape < 0.11:  # a notice, a menu or a footer alone
        return f"<html><body>{rng.choice((side_note(), nav, foot))}</body></html>", main
    text = wrap[0] + body() + wrap[1] if shape > 0.16 else ""  # or a page without an article
    return (
        f"<!DOCTYPE html><html><head><title>{words(3)}</title><style>p{{}}</style></head><body>{nav}<!-- {words(2)} -->{''.join(before)}{text}{''.join(after)}{foot}<script>f('</p>')</script></body></html>",
        main,
    )


def labelled_blocks(page: str, main: set[str]) -> tuple[list[Block], np.ndarray]:
    """Blocks of a generated page, and whether main text lies in or below each."""
    blocks = parse(page)
    place = {id(b): k for k, b in enumerate(blocks)}
    y = np.zeros(len(blocks))
    for k in range(len(blocks) - 1, -1, -1):
        if any(t in main for _, t in blocks[k].texts):
            y[k] = 1
        if y[k] and blocks[k].parent is not None:
            y[place[id(blocks[k].parent)]] = 1
    return blocks, y


def train(pages: int = PAGES, seed: int = SEED) -> BoostedTrees:
    rng = random.Random(seed)
    rows, masks, labels = [], [], []
    for _ in range(pages):
        blocks, y = labelled_blocks(*generated_page(rng))
        rows += features(blocks)
        masks += map(masks_of, blocks)
        labels.append(y)
    return BoostedTrees().fit(np.array(rows, float), token_matrix(masks), np.concatenate(labels))


def extract_texts(model: BoostedTrees, pages: list[str | None]) -> list[str]:
    parsed = [parse(p) for p in pages]
    odds = model.log_odds(np.array([r for blocks in parsed for r in features(blocks, model.bits)], float))
    at, out = 0, []
    for blocks in parsed:
        out.append(main_text(blocks, decode(blocks, odds[at : at + len(blocks)])))
        at += len(blocks)
    return out


def extract(pages: DataFrame, model: BoostedTrees | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())
    kinds = dict(pages.dtypes)

    def read(batches):
        for batch in batches:
            sources = batch.column(2).to_pylist()
            for lo, hi in chunks(sources, lambda p: len(p or ""), 1_000_000):
                texts = extract_texts(shared.value, sources[lo:hi])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
