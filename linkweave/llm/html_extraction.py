"""HTML main-text extraction: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between the tags of block-level elements, each with the tags and class
words of its ancestors. Features of a block are its ancestors, its own element, and its text (length, share of linked
characters, punctuation, notices' words). The chain has two labels, main text and rest; its weights are fitted by
gradient ascent on the conditional likelihood of labelled pages, and a page is decoded by Viterbi.

The labelled pages are drawn from the templates below: articles of invented words in the containers that pages use, in
plain divs, in cells of a table, or in none, inside the kinds of frames that pages have (menus, headers, footers,
sidebars, notices, adverts, forms, comments), with each block's label known.

Contents of script, style, template, iframe and textarea, what an attribute or a style keeps from being shown, comments
and markup are never blocks. Character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined by one newline in page order; nothing else is dropped or cut.

Edge cases: null and empty html have no blocks and give an empty text. Malformed markup is read as far as it goes, in
time proportional to its length: once a tag finds no end, quotes count for nothing in the tags after it, and a tag
without a > is text. Repeated rows each get their text; other columns don't matter.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose tags end a block, elements without an end tag, elements whose content isn't text of the page.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW_TAGS = frozenset("script style template iframe textarea".split())
HEAD_TAGS = frozenset(("head", "title"))
# An element that these open inside of the other ends it.
CLOSES = {"p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",))}
# Words of class, id and role attributes, and words of notices, that features know.
CLASS_WORDS = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs byline caption comment comments content cookie copyright disqus entry foot footer form head header login main masthead menu meta modal nav navbar navigation newsletter notice pagination popup post promo related reply respond search share sidebar signup social sponsor sponsored story subscribe tags toolbar widget article body consent alert".split())
NOTICES = re.compile(r"\b(?:cookies?|copyright|all rights reserved|subscribe|sign ?up|log ?in|newsletter|advertisement|sponsored|share this|related|read more|comments?|reply|privacy|terms)\b|©", re.I)
#: Ancestors that features know, and those that pages use around their main text.
PATH_TAGS = BLOCK_TAGS | {"a", "b", "strong", "em", "i", "span", "label", "noscript"}
MAIN_TAGS, MAIN_WORDS = frozenset(("article", "main")), frozenset("article body content entry main post story".split())

# Possessive: a tag that has no end is given up at once. A quote counts after an equals sign only.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_NO_DISPLAY = re.compile(r"display\s*+:\s*+none", re.I)
_WORDS, _SPACE = re.compile("[a-z]+"), re.compile(r"\s+")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in RAW_TAGS}


def attributes(raw: str) -> tuple[bool, frozenset[str]]:
    """Whether a tag's attributes hide its element (hidden, or a style without display), and the words of its class, id
    and role that features know."""
    hides, words = False, set()
    for name, *values in _ATTRIBUTE.findall(raw):
        name = name.lower()
        if name in ("class", "id", "role"):
            words |= CLASS_WORDS.intersection(_WORDS.findall("".join(values).lower()))
        elif name == "hidden" or name == "style" and _NO_DISPLAY.search("".join(values)):
            hides = True
    return hides, frozenset(words)


_NONE = (False, frozenset())


class Block:
    __slots__ = ("linked", "own", "path", "text", "words")

    def __init__(self, text: str, linked: int, own: str, path: tuple[str, ...], words: tuple[str, ...]):
        self.text, self.linked, self.own, self.path, self.words = text, linked, own, path, words


class _Page:
    """The open elements, and the blocks that they have given. Each element is opened and closed once, whatever the depth."""

    def __init__(self):
        self.out: list[Block] = []
        self.stack: list[tuple[str, frozenset[str]]] = []
        self.block_at: list[int] = []  # places of block-level elements in the stack
        self.hidden: list[int] = []
        self.tags: Counter[str] = Counter()
        self.words: Counter[str] = Counter()
        self.parts: list[str] = []
        self.linked = 0
        self.context: tuple[str, tuple[str, ...], tuple[str, ...]] | None = None

    def text(self, raw: str) -> None:
        if not self.hidden:
            text = entities.unescape(raw)
            self.parts.append(text)
            if self.tags["a"]:
                self.linked += len(text.strip())

    def flush(self) -> None:
        if not self.parts:
            return
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            if self.context is None:
                own = self.stack[self.block_at[-1]][0] if self.block_at else "-"
                self.context = own, tuple(sorted(PATH_TAGS.intersection(self.tags))), tuple(sorted(self.words))
            self.out.append(Block(text, self.linked, *self.context))
        self.parts.clear()
        self.linked = 0

    def open(self, name: str, hides: bool, words: frozenset[str]) -> None:
        if name in CLOSES and self.block_at and self.stack[self.block_at[-1]][0] in CLOSES[name]:
            self.cut(self.block_at[-1])
        if name in HEAD_TAGS or hides:
            self.hidden.append(len(self.stack))
        if name in BLOCK_TAGS:
            self.block_at.append(len(self.stack))
        self.stack.append((name, words))
        self.tags[name] += 1
        self.words.update(words)
        self.context = None
        if name == "body":
            self.hidden.clear()

    def close(self, name: str) -> None:
        if self.tags[name]:
            k = len(self.stack) - 1
            while self.stack[k][0] != name:
                k -= 1
            self.cut(k)
        else:
            del self.tags[name]

    def cut(self, k: int) -> None:
        """Closes the elements from the k-th on."""
        for name, words in self.stack[k:]:
            self.tags[name] -= 1
            if not self.tags[name]:
                del self.tags[name]
            for w in words:
                self.words[w] -= 1
                if not self.words[w]:
                    del self.words[w]
        del self.stack[k:]
        while self.block_at and self.block_at[-1] >= k:
            self.block_at.pop()
        while self.hidden and self.hidden[-1] >= k:
            self.hidden.pop()
        self.context = None


def blocks(html: str) -> list[Block]:
    """The leaf blocks of a page, in order."""
    page, at, size, tag = _Page(), 0, len(html), _TAG
    while at < size:
        less = html.find("<", at)
        if less != at:
            less = size if less < 0 else less
            page.text(html[at:less])
            at = less
            continue
        after = html[at + 1 : at + 2]
        if after in ("!", "?"):
            ends = "-->" if html.startswith("<!--", at) else "]]>" if html.startswith("<![CDATA[", at) else ">"
            found = html.find(ends, at + 2)
            at = size if found < 0 else found + len(ends)
            continue
        m = tag.match(html, at)
        if m is None and (after == "/" or after.isalpha()) and _PLAIN_TAG.match(html, at):
            tag = _PLAIN_TAG
            m = tag.match(html, at)
        if m is None:
            if html.find(">", at) < 0:
                page.text(html[at:])
                break
            page.text("<")
            at += 1
            continue
        at, name = m.end(), m[2].lower()
        if name in RAW_TAGS:
            if not m[1]:
                found = _ENDS[name].search(html, at)
                at = found.end() if found else size
            continue
        if name == "br":
            if not page.hidden:
                page.parts.append(" ")
            continue
        if name in BLOCK_TAGS and not page.hidden:
            page.flush()
        if m[1]:
            page.close(name)
        elif name not in VOID_TAGS:
            page.open(name, *(attributes(m[3]) if m[3] else _NONE))
    if not page.hidden:
        page.flush()
    return page.out


def features(page: list[Block]) -> list[list[str]]:
    out = []
    inside = [not MAIN_TAGS.isdisjoint(b.path) or not MAIN_WORDS.isdisjoint(b.words) for b in page]
    marked = any(inside)
    for i, b in enumerate(page):
        size = len(b.text)
        linked = int(4 * min(1.0, b.linked / size))
        f = ["bias", f"own:{b.own}", f"size:{min(8, size.bit_length())}", f"linked:{linked}", f"linked:{linked} own:{b.own}"]
        f += [f"in:{t}" for t in b.path if t not in ("html", "body")]
        f += [f"word:{w}" for w in b.words]
        f += [f"stops:{min(3, sum(b.text.count(c) for c in '.!?,'))}", f"ends:{b.text[-1] in '.!?'}"]
        f.append(f"main:{'in' if inside[i] else 'out' if marked else 'none'}")
        if size < 200 and NOTICES.search(b.text):
            f.append("notice")
        if i == 0:
            f.append("first")
        if i == len(page) - 1:
            f.append("last")
        out.append(f)
    return out


SYLLABLES = ("an", "er", "th", "in", "on", "re", "ti", "es", "or", "ea", "ou", "st", "en")


def _prose(r: random.Random, n: int) -> str:
    words = ["".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(n)]
    for k in range(0, n, r.randint(6, 14)):
        words[k] = words[k].capitalize()
        words[k - 1] += r.choice((".", ".", ",", "!", "?"))
    return " ".join(words)


#: Containers that say nothing of what they hold: none, divs, a table's cell.
PLAIN_CONTAINERS = ("", "", "div", "div class='x7'", "div id='wrap'>div", "div>div>div", "center", "table>tr>td", "section")


def labelled_page(seed: int) -> tuple[str, list[bool]]:
    """A page of the templates, and whether each of its blocks is main text."""
    r = random.Random(seed)
    out = ["<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>"]

    def put(text: str, main: bool) -> str:
        return ("\x02" if main else "\x01") + text

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{put(_prose(r, r.randint(1, 3)), False)}</a></li>' for k in range(n))

    def rest(kind: str) -> str:
        if kind == "menu":
            body = f"<ul>{links(r.randint(2, 8))}</ul>"
            plain = " | ".join(f'<a href="/{k}">{_prose(r, r.randint(1, 3))}</a>' for k in range(r.randint(1, 6)))
            bare = r.choice((f"<ul>{links(r.randint(2, 8))}</ul>", f"<div>{put(plain, False)}</div>", f"<p>{put(plain, False)}</p>", f"<table><tr><td>{put(plain, False)}</td></tr></table>"))
            return r.choice((bare, bare, f"<nav>{body}</nav>", f'<div class="{r.choice(("menu", "navbar", "navigation", "breadcrumb"))}">{body}</div>', f'<header><nav>{body}</nav></header>'))
        if kind == "header":
            return r.choice((f"<header>{put(_prose(r, r.randint(1, 6)), False)}</header>", f'<div id="{r.choice(("header", "masthead", "banner"))}"><p>{put(_prose(r, r.randint(1, 9)), False)}</p></div>'))
        if kind == "ad":
            return f'<{(t := r.choice(("div", "section", "aside")))} class="{r.choice(("ad", "ads", "advert", "sponsored", "promo", "banner ad"))}">{put(_prose(r, r.randint(2, 25)), False)}</{t}>'
        if kind == "side":
            inner = "".join(f"<p>{put(_prose(r, r.randint(3, 40)), False)}</p>" for _ in range(r.randint(1, 3)))
            return r.choice((f"<aside>{inner}<ul>{links(2)}</ul></aside>", f'<div class="{r.choice(("sidebar", "widget", "related"))}">{inner}</div>'))
        if kind == "notice":
            text = r.choice(("We use cookies on this site. ", "Accept all cookies. ", "Subscribe to our newsletter. ", "Please log in. ", "")) + _prose(r, r.randint(1, 12))
            return f'<div class="{r.choice(("cookie", "notice", "consent", "popup", "newsletter", "modal", "alert", "subscribe"))}"><p>{put(text, False)}</p></div>'
        if kind == "form":
            return f'<form action="/f"><label>{put(_prose(r, r.randint(1, 4)), False)}</label><input type="text"><button>{put(_prose(r, 1), False)}</button></form>'
        if kind == "comments":
            marked = r.choice((' class="comment"', ""))
            inner = "".join(f'<{(t := r.choice(("p", "div", "li")))}{marked}>{put(_prose(r, r.choice((1, 2, 5, 15, 50))), False)}</{t}>' for _ in range(r.randint(1, 5)))
            top = f'<h3>{put("Comments", False)}</h3>' * r.randint(0, 1)
            return f'<{(t := r.choice(("section", "div", "ol")))} {r.choice(("class", "id"))}="{r.choice(("comments", "comments", "comment", "disqus", "respond", "reply"))}">{top}{inner}</{t}>'
        text = r.choice(("&copy; ", "Copyright ", "")) + _prose(r, r.randint(2, 15))
        return r.choice((f"<footer>{put(text, False)}</footer>", f"<footer><p>{put(text, False)}</p></footer>", f'<div class="footer">{put(text, False)}</div>'))

    if r.random() < 0.1:  # a page that is nothing but its text
        few = [put(_prose(r, r.choice((2, 8, 20, 60))), True) for _ in range(r.randint(1, 3))]
        shape = r.choice(("<p>{}</p>", "<p>{}", "<div>{}</div>", "<td>{}</td>", "<article>{}</article>"))
        return _unmarked("".join(map(shape.format, few)) if len(few) > 1 or r.random() < 0.5 else few[0])
    for kind in r.sample(("menu", "header", "ad", "notice", "form", "side"), r.choice((0, 1, 1, 2, 3, 4))):
        out.append(rest(kind))
    container = r.choice(("article", "article", "article", "main", "div class='content'", "div class='post entry'", "div class='article body'", "section id='main'", "div class='story'", *PLAIN_CONTAINERS))
    opened = [x.split()[0] for x in container.split(">") if x]
    out += [f"<{x}>" for x in container.split(">") if x]
    paragraph = r.choice(("p", "p", "p", "p", "div"))
    if not container and r.random() < 0.3:  # a text between line breaks
        out.append(put("<br><br>".join(_prose(r, r.choice((8, 20, 60))) for _ in range(r.randint(1, 4))), True))
    out.append(f"<h1>{put(_prose(r, r.randint(2, 12)), True)}</h1>" * (r.random() < 0.8))
    for _ in range(r.randint(1, 12)):
        n = r.choice((1, 3, 8, 20, 60, 120))
        open_b = r.random() < 0.15
        kind = r.random()
        if kind < 0.1:  # an article may use the words of notices
            out.append(f"<p>{put(r.choice(('All rights reserved.', 'Released under a license.', 'Comments on terms and privacy: ', 'Subscribe. ')) + _prose(r, r.randint(1, 5)) * r.randint(0, 1), True)}</p>")
        elif kind < 0.75:
            if paragraph == "p" and open_b:
                out.append(f"<p><b>{put(_prose(r, n), True)}<br>")
            else:
                out.append(f"<{paragraph}>{put(_prose(r, n), True)}</{paragraph}>")
        elif kind < 0.85:
            out.append(f"<h2>{put(_prose(r, r.randint(1, 6)), True)}</h2>")
        elif kind < 0.9:
            out.append("<ul>" + "".join(f"<li>{put(_prose(r, r.randint(2, 20)), True)}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
        elif kind < 0.95:
            cells = "".join(f"<tr><td>{put(_prose(r, r.randint(1, 6)), True)}</td><td>{put(_prose(r, r.randint(1, 9)), True)}</td></tr>" for _ in range(r.randint(1, 3)))
            out.append(r.choice((f"<blockquote><p>{put(_prose(r, n), True)}</p></blockquote>", f"<table>{cells}</table>", f"<figure><figcaption>{put(_prose(r, r.randint(2, 12)), True)}</figcaption></figure>", f"<pre>{put(_prose(r, n), True)}</pre>")))
        else:
            out.append(f"<p>{put(_prose(r, n), True)} <a href='/x'>{_prose(r, 2)}</a></p>")
        if r.random() < 0.08 and container:
            out.append(rest(r.choice(("ad", "notice", "form", "side"))))
    out += [f"</{x}>" for x in reversed(opened)]
    for kind in r.sample(("menu", "ad", "side", "form", "notice"), r.randint(0, 2)) + ["comments"] * r.randint(0, 1):
        out.append(rest(kind))
    out.append(rest("footer") * (r.random() < 0.8) + "</body></html>")
    return _unmarked("".join(out))


def _unmarked(page: str) -> tuple[str, list[bool]]:
    return re.sub("[\x01\x02]", "", page), [c == "\x02" for c in page if c in "\x01\x02"]


def _add(x: np.ndarray, axis: int) -> np.ndarray:
    """The logarithm of the sum of two exponentials along an axis of two."""
    return np.logaddexp(x.take(0, axis), x.take(1, axis))


class Labelled:
    """Pages of known labels as arrays: each block's features one after another, and blocks by page and place."""

    def __init__(self, rows: list[list[list[int]]], gold: list[list[int]]):
        sizes = np.array([len(r) for r in rows])
        self.last, self.steps = sizes - 1, int(sizes.max())
        self.on = np.arange(self.steps) < sizes[:, None]
        self.many = np.array([len(f) for r in rows for f in r])
        self.flat = np.array([x for r in rows for f in r for x in f])
        self.start = np.cumsum(self.many) - self.many
        self.gold = np.zeros(self.on.shape, np.int64)
        self.gold[self.on] = [y for page in gold for y in page]

    def likelihood(self, weights: np.ndarray, steps: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The logarithm of all pages' labels' probability, and its gradients."""
        n, t = self.on.shape
        s = np.zeros((n, t, 2))
        s[self.on] = np.add.reduceat(weights[self.flat], self.start, axis=0)
        fwd, bwd = s.copy(), np.zeros((n, t, 2))
        for i in range(1, t):
            fwd[:, i] += _add(fwd[:, i - 1, :, None] + steps, 1)
        for i in range(t - 2, -1, -1):
            bwd[:, i] = np.where(self.on[:, i + 1, None], _add(steps + (s[:, i + 1] + bwd[:, i + 1])[:, None, :], 2), 0.0)
        total = _add(fwd[np.arange(n), self.last], 1)
        p = np.exp(fwd + bwd - total[:, None, None])
        left = (np.eye(2)[self.gold] - p)[self.on]
        by_feature = np.stack([np.bincount(self.flat, np.repeat(left[:, k], self.many), len(weights)) for k in range(2)], axis=1)
        both = self.on[:, 1:]
        pairs = np.exp(fwd[:, :-1, :, None] + steps + (s[:, 1:] + bwd[:, 1:])[:, :, None, :] - total[:, None, None, None])[both].sum(axis=0)
        held = np.bincount((2 * self.gold[:, :-1] + self.gold[:, 1:])[both], minlength=4).reshape(2, 2)
        value = (np.take_along_axis(s, self.gold[:, :, None], 2)[:, :, 0] * self.on).sum() + (held * steps).sum() - total.sum()
        return float(value), by_feature, held - pairs


class Chain:
    """Two labels: 0 the rest, 1 main text."""

    def __init__(self, names: list[str]):
        self.index = {n: i for i, n in enumerate(names)}
        self.weights = np.zeros((len(names), 2))
        self.steps = np.zeros((2, 2))

    def rows(self, feats: list[list[str]]) -> list[list[int]]:
        return [[self.index[f] for f in fs if f in self.index] for fs in feats]

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[r].sum(axis=0) for r in rows]).reshape(-1, 2)

    def decode(self, feats: list[list[str]]) -> list[int]:
        if not feats:
            return []
        s = self.scores(self.rows(feats)).tolist()
        (aa, ab), (ba, bb) = self.steps.tolist()
        best, back = s[0], []
        for x, y in s[1:]:
            from_a, from_b = best
            back.append((0 if from_a + aa >= from_b + ba else 1, 0 if from_a + ab >= from_b + bb else 1))
            best = [x + max(from_a + aa, from_b + ba), y + max(from_a + ab, from_b + bb)]
        at = int(best[1] > best[0])
        out = [at]
        for b in reversed(back):
            at = b[at]
            out.append(at)
        return out[::-1]


def train(pages: list[tuple[str, list[bool]]], rounds: int = 100, rate: float = 0.1, ridge: float = 0.5) -> Chain:
    """Gradient ascent with steps scaled by each weight's own gradients so far (Adam)."""
    data = [(features(blocks(p)), [int(x) for x in y]) for p, y in pages]
    data = [(f, y) for f, y in data if f and len(f) == len(y)]
    chain = Chain(sorted({x for f, _ in data for fs in f for x in fs}))
    known = Labelled([chain.rows(f) for f, _ in data], [y for _, y in data])
    both = [chain.weights, chain.steps]
    mean, square = [np.zeros_like(w) for w in both], [np.zeros_like(w) for w in both]
    for n in range(1, rounds + 1):
        _, *slopes = known.likelihood(*both)
        for k, (w, slope) in enumerate(zip(both, slopes)):
            slope -= ridge * w
            mean[k] = 0.9 * mean[k] + 0.1 * slope
            square[k] = 0.99 * square[k] + 0.01 * slope**2
            w += rate * (1 - n / (rounds + 1)) * (mean[k] / (1 - 0.9**n)) / (np.sqrt(square[k] / (1 - 0.99**n)) + 1e-8)
    return chain


#: Labelled pages that the chain is fitted to.
TRAINING_PAGES = 900


@lru_cache(maxsize=1)
def default_chain() -> Chain:
    return train([labelled_page(k) for k in range(TRAINING_PAGES)])


def main_text(chain: Chain, page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, y in zip(found, chain.decode(features(found))) if y)


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    chain = chain or default_chain()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [main_text(chain, h) for h in part["html"]]
            yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
