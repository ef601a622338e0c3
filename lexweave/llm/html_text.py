"""HTML extraction: gradient-boosted trees over DOM nodes, decoded over the tree.

A page becomes a tree of its block elements. Each node gets features of its subtree (text, density of
text and of links, tags), attribute tokens, depth and siblings; boosted trees, trained in NumPy on pages
made from random layouts with known main text, give the odds that the node holds main text. A node is
kept only if its parent is: the labelling of highest likelihood under that rule is found by one pass up
the tree, so that no kept block has a dropped ancestor.

The main text is that of the kept blocks in page order: character references decoded, white space inside
a block one blank, trimmed, blocks joined by \\n. Null and empty pages, and pages without text, give
an empty text. Repeated rows are extracted alike; other columns pass through `extract`.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

# HTML's element kinds and words of class names.
BLOCKS = frozenset("html body div p article main section header footer nav aside ul ol li dl dt dd table thead tbody tfoot tr td th caption form fieldset blockquote pre h1 h2 h3 h4 h5 h6 figure figcaption address details summary hr menu dialog center".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style title noscript template svg math iframe object canvas select textarea button audio video".split())
RAW = ("script", "style", "title", "textarea", "noscript", "iframe", "template")
GOOD_WORDS = frozenset("article content post entry main body story text prose page blog news single".split())
BAD_WORDS = frozenset("nav menu navbar navigation footer foot header masthead sidebar side aside ad ads advert advertisement sponsor sponsored promo banner cookie cookies consent notice alert popup modal comment comments respond discussion reply related share sharing social subscribe newsletter signup login search form breadcrumb breadcrumbs pagination pager widget tags meta toolbar skip legal copyright disclaimer".split())
TAG_KINDS = ("p", "li", "div", "section", "article", "main", "header", "footer", "nav", "aside", "form", "table", "td", "ul", "blockquote", "h1", "h2", "h3")
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
N_FEATURES = 24 + len(TAG_KINDS)
TREES, DEPTH, RATE, BINS, LEAST = 40, 3, 0.3, 32, 5
TRAIN_PAGES = 400


class Page:
    """Nodes in page order: parent, tag, attribute words; `parts`: (node, text) in page order, `link` if inside <a>."""

    def __init__(self, source: str):
        self.parent, self.tag, self.words, self.tags_in = [-1], ["#"], [()], [0]
        self.parts: list[tuple[int, str, bool]] = []
        self.stack: list[tuple[str, int]] = [("#", 0)]
        at, links = 0, 0
        while m := _TOKEN.search(source, at):
            if m.start() > at:
                self._text(source[at : m.start()], links)
            at = m.end()
            name = m[2]
            if not name:
                continue
            name = name.lower()
            if m[1]:
                links = max(0, links - (name == "a"))
                self._close(name)
            else:
                self._open(name, m[3])
                links += name == "a"
                if name in _END:
                    end = _END[name].search(source, at)
                    at = end.end() if end else len(source)
                    self._close(name)
        if at < len(source):
            self._text(source[at:], links)

    def _text(self, text: str, links: int) -> None:
        if not any(name in SILENT for name, _ in self.stack):
            self.parts.append((self.stack[-1][1], text, links > 0))

    def _open(self, name: str, attributes: str) -> None:
        if name in CLOSES:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k][0] in HOLDERS[name]:
                    break
                if self.stack[k][0] in CLOSES[name]:
                    del self.stack[k:]
                    break
        elif name in BLOCKS:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k][0] == "p":
                    del self.stack[k:]
                    break
                if self.stack[k][0] in BLOCKS:
                    break
        node = self.stack[-1][1]
        self.tags_in[node] += 1
        if name in BLOCKS:
            words = tuple(w for m in _ATTR.finditer(attributes) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower())) if "=" in attributes else ()
            self.parent.append(node)
            self.tag.append(name)
            self.words.append(words)
            self.tags_in.append(0)
            node = len(self.parent) - 1
        elif name == "br":
            self.parts.append((node, " ", False))
        if name not in VOID and not attributes.endswith("/"):
            self.stack.append((name, node))

    def _close(self, name: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == name:
                del self.stack[k:]
                return

    def features(self) -> np.ndarray:
        n = len(self.parent)
        parent = np.array(self.parent)
        chars, link, sentence, words, tags, upper = (np.zeros(n) for _ in range(6))
        for node, text, linked in self.parts:
            if size := len(text.strip()):
                chars[node] += size
                link[node] += size * linked
                sentence[node] += text.count(". ") + text.count(".\n") + text.count(", ") + text.rstrip().endswith(".")
                words[node] += text.count(" ") + 1
        own = chars.copy()
        tags += self.tags_in
        good = np.array([len(GOOD_WORDS.intersection(w)) for w in self.words], float)
        bad = np.array([len(BAD_WORDS.intersection(w)) for w in self.words], float)
        depth, index, siblings, alike, above_good, above_bad, nodes, in_article, in_bad = (np.zeros(n) for _ in range(9))
        nodes += 1
        count: dict = {}
        seen = np.zeros(n)
        for i in range(1, n):
            p, t = self.parent[i], self.tag[i]
            depth[i] = depth[p] + 1
            above_good[i], above_bad[i] = above_good[p] + good[p], above_bad[p] + bad[p]
            in_article[i] = in_article[p] + (self.tag[p] in ("article", "main"))
            in_bad[i] = in_bad[p] + (self.tag[p] in ("nav", "footer", "aside", "form", "header"))
            index[i] = seen[p]
            seen[p] += 1
            count[p, t] = count.get((p, t), 0) + 1
        for i in range(1, n):
            siblings[i], alike[i] = seen[self.parent[i]], count[self.parent[i], self.tag[i]]
        paragraphs = np.array([t == "p" for t in self.tag], float) * chars
        for i in range(n - 1, 0, -1):
            p = parent[i]
            for x in (chars, link, sentence, words, tags, nodes, paragraphs):
                x[p] += x[i]
        kinds = np.zeros((n, len(TAG_KINDS)))
        for i, t in enumerate(self.tag):
            if t in TAG_KINDS:
                kinds[i, TAG_KINDS.index(t)] = 1
        some = np.maximum(chars, 1)
        columns = [np.log1p(chars), np.log1p(own), link / some, chars / (tags + 1), words / (tags + 1), sentence / np.maximum(words, 1), chars / max(1.0, chars[0]), chars / np.maximum(words, 1), np.log1p(tags), np.log1p(nodes), paragraphs / some, chars / np.maximum(chars[parent], 1)]
        columns += [good, bad, above_good, above_bad, in_article, in_bad, depth, index, siblings, alike, np.arange(n) / n, seen]
        return np.concatenate([np.stack(columns, 1), kinds], 1)

    def kept(self, odds: np.ndarray) -> np.ndarray:
        """The most likely labelling in which each kept node's parent is kept; the root is."""
        yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        keep, drop = yes.copy(), no.copy()
        for i in range(len(odds) - 1, 0, -1):
            p = self.parent[i]
            keep[p] += max(keep[i], drop[i])
            drop[p] += drop[i]
        out = np.ones(len(odds), bool)
        for i in range(1, len(odds)):
            out[i] = out[self.parent[i]] and keep[i] > drop[i]
        return out

    def text(self, kept: np.ndarray) -> str:
        blocks, held, last = [], [], None
        for node, text, _ in [*self.parts, (None, "", False)]:
            if node != last:
                if held and (block := _SPACE.sub(" ", html.unescape("".join(held))).strip()):
                    blocks.append(block)
                held, last = [], node
            if node is not None and kept[node]:
                held.append(text)
        return "\n".join(blocks)


class Boosted:
    """Regression trees of fixed depth on binned features, boosted on the log loss."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        share = y.mean()
        self.base = float(np.log(share / (1 - share)))
        odds, self.trees = np.full(len(y), self.base), []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-odds))
            grad, hess = y - p, p * (1 - p)
            feature, cut, at = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf), np.zeros(len(y), np.int64)
            for node in range(2**DEPTH - 1):
                own = np.flatnonzero(at == node)
                best = 1e-6
                for f in range(x.shape[1]) if len(own) >= 2 * LEAST else ():
                    b = binned[own, f]
                    g, h, c = (np.cumsum(np.bincount(b, w, BINS)) for w in (grad[own], hess[own], None))
                    right_g, right_h = g[-1] - g, h[-1] - h
                    gain = g**2 / (h + 1) + right_g**2 / (right_h + 1) - g[-1] ** 2 / (h[-1] + 1)
                    gain[(c < LEAST) | (len(own) - c < LEAST)] = 0
                    k = int(gain[: len(self.cuts[f])].argmax()) if len(self.cuts[f]) else 0
                    if len(self.cuts[f]) and gain[k] > best:
                        best, feature[node], cut[node] = gain[k], f, self.cuts[f][k]
                at[own] = 2 * node + 1 + (x[own, feature[node]] >= cut[node])
            leaf = at - (2**DEPTH - 1)
            value = RATE * np.bincount(leaf, grad, 2**DEPTH) / (np.bincount(leaf, hess, 2**DEPTH) + 1)
            odds += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] >= cut[at])
            out += value[at - (2**DEPTH - 1)]
        return out


_MARK = "\x01"


def layout(rng: random.Random) -> str:
    """A page of a random layout; words of its main text start with _MARK."""
    syllables = ["an", "the", "ti", "on", "er", "re", "lo", "ma", "si", "qu", "é", "ü", "st", "en"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))

    def prose(low: int, high: int, mark: str = "") -> str:
        out = [mark + word() for _ in range(rng.randint(low, high))]
        return " ".join(w + (rng.choice([".", ",", "."]) if rng.random() < 0.12 else "") for w in out) + rng.choice([".", ".", ""])

    def attr(options: list[str], chance: float = 0.7) -> str:
        return f' {rng.choice(["class", "id", "class"])}="{rng.choice(options)}{rng.choice(["", "-1", " x"])}"' if rng.random() < chance else ""

    def links(tag: str, options: list[str], chance: float = 0.5) -> str:
        items = "".join(f'<li><a href="/{i}">{prose(1, 3)}</a></li>' for i in range(rng.randint(2, 9)))
        return f"<{tag}{attr(options, chance)}>{rng.choice([f'<ul>{items}</ul>', items.replace('<li>', '').replace('</li>', ' ')])}</{tag}>"

    def main() -> str:
        p = rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>", "<p>{} <a href='/x'>{}</a></p>"])
        blocks = [p.format(prose(*rng.choice([(1, 6), (20, 60), (60, 160)]), _MARK), _MARK + word()) for _ in range(rng.randint(1, 14))]
        if rng.random() < 0.3:
            blocks.insert(rng.randrange(len(blocks) + 1), "<ul>" + "".join(f"<li>{prose(3, 15, _MARK)}</li>" for _ in range(4)) + "</ul>")
        if rng.random() < 0.2:
            blocks.insert(rng.randrange(len(blocks) + 1), f"<blockquote>{prose(8, 40, _MARK)}</blockquote>")
        if rng.random() < 0.15:
            blocks.insert(rng.randrange(len(blocks) + 1), "<table>" + f"<tr><td>{prose(1, 3, _MARK)}</td><td>{prose(1, 3, _MARK)}</td></tr>" * 3 + "</table>")
        if rng.random() < 0.2:
            blocks.insert(rng.randrange(len(blocks) + 1), f'<div{attr(["ad", "advert", "promo"], 1)}>{prose(4, 30)}</div>')
        title = f"<h1>{prose(2, 9, _MARK)}</h1>" if rng.random() < 0.85 else ""
        title = f"<header>{title}</header>" if rng.random() < 0.1 and title else title
        body = title + "".join(blocks)
        kind = rng.random()
        if kind < 0.5:
            return f"<article{attr(['post', 'story'], 0.3)}>{body}</article>"
        if kind < 0.7:
            return f"<main>{body}</main>"
        return f"<div{attr(['content', 'article-body', 'post', 'entry-content', 'main', 'text'], 0.9)}>{body}</div>"

    before = [
        lambda: links("nav", ["menu", "navbar"]),
        lambda: f"<header{attr(['site-header', 'masthead'])}>{prose(1, 8)}</header>",
        lambda: f'<div{attr(["ad", "ads", "advert", "banner", "sponsored"], 1)}>{prose(3, 30)}</div>',
        lambda: f'<div{attr(["cookie-notice", "consent", "alert", "notice"], 1)}>{prose(6, 30)}</div>',
        lambda: links("div", ["menu", "breadcrumb", "navigation"], 1),
        lambda: f"<form{attr(['search', 'login'])}><label>{prose(1, 3)}</label><input name=q></form>",
    ]
    after = [
        lambda: f"<aside{attr(['sidebar', 'related'])}>{prose(3, 40)}</aside>",
        lambda: links("aside", ["sidebar", "related"]),
        lambda: links("div", ["sidebar", "related", "share", "widget"], 1),
        lambda: f'<{(t := rng.choice(["div", "section"]))}{attr(["comments", "comment-list", "discussion"], 1)}>' + "".join(f"<div class='comment'><p>{prose(4, 40)}</p></div>" for _ in range(rng.randint(1, 5))) + f"</{t}>",
        lambda: f'<div{attr(["newsletter", "subscribe", "promo"], 1)}><p>{prose(5, 20)}</p></div>',
        lambda: f"<form{attr(['comment-form', 'newsletter'])}><p>{prose(2, 8)}</p><textarea>x</textarea></form>",
    ]
    foot = lambda: f"<footer{attr(['footer', 'site-footer'], 0.4)}>&copy; {prose(3, 40)}</footer>" if rng.random() < 0.8 else f'<div{attr(["footer", "copyright", "legal"], 1)}><p>{prose(3, 30)}</p></div>'
    parts = [f() for f in rng.sample(before, rng.randint(1, 4))] + [main()] + [f() for f in rng.sample(after, rng.randint(0, 4))] + [foot()]
    body = "".join(parts)
    for _ in range(rng.randint(0, 2)):
        body = f"<div{attr(['wrapper', 'container', 'page'], 0.6)}>{body}</div>"
    return f"<html><head><title>{prose(2, 8)}</title><script>var a='<p>';</script></head><body>{body}</body></html>"


def train(seed: int = 11, pages: int = TRAIN_PAGES) -> Boosted:
    """Fit on `pages` random layouts: a node's label is whether its subtree holds main text."""
    rng, x, y = random.Random(seed), [], []
    for _ in range(pages):
        page = Page(layout(rng))
        label = np.zeros(len(page.parent))
        for node, text, _ in page.parts:
            label[node] = max(label[node], _MARK in text)
        for i in range(len(label) - 1, 0, -1):
            label[page.parent[i]] = max(label[page.parent[i]], label[i])
        page.parts = [(n, t.replace(_MARK, ""), k) for n, t, k in page.parts]
        x.append(page.features()[1:])
        y.append(label[1:])
    return Boosted().fit(np.concatenate(x), np.concatenate(y))


def extract(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """`pages` (with `html`) without `html`, and `text`."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())
    names = [c for c in pages.columns if c != "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                trees = [Page(x or "") for x in part.column("html").to_pylist()]
                odds = shared.value.odds(np.concatenate([t.features() for t in trees]))
                place = np.concatenate(([0], np.cumsum([len(t.parent) for t in trees])))
                texts = [t.text(t.kept(odds[a:b])) for t, a, b in zip(trees, place[:-1], place[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(texts, pa.string())], [*names, "text"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.schema if f.name != "html")
    return pages.mapInArrow(run, f"{schema}text string")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
