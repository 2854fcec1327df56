"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

The trees say for each node how likely it is that its subtree holds article text. They are
trained here, on made-up pages whose article is known: layouts, names, nesting, link
density, unclosed tags and boilerplate vary at random from a fixed seed. Decoding then picks
the likeliest choice over the whole tree in which no node is kept under a dropped one.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .htmltree import Tree, features, kept, parse, text_of
from .textbytes import slices

PAGES, SEED = 600, 7
TREES, DEPTH, RATE, BINS, LEAST = 80, 4, 0.2, 32, 8
MARK = "\ue000"  #: begins each word of an article in the made-up pages


class Maker:
    """Random pages; every word of the article's text begins with MARK."""

    def __init__(self, rng: random.Random):
        self.r = rng

    def words(self, lo: int, hi: int, mark: str = "") -> str:
        r = self.r
        out = [mark + "".join(r.choice(("an", "the", "or", "ion", "st", "le", "qu", "en", "da", "mi", "é", "ü")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi))]
        for i in range(r.randint(4, 14), len(out), r.randint(5, 15)):
            out[i] += r.choice((".", ",", ".", "?"))
        return " ".join(out) + r.choice((".", ".", ""))

    def names(self, *pool: str) -> str:
        r = self.r
        if r.random() < 0.1:
            return ""
        name = r.choice(pool)
        if r.random() < 0.3:
            name = r.choice((f"main-{name}", f"{name}-box", f"{name} c{r.randint(1, 9)}", f"site-{name}", f"{name}-wrap", f"{name.title()}Block"))
        return f' {r.choice(("class", "class", "id"))}="{name}"'

    def links(self, lo: int = 3, hi: int = 9) -> str:
        items = "".join(f'<li><a href="/{i}">{self.words(1, 4)}</a>{self.r.choice(("</li>", "</li>", ""))}' for i in range(self.r.randint(lo, hi)))
        return f"<ul>{items}</ul>" if self.r.random() < 0.8 else items.replace("<li>", " ").replace("</li>", " | ")

    def nav(self) -> str:
        return f"<nav{self.names('menu', 'nav', 'navigation', 'x1')}>{self.links()}</nav>" if self.r.random() < 0.6 else f"<div{self.names('menu', 'nav', 'topbar', 'navbar', 'breadcrumbs')}>{self.links()}</div>"

    def header(self) -> str:
        tag = self.r.choice(("header", "header", "div"))
        return f"<{tag}{self.names('header', 'masthead', 'branding', 'site-header')}><h{self.r.choice((1, 2, 3))}>{self.words(1, 5)}</h2><p>{self.words(2, 12)}</p>{self.r.choice((self.nav(), ''))}</{tag}>"

    def footer(self) -> str:
        tag = self.r.choice(("footer", "footer", "div"))
        close = self.r.choice((f"</{tag}>", f"</{tag}>", ""))
        return f"<{tag}{self.names('footer', 'copyright', 'legal', 'foot') if tag == 'div' else self.r.choice(('', self.names('footer')))}>&copy; {self.words(3, 40)}{self.r.choice((self.links(2, 5), '', '<p>' + self.words(5, 30) + '</p>'))}{close}"

    def ad(self) -> str:
        body = self.r.choice((self.words(3, 30), f"<p>{self.words(3, 25)}</p>", f'<a href="x">{self.words(2, 10)}</a>'))
        tag = self.r.choice(("div", "div", "aside", "section"))
        return f"<{tag} {self.r.choice(('class', 'id'))}=\"{self.r.choice(('ad', 'ads', 'advert', 'advertisement', 'ad-box', 'sponsored', 'promo', 'banner', 'ad-slot top'))}\">{body}</{tag}>"

    def notice(self) -> str:
        return f"<div{self.r.choice((' class', ' id'))}=\"{self.r.choice(('cookie-notice', 'consent', 'notice', 'alert', 'newsletter', 'gdpr-banner', 'popup', 'subscribe'))}\"><p>{self.words(8, 50)}</p>{self.r.choice(('<button>' + self.words(1, 2) + '</button>', ''))}</div>"

    def sidebar(self) -> str:
        tag = self.r.choice(("aside", "aside", "div", "section"))
        inner = "".join(self.r.choice((lambda: f"<h3>{self.words(1, 4)}</h3>{self.links()}", lambda: f"<div{self.names('widget', 'related', 'popular')}><p>{self.words(5, 40)}</p></div>", self.ad))() for _ in range(self.r.randint(1, 3)))
        return f"<{tag}{self.names('sidebar', 'widget', 'related', 'rail', 'recommended') if tag != 'aside' else self.r.choice(('', self.names('sidebar')))}>{inner}</{tag}>"

    def form(self) -> str:
        return f"<form{self.names('search', 'login', 'contact', 'signup')}><label>{self.words(1, 4)}</label><input name=q><p>{self.words(1, 14)}</p><button>{self.words(1, 2)}</button></form>"

    def comments(self) -> str:
        one = "".join(f"<{t}{self.names('comment', 'comment-body', 'reply')}><p>{self.words(4, 70)}</p></{t}>" for t in [self.r.choice(("div", "li", "article"))] for _ in range(self.r.randint(1, 6)))
        return f"<{self.r.choice(('section', 'div'))} {self.r.choice(('class', 'id'))}=\"{self.r.choice(('comments', 'comment-list', 'discussion', 'disqus_thread', 'responses', 'reader-comments'))}\"><h3>{self.words(1, 3)}</h3>{one}</div></section>"

    def share(self) -> str:
        return f"<div{self.names('share', 'social', 'tags', 'byline', 'share-buttons')}>{self.links(2, 4)}</div>"

    def part(self) -> str:
        r, m = self.r, MARK
        x = r.random()
        if x < 0.60:
            body = self.words(2, 120, m)
            if r.random() < 0.25:
                body += f' <{(t := r.choice(("b", "em", "a href=/x", "span", "strong")))}>{self.words(1, 8, m)}</{t.split()[0]}> {self.words(1, 20, m)}'
            return f"<p{r.choice(('', '', '', self.names('lead', 'text', 'p1')))}>{body}{r.choice(('</p>', '</p>', ''))}"
        if x < 0.70:
            return f"<h{r.choice((2, 3))}>{self.words(1, 8, m)}</h2></h3>"
        if x < 0.78:
            return "<ul>" + "".join(f"<li>{self.words(1, 20, m)}{r.choice(('</li>', ''))}" for _ in range(r.randint(2, 7))) + "</ul>"
        if x < 0.84:
            return f"<blockquote>{r.choice(('<p>', ''))}{self.words(5, 50, m)}</blockquote>"
        if x < 0.89:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 5, m)}<td>{self.words(1, 5, m)}" for _ in range(r.randint(1, 5))) + "</table>"
        if x < 0.93:
            return f"<figure><img src=x><figcaption>{self.words(2, 15, m)}</figcaption></figure>"
        if x < 0.97:
            return f"<div{self.names('block', 'row', 'x2', 'section')}><p>{self.words(5, 60, m)}</p></div>"
        return f"<pre>{self.words(5, 30, m)}</pre>"

    def article(self) -> str:
        r, m = self.r, MARK
        parts = [f"<h1{r.choice(('', self.names('title', 'headline')))}>{self.words(1, 12, m)}</h1>"] if r.random() < 0.85 else []
        if r.random() < 0.35:
            lead = self.words(2, 60, m)
            parts.append(r.choice((f"<p><b>{lead}<br>", f"<div>{lead}</div>", f"<p>{lead}<br>{lead}")))
        parts += [self.part() for _ in range(r.choice((0, 1, 1, 2, 3, 5, 8, 14)))] or ([] if parts else [f"<p>{self.words(3, 40, m)}</p>"])
        for extra in (self.ad, self.share, self.notice, self.form, self.sidebar):
            if r.random() < 0.12:
                parts.insert(r.randint(0, len(parts)), extra())
        if r.random() < 0.12:
            parts.append(self.comments())
        tag = r.choice(("article", "article", "article", "main", "div", "div", "section"))
        body = "".join(parts)
        if r.random() < 0.25:
            body = f"<div{self.names('content', 'entry', 'inner', 'post-body', 'c3')}>{body}</div>"
        return f"<{tag}{self.names('article', 'content', 'post', 'entry', 'story', 'main-content', 'text') if tag not in ('article', 'main') else r.choice(('', self.names('post', 'article')))}>{body}</{tag}>"

    def page(self) -> str:
        r = self.r
        some = lambda p, f: f() if r.random() < p else ""
        body = "".join([some(0.3, self.notice), some(0.5, self.header), some(0.8, self.nav), some(0.15, self.form), some(0.6, self.ad), some(0.25, self.sidebar)])
        middle = self.article()
        if r.random() < 0.3:
            middle = f"<{(t := r.choice(('main', 'div', 'div')))}{self.names('main', 'wrapper', 'container', 'page')}>{some(0.3, self.share)}{middle}{some(0.4, self.sidebar)}</{t}>"
        body += middle + "".join([some(0.3, self.comments), some(0.3, self.sidebar), some(0.3, self.ad), some(0.15, self.share), some(0.85, self.footer), some(0.1, self.notice)])
        if r.random() < 0.15:
            body = f"<{(t := r.choice(('div', 'form')))}{self.names('wrapper', 'page', 'aspnetForm', 'container')}>{body}</{t}>"
        return f"<!DOCTYPE html><html lang=en><head><meta charset=utf-8><title>{self.words(1, 9)}</title><style>p{{margin:0}}</style></head><body>{body}{r.choice(('</body></html>', ''))}"


@dataclass
class Forest:
    """Boosted trees: cuts by feature; for each tree and inner node a feature and a bin, for each leaf a weight."""

    cuts: list[np.ndarray]
    feature: np.ndarray
    bin: np.ndarray
    leaf: np.ndarray
    start: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1).astype(np.uint8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        b, row = self.binned(x), np.arange(len(x))
        out = np.full(len(x), self.start)
        for f, t, w in zip(self.feature, self.bin, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (b[row, f[at]] > t[at])
            out += w[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """Second-order boosting of the logistic loss on histograms of at most BINS bins."""
    cuts = [np.unique(np.quantile(np.unique(x[:, j]), np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
    p0 = float(np.clip(y.mean(), 0.01, 0.99))
    inner = 2**DEPTH - 1
    forest = Forest(cuts, np.zeros((trees, inner), np.int64), np.full((trees, inner), BINS, np.int64), np.zeros((trees, inner + 1)), float(np.log(p0 / (1 - p0))))
    b = forest.binned(x).astype(np.int64)
    n, d = b.shape
    flat = b + np.arange(d) * BINS
    score = np.full(n, forest.start)
    for k in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p) + 1e-6
        at = np.zeros(n, np.int64)
        for level in range(DEPTH):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(at == node)
                if len(rows) >= 2 * LEAST:
                    i = flat[rows].ravel()
                    gs, hs, cs = (np.bincount(i, w, d * BINS).reshape(d, BINS).cumsum(1) for w in (np.repeat(g[rows], d), np.repeat(h[rows], d), None))
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(cs < LEAST) | (len(rows) - cs < LEAST)] = 0
                    best = int(gain.argmax())
                    if gain.flat[best] > 1e-6:
                        forest.feature[k, node], forest.bin[k, node] = divmod(best, BINS)
                at[rows] = 2 * node + 1 + (b[rows, forest.feature[k, node]] > forest.bin[k, node])
        leaf = at - inner
        forest.leaf[k] = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        score += forest.leaf[k][leaf]
    return forest


def labels(t: Tree) -> list[float]:
    """1 for nodes whose subtree holds marked text."""
    out = [0.0] * len(t.tag)
    for node, s, _ in t.pieces:
        if MARK in s:
            out[node] = 1.0
    for i in range(len(out) - 1, 0, -1):
        out[t.parent[i]] = max(out[t.parent[i]], out[i])
    return out


@functools.lru_cache(1)
def trained(pages: int = PAGES, seed: int = SEED) -> Forest:
    make = Maker(random.Random(seed))
    x, y = [], []
    for _ in range(pages):
        t = parse(make.page())
        y += labels(t)
        t.pieces = [(n, s.replace(MARK, ""), g) for n, s, g in t.pieces]
        x += features(t)
    return boost(np.array(x), np.array(y))


def main_text(pages: list[str], forest: Forest) -> list[str]:
    trees = [parse(p) for p in pages]
    rows = [features(t) for t in trees]
    z = np.clip(forest.logit(np.array([r for page in rows for r in page])), -20, 20) if pages else np.zeros(0)
    log_in, log_out = -np.log1p(np.exp(-z)), -np.log1p(np.exp(z))
    out, at = [], 0
    for t, r in zip(trees, rows, strict=True):
        out.append(text_of(t, kept(t, log_in[at : at + len(r)].tolist(), log_out[at : at + len(r)].tolist())))
        at += len(r)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    A null or empty html, and a page without an article, give an empty text. Repeated rows
    give equal texts, an empty table no rows; extra columns are left alone. Pages are read
    whole, whatever their length or nesting; unclosed tags end as browsers end them.
    """
    held = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = held.value
        for batch in batches:
            for rows in slices(batch, "html", 2 << 20):
                texts = main_text([h or "" for h in rows.column("html").to_pylist()], forest)
                yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
