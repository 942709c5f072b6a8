"""Main text of web pages: boosted trees over DOM-node features, then a consistent choice over the tree.

Every block element is scored by gradient-boosted trees.  The choice of the elements kept maximises the sum
of log odds under one rule: what is inside a dropped element is dropped, what is inside a kept one is kept, and only a mixed
element leaves the choice to its children.  So no descendant contradicts an ancestor.

The trees are trained here, on pages that a seeded generator writes from templates with known main text.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .dom import Block, Node, parse

#: Attribute words (fixed values) that speak for and against main text.
FOR = frozenset("article articlebody blog body content entry main page post prose story text".split())
AGAINST = frozenset(
    "ad ads advert advertisement aside banner bar breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disqus footer form gdpr header infobar login masthead menu meta modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted recommended related reply respond rss search share sharing sidebar signup social sponsor sponsored subscribe tags teaser toc toolbar topbar widget widgets".split()
)
OUT_TAGS = frozenset("nav header footer aside form menu dialog".split())
MIXED_COST = 1.0
PAGES, TREES, DEPTH, RATE, BINS, SEED = 1000, 80, 4, 0.2, 32, 7
#: Share of the training pages without class and id words, and (independently) without telling tags.
HINTLESS = 0.35


# -- features -----------------------------------------------------------------------------------------------
class Tree:
    """A page's block elements in page order with sums over their subtrees."""

    def __init__(self, page: str):
        self.nodes: list[Node] = []
        self.children: list[list] = []
        root = parse(page)
        index = {}
        stack = [root]
        while stack:
            node = stack.pop()
            index[id(node)] = len(self.nodes)
            self.nodes.append(node)
            stack.extend(k for k in reversed(node.kids) if isinstance(k, Node))
        n = len(self.nodes)
        self.parent = np.array([index[id(x.parent)] if x.parent is not None else -1 for x in self.nodes])
        own = np.array([[sum(len(k.text) for k in x.kids if isinstance(k, Block)), sum(k.linked for k in x.kids if isinstance(k, Block)), x.links, 1, x.tag in ("p", "blockquote", "pre"), x.tag in ("li", "dt", "dd", "td")] for x in self.nodes], float).reshape(n, 6)
        sub = own.copy()
        for i in range(n - 1, 0, -1):
            sub[self.parent[i]] += sub[i]
        self.own, self.sub, self.index = own, sub, index

    def features(self) -> np.ndarray:
        n, own, sub, parent = len(self.nodes), self.own, self.sub, self.parent
        tokens = [x.tokens() for x in self.nodes]
        pro = np.array([bool(t & FOR) for t in tokens], float)
        con = np.array([bool(t & AGAINST) for t in tokens], float)
        out = np.array([x.tag in OUT_TAGS for x in self.nodes], float)
        main = np.array([x.tag in ("article", "main") or "main" in t for x, t in zip(self.nodes, tokens)], float)
        up = np.zeros((n, 4))
        number = np.zeros(n)
        seen: dict[int, int] = {}
        for i in range(1, n):
            p = parent[i]
            up[i] = np.maximum(up[p], (pro[p], con[p], out[p], main[p]))
            number[i] = seen.get(p, 0)
            seen[p] = seen.get(p, 0) + 1
        p = np.maximum(parent, 0)
        total = max(1.0, sub[0, 0])
        siblings = np.bincount(p[1:], minlength=n) if n > 1 else np.zeros(n)
        before = np.cumsum(own[:, 0]) - own[:, 0]
        tag = np.array([x.tag for x in self.nodes])
        kinds = [np.isin(tag, k) for k in (["p", "blockquote", "pre"], ["h1"], ["h2", "h3", "h4", "h5", "h6"], ["li", "dt", "dd"], ["ul", "ol", "dl", "table", "tbody", "tr"], ["div", "section"], ["td", "th"], ["figure", "figcaption"])]
        return np.column_stack(
            [
                pro, con, out, main, up, *kinds, [x.depth for x in self.nodes], np.log1p(own[:, 0]), np.log1p(sub[:, 0]), sub[:, 0] / total, sub[:, 1] / np.maximum(sub[:, 0], 1), sub[:, 0] / sub[:, 3], sub[:, 2] / np.maximum(1, sub[:, 0] / 100),
                np.log1p(sub[:, 4]), np.log1p(sub[:, 5]), np.log1p(sub[p, 0]), sub[p, 1] / np.maximum(sub[p, 0], 1), np.log1p(sub[p, 4]), np.log1p(siblings[p]), number, sub[:, 0] / np.maximum(sub[p, 0], 1), before / total,
            ]
        )

    def choose(self, odds: np.ndarray) -> list[str]:
        """Texts of the kept blocks in page order under the best consistent choice."""
        n = len(self.nodes)
        weight = np.where(self.own[:, 0] > 0, 1.0 + np.log1p(self.own[:, 0]) / 4, 0.5)
        keep, drop = odds * weight / 2, -odds * weight / 2
        best = np.zeros(n)
        free = np.zeros(n)
        for i in range(n - 1, -1, -1):
            best[i] = max(keep[i], drop[i], free[i] - MIXED_COST + (abs(odds[i]) * weight[i] / 2 if self.own[i, 0] else 0))
            if i:
                q = self.parent[i]
                keep[q] += keep[i]
                drop[q] += drop[i]
                free[q] += best[i]
        texts: list[str] = []
        stack: list = [(self.nodes[0], None)]
        while stack:
            x, state = stack.pop()
            if isinstance(x, Block):
                if state:
                    texts.append(x.text)
                continue
            i = self.index[id(x)]
            inner = state
            if state is None:
                if best[i] == keep[i]:
                    state = inner = True
                elif best[i] == drop[i]:
                    state = inner = False
                else:
                    state, inner = bool(odds[i] > 0), None
            for k in reversed(x.kids):
                stack.append((k, state if isinstance(k, Block) else inner))
        return texts


# -- boosted trees ------------------------------------------------------------------------------------------
class Boosted:
    """Gradient-boosted trees for log odds, grown level by level on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)])
        self.base = float(np.log((w @ y + 1) / (w @ (1 - y) + 1)))
        score = np.full(len(y), self.base)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, (y - p) * w, np.maximum(p * (1 - p), 1e-6) * w)
            self.trees.append(tree)
            score += self._leaf(tree, binned)
        self.trees = [(f, np.array([self.cuts[k][b] if k >= 0 and b < len(self.cuts[k]) else np.inf for k, b in zip(f, t)]), v) for f, t, v in self.trees]

    @staticmethod
    def _grow(x, g, h):
        size = 2 ** (DEPTH + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        at = np.zeros(len(g), int)
        for node in range(2**DEPTH - 1):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            gs, hs, best = g[rows].sum(), h[rows].sum(), 1e-6
            for k in range(x.shape[1]):
                gl = np.cumsum(np.bincount(x[rows, k], g[rows], BINS + 1))
                hl = np.cumsum(np.bincount(x[rows, k], h[rows], BINS + 1))
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(hl < 1) | (hs - hl < 1)] = 0
                b = int(gain.argmax())
                if gain[b] > best:
                    best, feature[node], cut[node] = gain[b], k, b
            if feature[node] >= 0:
                at[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        for node in np.unique(at):
            rows = at == node
            value[node] = RATE * g[rows].sum() / (h[rows].sum() + 1)
        return feature, cut, value

    @staticmethod
    def _leaf(tree, x):
        feature, cut, value = tree
        at = np.zeros(len(x), int)
        for _ in range(DEPTH):
            f = feature[at]
            inner = f >= 0
            right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return value[at]

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum(self._leaf(t, x) for t in self.trees)


# -- training pages -----------------------------------------------------------------------------------------
def write_page(rng: random.Random) -> tuple[str, str]:
    """(html, main text) of a page from random templates."""
    letters = "etaoinshrdlucmfwypvbgk"
    words = ["".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(150)]
    sentence = lambda a, b: (" ".join(rng.choices(words, k=rng.randint(a, b)))).capitalize() + rng.choice([".", ".", "!", "?", ""])
    link = lambda t: f'<a href="/{rng.choice(words)}">{t}</a>'
    attr = lambda *names: rng.choice([f' class="{rng.choice(names)}"', f' id="{rng.choice(names)}"', f' class="{rng.choice(words)} {rng.choice(names)}-{rng.choice(words)}"'])
    maybe = lambda p, f: f() if rng.random() < p else ""
    menu = lambda: "<ul>" + "".join(f"<li>{link(rng.choice(words))}" + rng.choice(["</li>", ""]) for _ in range(rng.randint(3, 10))) + "</ul>"
    nav = lambda: rng.choice([f"<nav>{menu()}</nav>", f"<div{attr('menu', 'nav', 'navbar')}>{menu()}</div>", f"<header>{sentence(1, 4)}{menu()}</header>", f"<div{attr('header', 'masthead', 'topbar')}><p>{sentence(1, 8)}</p>{menu()}</div>"])
    ad = lambda: rng.choice([f"<div{attr('ad', 'ads', 'advert', 'sponsored', 'promo', 'banner')}>{rng.choice(['<p>', '', '<b>'])}{sentence(2, 25)}</div>", f"<aside{attr('ad', 'promo')}>{sentence(2, 20)}</aside>", f"<section{attr('newsletter', 'subscribe')}><h3>{sentence(1, 4)}</h3><p>{sentence(3, 20)}</p></section>"])
    notice = lambda: f"<div{attr('cookie', 'notice', 'consent', 'gdpr', 'popup', 'modal')}><p>{sentence(5, 30)}</p>{rng.choice(['<button>Ok</button>', link('ok'), ''])}</div>"
    side = lambda: rng.choice([f"<aside>{rng.choice(['<h3>' + sentence(1, 3) + '</h3>', ''])}{menu()}<p>{sentence(4, 25)}</p></aside>", f"<div{attr('sidebar', 'widget', 'related', 'recommended')}><h3>{sentence(1, 3)}</h3>{menu()}{maybe(0.5, lambda: '<p>' + sentence(4, 30) + '</p>')}</div>"])
    form = lambda: f"<form{attr('search', 'login', 'signup', 'form')}><label>{sentence(1, 3)}</label><input><p>{sentence(2, 12)}</p><textarea>{sentence(2, 4)}</textarea></form>"
    foot = lambda: rng.choice([f"<footer>&copy; {sentence(2, 15)} {maybe(0.5, menu)}</footer>", f"<div{attr('footer', 'copyright')}><p>{sentence(3, 20)}</p>{maybe(0.5, menu)}</div>"])
    comments = lambda: rng.choice([f"<section{attr('comments', 'comment')}>", f"<div{attr('comments', 'disqus', 'respond')}>"]) + "<h3>Comments</h3>" + "".join(f"<div{attr('comment', 'reply')}><p>{sentence(4, 60)}</p></div>" for _ in range(rng.randint(1, 5)))
    share = lambda: f"<div{attr('share', 'social', 'tags', 'breadcrumb', 'meta', 'byline')}>{' '.join(link(rng.choice(words)) for _ in range(rng.randint(2, 5)))} {maybe(0.4, lambda: sentence(1, 4))}</div>"
    kept: list[str] = []

    def good(open_: str, close: str, text: str) -> str:
        kept.append(text)
        inner = text
        if rng.random() < 0.2:
            parts = text.split(" ")
            k = rng.randrange(len(parts))
            parts[k] = rng.choice([f"<b>{parts[k]}</b>", f"<em>{parts[k]}</em>", link(parts[k])])
            inner = " ".join(parts)
        return open_ + inner + close

    body = ""
    if rng.random() < 0.85:
        body += good("<h1>", "</h1>", sentence(3, 10))
    long = rng.random() < 0.8
    plain = rng.random() < 0.08
    for _ in range(rng.randint(1, 10)):
        kind = rng.random()
        text = " ".join(sentence(1, 20) for _ in range(rng.randint(1, 8 if long else 2)))
        if kind < 0.7:
            body += good("<div>" if plain else "<p>", "</div>" if plain else rng.choice(["</p>", "</p>", ""]), text)
        elif kind < 0.8:
            body += good("<h2>", "</h2>", sentence(1, 7))
        elif kind < 0.9:
            body += "<ul>" + "".join(good("<li>", "</li>", sentence(2, 15)) for _ in range(rng.randint(2, 5))) + "</ul>"
        else:
            body += good("<blockquote>", "</blockquote>", sentence(5, 30))
        body += maybe(0.08, ad) + maybe(0.04, share)
    body += maybe(0.15, share) + maybe(0.1, side)
    shell = rng.choice(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div" + attr("content", "post", "entry", "article", "story", "main", "text").replace("{", "") + ">{}</div>", "<div><div>{}</div></div>", "<section>{}</section>"])
    shell = shell.replace("{}", "\0")
    inner = shell.replace("\0", body)
    page = "<!DOCTYPE html><html><head><title>x</title></head><body>" + maybe(0.4, notice) + maybe(0.85, nav) + maybe(0.5, ad) + maybe(0.2, share)
    page += maybe(0.25, side) + inner + maybe(0.3, comments) + maybe(0.35, side) + maybe(0.2, form) + maybe(0.2, ad) + maybe(0.8, foot) + maybe(0.15, notice) + rng.choice(["</body></html>", ""])
    return page, " ".join(kept)


def without_hints(page: str, words: bool, tags: bool) -> str:
    """The page without class and id words and with plain containers instead of telling ones."""
    if words:
        page = re.sub(r'\s(?:class|id)="[^"]*"', "", page)
    if tags:
        page = re.sub(r"<(/?)(?:article|main|nav|header|footer|aside|section)\b", r"<\1div", page)
    return page


def training_rows(pages: int = PAGES, seed: int = SEED):
    """(features, labels, weights) of the generated pages' nodes; a node is main text if most of its letters are.

    Generated boilerplate carries telling words or tags, so a model trained on it as it is learns nothing else;
    part of the pages therefore lose either kind, and structure has to decide.
    """
    rng = random.Random(seed)
    xs, ys, ws = [], [], []
    for _ in range(pages):
        page, main = write_page(rng)
        tree = Tree(without_hints(page, rng.random() < HINTLESS, rng.random() < HINTLESS))
        left = main
        inside = np.zeros(len(tree.nodes))
        for i, node in enumerate(tree.nodes):  # kept texts come in page order
            for k in node.kids:
                if isinstance(k, Block) and left.startswith(k.text):
                    inside[i] += len(k.text)
                    left = left[len(k.text) :].lstrip()
        for i in range(len(inside) - 1, 0, -1):
            inside[tree.parent[i]] += inside[i]
        xs.append(tree.features())
        ys.append((inside > 0.5 * tree.sub[:, 0]) & (tree.sub[:, 0] > 0))
        ws.append(np.where(tree.sub[:, 0] > 0, 1.0, 0.1))
    return np.concatenate(xs), np.concatenate(ys).astype(float), np.concatenate(ws)


@lru_cache(maxsize=1)
def trained() -> Boosted:
    return Boosted(*training_rows())


def extract_texts(pages: list[str], model: Boosted) -> list[list[str]]:
    """Kept blocks of each page."""
    trees = [Tree(p) for p in pages]
    if not trees:
        return []
    features = [t.features() for t in trees]
    odds = np.split(model.odds(np.concatenate(features)), np.cumsum([len(f) for f in features])[:-1])
    return [t.choose(o) for t, o in zip(trees, odds)]


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rows_a_pass: int = 128) -> DataFrame:
    """(id, url, text, n_chars) of every page from its whole html.

    Null or empty html, and pages without main text, give an empty text.  Repeated rows give repeated rows; other
    columns are not read.  The model (a few thousand numbers) is trained on the driver and broadcast.
    """
    src = pages.select(id_col, url_col, html_col)
    model = pages.sparkSession.sparkContext.broadcast(trained())
    kinds = [src.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, rows_a_pass):
                part = batch.slice(k, rows_a_pass)
                texts = [" ".join(t) for t in extract_texts([h or "" for h in part.column(2).to_pylist()], model.value)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return src.mapInArrow(extracted, f"{id_col} {kinds[0]}, {url_col} {kinds[1]}, text string, n_chars bigint")
