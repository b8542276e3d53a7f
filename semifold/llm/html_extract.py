"""Main-text extraction by a tree-structured graphical model over the DOM.

A page is cut into tags and text in one pass over its characters; open elements form a tree whose nodes are labelled
content or not. A node's own potential is a logistic function of its features (tag kind, class and id words, text length, link
density, depth); parent-child potentials are log ratios of label pairs. Both are trained from a small table of labelled
pages (labelled_pages(), made by rule). Sum-product messages pass upward and downward by tree level, in numpy over a
whole batch of pages, and give each node's marginal of being content. Text under a node of marginal above the limit is
kept, block by block in page order.

Pages are independent: one pass of Arrow batches over the scan, no shuffle; the time is linear in a page's
length, however deep its elements are nested. Broken markup is
tolerated: stray end tags are ignored, p, li and table cells close their open namesakes, and everything open ends with the
page; an element whose content is not text is empty if it ends in a slash, and skips only its own tag if no end tag follows
(but script, style, textarea and title run to the page's end). Formulas (math) are part of their block's text, drawings
(svg) and embedded objects are blocks like any other, so their words stay where they stand in an article.

Defined results: null or empty html gives an empty text; a page without any tag is one text block and is judged at its
root; a header element is no content, also inside an article, but a heading outside of one is; a tag that never ends is
text if no > follows it, and else ends at the next >; elements may be nested to any depth; ids are passed on as they are;
repeated rows are extracted one by one; extra columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: In a tag: a value in quotes begins, or the tag ends.
IN_TAG = re.compile(r"=\s*([\"'])|>")
ATTR = re.compile(r"(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements without content, elements whose content is not text, and inline elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe select title annotation annotation-xml".split())
#: Of these, the ones whose content runs to the end of the page if no end tag follows.
TO_END = frozenset("script style textarea title".split())
END_TAGS = {t: re.compile(rf"</{t}(?![^\s/>])", re.I | re.A) for t in RAW}
#: Elements of other languages, which a trailing slash closes.
EMPTY_IF_CLOSED = frozenset("svg object path g rect circle line use text image".split())
#: A trailing slash closes an element, unless it belongs to an attribute's value without quotes.
CLOSED = re.compile(r"(?<!\S)/\Z|[\"']/\Z|(?<!\S)[^\s=]+/\Z")
INLINE = frozenset(("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label "
    "math merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics tspan").split())
#: Elements that an open tag of the key closes, up to the nearest scope.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES |= {t: {"p"} for t in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
SCOPE = frozenset("html body article aside section main div nav header footer form table ul ol dl blockquote figure fieldset td th".split())

#: Tag groups and the words in class and id that speak for or against content.
TAG_GROUPS = (("article", "main"), ("p", "pre", "blockquote", "dd", "dt", "td", "figcaption"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "button", "input", "fieldset", "dialog"), ("head", "script", "style", "noscript", "template", "iframe"), ("ul", "ol", "li", "dl"), ("table", "thead", "tbody", "tfoot", "tr", "caption", "figure", "svg", "g", "text", "object", "details", "summary"), ("div", "section", "body", "html"))
BAD_WORDS = ("ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "consent", "disqus", "footer", "form", "header", "legal", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "related", "reply", "replies", "responses", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget")
GOOD_WORDS = ("article", "articlebody", "body", "content", "entry", "main", "post", "story", "text")
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


@dataclass(frozen=True)
class HtmlParams:
    """limit: least marginal of content; batch_pages: pages whose trees are joined in one pass."""

    limit: float = 0.5
    batch_pages: int = 256


def markup(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, kind, name, attributes) of each piece of markup of a page; what lies between is text.

    kind is open, close, cdata or skip. Each character is passed over once, but for one second look at a page whose
    quotes never end. A caller that sends a place goes on from there.
    """
    at, last, quotes = 0, source.rfind(">"), True
    while (start := source.find("<", at)) >= 0:
        at, kind, name, attrs = start + 1, "", "", ""
        if source.startswith("!--", at):
            end = source.find("-->", at + 3)
            at, kind = end + 3 if end >= 0 else len(source), "skip"
        elif source.startswith("![CDATA[", at):
            end = source.find("]]>", at)
            at, kind = end + 3 if end >= 0 else len(source), "cdata"
        elif at > last:
            return
        elif source[at] in "!?":
            at, kind = source.find(">", at) + 1, "skip"
        elif m := NAME.match(source, at + (source[at] == "/")):
            kind, name, inner = "close" if source[at] == "/" else "open", m[0].lower(), m.end()
            at = inner
            while quotes and at >= 0:
                if not (m := IN_TAG.search(source, at)):
                    quotes, at = False, inner
                elif m[0] == ">":
                    at = m.end()
                    break
                else:
                    end = source.find(m[1], m.end())
                    quotes, at = (False, inner) if end < 0 else (True, end + 1)
            if not quotes:
                at = source.find(">", inner) + 1
                if not at:
                    return
            attrs = source[inner : at - 1]
        if kind:
            at = (yield start, at, kind, name, attrs) or at


class Tree:
    """Nodes of many pages as flat lists: parent (-1 for a root), tag group bits, text pieces in page order."""

    def __init__(self):
        self.page, self.parent, self.depth, self.features = [], [], [], []
        self.text_len, self.link_len = [], []
        self.pieces: list[tuple[int, int, str | None]] = []  # (page, node, text; None: a block's edge)

    def node(self, page: int, parent: int, tag: str, attrs: str) -> int:
        f = [float(tag in group) for group in TAG_GROUPS]
        words = {w for m in ATTR.finditer(attrs) for w in WORD.findall((m[1] or m[2] or m[3] or "").lower())} if attrs else ()
        f += [float(any(w in words for w in BAD_WORDS)), float(any(w in words for w in GOOD_WORDS))]
        self.page.append(page)
        self.parent.append(parent)
        self.depth.append(0 if parent < 0 else self.depth[parent] + 1)
        self.features.append(f)
        self.text_len.append(0)
        self.link_len.append(0)
        return len(self.parent) - 1

    def parse(self, page: int, source: str) -> None:
        stack: list[tuple[str, int]] = [("html", self.node(page, -1, "html", ""))]  # an inline element shares its block's node
        scopes: list[Counter] = [Counter(html=1)]  # open elements by tag, from each scope to the next
        whole: Counter = Counter(html=1)

        def push(tag: str, node: int) -> None:
            if tag in SCOPE:
                scopes.append(Counter())
            scopes[-1][tag] += 1
            whole[tag] += 1
            stack.append((tag, node))

        def pop_to(tags) -> int:
            """Closes open elements up to the nearest of tags; its node."""
            while True:
                tag, node = stack.pop()
                whole[tag] -= 1
                if tag in SCOPE:
                    scopes.pop()
                else:
                    scopes[-1][tag] -= 1
                if tag in tags:
                    return node

        at, missing = 0, set()  # missing: elements without an end tag in the rest of the page
        pieces = markup(source)
        here = next(pieces, None)
        while here:
            start, end, kind, tag, attrs = here
            if start > at:
                self._text(page, stack[-1][1], source[at:start], whole["a"] > 0)
            at = end
            if kind == "cdata":
                self._text(page, stack[-1][1], html.escape(source[start + 9 : end].removesuffix("]]>")), whole["a"] > 0)
            elif kind == "close":
                if (whole if tag in SCOPE else scopes[-1])[tag] > 0 and (tag != "html" or whole["html"] > 1):
                    node = pop_to((tag,))
                    if tag not in INLINE:
                        self.pieces.append((page, node, None))
            elif kind == "open" and tag in VOID:
                if tag in ("br", "hr"):
                    self.pieces.append((page, stack[-1][1], " " if tag == "br" else None))
            elif kind == "open" and tag in RAW:  # skip to its end tag; its content is not text
                if not CLOSED.search(attrs):
                    shut = None if tag in missing else END_TAGS[tag].search(source, at)
                    if not shut:
                        missing.add(tag)
                    if shut or tag in TO_END:
                        at = shut.start() if shut else len(source)
                        push(tag, self.node(page, stack[-1][1], tag, ""))
                        here = self._next(pieces, at)
                        continue
            elif kind == "open":
                shut = CLOSES.get(tag, ())
                while any(scopes[-1][t] > 0 for t in shut) and len(stack) > 1:
                    pop_to(shut)
                if tag in INLINE:
                    push(tag, stack[-1][1])
                else:
                    node = self.node(page, stack[-1][1], tag, attrs)
                    self.pieces.append((page, node, None))
                    push(tag, node)
                    if tag in EMPTY_IF_CLOSED and CLOSED.search(attrs):
                        pop_to((tag,))
            here = next(pieces, None)
        if at < len(source):
            self._text(page, stack[-1][1], source[at:], whole["a"] > 0)

    @staticmethod
    def _next(pieces, at: int):
        try:
            return pieces.send(at)
        except StopIteration:
            return None

    def _text(self, page: int, node: int, text: str, linked: bool) -> None:
        self.pieces.append((page, node, text))
        n = len(text) - text.count(" ")
        self.text_len[node] += n
        if linked:
            self.link_len[node] += n

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """parent, depth and the feature matrix with a leading 1."""
        text, link = np.array(self.text_len, float), np.array(self.link_len, float)
        own = np.column_stack([np.log1p(text) / 5, link / np.maximum(text, 1), (text == 0).astype(float)])
        x = np.column_stack([np.ones(len(text)), np.array(self.features, float).reshape(len(text), -1), own])
        return np.array(self.parent), np.array(self.depth), x


@dataclass
class TreeModel:
    """weights: of the node features; pair[a, b]: potential of parent label a and child label b (1: content)."""

    weights: np.ndarray
    pair: np.ndarray

    def marginals(self, parent: np.ndarray, depth: np.ndarray, x: np.ndarray, narrow: int = 24) -> np.ndarray:
        """Each node's probability of being content, by sum-product messages upward and downward, level by level.

        Levels of narrow nodes or fewer (deep pages have very many of them) go node by node, the others as arrays: the
        same messages either way, and time linear in the nodes at any depth.
        """
        n = len(parent)
        score = x @ self.weights
        inside, up, outside = np.column_stack([np.zeros(n), score]), np.zeros((n, 2)), np.zeros((n, 2))
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(depth.max(initial=0) + 2)).tolist()
        levels = list(zip(cuts[1:-1], cuts[2:], strict=True))  # below the roots
        (aa, ab), (ba, bb) = self.pair.tolist()

        def add(a: float, b: float) -> float:
            return a + log1p(exp(b - a)) if a > b else b + log1p(exp(a - b))

        for lo, hi in reversed(levels):
            at = order[lo:hi]
            if hi - lo > narrow:
                both = self.pair[None] + inside[at][:, None, :]  # node, parent label, own label
                up[at] = np.logaddexp(both[:, :, 0], both[:, :, 1])
                np.add.at(inside, parent[at], up[at])
                continue
            for i in at.tolist():
                zero, one = inside[i].tolist()
                above, now = parent[i], (add(aa + zero, ab + one), add(ba + zero, bb + one))
                up[i, 0], up[i, 1] = now
                inside[above, 0] += now[0]
                inside[above, 1] += now[1]
        for lo, hi in levels:
            at = order[lo:hi]
            if hi - lo > narrow:
                above = (inside[parent[at]] - up[at] + outside[parent[at]])[:, :, None] + self.pair[None]
                outside[at] = np.logaddexp(above[:, 0], above[:, 1])
                continue
            for i in at.tolist():
                zero, one = (inside[parent[i]] - up[i] + outside[parent[i]]).tolist()
                outside[i, 0], outside[i, 1] = add(zero + aa, one + ba), add(zero + ab, one + bb)
        total = inside + outside
        return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -700, 700)))


#: Bodies of labelled articles besides headings, paragraphs and lists.
OTHER_BODIES = (
    "<table><caption>%s</caption><tr><th>%s</th><td>%s</td></tr><tr><th>%s</th><td>%s</td></tr></table>",
    "<figure><img src='f'><figcaption>%s</figcaption></figure><p>%s</p>",
    "<blockquote><p>%s</p></blockquote>",
    "<table><tbody><tr><td>%s<td>%s<tr><td>%s</table>",
    "<pre>%s</pre>",
    "<dl><dt>%s</dt><dd>%s</dd></dl>",
    "<section><h2>%s</h2><p>%s</p></section>",
    "<div><p>%s <a href='/in'>with a link</a></p></div>",
    "<svg><g><text>%s</text></g></svg><object data='o'>%s</object>",
    "<details><summary>%s</summary><p>%s</p></details>",
    "<div>%s</div>",
)


def labelled_pages() -> list[tuple[str, list[str]]]:
    """A small labelled table made by rule: (html, the phrases that are content); every other text is not."""
    rows = []
    para = [f"Word {k}." if k % 4 == 0 else f"Plain words {k} here." if k % 4 == 1 else f"Plain sentence {k} of the story with several quiet words in a row to read." for k in range(40)]
    noise = [f"item{k}" for k in range(40)]
    chrome = (
        ("<nav class='top'><ul>%s</ul></nav>", "<li><a href='/x'>%s</a></li>", 4),
        ("<header><h2>%s</h2></header>", "%s ", 1),
        ("<div class='ad'>%s</div>", "%s buy now a longer line of words to sell. ", 1),
        ("<div id='cookie-notice'><p>%s</p></div>", "%s we use small files on this site for several reasons. ", 1),
        ("<aside class='sidebar'><h3>Also</h3>%s</aside>", "<p><a href='/y'>%s other story</a></p>", 3),
        ("<form action='/s'><p>%s</p><input name='q'></form>", "%s your address here ", 1),
        ("<section class='comments'><h3>Replies</h3>%s</section>", "<div class='comment'><p>%s I read this and liked most of the words in it.</p></div>", 3),
        ("<footer><p>%s</p></footer>", "%s all rights reserved by the people of the site. ", 1),
        ("<div class='menu'>%s</div>", "<a href='/z'>%s</a> ", 4),
        ("<footer>%s</footer>", "%s and a longer line of words about the site that is no story at all. ", 2),
        ("<header>%s</header>", "%s the name of the site and a long line of words below it. ", 1),
        ("<aside>%s</aside>", "%s a long line of words beside the story about other things. ", 2),
        ("<nav>%s</nav>", "%s and some words to go elsewhere on the site. ", 2),
        ("<form>%s</form>", "%s write your name and your words here and send them to us. ", 1),
        ("<div class='notice'>%s</div>", "%s a notice with a long line of words for every reader here. ", 1),
        ("<div class='share social'>%s</div>", "%s tell others about this with a long line of words. ", 1),
        ("<div class='related'><ul>%s</ul></div>", "<li><a href='/r'>%s one more</a></li>", 3),
    )
    frames = ("<article>%s</article>", "<main>%s</main>", "<div class='content'>%s</div>", "<div class='post-body'>%s</div>", "<section><article>%s</article></section>", "<div>%s</div>")
    for k in range(240):
        at, n, step = k * 7 % 30, 2 + k % 4, 4 if k % 3 == 0 else 1  # step 4: all paragraphs as short as the first, or as long
        body = [f"<h1>{para[at]}</h1>"] + [f"<p>{para[(at + j * step) % 40]}</p>" for j in range(1, n)]
        kept = [para[(at + j * step) % 40] for j in range(n)]
        if k % 5 == 0:
            body.append(f"<ul><li>{para[(at + 9) % 40]}</li><li>{para[(at + 10) % 40]}</li></ul>")
            kept += [para[(at + 9) % 40], para[(at + 10) % 40]]
        other = OTHER_BODIES[k % len(OTHER_BODIES)]
        if other and k % 2:
            own = [f"{para[(at + 11 + j) % 40]}" for j in range(other.count("%s"))]
            body.append(other % tuple(own))
            kept += own
        parts = [c % "".join(item % noise[(k + j) % 40] for j in range(n)) for c, item, n in (chrome[(k + i * 3) % len(chrome)] for i in range(5))]
        inside = parts.pop() if k % 6 == 0 else ""
        page = "".join(parts[:2]) + frames[k % len(frames)] % ("".join(body) + inside) + "".join(parts[2:])
        rows.append((f"<html><head><title>{para[at]}</title></head><body>{page}</body></html>", kept))
    return rows


def train(pages: list[tuple[str, list[str]]], steps: int = 300, l2: float = 0.02) -> TreeModel:
    """Node weights by penalised logistic regression, pair potentials by smoothed log ratios of label pairs."""
    tree = Tree()
    for k, (source, _) in enumerate(pages):
        tree.parse(k, source)
    y = np.zeros(len(tree.parent))
    wanted = [set(kept) for _, kept in pages]
    for page, node, text in tree.pieces:
        if text and text.strip() in wanted[page]:
            y[node] = 1
    parent, depth, x = tree.arrays()
    frame = {n for n in range(len(parent)) if tree.features[n][0] or tree.features[n][len(TAG_GROUPS) + 1]}
    for n in reversed(range(len(parent))):  # a frame is content if something in it is; plain wrappers are too
        if y[n] and parent[n] >= 0 and not (parent[n] not in frame and depth[parent[n]] <= 1):
            y[parent[n]] = 1
    w = np.zeros(x.shape[1])
    penalty = l2 * np.eye(len(w))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) / len(y) - penalty @ w / 10
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + penalty / 10 + 1e-6 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    child = np.flatnonzero(parent >= 0)
    count = np.full((2, 2), 1.0)
    np.add.at(count, (y[parent[child]].astype(int), y[child].astype(int)), 1)
    pair = np.log(count / count.sum(axis=1, keepdims=True)) - np.log(count.sum(axis=0) / count.sum())
    return TreeModel(w, pair)


def extract_batch(sources: list[str], model: TreeModel, limit: float) -> list[str]:
    tree = Tree()
    for k, s in enumerate(sources):
        tree.parse(k, s)
    good = model.marginals(*tree.arrays()) > limit if tree.parent else np.empty(0, bool)
    out: list[list[list[str]]] = [[] for _ in sources]  # page, block, pieces
    open_block: tuple[int, int] = (-1, -1)
    for page, node, text in tree.pieces:
        if text is None or not good[node]:
            open_block = (-1, -1)
        else:
            if open_block != (page, node):
                out[page].append([])
                open_block = (page, node)
            out[page][-1].append(html.unescape(text))
    return [" ".join(t for b in blocks if (t := SPACE.sub(" ", "".join(b)).strip())) for blocks in out]


def extract(pages: DataFrame, model: TreeModel | None = None, params: HtmlParams = HtmlParams()) -> DataFrame:
    """page_id, url, text and n_chars (code points): one row for each row of pages."""
    model = model or train(labelled_pages())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, params.batch_pages):
                part = b.slice(lo, params.batch_pages)
                text = extract_batch([x or "" for x in part.column("html").to_pylist()], model, params.limit)
                columns = [part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    chosen = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"))
    kinds = dict(chosen.dtypes)
    return chosen.mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
