"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, each with the path of open elements.
Scripts, styles, comments, the head and other elements that show nothing are passed over. Each block is a vector:
the mean of hashed path-step vectors (tag, classes, ids), the mean of hashed word vectors, and a few figures
(length, share of link text, punctuation, place). A bidirectional LSTM in numpy reads the page's blocks in order,
so each decision sees the whole document, and says which blocks are main text.

Training: here, in numpy, by back-propagation through time with Adam, on pages that are generated from a seed and
labelled by construction (articles among menus, headers, footers, sidebars, notices, adverts, forms and reader
comments, in semantic tags and in named divisions). It takes nothing from the input, takes some seconds on the
driver, once a process, and gives weights of a fixed size, which are broadcast.

Pages are labelled in Arrow batches; whole pages are read, nothing is cut off. Pages of like length go together, up to
`CELLS` padded blocks at a time; a longer page goes alone, in stretches of as many blocks, of which only the running
state is kept. Elements nested deeper than `DEPTH` open no level of their own, as in browsers. Style: free (mapInArrow,
numpy).

Defined results: a null or empty page, or one without main text, gives an empty text; null and repeated ids are
kept as they come; malformed pages are read as far as browsers would (an unclosed tag, script or comment runs to
the end); an empty table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import small_batches, table

#: Elements that show no text of the page.
UNSEEN = {"script", "style", "head", "template", "noscript", "svg", "math", "iframe", "object", "canvas", "audio", "video", "select", "textarea", "title"}
#: Of these the content is not markup.
RAW = {"script", "style", "textarea", "title", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}

#: Open elements that count, and names of one element that its steps hold.
DEPTH, NAMES = 512, 16

_TAG = re.compile(r"""<!--(?:>|->|.*?(?:-->|--!>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))""", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_STEP = re.compile(r"[a-z]+")


def blocks(page: str) -> list[tuple[str, tuple[str, ...], int]]:
    """(text, path, length of link text) of each leaf block in page order."""
    out: list[tuple[str, tuple[str, ...], int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    path: tuple[str, ...] = ()
    links = linked = unseen = 0

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, path, linked))
            parts = []
        linked = 0

    def opened(tag: str, steps: tuple[str, ...]):
        nonlocal links, unseen
        if len(stack) >= DEPTH and tag not in RAW:
            return
        stack.append((tag, steps))
        links += tag == "a"
        unseen += tag in UNSEEN

    def closed():
        nonlocal links, unseen
        tag, _ = stack.pop()
        links -= tag == "a"
        unseen -= tag in UNSEEN

    def see(text: str):
        nonlocal linked
        if text and not unseen:
            if "&" in text:
                text = html.unescape(text)
            parts.append(text)
            if links:
                linked += len(text)

    def walk():
        return tuple(s for tag, steps in stack if tag not in INLINE for s in steps)

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            see(page[at:])
            break
        see(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        if not m[0].endswith(">"):
            break  # the page ends inside a tag
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                see(" ")
            elif any(t == tag for t, _ in stack):
                if tag not in INLINE:
                    flush()
                    while stack[-1][0] != tag:
                        closed()
                    closed()
                    path = walk()
                else:
                    k = max(i for i, (t, _) in enumerate(stack) if t == tag)
                    if all(t in INLINE for t, _ in stack[k:]):
                        while len(stack) > k:
                            closed()
            continue
        if tag == "br":
            see(" ")
            continue
        if tag not in INLINE:
            flush()
            # a block begins: what HTML closes of itself is closed
            while stack and (stack[-1][0] == "p" or stack[-1][0] in INLINE and any(t == "p" for t, _ in stack) or stack[-1][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option") or tag == "body" and stack[-1][0] == "head"):
                closed()
        if tag in VOID or m[0].endswith("/>") and tag not in RAW:
            if tag not in INLINE:
                path = walk()
            continue
        steps = (tag,)
        if tag not in INLINE and ("=" in m[3]):
            for kind, *values in _NAMES.findall(m[3]):
                steps += tuple(f"{kind[0].lower()}.{w}" for w in _STEP.findall("".join(values).lower()))
        opened(tag, steps[:NAMES])
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            closed()
            continue
        if tag not in INLINE:
            path = walk()
    flush()
    return out


PATHS, WORDS, D_PATH, D_WORD, D_FIGURE, HIDDEN = 4096, 2048, 16, 8, 6, 16
CELLS = 1 << 14


@functools.lru_cache(maxsize=8192)
def _path_ids(path: tuple[str, ...]) -> np.ndarray:
    steps = [*path, "^".join(path[-2:]), "^" + "^".join(p for p in path if "." not in p)]
    return np.array([zlib.crc32(s.encode()) % PATHS for s in steps], np.int16)


_EDGES = re.compile(r"[^\W_]+")


def features(page: list[tuple[str, tuple[str, ...], int]]):
    """For a page: path ids and word ids of its blocks, each back to back with where a block's begin, and the figures."""
    n = len(page)
    figures = np.zeros((n, D_FIGURE))
    paths, words = [], []
    for k, (text, path, linked) in enumerate(page):
        paths.append(_path_ids(path))
        said = _EDGES.findall(text.lower())
        words.append(np.array([zlib.crc32(w.encode()) % WORDS for w in said] or [0], np.int16))
        size = len(text)
        figures[k] = (np.log1p(size) / 5, np.log1p(len(said)) / 4, linked / size, sum(map(text.count, ".,;:!?")) / size * 10, k / n, 1.0)
    return _flat(paths), _flat(words), figures


def _flat(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([0, *map(len, arrays)])
    return (np.concatenate(arrays) if arrays else np.zeros(0, np.int16)), ends


def _sums(table: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the table's rows for each block's ids; long texts by how often each id occurs."""
    if ends[-1] - ends[0] <= 1 << 17:
        return np.add.reduceat(table[ids[ends[0] : ends[-1]]], ends[:-1] - ends[0], axis=0)
    return np.array([np.bincount(ids[a:z], minlength=len(table)) @ table for a, z in zip(ends[:-1], ends[1:])])


def _gates(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """The network: embeddings, an LSTM each way, a logistic output."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        d, h = D_PATH + D_WORD + D_FIGURE, HIDDEN
        self.w = {"path": r.normal(0, 0.3, (PATHS, D_PATH)), "word": r.normal(0, 0.1, (WORDS, D_WORD)), "out": r.normal(0, 0.3, (2 * h + d, 1)), "bias": np.zeros(1)}
        for way in "fb":
            self.w[f"x{way}"], self.w[f"h{way}"], self.w[f"c{way}"] = r.normal(0, 0.25, (d, 4 * h)), r.normal(0, 0.25, (h, 4 * h)), np.zeros(4 * h)
            self.w[f"c{way}"][h : 2 * h] = 1.0

    def inputs(self, pages, low: int = 0, high: int | None = None):
        """(T, B, d) of blocks low .. high - 1 of each page, padded with zeros, and the mask (T, B)."""
        high = max(len(p[2]) for p in pages) if high is None else high
        x, mask = np.zeros((high - low, len(pages), D_PATH + D_WORD + D_FIGURE)), np.zeros((high - low, len(pages)), bool)
        for k, (paths, words, figures) in enumerate(pages):
            n = min(len(figures), high) - low
            if n <= 0:
                continue
            mask[:n, k] = True
            for (ids, ends), name, a, z in ((paths, "path", 0, D_PATH), (words, "word", D_PATH, D_PATH + D_WORD)):
                ends = ends[low : low + n + 1]
                sizes = np.diff(ends)
                x[:n, k, a:z] = _sums(self.w[name], ids, ends) / (np.sqrt(sizes) if name == "path" else sizes)[:, None]
            x[:n, k, D_PATH + D_WORD :] = figures[low : low + n]
        return x, mask

    def _run(self, x, mask, way):
        t, b, _ = x.shape
        h = HIDDEN
        wx, wh, c0 = self.w[f"x{way}"], self.w[f"h{way}"], self.w[f"c{way}"]
        pre = x @ wx + c0
        hs, cs, gs = np.zeros((t + 1, b, h)), np.zeros((t + 1, b, h)), np.zeros((t, b, 4 * h))
        order = range(t) if way == "f" else range(t - 1, -1, -1)
        prev = -1
        for k in order:
            z = pre[k] + hs[prev] @ wh
            g = np.concatenate((_gates(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])), axis=1)
            live = mask[k][:, None]
            cs[k] = np.where(live, g[:, h : 2 * h] * cs[prev] + g[:, :h] * g[:, 3 * h :], cs[prev])
            hs[k] = np.where(live, g[:, 2 * h : 3 * h] * np.tanh(cs[k]), hs[prev])
            gs[k], prev = g, k
        return hs, cs, gs

    def forward(self, pages):
        x, mask = self.inputs(pages)
        runs = {way: self._run(x, mask, way) for way in "fb"}
        top = np.concatenate((runs["f"][0][:-1], runs["b"][0][:-1], x), axis=2)
        return x, mask, runs, top, (top @ self.w["out"])[..., 0] + self.w["bias"]

    def _back(self, x, mask, run, way, dh_top, grads):
        hs, cs, gs = run
        t, h = len(x), HIDDEN
        wx, wh = self.w[f"x{way}"], self.w[f"h{way}"]
        dx = np.zeros_like(x)
        dh, dc = np.zeros_like(hs[0]), np.zeros_like(cs[0])
        order = list(range(t)) if way == "f" else list(range(t - 1, -1, -1))
        for i in range(t - 1, -1, -1):
            k = order[i]
            prev = order[i - 1] if i else -1
            live = mask[k][:, None]
            dh = dh + dh_top[k]
            g, tc = gs[k], np.tanh(cs[k])
            a_i, a_f, a_o, a_g = g[:, :h], g[:, h : 2 * h], g[:, 2 * h : 3 * h], g[:, 3 * h :]
            d_c = dc + dh * a_o * (1 - tc * tc)
            dz = np.concatenate((d_c * a_g * a_i * (1 - a_i), d_c * cs[prev] * a_f * (1 - a_f), dh * tc * a_o * (1 - a_o), d_c * a_i * (1 - a_g * a_g)), axis=1) * live
            grads[f"x{way}"] += x[k].T @ dz
            grads[f"h{way}"] += hs[prev].T @ dz
            grads[f"c{way}"] += dz.sum(axis=0)
            dx[k] = dz @ wx.T
            dh = np.where(live, dz @ wh.T, dh)
            dc = np.where(live, d_c * a_f, dc)
        return dx

    def step(self, pages, labels, state, rate):
        x, mask, runs, top, z = self.forward(pages)
        y = np.zeros(mask.shape)
        for k, own in enumerate(labels):
            y[: len(own), k] = own
        p = _gates(z)
        dz = np.where(mask, p - y, 0) / mask.sum()
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        grads["out"] = np.einsum("tbi,tb->i", top, dz)[:, None]
        grads["bias"] = np.array([dz.sum()])
        d_top = dz[..., None] * self.w["out"][:, 0]
        h = HIDDEN
        dx = d_top[..., 2 * h :] + self._back(x, mask, runs["f"], "f", d_top[..., :h], grads) + self._back(x, mask, runs["b"], "b", d_top[..., h : 2 * h], grads)
        for k, (paths, words, figures) in enumerate(pages):
            for (ids, ends), name, a, zz in ((paths, "path", 0, D_PATH), (words, "word", D_PATH, D_PATH + D_WORD)):
                sizes = np.diff(ends)
                share = dx[: len(figures), k, a:zz] / (np.sqrt(sizes) if name == "path" else sizes)[:, None]
                np.add.at(grads[name], ids, np.repeat(share, sizes, axis=0))
        state["t"] = state.get("t", 0) + 1
        for name, g in grads.items():  # Adam
            m, v = state.setdefault(name, (np.zeros_like(g), np.zeros_like(g)))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            state[name] = m, v
            self.w[name] -= rate * (m / (1 - 0.9 ** state["t"])) / (np.sqrt(v / (1 - 0.99 ** state["t"])) + 1e-8)
        return float(-np.sum(np.where(mask, y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9), 0)) / mask.sum())

    def scores(self, pages, cells: int = CELLS) -> np.ndarray:
        """(T, B): the output for each block. Of the recurrence only the running state is kept."""
        t, h, out = max(len(p[2]) for p in pages), HIDDEN, self.w["out"][:, 0]
        z, step = np.full((t, len(pages)), self.w["bias"][0]), max(1, cells // len(pages))
        spans = range(0, t, step)
        held = self.inputs(pages) if len(spans) == 1 else None
        for way in "fb":
            wx, wh, c0, own = self.w[f"x{way}"], self.w[f"h{way}"], self.w[f"c{way}"], out[:h] if way == "f" else out[h : 2 * h]
            hs = cs = np.zeros((len(pages), h))
            for low in spans if way == "f" else reversed(spans):
                x, mask = held or self.inputs(pages, low, min(t, low + step))
                pre = x @ wx + c0
                if way == "f":
                    z[low : low + len(x)] += x @ out[2 * h :]
                for k in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
                    a = pre[k] + hs @ wh
                    g = _gates(a[:, : 3 * h])
                    live = mask[k][:, None]
                    cs = np.where(live, g[:, h : 2 * h] * cs + g[:, :h] * np.tanh(a[:, 3 * h :]), cs)
                    hs = np.where(live, g[:, 2 * h :] * np.tanh(cs), hs)
                    z[low + k] += hs @ own
        return z

    def keep(self, pages, cells: int = CELLS) -> list[np.ndarray]:
        """Which blocks of each page are main text."""
        out = [np.zeros(0, bool)] * len(pages)
        some, part = sorted((k for k, p in enumerate(pages) if len(p[2])), key=lambda k: len(pages[k][2])), []
        for i, k in enumerate(some):
            part.append(k)
            if i + 1 == len(some) or len(pages[some[i + 1]][2]) * (len(part) + 1) > cells:
                z = self.scores([pages[j] for j in part], cells)
                for at, j in enumerate(part):
                    out[j] = z[: len(pages[j][2]), at] > 0
                part = []
        return out


class PageMaker:
    """Pages with labels by construction: text of main blocks carries a mark that the labels are read from."""

    MARK = "⁣"

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def pick(self, *options):
        return options[self.r.integers(len(options))]

    def word(self) -> str:
        return "".join(self.pick("ba", "te", "ri", "lo", "mu", "san", "ver", "pel", "qui", "dor", "ing", "ed", "er", "on", "th", "é", "ung") for _ in range(self.r.integers(1, 5)))

    def words(self, low: int, high: int) -> str:
        said = [self.word() for _ in range(self.r.integers(low, high))]
        for k in range(len(said)):
            if self.r.random() < 0.08:
                said[k] += self.pick(".", ",", ".", ";", " ###", " &amp;", " %%%")
        return (" ".join(said).capitalize() + self.pick(".", ".", "", "!")).strip()

    def main(self, low: int, high: int) -> str:
        return self.MARK + self.words(low, high)

    def attr(self, *names: str) -> str:
        name = self.pick(*names)
        return self.pick(f'class="{name}"', f'id="{name}"', f'class="{name} {self.word()}"', f"class='{self.word()} {name}'")

    def links(self, low: int, high: int, tag: str = "li") -> str:
        known = ("Home", "About", "Contact", "News", "Login", "Help", "Privacy", "Terms")
        items = "".join(f'<{tag}><a href="/x">{self.pick(*known) if self.r.random() < 0.3 else self.words(1, 4)}</a></{tag}>' for _ in range(self.r.integers(low, high)))
        return f"<ul>{items}</ul>" if tag == "li" else items

    def aside(self) -> str:
        """Something that is not main text and may stand anywhere."""
        k = self.r.integers(10)
        text = self.words(2, self.pick(12, 12, 60))
        if k < 2:
            return f'<div {self.attr("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "adsense")}>{self.pick("", "<p>")}{text}</div>'
        if k == 2:
            return f"<aside>{self.pick(f'<h3>{self.words(1, 4)}</h3>', '')}<p>{text}</p>{self.links(1, 5)}</aside>"
        if k == 3:
            return f'<div {self.attr("sidebar", "widget", "related", "recommended", "side")}>{self.pick(f"<h4>{self.words(1, 3)}</h4>", "")}{self.pick(f"<p>{text}</p>", self.links(2, 6))}</div>'
        if k == 4:
            return f'<div {self.attr("cookie", "cookie-notice", "consent", "notice", "gdpr", "alert", "popup", "modal")}><p>{self.pick("We use cookies", "Accept all cookies", "Please note")} {text}</p><button>OK</button></div>'
        if k == 5:
            return f'<form {self.pick("action=/s", self.attr("search", "newsletter", "signup"))}><label>{self.words(1, 4)}</label><input name=q><button>{self.words(1, 3)}</button><p>{text}</p></form>'
        if k == 6:
            return f'<div {self.attr("share", "social", "tags", "breadcrumb", "breadcrumbs", "pager", "meta")}>{self.links(2, 6, self.pick("li", "span"))}</div>'
        if k == 7:
            return f'<nav {self.pick("", self.attr("menu", "toc"))}>{self.links(2, 8)}</nav>'
        if k == 8:
            return self.comments()
        return f'<section {self.attr("newsletter", "subscribe", "related", "promo", "more")}><h2>{self.words(1, 5)}</h2><p>{text}</p></section>'

    def comments(self) -> str:
        one = lambda: f'<{self.pick("div", "li", "article")} {self.attr("comment", "reply", "comment-body")}><b>{self.word()}</b>{self.pick(" said: ", "<p>")}{self.words(3, 60)}</{self.pick("div", "li", "article")}>'
        return f'<{self.pick("section", "div", "ol")} {self.attr("comments", "comment-list", "responses", "discussion", "disqus")}>{self.pick(f"<h3>{self.words(1, 3)}</h3>", "")}{"".join(one() for _ in range(self.r.integers(1, 6)))}</{self.pick("section", "div")}>'

    def article(self) -> str:
        parts = []
        if self.r.random() < 0.8:
            parts.append(f"<h1>{self.main(1, 12)}</h1>")
        for _ in range(self.r.integers(1, self.pick(4, 12, 30))):
            k = self.r.integers(14)
            if k == 0:
                parts.append(f"<h2>{self.main(1, 8)}</h2>")
            elif k == 1:
                parts.append("<ul>" + "".join(f"<li>{self.main(1, 20)}</li>" for _ in range(self.r.integers(1, 5))) + "</ul>")
            elif k == 2:
                parts.append(f"<blockquote>{self.pick('<p>', '')}{self.main(3, 40)}</blockquote>")
            elif k == 3:
                parts.append(f"<p><b>{self.main(1, 30)}<br>")
            elif k == 4 and self.r.random() < 0.6:
                parts.append(self.aside())
            elif k == 5:
                parts.append(f"<div>{self.main(2, 60)}</div>")
            elif k == 6:
                parts.append("<table><tr>" + "".join(f"<td>{self.main(1, 6)}</td>" for _ in range(self.r.integers(1, 4))) + "</tr></table>")
            else:
                parts.append(f"<p>{self.main(1, self.pick(4, 40, 200))}{self.pick('</p>', '</p>', '')}")
        return "".join(parts)

    def page(self) -> str:
        body = []
        if self.r.random() < 0.5:
            body.append(f'<header {self.pick("", self.attr("header", "masthead", "site-header"))}>{self.pick(f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(1, 6)}</p>")}{self.pick("", self.links(2, 6))}</header>')
        if self.r.random() < 0.8:
            body.append(self.pick(f"<nav>{self.links(3, 10)}</nav>", f'<div {self.attr("nav", "menu", "navbar", "navigation")}>{self.links(3, 10)}</div>'))
        for _ in range(self.pick(0, 1, 1, 2)):
            body.append(self.aside())
        inner = self.article()
        name = self.attr("content", "main", "post", "entry", "entry-content", "article", "post-body", "story", "text", "body")
        a, z = self.pick(("<article>", "</article>"), ("<article>", "</article>"), (f"<article {name}>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), (f"<div {name}>", "</div>"), (f"<section {name}>", "</section>"), (f"<div {name}><article>", "</article></div>"))
        body.append(a + inner + z)
        for _ in range(self.pick(0, 0, 1, 2)):
            body.append(self.aside())
        if self.r.random() < 0.35:
            body.append(self.comments())
        if self.r.random() < 0.85:
            body.append(self.pick(f"<footer>&copy; {self.words(1, 12)}</footer>", f'<footer {self.attr("footer", "site-footer")}><p>{self.words(2, 15)}</p>{self.links(1, 6)}</footer>', f'<div {self.attr("footer", "bottom", "copyright")}>&copy; {self.words(1, 10)}</div>'))
        page = f"<!DOCTYPE html><html><head><title>{self.words(1, 8)}</title></head><body>{''.join(body)}</body></html>"
        if self.r.random() < 0.1:
            page = page[: self.r.integers(len(page) // 2, len(page))]
        return page

    def labelled(self):
        page = self.page()
        found = [b for b in blocks(page) if b[0].replace(self.MARK, "").strip()]
        labels = np.array([self.MARK in text for text, _, _ in found])
        return [(text.replace(self.MARK, ""), path, linked) for text, path, linked in found], labels


@functools.lru_cache(maxsize=2)
def trained(pages: int = 700, epochs: int = 6, seed: int = 11) -> Labeller:
    maker, net = PageMaker(seed), Labeller()
    made = [maker.labelled() for _ in range(pages)]
    rows = [(features(p), y) for p, y in made if p]
    rows.sort(key=lambda r: len(r[1]))
    batches = [rows[i : i + 20] for i in range(0, len(rows), 20)]
    state, order = {}, np.random.default_rng(seed)
    for epoch in range(epochs):
        for k in order.permutation(len(batches)):
            net.step([f for f, _ in batches[k]], [y for _, y in batches[k]], state, 0.02 if epoch < epochs - 2 else 0.005)
    return net


def extract(pages: DataFrame, net: Labeller | None = None, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """page_id, the columns of `keep`, text, n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(net or trained())
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), *keep, F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: list[str] = []
            last = b.num_columns - 1
            for at in range(0, b.num_rows, 128):
                found = [blocks(x.as_py() or "") for x in b.column(last).slice(at, 128)]
                for page, own in zip(found, shared.value.keep([features(p) for p in found])):
                    texts.append(" ".join(t for (t, _, _), k in zip(page, own) if k))
            yield pa.RecordBatch.from_arrays([*b.columns[:last], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*b.schema.names[:last], "text", "n_chars"])

    out = ", ".join([f"`{c}` {t}" for c, t in rows.drop("html").dtypes] + ["text string", "n_chars long"])
    return rows.mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
