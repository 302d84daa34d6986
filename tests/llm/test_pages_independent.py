"""The page labeller against a plain replay, on very long pages, and on the given pages by an independent parser."""

import math
import tracemalloc
from html.parser import HTMLParser

import numpy as np

from marlstone.llm import htmltext as ht


def replayed(net, page):
    """The network for one page, block by block, in plain loops."""
    (paths, pe), (words, we), figures = ht.features(page)
    n, h, w = len(page), ht.HIDDEN, net.w
    x = []
    for k in range(n):
        p, v = paths[pe[k] : pe[k + 1]], words[we[k] : we[k + 1]]
        x.append([sum(w["path"][i][d] for i in p) / math.sqrt(len(p)) for d in range(ht.D_PATH)] + [sum(w["word"][i][d] for i in v) / len(v) for d in range(ht.D_WORD)] + list(figures[k]))
    sig = lambda a: 1 / (1 + math.exp(-a))
    states = {}
    for way, order in (("f", range(n)), ("b", range(n - 1, -1, -1))):
        hs, cs = [0.0] * h, [0.0] * h
        for k in order:
            a = [sum(x[k][i] * w[f"x{way}"][i][j] for i in range(len(x[k]))) + sum(hs[i] * w[f"h{way}"][i][j] for i in range(h)) + w[f"c{way}"][j] for j in range(4 * h)]
            cs = [sig(a[h + j]) * cs[j] + sig(a[j]) * math.tanh(a[3 * h + j]) for j in range(h)]
            hs = [sig(a[2 * h + j]) * math.tanh(cs[j]) for j in range(h)]
            states[way, k] = hs
    out = w["out"][:, 0]
    return [sum(a * b for a, b in zip(states["f", k] + states["b", k] + x[k], out)) + w["bias"][0] for k in range(n)]


def test_replay():
    net, maker = ht.trained(), ht.PageMaker(5)
    pages = [p for p, _ in (maker.labelled() for _ in range(12)) if p and len(p) < 25]
    feats = [ht.features(p) for p in pages]
    for cells in (1 << 14, 7):  # together, and in stretches of a block
        z = net.scores(feats, cells)
        for k, p in enumerate(pages):
            assert np.allclose(z[: len(p), k], replayed(net, p), atol=1e-8)
        kept = net.keep(feats, cells)
        assert all((z[: len(p), k] > 0).tolist() == kept[k].tolist() for k, p in enumerate(pages))


def test_very_long_pages_take_bounded_memory():
    net = ht.trained()
    long = "<html><body><article>" + "".join(f"<p>word {k} of many</p>" for k in range(50_000)) + "</article></body></html>"
    short = "<html><body><nav><a href=x>Menu</a></nav><article><p>It is short.</p></article></body></html>"
    tracemalloc.start()
    found = [ht.blocks(p) for p in [long] + [short] * 127]
    kept = net.keep([ht.features(p) for p in found])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(kept[0]) == 50_000 and peak < 500e6
    assert ht.blocks("<div>" * 100_000 + "x") and len(ht.blocks("<div>x" * 20_000)) == 20_000
    one = ht.features([("a " * 300_000, ("p",), 0)])
    assert np.allclose(ht._sums(net.w["word"], *one[1]), net.w["word"][one[1][0]].sum(axis=0))


class Plain(HTMLParser):
    """Text in <article>, without what stands in asides of any kind there."""

    def __init__(self):
        super().__init__()
        self.open, self.text = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in ("br", "img", "input", "meta", "link", "hr"):
            self.open.append((tag, " ".join(v or "" for k, v in attrs if k in ("class", "id"))))
        if tag not in ht.INLINE or tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag):
        while self.open and tag in (t for t, _ in self.open):
            if self.open.pop()[0] == tag:
                break
        self.text.append(" ")

    def handle_data(self, data):
        tags = [t for t, _ in self.open]
        if "article" in tags and not {"script", "style", "nav", "aside", "form", "footer"} & set(tags) and not any(n for t, n in self.open if t != "article"):
            self.text.append(data)


def test_given_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: r.text for r in ht.extract(pages).collect()}
    right, rows = 0, pages.collect()
    for r in rows:
        p = Plain()
        p.feed(r.html or "")
        right += " ".join("".join(p.text).split()) == " ".join(got[r.page_id].split())
    assert right / len(rows) > 0.97, right / len(rows)
