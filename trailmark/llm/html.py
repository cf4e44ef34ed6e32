"""Main text of web pages by a recurrent block labeller (operator 2).

A page is cut into leaf blocks: the text between block-level tags, inline markup dropped, character references decoded, white
space made one space. Scripts, styles and the head are no blocks. Each block gets the tags, classes, ids and roles on its
whole path (those that occur in training), all its words, both hashed into embedding tables, and a few numbers. A bidirectional LSTM in numpy reads the whole
sequence of a page and labels every block as main text or not; main blocks are joined in page order.

The model is trained here, once in a process, on seeded pages that a generator writes in many layouts; it sees neither the
input nor labels of it. Its size does not depend on the data.

Null and empty pages, and pages without a main block, give an empty text. Unclosed tags end with their parent, unclosed comments,
scripts, styles and titles with the page; other elements that are no text (svg, video, ...) lose only their tag when they are
not closed, and an svg or math tag that ends in `/>` is empty. Very long pages are read whole, one at a time. Repeated pages are
read each. An empty table gives no rows; other columns than the named ones are ignored.
"""

import html
import random
import re
import zlib
from collections import Counter
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trailmark.llm.common import slices, table

# Tags whose content is no text, tags inside a line, tags that close an open paragraph or sibling.
DROPPED = "script style noscript template svg math title head iframe object canvas audio video".split()
TO_THE_END = "script style title".split()
EMPTY_BY_SLASH = "svg math".split()
INLINE = "a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr br acronym picture source input".split()
VOID = "area base br col embed hr img input link meta source track wbr param".split()
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "p": "p"}
HEADINGS = "h1 h2 h3 h4 h5 h6".split()

PATH_ROWS, WORD_ROWS = 2048, 1024
WIDTH, HIDDEN, NUMBERS = 20, 14, 8
TRAIN_PAGES, EPOCHS, BATCH, SEED = 1200, 6, 20, 11
WORD_RATE, WORD_DECAY, WORDLESS = 0.15, 0.004, 0.4
KEEP_FROM = 0.5
KNOWN_WORDS = 200_000
BAG_PART = 1 << 16


class PageReader:
    """Cuts a page into blocks: (text, distinct path tokens, characters inside links, innermost tag).

    With `known`, only those path tokens are read. The time grows with the page, however malformed or deep it is: what follows the
    last `>` holds no whole tag and is not searched for one, and a path is that of the parent and what its own tag adds.
    """

    def __init__(self, known=None):
        self.known = known
        raw = "|".join(TO_THE_END)
        drop = "|".join(t for t in DROPPED if t != "head" and t not in TO_THE_END)
        attrs = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
        self.tag = re.compile(
            rf"<!--.*?(?:(?P<done>-->)|\Z)|<(?P<raw>{raw})(?=[\s/>])[^>]*+>(?:.*?(?P<shut></(?P=raw)\s*+>)|.*\Z)"
            rf"|<(?P<drop>{drop})(?=[\s/>])(?:{attrs}>|[^>]*+>)"
            rf"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>{attrs})>"
            r"|</?[a-zA-Z][^>]*+>|<![^>]*+>|<\?[^>]*+>", re.S | re.I)
        self.opening = re.compile(r"<[/a-zA-Z!?]")
        self.attr = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
        self.close = {t: re.compile(rf"</{t}\s*+>", re.I) for t in drop.split("|")}
        self.inline, self.void = frozenset(INLINE), frozenset(VOID)
        self.closes = {k: frozenset(v.split()) for k, v in CLOSES.items()}
        self.keeps_p = frozenset(["html", "body"])

    def path(self, above: tuple, name: str, attrs: str) -> tuple:
        """The path tokens of a tag: those above it and its own, each once."""
        own = [name]
        if "=" in attrs:
            for kind, a, b, c in self.attr.findall(attrs):
                own += [f".{w}" for w in re.findall(r"[a-z]+", (a or b or c).lower())]
        own = [t for t in dict.fromkeys(own) if t not in above and (self.known is None or t in self.known)]
        return (*above, *own) if own else above

    def blocks(self, page: str) -> list[tuple[str, list[str], int, str]]:
        out, stack, buffer, links, in_link, at = [], [], [], 0, 0, 0

        def flush():
            nonlocal buffer, links
            if buffer:
                text = " ".join(html.unescape("".join(buffer)).split())
                if text:
                    out.append((text, stack[-1][1] if stack else (), links, stack[-1][0] if stack else ""))
                buffer, links = [], 0

        def leave() -> str:
            name = stack.pop()[0]
            inside[name] -= 1
            return name

        inside = Counter()  # open elements by name
        never_closed = set()  # names without a closing tag in the rest of the page
        last = page.rfind(">") + 1
        cut = False  # by a comment, script, style or title that nothing closes
        while m := self.tag.search(page, at, last):
            a, z = m.span()
            if a > at:
                buffer.append(page[at:a])
                if in_link:
                    links += a - at
            at = z
            if m["drop"]:
                name = m["drop"].lower()
                if name in never_closed or name in EMPTY_BY_SLASH and page[z - 2] == "/":
                    continue
                if shut := self.close[name].search(page, z, last):
                    at = shut.end()
                else:
                    never_closed.add(name)
                continue
            name = m["name"]
            if name is None:
                cut = z == last and (m["raw"] is not None and m["shut"] is None or page.startswith("<!--", a) and m["done"] is None)
                continue
            name = name.lower()
            if name in self.inline:
                if name == "a":
                    in_link = 0 if m["end"] else 1
                elif name == "br":
                    buffer.append(" ")
                continue
            flush()
            in_link = 0
            if m["end"]:
                if inside[name]:
                    while leave() != name:
                        pass
                continue
            if name in self.void:
                continue
            if stack and stack[-1][0] == "p":
                leave()
            shut = self.closes.get(name)
            if shut:
                while stack and stack[-1][0] in shut:
                    leave()
            stack.append((name, self.path(stack[-1][1] if stack else (), name, m["attrs"] or "")))
            inside[name] += 1
        if not cut:
            rest = page[at:]
            end = rest.find("<!--", max(0, last - at))
            if end < 0:
                end = rest.rfind("<", max(0, last - at))
                end = end if self.opening.match(rest, max(end, 0)) and end >= 0 else -1
            buffer.append(rest if end < 0 else rest[:end])
        flush()
        return out


def _row(kind: str, token: str, rows: int) -> int:
    return zlib.crc32(f"{kind}:{token}".encode("utf-8", "surrogatepass")) % rows


class Encoder:
    """Blocks of a page as index lists and numbers. Of a path, each token that training pages have counts once: others
    were never learned, and the more of them there were, the less the learned ones would weigh."""

    def __init__(self):
        self.paths = path_rows()
        self.words: dict[str, int] = {}

    def page(self, blocks):
        if len(self.words) > KNOWN_WORDS:
            self.words.clear()
        n = len(blocks)
        paths, words, numbers = [], [], np.zeros((n, NUMBERS))
        for i, (text, path, links, tag) in enumerate(blocks):
            paths.append([self.paths[t] for t in dict.fromkeys(path) if t in self.paths])
            own = []
            for t in text.lower().split():
                k = self.words.get(t)
                if k is None:
                    k = self.words[t] = _row("word", t, WORD_ROWS)
                own.append(k)
            words.append(own)
            size = len(text)
            numbers[i] = (np.log1p(size) / 6, min(1.0, links / size), tag in HEADINGS, tag == "li", tag == "p", i / max(1, n - 1), 1.0 if text[-1:] in ".!?" else 0.0, np.log1p(n) / 5)
        return paths, words, numbers


def _bag(table_: np.ndarray, lists: list[list[int]]) -> np.ndarray:
    """Sum of the table's rows of each list over the root of its length; BAG_PART rows are held at a time."""
    out = np.zeros((len(lists), table_.shape[1]), table_.dtype)
    size = np.array([len(x) for x in lists], np.int64)
    rows = chain.from_iterable(lists)
    owner = np.repeat(np.arange(len(lists)), size)
    for at in range(0, len(owner), BAG_PART):
        own = owner[at : at + BAG_PART]
        start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        out[own[start]] += np.add.reduceat(table_[np.fromiter(islice(rows, len(own)), np.int64, len(own))], start, axis=0)  # each owner once
    return out / np.sqrt(np.maximum(size, 1))[:, None]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, w: np.ndarray, b: np.ndarray, keep: list | None = None) -> np.ndarray:
    """x [time, batch, width] to the hidden states of all times; with `keep` also what training needs."""
    steps, batch, _ = x.shape
    h, c = np.zeros((batch, HIDDEN)), np.zeros((batch, HIDDEN))
    out = np.empty((steps, batch, HIDDEN))
    for t in range(steps):
        z = np.hstack([x[t], h])
        g = z @ w + b
        i, f, o, u = _sigmoid(g[:, :HIDDEN]), _sigmoid(g[:, HIDDEN : 2 * HIDDEN] + 1), _sigmoid(g[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(g[:, 3 * HIDDEN :])
        before, c = c, f * c + i * u
        th = np.tanh(c)
        h = o * th
        out[t] = h
        if keep is not None:
            keep.append((z, i, f, o, u, before, th))
    return out


def _lstm_back(d_out: np.ndarray, w: np.ndarray, kept: list, width: int):
    dw, db = np.zeros_like(w), np.zeros(4 * HIDDEN)
    dx = np.empty((*d_out.shape[:2], width))
    dh, dc = np.zeros(d_out.shape[1:]), np.zeros(d_out.shape[1:])
    for t in reversed(range(len(kept))):
        z, i, f, o, u, before, th = kept[t]
        dh = dh + d_out[t]
        dc = dc + dh * o * (1 - th * th)
        dg = np.hstack([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - u * u)])
        dw += z.T @ dg
        db += dg.sum(0)
        dz = dg @ w.T
        dx[t], dh, dc = dz[:, :width], dz[:, width:], dc * f
    return dx, dw, db


def _flip(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Reverses each sequence [time, batch, ...] within its own length."""
    t = np.arange(x.shape[0])[:, None]
    at = np.where(t < sizes[None, :], sizes[None, :] - 1 - t, t)
    return x[at, np.arange(x.shape[1])[None, :]]


def _inputs(pages, p):
    """Block vectors of pages, padded to [time, batch, width]; also the flat parts that training needs."""
    sizes = np.array([len(x[2]) for x in pages])
    paths, words = [b for x in pages for b in x[0]], [b for x in pages for b in x[1]]
    numbers = np.concatenate([x[2] for x in pages])
    flat = np.tanh(_bag(p["path"], paths) + _bag(p["word"], words) + numbers @ p["num"] + p["bias"])
    time, batch = np.concatenate([np.arange(n) for n in sizes]), np.repeat(np.arange(len(sizes)), sizes)
    x = np.zeros((sizes.max(), len(sizes), WIDTH))
    x[time, batch] = flat
    return x, flat, sizes, time, batch, paths, words, numbers


def probabilities(pages, p) -> list[np.ndarray]:
    """P(main text) of every block of some pages with blocks."""
    x, _, sizes, time, batch, *_ = _inputs(pages, p)
    hf = _lstm(x, p["wf"], p["bf"])
    hb = _flip(_lstm(_flip(x, sizes), p["wb"], p["bb"]), sizes)
    y = _sigmoid(np.concatenate([hf, hb, x], 2) @ p["out"] + p["out_bias"])
    return [y[: sizes[i], i] for i in range(len(sizes))]


# Names and phrases that page furniture goes by.
FURNITURE = {
    "nav": (["<nav{}>", "<div class='nav'>", "<div class='menu'>", "<ul class='navbar'>", "<div id='navigation'>", "<div class='breadcrumbs'>", "<nav class='breadcrumb'>", "<div role='navigation'>", "<div class='topbar'>"], "home about contact products services archive blog news login register sitemap search help"),
    "header": (["<header{}>", "<div class='header'>", "<div id='masthead'>", "<div class='site-header'>", "<div role='banner'>", "<div class='logo'>"], "welcome to our site daily journal the official website since est"),
    "footer": (["<footer{}>", "<div class='footer'>", "<div id='footer'>", "<div class='site-footer'>", "<div class='copyright'>", "<div role='contentinfo'>"], "© copyright all rights reserved privacy policy terms of use imprint powered by ·"),
    "aside": (["<aside{}>", "<div class='sidebar'>", "<div id='sidebar'>", "<div class='widget'>", "<div class='related'>", "<section class='related-posts'>", "<div class='popular'>", "<div role='complementary'>", "<div class='recommended'>"], "related popular recent posts most read tags categories see also you may like recommended"),
    "ad": (["<div class='ad'>", "<div class='ads'>", "<div class='advert'>", "<div class='advertisement'>", "<section class='promo'>", "<div class='sponsored'>", "<div class='banner'>", "<div id='ad-top'>", "<p class='ad'>", "<aside class='ad'>"], "sponsored advertisement buy now sale offer discount free shipping click here"),
    "notice": (["<div class='cookie-notice'>", "<div class='cookies'>", "<div class='notice'>", "<div class='alert'>", "<div id='consent'>", "<div class='popup'>", "<div class='modal'>", "<div role='alert'>", "<p class='notice'>", "<div class='gdpr'>", "<div class='subscribe'>", "<div class='paywall'>"], "we use cookies accept consent this site your browser javascript is required subscribe sign up"),
    "form": (["<form{}>", "<form class='search'>", "<form class='newsletter'>", "<form id='login'>", "<div class='newsletter'>", "<fieldset>"], "your email subscribe send name password search submit sign up newsletter"),
    "comments": (["<div class='comments'>", "<section id='comments'>", "<ol class='commentlist'>", "<div class='comment-list'>", "<div id='disqus'>", "<section class='responses'>", "<div class='reader-comments'>", "<div class='reviews'>", "<section class='comments'>"], "comments reply says posted by thanks great article agree i think replies"),
    "share": (["<div class='share'>", "<div class='social'>", "<ul class='sharing'>", "<div class='byline-tools'>"], "share tweet facebook print email this pin like follow us"),
}
CONTAINERS = ["<article>", "<main>", "<article class='post'>", "<div class='content'>", "<div class='entry'>", "<div class='post-body'>", "<div class='article'>", "<div id='content'>", "<section class='story'>", "<div role='main'>", "<main><article>", "<div class='main'><article>", "<div class='article-body'>", "<article id='post'>"]


def generated_page(rnd: random.Random) -> tuple[str, list[str]]:
    """A page, and its main blocks in order."""
    syllables = [rnd.choice("bcdfghklmnprstvwz") + rnd.choice("aeiouéäöó") + rnd.choice(["", "n", "r", "s", "ch"]) for _ in range(40)]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))

    def prose(low: int, high: int) -> str:
        words = [word() for _ in range(rnd.randint(low, high))]
        return " ".join(words).capitalize() + rnd.choice([".", ".", "", "!"])

    main: list[str] = []

    def keep(text: str) -> str:
        main.append(text)
        return text

    def furniture(kind: str) -> str:
        opens, phrases = FURNITURE[kind]
        tag = rnd.choice(opens).format(rnd.choice(["", " class='x" + word() + "'"]))
        name = re.match(r"<(\w+)", tag)[1]
        said = lambda: " ".join(rnd.sample(phrases.split(), min(len(phrases.split()), rnd.randint(1, 5)))) if rnd.random() < 0.5 else prose(2, 14)
        if kind == "nav" or kind in ("aside", "share", "footer", "header") and rnd.random() < 0.5:
            links = [f"<a href='/{i}'>{said()}</a>" for i in range(rnd.randint(1, 7))]
            inner = "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if name not in ("ul", "p") and rnd.random() < 0.7 else "".join((f"<li>{x}</li>" if name == "ul" else x + " ") for x in links)
        elif kind == "comments":
            inner = "".join(rnd.choice(["<div class='comment'><p>{}</p></div>", "<li><p>{}</p></li>", "<p>{}</p>", "<article class='comment'><p>{}</p></article>", "<div class='comment'><h4>{}</h4><p>" + prose(4, 40) + "</p></div>"]).format(prose(4, 60)) for _ in range(rnd.randint(1, 6)))
            inner = rnd.choice(["", "<h3>" + said() + "</h3>"]) + inner
        elif kind == "form":
            inner = f"<label>{said()}</label><input name='q'><button>{said()}</button>" + rnd.choice(["", f"<p>{said()}</p>"])
        else:
            inner = rnd.choice([said(), f"<p>{said()}</p>", f"<h4>{said()}</h4><p>{prose(3, 30)}</p>", prose(3, 30), f"<div>{said()}</div>"]) if name != "p" else said()
        return f"{tag}{inner}</{name}>"

    def body_part() -> str:
        kind = rnd.random()
        if kind < 0.72:
            text = prose(1, 120) if rnd.random() < 0.8 else prose(1, 5)
            keep(text)
            return rnd.choice(["<p>{}</p>"] * 6 + ["<p><b>{}<br>", "<p>{}", "<div>{}</div>", "<p class='lead'>{}</p>", "<p><a href='/x'>{}</a></p>"]).format(text)
        if kind < 0.82:
            return "<{0}>{1}</{0}>".format(rnd.choice(["h2", "h3", "h4"]), keep(prose(1, 8)))
        if kind < 0.9:
            return rnd.choice(["<ul>{}</ul>", "<ol>{}</ol>"]).format("".join(f"<li>{keep(prose(1, 20))}</li>" for _ in range(rnd.randint(1, 5))))
        if kind < 0.94:
            return f"<blockquote><p>{keep(prose(4, 40))}</p></blockquote>"
        if kind < 0.97:
            return f"<table><tr><td>{keep(prose(1, 4))}</td><td>{keep(prose(1, 4))}</td></tr></table>"
        return f"<figure><figcaption>{keep(prose(2, 10))}</figcaption></figure>"

    kinds = list(FURNITURE)
    before = [furniture(rnd.choice(["nav", "header", "ad", "notice", "form", "aside", "nav"])) for _ in range(rnd.choice([0, 1, 2, 2, 3, 4]))]
    opened = rnd.choice(CONTAINERS)
    parts = [opened]
    if rnd.random() < 0.75:
        head = keep(prose(1, 10))
        parts.append(rnd.choice(["<h1>{}</h1>", "<header><h1>{}</h1></header>", "<h1 class='title'>{}</h1>"] if rnd.random() < 0.5 else ["<h1>{}</h1>"]).format(head))
    inside = rnd.random() < 0.5
    for _ in range(rnd.choice([1, 1, 2, 3, 4, 6, 9, 14])):
        parts.append(body_part())
        if inside and rnd.random() < 0.2:
            parts.append(furniture(rnd.choice(["ad", "aside", "share", "notice", "form"])))
    if inside and rnd.random() < 0.3:
        parts.append(furniture(rnd.choice(["comments", "share", "form"])))
    parts += [f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opened))]
    after = [furniture(rnd.choice(["footer", "comments", "aside", "ad", "share", "form", "footer", rnd.choice(kinds)])) for _ in range(rnd.choice([0, 1, 1, 2, 3, 4]))]
    wrap = rnd.choice(["{}", "{}", "<div class='wrapper'>{}</div>", "<div id='page'>{}</div>"])
    return "<html><head><title>" + prose(1, 6) + "</title></head><body>" + wrap.format("".join(before + parts + after)) + "</body></html>", main


@lru_cache(maxsize=1)
def path_rows() -> dict[str, int]:
    """The path tokens of generated pages and their rows."""
    rnd, reader, pages = random.Random(SEED), PageReader(), Counter()
    for _ in range(TRAIN_PAGES // 4):
        pages.update({t for _, path, _, _ in reader.blocks(generated_page(rnd)[0]) for t in path})
    return {t: _row("path", t, PATH_ROWS) for t, n in sorted(pages.items()) if n > 2}


def training_pages(count: int, seed: int):
    """(encoded page, block labels): a block is main if it is the next main block of its page."""
    rnd, reader, encoder, out = random.Random(seed), PageReader(), Encoder(), []
    while len(out) < count:
        page, main = generated_page(rnd)
        blocks, at, y = reader.blocks(page), 0, []
        for text, *_ in blocks:
            hit = at < len(main) and text == " ".join(main[at].split())
            at += hit
            y.append(float(hit))
        if blocks and at == len(main):
            out.append((encoder.page(blocks), np.array(y)))
    return out


@lru_cache(maxsize=2)
def train(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Weights by Adam on backpropagation through time; the same on every run."""
    data, rng = training_pages(pages, seed), np.random.default_rng(seed)
    init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    p = {"path": np.zeros((PATH_ROWS, WIDTH)), "word": np.zeros((WORD_ROWS, WIDTH)), "num": init(NUMBERS, WIDTH), "bias": np.zeros(WIDTH),
         "wf": init(WIDTH + HIDDEN, 4 * HIDDEN), "bf": np.zeros(4 * HIDDEN), "wb": init(WIDTH + HIDDEN, 4 * HIDDEN), "bb": np.zeros(4 * HIDDEN),
         "out": init(2 * HIDDEN + WIDTH), "out_bias": np.zeros(())}
    p["path"] += rng.normal(0, 0.05, p["path"].shape)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), BATCH):
            chosen = [data[i] for i in order[at : at + BATCH]]
            shown = [c[0] if rng.random() >= WORDLESS else (c[0][0], [[] for _ in c[0][1]], c[0][2]) for c in chosen]
            x, flat, sizes, time, batch, paths, words, numbers = _inputs(shown, p)
            y = np.concatenate([c[1] for c in chosen])
            kf, kb = [], []
            hf = _lstm(x, p["wf"], p["bf"], kf)
            hb = _flip(_lstm(_flip(x, sizes), p["wb"], p["bb"], kb), sizes)
            joint = np.concatenate([hf, hb, x], 2)
            d = np.zeros(joint.shape[:2])
            d[time, batch] = (_sigmoid(joint[time, batch] @ p["out"] + p["out_bias"]) - y) / len(y)
            dj = d[..., None] * p["out"]
            dxf, gwf, gbf = _lstm_back(dj[..., :HIDDEN], p["wf"], kf, WIDTH)
            dxb, gwb, gbb = _lstm_back(_flip(dj[..., HIDDEN : 2 * HIDDEN], sizes), p["wb"], kb, WIDTH)
            dx = (dxf + _flip(dxb, sizes) + dj[..., 2 * HIDDEN :])[time, batch] * (1 - flat * flat)
            g = {"num": numbers.T @ dx, "bias": dx.sum(0), "wf": gwf, "bf": gbf, "wb": gwb, "bb": gbb, "out": np.einsum("tb,tbh->h", d, joint), "out_bias": d.sum()}
            for name, lists in (("path", paths), ("word", words)):
                size = np.array([len(b) for b in lists])
                grad = np.zeros_like(p[name])
                np.add.at(grad, np.fromiter((k for b in lists for k in b), np.int64, int(size.sum())), np.repeat(dx / np.sqrt(np.maximum(size, 1))[:, None], size, axis=0))
                g[name] = grad + 1e-5 * p[name]
            step += 1
            rate = 0.01 * (0.4 if epoch >= epochs - 2 else 1)
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                p[k] = p[k] * (1 - WORD_DECAY * (k == "word")) - rate * (WORD_RATE if k == "word" else 1) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return p


def labelled_blocks(pages: list[str], p, reader: PageReader, encoder: Encoder) -> list[list[tuple[str, float]]]:
    """(text, probability) of each block of each page. Pages of like length are read together."""
    cut = [reader.blocks(x) for x in pages]
    out: list[list[tuple[str, float]]] = [[] for _ in pages]
    order = sorted((i for i in range(len(pages)) if cut[i]), key=lambda i: len(cut[i]))
    at = 0
    while at < len(order):
        longest = len(cut[order[min(at + 63, len(order) - 1)]])
        to = at + (64 if longest < 2000 else 1)
        chosen = order[at:to]
        for i, y in zip(chosen, probabilities([encoder.page(cut[i]) for i in chosen], p)):
            out[i] = [(b[0], float(q)) for b, q in zip(cut[i], y)]
        at = to
    return out


def _extract(model, columns: list[str], page: str):
    def run(batches):
        encoder = Encoder()
        p, reader = model.value, PageReader(encoder.paths)
        for part in slices(batches, page, 1 << 20):
            pages = [x or "" for x in part.column(part.schema.get_field_index(page)).to_pylist()]
            found = labelled_blocks(pages, p, reader, encoder)
            texts = ["\n".join(t for t, q in blocks if q >= KEEP_FROM) for blocks in found]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(part.schema.get_field_index(c)) for c in columns), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in found], pa.int64())],
                [*columns, "text", "n_chars", "n_blocks"])

    return run


def extract(pages: DataFrame, columns: list[str], page: str = "html") -> DataFrame:
    """The named columns, text, n_chars, n_blocks (blocks seen) of every page; one pass, no shuffle."""
    model = pages.sparkSession.sparkContext.broadcast(train())
    kinds = dict(pages.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "text string, n_chars long, n_blocks long"])
    return pages.select(*columns, page).mapInArrow(_extract(model, columns, page), schema)


def op2_html_blocks(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
