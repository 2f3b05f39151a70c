"""Main text of web pages by a recurrent block labeller.

A page is read into leaves: runs of text between block-level tags, in page order, each with the path of open
elements (tag names, and the words of class, id and role). A bidirectional LSTM in numpy reads for each leaf a
vector of its hashed tag path, a vector of its hashed words and a few measures, and labels every leaf with the
context of the whole page before and behind it. Leaves labelled as main text are joined in page order.

The labeller is trained here on pages that are made up for it (``made_page``): articles among menus, headers,
footers, side bars, notices, adverts, forms and comments, under many element and class names, with invented words.
Training takes seconds, is seeded, and is kept for the life of the process.

Defined results: null or empty html, and pages without main text, give the empty string; markup that is cut off
or wrongly nested is read as browsers do for the common cases (an open ``script`` or comment swallows the rest);
character references are decoded once; white space of any kind inside a leaf becomes one space; very long and very
deep pages are read whole, in time linear in their length, with the vectors of a bounded number of leaves at once;
repeated rows give equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import fields

#: Fixed values of HTML: elements without an end, elements whose content is no text, elements that stand in a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = "script style noscript template iframe svg object textarea head"
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
#: Elements that end an open element of the named kinds where they begin.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ATTRS = r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+"


def _token(attrs: str) -> re.Pattern[str]:
    return re.compile(
        r"<!--(?:.*?-->|.*\Z)"
        rf"|<(?P<hidden>{HIDDEN.replace(' ', '|')})(?=[\s/>]){attrs}>(?:.*?</(?P=hidden)[^>]*>|.*\Z)"
        rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>{attrs})>"
        r"|<[!?/][^>]*>",
        re.S | re.I,
    )


TOKEN, PLAIN_TOKEN = _token(_ATTRS), _token("[^>]*+")


def tokens(page: str) -> Iterator[re.Match[str]]:
    """Tags, comments and hidden elements, in time linear in the page.

    A tag that its quotes keep open to the end of the page makes quotes count for nothing from there on (one such scan is
    enough to know it); behind the last ``>`` only a comment is looked for.
    """
    pattern, last, at = TOKEN, page.rfind(">"), page.find("<")
    while at >= 0:
        if at > last:
            at = page.find("<!--", at)
            if at >= 0:
                yield TOKEN.match(page, at)
            return
        m = pattern.match(page, at)
        if m is None and pattern is TOKEN and page[at + 1 : at + 2].isalpha() or page[at + 1 : at + 2] == "/" and m is None:
            pattern = PLAIN_TOKEN
            m = pattern.match(page, at)
        if m is not None:
            yield m
        at = page.find("<", at + 1 if m is None else m.end())


NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
LETTERS = re.compile(r"[a-z]+")
PATH_DIM, WORD_DIM, EXTRA = 192, 48, 6
FEATURES = PATH_DIM + WORD_DIM + EXTRA
#: Containers at which the search for an open sibling ends.
HOLDERS = ("ul", "ol", "dl", "table", "select")


class Path:
    """The open block elements of a place, as a chain that shares its beginning with others; its vector grows with it."""

    __slots__ = ("above", "label", "inner", "marks", "_vector")

    def __init__(self, above: Path | None = None, label: str = ""):
        self.above, self.label, self.inner, self._vector = above, label, {}, None
        #: the hashed tags and names of the whole path
        self.marks = (above.marks | frozenset(_buckets(label))) if above else frozenset()

    def child(self, label: str) -> Path:
        found = self.inner.get(label)
        if found is None:
            found = self.inner[label] = Path(self, label)
        return found

    def labels(self) -> tuple[str, ...]:
        out, at = [], self
        while at.above is not None:
            out.append(at.label)
            at = at.above
        return tuple(reversed(out))

    def __eq__(self, other) -> bool:
        return self.labels() == (other.labels() if isinstance(other, Path) else other)

    __hash__ = object.__hash__

    def vector(self) -> np.ndarray:
        """Hashed tags and names of the path; those of the last element also under a place of their own."""
        if self._vector is None:
            self._vector = np.zeros(PATH_DIM, np.float32)
            self._vector[list(self.marks)] = 1
            self._vector[_buckets(self.label, "!")] = 1
        return self._vector


@lru_cache(maxsize=20_000)
def _buckets(label: str, place: str = "") -> list[int]:
    tag, _, names = label.partition(" ")
    return [zlib.crc32(f"{w}{place}".encode()) % PATH_DIM for w in (tag, *(f".{x}" for x in LETTERS.findall(names))) if w]


class OpenElements:
    """The stack of open elements; every question that reading a tag asks is answered without walking the stack."""

    def __init__(self, root: Path):
        self.tags: list[str] = []
        self.paths: list[Path] = [root]  # of the blocks, at and below each element
        self.blocks: list[int] = []  # places of block elements
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, label: str) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        if tag not in INLINE:
            self.blocks.append(len(self.tags))
        self.paths.append(self.paths[-1] if tag in INLINE else self.paths[-1].child(label))
        self.tags.append(tag)

    def last(self, tag: str) -> int:
        """The place of the innermost open element of this name, or -1."""
        found = self.places.get(tag)
        return found[-1] if found else -1

    def cut(self, place: int) -> None:
        """Close everything from ``place`` inwards."""
        while len(self.tags) > place:
            self.places[self.tags.pop()].pop()
            self.paths.pop()
            if self.blocks and self.blocks[-1] == len(self.tags):
                self.blocks.pop()

    def close(self, tag: str) -> None:
        place = self.last(tag)
        if place >= 0 and not (tag in INLINE and self.blocks and self.blocks[-1] > place):  # an inline end does not close blocks
            self.cut(place)

    def make_way(self, tag: str) -> None:
        """Close what ends where ``tag`` begins."""
        if tag in ENDS_P and self.blocks and self.tags[self.blocks[-1]] == "p":
            self.cut(self.blocks[-1])
        if tag in SIBLINGS:
            place = max(map(self.last, SIBLINGS[tag]))
            if place > max(map(self.last, HOLDERS)):
                self.cut(place)


def leaves(page: str, root: Path | None = None) -> list[tuple[Path, str, int]]:
    """(path, text, letters inside links) of every leaf with text, in page order; in time linear in the page."""
    out: list[tuple[Path, str, int]] = []
    stack = OpenElements(root or Path())
    parts: list[str] = []
    linked = 0

    def end() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((stack.paths[-1], text, linked))
            parts.clear()
        linked = 0

    at = 0
    for m in tokens(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if stack.last("a") >= 0:
                linked += m.start() - at
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["hidden"] and m["hidden"].lower() == "head":
                end()
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            end()
        if m["close"]:
            stack.close(tag)
            continue
        stack.make_way(tag)
        if tag not in VOID:  # a slash closes nothing else
            names = " ".join(x for n in NAMES.findall(m["attrs"]) for x in n[1:] if x)
            stack.push(tag, f"{tag} {names.lower()}" if names else tag)
    if at < len(page):
        parts.append(page[at:])
    end()
    return out


@lru_cache(maxsize=100_000)
def word_bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_DIM


def features(page: list[tuple[Path, str, int]], start: int = 0, stop: int | None = None) -> np.ndarray:
    """The vectors of the leaves from ``start`` to ``stop``."""
    part = page[start:stop]
    x = np.zeros((len(part), FEATURES), np.float32)
    for i, (path, text, linked) in enumerate(part):
        x[i, :PATH_DIM] = path.vector()
        words = text.lower().split()
        counts = np.bincount([word_bucket(w) for w in words], minlength=WORD_DIM)
        x[i, PATH_DIM : PATH_DIM + WORD_DIM] = counts / len(words)
        n = len(text)
        x[i, -EXTRA:] = (min(1.0, np.log1p(n) / 8), min(1.0, linked / n), min(1.0, (text.count(".") + text.count(",")) * 20 / n), (start + i) / len(page), min(1.0, len(page) / 100), float(text[-1] in ".!?"))
    return x


class BiLstm:
    """A bidirectional LSTM with a logistic output for each step; plain numpy, with its own training step."""

    def __init__(self, inputs: int = FEATURES, hidden: int = 16, seed: int = 5):
        r = np.random.default_rng(seed)
        self.h = hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"W{d}"] = (r.standard_normal((inputs, 4 * hidden)) * 0.1).astype(np.float32)
            self.p[f"U{d}"] = (r.standard_normal((hidden, 4 * hidden)) * 0.2).astype(np.float32)
            self.p[f"c{d}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)
        self.p["V"] = (r.standard_normal(2 * hidden) * 0.2).astype(np.float32)
        self.p["v"] = np.zeros(1, np.float32)

    def _pass(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None, state: list | None = None) -> np.ndarray:
        """Hidden states (T, B, H) of one direction; masked steps carry the state on. ``state`` is where to begin, and is left at the end."""
        t_max, b, _ = x.shape
        n = self.h
        z_in = x @ self.p[f"W{d}"] + self.p[f"c{d}"]
        h, c = state or (np.zeros((b, n), np.float32), np.zeros((b, n), np.float32))
        out = np.zeros((t_max, b, n), np.float32)
        for t in range(t_max) if d == "f" else range(t_max - 1, -1, -1):
            z = z_in[t] + h @ self.p[f"U{d}"]
            g = 1 / (1 + np.exp(-z[:, : 3 * n]))
            i, f, o = g[:, :n], g[:, n : 2 * n], g[:, 2 * n :]
            u = np.tanh(z[:, 3 * n :])
            m = mask[t][:, None]
            c2 = f * c + i * u
            tc = np.tanh(c2)
            if keep is not None:
                keep.append((t, h, c, i, f, o, u, tc, m))
            h, c = m * (o * tc) + (1 - m) * h, m * c2 + (1 - m) * c
            out[t] = h
        if state is not None:
            state[:] = h, c
        return out

    def in_pieces(self, piece: Callable[[int, int], tuple[np.ndarray, np.ndarray]], steps: int, width: int, size: int) -> np.ndarray:
        """Probabilities (T, B) of a long sequence; ``piece(start, stop)`` gives inputs and mask of ``size`` steps at a time."""
        total = np.zeros((steps, width), np.float32)
        starts = range(0, steps, size)
        for d, order, part in (("f", starts, slice(0, self.h)), ("b", reversed(starts), slice(self.h, 2 * self.h))):
            state = [np.zeros((width, self.h), np.float32)] * 2
            for s in order:
                x, mask = piece(s, min(steps, s + size))
                total[s : s + size] += self._pass(d, x, mask, state=state) @ self.p["V"][part]
        return 1 / (1 + np.exp(-(total + self.p["v"])))

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        hs = np.concatenate([self._pass("f", x, mask), self._pass("b", x, mask)], axis=2)
        return 1 / (1 + np.exp(-(hs @ self.p["V"] + self.p["v"])))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over all unmasked steps, by back-propagation through time."""
        n, kept = self.h, {"f": [], "b": []}
        hs = np.concatenate([self._pass(d, x, mask, kept[d]) for d in "fb"], axis=2)
        prob = 1 / (1 + np.exp(-(hs @ self.p["V"] + self.p["v"])))
        err = (prob - y) * mask / mask.sum()
        grads = {"V": np.einsum("tb,tbh->h", err, hs), "v": np.array([err.sum()], np.float32)}
        for d, part in (("f", slice(0, n)), ("b", slice(n, 2 * n))):
            dz_all = np.zeros((*x.shape[:2], 4 * n), np.float32)
            du = np.zeros_like(self.p[f"U{d}"])
            dh, dc = np.zeros((x.shape[1], n), np.float32), np.zeros((x.shape[1], n), np.float32)
            for t, h0, c0, i, f, o, u, tc, m in reversed(kept[d]):
                dh = dh + err[t][:, None] * self.p["V"][part]
                gh, gc = dh * m, dc * m
                gc = gc + gh * o * (1 - tc * tc)
                dz = np.concatenate([gc * u * i * (1 - i), gc * c0 * f * (1 - f), gh * tc * o * (1 - o), gc * i * (1 - u * u)], axis=1)
                dz_all[t] = dz
                du += h0.T @ dz
                dh = dh * (1 - m) + dz @ self.p[f"U{d}"].T
                dc = dc * (1 - m) + gc * f
            grads[f"W{d}"] = np.einsum("tbi,tbz->iz", x, dz_all, optimize=True)
            grads[f"U{d}"], grads[f"c{d}"] = du, dz_all.sum((0, 1))
        return grads


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, pages))
    x, mask = np.zeros((t, len(pages), FEATURES), np.float32), np.zeros((t, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


#: Names that pages use around main text and around everything else.
MAIN_WRAPS = ["<article>", "<main>", '<div class="content">', '<div class="post">', '<div id="article-body">', '<section class="story">', '<div class="entry-content">', '<article class="post">', '<div class="main-text">', '<div role="main">', "<div>"]
OTHER_WRAPS = {
    "menu": ["<nav>", '<ul class="menu">', '<div class="navbar">', '<div id="nav">', '<nav class="breadcrumb">', '<div class="topnav">', '<div role="navigation">'],
    "header": ["<header>", '<div class="header">', '<div id="masthead">', '<div class="site-header">', '<div class="banner">'],
    "side": ["<aside>", '<div class="sidebar">', '<div id="side">', '<aside class="related">', '<div class="widget">', '<section class="recommended">'],
    "notice": ['<div class="cookie">', '<div class="notice">', '<div id="cookie-banner">', '<div class="alert">', '<section class="consent">', '<div class="popup modal">', '<p class="notice">', '<div role="alert">'],
    "advert": ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="sponsored">', '<div class="promo">', '<div id="ad-slot">', '<ins class="adsbox">', '<section class="advertisement">'],
    "form": ["<form>", '<form class="newsletter">', '<div class="subscribe">', '<form id="search">', '<form class="login">'],
    "comments": ['<div class="comments">', '<section id="comments">', '<ol class="comment-list">', '<div class="comment">', '<section class="responses">', '<div id="disqus-thread">', '<ul class="reader-comments">'],
    "footer": ["<footer>", '<div class="footer">', '<div id="footer">', '<div class="copyright">', '<div class="share social">', '<footer class="site-footer">'],
}


BLOCK_TAG = re.compile(r"<(/?)(?!html|body|a\b|input|br)[a-z]\w*[^>]*>")


def made_page(r: random.Random, neutral: float = 0.0) -> tuple[str, list[str]]:
    """A made-up page and the texts of its main leaves; with the chance ``neutral`` all its blocks are bare ``div`` elements."""
    letters = "aeiorntslmdhu"

    def words(a: int, b: int) -> str:
        ws = ["".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(r.randint(a, b))]
        return " ".join(w + ("," if r.random() < 0.06 else "." if r.random() < 0.06 else "") for w in ws)

    main: list[str] = []

    def close(wrap: str) -> str:
        return f"</{re.match(r'<(\w+)', wrap)[1]}>"

    def other(kind: str) -> str:
        wrap = r.choice(OTHER_WRAPS[kind])
        items = r.randint(1, 6)
        if kind in ("menu", "footer") or kind in ("side", "header") and r.random() < 0.5:
            inner = "".join(f'<li><a href="/{k}">{words(1, 3)}</a></li>' if r.random() < 0.7 else f"<a>{words(1, 2)}</a> " for k in range(items))
            inner = f"<ul>{inner}</ul>" if r.random() < 0.6 else inner
            inner += f"&copy; {words(2, 12)}" if kind == "footer" and r.random() < 0.7 else ""
        elif kind == "form":
            inner = f"<label>{words(1, 4)}</label><input><button>{words(1, 2)}</button>" + (f"<p>{words(4, 14)}</p>" if r.random() < 0.5 else "")
        elif kind == "comments":
            inner = (f"<h3>{words(1, 3)}</h3>" if r.random() < 0.5 else "") + "".join(f"<{t}>{words(5, 60)}</{t}>" for t in (r.choice(["p", "div", "li"]) for _ in range(items)))
        else:
            inner = words(3, 25) if r.random() < 0.6 else "".join(f"<p>{words(3, 40)}</p>" for _ in range(r.randint(1, 3)))
            inner = f"<h4>{words(1, 4)}</h4>{inner}" if r.random() < 0.25 else inner
        return wrap + inner + close(wrap)

    def leaf(tag: str, text: str) -> str:
        main.append(" ".join(text.split()))
        return f"<{tag}>{text}" + ("" if tag in ("p", "li") and r.random() < 0.2 else f"</{tag}>")

    def article() -> str:
        wrap = r.choice(MAIN_WRAPS)
        out = [wrap]
        if r.random() < 0.8:
            out.append(leaf(r.choice(["h1", "h1", "h2"]), words(3, 14)))
        for _ in range(r.choice([0, 1, 2, 3, 5, 8, 14] * 8 + [30])):
            k = r.random()
            if k < 0.08:
                out.append(leaf(r.choice(["h2", "h3"]), words(1, 6)))
            elif k < 0.14:
                out.append("<ul>" + "".join(leaf("li", words(2, 20)) for _ in range(r.randint(1, 5))) + "</ul>")
            elif k < 0.2:
                out.append(f"<{(t := r.choice(['blockquote', 'pre', 'td', 'div']))}>" + leaf("p", words(3, 40)) + f"</{t}>")
            elif k < 0.23:
                out.append("<figure><img src=x>" + leaf("figcaption", words(2, 20)) + "</figure>")
            elif k < 0.3:
                out.append(other(r.choice(["advert", "side", "form", "notice"])))
            elif k < 0.33:
                out.append("<details>" + leaf("summary", words(1, 8)) + leaf("p", words(3, 60)) + "</details>")
            elif k < 0.35:  # a line that is repeated, as in songs, logs and junk
                line = words(1, 8)
                out += [leaf("p", line) for _ in range(r.choice([3, 6, 12, 40]))]
            else:
                out.append(leaf("p", words(1, 90) if r.random() < 0.8 else words(1, 4)))
        if r.random() < 0.15:
            out.append(other(r.choice(["comments", "footer"])))
        return "".join(out) + close(wrap)

    before = [other(k) for k in ("notice", "header", "menu", "advert", "side", "form") if r.random() < 0.4]
    r.shuffle(before)
    inner = article()
    after = [other(k) for k in ("advert", "comments", "side", "form", "notice") if r.random() < 0.35]
    r.shuffle(after)
    after += [other("footer")] if r.random() < 0.7 else []
    if r.random() < 0.3:
        inner = f"<div>{inner}</div>"
    page = "".join(before) + inner + "".join(after)
    if neutral and r.random() < neutral:
        page = BLOCK_TAG.sub(r"<\1div>", re.sub(r"<(p|li)>([^<]*)(?=<(?:p|li|/ul)>)", r"<\1>\2</\1>", page))
    return f"<html><body>{page}" + ("</body></html>" if r.random() < 0.8 else ""), main


#: The share of training pages whose tags and names say nothing, so that text and context must.
NEUTRAL = 0.15


@lru_cache(maxsize=4)
def trained(pages: int = 2000, rounds: int = 14, seed: int = 11) -> BiLstm:
    """The labeller after Adam steps over batches of made-up pages: the mean of its weights over the last rounds."""
    r, model = random.Random(seed), BiLstm()
    data = []
    while len(data) < pages:
        page, main = made_page(r, NEUTRAL)
        found, left = leaves(page), list(main)
        y = []
        for _, text, _ in found:
            y.append(float(bool(left) and text == left[0]))
            if y[-1]:
                left.pop(0)
        if found:
            data.append((features(found), np.array(y, np.float32)))
    state = {k: (np.zeros_like(w), np.zeros_like(w)) for k, w in model.p.items()}
    mean, late, step = {k: np.zeros_like(w) for k, w in model.p.items()}, 0, 0
    for n in range(rounds):
        order = sorted(range(len(data)), key=lambda i: (len(data[i][1]) // 8, r.random()))
        batches = [order[k : k + 28] for k in range(0, len(order), 28)]
        r.shuffle(batches)
        for batch in batches:
            x, mask = padded([data[i][0] for i in batch])
            y = np.zeros(mask.shape, np.float32)
            for k, i in enumerate(batch):
                y[: len(data[i][1]), k] = data[i][1]
            step += 1
            rate = 0.012 * (1 - 0.8 * n / rounds)
            for k, g in model.gradients(x, mask, y).items():
                a, b = state[k]
                g = np.clip(g, -1, 1)
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                model.p[k] -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
            if n >= rounds * 0.6:
                late += 1
                for k, w in model.p.items():
                    mean[k] += (w - mean[k]) / late
    model.p = mean
    return model


def label_pages(pages: list[list[tuple[Path, str, int]]], model: BiLstm, steps: int = 1 << 13) -> list[np.ndarray]:
    """The probability of each leaf of each page; pages of like length go together, at most ``steps`` leaf vectors at once."""
    out: list[np.ndarray] = [np.empty(0)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        end = at
        while end < len(order) and (end == at or (end - at + 1) * len(pages[order[end]]) <= steps):
            end += 1
        batch = [pages[i] for i in order[at:end]]
        longest = len(batch[-1])
        if longest <= steps:
            prob = model.probabilities(*padded([features(p) for p in batch]))
        else:  # one page, longer than that
            prob = model.in_pieces(lambda s, e, p=batch[0]: padded([features(p, s, e)]), longest, 1, steps)
        for k, i in enumerate(order[at:end]):
            out[i] = prob[: len(pages[i]), k]
        at = end
    return out


def main_texts(pages: list[str | None], model: BiLstm) -> list[str]:
    root = Path()  # paths are shared within a batch of pages and go with it
    found = [leaves(p, root) if p else [] for p in pages]
    return [" ".join(text for (_, text, _), p in zip(f, prob, strict=True) if p >= 0.5) for f, prob in zip(found, label_pages(found, model), strict=True)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    sent = pages.sparkSession.sparkContext.broadcast(trained())  # some 30,000 weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 128):  # few pages at once: leaves take more room than html
                part = b.slice(k, 128)
                texts = main_texts(part.column(2).to_pylist(), sent.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return fields(pages, page_id=id_col, url=url_col, html=html_col).mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
