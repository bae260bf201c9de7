"""Main-text extraction with a recurrent block labeller.

A page becomes its sequence of leaf blocks: text between block-level tags, with the path of open tags.  Each leaf is a
vector of hashed path features (tags, and the words of class, id and role names), hashed words and a few numbers.
A bidirectional LSTM, written and trained in numpy, reads the whole sequence, so that each block is classified by the
context of the whole document, and the blocks labelled as article are joined.

The model is trained on pages that a generator lays out (menus, headers, banners, notices, adverts, forms, sidebars, comments,
footers around and inside articles, in many markups), filled with words of a bounded sample of the given pages.
Their labels are known by construction; given pages are never labelled by rules.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultlens.llm.common import pick, whole_text

PATH_DIM, WORD_DIM, NUMBER_DIM = 4096, 48, 8
DENSE = WORD_DIM + NUMBER_DIM
HIDDEN = 24
GATES = 8 * HIDDEN  # both directions
#: Leaves read at once; a longer page is read in parts, and the state of each direction goes on from part to part.
PART = 4096

_BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav noframes noscript ol
optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul""".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes first: an open one of these, if no barrier lies above it.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}}
_BARRIER = frozenset("ul ol dl table select menu body article section div nav aside main header footer form".split())
_CLOSE_P = _BLOCKS - {"button", "label", "option", "optgroup", "head", "title", "html", "body", "caption", "td", "th", "tr", "tbody",
                      "thead", "tfoot", "legend", "iframe", "noscript"}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S | re.I)
#: Inside an svg element, as in the HTML standard: what may hold other tags, its own tags, and the tags that end it wherever they
#: stand (title is an svg tag, too).
_ENDS_SVG = "|".join(sorted((_BLOCKS - {"title"}) | set("b big br code em embed i img meta nobr ruby s small span strong strike sub sup tt u var".split())))
_IN_SVG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|(?P<out></?(?:{_ENDS_SVG})(?=[\s/>]))|(?P<close></svg\s*>)"
    r"|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"""(class|id|role|aria-label|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass
class Leaf:
    """A block's text (white space collapsed, references decoded), its path features and the share of it inside links."""

    text: str
    path: tuple[int, ...]
    linked: float = 0.0


def _features_of(tag: str, attributes: str) -> tuple[int, ...]:
    names = [f"tag {tag}"]
    for key, value in _ATTRIBUTE.findall(attributes):
        words = [w.lower() for w in _NAME_WORD.findall(value.strip("\"'"))]
        names += [f"name {w}" for w in words[:12]]
        names += [f"name {w[:-1]}" for w in words[:12] if len(w) > 3 and w.endswith("s")]
    return tuple(1 + zlib.crc32(n.encode()) % (PATH_DIM - 1) for n in names)  # 0 stands for any path


def _after_svg(page: str, at: int) -> int:
    """Where the svg element whose opening tag ends at ``at`` ends: behind its closing tag, or before a tag that can't be in it."""
    depth = 1
    for m in _IN_SVG.finditer(page, at):
        if m["out"]:
            return m.start()
        if m["close"]:
            depth -= 1
            if not depth:
                return m.end()
        elif m["tag"] and m["tag"].lower() == "svg" and not m["attributes"].endswith("/"):
            depth += 1
    return len(page)


def leaves(page: str) -> list[Leaf]:
    """The leaf blocks of a page in order; unclosed and stray tags are tolerated, a tag cut off by the end is dropped.

    The drawing of an svg element is dropped; one that isn't closed ends before the next HTML tag. The text of math stays.
    """
    stack: list[tuple[str, tuple[int, ...]]] = []
    out: list[Leaf] = []
    parts: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                features = tuple(x for _, f in stack for x in f)
                out.append(Leaf(text, features, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def text_run(raw: str):
        nonlocal linked
        if raw:
            decoded = html.unescape(raw)
            parts.append(decoded)
            if any(t == "a" for t, _ in stack):
                linked += len(decoded.strip())

    def close_to(depth: int):
        del stack[depth:]

    at = 0
    while m := _TOKEN.search(page, at):
        text_run(page[at:m.start()])
        at = m.end()
        hidden, closing, opening, attributes = m.groups()
        if closing:
            tag = closing.lower()
            if tag in _BLOCKS:
                flush()
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    close_to(depth)
                    break
                if tag not in _BLOCKS and stack[depth][0] in _BLOCKS:
                    break
        elif opening:
            tag = opening.lower()
            if tag == "br":
                parts.append(" ")
                continue
            if tag == "svg":
                if not attributes.endswith("/"):
                    at = _after_svg(page, at)
                continue
            if tag in _BLOCKS:
                flush()
                wanted = _CLOSES.get(tag, set()) | ({"p"} if tag in _CLOSE_P else set())
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] in wanted:
                        close_to(depth)
                        break
                    if stack[depth][0] in _BARRIER:
                        break
            if tag not in _VOID and not attributes.endswith("/"):
                stack.append((tag, _features_of(tag, attributes)))
    text_run(page[at:])
    flush()
    return out


@dataclass
class Inputs:
    """A leaf sequence for the model: path features of all leaves in a row, their number per leaf, and the dense part."""

    path: np.ndarray
    sizes: np.ndarray
    dense: np.ndarray


def vectors(blocks: list[Leaf]) -> Inputs:
    """Inputs of the leaves; every path begins with feature 0, so none is empty."""
    paths = [(0, *sorted(set(b.path))) for b in blocks]
    dense = np.zeros((len(blocks), DENSE), np.float32)
    words_before, total = 0, sum(len(b.text) for b in blocks) or 1
    for k, b in enumerate(blocks):
        words = b.text.split()
        slots = [zlib.crc32(w.lower().encode()) % WORD_DIM for w in words]
        np.add.at(dense[k], np.array(slots, np.int64), 1.0 / max(1, len(slots)))
        size = len(b.text)
        dense[k, WORD_DIM:] = (
            np.log1p(size) / 8, np.log1p(len(words)) / 6, b.linked, sum(map(b.text.count, ".,;:!?")) / size * 5,
            sum(map(b.text.count, "0123456789")) / size, words_before / total, (k + 1) / len(blocks), float(b.text[-1] in ".!?"))
        words_before += size
    return Inputs(np.array([x for p in paths for x in p], np.int64), np.array([len(p) for p in paths], np.int64), dense)


@dataclass(frozen=True)
class Labeller:
    """Parameters of the bidirectional LSTM: path and dense inputs and bias (both directions side by side), the recurrent
    weights (one matrix for each direction), then the output layer."""

    parts: tuple[np.ndarray, ...]

    def scores(self, inputs: list[Inputs]) -> list[np.ndarray]:
        """Log-odds that each leaf is article text, for each sequence."""
        wp, wd, bias, u, wo, bo = self.parts
        flat = _project(wp, wd, bias, np.concatenate([i.path for i in inputs]), np.concatenate([i.sizes for i in inputs]),
                        np.concatenate([i.dense for i in inputs]))
        lengths = [len(i.sizes) for i in inputs]
        both, _ = _both_ways(flat, lengths, u)
        score = both @ wo + bo
        return [score[k, :n] for k, n in enumerate(lengths)]

    def long_scores(self, whole: Inputs) -> np.ndarray:
        """Log-odds of the leaves of one page, read in parts of PART leaves: backward from the end, then forward."""
        wp, wd, bias, u, wo, bo = self.parts
        n, edges = len(whole.sizes), np.concatenate([[0], np.cumsum(whole.sizes)])
        cuts = [(lo, min(n, lo + PART)) for lo in range(0, n, PART)]
        score = np.zeros(n, np.float32)
        for way, steps in ((1, cuts[::-1]), (0, cuts)):
            state = [np.zeros((1, HIDDEN), np.float32) for _ in range(2)]
            for lo, hi in steps:
                flat = _project(wp, wd, bias, whole.path[edges[lo]:edges[hi]], whole.sizes[lo:hi], whole.dense[lo:hi])
                a = flat[None, ::-1, GATES // 2:] if way else flat[None, :, :GATES // 2]
                out, _ = _lstm(a, u[way], np.ones((1, hi - lo), np.float32), state)
                score[lo:hi] += (out[0, ::-1] if way else out[0]) @ wo[way * HIDDEN:(way + 1) * HIDDEN]
        return score + bo

    def article(self, pages: list[list[Leaf]]) -> list[np.ndarray]:
        """For each page, which of its leaves are article text."""
        out = [np.zeros(len(b), bool) for b in pages]
        for p, blocks in enumerate(pages):
            if len(blocks) > PART:
                out[p] = self.long_scores(vectors(blocks)) > 0
        jobs = sorted((len(b), p) for p, b in enumerate(pages) if 0 < len(b) <= PART)
        at = 0
        while at < len(jobs):
            stop = at + 1
            while stop < len(jobs) and jobs[stop][0] * (stop + 1 - at) <= 2 * PART:
                stop += 1
            group = [p for _, p in jobs[at:stop]]
            for p, score in zip(group, self.scores([vectors(pages[p]) for p in group])):
                out[p] = score > 0
            at = stop
        return out


def _project(wp, wd, bias, path, sizes, dense) -> np.ndarray:
    """Gate inputs of each leaf: the sum of its path features' rows, and the dense part."""
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.add.reduceat(wp[path], begins, axis=0) + dense @ wd + bias


def _both_ways(flat: np.ndarray, lengths: list[int], u: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Hidden states of both directions, (sequences, steps, 2 x HIDDEN), and what backpropagation needs."""
    width = max(lengths)
    place = np.concatenate([k * width + np.arange(n) for k, n in enumerate(lengths)])
    mask = np.zeros(len(lengths) * width, np.float32)
    mask[place] = 1
    mask = mask.reshape(len(lengths), width)
    a = np.zeros((len(lengths) * width, GATES), np.float32)
    a[place] = flat
    a = a.reshape(len(lengths), width, GATES)
    forward, tf = _lstm(a[:, :, :GATES // 2], u[0], mask)
    backward, tb = _lstm(a[:, ::-1, GATES // 2:], u[1], mask[:, ::-1])
    return np.concatenate([forward, backward[:, ::-1]], axis=2), (place, mask, tf, tb)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _lstm(a: np.ndarray, u: np.ndarray, mask: np.ndarray, state: list[np.ndarray] | None = None) -> tuple[np.ndarray, list]:
    """Hidden states of one direction for input projections ``a`` (sequences, steps, 4 x HIDDEN), and what backpropagation needs.

    ``state`` [h, c] is where to go on from; it is left at the state after the last step.
    """
    n, steps, _ = a.shape
    h, c = state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
    out, tape = np.zeros((n, steps, HIDDEN), np.float32), []
    for t in range(steps):
        z = a[:, t] + h @ u
        gates = _sigmoid(z[..., :3 * HIDDEN])
        i, f, o = gates[..., :HIDDEN], gates[..., HIDDEN:2 * HIDDEN], gates[..., 2 * HIDDEN:]
        g = np.tanh(z[..., 3 * HIDDEN:])
        live = mask[:, t, None]
        new_c = live * (f * c + i * g) + (1 - live) * c
        tc = np.tanh(new_c)
        new_h = live * (o * tc) + (1 - live) * h
        tape.append((h, c, i, f, o, g, tc, live))
        h, c = new_h, new_c
        out[:, t] = h
    if state is not None:
        state[:] = h, c
    return out, tape


def _lstm_back(grad: np.ndarray, u: np.ndarray, tape: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input projections and of the recurrent weights."""
    n, steps, _ = grad.shape
    da, du = np.zeros((n, steps, 4 * HIDDEN), np.float32), np.zeros_like(u)
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    back = np.ascontiguousarray(u.T)
    for t in reversed(range(steps)):
        h, c, i, f, o, g, tc, live = tape[t]
        dh = dh + grad[:, t]
        dho, dcc = dh * live, dc * live
        dcc = dcc + dho * o * (1 - tc * tc)
        dz = np.concatenate([dcc * g * i * (1 - i), dcc * c * f * (1 - f), dho * tc * o * (1 - o), dcc * i * (1 - g * g)], axis=-1)
        da[:, t] = dz
        du += h.T @ dz
        dh = dz @ back + dh * (1 - live)
        dc = dcc * f + dc * (1 - live)
    return da, du


def fit(pages: list[tuple[Inputs, np.ndarray]], epochs: int = 5, batch: int = 24, rate: float = 6e-3, seed: int = 3) -> Labeller:
    """Adam on the mean cross-entropy of all leaves; ``pages`` holds (inputs, 0/1 labels)."""
    draw = np.random.default_rng(seed)

    def weights(rows, cols, scale):
        return (draw.standard_normal((rows, cols)) * scale).astype(np.float32)

    bias = np.zeros(GATES, np.float32)
    bias[HIDDEN:2 * HIDDEN] = bias[GATES // 2 + HIDDEN:GATES // 2 + 2 * HIDDEN] = 1.0
    p = [weights(PATH_DIM, GATES, 0.15), weights(DENSE, GATES, 0.3), bias,
         np.stack([weights(HIDDEN, GATES // 2, HIDDEN ** -0.5) for _ in range(2)]), weights(2 * HIDDEN, 1, 0.2)[:, 0], np.zeros(1, np.float32)]
    first, second, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    order = sorted(range(len(pages)), key=lambda k: len(pages[k][1]))
    groups = [order[k:k + batch] for k in range(0, len(order), batch)]
    for epoch in range(epochs):
        for at in draw.permutation(len(groups)):
            group = [pages[k] for k in groups[at]]
            lengths = [len(y) for _, y in group]
            path, sizes = np.concatenate([x.path for x, _ in group]), np.concatenate([x.sizes for x, _ in group])
            dense, y = np.concatenate([x.dense for x, _ in group]), np.concatenate([y for _, y in group])
            # a leaf sometimes loses a part of its path: the model must not lean on one name alone
            keep = (draw.random(len(path)) > 0.05) | (path == 0)
            leaf = np.repeat(np.arange(len(sizes)), sizes)[keep]
            path, sizes = path[keep], np.bincount(leaf, minlength=len(sizes))
            both, (place, mask, tf, tb) = _both_ways(_project(*p[:3], path, sizes, dense), lengths, p[3])
            gap = np.zeros(mask.size, np.float32)
            gap[place] = (_sigmoid((both @ p[4] + p[5]).ravel()[place]) - y) / len(y)
            gap = gap.reshape(mask.shape)
            dboth = gap[:, :, None] * p[4]
            daf, duf = _lstm_back(dboth[:, :, :HIDDEN], p[3][0], tf)
            dab, dub = _lstm_back(dboth[:, ::-1, HIDDEN:], p[3][1], tb)
            da, du = np.concatenate([daf, dab[:, ::-1]], axis=2).reshape(-1, GATES)[place], np.stack([duf, dub])
            used, slot = np.unique(path, return_inverse=True)
            count = np.zeros((len(used), len(sizes)), np.float32)
            np.add.at(count, (slot, leaf), 1.0)
            dwp = np.zeros_like(p[0])
            dwp[used] = count @ da
            grads = [dwp, dense.T @ da, da.sum(axis=0), du, both.reshape(-1, 2 * HIDDEN).T @ gap.ravel(),
                     np.array([gap.sum()], np.float32)]
            size = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            pace = rate * min(1.0, 5.0 / (size + 1e-9)) * (0.5 ** (2 * epoch / epochs))
            for k, g in enumerate(grads):
                rows = used if k == 0 else slice(None)  # path features that a batch doesn't have stay as they are
                first[k][rows] = 0.9 * first[k][rows] + 0.1 * g[rows]
                second[k][rows] = 0.999 * second[k][rows] + 0.001 * g[rows] ** 2
                p[k][rows] -= pace * (first[k][rows] / (1 - 0.9 ** step)) / (np.sqrt(second[k][rows] / (1 - 0.999 ** step)) + 1e-8)
    return Labeller(tuple(x.astype(np.float32) for x in p))


class Layouts:
    """Pages with known labels: every leaf of article text ends in a mark that is cut off after parsing."""

    MARK = "\ue000"
    # names that sites give to the parts around an article (classes, ids)
    MENU = "nav navbar menu navigation topnav main-menu site-nav breadcrumb breadcrumbs pagination pager tabs toolbar skip-links toc".split()
    HEADER = "header masthead site-header page-header banner top-bar topbar logo branding hero-banner tagline".split()
    FOOTER = "footer site-footer page-footer copyright colophon legal bottom imprint credits".split()
    SIDE = "sidebar side aside widget widgets related related-posts recommended popular trending more-links rail secondary tags archive".split()
    NOTICE = "notice cookie-notice cookie-banner consent gdpr alert warning message popup modal overlay announcement disclaimer subscribe newsletter".split()
    ADVERT = "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adsense ad-slot commercial affiliate teaser".split()
    FORM = "form search search-form login signup register contact newsletter-form feedback survey".split()
    COMMENT = "comments comment comment-list comment-body discussion replies reply responses reader-comments disqus thread user-comments".split()
    SHARE = "share social sharing share-buttons follow social-links meta byline author-box author date timestamp post-meta".split()
    ARTICLE = "article post entry content story main-content article-body post-content entry-content text body page-content".split()

    def __init__(self, words: list[str], seed: int):
        self.r, self.words = random.Random(seed), words

    def say(self, low: int, high: int) -> str:
        return html.escape(" ".join(self.r.choice(self.words) for _ in range(self.r.randint(low, high))), quote=False)

    def name(self, names: list[str]) -> str:
        one = self.r.choice(names)
        if self.r.random() < 0.3:
            one += " " + self.r.choice(["box", "block", "inner", "wrap", "container", "clearfix", "left", "main", "item", "c1"])
        return self.r.choice(['class="{}"', 'id="{}"', 'class="{}"', 'role="{}"', "class='{}'"]).format(one)

    def links(self) -> str:
        items = [f'<a href="/{k}">{self.inline()}{self.say(1, 3)}</a>' for k in range(self.r.randint(2, 9))]
        if self.r.random() < 0.7:
            tag = self.r.choice(["ul", "ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{x}</li>" for x in items) + f"</{tag}>"
        return self.r.choice([" | ", " ", " &raquo; "]).join(items)

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.say(2, 14).capitalize() + self.r.choice([".", ".", ".", "!", "?", ""]) for _ in range(self.r.randint(low, high)))

    def outer(self, tag: str | None, names: list[str], inner: str) -> str:
        """A part in its own element or in a named div or section."""
        r = self.r.random()
        if tag and r < 0.45:
            return f"<{tag}>{inner}</{tag}>"
        if tag and r < 0.6:
            return f"<{tag} {self.name(names)}>{inner}</{tag}>"
        box = self.r.choice(["div", "div", "section", "div"])
        return f"<{box} {self.name(names)}>{inner}</{box}>"

    def clutter(self) -> str:
        pick = self.r.randrange(9)
        text = self.sentences(1, 3)
        para = f"<p>{text}</p>" if self.r.random() < 0.5 else text
        head = f"<h{self.r.randint(2, 5)}>{self.say(1, 4)}</h{self.r.randint(2, 5)}>" if self.r.random() < 0.3 else ""
        if pick == 0:
            return self.outer("nav", self.MENU, self.links())
        if pick == 1:
            return self.outer("header", self.HEADER, head + self.r.choice([para, self.links()]))
        if pick == 2:
            return self.outer("aside", self.SIDE, head + self.r.choice([para, self.links(), para + self.links()]))
        if pick == 3:
            return self.outer(None, self.NOTICE, para + self.r.choice(["", f"<button>{self.say(1, 2)}</button>"]))
        if pick in (4, 5):
            return self.outer(None, self.ADVERT, para)
        if pick == 6:
            return self.outer("form", self.FORM, f"<label>{self.say(1, 3)}</label><input name=q>" + self.r.choice(
                [f"<button>{self.say(1, 2)}</button>", f"<select><option>{self.say(1, 2)}<option>{self.say(1, 2)}</select>", para]))
        if pick == 7:
            tag = self.r.choice(["div", "li", "p", "article", "article", "section"])
            own = "".join(f"<{tag} {self.name(self.COMMENT) if self.r.random() < 0.8 else ''}>{self.remark(tag)}</{tag}>"
                          for _ in range(self.r.randint(1, 5)))
            return self.outer(None, self.COMMENT, head + (f"<ol>{own}</ol>" if tag == "li" else own))
        return self.outer(None, self.SHARE, self.r.choice([self.links(), self.say(1, 6)]))

    def remark(self, tag: str) -> str:
        """What a reader wrote, with or without a name or date."""
        if tag == "p" or self.r.random() < 0.3:
            return self.sentences(1, 4)
        name = self.r.choice(["", "", f"<p {self.name(self.SHARE)}>{self.say(1, 3)}</p>", f"<div>{self.say(1, 3)}</div>", f"<h4>{self.say(1, 3)}</h4>"])
        return name + "".join(f"<p>{self.sentences(1, 4)}</p>" for _ in range(self.r.randint(1, 3)))

    def inline(self) -> str:
        """Now and then an icon, whose text is no text of the page, or a formula."""
        r = self.r.random()
        if r < 0.03:
            return ' <svg class="icon" viewBox="0 0 9 9"/>'
        if r < 0.06:
            return f' <svg viewBox="0 0 9 9"><title>{self.say(1, 2)}</title><path d="M0 0h9"/></svg>'
        if r < 0.09:
            return f" <math><mi>{self.r.choice('abnxy')}</mi><mo>=</mo><mn>{self.r.randint(0, 99)}</mn></math>"
        return ""

    def paragraph(self) -> str:
        m, r = self.MARK, self.r.random()
        text = self.sentences(1, 7)
        if r < 0.08:
            return f"<p><b>{text}{m}<br>"
        if r < 0.16:
            return f"<p>{text[:len(text) // 2]}<a href='/x'>{self.say(1, 3)}</a> {self.sentences(1, 2)}{m}</p>"
        if r < 0.22:
            return f"<h{self.r.randint(2, 4)}>{self.say(1, 9)}{m}</h{self.r.randint(2, 4)}>"
        if r < 0.28:
            return "<ul>" + "".join(f"<li>{self.say(1, 15)}{m}</li>" for _ in range(self.r.randint(1, 5))) + "</ul>"
        if r < 0.33:
            return f"<blockquote>{self.r.choice(['', '<p>'])}{text}{m}</blockquote>"
        if r < 0.37:
            return "<table>" + "".join(f"<tr><td>{self.say(1, 3)}{m}<td>{self.say(1, 3)}{m}</tr>" for _ in range(self.r.randint(1, 4))) + "</table>"
        if r < 0.40:
            return f"<pre>{self.say(1, 12)}{m}</pre>"
        if r < 0.45:
            return f"<div>{text}{m}</div>"
        if r < 0.50:
            return f"<p>{self.say(1, 3)}{m}</p>"
        if r < 0.52:
            return f'<p>{text}{m}<svg viewBox="0 0 9 9"><path d="M0 0h9"></p>'
        return f"<p>{text}{self.inline()} {self.say(1, 5)}{m}</p>"

    def article(self) -> str:
        body = [f"<h1>{self.say(1, 12)}{self.MARK}</h1>"] if self.r.random() < 0.8 else []
        for _ in range(self.r.choice([0, 1, 1, 2, 3, 5, 8, 14])):
            body.append(self.paragraph())
            if self.r.random() < 0.06:
                body.append(self.clutter())
        r = self.r.random()
        if r < 0.6:
            tag = "<article>", "</article>"
        elif r < 0.7:
            tag = f"<article {self.name(self.ARTICLE)}>", "</article>"
        elif r < 0.8:
            tag = f"<main {self.r.choice(['', self.name(self.ARTICLE)])}>", "</main>"
        elif r < 0.93:
            tag = f"<div {self.name(self.ARTICLE)}>", "</div>"
        else:
            tag = f"<section {self.name(self.ARTICLE)}>", "</section>"
        whole = tag[0] + "".join(body) + tag[1]
        return f"<main>{whole}</main>" if r < 0.7 and self.r.random() < 0.15 else whole

    def page(self) -> str:
        title = self.say(2, 12)
        head = f"<!DOCTYPE html><html lang=en><head><meta charset=utf-8><title>{title}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
        before = "".join(self.clutter() for _ in range(self.r.choice([0, 1, 2, 2, 3, 4])))
        if self.r.random() < 0.5:
            before = self.outer("nav", self.MENU, self.links()) + f"<!-- ad {self.r.randint(0, 99)} -->" + before
        after = "".join(self.clutter() for _ in range(self.r.choice([0, 0, 1, 2, 3])))
        if self.r.random() < 0.7:
            after += self.outer("footer", self.FOOTER, self.r.choice(["&copy; ", "", "<p>"]) + self.sentences(1, 2))
        whole = head + before + self.article() + after + "</body></html>"
        return whole[:-self.r.randint(1, 25)] if self.r.random() < 0.1 else whole

    def labelled(self) -> tuple[Inputs, np.ndarray]:
        blocks = leaves(self.page())
        y = np.array([self.MARK in b.text for b in blocks], np.float32)
        for b in blocks:
            b.text = " ".join(b.text.replace(self.MARK, " ").split()) or "x"
        return vectors(blocks), y


def train(pages: DataFrame, html_col: str = "html", max_pages: int = 200, layouts: int = 3000, seed: int = 17,
          max_words: int = 20_000) -> Labeller:
    """Train on ``layouts`` generated pages with words of about ``max_pages`` of the given ones (by a hash of the page).

    Of all words of these pages, the ``max_words`` with the smallest hash fill the generated pages; no more come to the driver.
    """
    own = pages.select(F.col(html_col).cast("string").alias("html")).where("html is not null")
    share = min(1.0, max_pages / max(1, own.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.column(0):
                found = sorted({w for b in leaves(page.as_py()) for w in b.text.split()})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["word"])

    chosen = own.where(F.pmod(F.xxhash64("html"), F.lit(1 << 30)) < share * (1 << 30))
    found = chosen.mapInArrow(run, "word string").distinct().orderBy(F.xxhash64("word"), "word").limit(max_words)
    words = sorted(r["word"] for r in found.collect())
    words = words or [a + b for a in "ka lo mi ne su ta".split() for b in "ra den ti vo".split()]
    made = Layouts(words, seed)
    return fit([x for x in (made.labelled() for _ in range(layouts)) if len(x[1])])


def extract(pages: DataFrame, model: Labeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``id_col, url_col, text, n_chars``; the text is empty if nothing is article text.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by one space in page
    order. Null and empty html give an empty text. Repeated rows are kept; an empty table gives no rows; extra columns are ignored.
    """
    source = pick(pages, id_col, url_col, html_col).select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), whole_text(html_col).alias("html"))
    kind = source.schema["id"].dataType.simpleString()
    shared = pages.sparkSession.sparkContext.broadcast(model.parts)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller(shared.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                found = [leaves(h.as_py()) for h in batch.column(2)]
                texts = [" ".join(b.text for b, keep in zip(blocks, kept) if keep) for blocks, kept in zip(found, own.article(found))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["id", "url", "text", "n_chars"])

    return source.mapInArrow(run, f"id {kind}, url string, text string, n_chars long") \
        .withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
