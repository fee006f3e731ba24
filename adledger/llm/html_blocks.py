"""HTML extraction with a recurrent block labeller.

A page becomes the sequence of its leaf blocks: stretches of text without a block-level tag
inside, in page order, each with the path of its ancestors. A bidirectional LSTM in numpy
reads one vector per block (hashed tag path, hashed words, lengths, link share) and labels
every block as main text or not, with the whole page as context. The text of a page is its
main blocks, one per line.

The labeller is trained here on a bounded sample of the given pages (the smallest hashes of
their ids). Their blocks are labelled weakly by the structure they stand in; to know other
layouts too, the sampled blocks are also set into layouts drawn at random (main, div and
section containers, sidebars, notices, adverts, forms, reader comments, inside and around
the article). A layout's label says what a block is; what the model learns is how paths,
words and neighbours tell it.

Null and empty pages have the text "". Markup that breaks off ends where it breaks off.
Character references are decoded, white space inside a block becomes one space, and nothing
else is dropped: whole pages of any length are read and labelled.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adledger.llm.common import arrow_map, slices

# fixed values: how tags of HTML behave
RAW = frozenset("script style template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol
    option p pre section select summary table tbody td tfoot th thead title tr ul""".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
IN_P = BLOCK - {"body", "head", "html", "title", "option", "caption", "tbody", "thead", "tfoot", "tr", "td", "th", "legend"}

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)"""
                    r"""((?:[^<>"']*(?:"[^"]*"|'[^']*'))*[^<>"']*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-zA-Z]+")

PATHS, WORDS, PLAIN = 96, 32, 8
WIDTH = PATHS + WORDS + PLAIN
HIDDEN = 16


def _token(tag: str, attributes: str) -> tuple[str, ...]:
    names = [x for m in NAMED.finditer(attributes) for x in PART.findall((m[2] or m[3] or m[4] or "").lower())] if attributes else []
    return (tag, *("." + n for n in names))


def blocks(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(path names, text, share of the text in links) of each block of a page with text."""
    out, stack, at, parts, link, linked = [], [], 0, [], 0, 0

    def close():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((tuple(n for _, names in stack for n in names), text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def say(raw: str):
        nonlocal linked
        if raw:
            if "&" in raw:
                raw = entities.unescape(raw)
            parts.append(raw)
            if link:
                linked += len(raw)

    while (m := MARKUP.search(page, at)):
        say(page[at:m.start()])
        at = m.end()
        ending, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW and not ending:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                # a tag that is never closed takes nothing with it but a script or style, whose text is no text
                at = end.end() if end else len(page) if tag != "template" else at
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            link = 0 if ending else 1
        if tag not in BLOCK:
            continue
        close()
        if ending:
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
                link = 0
            continue
        if tag in VOID:
            continue
        if tag in IN_P and stack and stack[-1][0] == "p":
            stack.pop()
        while stack and stack[-1][0] in CLOSES.get(tag, ()):
            stack.pop()
        stack.append((tag, _token(tag, attributes)))
    say(page[at:])
    close()
    return out


_SLOT: dict[str, int] = {}


def _slot(kind: str, word: str, size: int) -> int:
    key = kind + word
    got = _SLOT.get(key)
    if got is None:
        if len(_SLOT) > 400_000:
            _SLOT.clear()
        got = _SLOT[key] = zlib.crc32(key.encode()) % size
    return got


def vectors(page: list[tuple[tuple[str, ...], str, float]]) -> np.ndarray:
    """One vector per block."""
    n = len(page)
    out = np.zeros((n, WIDTH), np.float32)
    for i, (path, text, linked) in enumerate(page):
        row = out[i]
        for depth, name in enumerate(reversed(path)):
            row[_slot("p", name, PATHS)] += 1.0 / (1 + 0.1 * depth)
        words = text.split(" ")
        if len(words) > 64:
            row[PATHS:PATHS + WORDS] = np.bincount([_slot("w", w, WORDS) for w in words], minlength=WORDS)
        else:
            for w in words:
                row[PATHS + _slot("w", w, WORDS)] += 1
        row[PATHS:PATHS + WORDS] /= len(words)
        row[PATHS + WORDS:] = (np.log1p(len(words)) / 5, np.log1p(len(text)) / 8, linked, i / n, 1 / n, len(path) / 10,
                               text[-1] in ".!?", "©" in text)
    return out


class Labeller:
    """A bidirectional LSTM with one output per step; weights are plain arrays."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        h, scale = HIDDEN, 1 / np.sqrt(WIDTH)
        self.w = {}
        for d in "fb":
            self.w["x" + d] = r.normal(0, scale, (WIDTH, 4 * h)).astype(np.float32)
            self.w["h" + d] = r.normal(0, 1 / np.sqrt(h), (h, 4 * h)).astype(np.float32)
            bias = np.zeros(4 * h, np.float32)
            bias[h:2 * h] = 1  # remember at first
            self.w["b" + d] = bias
        self.w["o"] = r.normal(0, 0.3, 2 * h).astype(np.float32)
        self.w["c"] = np.zeros(1, np.float32)

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """x (steps, batch, WIDTH) in reading order of direction d; hidden states by step."""
        steps, batch, _ = x.shape
        h, c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
        wx = x @ self.w["x" + d] + self.w["b" + d]
        out, memory = np.zeros((steps, batch, HIDDEN), np.float32), []
        for t in (range(steps) if d == "f" else range(steps - 1, -1, -1)):
            z = wx[t] + h @ self.w["h" + d]
            gates = 1 / (1 + np.exp(-z[:, :3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
            g = np.tanh(z[:, 3 * HIDDEN:])
            m = mask[t][:, None]
            fresh = f * c + i * g
            squashed = np.tanh(fresh)
            if keep:
                memory.append((t, i, f, o, g, c, squashed, h))
            c = np.where(m, fresh, c)
            h = np.where(m, o * squashed, h)
            out[t] = h
        return out, memory

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        forth, _ = self._pass(x, mask, "f", False)
        back, _ = self._pass(x, mask, "b", False)
        return np.concatenate([forth, back], axis=2) @ self.w["o"] + self.w["c"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        forth, memory_f = self._pass(x, mask, "f", True)
        back, memory_b = self._pass(x, mask, "b", True)
        both = np.concatenate([forth, back], axis=2)
        p = 1 / (1 + np.exp(-np.clip(both @ self.w["o"] + self.w["c"], -30, 30)))
        error = (p - y) * mask / max(1, mask.sum())
        grads = {"o": np.einsum("tb,tbh->h", error, both), "c": np.array([error.sum()])}
        for d, memory, part in (("f", memory_f, slice(0, HIDDEN)), ("b", memory_b, slice(HIDDEN, None))):
            seen = error[:, :, None] * self.w["o"][part]
            dh, dc = np.zeros(seen.shape[1:]), np.zeros(seen.shape[1:])
            gx, gh, gb = np.zeros_like(self.w["x" + d]), np.zeros_like(self.w["h" + d]), np.zeros_like(self.w["b" + d])
            for t, i, f, o, g, c, squashed, h in reversed(memory):
                m = mask[t][:, None]
                total = dh + seen[t]
                inner = (dc + total * o * (1 - squashed ** 2)) * m
                dz = np.concatenate([inner * g * i * (1 - i), inner * c * f * (1 - f),
                                     total * m * squashed * o * (1 - o), inner * i * (1 - g ** 2)], axis=1)
                gx += x[t].T @ dz
                gh += h.T @ dz
                gb += dz.sum(axis=0)
                dh = dz @ self.w["h" + d].T + total * ~m
                dc = inner * f + dc * ~m
            grads |= {"x" + d: gx, "h" + d: gh, "b" + d: gb}
        return grads

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 10, batch: int = 48,
            rate: float = 0.01, seed: int = 5) -> "Labeller":
        """Adam over batches of pages of like length."""
        r = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        step = 0
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        groups = [order[i:i + batch] for i in range(0, len(order), batch)]
        for _ in range(epochs):
            for k in r.permutation(len(groups)):
                x, mask = padded([pages[i] for i in groups[k]])
                y = np.zeros(mask.shape, np.float32)
                for col, i in enumerate(groups[k]):
                    y[:len(labels[i]), col] = labels[i]
                step += 1
                for name, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    move = first[name] / (1 - 0.9 ** step) / (np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-8)
                    self.w[name] = (self.w[name] - rate * move).astype(np.float32)
        return self

    def label(self, pages: list[np.ndarray], batch: int = 128) -> list[np.ndarray]:
        """Whether each block of each page is main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if len(pages[i])]
        for at in range(0, len(order), batch):
            rows = order[at:at + batch]
            while rows:  # a batch holds a bounded number of steps
                take = max(1, min(len(rows), 20_000 // len(pages[rows[-1]])))
                now, rows = rows[-take:], rows[:-take]
                x, mask = padded([pages[i] for i in now])
                z = self.logits(x, mask)
                for col, i in enumerate(now):
                    out[i] = z[:len(pages[i]), col] > 0
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), WIDTH), np.float32)
    mask = np.zeros((steps, len(pages)), bool)
    for col, p in enumerate(pages):
        x[:len(p), col] = p
        mask[:len(p), col] = True
    return x, mask


MAIN = frozenset({"article", "main", ".article", ".main", ".content", ".post", ".entry"})
NOT_MAIN = frozenset({"nav", "footer", "header", "aside", "form", "title", "head", "button", "select", ".ad", ".ads", ".advert",
                      ".sidebar", ".cookie", ".notice", ".banner", ".comment", ".comments", ".menu", ".promo", ".related"})


def weak_labels(page) -> np.ndarray | None:
    """What the structure says of a page's blocks; None if it holds no main part."""
    main = [bool(MAIN & set(path)) for path, _, _ in page]
    return np.array([m and not NOT_MAIN & set(path) for m, (path, _, _) in zip(main, page)], np.float32) if any(main) else None


def _names(r, *options: str) -> tuple[str, ...]:
    return tuple(options[r.integers(len(options))].split())


def layout(r: np.random.Generator, prose: list[str], short: list[str]):
    """A page of a layout drawn at random, and its labels."""
    page, labels = [], []
    top = ("html", "body")
    wrap = top + (() if r.random() < 0.5 else _names(r, "div .page", "div .wrapper", "div .container", "div .site"))

    def add(path, text, main, linked=0.0):
        page.append((tuple(path), text, linked))
        labels.append(float(main))

    def some(texts):
        return texts[r.integers(len(texts))]

    def noise(base):
        kind = r.integers(8)
        if kind == 0:
            path = base + _names(r, "nav", "nav .menu", "div .nav", "ul .menu", "div .navigation", "div .breadcrumb", "header nav")
            for _ in range(r.integers(2, 9)):
                add(path + _names(r, "ul li", "li", "ul li .item"), some(short), 0, 1.0)
        elif kind == 1:
            path = base + _names(r, "aside", "div .sidebar", "aside .sidebar", "div .related", "div .widget", "section .related")
            for _ in range(r.integers(1, 5)):
                add(path + _names(r, "p", "ul li", "h3", "div"), some(short if r.random() < 0.6 else prose), 0, float(r.random() < 0.5))
        elif kind == 2:
            add(base + _names(r, "div .ad", "div .ads", "div .advert", "div .advertisement", "div .sponsored", "div .promo",
                              "aside .ad", "ins .ad", "section .promo p"), some(prose), 0, float(r.random() < 0.4))
        elif kind == 3:
            path = base + _names(r, "div .cookie .notice", "div .notice", "div .banner", "div .cookie .consent", "div .alert",
                                 "div .popup", "div .newsletter", "div .subscribe", "div .notice p", "div .cookie .banner p")
            add(path, some(prose if r.random() < 0.6 else short), 0)
        elif kind == 4:
            path = base + _names(r, "form", "div .search form", "form .newsletter", "form .login", "div .form form")
            for _ in range(r.integers(1, 4)):
                add(path + _names(r, "div", "p", "fieldset", "button", "select option"), some(short), 0)
        elif kind == 5:
            path = base + _names(r, "section .comments", "div .comments", "div .comment .list", "ol .comments", "section .responses",
                                 "div .discussion", "div .reader .comments")
            for _ in range(r.integers(1, 6)):
                add(path + _names(r, "div .comment p", "li .comment p", "article .comment p", "div .reply", "p", "div .comment"), some(prose), 0)
        elif kind == 6:
            path = base + _names(r, "header", "div .header", "header .site", "div .topbar", "header .masthead")
            for _ in range(r.integers(1, 3)):
                add(path + _names(r, "h1", "p", "div .logo", "div .title", "div"), some(short), 0, float(r.random() < 0.4))
        else:
            path = base + _names(r, "footer", "div .footer", "footer .site", "div .copyright", "footer div")
            for _ in range(r.integers(1, 4)):
                add(path + _names(r, "p", "ul li", "div", "small"), ("© " if r.random() < 0.5 else "") + some(short if r.random() < .6 else prose), 0,
                    float(r.random() < 0.3))

    if r.random() < 0.7:
        add(("html", "head", "title"), some(short), 0)
    for _ in range(r.integers(0, 4)):
        noise(top if r.random() < 0.6 else wrap)
    inside = wrap + _names(r, "article", "article", "main", "main article", "div .content", "div .main", "div .article .body",
                           "section .post .content", "div .entry .content", "div .post", "main div .content", "article .post div .entry",
                           "div .story", "section .article", "div .text", "article div .body")
    if r.random() < 0.7:
        add(inside + _names(r, "h1", "h1 .title", "header h1", "h2", "header .entry h1"), some(short), 1)
    for _ in range(r.integers(1, 14)):
        add(inside + _names(r, "p", "p", "p", "p", "ul li", "blockquote p", "h2", "h3", "div", "section p", "pre", "table tr td",
                            "ol li", "figure figcaption", "dl dd"), some(prose if r.random() < 0.8 else short), 1, float(r.random() < 0.05))
        if r.random() < 0.12:
            noise(inside)
    for _ in range(r.integers(0, 4)):
        noise(inside if r.random() < 0.3 else wrap if r.random() < 0.5 else top)
    return page, np.array(labels, np.float32)




def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = 200, drawn: int = 800,
          most_blocks: int = 60, seed: int = 11) -> Labeller:
    """A labeller from `sample` pages at most and `drawn` layouts of their blocks.

    For training only, a page gives its first `most_blocks` blocks and a block its first 400
    characters; labelling reads whole pages and blocks.
    """
    some = (pages.where(F.length(html_col) > 0).select(id_col, html_col)
            .orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(sample))

    def run(batches):
        for batch in batches:
            for page in batch.column(1).to_pylist():
                got = blocks(page)[:most_blocks]
                yield pa.RecordBatch.from_arrays([
                    pa.array([[list(p) for p, _, _ in got]], pa.list_(pa.list_(pa.string()))),
                    pa.array([[t[:400] for _, t, _ in got]], pa.list_(pa.string())),
                    pa.array([[s for _, _, s in got]], pa.list_(pa.float64()))], ["paths", "texts", "linked"])

    rows = arrow_map(some, run, "paths array<array<string>>, texts array<string>, linked array<double>").collect()
    seen = sorted((list(zip(map(tuple, x.paths), x.texts, x.linked)) for x in rows if x.texts), key=str)
    words = sorted({t for page in seen for _, t, _ in page}) or ["text"]
    prose = [t for t in words if len(t) >= 60] or words
    short = [" ".join(t.split(" ")[:6]) for t in words]
    r = np.random.default_rng(seed)
    xs, ys = [], []
    for page in seen:
        if (y := weak_labels(page)) is not None:
            xs.append(vectors(page))
            ys.append(y)
    for _ in range(drawn):
        page, y = layout(r, prose, short)
        xs.append(vectors(page))
        ys.append(y)
    return Labeller().fit(xs, ys)


def extract(pages: DataFrame, model: Labeller, id_col: str = "page_id", html_col: str = "html", keep: Iterable[str] = ()) -> DataFrame:
    """id, the columns named in keep, text, n_chars, n_blocks, n_main per row of pages."""
    keep = list(keep)
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in [id_col, *keep])

    def run(batches):
        for part in slices(batches, 1, 4 << 20):
            cut = [blocks(p or "") for p in part.column(1).to_pylist()]
            labels = model.label([vectors(c) if c else np.zeros((0, WIDTH), np.float32) for c in cut])
            texts = ["\n".join(t for (_, t, _), main in zip(c, y) if main) for c, y in zip(cut, labels)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *part.columns[2:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()),
                 pa.array(map(len, cut), pa.int64()), pa.array([int(y.sum()) for y in labels], pa.int64())],
                [id_col, *keep, "text", "n_chars", "n_blocks", "n_main"])

    return arrow_map(pages.select(id_col, html_col, *keep), run,
                     f"{schema}, text string, n_chars long, n_blocks long, n_main long")
