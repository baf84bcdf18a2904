"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks: the text between the tags that begin or end a line. For each
block a small vector describes its tag path (names, classes and ids of the open elements,
hashed), its words (hashed) and its shape (length, links, punctuation, place). A
bidirectional LSTM in numpy reads the vectors of a page's blocks from both ends and labels
each one with the whole page as context; blocks labelled as main text are joined.

The model is trained here, on pages that a generator lays out at random from the usual
parts of web pages (``layouts``), with the label that each part has by its making. No
page of the input is looked at for that, so a model doesn't depend on the table.

Scripts, styles, comments, drawings and the fields of forms are not text; formulas are, and so is
what stands in for an object, a film or a script where those don't run. Character references are
decoded, white space in a block becomes one space, blocks are trimmed and joined by one
space in page order. A silent element that is never closed (a button, say) ends with the
element around it; only a script, style, title, textarea or iframe runs to the page's end.

Null and empty pages, and pages without main text, give an empty text. Very long pages are
read whole: time and memory grow with their length. Rows with a repeated or null id, and
equal pages, are treated like any other, each by itself, so there are no ties. Other
columns, whatever their names, are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import html
import math
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices, texts

EXTRACTED = "page_id long, url string, text string, n_chars long"

#: Tags, comments and declarations; quoted attribute values may hold ">".
MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Elements without an end tag, those that don't break a line, those whose content isn't text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym annotation audio b bdi bdo big canvas cite code data del dfn em font i img ins kbd label mark math menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms "
    "mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover noscript object q rp rt ruby s samp semantics small span strike strong sub sup time tt u var video wbr".split()
)
SILENT = frozenset("script style template title textarea select button svg iframe".split())
#: Of the silent ones, those whose content is text up to their own end tag, whatever stands there.
RAW = frozenset("script style title textarea iframe".split())
#: An element of the first kind ends an open one of the second.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)

PATH, WORD, SHAPE = 96, 32, 8
WIDTH = PATH + WORD + SHAPE


@dataclass
class Block:
    """text: a block's text. slots: the hashed names of the open elements, a bit each; deep: how many names."""

    text: str
    linked: int = 0
    slots: int = 0
    deep: int = 0


@dataclass(slots=True)
class Open:
    """An open element, with what it and those around it say together."""

    name: str
    slots: int
    deep: int
    links: int
    silent: bool


@functools.lru_cache(100_000)
def _slot(kind: str, name: str, size: int) -> int:
    return zlib.crc32(f"{kind}:{name}".encode("utf-8", "surrogatepass")) % size


def slot(kind: str, name: str, size: int) -> int:
    return _slot(kind, name, size) if len(name) < 64 else _slot.__wrapped__(kind, name, size)


#: The beginning of a tag, or a whole comment or declaration.
BEGINNING = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
NEXT = re.compile(r"[>\"']")
UNCLOSED = re.compile(r"<!--|<!\[CDATA\[")


class Loose:
    """Finds the ends of tags on a page with quotes that are never closed, in time that grows with its length.

    A way from a tag on, quote by quote, that reaches the page's end without a ">" is kept: a
    later tag that stands on it, outside of its quotes, goes the same way. No more than three
    ways can differ, as at each place a way is outside of quotes or within one of two kinds.
    """

    def __init__(self, page: str):
        self.page, self.ways = page, []

    def end(self, at: int) -> tuple[int, int]:
        """Where a tag's attributes, from ``at``, end, and where the text goes on."""
        first, starts, ends = at, [], []
        while True:
            for lefts, rights in self.ways:
                i = bisect.bisect_right(lefts, at) - 1
                if i >= 0 and at <= rights[i]:
                    break
            else:
                found = NEXT.search(self.page, at)
                if found and found[0] == ">":
                    return found.start(), found.end()
                starts.append(at)
                ends.append(found.start() if found else len(self.page))
                closes = self.page.find(found[0], found.end()) if found else -1
                if closes >= 0:
                    at = closes + 1
                    continue
            break
        if starts:
            self.ways.append((starts, ends))
        ends_at = self.page.find(">", first)  # quotes don't count, then
        return ends_at, ends_at + 1


class Parser:
    """Cuts a page's text into blocks; time and memory grow with the page's length."""

    def __init__(self):
        self.out: list[Block] = []
        self.stack: list[Open] = []
        self.names: Counter = Counter()  # of the open elements
        self.parts: list[str] = []
        self.linked = 0
        self.top = Open("", 0, 0, 0, False)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.out.append(Block(text, self.linked, self.top.slots, self.top.deep))
        self.parts.clear()
        self.linked = 0

    def say(self, raw: str) -> None:
        if raw and not self.top.silent:
            raw = html.unescape(raw) if "&" in raw else raw
            self.parts.append(raw)
            if self.top.links:
                self.linked += len(raw)

    def push(self, name: str, attributes: str) -> None:
        marks = [name]
        if attributes:
            for key, *values in ATTRIBUTE.findall(attributes):
                value = next((v for v in values if v), "")
                marks += [key.lower()] if key.lower() in ("hidden", "aria-hidden") else re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
        around, slots = self.top, self.top.slots
        for m in marks:
            slots |= 1 << slot("path", m, PATH)
        self.top = Open(name, slots, around.deep + len(marks), around.links + (name == "a"), around.silent or name in SILENT)
        self.stack.append(self.top)
        self.names[name] += 1

    def pop_to(self, depth: int) -> None:
        if any(o.name not in INLINE and o.name not in SILENT for o in self.stack[depth:]) and not (depth and self.stack[depth - 1].silent):
            self.flush()
        for o in self.stack[depth:]:
            self.names[o.name] -= 1
        del self.stack[depth:]
        self.top = self.stack[-1] if self.stack else Open("", 0, 0, 0, False)

    def close(self, kinds, until) -> None:
        """Ends the innermost open element of ``kinds`` unless an element that ``until`` stops at is nearer."""
        if not any(self.names[k] for k in kinds):
            return
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth].name in kinds:
                return self.pop_to(depth)
            if until(self.stack[depth].name):
                return

    def end(self, name: str) -> None:
        if self.names[name]:
            self.close((name,), lambda n: False)
        elif name not in INLINE and name not in SILENT and not self.top.silent:
            self.flush()

    def start(self, name: str, attributes: str, closed: bool) -> None:
        if self.top.silent:
            if name not in VOID and not closed:
                self.push(name, "")
            return
        if name not in INLINE and name not in SILENT:
            self.flush()
        if name in VOID or closed and name in SILENT:
            return
        if name in CLOSES:
            self.close(CLOSES[name], ("ul", "ol", "dl", "table").__contains__)
        elif name in ENDS_P:
            self.close(("p",), lambda n: n not in INLINE)
        self.push(name, attributes)

    def read(self, page: str) -> list[Block]:
        at, last = 0, page.rfind(">") + 1  # no tag ends behind ``last``
        loose = None
        while at < last:
            found = (MARKUP if loose is None else BEGINNING).search(page, at, last)
            if not found:
                break
            self.say(page[at : found.start()])
            at = found.end()
            if found[0].startswith("<!--"):
                if not found[0].endswith("-->"):
                    at = len(page)
                continue
            if found[0].startswith("<![CDATA["):
                self.say(found[0][9:-3] if found[0].endswith("]]>") else page[found.start() + 9 :])
                at = at if found[0].endswith("]]>") else len(page)
                continue
            if loose is None:
                name, ends, attributes, whole = found[2] or found[5], found[1] or found[4], found[3] or found[6] or "", found[0]
                if found[5]:  # a quote that is never closed: it costs a look at the whole page, once
                    loose = Loose(page)
            elif found[2]:
                stop, behind = loose.end(at)
                name, ends, attributes, whole, at = found[2], found[1], page[at:stop], page[stop - 1 : behind], behind
            else:
                continue
            name = (name or "").lower()
            if not name:
                continue
            if ends:
                self.end(name)
            elif name in RAW:
                end = RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
            else:
                self.start(name, attributes, whole.endswith("/>"))
        rest = UNCLOSED.search(page, at)
        self.say(page[at : rest.start()] if rest else page[at:])
        if rest and rest[0] != "<!--":
            self.say(page[rest.end() :])
        self.flush()
        return self.out


RAW_END = {n: re.compile(rf"</{n}\b[^>]*>", re.I) for n in RAW}


def blocks(page: str) -> list[Block]:
    """The page's text in blocks with what describes their places."""
    return Parser().read(page)


def describe(many: list[Block]) -> np.ndarray:
    """A vector for each block, from all its words."""
    x = np.zeros((len(many), WIDTH), np.float32)
    for i, b in enumerate(many):
        row = x[i]
        bits = b.slots
        while bits:
            low = bits & -bits
            row[low.bit_length() - 1] = 1.0
            bits ^= low
        words = b.text.lower().split()
        for w in words:
            row[PATH + slot("word", w, WORD)] += 1.0
        part = row[PATH : PATH + WORD]
        part /= max(1.0, float(np.sqrt((part * part).sum())))
        n = len(b.text)
        row[PATH + WORD :] = (
            min(math.log1p(n) / 6, 2.0),
            min(1.0, b.linked / n),
            min(1.0, 10 * sum(map(b.text.count, ".,;:!?")) / n),
            i / len(many),
            min(1.0, b.deep / 16),
            1.0 if n < 40 else 0.0,
            min(1.0, len(words) / 50),
            1.0,
        )
    return x


class Labeller:
    """A bidirectional LSTM with one logistic output for each step."""

    #: Blocks that are labelled together.
    most = 8192

    def __init__(self, width: int = WIDTH, hidden: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        scale = 1 / math.sqrt(width + hidden)
        self.p = {f"{k}{d}": rng.normal(0, scale, s) for d in "fb" for k, s in (("W", (width, 4 * hidden)), ("U", (hidden, 4 * hidden)), ("c", (4 * hidden,)))}
        for d in "fb":
            self.p[f"c{d}"][hidden : 2 * hidden] = 1.0  # remember, to begin with
        self.p["v"], self.p["o"] = rng.normal(0, scale, (2 * hidden,)), np.zeros(1)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States of one direction over (pages, steps, width); padding leaves a state as it is."""
        n, steps, _ = x.shape
        k, u = self.hidden, self.p[f"U{d}"]
        inputs = x @ self.p[f"W{d}"] + self.p[f"c{d}"]
        h, c = np.zeros((n, k)), np.zeros((n, k))
        out, kept = np.zeros((n, steps, k)), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = inputs[:, t] + h @ u
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * k], -30, 30)))
            i, f, o = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]
            g = np.tanh(z[:, 3 * k :])
            m = mask[:, t, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            kept.append((t, h, c, i, f, o, g, tc, m))
            c = np.where(m, c2, c)
            h = np.where(m, o * tc, h)
            out[:, t] = h
        return out, kept

    def forward(self, x: np.ndarray, mask: np.ndarray):
        f, kf = self._run(x, mask, "f")
        b, kb = self._run(x, mask, "b")
        h = np.concatenate([f, b], 2)
        return 1 / (1 + np.exp(-np.clip(h @ self.p["v"] + self.p["o"], -30, 30))), h, {"f": kf, "b": kb}

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, h, kept = self.forward(x, mask)
        e = (p - y) * mask / mask.sum()
        g = {"v": np.einsum("nt,nth->h", e, h), "o": np.array([e.sum()])}
        k = self.hidden
        for d, part in (("f", slice(0, k)), ("b", slice(k, 2 * k))):
            from_out = e[:, :, None] * self.p["v"][part]
            dz_all = np.zeros((*x.shape[:2], 4 * k))
            du = np.zeros_like(self.p[f"U{d}"])
            dh, dc = np.zeros((len(x), k)), np.zeros((len(x), k))
            for t, h0, c0, i, f, o, gg, tc, m in reversed(kept[d]):
                dh = dh + from_out[:, t]
                live = np.where(m, dh, 0.0)
                dct = np.where(m, dc, 0.0) + live * o * (1 - tc * tc)
                dz = np.concatenate([dct * gg * i * (1 - i), dct * c0 * f * (1 - f), live * tc * o * (1 - o), dct * i * (1 - gg * gg)], 1)
                dz_all[:, t] = dz
                du += h0.T @ dz
                dh = np.where(m, dz @ self.p[f"U{d}"].T, dh)
                dc = np.where(m, dct * f, dc)
            g[f"U{d}"], g[f"W{d}"], g[f"c{d}"] = du, np.einsum("ntw,ntz->wz", x, dz_all, optimize=True), dz_all.sum((0, 1))
        return g

    def label(self, pages: list[np.ndarray], batch: int = 64) -> list[np.ndarray]:
        """Probabilities for each block; pages of like length run together."""
        out: list = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):  # pages of like length, no more than a bounded number of blocks unless one page has them
            own = order[at : at + batch]
            while len(own) > 1 and len(own) * len(pages[own[-1]]) > self.most:
                own = own[: len(own) // 2]
            at += len(own)
            x, mask = padded([pages[i] for i in own])
            p, _, _ = self.forward(x, mask)
            for i, row in zip(own, p):
                out[i] = row[: len(pages[i])]
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((len(pages), steps, pages[0].shape[1])), np.zeros((len(pages), steps), bool)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, True
    return x, mask


# --- pages to learn from -----------------------------------------------------------------

#: Names that web pages give to their parts.
MAIN_NAMES = ["content", "main", "article", "post", "entry", "story", "body", "text"]
PARTS = {
    "nav": ["nav", "menu", "navigation", "breadcrumb", "breadcrumbs", "topbar", "navbar"],
    "header": ["header", "masthead", "banner", "top", "logo"],
    "footer": ["footer", "copyright", "bottom", "legal", "credits"],
    "aside": ["sidebar", "aside", "widget", "related", "recommended", "toc"],
    "ad": ["ad", "ads", "advert", "advertisement", "promo", "sponsored", "sponsor"],
    "notice": ["cookie", "notice", "consent", "gdpr", "popup", "modal", "alert"],
    "form": ["newsletter", "subscribe", "login", "search", "signup"],
    "comments": ["comments", "comment", "replies", "disqus", "discussion", "reply"],
    "share": ["share", "social", "tags", "meta", "pagination", "pager"],
}


def layouts(n: int, seed: int = 3) -> list[tuple[str, list[int]]]:
    """Random pages, and the label of each of their blocks."""
    rng = random.Random(seed)
    letters = ["".join(rng.choice("aeiou" if i % 2 else "bcdfghlmnprstvw") for i in range(rng.randint(2, 8))) for _ in range(3000)]

    def words(low: int, high: int) -> str:
        out = [rng.choice(letters) for _ in range(rng.randint(low, high))]
        text = " ".join(w + rng.choice(["", "", "", "", ",", "."]) for w in out)
        return text[0].upper() + text[1:]

    def named(tag: str, names: list[str], inner: str, semantic: str | None = None) -> str:
        if semantic and rng.random() < 0.5:
            return f"<{semantic}>{inner}</{semantic}>"
        key = rng.choice(["class", "class", "id"])
        value = rng.choice(names) + rng.choice(["", "", "-box", "-wrap", " x", "-1"])
        return f'<{tag} {key}="{value}">{inner}</{tag}>'

    def page() -> tuple[str, list[int]]:
        labels: list[int] = []

        def block(html_: str, label: int) -> str:
            labels.append(label)
            return html_

        def links(low: int, high: int) -> str:
            return "<ul>" + "".join(block(f'<li><a href="/{i}">{words(1, 3)}</a></li>', 0) for i in range(rng.randint(low, high))) + "</ul>"

        def junk(kind: str) -> str:
            names = PARTS[kind]
            if kind == "nav":
                return named("div", names, links(2, 8), "nav")
            if kind == "form":
                inner = "<form>" + block(f"<label>{words(1, 4)}</label>", 0) + '<input name="q"><button>Go</button></form>'
                return inner if rng.random() < 0.4 else named("div", names, inner)
            if kind == "aside":
                inner = block(f"<h3>{words(1, 4)}</h3>", 0) + (links(1, 5) if rng.random() < 0.6 else block(f"<p>{words(5, 40)}</p>", 0))
                return named("div", names, inner, "aside")
            if kind == "comments":
                inner = "".join(block(f"<p>{words(4, 50)}</p>", 0) for _ in range(rng.randint(1, 5)))
                return named(rng.choice(["div", "section"]), names, inner)
            if kind == "share" and rng.random() < 0.5:
                return named("div", names, links(1, 4))
            semantic = {"header": "header", "footer": "footer"}.get(kind)
            body = words(2, 25) if rng.random() < 0.5 else f"&copy; {words(1, 3)} &middot; {words(2, 14)}"
            wrap = rng.choice(["{}", "<p>{}</p>", "<span>{}</span>"])
            return named("div", names, block(wrap.format(body), 0), semantic)

        def main() -> str:
            out = []
            if rng.random() < 0.8:
                out.append(block(f"<h1>{words(2, 14)}</h1>", 1))
            for _ in range(rng.randint(1, 12)):
                roll = rng.random()
                if roll < 0.55:
                    low, high = rng.choice([(1, 4), (8, 60), (40, 150)])
                    out.append(block(f"<p>{words(low, high)}</p>", 1))
                elif roll < 0.65:  # a paragraph with loose ends
                    out.append("<p><b>" + block(words(5, 120), 1) + "<br>" + block(f"<p>{words(5, 100)}</p>", 1))
                elif roll < 0.72:
                    out.append(block(f"<h2>{words(1, 8)}</h2>", 1))
                elif roll < 0.78:
                    out.append(f"<{'ul'}>" + "".join(block(f"<li>{words(2, 20)}</li>", 1) for _ in range(rng.randint(2, 5))) + "</ul>")
                elif roll < 0.84:
                    out.append(block(f'<p>{words(3, 30)} <a href="/x">{words(1, 4)}</a> {words(2, 30)}</p>', 1))
                elif roll < 0.88:
                    out.append(block(f"<blockquote>{words(5, 50)}</blockquote>", 1))
                elif roll < 0.91:
                    out.append("<table><tr>" + "".join(block(f"<td>{words(1, 4)}</td>", 1) for _ in range(3)) + "</tr></table>")
                else:
                    out.append(junk(rng.choice(["ad", "share", "aside", "form", "comments"])))
            inner = "".join(out)
            roll = rng.random()
            if roll < 0.5:
                return f"<article>{inner}</article>"
            if roll < 0.6:
                return f"<main>{inner}</main>"
            if roll < 0.7:
                return f'<main><article class="{rng.choice(MAIN_NAMES)}">{inner}</article></main>'
            return named("div", MAIN_NAMES, inner)

        before = [junk(rng.choice(["nav", "header", "nav", "ad", "notice", "form", "aside"])) for _ in range(rng.randint(0, 4))]
        middle = main()
        after = [junk(rng.choice(["footer", "comments", "aside", "ad", "share", "notice", "footer"])) for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.4:
            after.append(junk("footer"))
        body = "".join(before) + middle + "".join(after)
        if rng.random() < 0.3:
            body = f'<div class="{rng.choice(["wrapper", "page", "container"])}">{body}</div>'
        head = "<!DOCTYPE html><html><head><title>t</title></head><body>" if rng.random() < 0.8 else ""
        return head + body, labels

    out: list[tuple[str, list[int]]] = []
    while len(out) < n:
        text, labels = page()
        if len(blocks(text)) == len(labels):
            out.append((text, labels))
    return out


def train(pages: int = 700, epochs: int = 30, batch: int = 32, seed: int = 5) -> Labeller:
    """Adam on the cross-entropy over generated pages."""
    data = [(describe(blocks(p)), np.array(y, float)) for p, y in layouts(pages)]
    model, rng = Labeller(seed=seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for epoch in range(epochs):
        order = sorted(rng.permutation(len(data)).tolist(), key=lambda i: len(data[i][1]))
        starts = rng.permutation(range(0, len(order), batch)).tolist()
        for at in starts:
            own = [data[i] for i in order[at : at + batch]]
            x, mask = padded([d[0] for d in own])
            y = np.zeros(mask.shape)
            for row, (_, labels) in zip(y, own):
                row[: len(labels)] = labels
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 0.0005
            for k, g in model.gradients(x, mask, y).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


@functools.lru_cache(4)
def trained(pages: int, epochs: int) -> Labeller:
    return train(pages, epochs)


def main_texts(model: Labeller, pages: list[str], threshold: float = 0.5) -> list[str]:
    parsed = [blocks(p) for p in pages]
    labels = model.label([describe(b) for b in parsed])
    return [" ".join(b.text for b, p in zip(own, row) if p >= threshold) for own, row in zip(parsed, labels)]


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", pages: int = 1000, epochs: int = 36) -> DataFrame:
    """page_id, url, text, n_chars. pages and epochs: how long the labeller learns, on the driver."""
    sent = df.sparkSession.sparkContext.broadcast(trained(pages, epochs))
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches):
        for part in slices(batches, 256):
            found = main_texts(sent.value, texts(part.column(2)))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, EXTRACTED)
