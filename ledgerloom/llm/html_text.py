"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks, runs of inline text between block-level tags.
Each block has features of its ancestors (tags, words of class, id and role)
and of its text (length, share of links, end punctuation, place in the page).
A two-state chain (main text or not) is trained by maximum likelihood on
labelled pages, which `labelled_pages` builds from many layouts, and decoded by
Viterbi.

Defined results: a null or empty page has the text ""; scripts, styles and
other raw elements are never text, fallbacks (noscript, object, canvas) and the
text of math and svg are; a page is whatever its tags say, however broken, and
nothing of it is dropped for its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import nested, slices, table, with_fields, with_text

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: What stands before the end of a tag or a quoted value; only after = does a quote begin one.
UNQUOTED = re.compile(r"[^>=]*(?:=\s*)?")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

#: Elements whose text is never shown as text of the page.
RAW = frozenset("script style iframe noembed noframes textarea title".split())
#: Such elements that without an end tag lose only their start tag; the others take the rest of the page.
OPEN = frozenset("select template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a start tag ends, up to the nearest of the second set.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table", "tbody", "thead", "tfoot"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: A start tag of one of these ends an open paragraph.
ENDS_P = BLOCK - frozenset(["button", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "option", "body", "html", "head"])
PARAGRAPH, SCOPE = frozenset(["p"]), frozenset(["button", "table", "td", "th", "caption", "html"])
SECTIONS = frozenset("article main nav header footer aside form".split())
NO_KINDS: frozenset[str] = frozenset()
NAME_WORD = re.compile(r"[a-z]+")
END_MARKS = ".!?…。！？:;\"'”’)»"
GOLD = "data-gold"


class Node:
    """A block-level element, with what it and its ancestors tell; ancestors are shared, not copied."""

    __slots__ = ("up", "tag", "kinds", "known", "inner", "depth")

    def __init__(self, up: Node | None, tag: str = "", names: str = "") -> None:
        self.up, self.tag, self.depth = up, tag, up.depth + 1 if up else 0
        self.kinds: frozenset[str] = NO_KINDS
        self.known: frozenset[str] = up.known if up else NO_KINDS
        self.inner = tag if tag in SECTIONS else up.inner if up else ""
        if names:
            words = names.split()
            self.kinds = frozenset(k for w in words for k in OF_WORD.get(w, ()))
            own = {f"named:{k}" for k in self.kinds} | ({"hidden"} if "hidden" in words else set())
            if not own <= self.known:
                self.known |= own
        if tag in TAGS and (feature := f"in:{tag}") not in self.known:
            self.known |= {feature}

    def key(self) -> tuple:
        """Nodes with the same key have the same features."""
        up = self.up or self
        return self.known, self.tag, self.kinds, up.tag, up.kinds, self.inner, min(self.depth, 8) // 2

    def features(self) -> list[str]:
        """Features of the element and its ancestors; those of the parent and its parent count once more."""
        found = set(self.known)
        if self.tag in TAGS:
            found.add(f"parent:{self.tag}")
        if self.up and self.up.tag in TAGS:
            found.add(f"grand:{self.up.tag}")
        found.update(f"near:{k}" for k in (*self.kinds, *(self.up.kinds if self.up else ())))
        if self.inner:
            found.add(f"inner:{self.inner}")  # the innermost sectioning element tells more than those around it
        found.add(f"depth:{min(self.depth, 8) // 2}")
        return sorted(found)


class Block:
    __slots__ = ("gold", "node", "text", "linked")

    def __init__(self, node: Node, text: str, linked: int, gold: bool) -> None:
        self.node, self.text, self.linked, self.gold = node, text, linked, gold


def _names(attributes: str) -> str:
    """The words of class, id and role, and whether the element is marked as main text (for training)."""
    found = []
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role", "itemprop"):
            found += NAME_WORD.findall(unescape(a or b or c).lower())
        elif name == "hidden" or (name == "style" and "display:none" in (a or b or c).replace(" ", "").lower()):
            found.append("hidden")
        elif name == GOLD:
            found.append(GOLD)
    return " ".join(found)


_kept_names = lru_cache(maxsize=20_000)(_names)


def closed(html: str, tag: str) -> dict[int, int]:
    """Where the elements of this tag that have an end tag begin and end; each end tag ends the nearest open one."""
    found: dict[int, int] = {}
    begun: list[int] = []
    for m in re.finditer(rf"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\b|\Z)|<(/?){tag}(?=[\s/>])([^>]*)(?:>|\Z)", html, re.S | re.I):
        if m[2] == "/":
            if begun:
                found[begun.pop()] = m.end()
        elif m[2] is not None and not m[3].rstrip().endswith("/"):
            begun.append(m.start())
    return found


@lru_cache(maxsize=64)
def _end_tag(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{tag}(?=[\s/>])", re.I)


class _Tags:
    """Where tags end: at the first > outside quoted values.

    Where quotes do not pair up, tags before that place end at their first >,
    so no part of a page is looked through more than twice.
    """

    def __init__(self, html: str) -> None:
        self.html, self.last, self.unpaired = html, html.rfind(">"), 0

    def end(self, at: int) -> int:
        """The place of the > of a tag whose attributes begin at `at`; -1 if there is none."""
        html = self.html
        if at > self.last:
            return -1
        j = at
        while at >= self.unpaired:
            j = UNQUOTED.match(html, j).end()
            if j > self.last:
                self.unpaired = j
                break
            c = html[j]
            if c == ">":
                return j
            if c in "\"'":
                close = html.find(c, j + 1)
                if close < 0:
                    self.unpaired = j + 1
                    break
                j = close + 1
            # else an unquoted value begins here, or another = follows
        return html.find(">", at)


class _Page:
    """The open elements of a page and the blocks found so far."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, Node, bool]] = []  # tag, innermost block-level element, whether it is marked
        self.places: dict[str, list[int]] = {}  # of each tag in the stack
        self.block_places: list[int] = []
        self.root = self.node = Node(None)
        self.parts: list[str] = []
        self.links = self.linked = self.marked = 0

    def text(self, text: str) -> None:
        if "&" in text:
            text = unescape(text)
        self.parts.append(text)
        if self.links > 0:
            self.linked += len(text.strip())

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(self.node, text, min(self.linked, len(text)), self.marked > 0))
            self.parts.clear()
            self.linked = 0

    def open(self, tag: str, names: str) -> None:
        place = len(self.stack)
        if tag in BLOCK:
            self.block_places.append(place)
            self.node = Node(self.node, tag, names)
        elif tag == "a":
            self.links += 1
        marked = GOLD in names
        self.marked += marked
        self.places.setdefault(tag, []).append(place)
        self.stack.append((tag, self.node, marked))

    def close(self, n: int) -> None:
        """Leave the elements from number n on."""
        if self.block_places and self.block_places[-1] >= n:
            self.flush()
        while len(self.stack) > n:
            tag, _, marked = self.stack.pop()
            self.places[tag].pop()
            self.marked -= marked
            self.links -= tag == "a"
        while self.block_places and self.block_places[-1] >= n:
            self.block_places.pop()
        self.node = self.stack[-1][1] if self.stack else self.root

    def last(self, tags: frozenset[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def end(self, tag: str) -> None:
        if self.places.get(tag):
            k = self.places[tag][-1]
            if tag in BLOCK or not self.block_places or self.block_places[-1] < k:
                self.close(k)
        elif tag in BLOCK:
            self.flush()

    def implied_ends(self, tag: str) -> None:
        """Leave what the start of a block-level element ends."""
        self.flush()
        if tag in ENDS_P and (k := self.last(PARAGRAPH)) > self.last(SCOPE):
            self.close(k)
        if tag in ENDS and (k := self.last(ENDS[tag][0])) > self.last(ENDS[tag][1]):
            self.close(k)


def leaf_blocks(html: str) -> list[Block]:
    """The blocks of a page with any text, in page order; takes time in proportion to the page."""
    page, tags = _Page(), _Tags(html)
    closings: dict[str, dict[int, int]] = {}
    at, size = 0, len(html)
    while at < size:
        begin = html.find("<", at)
        if begin != at:
            page.text(html[at : begin if begin >= 0 else size])
            if begin < 0:
                break
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 4)
            at = end + 3 if end >= 0 else size
            continue
        if html.startswith(("<!", "<?"), begin):
            end = html.find(">", begin)
            at = end + 1 if end >= 0 else size
            continue
        m = NAME.match(html, begin + 1)
        end = tags.end(m.end()) if m else -1
        if end < 0:
            page.text("<")
            at = begin + 1
            continue
        at = end + 1
        tag = m[2].lower()
        if m[1]:
            page.end(tag)
            continue
        if tag in VOID:
            if tag == "br":
                page.parts.append(" ")
            elif tag == "hr":
                page.flush()
            continue
        if tag in OPEN:
            if tag not in closings:
                closings[tag] = closed(html, tag)
            at = max(at, closings[tag].get(begin, at))
            page.parts.append(" ")
            continue
        if tag in RAW:
            if html[end - 1] != "/":
                found = _end_tag(tag).search(html, at)
                close = html.find(">", found.end()) if found else -1
                at = close + 1 if close >= 0 else size
            page.parts.append(" ")
            continue
        if tag in BLOCK:
            page.implied_ends(tag)
        names = ""
        if end > m.end():
            attributes = html[m.end() : end]
            if "=" in attributes or "hidden" in attributes or GOLD in attributes:
                names = _kept_names(attributes) if len(attributes) < 500 else _names(attributes)
        page.open(tag, names)
    page.flush()
    return page.blocks


#: Words in names of elements, by what they tell.
HINTS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc topbar pagination pager tabs skip".split(),
    "head": "header masthead banner logo branding sitename topnav".split(),
    "foot": "footer foot copyright colophon legal imprint bottom credits".split(),
    "side": "sidebar aside rail widget widgets related recommended popular trending tags archive blogroll more teaser teasers".split(),
    "ad": "ad ads adv advert adverts advertisement sponsor sponsored promo promotion promoted banner outbrain taboola affiliate dfp".split(),
    "comment": "comment comments commentlist reply replies respond discussion disqus reactions feedback".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall message toast banner".split(),
    "share": "share sharing social twitter facebook follow like".split(),
    "form": "form search login signin register contact field input".split(),
    "meta": "meta byline author date time published posted timestamp category".split(),
    "main": "main content article post entry story body text page blog news single maincontent articlebody hentry prose markdown".split(),
}
OF_WORD: dict[str, list[str]] = {}
for _kind, _words in HINTS.items():
    for _w in _words:
        OF_WORD.setdefault(_w, []).append(_kind)
TAGS = frozenset("nav header footer aside article main section form table td th ul ol li dl dt dd h1 h2 h3 h4 h5 h6 p blockquote pre figure figcaption button label fieldset details summary address div menu dialog".split())


def text_features(b: Block, k: int, n: int) -> list[str]:
    text = b.text
    words = text.count(" ") + 1
    share = b.linked / max(1, len(text))
    marks = sum(text.count(c) for c in ".,;!?")
    out = ["words:" + ("1" if words < 2 else "4" if words < 5 else "9" if words < 10 else "19" if words < 20 else "49" if words < 50 else "50+"), "links:" + ("0" if share < 0.05 else "3" if share < 0.4 else "8" if share < 0.8 else "9")]
    out.append("ends" if text[-1] in END_MARKS else "open")
    out.append("marks:" + str(min(marks, 6)))
    if k < 3:
        out.append(f"first:{k}")
    if n - k <= 2:
        out.append(f"last:{n - k}")
    out.append("place:" + str(4 * k // n))
    if "©" in text or "(c)" in text.lower()[:12]:
        out.append("copyright")
    if "|" in text or "»" in text or "›" in text:
        out.append("separators")
    if words >= 2 and text.isupper():
        out.append("upper")
    if any(c.isdigit() for c in text[:40]):
        out.append("digits")
    return out


class Chain:
    """Weights of the features and of the transitions between 'other' (0) and 'main' (1)."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> None:
        self.index, self.weights, self.transitions, self.start = index, weights, transitions, start
        self._nodes: dict[tuple, float] = {}
        # only the difference between the states matters
        self._margin = {f: float(weights[k, 1] - weights[k, 0]) for f, k in index.items()}

    def emissions(self, blocks: list[Block]) -> list[float]:
        """What the features of each block add to the score of 'main'."""
        margin, out, n = self._margin, [], len(blocks)
        node, of_node = None, 0.0
        for k, block in enumerate(blocks):
            if block.node is not node:
                node = block.node
                key = node.key()
                found = self._nodes.get(key)
                if found is None:
                    if len(self._nodes) > 50_000:
                        self._nodes.clear()
                    found = self._nodes[key] = sum(margin.get(f, 0.0) for f in node.features())
                of_node = found
            out.append(of_node + sum(margin.get(f, 0.0) for f in text_features(block, k, n)))
        return out

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The most likely states (Viterbi)."""
        n = len(blocks)
        if not n:
            return []
        (t00, t01), (t10, t11) = self.transitions.tolist()
        back: list[tuple[int, int]] = []
        a, b = 0.0, 0.0
        for k, e in enumerate(self.emissions(blocks)):
            if k == 0:
                a, b = float(self.start[0]), float(self.start[1]) + e
                continue
            from0, from1 = (0 if a + t00 >= b + t10 else 1), (0 if a + t01 >= b + t11 else 1)
            back.append((from0, from1))
            a, b = max(a + t00, b + t10), max(a + t01, b + t11) + e
        state = int(b > a)
        out = [bool(state)]
        for pair in reversed(back):
            state = pair[state]
            out.append(bool(state))
        return out[::-1]


@dataclass(frozen=True)
class TrainingData:
    """The blocks of labelled pages as rows of features."""

    index: dict[str, int]
    x: np.ndarray  # row by feature
    page: np.ndarray  # of each row
    place: np.ndarray  # of each row in its page
    gold: np.ndarray
    mask: np.ndarray  # page by place


def training_data(pages: list[list[Block]]) -> TrainingData:
    index: dict[str, int] = {}
    rows = [[index.setdefault(f, len(index)) for f in (*b.node.features(), *text_features(b, k, len(blocks)))] for blocks in pages for k, b in enumerate(blocks)]
    x = np.zeros((len(rows), len(index)))
    for r, fs in enumerate(rows):
        x[r, fs] = 1
    lengths = np.array([len(p) for p in pages])
    place = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    gold = np.array([int(b.gold) for p in pages for b in p])
    return TrainingData(index, x, np.repeat(np.arange(len(pages)), lengths), place, gold, np.arange(int(lengths.max()))[None, :] < lengths[:, None])


def loss_and_gradients(data: TrainingData, w: np.ndarray, t: np.ndarray, s: np.ndarray, decay: float) -> tuple[float, list[np.ndarray]]:
    """The negative log likelihood a row, with the L2 penalty, and its gradients in the weights, transitions and start; sums run over all pages at once."""
    n, longest = data.mask.shape
    page, place, gold, mask, rows = data.page, data.place, data.gold, data.mask, len(data.gold)
    e = np.zeros((n, longest, 2))
    e[page, place] = data.x @ w
    forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
    forward[:, 0] = s + e[:, 0]
    for k in range(1, longest):
        step = np.logaddexp.reduce(forward[:, k - 1, :, None] + t[None], axis=1) + e[:, k]
        forward[:, k] = np.where(mask[:, k, None], step, forward[:, k - 1])
    for k in range(longest - 2, -1, -1):
        step = np.logaddexp.reduce(t[None] + (e[:, k + 1] + backward[:, k + 1])[:, None, :], axis=2)
        backward[:, k] = np.where(mask[:, k + 1, None], step, 0)
    total = np.logaddexp.reduce(forward[:, -1], axis=1)
    p = np.exp(forward + backward - total[:, None, None])[page, place]
    pair = np.exp(forward[:, :-1, :, None] + t[None, None] + (e + backward)[:, 1:, None, :] - total[:, None, None, None])
    p_t = (pair * mask[:, 1:, None, None]).sum((0, 1))
    follow = np.flatnonzero(place > 0)
    gold_t, gold_s = np.zeros((2, 2)), np.bincount(gold[place == 0], minlength=2)
    np.add.at(gold_t, (gold[follow - 1], gold[follow]), 1)
    scored = e[page, place][np.arange(rows), gold].sum() + (gold_t * t).sum() + (gold_s * s).sum()
    loss = (total.sum() - scored) / rows + decay / 2 * sum(float((v * v).sum()) for v in (w, t, s))
    return loss, [data.x.T @ (p - np.eye(2)[gold]) / rows + decay * w, (p_t - gold_t) / rows + decay * t, (p[place == 0].sum(0) - gold_s) / rows + decay * s]


def train_chain(pages: list[list[Block]], rounds: int = 150, decay: float = 1e-3) -> Chain:
    """Maximum likelihood with an L2 penalty, by Adam on all pages."""
    data = training_data(pages)
    w, t, s = np.zeros((len(data.index), 2)), np.zeros((2, 2)), np.zeros(2)
    state = [(np.zeros_like(v), np.zeros_like(v)) for v in (w, t, s)]
    for step in range(1, rounds + 1):
        _, grads = loss_and_gradients(data, w, t, s, decay)
        for value, grad, (m1, m2) in zip((w, t, s), grads, state, strict=True):
            m1 += 0.1 * (grad - m1)
            m2 += 0.01 * (grad * grad - m2)
            value -= 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return Chain(data.index, w, t, s)


SYLLABLES = "ra len to mi sa ver on the di ku pe al or in st ma ne vo lu ter an ci go fa be no us tri".split()


class PageMaker:
    """Labelled pages in many layouts; elements of main text carry the attribute GOLD."""

    def __init__(self, seed: int) -> None:
        self.rng = np.random.Generator(np.random.PCG64(seed))

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def pick(self, *options: str) -> str:
        return options[int(self.rng.integers(len(options)))]

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.pick(*SYLLABLES) for _ in range(int(self.rng.integers(1, 4)))) for _ in range(int(self.rng.integers(low, high + 1))))

    def sentence(self, low: int = 4, high: int = 18) -> str:
        s = self.words(low, high)
        if self.chance(0.3):
            s = s.replace(" ", ", ", 1)
        return s.capitalize() + self.pick(".", ".", ".", ".", "!", "?")

    def prose(self) -> str:
        n = 1 if self.chance(0.25) else int(self.rng.integers(1, 7))
        s = " ".join(self.sentence(1 if self.chance(0.15) else 4) for _ in range(n))
        if self.chance(0.1):
            s = s.replace(" ", " &amp; ", 1)
        if self.chance(0.12):
            s = f'<a href="/x">{self.words(1, 3)}</a> ' + s
        if self.chance(0.15):
            s = f"<b>{s}" + ("</b>" if self.chance(0.6) else "")
        if self.chance(0.1):
            s += "<br>" + self.sentence()
        return s

    def heading(self) -> str:
        return self.words(2, 9).capitalize() + ("." if self.chance(0.2) else "")

    def links(self, tag: str = "ul") -> str:
        n = int(self.rng.integers(3, 9))
        return f"<{tag}>" + "".join(f'<li><a href="/{k}">{self.words(1, 3).capitalize() if self.chance(0.5) else self.words(1, 2)}</a>' + ("</li>" if self.chance(0.9) else "") for k in range(n)) + f"</{tag}>"

    def menu(self) -> str:
        k = int(self.rng.integers(5))
        return [f"<nav>{self.links()}</nav>", f'<div class="{self.pick("menu", "navbar", "main-nav", "navigation")}">{self.links()}</div>', f'<ul class="nav menu"><li><a href="/">{self.words(1, 1)}</a></li><li><a href="/b">{self.words(1, 2)}</a></li></ul>', f'<nav class="breadcrumb"><a href="/">{self.words(1, 1)}</a> &gt; <a href="/c">{self.words(1, 2)}</a></nav>', f'<div id="topbar"><a href="/">{self.words(1, 2)}</a> | <a href="/y">{self.words(1, 2)}</a></div>'][k]

    def top(self) -> str:
        k = int(self.rng.integers(4))
        return [f"<header><h1>{self.heading()}</h1><p>{self.sentence(3, 7)}</p></header>", f'<div class="header"><a class="logo" href="/">{self.words(1, 2)}</a><span>{self.words(2, 6)}</span></div>', f"<header>{self.links()}</header>", f'<div id="masthead">{self.words(1, 4)}</div>'][k]

    def ad(self) -> str:
        c = self.pick("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-slot")
        return f'<{self.pick("div", "div", "aside")} {self.pick("class", "class", "id")}="{c}">{self.pick(self.sentence(3, 14), self.prose(), f"<p>{self.sentence()}</p>")}</div>'

    def notice(self) -> str:
        return f'<div class="{self.pick("cookie-notice", "consent", "notice", "newsletter", "alert", "popup", "subscribe")}">' + self.pick(f"<p>{self.prose()}</p>", self.sentence()) + f"<button>{self.words(1, 2)}</button></div>"

    def side(self) -> str:
        inner = self.pick(f"<h3>{self.words(1, 3)}</h3>{self.links()}", f"<h4>{self.words(1, 3)}</h4><p>{self.prose()}</p>", self.links("ol"), f"<p>{self.sentence()}</p>")
        return self.pick(f"<aside>{inner}</aside>", f'<div class="{self.pick("sidebar", "related", "widget", "rail", "popular")}">{inner}</div>', f'<section class="related-posts">{inner}</section>')

    def form(self) -> str:
        return f'<form><label>{self.words(1, 3)}</label><input name="q"><p>{self.sentence(3, 9)}</p><button>{self.words(1, 1)}</button></form>'

    def comments(self) -> str:
        n = int(self.rng.integers(1, 5))
        one = lambda: self.pick(f'<div class="comment"><b>{self.words(1, 2)}</b><p>{self.prose()}</p></div>', f"<li><p>{self.prose()}</p></li>", f"<article><p>{self.prose()}</p></article>")
        return f'<{(t := self.pick("div", "section", "ol"))} {self.pick("class", "id")}="{self.pick("comments", "comment-list", "replies", "discussion", "respond")}"><h3>{self.words(1, 2)}</h3>' + "".join(one() for _ in range(n)) + f"</{t}>"

    def share(self) -> str:
        return f'<div class="{self.pick("share", "social", "follow-us")}"><a href="#">{self.words(1, 1)}</a> <a href="#">{self.words(1, 1)}</a></div>'

    def foot(self) -> str:
        text = self.pick(f"&copy; {self.words(1, 3)} &middot; {self.sentence(3, 8)}", f"© 20{int(self.rng.integers(10, 25))} {self.words(1, 3)}. {self.sentence()}", self.prose(), self.links())
        return self.pick(f"<footer>{text}</footer>", f'<div class="footer">{text}</div>', f"<footer><p>{text}</p></footer>", f'<div id="footer">{self.links()}<p>{text}</p></div>')

    def main(self) -> str:
        def p() -> str:
            return f"<p {GOLD}>{self.prose()}" + ("</p>" if self.chance(0.85) else "")

        parts = [f"<h1 {GOLD}>{self.heading()}</h1>"] if self.chance(0.75) else []
        if self.chance(0.15):
            parts.append(f"<h2 {GOLD}>{self.heading()}</h2>")
        for _ in range(int(self.rng.integers(1, 14))):
            r = self.rng.random()
            if r < 0.62:
                parts.append(p())
            elif r < 0.68:
                parts.append(f"<{(h := self.pick('h2', 'h3', 'h4'))} {GOLD}>{self.heading()}</{h}>")
            elif r < 0.73:
                parts.append(f"<ul {GOLD}>" + "".join(f"<li>{self.sentence(2, 9)}</li>" for _ in range(int(self.rng.integers(2, 6)))) + "</ul>")
            elif r < 0.76:
                parts.append(f"<blockquote {GOLD}><p>{self.prose()}</p></blockquote>")
            elif r < 0.78:
                parts.append(f"<pre {GOLD}>{self.words(3, 20)}</pre>")
            elif r < 0.81:
                parts.append(f"<figure {GOLD}><img src=x><figcaption>{self.sentence(3, 9)}</figcaption></figure>")
            elif r < 0.83:
                parts.append(f"<table {GOLD}><tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr><tr><td>{self.words(1, 2)}<td>{self.words(1, 4)}</table>")
            elif r < 0.85:
                parts.append(f"<div {GOLD}>{self.prose()}</div>")
            else:
                parts.append(self.pick(self.ad(), self.share(), self.side(), self.notice(), self.form()))
        body = "".join(parts)
        kind = int(self.rng.integers(8))
        name = self.pick("content", "post-content", "entry-content", "article-body", "story", "post", "main-text", "page-content")
        return [f"<article>{body}</article>", f"<article>{body}</article>", f"<main>{body}</main>", f"<main><article>{body}</article></main>", f'<div class="{name}">{body}</div>', f'<div id="{name}"><div>{body}</div></div>', f'<section class="{name}">{body}</section>', f"<div><div>{body}</div></div>"][kind]

    def page(self) -> str:
        head = f"<!DOCTYPE html><html><head><title>{self.heading()}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head><body>"
        before = [f() for f, p in ((self.top, 0.4), (self.menu, 0.75), (self.notice, 0.2), (self.ad, 0.4), (self.side, 0.15), (self.form, 0.15)) if self.chance(p)]
        after = [f() for f, p in ((self.share, 0.2), (self.ad, 0.2), (self.comments, 0.35), (self.side, 0.35), (self.form, 0.15), (self.notice, 0.1), (self.foot, 0.85)) if self.chance(p)]
        if self.chance(0.3):
            self.rng.shuffle(before)
        return head + "".join(before) + self.main() + "".join(after) + ("</body></html>" if self.chance(0.9) else "")


def labelled_pages(n: int, seed: int = 5) -> list[list[Block]]:
    maker = PageMaker(seed)
    found = []
    while len(found) < n:
        if blocks := leaf_blocks(maker.page()):
            found.append(blocks)
    return found


def main_text(html: str | None, chain: Chain) -> str:
    blocks = leaf_blocks(html) if html else []
    return " ".join(b.text for b, keep in zip(blocks, chain.decode(blocks), strict=True) if keep)


def _extract(shared, field_: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: Chain = shared.value
        for batch, pages in slices(with_text(batches, field_), "_text"):
            text = [main_text(p.decode("utf-8", "replace") if p else None, chain).encode("utf-8", "replace").decode() for p in pages]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(text, pa.string())], names=["row", "text"])

    return scan


#: Labelled pages that the chain is trained on.
TRAINING_PAGES = 400


def extract_text(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """Per page: `row` (its columns) and text, the main text of its html."""
    rows = nested(pages)
    shared = pages.sparkSession.sparkContext.broadcast(chain or train_chain(labelled_pages(TRAINING_PAGES)))
    return rows.mapInArrow(_extract(shared, "html"), with_fields(rows.schema["row"].dataType, ("text", "string")))


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    found = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select(F.col("row.page_id").alias("page_id"), F.col("row.url").alias("url"), "text", F.char_length("text").cast("long").alias("n_chars"))
