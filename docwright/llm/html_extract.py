"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page becomes the sequence of its leaf blocks: runs of text between block-level tags. Each block
has features of its ancestors' tags, their class and id words, and of its text. A chain with two
states, main text or not, is trained on labelled pages and decoded by Viterbi; the main blocks are
joined in page order.

The labelled pages are made here, from a seeded choice of layouts whose blocks are known to be main
text or not; ``N_PAGES`` bounds them. ``train`` takes any other labelled pages as well.

Defined results: null or empty html, or a page without main blocks, gives the empty text; scripts,
styles, comments, forms and the head are never text; elements marked as hidden count as any other;
unclosed elements, tags and comments end with the page; equal rows are kept; an empty table gives an
empty table; extra columns are ignored, and a kept column with a result's name gives way to it.
"""

from __future__ import annotations

import bisect
import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docwright.llm.frames import without

N_PAGES, SEED = 600, 11
ROUNDS, RATE, DECAY = 300, 0.2, 3e-4

NAME = re.compile(r"[A-Za-z][^\s/>]*+")
#: Up to the end of a tag: a quote counts only after an equals sign, and only where it closes.
TAG_END = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""")
NAMED = {"class", "id", "role"}
#: A number of a character reference too long to be a character; zeros before it count for nothing.
FAR_REFERENCE = re.compile(r"&#(?:0*+[1-9][0-9]{7,}|[xX]0*+[1-9a-fA-F][0-9a-fA-F]{6,});?")
#: The zeros before the number of a reference, which can make it longer than numbers may be.
ZEROS = re.compile(r"(&#)0+(?=[0-9])|(&#[xX])0+(?=[0-9a-fA-F])")
#: Fixed values of the HTML standard: elements whose content is no page text, that never have
#: content, and that stand inside a line.
DROPPED = {"script", "style", "noscript", "template", "head", "title", "textarea", "select", "button", "svg", "iframe", "object", "form"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
    "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
    "tt", "u", "var", "wbr",
}
IN_HEAD = {"base", "basefont", "bgsound", "link", "meta", "title", "style", "script", "noscript", "template"}
#: Starts and ends of forms, and what shows that a form wraps the page and is no form of it.
FORM, WRAPPED = re.compile(r"<(/?)form\b", re.I), re.compile(r"<(?:article|main|h1)\b", re.I)
CLOSED_BY_SELF = {"li", "dt", "dd", "tr", "td", "th", "option"}
SCOPES = {"ul", "ol", "dl", "table", "article", "section", "main", "div", "aside", "nav", "header", "footer", "body", "html"}


@dataclass(frozen=True)
class Place:
    """What an open element hands down to the text in it; elements that add nothing share one."""

    tag: str = ""
    tags: tuple[str, ...] = ()
    names: tuple[str, ...] = ()


@dataclass
class Block:
    """A leaf block: its text, the element it stands in, and how much of it is links."""

    text: str
    place: Place
    linked: int
    label: int = -1


@dataclass
class _Open:
    tag: str
    place: Place
    dropped: bool
    linked: bool
    scope: int  # index of the nearest element, itself included, that bounds implied ends


class _Builder:
    """The open elements of a page. Every element is looked up by tag, so no step walks the stack."""

    def __init__(self, known: frozenset[str] | None):
        self.known = known  # names that features are made of; all if None
        self.stack: list[_Open] = [_Open("", Place(), False, False, -1)]
        self.where: dict[str, list[int]] = {}
        self.parts: list[str] = []
        self.linked = 0
        self.blocks: list[Block] = []

    def add(self, raw: str) -> None:
        top = self.stack[-1]
        if raw and top.tag == "head" and not raw.isspace():
            self.close("head")
            top = self.stack[-1]
        if raw and not top.dropped:
            text = html.unescape(ZEROS.sub(r"\1\2", FAR_REFERENCE.sub("�", raw))) if "&" in raw else raw
            self.parts.append(text)
            if top.linked:
                self.linked += len("".join(text.split()))

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(text, self.stack[-1].place, self.linked))
            self.parts, self.linked = [], 0

    def close(self, tag: str, bound: int = -1) -> None:
        """Close the nearest open ``tag`` and all in it, if it lies above the element ``bound``."""
        held = self.where.get(tag)
        if held and held[-1] > bound:
            for gone in self.stack[held[-1] :][::-1]:
                self.where[gone.tag].pop()
                self.stack.pop()

    def nearest(self, tag: str) -> int:
        held = self.where.get(tag)
        return held[-1] if held else -1

    def end(self, tag: str) -> None:
        self.close(tag, self.nearest("table") if tag in {"p", "li", "td", "th", "tr"} else -1)

    def open(self, tag: str, rest: str, kept: bool = False) -> None:
        if tag not in IN_HEAD:  # an unclosed head ends here
            self.close("head")
        if tag not in INLINE:
            self.close("p", self.stack[-1].scope)
        if tag in CLOSED_BY_SELF:
            self.close(tag, self.stack[-1].scope)
        if tag in VOID:
            return
        up = self.stack[-1]
        words = [w for m in ATTRIBUTE.finditer(rest) if m[1].lower() in NAMED for w in re.findall(r"[a-z]+", (m[2] or m[3] or m[4] or "").lower())]
        at = len(self.stack)
        self.where.setdefault(tag, []).append(at)
        self.stack.append(
            _Open(tag, self.placed(up.place, tag, words), up.dropped or (tag in DROPPED and not kept), up.linked or tag == "a", at if tag in SCOPES else up.scope)
        )

    def placed(self, up: Place, tag: str, words: list[str]) -> Place:
        known = self.known
        if known is not None:
            words = [w for w in words if f"name={w}" in known]
        fresh = tuple(w for w in dict.fromkeys(words) if w not in up.names)
        own = up.tag if tag in INLINE else tag
        new = tag not in INLINE and tag not in up.tags and (known is None or f"up={tag}" in known)
        if not fresh and not new and own == up.tag:
            return up
        return Place(own, (*up.tags, tag) if new else up.tags, up.names + fresh)


def wrapping_forms(page: str) -> set[int]:
    """Where forms begin that hold an article, a main part or the first heading: they wrap the page, and only their fields are dropped."""
    marks, open_, found = [m.start() for m in WRAPPED.finditer(page)], [], set()
    for m in FORM.finditer(page):
        if not m[1]:
            open_.append(m.start())
        elif open_:
            begin = open_.pop()
            if bisect.bisect(marks, begin) < bisect.bisect(marks, m.start()):
                found.add(begin)
    return found | {begin for begin in open_ if marks and marks[-1] > begin}


def leaf_blocks(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """The leaf blocks of a page in order, in time linear in the page.

    Only ancestors' tags and names among the features ``known`` are kept, so what a block carries
    is bounded however deep it lies. A tag that never ends takes the rest of the page with it, as
    in browsers; once a quote in a tag doesn't close, quotes no longer hide the ends of tags.
    """
    built, at, quoted, raw_end, forms = _Builder(known), 0, True, {}, wrapping_forms(page)
    while (begin := page.find("<", at)) >= 0:
        second = page[begin + 1 : begin + 2]
        closing = second == "/"
        name = NAME.match(page, begin + 1 + closing)
        if name is None and second not in ("!", "?", "/"):
            built.add(page[at : begin + 1])
            at = begin + 1
            continue
        built.add(page[at:begin])
        if name is None:
            comment = page.startswith("<!--", begin)
            stop = page.find("-->", begin + 2) if comment else page.find(">", begin)
            at = len(page) if stop < 0 else stop + (3 if comment else 1)
            continue
        tail = TAG_END.match(page, name.end()) if quoted else None
        if tail is None:
            quoted = False
            stop = page.find(">", name.end())
            at = len(page) if stop < 0 else stop + 1
            if stop < 0:
                break
        else:
            at = tail.end()
        tag, rest = name[0].lower(), page[name.end() : at - 1]
        if tag not in INLINE:
            if tag == "br":
                built.parts.append("\n")
                continue
            built.flush()
        if closing:
            built.end(tag)
            continue
        built.open(tag, rest, kept=begin in forms)
        if tag in RAW and not (tag == "svg" and rest.endswith("/")):
            if tag not in raw_end:
                raw_end[tag] = re.compile(rf"</{tag}\b", re.I)
            stop = raw_end[tag].search(page, at)
            at = stop.start() if stop else len(page)
        elif tag == "svg":
            built.end(tag)
    built.add(page[at:])
    built.flush()
    return built.blocks


def place_features(place: Place) -> list[str]:
    """Names of the features that a block's place turns on."""
    tag, tags = place.tag, place.tags
    on = [f"tag={tag}", *[f"up={t}" for t in tags], *[f"name={n}" for n in place.names]]
    if tag:
        on += [f"{t}>{tag}" for t in tags if t in SCOPES and t not in ("html", "body", tag)]
    return on


def text_features(b: Block) -> list[str]:
    """Names of the features that a block's text turns on."""
    n, chars = len(b.text.split()), max(1, len("".join(b.text.split())))
    words = 0 if n < 4 else 1 if n < 10 else 2 if n < 25 else 3
    share = b.linked / chars
    on = ["bias", f"words={words}", f"links={0 if share < 0.05 else 1 if share < 0.5 else 2}", f"end={b.text[-1] in '.!?\"”…'}"]
    if "©" in b.text[:40]:
        on.append("copyright")
    return on


def features(b: Block) -> list[str]:
    return text_features(b) + place_features(b.place)


@dataclass
class Chain:
    """Weights: by feature and state, and by pair of neighbouring states."""

    weights: dict[str, tuple[float, float]]
    moves: tuple[tuple[float, float], tuple[float, float]]
    known: frozenset[str] = field(init=False)

    def __post_init__(self) -> None:
        self.known = frozenset(self.weights)

    def score(self, on: list[str]) -> tuple[float, float]:
        held = [w for f in on if (w := self.weights.get(f)) is not None]
        return sum(w[0] for w in held), sum(w[1] for w in held)

    def decode(self, blocks: list[Block]) -> list[int]:
        """The best sequence of states, by Viterbi."""
        if not blocks:
            return []
        best, back, placed = (0.0, 0.0), [], {}
        m = self.moves
        for i, b in enumerate(blocks):
            if id(b.place) not in placed:
                placed[id(b.place)] = self.score(place_features(b.place))
            (s0, s1), (t0, t1) = placed[id(b.place)], self.score(text_features(b))
            s0, s1 = s0 + t0, s1 + t1
            if i == 0:
                best = s0, s1
                continue
            a0, a1 = best[0] + m[0][0], best[1] + m[1][0]
            b0, b1 = best[0] + m[0][1], best[1] + m[1][1]
            back.append((0 if a0 >= a1 else 1, 0 if b0 > b1 else 1))
            best = max(a0, a1) + s0, max(b0, b1) + s1
        states = [0 if best[0] > best[1] else 1]
        for step in reversed(back):
            states.append(step[states[-1]])
        return states[::-1]


def train(pages: list[list[Block]], rounds: int = ROUNDS) -> Chain:
    """Fit a chain to labelled pages by gradient ascent on the penalised log-likelihood.

    All pages go through forward-backward at once, padded to the longest.
    """
    pages = [p for p in pages if p]
    names = sorted({f for p in pages for b in p for f in features(b)})
    number = {f: k for k, f in enumerate(names)}
    n, longest = len(pages), max(map(len, pages))
    page, place, feature = [], [], []
    truth, there = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for a, p in enumerate(pages):
        for i, b in enumerate(p):
            truth[a, i], there[a, i] = b.label, True
            for f in features(b):
                page.append(a)
                place.append(i)
                feature.append(number[f])
    page, place, feature = map(np.array, (page, place, feature))
    flat = page * longest + place
    wanted = np.zeros((n, longest, 2))
    wanted[np.arange(n)[:, None], np.arange(longest)[None, :], truth] = 1.0
    wanted *= there[:, :, None]
    both = there[:, 1:] & there[:, :-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[:, :-1][both], truth[:, 1:][both]), 1.0)
    w, m = np.zeros((len(names), 2)), np.zeros((2, 2))
    gw, gm = np.zeros_like(w) + 1e-8, np.zeros_like(m) + 1e-8
    for _ in range(rounds):
        score = np.stack([np.bincount(flat, w[feature, s], n * longest) for s in (0, 1)], axis=1).reshape(n, longest, 2)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for i in range(1, longest):
            came = np.logaddexp(ahead[:, i - 1, 0, None] + m[0], ahead[:, i - 1, 1, None] + m[1]) + score[:, i]
            ahead[:, i] = np.where(there[:, i, None], came, ahead[:, i - 1])
        for i in range(longest - 2, -1, -1):
            on = score[:, i + 1] + behind[:, i + 1]
            goes = np.logaddexp(m[:, 0] + on[:, 0, None], m[:, 1] + on[:, 1, None])
            behind[:, i] = np.where(there[:, i + 1, None], goes, 0.0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        chance = np.exp(ahead + behind - total[:, None, None]) * there[:, :, None]
        pair = np.exp(
            ahead[:, :-1, :, None] + m + score[:, 1:, None, :] + behind[:, 1:, None, :] - total[:, None, None, None]
        ) * both[:, :, None, None]
        over = (wanted - chance).reshape(-1, 2)[flat]
        dw = np.stack([np.bincount(feature, over[:, s], len(names)) for s in (0, 1)], axis=1) / n - DECAY * w
        dm = (seen - pair.sum(axis=(0, 1))) / n - DECAY * m
        gw, gm = gw + dw**2, gm + dm**2
        w, m = w + RATE * dw / np.sqrt(gw), m + RATE * dm / np.sqrt(gm)
    return Chain({f: (float(w[k, 0]), float(w[k, 1])) for f, k in number.items()}, tuple(map(tuple, m.tolist())))


class _Layouts:
    """Labelled pages: html, and for each leaf block whether it is main text."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        make = lambda: "".join(self.r.choice(("ka", "lo", "mi", "ter", "ven", "su", "ra", "on", "es", "id")) for _ in range(self.r.randint(1, 4)))
        return " ".join(make() for _ in range(self.r.randint(low, high)))

    def sentence(self, low: int = 4, high: int = 40) -> str:
        return self.words(low, high).capitalize() + self.r.choice(".....!?")

    def links(self, n: int) -> list[str]:
        return [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(n)]

    def listed(self, n: int, name: str) -> list[tuple[str, int]]:
        return [(f"<ul{name}>", -1), *[(f"<li>{x}</li>", 0) for x in self.links(n)], ("</ul>", -1)]

    def before(self) -> list[tuple[str, int]]:
        r, out = self.r, []
        if r.random() < 0.4:
            out += [("<header>" if r.random() < 0.6 else '<div class="header" id="top">', -1), (f"<div>{self.words(1, 4)}</div>", 0), ("</header>", -1)]
        if r.random() < 0.9:
            tag, name = r.choice((("nav", ""), ("nav", ""), ("div", ' class="menu"'), ("div", ' id="navigation"'), ("div", "")))
            out += [(f"<{tag}{name}>", -1), *self.listed(r.randint(2, 9), ""), (f"</{tag}>", -1)]
        return out + self.aside(0.5)

    def aside(self, chance: float) -> list[tuple[str, int]]:
        r, out = self.r, []
        kinds = (
            ("div", "ad"), ("div", "advert"), ("div", "ads banner"), ("div", "sponsored"), ("div", "promo"), ("div", "cookie notice"),
            ("div", "newsletter signup"), ("aside", "sidebar"), ("aside", ""), ("div", "sidebar"), ("div", "related"), ("div", "share social"),
            ("div", "breadcrumb"), ("div", "notice"),
        )
        while r.random() < chance:
            tag, name = r.choice(kinds)
            inner = r.choice(("text", "p", "links"))
            out.append((f'<{tag} class="{name}">' if name else f"<{tag}>", -1))
            if inner == "links":
                out += self.listed(r.randint(1, 5), "")
            else:
                body = self.sentence(3, 20)
                out.append((f"<p>{body}</p>" if inner == "p" else body, 0))
            out.append((f"</{tag}>", -1))
            chance *= 0.6
        return out

    def body(self) -> list[tuple[str, int]]:
        r, out = self.r, []
        tag, name = r.choice(
            (("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' id="content"'), ("div", ' class="entry content"'),
             ("div", ' class="article body"'), ("section", ' class="story"'), ("div", ""), ("div", ' class="post text"'))
        )
        out.append((f"<{tag}{name}>", -1))
        if r.random() < 0.9:
            out.append((f"<h1>{self.words(2, 12).capitalize()}{r.choice(('', '.'))}</h1>", 1))
        if r.random() < 0.15:
            out += self.aside(0.6)
        for _ in range(r.choice((0, 1, 1, 2, 3, 5, 8, 12))):
            kind = r.random()
            if kind < 0.72:
                text = self.sentence(1, 60)
                if r.random() < 0.3:
                    text += f' <a href="/x">{self.words(1, 4)}</a> {self.sentence(3, 20)}'
                opened = r.choice(("<p>", "<p>", "<p>", "<p><b>", '<p class="lead">', "<div>"))
                close = "</div>" if opened == "<div>" else r.choice(("</p>", "</p>", "</p>", "<br>"))
                out.append((f"{opened}{text}{close}", 1))
            elif kind < 0.8:
                out.append((f"<h2>{self.words(1, 8)}</h2>", 1))
            elif kind < 0.88:
                out += [("<ul>", -1), *[(f"<li>{self.sentence(2, 15)}</li>", 1) for _ in range(r.randint(1, 5))], ("</ul>", -1)]
            elif kind < 0.93:
                out.append((f"<blockquote>{self.sentence()}</blockquote>", 1))
            elif kind < 0.96:
                out.append((f"<pre>{self.words(2, 20)}</pre>", 1))
            else:
                out += [("<table><tr>", -1), *[(f"<td>{self.words(1, 5)}</td>", 1) for _ in range(3)], ("</tr></table>", -1)]
            if r.random() < 0.05:
                out += self.aside(0.8)
        out.append((f"</{tag}>", -1))
        return out

    def after(self) -> list[tuple[str, int]]:
        r, out = self.r, self.aside(0.35)
        if r.random() < 0.3:
            name = r.choice(('class="comments"', 'id="comments"', 'class="comment list"', 'class="discussion replies"'))
            out += [(f"<section {name}>", -1), ("<h3>" + self.words(1, 3) + "</h3>", 0)]
            for _ in range(r.randint(1, 5)):
                out.append((f'<{"div" if r.random() < 0.5 else "p"} class="comment">{self.sentence(3, 30)}', 0))
            out.append(("</section>", -1))
        if r.random() < 0.9:
            tag, name = r.choice((("footer", ""), ("footer", ""), ("div", ' class="footer"'), ("div", ' id="footer"')))
            text = r.choice((f"&copy; {self.words(1, 3)} &middot; {self.sentence(3, 15)}", self.sentence(3, 12), f"&copy; {self.words(2, 5)}"))
            out += [(f"<{tag}{name}>", -1), *([(f"<p>{text}</p>", 0)] if r.random() < 0.4 else [(text, 0)]), (f"</{tag}>", -1)]
        return out

    def page(self) -> tuple[str, list[int]]:
        bare = self.r.random() < 0.12
        parts = self.body() if bare else [*self.before(), *self.body(), *self.after()]
        labels = [y for _, y in parts if y >= 0]
        head = f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><script>var x='</p>';</script></head><body>"
        return head + "".join(x for x, _ in parts) + "</body></html>", labels


def labelled_pages(n: int = N_PAGES, seed: int = SEED) -> list[list[Block]]:
    """Blocks of made pages with their labels; pages whose layout merges blocks are passed over."""
    made, out = _Layouts(seed), []
    while len(out) < n:
        page, labels = made.page()
        blocks = leaf_blocks(page)
        if len(blocks) == len(labels):
            for b, y in zip(blocks, labels, strict=True):
                b.label = y
            out.append(blocks)
    return out


@lru_cache(maxsize=1)
def default_chain() -> Chain:
    return train(labelled_pages())


def main_text(page: str, chain: Chain) -> str:
    """The main blocks of a page, joined by single spaces."""
    blocks = leaf_blocks(page, chain.known)
    return " ".join(b.text for b, s in zip(blocks, chain.decode(blocks), strict=True) if s)


def extract(pages: DataFrame, keep: list[str], column: str = "html", chain: Chain | None = None) -> DataFrame:
    """``keep`` with ``text``, the main text of each whole page, and ``n_chars``, its code points.

    The chain is trained on the driver, on a bounded number of pages, and its few hundred weights
    go to the tasks with the function.
    """
    chain, keep = chain or default_chain(), without(keep, ["text", "n_chars"])
    read = pages.select(*keep, F.col(column).cast("binary").alias("_page"))
    schema = T.StructType([*pages.select(*keep).schema.fields, *T.StructType.fromDDL("text string, n_chars bigint").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text((p.as_py() or b"").decode("utf-8", "replace"), chain) for p in batch.column(len(keep))]
            columns = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], schema.names)

    return read.mapInArrow(run, schema)
