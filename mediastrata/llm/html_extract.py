"""Main text of HTML pages: a linear-chain conditional random field over DOM leaf blocks.

A page's markup is read once, leniently, into leaf blocks: runs of text between block-level tags, each with the tags
and class names above it. Features of a block are its ancestors, its tag, and its text's shape; the field's labels are
article and other, with weights for label pairs, so that a block is judged with its neighbours. It is trained on
labelled pages (whose layouts labelled_pages() writes, with every block's label known), by gradient ascent on the
conditional log likelihood, and decoded by Viterbi.

A page is read once from front to end, in time that grows with its length, whatever it holds: a tag is matched at its place
without giving anything back, and the open elements are looked up by name. Below an element with the attribute ``hidden``, with
``aria-hidden`` true or with ``display: none`` in its style, nothing is read; attributes are told apart from their values.

Defined cases: a null or empty page, and one without article, gives an empty text; markup that is cut off ends where it
ends; unknown character references stay as they are, and those of no character are U+FFFD; a page of any length and depth is
read whole; repeated rows are each returned; an empty table gives no rows; columns in keep may have any names but text and
n_chars, and other columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediastrata.llm.common import Transform, table, text_list, with_columns

# HTML's elements without content, with raw content, and those that don't break a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes".split())
#: Raw content that is shown as it stands.
SHOWN_RAW = frozenset("xmp listing".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img ruby rt rp "
    # Formulas and drawings stand inside a sentence.
    "math semantics annotation mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd "
    "svg g defs symbol use desc metadata path rect circle ellipse line polyline polygon text tspan textpath image clippath mask marker pattern filter lineargradient radialgradient stop".split()
)
#: Inline, but a reader sees a gap before them.
_SPACED = frozenset("mtd text".split())
#: Raw content, controls, and parts of formulas and drawings that a reader never sees as text.
HIDDEN = frozenset("script style template head title textarea select option noscript iframe annotation annotation-xml defs symbol desc metadata object canvas audio video".split())
#: What can stand in a head; any other element, or text, ends it.
_IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
#: A start tag of the key ends an open element of the values, up to a container.
_ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    **dict.fromkeys("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split(), ("p",)),
}
#: The names that count as a block's ancestors, so that they are a bounded number.
KNOWN = frozenset(
    "html body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption form fieldset legend blockquote pre address figure "
    "figcaption details summary dialog menu hgroup hr center button xmp".split()
)
_LOWER = {c: c + 32 for c in range(65, 91)}
_CONTAINERS = frozenset("html body table ul ol dl div section article main aside nav header footer form".split())
#: A start tag at its place: its name, and its attributes as the standard tells them apart.
_TAG = re.compile(r"""<([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))?+)?+""")
_END_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_NONE = re.compile(r"display\s*+:\s*+none", re.I)
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
#: Decimal and hexadecimal references of more digits than any character has.
_TOO_LONG = re.compile(r"&#(?:0*+[0-9]{8,}+|[xX]0*+[0-9a-fA-F]{7,}+);?")
_NAMED_BY = frozenset(("class", "id", "role"))


@dataclass
class Block:
    text: str
    tags: frozenset[str]
    tag: str
    names: frozenset[str]
    link_chars: int = 0


class _Open:
    """The open elements, with where each name stands, so that no lookup walks down the stack."""

    def __init__(self) -> None:
        #: (tag, block-level tags down to here, the innermost of them, class names down to here, whether it hides its content)
        self.stack: list[tuple[str, frozenset[str], str, frozenset[str], bool]] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.containers: list[int] = []
        self.concealed = 0

    def last(self, tag: str) -> int:
        places = self.at.get(tag)
        return places[-1] if places else -1

    def push(self, tag: str, names: frozenset[str], hides: bool) -> None:
        _, tags, inner, above, _ = self.stack[-1] if self.stack else ("", frozenset(), "", frozenset(), False)
        place = len(self.stack)
        self.at.setdefault(tag, []).append(place)
        if tag not in INLINE:
            self.blocks.append(place)
            inner = tag
            if tag in KNOWN and tag not in tags:
                tags = tags | {tag}
        if tag in _CONTAINERS:
            self.containers.append(place)
        self.concealed += hides
        self.stack.append((tag, tags, inner, above if names <= above else above | names, hides))

    def close(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, _, _, _, hides = self.stack.pop()
            place = len(self.stack)
            self.at[tag].pop()
            self.concealed -= hides
            for places in (self.blocks, self.containers):
                if places and places[-1] == place:
                    places.pop()


def _attributes(text: str, known: frozenset[str] | None) -> tuple[frozenset[str], bool]:
    """The words of an element's class, id and role (of them those that are known), and whether it isn't shown."""
    names, hides, seen = set(), False, set()
    for m in _ATTRIBUTE.finditer(text):
        name = m[1].lower()
        if name in seen:  # of an attribute that stands twice, the first counts
            continue
        seen.add(name)
        value = m[2] or m[3] or m[4] or ""
        if name in _NAMED_BY:
            names.update(_NAME.findall(value.lower()))
        elif name == "hidden":
            hides = True
        elif name == "aria-hidden":
            hides |= value.strip().lower() == "true"
        elif name == "style":
            hides |= _NONE.search(value) is not None
    return frozenset(names if known is None else names & known), hides


def unescape(text: str) -> str:
    """Character references decoded."""
    return html.unescape(_TOO_LONG.sub("\ufffd", text)) if "&" in text else text


def blocks(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """The page's leaf blocks that hold text, in page order. known: the class names that count (None: all)."""
    out: list[Block] = []
    own, parts, link = _Open(), [], 0
    stack, find, size, at = own.stack, page.find, len(page), 0
    lower: str | None = None
    unended: set[str] = set()

    def flush() -> None:
        nonlocal link
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                _, tags, inner, names, _ = stack[-1] if stack else ("", frozenset(), "", frozenset(), False)
                out.append(Block(text, tags, inner, names, link))
            parts.clear()
        link = 0

    def add(text: str) -> None:
        nonlocal link
        if not own.concealed:
            parts.append(text)
            if own.at.get("a"):
                link += len(text)

    while at < size:
        lt = find("<", at)
        if lt != at:
            text = page[at:] if lt < 0 else page[at:lt]
            if stack and stack[-1][0] == "head" and text.strip():
                own.close(len(stack) - 1)
            add(text)
            if lt < 0:
                break
        following = page[lt + 1 : lt + 2]
        if following == "!" or following == "?":
            end = find("-->", lt + 2) if page.startswith("<!--", lt) and not page.startswith("<!-->", lt) else find(">", lt)
            at = size if end < 0 else end + (1 if page[end] == ">" else 3)
            continue
        if following == "/":
            m = _END_NAME.match(page, lt + 2)
            end = find(">", lt + 2)
            at = size if end < 0 else end + 1
            if not m or end < 0:
                continue
            tag = m[0].lower()
            depth = own.last(tag)
            if tag not in INLINE:
                flush()
            elif tag == "br":
                add(" ")
            if depth >= 0 and (tag not in INLINE or not own.blocks or own.blocks[-1] < depth):
                own.close(depth)
            continue
        m = _TAG.match(page, lt)
        if not m:
            if following.isascii() and following.isalpha():  # a tag without end: nothing after it is shown
                break
            if stack and stack[-1][0] == "head":
                own.close(len(stack) - 1)
            add("<")
            at = lt + 1
            continue
        at, tag, attributes = m.end(), m[1].lower(), m[2]
        if stack and stack[-1][0] == "head" and tag not in _IN_HEAD:
            own.close(len(stack) - 1)
        if tag == "br":
            add(" ")
            continue
        if tag in _SPACED:
            add(" ")
        if tag not in INLINE and not (tag in RAW and own.at.get("svg")):
            flush()
            if ends := _ENDS.get(tag):
                depth = max(map(own.last, ends))
                if depth >= 0 and (not own.containers or own.containers[-1] < depth):
                    own.close(depth)
        if tag in VOID or attributes.endswith("/") and tag not in RAW and tag not in SHOWN_RAW:
            continue
        if tag in RAW or tag in SHOWN_RAW:
            if lower is None:
                lower = page.lower()
                if len(lower) != size:  # some letter has a longer lower case
                    lower = page.translate(_LOWER)
            end = -1 if tag in unended else lower.find(f"</{tag}", at)
            if end < 0:
                unended.add(tag)
                if tag == "noscript":
                    continue
                end = size
            if tag in SHOWN_RAW and not _attributes(attributes, known)[1]:
                add(html.escape(page[at:end], quote=False))
                flush()
            end = find(">", end)
            at = size if end < 0 else end + 1
            continue
        names, hides = _attributes(attributes, known) if attributes else (frozenset(), False)
        own.push(tag, names, hides or tag in HIDDEN)
    flush()
    return out


def features(page: list[Block]) -> list[list[str]]:
    """The names of each block's features."""
    out = []
    n = len(page)
    for k, b in enumerate(page):
        words = b.text.count(" ") + 1
        links = b.link_chars / max(1, len(b.text))
        f = ["bias", f"tag={b.tag if b.tag in KNOWN else ''}", f"words={min(7, words.bit_length())}", f"links={0 if links < 0.05 else 1 if links < 0.5 else 2}"]
        f += [f"in={t}" for t in b.tags]
        f += [f"named={x}" for x in b.names]
        f.append(f"stops={min(3, sum(map(b.text.count, '.!?')))}")
        if b.text[:1] == "©" or b.text[-1:] not in ".!?\"'”»…)":
            f.append("open_end")
        f.append("first" if k == 0 else "last" if k == n - 1 else "middle")
        out.append(f)
    return out


def marginals(s: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From blocks' scores and pairs' weights: each block's label probabilities, and the expected counts of label pairs, by forward and backward sums."""
    n = len(s)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    forward[0] = s[0]
    for t in range(1, n):
        forward[t] = s[t] + np.logaddexp(forward[t - 1, 0] + pairs[0], forward[t - 1, 1] + pairs[1])
    for t in range(n - 2, -1, -1):
        x = backward[t + 1] + s[t + 1]
        backward[t] = np.logaddexp(pairs[:, 0] + x[0], pairs[:, 1] + x[1])
    total = np.logaddexp(*forward[-1])
    both = np.exp(forward[:-1, :, None] + pairs + (backward[1:] + s[1:])[:, None, :] - total).sum(axis=0)
    return np.exp(forward + backward - total), both


@dataclass
class Field:
    """The conditional random field; labels are 0 (other) and 1 (article)."""

    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def named(self) -> frozenset[str]:
        """The class names that the field has weights for."""
        return frozenset(x[6:] for x in self.index if x.startswith("named="))

    def scores(self, page: list[list[str]]) -> np.ndarray:
        index, w = self.index, self.weights
        return np.array([w[[i for i in map(index.get, f) if i is not None]].sum(axis=0) for f in page])

    def decode(self, page: list[list[str]]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        if not page:
            return []
        s = self.scores(page).tolist()
        (p00, p01), (p10, p11) = self.pairs.tolist()
        a, b = s[0]
        back = []
        for u, v in s[1:]:
            from0, from1 = (a + p00 >= b + p10), (a + p01 >= b + p11)
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = (a + p00 if from0 else b + p10) + u, (a + p01 if from1 else b + p11) + v
        label = int(b > a)
        labels = [label]
        for choice in reversed(back):
            label = choice[label]
            labels.append(label)
        return labels[::-1]

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-4) -> Field:
        """Stochastic gradient ascent (with per-weight rates) on the log likelihood, by forward and backward sums."""
        for f, _ in pages:
            for names in f:
                for name in names:
                    self.index.setdefault(name, len(self.index))
        self.weights = np.zeros((len(self.index), 2))
        seen_w, seen_p = np.full_like(self.weights, 1e-6), np.full_like(self.pairs, 1e-6)
        rows = [[np.array([self.index[x] for x in names]) for names in f] for f, _ in pages]
        order = np.random.default_rng(7)
        for _ in range(rounds):
            for k in order.permutation(len(pages)):
                labels, at = pages[k][1], rows[k]
                n = len(labels)
                if not n:
                    continue
                s = np.array([self.weights[i].sum(axis=0) for i in at])
                p, both = marginals(s, self.pairs)
                gold = np.eye(2)[labels]
                for t in range(n):
                    g = gold[t] - p[t] - decay * self.weights[at[t]]
                    seen_w[at[t]] += g**2
                    self.weights[at[t]] += rate * g / np.sqrt(seen_w[at[t]])
                if n > 1:
                    real = np.zeros((2, 2))
                    np.add.at(real, (labels[:-1], labels[1:]), 1)
                    g = real - both
                    seen_p += g**2
                    self.pairs += rate * g / np.sqrt(seen_p)
        return self


#: Private characters that mark a labelled page's texts, before its blocks are read.
_MARKS = ""


def labelled_pages(count: int = 240, seed: int = 11) -> Iterator[tuple[list[Block], list[int]]]:
    """Pages in the usual layouts, with the label of each block."""
    r = random.Random(seed)
    syllables = ["ta", "re", "ing", "mo", "le", "du", "sch", "an", "ver", "ción", "eau", "th", "on", "el", "que", "st"]

    def word() -> str:
        return "".join(r.choices(syllables, k=r.randint(1, 4)))

    def sentences(n: int) -> str:
        return " ".join(" ".join(word() for _ in range(r.randint(1, 16))).capitalize() + "." for _ in range(n))

    def no(text: str) -> str:
        return _MARKS[0] + text

    def yes(text: str) -> str:
        return _MARKS[1] + text

    def listed(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{no(word())}</a></li>' for _ in range(n)) + "</ul>"

    def boilerplate() -> str:
        kind = r.choice(["ad", "ads", "advert", "banner", "sponsored", "promo", "cookie", "cookie-notice", "consent", "newsletter", "share", "social", "related", "breadcrumb", "sidebar", "widget", "notice", "popup"])
        inner = r.choice([no(sentences(r.randint(1, 3))), f"<p>{no(sentences(r.randint(1, 4)))}</p>", f"<h3>{no(word())}</h3>{listed(r.randint(2, 5))}"])
        return r.choice([f'<div class="{kind}">{inner}</div>', f'<aside class="{kind}">{inner}</aside>', f'<section id="{kind}">{inner}</section>', f'<div role="complementary" class="{kind}">{inner}</div>'])

    def comments() -> str:
        one = "".join(f'<{t} class="comment"><b>{no(word())}</b><p>{no(sentences(r.randint(1, 4)))}</p></{t}>' for t in r.choices(["div", "li", "article"], k=r.randint(1, 4)))
        return r.choice([f'<section class="comments"><h2>{no(word())}</h2>{one}</section>', f'<div id="comments">{one}</div>', f'<ol class="comment-list">{one}</ol>'])

    def form() -> str:
        if r.random() < 0.3:
            return f"<button>{no(word())}</button>"
        return f'<form action="/s"><label>{no(word())}</label><input name="q"><p>{no(sentences(1))}</p></form>'

    for _ in range(count):
        nav = r.choice([f"<nav>{listed(r.randint(3, 8))}</nav>", f'<div class="menu">{listed(r.randint(3, 8))}</div>', f'<header>{no(word())}<nav>{listed(4)}</nav></header>', f'<header class="site-header"><h1>{no(word())}</h1></header>'])
        body = [f"<h1>{yes(' '.join(word() for _ in range(r.randint(1, 12))))}</h1>"]
        for _ in range(r.randint(1, 12)):
            n = r.choice([1, 1, 2, 4, 8])
            body.append(r.choice([f"<p>{yes(sentences(n))}</p>"] * 6 + [f"<p><b>{yes(sentences(n))}<br>", f"<h2>{yes(word())}</h2>", f"<blockquote><p>{yes(sentences(n))}</p></blockquote>", f"<ul><li>{yes(sentences(1))}</li><li>{yes(word())}</li></ul>", f"<p>{yes(sentences(1))} <a href='#'>{word()}</a> {sentences(1)}</p>", f"<div>{yes(sentences(n))}</div>", f"<pre>{yes(sentences(n))}</pre>", f"<table><tr><td>{yes(word())}</td><td>{yes(word())}</td></tr></table>", boilerplate(), f"<p>{yes(' '.join(word() for _ in range(r.randint(1, 9))))}</p>"]))
        inner = "".join(body) + r.choice(["", "", "", form(), comments()])
        main = r.choice([f"<article>{inner}</article>"] * 6 + [f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", f'<div class="content">{inner}</div>', f'<div id="article-body">{inner}</div>', f'<div class="post entry">{inner}</div>', f'<section class="story">{inner}</section>'])
        foot = r.choice([f"<footer>{no('&copy; ' + word() + ' &middot; ' + sentences(1))}</footer>"] * 3 + [f'<div class="footer"><p>{no(sentences(1))}</p></div>', f"<footer><p>{no(sentences(2))}</p>{listed(3)}</footer>", ""])
        page = f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style></head><body>" + nav + "".join(boilerplate() for _ in range(r.randint(0, 2))) + main + "".join(r.choice([boilerplate, comments, form])() for _ in range(r.randint(0, 2))) + foot + "</body></html>"
        found = blocks(page[: r.randint(len(page) // 2, len(page))] if r.random() < 0.15 else page)
        labels = [int(_MARKS[1] in b.text) for b in found]
        for b in found:
            b.text = b.text.replace(_MARKS[0], "").replace(_MARKS[1], "").strip()
        yield found, labels


def train(pages: int = 240, seed: int = 11) -> Field:
    return Field().fit([(features(f), labels) for f, labels in labelled_pages(pages, seed)])


def main_text(page: str, model: Field) -> str:
    found = blocks(page, model.named())
    return "\n\n".join(b.text for b, label in zip(found, model.decode(features(found)), strict=True) if label)


def extract(pages: DataFrame, model: Field, html_col: str = "html", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns in keep, and text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # the names in the layouts above, whatever the input

    def extractor() -> Transform:
        m = shared.value

        def texts(values: pa.Array) -> list[pa.Array]:
            found = [main_text(p, m) for p in text_list(values)]
            return [pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())]

        return texts

    return with_columns(pages, F.col(f"`{html_col}`"), keep or {}, "text string, n_chars bigint", extractor)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), train(), "html", {"page_id": F.col("page_id"), "url": F.col("url")})
