"""Main text of HTML pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks, the runs of text between block-level tags. Each block has
features of its ancestors (tags, words of classes and ids) and of its text; the field labels
blocks as main text or not, with weights for features and for neighbouring labels, trained by
its likelihood on labelled pages and decoded by Viterbi. The labelled pages here are drawn from
layouts in the module, a fixed number with a fixed seed; other labelled pages can be given.

Scripts, styles, the head and comments in the markup are no blocks. Character references are decoded,
white space within a block is one blank, blocks are trimmed and joined in page order by two
line feeds. Broken markup is read as far as it goes: unclosed tags end with their parent, a
head ends at the first tag or text that cannot stand in it, and a tag whose quotes are never
closed at its next ">". Null pages have an empty text. Pages of any length are read whole, in
time that grows with their length. Equal rows stay, an empty table stays empty, and so do
extra columns.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of HTML: tags by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style noscript template iframe object svg math title textarea".split())
HIDDEN = RAW | {"head"}
CLOSES = {  # a start tag ends an open element of these
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
SCOPES = frozenset("ul ol dl table tbody thead select div article section main body".split())

# Fixed words of classes, ids and roles, by what they tell.
HINTS = {
    "menu": "nav navigation navbar menu menubar breadcrumb breadcrumbs toolbar tabs pager pagination skip",
    "side": "sidebar side aside widget widgets rail related recommended trending popular complementary tags",
    "advert": "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup paywall banner disclaimer privacy",
    "comment": "comment comments commentlist respond reply replies discussion disqus thread reader readers",
    "foot": "footer foot copyright legal colophon contentinfo bottom",
    "head": "header masthead topbar head top branding logo",
    "form": "form search login contact register",
    "share": "share sharing social follow byline author meta",
    "body": "article post content entry story main body text prose page",
}
HINT = {w: kind for kind, words in HINTS.items() for w in words.split()}

IN_HEAD = RAW | {"head", "meta", "link", "base", "basefont", "bgsound", "noframes"}
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
SPECIAL = re.compile("[>\"']")
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    tags: frozenset[str]  # of all ancestors
    own: str  # the nearest that is not inline
    hints: frozenset[str]
    linked: float
    label: str = ""


@dataclass(frozen=True)
class Open:
    """An open element with what it hands down: sets are shared with the parent where equal."""

    name: str
    tags: frozenset[str] = frozenset()
    own: str = "none"
    hints: frozenset[str] = frozenset()
    label: str = ""

    def child(self, name: str, attributes: str) -> Open:
        hints, label = _hints(attributes)
        return Open(
            name,
            self.tags if name in self.tags else self.tags | {name},
            self.own if name in INLINE else name,
            self.hints if hints <= self.hints else self.hints | hints,
            label or self.label,
        )


ROOT = Open("")


def _hints(attributes: str) -> tuple[frozenset[str], str]:
    """What the words of classes, ids and roles tell; and a label, which only training pages have."""
    if not attributes or "=" not in attributes:
        return frozenset(), ""
    words = (w.lower() for m in NAMED.findall(attributes) for w in WORD.findall(" ".join(m)))
    label = re.search(r'data-label="(\w+)"', attributes)
    return frozenset(HINT[w] for w in words if w in HINT), label[1] if label else ""


class Tags:
    """Where the tags of a page end, found by one pass from its end.

    A ``>`` in quotes does not end a tag, unless a quote is never closed.
    """

    def __init__(self, page: str):
        self.page, self.at = page, [m.start() for m in SPECIAL.finditer(page)]
        self.quoted = [-1] * (len(self.at) + 1)  # end of a tag that meets this mark outside quotes
        self.plain = [-1] * (len(self.at) + 1)  # next > of any kind
        later: dict[str, int] = {}
        for k in range(len(self.at) - 1, -1, -1):
            mark = page[self.at[k]]
            if mark == ">":
                self.quoted[k] = self.plain[k] = self.at[k]
            else:
                self.quoted[k] = self.quoted[later[mark] + 1] if mark in later else -1
                self.plain[k] = self.plain[k + 1]
                later[mark] = k

    def end(self, start: int, quotes: bool) -> int:
        """Place of the > that ends a tag read from ``start`` on, or -1."""
        k = bisect_left(self.at, start)
        found = self.quoted[k] if quotes else -1
        return found if found >= 0 else self.plain[k]


def tokens(page: str) -> Iterator[tuple[int, str, str, str, str]]:
    """``end, text, slash, name, attributes`` of each piece: text without a name, or a tag with one.

    Comments and declarations have neither. The reader may send the place to go on from.
    """
    tags, at = Tags(page), 0
    while at < len(page):
        if page[at] != "<":
            end = page.find("<", at)
            end = len(page) if end < 0 else end
            token = (end, page[at:end], "", "", "")
        elif page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            token = (len(page) if end < 0 else end + 3, "", "", "", "")
        elif (end := tags.end(at, False)) >= 0 and (m := NAME.match(page, at + 1)):
            end = tags.end(m.end(), True)
            token = (end + 1, "", m[1], m[2].lower(), page[m.end() : end])
        elif end >= 0 and page[at + 1 : at + 2] in ("!", "?", "/"):
            token = (end + 1, "", "", "", "")
        else:
            token = (at + 1, "<", "", "", "")
        to = yield token
        at = token[0] if to is None else to


def leaf_blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order, those without text left out."""
    page = page or ""
    stack: list[Open] = []
    opened: Counter[str] = Counter()
    blocks: list[Block] = []
    held: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                top = stack[-1] if stack else ROOT
                share = min(1.0, linked / len(text))
                blocks.append(Block(text, top.tags, top.own, top.hints, share, top.label))
            held.clear()
        linked = 0

    def close(names: set[str] | frozenset[str], scope: frozenset[str] = frozenset()) -> None:
        if not any(opened[n] for n in names):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].name in names:
                opened.subtract(x.name for x in stack[i:])
                del stack[i:]
                return
            if stack[i].name in scope:
                return

    read, to = tokens(page), None
    while True:
        try:
            at, text, ends, name, attributes = read.send(to)
        except StopIteration:
            break
        to = None
        if text:
            if stack and stack[-1].name == "head" and not text.isspace():
                close({"head"})
            if not any(x.name == "head" for x in stack[:2]):
                held.append(text)
                if any(x.name == "a" for x in stack[-4:]):
                    linked += len(text)
            continue
        if not name:
            continue
        if name in RAW and not ends:
            found = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            to = found.end() if found else len(page)
            flush()
            continue
        if not ends and name not in IN_HEAD:
            close({"head"})
        if name not in INLINE:
            flush()
        elif name in VOID:
            held.append(" ")
        if ends:
            close({name})
        else:
            if name in CLOSES:
                close(CLOSES[name], SCOPES)
            elif name not in INLINE:
                close({"p"}, SCOPES)
            if name not in VOID and not attributes.endswith("/"):
                stack.append((stack[-1] if stack else ROOT).child(name, attributes))
                opened[name] += 1
    flush()
    return blocks


def features(blocks: list[Block]) -> list[list[str]]:
    out = []
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        size = next(k for k, top in enumerate((2, 7, 15, 40, 1 << 60)) if words <= top)
        linked = "none" if not b.linked else "some" if b.linked < 0.5 else "most"
        place = "first" if i < 2 else "last" if i >= len(blocks) - 2 else "mid"
        found = [f"in:{t}" for t in b.tags] + [f"hint:{h}" for h in b.hints]
        if not b.hints:
            found.append("hint:none")
        stop = b.text[-1] in ".!?…:;\"'”»"
        found += ["one", f"own:{b.own}", f"size:{size}", f"linked:{linked}", f"stop:{stop}", f"place:{place}"]
        found += [f"own:{b.own}&size:{size}", f"size:{size}&linked:{linked}&stop:{stop}"]
        if "©" in b.text or "(c)" in b.text:
            found.append("sign:copyright")
        out.append(found)
    return out


@dataclass
class Field:
    """Weights for main text against the rest by feature; ``turn[a][b]`` for label b after a."""

    weights: dict[str, float] = field(default_factory=dict)
    turn: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))

    def decode(self, page: list[list[str]]) -> list[bool]:
        """Most likely labels of all blocks together (Viterbi)."""
        get, (rest, main) = self.weights.get, self.turn
        back, off, on = [], 0.0, 0.0
        for i, block in enumerate(page):
            score = sum(get(f, 0.0) for f in block)
            if i:
                from_off = (off + rest[0] >= on + main[0], off + rest[1] >= on + main[1])
                back.append(from_off)
                off, on = (
                    off + rest[0] if from_off[0] else on + main[0],
                    off + rest[1] if from_off[1] else on + main[1],
                )
            on += score
        labels = [on > off] if page else []
        for from_off in reversed(back):
            labels.append(not from_off[labels[-1]])
        return labels[::-1]


def train(
    pages: Iterable[tuple[list[list[str]], list[bool]]], steps: int = 150, penalty: float = 1e-3
) -> Field:
    """Field of greatest penalised likelihood, by forward-backward sums over all pages at once."""
    pages = [p for p in pages if p[0]]
    names = sorted({f for blocks, _ in pages for b in blocks for f in b})
    place = {f: i for i, f in enumerate(names)}
    longest = max(len(blocks) for blocks, _ in pages)
    given = np.zeros((len(pages), longest, len(names)), np.float32)
    truth, real = np.zeros((len(pages), longest), int), np.zeros((len(pages), longest), bool)
    for i, (blocks, labels) in enumerate(pages):
        truth[i, : len(labels)], real[i, : len(labels)] = labels, True
        for j, block in enumerate(blocks):
            given[i, j, [place[f] for f in block]] = 1
    weights, turn = np.zeros(len(names)), np.zeros((2, 2))
    seen_turn = np.zeros((2, 2))
    pairs = real[:, 1:]
    np.add.at(seen_turn, (truth[:, :-1][pairs], truth[:, 1:][pairs]), 1)
    moments = [[np.zeros_like(weights), np.zeros_like(weights)], [np.zeros_like(turn), np.zeros_like(turn)]]
    for step in range(1, steps + 1):
        score = np.zeros((len(pages), longest, 2))
        score[..., 1] = given @ weights
        ahead, behind = score.copy(), np.zeros_like(score)
        for j in range(1, longest):
            new = np.logaddexp.reduce(ahead[:, j - 1, :, None] + turn, axis=1) + score[:, j]
            ahead[:, j] = np.where(real[:, j, None], new, ahead[:, j - 1])
        for j in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(turn + (score[:, j + 1] + behind[:, j + 1])[:, None], axis=2)
            behind[:, j] = np.where(real[:, j + 1, None], new, 0.0)
        whole = np.logaddexp.reduce(ahead[:, -1], axis=1)
        share = np.exp(ahead + behind - whole[:, None, None])
        both = ahead[:, :-1, :, None] + turn + (score + behind)[:, 1:, None, :] - whole[:, None, None, None]
        expected = (np.exp(both) * pairs[..., None, None]).sum(axis=(0, 1))
        wrong = (truth - share[..., 1]) * real
        grads = (
            np.tensordot(wrong, given, 2) / len(pages) - penalty * weights,
            (seen_turn - expected) / len(pages) - penalty * turn,
        )
        for value, grad, (m, v) in zip((weights, turn), grads, moments, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            value += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(dict(zip(names, weights.tolist(), strict=True)), tuple(map(tuple, turn.tolist())))


MAIN, REST = "main", "rest"


def labelled_page(rng: random.Random) -> str:
    """A page of some layout; each part says in ``data-label`` what its blocks are."""

    def words(low: int, high: int) -> str:
        made = ("".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high)))
        return " ".join(made).capitalize()

    def prose(low: int = 1, high: int = 70) -> str:
        return words(low, high) + rng.choice((".", ".", ".", "?", "!", ""))

    def named(tag: str, label: str, body: str, *names: str) -> str:
        name = rng.choice(names) if names else ""
        how = f' {rng.choice(("class", "id"))}="{name}"' if name else ""
        return f'<{tag}{how} data-label="{label}">{body}</{tag}>'

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(n)) + "</ul>"

    def paragraphs(n: int) -> str:
        close = rng.choice(("</p>", "</p>", ""))
        each = (
            f"<blockquote>{prose(3, 20)}</blockquote>"
            if (kind := rng.random()) < 0.06
            else f"<ul><li>{prose(2, 12)}</li><li>{prose(2, 12)}</li></ul>"
            if kind < 0.12
            else f"<h2>{words(1, 6)}</h2>"
            if kind < 0.2
            else f"<p>{prose()} <a href='/x'>{words(1, 2)}</a> {prose(1, 9)}{close}"
            if kind < 0.3
            else f"<p><b>{prose(3, 30)}<br>{close}"
            if kind < 0.4
            else f"<p>{prose()}{close}"
            for _ in range(n)
        )
        return "".join(each)

    menu = lambda: rng.choice((named("nav", REST, links(rng.randint(2, 7))), named("div", REST, links(4), "menu", "navbar", "breadcrumbs")))
    advert = lambda: named(rng.choice(("div", "aside", "p", "section")), REST, rng.choice((prose(2, 25), f"<p>{prose(2, 25)}</p>")), "ad", "ads", "advert", "sponsored", "promo")
    notice = lambda: named(rng.choice(("div", "section", "p")), REST, f"{prose(4, 25)} <button>{words(1, 2)}</button>", "cookie-notice", "consent", "alert", "newsletter", "paywall")
    form = lambda: named("form", REST, f"<label>{words(1, 3)}</label><input><select><option>{words(1, 1)}<option>{words(1, 1)}</select><button>{words(1, 2)}</button><p>{prose(2, 12)}</p>", "", "search", "contact")
    side = lambda: named(rng.choice(("aside", "div")), REST, f"<h3>{words(1, 3)}</h3>" + rng.choice((links(4), f"<p>{prose(2, 30)}</p>")), "sidebar", "related", "widget")
    said = lambda: named(rng.choice(("section", "div", "ol")), REST, f"<h3>{words(1, 2)}</h3>" + "".join(f'<div class="comment"><p>{prose(2, 50)}</p></div>' for _ in range(rng.randint(1, 4))), "comments", "comment-list", "discussion")
    head = lambda: named(rng.choice(("header", "div")), REST, f"<h2>{words(1, 3)}</h2><p>{prose(1, 8)}</p>", "header", "masthead")
    foot = lambda: named(rng.choice(("footer", "footer", "div")), REST, rng.choice((f"&copy; {words(1, 2)} &middot; {prose(2, 15)}", f"<p>{prose(2, 15)}</p>{links(2)}")), "footer")
    inner = paragraphs(rng.randint(1, 12))
    for part in (advert, side, notice, form):
        if rng.random() < 0.12:
            inner += part() + paragraphs(rng.randint(1, 4))
    title = rng.choice((f"<h1>{words(1, 10)}</h1>", f"<h1>{words(1, 10)}</h1>", ""))
    tag, names = rng.choice((("article", ("", "post")), ("article", ("",)), ("main", ("",)), ("div", ("content", "post-body", "story", "entry", "article-text")), ("section", ("content", ""))))
    late = said() if rng.random() < 0.15 else ""
    body = named(tag, MAIN, title + inner + late, *names)
    before = [p() for p in (menu, advert, head, notice, form, side) if rng.random() < 0.4]
    after = [p() for p in (said, side, advert, form, notice, menu) if rng.random() < 0.35]
    rng.shuffle(before)
    rng.shuffle(after)
    parts = [*before, body, *after, *([foot()] if rng.random() < 0.85 else [])]
    close = rng.choice(("</body></html>", ""))
    return f"<html><head><title>{words(1, 6)}</title><style>p{{}}</style></head><body>{''.join(parts)}{close}"


def labelled_pages(n: int = 600, seed: int = 2) -> Iterator[tuple[list[list[str]], list[bool]]]:
    rng = random.Random(seed)
    for _ in range(n):
        blocks = leaf_blocks(labelled_page(rng))
        yield features(blocks), [b.label == MAIN for b in blocks]


def main_text(page: str | None, model: Field) -> str:
    blocks = leaf_blocks(page)
    kept = model.decode(features(blocks))
    return "\n\n".join(b.text for b, is_main in zip(blocks, kept, strict=True) if is_main)


def extract(pages: DataFrame, model: Field, html_col: str = "html", text: str = "text") -> DataFrame:
    """All columns but the markup, and the main text."""

    @F.pandas_udf(T.StringType())
    def of(series: pd.Series) -> pd.Series:
        return pd.Series([main_text(p if isinstance(p, str) else None, model) for p in series], dtype=str)

    keep = [c for c in pages.columns if c not in (html_col, text)]
    return pages.select(*keep, of(F.col(html_col)).alias(text))


