"""Operator 4: main text of web pages, by flat text blocks and a decision tree.

A page is cut into flat blocks, one for each run of text between block-level tags. Each block is described by its word count
and link density, those of the block before and the one after, what kind of element it is, and what enclosing elements say by
their tags and, more weakly, by words in their class, id and role. What an element says is not believed if it holds more than
half of the page's words: a form or a "has-sidebar" round everything tells nothing. A decision tree, grown on a small table of
labelled blocks that this module lays out, tells article blocks from the rest.

Pages are read once from left to right in time proportional to their length, whatever they hold.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noframes", "noembed", "xmp")}
VOID = {"area", "base", "br", "col", "embed", "frame", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "label", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
SPACE = {"br", "img", "wbr", "input"}
#: Elements that say by their tag that they stand beside an article; a header counts outside articles alone.
AWAY = {"nav", "footer", "aside", "form", "header", "menu", "button", "dialog", "fieldset", "label", "legend", "head", "select", "datalist", "textarea"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
PARAGRAPH = {"p", "blockquote", "pre", "figcaption", "dd"}
ITEM = {"li", "td", "th", "dt", "option"}
#: Tags that open elements of which another of the same group closes the last.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in class, id or role: of what stands beside an article; such as mean many things; of the article itself.
CLEAR = re.compile(r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adbox|banner|sponsor\w*|cookies?|consent|gdpr|popup|modal|overlay|comments?|replies|respond|disqus|sidebar|related|recommend\w*|newsletter|subscribe|signup|login|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|footer|contentinfo|complementary|search|copyright|notice|alert)(?=$|[\s_-])", re.I)
VAGUE = re.compile(r"(?:^|[\s_-])(?:promo\w*|side|widget\w*|share|sharing|social|foot|header|masthead|topbar|toolbar|legal|skip\w*|tags?|meta|byline|hidden|notices|alerts|links?|more|extra)(?=$|[\s_-])", re.I)
GOOD = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|main|content|body|text)(?=$|[\s_-])", re.I)
NAME, GAP, ATTRIBUTE, VALUE, PLAIN = re.compile(r"[a-zA-Z][^\s/>]*"), re.compile(r"[\s/]*"), re.compile(r"=?[^\s=/>]*"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
SPACES = re.compile(r"\s+")

#: What a block is described by, in this order. ``tag`` and ``name``: what an enclosing element that holds the smaller part of the page's
#: words says by its tag (1), or by its names (1 vague, 2 clear). ``place``: 1 in an article or main element, -1 if the page has one
#: elsewhere, else 0.
FIELDS = ("words", "links", "before_words", "before_links", "after_words", "after_links", "paragraph", "item", "heading", "tag", "name", "place")


def attributes(page: str, at: int) -> tuple[int, dict[str, str], bool]:
    """From the end of a tag's name: where the tag ends, its attributes (of a name the first), and whether it closes itself.
    The end is -1 where the page ends first. Every character is looked at a fixed number of times."""
    found: dict[str, str] = {}
    n = len(page)
    while True:
        gap = GAP.match(page, at)
        at = gap.end()
        if at >= n:
            return -1, found, False
        if page[at] == ">":
            return at + 1, found, page[at - 1] == "/"
        m = ATTRIBUTE.match(page, at)
        name, at, value = m[0].lower(), m.end(), ""
        m = VALUE.match(page, at)
        if m:
            at = m.end()
            if at < n and page[at] in "\"'":
                end = page.find(page[at], at + 1)
                if end < 0:
                    return -1, found, False
                value, at = page[at + 1 : end], end + 1
            else:
                m = PLAIN.match(page, at)
                value, at = m[0], m.end()
        if name in ("class", "id", "role", "hidden", "style", "aria-hidden"):
            found.setdefault(name, value)


def marks(tag: str, said: dict[str, str], inside: bool) -> tuple[int, int]:
    """Whether an element's tag says that it stands beside the article; what its names say. Names of the article itself outweigh the others."""
    away = int(tag in AWAY and not (tag == "header" and inside))
    if "hidden" in said or said.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", said.get("style", ""), re.I):
        away = 1
    names = " ".join(said[k] for k in ("class", "id", "role") if k in said)
    if not names or tag in ("html", "body", "article", "main") or GOOD.search(names):
        return away, 0
    return away, 2 if CLEAR.search(names) else int(bool(VAGUE.search(names)))


class Page:
    """The flat blocks of a page, and the elements that say something about what they enclose."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.texts: list[str] = []
        self.rows: list[list] = []  # words, linked words, tag, place, and the numbers of the elements that say something
        self.said: list[tuple[int, int]] = []  # tag, name
        self.held: list[int] = []  # words in each such element
        self.frames: list[tuple] = [("", {}, (), 0)]  # block elements: tag, inline elements open in it, marks, place
        self.inline: list[str] = []
        self.parts: list[str] = []
        self.linked, self.link = 0, -1  # words in links; how many frames were open where the open link began
        self.parse()
        self.flush()

    def flush(self) -> None:
        if self.parts:
            text = SPACES.sub(" ", html.unescape("".join(self.parts))).strip()
            if text:
                n = text.count(" ") + 1
                tag, _, said, place = self.frames[-1]
                self.texts.append(text)
                self.rows.append([n, min(n, self.linked), tag, place, said])
                for k in said:
                    self.held[k] += n
            self.parts.clear()
        self.linked = 0

    def take(self, text: str) -> None:
        if text:
            self.parts.append(text)
            if self.link >= 0:
                self.linked += len(text.split())

    def close(self) -> None:
        """The innermost block element ends, and what inline elements are open in it."""
        inside = sum(self.frames.pop()[1].values())
        if inside:
            del self.inline[-inside:]
        if self.link > len(self.frames):
            self.link = -1

    def parse(self) -> None:
        page, at, n = self.page, 0, len(self.page)
        opened: Counter = Counter()  # block elements
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                self.take(page[at:])
                return
            self.take(page[at:lt])
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            if page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt)
                self.take(html.escape(page[lt + 9 : n if end < 0 else end]))
                at = n if end < 0 else end + 3
                continue
            if page[lt + 1 : lt + 2] in ("!", "?"):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            ends = page[lt + 1 : lt + 2] == "/"
            m = NAME.match(page, lt + 1 + ends)
            if not m:
                self.take("<")
                at = lt + 1
                continue
            tag = m[0].lower()
            at, said, void = attributes(page, m.end())
            if at < 0:
                return  # the page ends inside a tag
            if ends:
                self.end(tag, opened)
            else:
                if tag in RAW:
                    if not void:
                        end = RAW[tag].search(page, at)
                        at = attributes(page, end.end())[0] if end else n
                        if at < 0:
                            return
                    continue
                self.start(tag, said, void, opened)

    def end(self, tag: str, opened: Counter) -> None:
        if tag == "a":
            self.link = -1
        if tag in BLOCK:
            self.flush()
            if opened[tag]:
                while True:
                    top = self.frames[-1][0]
                    opened[top] -= 1
                    self.close()
                    if top == tag:
                        return
        elif self.frames[-1][1].get(tag):  # an inline element's end closes nothing beyond its block
            while True:
                top = self.inline.pop()
                self.frames[-1][1][top] -= 1
                if top == tag:
                    return

    def start(self, tag: str, said: dict[str, str], void: bool, opened: Counter) -> None:
        if tag in SPACE:
            self.parts.append(" ")
        if tag not in BLOCK:
            if tag in VOID or void:
                return
            inline = self.frames[-1][1]
            inline[tag] = inline.get(tag, 0) + 1
            self.inline.append(tag)
            if tag == "a":
                self.link = len(self.frames)
            return
        self.flush()
        if tag in VOID:
            return
        group = CLOSES.get(tag, ())
        top = self.frames[-1][0]
        # a paragraph ends where another block begins; so does a list of choices where anything but a choice does
        while top == "p" or top in group or top in ("option", "optgroup", "select") and tag not in ("option", "optgroup"):
            opened[top] -= 1
            self.close()
            top = self.frames[-1][0]
        _, _, marks_, place = self.frames[-1]
        place |= tag in ("article", "main") or said.get("role", "").lower() in ("article", "main")
        say = marks(tag, said, bool(place))
        if any(say):
            self.said.append(say)
            self.held.append(0)
            marks_ = (*marks_, len(self.said) - 1) if len(marks_) < 16 else (*marks_[1:], len(self.said) - 1)
        opened[tag] += 1
        self.frames.append((tag, {}, marks_, place))

    def described(self) -> list[tuple]:
        """A tuple of ``FIELDS`` for each block."""
        total, main = sum(r[0] for r in self.rows), any(r[3] for r in self.rows)
        believed = [2 * h <= total for h in self.held]
        beside = [(n, linked / n) for n, linked, *_ in self.rows]
        out = []
        for i, (n, linked, tag, place, said) in enumerate(self.rows):
            b, a = beside[i - 1] if i else (0, 0.0), beside[i + 1] if i + 1 < len(beside) else (0, 0.0)
            told = [self.said[k] for k in said if believed[k]]
            out.append((n, linked / n, *b, *a, int(tag in PARAGRAPH), int(tag in ITEM), int(tag in HEADING), max([x for x, _ in told], default=0), max([y for _, y in told], default=0), 1 if place else -1 if main else 0))
        return out


def sentence(r: random.Random, n: int) -> str:
    return " ".join("w" * r.randint(2, 9) for _ in range(n))


def labelled_pages() -> list[tuple[str, list[int]]]:
    """Small pages laid out by hand in the ways that sites are, word counts drawn, and 1 for each block of theirs that is article text."""
    r = random.Random(8)
    out = []
    for k in range(600):
        parts: list[tuple[str, list[int]]] = []
        para = "div" if k % 7 == 5 else "p"  # sites that write paragraphs as plain divisions
        p = lambda n, extra="": f"<{para}>{sentence(r, n)}{extra}</{para}>"
        links = lambda n: "<ul>" + "".join(f"<li><a href=x>{sentence(r, r.choice([1, 1, 2, 3, 4, 9, 18]))}</a></li>" for _ in range(n)) + "</ul>"
        some = lambda low, high: r.randint(low, high)
        n = some(3, 7)
        bare = k % 9 in (0, 4)  # nothing but the article
        if not bare and k % 11:
            parts.append((f"<nav>{links(n)}</nav>" if k % 3 else f"<div class=menu>{links(n)}</div>" if k % 2 else f"<div>{links(n)}</div>", [0] * n))
        if k % 13 == 6 and not bare:
            parts.append((f"<{r.choice(['nav', 'div', 'header'])}><p><a href=x>{sentence(r, some(1, 5))}</a> <a href=y>{sentence(r, some(1, 5))}</a></p></nav></div></header>", [0]))
        if k % 4 == 1 and not bare:
            parts.append((f"<header><div>{sentence(r, some(1, 8))}</div></header>", [0]))
        if k % 5 == 2 and not bare:
            parts.append((f"<div class=cookie-notice>{sentence(r, some(8, 40))} <a href=x>ok</a></div>", [0]))
        if k % 4 == 2 and not bare:
            parts.append((f"<div class=ad>{sentence(r, some(5, 14))}</div>", [0]))
        if k % 7 == 3 and k % 4 < 2 and not bare:
            parts.append((f"<div>{sentence(r, some(1, 4))}</div>", [0]))
        body: list[tuple[str, int]] = [(f"<h1>{sentence(r, some(2, 12))}</h1>", 1)] if k % 3 else [(p(some(30, 140)), 1)]
        for _ in range(some(0, 7)):
            kind = r.random()
            if kind < 0.62:
                body.append((p(r.choice([1, 2, 4, 8, 15, 25, 40, 60, 90, 140]), f" <a href=x>{sentence(r, 2)}</a>" * (r.random() < 0.3)), 1))
            elif kind < 0.7:
                body.append((f"<h2>{sentence(r, some(1, 6))}</h2>", 1))
            elif kind < 0.78:
                item = sentence(r, some(2, 20))
                body.append((f"<li>{item}</li>" if kind < 0.75 else f"<li><a href=x>{item}</a></li>", 1))
            elif kind < 0.84:
                body.append((f"<blockquote>{sentence(r, some(5, 40))}</blockquote>", 1))
            elif kind < 0.9:
                body.append((f"<div class={r.choice(['tags', 'promo', 'share-box', 'meta'])}>{p(some(25, 80))}</div>", 1))
            else:
                body.append((f"<div class={r.choice(['tags', 'share', 'social'])}><a href=x>{sentence(r, some(1, 3))}</a></div>", 0))
        body.append((p(some(30, 80)), 1))
        if k % 3 == 2:
            body.append((p(some(1, 12)), 1))
        if k % 6 == 4:
            body.append((f"<div class=comments>{p(some(5, 60))}</div>", 0))
        if k % 6 == 5:
            body.append((f"<div class=related><a href=x>{sentence(r, some(3, 25))}</a></div>", 0))
        text, labels = "".join(b for b, _ in body), [x for _, x in body]
        kind = k % 4
        wrap = f"<article>{text}</article>" if kind < 2 else f"<div class={r.choice(['post', 'content', 'entry-text', 'x1'])}>{text}</div>" if kind == 2 else text
        parts.append((wrap, labels))
        if k % 3 == 1 and not bare:
            if k % 2:
                parts.append((f"<aside><p><a href=x>{sentence(r, some(3, 30))}</a></p></aside>", [0]))
            m = some(1, 3)
            parts.append((f"<aside>{''.join(p(some(4, 30)) for _ in range(m))}</aside>" if k % 2 else f"<div class=sidebar>{''.join(p(some(4, 30)) for _ in range(m))}</div>", [0] * m))
        if k % 5 == 3 and not bare:
            m = some(1, 4)
            parts.append((f"<section id=comments>{''.join(p(some(3, 50)) for _ in range(m))}</section>", [0] * m))
        if k % 8 == 6 and not bare:
            parts.append((f"<form><label>{sentence(r, 3)}</label><p>{sentence(r, some(4, 20))}</p></form>", [0, 0]))
        if not bare and k % 5:
            parts.append((f"<footer><p>{sentence(r, some(1, 12))} <a href=x>{sentence(r, some(1, 9))}</a></p></footer>" if k % 4 == 0 else f"<footer>{sentence(r, some(3, 25))}</footer>" if k % 3 else f"<div>{sentence(r, some(2, 5))} <a href=x>{sentence(r, some(3, 6))}</a></div>", [0]))
        out.append(("<html><body>" + "".join(t for t, _ in parts) + "</body></html>", [x for _, ls in parts for x in ls]))
    return out


def labelled_table() -> list[tuple]:
    """The labelled blocks: ``FIELDS``, then the label."""
    rows = []
    for page, labels in labelled_pages():
        got = Page(page).described()
        if len(got) != len(labels):
            raise ValueError("a page and its labels differ")
        rows += [(*x, y) for x, y in zip(got, labels)]
    return rows


def grow(rows: np.ndarray, depth: int = 9, least: int = 8):
    """A tree (field, at most, low, high), or a leaf's share of article blocks, by Gini impurity."""
    n, ones = len(rows), rows[:, -1].sum()
    if depth == 0 or ones in (0, n):
        return float(ones / n)
    best = (2 * ones * (n - ones) / n - 1e-9, None)
    for f in range(len(FIELDS)):
        order = rows[rows[:, f].argsort(kind="stable")]
        x, y = order[:, f], order[:, -1].cumsum()[:-1]
        at = np.flatnonzero((x[1:] > x[:-1]))
        at = at[(at + 1 >= least) & (n - at - 1 >= least)]
        if len(at):
            nl, ol = at + 1, y[at]
            nr, hr = n - nl, ones - ol
            cost = 2 * ol * (nl - ol) / nl + 2 * hr * (nr - hr) / nr
            j = int(cost.argmin())
            if cost[j] < best[0]:
                best = (float(cost[j]), (f, float(x[at[j]] + x[at[j] + 1]) / 2))
    if best[1] is None:
        return float(ones / n)
    f, cut = best[1]
    low = rows[:, f] <= cut
    return f, cut, grow(rows[low], depth - 1, least), grow(rows[~low], depth - 1, least)


@cache
def tree():
    return grow(np.array(labelled_table(), float))


def is_article(block: tuple, node=None) -> bool:
    node = tree() if node is None else node
    while isinstance(node, tuple):
        f, cut, low, high = node
        node = low if block[f] <= cut else high
    return node >= 0.5


def main_text(page: str | None, node=None) -> str:
    """The article's blocks, joined by one newline; empty for null, empty and blank pages."""
    got = Page(page or "")
    return "\n".join(text for text, block in zip(got.texts, got.described()) if is_article(block, node))


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page: (page_id, url, text, n_chars).

    A null page is an empty one and has an empty text; null ids and urls stay; repeated rows are extracted each; other columns
    are not looked at. Pages are not shuffled.
    """

    grown = tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(x.as_py(), grown) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as bigint) page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
