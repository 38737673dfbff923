"""The main text of web pages as a maximum-scoring subsequence of words and tags.

Method. A page is read as a sequence of words and tags. Weights are learned from labelled pages (``labelled_pages``, or the caller's own):
log odds of main text against the rest for tag names, words of class, id and role, length of a block and share of its words in
links. Words of likely text score positive, words of likely boilerplate and all tags negative, tags the more the less likely their place
is main text. One linear scan finds the contiguous region of the greatest sum. Blocks of the region whose own words score positive are
the text; a block that stands in the midst of the article but under a decidedly foreign element (an advert, reader comments) goes.

Fixed rules come before the weights: scripts, styles, embedded and hidden things and form controls are never text, nor are menus, page
footers and side notes by their own tags. An element whose name sounds foreign but that holds most of the page's words and its
heading (``class="has-sidebar"`` around everything) is not taken by its name.

Text. Character references are decoded, white space inside a block becomes one blank, blocks are joined by a blank line in page order.
``<br>`` is white space. Nothing is capped.

Scale. One pass, nothing is shuffled; the model is a few hundred numbers.

Edge cases. Null or empty html, or a page without a region of positive sum: empty text. Html without any tag is one block. Unclosed
tags, comments and quotes end where the next tag of their kind forces it, or with the page. Repeated rows and null ids keep rows of their
own, ``url`` goes along, other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from quireflow.llm.common import texts
from quireflow.llm.labelled_pages import LABELLED, MARK

INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math nobr picture q rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup; it is skipped as a whole.
RAW = set("script style textarea title xmp iframe noembed noframes".split())
#: Tags that say by themselves what stands in them; other tags tell of their own block only.
SECTIONS = set("article main section header form fieldset figure address details".split())
NEVER = set("head script style template svg math canvas iframe object audio video select option button textarea noscript dialog map nav footer aside menu".split())
#: Opening one of the first closes an open element of the second, up to one of the third.
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "option": ("option", ("select",)),
    "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
}
#: Log odds below which a single element makes all in it foreign; bounds of one feature's log odds and of a place's sum; smoothing; price of a
#: tag nowhere near text.
FOREIGN, MOST, BOUND, SMOOTH, TAG_PRICE = -1.5, 4.0, 6.0, 0.1, 0.5
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_TAG_END = re.compile(r"""(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+>""")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


@lru_cache(4096)
def element_features(tag: str, attributes: str) -> tuple[frozenset[str], bool, bool]:
    """(features, hidden, marked as main text) of an element."""
    names, hidden, marked = set(), tag in NEVER, False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m.group(1).lower(), next((g for g in m.groups()[1:] if g is not None), "")
        if key in ("class", "id", "role") and tag not in ("html", "body"):
            names.update(w.lower() for w in _WORDS.findall(unescape(value)))
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            hidden = True
        elif key == MARK:
            marked = True
    return frozenset(names | {f"<{tag}>"} if tag in SECTIONS else names), hidden, marked


@dataclass
class Page:
    """Elements (their parents come before them), blocks of text pieces (element, text), and the order of blocks (>= 0) and tags (< 0)."""

    tags: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    attributes: list[str] = field(default_factory=lambda: [""])
    blocks: list[list[tuple[int, str]]] = field(default_factory=list)
    order: list[int] = field(default_factory=list)
    words: list[int] = field(default_factory=list)


def parse(html: str) -> Page:
    page, stack, open_block, at = Page(), [0], False, 0
    tags, parents, attributes, blocks, order = page.tags, page.parents, page.attributes, page.blocks, page.order

    def add_text(raw: str) -> None:
        nonlocal open_block
        if not open_block:
            if raw.isspace():
                return
            order.append(len(blocks))
            blocks.append([])
            open_block = True
        blocks[-1].append((stack[-1], unescape(raw)))

    while at < len(html):
        low = html.find("<", at)
        if low < 0:
            low = len(html)
        if low > at:
            add_text(html[at:low])
        if low == len(html):
            break
        ahead = html[low + 1 : low + 4]
        if ahead == "!--":
            end = html.find("-->", low + 2)
            at = len(html) if end < 0 else end + 3
            continue
        if ahead[:1] in ("!", "?"):
            end = html.find(">", low)
            at = len(html) if end < 0 else end + 1
            continue
        closing = ahead[:1] == "/"
        name = _NAME.match(html, low + 1 + closing)
        if not name:
            add_text("<")
            at = low + 1
            continue
        found = _TAG_END.match(html, name.end())
        at = found.end() if found else len(html)
        tag, rest = name.group().lower(), html[name.end() : at - 1 if found else at]
        if tag not in INLINE and tag not in RAW:
            open_block = False
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if tags[stack[i]] == tag:
                    del stack[i:]
                    break
            order.append(-1 - stack[-1])
            continue
        if tag == "br":
            if open_block:
                blocks[-1].append((stack[-1], " "))
            continue
        shut, within = CLOSES.get(tag, ("p" if tag not in INLINE and tag not in RAW else "", ("td", "th", "li", "div", "section", "article", "body")))
        for i in range(len(stack) - 1, 0, -1):
            if tags[stack[i]] in shut.split():
                del stack[i:]
                if tag not in ("td", "th", "tr"):
                    break
            elif i < len(stack) and tags[stack[i]] in within:
                break
        tags.append(tag)
        parents.append(stack[-1])
        attributes.append(rest)
        made = len(tags) - 1
        order.append(-1 - made)
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            if not end:
                break
            close = html.find(">", end.end())
            at = len(html) if close < 0 else close + 1
        elif tag not in VOID:
            stack.append(made)
    page.words = [0] * len(tags)
    for block in blocks:
        for element, text in block:
            page.words[element] += len(text.split())
    for i in range(len(tags) - 1, 0, -1):
        page.words[parents[i]] += page.words[i]
    return page


def block_features(page: Page, pieces: list[tuple[int, str]]) -> tuple[str, ...]:
    """Tag, length, share of words in links, and last sign of a block."""
    n = linked = 0
    own = pieces[0][0]
    while own > 0 and page.tags[own] in INLINE:
        own = page.parents[own]
    for element, text in pieces:
        words = len(text.split())
        n += words
        while element > 0 and page.tags[element] != "a" and page.tags[element] in INLINE:
            element = page.parents[element]
        linked += words * (page.tags[element] == "a")
    share = 4 * linked // n if n else 0
    return f"in <{page.tags[own] or 'body'}>", f"length {min(n, 80).bit_length()}", f"links {share}", "sentence" if pieces[-1][1].rstrip()[-1:] in tuple(".!?…。\"”»") else "no sentence"


class Model:
    """Log odds of main text for features, from pages whose main text stands in elements with the attribute ``MARK``."""

    def __init__(self, labelled: Iterable[str]):
        inside, outside, tags_in, tags_out = Counter(), Counter(), Counter(), Counter()
        for html in labelled:
            page = parse(html)
            marked = [False] * len(page.tags)
            named: list[frozenset[str]] = [frozenset()] * len(page.tags)
            for i in range(1, len(page.tags)):
                own, _, mark = element_features(page.tags[i], page.attributes[i])
                marked[i] = mark or marked[page.parents[i]]
                named[i] = named[page.parents[i]] | self.names(page, i, own)
            for item in page.order:
                if item >= 0:
                    element = page.blocks[item][0][0]
                    kind = inside if marked[element] else outside
                    kind.update({"", *named[element], *block_features(page, page.blocks[item])})
                else:
                    (tags_in if marked[-1 - item] else tags_out)[page.tags[-1 - item]] += 1
        whole = math.log((inside[""] + SMOOTH) / (outside[""] + SMOOTH))
        odds = {f: math.log((inside[f] + SMOOTH) / (outside[f] + SMOOTH)) - whole for f in inside.keys() | outside.keys() if f}
        self.odds = {f: min(max(o, -MOST), MOST) for f, o in odds.items()}
        self.price = {t: TAG_PRICE * (tags_out[t] + SMOOTH) / (tags_in[t] + tags_out[t] + 2 * SMOOTH) for t in tags_in.keys() | tags_out.keys()}

    @staticmethod
    def names(page: Page, element: int, own: frozenset[str]) -> frozenset[str]:
        """Features of an element; a header inside of an article is not the page's."""
        if page.tags[element] == "header":
            above = page.parents[element]
            while above > 0:
                if page.tags[above] in ("article", "main"):
                    return own - {"<header>"} | {"<inner header>"}
                above = page.parents[above]
        return own

    def places(self, page: Page) -> tuple[list[float], list[bool], list[float]]:
        """The log odds of each element as a place of main text, whether its words never count, and how much foreign
        words and tags weigh there: little inside of what is named as an article."""
        n, total = len(page.tags), page.words[0]
        holds = [False] * n
        for i in range(n - 1, 0, -1):
            holds[page.parents[i]] |= holds[i] or page.tags[i] in ("h1", "article", "main")
        good, bad, never = [0.0] * n, [0.0] * n, [False] * n
        for i in range(1, n):
            own, hidden, _ = element_features(page.tags[i], page.attributes[i])
            up = page.parents[i]
            odds = sum(self.odds.get(f, 0.0) for f in self.names(page, i, own))
            if odds < 0 and holds[i] and 2 * page.words[i] > total:
                odds = 0.0
            good[i], bad[i] = good[up] + max(odds, 0.0), min(bad[up], odds)
            never[i] = never[up] or hidden
        place = [max(b if b < FOREIGN else min(g, BOUND) + b, -BOUND) for g, b in zip(good, bad, strict=True)]
        return place, never, [1 - math.tanh(min(g, BOUND) / 2) for g in good]

    def extract(self, html: str) -> str:
        page = parse(html)
        place, never, weight = self.places(page)
        texts_of, scores, best, total, start, region = [], [], 0.0, 0.0, 0, (0, 0)
        for pieces in page.blocks:
            stays = [(e, t) for e, t in pieces if not never[e] and place[e] >= FOREIGN]
            text = " ".join("".join(t for _, t in stays).split())
            odds = -BOUND
            if text:  # the block stands where its outermost piece stands
                odds = place[min(e for e, t in stays if not t.isspace())] + sum(self.odds.get(f, 0.0) for f in block_features(page, stays))
            texts_of.append(text)
            score = math.tanh(odds / 2)
            scores.append(score if score > 0 else score * weight[pieces[0][0]])
        for i, item in enumerate(page.order):
            if item >= 0:
                words = texts_of[item].count(" ") + 1 if texts_of[item] else sum(len(t.split()) for _, t in page.blocks[item])
                total += words * scores[item]
            else:
                element = -1 - item
                total -= weight[element] * self.price.get(page.tags[element], TAG_PRICE / 2) / (1 + math.exp(place[element]))
            if total <= 0:
                total, start = 0.0, i + 1
            elif total > best:
                best, region = total, (start, i + 1)
        return "\n\n".join(texts_of[item] for item in page.order[slice(*region)] if item >= 0 and scores[item] > 0)


@lru_cache(1)
def own_model() -> Model:
    return Model(LABELLED)


def main_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", *, labelled: tuple[str, ...] | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars. ``labelled``: pages to learn from in place of those that come with the library."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(labelled) if labelled else own_model()
        for batch in batches:
            found = [model.extract(html) if html else "" for html in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("page_url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = texts(df, id_col, html_col, url_col).withColumnRenamed(url_col, "page_url")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
