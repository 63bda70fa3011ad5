"""Main text of HTML pages by text-to-tag ratios.

Events of the standard library's parser cut a page into lines, one per block element, and note the container that each is in.
A line's ratio is its text length over its tags. Text that a page presents as no part of its article (forms, adverts, comments,
...) counts as markup, so such a line has the ratio 0, and of the text of links only a tenth counts. The logarithms of the ratios are smoothed by a
Gaussian over the page's lines, where containers side by side blur less than what is nested, and two clusters split them at
a threshold. The lines of the upper cluster are content.

The lines also choose the region by what they lie above or below the threshold: the container with the greatest sum. Content
lines of the region are the article, with the lists, tables and nested parts that follow on from them. Article and main
elements only help: their names are never read as adverts or menus, a container around one is no menu, and an article next to
the chosen one belongs to it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that start a block, that never hold article text, and that have no end tag.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead title tr ul".split()
)
NEVER = frozenset("audio button canvas dialog embed fieldset footer form iframe input label legend map menu nav noscript object option script search select style svg template textarea title video aside head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CELLS = frozenset("td th br".split())
#: Containers whose start and end are followed; what is not listed ends with its block.
FOLLOWED = frozenset("article aside audio body button canvas dialog div dl fieldset figure footer form head header iframe label legend main map menu nav noscript object ol option script search section select style svg table template textarea title ul video".split())
ARTICLES = frozenset("article main".split())
#: Words in class, id or role, between hyphens and underscores, that name comments and other parts outside the article, and
#: first words after which they don't.
COMMENTS = frozenset("comment comments disqus respond reply replies".split())
ROLES = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies footer gdpr masthead menu modal "
    "nav navbar navigation newsletter notice notices outbrain pagination popup promo promoted recommended related search share sharing sidebar skip social sponsor sponsored "
    "subscribe subscription taboola toolbar topbar widget widgets".split()
)
ABOUT = frozenset("cat category format has is no not post tag type with without".split())
FREE, WEAK, STRONG = 0, 1, 2
SIGMA = 2.0
#: The weight of lines in containers side by side, and the part of its text that a wider region may add.
ASIDE, MORE = 0.25, 0.25
#: The part of a link's text that does not count, and the part of a line that links are in menus.
UNLINKED, MENU = 0.9, 0.6


class Lines(HTMLParser):
    """A page as lines (text, tags, container, link characters, in a paragraph) and containers (parent, tag, mark)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.parent, self.tag, self.mark = [-1], ["html"], [FREE]
        self.open = [0]
        self.still_open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.in_link = self.paragraph = False

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.open[-1], min(self.linked, len(text)), self.paragraph))
            self.tags = 0
        # Tags without text weigh on the next line.
        self.parts, self.linked, self.paragraph = [], 0, False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS or tag in NEVER:
            self.end_line()
            self.paragraph = tag == "p"
        elif tag in CELLS:
            self.parts.append(" ")
        elif tag == "a":
            self.in_link = True
        self.tags += 1
        if tag == "body":
            while len(self.open) > 1 and self.tag[self.open[-1]] in ("head", "title"):
                self.close_top()
        if tag in FOLLOWED and tag not in VOID:
            self.parent.append(self.open[-1])
            self.tag.append(tag)
            self.mark.append(self.mark_of(tag, attrs))
            self.open.append(len(self.tag) - 1)
            self.still_open[tag] += 1

    def mark_of(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        given = {k: v or "" for k, v in attrs}
        if "hidden" in given or given.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", given.get("style", "")):
            return STRONG
        if tag in NEVER:
            return WEAK if tag == "form" else STRONG
        if tag == "header" and not (self.still_open["article"] or self.still_open["main"]):
            return STRONG
        names = [words for k in ("class", "id", "role") for name in given.get(k, "").lower().split() if (words := re.split("[-_]", name))[0] not in ABOUT]
        named = {word.rstrip("0123456789") for words in names for word in words}
        if named & COMMENTS and tag != "body":
            return STRONG
        return WEAK if tag not in ARTICLES and tag != "body" and named & ROLES else FREE

    def close_top(self) -> None:
        self.still_open[self.tag[self.open.pop()]] -= 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in NEVER:
            self.end_line()
        elif tag in CELLS:
            self.parts.append(" ")
        elif tag == "a":
            self.in_link = False
        self.tags += 1
        if self.still_open[tag] > 0:
            while self.tag[self.open[-1]] != tag:
                self.close_top()
            self.close_top()

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.in_link:
            self.linked += len(data.strip())


def below(page: Lines, own: np.ndarray) -> np.ndarray:
    """Per container the sum of own over it and all containers inside; a container's number is above its parent's."""
    total = own.astype(float).tolist()
    for i in range(len(total) - 1, 0, -1):
        total[page.parent[i]] += total[i]
    return np.array(total)


def barred(page: Lines) -> list[bool]:
    """The containers whose text counts as markup.

    A weak mark (a name, a form) does not count where the container holds an article with text, or, on pages without one,
    three paragraphs and more than half of the text.
    """
    nodes = len(page.tag)
    out = [page.mark[0] == STRONG] * nodes
    for i in range(1, nodes):
        out[i] = out[page.parent[i]] or page.mark[i] == STRONG
    text, paragraphs = np.zeros(nodes), np.zeros(nodes)
    for words, _, node, _, paragraph in page.lines:
        if not out[node]:
            text[node] += len(words)
            paragraphs[node] += paragraph
    text, paragraphs = below(page, text), below(page, paragraphs)
    articles = below(page, np.array([t in ARTICLES and not out[i] and text[i] > 0 for i, t in enumerate(page.tag)]))
    for i in range(1, nodes):
        if out[page.parent[i]]:
            out[i] = True
        elif page.mark[i] == WEAK:
            out[i] = not (articles[i] or not articles[0] and paragraphs[i] >= 3 and 2 * text[i] > text[0])
    return out


def ratios(page: Lines) -> np.ndarray:
    """Text over tags of each line; of the text of links a part, of markup's nothing."""
    out = barred(page)
    return np.array([0.0 if out[node] else (len(text) - UNLINKED * linked) / max(1, tags) for text, tags, node, linked, _ in page.lines])


def smoothed(page: Lines, values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """values averaged with those of the lines nearby by a Gaussian. Lines of containers side by side count as ASIDE of their
    weight, those of one container or of nested ones in full; markup (0) stays 0 and blurs nothing."""
    n, reach = len(values), int(np.ceil(3 * sigma))
    use = (values > 0).astype(float)
    total, weight = values * use, use.copy()
    node = np.array([x[2] for x in page.lines])
    order = nested(page)
    for d in range(1, min(reach, n - 1) + 1):
        a, b = node[:-d], node[d:]
        w = np.exp(-0.5 * (d / sigma) ** 2) * np.where(order(a, b) | order(b, a), 1.0, ASIDE) * use[:-d] * use[d:]
        total[:-d] += w * values[d:]
        total[d:] += w * values[:-d]
        weight[:-d] += w
        weight[d:] += w
    return total / np.maximum(weight, 1e-12)


def nested(page: Lines):
    """Whether container b is a or lies in a, for arrays of containers. Numbers are given when containers open, so all inside
    of one follow it up to the last that it holds."""
    last = list(range(len(page.tag)))
    for i in range(len(last) - 1, 0, -1):
        last[page.parent[i]] = max(last[page.parent[i]], last[i])
    last_of = np.array(last)
    return lambda a, b: (a <= b) & (b <= last_of[a])


def two_clusters(values: np.ndarray) -> float:
    """The threshold midway between the means of two clusters (Lloyd's algorithm in one dimension, from the extremes)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        up = values >= cut
        if up.all() or not up.any():
            return cut
        now = float(values[~up].mean()), float(values[up].mean())
        if now == (low, high):
            break
        low, high = now
    return (low + high) / 2


def content(page: Lines, ratio: np.ndarray) -> np.ndarray:
    """How far each line lies above the threshold between the two clusters of smoothed ratios. Ratios count by their logarithm,
    as those of paragraphs reach over several powers of ten; a page has a line of markup, even if it shows none."""
    smooth = smoothed(page, np.log1p(ratio))
    return smooth - two_clusters(np.append(smooth, 0.0))


def region(page: Lines, ratio: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The lines of the container that the lines choose: those above the threshold speak for the containers they are in, those
    below against them, and the most favoured one counts, the outermost of equals; widened by what adds little text to it."""
    nodes = len(page.tag)
    node = np.array([x[2] for x in page.lines])
    chars = np.array([len(x[0]) for x in page.lines], float)
    votes = below(page, np.bincount(node, above, nodes))
    kept = below(page, np.bincount(node, chars * (ratio > 0), nodes))
    votes[kept == 0] = -np.inf
    best = int(np.flatnonzero(votes >= votes.max() - 1e-9)[0])
    while page.tag[best] not in ARTICLES and page.parent[best] > 0 and page.tag[page.parent[best]] != "body" and kept[page.parent[best]] <= (1 + MORE) * kept[best]:
        best = page.parent[best]
    order = nested(page)
    inside = order(np.full(len(node), best), node)
    if page.tag[best] in ARTICLES:
        for i in range(nodes):
            if page.tag[i] in ARTICLES and page.parent[i] == page.parent[best]:
                inside |= order(np.full(len(node), i), node)
    return inside


def main_text(html: str | None) -> str:
    """The lines of the page's article, joined by newlines; '' for null, empty and contentless pages."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.end_line()
    if not page.lines:
        return ""
    ratio = ratios(page)
    if not ratio.any():
        return ""
    above = content(page, ratio)
    own = np.flatnonzero(region(page, ratio, above) & (ratio > 0))
    keep = above[own] >= 0
    if not keep.any():
        keep[above[own].argmax()] = True
    # The lists, tables and parts inside the region that follow on from content lines belong to them.
    top = {page.lines[i][2] for i in own[keep]}
    part = np.array([page.lines[i][2] not in top and page.lines[i][3] < MENU * len(page.lines[i][0]) for i in own])
    for order in (range(1, len(own)), range(len(own) - 2, -1, -1)):
        step = 1 if order.step > 0 else -1
        for k in order:
            keep[k] |= part[k] and keep[k - step]
    return "\n".join(page.lines[i][0] for i in own[keep])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row; null and empty html give ''. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
