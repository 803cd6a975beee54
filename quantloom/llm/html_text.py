"""Main text of web pages by composite text density.

Every block of the page gets a density: characters per tag, lowered by the share of linked text.
A block's score is the sum of its children's densities; the block with the largest score holds the
article, and the least density on its path from the body is the threshold for further parts.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from .common import add_columns

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is never part of an article.
DROPPED = frozenset("head nav footer aside form script style noscript template iframe object svg canvas button select textarea input dialog menu audio video".split())
#: Words of class, id and role values that mark page furniture, and those that mark reader comments.
FURNITURE = frozenset("ad ads adbox advert advertisement adverts banner breadcrumb breadcrumbs consent cookie cookies menu modal navbar navigation newsletter notice "
                      "popup promo promoted promotion related share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split())
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
WHOLE = frozenset(("html", "body"))
ARTICLE = frozenset(("article", "main"))
#: Which open element an opening tag ends.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: A further part must have this share of the chosen block's score.
FURTHER = 0.3


class Page(HTMLParser):
    """A flat tree: node i has a tag, a parent with a smaller number, marks, and an ordered list of parts (texts and nodes)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parent, self.marks, self.parts = ["#root"], [0], [frozenset()], [[]]
        self.stack, self.open = [0], {}

    def handle_starttag(self, tag, attrs):
        if tag == "br" or tag == "wbr":
            if tag == "br":
                self.parts[self.stack[-1]].append(" ")
            return
        for other in ENDS.get(tag, ()):
            self._end_if_near(other)
        if tag in BLOCK and tag not in WHOLE:
            self._end_if_near("p")
        if tag in WHOLE and self.open.get(tag):
            return
        i = len(self.tags)
        values = " ".join(v for k, v in attrs if v and k in ("class", "id", "role")) if attrs else ""
        marks = set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", values).lower()))
        if any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and re.search(r"display\s*:\s*none", v) for k, v in attrs):
            marks.add("#hidden")
        self.tags.append(tag)
        self.parent.append(self.stack[-1])
        self.marks.append(marks)
        self.parts.append([])
        self.parts[self.stack[-1]].append(i)
        if tag not in VOID:
            self.stack.append(i)
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("script", "style", "a", "span", "div", "p", "svg", "path"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.open.get(tag) or tag in WHOLE:
            return
        while True:
            top = self.tags[self.stack.pop()]
            self.open[top] -= 1
            if top == tag:
                return

    def _end_if_near(self, tag):
        """End the nearest open ``tag`` if only inline elements are open inside it."""
        if not self.open.get(tag):
            return
        for i in reversed(self.stack):
            if self.tags[i] == tag:
                self.handle_endtag(tag)
                return
            if self.tags[i] in BLOCK or i == 0:
                return

    def handle_data(self, data):
        self.parts[self.stack[-1]].append(data)


def parse(html: str) -> Page:
    page, last = Page(), html.rfind("<")
    if last > html.rfind(">") and re.match(r"<[A-Za-z/!?]", html[last:last + 2]):
        html = html[:last]  # a tag that the page's end cuts off
    page.feed(html)
    page.close()
    return page


def dropped(page: Page) -> list[bool]:
    """Which nodes are page furniture, reader comments or without content."""
    n = len(page.tags)
    article = [False] * n  # holds an article that isn't a comment
    heading = [False] * n
    for i in range(n - 1, 0, -1):
        tag = page.tags[i]
        article[i] = article[i] or tag in ARTICLE and not page.marks[i] & COMMENTS
        heading[i] = heading[i] or tag == "h1"
        p = page.parent[i]
        article[p], heading[p] = article[p] or article[i], heading[p] or heading[i]
    out, inside = [False] * n, [False] * n
    for i in range(1, n):
        p, tag, marks = page.parent[i], page.tags[i], page.marks[i]
        inside[i] = inside[p] or tag in ARTICLE
        out[i] = out[p] or tag not in WHOLE and (
            tag in DROPPED and not (article[i] and tag in ("form", "aside")) or "#hidden" in marks or bool(marks & COMMENTS) and not article[i]
            or tag == "header" and not (inside[i] and heading[i]) and not article[i]
            or bool(marks & FURNITURE) and not article[i])
    return out


def scores(page: Page, out: list[bool]) -> tuple[list[float], list[float], list[int]]:
    """Per node its density and the sum of its block children's densities, and the characters it holds."""
    n = len(page.tags)
    chars, linked, tags, links = [0] * n, [0] * n, [0] * n, [0] * n
    body = 0
    for i in range(n - 1, -1, -1):
        if out[i]:
            continue
        chars[i] += sum(len(x.strip()) for x in page.parts[i] if isinstance(x, str))
        if page.tags[i] == "a":
            linked[i], links[i] = chars[i], links[i] + 1
        if i:
            p = page.parent[i]
            chars[p] += chars[i]
            linked[p] += linked[i]
            tags[p] += tags[i] + 1
            links[p] += links[i]
        if page.tags[i] == "body":
            body = i
    share = linked[body] / chars[body] if chars[body] else 0.0
    density, score = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if out[i] or not chars[i]:
            continue
        c, lc, t, lt = chars[i], linked[i], max(tags[i], 1), max(links[i], 1)
        base = math.log(c * lc / max(c - lc, 1) + share * c + math.e)
        density[i] = c / t * max(math.log(c / max(lc, 1) * t / lt + 1), 0.0) / math.log(max(base, 1.0) + math.e - 1)
        score[i] = max(score[i], density[i] if not score[i] else 0.0)
        if i:
            score[page.parent[i]] += density[i] if page.tags[i] in BLOCK else score[i]
    return density, score, chars


def main_text(html: str | None) -> str:
    """The article's blocks in page order, an empty line between them; empty if the page has none.

    Parts beside the chosen block that score less than ``FURTHER`` of it are left out where no element marks the article.
    """
    if not html:
        return ""
    page = parse(html)
    out = dropped(page)
    density, score, chars = scores(page, out)
    blocks = [i for i in range(len(page.tags)) if not out[i] and chars[i] and (page.tags[i] in BLOCK or i == 0)]
    if not blocks:
        return ""
    target = max(blocks, key=lambda i: (score[i], -i))
    path = [target]
    while path[-1]:
        path.append(page.parent[path[-1]])
    holder = next((i for i in reversed(path) if page.tags[i] in ARTICLE), None)
    if holder is not None:
        chosen = [holder]
    else:
        threshold = min((density[i] for i in path if i and page.tags[i] not in ("html",)), default=0.0)
        on_path = set(path)
        chosen = [target]
        for i in blocks:  # parts beside the path that are as dense, and score enough
            if i not in on_path and page.parent[i] in on_path and page.parent[i] != target and density[i] >= threshold and score[i] >= FURTHER * score[target]:
                chosen.append(i)
    lines, words = [], []

    def end_block():
        line = " ".join("".join(words).split())
        if line:
            lines.append(line)
        words.clear()

    for top in sorted(chosen):
        if any(_within(page, top, other) for other in chosen if other != top):
            continue
        end_block()
        todo = [top]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                words.append(x)
            elif x < 0:
                end_block()
            elif not out[x]:
                if page.tags[x] in BLOCK:
                    end_block()
                    todo.append(-x - 1)
                todo.extend(reversed(page.parts[x]))
        end_block()
    return "\n\n".join(lines)


def _within(page: Page, node: int, other: int) -> bool:
    while node > other:
        node = page.parent[node]
    return node == other


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page (page_id, url, html), from the whole html.

    Null and empty html, and pages without text, give an empty text and 0.  Null ids and urls and
    repeated rows pass through; broken html is read as far as a browser would; an empty table gives
    an empty result; other columns are ignored.
    """

    def row(html: str | None) -> tuple:
        text = main_text(html)
        return text, len(text)

    return add_columns(pages.select("page_id", "url", "html"), "html", row, "text string, n_chars long")
