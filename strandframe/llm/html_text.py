"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, containers lose
points by the share of link text, and the best container with its siblings of similar
worth is kept.  A page is one row; the tree is a few flat lists in page order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import text_of

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
QUOTE_OR_END = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# Content up to the matching end tag is no markup.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "xmp", "noframes", "annotation", "annotation-xml"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br ruby rt rp "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup mover munder munderover mstyle mfenced semantics".split()
)
DROPPED = set("nav aside footer form button select input dialog menu object canvas video audio map head fieldset".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
# Whole names in class or id of what is not the article.
SIDE_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side-bar nav navigation navbar menu breadcrumb breadcrumbs "
    "footer site-footer page-footer site-header page-header masthead comment comments comment-list commentlist comment-section comments-section comment-thread comment-form "
    "disqus disqus_thread respond reply replies cookie cookies cookie-notice cookie-banner cookie-consent consent gdpr notice notices alert popup modal overlay "
    "newsletter newsletter-signup newsletter-form subscribe subscription signup login share share-bar share-buttons share-links sharing social social-links social-share "
    "related related-articles related-links related-posts recommended recommendations pagination pager widget widgets toolbar topbar".split()
)
# Of these the ones that are never the article, however much of the page they hold.
NEVER = {n for n in SIDE_NAMES if re.match("ads?$|advert|comment|cookie|disqus|respond$|replies$|side-?bar$|footer$|site-footer$|page-footer$", n)}
# Words inside such names; they decide only together with links or form controls.
SIDE_WORDS = {w for name in SIDE_NAMES for w in re.split("[-_]", name)} - {"thread", "list", "section", "site", "page", "form", "side", "bar", "links", "posts", "articles", "buttons", "header"}
QUALIFIERS = {"has", "with", "no", "without", "is", "hide", "show", "open"}
# An open element that the start of one of these ends first.
ENDS_PARAGRAPH = set(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "body", "html", "article", "main", "div", "section"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARAGRAPHS = {"p", "pre", "td", "blockquote", "dd", "li", "div", "section", "article", "main"}
TAG_POINTS = {"article": 5, "main": 5, "div": 5, "section": 3, "pre": 3, "td": 3, "blockquote": 3, "ol": -3, "ul": -3, "dl": -3, "li": -3, "form": -3, "th": -5}
CONTROLS = {"input", "button", "select", "textarea", "form", "fieldset"}


class Page:
    """Elements in page order (parents first) and text blocks."""

    def __init__(self, html: str):
        self.tags, self.parents, self.dropped, self.hinted, self.controls = ["#root"], [-1], [False], [0], [0]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters inside links
        self._text: list[tuple[str, bool]] = []
        self._open_tags: Counter = Counter()
        self._parse(html)

    def _parse(self, html: str) -> None:
        """One walk over the page; every character is passed a fixed number of times."""
        stack, at, end = [0], 0, len(html)
        last_end, last_quote = html.rfind(">"), {q: html.rfind(q) for q in "\"'"}
        quotes = True  # until a tag has no end outside of its quotes: from there on a tag ends at the first >
        while at < end:
            lt = html.find("<", at)
            if lt < 0:
                break
            self._add(html[at:lt], stack)
            if html.startswith("<!--", lt):
                close = html.find("-->", lt + 4)
                at = close + 3 if close >= 0 else end
                continue
            if html[lt + 1 : lt + 2] in ("!", "?"):
                close = html.find(">", lt)
                at = close + 1 if close >= 0 else end
                continue
            ending = html.startswith("</", lt)
            name = NAME.match(html, lt + 1 + ending) if lt < last_end else None
            if name is None:
                self._add("<", stack)
                at = lt + 1
                continue
            close = self._tag_end(html, name.end(), last_quote) if quotes else -1
            if close < 0:
                quotes, close = False, html.find(">", name.end())
            tag, attributes, at = name[0].lower(), html[name.end() : close], close + 1
            if ending:
                self._close(tag, stack)
            elif tag in RAW:
                found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                close = html.find(">", found.end()) if found else -1
                at = close + 1 if close >= 0 else end
            else:
                self._open(tag, attributes, stack)
        if at < end:
            self._add(html[at:], stack)
        self._flush(stack)

    @staticmethod
    def _tag_end(html: str, at: int, last_quote: dict[str, int]) -> int:
        """Place of the > that ends a tag, outside of quoted values; a quote that is never closed is a plain letter."""
        while True:
            m = QUOTE_OR_END.search(html, at)
            if m is None:
                return -1
            if m[0] == ">":
                return m.start()
            at = m.end()
            if m.start() < last_quote[m[0]]:
                at = html.find(m[0], at) + 1

    def _add(self, text: str, stack: list[int]) -> None:
        if text:
            self._text.append((text, self._open_tags["a"] > 0))

    def _flush(self, stack: list[int]) -> None:
        if not self._text:
            return
        text = " ".join(unescape("".join(t for t, _ in self._text)).split())
        if text:
            owner = next(i for i in reversed(stack) if self.tags[i] not in INLINE)
            linked = " ".join(unescape("".join(t for t, link in self._text if link)).split())
            self.blocks.append((owner, text, len(linked)))
        self._text = []

    def _pop_to(self, k: int, stack: list[int]) -> None:
        if any(self.tags[i] not in INLINE for i in stack[k:]):
            self._flush(stack)
        self._open_tags.subtract(self.tags[i] for i in stack[k:])
        del stack[k:]

    def _open(self, tag: str, attributes: str, stack: list[int]) -> None:
        if tag in VOID:
            if tag == "hr":
                self._flush(stack)
            elif tag == "input":
                self.controls[stack[-1]] += 1
            elif tag in ("br", "img"):
                self._text.append((" ", False))
            return
        if tag in ENDS_PARAGRAPH:
            for k in range(len(stack) - 1, 0, -1):
                if self.tags[stack[k]] == "p":
                    self._pop_to(k, stack)
                    break
                if self.tags[stack[k]] not in INLINE:
                    break
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if self.tags[stack[k]] in CLOSES[tag]:
                    self._pop_to(k, stack)
                    if tag != "tr":
                        break
                elif self.tags[stack[k]] in SCOPE:
                    break
        if tag not in INLINE:
            self._flush(stack)
        parent = stack[-1]
        self.tags.append(tag)
        self.parents.append(parent)
        hard, hint = judged(tag, attributes, self._open_tags["article"] + self._open_tags["main"] > 0)
        self.dropped.append(self.dropped[parent] or hard)
        self.hinted.append(hint)
        self.controls.append(int(tag in CONTROLS))
        if not attributes.endswith("/") or tag in INLINE or tag in ENDS_PARAGRAPH:
            stack.append(len(self.tags) - 1)
            self._open_tags[tag] += 1

    def _close(self, tag: str, stack: list[int]) -> None:
        if not self._open_tags[tag]:
            if tag == "p":
                self._flush(stack)
            return
        for k in range(len(stack) - 1, 0, -1):
            here = self.tags[stack[k]]
            if here == tag:
                self._pop_to(k, stack)
                return
            if tag in INLINE and here not in INLINE:
                return


def judged(tag: str, attributes: str, inside: bool) -> tuple[bool, int]:
    """(surely not the article, hinted not to be it by class or id: 2 by a whole name, 1 by a word of one)."""
    if tag in DROPPED or (tag == "header" and not inside):
        return True, 0
    if not attributes.strip():
        return False, 0
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
    role = found.get("role", "").lower()
    if role in DROPPED_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True, 0
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True, 0
    if tag in ("html", "body", "main", "article") or tag in HEADINGS:
        return False, 0
    hint = 0
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = [x.lower() for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)]
        if not parts or parts[0] in QUALIFIERS:
            continue
        known = {name.lower(), "-".join(parts)} & SIDE_NAMES
        if known:
            return bool(known & NEVER), 2
        hint = max(hint, int(bool(SIDE_WORDS.intersection(parts))))
    return False, hint


def main_blocks(html: str) -> list[str]:
    """Blocks of the article in page order."""
    page = Page(html)
    n = len(page.tags)
    chars, linked, links = [0] * n, [0] * n, [0] * n
    for owner, text, link in page.blocks:
        if not page.dropped[owner]:
            chars[owner] += len(text)
            linked[owner] += link
            links[owner] += link > 0
    for i in range(n - 1, 0, -1):
        chars[page.parents[i]] += chars[i]
        linked[page.parents[i]] += linked[i]
        links[page.parents[i]] += links[i]
    controls = list(page.controls)
    for i in range(n - 1, 0, -1):
        controls[page.parents[i]] += controls[i]
    total = chars[0]
    gone = list(page.dropped)
    for i in range(1, n):
        # A whole name drops what is not most of the page, a word only what is links or a form; so does being a list of links.
        bar = links[i] >= 3 and linked[i] >= 0.9 * chars[i] and page.tags[i] in ("ul", "ol", "div", "table", "section", "dl", "p")
        side = page.hinted[i] == 2 or (page.hinted[i] == 1 and (controls[i] > 0 or 2 * linked[i] >= chars[i]))
        gone[i] = gone[i] or gone[page.parents[i]] or (side and 2 * chars[i] <= total and page.tags[i] != "header") or bar
    # a paragraph's points go to its container in full and on to every ancestor by halves
    points = [0.0] * n
    scored = False
    for owner, text, _ in page.blocks:
        if gone[owner] or page.tags[owner] not in PARAGRAPHS:
            continue
        scored = True
        up = page.parents[owner] if page.tags[owner] in ("p", "pre", "li", "dd", "td", "blockquote") else owner
        points[max(up, 0)] += sum(text.count(c) for c in ",，、") + min(len(text) / 100, 4.0)
    for i in range(n - 1, 0, -1):
        points[page.parents[i]] += points[i] / 2
    inside = in_container(page, gone, points, chars, linked) if scored else semantic(page, gone, chars)
    return [text for owner, text, _ in page.blocks if inside[owner] and not gone[owner]]


def spread_down(page: Page, roots: set[int]) -> list[bool]:
    inside = [i in roots for i in range(len(page.tags))]
    for i in range(1, len(inside)):
        inside[i] = inside[i] or inside[page.parents[i]]
    return inside


def semantic(page: Page, gone: list[bool], chars: list[int]) -> list[bool]:
    """No paragraph scored: the first article or main with text, else the whole page."""
    for i, tag in enumerate(page.tags):
        if tag in ("article", "main") and chars[i] and not gone[i]:
            return spread_down(page, {i})
    return spread_down(page, {0})


def in_container(page: Page, gone: list[bool], points: list[float], chars: list[int], linked: list[int]) -> list[bool]:
    """Membership in the best container and in those of its siblings that are kept."""
    def score(i: int) -> float:
        density = linked[i] / chars[i] if chars[i] else 0.0
        return (points[i] + TAG_POINTS.get(page.tags[i], 0)) * (1 - density)

    candidates = [i for i in range(1, len(points)) if points[i] > 0 and not gone[i] and page.tags[i] not in INLINE]
    if not candidates:
        return spread_down(page, {0})
    best = max(candidates, key=lambda i: (score(i), -i))
    up = best
    while up > 0 and page.tags[up] not in ("article", "main"):
        up = page.parents[up]
    if up > 0 and page.tags[up] == "article":
        best = up
    elif up > 0 and not any(t == "article" and not gone[i] and chars[i] for i, t in enumerate(page.tags)):
        best = up
    roots, bar = {best}, max(10.0, 0.2 * score(best))
    if page.tags[best] != "main":
        for i in range(1, len(points)):
            if page.parents[i] != page.parents[best] or i == best or gone[i] or not chars[i]:
                continue
            prose = linked[i] <= 0.25 * chars[i] and page.tags[i] in ("p", "pre", "blockquote", "h1", "h2", "h3", "ul", "ol", "table", "figure")
            if score(i) >= bar or (prose and page.tags[best] != "article"):
                roots.add(i)
    return spread_down(page, roots)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text, n_chars`` per input row.

    A null or empty page, or one without text, gives an empty text.  Rows are
    independent, so repeated ids give one row each; other columns are ignored.
    """
    picked = pages.select(F.struct(F.col(id_col).alias("id"), F.col(url_col).alias("url")).alias("key"), text_of(html_col).alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "text": ["\n".join(main_blocks(h)) for h in batch["html"]]})

    key = picked.schema["key"].dataType.simpleString()
    done = picked.mapInPandas(run, f"key {key}, text string")
    return done.select(F.col("key.id").alias(id_col), F.col("key.url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
