"""Main text of web pages by tree scoring.

A page is read once into a tree of block-level elements. Every block of text gives points for its length and its commas
to the elements above it, fewer the further up; an element's points are discounted by the share of its text that stands
in links. The best container, or the article element around it, is kept together with siblings that score alongside it.
Scripts, buttons, labels, adverts within a line, and hidden elements give no points and no text. Elements that by tag, or by a
whole name in class, id or role, stand beside an article (navigation, forms, notices, adverts, comments and the like) are left
out too, but only once the page is read: one that holds the main element, the longest article, a top heading or most of the
page's text is never left out, nor is one of some length with few links, tags of NEVER aside; both only score lower. A name
of which only a part is such a word acts only together with links, a form, comments, or a place outside the article. If
nothing is left, the page is scored again without these rules. A list of links is a menu if its links are short (MENU
characters on average) and neither a heading nor a line with a colon at its end leads to it.
Beside the best container stay its siblings that continue it, however short: paragraphs, headings, lists and the like, and
containers of paragraphs, if few links are in them.
Spark's part is a narrow map over the rows: no shuffle, memory bounded by one page per task.

Edge cases: null or empty html, or a page without text, gives an empty string; unclosed and misnested tags are closed as
the next block requires; an unclosed quote or comment ends at the next ">" or at the end of the page; repeated rows
repeat; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption pre blockquote figure figcaption header footer nav aside form fieldset address details summary hr center menu dialog hgroup search".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp template svg math object canvas audio video select".split())
NEVER = frozenset("nav footer aside menu dialog search header".split())
FORMS = frozenset("form fieldset".split())
#: What an element beside the article keeps of its score, and the length from which it is scored at all.
LOWERED = 0.25
LONG = 250
#: Characters of a link, on average, up to which a list of links is a menu.
MENU = 25
#: Parts of a line that are no text of the article, by tag, and the words that mark an advert.
CONTROLS = frozenset("button label legend option optgroup datalist output progress meter".split())
ADVERT = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption"}
#: An element that opens closes an open one of these kinds, up to the given borders.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"})}
CONTAINERS = frozenset("body main article section div td blockquote html center dd li figure details".split())
#: Words in class, id or role that mark parts beside the article.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay sidebar aside rail nav navbar navigation menu breadcrumb breadcrumbs pagination pager "
    "header comment comments commentlist disqus reply replies respond discussion share sharing social related recommended newsletter subscribe subscription signup login footer masthead toolbar widget widgets skip hidden complementary contentinfo search alert".split()
)
#: Words that say nothing in a name of words of BESIDE.
NEUTRAL = frozenset("post posts story stories link links list item items box area block section container wrapper wrap panel bar site page top bottom left right global primary secondary inner outer form content buttons icons slot unit group row module main".split())
#: Names that are as often a part of an article.
EITHER = frozenset({"discussion"})
COMMENTS = frozenset("header comment comments commentlist disqus reply replies respond".split())
#: Elements of running text.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
GOOD = frozenset("article body content entry main post text story blog page hentry".split())
_TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*+)|[!?/])")
_ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_COMMAS = re.compile("[,،、，]")


SURE, UNSURE = 2, 1


class _Page:
    """Elements in page order: parent, tag, whether hidden, whether beside the article by its tag or a whole name (SURE) or a part of one (UNSURE), bonus; and blocks (element, text, characters in links, links)."""

    def __init__(self, html: str):
        self.parent, self.tag, self.hidden, self.beside, self.bonus, self.end = [-1], ["html"], [False], [0], [0.0], [0]
        self.remarks = [False]  # by class, id or role, an element of comments
        self.blocks: list[tuple[int, str, int, int]] = []
        self.open, self.count = [0], Counter({"html": 1})
        self.text: list[str] = []
        self.links = self.anchors = 0
        self.in_link = False
        #: of an element within a line that is left out: its tag, how many of that tag are open, how many blocks were
        self.skipped: tuple[str, int, int] | None = None
        self._read(html)

    def _flush(self) -> None:
        if self.text:
            text = " ".join(unescape("".join(self.text)).split())
            if text and not self.hidden[self.open[-1]]:
                self.blocks.append((self.open[-1], text, min(self.links, len(text)), self.anchors))
            self.text, self.links, self.anchors = [], 0, 0

    def _pop(self) -> None:
        element = self.open.pop()
        self.count[self.tag[element]] -= 1
        self.end[element] = len(self.tag)
        if self.skipped and len(self.open) < self.skipped[2]:
            self.skipped = None  # the block that it is in has ended

    def _close(self, kinds: set[str], borders: set[str] | frozenset[str] = frozenset()) -> None:
        if not any(self.count[k] for k in kinds):
            return
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[at]]
            if tag in kinds:
                while len(self.open) > at:
                    self._pop()
                return
            if tag in borders:
                return

    @staticmethod
    def _marks(attributes: str) -> tuple[list[frozenset[str]], bool]:
        """The words of each name in class, id and role; whether the element is hidden."""
        names, hidden = [], False
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id", "role", "itemprop"):
                names += [frozenset(_WORDS.findall(x)) for x in value.split()]
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
                hidden = True
        return names, hidden

    def _begin(self, tag: str, attributes: str) -> None:
        hidden, beside, bonus, remarks = self.hidden[self.open[-1]], SURE if tag in NEVER or tag in FORMS else 0, 0.0, False
        if tag in ("article", "main"):
            bonus += 25
        if tag == "header" and (self.count["article"] or self.count["main"]):
            beside = 0
        if attributes and not hidden:
            names, unseen = self._marks(attributes)
            words = frozenset().union(*names)
            hidden = unseen and tag not in ("html", "body")
            remarks = bool(words & COMMENTS)
            if words & BESIDE and not (words & GOOD and not words & ADVERT and self._in_a_name_of_its_own(attributes)) and tag not in ("html", "body", "main", "h1"):
                whole = any(n & BESIDE and n <= BESIDE | NEUTRAL and not n <= EITHER for n in names)
                if tag != "article" or words & {"comment", "comments", "reply", "ad", "ads", "advert", "sponsored", "related", "promo"}:
                    beside = max(beside, SURE if whole else UNSURE)
            if words & GOOD:
                bonus += 25
        self.count[tag] += 1
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        self.hidden.append(hidden)
        self.beside.append(beside)
        self.remarks.append(remarks)
        self.bonus.append(bonus)
        self.end.append(0)
        self.open.append(len(self.tag) - 1)

    @staticmethod
    def _in_a_name_of_its_own(attributes: str) -> bool:
        """Whether one of the names in class has a word of GOOD and none of BESIDE."""
        names = [set(_WORDS.findall(name)) for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() == "class" for name in (m[2] or m[3] or m[4] or "").lower().split()]
        return any(name & GOOD and not name & BESIDE for name in names)

    def _skips(self, tag: str, attributes: str) -> bool:
        """Whether an element within a line is left out with all in it."""
        if tag in CONTROLS:
            return True
        if tag in VOID or not attributes or attributes.endswith("/"):
            return False
        names, hidden = self._marks(attributes)
        return hidden or any(n and n <= ADVERT for n in names)

    def _read(self, html: str) -> None:
        at, size, quotes = 0, len(html), True
        lowered = None
        while True:
            m = _TAG.search(html, at)
            piece = html[at : m.start() if m else size]
            if piece and not self.skipped:
                self.text.append(piece)
                if self.in_link:
                    self.links += len(piece)
            if not m:
                break
            if m[1]:
                end = html.find("-->", m.end())
                at = end + 3 if end >= 0 else self._next(html, m.end())
                continue
            tag = (m[3] or "").lower()
            found = _ATTRIBUTES.match(html, m.end()) if quotes and tag else None
            if found:
                at = found.end()
            else:
                quotes = quotes and not tag  # an unclosed quote: from here on tags end at the next ">"
                at = self._next(html, m.end())
            if not tag:
                continue
            if m[2]:
                if tag in BLOCKS:
                    self._flush()
                    if tag not in ("html", "body"):
                        self._close({tag})
                elif tag == "a":
                    self.in_link = False
                if self.skipped and self.skipped[0] == tag:
                    self.skipped = (tag, self.skipped[1] - 1, self.skipped[2]) if self.skipped[1] > 1 else None
                continue
            attributes = html[m.end() : at - 1]
            if tag in RAW or tag == "head":
                if attributes.endswith("/"):
                    continue
                if tag == "head":
                    continue
                lowered = html.lower() if lowered is None else lowered
                lowered = lowered if len(lowered) == size else re.sub("[A-Z]+", lambda x: x[0].lower(), html)
                end = lowered.find(f"</{tag}", at)
                at = self._next(html, end) if end >= 0 else size
                continue
            if tag in BLOCKS:
                self._flush()
                self.in_link = False
                if tag in CLOSES_P:
                    self._close({"p"}, {"td", "th", "table", "li"})
                if tag in IMPLIED:
                    self._close(*IMPLIED[tag])
                if tag in ("html", "body"):
                    if tag == "body" and not self.count["body"]:
                        self._begin(tag, attributes)
                elif tag != "hr":
                    self._begin(tag, attributes)
                continue
            if tag == "a":
                self.in_link = True
                self.anchors += not self.skipped
            if self.skipped:
                if tag == self.skipped[0]:
                    self.skipped = (tag, self.skipped[1] + 1, self.skipped[2])
            elif self._skips(tag, attributes):
                self.text.append(" ")
                self.skipped = (tag, 1, len(self.open))
            elif tag in ("br", "img", "input"):
                self.text.append(" ")
        self._flush()
        while self.open:
            self._pop()

    @staticmethod
    def _next(html: str, at: int) -> int:
        end = html.find(">", at)
        return end + 1 if end >= 0 else len(html)

    def main_text(self) -> str:
        if not self.blocks:
            return ""
        return self._main_text(self.beside) or self._main_text([0] * len(self.tag))

    def _sums(self, dropped: list[bool]) -> tuple[list[int], list[int]]:
        """Characters, and characters in links, of each element with all in it."""
        chars, links = [0] * len(self.tag), [0] * len(self.tag)
        for element, text, linked, _ in self.blocks:
            if not dropped[element]:
                chars[element] += len(text)
                links[element] += linked
        for element in range(len(self.tag) - 1, 0, -1):
            chars[self.parent[element]] += chars[element]
            links[self.parent[element]] += links[element]
        return chars, links

    def _judged(self, beside: list[int]) -> tuple[list[bool], list[float], list[bool], list[bool]]:
        """Whether each element is left out, what it keeps of its score, whether it holds what marks an article, and whether it is beside one."""
        n = len(self.tag)
        chars, links = self._sums([False] * n)
        apart = [False] * n  # in an element that may be beside the article, itself included
        for k in range(1, n):
            apart[k] = beside[k] > 0 or apart[self.parent[k]]
        articles = [k for k in range(n) if self.tag[k] == "article" and chars[k] and not beside[k]]
        longest = max(articles, key=lambda k: (chars[k], not apart[k]), default=-1)
        marks, heads = [False] * n, [False] * n
        for k in range(n - 1, 0, -1):
            marks[k] = marks[k] or k == longest or self.tag[k] == "main" and chars[k] > 0
            heads[k] = heads[k] or self.tag[k] == "h1" and chars[k] > 0
            marks[self.parent[k]] = marks[self.parent[k]] or marks[k]
            heads[self.parent[k]] = heads[self.parent[k]] or heads[k]
        # a part of a name counts together with links, a form, comments, or a place outside the article
        form, remarks, within = [t in FORMS for t in self.tag], [False] * n, [False] * n
        for k in range(n - 1, 0, -1):
            form[self.parent[k]] = form[self.parent[k]] or form[k]
            remarks[self.parent[k]] = remarks[self.parent[k]] or remarks[k] or self.remarks[k]
        for k in range(n):
            within[k] = self.tag[k] in ("article", "main") or k > 0 and within[self.parent[k]]
        marked = longest >= 0 or any(marks)
        aside = [b == SURE or b == UNSURE and (2 * links[k] > chars[k] or form[k] or remarks[k] or marked and not within[k]) for k, b in enumerate(beside)]
        holds = [marks[k] or heads[k] and self.tag[k] not in ("nav", "header", "footer") for k in range(n)]
        dropped, keeps, below = [False] * n, [1.0] * n, [1.0] * n
        for k in range(1, n):
            above = self.parent[k]
            dropped[k], keeps[k], below[k] = dropped[above], below[above], below[above]
            if aside[k]:
                keeps[k], most = LOWERED, 2 * chars[k] > chars[0]
                if not (holds[k] and most):
                    below[k] = LOWERED
                if not (holds[k] or most):
                    dropped[k] = dropped[k] or self.tag[k] in NEVER or chars[k] < LONG or 2 * links[k] > chars[k]
        return dropped, keeps, holds, aside

    def _main_text(self, beside: list[int]) -> str:
        n = len(self.tag)
        dropped, keeps, holds, apart = self._judged(beside)
        chars, links = self._sums(dropped)
        if not chars[0]:
            return ""
        score = [0.0] * n
        for element, text, *_ in self.blocks:
            if dropped[element]:
                continue
            points = (1 + len(_COMMAS.findall(text)) + min(len(text) // 100, 3)) if len(text) >= 25 else 0.2
            if self.tag[element] not in CONTAINERS:
                element = self.parent[element]
            level = 0
            while element >= 0 and level < 6:
                score[element] += points / (1, 2, 6, 9, 12, 15)[level]
                element, level = self.parent[element], level + 1
        density = [links[k] / chars[k] if chars[k] else 0.0 for k in range(n)]
        final = [(score[k] + self.bonus[k]) * (1 - density[k]) * keeps[k] if chars[k] and not dropped[k] else -1.0 for k in range(n)]
        best = max((k for k in range(n) if chars[k] and (self.tag[k] in CONTAINERS)), key=lambda k: (final[k], -k), default=0)
        top, around = best, best
        while around >= 0:
            if self.tag[around] in ("article", "main"):
                top = around
                if self.tag[around] == "article":
                    break
            around = self.parent[around]
        kept, running = {top}, [0] * n  # characters in elements of running text
        for element, text, *_ in self.blocks:
            if not dropped[element] and self.tag[element] in TEXTUAL:
                running[element] += len(text)
        for k in range(n - 1, 0, -1):
            running[self.parent[k]] += running[k]
        if top:
            for k in range(self.parent[top] + 1, n):
                if self.parent[k] == self.parent[top] and k != top and chars[k] and not dropped[k] and not apart[k] and self._alongside(k, top, final, chars, density, running):
                    kept.add(k)
        # what is beside the article counts within it only if it holds the best, a mark of the article, or scores alongside it
        out, inside, anchors = [], [False] * n, [0] * n
        for element, *_, count in self.blocks:
            anchors[element] += count
        for k in range(n - 1, 0, -1):
            anchors[self.parent[k]] += anchors[k]
        led = self._led(dropped)
        for k in range(n):
            above = self.parent[k]
            aside = apart[k] and not (k <= best < self.end[k] or holds[k] or final[k] >= max(10.0, 0.2 * final[best]))
            inside[k] = k in kept or above >= 0 and inside[above] and not aside and not (self._menu(k, links, anchors, density) and not led[k])
        for element, text, *_ in self.blocks:
            if inside[element] and not dropped[element]:
                out.append(text)
        return "\n".join(out)

    def _alongside(self, k: int, top: int, final: list[float], chars: list[int], density: list[float], running: list[int]) -> bool:
        """Whether a sibling continues the best: running text of few links, whatever its length."""
        if self.tag[k] in CONTAINERS or self.tag[k] in ("table", "dl", "ul", "ol"):
            return density[k] < 0.25 and 2 * running[k] > chars[k] or final[k] >= max(10.0, 0.2 * final[top])
        return density[k] < 0.25 and self.tag[k] in TEXTUAL or final[k] >= max(10.0, 0.2 * final[top])

    def _led(self, dropped: list[bool]) -> list[bool]:
        """Whether the block in front of an element, below the same parent, is a heading or ends with a colon."""
        led, first = [False] * len(self.tag), {}
        for at, (element, *_) in enumerate(self.blocks):
            while element > 0 and element not in first:
                first[element] = at
                element = self.parent[element]
        for k, at in first.items():
            if at:
                element, text, *_ = self.blocks[at - 1]
                led[k] = not dropped[element] and self.parent[element] == self.parent[k] and (self.tag[element] in HEADINGS or text.endswith(":"))
        return led

    def _menu(self, k: int, links: list[int], anchors: list[int], density: list[float]) -> bool:
        return self.tag[k] in ("ul", "ol", "dl") and density[k] > 0.8 and links[k] <= MENU * anchors[k]


def main_text(html: str | None) -> str:
    return _Page(html).main_text() if html else ""


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_column, url_column, "text", "n_chars"])

    kind = pages.schema[id_column].dataType.simpleString()
    return pages.select(id_column, url_column, html_column).mapInArrow(run, f"{id_column} {kind}, {url_column} string, text string, n_chars long")
