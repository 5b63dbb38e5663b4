"""Op 12: the main text of web pages, by scores on the tree of containers.

A page is read once into its tree of block elements and the blocks of text between their borders. Menus, headers, footers,
sidebars, notices, adverts, forms, comments and what else is no article by its element, role or class goes; then each
block passes points, for its length and its commas, to its container and in falling shares to the containers around it.
The container with the most points, discounted by the share of its text that is in links, is the article, or the
``article`` or ``main`` element that holds it; siblings with a fair share of its points are kept beside it. Lists and
boxes of links inside it go.

Defined cases: a null or empty page has an empty text, and so has one whose text is all left out; a page without any block
long enough for points is taken by its ``article`` or ``main`` element, else whole; a page that only holds boxes with
names of menus and the like keeps them; equal scores go to the first container;
markup that ends in the middle of a tag or a comment ends there, elements may be left open or closed in any order, and
depth and length are not limited (one pass, no recursion); repeated rows give equal results; extra columns, of any name,
pass through, but for those of the operator's own names.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import blocks, shielded, table

#: Code points from which a block gives points; how far up they go; share of the best score that a sibling needs.
LEAST_BLOCK, LEVELS, SIBLING = 25, 5, 0.2
#: A box of this many links or more, whose text is in links by more than this share, is a menu.
MENU_LINKS, MENU_SHARE = 3, 0.66
OUTPUT = [T.StructField("__mt_text", T.StringType()), T.StructField("__mt_container", T.StringType())]

# Names of elements.
BLOCKS = frozenset(
    "address article aside blockquote body caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
#: Inline or not, these never hold text of an article.
SILENT = frozenset("applet audio button canvas datalist map meter noscript object optgroup option output progress select svg template video".split())
BOXES = frozenset("article aside body div fieldset footer form header main nav section table td th ul ol dl menu details".split())
LISTS = frozenset("ul ol dl menu dir div section table nav td".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: An open element of the first name ends where one of these starts, unless one of the last names was opened since.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
# Words of class and id. The first are left out wherever they stand, the others unless they hold the article.
NEVER = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox adbanner sponsor sponsored sponsors promo promos promotion promoted "
    "cookie cookies consent gdpr comment comments commentlist disqus respond reply replies discussion popup modal newsletter related recommended recommendations "
    "teaser teasers outbrain taboola paywall".split()
)
SELDOM = frozenset(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars rail header masthead topbar footer colophon copyright notice notices notification "
    "notifications alert alerts disclaimer banner banners overlay subscribe subscription signup login signin register search share sharing sharebar social trending popular "
    "pagination pager paging toolbar widget widgets skip".split()
)
HIDDEN = frozenset(("sr-only", "visually-hidden", "screen-reader-text", "d-none", "hidden"))
WITHOUT = frozenset(("has", "with", "no", "without", "not"))
COMMAS = re.compile("[,;،、，；]")

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*|(?=>))))?)""")
_COMMENT_END = re.compile(r"--!?>")
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
KEPT, WEAK, GONE, HEADER, FORM = range(5)


def _rest_of_tag(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from ``at`` on, and where the tag ends; -1 if the page ends first."""
    end = page.find(">", at)
    if end < 0:
        return {}, -1
    if end == at or page[at:end].isspace() or page[at:end] == "/":
        return {}, end + 1
    found: dict[str, str] = {}
    while m := _ATTRIBUTE.match(page, at):
        at = m.end()
        if m[1]:
            return found, at
        if at < len(page) and page[at] == "=":
            # A value whose quotation mark is never closed takes the rest of the page.
            return found, -1
        found.setdefault(m[2].lower(), unescape(m[3] or m[4] or m[5] or ""))
    return found, -1


def _kind(name: str, attributes: dict[str, str]) -> int:
    """What an element is by its name, role, class and id: kept, gone, gone unless it holds the article, or a header."""
    if name in ("nav", "aside", "footer", "search", "menu", "dialog"):
        return GONE
    if attributes:
        if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
            return GONE
        if "style" in attributes and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes["style"], re.I):
            return GONE
        if name in ("html", "body", "main"):
            return KEPT
        if attributes.get("role", "").lower() in ROLES:
            return WEAK
        named = f"{attributes.get('class', '')} {attributes.get('id', '')}"
        if not HIDDEN.isdisjoint(named.split()):
            return GONE
        found = KEPT
        for one in named.split():
            words = [w.lower() for w in _WORD.findall(one)]
            for k, word in enumerate(words):
                if k and words[k - 1] in WITHOUT:
                    continue
                if word in NEVER:
                    return GONE
                if word in SELDOM:
                    found = HEADER if word == "header" and found == KEPT else WEAK
        if found:
            return found
    if name == "header":
        return HEADER
    return FORM if name in ("form", "fieldset") else KEPT


class Page:
    """Block elements in page order (name, container, last element inside, kind) and the blocks of text between their borders."""

    def __init__(self, page: str):
        self.names, self.up, self.kinds, self.last = ["body"], [-1], [KEPT], [0]
        self.links = [0]
        self.main = [False]
        #: Each block: its element, its text, and how many of its code points are in links.
        self.blocks: list[tuple[int, str, int]] = []
        self._parts: list[str] = []
        self._linked: list[str] = []
        self._read(page)

    def _flush(self, owner: int) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self.blocks.append((owner, text, min(len(text), len(" ".join("".join(self._linked).split())))))
            self._parts, self._linked = [], []

    def _read(self, page: str) -> None:
        # Open elements: names and numbers (-1: inline); where each name stands among them; where the blocks do.
        stack, numbers = ["body"], [0]
        places: dict[str, list[int]] = {"body": [0]}
        block_places = [0]
        silent: list[int] = []  # places of open elements without text

        def close_to(place: int) -> None:
            while len(stack) > place:
                name, number = stack.pop(), numbers.pop()
                places[name].pop()
                if silent and silent[-1] == len(stack):
                    silent.pop()
                if number >= 0:
                    self._flush(number)
                    block_places.pop()
                    self.last[number] = len(self.names) - 1

        def top(name: str) -> int:
            own = places.get(name)
            return own[-1] if own else -1

        at, n = 0, len(page)
        while at < n:
            tag = page.find("<", at)
            if tag != at:
                text = page[at : tag if tag >= 0 else n]
                if not silent:
                    text = unescape(text) if "&" in text else text
                    self._parts.append(text)
                    if places.get("a"):
                        self._linked.append(text)
                if tag < 0:
                    break
            at = tag + 1
            mark = page[at : at + 1]
            if mark == "!" or mark == "?":
                if page.startswith("!--", at):
                    m = _COMMENT_END.search(page, at + 1)  # <!--> is a comment too
                    at = m.end() if m else n
                else:
                    at = page.find(">", at) + 1 or n
                continue
            closing = mark == "/"
            m = _NAME.match(page, at + closing)
            if not m:
                if closing and page[at + 1 : at + 2]:
                    at = page.find(">", at) + 1 or n
                elif not silent:
                    self._parts.append("<")
                continue
            name = m[0].lower()
            attributes, at = _rest_of_tag(page, m.end())
            if at < 0:
                break
            if closing:
                place = top(name)
                if place <= 0:
                    if name in BLOCKS:
                        self._flush(numbers[block_places[-1]])
                    elif name == "br":
                        self._parts.append(" ")
                elif name in BLOCKS or name in SILENT:
                    # A cell holds what is open in it, and the end of an outer element does not reach inside a table's.
                    if name in ("table", "tr", "td", "th", "tbody", "thead", "tfoot") or place > max(top("td"), top("th")):
                        close_to(place)
                elif place > block_places[-1]:
                    close_to(place)
                continue
            if name in RAW:
                m = _RAW_END[name].search(page, at)
                at = m.start() if m else n
                if m:
                    at = page.find(">", at) + 1 or n
                continue
            if name == "br":
                self._parts.append(" ")
                continue
            if name in ("body", "html", "head"):
                continue
            if name in BLOCKS:
                if top("p") > max(top("td"), top("th"), top("caption")):
                    close_to(top("p"))
                ends, holds = IMPLIED.get(name, ((), ()))
                if ends:
                    inner = max(top(e) for e in ends)
                    if inner > max(top(h) for h in holds):
                        close_to(inner)
                if name in HEADINGS and stack[-1] in HEADINGS:
                    close_to(len(stack) - 1)
                self._flush(numbers[block_places[-1]])
                if name in VOID:
                    continue
                number = len(self.names)
                self.names.append(name)
                self.up.append(numbers[block_places[-1]])
                self.kinds.append(_kind(name, attributes))
                self.last.append(number)
                self.links.append(0)
                self.main.append(name in ("article", "main") or attributes.get("role", "").lower() in ("main", "article") or attributes.get("itemprop", "").lower() == "articlebody")
                block_places.append(len(stack))
            else:
                if name in VOID:
                    continue
                number = -1
                if name == "a":
                    if top("a") > block_places[-1]:
                        close_to(top("a"))
                    if "href" in attributes and not silent:
                        self.links[numbers[block_places[-1]]] += 1
                if name in SILENT or (attributes and _kind(name, attributes) == GONE):
                    silent.append(len(stack))
            places.setdefault(name, []).append(len(stack))
            stack.append(name)
            numbers.append(number)
        self._flush(numbers[block_places[-1]])
        close_to(0)

    def _gone(self, all_weak: bool) -> list[bool]:
        """Which elements are left out; headings of a header inside an article stay, and a form that holds most of the page."""
        n = len(self.names)
        size = [0] * n
        for owner, text, _ in self.blocks:
            size[owner] += len(text)
        for k in range(n - 1, 0, -1):
            size[self.up[k]] += size[k]
        holds, inside = [False] * n, [False] * n
        for k in range(n - 1, 0, -1):
            # An article of comments or adverts is not what makes its container worth keeping.
            if (self.main[k] and self.kinds[k] == KEPT) or (holds[k] and self.kinds[k] != GONE):
                holds[self.up[k]] = True
        gone, heads = [False] * n, [False] * n
        for k in range(1, n):
            up, kind = self.up[k], self.kinds[k]
            inside[k] = self.main[k] or inside[up]
            gone[k], heads[k] = gone[up], heads[up]
            if kind == FORM and 2 * size[k] > size[0]:
                kind = KEPT
            if kind == GONE or (kind != KEPT and not holds[k] and (all_weak or kind == HEADER)):
                if not gone[k] and kind == HEADER and inside[k]:
                    heads[k] = True
                else:
                    heads[k] = False
                gone[k] = True
            if heads[k] and self.names[k] in HEADINGS and kind == KEPT:
                gone[k] = heads[k] = False
        return gone

    def main_text(self) -> tuple[str, str]:
        """The text of the best container and its siblings, one block a line, and the container's element."""
        n = len(self.names)
        for all_weak in (True, False):
            # Where nothing is left, a name that may stand for less takes nothing away.
            gone = self._gone(all_weak)
            kept = [b for b in self.blocks if not gone[b[0]]]
            if kept:
                break
        else:
            return "", ""
        size, linked, links = [0] * n, [0] * n, [0 if gone[k] else x for k, x in enumerate(self.links)]
        points = [0.0] * n
        for owner, text, in_links in kept:
            size[owner] += len(text)
            linked[owner] += in_links
            if len(text) >= LEAST_BLOCK:
                given = (1 + len(COMMAS.findall(text)) + len(text) / 100) * (1 - in_links / len(text))
                to = owner if self.names[owner] in BOXES else self.up[owner]
                for level in range(1, LEVELS + 1):
                    if to < 0:
                        break
                    points[to] += given / level
                    to = self.up[to]
        for k in range(n - 1, 0, -1):
            size[self.up[k]] += size[k]
            linked[self.up[k]] += linked[k]
            links[self.up[k]] += links[k]
        score = [p * (1 - linked[k] / size[k]) if p and size[k] else 0.0 for k, p in enumerate(points)]
        best = max(range(n), key=lambda k: (score[k], -k))
        if not score[best]:
            best = max((k for k in range(n) if self.main[k] and not gone[k]), key=lambda k: (size[k], -k), default=0)
        chosen = best
        while chosen >= 0 and not self.main[chosen]:
            chosen = self.up[chosen]
        chosen = best if chosen < 0 else chosen
        kept_in = [chosen]
        if chosen and score[best]:
            share = SIBLING * max(score[best], score[chosen])
            up = self.up[chosen]
            k = up + 1
            while k <= self.last[up]:
                if k != chosen and not gone[k] and size[k]:
                    dense = linked[k] / size[k]
                    paragraph = not self.main[chosen] and (size[k] >= 80 and dense < 0.25 and self.names[k] not in BOXES or dense == 0 and self.names[k] in HEADINGS)
                    if (score[k] >= share and dense < 0.33) or paragraph:
                        kept_in.append(k)
                k = self.last[k] + 1
        menu = [False] * n
        allowed = [False] * n
        for k in kept_in:
            allowed[k] = True
        for k in range(n):
            up = self.up[k]
            if up >= 0:
                allowed[k] = allowed[k] or allowed[up]
                menu[k] = menu[up]
            if allowed[k] and k not in (chosen, best) and self.names[k] in LISTS and links[k] >= MENU_LINKS and linked[k] > MENU_SHARE * size[k]:
                menu[k] = True
        return "\n".join(text for owner, text, _ in kept if allowed[owner] and not menu[owner]), self.names[chosen]


def main_text(page: str | None) -> tuple[str, str]:
    """The main text of a page and the element that holds it; both empty if there is none."""
    return Page(page).main_text() if page else ("", "")


def _with_text(names: list[str]):
    def with_text(batches):
        for batch in batches:
            for part in blocks(batch, "html"):
                found = [main_text(page.as_py()) for page in part.column("html")]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([f[k] for f in found], pa.string()) for k in (0, 1))], names + [f.name for f in OUTPUT])

    return with_text


def extract(pages: DataFrame) -> DataFrame:
    """The columns of pages, __mt_text and __mt_container, from the markup in html."""
    added = [f.name for f in OUTPUT]
    pages = pages.drop(*added)
    safe, names = shielded(pages, "html")
    return safe.mapInArrow(_with_text(names), T.StructType(safe.schema.fields + OUTPUT)).toDF(*pages.columns, *added)


def op12_main_text(spark, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("__mt_text").alias("text"), F.char_length("__mt_text").cast("long").alias("n_chars"))
