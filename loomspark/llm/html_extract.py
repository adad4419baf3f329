"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one for each block of text; scripts, styles,
comments, forms and elements whose tag, role, class or id names boilerplate are
left out. Lengths of text outside links are summed over a sliding window of
lines; a region begins where the sum surges and ends where it dives. The
heaviest region is the page's core. The text goes from the first to the last
line that surges within the smallest container of the whole core, whatever that
container's tag, and on over plain lines at both ends (headings, lists, short
last sentences) that stand in a container with a surge, as these are often too
short to surge. A container beside without a surge stays out, but for a heading
before the text. A name counts as boilerplate's only as a word of its own at the
end or start of a class or id; an element so named that holds by far the most
text (a form or notice around the whole page) is opened after all.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm.arrow import with_columns

WINDOW = 3
SURGE = 60  # characters of text in a window that begin a region
GAP = 2  # quiet windows that a region may hold

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW = {t: re.compile(rf"</{t}\s*[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "xmp", "noembed", "noframes", "select")}
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr picture source".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_DROP = set("nav header footer aside form menu dialog button fieldset head object embed applet canvas map audio video".split())
_NAMES = (
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|menu\w*|nav\w*|breadcrumbs?|header|masthead|footer|sidebar|aside|widgets?|"
    r"cookies?|cookiebar|consent|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|sharebar|socials?|related|recommend\w*|"
    r"comments?|commentlist|disqus\w*|respond|replies|pagination|pager|toolbar|skip|skiplinks?|copyright|legal|disclaimer|form|search|searchform|searchbox|tags"
)
_NAMED = re.compile(rf"(?:{_NAMES})", re.I)
# What may stand before a name in a class or id without its meaning the element itself.
_ABOUT = set("has no not with without is hide show category categories tag topic subject type format term".split())
_OWN_HEADER = set("entry article post story content page".split())
# What may follow a name in an id; ids are also made of headings ("search-algorithms").
_SORT = re.compile(r"(?:\d+|area|bar|block|body|bottom|box|button|buttons|column|container|content|feed|footer|form|group|header|holder|icons|inner|items?|left|links?|list|main|menu|nav|outer|panel|posts|primary|right|row|secondary|section|slot|text|thread|title|top|unit|widgets?|wrap|wrapper)", re.I)
# Boilerplate however much text it holds.
_NEVER = set("nav footer aside menu button head object embed applet canvas map audio video".split())
_READERS = re.compile(r"comment|disqus|respond|replies|nav|menu|footer|cookie|consent", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
_CORE = {"article", "main"}
# Parts of a text rather than containers of one.
_PART = _INLINE | set("p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd table caption thead tbody tfoot tr pre blockquote figure figcaption address details summary center".split())
_ROOT = {"", "html", "body"}
_HEADINGS = {"h1", "h2", "hgroup"}
OPENED, SPARE = 4, 3  # a named element is opened for so many times the text found without, up to so many in one another


def names_boilerplate(value: str, is_id: bool) -> bool:
    """Whether a class or id has a token that names boilerplate by its last word or its first one.

    A first word of an id needs a word for a part of a page behind it, and a last
    one mustn't be told of something else ("has-sidebar", "category-legal").
    """
    for token in value.split():
        words = [w for w in re.split(r"[-_]+", token) if w]
        if not words or words[0].lower() in _ABOUT:
            continue
        if _NAMED.fullmatch(words[-1]):
            if not (len(words) > 1 and words[-1].lower() == "header" and words[0].lower() in _OWN_HEADER):
                return True
        elif len(words) > 1 and _NAMED.fullmatch(words[0]) and (not is_id or _SORT.fullmatch(words[1])):
            return True
    return False


class _Lines:
    """Blocks of text in page order, the characters outside links, and the element each stands in.

    ``spare`` is how many elements named or shaped as boilerplate may be open
    around a text that still counts; some sorts never are.
    """

    def __init__(self, page: str, spare: int = 0):
        self.spare = spare
        self.text: list[str] = []
        self.weight: list[int] = []
        self.home: list[int] = []  # the element other than an inline one that each line stands in
        self.tags, self.parent = [""], [0]  # of each such element, the page itself first
        self._open: list[tuple[str, int, bool]] = []  # tag, dropped (2: whatever is spared), article or main
        self.left_out = 0  # characters left out that a larger ``spare`` may let in
        self._homes = [0]  # of each open element, after the page
        self._articles = self._dropped = self._barred = self._links = 0
        self._now: list[str] = []
        self._plain = 0
        at = 0
        while m := _TOKEN.search(page, at):
            if m.start() > at:
                self._data(page[at : m.start()])
            at = m.end()
            if not m[2]:
                if m[0].startswith("<![CDATA["):
                    self._data(m[0][9:].removesuffix("]]>"))
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(tag)
            elif tag in _RAW:
                self._break(tag)
                if not m[3].endswith("/"):
                    end = _RAW[tag].search(page, at)
                    at = end.end() if end else len(page)
            else:
                self._start(tag, m[3])
        self._data(page[at:])
        self._flush()

    def _data(self, s: str) -> None:
        if self._dropped <= self.spare and not self._barred:
            self._now.append(s)
            if not self._links:
                self._plain += len(s)
        elif not self._barred:
            self.left_out += len(s)

    def _flush(self) -> None:
        if self._now:
            line = " ".join(html.unescape("".join(self._now)).split())
            if line:
                self.text.append(line)
                self.weight.append(min(self._plain, len(line)))
                self.home.append(self._homes[-1])
        self._now, self._plain = [], 0

    def _break(self, tag: str) -> None:
        if tag == "br":
            self._data(" ")
        elif tag not in _INLINE:
            self._flush()

    def _start(self, tag: str, attributes: str) -> None:
        self._break(tag)
        if tag in _VOID:
            return
        if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):  # their ends may be left out
            for k in range(len(self._open) - 1, -1, -1):
                if self._open[k][0] == tag:
                    self._pop(k)
                    break
                if self._open[k][0] not in _INLINE | {"p", "td", "th"}:
                    break
        core = tag in _CORE
        drop = 2 if tag in _NEVER else int(tag in _DROP)
        own = tag == "header" and self._articles > 0  # an article's own heading
        if own:
            drop = 0
        if attributes and tag not in ("html", "body"):
            for m in _ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                    drop = 2
                elif name == "role" and value.lower() in _ROLES and not core:
                    drop = max(drop, 1 if value.lower() in ("form", "dialog", "alert") else 2)
                elif name in ("class", "id", "itemprop") and core and re.search(r"(?:^|[\s_-])comment", value, re.I):
                    drop, core = 2, False
                elif name in ("class", "id", "itemprop") and not core and not own and names_boilerplate(value, name == "id"):
                    drop = max(drop, 2 if _READERS.search(value) else 1)
        self._open.append((tag, drop, core))
        if tag not in _INLINE:
            self.tags.append(tag)
            self.parent.append(self._homes[-1])
        self._homes.append(self._homes[-1] if tag in _INLINE else len(self.tags) - 1)
        self._dropped += drop == 1
        self._barred += drop == 2
        self._links += tag == "a"
        self._articles += core

    def _close(self, tag: str) -> None:
        self._break(tag)
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] == tag:
                self._pop(k)
                return
            if tag in _INLINE and self._open[k][0] not in _INLINE:
                return

    def _pop(self, k: int) -> None:
        for tag, drop, core in reversed(self._open[k:]):
            self._articles -= core
            self._dropped -= drop == 1
            self._barred -= drop == 2
            self._links -= tag == "a"
        del self._open[k:], self._homes[k + 1 :]


def surges(weight: list[int]) -> tuple[list[bool], tuple[int, int]]:
    """Lines that surge, and first and one past the last line of the heaviest region."""
    n = len(weight)
    sums = [sum(weight[max(0, k - WINDOW // 2) : k + WINDOW // 2 + 1]) for k in range(n)]
    limit = min(SURGE, max(sums, default=0))
    best, k = (0, 0, 0), 0
    while k < n:
        if sums[k] < limit:
            k += 1
            continue
        end = last = k + 1
        while end < n and end - last < GAP:
            end += 1
            if sums[end - 1] >= limit:
                last = end
        mass = sum(weight[k:last])
        best = max(best, (mass, -k, last))
        k = last
    own = [x >= limit and w * WINDOW >= limit for x, w in zip(sums, weight, strict=True)]  # windows reach over a region's ends
    first, last = -best[1], best[2]
    while first < last and not own[first]:
        first += 1
    while last > first and not own[last - 1]:
        last -= 1
    return own, ((first, last) if last > first else (-best[1], best[2]))


def _around(lines: _Lines, own: list[bool], first: int, last: int) -> list[str]:
    """Lines of the article that the region from ``first`` to ``last`` belongs to."""
    tags, parent = lines.tags, lines.parent
    box, held, count = [], [0] * len(tags), [0] * len(tags)  # the container of each line, and what surges in it
    for k, c in enumerate(lines.home):
        while tags[c] in _PART:
            c = parent[c]
        box.append(c)
        held[c] += lines.weight[k] if own[k] else 0
        count[c] += 1
    blocks = [0] * len(tags)  # containers of one heavy line in each element: paragraphs
    for c in set(box):
        blocks[parent[c]] += count[c] == 1 and held[c] >= SURGE

    def light(c: int) -> bool:
        """Whether windows only reach into a container from beside; a short block among paragraphs isn't one."""
        return held[c] < SURGE and not (count[c] == 1 and blocks[parent[c]] > 1)

    while last - first > 1 and light(box[last - 1]) and box[last - 1] != box[first]:
        last -= 1
    while last - first > 1 and light(box[first]) and box[first] != box[last - 1]:
        first += 1
    top = lines.home[first]
    for c in lines.home[first + 1 : last]:  # an element's number is above its parent's
        while c != top:
            if c > top:
                c = parent[c]
            else:
                top = parent[top]
    if last - first == 1 and tags[top] not in _ROOT and tags[parent[top]] not in _ROOT:
        top = parent[top]  # a line's own element
    while tags[top] in _PART:
        top = parent[top]
    inside = [False] * len(tags)
    for c in range(len(tags)):
        inside[c] = c == top or (c > 0 and inside[parent[c]])
    # Containers that hold a surge, and whether a line stands in one of them rather than in one beside.
    surging, core = {top}, range(first, last)
    for k, c in enumerate(lines.home):
        if own[k] and inside[c] and (k in core or box[k] == top or not light(box[k])):
            first, last = min(first, k), max(last, k + 1)
            while c not in surging:
                surging.add(c)
                c = parent[c]

    def belongs(k: int) -> bool:
        c = lines.home[k]
        if not inside[c] or lines.weight[k] * 2 < len(lines.text[k]):
            return False
        while c not in surging and (tags[c] in _PART or (tags[c] in ("td", "th") and count[c] == 1)):  # cells of data, not of a layout
            heading = k < first and tags[c] in _HEADINGS
            c = parent[c]
            while heading and c not in surging and c != top:  # a title often has a box of its own before the text
                c = parent[c]
        return c in surging or (c == box[k] and not light(c) and parent[c] in surging)

    if tags[top] in _ROOT:
        while first and belongs(first - 1):
            first -= 1
        while last < len(own) and belongs(last):
            last += 1
    else:
        plain = [k for k in range(len(own)) if belongs(k)]
        first, last = min([first, *plain]), max([last, *(k + 1 for k in plain)])
    kept = [k for k in range(first, last) if inside[lines.home[k]]]
    titled = any(tags[lines.home[k]] == "h1" for k in kept)
    if not titled and first and tags[lines.home[first - 1]] == "h1":  # in a container before the text's
        kept.insert(0, first - 1)
    return [lines.text[k] for k in kept]


def main_text(page: str | None) -> str:
    """Blocks of the page's article joined by a newline; empty if there are none."""
    if not page:
        return ""
    found = _core(page, 0)
    for spare in range(1, SPARE + 1):
        if found[0].left_out <= OPENED * _mass(found) + SURGE:
            break
        more = _core(page, spare)
        if _mass(more) > OPENED * _mass(found) + SURGE:
            found = more
    lines, own, (first, last) = found
    return "\n".join(_around(lines, own, first, last)) if lines.text else ""


def _core(page: str, spare: int) -> tuple[_Lines, list[bool], tuple[int, int]]:
    lines = _Lines(page, spare)
    return (lines, *surges(lines.weight))


def _mass(found: tuple[_Lines, list[bool], tuple[int, int]]) -> int:
    lines, _, (first, last) = found
    return sum(lines.weight[first:last])


def extract(pages: DataFrame, page: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text of each page ("" for null or empty html).

    Every page is read whole. An input column named text is replaced.
    """

    def run(batch: pa.RecordBatch) -> list:
        return [[main_text(h) for h in batch.column(page).to_pylist()]]

    return with_columns(pages, run, [T.StructField("text", T.StringType())])


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
