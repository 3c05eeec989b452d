"""Main text of web pages by tag-path ratios.

A page is cut into text blocks, each with its root-to-leaf path of block tags. Text length outside links,
damped by a logarithm, and punctuation are aggregated per path, smoothed over the blocks in page order,
and fused into one score per path, which is taken as a share of the page's median score (weighted by
damped length), so that no single block sets the scale. On a page that names its main text, paths inside
it are moved up and those outside down, by less than the threshold. Paths above the threshold give the content, and
with them the lists, quotes, tables and preformatted texts that stand in an element with chosen text,
unless most of such a part is links. Nothing inside an element for navigation, scripts, controls and the like is
looked at. An element that is named (by class, id or role) after menus, adverts, notices, comments and the like, a form, or
the page's header goes with all its text only if that is the smaller part of what stands around it: names also
occur on wrappers of the whole page, so one that holds the bulk of the text, or the page's article, is an
element like any other. Each page is judged by itself: no shuffle, and a task holds one Arrow batch.

Defined cases: a null or empty page has the empty text. A page cut off anywhere is read as if its open
elements were closed at its end. Rows that repeat are read each for itself. Extra columns are kept; a
column with the result's name is replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
SKIPPED = frozenset(
    "nav footer aside script style noscript template iframe object embed svg math canvas audio video "
    "button select option textarea input label dialog menu head title".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of lists, quotes, tables and preformatted texts, which go with the text around them.
PARTS = frozenset(
    "ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption details summary".split()
)
LISTS = frozenset("ul ol dl figure details".split())
#: Elements that may wrap such a part alone.
WRAPPERS = frozenset("div section center".split())
#: Start tags that end an open element of the given names.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "body": ("head",),
}
#: Elements inside which such a start tag stays.
HOLDS = frozenset("ul ol dl table tbody thead tfoot select".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
# Words in class, id or role that name something other than the main text, or the main text.
OTHER = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|"
    r"newsletter|subscri\w*|sidebar\w*|widgets?|menu\w*|nav|navbar|navigation|breadcrumbs?|toolbar|masthead|footer\w*|"
    r"copyright|comments?|replies|respond|disqus|discussion|shar(?:e|ing)|social|related|recommend\w*|login|signup|"
    r"search|complementary|contentinfo|pagination|tags|skip)(?:$|[\s_-])",
    re.I,
)
# Words that make of such a name a state of the page ("no-sidebar", "comments-open"); it names nothing then.
STATE = re.compile(
    r"(?:^|(?<=\s))(?:(?:no|not|with|without|has|have|hide|hides|show|shows|is)[_-]\S+|"
    r"\S+[_-](?:open|opened|closed|on|off|enabled|disabled|allowed|active|inactive|hidden|visible|none))(?=\s|$)",
    re.I,
)
# Words of names for reader comments, which may be longer than the article.
READERS = re.compile(r"(?:^|[\s_-])(?:comments?|replies|respond|disqus|discussion)(?:$|[\s_-])", re.I)
PAGE_HEADER = re.compile(r"(?:^|[\s_-])(?:header|banner|top)(?:$|[\s_-])", re.I)
MAIN = re.compile(r"(?:^|[\s_-])(?:main|article|content|post|entry|story|body)(?:$|[\s_-])", re.I)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<",
    re.S,
)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_HREF = re.compile(r"(?:^|\s)href\s*=", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、؟¿¡]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

SMOOTHING = (0.25, 0.5, 0.25)
#: Characters of text from which on length is damped.
SCALE = 20
#: Least share of the page's median score.
THRESHOLD = 0.2
#: What the name of the main text adds to the scores of paths inside it, and takes from those outside.
PRIOR = 0.15
#: A list, quote or table with a larger share of text in links does not go with the text around it.
LINKS = 0.5


#: Share of the text around it from which on an element named after something else is kept: in general, if it holds an
#: article or main element, and if it is named after comments.
HELD, HELD_MAIN, HELD_READERS = 0.5, 0.2, 0.9


def _part(name: str, attributes: str, inside_main: bool) -> int:
    """What an element says of its text: -1 other text, -2 named after other text, -3 after readers' comments,
    1 named after the main text, 0 nothing."""
    if name in SKIPPED:
        return -1
    doubt = -2 if name == "form" or (name == "header" and not inside_main) else 0
    if attributes:
        for key, value in _NAMES.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                return -1
            if key == "style":
                if _HIDDEN.search(value):
                    return -1
            elif name not in ("html", "body", "article", "main"):
                value = STATE.sub(" ", value)
                if OTHER.search(value) or (not inside_main and PAGE_HEADER.search(value)):
                    doubt = min(doubt, -3 if READERS.search(value) else -2)
                elif not doubt and MAIN.search(value) and name in ("div", "section", "td"):
                    doubt = 1
    return 1 if name in ("article", "main") else doubt


class Doubt:
    """An element named after something other than the main text: whether after comments, and the number of the
    article or main element around it (0: none)."""

    def __init__(self, readers: bool, scope: int) -> None:
        self.readers, self.scope = readers, scope


def blocks(page: str) -> list[tuple[str, str, bool, bool, int, tuple[tuple[str, int], ...]]]:
    """The blocks that are not marked as other text.

    Each is (path, text, inside the main text, is a heading, characters in links, its elements from the
    root down as (name, number in the page)).
    """
    out: list[tuple[str, str, bool, bool, int, tuple[tuple[str, int], ...]]] = []
    doubts: dict[int, Doubt] = {}
    stack: list[tuple[str, int, int, str, int]] = []  # name, elements of other text, of main text, path, number
    parts: list[str] = []
    linked: list[str] = []
    link = -1  # depth of the stack at which a link was opened
    number = 0

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            inside = len(" ".join("".join(linked).split()))
            parts.clear(), linked.clear()
            if text:
                name, other, main, path, _ = stack[-1] if stack else ("", 0, 0, "", 0)
                if not other:
                    line = tuple((element[0], element[4]) for element in stack)
                    out.append((path, text, main > 0, name in HEADINGS, inside, line))

    def close(names: tuple[str, ...], stop: frozenset[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.match(page, at)
        at = found.end()
        name = found[2] or found[5]
        if not name:
            token = found[0]
            if token[0] != "<" or token == "<":
                parts.append(unescape(token))
                if link >= 0:
                    linked.append(parts[-1])
            continue
        name, closing, attributes = name.lower(), found[1] or found[4], found[3] or found[6] or ""
        if name in INLINE:
            if name in ("br", "wbr", "img"):
                parts.append(" " if name == "br" else "")
            elif not closing and _part(name, attributes, bool(stack and stack[-1][2])) < 0:
                # Other text inside a line: an inline element is looked at only to be left out.
                stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = stop.end() if stop else at
            elif name == "a":
                link = len(stack) if not closing and _HREF.search(attributes) else -1
                linked.append(" ")
            continue
        flush()
        if closing:
            if any(element[0] == name for element in stack):
                close((name,), frozenset())
                link = -1 if len(stack) < link else link
            continue
        if name in RAW:
            if not attributes.rstrip().endswith("/") or name not in ("svg", "math"):
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if name in ENDS_P:
            close(("p",), frozenset(("td", "th", "li", "button", "article", "div", "section")) if name != "p" else frozenset(("td", "th")))
        if name in HEADINGS:
            close(tuple(HEADINGS), frozenset(("td", "th", "div", "article", "section", "li")))
        if name in CLOSES:
            close(CLOSES[name], HOLDS)
        if name in VOID:
            continue
        link = -1 if len(stack) < link else link
        _, other, main, path, _ = stack[-1] if stack else ("", 0, 0, "", 0)
        part = _part(name, attributes, main > 0)
        number += 1
        if part < -1:
            doubts[number] = Doubt(part == -3, next((i for n, _, _, _, i in reversed(stack) if n in ("article", "main")), 0))
        stack.append((name, other + (part == -1), main + (part > 0), f"{path}/{name}", number))
    flush()
    return _without(out, doubts) if doubts else out


def _without(found: list, doubts: dict[int, Doubt]) -> list:
    """``found`` less what lies in elements named after other text that do not hold the bulk of the text around them."""
    plain = [max(len(block[1]) - block[4], 0) for block in found]
    inside = {i: 0 for i in doubts}  # text of the element
    mains = dict.fromkeys(doubts, 0)  # of it in article and main elements inside
    around = {0: 0}  # text of the page, and of each article or main element
    articles = 0
    for block, size in zip(found, plain, strict=True):
        own = [i for name, i in block[5] if name in ("article", "main")]
        around[0] += size
        articles += size * bool(own)
        for i in own:
            around[i] = around.get(i, 0) + size
        for _, i in block[5]:
            if i in doubts:
                inside[i] += size
                mains[i] += size * any(main > i for main in own)
    gone = set()
    for i, doubt in doubts.items():
        whole = around.get(doubt.scope, 0)
        rival = 0 if doubt.scope else articles - mains[i]
        if not whole or (rival >= HELD_MAIN * whole and not mains[i]):
            gone.add(i)
            continue
        least = HELD_READERS if doubt.readers else HELD_MAIN if mains[i] else HELD
        if inside[i] < least * whole:
            gone.add(i)
    return [block for block in found if not any(i in gone for _, i in block[5])]


def _beside(found: list, chosen: np.ndarray, length: np.ndarray, plain: np.ndarray) -> None:
    """Adds to ``chosen`` the lists, quotes, tables and preformatted texts that stand beside chosen text."""
    holds, tables, loose = set(), set(), set()  # numbers of elements: of chosen text, of text outside such parts
    for block, keep in zip(found, chosen, strict=True):
        if block[3]:
            continue
        line = [(name, i) for name, i in block[5] if name != "p"]
        if keep:
            holds.add(line[-1][1] if line else 0)
        for name, i in reversed(line):
            if name not in PARTS:
                break
            if keep and name in LISTS:
                holds.add(i)
            if keep and name == "table":
                tables.add(i)
                break
        for name, i in reversed(line):
            if name in PARTS:
                break
            loose.add(i)
    parts: dict[int, list[int]] = {}
    for k, block in enumerate(found):
        outer, line = None, [(name, i) for name, i in block[5] if name != "p" and name not in HEADINGS]
        labels = bool(line) and line[-1][0] in ("th", "caption")
        for at in range(len(line) - 1, -1, -1):
            name, i = line[at]
            if name not in PARTS and (name not in WRAPPERS or i in loose):
                break
            above = line[at - 1][1] if at else 0
            if above in holds or (labels and above in tables):
                outer = i
        if outer is not None:
            parts.setdefault(outer, []).append(k)
    for places in parts.values():
        if plain[places].sum() >= (1 - LINKS) * length[places].sum():
            chosen[places] = True


def content(page: str | None) -> str:
    """The blocks whose paths pass the threshold, in page order, two line feeds between them."""
    found = blocks(page or "")
    if not found:
        return ""
    paths: dict[str, list[int]] = {}
    for i, block in enumerate(found):
        paths.setdefault(block[0], []).append(i)
    length = np.array([len(block[1]) for block in found], float)
    plain = np.maximum(length - [block[4] for block in found], 0)
    if not plain.any():
        plain = length  # a page of links only
    marks = np.array([len(_PUNCTUATION.findall(block[1])) for block in found], float)

    def ratio(values: np.ndarray) -> np.ndarray:
        """The path's mean, for each of its blocks."""
        out = np.empty(len(found))
        for places in paths.values():
            out[places] = values[places].mean()
        return out

    def smooth(values: np.ndarray) -> np.ndarray:
        padded = np.concatenate([values[:1], values, values[-1:]])
        return sum(w * padded[k : k + len(values)] for k, w in enumerate(SMOOTHING))

    damped = np.log1p(plain / SCALE)
    own = ratio(damped)
    marked = np.log1p(smooth(100 * ratio(marks) / (ratio(length) + SCALE)))
    score = ratio(np.sqrt(own * smooth(own)) * (1 + marked))  # text and punctuation, fused
    order = np.argsort(score, kind="stable")
    heavy = np.cumsum(damped[order])
    score /= score[order][np.searchsorted(heavy, heavy[-1] / 2)]
    main = np.array([block[2] for block in found], float)
    if main.any():
        score += PRIOR * (2 * ratio(main) - 1)  # up inside a named main text, down outside
    chosen = score >= THRESHOLD
    _beside(found, chosen, length, plain)
    # A heading leads the block after it, and stays with it; that of a named main text leads all of it.
    for i in range(len(found) - 2, -1, -1):
        if found[i][3]:
            first = main[i] and found[i][0].endswith("/h1")
            chosen[i] = chosen[i] or (chosen[i + 1 :].any() if first else chosen[i + 1])
    return "\n\n".join(block[1] for block, keep in zip(found, chosen, strict=True) if keep)


def extract(pages: DataFrame, html: str = "html", into: str = "main_text") -> DataFrame:
    """``pages`` with the main text of ``html`` as ``into``."""

    @F.arrow_udf("string")
    def main_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([content(value.as_py()) for value in batch], pa.string())

    return pages.withColumn(into, main_text(F.col(html)))
