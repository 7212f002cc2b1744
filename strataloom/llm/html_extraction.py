"""Main text of web pages by the line-block distribution.

A page is stripped of its markup into lines, one for each block element. Every line weighs the length of its
text outside links; lines inside menus, headers, footers, sidebars, notices, adverts, forms and reader comments
weigh nothing. Where a page marks its articles, their lines gain ``LIFT`` and the others lose all weight. Weights are
summed over sliding windows of ``WINDOW`` lines. A surge point is a line where that sum rises to the threshold
from below, a dive point one where it falls to nothing; what lies between is kept, on every page.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, carried, quoted

#: Lines summed at each position.
WINDOW = 3
#: Characters that a window needs for a surge, and at most this share of the fullest window, so that short pages
#: and articles have a surge too.
SURGE_CHARS, SURGE_SHARE = 86, 0.5
#: What a line gains where its page marks it as part of an article: a window of such lines is a surge.
LIFT = -(-SURGE_CHARS // WINDOW)

NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
STOP = re.compile(r"""["'>]""")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Elements and attribute words.
SKIPPED = frozenset("script style noscript template textarea svg math iframe object embed canvas audio video map select option datalist title head button applet noframes".split())
RAW = frozenset("script style textarea title iframe noframes".split())
BOILER = frozenset("nav header footer aside form menu dialog fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br td th nobr".split())
ARTICLE_ROLES = frozenset("main article".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
BOILER_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar sidebars footer header masthead banner cookie cookies consent gdpr notice notices popup modal overlay "
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus discussion respond replies reply related recommended "
    "recommendations share sharing social newsletter subscribe subscription signup login search pagination pager toolbar widget widgets copyright legal disclaimer aside skip alert".split()
)
# Inside an article only whole names count, and none that its own sections may bear (discussion, menu, legal, share).
INSIDE_WORDS = frozenset(
    "navbar breadcrumb breadcrumbs sidebar sidebars gdpr ad ads advert adverts advertisement advertising sponsor sponsored promo comment comments disqus respond replies reply "
    "related newsletter pagination pager toolbar widget widgets ad-banner ad-container ad-slot ad-unit comment-form comment-list comment-respond comments-area cookie-banner cookie-notice "
    "newsletter-form newsletter-signup post-comments related-articles related-links related-posts share-bar share-buttons social-links social-share".split()
)
# Of these the ones that mark nothing beside words of another kind.
MARKS_ALONE = frozenset({"related"})
# Words that tell what an element is wherever they stand in its name; the others leave a doubt in a longer name.
SURE_WORDS = BOILER_WORDS - frozenset("share sharing social related discussion legal copyright search login signup reply replies notice notices alert aside skip recommended header menu subscription pager toolbar".split())
ARTICLE_WORDS = frozenset("article articlebody post postbody entry story content main maincontent maintext".split())
P_CLOSERS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li dt dd tr figure figcaption details".split())
RIGHTS = re.compile(r"(?:©|\(c\)\s|copyright\s+(?:©|\(c\)|\d{4})|all rights reserved\b\W*$)", re.I)
COMMENTS = re.compile(r"(?:\d+ )?(?:reader )?(?:comments?|kommentare?|commentaires?|comentarios?|leave a (?:reply|comment)|responses|replies)(?: \(\d+\))?:?", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")


CLOSERS = {name: re.compile(rf"</{name}\b", re.I) for name in SKIPPED}


class Line:
    __slots__ = ("article", "around", "boiler", "doubt", "heading", "holder", "listed", "text", "weight")

    def __init__(self, text: str, linked: int, boiler: bool, doubt: bool, article: int, around: int, listed: bool, heading: bool, holder: int):
        self.text, self.boiler, self.doubt, self.article, self.around, self.listed, self.heading, self.holder = text, boiler, doubt, article, around, listed, heading, holder
        self.weight = 0 if boiler else len(text) - linked


def _kind(name: str, attributes: str, inside: int) -> tuple[bool, bool, bool]:
    """Whether an element is boilerplate, whether it is marked as an article, and whether its name leaves a doubt."""
    doubt = False
    boiler, article = name in BOILER and not (name == "header" and inside), name in ("article", "main")
    if attributes:
        words: set[str] = set()
        whole: set[str] = set()
        for key, a, b, c in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), (a or b or c).lower()
            if key in ("class", "id"):
                for token in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", a or b or c).lower().split():
                    whole.add(token)
                    if not (some := set(SPLIT.split(token))) & {"with", "no", "has", "without"}:
                        words |= some
            elif key == "role":
                boiler, article = boiler or value in BOILER_ROLES, article or value in ARTICLE_ROLES
            elif key == "itemprop":
                article = article or value == "articlebody"
                boiler = boiler or value == "comment"
            elif key == "hidden" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                boiler = True
        if name not in ("html", "body"):
            if name not in ("article", "main") and not (inside and name in ("h1", "h2", "header")):
                if whole & MARKS_ALONE and not whole <= INSIDE_WORDS:
                    whole -= MARKS_ALONE  # a section about related work is not a list of related pages
                boiler = boiler or bool(whole & INSIDE_WORDS if inside else whole & (BOILER_WORDS | INSIDE_WORDS) or words & SURE_WORDS)
                doubt = not inside and not boiler and bool(words & BOILER_WORDS)
            elif whole & {"comment", "comments", "reply", "related", "ad", "ads", "sponsored", "promo"}:
                boiler = True
            article = article or bool(words & ARTICLE_WORDS)
    return boiler, article and not boiler, doubt and not article


class Tags:
    """The tags of a page from left to right; each part of it is looked at a fixed number of times.

    Quotes hide a > up to their end. Where that finds no end of a tag up to the end of the page, quotes hide nothing
    from there on, and a < after the last > is text.
    """

    def __init__(self, page: str):
        self.page, self.quotes, self.unclosed = page, True, set[str]()
        self.last = page.rfind(">")

    def end_of(self, at: int) -> int:
        """Place of the > that ends the tag whose name ends at ``at``, or -1."""
        page = self.page
        if at > self.last:
            return -1
        i = at
        while self.quotes and (found := STOP.search(page, i)):
            if found[0] == ">":
                return found.start()
            i = page.find(found[0], found.end()) + 1
            if not i:
                break
        self.quotes = False
        return page.find(">", at)

    def after(self, name: str, at: int) -> int:
        """Place after the closing tag of an element whose content is skipped, or -1."""
        if name in self.unclosed:
            return -1
        found = CLOSERS[name].search(self.page, at)
        if not found:
            self.unclosed.add(name)
            return -1
        end = self.page.find(">", found.end())
        return end + 1 if end >= 0 else len(self.page)

    def next(self, at: int) -> tuple[int, int, str, str] | None:
        """(start, end, name with its slash, attributes) of the next tag from ``at`` on; comments have no name."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            for opened, closed in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                if page.startswith(opened, at):
                    end = page.find(closed, at + len(opened))
                    return at, end + 3 if end >= 0 else len(page), "", ""
            if page.startswith(("<!", "<?"), at) and at < self.last:
                return at, page.find(">", at) + 1, "", ""
            name = NAME.match(page, at + 1)
            if name and (end := self.end_of(name.end())) >= 0:
                return at, end + 1, name[0].lower(), page[name.end() : end]
            at += 1
        return None


class Open:
    """The open elements, and where the last one of each name stands among them."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool, bool]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, name: str, *marks: bool) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if name not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((name, *marks))

    def pop(self) -> tuple[str, bool, bool, bool]:
        top = self.stack.pop()
        self.places[top[0]].pop()
        if top[0] not in INLINE:
            self.blocks.pop()
        return top

    def last(self, *names: str) -> int:
        return max((at[-1] for name in names if (at := self.places.get(name))), default=-1)

    def last_block(self) -> int:
        return self.blocks[-1] if self.blocks else -1


def lines_of(page: str) -> tuple[list[Line], dict[int, int]]:
    """Strip the markup: one line for each run of text between block elements, and where each line's container ends.

    A line's container is the block element around the one that the line is the text of.
    """
    lines: list[Line] = []
    tags, elements = Tags(page), Open()
    pieces: list[str] = []
    linked: list[str] = []
    boilers = doubts = links = lists = forms = titles = 0
    articles: list[tuple[int, bool, int]] = []  # number, whether an article element, number of the container around it
    numbered = opened = 0
    serials: list[int] = []
    ends: dict[int, int] = {}

    def holder() -> int:
        return serials[elements.blocks[-2]] if len(elements.blocks) > 1 else 0

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                whole = boilers > 0 or (forms > 0 and not articles)
                lines.append(Line(text, len(" ".join(entities.unescape(" ".join(linked)).split())), whole, doubts > 0, articles[-1][0] if articles else 0, articles[-1][2] if articles else 0, lists > 0, titles > 0, holder()))
            pieces.clear()
        linked.clear()

    def close(upto: int) -> None:
        nonlocal boilers, doubts, links, lists, forms, titles
        while len(elements.stack) > upto:
            name, boiler, article, doubt = elements.pop()
            ends[serials.pop()] = len(lines)
            boilers -= boiler
            doubts -= doubt
            forms -= name == "form" and not boiler
            titles -= name == "h1"
            if article:
                articles.pop()
            links -= name == "a"
            lists -= name in ("ul", "ol", "menu", "td", "th")

    at, end = 0, len(page)
    while at < end:
        tag = tags.next(at)
        until = tag[0] if tag else end
        if until > at:
            pieces.append(page[at:until])
            if links:
                linked.append(page[at:until])
        if not tag:
            break
        _, at, name, attributes = tag
        if not name:
            continue
        if name[0] == "/":
            name = name[1:]
            if name not in INLINE:
                flush()
            elif name in ("td", "th"):
                pieces.append(" ")
            k = elements.last(name)
            if k >= 0 and (name not in INLINE or k > elements.last_block()):
                close(k)
            continue
        if name in SKIPPED:
            if not attributes.rstrip().endswith("/"):
                over = tags.after(name, at)
                if over >= 0:
                    at = over
                elif name in RAW:
                    at = end
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in ("td", "th"):
            pieces.append(" ")
        if name not in INLINE:
            flush()
            # an open paragraph or item ends here, with what is open in it
            if name in P_CLOSERS and (k := elements.last("p")) >= 0 and k == elements.last_block():
                close(k)
            if name in ("li", "dt", "dd", "tr") and (k := elements.last(name)) > elements.last("ul", "ol", "dl", "table", "menu"):
                close(k)
        if name in VOID or attributes.rstrip().endswith("/"):
            continue
        boiler, article, doubt = _kind(name, attributes, len(articles)) if attributes or name in BOILER or name in ("article", "main") else (False, False, False)
        if name == "form" and not articles and not boilers:
            boiler = False  # a form around the whole page hides no article in it
            forms += 1
        elif name == "form":
            boiler = True
        elements.push(name, boiler, article, doubt)
        opened += 1
        serials.append(opened)
        boilers += boiler
        doubts += doubt
        titles += name == "h1"
        links += name == "a"
        lists += name in ("ul", "ol", "menu", "td", "th")
        if article:
            whole = name == "article"
            if not articles or whole and not articles[-1][1]:  # an article element is more than what marks a page's middle
                numbered += 1
                articles.append((numbered, whole, articles[-1][0] if articles else 0))
            else:
                articles.append(articles[-1])
    flush()
    return lines, ends


def runs(weights: list[int], threshold: float, heads: list[bool], doubts: list[bool]) -> list[tuple[int, int]]:
    """From each surge point to its dive point, as half-open ranges of lines.

    A run reaches back over lines with weight, but not beyond a heading nor to lines in an element of doubtful name.
    """
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    found, i, n = [], 0, len(weights)
    while i < n:
        if sums[i] < threshold or not weights[i]:
            i += 1
            continue
        start = i
        while start and weights[start - 1] and not heads[start] and not doubts[start - 1]:  # lines before the surge that already carry text
            start -= 1
        for k in range(i, min(i + WINDOW, n)):  # a heading within the window of the surge, where what stands before it is none
            if heads[k] and not any(heads[start:k]) and sum(weights[start:k]) < threshold:
                start = k
        while i < n and sums[i]:
            i += 1
        found.append((start, i))
    return found


def between(lines: list[Line], weights: list[int], marked: bool = False) -> list[Line]:
    """The lines between the surge and dive points of these lines: those with weight, and paragraphs that are mostly links.

    Where a page marks its article, what stands in it before a heading is part of it as well.
    """
    top = max((sum(weights[i : i + WINDOW]) for i in range(len(weights))), default=0)
    heads = [line.heading and not marked for line in lines]
    kept = runs(weights, max(1, min(SURGE_CHARS, SURGE_SHARE * top)), heads, [line.doubt for line in lines])
    prose = [not (line.boiler or line.listed or line.doubt or marked or RIGHTS.match(line.text)) and line.weight > 0 for line in lines]
    return [lines[i] for a, b in kept for i in range(a, b) if weights[i] or prose[i]]


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by a blank line; empty if there is none."""
    lines, ends = lines_of(page or "")
    by_article: dict[int, int] = {}
    inner: dict[int, int] = {}
    for line in lines:
        if line.article and not line.boiler:
            by_article[line.article] = by_article.get(line.article, 0) + len(line.text)
            inner[line.around] = inner.get(line.around, 0) + len(line.text)
    # every container counts, but for what only stands around heavier article elements
    marked = {k for k, n in by_article.items() if n > inner.get(k, 0)}
    title = {line.article > 0 for line in lines if line.heading and not line.boiler}
    if len(marked) > 1 and title == {False}:
        marked = set()  # teasers of other articles: the page's title stands outside them
    if marked:
        # each article has surges of its own; boilerplate between its lines, however long, is one line without weight
        of: dict[int, list[int]] = {}
        weights = [0 if line.boiler else line.weight + LIFT for line in lines]
        for i, line in enumerate(lines):
            if line.article in marked:
                mine = of.setdefault(line.article, [])
                if weights[i] or not mine or weights[mine[-1]]:
                    mine.append(i)
        place = {id(line): i for i, line in enumerate(lines)}
        kept = sorted(place[id(line)] for mine in of.values() for line in between([lines[i] for i in mine], [weights[i] for i in mine], True))
        return "\n\n".join(lines[i].text for i in kept)
    weights = [line.weight if line.weight * 2 >= len(line.text) and not RIGHTS.match(line.text) else 0 for line in lines]
    readers = 0
    for i, line in enumerate(lines):
        if i and i >= readers and COMMENTS.fullmatch(line.text):  # what follows in the same container is by readers
            readers = ends.get(line.holder, len(lines))
        if i < readers:
            weights[i], line.boiler = 0, True
    return "\n\n".join(line.text for line in between(lines, weights))


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with text and n_chars (code points) beside its own columns, one row for each of its rows.

    A null, empty or textless page has text "" and n_chars 0. Markup of any length is read whole. Repeated
    rows get equal texts. Columns of ``pages`` named text or n_chars are replaced.
    """

    bounded_batches(pages.sparkSession)

    @F.arrow_udf("string")
    def extracted(page: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py()) for x in page], pa.string())

    own, back = carried(pages, "text", "n_chars")
    found = pages.select(*own, extracted(F.col(quoted(html_col))).alias("text"))
    return found.select(*back, "text", F.char_length("text").cast("long").alias("n_chars"))
