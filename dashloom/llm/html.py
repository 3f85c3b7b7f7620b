"""Main text of web pages: flat blocks, classified by a decision tree over them and their neighbours."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .fit import Tree
from .words import small

# Element names of HTML.
_RAW = {"script", "style", "textarea", "title", "iframe"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header",
    "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "button", "xmp",
}
_AROUND = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", "fieldset", "noscript"}
_ARTICLE = {"article", "main"}
_NESTED = {"template", "svg", "object", "canvas", "annotation", "annotation-xml"}  # dropped with all in them; one left open holds nothing
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_TEXT = {"p", "li", "dt", "dd", "td", "th", "tr", "blockquote", "pre", "figure", "figcaption", "caption", "xmp"}
#: Words in a class or role that name what stands around an article, as a part of a longer name too.
_SURE = (r"ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|popup|modal|overlay|nav\w*|menu\w*|breadcrumb\w*|"
         r"sidebar\w*|aside|footer\w*|masthead|topbar|toolbar|pagination|pager|comment\w*|disqus|recommend\w*|sharing|subscribe|"
         r"newsletter|signup|widget\w*|contentinfo|complementary|navigation|copyright|teasers?|outbrain|taboola")
#: Words that an article's own parts bear as well: they count as a whole name, with words of _WITH at most.
_UNSURE = r"related|share|social|search|legal|notices?|header|side|hidden|alert|reply|replies|respond|login|banner|more|most"
#: Such words of which ids and sections are full; they count in the class of other elements only.
_LOOSE = r"discussions?|feedback|popular|trending|responses|talkback"
#: Those of all these that name a text of its own, never the frame of a page.
_OWN_WORDS = (r"ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notices?|breadcrumb\w*|pagination|pager|comment\w*|"
              r"disqus|reply|replies|respond|related|recommend\w*|share|sharing|social|subscribe|newsletter|login|signup|alert|legal|"
              r"copyright|teasers?|outbrain|taboola|more|most|" + _LOOSE)
_PLACES = r"main|top|site|page|primary|secondary|global|mobile|left|right|bottom|post|article|user|reader|blog|google|block"
_WITH = (r"posts?|articles?|links?|stories|story|news|items?|list|box|bar|block|section|area|container|wrapper|wrap|inner|panel|content|"
         r"buttons?|icons?|form|notice|message|banner|popup|consent|policy|text|count|feed|threads?|replies|unit|slot|top|bottom|left|"
         r"right|read|from|media|results?|\d+")
_PART_OF = re.compile(rf"(?:^|[_-])(?:{_SURE})(?=$|[_-])", re.I)


def _whole(words: str) -> re.Pattern:
    return re.compile(rf"(?:(?:{_PLACES})[_-])*(?:{words})(?:[_-](?:{_WITH}))*", re.I)


_NAME, _ID, _OWN, _OWN_CLASS = _whole(f"{_SURE}|{_UNSURE}|{_LOOSE}"), _whole(f"{_SURE}|{_UNSURE}"), _whole(_OWN_WORDS), re.compile(rf"(?:^|[_-])(?:{_OWN_WORDS})(?=$|[_-])", re.I)
_MORE = re.compile(r"(?:.*[_-])?(?:more|most)", re.I)  # nothing without what it is more of
#: Names that say how a page is laid out, the last ones only beside the name of a frame.
_MODIFIER = re.compile(r"(?:has|no|with|without)[_-].*", re.I)
_FRAME = re.compile(r"layout|wrapper|wrap|container|site|page|content", re.I)
_PLACE = re.compile(r"(?:fixed|sticky)[_-].*|.*[_-](?:left|right)", re.I)
#: What marks an element, by what it takes to show that it is the frame of an article after all.
FRAME, OWN, ELEMENT, HIDDEN = 1, 2, 3, 4
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)


@dataclass
class Block:
    """A run of text between block tags, with what the tree looks at."""

    text: str = ""
    words: int = 0
    link_words: int = 0
    around: bool = False  # inside an element that names itself as no part of an article
    article: bool = False
    heading: bool = False
    parts: list[tuple[str, bool]] = field(default_factory=list, repr=False)
    within: int = field(default=-1, repr=False)  # the number of the innermost marked element or article
    title: bool = field(default=False, repr=False)


def _named(name: str, attribute: str, element: str) -> int:
    """What one name in a class, id or role says of an element: nothing, FRAME or OWN.

    Ids name a heading's or section's subject as often as a role on the page, so they count as a
    whole only. Headings bear no mark, and elements of running text none but a whole name of OWN.
    """
    if element in _HEADINGS or _MORE.fullmatch(name):
        return 0
    if element in _TEXT:
        return OWN if attribute != "id" and _OWN.fullmatch(name) else 0
    if attribute == "id" or element == "section":
        known = _ID.fullmatch(name) or attribute != "id" and _PART_OF.search(name)
    else:
        known = _NAME.fullmatch(name) or _PART_OF.search(name)
    return (OWN if _OWN_CLASS.search(name) else FRAME) if known else 0


def _marked(attributes: str, element: str) -> int:
    kind = 0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            names = [n for n in value.split() if not _MODIFIER.fullmatch(n)]
            if any(_FRAME.fullmatch(n) for n in names):
                names = [n for n in names if not _PLACE.fullmatch(n)]
            kind = max([kind, *(_named(n, name, element) for n in names)])
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return HIDDEN
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return HIDDEN
    return kind


def _ends(page: str, name: str) -> dict[int, int]:
    """Where each element of that name ends, by where its first tag ends; those left open are not in it."""
    ends, starts = {}, []
    for m in re.finditer(rf"<(/?){name}(?=[\s>/])((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", page, re.I):
        if not m[1]:
            if not (name == "svg" and m[2].endswith("/")):
                starts.append(m.end())
        elif starts:
            ends[starts.pop()] = m.end()
    return ends


def _lift(found: list[Block], elements: list[tuple[str, int, int]]) -> None:
    """Sets which blocks stand around; a mark goes where it is on the frame of the main text.

    The marks around <main> go. Those around an <article> go if it has more words than all that is
    unmarked, four times as many where an article is unmarked. Those around the most words go if
    they name the layout and hold four times the unmarked words, or hold a title and more words,
    and no article is unmarked but one that they are in. Save for <main>, no title may stand
    unmarked elsewhere. What is hidden stays so.
    """
    kinds = [kind for _, kind, _ in elements]

    def count() -> tuple[list[int], list[bool], list[int]]:
        """Each element's words and title outside marks within it, and its innermost mark."""
        words, title, mark = [0] * (len(elements) + 1), [False] * (len(elements) + 1), [-1] * (len(elements) + 1)
        for b in found:  # the last place, -1, is the page
            words[b.within] += b.words - b.link_words
            title[b.within] |= b.title
        for e in reversed(range(len(elements))):
            if not kinds[e]:
                words[elements[e][2]] += words[e]
                title[elements[e][2]] |= title[e]
        for e, (_, _, above) in enumerate(elements):
            mark[e] = e if kinds[e] else mark[above]
        return words, title, mark

    def path(mark: int) -> list[int]:
        out = []
        while mark >= 0:
            if kinds[mark]:
                out.append(mark)
            mark = elements[mark][2]
        return out

    def lift(around: list[int]) -> None:
        if all(kinds[e] != HIDDEN for e in around):
            for e in around:
                kinds[e] = 0

    words, title, mark = count()
    for e, (name, _, _) in enumerate(elements):
        if name == "main" and words[e] and mark[e] >= 0:
            lift(path(e))
    words, title, mark = count()
    whole = any(b.article and mark[b.within] < 0 for b in found)
    articles = [e for e, (name, _, _) in enumerate(elements) if name in _ARTICLE and mark[e] >= 0 and (title[e] or not title[-1])]
    best = max(articles, key=lambda e: words[e], default=-1)
    if best >= 0 and words[best] > (4 if whole else 1) * words[-1]:
        lift(path(best))
        words, title, mark = count()
    clear = any(b.article and mark[b.within] < 0 for b in found)
    groups = {mark[b.within] for b in found if b.article or not clear} - {-1}
    for best in sorted(groups, key=lambda e: (-words[e], e)):
        around = path(best)
        kind = max(kinds[e] for e in around)
        if not title[-1] and words[best] and (
                title[best] and kind <= OWN and words[best] > words[-1] or kind == FRAME and words[best] >= 4 * words[-1]):
            lift(around)
            mark = count()[2]
            break
    for b in found:
        b.around = mark[b.within] >= 0


def blocks(page: str | None) -> list[Block]:
    """The page's blocks in order; scripts, styles, comments and markup are no text."""
    page = page or ""
    out: list[Block] = []
    open_tags: list[tuple[str, int]] = []  # name, and the number of the innermost marked element or article, or -1
    elements: list[tuple[str, int, int]] = []  # name and mark of those, and the number of the one around
    ends: dict[str, dict[int, int]] = {}
    links = article = 0
    current = Block()

    def close() -> None:
        nonlocal current
        current.text = " ".join("".join(t for t, _ in current.parts).split())
        if current.text:
            current.words = len(current.text.split())
            current.link_words = min(current.words, sum(len(t.split()) for t, linked in current.parts if linked))
            out.append(current)
        current = Block()

    def leave(n: int) -> None:
        nonlocal article, links
        for name, _ in open_tags[n:]:
            article -= name in _ARTICLE
            links -= name == "a"
        del open_tags[n:]

    def add(raw: str, literal: bool = False) -> None:
        if raw:
            if not current.parts:
                current.within, current.article = open_tags[-1][1] if open_tags else -1, article > 0
                current.title = any(name == "h1" for name, _ in open_tags)
                current.heading = any(name in ("h1", "h2", "h3", "h4", "h5", "h6") for name, _ in open_tags)
            current.parts.append((raw if literal else html.unescape(raw), links > 0))

    at = 0
    while True:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in _BLOCK:
            close()
        elif name == "br":
            add(" ")
        if m[1]:
            known = [i for i, (n, _) in enumerate(open_tags) if n == name]
            if known:
                leave(known[-1])
            continue
        if name in _NESTED:
            if name not in ends:
                ends[name] = _ends(page, name)
            at = ends[name].get(at, at)
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}[\s>/]", re.I).search(page, at)
            if not end:
                if m[3].rstrip().endswith("/"):
                    continue
                break
            at = page.find(">", end.start()) + 1 or len(page)
            continue
        if name == "xmp":  # its text is what it says, tags and references included
            end = re.compile(r"</xmp[\s>/]", re.I).search(page, at)
            add(page[at : end.start() if end else len(page)], literal=True)
            close()
            at = page.find(">", end.start()) + 1 or len(page) if end else len(page)
            continue
        if name in _VOID:
            continue
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option", "a"):  # these do not nest
            if open_tags and open_tags[-1][0] == name:
                leave(len(open_tags) - 1)
        marked = _marked(m[3], name)
        if name in ("form", "fieldset"):
            marked = max(marked, FRAME)
        elif name in _AROUND and not (name in ("header", "noscript") and article):  # an article's own header holds its title
            marked = max(marked, ELEMENT)
        if name in _ARTICLE or name == "body":
            marked = 0
        number = open_tags[-1][1] if open_tags else -1
        if marked or name in _ARTICLE:
            elements.append((name, marked, number))
            number = len(elements) - 1
        open_tags.append((name, number))
        article += name in _ARTICLE
        links += name == "a"
    close()
    _lift(out, elements)
    return out


def features(found: list[Block]) -> np.ndarray:
    """Where each block stands (around the text; out of the article, on a page without, or in it), its word count and link density, and those of its neighbours.

    Of features that part the labelled table equally well, the tree takes the first.
    """
    words = np.array([b.words for b in found], float)
    density = np.array([b.link_words / b.words for b in found])
    some_article = any(b.article and not b.around for b in found)
    before = lambda x: np.r_[0.0, x[:-1]]
    after = lambda x: np.r_[x[1:], 0.0]
    return np.c_[
        [b.around for b in found], [2 * b.article if some_article else 1 for b in found], [b.heading for b in found],
        density, before(density), after(density), words, before(words), after(words),
    ]


# The labelled table, pages in short. A number stands for so many words and a number
# in brackets for so many words in a link; + before a block says that it is main text.
LABELLED = """
<nav><li>[1]<li>[2]<li>[1]</nav><div class=ad>9</div><article><h1>+8</h1><p>+40<p>+118 [2]<p>+1</article><footer>14</footer>
<header>[3]</header><div class=sponsor>25</div><article><h1>+2</h1><p>+1<p>+[3]<p>+50 [10]<aside>29 [1]</aside><p>+15</article><footer>3 [2]</footer>
<div class=cookie-bar>40</div><article><p>+300<nav>[6]</nav><h2>+4</h2><p>+[4]<p>+85 [5]<div class=promo>22</div></article><footer>60</footer><p>12
<p>18<article><h1>+5</h1><p>+[22]<p>+35</article><p>80<h3>3</h3><p>[2]
<nav>[1]</nav><article><h1>+6</h1></article><footer>10</footer>
<nav>[2]</nav><div id=notice>12</div><article><h1>+10</h1><p>+14<p>+19<p>+28<p>+33<p>+45 [3]<p>+75<p>+180<p>+491 [9]<p>+2</article><footer>15</footer>
<nav>[4]</nav><main><h1>+12</h1><p>+150<p>+23<p>+1<p>+26<p>+2<p>+17<p>+64<p>+11<p>+100</main><footer>98 [2]</footer>
<nav>[1]</nav><header>70</header><article><h1>+3</h1><p>+[8]<p>+[2]<p>+[21]<p>+[1]<p>+9<div class=advert>45</div><p>+200</article><div class=newsletter>33</div>
<div class=banner>28</div><nav>[2]</nav><article><p>+30<p>+24<p>+20<p>+16<p>+13<p>+17 [1]<p>+27<p>+37</article><footer>17</footer>
<article><h1>+7</h1><ul><li>+[9]<li>+[7]<li>+[12]</ul><p>+3</article><div>30</div><div>[8]</div>
<nav>[2]</nav><div>[2]</div><div>[1]</div><h1>+7</h1><p>+45<p>+77 [3]<p>+12<footer>20</footer>
<div>[3]</div><div>[4]</div><div>1 [2]</div><p>+55<p>+3<p>+26 [4]<div>[6]</div><div>[5]</div>
<header>35</header><h1>+9</h1><p>+20<p>+9 [1]<div>[12]</div><div>[3]</div><footer>50</footer>
<h1>+2</h1><p>+1<p>+6<div>[1]</div><nav>[2]</nav>
<p>+238 [12]
<p>+4
<div>[2]</div><div>[2]</div>
<div>[1]</div><div>[2]</div><div>3</div><div>[2]</div><h1>+6</h1><p>+30<p>+44 [2]<p>+8<p>+61<div>4</div><div>[3]</div><div>[2]</div><div>6</div><div>[1]</div>
<div>[2]</div><div>5</div><div>[4]</div><h2>+9</h2><p>+70<p>+[4]<p>+52<p>+16<div>[7]</div><div>2</div><div>[9]</div><div>[6]</div><div>8 [4]</div>
<div>[1]</div><div>[1]</div><div>11</div><div>[3]</div><p>+34<p>+5<p>+90 [8]<p>+27<p>+2<p>+40<div>[5]</div><div>13</div><div>[2]</div>
<div>2</div><div>[2]</div><div>[2]</div><h1>+11</h1><p>+18<p>+22<p>+15<p>+13 [1]<p>+25<div>[4]</div><div>7</div><div>[1]</div><div>[1]</div>
<div>[6]</div><div>9 [5]</div><div>[8]</div><p>+120<p>+[6]<p>+140<div>[6]</div><div>[9]</div><div>10</div>
<h1>+2</h1><p>+48<p>+11<p>+7
<nav>[1]</nav><h1>+2</h1><p>+48<p>+11<p>+60<aside>60</aside><footer>5</footer>
<h2>+4</h2><p>+120<p>+33 [2]<p>+20<h2>+3</h2><p>+64<div class=comments><p>70<p>45<p>12<p>38</div>
<p>+33<p>+29<p>+3<p>+41<p>+18
<p>+8<p>+6<p>+11
<nav>[1]<li>[2]<li>[3]</nav><h1>+5</h1><p>+4<p>+95<p>+10 [1]<p>+55<div class=sidebar><p>90<p>[3]</div>
<header>6</header><p>+21<p>+[3]<p>+75<p>+32<footer>[2]<p>44</footer>
<h1>+9</h1><p>+3<p>+140<p>+15<p>+260 [6]<div class=related-posts>[8]<p>[7]<p>[9]</div>
<div class=cookie-notice>24</div><nav>[2]</nav><h1>+7</h1><p>+36<h3>+2</h3><p>+58<p>+4<div class=share>[1] [1] 2</div>
<div>[2]</div><div>[3]</div><h1>+4</h1><p>+28<p>+112<p>+5<p>+19 [2]<div>[4]</div><div>[3]</div>
<div>[5]</div><div>4 [3]</div><p>+66<p>+7<p>+81<p>+23<div>3 [3]</div><div>[10]</div><div>9</div><div>[2]</div>
<div>4</div><div>[2]</div><div>[7]</div><h2>+6</h2><p>+17<p>+26<p>+14<div>8 [6]</div><div>[4]</div><div>5</div><div>[1]</div>
<article><h1>+7</h1><div class=share>[1] [1]</div><nav>[2]<p>[3]<p>[4]</nav><p>+66<p>+[5]<p>+120<aside>[4]<p>20</aside><p>+30<div class=related-posts>[6]<p>[8]<p>[7]</div></article><footer>[2] 9</footer>
<nav>[1]<p>[2]</nav><article><p>+90<nav>[2]</nav><p>+210<div class=teaser>[9]</div><p>+44<p>+[12]<p>+180<div class=ad>[5] 20</div><p>+12<div class=comments><p>40<p>[1] 15</div></article>
<header>[2]<p>5</header><main><h1>+4</h1><div class=breadcrumb>[1] [2]</div><p>+25<p>+[2]<p>+[7]<p>+160<div class=sponsor>[6]</div><p>+35<div class=newsletter>14<form>3</form></div></main>
<article><h1>+10</h1><p>+300<p>+[6]<p>+250<p>+[15]<div class=pagination>[1] [1] [1]</div><div class=tags-widget>[2] [1]</div><p>+70</article><aside><p>80<p>[9]</aside>
<main><p>+170<p>+[4]<p>+160<p>+200 [20]<p>+[3]<div class=advert>[11]</div><div class=advert>60</div><p>+180</main><footer>120</footer>
<nav>[1]<li>[1]<li>[2]</nav><h1>+6</h1><p>+80<div class=share>[1] [1]</div><p>+75<aside>[5]</aside><p>+60<div class=ad>33</div><p>+90<footer>[3] 20</footer>
<div>[2]</div><div>[1]</div><p>+78<div>[2]</div><p>+62<div>[3]</div><p>+85<p>+14<div>[5]</div><div>[2]</div>
<p>8<article><h1>+4</h1><p>+6<p>+3<p>+9<p>+2</article><p>12<div>30</div><p>5
<div>7</div><main><p>+11<p>+4<h2>+2</h2><p>+7<p>+10</main><div>16</div><div>90</div><p>28 [1]
<div class=ad>15</div><p>+52<div class=ad>48</div><p>+47<p>+2<div class=ad>19</div>
"""


def _labelled(line: str) -> tuple[list[Block], list[float]]:
    """The blocks of a page in short, and which are main text."""
    page = re.sub(r"\[(\d+)\]", lambda m: f"<a href=x>{'w ' * int(m[1])}</a>", line)
    found = blocks(re.sub(r"(?<![\w<])(\+?)(\d+)(?=[\s<]|$)", lambda m: m[1] + "w " * int(m[2]), page))
    return found, [float(b.text.startswith("+")) for b in found]


@cache
def tree() -> Tree:
    """The tree trained on the labelled table."""
    pages = [_labelled(line) for line in LABELLED.strip().split("\n")]
    return Tree.fit(np.concatenate([features(found) for found, _ in pages]), np.concatenate([y for _, y in pages]), depth=8, least=2)


def main_text(page: str | None, model: Tree) -> str:
    """The main blocks of a page in page order, two newlines apart."""
    found = blocks(page)
    if not found:
        return ""
    keep = model.predict(features(found)) >= 0.5
    return "\n\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """The main text of every page: page_id, url, text and n_chars (code points).

    `pages` needs (page_id, url, html); other columns are ignored. Blocks are the runs of text
    between block elements, with character references decoded and white space runs as one
    space. A null or empty page, or one without main text, has an empty text. Nothing is cut
    off; a tag left open at the end and one that closes nothing are tolerated. Repeated rows
    stay, and an empty table gives an empty one. No row is shuffled.
    """

    def run(batches):
        model = tree()
        for batch in small(batches):
            texts = [main_text(p, model) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
