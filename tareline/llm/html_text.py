"""Main text of HTML pages: flat text blocks classified by a small decision tree.

A page becomes a flat list of blocks, each with its word count and link density,
those of its neighbours, and where it stands (inside an article; inside a
container that by tag or name is no article).  A decision tree trained on a
small labelled table of pages decides which blocks are main text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tareline.llm.batches import with_text_columns

#: HTML elements by what they do to text.
BLOCKS = frozenset(
    "html body p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre section"
    " article main header footer nav aside form fieldset figure figcaption address details summary hr dialog menu center".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head title script style noscript template svg math textarea select option button iframe object canvas video audio label".split())
MAIN = frozenset(["article", "main"])
OTHER = frozenset("nav footer aside form menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names by which pages call what is no article.
NAMES = re.compile(
    r"(?<![a-z])(?:ad|ads|adv|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|alert|popup|modal|overlay"
    r"|sidebar|side-bar|widget|related|recommend\w*|share|sharing|social|newsletter|subscribe|signup|login|search"
    r"|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|toolbar|topbar|masthead|header|footer|copyright"
    r"|comments?|comment-list|replies|reply|disqus|respond|reactions?|tags|byline-links)(?![a-z])"
)
#: Whole names of comments and of lists of them.
COMMENT = re.compile(
    r"(?<!\S)(?!(?:tag|category|topic)-)(?:\w[\w-]*[-_])?(?:comments?|reply|replies)"
    r"(?:[-_]*\d+|[-_]+(?:area|body|content|entry|inner|item|list|section|text|thread|wrap|wrapper))?(?!\S)"
)
#: Lists of other articles, whose articles are not the page's own.
LISTS = re.compile(r"(?<![a-z])(?:related|recommend\w*|comments?|replies|disqus)(?![a-z])|^\s*(?:sidebar|side-bar|widget|menu|nav)\s*$")
#: Parts of names that tell what a container holds beside its text, or lacks ("has-sidebar", "page--no-ads").
BESIDE = re.compile(r"(?<![a-z0-9])(?:has|have|with|without|no|non|not)[-_]\S*")
#: Names of containers of whole pages, and how these are laid out ("content sticky-header").
WRAPPER = re.compile(r"(?<!\S)(?:article|body|columns?|container|content|entry|grid|layout|main|page|post|row|site|wrap|wrapper)(?!\S)")
PLACE = r"(?:bottom|closed|collapsed|dark|disabled|enabled|fixed|floating|hidden|left|light|open|right|static|sticky|top|transparent|visible)"
LAYOUT = re.compile(rf"(?<!\S)(?:{PLACE}[-_]\S+|\S+[-_]{PLACE})(?!\S)")
#: Elements of running text, whose ids are anchors; inside an article sections have anchors, too.
ANCHORED = HEADINGS | {"p"}
SECTIONS = frozenset("section li dt dd dl td th tr table caption blockquote pre figure figcaption".split())
SECTION = re.compile(r"(?<!\S)(?:section|chapter|level\d|sect\d)(?!\S)")
#: Elements that hold no article of the page.
FIRM = OTHER - {"form"}
UNFINISHED = re.compile(r"<(?:[a-zA-Z/!?][^<>]*)?$")


def named_other(tag: str, attrs: list[tuple[str, str | None]], main: bool) -> tuple[bool, bool]:
    """Whether an element's names tell that it is no article, and whether articles inside are none of the page's."""
    at = {k: v.lower() for k, v in attrs if v and k in ("class", "id", "role", "aria-label")}
    if not at or tag in ("html", "body"):
        return False, False
    kind = f"{at.get('class', '')} {at.get('role', '')}"
    # A label is free text, unless all its words are such names.
    label = at.get("aria-label", "")
    anchor = f" {at.get('id', '')} {label if all(map(NAMES.fullmatch, label.split())) else ''}"
    if tag in MAIN:
        comment = bool(COMMENT.search(BESIDE.sub("", kind + anchor)))
        return comment, comment
    if tag not in ANCHORED:
        in_text = main and (tag in SECTIONS or SECTION.search(kind))
        if not in_text or COMMENT.search(anchor):
            kind += anchor
    kind = BESIDE.sub("", kind)
    if WRAPPER.search(kind):
        kind = LAYOUT.sub("", kind)
    # The head of an article is part of it, and so is a heading.
    named = any(m[0] != "header" or not main and tag not in HEADINGS for m in NAMES.finditer(kind))
    return named, named and bool(LISTS.search(kind))


class Blocks(HTMLParser):
    """Collects ``(text, words, link words, in main, in other, heading, label)`` of each block in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, bool, bool]] = []  # tag, main, other, silent, without articles of the page
        self.opened: Counter[str] = Counter()  # open elements by tag
        self.text: list[str] = []
        self.link_words = self.links = 0
        self.heading = False
        self.label = 0
        self.found: list[tuple[str, int, int, bool, bool, bool, int]] = []

    def state(self) -> tuple[bool, bool, bool, bool]:
        return self.open[-1][1:] if self.open else (False, False, False, False)

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            main, other, *_ = self.state()
            self.found.append((text, text.count(" ") + 1, self.link_words, main, other, self.heading, self.label))
        self.text.clear()
        self.link_words = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.text.append(" ")
        if tag == "a":
            self.links = 1
        if tag in BLOCKS:
            self.flush()
            self.heading = tag in HEADINGS
            self.label = int(any(k == "data-main" for k, _ in attrs))
        if tag in VOID or tag not in BLOCKS and tag not in SILENT:
            return
        if tag == "p" and self.open and self.open[-1][0] == "p":
            self.close_from(-1)
        main, other, silent, firm = self.state()
        named, lists = named_other(tag, attrs, main)
        if tag in MAIN and not firm:
            other = False  # whatever the containers around it are called
        other = other or tag in OTHER or tag == "header" and not main or named
        self.opened[tag] += 1
        self.open.append((tag, main or tag in MAIN, other, silent or tag in SILENT, firm or lists or tag in FIRM))

    def close_from(self, i: int) -> None:
        self.opened.subtract(e[0] for e in self.open[i:])
        del self.open[i:]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.links = 0
        if tag in BLOCKS:
            self.flush()
            self.heading, self.label = False, 0
        if self.opened[tag] > 0:
            i = len(self.open) - 1
            while self.open[i][0] != tag:
                i -= 1
            self.close_from(i)

    def handle_data(self, data: str) -> None:
        if not self.state()[2]:
            self.text.append(data)
            if self.links:
                self.link_words += len(data.split())


def blocks(html: str | None) -> list[tuple[str, int, int, bool, bool, bool, int]]:
    html = html or ""
    parser = Blocks()
    cut = UNFINISHED.search(html, max(0, html.rfind("<")))
    parser.feed(html[: cut.start()] if cut else html)
    parser.close()
    parser.flush()
    return parser.found


def block_features(found: list) -> np.ndarray:
    """Words and link density of a block and its neighbours, and where it stands."""
    own = np.array([(b[1], min(1.0, b[2] / b[1]), b[3], b[4], b[5]) for b in found], dtype=float).reshape(-1, 5)
    around = np.vstack([np.zeros((1, 5)), own, np.zeros((1, 5))])
    return np.hstack([own, around[:-2, :2], around[2:, :2]])


#: The labelled table: main blocks carry ``data-main``.
LABELLED = (
    "<header><a href=/>Site name</a> Daily paper of record</header><nav><ul><li><a href=/a>Home</a><li><a href=/b>World news</a>"
    "<li>Weather</ul></nav><div class=ad>Buy the best shoes in town, now with a discount of one half.</div><article><h1 data-main>A title"
    " of six words here</h1><p data-main>A first paragraph that is long enough to tell the reader what happened, where it happened and who"
    " was there when it did.</p><p data-main>Short.</p><p data-main>See <a href=/x>the earlier report on this</a>.</p></article><footer>&copy; All rights"
    " of the publisher are kept, as the terms of use say at length.</footer>",
    "<div id=sidebar><p>Most read stories of the week that readers liked and shared with all of their friends and family.</p></div>"
    "<main><h2 data-main>Heading</h2><p data-main>One.</p><blockquote data-main>Words that somebody said on that day.</blockquote><div class=comments><p>I"
    " agree with every word of this piece, and I would like to add that I have seen it myself.</p><p>No.</p></div></main>",
    "<div><a href=/1>One</a> <a href=/2>Two</a> <a href=/3>Three</a></div><div data-main>A page without any article element still has a"
    " long run of words, which follow each other in whole sentences, and hold hardly a link at all among them.</div><div data-main>Another"
    " such run stands below the first one, and goes on about the same subject for a good while longer than menus do.</div><div>Contact</div>"
    "<div><a href=/terms>Terms</a> and <a href=/privacy>privacy</a></div>",
    "<form><p>Sign up with your address to get the letter that we write to our readers every morning before breakfast.</p></form>"
    "<aside><p>Related</p><p>Another story about a similar thing that took place in another town some time ago, told at length.</p></aside>"
    "<article><p data-main>Text in an article, with <a href=/l>a link of many words in the middle of it</a> and some more text.</p>"
    "<ul><li data-main>first</li><li data-main><a href=/s>second</a></li></ul><div class=share><a href=/t>Share</a> this</div></article>",
    "<div class=cookie-notice><p>We use cookies to make this page work and to see how it is used; read on to agree with that and more.</p></div>"
    "<p><a href=/home>Home</a></p><p data-main>Plain paragraphs under the body are main text when they are long and have no links in them, as this one.</p>"
    "<p data-main>A second long paragraph follows the first and has as many words as it needs to say what is to be said in it.</p>"
    "<p data-main>A third one ends the page, long enough to be told from the few words of a menu or of a line about rights.</p><p><a href=/top>Back to top</a></p>",
    "<div class='container has-sidebar'><article><h1 data-main id=search>On searching</h1><p data-main>Few words.</p><section id=related-work><h2 data-main>Related"
    " work</h2><p data-main>What others wrote before.</p></section></article><div class=sidebar><p>Stories of the day that other readers have read and"
    " liked, with a word or two on each of them.</p></div></div>",
)
MAX_DEPTH = 6


class DecisionTree:
    """Binary splits by Gini impurity until leaves are pure or the depth is reached."""

    def fit(self, x: np.ndarray, y: np.ndarray, depth: int = MAX_DEPTH) -> DecisionTree:
        self.test: tuple[int, float] | None = None
        self.value = int(y.mean() * 2 > 1) if len(y) else 0
        best = len(y) * self.impurity(y)
        if depth and best > 0:
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for at in (values[:-1] + values[1:]) / 2:
                    left = x[:, f] <= at
                    cost = left.sum() * self.impurity(y[left]) + (~left).sum() * self.impurity(y[~left])
                    if cost < best - 1e-9:
                        best, self.test = cost, (f, float(at))
        if self.test:
            left = x[:, self.test[0]] <= self.test[1]
            self.low = DecisionTree().fit(x[left], y[left], depth - 1)
            self.high = DecisionTree().fit(x[~left], y[~left], depth - 1)
        return self

    @staticmethod
    def impurity(y: np.ndarray) -> float:
        p = y.mean() if len(y) else 0.0
        return 2 * p * (1 - p)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.test is None:
            return np.full(len(x), self.value)
        left = x[:, self.test[0]] <= self.test[1]
        out = np.empty(len(x), int)
        out[left], out[~left] = self.low.predict(x[left]), self.high.predict(x[~left])
        return out


@cache
def trained() -> DecisionTree:
    pages = [blocks(f"<html><body>{p}</body></html>") for p in LABELLED]
    return DecisionTree().fit(np.vstack([block_features(p) for p in pages]), np.array([b[6] for p in pages for b in p]))


def main_text(html: str | None, tree: DecisionTree) -> str:
    found = blocks(html)
    if not found:
        return ""
    return " ".join(b[0] for b, keep in zip(found, tree.predict(block_features(found))) if keep)


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None, column: str = "text") -> DataFrame:
    """Add the main text of each page; null and empty pages have the empty text.

    Rows do not meet each other: repeated rows give repeated results, an empty
    table none.  A page is read whole, whatever its length.
    """
    def make() -> Callable[[list], list[pa.Array]]:
        tree = trained()
        return lambda texts: [pa.array([main_text(t, tree) for t in texts], pa.string())]

    return with_text_columns(pages, html, make, [T.StructField(column, T.StringType())], keep)


def page_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    made = extract(pages.select("page_id", "url", "html"), keep=["page_id", "url"])
    return made.withColumn("n_chars", F.char_length("text").cast("long"))
