"""Main text of web pages: flat text blocks classified by a decision tree.

A page is read as a flat list of text blocks, cut at block-level tags.  Of each block the tree sees its number of words
and link density, those of the blocks before and after it, and where it stands: in a menu, footer, form and the like, in
an element whose class, id or role says so, in an article.  A name counts only for an element that does not hold the
page's main element or all or most of its text, and a name that merely mentions such a word not within an article.
The tree is grown here, by Gini impurity, on the small labelled table ``LABELLED``.  Scripts, styles, comments of the
markup, the head and form controls never make blocks.

Character references are decoded, white space within a block becomes one space, and the blocks of the main text are
joined by an empty line.  A null, empty or textless page gives the empty text.  Pages are handled one by one and whole;
repeated rows, null ids and further columns change nothing.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veta.llm.common import narrow, query, table

# Names of HTML elements and customary class names, grouped by what they mean here.
BLOCK = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
CONTAINER = BLOCK - {"p", "hr", "body", "html", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SILENT = set("script style noscript template textarea select button svg canvas iframe object video audio title datalist".split())
#: Of these everything up to the end tag, or to the page's end without one, is text; the others hold elements.
RAW = set("script style noscript iframe title textarea".split())
APART = {"nav", "footer", "aside", "form", "menu", "dialog"}
APART_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
APART_NAMES = set("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar sidebar footer
    header masthead topbar toolbar breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription
    signup login share sharing social related recommended recommendations comment comments disqus discussion replies reply pagination pager widget rail
    copyright disclaimer legal skip teaser outbrain taboola""".split())
ARTICLE_NAMES = set("article articlebody content main post entry story maincontent postbody".split())
#: Words that leave a name what it is, words after which a name tells what is around, and last words that deny the others.
FURNITURE = set("""area bar block bottom box button buttons col column container fixed global group holder icon icons inner item items left link links list
    mobile module outer page panel posts primary reader region right row secondary section site slot sticky stories top unit user wrap wrapper zone""".split())
ABOUT = set("has is no non not with without hide hides".split())
WITHOUT = {"free", "less"}
#: Names of reader comments, which may be longer than the article they follow.
REPLIES = set("comment comments disqus discussion replies reply".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[|\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
NEVER = {n: re.compile(rf"</{n}\s*>", re.I) for n in RAW}


def named(value: str) -> int:
    """What the names in a class, id, role or itemprop say: 2 for apart, 3 for a name that only mentions such a word, -1 for an article.

    The last word of a name tells what it is, the others of what kind: post-footer is a footer, footer-post is not.
    What follows has-, no-, with- and the like is about the element's surroundings.
    """
    kinds = set()
    for name in value.split():
        words = []
        for w in NAME.findall(name):
            if w.lower() in ABOUT:
                break
            words.append(w.lower())
        if words and words[-1] in WITHOUT:
            continue
        if not APART_NAMES.isdisjoint(words):
            kinds.add(2 if words[-1] in APART_NAMES or all(w in APART_NAMES or w in FURNITURE or w.isdigit() for w in words) else 3)
        elif not ARTICLE_NAMES.isdisjoint(words):
            kinds.add(-1)
    return next((k for k in (2, -1, 3) if k in kinds), 0)


def standing(tag: str, attributes: str) -> int:
    """1 for an element that sets its text apart, 2 if only by its name or class, 3 if that only mentions it, -1 for an article, 0 for any other."""
    if tag in APART:
        return 1
    found = 0
    if attributes:
        kinds = set()
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                return 1
            if key == "role" and value.lower() in APART_ROLES:
                return 1
            if key in ("class", "id", "role", "itemprop"):
                kinds.add(named(value))
        found = next((k for k in (2, -1, 3) if k in kinds), 0)
    if tag == "main":
        return -1
    return 2 if found == 2 else -1 if tag == "article" else 2 if tag == "header" and found != -1 else found


def closings(page: str) -> dict[int, int]:
    """Where each silent element that holds elements ends, by the end of its start tag: after its end tag or before one that
    ends an element around it; those that nothing ends are left out."""
    found, at = {}, 0
    around: list[tuple[str, int]] = []
    count: dict[str, int] = {}
    for m in TAG.finditer(page):
        name = m[2] or m[5]
        if m.start() < at or not name:
            continue
        name, last = name.lower(), (m[3] or m[6] or "").endswith("/")
        if (m[1] or m[4]) == "/":
            while count.get(name):
                inner, place = around.pop()
                count[inner] -= 1
                if inner in SILENT:
                    found[place] = m.end() if inner == name else m.start()
                if inner == name:
                    break
        elif not last and name in RAW:
            over = NEVER[name].search(page, m.end())
            at = over.end() if over else len(page)
        elif not last:
            around.append((name, m.end()))
            count[name] = count.get(name, 0) + 1
    return found


@dataclass(eq=False, slots=True)
class Element:
    """An open element: its words outside what is surely apart, and what it holds."""

    tag: str
    stands: int
    replies: bool = False
    words: int = 0
    main: bool = False
    article: bool = False


class Blocks:
    """The flat blocks of one page: texts, and for each (words, words in links, apart, named apart, in article, heading, marked)."""

    def __init__(self, page: str):
        self.texts: list[str] = []
        self.facts: list[tuple] = []
        self.around: list[list[Element]] = []
        self.words = 0
        self.open: list[Element] = []
        self.parts: list[str] = []
        self.link_parts: list[str] = []
        self.links = self.marked = 0
        self.heading = False
        at, end, head, over = 0, len(page), False, None
        for_tag = TAG.finditer(page)
        for m in for_tag:
            start, stop = m.span()
            if start < at:
                continue
            if start > at and not head:
                self.say(page[at:start])
            at = stop
            name = m[2] or m[5]
            if not name:
                continue
            name, closing = name.lower(), (m[1] or m[4]) == "/"
            if name in SILENT:
                if not closing and not (m[3] or m[6] or "").endswith("/"):
                    if name in RAW:
                        last = NEVER[name].search(page, stop)
                        at = last.end() if last else end
                    else:
                        over = closings(page) if over is None else over
                        at = over.get(stop, stop)
                continue
            if name == "head":
                head = not closing
            elif head and name in BLOCK:
                head = False
            if name == "a":
                self.links = 0 if closing else 1
            elif name == "br":
                self.parts.append(" ")
            elif name == "x-main":
                self.cut()
                self.marked = 0 if closing else 1
            elif name in BLOCK:
                self.cut()
                self.links = 0
                if name in CONTAINER:
                    if closing:
                        for i in range(len(self.open) - 1, -1, -1):
                            if self.open[i].tag == name:
                                del self.open[i:]
                                break
                    elif not (m[3] or m[6] or "").endswith("/"):
                        self.enter(name, m[3] or m[6] or "")
                self.heading = not closing and name in ("h1", "h2", "h3", "h4", "h5", "h6")
        if at < end and not head:
            self.say(page[at:])
        self.cut()
        self.settle()

    def enter(self, name: str, attributes: str) -> None:
        stands = standing(name, attributes)
        if stands == -1:
            for e in self.open:
                e.main |= name == "main" or "articlebody" in attributes.lower()
                e.article |= name == "article"
        replies = stands == 2 and not REPLIES.isdisjoint(w.lower() for w in NAME.findall(attributes))
        self.open.append(Element(name, stands, replies))

    def say(self, text: str) -> None:
        text = html.unescape(text) if "&" in text else text
        self.parts.append(text)
        if self.links:
            self.link_parts.append(text)

    def cut(self) -> None:
        if self.parts:
            words = "".join(self.parts).split()
            if words:
                around = [e for e in self.open if e.stands]
                if all(e.stands != 1 for e in around):
                    self.words += len(words)
                    for e in around:
                        e.words += len(words)
                self.texts.append(" ".join(words))
                self.around.append(around)
                self.facts.append((len(words), len(" ".join(self.link_parts).split()), self.heading, self.marked))
            self.parts, self.link_parts = [], []

    def released(self, e: Element, in_article: bool) -> bool:
        """Whether an element stays with the text whatever its name: it holds the main element or, but for replies, all or most of the page."""
        if e.main:
            return True
        most = 2 * e.words > self.words
        return e.stands == 3 and (in_article or most) or e.article and most or not e.replies and 20 * e.words >= 19 * self.words

    def settle(self) -> None:
        """Complete the facts, now that it is known what each element holds."""
        for i, around in enumerate(self.around):
            stands, tags = [], []
            for e in around:
                if e.stands in (2, 3) and self.released(e, -1 in stands):
                    continue
                stands.append(2 if e.stands == 3 else e.stands)
                tags.append(e.tag)
            # A header within an article holds its title.
            titled = -1 in stands and stands[-1] == 2 and tags[-1] == "header"
            words, links, heading, marked = self.facts[i]
            self.facts[i] = (words, links, 1 in stands, 2 in stands and not titled, -1 in stands, heading, marked)


def features(facts: list[tuple]) -> np.ndarray:
    """One row a block, in the order of ``FEATURES``."""
    f = np.array(facts, np.float64).reshape(-1, 7)
    density = f[:, 1] / f[:, 0]
    around = lambda x: (np.concatenate(([0.0], x[:-1])), np.concatenate((x[1:], [0.0])))
    (words_before, words_after), (density_before, density_after) = around(f[:, 0]), around(density)
    has_article = np.full(len(f), float((f[:, 4] * (1 - f[:, 2]) * f[:, 0]).sum() > 0))
    return np.stack([f[:, 0], density, words_before, density_before, words_after, density_after, f[:, 2], f[:, 3], f[:, 4], f[:, 5], has_article], axis=1)


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "apart", "named_apart", "in_article", "heading", "has_article")

#: The labelled table: a page a row, {n} stands for n words, x-main marks blocks of the main text.
LABELLED = (
    "<nav><ul><li><a>{1}</a></li><li><a>{2}</a></li><li><a>{1}</a></li></ul></nav><div class=ad>{7}</div><article><x-main><h1>{9}</h1><p>{60}<p>{3}<p>{1}</p><p>{35}</p></x-main></article><footer>{12}</footer>",
    "<header><a>{1}</a><a>{2}</a></header><div id=content><x-main><h2>{6}</h2><p>{45}</p><p>{2}</p><ul><li>{4}</li><li>{9}</li></ul><p>{80}</p></x-main></div><div class=sidebar><h3>{2}</h3><p>{25}</p><a>{5}</a></div><div id=footer>{14}</div>",
    "<div class=cookie-notice>{30}<a>{2}</a></div><nav><a>{1}</a></nav><main><x-main><h1>{5}</h1><p>{12}</p><blockquote>{20}</blockquote><p>{1}</p></x-main><aside>{40}</aside><div class=comments><h3>{1}</h3><p>{33}</p><p>{4}</p></div></main><footer><p>{20}</p></footer>",
    "<table><tr><td><a>{1}</a><td><a>{2}</a><td><a>{1}</a></table><x-main><h1>{6}</h1><p>{70}</p><p>{55}</p><p>{8}</p><p>{40}</p></x-main><p><a>{3}</a> <a>{2}</a> <a>{4}</a></p><p>{5}</p>",
    "<div><a>{1}</a></div><div><a>{2}</a></div><div><x-main><p>{30}</p><p>{50}</p></x-main></div><div><a>{6}</a></div><div><a>{4}</a></div><div>{6}</div>",
    "<article><header><x-main><h1>{7}</h1></x-main></header><x-main><p>{3}</p><p>{18}</p><pre>{22}</pre><table><tr><td>{2}</td><td>{3}</td></tr></table></x-main><form>{9}<p>{25}</p></form><div class=share><a>{1}</a><a>{1}</a></div><footer><p>{15}</p></footer></article><div class='related-posts'><h3>{2}</h3><p>{22}</p><a>{8}</a></div>",
    "<div role=navigation><p>{8}</p></div><div class='post-body'><x-main><h1>{4}</h1><p>{1}</p><p>{2}</p><p>{90}</p><p><a>{9}</a></p></x-main></div><section id=comments><p>{60}</p><p>{45}</p></section><div class=newsletter><p>{14}</p></div>",
    "<ul><li><a>{2}</a></li><li><a>{2}</a></li><li><a>{3}</a></li></ul><x-main><h1>{8}</h1><p>{120}</p></x-main><p>{4}</p><ul><li><a>{2}</a></li><li><a>{2}</a></li></ul>",
    "<div class=banner><p>{35}</p></div><main><x-main><p>{15}</p><p>{16} <a>{2}</a> {20}</p><p>{1}</p><h2>{2}</h2><p>{5}</p></x-main></main><p>{28}</p><p>{50}</p><div><a>{3}</a></div>",
    "<p><a>{1}</a> | <a>{1}</a> | <a>{1}</a></p><x-main><h1>{3}</h1><p>{25}</p><p>{24} <a>{3}</a></p><h2>{4}</h2><p>{65}</p></x-main><p>{3} <a>{2}</a></p>",
    "<article><x-main><p>{2}</p></x-main><div class=advert><p>{30}</p></div><x-main><p>{14}</p></x-main><aside><p>{22}</p></aside><x-main><p>{1}</p><p><a>{2}</a></p><ul><li><a>{3}</a></li></ul></x-main></article><div><p>{40}</p><p>{9}</p></div>",
    "<x-main><p>{20}</p></x-main>",
    "<nav><a>{1}</a></nav><article><x-main><h1>{5}</h1><p>{40}</p><p>{6}</p><p>{1}</p></x-main></article>",
    "<footer>{8}</footer><div class=ad>{9}</div><main><x-main><p>{40}</p><p>{2}</p><p>{50}</p></x-main></main>",
    "<div class=menu><a>{1}</a></div><div class=story><x-main><h2>{4}</h2><p>{3}</p><p>{30}</p></x-main></div>",
    "<x-main><h1>{3}</h1><p>{40}</p><p>{6}</p><p>{55}</p><p>{3}</p></x-main>",
    "<p><a>{2}</a> <a>{1}</a></p><x-main><h1>{4}</h1><p>{35}</p><p>{50}</p></x-main>",
    "<div class=header><h1>{2}</h1><p>{9}</p></div><div><x-main><h2>{3}</h2><p>{50}</p><p>{1}</p><p>{40}</p></x-main></div><div class=footer>{6}</div>",
    "<header><h1>{3}</h1></header><nav>{4} <a>{1}</a></nav><div><x-main><h2>{5}</h2><p>{44}</p><p>{2}</p><p>{31}</p></x-main></div><aside><p>{35}</p><p>{12}</p></aside><footer><p>{25}</p></footer>",
    "<div id=top-menu>{5}</div><x-main><p>{12}</p><p>{33}</p><p>{1}</p></x-main><div class=promo>{18}</div><x-main><p>{27}</p><p>{4}</p></x-main><div class=comments><p>{40}</p><p>{3}</p></div>",
    "<div class=notice><p>{22}</p></div><x-main><h1>{4}</h1><p>{2}</p><p>{64}</p></x-main><div id=reader-comments><p>{15}</p><p>{52}</p></div><form>{4}</form><footer>{9}</footer>",
    "<nav><p>{30}</p></nav><x-main><p>{5}</p><p>{75}</p></x-main><aside>{60}</aside><dialog><p>{20}</p></dialog><footer>{40}</footer>",
    "<x-main><h1>{3}</h1><p>{6}</p><p>{40}</p></x-main><div class=disclaimer>{45}</div><form><p>{50}</p></form>",
    "<div class='container no-sidebar'><nav><a>{2}</a></nav><article><x-main><h1>{4}</h1><p>{40}</p></x-main><div class=legal-text><x-main><p>{30}</p></x-main></div></article></div>",
    "<main class=has-header><section class=share-price-report><x-main><p>{35}</p><p>{3}</p></x-main></section><div class=share-buttons><a>{2}</a></div></main><p>{20}</p>",
    "<div class=page-header><x-main><h1>{4}</h1><p>{60}</p><p>{44}</p></x-main></div>",
)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled table.

    Each page is taken several times with other lengths: where elements or names tell what a block is, its length says
    little, so lengths vary widely there; pages without such signs keep about the lengths given.
    """
    rows, labels, rng = [], [], np.random.default_rng(5)
    for page in LABELLED:
        told = re.search(r"class=|id=|role=|<(?:article|main|nav|aside|footer|form|header)", page)
        low, high, times = (0.02, 4, 12) if told else (0.8, 1.3, 4)
        for _ in range(times):
            longer = lambda m: "w " * max(1, round(int(m[1]) * float(np.exp(rng.uniform(np.log(low), np.log(high))))))  # noqa: B023, E731
            facts = Blocks(re.sub(r"\{(\d+)\}", longer, page)).facts
            rows.append(features(facts))
            labels += [f[6] for f in facts]
    return np.concatenate(rows), np.array(labels)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 4) -> tuple:
    """A tree: (share of main text,) or (feature, cut, tree up to the cut, tree above it)."""
    if depth == 0 or y.min() == y.max():
        return (float(y.mean()),)
    best = (np.inf, 0, 0.0)
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, k] <= cut
            a, b = y[low], y[~low]
            if min(len(a), len(b)) < least:
                continue
            impurity = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if impurity < best[0] - 1e-12:
                best = (impurity, k, float(cut))
    if best[0] == np.inf:
        return (float(y.mean()),)
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def share(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    low = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[low], out[~low] = share(tree[2], x[low]), share(tree[3], x[~low])
    return out


def main_text(page: str | None, tree: tuple) -> str:
    blocks = Blocks(page or "")
    if not blocks.texts:
        return ""
    keep = share(tree, features(blocks.facts)) > 0.5
    return "\n\n".join(t for t, k in zip(blocks.texts, keep.tolist(), strict=True) if k)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every row."""
    tree = grow(*labelled())
    frame = narrow(pages, key=key, url=url, page=page)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), tree) for x in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                  names=[key, url, "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in frame.schema}
    return frame.mapInArrow(run, f"`{key}` {kinds['key']}, `{url}` {kinds['url']}, text string, n_chars bigint")


@query("op3_main_text")
def op3_main_text(spark, sf):
    return extract(table(spark, sf, "pages"))
