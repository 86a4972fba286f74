"""Main-text extraction from HTML by a decision tree over flat text blocks.

A page is cut into flat blocks: runs of text between block-level tags. Each
block has its number of words and link density, those of its neighbours, and
what its ancestors say (navigation, form or comment elements, telling class
names, an article around it). A decision tree, grown on the small labelled table
below, decides which blocks are kept.

Defined cases: null or empty html gives the empty text; markup that is cut off
in the middle of a tag loses that tag only; unclosed elements are closed where
HTML closes them; text in scripts, styles, templates and hidden elements is
never a block; pages are independent, so repeated rows give repeated results and ties
can't occur; very long pages are read whole; columns are asked for by name, so others
may have any; the empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are skipped with their content: to their end tag or the page's end as HTML leaves them open, or only if they have an end tag.
RAW = ("script", "style", "textarea", "title", "iframe", "template")
HELD = ("noscript", "svg", "object", "select", "audio", "video", "canvas", "math")
#: What a head can hold, besides elements that are skipped; any other start tag ends it.
HEAD = frozenset("base basefont bgsound link meta noframes noscript head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset("html body main article section nav aside header footer div p ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address form fieldset legend hr details summary dialog center menu hgroup search noframes".split())
#: Elements that hold no article text, wherever they are.
FURNITURE = frozenset("nav footer aside form button label fieldset legend dialog menu search option datalist output".split())
#: What a start tag closes, within the nearest of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
BAD_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices notification alert warning comment comments commentlist disqus reply replies respond discussion sidebar side rail widget widgets menu nav navbar navigation navigator topbar breadcrumb breadcrumbs crumbs footer foot header masthead toolbar share sharing social follow related recommended recommendations recirc more trending popular newsletter subscribe subscription signup login signin register search form popup modal overlay dialog lightbox paywall pagination pager tags tagcloud copyright legal disclaimer skip hidden toc sitemap language feedback rating ratings poll author-bio".split())
GOOD_NAMES = frozenset("article articlebody content contents main maincontent post posttext entry story body text page-content markdown prose".split())
#: Names of others' remarks and pages: an article inside such an element is one of theirs.
REMARKS = frozenset("comment comments commentlist disqus reply replies respond discussion related recommended recommendations recirc more trending popular promo sponsored".split())
#: Words that make a name tell of a state or relation, not of the element itself.
STATES = frozenset("with without has no is open closed enabled disabled on off show hide not".split())
NAME = re.compile(r"[A-Za-z]+")
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:svg|math)(?=[\s/])(?:\s+|/(?!>)|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|[^\s\"'>/=]+|\"[^\"]*\"|'[^']*')*+/>|<(?P<raw>" + "|".join(RAW) + r")\b(?=[\s/>])(?P<rawattr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<held>" + "|".join(HELD) + r")\b(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?</(?P=held)\s*>|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<[A-Za-z][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/]|\Z)", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: page | path | words | linked words | kept. An element is tag.class.class; pages are made up.
LABELLED = """
1 body>nav>ul>li 1 1 0
1 body>nav>ul>li 1 1 0
1 body>nav>ul>li 2 2 0
1 body>div.ad 9 0 0
1 body>article>h1 8 0 1
1 body>article>p 45 0 1
1 body>article>p 3 0 1
1 body>article>p 1 0 1
1 body>article>p 80 6 1
1 body>article>ul>li 4 0 1
1 body>article>ul>li 12 2 1
1 body>footer 10 0 0
2 body>header>div.logo 2 2 0
2 body>header>p 9 0 0
2 body>div.cookie-notice>p 25 2 0
2 body>main>h1 6 0 1
2 body>main>p 60 0 1
2 body>main>div.ad 14 3 0
2 body>main>p 30 0 1
2 body>main>h2 3 0 1
2 body>main>p 5 0 1
2 body>main>blockquote>p 22 0 1
2 body>main>aside>h3 2 0 0
2 body>main>aside>p 30 0 0
2 body>main>section.comments>h2 2 0 0
2 body>main>section.comments>div.comment>p 28 0 0
2 body>main>section.comments>div.comment>p 7 0 0
2 body>footer>p 12 4 0
3 body>div.header>h2 3 3 0
3 body>div.menu>ul>li 1 1 0
3 body>div.menu>ul>li 2 2 0
3 body>div>h1 7 0 1
3 body>div>p 52 2 1
3 body>div>p 34 0 1
3 body>div>p 6 0 1
3 body>div>p 71 4 1
3 body>div>ul>li 5 5 0
3 body>div>ul>li 6 6 0
3 body>div>ul>li 4 4 0
3 body>div>p 3 0 0
3 body>form>p 6 0 0
3 body>form>label 2 0 0
3 body>div.footer>p 18 0 0
4 body>div>a 2 2 0
4 body>div>a 3 3 0
4 body>div>p 2 0 0
4 body>div.sidebar>p 33 2 0
4 body>div.sidebar>h3 2 0 0
4 body>div.content>h1 5 0 1
4 body>div.content>p 24 0 1
4 body>div.content>p 2 0 1
4 body>div.content>div.share>a 2 2 0
4 body>div.content>p 41 3 1
4 body>div.content>table>tr>td 2 0 1
4 body>div.content>table>tr>td 3 0 1
4 body>div.content>div.newsletter>p 20 0 0
4 body>div.content>div.related>ul>li 7 7 0
4 body>div.content>div.related>ul>li 8 8 0
4 body>div>p 4 0 0
5 body>header>nav>a 1 1 0
5 body>main>article>header>h1 9 0 1
5 body>main>article>p 64 5 1
5 body>main>article>figure>figcaption 9 0 1
5 body>main>article>p 17 0 1
5 body>main>article>div.notice>p 16 0 0
5 body>main>article>form>p 12 0 0
5 body>main>article>nav>a 3 3 0
5 body>main>article>p 4 0 1
5 body>main>article>section>h2 4 0 1
5 body>main>article>section>p 39 0 1
5 body>main>article>footer>p 8 1 0
5 body>main>article>aside>p 26 1 0
5 body>main>div.comments>article>p 31 0 0
5 body>main>div.comments>article>p 12 0 0
5 body>div>p 22 0 0
6 body>p 2 2 0
6 body>p 3 3 0
6 body>h1 6 0 1
6 body>p 47 1 1
6 body>p 5 0 1
6 body>p 38 0 1
6 body>p 29 0 1
6 body>p 4 4 0
6 body>p 3 0 0
7 body>div.top>div>a 2 2 0
7 body>div>div>h1 8 0 1
7 body>div>div>p 33 0 1
7 body>div>div>p 15 1 1
7 body>div>div>p 44 0 1
7 body>div>div>p 10 9 0
7 body>div.widget>p 31 0 0
7 body>div>div>a 3 3 0
7 body>div>p 5 1 0
8 body>div>p 24 0 0
8 body>article>p 2 0 1
8 body>article>p 6 6 1
8 body>article>p 15 0 1
8 body>div>p 40 0 0
8 body>section.discussion>p 35 0 0
9 body>div.ads>p 20 2 0
9 body>main>div>p 3 0 1
9 body>main>div>p 26 2 1
9 body>main>button 2 0 0
9 body>div>h3 4 0 0
9 body>div>ul>li 9 2 0
10 body>div.nav>a 1 1 0
10 body>article>h1 8 0 1
10 body>article>p 4 0 1
10 body>article>p 37 1 1
11 body>main>h1 5 0 1
11 body>main>p 40 0 1
11 body>main>p 9 0 1
12 body>h1 6 0 1
12 body>p 55 0 1
12 body>p 21 0 1
13 body>article>h1 7 0 1
13 body>article>p 2 0 1
14 body>div>a 2 2 0
14 body>div>p 48 3 1
14 body>div>p 33 0 1
15 body>article>h1 9 0 1
15 body>article>p 30 8 1
15 body>article>p 5 5 1
15 body>article>p 26 12 1
15 body>article>p 3 3 1
15 body>article>p 18 0 1
16 body>div>ul>li 3 3 0
16 body>div>ul>li 2 2 0
16 body>div>h1 4 0 1
16 body>div>p 19 0 1
16 body>div>p 12 0 1
16 body>div>ul>li 2 2 0
16 body>div>ul>li 3 3 0
17 body>div>p 64 0 1
17 body>div>p 3 0 1
17 body>div>p 4 0 1
17 body>div>p 52 0 1
17 body>div>p 2 0 0
18 body>article>p 5 0 1
18 body>article>ul>li 4 4 0
18 body>article>ul>li 6 6 0
18 body>article>ul>li 5 5 0
18 body>article>ul>li 3 3 0
19 body>article>h2 5 5 1
19 body>article>p 62 2 1
19 body>article>h2 3 3 1
19 body>article>p 45 0 1
20 body>div.site-menu>a 2 2 0
20 body.comments-open>div.content-with-sidebar>article.post.comments-open>h1 6 0 1
20 body.comments-open>div.content-with-sidebar>article.post.comments-open>p 38 1 1
20 body.comments-open>div.content-with-sidebar>article.post.comments-open>p 4 0 1
20 body.comments-open>div.content-with-sidebar>div.sidebar-left>p 21 2 0
20 body.comments-open>div.comments-area>article.comment>p 19 0 0
21 body>div.banner>main>h1 5 0 1
21 body>div.banner>main>p 44 0 1
21 body>div.banner>p 12 0 0
21 body>div.related-posts>article>p 17 3 0
"""

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "article", "page_article", "heading")


class Context:
    """What a block's ancestors say."""

    __slots__ = ("furniture", "article", "hidden", "link")

    def __init__(self, furniture: int = 0, article: int = 0, hidden: bool = False, link: bool = False):
        self.furniture, self.article, self.hidden, self.link = furniture, article, hidden, link


@lru_cache(maxsize=20_000)
def _named(names: str) -> tuple[int, bool]:
    """How far class names and ids speak against their element (0, 1, or 2 for what stays so within), and whether for it.

    A name counts as a whole or by its first or last word ("cookie-banner", "sidebar-left"). Names of
    a state or a relation ("comments-open", "content-with-sidebar", "has-menu") say nothing against it.
    """
    bad, good = 0, False
    for name in names.lower().split():
        words = NAME.findall(name)
        good = good or name in GOOD_NAMES or bool(words and words[-1] in GOOD_NAMES)
        if name in BAD_NAMES or (words and not STATES & set(words) and {words[0], words[-1]} & BAD_NAMES):
            bad = max(bad, 2 if set(words) & REMARKS else 1)
    return bad, good


def enter(above: Context, tag: str, names: str = "", role: str = "", hidden: bool = False) -> Context:
    """The context within an element. ``main``, or an ``article`` that isn't named otherwise, clears what names
    around it said; what elements said, or names of remarks and recommendations, stays."""
    bad, good = _named(names) if names else (0, False)
    named = 0 if tag in ("html", "body", "main") or (good and bad < 2) else bad
    article = above.article or tag in ("article", "main") or role in ("main", "article") or (good and not named)
    around = 0 if above.furniture == 1 and not named and (tag in ("article", "main") or role == "main") else above.furniture
    of_element = tag in FURNITURE or role in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu") or (tag == "header" and not above.article)
    furniture = max(around, 2 if of_element else 0, named)
    return Context(furniture, int(article), above.hidden or hidden, above.link or tag == "a")


def blocks(page: str) -> list[tuple[str, int, float, Context, bool]]:
    """(text, words, link density, context, heading) of each block, in page order."""
    out: list = []
    stack: list[tuple[str, Context]] = [("", Context())]
    runs: list[tuple[str, bool]] = []
    at: tuple[Context, bool] | None = None

    def flush() -> None:
        nonlocal at
        if at is not None:
            words = unescape("".join(t for t, _ in runs)).split()
            if words:
                linked = sum(len(unescape(t).split()) for t, link in runs if link)
                out.append((" ".join(words), len(words), min(1.0, linked / len(words)), *at))
        runs.clear()
        at = None

    def text(raw: str) -> None:
        nonlocal at
        context = stack[-1][1]
        if context.hidden:
            return
        if at is None:
            if raw.isspace():
                return
            at = (context, any(t in HEADINGS for t, _ in stack[-3:]))
        runs.append((raw, context.link))

    def pop(n: int) -> None:
        if any(t in BLOCKS or t in FURNITURE for t, _ in stack[n:]):
            flush()
        del stack[n:]

    done = 0
    for m in TAG.finditer(page):
        if m.start() > done:
            text(page[done : m.start()])
        done = m.end()
        name = m["name"]
        if name is None:
            if m["held"] and m["held"].lower() == "select":
                flush()
            continue
        name = name.lower()
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
                if stack[i][0] in ("article", "main", "body", "table") and name in ("p", "a", "b", "i", "span", "em", "strong", "li", "div"):
                    break
            else:
                if name in BLOCKS:
                    flush()
            continue
        if stack[-1][0] == "head" and name not in HEAD:
            stack.pop()
        if name == "br":
            text(" ")
            continue
        if name in VOID:
            if name in BLOCKS:
                flush()
            continue
        if name in BLOCKS or name in FURNITURE:
            flush()
        if name in BLOCKS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    pop(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        if name in CLOSES:
            own, within = CLOSES[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in own:
                    pop(i)
                    break
                if stack[i][0] in within:
                    break
        attr = m["attr"]
        names, role, hidden = "", "", False
        if attr and not attr.isspace():
            for a in ATTR.finditer(attr):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key in ("class", "id"):
                    names += " " + value
                elif key == "role":
                    role = value.lower()
                elif key == "style":
                    hidden = hidden or bool(HIDDEN.search(value))
                else:
                    hidden = hidden or key == "hidden" or value.lower() == "true"
        if not attr.rstrip().endswith("/") or name in BLOCKS or name == "a":
            stack.append((name, enter(stack[-1][1], name, names, role, hidden)))
    if done < len(page):
        text(page[done:])
    flush()
    return out


def rows_of(found: list[tuple[int, float, Context, bool]]) -> list[tuple[float, ...]]:
    """Feature rows of a page's blocks: (words, links, context, heading) with neighbours."""
    page_article = float(any(c.article and not c.furniture for _, _, c, _ in found))
    rows = []
    for i, (words, links, context, heading) in enumerate(found):
        wb, lb = found[i - 1][:2] if i else (0, 0.0)
        wa, la = found[i + 1][:2] if i + 1 < len(found) else (0, 0.0)
        rows.append((words, links, wb, lb, wa, la, min(context.furniture, 1), context.article, page_article, float(heading)))
    return rows


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the table above."""
    pages: dict[str, list] = {}
    for line in LABELLED.strip().splitlines():
        page, path, words, linked, kept = line.split()
        context = Context()
        for element in path.split(">"):
            tag, *names = element.split(".")
            context = enter(context, tag, " ".join(names))
        pages.setdefault(page, []).append((int(words), int(linked) / int(words), context, element in HEADINGS, int(kept)))
    rows = [r for found in pages.values() for r in rows_of([f[:4] for f in found])]
    return np.array(rows, float), np.array([f[4] for found in pages.values() for f in found])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2):
    """A tree of (feature, threshold, below, above) with shares of kept blocks as leaves (CART, Gini)."""
    share = float(y.mean())
    if not depth or share in (0.0, 1.0) or len(y) < 2 * least:
        return share
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        values, ys = x[order, f], y[order]
        ones, n = np.cumsum(ys), np.arange(1, len(ys) + 1)
        cut = np.flatnonzero(values[1:] > values[:-1])
        cut = cut[(n[cut] >= least) & (len(ys) - n[cut] >= least)]
        if not len(cut):
            continue
        left, right = n[cut], len(ys) - n[cut]
        a, b = ones[cut] / left, (ones[-1] - ones[cut]) / right
        impurity = left * a * (1 - a) + right * b * (1 - b)
        k = int(np.argmin(impurity))
        if best is None or impurity[k] < best[0] - 1e-12:
            best = (impurity[k], f, (values[cut[k]] + values[cut[k] + 1]) / 2)
    if best is None:
        return share
    _, f, at = best
    below = x[:, f] <= at
    return (f, float(at), grow(x[below], y[below], depth - 1, least), grow(x[~below], y[~below], depth - 1, least))


@lru_cache(maxsize=1)
def tree():
    return grow(*labelled_table())


def kept(node, row: tuple[float, ...]) -> bool:
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node >= 0.5


def main_text(page: str | None, model=None) -> str:
    if not page:
        return ""
    model = tree() if model is None else model
    found = blocks(page)
    rows = rows_of([f[1:] for f in found])
    return "\n".join(f[0] for f, row in zip(found, rows) if kept(model, row))


def extract(pages: DataFrame, html: str = "html", into: str = "text", **columns: str) -> DataFrame:
    """(keyword columns..., text, n_chars) per input row."""
    from pyspark.sql import types as T

    model = tree()
    inner = pages.select(F.struct(*(F.col(c).alias(n) for n, c in columns.items())).alias("row"), F.col(html).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [main_text(x.as_py(), model) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["row", into, "n_chars"])

    schema = T.StructType([inner.schema["row"], T.StructField(into, T.StringType()), T.StructField("n_chars", T.LongType())])
    return inner.mapInArrow(run, schema).select("row.*", into, "n_chars")
