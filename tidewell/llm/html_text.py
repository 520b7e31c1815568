"""HTML extraction by minimum cut: blocks of text are content or boilerplate, whichever labelling costs least.

A page is cut into blocks at block-level tags. A linear classifier over a block's words, links and punctuation gives the
cost of each label, the capacities of its edges to the two terminals. Elements that tell something by their tag or names
are nodes too: an article, a menu, a sidebar. Edges between a block and its nearest such element, between that and the
next one out, between blocks next to each other, and between blocks of one container charge for labels that differ. The
minimum cut labels blocks and elements of a page at once, so that a short line stays with the article that holds it, and
a long one goes with its sidebar.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import table, text_batches

# Tags of the HTML standard by what they do to text.
#: Their contents are no text.
RAW = {"script", "style", "noscript", "template", "svg", "math", "head", "iframe", "object", "canvas", "audio", "video"}
#: Text inside runs on over them.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Their blocks never are content.
BOILERPLATE = {"nav", "footer", "aside", "header", "form", "button", "select", "textarea", "dialog", "menu", "fieldset", "option"}
CONTENT = {"article", "main"}
#: Opening one of the keys ends an open one of the values, up to a tag of SCOPE.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "select", "menu"}
#: Words of a class, id or role that tell boilerplate. A name of such words alone tells it of the element; beside other words
#: ("post-share") they tell less, and nothing where ABOUT says that they are of something within. HINTS are weaker.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead "
    "comment comments disqus cookie cookies consent notice notices newsletter subscribe popup modal form share sharing social widget complementary contentinfo search".split()
)
HINTS = set("related recommended widget widgets toolbar login tags meta byline pagination pager copyright legal disclaimer alert reply replies respond header top bottom side links".split()) - MARKS
ABOUT = {"has", "with", "no", "without"}
GOOD = set("article content main post entry story body text prose".split())

# Weights of the classifier, in units of the cut: for content above zero, for boilerplate below.
BIAS, PARAGRAPH, HEADING, PER_WORD, MOST_WORDS, LINKED, LIST, STOPS = -5, 3, 3, 0.3, 12, -16, -2, 2
#: Costs of elements: articles; menus and the like, and names of marks alone; names with a mark beside other words; hints; good names.
ARTICLE, CERTAIN, MARKED, HINTED, NAMED_GOOD = 200, -60, -14, -6, 4
#: Charges between an element and its blocks, by what its cost is; and between an element of marks or hints and the next one out.
HOLDS_CONTENT, HOLDS_CERTAIN, HOLDS_OTHER, WITHIN = 10, 24, 6, 6
#: Charges for labels that differ: neighbours on the page, less for each step between them in the tree; the next block of one container.
NEXT, STEP, SIBLING = 4, 1, 2
#: Open block-level tags, from the innermost, that a block's place in the tree is told by: more steps than that cost nothing.
NEAR = 24
UNIT = 4  # capacities are whole numbers of quarters

_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>|<[!?/][^>]*>|<(?=[a-zA-Z/!?])[^>]*\Z", re.S)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW | {"textarea", "title"}}
_ALONE = {"head", "object"}  # their contents are tags, which are followed


class Block:
    __slots__ = ("text", "linked", "path", "holder", "tag")


def _names(attributes: str) -> tuple[set[str], bool, bool]:
    """(words of the class, id and role, whether one is of MARKS alone, whether one has a mark beside other words)."""
    words, alone, beside = set(), False, False
    if "=" in attributes:
        for name in " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)).split():
            parts = set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())) - {""}
            words |= parts
            if parts & MARKS:
                alone |= parts <= MARKS
                beside |= not parts <= MARKS and not parts & ABOUT
    return words, alone, beside


def evidence(name: str, attributes: str, in_article: bool) -> int:
    """The cost of an element by its tag and names; 0 where they tell nothing."""
    if name in ("html", "body"):
        return 0
    words, alone, beside = _names(attributes)
    if name in CONTENT:
        return ARTICLE
    if alone or name in BOILERPLATE and not (name == "header" and in_article):  # an article's header has its title
        return CERTAIN
    if name in INLINE:
        return 0
    return MARKED * beside + HINTED * bool(words & HINTS) + NAMED_GOOD * bool(words & GOOD)


def blocks(page: str) -> tuple[list[Block], list[tuple[int, int]]]:
    """The blocks of a page in order, and the elements that tell something: (cost, the next one out or -1).

    A tag that nothing closes holds until its parent is closed, or to the end.
    """
    out: list[Block] = []
    elements: list[tuple[int, int]] = []
    # Open tags: name, number, no text, linked, nearest element.
    stack: list[tuple] = [("", 0, False, False, -1)]
    parts: list[str] = []
    linked = number = 0
    holder = -1

    def end() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                b = Block()
                b.text, b.linked, b.holder = text, min(1.0, linked / len(text)), holder
                b.path = [x[1] for x in stack if x[0] not in INLINE][-NEAR:]
                b.tag = next((x[0] for x in reversed(stack) if x[0] not in INLINE), "")
                out.append(b)
        linked = 0

    def add(text: str) -> None:
        nonlocal linked, holder
        top = stack[-1]
        if not top[2] and text:
            parts.append(text)
            if not text.isspace():
                holder = top[4] if len(parts) == 1 or top[4] >= 0 and elements[top[4]][0] <= CERTAIN else holder
                linked += len(text) if top[3] else 0

    at = 0
    while True:
        m = _TAG.search(page, at)
        add(page[at : m.start() if m else len(page)])
        if not m:
            break
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            known = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if name == "p" and not known or name not in INLINE:
                end()
            if known and not (name in INLINE and any(x[0] not in INLINE for x in stack[known:])):
                del stack[known:]
            continue
        if name in INLINE:
            if name == "br":
                add(" ")
        else:
            end()
            while len(stack) > 1 and (stack[-1][0] in INLINE or stack[-1][0] == "p"):
                stack.pop()  # a paragraph, and what is open in it, ends where a block begins
            closes = CLOSES.get(name)
            if closes:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in closes:
                        del stack[i:]
                        break
                    if stack[i][0] in SCOPE:
                        break
        if name in VOID or m[3].endswith("/") and name in RAW:
            continue
        if name in _END and name not in _ALONE:
            close = _END[name].search(page, at)
            if name in RAW:
                at = close.start() if close else len(page)
        top, number = stack[-1], number + 1
        cost_, nearest = evidence(name, m[3], top[0] in CONTENT), top[4]
        if cost_:
            elements.append((cost_, nearest))
            nearest = len(elements) - 1
        stack.append((name, number, top[2] or name in RAW, top[3] or name == "a", nearest))
    end()
    return out, elements


def cost(b: Block) -> int:
    """Above zero: what it costs to call the block boilerplate; below: to call it content."""
    words = b.text.count(" ") + 1
    s = BIAS + min(MOST_WORDS, PER_WORD * words) + LINKED * b.linked
    s += PARAGRAPH * (b.tag in ("p", "blockquote", "pre", "")) + HEADING * (b.tag in ("h1", "h2", "h3", "h4", "h5", "h6")) + LIST * (b.tag == "li") + STOPS * (b.text[-1] in ".!?…。")
    return round(s * UNIT)


def edges(found: list[Block], elements: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(i, j, charge) between neighbours, a block and the next one of its container, blocks and their elements (numbered after
    the blocks), and elements within each other."""
    out, last, n = [], {}, len(found)
    for i, b in enumerate(found):
        if i:
            up = {x: k for k, x in enumerate(reversed(found[i - 1].path))}
            steps = next((k + up[x] - 2 for k, x in enumerate(reversed(b.path)) if x in up), NEXT)
            if NEXT - STEP * steps > 0:
                out.append((i - 1, i, (NEXT - STEP * steps) * UNIT))
        holder = tuple(b.path[-2:-1])
        if holder in last and last[holder] != i - 1:
            out.append((last[holder], i, SIBLING * UNIT))
        last[holder] = i
        if b.holder >= 0:
            c = elements[b.holder][0]
            out.append((i, n + b.holder, (HOLDS_CONTENT if c >= ARTICLE else HOLDS_CERTAIN if c <= CERTAIN else HOLDS_OTHER) * UNIT))
    return out + [(n + i, n + outer, WITHIN * UNIT) for i, (c, outer) in enumerate(elements) if outer >= 0 and CERTAIN < c < ARTICLE]


def minimum_cut(costs: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """True for the nodes on the content side: maximum flow by shortest augmenting paths in levels.

    A node's supply (cost above zero) comes from the source and its demand (below) goes to the sink.
    """
    n = len(costs)
    to: list[list[list]] = [[] for _ in range(n)]
    for i, j, c in links:
        a, b = [j, c, None], [i, c, None]
        a[2], b[2] = b, a
        to[i].append(a)
        to[j].append(b)
    left = list(costs)
    while True:
        level = [0 if x > 0 else -1 for x in left]
        queue = deque(i for i in range(n) if left[i] > 0)
        reached = False
        while queue:
            i = queue.popleft()
            for j, c, _ in to[i]:
                if c > 0 and level[j] < 0:
                    level[j] = level[i] + 1
                    reached |= left[j] < 0
                    queue.append(j)
        if not reached:
            return [x >= 0 for x in level]
        place = [0] * n
        for s in range(n):
            path: list[list] = []
            i = s
            while left[s] > 0:
                if left[i] < 0:
                    flow = min(left[s], -left[i], *(e[1] for e in path))
                    for e in path:
                        e[1] -= flow
                        e[2][1] += flow
                    left[s] -= flow
                    left[i] += flow
                    path, i = [], s
                    continue
                while place[i] < len(to[i]) and not (to[i][place[i]][1] > 0 and level[to[i][place[i]][0]] == level[i] + 1):
                    place[i] += 1
                if place[i] < len(to[i]):
                    path.append(to[i][place[i]])
                    i = path[-1][0]
                elif path:
                    path.pop()
                    i = path[-1][0] if path else s
                    place[i] += 1
                else:
                    break


def labelled(page: str) -> tuple[list[Block], list[int], list[bool]]:
    """(blocks, their own costs, which of them are content)."""
    found, elements = blocks(page)
    costs = [cost(b) for b in found]
    return found, costs, minimum_cut(costs + [c * UNIT for c, _ in elements], edges(found, elements))[: len(found)]


def main_text(page: str) -> str:
    """The content blocks of a page, one a line; empty if there is none."""
    found, _, keep = labelled(page)
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def _extract(batches):
    for b in batches:
        texts = [main_text(h or "") for h in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of each row of pages; one pass, no shuffle.

    Null html counts as empty, and a page without content has an empty text. Ids and urls may be null and repeated;
    an empty table gives no rows; extra columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return text_batches(rows, _extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
