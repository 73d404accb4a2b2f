"""HTML extraction: content and boilerplate are separated by a minimum cut.

A page is cut into text blocks.  Each block is a node.  A classifier gives its cost as content and as boilerplate, which are its
capacities to the two terminals: a logistic model of the block's text (length, end of a sentence, heading, share of
links), trained on a bounded sample of the pages by the blocks that their elements name, and the elements' own evidence.
Neighbouring blocks, and blocks under one parent, are joined by smoothness edges that get weaker with their distance in the
DOM and where a named element begins or ends.  The blocks on the source's side of a maximum flow are the main text: a short line
between paragraphs stays with them, a line without a link in a list of links goes with the list.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# HTML element names.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
RAW_TAGS = frozenset("script style noscript template textarea title iframe svg object canvas".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends an open element of these names, up to the nearest scope.
IMPLIED_END = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
CONTENT_TAGS = frozenset(["article", "main"])
BOILERPLATE_TAGS = frozenset(["nav", "footer", "aside", "menu", "dialog", "button", "select", "search", "fieldset"])
#: Words of class names and ids that name boilerplate, and those that may also be part of an article's own name.
BOILERPLATE_WORDS = frozenset("ad ads adv advert advertisement advertising adverts breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus dropdown footer gdpr login masthead nav navbar navigation newsletter outbrain pagination replies reply respond sidebar signup sponsor sponsored subscribe taboola toolbar topbar".split())
DOUBTFUL_WORDS = frozenset("banner menu modal notice notices notification popup promo promoted promotion recommended related search share sharing skip social widget".split())
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
BOILERPLATE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+")
SENTENCE_END = re.compile(r"""[.!?…。]["'”»)]*$""")

# Evidence of elements, in hundredths of log-odds for content: a block under none that tells, in an article, in a form, under a
# word that may mean either, in a boilerplate element.
UNMARKED, IN_CONTENT, IN_FORM, DOUBTFUL, IN_BOILERPLATE = 80, 300, -399, -60, -400
#: The most that the text itself and the share of links can say.
TEXT_MOST, LINKS_MOST = 70, 200
#: Smoothness between neighbours and between blocks under one parent, at DOM distance 0; where one of two blocks is in a named
#: element and the other is not, a quarter.
NEIGHBOUR, SIBLING = 120, 60
#: Pages that the text classifier is trained on, about, and the weights where they hold too few named blocks.
TRAIN_PAGES, BLOCKS_A_PAGE, LEAST_BLOCKS = 2000, 20, 50
#: Bias, length, end of a sentence, heading, share of links.
PLAIN_WEIGHTS = np.array([-80.0, 160.0, 80.0, 100.0, -240.0])


@dataclass
class Block:
    text: str
    depth: int
    low: int
    parent: int
    content: bool
    mark: int
    heading: bool
    linked: int


def marks(tag: str, attributes: str, inside_content: bool) -> int:
    """What an element says of its text: IN_CONTENT, IN_BOILERPLATE, IN_FORM, DOUBTFUL, or 0 for nothing."""
    if tag in BOILERPLATE_TAGS or tag == "header" and not inside_content:
        return IN_BOILERPLATE
    if attributes and "=" in attributes:
        doubtful = False
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value = (a or b or c).lower()
            if name.lower() == "role":
                if value in BOILERPLATE_ROLES:
                    return IN_BOILERPLATE
                if value in ("main", "article"):
                    return IN_CONTENT
            elif tag not in ("body", "html", "article", "main"):
                words = WORDS.findall(value)
                if not BOILERPLATE_WORDS.isdisjoint(words) or "header" in words and not inside_content:
                    return IN_BOILERPLATE
                if not DOUBTFUL_WORDS.isdisjoint(words):
                    if CONTENT_WORDS.isdisjoint(words):
                        return IN_BOILERPLATE
                    doubtful = True
        if doubtful:
            return DOUBTFUL
    return IN_FORM if tag == "form" else IN_CONTENT if tag in CONTENT_TAGS else 0


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page, in order.  One pass; work for a tag does not grow with the depth it stands at."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, int]] = []  # name, own mark, number, mark in force (of all around)
    where: dict[str, list[int]] = {}  # name -> its places in the stack
    content = links = 0
    parts: list[str] = []
    linked = number = at = low = 0

    def close() -> None:
        nonlocal parts, linked, low
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                own = stack[-1] if stack else ("", 0, 0, 0)
                out.append(Block(text, len(stack), low, stack[-2][2] if len(stack) > 1 else 0, content > 0, own[3], own[0] in HEADINGS, linked))
                low = len(stack)
            parts, linked = [], 0

    def pop() -> None:
        nonlocal content, low
        name, mark, _, _ = stack.pop()
        where[name].pop()
        content -= mark == IN_CONTENT
        low = min(low, len(stack))

    def last(names: tuple[str, ...]) -> int:
        return max((where[n][-1] for n in names if where.get(n)), default=-1)

    while True:
        m = TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            parts.append(text)
            if links > 0:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, ends = tag.lower(), m[1] or m[4]
        if tag in RAW_TAGS:
            if not ends:
                found = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = found.end() if found else len(page) if tag in ("script", "style") else at
                parts.append(" ")
            continue
        if tag == "a":
            links = max(0, links - 1) if ends else links + 1
            continue
        if tag not in BLOCK_TAGS:
            if tag == "br":
                parts.append(" ")
            continue
        close()
        links = 0
        if ends:
            if where.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if stack and stack[-1][0] == "p":
            pop()
        if tag in IMPLIED_END:
            names, scopes = IMPLIED_END[tag]
            k = last(names)
            if k > last(scopes):
                while len(stack) > k:
                    pop()
        if tag in VOID_TAGS:
            continue
        mark = marks(tag, m[3] or m[6] or "", content > 0)
        around = stack[-1][3] if stack else 0
        # an article inside a form is an article; other boilerplate holds for all that is in it
        force = 0 if mark == IN_CONTENT and around == IN_FORM else min(mark, around, 0)
        number += 1
        where.setdefault(tag, []).append(len(stack))
        stack.append((tag, mark, number, force))
        content += mark == IN_CONTENT
    close()
    return out


def features(b: Block) -> list[float]:
    n = len(b.text)
    return [1.0, min(math.log2(1 + n), 10) / 10, float(SENTENCE_END.search(b.text) is not None), float(b.heading), min(b.linked, n) / n]


def preferences(blocks: list[Block], weights: np.ndarray) -> list[int]:
    """Log-odds of content in hundredths: the text's and the elements'."""
    if not blocks:
        return []
    x = np.array([features(b) for b in blocks])
    text = np.clip(x[:, :-1] @ weights[:-1], -TEXT_MOST, TEXT_MOST) + np.clip(x[:, -1] * weights[-1], -LINKS_MOST, 0)
    return [round(t) + (b.mark if b.mark else IN_CONTENT if b.content else UNMARKED) for t, b in zip(text.tolist(), blocks)]


def edges_of(blocks: list[Block]) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        j = last.get(b.parent, i - 1)
        for k, weight in ((i - 1, NEIGHBOUR), (j, SIBLING)) if 0 <= j < i - 1 else ((i - 1, NEIGHBOUR),):
            if k >= 0:
                a = blocks[k]
                # neighbours: steps up to the lowest element between them and down again; siblings: one up, one down
                steps = a.depth + b.depth - 2 * b.low if k == i - 1 else 2
                out.append((k, i, weight * 2 // ((2 + steps) * (1 if (a.mark < 0, a.content) == (b.mark < 0, b.content) else 4))))
        last[b.parent] = i
    return [e for e in out if e[2] > 0]


def content_side(prefer: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source after a maximum flow (in phases of shortest paths).

    A node's two terminal capacities are already cancelled against each other, so it hangs on
    one terminal only: positive preferences on the source, negative ones on the sink."""
    n = len(prefer)
    supply, demand = [max(p, 0) for p in prefer], [max(-p, 0) for p in prefer]
    near: list[list[int]] = [[] for _ in range(n)]  # the edges at a node; edge e and e ^ 1 are one pair
    to: list[int] = []
    room: list[int] = []
    for a, b, w in edges:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to += [b, a]
        room += [w, w]
    while True:
        level = [-1] * n
        front = [i for i in range(n) if supply[i]]
        for i in front:
            level[i] = 0
        order, found = list(front), False
        while front and not found:
            behind = []
            for x in front:
                for e in near[x]:
                    y = to[e]
                    if room[e] and level[y] < 0:
                        level[y] = level[x] + 1
                        found |= demand[y] > 0
                        behind.append(y)
            order += behind
            front = behind
        if not found:
            return [x >= 0 for x in level]
        at = [0] * n
        for root in order:
            if level[root]:
                break
            while supply[root]:
                path, x = [], root
                while not demand[x] or not level[x]:
                    while at[x] < len(near[x]) and not (room[near[x][at[x]]] and level[to[near[x][at[x]]]] == level[x] + 1):
                        at[x] += 1
                    if at[x] < len(near[x]):
                        path.append(near[x][at[x]])
                        x = to[path[-1]]
                    elif path:
                        x = to[path.pop() ^ 1]
                        at[x] += 1
                    else:
                        break
                if not path:
                    break
                flow = min(supply[root], demand[x], *(room[e] for e in path))
                supply[root] -= flow
                demand[x] -= flow
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow


def kept_blocks(blocks: list[Block], weights: np.ndarray = PLAIN_WEIGHTS) -> list[bool]:
    return content_side(preferences(blocks, weights), edges_of(blocks))


def main_text(page: str | None, weights: np.ndarray = PLAIN_WEIGHTS) -> str:
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, kept in zip(blocks, kept_blocks(blocks, weights)) if kept)


def train_weights(x: np.ndarray, y: np.ndarray, steps: int = 12, penalty: float = 0.01) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps, both classes of equal weight; in hundredths of log-odds."""
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max(len(y) - y.sum(), 1))
    w, ridge = np.zeros(x.shape[1]), penalty * np.diag([0.0] + [1.0] * (x.shape[1] - 1)) + 1e-6 * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (share * (p - y)) + ridge @ w)
    return 100 * w


def fit_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", train_pages: int = TRAIN_PAGES) -> np.ndarray:
    """Weights of the text classifier from about ``train_pages`` pages (by the hash of the id; a bounded sample), whose blocks
    in articles count as content and whose blocks in navigation, footers, asides and the like as boilerplate.  With fewer than
    LEAST_BLOCKS of either: the plain weights."""
    n = pages.count()
    spread = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    drawn = pages.where(spread < min(1.0, train_pages / max(n, 1))).limit(2 * train_pages).select(F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page in batch.column(0):
                # of each page a bounded number of blocks, and the same of either kind
                told = [(b, b.mark == 0) for b in blocks_of(page.as_py() or "") if b.mark == IN_BOILERPLATE or b.mark == 0 and b.content]
                for kind in (True, False):
                    rows += [[*features(b), float(kind)] for b, own in told if own is kind][:BLOCKS_A_PAGE]
            x = np.array(rows, np.float64).reshape(-1, len(PLAIN_WEIGHTS) + 1)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], ["x"])

    got = np.concatenate([np.empty((0, len(PLAIN_WEIGHTS) + 1)), *(np.frombuffer(bytes(r.x), np.float64).reshape(-1, len(PLAIN_WEIGHTS) + 1) for r in drawn.mapInArrow(run, "x binary").collect())])
    x, y = got[:, :-1], got[:, -1]
    return train_weights(x, y) if min(y.sum(), len(y) - y.sum()) >= LEAST_BLOCKS else PLAIN_WEIGHTS


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text, n_chars: the main text of whole pages, by the ``weights`` of the text classifier (by default trained
    on a sample of the pages themselves).

    Null and empty html give an empty text, an empty table no rows; null ids and urls and repeated rows stay, one result row
    each; other columns are ignored.  Very long and very deep pages are taken whole: the work grows with their length, not
    with their depth."""
    weights = fit_weights(pages, id_col, html_col) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
