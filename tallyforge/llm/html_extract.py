"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text.  A logistic classifier over each block's text and
surroundings gives its costs as content and as boilerplate, which become the capacities
of its edges to the two terminals; blocks next to each other, and next ones of the
same parent, are tied by smoothness edges that weaken with their distance in the
document tree.  The maximum flow's minimum cut labels all blocks of a page at once.

The classifier's weights for the text are fitted on a bounded sample of the pages, where
blocks below article or main elements are taken as content and blocks below
navigation, footers, forms and the like as boilerplate; without such blocks they stay
at their defaults.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mroot mrow ms msqrt msub msubsup msup mtext munder munderover q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style template textarea title iframe".split())  # to the end of the page, if never closed
SKIPPED = frozenset("noscript object svg canvas audio video select button".split())
BOILER = frozenset("nav footer aside menu dialog fieldset legend option datalist".split())
CONTENT = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p blockquote pre li td dd".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table div section article main body html td th blockquote".split())

#: Parts of class, id and role names that tell of boilerplate; of those in WEAK only where no part in GOOD stands beside.
BAD = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu sidebar footer foot breadcrumb breadcrumbs comment comments disqus reply replies respond cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended recommendations widget copyright pagination pager search toolbar contentinfo complementary".split()
)
WEAK = frozenset("header masthead top alert legal".split())
GOOD = frozenset("article main content post entry story body text".split())
#: A name that begins so speaks of what the element does without, or has somewhere within.
ASIDE = frozenset("no not without with has have hide show is".split())

STRICT = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>?)|<[!?][^>]*+>", re.S)
SIMPLE = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(>?)|<[!?][^>]*+>", re.S)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true)|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
END = {n: re.compile(rf"</{n}\s*>", re.I) for n in (*RAW, *SKIPPED)}

#: Features of a block and their weights before any fit: first those of its text, then those of what it stands in.
TEXT_WEIGHTS = {"bias": -1.6, "length": 0.45, "links": -4.0, "sentence": 0.8, "signs": -2.0}
PLACE_WEIGHTS = {"own_links": 4.0, "paragraph": 0.8, "heading": 0.8, "item": -0.2, "hint": -8.0, "good": 1.0, "boiler": -8.0, "content": 3.0, "hidden": -10.0}
DEFAULT = (*TEXT_WEIGHTS.values(), *PLACE_WEIGHTS.values())
#: Smoothness of blocks that are one step apart, doubled; capacities are integers of 1 / SCALE.
SMOOTH, SCALE = 3.0, 1000
#: The most pages that the weights are fitted on, and how many blocks' worth the defaults count.
SAMPLE_PAGES, DEFAULT_COUNT = 2000, 140.0


@dataclass(eq=False)
class Node:
    name: str
    parent: Node | None
    depth: int
    hint: Node | None = None  # the nearest element, itself included, whose names tell of boilerplate
    good: bool = False
    boiler: bool = False
    content: bool = False
    hidden: bool = False
    heading: bool = False
    item: bool = False
    chars: int = 0  # of text below, in an element with a hint and in one of content
    plain: int = 0  # of these, in an element of content, those below no hint inside it
    within: Node | None = None  # the nearest element of content, itself included
    holds: set[str] = field(default_factory=set)  # of article, main, h1: what an element with a hint holds


@dataclass
class Block:
    text: str
    node: Node
    link_chars: int


def names_tell(attributes: str) -> int:
    """-1 if an element's names tell of boilerplate, 1 of content, 0 of neither or both."""
    bad = good = False
    for found in NAMES.findall(attributes):
        for name in " ".join(found).lower().split():
            parts = [p.rstrip("0123456789") for p in re.split(r"[-_:]", name)]
            if parts[0] not in ASIDE:
                fine = any(p in GOOD for p in parts)
                wrong = any(p in BAD for p in parts) or (not fine and any(p in WEAK for p in parts))
                bad, good = bad or wrong, good or (fine and not wrong)
    return good - bad


def open_node(name: str, attributes: str, parent: Node) -> Node:
    node = Node(name, parent, parent.depth + 1, parent.hint, parent.good, parent.boiler, parent.content, parent.hidden, parent.heading or name in HEADINGS, parent.item or name == "li", within=parent.within)
    if attributes and name not in ("body", "html"):
        told = names_tell(attributes)
        if told < 0:
            node.hint = node
        node.good |= told > 0
        node.hidden |= HIDDEN.search(attributes) is not None
    if name == "form":
        node.hint = node
    node.boiler |= name in BOILER or (name == "header" and not node.content)
    if name in CONTENT or name == "h1":
        up = node.parent.hint
        while up is not None and name not in up.holds:
            up.holds.add(name)
            up = up.parent.hint
    if name in CONTENT:
        node.content, node.within = True, node
    return node


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order, each with the element it lies in."""
    root = Node("", None, 0)
    stack, out, parts, linked = [root], [], [], 0
    open_names: dict[str, int] = {}
    at, links, token = 0, 0, STRICT

    def close_block() -> None:
        nonlocal parts, linked
        if parts:
            text = "".join(parts)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                node = next((n for n in reversed(stack) if n.name not in INLINE), root)
                out.append(Block(text, node, linked))
                up = node.hint
                while up is not None:
                    up.chars += len(text)
                    up = up.parent.hint
                up = node.within
                while up is not None:
                    up.chars += 0 if up.hint is up else len(text)
                    if not node.boiler and not node.hidden and (node.hint is None or node.hint.depth <= up.depth):
                        up.plain += len(text)
                    up = up.parent.within
        parts, linked = [], 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if links:
                linked += len(text)

    def cut_stack(k: int) -> None:
        nonlocal links
        for n in stack[k:]:
            open_names[n.name] -= 1
            links -= n.name == "a"
        del stack[k:]

    while True:
        m = token.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m[2] is not None and not m[4]:  # no end by its quotes: from here on quotes do not count
            token = SIMPLE
            m = token.match(page, m.start())
            if not m[4]:
                say(page[at:])
                break
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:  # an end tag
            if open_names.get(name):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == name:
                        if any(n.name not in INLINE for n in stack[k:]):
                            close_block()
                        cut_stack(k)
                        break
                    if name in INLINE and stack[k].name in SCOPES:
                        break
            continue
        if name in END:  # it and what it holds vanish from the text around
            if not m[3].endswith("/"):
                end = END[name].search(page, at)
                at = end.end() if end else len(page) if name in RAW else at
            continue
        if name in INLINE:
            if name in VOID:
                if name == "br":
                    say(" ")
                continue
        else:
            close_block()
            if name in VOID:
                continue
            ends = CLOSES.get(name, {"p"})
            if any(open_names.get(n) for n in ends):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in ends:
                        cut_stack(k)
                        break
                    if stack[k].name in SCOPES:
                        break
        stack.append(open_node(name, m[3], stack[-1]))
        open_names[name] = open_names.get(name, 0) + 1
        links += name == "a"
    close_block()
    return out


def features(blocks: list[Block]) -> list[tuple[float, ...]]:
    """A row for each block, in the order of the weights."""
    whole = sum(len(b.text) for b in blocks)
    stands: dict[int, bool] = {}

    def hinted(node: Node) -> bool:
        """Whether a hint holds.

        It doesn't for an element with the article or, under a first heading or in a form, most
        of the page's text, nor for one inside an article of which it would leave nothing.
        """
        up = node.hint
        while up is not None:
            if id(up) not in stands:
                most = 2 * up.chars > whole and ("h1" in up.holds or up.name == "form")
                inside = up.parent.within
                all_of_it = inside is not None and not inside.plain and 2 * up.chars > inside.chars
                stands[id(up)] = not (up.holds & CONTENT or most or all_of_it)
            if stands[id(up)]:
                return True
            up = up.parent.hint
        return False

    rows = []
    for b in blocks:
        n, node = len(b.text), b.node
        text = (1.0, math.log2(1 + n), min(b.link_chars / n, 1.0), b.text[-1] in ".!?:;\"')…。", any(c in b.text for c in "©®"))
        rows.append((*text, text[2] * node.content, node.name in PARAGRAPHS, node.heading, node.item, hinted(node), node.good, node.boiler, node.content, node.hidden))
    return rows


def apart(a: Node, b: Node) -> int:
    """Steps between two elements of the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def ties_of(blocks: list[Block]) -> dict[tuple[int, int], int]:
    """The smoothness edges of blocks and their capacities."""
    ties: dict[tuple[int, int], int] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        before = {i - 1} if i else set()
        parent = id(b.node.parent)
        if parent in last:
            before.add(last[parent])
        last[parent] = i
        for j in before:
            ties[j, i] = round(SMOOTH * SCALE / (1 + apart(blocks[j].node, b.node)))
    return ties


def minimum_cut(scores: Sequence[int], ties: dict[tuple[int, int], int]) -> list[bool]:
    """Which nodes stay on the source's side: a maximum flow from nodes above 0 to nodes below.

    A node whose own capacity is no less than all its ties has its label in some
    minimum cut, so it is settled first and its ties become capacities of its neighbours.
    What is left is solved by blocking flows over levels.
    """
    n, score = len(scores), list(scores)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for (a, b), w in ties.items():
        near[a][b] = near[b][a] = w
    free = [sum(x.values()) for x in near]  # ties to nodes that are not settled
    label: list[bool | None] = [None] * n
    ready = deque(i for i in range(n) if abs(score[i]) >= free[i])
    while ready:
        i = ready.popleft()
        if label[i] is not None:
            continue
        label[i] = score[i] > 0
        for j, w in near[i].items():
            if label[j] is None:
                score[j] += w if label[i] else -w
                free[j] -= w
                if abs(score[j]) >= free[j]:
                    ready.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if not rest:
        return label
    room = {i: {j: w for j, w in near[i].items() if label[j] is None} for i in rest}
    supply, demand = {i: max(score[i], 0) for i in rest}, {i: max(-score[i], 0) for i in rest}
    while True:
        level, queue = {i: 0 for i in rest if supply[i] > 0}, deque(i for i in rest if supply[i] > 0)
        found = False
        while queue:
            i = queue.popleft()
            found |= demand[i] > 0
            for j, w in room[i].items():
                if w > 0 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not found:
            return [x if x is not None else i in level for i, x in enumerate(label)]
        arcs = {i: iter(list(room[i])) for i in level}
        for source in [i for i in rest if supply[i] > 0]:
            path = [source]
            while path and supply[source] > 0:
                i = path[-1]
                if demand[i] > 0:
                    flow = min(supply[source], demand[i], *(room[a][b] for a, b in zip(path, path[1:])))
                    supply[source] -= flow
                    demand[i] -= flow
                    stop = len(path)
                    for k in range(len(path) - 2, -1, -1):
                        a, b = path[k], path[k + 1]
                        room[a][b] -= flow
                        room[b][a] += flow
                        if room[a][b] == 0:
                            stop = k + 1
                    if demand[i] == 0 or stop < len(path):
                        del path[stop if stop < len(path) else len(path) - 1 :]
                    continue
                j = next((j for j in arcs[i] if room[i][j] > 0 and level.get(j, -1) == level[i] + 1), None)
                if j is None:
                    path.pop()
                    level[i] = -1
                else:
                    path.append(j)


def labels(page: str, weights: Sequence[float] = DEFAULT) -> tuple[list[Block], list[int], list[bool]]:
    """A page's blocks, their scores (above 0: content) and whether the cut keeps them."""
    blocks = blocks_of(page)
    scores = [round(SCALE * sum(w * x for w, x in zip(weights, row))) for row in features(blocks)]
    return blocks, scores, minimum_cut(scores, ties_of(blocks))


def main_text(page: str, weights: Sequence[float] = DEFAULT) -> str:
    """The content blocks of a page, one a line."""
    blocks, _, keep = labels(page, weights)
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def fit(rows: np.ndarray, content: np.ndarray) -> tuple[float, ...]:
    """Weights by logistic regression of the text's features, drawn to the defaults; the weights of places stay.

    Each class counts half, however many blocks it has.
    """
    start = np.array([*TEXT_WEIGHTS.values()])
    w, k = start.copy(), len(start)
    if len(rows) and content.any() and not content.all():
        x = rows[:, :k]
        each = np.where(content, 0.5 / content.mean(), 0.5 / (1 - content.mean()))
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (each * (p - content)) + DEFAULT_COUNT * (w - start)
            bend = (x * (each * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + DEFAULT_COUNT * np.eye(k)
            step = np.linalg.solve(bend, slope)
            w = w - step / max(1.0, float(np.abs(step).max()))
    return (*w.tolist(), *PLACE_WEIGHTS.values())


def known(row: Sequence[float]) -> bool | None:
    """Whether a block's place tells that it is content or boilerplate; None if it tells neither."""
    at = dict(zip((*TEXT_WEIGHTS, *PLACE_WEIGHTS), row))
    if at["hint"] or at["boiler"] or at["hidden"]:
        return False
    return True if at["content"] else None


def fit_weights(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, html_col: str = "html") -> tuple[float, ...]:
    """Weights fitted on the blocks of at most sample_pages pages, the first by a hash of their text, whose places tell what they are."""
    html = pages.select(F.col(html_col).cast("string").alias("html")).where("html is not null and html != ''")
    total = html.count()
    share = min(1.0, 1.2 * sample_pages / total) if total else 1.0  # so that no partition sends more than its part
    some = html.withColumn("h", F.xxhash64("html")).where(F.col("h") < int(min(2.0 * share - 1, 1.0) * (2**63 - 1024))).orderBy("h").limit(sample_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(TEXT_WEIGHTS)
        for batch in batches:
            kinds: dict[tuple, int] = {}
            for page in batch["html"]:
                for row in features(blocks_of(page.as_py())):
                    told = known(row)
                    if told is not None:
                        kinds[row[:k], told] = kinds.get((row[:k], told), 0) + 1
            yield pa.record_batch({"x": pa.array([[float(v) for v in r] for r, _ in kinds], pa.list_(pa.float64())), "content": pa.array([bool(c) for _, c in kinds], pa.bool_()), "n": pa.array(list(kinds.values()), pa.int64())})

    told = some.select("html").mapInArrow(run, "x array<double>, content boolean, n long").groupBy("x", "content").agg(F.sum("n").alias("n")).collect()
    if not told:
        return DEFAULT
    n = np.array([r.n for r in told])
    return fit(np.repeat(np.array([r.x for r in told]), n, axis=0), np.repeat(np.array([r.content for r in told]), n))


def extract_main_text(pages: DataFrame, weights: Sequence[float] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text (empty if none), n_chars (its code points).

    Blocks keep page order and are joined by one newline; character references are decoded
    and white space in a block becomes one space.  A null or empty page gives an empty
    text; null ids and urls stay null; repeated rows each count; other columns are ignored; an
    empty table gives no rows.  Without weights they are fitted on a sample (fit_weights).
    """
    weights = tuple(weights) if weights is not None else fit_weights(pages, html_col=html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "", weights) for x in batch["html"]]
            yield pa.record_batch({"page_id": batch["page_id"], "url": batch["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
