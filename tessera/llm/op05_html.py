"""HTML extraction by minimum cut.

A page becomes blocks of text in page order. A logistic classifier over a block's text and place, plus the marks its
containers carry (tags, class and id words), gives each block a cost of being content or boilerplate; these are its
capacities to the two terminals. Marks and classifier are of one scale, so neither decides alone. Blocks that follow each
other or share a container are tied by smoothness edges, weaker where their marks differ. The minimum cut, found by
maximum flow, parts content from boilerplate.

The classifier is trained on at most TRAIN_PAGES pages, drawn by a hash of page_id: blocks inside semantic containers
(article, main; nav, footer, aside and the like) are its examples, and it sees only text and place, not containers, so
that it can judge pages without such marks. Each example is also given without its own tag, for pages built of div alone.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import released, table

TRAIN_PAGES = 500
#: Smoothness: of neighbours in page order, of blocks that follow each other in one container, and the decay of both, by
#: distance in the DOM and by the blocks between.
NEAR, KIN, DECAY = 0.6, 1.0, 0.35
HARD = 50.0

BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html iframe legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup, or no text of a page. Without an end tag the first take the rest of the page, as in
#: browsers; the others are then read as ordinary elements.
TO_THE_END = set("script style textarea title template".split())
RAW = TO_THE_END | set("svg iframe select canvas audio video".split())
SKIPPED = {"head"}
#: Containers that are never content, ones that speak against it (with what weight), and ones that speak for it.
NEVER = set("form button dialog".split())
AGAINST_TAGS = set("nav footer aside menu noscript".split())
AGAINST_ROLES = set("navigation banner contentinfo complementary search".split())
AGAINST, AGAINST_TAG = 4.0, 5.0
FOR = {"article": 3.0, "main": 2.0}
AGAINST_WORDS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disqus feedback footer gdpr header login masthead menu modal nav navbar navigation newsletter notice "
    "pager pagination pingback popup promo promoted promotion recommended related reply replies respond rss search share sharing shout sidebar signup skip social sponsor sponsored subscribe tags teaser toolbar topbar widget".split()
)
FOR_WORDS = set("article articlebody body content entry main post story text".split())
#: An element that one of the second closes when it opens.
CLOSES = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}

#: What a container may close: open elements that one of these keeps are left.
KEEPS = "ul ol dl table tbody thead div section article main nav aside".split()

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<[a-zA-Z][^<>]*(?:>|\Z)",
    re.S | re.I,
)
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_PART = re.compile(r"[A-Za-z][a-z]+|[A-Z]+|\d+")


@dataclass
class Block:
    """A run of text between block-level tags.

    ``depth`` counts its open block elements, ``common`` those it shares with the block before, ``holder`` is the number
    of the one around its own. ``prior`` is what its containers' marks say for it, ``semantic`` the nearest container's
    kind (1 content, -1 boilerplate, 0 neither).
    """

    text: str
    linked: float
    depth: int
    common: int
    holder: int
    tag: str
    prior: float
    never: bool
    semantic: int


@dataclass
class Open:
    """An open element with what holds for all that it contains."""

    tag: str
    number: int
    block: int  # its number or that of the nearest block element around it
    holder: int
    depth: int
    kind: str
    speaks_for: float
    speaks_against: float
    never: bool
    semantic: int


def _marks(tag: str, attrs: str, inside_article: bool) -> tuple[float, float, bool]:
    """What an element says for and against its text being content, and whether it rules that out."""
    good, never = FOR.get(tag, 0.0), tag in NEVER
    bad = AGAINST_TAG if tag in AGAINST_TAGS or tag == "header" and not inside_article else 0.0
    if attrs:
        for name, a, b, c, hidden in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if hidden or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                never = True
            elif name in ("class", "id", "role"):
                words = {w.lower() for w in _PART.findall(value)}
                if words & AGAINST_WORDS or name == "role" and value in AGAINST_ROLES:
                    bad = max(bad, AGAINST)
                elif words & FOR_WORDS:
                    good += 1.0
    return good, bad, never


def blocks(page: str) -> list[Block]:
    """The text blocks of a page; broken markup is read as browsers do, by closing what must be closed.

    Every open element carries what its ancestors say, and open elements are found by tag, so that time doesn't grow
    with depth.
    """
    out: list[Block] = []
    root = Open("", 0, 0, 0, 0, "", 0.0, 0.0, False, 0)
    stack = [root]
    places: dict[str, list[int]] = {}
    parts: list[str] = []
    hopeless: set[str] = set()
    linked, number, at, shared = 0, 0, 0, 0

    def last(tag: str) -> int:
        return places[tag][-1] if places.get(tag) else 0

    def flush() -> None:
        nonlocal linked, shared
        if parts:
            raw = "".join(parts)
            text = " ".join(htmllib.unescape(raw).split())
            if text:
                top = stack[-1]
                prior = -top.speaks_against if top.speaks_against else top.speaks_for
                out.append(Block(text, min(1.0, linked / max(1, len(raw))), top.depth, min(shared, top.depth), top.holder, top.kind, prior, top.never, top.semantic))
                shared = top.depth
            parts.clear()
            linked = 0

    def close(to: int) -> None:
        nonlocal shared
        if stack[-1].depth > stack[to - 1].depth:
            flush()
        while len(stack) > to:
            places[stack.pop().tag].pop()
        shared = min(shared, stack[-1].depth)

    def add(text: str) -> None:
        nonlocal linked
        if text and not any(places.get(tag) for tag in SKIPPED):
            parts.append(text)
            if places.get("a"):
                linked += len(text)

    while m := _TOKEN.search(page, at) if page.find(">", at) >= 0 else None:
        add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if last(tag):
                close(last(tag))
            elif tag in BLOCK:
                flush()
            continue
        if tag in RAW and tag not in hopeless:
            end = _ENDS[tag].search(page, at)
            if end or tag in TO_THE_END:
                at = end.end() if end else len(page)
                continue
            hopeless.add(tag)
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCK:
            closed = max((last(t) for t, by in CLOSES.items() if tag in by), default=0)
            if closed > max(map(last, KEEPS)):
                close(closed)
            if tag == "body" and last("head"):
                close(places["head"][0])
            flush()
        if tag in VOID or m["attrs"].endswith("/") and tag not in BLOCK:
            continue
        number += 1
        up = stack[-1]
        good, bad, never = _marks(tag, m["attrs"], bool(last("article") or last("main")))
        kind = -1 if never or bad else 1 if tag in FOR else up.semantic
        inner = (number, up.block, up.depth + 1, tag) if tag in BLOCK else (up.block, up.holder, up.depth, up.kind)
        places.setdefault(tag, []).append(len(stack))
        stack.append(Open(tag, number, *inner, up.speaks_for + good, max(up.speaks_against, bad), up.never or never, kind))
    rest = re.search(r"<[a-zA-Z][^<>]*\Z", page[at:]) if "<" in page[at:] else None
    add(page[at : at + rest.start()] if rest else page[at:])
    flush()
    return out


#: The features that tell a block's own tag.
TAGS = [5, 6, 7]


def block_features(found: list[Block]) -> np.ndarray:
    """Text and place of each block, without its containers' marks."""
    n = len(found)
    out = np.zeros((n, 12), np.float64)
    for i, b in enumerate(found):
        words = b.text.split(" ")
        ends = sum(b.text.count(c) for c in ".!?;:")
        out[i] = (
            np.log1p(len(words)), b.linked, np.log1p(ends), ends > 0 and b.text[-1] in ".!?\"'", sum(map(len, words)) / len(words) / 10,
            b.tag == "li", b.tag in ("p", "pre", "blockquote"), b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), min(b.depth, 100) / 10, i / n, (n - 1 - i) / n, sum(w[:1].isupper() for w in words) / len(words),
        )
    return out


#: Used where no page of the sample has semantic containers: length, links, sentences and paragraphs decide.
DEFAULT_WEIGHTS = np.array([0.8, -4.0, 0.6, 0.6, 0.0, -1.2, 1.0, 0.4, 0.0, 0.0, 0.0, -0.5, -1.6])


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton's method, classes balanced; the last weight is the intercept."""
    if len(set(y)) < 2:
        return DEFAULT_WEIGHTS
    z = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def max_flow(n: int, edges: list[tuple[int, int, float, float]], source: int, sink: int) -> np.ndarray:
    """The nodes on the source's side of a minimum cut (Dinic). Edges: from, to, capacity forth and back."""
    to, cap, out = [], [], [[] for _ in range(n)]
    for a, b, forth, back in edges:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to += [b, a]
        cap += [forth, back]
    while True:
        level = [-1] * n
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return np.array([x >= 0 for x in level])
        turn, path = [0] * n, []
        at = source
        while True:
            if at == sink:
                push = min(cap[e] for e in path)
                cut = next(i for i, e in enumerate(path) if cap[e] <= push)
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                at = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[at] < len(out[at]):
                e = out[at][turn[at]]
                if cap[e] > 1e-9 and level[to[e]] == level[at] + 1:
                    break
                turn[at] += 1
            if turn[at] < len(out[at]):
                path.append(e)
                at = to[e]
            elif path:
                at = to[path.pop() ^ 1]
                turn[at] += 1
            else:
                break


def costs(found: list[Block], weights: np.ndarray) -> np.ndarray:
    """What each block gains as content: the classifier's margin and its containers' marks, both finite.

    Only hidden text, forms and buttons are ruled out; against any other mark a sure classifier and neighbours can win.
    """
    if not found:
        return np.zeros(0)
    margin = np.clip(np.hstack([block_features(found), np.ones((len(found), 1))]) @ weights, -4, 4)
    return np.where([b.never for b in found], -HARD, margin + np.clip([b.prior for b in found], -AGAINST_TAG, 4.0))


def alike(a: Block, b: Block) -> float:
    """How much of a smoothness edge is left between blocks whose containers' marks differ."""
    return float(np.exp(-abs(a.prior - b.prior) / 2)) if a.never == b.never else 0.0


def label(found: list[Block], weights: np.ndarray) -> np.ndarray:
    """Which blocks are content, by the minimum cut of the page's graph."""
    n = len(found)
    cost = costs(found, weights)
    if n == 0 or (cost >= 0).all() or (cost < 0).all():
        return cost >= 0  # no edge to cut
    edges = [(n, i, c, 0.0) if c >= 0 else (i, n + 1, -c, 0.0) for i, c in enumerate(cost)]
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            apart = b.depth + found[i - 1].depth - 2 * b.common
            tie = NEAR * np.exp(-DECAY * apart) * alike(b, found[i - 1])
            edges.append((i - 1, i, tie, tie))
        if b.holder in last:
            before = last[b.holder]
            tie = KIN * np.exp(-DECAY * (i - before - 1)) * alike(b, found[before])
            edges.append((before, i, tie, tie))
        last[b.holder] = i
    return max_flow(n + 2, edges, n, n + 1)[:n]


def extract(page: str | None, weights: np.ndarray) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, label(found, weights), strict=True) if keep) if found else ""


def train(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> np.ndarray:
    """Weights of the block classifier from a bounded sample of ``pages`` (page_id, html)."""
    ids = pages.filter("page_id IS NOT NULL").select("page_id").distinct().orderBy(F.xxhash64(F.lit(9), "page_id"), "page_id").limit(train_pages)
    width = 13

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page in batch.column(0).to_pylist():
                found = blocks(page or "")
                known = [b.semantic != 0 for b in found]
                if any(known):
                    seen = np.hstack([block_features(found)[known], [[b.semantic > 0] for b in found if b.semantic]])
                    bare = seen.copy()
                    bare[:, TAGS] = 0
                    rows += np.vstack([seen, bare]).tolist()
            yield pa.record_batch({"x": pa.array(rows, pa.list_(pa.float64()))})

    got = pages.select("page_id", "html").join(F.broadcast(ids), "page_id", "left_semi").select("html").mapInArrow(released(run), "x array<double>").toPandas()
    if got.empty:
        return DEFAULT_WEIGHTS
    x = np.stack(got.x.to_numpy())
    x = x[np.lexsort(x.T)]  # the same sums whatever the order of tasks
    assert x.shape[1] == width
    return fit_weights(x[:, :-1], x[:, -1])


def extract_pages(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages``: the whole html's main text, its blocks joined by line breaks.

    A null or empty html, or one without content, has an empty text. Repeated rows give repeated results, no rows none;
    only page_id, url and html are read, so further columns can't clash. ``<br>`` is white space inside its block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page, weights) for page in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(released(run), "page_id long, url string, text string, n_chars long")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_pages(pages, train(pages))
