"""HTML extraction by minimum-cut labelling.

A page is cut into text blocks.  A classifier gives each block the cost of calling it boilerplate or
content; the costs are the capacities of its edges to the two terminals.  Neighbours in the page, and
blocks next to each other under one element, are joined by smoothness edges.  The minimum cut, found by
maximum flow, is the labelling of least total cost, and the content side is the text.

The classifier's costs are log-odds of binned features (naive Bayes), trained on the blocks of at most
``sample`` pages, in the order of a hash of the id, whose place in the document (article and main against
nav, aside, footer, header) gives the label.  Blocks in such places also get a fixed cost for them.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 2000
#: Cost, in log-odds, of labelling neighbours in the page, and siblings, differently.
ADJACENT, SIBLING = 0.6, 0.9
#: Log-odds of content for a block inside an element that says what it is.
PLACE = 3.0
#: Capacities are whole numbers of this fraction.
SCALE = 1000

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<closing>/?)(?P<name>[A-Za-z][A-Za-z0-9]*)(?P<rest>(?:[^<>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*+)>|<[!?][^>]*(?:>|\Z)""", re.S
)
#: Elements that hold no text of the page; of the first two all is skipped where the end tag is missing.
_RAW, _SKIPPED = {"script", "style"}, {"script", "style", "noscript", "template", "svg"}
#: What may stand in the head, whose end tag may be left out: it ends before text and before any other tag.
_HEAD = {"base", "link", "meta", "title", "script", "style", "noscript", "template"}
_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in (*_SKIPPED, "title")}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "em", "font", "i", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: An opening tag of these closes an open one of the same kind, up to a container.
_SELF_CLOSING = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
_GOOD, _BAD = {"article", "main"}, {"nav", "aside", "footer", "header", "form", "menu"}
_HINT = re.compile(r"(?:class|id|role)\s*=\s*[\"']?[^\"'>]*\b(ad|ads|advert|banner|breadcrumb|comment|comments|cookie|footer|menu|nav|navigation|promo|related|share|sidebar|social|widget)\b", re.I)
_TITLE, _TITLE_END = re.compile(r"<title[^>]*(?:>|\Z)", re.I), re.compile(r"</title", re.I)
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    parent: int
    tag: str
    linked: int
    place: int  # 1 in content elements, -1 in boilerplate elements, 0 elsewhere


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order; block-level tags part them, inline tags don't."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, element number, place
    open_: dict[str, int] = {}  # how many of each tag are on the stack
    missing: set[str] = set()  # elements without an end tag from here on
    parts: list[str] = []
    number = last = linked = anchors = 0
    head = False

    def take(chunk: str) -> None:
        nonlocal linked
        if chunk:
            parts.append(chunk)
            if anchors:
                linked += len(chunk)

    def close() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                tag, element, place = stack[-1]
                # siblings that each hold one block are siblings of their elements
                parent = stack[-2][1] if len(stack) > 1 else element
                out.append(Block(text, parent, tag, min(linked, len(text)), place))
            parts.clear()
        linked = 0

    def after(name: str, at: int) -> int:
        """Where the element that was opened before at ends; at itself where its end tag is missing."""
        if name not in missing:
            if m := _END[name].search(page, at):
                return m.end()
            missing.add(name)
        return len(page) if name in _RAW else at

    while m := _TOKEN.search(page, last):
        chunk = page[last : m.start()]
        if head and chunk.strip():
            head = False
        if not head:
            take(chunk)
        last = m.end()
        name = m.group("name")
        if not name:
            continue
        name, closing, rest = name.lower(), m.group("closing"), m.group("rest")
        if head:
            if name in _HEAD:
                if not closing and name in _END and not rest.endswith("/"):
                    last = after(name, last)
                continue
            head = False
            if name == "head":
                continue
        if name in _SKIPPED:
            if not closing and not rest.endswith("/"):
                last = after(name, last)
            continue
        if name in _INLINE:
            if name == "a":
                anchors = max(0, anchors - 1) if closing else anchors + 1
            continue
        if name == "br":
            take("\n")
            continue
        close()
        anchors = 0
        if name == "head":
            head = not closing
        elif closing:
            if open_.get(name):
                while True:
                    gone = stack.pop()[0]
                    open_[gone] -= 1
                    if gone == name:
                        break
        elif name not in _VOID and not rest.endswith("/"):
            if name in _SELF_CLOSING and stack[-1][0] == name:
                stack.pop()
                open_[name] -= 1
            number += 1
            place = stack[-1][2]
            if name in _BAD or _HINT.search(rest):
                place = -1
            elif name in _GOOD:
                place = 1
            stack.append((name, number, place))
            open_[name] = open_.get(name, 0) + 1
    take(page[last:])
    close()
    return out


_LENGTH = np.array([2, 4, 8, 15, 30, 60, 120])
_TAGS = {t: i + 1 for i, t in enumerate(["p", "li", "h1", "h2", "h3", "div", "td", "pre", "blockquote", "footer", "nav", "article", "section", "span"])}
WIDTHS = (8, 6, 6, 16, 5, 8)


def title_of(page: str) -> str | None:
    """The text of the first title; None without one, or where its end is missing."""
    if (m := _TITLE.search(page)) and (end := _TITLE_END.search(page, m.end())):
        return _SPACE.sub(" ", entities.unescape(page[m.end() : end.start()])).strip()
    return None


def block_features(blocks: list[Block]) -> np.ndarray:
    """Bin numbers, a row a block: words, share in links, stops a word, tag, words of the blocks around."""
    n = len(blocks)
    out = np.zeros((n, len(WIDTHS)), dtype=np.int64)
    counts = np.fromiter((b.text.count(" ") + 1 for b in blocks), dtype=np.int64, count=n)
    out[:, 0] = np.searchsorted(_LENGTH, counts)
    out[:, 1] = [min(5, 5 * b.linked // max(1, len(b.text))) for b in blocks]
    stops = np.fromiter((b.text.count(".") + b.text.count(",") + b.text.count("!") + b.text.count("?") for b in blocks), dtype=np.int64, count=n)
    out[:, 2] = np.minimum(5, 20 * stops // np.maximum(1, counts))
    out[:, 3] = [_TAGS.get(b.tag, 0) for b in blocks]
    out[:, 4] = np.minimum(4, [len(b.text) // max(1, c) // 3 for b, c in zip(blocks, counts.tolist())])
    around = np.zeros(n, dtype=np.int64)
    around[1:] += counts[:-1]
    around[:-1] += counts[1:]
    out[:, 5] = np.searchsorted(_LENGTH, around)
    return out


def max_flow_cut(n: int, source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node is on the source's side of the minimum cut that is nearest the source.

    source, sink: terminal capacities; edges: (a, b, capacity) both ways.  Terminal pairs are cancelled first;
    then shortest augmenting paths by levels (Dinic), without recursion.
    """
    s, t = n, n + 1
    to: list[int] = []
    cap: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, ab: int, ba: int) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(ab)
        out[b].append(len(to))
        to.append(a)
        cap.append(ba)

    for i in range(n):
        less = min(source[i], sink[i])
        if source[i] > less:
            add(s, i, source[i] - less, 0)
        elif sink[i] > less:
            add(i, t, sink[i] - less, 0)
    for a, b, c in edges:
        if c > 0 and a != b:
            add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            x = queue.popleft()
            for e in out[x]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        x = s
        while True:
            if x == t:
                least = min(cap[e] for e in path)
                cutoff = len(path)
                for i, e in enumerate(path):
                    cap[e] -= least
                    cap[e ^ 1] += least
                    if not cap[e] and i < cutoff:
                        cutoff = i
                x = to[path[cutoff] ^ 1]
                del path[cutoff:]
            while at[x] < len(out[x]):
                e = out[x][at[x]]
                if cap[e] and level[to[e]] == level[x] + 1:
                    break
                at[x] += 1
            if at[x] < len(out[x]):
                path.append(out[x][at[x]])
                x = to[path[-1]]
            elif x == s:
                break
            else:
                e = path.pop()
                x = to[e ^ 1]
                at[x] += 1


def smoothness(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Edges between neighbours in the page and between neighbours under one parent."""
    edges = [(i, i + 1, int(ADJACENT * SCALE)) for i in range(len(blocks) - 1)]
    seen: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if b.parent in seen:
            edges.append((seen[b.parent], i, int(SIBLING * SCALE)))
        seen[b.parent] = i
    return edges


def unary(blocks: list[Block], tables: list[np.ndarray]) -> np.ndarray:
    """Log-odds of content of each block."""
    x = block_features(blocks)
    odds = sum(t[x[:, i]] for i, t in enumerate(tables))
    return np.clip(odds, -6, 6) + PLACE * np.fromiter((b.place for b in blocks), dtype=np.float64, count=len(blocks))


def label(blocks: list[Block], tables: list[np.ndarray]) -> list[bool]:
    """Whether each block is content."""
    if not blocks:
        return []
    cost = np.rint(unary(blocks, tables) * SCALE).astype(np.int64)
    return max_flow_cut(len(blocks), np.maximum(cost, 0).tolist(), np.maximum(-cost, 0).tolist(), smoothness(blocks))


def default_tables() -> list[np.ndarray]:
    """Costs where there is nothing to train on: length speaks for content, links against."""
    tables = [np.zeros(w) for w in WIDTHS]
    tables[0][:] = np.linspace(-1.5, 2, WIDTHS[0])
    tables[1][:] = np.linspace(0.5, -3, WIDTHS[1])
    return tables


def _tally(batches):
    import pyarrow as pa

    for b in batches:
        count = np.zeros((2, len(WIDTHS), max(WIDTHS)), dtype=np.int64)
        for page in b.column(0).to_pylist():
            blocks = blocks_of(page)
            if blocks:
                x = block_features(blocks)
                for i, block in enumerate(blocks):
                    if block.place:
                        count[int(block.place > 0), np.arange(len(WIDTHS)), x[i]] += 1
        at = np.flatnonzero(count.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count.ravel()[at])], names=["cell", "n"])


def train_tables(pages: DataFrame, sample: int = SAMPLE) -> list[np.ndarray]:
    """Log-odds a bin of each feature, smoothed by one, from the labelled blocks of at most ``sample`` pages."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").alias("html")).where("page_id is not null and html is not null")
    chosen = base.select(F.xxhash64("page_id").alias("h"), "page_id").orderBy("h", "page_id").limit(sample)
    texts = base.join(F.broadcast(chosen.select("page_id").distinct()), "page_id", "left_semi").select("html")
    got = texts.mapInArrow(_tally, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(2 * len(WIDTHS) * max(WIDTHS))
    for r in got:
        count[r.cell] = r.n
    count = count.reshape(2, len(WIDTHS), max(WIDTHS))
    if not count[0].sum() or not count[1].sum():
        return default_tables()
    share = [(count[c] + 1) / (count[c].sum(axis=1, keepdims=True) + np.array(WIDTHS)[:, None]) for c in (0, 1)]
    # features are dependent: half of their evidence in sum
    return [0.5 * np.log(share[1][i] / share[0][i])[:w] for i, w in enumerate(WIDTHS)]


def extract_content(pages: DataFrame, sample: int = SAMPLE, tables: list[np.ndarray] | None = None) -> DataFrame:
    """(page_id, title, text, blocks, content_blocks): the content blocks of each page, a line each.

    A null html gives a null title and text and 0 blocks; an empty page an empty text; a page without a
    title a null one.  Rows with a null page_id are left out; repeated rows come back each time.
    An empty table gives no rows.  Other columns are ignored.
    """
    tables = train_tables(pages, sample) if tables is None else tables

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for page in b.column(1).to_pylist():
                if page is None:
                    out.append((None, None, 0, 0))
                    continue
                blocks = blocks_of(page)
                keep = label(blocks, tables)
                out.append((title_of(page), "\n".join(x.text for x, k in zip(blocks, keep) if k), len(blocks), sum(keep)))
            cols = list(zip(*out)) or [[]] * 4
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["page_id", "title", "text", "blocks", "content_blocks"])

    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).where("page_id is not null")
    return base.mapInArrow(run, "page_id long, title string, text string, blocks int, content_blocks int")
