"""Main text of web pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that never hold text of the page, that stand around an article, that hold one, that start a block.
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea "
                   "datalist map".split())
#: Of the silent ones: their text is no markup at all, so without an end tag it goes to the end of the page.
RAW = frozenset("script style textarea title iframe".split())
AROUND = frozenset("nav header footer aside form button dialog menu fieldset label figure".split())
CONTENT = frozenset("article main".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav noscript ol optgroup "
                  "option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a start tag on the left closes if they are the open block.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
#: Words in class, id and role that name what is not, or what is, the article.
BAD_NAME = re.compile(
    r"(?<![a-z])(ads?|advert\w*|adsense|banner\w*|breadcrumb\w*|comments?|commentlist|disqus|replies|reply|respond|cookie\w*|consent|"
    r"gdpr|notice\w*|notification\w*|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|promo\w*|sponsor\w*|related|"
    r"recommend\w*|share|sharing|social|sidebar\w*|side|widget\w*|menu\w*|nav|navbar|navigation|footer\w*|masthead|header|topbar|toolbar|"
    r"pagination|pager|tags?|toc|copyright|legal|disclaimer|complementary|contentinfo|search|skip)(?![a-z])")
#: Class names that say what stands elsewhere on the page, or what a post is about.
ASIDE_NAME = re.compile(r"(?:(?:has|with|without|no|is|not|show|hide)[-_]|tags?[-_]).*", re.S)
#: An article of such a name is not the one of the page.
MINOR_NAME = re.compile(r"(?<![a-z])(comments?|commentlist|reply|replies|respond|related|recommend\w*|promo\w*|sponsor\w*|ads?|advert\w*|widget\w*)(?![a-z])")
GOOD_NAME = re.compile(r"(?<![a-z])(article|articlebody|post|entry|content|story|main|body|text|prose)(?![a-z])")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
                   r"<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)(hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)

#: Costs in nats: evidence for (positive) or against (negative) content, and the price of cutting between neighbours.
W_CONTENT, W_AROUND, W_BAD_NAME, W_GOOD_NAME, W_HIDDEN = 4.0, -12.0, -12.0, 1.5, -12.0
W_LINKS, W_LENGTH, W_HEADING, W_BIAS, W_STOP = -4.0, 0.6, 0.8, -1.2, 0.3
SMOOTH_NEXT, SMOOTH_DOM = 1.0, 1.2


@dataclass
class Block:
    """A run of text without block boundary, with what surrounds it."""

    path: tuple[int, ...]
    score: float
    heading: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0


def blocks_of(page: str) -> list[tuple[str, float, tuple[int, ...]]]:
    """(text, evidence for content, path of element numbers) of each block with text, in page order."""
    stack: list[tuple[str, int, float]] = []  # element, its number, its evidence
    named: dict[int, float] = {}  # penalty for the name of an element
    spared: set[int] = set()  # main, the first article, and the elements around them: their names cost nothing
    article = False
    silent: dict[str, dict[int, int]] = {}
    found: list[Block] = []
    now: Block | None = None
    count, at, links = 0, 0, 0

    def text(raw: str) -> None:
        nonlocal now
        if not raw:
            return
        if now is None:
            if raw.isspace():
                return
            now = Block(tuple(n for _, n, _ in stack), sum(s for _, _, s in stack), any(t[0] in "h" and len(t) == 2 for t, _, _ in stack))
            found.append(now)
        plain = html.unescape(raw) if "&" in raw else raw
        now.parts.append(plain)
        if links:
            now.linked += len(plain)

    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        if m.group(2) is None:
            if m.group(0).startswith("<![CDATA["):
                text(m.group(0)[9:].removesuffix("]]>"))
            continue
        closing, tag, attributes = m.group(1), m.group(2).lower(), m.group(3)
        if tag in BLOCK:
            now = None
        if closing:
            if any(t == tag for t, _, _ in stack):
                while stack:
                    t, _, _ = stack.pop()
                    links -= t == "a"
                    if t == tag:
                        break
            continue
        if tag in SILENT:
            # the text of these is no markup: go on behind the end tag
            if not attributes.endswith("/"):
                if tag in RAW:
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                    at = end.end() if end else size
                    continue
                if tag not in silent:
                    silent[tag] = _ends(page, tag)
                end = silent[tag].get(m.start())
                if tag == "head" and end is None and (body := re.compile(r"(?=<body[\s>])", re.I).search(page, at)):
                    end = body.end()
                at = at if end is None else end  # without an end tag only the start tag is passed over
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag == "a" and links:
            continue
        closes = CLOSES.get(tag)
        if closes and stack and stack[-1][0] in closes:
            stack.pop()
        elif tag in BLOCK and stack and stack[-1][0] == "p":
            stack.pop()
        count += 1
        links += tag == "a"
        score, penalty, minor = _evidence(tag, attributes)
        stack.append((tag, count, score))
        if penalty:
            named[count] = penalty
        if tag == "main" or tag == "article" and not article and not minor:
            article = article or tag == "article"
            spared.update(n for _, n, _ in stack)
    out = []
    for b in found:
        line = " ".join("".join(b.parts).split())
        if line:
            names = sum(named[n] for n in b.path if n in named and n not in spared) if named else 0.0
            out.append((line, b.score + names + _own(line, b), b.path))
    return out


def _ends(page: str, tag: str) -> dict[int, int]:
    """Where each element of a kind begins and ends; those without an end tag of their own are left out."""
    token = re.compile(rf"<!--.*?(?:-->|\Z)|<script[\s>].*?(?:</script\s*>|\Z)|<(/?){re.escape(tag)}(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.I | re.S)
    opened: list[int] = []
    ends = {}
    for m in token.finditer(page):
        if m.group(1) == "/":
            if opened:
                ends[opened.pop()] = m.end()
        elif m.group(1) == "" and not m.group(0).endswith("/>"):
            opened.append(m.start())
    return ends


def _evidence(tag: str, attributes: str) -> tuple[float, float, bool]:
    """Evidence from an element and what its name adds against it; whether the name is one of comments or teasers."""
    score = W_CONTENT if tag in CONTENT else W_AROUND if tag in AROUND else 0.0
    penalty, minor = 0.0, False
    if attributes and tag not in ("body", "html"):
        names = " ".join(x or y or z for _, x, y, z in NAMED.findall(attributes)).lower()
        names = " ".join(x for x in names.split() if not ASIDE_NAME.fullmatch(x))
        if names:
            minor = MINOR_NAME.search(names) is not None
            if BAD_NAME.search(names):
                penalty = W_BAD_NAME
            elif GOOD_NAME.search(names):
                score += W_GOOD_NAME
        if HIDDEN.search(attributes):
            score += W_HIDDEN
    return score, penalty, minor


def _own(line: str, block: Block) -> float:
    chars = len(line)
    score = W_BIAS + W_LINKS * min(1.0, block.linked / chars) + W_LENGTH * math.log1p(chars / 20)
    return score + W_HEADING * block.heading + W_STOP * (line[-1] in ".!?…:;\"'”»")


def labelled(blocks: list[tuple[str, float, tuple[int, ...]]]) -> list[bool]:
    """Content or not, by a minimum cut.

    Evidence becomes the capacity from the source (content) or to the sink (boilerplate).  Neighbours in page order, and each
    block and the next one under the same parent, are tied by a smoothness capacity that falls with their distance in the
    element tree.  The labels of least total cost are the two sides of a minimum cut.
    """
    n = len(blocks)
    ties: dict[tuple[int, int], float] = {}
    last: dict[tuple[int, ...], int] = {}
    for i, (_, _, path) in enumerate(blocks):
        if i:
            before = blocks[i - 1][2]
            shared = 0
            for a, b in zip(before, path):
                if a != b:
                    break
                shared += 1
            steps = len(before) + len(path) - 2 * shared
            ties[i - 1, i] = SMOOTH_NEXT / (1 + steps)
        parent = path[:-1]
        if parent in last:
            edge = (last[parent], i)
            ties[edge] = ties.get(edge, 0.0) + SMOOTH_DOM / 2
        last[parent] = i
    # a block whose evidence outweighs all its ties keeps its side in every minimum cut: only the others enter the network
    tied = [0.0] * n
    for (i, j), c in ties.items():
        tied[i] += c
        tied[j] += c
    fixed = [None if abs(s) <= tied[i] else s > 0 for i, (_, s, _) in enumerate(blocks)]
    if all(f is not None for f in fixed):
        return [bool(f) for f in fixed]
    return _min_cut(n, [s for _, s, _ in blocks], ties)


def _min_cut(n: int, evidence: list[float], ties: dict[tuple[int, int], float]) -> list[bool]:
    """Source side of a minimum cut, by shortest augmenting paths on level graphs."""
    source, sink = n, n + 1
    flow: list[dict[int, float]] = [{} for _ in range(n + 2)]
    for i, s in enumerate(evidence):
        if s > 0:
            flow[source][i], flow[i][source] = s, 0.0
        elif s < 0:
            flow[i][sink], flow[sink][i] = -s, 0.0
    for (i, j), c in ties.items():
        flow[i][j] = flow[i].get(j, 0.0) + c
        flow[j][i] = flow[j].get(i, 0.0) + c
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, c in flow[u].items():
                if c > 1e-9 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return [i in level for i in range(n)]
        todo = {u: [v for v in flow[u] if level.get(v) == level[u] + 1] for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                push = min(flow[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    flow[a][b] -= push
                    flow[b][a] += push
                cut = next(k for k, (a, b) in enumerate(zip(path, path[1:])) if flow[a][b] <= 1e-9)
                del path[cut + 1:]
                continue
            while todo[u] and not (flow[u][todo[u][-1]] > 1e-9):
                todo[u].pop()
            if todo[u]:
                path.append(todo[u][-1])
            else:
                path.pop()
                if path:
                    todo[path[-1]].pop()


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    return "\n".join(b[0] for b, keep in zip(blocks, labelled(blocks)) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each page, one row per input row.

    Blocks are runs of text between block-level tags.  Each gets evidence from the elements around it (article or menu, names of
    class, id and role), from its share of linked text and its length; a minimum cut then labels all blocks of a page together,
    so a short line inside an article stays and a long one inside a comment list goes.  Character references are decoded, white
    space inside a block becomes one space, blocks are joined by a line break.

    Null html is empty; a page without content has an empty text.  Open, broken and missing tags are tolerated, and pages of any
    length are read whole.  Null ids and urls are passed through, repeated rows give repeated results, other columns are ignored.
    """
    schema = "page_id long, url string, text string, n_chars long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html"), F.lit("")).alias("html")).mapInArrow(run, schema)
