"""Main text of HTML pages by consensus host paths.

Pass 1 parses each page, scores its containers (text in own blocks, less link text; parents of several that of all) and votes for their generalised
tag-class paths; votes are summed per (host, path) and each host's best path wins. Pass 2 parses again and takes the blocks
under the winning path; a page without that path takes its own best container. Votes are pre-aggregated per batch, so a host
with a third of all pages sends few rows. The winners are broadcast only if they are measured to fit ``BROADCAST_BYTES``;
otherwise they are joined on the host.

Defined cases: null html is an empty page with empty text; null URLs share the host ''; very long pages and hostile nesting cost
time and memory in proportion to their length; of containers, or a host's paths, of one score the last in the order of paths
wins; an empty table gives an empty result; repeated rows each get a row; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookupforge.llm.common import bound_batches, stage, table
from lookupforge.llm.url_rules import host_of

BROADCAST_BYTES = 16 << 20
#: A page votes with so many characters of text at most, so that a huge page does not outvote its host.
VOTE = 4000

#: Tags by what they do to the text.
RAW = frozenset("script style noscript template iframe svg math object textarea select".split())
DROPPED = frozenset("nav aside footer form button menu dialog head".split())
CONTAINERS = frozenset("html body main article section div table tbody tr td ul ol dl header figure details center".split()) | DROPPED
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre hr figcaption caption th address summary".split()) | CONTAINERS
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
BOILER = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side|menu|nav\w*|breadcrumb\w*|footer|header|masthead|cookie\w*|consent|notice|popup|modal|newsletter|subscribe|share|sharing|social|related|recommend\w*|comment\w*|disqus|reply|replies|widget|toolbar|pagination|pager|login|signup)(?:$|[\s_-])", re.IGNORECASE)

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""", re.DOTALL)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
_DIGITS = re.compile(r"\d+")

#: What becomes of a container's text: FREED is an article or main inside a part whose label drops it.
KEPT, FREED, LABELLED, GONE = range(4)


class Paths:
    """The container paths of a page as a tree: node 0 is the root; a path's node follows its parent's."""

    def __init__(self) -> None:
        self.parent, self.kind, self.tag, self.article, self.main = [0], [""], [""], [False], [False]
        self.at: dict[tuple[int, str], int] = {}

    def add(self, parent: int, tag: str, kind: str) -> int:
        node = self.at.get((parent, kind))
        if node is None:
            node = self.at[parent, kind] = len(self.parent)
            self.parent.append(parent)
            self.kind.append(kind)
            self.tag.append(tag)
            self.article.append(self.article[parent] or tag == "article")
            self.main.append(self.main[parent] or tag == "main")
        return node

    def name(self, node: int) -> str:
        out = []
        while node:
            out.append(self.kind[node])
            node = self.parent[node]
        return "".join(f"/{k}" for k in reversed(out))

    def find(self, name: str) -> int | None:
        node: int | None = 0
        for kind in name.split("/")[1:]:
            node = self.at.get((node, kind))
            if node is None:
                return None
        return node


def blocks(page: str) -> tuple[list[tuple[int, str, int]], Paths]:
    """(container, text, characters in links) of each block of text outside dropped parts, in page order, and the containers'
    paths. An article or main inside a part that only its label drops (a wrapper that has-sidebar, say) stays where it is the
    page's main text: where no other article has text and no main has more of it."""
    out: list[tuple[int, str, int]] = []
    freed: list[bool] = []  # for each block, whether a label drops a part around its article or main
    paths = Paths()
    stack: list[tuple[str, int, int]] = [("", 0, KEPT)]  # tag, path, state
    open_: Counter = Counter()  # tags on the stack
    parts: list[str] = []
    linked, in_link, at, block = 0, False, 0, ""

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text and stack[-1][2] <= FREED and not (block[:1] != "h" and open_["header"]):
                out.append((stack[-1][1], text, min(linked, len(text))))
                freed.append(stack[-1][2] == FREED)
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if in_link:
            linked += len(text)

    def close(size: int) -> None:
        """Leave ``size`` containers open."""
        while len(stack) > size:
            open_[stack.pop()[0]] -= 1

    while m := _TAG.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                add(html.escape(m[0][9:-3]))
            continue
        closing, attrs = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if tag in RAW:
            if not closing and not attrs.endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            add(" ")
        elif tag == "a":
            in_link = not closing
        elif tag in BLOCKS:
            flush()
            block = "" if closing else tag
            if tag in CONTAINERS:
                if closing:
                    if open_[tag]:
                        while stack[-1][0] != tag:
                            close(len(stack) - 1)
                        close(len(stack) - 1)
                else:
                    inside = open_["article"] + open_["main"] > 0
                    if tag in ("article", "main") and not inside and any(open_[t] for t in DROPPED):
                        close(next(i for i, (t, _, _) in enumerate(stack) if t in DROPPED))  # an unclosed menu or footer ends where an article begins
                    if tag == "body" and (open_["head"] or open_["body"]):
                        close(next(i for i, (t, _, _) in enumerate(stack) if t in ("head", "body")))
                    names = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)} if attrs else {}
                    label = f"{names.get('class', '')} {names.get('id', '')} {names.get('role', '')}".strip() if names else ""
                    kind = ".".join([tag, *sorted(set(_DIGITS.sub("#", names.get("class", "")).replace("/", "|").split()))])
                    inside = open_["article"] + open_["main"] > 0
                    up, boiler = stack[-1][2], bool(label) and bool(BOILER.search(label))
                    if up == GONE or tag in DROPPED or tag == "header" and not inside or bool(attrs) and bool(_HIDDEN.search(attrs)):
                        state = GONE
                    elif up == LABELLED:
                        own = tag == "main" or tag == "article" and not open_["article"]
                        state = FREED if own and not boiler else LABELLED
                    else:
                        state = LABELLED if boiler and tag not in ("html", "body", "article", "main") else up
                    stack.append((tag, paths.add(stack[-1][1], tag, kind), state))
                    open_[tag] += 1
    if at < len(page):
        add(page[at:])
    flush()
    if any(freed):
        kept = [x for x, f in zip(out, freed, strict=True) if not f]
        inner = sum(len(text) for node, text, _ in kept if paths.main[node])
        if any(paths.article[node] for node, _, _ in kept) or sum(len(x[1]) for x in out) - sum(len(x[1]) for x in kept) <= inner:
            return kept, paths
    return out, paths


def scores(found: list[tuple[int, str, int]], paths: Paths) -> dict[int, int]:
    """Score of each container path on one page: text in own blocks; an article or main gains what stands in it, and outside
    of those a parent below body that holds several containers with text (or one, and text of its own) gains theirs. Sums go
    up the tree once, so deep nesting costs no more than its tags."""
    size = len(paths.parent)
    own, inner, outer, most = [0] * size, [0] * size, [0] * size, [0] * size  # inner, outer: all text under a path, in an article or not
    n: dict[int, int] = {}
    for node, text, linked in found:
        worth = max(0, len(text) - 2 * linked)
        n[node] = n.get(node, 0) + worth
        own[node] += worth
        (inner if paths.article[node] or paths.main[node] else outer)[node] += worth
    for node in range(size - 1, 0, -1):
        up = paths.parent[node]
        inner[up] += inner[node]
        outer[up] += outer[node]
        if paths.tag[node] not in ("html", "body"):
            most[up] = max(most[up], outer[node])
            if outer[node] > most[node]:
                n[node] = outer[node]
        if paths.tag[node] in ("article", "main") and inner[node]:
            n[node] = inner[node]
    return n


def best_path(found: list[tuple[int, str, int]], paths: Paths) -> tuple[int, int, str] | None:
    """(node, score, path) of the container of most score, of equal ones the last in the order of paths."""
    n = scores(found, paths)
    if not n:
        return None
    top = max(n.values())
    return max(((i, top, paths.name(i)) for i, x in n.items() if x == top), key=lambda x: x[2])


def main_text(found: list[tuple[int, str, int]], paths: Paths, winner: str | None) -> str:
    """Blocks under the winning path, or under the page's own best container where the path is not on the page."""
    def under(top: int) -> list[str]:
        inside = [i == top for i in range(len(paths.parent))]
        for i in range(top + 1, len(inside)):
            inside[i] = inside[paths.parent[i]]
        return [t for node, t, _ in found if inside[node]]

    if winner is not None and (at := paths.find(winner)) is not None and (own := under(at)):
        return "\n".join(own)
    best = best_path(found, paths)
    return "\n".join(under(best[0])) if best else ""


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n: Counter = Counter()
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if best := best_path(*blocks(page or "")):
                n[host, best[2]] += min(best[1], VOTE)
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in n], pa.string()), pa.array([p for _, p in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["host", "path", "votes"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(*blocks(page or ""), w) for page, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), b.column(3)], names=["key", "url", "text", "n_chars", "path"])


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text, n_chars, path): the main text of each page and its host's winning path."""
    spark = pages.sparkSession
    bound_batches(spark)
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    votes = rows.select("host", "html").mapInArrow(_vote, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    winners = stage(votes.groupBy("host").agg(F.max(F.struct("votes", "path")).alias("best")).select("host", F.col("best.path").alias("path")), "host-paths")
    size = winners.agg(F.sum(F.length("host") + F.length("path") + 64)).first()[0] or 0
    kind = rows.schema["key"].dataType.simpleString()
    both = rows.join(F.broadcast(winners) if size <= BROADCAST_BYTES else winners, "host", "left").select("key", "url", "html", "path")
    return both.mapInArrow(_extract, f"key {kind}, url string, text string, n_chars long, path string").withColumnRenamed("key", key)


def op5_html_consensus(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
