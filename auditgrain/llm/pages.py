"""Main text of web pages by a consensus of the pages of a host.

1. Every page is read into a small tree. Its containers are scored by the running text of their
   blocks, and each container is named by the tags and classes that lead to it, digits generalised.
2. Scores are votes: they are summed by host and path in Spark, and each host's best path wins.
3. Every page is read again and the parts at its host's winning path are taken, in page order, with
   the prose that stands around them. A page without that path, or with far less text at it than
   elsewhere, falls back on its own best container.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_hexdigest

from auditgrain.llm.common import column, pieces, schema_of, texts_of
from auditgrain.session import materialize

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("head script style noscript template iframe svg math canvas object audio video nav header footer aside form button select textarea input dialog menu title".split())
CONTAINERS = frozenset("body div article section main td center".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

# Words in a class, id or role that mark what is not the article.
ASIDE = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header "
    "masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promoted promotion related replies respond share "
    "sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
MARKS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


#: Markers that also name parts of an article: inside one, long prose outweighs them.
UNSURE = frozenset("header menu overlay related respond share sharing social".split())
TEXT_LEVEL = frozenset("blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Least characters of a block that counts as prose, and of an element that outweighs an unsure marker.
PROSE, MUCH_PROSE = 40, 200
#: Share of what an ancestor adds that has to be prose; share of a page's own best part that the host's path has to hold.
MOSTLY, FAR_LESS = 0.8, 1 / 3
#: Hosts whose paths are broadcast at most; parts of a host beyond that.
BROADCAST_HOSTS, HOST_PARTS = 100_000, 32
_ENDS = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}


@dataclass(slots=True, eq=False)
class Node:
    """An element; `path` is its depth among blocks and a hash of the tags and classes that lead to it.

    `run` and `link` are the characters of visible text outside and inside links, `prose` those of
    blocks that read like running text, `line` what stands in the element's own lines.
    """

    tag: str
    path: str
    parent: "Node | None"
    depth: int = 0
    marks: frozenset[str] = frozenset()
    hidden: bool = False
    linked: bool = False
    within: bool = False
    parts: list["Node | str"] = field(default_factory=list)
    holds: bool = False
    run: int = 0
    link: int = 0
    prose: int = 0
    line: int = 0


@dataclass(slots=True)
class Page:
    """The root of a page, and all elements in page order: walks are loops over them, so no page is too deep."""

    root: Node
    nodes: list[Node]


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text.strip(" /\n\t") else {}


def _node(tag: str, attributes: dict[str, str], parent: Node) -> Node:
    path, depth = parent.path, parent.depth
    if tag not in INLINE and tag != "p":
        general = sorted(re.sub(r"\d+", "#", n.lower()) for n in attributes.get("class", "").split())
        depth += 1
        step = f"{path}>{'.'.join([tag, *general])}"
        path = f"{depth:06d}-{xxh3_128_hexdigest(step.encode('utf-8', 'surrogatepass'))}"
    # what a heading or a paragraph is called does not tell what kind of part it is
    named = ("class", "role") if tag in TEXT_LEVEL else ("class", "id", "role")
    marks = frozenset(m.lower() for x in named for m in MARKS.findall(attributes.get(x, ""))) & ASIDE
    style = attributes.get("style", "").replace(" ", "").lower()
    hidden = tag in NEVER or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style
    within = parent.within or parent.tag in ("article", "main")
    return Node(tag, path, parent, depth, marks, hidden, tag == "a" or parent.linked, within)


def parse(page: str) -> Page:
    """A tree of the page: misnested and missing end tags, cut-off pages and stray `<` are tolerated."""
    root = here = Node("", "", None)
    nodes: list[Node] = []
    opened: dict[str, int] = {}
    at, n = 0, len(page)

    def leave(upto: Node | None) -> None:
        nonlocal here
        while here is not upto:
            opened[here.tag] -= 1
            here = here.parent

    while at < n:
        m = TAG.search(page, at)
        start = m.start() if m else n
        if start > at:
            here.parts.append(page[at:start])
        if m is None:
            break
        at = max(m.end(), start + 1)
        tag = m[2]
        if tag is None or not m[4]:  # a comment, a declaration or a tag that the page breaks off in
            continue
        tag = tag.lower()
        if m[1]:
            if opened.get(tag):
                up = here
                # an end tag of text style does not close blocks
                while up.tag != tag and not (tag in INLINE and up.tag not in INLINE):
                    up = up.parent
                if up.tag == tag:
                    leave(up.parent)
            continue
        closes = "p" if tag in CLOSES_P else tag if tag in ("li", "dd", "dt", "td", "th", "tr") else None
        if closes is not None and opened.get(closes):
            up = here
            while up.tag != closes and (up.tag in INLINE or up.tag == "p"):
                up = up.parent
            if up.tag == closes:
                leave(up.parent)
        node = _node(tag, _attributes(m[3]), here)
        here.parts.append(node)
        nodes.append(node)
        if tag in RAW and not m[3].endswith("/"):
            end = _ENDS[tag].search(page, at)
            at = n if end is None else (page.find(">", end.start()) + 1 or n)
        elif tag not in VOID and not m[3].endswith("/"):
            here = node
            opened[tag] = opened.get(tag, 0) + 1
    found = Page(root, nodes)
    _settle(found)
    return found


def _settle(page: Page) -> None:
    """Hides what markers tell, unless it is the frame around the article itself, and measures visible text."""
    for node in reversed(page.nodes):  # children before their parents
        node.holds |= node.tag in ("article", "main")
        node.parent.holds |= node.holds
        _measure(node)
        if node.marks and not node.holds and node.tag not in ("html", "body"):
            long = node.prose >= MUCH_PROSE and node.prose >= MOSTLY * (node.run + node.link)
            node.hidden |= not (node.within and long and node.marks <= UNSURE)
        if not node.hidden:
            up = node.parent
            up.run, up.link, up.prose = up.run + node.run, up.link + node.link, up.prose + node.prose
            if node.tag in INLINE:
                up.line += node.line
    _measure(page.root)


def _measure(node: Node) -> None:
    size = sum(len(x.strip()) for x in node.parts if isinstance(x, str))
    if node.linked:
        node.link += size
        return
    node.run += size
    node.line += size
    if node.tag in TEXT_LEVEL and (node.line >= PROSE or node.tag in HEADINGS):
        node.prose += node.line


def _visible(page: Page) -> list[Node]:
    """Elements outside hidden ones, in page order."""
    shown, seen = [], {id(page.root)}
    for node in page.nodes:
        if not node.hidden and id(node.parent) in seen:
            seen.add(id(node))
            shown.append(node)
    return shown


def _flush(out: list[str], line: list[str]) -> None:
    text = " ".join(entities.unescape("".join(line)).split())
    line.clear()
    if text:
        out.append(text)


def text_of(nodes: list[Node]) -> str:
    """Visible text of some elements: blocks joined by one space."""
    out: list[str] = []
    line: list[str] = []
    for top in nodes:
        _flush(out, line)
        open_ = [(top, iter(top.parts))]
        while open_:
            node, rest = open_[-1]
            for x in rest:
                if isinstance(x, str):
                    line.append(x)
                elif not x.hidden:
                    if x.tag not in INLINE:
                        _flush(out, line)
                    open_.append((x, iter(x.parts)))
                    break
            else:
                open_.pop()
                if node.tag not in INLINE:
                    _flush(out, line)
    _flush(out, line)
    return " ".join(out)


def scores(page: Page) -> dict[str, float]:
    """Score of each container path of a page: its own running text, that of nested containers counting half."""
    shown = _visible(page)
    own: dict[int, float] = {}
    nested: dict[int, float] = {}
    found: dict[str, float] = {}
    for node in reversed(shown):
        size = sum(len(x.strip()) for x in node.parts if isinstance(x, str))
        a, b = own.pop(id(node), 0.0) + (-size if node.linked else size), nested.pop(id(node), 0.0)
        up = id(node.parent)
        if node.tag in CONTAINERS:
            value = (1.25 if node.tag in ("article", "main") else 1.0) * (a + b / 2)
            if value > 0:
                found[node.path] = found.get(node.path, 0.0) + value
            a, b = 0.0, a + b
        own[up], nested[up] = own.get(up, 0.0) + a, nested.get(up, 0.0) + b
    return found


def at_path(page: Page, path: str) -> list[Node]:
    """The parts of a page around the visible containers at a path, in page order.

    A part is the outermost element below the page's body that holds such containers and is an
    article, or adds little but prose to them: headings, leads and sections beside the winning one.
    """
    shown = _visible(page)
    taken: dict[int, tuple[int, int, int]] = {}
    chosen = {id(x) for x in shown if x.path == path and x.tag in CONTAINERS}
    for node in reversed(shown):
        own = (node.run, node.link, node.prose) if id(node) in chosen else taken.get(id(node))
        if own is not None:
            taken[id(node)] = own
            taken[id(node.parent)] = tuple(x + y for x, y in zip(taken.get(id(node.parent), (0, 0, 0)), own))
    tops, inside = [], set()
    for node in shown:
        if id(node.parent) in inside:
            inside.add(id(node))
        elif id(node) in taken and (id(node) in chosen or _frames(node, taken[id(node)])):
            inside.add(id(node))
            tops.append(node)
    return tops


def _frames(node: Node, taken: tuple[int, int, int]) -> bool:
    if node.tag in ("html", "body", "main", "tr", "tbody", "table") or node.tag in INLINE:
        return False
    added = node.run + node.link - taken[0] - taken[1]
    return node.tag == "article" or node.prose - taken[2] >= MOSTLY * added


def main_text(page: Page, path: str | None) -> str:
    """Text at the host's path, or at the page's own best where that path is missing or holds far less running text."""
    nodes = at_path(page, path) if path else []
    own = scores(page)
    best = at_path(page, min(own, key=lambda p: (-own[p], p))) if own else [page.root]
    if not nodes or sum(x.run for x in nodes) < FAR_LESS * sum(x.run for x in best):
        return text_of(best)
    return text_of(nodes) or text_of(best)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, its first 255 characters (names of hosts have no more); empty if there is none."""
    return F.coalesce(F.lower(F.substring(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), 1, 255)), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """`host` and `path`, the path with the most votes of the host's pages; ties go to the path that sorts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            votes: dict[tuple[str, str], float] = {}
            for host, page in zip(column(batch, "host").to_pylist(), texts_of(batch, "html")):
                own = scores(parse(page))
                total = sum(own.values())
                for path, value in own.items():  # each page has one vote, shared out by score
                    votes[host, path] = votes.get((host, path), 0.0) + value / total
            if votes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h for h, _ in votes]), pa.array([p for _, p in votes]), pa.array(list(votes.values()), pa.float64())], names=["host", "path", "votes"],
                )

    voted = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string, votes double")
    summed = voted.groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"))
    return summed.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), F.col("path"))).alias("path"))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """`keep`, `text` (blocks joined by one space) and `n_chars` of every row.

    A null html is empty and gives an empty text; a null or odd url belongs to the host with the empty
    name; repeated rows give repeated rows; pages of any length are read whole; an empty table gives
    an empty one. Columns other than `keep`, url and html are not read.
    """
    names = list(keep)
    used = list(dict.fromkeys([*names, "html"]))
    source = pages.select(*used, host_of(F.col("url")).alias("page_host"))
    paths = materialize(host_paths(pages).select(F.col("host").alias("page_host"), F.col("path").alias("host_path")), "paths")
    if paths.count() <= BROADCAST_HOSTS:  # a host name has 255 characters at most, a path 39
        joined = source.join(F.broadcast(paths), "page_host", "left")
    else:  # pages of a host are dealt to several tasks, each with a copy of the host's row
        part = F.pmod(F.xxhash64("html"), F.lit(HOST_PARTS))
        copied = paths.withColumn("host_part", F.explode(F.sequence(F.lit(0), F.lit(HOST_PARTS - 1))))
        joined = source.withColumn("host_part", F.coalesce(part, F.lit(0))).join(copied, ["page_host", "host_part"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            out = []
            for path, page in zip(column(batch, "host_path").to_pylist(), texts_of(batch, "html")):
                out.append(main_text(parse(page), path))
            yield pa.RecordBatch.from_arrays(
                [*(column(batch, n) for n in names), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=[*names, "text", "n_chars"],
            )

    return joined.select(*used, "host_path").mapInArrow(run, f"{schema_of(pages, names)}, text string, n_chars long")
