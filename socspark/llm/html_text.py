"""Main text of web pages by a consensus of each host's pages.

Every page's containers are scored by their running text. A page's context is its
outermost ``article`` and ``main`` elements where these hold most of it, else the
lowest container that holds all of it, so that only lists of links stand
outside. The page votes for the generalised path (tags with their classes, digits
masked) of its context. Votes are summed per host in Spark. A page is then
extracted from its articles or, without any, from the path for which most of its
host's votes are, if it has that path and most of its text there; else from its own
context. A headline before the context, with what follows it there, belongs to it.

Noise is decided for whole elements, before the vote: by tag, role and the
``hidden`` marks, and by names. A name counts only where all its words are words
of noise or of layout (``ad-box``, not ``legal-analysis``). Readers' comments stay
noise however long they are; no element is noise or dropped because of its size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import annotate, fresh, small_enough, stored

#: Elements that nest. Items, rows and cells end where their next sibling begins.
ITEMS = frozenset("li dd dt tr td th thead tbody tfoot".split())
CONTAINERS = ITEMS | frozenset("body div article section main aside nav header footer form figure ul ol dl table blockquote dialog details center fieldset head html menu".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 pre figcaption address hr summary caption option legend".split())
#: Left out with all they hold; the block around them goes on.
UNSEEN = frozenset("svg template select button object canvas".split())
NOISE_TAGS = frozenset("nav aside footer form head dialog menu".split())
RAW = "script|style|noscript|iframe|textarea|title|noembed|noframes|xmp"
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "nav navbar navigation menu sidebar footer ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promotion "
    "promoted banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register share sharing "
    "social related recommended recommendations comment comments commentlist respond disqus discussion replies breadcrumb breadcrumbs pagination pager "
    "widget widgets toolbar masthead copyright legal search skip hidden teaser paywall".split()
)
#: Words that say where or how an element stands, not what it holds.
LAYOUT_WORDS = frozenset(
    "area article articles aside bar bars block blocks body bottom box boxes btn button buttons center col column container content desktop div entry feed field fixed form "
    "global group head header icons inline inner item items js large left link links list main md lg sm xs mobile module outer page panel placeholder policy post posts primary right row "
    "secondary section side site slot small space sticky stories text thread tools top unit wrap wrapper zone".split()
)
HEADER_WORDS = frozenset("header siteheader pageheader topbar".split())
COMMENT_WORDS = frozenset("comment comments commentlist respond disqus discussion replies".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Text of a link in such a block is running text, elsewhere it may be a menu.
PROSE = HEADINGS | frozenset("p pre blockquote figcaption caption".split())
#: What a character of a link counts for, next to one of running text.
LINK_WEIGHT = 0.2

_ATTRS = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+"
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<raw>{RAW})\b{_ATTRS}(?:>.*?(?:</(?P=raw)\b[^>]*+(?:>|\Z)|\Z)|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>{_ATTRS})(?:>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"""([^\s=/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MAY_HIDE = re.compile("hidden|none", re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Block(NamedTuple):
    """A block's container, text and tag."""

    box: Container
    text: str
    tag: str


class Container:
    __slots__ = ("comment", "full", "hidden", "inside", "key", "lifted", "mark", "noise", "own", "parent", "plain", "running", "scope", "tag", "total")

    def __init__(self, tag: str, key: str, mark: bool, hidden: bool, parent: Container | None, inside: bool):
        self.tag, self.key, self.mark, self.hidden, self.parent, self.inside = tag, key, mark, hidden, parent, inside
        #: The nearest element, itself included, that is no plain division.
        self.scope = self if parent is None or tag not in ("div", "center") else parent.scope
        self.noise = self.comment = self.lifted = False
        #: Its own text and the text below it, with links for less; the same without lists of links, noise left out.
        self.own, self.full, self.plain, self.running, self.total = 0.0, 0.0, 0.0, 0.0, 0.0

    def path(self) -> str:
        keys, at = [], self
        while at is not None:
            keys.append(at.key)
            at = at.parent
        return ">".join(reversed(keys))


def _noisy_name(name: str) -> bool:
    """Whether all words of a class or id are words of noise or layout, one at least of noise."""
    pieces = [x.lower() for x in _PIECES.findall(name)]
    return any(x in NOISE_WORDS for x in pieces) and all(x in NOISE_WORDS or x in LAYOUT_WORDS for x in pieces)


def _names_comments(name: str) -> bool:
    return _noisy_name(name) and any(x.lower() in COMMENT_WORDS for x in _PIECES.findall(name))


def _attributes(attrs: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        out.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
    return out


def _is_hidden(found: dict[str, str]) -> bool:
    return found.get("aria-hidden", "").lower() == "true" or "hidden" in found or "display:none" in "".join(found.get("style", "").split()).lower()


def _open(tag: str, attrs: str, parent: Container | None) -> Container:
    key, noise, hidden, comment, inside = tag, tag in NOISE_TAGS, False, False, parent is not None and (parent.inside or parent.tag in ("article", "main"))
    if tag == "header" and not inside:
        noise = True
    if attrs:
        found = _attributes(attrs)
        names = found.get("class", "").split()
        if names:
            key = tag + "".join("." + re.sub(r"\d+", "#", x.replace(">", "_")) for x in sorted(names))
        known = [*names, found.get("id", "")]
        comment = tag not in ("body", "html", "main") and any(map(_names_comments, known))
        noise = noise or comment or tag not in ("body", "html", "main", "article") and any(map(_noisy_name, known))
        noise = noise or not inside and any(x.lower().replace("-", "").replace("_", "") in HEADER_WORDS for x in known)
        noise = noise or found.get("role", "").lower() in NOISE_ROLES
        hidden = _is_hidden(found)
    box = Container(tag, key, noise, hidden or parent is not None and parent.hidden, parent, inside)
    box.comment = comment or parent is not None and parent.comment
    return box


def _settle(boxes: list[Container]) -> None:
    """Decides which of a page's containers, parents first, are noise; ``own`` holds the text of each.

    A marked container is noise with all below it. Marks around an article are
    lifted where no article is free of them and it holds more than all that is.
    Where nothing is left, the mark of the largest form or named element is lifted,
    else all such marks, else all. Comments and hidden elements keep theirs.
    """
    for box in reversed(boxes):
        box.full += 0.0 if box.hidden else box.own
        if box.parent is not None:
            box.parent.full += box.full

    def spread() -> float:
        left = 0.0
        for box in boxes:
            box.noise = box.mark or box.hidden or box.comment or box.parent is not None and box.parent.noise
            left += 0.0 if box.noise else box.own
        return left

    left = spread()
    articles = [b for b in boxes if b.tag in ("article", "main") and b.full and not b.comment and not b.hidden]
    if articles and all(b.noise for b in articles):
        at: Container | None = max(articles, key=lambda b: b.full)
        if at.full > left:
            while at is not None:
                at.lifted, at.mark, at = True, False, at.parent
            left = spread()
    if not left:
        marked = [b for b in boxes if b.mark and b.full and b.tag not in NOISE_TAGS - {"form"} and not b.comment and not b.hidden]
        for some in ([max(marked, key=lambda b: b.full)], marked) if marked else ():
            for box in some:
                box.mark = False
            left = spread()
            if left:
                break
    if not left:
        for box in boxes:
            box.noise = box.hidden or box.comment


def parse(html: str) -> tuple[list[Container], list[Block]]:
    """The containers of a page, parents first, and its blocks in page order.

    References are decoded in every stretch between tags by itself. Only
    containers are nested, so unclosed paragraphs and inline tags do no harm; a
    paragraph or heading that is marked as noise is a container up to the next
    block. Inline elements with a hidden mark leave their block as it is without
    them. A quote that is never closed ends with its tag, and an unfinished tag
    at the end is dropped. Time and memory grow with the length of the page, at
    any depth.
    """
    root = Container("", "", False, False, None, False)
    boxes, blocks, parts = [root], [], []
    here, leaf, in_link, at, block = root, None, False, 0, ""
    opened: dict[str, int] = {}
    unseen: list | None = None  # tag, depth and container of an inline element that is left out

    def text_until(end: int) -> None:
        if end > at and unseen is None:
            part = unescape(html[at:end])
            parts.append(part)
            size = 0 if part.isspace() else len(part.strip())
            (leaf or here).own += size * (LINK_WEIGHT if in_link else 1.0)
            (leaf or here).plain += 0 if in_link and block not in PROSE else size

    def close() -> None:
        nonlocal parts
        if parts:
            if text := " ".join("".join(parts).split()):
                blocks.append(Block(leaf or here, text, block))
            parts = []

    def pop_to(box: Container) -> None:
        """Ends ``box`` and what is open in it."""
        nonlocal here, unseen
        up = here
        while True:
            opened[up.tag] -= 1
            if unseen is not None and unseen[2] is up:
                unseen = None
            if up is box:
                break
            up = up.parent
        here = box.parent

    for m in _TOKEN.finditer(html):
        text_until(m.start())
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag, ends = tag.lower(), bool(m["end"])
        if tag == "a":
            in_link = not ends
        elif tag == "br" and unseen is None:
            parts.append(" ")
        if tag not in BLOCKS:
            if unseen is not None:
                if tag == unseen[0]:
                    unseen[1] += -1 if ends else 1
                    if not unseen[1]:
                        unseen = None
            elif not ends and tag not in _VOID and (tag in UNSEEN and not m["attrs"].endswith("/") or _MAY_HIDE.search(m["attrs"]) and _is_hidden(_attributes(m["attrs"]))):
                unseen = [tag, 1, here]
            continue
        close()
        leaf, block = None, "" if ends else tag
        if tag not in CONTAINERS:
            if ends:
                if unseen is not None and unseen[2] is here:
                    unseen = None
            elif m["attrs"]:
                box = _open(tag, m["attrs"], here)
                if box.mark or box.hidden:
                    leaf = box
                    boxes.append(box)
        elif ends:
            if opened.get(tag):
                up = here
                while up.tag != tag:
                    up = up.parent
                pop_to(up)
                in_link = False
        else:
            if tag in ITEMS:
                _end_items(tag, lambda: here, pop_to)
            here = _open(tag, m["attrs"], here)
            boxes.append(here)
            opened[tag] = opened.get(tag, 0) + 1
    text_until(len(html))
    close()
    return boxes, blocks


#: What an item ends when it begins.
_ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
_GROUP_ENDS = ("td", "th", "tr", "thead", "tbody", "tfoot")


def _end_items(tag: str, here, pop_to) -> None:
    for _ in range(3):
        up = here().scope
        if up.tag not in _ENDS.get(tag, _GROUP_ENDS):
            break
        pop_to(up)


def context(boxes: list[Container]) -> tuple[list[Container], float, bool]:
    """The containers to extract, their share of the page's running text, and whether they are marked as the article.

    Outermost ``article`` and ``main`` elements are the context where they hold
    half at least of the running text. Else the search goes down from the root
    as long as one child holds all of it, so nothing but links is left behind.
    """
    children: dict[int, list[Container]] = {}
    for box in boxes:
        box.total, box.running = (0.0, 0.0) if box.noise else (box.own, box.plain)
        if box.parent is not None and not box.noise:
            children.setdefault(id(box.parent), []).append(box)
    for box in reversed(boxes):
        if box.parent is not None:
            box.parent.total += box.total
            box.parent.running += box.running
    root = boxes[0]
    if not root.total:
        return [], 0.0, False
    weight = (lambda b: b.running) if root.running else lambda b: b.total
    within: set[int] = set()
    outer = []
    for box in boxes:
        if box.parent is not None and id(box.parent) in within:
            within.add(id(box))
        elif box.tag in ("article", "main") and not box.noise and not box.lifted:
            within.add(id(box))
            if box.total:
                outer.append(box)
    if outer and 2 * sum(map(weight, outer)) >= weight(root):
        return outer, sum(map(weight, outer)) / weight(root), True
    here = root
    while True:
        below = [b for b in children.get(id(here), []) if b.tag not in ITEMS and weight(b) >= weight(here)]
        if not below:
            return [here], 1.0, False
        here = below[0]


def text_of(boxes: list[Container], blocks: list[Block], chosen: list[Container]) -> str:
    """The blocks below the chosen containers, after the headline before them, joined by line feeds; noise is left out.

    The headline is each ``h1`` before the first of them where they hold none, and
    whatever stands from a heading on in the elements around them.
    """
    wanted, under, around = set(map(id, chosen)), set(), set()
    for box in boxes:
        if id(box) in wanted or box.parent is not None and id(box.parent) in under:
            under.add(id(box))
    for box in chosen:
        at = box.parent
        while at is not None and id(at) not in around:
            around.add(id(at))
            at = at.parent
    seen = [b for b in blocks if not b.box.noise]
    first = next((i for i, b in enumerate(seen) if id(b.box) in under), 0)
    titled, lead, begun = any(b.tag == "h1" for b in seen if id(b.box) in under), [], False
    for b in seen[:first]:
        direct = id(b.box) in around
        title = b.tag == "h1" and not titled
        begun = begun or title or direct and b.tag in HEADINGS
        if title or direct and begun:
            lead.append(b.text)
    return "\n".join(lead + [b.text for b in seen[first:] if id(b.box) in under])


def _at_path(boxes: list[Container], path: str) -> list[Container]:
    """The containers at a path, found level by level."""
    keys = path.split(">")
    level = {id(boxes[0])} if keys[0] == boxes[0].key else set()
    depth, found = {id(boxes[0]): 0}, []
    for box in boxes:
        if box.parent is not None:
            depth[id(box)] = depth[id(box.parent)] + 1
            n = depth[id(box)]
            if id(box.parent) in level and n < len(keys) and box.key == keys[n] and not box.noise:
                level.add(id(box))
        if id(box) in level and depth[id(box)] == len(keys) - 1:
            found.append(box)
    return found


def analyse(html: str) -> tuple[list[Container], list[Block], list[Container], float, bool]:
    boxes, blocks = parse(html)
    _settle(boxes)
    return boxes, blocks, *context(boxes)


def extract(html: str | None, paths: list[str]) -> str:
    """The main text of a page, given the paths that its host agrees on.

    A path counts only where the page has no article of its own and half at least of its
    running text there.
    """
    if not html:
        return ""
    boxes, blocks, mine, _, article = analyse(html)
    if not mine:
        return ""
    for path in [] if article else paths:
        found = _at_path(boxes, path)
        if found and 2 * sum(b.running for b in found) >= boxes[0].running > 0:
            return text_of(boxes, blocks, found)
    return text_of(boxes, blocks, mine)


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1)), F.lit(""))


def vote(pages: DataFrame, url_col: str = "url", html_col: str = "html", agreement: float = 0.5) -> DataFrame:
    """(host, paths): the path that more than ``agreement`` of each host's votes are for, if there is one."""
    fields = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("share", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, str], float] = {}
            for name, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = html.as_py()
                best, share = analyse(text)[2:4] if text else ([], 0.0)
                if best:
                    key = name, best[0].path()
                    votes[key] = votes.get(key, 0.0) + share
            keys = list(votes)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([votes[k] for k in keys], pa.float64())], names=fields.names)

    votes = pages.select(host(F.col(url_col)).alias("host"), html_col).mapInArrow(run, fields)
    sums = votes.groupBy("host", "path").agg(F.round(F.sum("share"), 6).alias("votes"))
    won = sums.groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("path"), F.max("votes").alias("most"), F.sum("votes").alias("all"))
    return won.where(F.col("most") > agreement * F.col("all")).select("host", F.array("path").alias("paths"))


def extract_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 16 << 20) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` in place of the html.

    A null html, or one without text, has an empty text. Rows without a usable
    url share one unnamed host. Other columns pass through, save those named
    ``text`` or ``n_chars``; repeated rows are extracted each for itself but vote each,
    of equal votes no path wins, and an empty table gives no rows. A page of any length is read whole, in
    memory in proportion to it. The
    winners' table is broadcast where its measured size is below
    ``broadcast_bytes`` and joined by host beyond that.
    """
    winners = stored(vote(pages, url_col, html_col), "host-paths")
    key, paths = fresh(pages, "host", "paths")
    named = winners.select(F.col("host").alias(key), F.col("paths").alias(paths))
    small = small_enough(named, broadcast_bytes)
    joined = pages.withColumn(key, host(F.col(url_col))).join(F.broadcast(named) if small else named, key, "left")

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        html, won = batch.column(batch.schema.get_field_index(html_col)), batch.column(batch.schema.get_field_index(paths)).to_pylist()
        return {"text": pa.array([extract(h.as_py(), p or []) for h, p in zip(html, won, strict=True)], pa.string())}

    out = annotate(joined, run, [T.StructField("text", T.StringType())], drop=[key, paths, html_col])
    return out.withColumn("n_chars", F.length("text").cast("long"))
