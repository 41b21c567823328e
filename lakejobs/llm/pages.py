"""Main text of web pages by paths that the pages of a host agree on.

Every page is read into blocks of text and containers. A container's score is the text that stands
directly in it, with links and boilerplate left out, and half of that of its children. Its path
is that of tags and classes from above, without numbers. Pages vote: each gives its containers' paths their shares
of its score, and Spark adds the votes of a host. Then every page is read again, and its text is
taken from the containers at the highest path that it has; a page without any keeps its own best one.
The best paths of a host are sent to all its pages; a page that has none of them is sent the best of its own.

Scripts, styles, forms, menus, side columns, page headers and footers, and containers that their
class, id or role marks as adverts, notices, comments and the like are never read.

The highest path tells where on a page the article is, not how far it goes: from a container at that path the text
is that of the nearest ``article`` or ``main`` around it, and of any container above that has text of its own
beside it, short of the whole body. So titles, leads, tables and what stands between them come back, in page order.

A null or empty page gives an empty text; so does one without text. A null or odd URL has the empty host, whose
pages vote together. Repeated rows stay, each with its own result. Only ``page_id``, ``url`` and
``html`` are read. No rows give no rows.

Pages meet the paths of their host by host and part: a host of many pages is cut into parts by the places of its
rows in the stored files, so no task holds a whole large host, exact copies included.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakejobs.llm.shared import saved
from lakejobs.operators.skew import stored_rows

# Pages of a host that may stand in one part, unless that would make more than MOST_PARTS parts of all pages.
PAGES_TOGETHER = 256
MOST_PARTS = 100_000
# Paths of a host that all its pages are tried with, best first.
PATHS_KEPT = 16
PATH_LENGTH = 6
# The elements of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
SKIPPED = frozenset("nav footer aside form button select datalist dialog menu svg math canvas audio video object head".split()) | RAW
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body center details div fieldset figure header main section table tbody td th tr html".split())
ENDS_PARAGRAPH = BLOCKS - {"br", "td", "th", "tr", "tbody", "option"}
# An element that a new one of its kind closes, and what bounds that.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
MARKED = re.compile(
    r"(?<![a-z])(?:ads?|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|"
    r"notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|sidebar|sidebars|widget|widgets|menu|menus|nav|"
    r"navbar|navigation|breadcrumb|breadcrumbs|footer|footers|masthead|topbar|toolbar|pagination|pager|comment|comments|disqus|reply|"
    r"replies|respond|related|recommended|recommendations|share|sharing|social|login|search|form|copyright|skip)(?![a-z])"
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
TAG = re.compile(
    r"""<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>?""", re.S
)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


class Page:
    """Blocks of text in page order and, for each container, its path and which blocks it holds."""

    def __init__(self, source: str) -> None:
        # How many elements of each tag are open.
        self.opened: dict[str, int] = defaultdict(int)
        self.blocks: list[str] = []
        # Container, and characters inside links, of each block.
        self.owner: list[int] = []
        self.linked: list[int] = []
        # (path, container above, first block, block after the last, tag)
        self.containers: list[list] = [["", -1, 0, 0, ""]]
        # (tag, container, skipped, inside a link)
        self.stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        self.parts: list[str] = []
        self.in_links = 0
        self.read(source)
        self.flush()
        while len(self.stack) > 1:
            self.close(len(self.stack) - 1)
        self.containers[0][3] = len(self.blocks)

    def text(self, part: str) -> None:
        _, _, skipped, link = self.stack[-1]
        if part and not skipped:
            part = html.unescape(part) if "&" in part else part
            self.parts.append(part)
            self.in_links += len(part) if link else 0

    def flush(self) -> None:
        """Ends a block; it belongs to the container that is open now."""
        if self.parts:
            block = " ".join("".join(self.parts).split())
            if block:
                self.blocks.append(block)
                self.owner.append(self.stack[-1][1])
                self.linked.append(self.in_links)
            self.parts, self.in_links = [], 0

    def close(self, depth: int) -> None:
        """Closes the element at a depth of the stack, and all inside it."""
        if any(self.stack[i][0] in BLOCKS for i in range(depth, len(self.stack))):
            self.flush()
        for i in range(len(self.stack) - 1, depth - 1, -1):
            tag, container, _, _ = self.stack[i]
            self.opened[tag] -= 1
            if container != self.stack[i - 1][1]:
                self.containers[container][3] = len(self.blocks)
        del self.stack[depth:]

    def close_in(self, tags: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> None:
        """Closes the outermost of some elements above the nearest of others."""
        if not any(self.opened[tag] for tag in tags):
            return
        found = None
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in until:
                break
            if self.stack[i][0] in tags:
                found = i
        if found:
            self.close(found)

    def open(self, tag: str, attributes: str) -> None:
        if tag in ENDS_PARAGRAPH:
            self.close_in({"p"}, CONTAINERS | {"li", "td", "th", "blockquote"} - {"p"})
        if tag in SIBLINGS:
            self.close_in(*SIBLINGS[tag])
        if tag in BLOCKS:
            self.flush()
        if tag in VOID:
            return
        _, container, skipped, link = self.stack[-1]
        marks = {}
        if attributes and not skipped:
            marks = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
        inside = self.opened["article"] or self.opened["main"]
        skipped = skipped or tag in SKIPPED or (tag == "header" and not inside) or self.marked(tag, marks)
        if tag in CONTAINERS and not skipped:
            names = sorted(re.sub(r"\d+", "", marks.get("class", "")).lower().split())
            step = ".".join([tag, *[n for n in names if n]])
            above = self.containers[container][0].split("/")[1 - PATH_LENGTH :]
            self.containers.append(["/".join([*[a for a in above if a], step]), container, len(self.blocks), len(self.blocks), tag])
            container = len(self.containers) - 1
        self.opened[tag] += 1
        self.stack.append((tag, container, skipped, link or tag == "a"))

    def marked(self, tag: str, marks: dict[str, str]) -> bool:
        if tag in ("html", "body", "article", "main"):
            return False
        if "hidden" in marks or marks.get("aria-hidden", "").lower() == "true" or marks.get("role", "").lower() in ROLES:
            return True
        # Words run together in capitals are told apart as well.
        names = re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{marks.get('class', '')} {marks.get('id', '')}").lower()
        return tag not in ("p", "b", "i", "em", "strong", "h1", "h2") and bool(MARKED.search(names))

    def read(self, source: str) -> None:
        at = 0
        while found := TAG.search(source, at):
            self.text(source[at : found.start()])
            at = found.end()
            if found[2] is None:
                continue
            tag = found[2].lower()
            if found[1]:
                if self.opened[tag]:
                    self.close(next(i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i][0] == tag))
                elif tag in BLOCKS:
                    self.flush()
                continue
            self.open(tag, found[3])
            if tag in RAW and tag not in ("noscript", "template"):
                # What stands up to the closing tag is no markup; nothing of it is read.
                end = re.compile(rf"</{re.escape(tag)}", re.I).search(source, at)
                at = end.start() if end else len(source)
        self.text(source[at:])

    def own_text(self) -> list[float]:
        """Characters that stand directly in each container, without blocks that are mostly links."""
        own = [0.0] * len(self.containers)
        for text, container, linked in zip(self.blocks, self.owner, self.linked):
            if 2 * linked <= len(text):
                own[container] += len(text) - linked
        return own

    def scores(self) -> list[float]:
        own = self.own_text()
        given = list(own)
        for i in range(len(own) - 1, 0, -1):
            given[self.containers[i][1]] += own[i] / 2
        return given

    def shares(self) -> dict[str, int]:
        """Thousandths of the page's score by path; the page itself is no candidate if it has containers."""
        by_path: dict[str, float] = defaultdict(float)
        for score, (path, *_) in zip(self.scores(), self.containers):
            by_path[path] += score
        whole = sum(by_path.values())
        return {path: int(1000 * s / whole) for path, s in by_path.items() if s} if whole else {}

    def paths(self) -> set[str]:
        """The paths that have text."""
        return {c[0] for c in self.containers if c[3] > c[2]}

    def whole(self) -> list[int]:
        """For each container the one that holds the article of which it is a part."""
        own, out = self.own_text(), [0]
        # The nearest article or main, and whether a container may be taken for a part of the one above.
        around = [0]
        for at, (_, above, _, _, tag) in enumerate(self.containers[1:], 1):
            around.append(at if tag in ("article", "main") else around[above])
            up, above_tag = around[at], self.containers[above][4]
            if up and up != at:
                out.append(out[up])
            else:
                out.append(out[above] if own[above] and above_tag not in ("", "html", "body") else at)
        return out

    def main_text(self, paths: list[str]) -> str:
        """The article around the containers at the first path that the page has; else around its best container."""
        have = self.paths()
        path = next((p for p in paths if p in have), None)
        if path is None:
            shares = self.shares()
            path = max(shares, key=lambda p: (shares[p], p), default="")
        whole = self.whole()
        chosen = sorted({whole[i] for i, c in enumerate(self.containers) if c[0] == path and c[3] > c[2]}, key=lambda i: self.containers[i][2:4])
        out, done = [], 0
        for i in chosen:
            _, _, first, last, _ = self.containers[i]
            out += self.blocks[max(first, done) : last]
            done = max(done, last)
        return " ".join(out)


def hosts(pages: DataFrame) -> DataFrame:
    """The columns that are read, the host, and a number that follows from the row's place in the stored files."""
    stored = stored_rows(pages.select("page_id", "url", "html"))
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    page_id = F.col("page_id").cast("long").alias("page_id")
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("place")
    return stored.select(page_id, "url", F.coalesce(host, F.lit("")).alias("host"), F.coalesce("html", F.lit("")).alias("html"), place)


def large_hosts(rows: DataFrame) -> DataFrame:
    """``host`` and ``parts`` of the hosts that are cut: fewer than MOST_PARTS rows, however many pages there are."""
    pages_in = rows.groupBy("host").agg(F.count("*").alias("n"))
    together = F.greatest(F.lit(PAGES_TOGETHER), rows.agg(F.count("*").alias("n")).scalar() / MOST_PARTS)
    return pages_in.select("host", F.ceil(F.col("n") / together).cast("int").alias("parts")).where(F.col("parts") > 1)


def votes(pages: DataFrame) -> DataFrame:
    """``host``, ``place`` and ``found`` of every page: the paths that have text on it, each with the page's vote or null."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("path", pa.string()), ("share", pa.int64())]))
        for batch in batches:
            found = []
            for source in batch.column("html").to_pylist():
                page = Page(source)
                shares = page.shares()
                found.append([{"path": p, "share": shares.get(p)} for p in sorted(page.paths())])
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("place"), pa.array(found, kind)], ["host", "place", "found"])

    schema = "host string, place long, found array<struct<path:string,share:long>>"
    return pages.select("host", "place", "html").mapInArrow(vote, schema)


def best_paths(added: DataFrame) -> DataFrame:
    """``host`` and its ``paths``, best first, at most PATHS_KEPT, from the votes added up by path."""
    # Spark takes the best paths of a host in each task before they meet.
    order = Window.partitionBy("host").orderBy(F.desc("share"), "path")
    best = added.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PATHS_KEPT)
    listed = best.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "path"))).alias("best"))
    return listed.select("host", F.transform("best", lambda b: b["path"]).alias("paths"))


def lower_paths(apart: DataFrame, listed: DataFrame, added: DataFrame) -> DataFrame:
    """``host``, ``part`` and ``lower``: place and best path of the part's pages that have none of the listed paths."""
    met = apart.join(listed, ["host", "part"])
    own = F.transform("found", lambda x: x["path"])
    without = met.where(~F.arrays_overlap(own, "paths")).select("host", "part", "place", F.explode(own).alias("path"))
    ranked = without.join(added, ["host", "path"]).groupBy("host", "part", "place").agg(F.min(F.struct(-F.col("share"), "path")).alias("best"))
    return ranked.groupBy("host", "part").agg(F.collect_list(F.struct("place", F.col("best.path").alias("path"))).alias("lower"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""
    rows = hosts(pages)
    large = F.broadcast(large_hosts(rows))
    parts = F.coalesce("parts", F.lit(1))
    part = F.pmod("place", parts).cast("int")
    voted = saved(votes(rows), "votes")
    cast = voted.select("host", F.explode("found").alias("one")).select("host", "one.path", "one.share").where("share IS NOT NULL")
    added = saved(cast.groupBy("host", "path").agg(F.sum("share").alias("share")), "added")
    # The paths of a host once for each of its parts; all hosts' parts together are few beside the pages.
    listed = best_paths(added).join(large, "host", "left").select("host", "paths", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    listed = saved(listed, "listed")
    lower = lower_paths(voted.join(large, "host", "left").withColumn("part", part).drop("parts"), listed, added)
    apart = rows.join(large, "host", "left").withColumn("part", part)
    met = apart.join(listed.join(lower, ["host", "part"], "left"), ["host", "part"], "left")
    of_page = F.transform(F.filter("lower", lambda x: x["place"] == F.col("place")), lambda x: x["path"])
    met = met.select("page_id", "url", "html", F.concat("paths", F.coalesce(of_page, F.array().cast("array<string>"))).alias("paths"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist())
            texts = [Page(source).main_text(paths or []) for source, paths in both]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return met.mapInArrow(read, "page_id long, url string, text string, n_chars long")


def op7_consensus_html(pages: DataFrame) -> DataFrame:
    return extract(pages)
