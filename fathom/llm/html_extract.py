"""HTML extraction by consensus host paths.

First pass: every page's containers are scored by the text of the blocks they
hold (a block counts whole for its container and half for the container
around it; linked text counts against it), and the best one votes with its
generalised path: the tags from the root, each with its classes in order and
without digits, such as ``html/body/div.post-#``. The votes are summed per
host in Spark. Second pass: a page is extracted again with its host's paths,
the one with most votes first; the first path that leads to text on the page
is taken. A page on which no path of its host does takes its own best
container, so a page is never lost to the vote.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments are known by tag, role or class words (``CHROME``), and
are neither scored nor extracted; a header inside an article belongs to
it. Blocks are the runs of text between block tags, line breaks are
white space inside a block.

Defined cases: null or empty html has empty text. A null url, or one without
"://", has the empty host, which votes like any other. Unclosed elements end
with the page or with the element around them; truncated tags and comments are
dropped. Ties between containers go to the one that starts first, ties
between paths to the one in code-point order. Repeated rows are pages of their
own. An empty table gives an empty table. Only the named columns are read.

Skew: votes are partially aggregated, one row per (host, path) and task. A
host's paths are at most 1 / ``LEAST_SHARE``. Winners within
``BROADCAST_BYTES`` as measured are broadcast and no html is shuffled. Beyond
it only the winners of hosts with at least ``HOT_SHARE`` of all pages (so at
most 1 / ``HOT_SHARE`` hosts) are broadcast, and the rest is joined by host,
none of which holds more than that share.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.common import chunks, pylist, store
from fathom.llm.url_filter import host_of

LEAST_SHARE, HOT_SHARE = 0.05, 0.001
BROADCAST_BYTES = 16 << 20

# HTML's own lists of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes xmp svg math object title textarea select".split())
CONTAINERS = frozenset("html body main article section div td center blockquote".split())
BLOCKS = CONTAINERS | frozenset("""p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre table tr th thead tbody tfoot caption figure figcaption
    address header footer nav aside form fieldset details summary hr head menu dialog hgroup legend""".split())
ENDS_P = BLOCKS - {"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol dl table".split())
# What is never main text, by tag, by role and by the words of classes and ids.
CHROME_TAGS = frozenset("head nav footer aside form menu button dialog fieldset label".split())
CHROME = re.compile(r"""(?:^|(?<!has)(?<!with)(?<!no)[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside
    |(?<!post.)(?<!entry.)(?<!article.)header|masthead|footer|foot|banner|ads?|advert|adverts|advertisement|adsense|sponsor|sponsored|promo|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|share|sharing|social|related
    |comments?|commentlist|respond|disqus|replies|newsletter|subscribe|signup|login|search|widget|pagination|pager|toolbar|skip|complementary
    |contentinfo)(?=$|[\s_-])""", re.I | re.X)
# Containers whose headers are the article's own.
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content)(?=$|[\s_-])", re.I)
# One token: a comment or declaration, a tag, or the text up to the next "<".
TOKEN = re.compile(r"""[^<]+|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*'|["'])*+)(>|\Z)|<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<[^<]*""", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
DIGITS = re.compile(r"[\d/]+")


def _attributes(text: str) -> dict[str, str]:
    return {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(text)} if text.strip() else {}


class Page:
    """The blocks of one page: ``blocks`` holds (text, linked characters,
    number of the container), ``parent`` and ``path`` describe containers.

    Paths are numbers of (path around it, label) pairs, so a deeply nested
    page takes one step per element."""

    def __init__(self, html: str) -> None:
        self.blocks: list[tuple[str, int, int]] = []
        self.parent, self.path = [-1], [-1]
        self.numbers: dict[tuple[int, str], int] = {}
        self.labels: list[tuple[int, str]] = []
        self._parse(html)

    def _parse(self, html: str) -> None:
        # open elements: (tag, container, inside chrome, inside an article, inside a link)
        stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
        held: list[str] = []
        linked, at, n = 0, 0, len(html)
        opened: Counter[str] = Counter()    # open elements by tag: nothing is looked for in vain
        endless: set[str] = set()           # raw elements without an end tag further on

        def flush(container: int) -> None:
            nonlocal linked
            if held and (text := " ".join("".join(held).split())):
                self.blocks.append((text, min(linked, len(text)), container))
            held.clear()
            linked = 0

        def close(down_to: int) -> None:
            for i in range(len(stack) - 1, down_to - 1, -1):
                if stack[i][0] in BLOCKS:
                    flush(stack[i][1])
                opened[stack[i][0]] -= 1
            del stack[down_to:]

        while at < n:
            m = TOKEN.match(html, at)
            at = m.end()
            tag = m.group(2)
            if tag is None:
                token = m.group()
                if not stack[-1][2] and not (token[0] == "<" and token[1:2] in ("!", "?")):
                    text = entities.unescape(token)
                    held.append(text)
                    linked += len(text) if stack[-1][4] else 0
                continue
            if not m.group(4):      # the page ends inside a tag
                break
            tag = tag.lower()
            if m.group(1):
                for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                    if stack[i][0] == tag:
                        close(i)
                        break
                continue
            if tag in RAW:
                if m.group(3).endswith("/") or tag in endless:
                    continue
                end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(html, at)
                at = end.end() if end else (n if tag in ("script", "style") else at)
                if not end:
                    endless.add(tag)
                continue
            if tag in ENDS_P and opened["p"]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        close(i)
                        break
                    if stack[i][0] in BLOCKS:
                        break
            if (same := SIBLINGS.get(tag)) and any(opened[x] for x in same):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in same and (i + 1 == len(stack) or tag != "tr" or stack[i][0] == "tr"):
                        close(i)
                        break
                    if stack[i][0] in SCOPES:
                        break
            _, container, chrome, article, link = stack[-1]
            if tag in BLOCKS:
                flush(container)
            if tag in VOID:
                if tag in ("br", "hr") and not chrome:
                    held.append(" ")
                continue
            a = _attributes(m.group(3))
            names = f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}"
            if not chrome and (tag in CHROME_TAGS or (tag == "header" and not article) or "hidden" in a or a.get("aria-hidden") == "true"
                               or (names != "  " and tag not in ("html", "body", "main") and CHROME.search(names))):
                chrome = True
            if tag in CONTAINERS:
                label = ".".join([tag, *sorted(DIGITS.sub("#", c) for c in set(a.get("class", "").split()))])
                around = self.path[container]
                number = self.numbers.setdefault((around, label), len(self.labels))
                if number == len(self.labels):
                    self.labels.append((around, label))
                self.parent.append(container)
                self.path.append(number)
                container = len(self.parent) - 1
            article = article or tag in ("article", "main") or (tag in CONTAINERS and ARTICLE.search(names) is not None)
            stack.append((tag, container, chrome, article, link or tag == "a"))
            opened[tag] += 1
        close(0)
        flush(0)

    def best(self) -> tuple[int, float]:
        """The container with the highest score, the first of equal ones."""
        score = [0.0] * len(self.parent)
        for text, links, c in self.blocks:
            x = len(text) - 2.0 * links
            score[c] += x
            if self.parent[c] >= 0:
                score[self.parent[c]] += x / 2
        at = max(range(len(score)), key=lambda i: (score[i], -i))
        return at, score[at]

    def path_text(self, container: int) -> str:
        labels, at = [], self.path[container]
        while at >= 0:
            at, label = self.labels[at]
            labels.append(label)
        return "/".join(reversed(labels))

    def text_at(self, path: str) -> list[str]:
        """Blocks inside every container with that path, in page order."""
        number = -1
        for label in path.split("/") if path else []:
            number = self.numbers.get((number, label))
            if number is None:
                return []
        inside = [False] * len(self.parent)
        for i, p in enumerate(self.path):
            inside[i] = p == number or (self.parent[i] >= 0 and inside[self.parent[i]])
        return [t for t, _, c in self.blocks if inside[c]]

    def main_text(self, paths: list[str]) -> tuple[str, str | None]:
        """The text by the first path that finds any, and that path."""
        for path in paths:
            if found := self.text_at(path):
                return "\n\n".join(found), path
        if not self.blocks:
            return "", None
        own = self.path_text(self.best()[0])
        return "\n\n".join(self.text_at(own)), own


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "_html", 16 << 20, 2048):
        out = []
        for host, html in zip(pylist(b, "_host"), pylist(b, "_html")):
            page = Page(html)
            path = page.path_text(page.best()[0]) if page.blocks else None
            out.append((host, path))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], names=["_host", "_path"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "_html", 16 << 20, 2048):
        got = [Page(h).main_text(p or []) for h, p in zip(pylist(b, "_html"), pylist(b, "_paths"))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.string())],
                                         names=["_id", "_url", "text", "path"])


def _pages(pages: DataFrame, id_col: str, url: str, html: str) -> DataFrame:
    return pages.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url}`").alias("_url"), host_of(F.col(f"`{url}`")).alias("_host"),
                        F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("_html"))


def host_paths(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per host: _pages and _paths, those with at least ``LEAST_SHARE`` of the
    votes, most first."""
    votes = (_pages(pages, id_col, url, html).select("_host", "_html").mapInArrow(_vote, "_host string, _path string")
             .groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("_votes")))
    total = F.sum("_votes").over(Window.partitionBy("_host"))
    kept = votes.withColumn("_pages", total).where(F.col("_path").isNotNull() & (F.col("_votes") >= LEAST_SHARE * F.col("_pages")))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("_votes")).alias("v"), F.col("_path").alias("p"))))
    return kept.groupBy("_host").agg(F.max("_pages").alias("_pages"), F.transform(ranked, lambda x: x["p"]).alias("_paths"))


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html",
            broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per page: ``id_col``, ``url``, text, n_chars and the path taken."""
    own, winners = _pages(pages, id_col, url, html), store(host_paths(pages, id_col, url, html), "host-paths")
    seen = winners.agg(F.sum(F.octet_length("_host") + F.octet_length(F.array_join("_paths", "/")) + 64).alias("b"), F.sum("_pages").alias("n")).first()
    if (seen["b"] or 0) <= broadcast_bytes:
        found = own.join(F.broadcast(winners), "_host", "left")
    else:
        hot = F.broadcast(winners.where(F.col("_pages") >= HOT_SHARE * seen["n"]))
        found = own.join(hot, "_host").unionByName(own.join(hot.select("_host"), "_host", "left_anti").join(
            winners.hint("shuffle_hash"), "_host", "left"))
    types = f"_id {own.schema['_id'].dataType.simpleString()}, _url {own.schema['_url'].dataType.simpleString()}, text string, path string"
    got = found.select("_id", "_url", "_html", "_paths").mapInArrow(_extract, types)
    return got.select(F.col("_id").alias(id_col), F.col("_url").alias(url), "text", F.length("text").cast("long").alias("n_chars"), "path")
