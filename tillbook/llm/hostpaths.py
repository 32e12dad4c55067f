"""Main text of web pages by paths that a host's pages agree on.

1. Every page scores its containers by the text in them that is no link, and
   votes for the one that holds the article. A vote is the container's path:
   tags with their classes, digits generalised, from the body down.
2. Votes are counted per host and path in Spark. A path wins if it has at least
   ``LEAST_SHARE`` of the host's votes, so a host has at most 1 / LEAST_SHARE.
3. Every page is read again; its text is that of the containers on the winning
   path with most votes that it has, or of its own best container if it has none.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are left out in both passes, by tag, role, and words in class or id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tillbook.session import cut_lineage, shared_dir

LEAST_SHARE = 0.1
# Copies of a host's winning paths; a host's pages meet them in as many places.
SALTS = 16

# A child holds the article if it has so much of its parent's text, and the parent has little of its own.
_MOST_OF = 0.75
_LITTLE_OF = 0.1
# Text in what is marked as the article counts so many times.
_MARKED = 3

_CONTAINERS = frozenset("body main article section div td center".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BLOCKS = _CONTAINERS | _HEADINGS | frozenset(
    """html head address aside blockquote caption dd details dialog dir dl dt fieldset figcaption figure footer form frameset
    header hgroup hr legend li menu nav ol optgroup option p pre search summary table tbody tfoot th thead tr ul""".split())
_VOID = frozenset("area base br col embed frame hr img input keygen link meta param source track wbr".split())
_IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
# The text in them is no markup.
_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in "script style textarea title xmp iframe noembed noframes".split()}
_NEVER = frozenset(
    """head script style textarea title iframe noembed noframes noscript template svg math canvas audio video object applet
    button select datalist option optgroup label input legend nav aside footer dialog menu search map""".split())
# Left out unless the article is inside.
_UNLESS_ARTICLE = frozenset("header form".split())
_ROLES = frozenset(
    """navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar tablist alert status
    tooltip""".split())
# Words of class or id that mark what is no article; those of the second list may also mark what holds one.
_MARKS = frozenset(
    """ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promoted promotion
    comment comments disqus respond cookie cookies consent gdpr newsletter subscribe subscription signup popup modal lightbox
    share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager""".split())
_SOFT_MARKS = frozenset(
    """nav navbar navigation menu submenu header masthead banner topbar toolbar footer sidebar sidebars rail notice notices
    notification alert disclaimer copyright widget widgets overlay""".split())
# An open element of the first kind ends where one of the second begins, looked for up to one of the third.
_ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])), "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())), "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    **dict.fromkeys("tbody thead tfoot".split(), (frozenset("tbody thead tfoot".split()), frozenset(["table"]))),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_HOLDS_P = frozenset("td th table caption button object body".split())

_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
# Quotes hide what ends a tag, in tags of so many parts; in a longer one the first > ends it.
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'){0,2000}+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_OF_INTEREST = re.compile(r"class|id|role|hidden|style", re.I)
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HOST = re.compile(r"\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")

NEVER, UNLESS_ARTICLE = 1, 2


def host_of(url: str | None) -> str:
    """The host of an address in lower case; empty without one."""
    found = _HOST.match(url or "")
    return found.group(1).lower() if found else ""


@lru_cache(maxsize=8192)
def _element(tag: str, attributes: str) -> tuple[int, str]:
    """Whether an element is left out (NEVER, UNLESS_ARTICLE or 0), and its step of a path."""
    out = NEVER if tag in _NEVER else UNLESS_ARTICLE if tag in _UNLESS_ARTICLE else 0
    if not _OF_INTEREST.search(attributes):
        return out, tag
    known: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(attributes):
        known.setdefault(name.lower(), unescape(value.strip("\"'")))
    classes = known.get("class", "").split()
    if tag in ("html", "body", "main"):
        marked = 0
    elif tag == "article":  # comments are often articles of their own
        marked = NEVER if any(re.match(r"comment(?:$|[-_])", c, re.I) for c in classes) else 0
    else:
        words = {w.lower() for c in (*classes, known.get("id", "")) for w in _WORD.findall(c)}
        marked = NEVER if words & _MARKS else UNLESS_ARTICLE if words & _SOFT_MARKS or known.get("role", "").lower() in _ROLES else 0
    if "hidden" in known or known.get("aria-hidden", "").lower() == "true" or _HIDDEN_STYLE.search(known.get("style", "")):
        marked = NEVER if tag not in ("html", "body") else 0
    step = ".".join([tag, *sorted({re.sub("[0-9]+", "#", c.lower()) for c in classes})])
    return NEVER if NEVER in (out, marked) else max(out, marked), step


class Page:
    """Containers of one page, each with its path, and blocks of text, each in its nearest container."""

    def __init__(self, html: str):
        self.paths, self.parents, self.marked = ["body"], [-1], [False]
        # (container, text, characters of links, is a heading)
        self.blocks: list[tuple[int, str, int, bool]] = []
        # elements that are left out unless they hold the article: the one around, and whether they are rescued
        self._around, self._rescued = [-1], [True]
        found: list[tuple[int, str, int, bool, int]] = []
        self._read(html, found)
        kept = [True]
        for i in range(1, len(self._around)):
            kept.append(self._rescued[i] and kept[self._around[i]])
        self.blocks = [block[:4] for block in found if kept[block[4]]]

    def _read(self, html: str, found: list) -> None:
        # open elements: tag, then what held before: container, hidden, element that may be left out
        stack: list[tuple[str, int, bool, int]] = []
        container, hidden, soft, links, heading = 0, False, 0, 0, False
        parts: list[str] = []
        in_links = 0

        def flush():
            nonlocal in_links
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    found.append((container, text, in_links, heading, soft))
                parts.clear()
            in_links = 0

        def close(depth: int):
            nonlocal container, hidden, soft, heading
            _, container, hidden, soft = stack[depth]
            del stack[depth:]
            heading = False

        at, end = 0, len(html)
        while at < end:
            mark = html.find("<", at)
            text = html[at : mark if mark >= 0 else end]
            if text and not hidden:
                text = unescape(text) if "&" in text else text
                parts.append(text)
                if links:
                    in_links += len(text.strip())
            if mark < 0:
                break
            tag_at = _TAG.match(html, mark) or _PLAIN_TAG.match(html, mark)
            if not tag_at:
                follows = html[mark + 1 : mark + 2]
                if html.startswith("<!--", mark):
                    at = _COMMENT.match(html, mark).end()
                elif follows in ("!", "?", "/"):
                    close_at = html.find(">", mark)
                    at = close_at + 1 if close_at >= 0 else end
                elif follows.isascii() and follows.isalpha():  # a tag that the page's end cuts off
                    break
                else:
                    if not hidden:
                        parts.append("<")
                    at = mark + 1
                continue
            at = tag_at.end()
            closing, tag, attributes = tag_at.group(1), tag_at.group(2).lower(), tag_at.group(3)
            block = tag in _BLOCKS
            if closing:
                if tag == "a":
                    links = 0
                if block:
                    flush()
                    if tag in ("html", "body"):  # what follows them is still the page's
                        continue
                    # a cell, a list or a form ends only what it holds
                    for depth in range(len(stack) - 1, -1, -1):
                        if stack[depth][0] == tag:
                            close(depth)
                            break
                        if tag == "p" and stack[depth][0] in _HOLDS_P:
                            break
                else:
                    for depth in range(len(stack) - 1, -1, -1):
                        if stack[depth][0] == tag:
                            if hidden:
                                close(depth)
                            break
                        if stack[depth][0] in _BLOCKS and tag not in _NEVER:
                            break
                continue
            if tag == "br":
                if not hidden:
                    parts.append(" ")
                continue
            if tag == "a":
                links = 1
            if stack and stack[-1][0] == "head" and tag not in _IN_HEAD:
                close(len(stack) - 1)
            if block:
                flush()
                if tag not in ("html", "head", "option", "optgroup", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "legend"):
                    for depth in range(len(stack) - 1, -1, -1):
                        if stack[depth][0] == "p" or stack[depth][0] in _HEADINGS and tag in _HEADINGS:
                            close(depth)
                            break
                        if stack[depth][0] in _HOLDS_P or stack[depth][0] in _CONTAINERS:
                            break
                if tag in _ENDS:
                    ends, up_to = _ENDS[tag]
                    for depth in range(len(stack) - 1, -1, -1):
                        if stack[depth][0] in ends:
                            close(depth)
                            break
                        if stack[depth][0] in up_to:
                            break
            if tag in _VOID:
                continue
            out, step = _element(tag, attributes)
            if tag in _RAW:
                # its text is left out with it; only xmp shows
                last = _RAW[tag].search(html, at)
                if tag == "xmp" and not hidden:
                    flush()
                    parts.append(html[at : last.start() if last else end])
                    flush()
                at = _PLAIN_TAG.match(html, last.start()).end() if last and html.find(">", last.start()) >= 0 else end
                continue
            if not block:
                if hidden or out:
                    stack.append((tag, container, hidden, soft))
                    hidden = True
                continue
            if tag in ("html", "body"):
                continue
            stack.append((tag, container, hidden, soft))
            if tag in ("article", "main") and not (hidden or out):
                up = soft
                while up > 0 and not self._rescued[up]:
                    self._rescued[up] = True
                    up = self._around[up]
            if out == NEVER:
                hidden = True
            elif out and not hidden:
                self._around.append(soft)
                self._rescued.append(False)
                soft = len(self._around) - 1
            heading = tag in _HEADINGS
            # a heading rescues a header in the article
            if heading and soft and not hidden and self._in_article(container):
                self._rescued[soft] = self._rescued[soft] or any(t == "header" for t, *_ in stack)
            if tag in _CONTAINERS and not hidden:
                self.paths.append(f"{self.paths[container]}>{step}")
                self.parents.append(container)
                self.marked.append(tag in ("article", "main"))
                container = len(self.paths) - 1
        flush()

    def _in_article(self, container: int) -> bool:
        while container >= 0:
            if self.marked[container]:
                return True
            container = self.parents[container]
        return False

    def best(self) -> int:
        """The container that holds the article, -1 on a page without text."""
        n = len(self.paths)
        own, titled = [0] * n, [False] * n
        for container, text, links, heading in self.blocks:
            own[container] += max(0, len(text) - 2 * links)
            titled[container] |= heading
        if not self.blocks:
            return -1
        inside = [self.marked[0]] * n
        for i in range(1, n):
            inside[i] = self.marked[i] or inside[self.parents[i]]
        own = [x * (_MARKED if inside[i] else 1) for i, x in enumerate(own)]
        score, children = list(own), [[] for _ in range(n)]
        for i in range(n - 1, 0, -1):
            score[self.parents[i]] += score[i]
            children[self.parents[i]].append(i)
        at = 0
        while children[at] and not self.paths[at].rpartition(">")[2].startswith("article"):
            child = max(children[at], key=lambda c: (score[c], -c))
            if score[child] < _MOST_OF * score[at] or titled[at] or own[at] > _LITTLE_OF * score[at]:
                break
            at = child
        return at

    def text(self, winners: list[str]) -> str:
        """Blocks of the containers on the first winning path with text, or of the best container, one a line."""
        n = len(self.paths)
        for path in winners:
            chosen = [self.paths[i] == path for i in range(n)]
            lines = self._lines(chosen)
            if lines:
                return "\n".join(lines)
        best = self.best()
        return "\n".join(self._lines([i == best for i in range(n)])) if best >= 0 else ""

    def _lines(self, chosen: list[bool]) -> list[str]:
        for i in range(1, len(chosen)):
            chosen[i] = chosen[i] or chosen[self.parents[i]]
        return [text for container, text, *_ in self.blocks if chosen[container]]


# --- over a table -----------------------------------------------------------


def votes(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, n, chars): pages of a host that vote for a path, and the text they have there."""
    rows = pages.select(F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, chars = [], [], []
            for address, source in zip(batch.column(0), batch.column(1)):
                page = Page(source.as_py())
                best = page.best()
                if best >= 0:
                    hosts.append(host_of(address.as_py()))
                    paths.append(page.paths[best])
                    chars.append(sum(len(b[1]) for b in page.blocks))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(chars, pa.int64())], ["host", "path", "chars"])

    found = rows.mapInArrow(run, "host string, path string, chars long")
    return found.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


def winning_paths(counted: DataFrame) -> DataFrame:
    """(host, paths): paths with at least ``LEAST_SHARE`` of the host's votes, most votes first, then most text, then the path."""
    totals = counted.groupBy("host").agg(F.sum("n").alias("total"))
    won = counted.join(totals, "host").where(F.col("n") >= LEAST_SHARE * F.col("total"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), (-F.col("chars")).alias("chars"), "path")))
    return won.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame, *, keep: list, url: str = "url", html: str = "html", paths: DataFrame | None = None) -> DataFrame:
    """Columns ``keep`` of every page, with text (its main text, a block a line) and n_chars (code points).

    Winning paths are those of ``paths``, or found from ``pages`` and written to
    the shared folder; Spark broadcasts them where the written files are small,
    and joins them by host and salt where they are not. White space, as Unicode
    has it, is one space in a block; a line break of the markup is white space.
    Null and empty pages have empty text. Pages without an address share the
    host ''. Repeated rows stay; an empty table gives no rows. ``keep`` must not
    hold ``text`` or ``n_chars``.
    """
    spark = pages.sparkSession
    if paths is None:
        import uuid

        folder = f"{shared_dir(spark)}/paths-{uuid.uuid4().hex}"
        # cut here, as the totals need the counts twice
        winning_paths(cut_lineage(votes(pages, url=url, html=html))).write.parquet(folder)
        paths = spark.read.schema("host string, paths array<string>").parquet(folder)
    salted = paths.select(F.col("host").alias("__host"), F.col("paths").alias("__won"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    source = F.coalesce(F.col(html), F.lit(""))
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), _HOST.pattern.replace(r"\s*", r"^\s*", 1), 1))
    rows = pages.select(
        *keep, source.alias("__html"), host.alias("__at"), F.pmod(F.xxhash64(source), F.lit(SALTS)).cast("int").alias("__part"))
    kept = [f for f in rows.schema.fields if f.name not in ("__html", "__at", "__part")]
    joined = rows.join(salted, (F.col("__at") == F.col("__host")) & (F.col("__part") == F.col("__salt")), "left")
    joined = joined.select(*[F.col(f"`{f.name}`") for f in kept], "__html", F.coalesce("__won", F.array().cast("array<string>")).alias("__paths"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            texts = [Page(h.as_py()).text(p.as_py()) for h, p in zip(batch.column(n - 2), batch.column(n - 1))]
            columns = [*batch.columns[: n - 2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[: n - 2], "text", "n_chars"])

    return joined.mapInArrow(run, StructType([*kept, StructField("text", StringType()), StructField("n_chars", LongType())]))
