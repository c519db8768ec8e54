"""Main text of web pages by host paths that their pages agree on.

Each page's containers are scored by the running text in them. A container's path is the tags and first class names
from the root to it, with digits as 0. The pages of a host vote, each for all its paths with the score of the best container there, and the path
with most votes is the host's. Every page is then read again and gives, in page order, the text of all its containers
on that path; a page without one, or without a host, gives that of all on its own best container's path. A page whose containers on the
host's path score less than a LEAVES-th of those on another that has half as many votes or more, and is not above it, takes that. A container
in an article element stands for the whole element. Headings right in an element around these, below the body, are
given too.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out, by
element or by class, id and role names. Blocks have their character references decoded and their white space turned
into single spaces, and are joined by line feeds. Null or empty html gives an empty text; repeated rows give equal
results; an empty table gives an empty result. No page's text is cut, however long or deep: a page takes time and
memory in proportion to its length. A tag without an end is text, a comment or section without one reaches to the end.
A link begins at an `a` with an address and ends at the next `a`, or with the element it begins in. A form that holds an article or
most of the page's text is the page's, and so is a header or aside that holds an article and most text. Of equal scores the first container leads, and of equal votes the
last path by name. Other columns of pages, whatever their names, are not read.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import small_batches, stored
from quern.llm.url_rules import host_of

#: Hosts whose paths are sent to every executor; with more, pages meet them in a salted join.
BROADCAST_HOSTS, SALTS = 100_000, 32
#: A page leaves its host's path where that has less than this part of the score of another path that the host's pages vote for.
LEAVES = 4

_MARK = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|[!?])")
_STOP = re.compile(r"=\s*([\"'])|>")
_NAME = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HREF = re.compile(r"\bhref\s*=", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")

# Fixed values of HTML: elements without content, with raw content, that stand as blocks, and that end others.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe xmp noembed noframes svg math title textarea object canvas".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
CLOSES = {t: frozenset({"p"}) for t in BLOCKS - {"body", "head", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option"}} | {
    "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}), "option": frozenset({"option"}),
}
_END = {t: re.compile(f"</{t}", re.I | re.A) for t in RAW}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element of the key's kind does not reach out of these.
SCOPES = {"li": frozenset({"ul", "ol", "menu", "dir"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}), "tr": frozenset({"table"}), "td": frozenset({"tr", "table"}), "th": frozenset({"tr", "table"})}
EDGES = frozenset({"article", "aside", "body", "div", "main", "section", "table", "td", "th", "blockquote", "form", "nav", "header", "footer"})
# What is no part of an article: by element, and by words of class, id and role names.
OUT_TAGS = frozenset("nav header footer aside form menu button select dialog".split())
OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle banner breadcrumb breadcrumbs byline comment comments commentlist complementary contentinfo consent cookie cookies disclaimer disqus feedback footer form gdpr header login masthead "
    "menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promotion promoted recommended related remark reply replies respond responses search share sharing sidebar signup social sponsor sponsored subscribe subscription toc toolbar widget".split()
)
#: Those of them that are readers' own: much text in them is no sign that they hold the article.
READERS = frozenset("comment comments commentlist disqus feedback remark reply replies respond responses".split())


class Page:
    """A page's elements and blocks. Elements are numbered in page order; 0 is the root.

    Reading takes time and memory in proportion to the page, whatever is in it: paths are numbers of (path above, step),
    open elements are found by tag, and what a search did not find is not searched for again.
    """

    def __init__(self, html: str):
        self.parent, self.tag, self.path, self.out, self.readers = [0], [""], [0], [False], [False]
        self.paths: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._read(html)

    def path_of(self, e: int) -> str:
        """The steps from the root to an element."""
        steps = []
        while e:
            steps.append(self._step[self.path[e]])
            e = self.parent[e]
        return ">".join(reversed(steps))

    def path_named(self, path: str) -> int | None:
        """The number of a path in this page."""
        at: int | None = 0
        for step in path.split(">") if path else ():
            if (at := self.paths.get((at, step))) is None:
                return None
        return at

    def _element(self, up: int, tag: str, attributes: str) -> int:
        first, out, readers = "", tag in OUT_TAGS, False
        if attributes and "=" in attributes:
            for m in _NAME.finditer(attributes):
                value = (m[2] or m[3] or m[4] or "").lower()
                if m[1].lower() == "class" and value.split():
                    first = "." + re.sub("[0-9]+", "0", value.split()[0]).replace(">", "")
                if tag not in ("html", "body") and not OUT_NAMES.isdisjoint(names := _SPLIT.split(value)):
                    out, readers = True, readers or not READERS.isdisjoint(names)
        self.parent.append(up)
        self.tag.append(tag)
        self.path.append(self.paths.setdefault((self.path[up], tag + first), len(self.paths) + 1))
        self.out.append(out)
        self.readers.append(readers)
        return len(self.tag) - 1

    def _read(self, html: str) -> None:
        stack, at, words, links, in_link = [0], 0, [], 0, 0
        opened: dict[str, list[int]] = {}  # places in the stack of each tag's open elements
        last, quoted, absent, end = html.rfind(">"), True, set(), len(html)

        def flush() -> None:
            nonlocal words, links
            if words:
                text = " ".join("".join(words).split())
                if text:
                    self.blocks.append((stack[-1] if len(stack) > 1 else 0, text, links))
                words, links = [], 0

        def add(raw: str) -> None:
            nonlocal links
            text = _html.unescape(raw) if "&" in raw else raw
            words.append(text)
            if in_link:
                links += len(text)

        def close(k: int) -> None:
            nonlocal in_link
            for e in stack[k:]:
                opened[self.tag[e]].pop()
            del stack[k:]
            if in_link > k:
                in_link = 0

        def nearest(tags: frozenset[str]) -> int:
            return max((own[-1] for t in tags if (own := opened.get(t))), default=0)

        def past(mark: str, start: int) -> int:
            """Behind the next mark, or the end of the page."""
            k = html.find(mark, start)
            return end if k < 0 else k + len(mark)

        def tag_end(start: int) -> int:
            """The place of the `>` that ends a tag. Where quotes leave none, they no longer count in the page."""
            nonlocal quoted
            k = start
            while quoted:
                m = _STOP.search(html, k)
                if m and m[1] is None:
                    return m.start()
                k = html.find(m[1], m.end()) + 1 if m else 0
                quoted = k > 0
            return html.find(">", start)

        while at < end:
            m = _MARK.search(html, at)
            if m is None:
                add(html[at:])
                break
            if m.start() > at:
                add(html[at : m.start()])
            tag = m[2]
            if tag is None:
                if html.startswith("<!--", m.start()):
                    at = past("-->", m.start() + 2)
                elif html.startswith("<![CDATA[", m.start()):
                    at = past("]]>", m.end())
                    add(html[m.start() + 9 : at - 3 if html.endswith("]]>", m.end(), at) else at])
                else:
                    at = past(">", m.end())
                continue
            if m.end() > last:  # no tag ends from here on
                add(html[m.start() :])
                break
            stop = tag_end(m.end())
            attributes, at, tag = html[m.end() : stop], stop + 1, tag.lower()
            if m[1]:
                if tag == "a":
                    in_link = 0
                if tag in BLOCKS:
                    flush()
                    if own := opened.get(tag):
                        close(own[-1])
                continue
            if tag in RAW:
                alone, skips = attributes.endswith("/"), tag not in ("svg", "math", "object", "canvas")
                if not alone or tag in ("script", "style", "textarea", "title"):
                    k = None if tag in absent else _END[tag].search(html, at)
                    if k:
                        at = past(">", k.start())
                    else:
                        absent.add(tag)
                        at = end if skips else at
                if tag in ("textarea", "title"):
                    flush()
                continue
            if tag in BLOCKS:
                flush()
                if ends := CLOSES.get(tag):
                    bound = nearest(SCOPES.get(tag, EDGES))
                    while (k := nearest(ends)) > bound:
                        closed = self.tag[stack[k]]
                        close(k)
                        if closed == "p":
                            break
                if tag != "hr":
                    opened.setdefault(tag, []).append(len(stack))
                    stack.append(self._element(stack[-1], tag, attributes))
            elif tag == "br":
                words.append(" ")
            elif tag == "a":  # how many elements are open where the link begins
                in_link = len(stack) if _HREF.search(attributes) else 0
        flush()
        self._step = {i: step for (_, step), i in self.paths.items()}

    def scored(self) -> dict[int, int]:
        """The score of each container: running text in its own blocks, and half of that one level deeper."""
        n = len(self.tag)
        size = [0] * n
        for e, text, _ in self.blocks:
            size[e] += len(text)
        for e in range(n - 1, 0, -1):
            size[self.parent[e]] += size[e]
        # a name like "with-sidebar" on an element that holds most of the page's text is no reason to leave it out
        self.gone = [False] * n
        holds = self._holds_article()
        for e in range(1, n):
            most = 2 * size[e] > size[0]
            spared = holds[e] or most and not self.readers[e]
            if self.tag[e] in OUT_TAGS:
                spared = spared if self.tag[e] == "form" else self.tag[e] in ("header", "aside") and holds[e] and most
            out = self.out[e] and not spared
            self.gone[e] = self.gone[self.parent[e]] or out
        score: dict[int, int] = {}
        for e, text, links in self.blocks:
            if self.gone[e]:
                continue
            worth = max(0, len(text) - 2 * links) * (2 if self.tag[e] in ("p", "pre", "blockquote") else 1)
            box = self.parent[e] if self.tag[e] in ("p", "pre", "li", "h1", "h2", "h3", "h4", "h5", "h6") else e
            score[box] = score.get(box, 0) + 2 * worth
            up = self.parent[box]
            if box:
                score[up] = score.get(up, 0) + worth
        for e in score:
            if self.tag[e] in ("article", "main"):
                score[e] *= 2
        return {e: s for e, s in score.items() if s > 0}

    def _holds_article(self) -> list[bool]:
        holds = [t in ("article", "main") for t in self.tag]
        for e in range(len(holds) - 1, 0, -1):
            if holds[e]:
                holds[self.parent[e]] = True
        return holds

    def text_of(self, boxes: list[int]) -> str:
        inside, around, article = [False] * len(self.tag), [False] * len(self.tag), [0] * len(self.tag)
        for e in range(1, len(self.tag)):
            article[e] = e if self.tag[e] == "article" else article[self.parent[e]]
        for e in boxes:
            e = article[e] or e
            inside[e] = True
            while (e := self.parent[e]) and not around[e] and self.tag[e] not in ("html", "body"):
                around[e] = True
        for e in range(1, len(self.tag)):
            inside[e] = inside[e] or inside[self.parent[e]] or (self.tag[e] in HEADINGS and around[self.parent[e]])
        return "\n".join(text for e, text, _ in self.blocks if inside[e] and not self.gone[e])


def candidates(html: str) -> list[tuple[str, int]]:
    """A page's paths with containers, each with its best one's score in thousandths of the page's best, where that is one at least."""
    page = Page(html)
    best: dict[int, tuple[int, int]] = {}
    for e, s in page.scored().items():
        if s > best.get(page.path[e], (0, 0))[0]:
            best[page.path[e]] = (s, e)
    most = max((s for s, _ in best.values()), default=1)
    return [(page.path_of(e), s * 1000 // most) for s, e in best.values() if s * 1000 >= most]


def main_text(html: str, path: str | None, others: list[str] | None = None) -> str:
    """The text of the containers on the path, or on one of the others that it falls far behind, or else on that of the page's best container."""
    page = Page(html)
    score = page.scored()
    if not score:
        return ""
    on = lambda p: [e for e in score if page.path[e] == p]
    total = lambda boxes: sum(score[e] for e in boxes)
    there = [] if path is None else on(page.path_named(path))
    for other in others or ():
        instead = on(page.path_named(other))
        if there and LEAVES * total(there) < total(instead):
            there = instead
    return page.text_of(there or on(page.path[min(score, key=lambda e: (-score[e], e))]))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hosts, paths, scores = [], [], []
        for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for p, s in candidates(html):
                hosts.append(host)
                paths.append(p)
                scores.append(s)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.int64())], names=["host", "box", "score"])


def host_paths(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(host, box, others): the path that each host's pages agree on, and those not above it with half as many votes or more."""
    asked = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).where("host <> '' and html is not null")
    sums = stored(asked.mapInArrow(_votes, "host string, box string, score bigint").groupBy("host", "box").agg(F.sum("score").alias("score")), "votes")
    best = sums.groupBy("host").agg(F.max(F.struct("score", "box")).alias("best"))
    second = sums.join(best, "host").where((2 * F.col("score") >= F.col("best.score")) & ~F.startswith(F.concat("best.box", F.lit(">")), F.concat("box", F.lit(">"))))
    others = second.groupBy("host").agg(F.array_sort(F.collect_list("box")).alias("others"))
    return best.join(others, "host", "left").select("host", F.col("best.box").alias("box"), "others")


def extract_text(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """(key, url, text, n_chars) of each row."""
    kind = pages.schema[key].dataType.simpleString()
    small_batches(pages.sparkSession)
    agreed = stored(host_paths(pages, html, url), "paths")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    if agreed.count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(agreed), "host", "left")
    else:
        salted = agreed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, p, o) if h else "" for h, p, o in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["key", "url", "text", "n_chars"])

    out = joined.select("key", "url", "html", "box", "others").mapInArrow(read, f"key {kind}, url string, text string, n_chars bigint")
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text", "n_chars")
