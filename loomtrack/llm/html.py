"""Main text of web pages by site template removal.

Every element's subtree is hashed; Spark counts, per host, on how many different pages a
subtree stands and how many there are; what stands on at least half of them, inside an
article or not, is the site's template and is deleted. Blocks that a page itself marks as menu,
advert, form and the like by a whole name go too, as they may be unlike on every page. Pages that are copies of each
other count once, and a passage that a few articles of a host share stays.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrack.functions.shared import written
from loomtrack.llm.common import small_batches

#: On this share of a host's different pages, and on so many at least, a subtree must stand to be its template.
SHARE, MIN_PAGES = 0.5, 3
#: Up to so many templates go to the executors as a broadcast set (16 bytes each), and so many hosts with their page counts; more are joined.
BROADCAST_TEMPLATES = 200_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
DROPPED = frozenset("head nav footer aside form script style title noscript template iframe object svg canvas button select textarea dialog menu xmp".split())
#: Words in class, id or role that mark what is not the article, and words that may stand beside them in one name ("site-footer"; not "no-sidebar").
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies footer menu modal nav navbar navigation newsletter notice notices pager pagination popup promo related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
PLACES = frozenset("site page box block list wrapper wrap container area bar item section inner outer left right top bottom global primary secondary links panel group row col column".split())
#: Inside the article only these elements are dropped by a mark, and only where it is a whole class, id or role.
BOXES = frozenset("div section ul ol dl table figure header".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = frozenset("ul ol table article section div body html blockquote".split())
#: Elements that an opening tag may close, or that keep it from closing others. Only these are looked through, so time grows with a page's length, however deep it nests.
STOPS = LIMITS | frozenset(CLOSES) | {"p"}
#: A form that holds most of a page's text and one of these is not a form to fill in but the page itself.
FRAMED = frozenset("article main h1 p".split())

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: One attribute of a tag: name, and value without quotes, or the quote that opens it.
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:(["'])|([^\s>]*)))?""")
TAG_END = re.compile(r"[\s/]*>")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
WORD = re.compile(r"[^a-z]+")


def _tag(source: str, at: int) -> tuple[list[str], bool, int]:
    """(values of class, id and role; whether a slash stands before the end; place after the tag) of a tag whose name ends at ``at``.

    Values in quotes may hold any character. A quote that is never closed ends with the tag,
    at the next ``>``; a tag without an end takes the rest of the page. No place is read more than a few times.
    """
    found = []
    while True:
        end = TAG_END.match(source, at)
        if end:
            return found, source[end.end() - 2] == "/", end.end()
        m = ATTRIBUTE.match(source, at)
        if m is None:
            return found, False, len(source)
        value, at = m[3], m.end()
        if m[2]:
            close = source.find(m[2], at)
            if close < 0:
                close = source.find(">", at)
                value = source[at : close if close >= 0 else len(source)]
                at = close if close >= 0 else len(source)
            else:
                value, at = source[at:close], close + 1
        if value and m[1].lower() in ("class", "id", "role"):
            found.append(entities.unescape(value))


class Page:
    """The elements of a page in the order they open, and its text pieces.

    ``tags``, ``parents``, ``marked`` (0: no, 1: by a class, id or role made of marks and places, 2: by one
    that is a mark), ``hashes``, ``has_text`` and ``spans`` (first piece, piece after the last) go by
    element; a piece is (block number, element, text).
    """

    def __init__(self, source: str):
        self.tags, self.parents, self.marked, self.hashes, self.has_text = ["#"], [0], [0], [0], [False]
        self.spans = [(0, 0)]
        self.pieces: list[tuple[int, int, str]] = []
        inside: list[list[str]] = [[]]  # what each open element holds, as digests and texts
        stack = [0]
        opened: dict[str, int] = {}  # open elements by name
        stops: list[int] = []  # places on the stack of elements in STOPS
        block = at = 0

        def close(depth: int) -> None:
            while len(stack) > depth:
                node, held = stack.pop(), inside.pop()
                if stops and stops[-1] == len(stack):
                    stops.pop()
                if stack:
                    opened[self.tags[node]] -= 1
                digest = xxhash.xxh64_intdigest("\x1f".join(held).encode("utf-8", "surrogatepass"), 42)
                self.hashes[node] = digest - (1 << 64) if digest >> 63 else digest
                self.spans[node] = (self.spans[node][0], len(self.pieces))
                if stack:
                    inside[-1].append(f"\x1e{digest}")
                    if self.has_text[node]:
                        self.has_text[stack[-1]] = True

        def words(text: str) -> None:
            if not text:
                return
            text = entities.unescape(text) if "&" in text else text
            self.pieces.append((block, stack[-1], text))
            if flat := " ".join(text.split()):
                inside[-1].append(flat)
                self.has_text[stack[-1]] = True

        while at < len(source):
            start = source.find("<", at)
            if start != at:
                words(source[at : start if start >= 0 else len(source)])
                at = start if start >= 0 else len(source)
                continue
            m = NAME.match(source, at)
            if m is None:
                if source.startswith("<!--", at):
                    end = source.find("-->", at + 2)  # a comment may end with the dashes that open it
                    at = end + 3 if end >= 0 else len(source)
                elif source.startswith(("<!", "<?", "</"), at):
                    end = source.find(">", at)
                    at = end + 1 if end >= 0 else len(source)
                else:
                    words("<")
                    at += 1
                continue
            name = m[2].lower()
            values, slash, at = _tag(source, m.end())
            if m[1]:
                block += name in BLOCK
                if opened.get(name):
                    for depth in range(len(stack) - 1, 0, -1):
                        if self.tags[stack[depth]] == name:
                            close(depth)
                            break
                continue
            if name in BLOCK:
                block += 1
                for depth in reversed(stops):
                    if self.tags[stack[depth]] == "p":
                        close(depth)
                        break
                    if self.tags[stack[depth]] in LIMITS:
                        break
            i = len(stops) - 1 if name in CLOSES else -1
            while i >= 0:
                depth = stops[i]
                if self.tags[stack[depth]] in CLOSES[name]:
                    close(depth)
                    if name != "tr":
                        break
                elif self.tags[stack[depth]] in LIMITS:
                    break
                i -= 1
            if name in VOID:
                if name in ("br", "hr"):
                    self.pieces.append((block, stack[-1], " "))
                inside[-1].append(name)
                continue
            node = len(self.tags)
            self.tags.append(name)
            self.parents.append(stack[-1])
            named = [n for v in values for n in v.split()]
            split = [set(WORD.split(re.sub(r"([a-z])([A-Z])", r"\1-\2", n).lower())) - {""} for n in named]
            self.marked.append(2 if any(n.lower() in MARKS for n in named) else int(any(w <= MARKS | PLACES and w & MARKS for w in split)))
            self.hashes.append(0)
            self.has_text.append(False)
            self.spans.append((len(self.pieces), 0))
            if name in STOPS:
                stops.append(len(stack))
            stack.append(node)
            opened[name] = opened.get(name, 0) + 1
            inside.append([name, " ".join(values)])
            if name in RAW:
                end = RAW_END[name].search(source, at)
                inside[-1].append(" ".join(source[at : end.start() if end else len(source)].split()))
                at = _tag(source, end.end())[2] if end else len(source)
                close(len(stack) - 1)
            elif slash and name == "svg":
                close(len(stack) - 1)
        close(0)

    def cut(self) -> list[bool]:
        """Which elements are of a kind that is no text of a page, or lie in one; a form that holds most of the text stays."""
        own = [0] * len(self.tags)
        for _, node, piece in self.pieces:
            own[node] += len(piece.strip())
        other, size, framed = [False] * len(self.tags), [0] * len(self.tags), [False] * len(self.tags)
        for k in range(1, len(self.tags)):
            other[k] = other[self.parents[k]] or (self.tags[k] in DROPPED and self.tags[k] != "form")
        for k in range(len(self.tags) - 1, 0, -1):
            size[k] += 0 if other[k] else own[k]
            framed[k] = framed[k] or self.tags[k] in FRAMED
            size[self.parents[k]] += size[k]
            framed[self.parents[k]] = framed[self.parents[k]] or framed[k]
        total = size[0] + own[0]
        out = [False] * len(self.tags)
        for k in range(1, len(self.tags)):
            form = self.tags[k] == "form" and not (framed[k] and 2 * size[k] > total)
            out[k] = out[self.parents[k]] or other[k] or form
        return out

    def scope(self, cut: list[bool]) -> list[bool]:
        """Which elements lie in the article: article elements or a main element, whichever holds most text; else all.

        Article elements are preferred where they hold half of the main element's text at
        least, so that a teaser in an article element does not hide the main text.
        """
        own = [0] * len(self.tags)
        for _, node, piece in self.pieces:
            own[node] += len(piece)
        found, dropped = {}, [False] * len(self.tags)
        for wanted in ("article", "main"):
            inside, size = [False] * len(self.tags), 0
            for k in range(1, len(self.tags)):
                tag, parent = self.tags[k], self.parents[k]
                inside[k] = inside[parent] or tag == wanted
                dropped[k] = dropped[parent] or cut[k] or (self.marked[k] == 2 and tag in BOXES)
                size += own[k] if inside[k] and not dropped[k] else 0
            if any(inside):
                found[wanted] = (size, inside)
        if not found:
            return [True] * len(self.tags)
        if len(found) == 2:
            return found["article" if 2 * found["article"][0] >= found["main"][0] else "main"][1]
        return next(iter(found.values()))[1]

    def countable(self) -> list[bool]:
        """Which elements may be templates: those with text that share no block with text around them.

        So a word in bold or a link within a sentence is no template, and a paragraph or a span of its own is one.
        """
        filled = [k for k, (_, _, piece) in enumerate(self.pieces) if not piece.isspace()]
        found = [False] * len(self.tags)
        for k in range(1, len(self.tags)):
            if self.has_text[k] and self.tags[k] not in ("html", "body"):
                a, b = (bisect_left(filled, at) for at in self.spans[k])
                block = lambda at: self.pieces[filled[at]][0] if 0 <= at < len(filled) else -1
                found[k] = a == b or (block(a - 1) != block(a) and block(b) != block(b - 1))
        return found

    def candidates(self) -> list[int]:
        """The hashes of the subtrees to count."""
        return list({self.hashes[k] for k, yes in enumerate(self.countable()) if yes})

    def text(self, templates: frozenset[int] | set[int] = frozenset()) -> str:
        cut = self.cut()
        article = self.scope(cut)
        whole = all(article)
        gone = [False] * len(self.tags)
        countable = self.countable() if templates else gone
        for k in range(1, len(self.tags)):
            tag, inside = self.tags[k], article[k] and not whole
            root = tag in ("html", "body", "article", "main")
            gone[k] = (
                gone[self.parents[k]]
                or cut[k]
                or (tag == "header" and not inside)
                or (not root and self.marked[k] >= (2 if inside else 1) and tag in (BOXES if inside else BLOCK))
                or (countable[k] and self.hashes[k] in templates)
            )
        blocks: dict[int, list[str]] = {}
        for block, node, piece in self.pieces:
            if article[node] and not gone[node]:
                blocks.setdefault(block, []).append(piece)
        return "\n\n".join(t for pieces in blocks.values() if (t := " ".join("".join(pieces).split())))


def _host(url: str) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def subtrees(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(key, host, hash, content): the countable subtrees of each page, and a row with null hash for the page; ``content`` identifies its text."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes, contents = [], [], []
            for row, source in enumerate(batch.column(2).to_pylist()):
                page = Page(source or "")
                content = xxhash.xxh64_intdigest(page.text().encode("utf-8", "surrogatepass"), 42) - (1 << 63)
                for digest in (None, *page.candidates()):
                    rows.append(row), hashes.append(digest), contents.append(content)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(hashes, pa.int64()), pa.array(contents, pa.int64())], ["key", "host", "hash", "content"])

    return pages.select(F.xxhash64(url, html).alias("key"), _host(url).alias("host"), html).mapInArrow(run, "key long, host string, hash long, content long")


def _templates(found: DataFrame, broadcast_limit: int) -> DataFrame:
    """(host, hash) of the subtrees on at least ``SHARE`` of their host's different pages, and on ``MIN_PAGES`` at least."""
    seen = written(found.select("host", "hash", "content").distinct().groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES), "html-counts")
    hosts = seen.where("hash IS NULL").select("host", F.col("n").alias("pages"))
    few = hosts.count() <= broadcast_limit
    return seen.where("hash IS NOT NULL").join(F.broadcast(hosts) if few else hosts.hint("merge"), "host").where(F.col("n") >= SHARE * F.col("pages")).select("host", "hash")


def main_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", broadcast_limit: int = BROADCAST_TEMPLATES) -> DataFrame:
    """(page_id, url, text, n_chars), one row per page.

    A host with fewer than ``MIN_PAGES`` different pages has no templates; there tags and marks
    alone decide. Null or empty html gives an empty text; pages with a null url share the empty host.
    Repeated pages are returned as often as they come and count once as evidence. An empty
    table gives an empty result.
    """
    spark = pages.sparkSession
    found = written(subtrees(pages, html, url), "html-subtrees")
    templates = written(_templates(found, broadcast_limit), "html-templates")
    n = templates.count()
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), _host(url).alias("host"), F.col(html).alias("html"))
    if n <= broadcast_limit:
        shared = spark.sparkContext.broadcast({(r[0], r[1]) for r in templates.toLocalIterator()})
    else:
        shared = None
        per_page = found.join(templates.hint("merge"), ["host", "hash"]).groupBy("key").agg(F.collect_set("hash").alias("templates"))
        rows = rows.withColumn("key", F.xxhash64("url", "html")).join(per_page.hint("merge"), "key", "left").select("id", "url", "host", "html", "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_host: dict[str, set[int]] = {}
        for host, digest in shared.value if shared is not None else ():
            by_host.setdefault(host, set()).add(digest)
        for batch in batches:
            hosts = batch.column(2).to_pylist()
            known = [by_host.get(h, frozenset()) for h in hosts] if shared is not None else [set(t or ()) for t in batch.column(4).to_pylist()]
            texts = [Page(source or "").text(t) for source, t in zip(batch.column(3).to_pylist(), known)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [page_id, url, "text", "n_chars"])

    return rows.mapInArrow(run, f"`{page_id}` {pages.schema[page_id].dataType.simpleString()}, `{url}` string, text string, n_chars long")
